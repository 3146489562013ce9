import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioflow.functions import numbers, values, words
from folioflow.operators import candidates, tables
from folioflow.plans import report, views
from folioflow.sources import files
from folioflow.streaming import ingest


def test_two_reports_in_one_plan(spark):
    rows = spark.createDataFrame([("a", '{"firma": true}'), ("b", "{}")], "name string, payload string")
    one = report.report_rows(rows, "name", "payload", report.Rules(), "2026-02-28")
    two = report.report_rows(rows, "name", "payload", report.Rules(max_months=3), "2026-02-28")
    assert one.unionByName(two).count() == 4 and one.unionByName(one).count() == 4
    assert one.alias("x").join(two.alias("y"), "nombre_archivo").count() == 2


def brute_ctc(p, text, alphabet, penalty=2.5):
    """The best over all ways to label every frame: outside, blank or a letter, in order."""
    letters = [c for c in text if c != " "]
    states = [None] + [x for c in letters for x in (c, None)]
    log = lambda x: math.log(x + 1e-12)
    best = [log(max(row)) for row in p]
    free = [b - (0 if np.argmax(row) == 0 else penalty) for b, row in zip(best, p)]
    emit = lambda s, row: log(row[0]) if s is None else log(sum(row[i + 1] for i, a in enumerate(alphabet) if candidates._same_letter(s, a)))
    top = -math.inf
    for start, end in itertools.combinations_with_replacement(range(len(p)), 2):
        inside = range(start, end + 1)
        for path in itertools.product(range(len(states)), repeat=len(inside)):
            ok = path[0] <= 1 and path[-1] >= len(states) - 2 and all(
                b == a or b == a + 1 or (b == a + 2 and states[b] is not None and states[a] is not None and states[a] != states[b]) for a, b in zip(path, path[1:], strict=False))
            if ok:
                top = max(top, sum(emit(states[s], p[k]) for s, k in zip(path, inside, strict=True)) + sum(free[:start]) + sum(free[end + 1 :]))
    return top - sum(best)


def test_ctc_scores_equal_all_paths(spark):
    r, alphabet = np.random.default_rng(4), "aáb"
    rows, want = [], []
    for n in (1, 2, 3, 4):
        for text in ("a", "b", "ab", "aa", "ÁB", "a b"):
            p = r.dirichlet([0.5] * 4, n)
            rows.append((len(rows), p.ravel().tolist(), n, text))
            want.append(brute_ctc(p, text, alphabet))
    df = spark.createDataFrame(rows, "i int, m array<double>, t int, c string")
    got = [x.score for x in candidates.ctc_scores(df, "m", "t", "c", alphabet).orderBy("i").collect()]
    # Where a text does not fit into the frames, no path is left.
    assert all(math.isclose(g, w, abs_tol=1e-6) or (math.isinf(w) and math.isinf(g)) for g, w in zip(got, want, strict=True))
    odd = spark.createDataFrame([(None, 1, "a"), ([1.0, 0.0], 1, None), ([1.0, 0.0], 1, "z")], "m array<double>, t int, c string")
    assert [x.score for x in candidates.ctc_scores(odd, "m", "t", "c", "a").collect()] == [None] * 3


def test_folders(spark, tmp_path):
    assert files.scan(spark, f"file://{tmp_path}/missing").count() == 0
    for name in ("b.PNG", "A.jpg", "c.heic", "d.GIF", "notes.txt", "~$x.png"):
        (tmp_path / name).write_bytes(name.encode())
    assert [r.name for r in files.in_order(files.scan(spark, f"file://{tmp_path}")).collect()] == ["A.jpg", "b.PNG", "c.heic", "d.GIF"]


def test_versions_of_a_store(spark, tmp_path):
    store = spark.createDataFrame([("a", 1, 0), ("b", 2, 0), ("a", 3, 1)], "k string, v int, version long")
    assert [r.v for r in ingest.changed_since(store, 0).collect()] == [3]
    again = ingest.reprocessed(store, spark.createDataFrame([("a",)], "k string"), ["k"], lambda df: df.withColumn("v", F.col("v") * 10))
    assert [tuple(r) for r in again.select("k", "v", "version").collect()] == [("a", 30, 2)]


def test_lookup_and_constraints(spark):
    df = spark.createDataFrame([(1, "x", None), (2, "toolong", "A")], "id int, name string, state string")
    assert views.by_id(df, "id", 2).first().name == "toolong"
    with pytest.raises(LookupError):
        views.by_id(df, "id", 3)
    rules = {"name": views.at_most(3), "state": views.one_of(["A"]), "id": lambda c: c > 0}
    assert [r.ok for r in df.orderBy("id").select(views.valid(rules).alias("ok")).collect()] == [True, False]
    assert [r.ok for r in df.orderBy("id").select(views.like_pattern("[a-z]{1,3}")(F.col("name")).alias("ok")).collect()] == [True, False]
    assert views.page_totals(df.limit(0), 1, 20).first().pages == 1
    assert views.as_json(df.where("id = 2")).first().json == '{"id":2,"name":"toolong","state":"A"}'


def test_search_is_like(spark):
    df = spark.createDataFrame([("a_b",), ("axb",), ("A\\b",), ("ÑU",)], "n string").withColumn("deleted", F.lit(False))
    find = lambda s: sorted(r.n for r in df.where(tables.Filter(search=s, search_columns=["n"]).predicate()).collect())
    assert find("A_B") == ["A\\b", "a_b", "axb"] and find("\\") == ["A\\b"] and find("ñ") == [] and find("%b") == ["A\\b", "a_b", "axb"]


def test_word_lists_agree():
    assert all(values.UNITS[w] == i for i, w in enumerate(values.ONES))
    assert all(values.UNITS[w] == 10 * i for i, w in enumerate(values.TENS) if w) and all(values.UNITS[w] == 100 * i for i, w in enumerate(values.HUNDREDS) if w)
    assert "docientos" not in words.tolerant_vocabulary()


def test_nulls_give_nulls(spark):
    from folioflow.functions import dates, spans, text

    c = F.col("s")
    df = spark.createDataFrame([(None,), ("",)], "s string")
    made = [numbers.amount_tolerant(c), numbers.find_amount_bilingual(c)["value"], numbers.find_amount_repair(c)["value"], dates.earliest_date(c)["date"], dates.date_any_form(c), dates.loose_date(c), spans.first_object(c), text.after_anchor(c, ["son"])]
    assert all(x is None for r in df.select(*made).collect() for x in r)
