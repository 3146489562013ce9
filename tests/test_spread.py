"""Candidates of many rows are aligned together, and matrices stay out of the rows of candidates."""

import io
from contextlib import redirect_stdout

import numpy as np
from pyspark.sql import functions as F

from folioflow import queries as q
from folioflow.operators import candidates as ca


def test_best_of_many_rows_equals_one_by_one(spark):
    rng = np.random.default_rng(5)
    rows, single = [], []
    for i in range(60):
        n, texts = int(rng.integers(2, 12)), ["".join(rng.choice(list("ab 1"), int(rng.integers(1, 6)))) for _ in range(4)]
        m = rng.dirichlet(np.ones(4), n).ravel().tolist()
        rows.append((i, [m, m[::-1]], [n, n], [1.0, 0.4], [[x] for x in texts]))
        single += [(i, k, j, w, mm, n, x) for j, x in enumerate(texts) for k, (mm, w) in enumerate(((m, 1.0), (m[::-1], 0.4)))]
    df = spark.createDataFrame(rows, "i int, m array<array<double>>, t array<int>, w array<double>, f array<array<string>>").coalesce(1)
    got = {(r.i, j): x for r in df.select("i", ca.ctc_best(F.col("m"), F.col("t"), F.col("f"), "ab1", weights=F.col("w")).alias("s")).collect() for j, x in enumerate(r.s)}
    one = ca.ctc_scores(spark.createDataFrame(single, "i int, k int, j int, w double, m array<double>, t int, x string"), "m", "t", "x", "ab1")
    want: dict = {}
    for r in one.collect():
        if r.x.strip():
            want[r.i, r.j] = want.get((r.i, r.j), 0.0) + r.w * r.score
    # Texts longer than the image has steps score minus infinity.
    assert all(got[k] == v or abs(got[k] - v) < 1e-9 for k, v in want.items()) and len(want) > 200


def test_numbers_carry_no_matrix_for_each_candidate(spark, sf):
    with redirect_stdout(io.StringIO()) as said:
        q.QUERIES["printed_numbers"](spark, sf).explain()
    plan = said.getvalue()
    # One row a number goes to Python: candidates are listed after their scores are known.
    below = plan[plan.index("ArrowEvalPython"):]
    assert "Generate explode(c" not in below and "REPARTITION_BY_NUM" in plan


def test_a_text_is_searched_for_dates_once(spark, sf):
    with redirect_stdout(io.StringIO()) as said:
        q.QUERIES["dates_on_images"](spark, sf).explain()
    plan = said.getvalue()
    # The rows that are scored stay spread, whatever their bytes.
    assert plan.count("REPARTITION_BY_NUM") >= 2


def test_matrices_are_rendered_once_and_shuffled(spark, sf):
    with redirect_stdout(io.StringIO()) as said:
        q.QUERIES["dates_on_images"](spark, sf).explain()
    plan = said.getvalue()
    # A filter on rendered matrices held their expression once more, and the planner broadcast them all.
    assert "0.9" in plan and "Broadcast" not in plan
    assert not [line for line in plan.splitlines() if "Filter" in line and "0.9" in line]


def test_pages_are_united_many_at_once(spark):
    from folioflow.operators import windows as wi

    rng = np.random.default_rng(3)
    rows = []
    for page in range(300):
        for _ in range(int(rng.integers(1, 9))):
            x, y = rng.integers(0, 60, 2)
            rows.append((None if page == 7 else page, float(x), float(y), float(x + rng.integers(0, 30)), float(y + rng.integers(0, 9)), None if rng.random() < 0.2 else float(rng.integers(0, 9))))

    def meets(a, b):
        w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
        area, narrow = min((x[2] - x[0]) * (x[3] - x[1]) for x in (a, b)), min(x[2] - x[0] for x in (a, b))
        return (w > 0 and h > 0 and w * h >= 0.5 * (area or 1)) or (w >= 0.6 * (narrow or 1) and h > -12)

    def one(boxes):
        while pair := next(((i, j) for i in range(len(boxes)) for j in range(i + 1, len(boxes)) if meets(boxes[i], boxes[j])), None):
            a, b = boxes[pair[0]], boxes.pop(pair[1])
            boxes[pair[0]] = [min(a[0], b[0]), min(a[1], b[1]), max(a[2], b[2]), max(a[3], b[3]), max((x for x in (a[4], b[4]) if x is not None), default=None)]
        return boxes

    pages: dict = {}
    for p, *box in rows:
        pages.setdefault(p, []).append(box)
    want = [(p, *b) for p, boxes in pages.items() for b in one(sorted(boxes, key=lambda b: (*b[:4], b[4] is None, b[4] or 0)))]
    df = wi.merged_boxes(spark.createDataFrame(rows, "page int, x0 double, y0 double, x1 double, y1 double, confidence double"), "page")
    assert sorted(map(str, (tuple(r) for r in df.collect()))) == sorted(map(str, want))
    with redirect_stdout(io.StringIO()) as said:
        df.explain()
    assert "FlatMapGroupsInPandas" not in said.getvalue() and "REPARTITION_BY_NUM" in said.getvalue()


def test_heavy_rows_are_dealt_over_more_tasks_as_they_grow(spark, tmp_path, monkeypatch):
    from folioflow import session

    monkeypatch.setattr(session, "DEALT_ROWS", 100, raising=False)
    spark.range(0, 2000, 1, 1).write.parquet(f"{tmp_path}/t")
    df = session.dealt(spark.read.parquet(f"{tmp_path}/t"))
    assert df.rdd.getNumPartitions() == 20 and df.count() == 2000
    few = session.dealt(spark.read.parquet(f"{tmp_path}/t").limit(50))
    assert few.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


def test_texts_are_searched_before_pages_are_put_together(spark, sf):
    with redirect_stdout(io.StringIO()) as said:
        q.QUERIES["page_fields"](spark, sf).explain()
    # One plan of all fields held each label's patterns for every kind of evidence: 1.4 million characters in the driver.
    assert len(said.getvalue()) < 100_000 and "regexp_instr" not in said.getvalue()


def test_amounts_are_searched_in_steps(spark, sf):
    with redirect_stdout(io.StringIO()) as said:
        q.QUERIES["amounts_on_images"](spark, sf).explain()
    # One plan of both searches had 2.2 million characters in the driver.
    assert len(said.getvalue()) < 200_000


def plans_of(monkeypatch, module, run):
    """The plans of all that a query writes on its way, and of its result."""
    said, cut = io.StringIO(), module.cut
    with redirect_stdout(said), monkeypatch.context() as m:
        m.setattr(module, "cut", lambda df: (df.explain(), cut(df))[1])
        run().explain()
    return said.getvalue()


def test_images_do_not_pass_through_the_driver(spark, sf, monkeypatch):
    from folioflow.plans import amounts

    # The planner took matrices for a few bytes a row, so 90,000 of them were broadcast.
    plans = plans_of(monkeypatch, amounts, lambda: q.QUERIES["amounts_on_images"](spark, sf))
    assert plans.count("SortMergeJoin") >= 5 and "Broadcast" not in plans


def test_tokens_do_not_pass_through_the_driver(spark, sf, monkeypatch):
    from folioflow.plans import page_fields

    # Rows of 9,900,000 tokens were taken for a few bytes each, and broadcast.
    plans = plans_of(monkeypatch, page_fields, lambda: q.QUERIES["page_fields"](spark, sf))
    assert plans.count("SortMergeJoin") >= 16 and "Broadcast" not in plans


def test_portions_become_more_with_the_rows(spark, monkeypatch):
    from folioflow import session

    monkeypatch.setattr(session, "PORTION_ROWS", 10)
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    few, many = (session.portioned(spark.range(n), "id").rdd.getNumPartitions() for n in (5, 10 * (least + 7)))
    assert (few, many) == (least, least + 7)
