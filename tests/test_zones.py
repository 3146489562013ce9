"""Zones of pages, names in texts, and decisions on images, against plain Python or worked out by hand."""

import random

import pytest
from pyspark.sql import functions as F

from folioflow.functions import bilingual, numbers
from folioflow.operators import candidates as ca, tables as tb
from folioflow.plans import amounts, deciders, zones
from folioflow.queries_images import ALPHABET, frames

from .test_functions import apply

COLUMNS = ("text", "dated", "words", "figures", "name", "digit", "printed", "letters")


def page(spark, rows, w=1000, h=400):
    """Boxes of one page: (label, text, x0, y0, x1, y1)."""
    boxes = spark.createDataFrame([(1, i, label, text, float(a), float(b), float(c), float(d), float(c)) for i, (label, text, a, b, c, d) in enumerate(rows)], "page long, idx long, label string, text string, x0 double, y0 double, x1 double, y1 double, label_end double")
    boxes = zones.said(zones.written_parts(boxes), ["juan", "perez"])
    return zones.gathered(boxes, spark.createDataFrame([(1, w, h)], "page long, w long, h long"), *COLUMNS)


FULL = [
    ("paguese", "Paguese a", 10, 100, 110, 120), (None, "Juan Perez", 150, 95, 400, 125), ("moneda", "US$", 700, 100, 740, 120), (None, "475,", 760, 90, 830, 125), (None, "60", 825, 85, 850, 105),
    ("suma", "La suma de", 10, 160, 120, 180), (None, "cuatrocientos setenta", 150, 155, 500, 185), (None, "y cinco", 510, 155, 600, 185), (None, "Go1)ce", 610, 155, 700, 185), (None, "con sesenta centavos", 20, 200, 300, 228),
    ("ciudad", "Ciudad y fecha", 10, 250, 140, 270), (None, "Quito,", 150, 245, 240, 275), (None, "05/10/1997", 238, 245, 400, 275), (None, "Banco Central", 300, 10, 500, 30), (None, None, 5, 5, 6, 6),
]


def test_content_takes_each_box_once_and_grows_to_the_right(spark):
    got = {r.zone: (r.x0, r.y0, r.x1, r.y1) for r in zones.by_content(page(spark, FULL)).collect()}
    # The print is 20 high: margins are 4 across and 7 (12 for figures) up and down.
    assert got["ciudad_fecha"] == (146, 238, 404, 282)
    assert got["monto_letras"] == (146, 148, 704, 192) and got["monto_letras_2"] == (16, 193, 304, 235)
    assert got["monto_numeros"] == (756, 73, 854, 137) and got["beneficiario"] == (146, 88, 404, 132)


def test_labels_place_what_has_no_label(spark):
    full = {r.zone: (r.x0, r.y0, r.x1, r.y1) for r in zones.by_labels(page(spark, FULL)).collect()}
    assert full["beneficiario"] == (112, 92, 697, 130) and full["monto_numeros"] == (741, 74, 1000, 132)
    one = {r.zone: (r.x0, r.y0, r.x1, r.y1) for r in zones.by_labels(page(spark, [FULL[0], FULL[3]])).collect()}
    # Without its label the amount lies right of the payee, from a tenth before its first digits on.
    assert one["beneficiario"] == (112, 92, 760, 130) and one["monto_numeros"] == (640, 80, 1000, 130)
    assert zones.by_labels(page(spark, [FULL[1]])).count() == 0
    merged = {r.zone: r.source for r in zones.zones(page(spark, FULL)).collect()}
    assert merged["beneficiario"] == "content" and page(spark, []).count() == 0 and zones.by_content(page(spark, [])).count() == 0


def test_glued_labels_leave_their_writing(spark):
    row = ("suma", "La suma de mil cien", 10, 160, 310, 185)
    boxes = spark.createDataFrame([(1, 0, row[0], row[1], 10.0, 160.0, 310.0, 185.0, 10 + 300 * 10 / 19)], "page long, idx long, label string, text string, x0 double, y0 double, x1 double, y1 double, label_end double")
    part = [r for r in zones.written_parts(boxes).collect() if r.label is None]
    assert [(r.text, round(r.x0)) for r in part] == [("mil cien", 168)]


def test_split_off_writing_counts_for_the_content_only(spark):
    rows = [*FULL[:5], ("suma", "La suma de mil cien", 10, 160, 310, 185), *FULL[9:]]
    boxes = spark.createDataFrame([(1, i, label, text, float(a), float(b), float(c), float(d), 168.0 if "mil" in (text or "") else float(c)) for i, (label, text, a, b, c, d) in enumerate(rows)], "page long, idx long, label string, text string, x0 double, y0 double, x1 double, y1 double, label_end double")
    said = zones.said(zones.written_parts(boxes), ["juan", "perez"]).withColumns({"w": F.lit(1000), "h": F.lit(400)})
    own = {r.zone: tuple(r)[2:6] for r in zones.by_labels(zones.gathered(said.where("NOT part"), None, *COLUMNS)).collect()}
    content = {r.zone: tuple(r)[2:6] for r in zones.by_content(zones.gathered(said, None, *COLUMNS)).collect()}
    got = {r.zone: (tuple(r)[2:6], r.source) for r in zones.zones(zones.gathered(said, None, *COLUMNS, "part")).collect()}
    assert got["monto_letras"] == (content["monto_letras"], "content") and set(got) == set(own) | set(content)
    assert all(z == ((content[k], "content") if k in content else (own[k], "label")) for k, z in got.items())


def test_pages_are_gathered_once(spark, sf):
    import io
    from contextlib import redirect_stdout

    from folioflow import queries as q

    for name in ("page_zones", "zones_by_content", "zones_by_labels"):
        with redirect_stdout(io.StringIO()) as said:
            q.QUERIES[name](spark, sf).explain()
        assert said.getvalue().count("Exchange") <= 2, name
    # By labels nothing is asked of a text but its letters.
    assert "misread_legend" not in said.getvalue()


def test_names_are_found_as_by_all_pairs(spark):
    r = random.Random(8)
    names = ["".join(r.choice("abc ") for _ in range(r.randint(1, 9))).strip() or "a" for _ in range(40)] + [None, ""]
    texts = ["".join(r.choice("abc ") for _ in range(r.randint(0, 14))) for _ in range(150)] + [None, "", *[n for n in names if n][:10]]

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, last = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        return row[-1]

    want = sorted({(i, n) for i, s in enumerate(texts) for n in names if s is not None and n and (n in s or 1 - edits(s, n) / max(len(s), len(n)) >= 0.8)})
    df = spark.createDataFrame(list(enumerate(texts)), "i long, t string")
    got = ca.named_in(df, "t", spark.createDataFrame([(n,) for n in names], "name string"), "name").collect()
    assert sorted((x.i, x.name) for x in got) == want
    assert "CartesianProduct" not in (plan := ca.named_in(df, "t", spark.createDataFrame([("a",)], "name string"), "name")._jdf.queryExecution().toString()) and "BroadcastNestedLoopJoin" not in plan
    assert ca.named_in(df, "t", spark.createDataFrame([], "name string"), "name").count() == 0


def test_numbers_by_ranges_are_those_of_one_sort(spark):
    rows = [(i, (i * 7919) % 101) for i in range(1000)]
    got = {r.i: r.n for r in tb.numbered(spark.createDataFrame(rows, "i long, v long"), "n", "v", "i").collect()}
    assert got == {i: k for k, (i, v) in enumerate(sorted(rows, key=lambda r: (r[1], r[0])), 1)}
    assert tb.numbered(spark.createDataFrame([], "i long"), "n", "i").count() == 0


def brute_ctc(p, text, alphabet, penalty=2.5):
    """Every path of a short matrix: which step begins and ends, and what each step between says."""
    import itertools
    import math

    letters = [0, *[alphabet.index(c) + 1 for c in text]]
    free = [math.log(max(row)) - (0 if row.index(max(row)) == 0 else penalty) for row in p]
    best = -math.inf
    for a in range(len(p)):
        for b in range(a + 1, len(p) + 1):
            for path in itertools.product(sorted(set(letters)), repeat=b - a):
                said = [k for k, _ in itertools.groupby(path) if k]
                if said == letters[1:]:
                    best = max(best, sum(free[:a]) + sum(math.log(p[a + i][k]) for i, k in enumerate(path)) + sum(free[b:]))
    return best - sum(math.log(max(row)) for row in p)


def test_forms_are_scored_as_every_path(spark):
    r = random.Random(3)
    for _ in range(4):
        p = [[r.random() + 0.01 for _ in range(3)] for _ in range(4)]
        p = [[x / sum(row) for x in row] for row in p]
        forms = [["a"], ["ab", "ba"], ["aa"], ["z"], ["a b", "b"], []]
        df = spark.createDataFrame([([[x for row in p for x in row]] * 2, [4, 4], forms)], "m array<array<double>>, t array<int>, f array<array<string>>")
        got = df.select(ca.ctc_best(F.col("m"), F.col("t"), F.col("f"), "ab").alias("s")).first().s
        for f, s in zip(forms, got, strict=True):
            want = max((2 * brute_ctc(p, x.replace(" ", ""), "ab") for x in f if set(x) <= set("ab ")), default=None)
            assert (s is None and want is None) or s == pytest.approx(want, abs=1e-9), f


def test_amount_gates(spark):
    """A dirty figure, a confirmed reading, nothing read at all, and no image."""
    readings = [(1, "figures", "475.", None), (1, "words", "cuatrocientos setenta y cinco", None), (2, "figures", "12.50", None), (2, "words", "doce con 50/100", None), (3, "figures", "nada", None), (4, "figures", "20.00", None), (4, "words", "veinte con 00/100", None)]
    df = spark.createDataFrame([(*x, 0.9) for x in readings], "k long, zone string, text string, deep boolean, confidence double")
    images = None
    for k, zone, text in ((1, "figures", "47500"), (1, "words", "cuatrocientossetentaycinco"), (2, "figures", "1250"), (2, "words", "doce50")):
        m, n = frames(F.lit(text).substr(F.lit(1), F.length(F.lit(text)) + F.col("id").cast("int") * 0))
        part = spark.range(1).select(F.lit(k).cast("long").alias("k"), F.lit(zone).alias("zone"), m.alias("m"), n.alias("t"))
        images = part if images is None else images.unionByName(part)
    got = {r.k: r for r in amounts.amount(df, images, "k", ALPHABET).collect()}
    assert (str(got[1].value), got[1].review, got[1].same) == ("475.00", True, True)  # the cents may have been cut off
    assert (str(got[2].value), got[2].review, got[2].read) == ("12.50", True, True)  # one number word is too few
    assert got[3].value is None and got[3].review and got[3].confidence == 0 and got[4].review


def test_dates_one_digit_away(spark):
    df = spark.createDataFrame([("1998-02-28",)], "d string").select(F.col("d").cast("date").alias("d"))
    for first in (True, False):
        got = {str(x) for x in df.select(deciders.date_neighbours(F.col("d"), F.lit(first)).alias("n")).first().n}
        import datetime

        want, base = set(), "19980228"
        for i in range(8):
            for c in "0123456789":
                if c != base[i]:
                    x = base[:i] + c + base[i + 1 :]
                    try:
                        want.add(str(datetime.date(int(x[:4]), int(x[4:6]), int(x[6:]))))
                    except ValueError:
                        pass
        assert got == want


def test_bilingual_cases(spark):
    cases = {"mil quinientos con 50/100": ("1500.50", 1.0, None), "one thousand two hundred and 05/100 dollars": ("1200.05", 1.0, "dollars"), "milquinientos dolares": ("1500.00", 1.0, "dolares"), "dos dolares con veinte centavos": ("2.20", 1.0, "dolares"),
             "quinientcs xqz": ("500.00", 0.5, None), "nada": None, "": None, "two million three": ("2000003.00", 1.0, None), "cien 150/100": ("100.50", 1.0, None)}
    got = apply(spark, bilingual.amount_words_bilingual, list(cases))
    for (text, want), r in zip(cases.items(), got, strict=True):
        assert (None if r is None or r.value is None else (str(r.value), r.share, r.currency)) == want, (text, r)


def test_line_fold(spark):
    got = apply(spark, lambda c: numbers.line_fold(F.regexp_extract_all(c, F.lit("(.)"))), ["S12T3?S", "", "7", "S S"])
    assert [[(g.digits, g.sure) for g in x] for x in got] == [[("12", True), ("3?", False)], [], [("7", True)], []]


def test_templates(spark):
    t = spark.createDataFrame([("a", [1.0, 0.0, 0.0, 1.0]), ("b", [0.0, 1.0, 1.0, 0.0]), ("b", [0.0, 1.0, 0.0, 1.0])], "class string, vector array<double>")
    rows = [(0, [2.0, 0.0, 0.1, 2.0]), (1, [1.0, 1.0, 1.0, 1.0]), (2, None), (3, [1.0]), (4, [0.0, 5.0, 5.0, 0.1]), (5, [float("nan"), 1.0, 1.0, 1.0])]
    got = {r.i: r["class"] for r in ca.by_template(spark.createDataFrame(rows, "i long, v array<double>"), "v", t).collect()}
    assert got == {0: "a", 1: "?", 2: None, 3: None, 4: "b", 5: None}


def test_page_fields_of_one_form(spark):
    """A value below its label, a date that is no amount, the figures that agree with the words, and nothing for what is missing."""
    from folioflow.plans.page_fields import page_fields

    rows = [
        (0, "Páguese a la orden de", 0.05, 0.30), (1, "Juan Pérez", 0.06, 0.35), (2, "7.000,00", 0.70, 0.10), (3, "US$", 0.60, 0.45), (4, "1.500,50", 0.73, 0.45), (5, "La suma de: mil quinientos con 50/100 dolares", 0.05, 0.55),
        (6, "Quito, 05/10/1997", 0.05, 0.65), (7, None, 0.5, 0.7), (8, "05/10/97 900,00", 0.05, 0.95),
    ]
    t = spark.createDataFrame([(1, i, x, a, b, a + 0.12, b + 0.04) for i, x, a, b in rows], "page long, idx long, text string, x0 double, y0 double, x1 double, y1 double")
    got = {r.field: (r.value, r.source, r["at"]) for r in page_fields(t).collect()}
    assert got == {"beneficiario": ("Juan Pérez", "label", 0), "monto_letras": ("1500.50", "label", 5), "monto": ("1500.50", "token", 4), "fecha": ("1997-10-05", "row", 6), "moneda": ("USD", "words", 5)}
    assert page_fields(t.limit(0)).count() == 0
