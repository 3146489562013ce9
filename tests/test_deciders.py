from decimal import Decimal

from pyspark.sql import functions as F

from folioflow import queries
from folioflow.functions import dates, words
from folioflow.plans import deciders


def test_line_groups(spark):
    rows = spark.createDataFrame([(1, ["123", "011000015", "2200123456", "77"]), (2, ["12", "34567"]), (3, []), (4, ["123456", "654321"])], "k int, g array<string>")
    got = {r.k: (r.r.routing, r.r.account, r.r.serials) for r in rows.select("k", deciders.line_groups(F.col("g")).alias("r")).collect()}
    assert got == {1: ("011000015", "2200123456", ["123"]), 2: (None, None, ["34567"]), 3: (None, None, []), 4: (None, "123456", ["654321"])}


def test_merge_line(spark):
    schema = "k int, number string, number_conf double, account string, account_conf double, groups array<string>"
    rows = [(1, "0123", 0.7, "22-001234", 0.5, ["123", "011000015", "22001234"]), (2, None, None, None, None, ["123", "22001234"]), (3, "9", 0.4, "1", 0.4, ["555"])]
    got = {r.k: (r.number, r.number_conf, r.account, r.account_conf) for r in deciders.merge_line(spark.createDataFrame(rows, schema)).collect()}
    assert got == {1: ("0123", 0.98, "22-001234", 0.98), 2: ("123", 0.6, "22001234", 0.75), 3: ("9", 0.4, "1", 0.4)}


def test_refine(spark):
    fields = spark.createDataFrame([(1, "a", "José", 0.5), (1, "b", "x", 0.9), (1, "c", "x", 0.7), (1, "e", "x", 0.7)], "k int, field string, value string, confidence double")
    second = spark.createDataFrame([(1, "a", "jose"), (1, "b", "y"), (1, "c", "y"), (1, "d", "z"), (1, "e", "")], "k int, field string, value string")
    got = {r.field: (r.value, r.confidence) for r in deciders.refine(fields, second, ["k", "field"]).collect()}
    assert got == {"a": ("José", 0.95), "b": ("x", 0.9), "c": ("y", 0.85), "d": ("z", 0.85), "e": ("x", 0.7)}


def test_settle_amount(spark):
    d = Decimal
    schema = "k int, figures decimal(18,2), figures_conf double, words decimal(18,2), words_ratio double, words_conf double, others array<decimal(18,2)>"
    rows = [(1, d(5), 0.5, d(5), 1.0, 0.6, None), (2, None, None, d(5), 0.8, 0.6, []), (3, d(6), 0.5, d(5), 1.0, 0.6, [d(5)]), (4, d(6), 0.5, d(5), 1.0, 0.6, [d(7)]), (5, d(6), 0.5, None, None, None, [])]
    got = {r.k: (r.figures, r.figures_conf, r.amount_match, r.amount_from_words) for r in deciders.settle_amount(spark.createDataFrame(rows, schema)).collect()}
    assert got == {1: (d(5), 0.97, True, False), 2: (d(5), 0.6, None, True), 3: (d(5), 0.97, True, False), 4: (d(6), 0.5, False, False), 5: (d(6), 0.5, None, False)}


def test_final_status(spark):
    rows = [(1, "amount", "5", 0.9, True), (1, "date", "x", 0.8, False), (1, "bank", "b", 0.7, False), (2, "amount", None, 0.9, False), (2, "date", "x", 0.5, False)]
    out = deciders.final_status(spark.createDataFrame(rows, "k int, field string, value string, confidence double, s boolean"), "k", ["amount", "date"], ["bank"], F.col("s"))
    got = {r.k: (r.observations, r.confidence, r.status) for r in out.collect()}
    assert got == {1: ([], 0.8, "COMPLETO"), 2: (["missing amount", "doubtful date", "no signature"], 0.25, "REVISAR")}


def test_number_candidates(spark):
    rows = spark.createDataFrame([(1, ["123", "128", "9"]), (2, ["77", "12"]), (3, ["555"])], "k int, reads array<string>")
    got = {}
    for r in deciders.number_candidates(rows, "k", F.col("reads"), 3).collect():
        got.setdefault(r.k, set()).add(r.candidate)
    assert got[1] == {"123", "128"} and 2 not in got and len(got[3]) == 28


def test_verified_number(spark):
    scores = spark.createDataFrame([(1, "10", 1.0, -1.0), (1, "11", 1.0, -6.0), (2, "10", 1.0, -1.0), (2, "11", 1.0, -3.5), (3, "10", 1.0, -1.0), (3, "11", 1.0, -3.5)], "k int, candidate string, weight double, score double")
    both = spark.createDataFrame([(2, "10"), (2, "10")], "k int, candidate string")
    got = {r.k: (r.value, r.review, r.confidence >= 0.8) for r in deciders.verified_number(scores, "k", both).collect()}
    assert got == {1: ("10", False, True), 2: ("10", False, True), 3: ("10", True, False)}


def test_bank(spark):
    rows = spark.createDataFrame([("Banco Azul", "1012"), ("Banco Azul", None), ("Banco Rojo", "10"), ("Caja", None), ("", None), (None, "10")], "n string, r string")
    assert [tuple(r) for r in rows.select(*deciders.bank(F.col("n"), F.col("r"), "Banco Azul", "10", ["Banco"])).collect()] == [("Banco Azul", 0.99, False), ("Banco Azul", 0.9, False), ("Banco Rojo", 0.9, False), ("Caja", 0.6, True), (None, 0.0, True), (None, 0.0, True)]


def test_a_written_amount_is_worked_out_once(spark):
    """The expression that a text comes from stands once in the plan, however often its parser looks at the text."""
    text = F.concat(F.col("id").cast("string"), F.lit("marker"))
    rows = spark.range(1).select(words.repaired_words(text).alias("w")).select(words.amount_words_tolerant(F.col("w")).alias("a"))
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("marker") == 1


def test_tolerant_words(spark):
    cases = {
        "mil doscientos cincuenta 50/100": "1250.50", "cero dólares con 75/100": "0.75", "veintidós dólares": "22", "cuatro cientos dolares": "400", "M1l setecientoss": "1700",
        "quinientos con noventa y nueve": "500.99", "novecientos cincuenta dolares y veinticuatro centavos": "950.24", "dos mil millones": "2001000000", "nada aqui": None, "": None, "cincuenta centavos": "50",
    }
    rows = spark.createDataFrame([(k,) for k in cases] + [(None,)], "t string")
    got = {r.t: r.a for r in rows.select("t", words.repaired_words(F.col("t")).alias("w")).select("t", words.amount_words_tolerant(F.col("w")).alias("a")).collect()}
    assert got == {**{k: None if v is None else Decimal(v).quantize(Decimal("0.01")) for k, v in cases.items()}, None: None}


def test_short_year_dates(spark):
    rows = spark.createDataFrame([("05/03/26",), ("03.25.2026",), ("01 02 2026",), ("01022026",), ("05/03/1980",), ("31/02/2026",), (None,)], "t string")
    assert [str(r.d) for r in rows.select(dates.short_year_date(F.col("t")).alias("d")).collect()] == ["2026-03-05", "2026-03-25", "2026-02-01", "2026-02-01", "None", "None", "None"]
