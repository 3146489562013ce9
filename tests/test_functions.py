import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from folioflow.functions import dates, numbers, text, values, words
from folioflow.operators import candidates, windows


def apply(spark, f, xs, kind="string"):
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(xs)], f"i int, x {kind}")
    return [r.y for r in rows.select("i", f(F.col("x")).alias("y")).orderBy("i").collect()]


DAY = datetime.date(2026, 3, 5)


@pytest.mark.parametrize("written", [
    "2026/03/05", "2026-3-5", "2026, 03, 05", "2026, marzo, 05", "2026, mar., 5", "2026, III, 05", "5 de marzo de 2026", "05 de Marzo del 2026", "5 de mar. de 2026",
    "5 de mar del 2026", "5 de iii de 2026", "5 de mar. 2026", "Marzo 05, 2026", "5 de marzo/ 2026", "mar. 05/2026", "2026 marzo 05", "Quito, 05 marzo 2026",
])
def test_every_date_format(spark, written):
    assert apply(spark, dates.parse_date, [written]) == [DAY]


def test_dates_that_are_none(spark):
    assert apply(spark, dates.parse_date, ["31/02/2026", "05/03/2026", "2026/02/30", "", None, "12026/03/05", "2026/03/055"]) == [None] * 7
    # A first hit that is no date is skipped.
    assert apply(spark, dates.parse_date, ["2026/13/40 2026/03/05"]) == [DAY]


def test_format_order_wins_over_position(spark):
    both = "5 de abril de 2026 2026/03/05"
    assert apply(spark, lambda c: dates.parse_date(c, ["aaaa/mm/dd", "dd de mes de aaaa"]), [both]) == [DAY]
    assert apply(spark, lambda c: dates.parse_date(c, ["dd de mes de aaaa", "aaaa/mm/dd"]), [both]) == [datetime.date(2026, 4, 5)]


def test_months_elapsed(spark):
    pairs = [("2026-01-31", "2026-02-28", 0), ("2025-01-28", "2026-02-28", 13), ("2025-01-29", "2026-02-28", 12), ("2026-05-01", "2026-02-28", -3), ("2026-02-28", "2026-02-28", 0)]
    rows = spark.createDataFrame(pairs, "a string, b string, n int")
    assert all(r.m == r.n for r in rows.select("n", dates.months_elapsed(F.col("a").cast("date"), F.col("b").cast("date")).alias("m")).collect())


@pytest.mark.parametrize("dialect,want", [
    ("rules", ["1.25", "1250", "1250.50", "1250.50", "1250.50", None, None, None, "-3.10", "1.24"]),
    ("tolerant", ["1250", "1250", "1250.50", "1250.50", "1250.50", None, None, None, "3.10", "1235"]),
    ("bilingual", ["1250", "1250", "1250.50", "1250.50", "1250.50", "1250000", None, None, "3.10", "1235"]),
])
def test_amount_dialects(spark, dialect, want):
    xs = ["1.250", "1,250", "1250,5", "US$ 1.250,50", "$1,250.50", "12.50.000", "", None, "-3.1", "1.235"]
    got = apply(spark, lambda c: numbers.parse_amount(c, dialect), xs)
    want = [None if w is None else Decimal(w).quantize(Decimal("0.01")) for w in want]
    assert got == want


def test_amounts_with_lookalike_letters(spark):
    assert apply(spark, numbers.amount_tolerant, ["1.25O,5O", "l.250", "sin numero", "1000 son"]) == [Decimal("1250.50"), Decimal("1250.00"), None, Decimal("1000.00")]


def test_words_fold(spark):
    xs = ["ciento treinta y cuatro con 00/100", "MIL DOSCIENTOS DÓLARES", "dos mil millones", "veintidós mil trescientos 45/100", "tres gatos", "", None, "un millón", "cero", "quinientos con 5"]
    want = ["134", "1200", "1002000", "22300.45", None, None, None, "1000000", "0", "500.05"]
    assert apply(spark, words.amount_words, xs) == [None if w is None else Decimal(w).quantize(Decimal("0.01")) for w in want]


def test_words_render_then_parse(spark):
    xs = [0, 1, 15, 21, 29, 30, 31, 99, 100, 101, 115, 121, 200, 999, 1000, 1001, 1021, 2000, 21000, 31031, 100000, 121121, 999999, 1000000, 1000001, 2000000, 21000021, 999999999]
    rows = spark.createDataFrame([(x,) for x in xs], "x long").withColumn("w", words.number_words(F.col("x")))
    # The strict fold banks thousands before a "millones", so only amounts below a thousand million-units round-trip.
    assert all(r.y == r.x for r in rows.where("x < 1000000").select("x", words.amount_words(F.col("w")).alias("y")).collect())
    spelled = {r.x: r.w for r in rows.collect()}
    assert spelled[21000021] == "veintiun millones veintiuno" and spelled[1000001] == "un millon uno" and spelled[100000] == "cien mil" and spelled[31031] == "treinta y un mil treinta y uno"


def test_text(spark):
    assert apply(spark, text.plain, ["  José  Ñandú ", "Él", None]) == ["jose nandu", "el", None]
    assert apply(spark, lambda c: F.length(text.fold(c)), ["Ñandú José"]) == [10]
    assert apply(spark, text.looks_hallucinated, ["a a a a", "uno dos tres cuatro", "漢字", "a b", None]) == [True, False, True, False, None]
    assert apply(spark, text.is_negative, ["No presente", "no se ve", "noche", "", "NULL"]) == [True, True, False, False, True]
    assert apply(spark, text.tidy, ["**** Juan -- Pérez xxxx ,"]) == ["Juan Pérez"]
    assert apply(spark, lambda c: text.digits(c, {"O": "0", "l": "1"}), ["A1O-l9"]) == ["1019"]


def test_routing(spark):
    assert apply(spark, numbers.routing_ok, ["011000015", "011000016", "123", "abcdefghi", None]) == [True, False, False, False, None]


def test_neighbours_and_products(spark):
    assert len(apply(spark, numbers.digit_neighbours, ["123"])[0]) == 27
    rows = spark.createDataFrame([([["1", "7"], ["0"], ["3", "8"]],), ([[str(d) for d in range(10)]] * 3,)], "p array<array<string>>")
    a, b = (r.x for r in rows.select(candidates.digit_product(F.col("p")).alias("x")).collect())
    assert a == ["103", "108", "703", "708"] and b == [f"{i:03d}" for i in range(64)]


def test_closest(spark):
    assert apply(spark, lambda c: candidates.closest(c, ["Guayaquil", "Quito"], 0.68), ["Guayagwil", "Quitx", "Loja", None]) == ["Guayaquil", "Quito", None, None]


def test_ctc_prefers_the_written_text(spark):
    good, other = 0.9, 0.01
    frame = lambda k: [good if i == k else other for i in range(11)]
    matrix = sum((frame(k) for k in (0, 2, 2, 0, 3, 0)), [])
    rows = spark.createDataFrame([(matrix, 6, c) for c in ("12", "21", "1", "122", "1x", None)], "m array<double>, t int, c string")
    got = {r.c: r.score for r in candidates.ctc_scores(rows, "m", "t", "c", "0123456789").collect()}
    assert got["12"] == max(v for v in got.values() if v is not None) and got["1x"] is None and got[None] is None


def test_page_rows(spark):
    rows = spark.createDataFrame([(1, 0, 0.10, 0.05, 0.5), (1, 1, 0.11, 0.05, 0.1), (1, 2, 0.20, 0.05, 0.1), (1, 3, 0.13, 0.05, 0.9)], "page long, idx long, cy double, h double, x0 double")
    assert {r.idx: r.row for r in windows.page_rows(rows, "page").collect()} == {0: 0, 1: 0, 3: 0, 2: 1}


def test_fixed_values_are_consistent():
    assert set(values.MONTHS.values()) == set(values.MONTHS_SHORT.values()) == set(values.MONTHS_ROMAN.values()) == set(range(1, 13))
