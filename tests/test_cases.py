import duckdb
import pytest

from folioflow.functions import dates, text, words
from folioflow.operators import aggregates
from folioflow.plans import zones

from .cases import CASES
from .test_entry import plain
from .test_functions import apply


@pytest.mark.parametrize("name", sorted(CASES))
def test_case(spark, name):
    build, sql = CASES[name]
    df = build(spark, None)
    res = duckdb.sql(sql)
    cols = sorted(df.columns)
    assert sorted(res.columns) == cols
    want = sorted(tuple(plain(dict(zip(res.columns, r, strict=True))[c]) for c in cols) for r in res.fetchall())
    assert sorted(tuple(plain(r[c]) for c in cols) for r in df.collect()) == want


def test_tidy(spark):
    cases = {"..a..": "a", "=a=": "a", "9xxx9": "9 9", "axxxa": "axxxa", "**** Juan -- Pérez xxxx ,": "Juan Pérez", "": "", "XXXX": "", "a - b": "a - b"}
    assert apply(spark, text.tidy, list(cases)) == list(cases.values())


def test_canonical_words(spark):
    cases = {"Míl cíncuenta": "Mil cincuenta", "DIECISEIS MILLON Y dolares": "DIECISÉIS MILLÓN Y dólares", "mÍl Casa 5o/1OO": "mil Casa 50/100", "": "", "b5/100 thóusand": "b5/100 thousand"}
    assert apply(spark, words.canonical_words, list(cases)) == list(cases.values())


def test_rewritten_amount(spark):
    cases = {"mil quinientosveinte dólares con 5O/1oo y más": "MIL QUINIENTOS VEINTE DOLARES CON 50/100", "cien": "CIEN", "5/100": "05/100", "": ""}
    assert apply(spark, words.rewritten_amount, list(cases)) == list(cases.values())


def test_unfilled_and_digit_ratio(spark):
    assert apply(spark, text.unfilled, ["** a__b ;", "", ". , -", "a - b"]) == ["a b", "", "", "a - b"]
    assert apply(spark, text.digit_ratio, ["12 ab", "", " ", "٣x"]) == [0.5, 0.0, 0.0, 0.5]


def test_misread_legends(spark):
    cases = {"companaanonma": True, "juanperez": False, "usdolar": False, "usdolare": True, "": False, None: False}
    assert apply(spark, zones.misread_legend, list(cases)) == list(cases.values())


def test_dates_need_what_their_formats_need(spark):
    cases = {"1998 / 3/4": "1998-03-04", "1998": None, "4 de marzo": None, "quito 1998,3,4": "1998-03-04", "mar 4/1998 y 1999/31/31": "1998-03-04", "12-3": None}
    assert apply(spark, lambda c: dates.parse_plain_date(c).cast("string"), list(cases)) == list(cases.values())
    mixed = ["dd mes aaaa", "aaaa/mm/dd", "aaaa mes dd"]
    assert apply(spark, lambda c: dates.parse_plain_date(c, mixed).cast("string"), ["1998/3/4 5 mayo 1999", "1998/3/4 y 1999 mayo 5"]) == ["1999-05-05", "1998-03-04"]


def test_a_reading_with_the_amount_is_the_most_useful(spark):
    rows = [(1, "x", 0, 1.0, "son milcien"), (1, "x", 1, 0.5, "50/100"), (1, "y", 0, 0.9, "juan perez juan perez juan"), (1, "z", 0, None, None), (2, "b", 0, 1.0, "ab"), (2, "a", 0, 1.0, "ab")]
    boxes = spark.createDataFrame(rows, "k int, r string, i int, c double, t string")
    got = {(r.k, r.r): (r.utility, r.best) for r in aggregates.useful_readings(boxes, ["k"], "r", "i", "c", "t").collect()}
    assert got == {(1, "x"): (11 + 3 + 24 + 40 + 8, True), (1, "y"): (0.9 * 26, False), (1, "z"): (0.0, False), (2, "a"): (2.0, True), (2, "b"): (2.0, False)}
