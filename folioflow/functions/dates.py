"""Dates in named formats, and month arithmetic."""

from __future__ import annotations

import re
from itertools import groupby

from pyspark.sql import Column, functions as F

from . import values
from .text import fold, let, plain, replace_each
from .words import _map

_TOKENS = {"Y": r"([0-9]{4})", "N": r"([0-9]{1,2})", "D": r"([0-9]{1,2})", "W": r"([a-z]{3,})", "L": r"([a-z]{4,})", "A": r"([a-z]{3,4}\.?)", "P": r"([a-z]{3,}\.?)", "R": "(" + "|".join(sorted(values.MONTHS_ROMAN, key=len, reverse=True)) + ")"}


def pattern(spec: str) -> tuple[str, str]:
    """Regular expression and the order of its groups (such as "YMD") of a format specification."""
    out, order = "", ""
    for part in re.findall(r"_del?_|_|[/,\-]|[A-Z]", spec):
        if part in _TOKENS:
            out += _TOKENS[part]
            order += part if part in "YD" else "M"
        elif part == "_":
            out += r"\s+"
        elif part[0] == "_":
            out += rf"\s+{part.strip('_')}\s+"
        else:
            out += rf"\s*{part}\s*"
    return out, order


def month_number(c: Column) -> Column:
    """1 to 12 from digits, a name, an abbreviation or a roman numeral; else null."""
    n = F.btrim(c, F.lit(". ")).try_cast("int")
    return F.when(n.isNotNull(), F.when(n.between(1, 12), n)).otherwise(named_month(c))


def named_month(c: Column) -> Column:
    """1 to 12 from a name, an abbreviation or a roman numeral; else null."""
    return F.try_element_at(_map(values.MONTHS | values.MONTHS_SHORT | values.MONTHS_ROMAN), F.btrim(c, F.lit(". ")))


def _date(y: Column, m: Column, d: Column) -> Column:
    zero = F.lit(0)
    return F.try_make_timestamp(y.try_cast("int"), m, d.try_cast("int"), zero, zero, zero).cast("date")


def first_date(p: Column, name: str) -> Column:
    """First valid date of one format in a plain text."""
    body, order = pattern(values.DATE_FORMATS[name])
    figures = "N" in values.DATE_FORMATS[name]
    found = F.regexp_extract_all(p, F.lit(rf"(?<![0-9]){body}(?![0-9])"), F.lit(0))

    def read(m):
        g = {k: F.regexp_extract(m, body, i + 1) for i, k in enumerate(order)}
        return _date(g["Y"], g["M"].try_cast("int") if figures else named_month(g["M"]), g["D"])

    return F.get(F.filter(F.transform(found, read), lambda d: d.isNotNull()), F.lit(0))


def parse_date(c: Column, formats: list[str] | None = None) -> Column:
    """First format, in the given order, that reads a valid date anywhere in the text."""
    return parse_plain_date(plain(c), formats)


def parse_plain_date(p: Column, formats: list[str] | None = None) -> Column:
    """Formats in figures ask for a sign between digits, those with month words for a letter, all for four digits in a row:
    what a text lacks is tested once for all formats that stand together."""
    def worded(name):
        return bool(set(values.DATE_FORMATS[name]) & set("WLAPR"))

    needs = {True: "[a-z]", False: r"[0-9]\s*[/,\-]\s*[0-9]"}
    some = [F.when(F.regexp_like(p, F.lit(needs[w])), F.coalesce(*[first_date(p, f) for f in same])) for w, same in groupby(formats or values.DATE_FORMATS, worded)]
    return F.when(F.regexp_like(p, F.lit("[0-9]{4}")), F.coalesce(*some))


def months_elapsed(start: Column, end: Column) -> Column:
    """Full months: calendar difference, less one if the day of month has not come yet."""
    return (F.year(end) - F.year(start)) * 12 + F.month(end) - F.month(start) - F.when(F.dayofmonth(end) < F.dayofmonth(start), 1).otherwise(0)


def numeric_date(c: Column) -> Column:
    """dd/mm/yyyy or yyyy/mm/dd with any of / - . between; years below 1000 and impossible days give null."""
    g = r"(?<![0-9])([0-9]{1,2})\s*[/.-]\s*([0-9]{1,2})\s*[/.-]\s*([0-9]{4})(?![0-9])"
    r = r"(?<![0-9])([0-9]{4})\s*[/.-]\s*([0-9]{1,2})\s*[/.-]\s*([0-9]{1,2})(?![0-9])"
    dmy = _date(F.regexp_extract(c, g, 3), F.regexp_extract(c, g, 2).try_cast("int"), F.regexp_extract(c, g, 1))
    ymd = _date(F.regexp_extract(c, r, 1), F.regexp_extract(c, r, 2).try_cast("int"), F.regexp_extract(c, r, 3))
    d = F.coalesce(ymd, dmy)
    return F.when(F.year(d) >= 1000, d)


def short_year_date(c: Column) -> Column:
    """Numeric dates whose year may have two digits (20xx), day and month swapped if only that can be meant, as boxes
    ("01 02 2026") or compact ("01022026"); years 1990 to 2100."""
    def read(pattern, order):
        found = F.regexp_extract_all(c, F.lit(pattern), F.lit(0))

        def one(m):
            y, a, b = (F.regexp_extract(m, pattern, order.index(k) + 1).try_cast("int") for k in "ymd")
            y = F.when(y < 100, y + 2000).otherwise(y)
            swap = (a > 12) & (b <= 12) if order == "dmy" else F.lit(False)
            d = F.try_make_timestamp(y, F.when(swap, b).otherwise(a), F.when(swap, a).otherwise(b), F.lit(0), F.lit(0), F.lit(0)).cast("date")
            return F.when(y.between(1990, 2100), d)

        return F.get(F.filter(F.transform(found, one), lambda d: d.isNotNull()), F.lit(0))

    gap = r"\s*[/.-]\s*"
    return F.coalesce(
        read(rf"\b([0-9]{{4}}){gap}([0-9]{{1,2}}){gap}([0-9]{{1,2}})\b", "ymd"),
        read(rf"\b([0-9]{{1,2}}){gap}([0-9]{{1,2}}){gap}([0-9]{{4}}|[0-9]{{2}})\b", "dmy"),
        read(r"\b([0-9]{2})\s+([0-9]{2})\s+([0-9]{4})\b", "dmy"),
        read(r"\b([0-9]{2})([0-9]{2})(20[0-9]{2})\b", "dmy"),
    )


def _words(months: dict[str, int]) -> str:
    return "(" + "|".join(sorted(months, key=len, reverse=True)) + ")"


def date_any_form(c: Column) -> Column:
    """First valid date by kinds in this order: day, month in words (Spanish or English), year; month in words, day, year;
    the numeric kinds of ``short_year_date``. Two-digit years are 20xx; years 1990 to 2100."""
    months = values.MONTHS | values.MONTHS_SHORT | values.MONTHS_ENGLISH
    word, table = _words(months), _map(months)

    def read(pattern, order):
        def one(m):
            g = {k: F.regexp_extract(m, pattern, i + 1) for i, k in enumerate(order)}
            y = g["y"].try_cast("int")
            y = F.when(y < 100, y + 2000).otherwise(y)
            return F.when(y.between(1990, 2100), _date(y, F.try_element_at(table, g["m"]), g["d"]))

        return F.get(F.filter(F.transform(F.regexp_extract_all(t, F.lit(pattern), F.lit(0)), one), lambda d: d.isNotNull()), F.lit(0))

    t = fold(c)
    return F.coalesce(
        read(rf"([0-9]{{1,2}})\s*(?:de\s*)?{word}[a-z]*\.?\s*(?:de(?:l)?\s*)?,?\s*([0-9]{{4}}|[0-9]{{2}})\b", "dmy"),
        read(rf"\b{word}[a-z]*\.?\s*([0-9]{{1,2}})\s*,?\s*([0-9]{{4}})\b", "mdy"),
        short_year_date(t),
    )


def earliest_date(c: Column) -> Column:
    """The valid date that begins first in the text, of five kinds, as (pos, end, date), positions from 1 in the plain text;
    of those that begin together the kind listed first. Years below 1000 are none."""
    months = values.MONTHS | values.MONTHS_SHORT | values.MONTHS_ROMAN
    token = {"D": "([0-9]{1,2})", "N": "([0-9]{1,2})", "Y": "([0-9]{4})", "M": _words(months) + r"(?![a-z])\.?", "S": r"\s*[,/\-.\s]\s*"}

    def kind(p, spec):
        body = re.sub("[DNYMS]", lambda m: token[m[0]], spec)
        order = [k for k in re.findall("[DNYM]", spec)]

        def step(acc, m):
            at = F.call_function("locate", m, p, acc["end"])
            g = {("M" if k == "N" else k): F.regexp_extract(m, body, i + 1) for i, k in enumerate(order)}
            d = F.when(g["Y"].try_cast("int") >= 1000, _date(g["Y"], month_number(g["M"]), g["D"]))
            found = F.when(d.isNotNull() & acc["found"].isNull(), F.struct(at.alias("pos"), (at + F.length(m) - 1).alias("end"), d.alias("date"))).otherwise(acc["found"])
            return F.struct((at + F.length(m)).alias("end"), found.alias("found"))

        zero = F.struct(F.lit(1).alias("end"), F.lit(None).cast("struct<pos:int,end:int,date:date>").alias("found"))
        return F.aggregate(F.regexp_extract_all(p, F.lit(body), F.lit(0)), zero, step, lambda a: a["found"])

    def first(p):
        found = F.filter(F.array(*[kind(p, spec) for spec in values.DATES_ANYWHERE]), lambda x: x.isNotNull())
        return F.reduce(found, F.lit(None).cast("struct<pos:int,end:int,date:date>"), lambda a, b: F.when(a.isNull() | (b["pos"] < a["pos"]), b).otherwise(a))

    return let(plain(c), first)


def digits_repaired(c: Column) -> Column:
    """Letters that scanners read for digits, inside groups of up to four signs that hold a digit ("20a6-0s-29")."""
    return replace_each(c, r"(?<![a-zA-Z])[0-9oODlIi|ZzasSbGgqBT]{1,4}(?![a-zA-Z])", _as_digits(values.DATE_LOOKALIKES))


def digits_repaired_in_dates(c: Column) -> Column:
    """The repair dialect: only where three groups stand between separators, the first opening with a digit, and four signs
    or more are digits already."""
    group = "[0-9oOdDiIlL|sSzZbgqa]"
    return replace_each(c, rf"[0-9]{group}{{0,3}}(?:\s*[/\-.]\s*{group}{{1,4}}){{2}}", _as_digits(values.DATE_LOOKALIKES_REPAIR, 4))


def _as_digits(letters: dict[str, str], least: int = 1):
    return lambda x: F.when(F.length(F.regexp_replace(x, "[^0-9]", "")) >= least, F.translate(x, "".join(letters), "".join(letters.values()))).otherwise(x)


def slash_readings(c: Column) -> Column:
    """The text, and what it says if a 1 in it is a slash ("01101/2008" for "01/01/2008")."""
    ways = [(r"\b([0-9]{1,2})[1lI|]([0-9]{1,2})([/\-.])([0-9]{4})\b", "$1$3$2$3$4"), (r"\b([0-9]{1,2})([/\-.])([0-9]{1,2})[1lI|]([0-9]{4})\b", "$1$2$3$2$4"), (r"\b([0-9]{1,2})([/\-.])([0-9])1([0-9]{4})\b", "$1$2$3$2$4")]
    return F.array_distinct(F.array(c, *[F.regexp_replace(c, a, b) for a, b in ways]))


def loose_date(c: Column) -> Column:
    """dd/mm/yyyy of the repair dialect, as text, for the calendar is not asked: 31/02/2026 passes. Year, month, day; day,
    month, year; a slash read as 1; day, month word (whole or by its first letters), year. Years 1950 to 2100."""
    t = fold(digits_repaired_in_dates(c))
    months = values.MONTHS | values.MONTHS_SHORT
    kinds = [
        ("ymd", r"(?<![0-9])([0-9]{4})\s*[/\-.]\s*([0-9]{1,2})\s*[/\-.]\s*([0-9]{1,2})(?![0-9])"),
        ("dmy", r"(?<![0-9])([0-9]{1,2})\s*[/\-.]\s*([0-9]{1,2})\s*[/\-.]\s*([0-9]{4}|[0-9]{2})(?![0-9])"),
        ("dmy", r"(?<![0-9])([0-9]{1,2})[1li]([0-9]{1,2})[/\-.]([0-9]{4}|[0-9]{2})(?![0-9])"),
        ("dmy", r"(?<![0-9])([0-9]{1,2})\s*(?:de\s*)?([a-z]{3,10})\.?\s*(?:de[l]?\s*)?([0-9]{4})(?![0-9])"),
    ]

    def pick(t):
        out = None
        for order, pattern in kinds:
            g = {k: F.regexp_extract(t, pattern, i + 1) for i, k in enumerate(order)}
            one = F.struct(g["y"].alias("y"), g["m"].alias("m"), g["d"].alias("d"))
            out = F.when(F.regexp_like(t, F.lit(pattern)), one) if out is None else out.when(F.regexp_like(t, F.lit(pattern)), one)
        return out

    def write(x):
        y, d = x["y"].try_cast("int"), x["d"].try_cast("int")
        y, m = F.when(y < 100, y + 2000).otherwise(y), F.coalesce(x["m"].try_cast("int"), F.try_element_at(_map(months), x["m"]))
        two = lambda n: F.lpad(n.cast("string"), 2, "0")
        return F.when(d.between(1, 31) & m.between(1, 12) & y.between(1950, 2100), F.concat_ws("/", two(d), two(m), y.cast("string")))

    return let(let(t, pick), write)


def date_spellings(d: Column, like: Column) -> Column:
    """A date's digits in the order of another written date, padded and not: year first if that opens with four digits, day
    first otherwise; null if that has not three groups."""
    groups = F.regexp_extract_all(like, F.lit("[0-9]+"), F.lit(0))
    year_first = F.length(F.get(groups, F.lit(0))) == 4
    y, m, n = F.date_format(d, "yyyy"), F.month(d).cast("string"), F.dayofmonth(d).cast("string")
    def order(m, n):
        return F.when(year_first, F.concat(y, m, n)).otherwise(F.concat(n, m, y))

    return F.when(F.size(groups) == 3, F.array_distinct(F.array(order(F.lpad(m, 2, "0"), F.lpad(n, 2, "0")), order(m, n))))


def shown(d: Column) -> Column:
    return F.date_format(d, "dd/MM/yyyy")


def plausible(d: Column, as_of: Column) -> Column:
    """Year from ten before to one after the given day."""
    return F.year(d).between(F.year(as_of) - 10, F.year(as_of) + 1)
