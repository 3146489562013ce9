"""Amounts in figures. The dialects differ in how they read separators; each result is decimal(18,2) or null."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from . import values
from .text import let, plain

MONEY = "decimal(18,2)"


def _cast(s: Column) -> Column:
    return F.round(s.try_cast("decimal(38,10)"), 2).cast(MONEY)


def _last(s: Column, sep: str) -> Column:
    """Position of the last separator from the left, 0 if none."""
    at = F.instr(F.reverse(s), sep)
    return F.when(at > 0, F.length(s) + 1 - at).otherwise(0)


def amount_rules(c: Column) -> Column:
    """A lone full stop is always decimal; a lone comma is, if at most two digits follow the last one. Half up."""
    def read(s):
        comma, dot = _last(s, ","), _last(s, ".")
        both = F.when(comma > dot, F.translate(s, ",.", ".")).otherwise(F.translate(s, ",", ""))
        lone = F.when(F.length(s) - comma <= 2, F.translate(s, ",", ".")).otherwise(F.translate(s, ",", ""))
        return F.when((comma > 0) & (dot > 0), both).when(comma > 0, lone).otherwise(s)

    number = let(let(F.regexp_replace(c, r"[^0-9,.\-]", ""), read), lambda s: F.when(F.regexp_like(s, F.lit(r"^-?([0-9]+\.?[0-9]*|\.[0-9]+)$")), s))
    return _cast(number)


def amount_tolerant(c: Column) -> Column:
    """Look-alike letters count as digits inside a number; thousands stand in groups of three, else the amount is malformed
    and null. Words at either end of a number that have no digit of their own do not belong to it."""
    def bare(run):
        return F.regexp_replace(F.regexp_replace(run, r"^(?:[^0-9\s]+\s+)+|\s+$", ""), r"(?:\s+[^0-9\s]+)+$", "")

    def parts(s):
        """(all before the cents, cents)"""
        dotted, blank = r"[.,]\s*([0-9]{1,2})$", r"(?<=[0-9]{3})\s+([0-9]{2})$"
        return F.when(F.regexp_like(s, F.lit(dotted)), F.struct(F.regexp_replace(s, dotted, "").alias("whole"), F.regexp_extract(s, dotted, 1).alias("cents"))) \
            .when(F.regexp_like(s, F.lit(blank)), F.struct(F.regexp_replace(s, blank, "").alias("whole"), F.regexp_extract(s, blank, 1).alias("cents"))) \
            .otherwise(F.struct(s.alias("whole"), F.lit("00").alias("cents")))

    def value(x):
        good = F.regexp_like(x["whole"], F.lit(r"^[.,\s]*([0-9]+|[0-9]{1,3}([.,\s]+[0-9]{3})+)[.,\s]*$|^\s*[0-9]+(\s+[0-9]{3})+\s*$"))
        return F.when(good, F.concat(F.regexp_replace(x["whole"], "[^0-9]", ""), F.lit("."), F.rpad(x["cents"], 2, "0")).try_cast(MONEY))

    runs = F.transform(F.regexp_extract_all(c, F.lit(r"[0-9OoIlSsBZ|][0-9OoIlSsBZ|.,\s]*"), F.lit(0)), bare)
    run = F.get(F.filter(runs, lambda r: F.regexp_like(r, F.lit("[0-9]"))), F.lit(0))
    number = F.regexp_replace(F.translate(run, "".join(values.LOOKALIKES), "".join(values.LOOKALIKES.values())), r"^[ .,]+|[ .,]+$", "")
    return let(let(number, parts), value)


def _grouped(s: Column, half_even: bool) -> Column:
    comma, dot = _last(s, ","), _last(s, ".")
    last = F.greatest(comma, dot)
    both = (comma > 0) & (dot > 0)
    decimal = (last > 0) & (both | (F.length(s) - last).between(1, 2))
    # Of two kinds of separators the decimal one stands once.
    sign = F.when(comma > dot, ",").otherwise(".")
    once = ~both | (F.length(s) - F.length(F.replace(s, sign)) == 1)
    head = F.translate(F.when(decimal, F.substr(s, F.lit(1), last - 1)).otherwise(s), ".,", "")
    full = F.concat(head, F.when(decimal, F.concat(F.lit("."), F.substr(s, last + 1))).otherwise(F.lit("")))
    number = full.try_cast("decimal(38,10)")
    return F.when(F.regexp_like(s, F.lit("[0-9]")) & once, (F.bround(number, 2) if half_even else F.round(number, 2)).cast(MONEY))


def amount_grouped(c: Column, half_even: bool = True) -> Column:
    """A lone separator is decimal only before one or two final digits; with both kinds, the later is decimal."""
    return let(F.regexp_replace(c, r"[^0-9.,]", ""), lambda s: _grouped(s, half_even))


def _longest(tokens: Column, value) -> Column:
    """(text, value) of the longest token that has a value; the first of equally long ones."""
    found = F.filter(F.transform(tokens, lambda x: F.struct(x.alias("text"), value(x).alias("value"))), lambda r: r["value"].isNotNull())
    return F.reduce(found, F.lit(None).cast("struct<text:string,value:decimal(18,2)>"), lambda a, b: F.when(a.isNull() | (F.length(b["text"]) > F.length(a["text"])), b).otherwise(a))


def find_amount_bilingual(c: Column) -> Column:
    """(text, value) of the most plausible amount: the longest number that is no part of a fraction. Blanks and apostrophes
    may part thousands; cents may follow a hyphen, or a blank where nothing else is there. Half to even."""
    t = F.regexp_replace(c, values.CURRENCY_SIGNS, " ")
    t = F.regexp_replace(t, r"([0-9])\s*[-=]\s*(?=[0-9]{2}\b)", "$1.")
    t = F.regexp_replace(F.trim(t), r"([0-9])\s*[-=/]+\s*$", "$1")
    t = F.regexp_replace(t, r"^\s*([0-9]{1,3}(?:[.,][0-9]{3})*|[0-9]+)\s+([0-9]{2})\s*$", "$1.$2")
    value = lambda x: let(F.translate(x, "' ", ",,"), lambda s: _grouped(s, True))
    return _longest(F.regexp_extract_all(t, F.lit(values.AMOUNT_BILINGUAL), F.lit(0)), value)


def find_amount_repair(c: Column) -> Column:
    """(text, value) of the longest run of digits, letters o read as noughts; the first of equally long ones. Half to even."""
    value = lambda x: let(F.replace(x, F.lit(" "), F.lit("")), lambda s: F.when(F.regexp_like(s, F.lit("^[0-9.,]+$")), _grouped(s, True)))
    # The longest run counts even if it has no value.
    runs = F.regexp_extract_all(F.translate(c, "Oo", "00"), F.lit(values.AMOUNT_REPAIR), F.lit(0))
    longest = F.array_max(F.transform(runs, lambda x: F.length(x)))
    return _longest(F.slice(F.filter(runs, lambda x: F.length(x) == longest), 1, 1), value)


#: Values of single tokens; the two last have finders of their own for running text.
DIALECTS = {"rules": amount_rules, "tolerant": amount_tolerant, "bilingual": amount_grouped, "repair": amount_grouped}


def parse_amount(c: Column, dialect: str) -> Column:
    return DIALECTS[dialect](c)


def amount_hypotheses(c: Column, confidence: Column) -> Column:
    """What a reading of an amount may mean, as (value, weight): itself; without a first 5, which may be a printed dollar
    sign; its digits with the last two as raised cents."""
    noughts = r"[cCoODQ](?=[cCoODQ]*[0-9])|(?<=[0-9][cCoODQ]{0,40})[cCoODQ]"
    def ways(t):
        d = F.regexp_replace(F.translate(t, "".join(values.LOOKALIKES), "".join(values.LOOKALIKES.values())), "[^0-9]", "")
        pairs = [(amount_tolerant(t), 1.0), (F.when(F.regexp_like(t, F.lit("^5[0-9]{2,}")), amount_tolerant(F.substr(t, F.lit(2)))), 0.8), (F.when(F.length(d) >= 3, (d.try_cast("decimal(20,0)") / 100).try_cast(MONEY)), 0.5)]
        return F.filter(F.array(*[F.struct(v.alias("value"), (confidence * w).alias("weight")) for v, w in pairs]), lambda x: x["value"] > 0)

    return let(F.regexp_replace(F.regexp_replace(c, "^[^0-9]*", ""), noughts, "0"), ways)


def comparable(field: Column, c: Column, words_value: Column) -> Column:
    """A value as it is compared with the truth: amounts with two decimals (those in words by ``words_value``), numbers
    without other signs, other texts plain; null counts as empty."""
    v = F.lower(F.trim(c))
    money = F.coalesce(F.when(F.regexp_like(v, F.lit(r"^-?[0-9]*\.?[0-9]+$")), v.try_cast(MONEY).cast("string")), v)
    spoken = F.when(F.regexp_like(v, F.lit(r"^[0-9.]+$")), money).otherwise(F.coalesce(words_value.cast(MONEY).cast("string"), v))
    out = F.when(field == "monto_numeros", money).when(field == "monto_letras", spoken).when(field.isin("numero_cheque", "cuenta", "micr"), F.regexp_replace(v, "[^0-9]", "")).otherwise(plain(v))
    return F.coalesce(out, F.lit(""))


def amount_score(symbol: Column, near_symbol: Column, decimals: Column, starred: Column, cx: Column, cy: Column, digits: Column, agrees: Column) -> Column:
    """How well a token serves as the amount, for a page of width and height 1; below 0.45 it does not."""
    when = lambda c, x: F.when(c, x).otherwise(0.0)
    return (F.lit(0.3) + when(symbol | near_symbol, 0.35) + when(decimals | starred, 0.15) + when(cx > 0.55, 0.15) + when(cy < 0.6, 0.05)
            - when((digits >= 7) & ~decimals & ~symbol, 0.45) + when(F.coalesce(agrees, F.lit(False)), 0.5))


def amount_score_repair(symbol: Column, decimals: Column, cx: Column, digits: Column, agrees: Column) -> Column:
    """The repair dialect's score; null where a token without a sign has no decimals or too many digits."""
    when = lambda c, x: F.when(c, x).otherwise(0.0)
    return F.when(symbol | ((digits <= 9) & decimals), when(symbol, 3.0) + when(decimals, 2.0) + cx + when(F.coalesce(agrees, F.lit(False)), 10.0))


def line_tokens(c: Column) -> Column:
    """Groups of digits of a magnetic line, look-alike letters read as digits."""
    return F.regexp_extract_all(F.translate(c, "".join(values.LINE_LOOKALIKES), "".join(values.LINE_LOOKALIKES.values())), F.lit("[0-9]+"), F.lit(0))


def routing_ok(c: Column) -> Column:
    """Nine digits whose sum weighted 3-7-1 is a multiple of ten."""
    total = sum((F.substring(c, i + 1, 1).try_cast("int") * (3, 7, 1)[i % 3] for i in range(9)), F.lit(0))
    return F.regexp_like(c, F.lit(r"^[0-9]{9}$")) & (total % 10 == 0)


def digit_neighbours(c: Column) -> Column:
    """All strings that differ from a digit string in exactly one digit."""
    return F.flatten(F.transform(F.sequence(F.lit(1), F.length(c)), lambda i: F.transform(F.filter(F.sequence(F.lit(0), F.lit(9)), lambda d: d.cast("string") != F.substr(c, i, F.lit(1))), lambda d: F.overlay(c, d.cast("string"), i, F.lit(1)))))


def masked(c: Column) -> Column:
    """An account number with a hyphen before its last two digits."""
    return F.concat(F.substr(c, F.lit(1), F.length(c) - 2), F.lit("-"), F.right(c, F.lit(2)))


def line_fold(characters: Column) -> Column:
    """Groups of a magnetic line out of its characters in order, as (digits, sure): "S", "T" and blanks end a group, and a
    group with a "?" is not sure. An empty or null line has none."""

    def step(acc, c):
        ends = c.isin("S", "T", " ")
        done = F.when(ends & (acc["now"] != ""), F.concat(acc["out"], F.array(F.struct(acc["now"].alias("digits"), acc["sure"].alias("sure"))))).otherwise(acc["out"])
        return F.struct(done.alias("out"), F.when(ends, "").otherwise(F.concat(acc["now"], c)).alias("now"), (ends | (acc["sure"] & (c != "?"))).alias("sure"))

    zero = F.expr("named_struct('out', cast(array() AS array<struct<digits: string, sure: boolean>>), 'now', '', 'sure', true)")
    return F.aggregate(F.concat(F.filter(characters, lambda c: c.isNotNull()), F.array(F.lit("S"))), zero, step, lambda a: a["out"])


def line_by_template(groups: Column, lengths: tuple[int, ...] = (6, 8, 10)) -> Column:
    """(number, routing, account, kind) of a line whose first groups have the lengths and, with the next one, are sure; else null."""
    fits = F.size(groups) > len(lengths)
    for i, n in enumerate(lengths):
        fits &= F.length(F.get(groups, F.lit(i))["digits"]) == n
    fits &= F.forall(F.slice(groups, 1, len(lengths) + 1), lambda g: g["sure"])
    digits = lambda i: F.get(groups, F.lit(i))["digits"]
    return F.when(F.coalesce(fits, F.lit(False)), F.struct(digits(0).alias("number"), digits(1).alias("routing"), masked(digits(2)).alias("account"), F.left(digits(3), F.lit(2)).alias("kind")))


def tokens_of_length(tokens: Column, n: int) -> Column:
    """The groups of a length, then those with one digit too many, without their first and without their last: a symbol that was read as a digit stands at one end."""
    whole = F.filter(tokens, lambda x: F.length(x) == n)
    longer = F.flatten(F.transform(F.filter(tokens, lambda x: F.length(x) == n + 1), lambda x: F.array(F.substr(x, F.lit(2)), F.left(x, F.lit(n)))))
    return F.concat(whole, longer)
