"""Amounts in Spanish or English words, with how much of the text was understood, as Spark expressions.

The vocabulary of both languages is one pattern, longest words first, so a word in which blanks were lost is cut by the
longest word that it begins with, again and again; it stays whole if that leaves a rest.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from . import values
from .text import let, plain
from .words import _map

_NUMBERS = [*values.BILINGUAL_UNITS, *values.BILINGUAL_SCALES]
_KNOWN = [*_NUMBERS, "hundred", *values.BILINGUAL_CENTS, *values.BILINGUAL_CURRENCIES]
_GLUED = "(" + "|".join(sorted({*_NUMBERS, "y", "con"}, key=lambda w: (-len(w), w))) + ")"
MONEY = "decimal(18,2)"


def _cut(word: Column) -> Column:
    pieces = F.regexp_extract_all(word, F.lit(_GLUED), F.lit(0))
    return F.when(word.isin(_NUMBERS) | (F.length(word) < 6) | (F.array_join(pieces, "") != word), F.array(word)).otherwise(pieces)


def _understood(word: Column, least: float) -> Column:
    """The word if it is known, else the likest known one if edits touch few of its letters, else null."""
    alike = F.transform(F.array(*map(F.lit, [*_KNOWN, "con"])), lambda v: F.struct((1 - F.levenshtein(word, v) / F.greatest(F.length(word), F.length(v))).alias("alike"), v.alias("word")))
    best = F.array_max(alike)
    return F.when(word.isin([*_KNOWN, *values.BILINGUAL_CONNECTORS, *values.BEFORE_CENTS]), word).when((F.length(word) >= 3) & (best["alike"] >= least), best["word"])


def _number(words: Column) -> Column:
    """Fold: units add up, "hundred" multiplies what stands since the last scale, a thousand banks it, a million multiplies all. Null without a number."""
    units = _map(values.BILINGUAL_UNITS)

    def step(acc, w):
        now, total, unit = acc["now"], acc["total"], F.try_element_at(units, w)
        thousand, million, hundred = w.isin("mil", "thousand"), w.isin("millon", "millones", "million"), w == "hundred"
        most = F.greatest(now, F.lit(1))
        return F.struct(
            F.when(thousand, total + most * 1000).when(million, (total + most) * 1_000_000).otherwise(total).cast("long").alias("total"),
            F.when(thousand | million, F.lit(0)).when(hundred, most * 100).otherwise(now + F.coalesce(unit, F.lit(0))).cast("long").alias("now"),
            (acc["found"] | thousand | million | hundred | unit.isNotNull()).alias("found"),
        )

    zero = F.struct(F.lit(0).cast("long").alias("total"), F.lit(0).cast("long").alias("now"), F.lit(False).alias("found"))
    return F.aggregate(words, zero, step, lambda a: F.when(a["found"], a["total"] + a["now"]))


def amount_words_bilingual(c: Column, least: float = 0.75) -> Column:
    """(value, share, currency): the amount, the share of the text's words that were understood, and the first word for a currency.

    Cents are those of NN/100, or, if there is a word for cents, what follows the first "con", "and", "with" or currency
    that a number follows; 100 cents and more are none. Null without a word that is a number.
    """

    def read(p):
        cents = F.translate(F.regexp_extract(p, values.CENTS_FRACTION, 1), "o", "0").try_cast("int")
        body = F.regexp_replace(F.concat_ws(" ", F.split(p, values.CENTS_FRACTION, 2)), "[^a-z]", " ")
        return let(F.struct(cents.alias("cents"), F.filter(F.split(body, " +"), lambda w: w != "").alias("raw")), understand)

    def understand(x):
        words = F.filter(F.transform(F.flatten(F.transform(x["raw"], _cut)), lambda w: _understood(w, least)), lambda w: w.isNotNull())
        return let(F.struct(x["cents"].alias("cents"), F.size(x["raw"]).alias("n"), words.alias("words")), settle)

    def settle(x):
        words = x["words"]
        follows = lambda i: F.exists(F.slice(words, i + 2, F.size(words)), lambda w: w.isin([*values.BILINGUAL_UNITS]))
        spoken = x["cents"].isNull() & F.exists(words, lambda w: w.isin(values.BILINGUAL_CENTS))
        at = F.array_min(F.filter(F.transform(words, lambda w, i: F.when(w.isin([*values.BEFORE_CENTS, *values.BILINGUAL_CURRENCIES]) & follows(i), i)), lambda i: i.isNotNull()))
        at = F.when(spoken, at)
        whole = _number(F.filter(F.when(at.isNotNull(), F.slice(words, 1, at)).otherwise(words), lambda w: ~w.isin(values.BILINGUAL_CENTS)))
        cents = F.coalesce(x["cents"], F.when(at.isNotNull(), F.coalesce(_number(F.slice(words, at + 2, F.size(words))), F.lit(0))))
        value = (whole.cast("decimal(20,0)") + F.coalesce(F.when(cents < 100, cents), F.lit(0)).cast("decimal(4,0)") / 100).try_cast(MONEY)
        share = F.least(F.size(words) / F.greatest(x["n"], F.lit(1)), F.lit(1.0))
        currency = F.get(F.filter(words, lambda w: w.isin(values.BILINGUAL_CURRENCIES)), F.lit(0))
        return F.when(value.isNotNull(), F.struct(value.alias("value"), share.alias("share"), currency.alias("currency")))

    return let(plain(c), read)


def number_words_english(n: Column) -> Column:
    """English words of 1 to 999,999,999."""
    by_value = {v: k for k, v in values.BILINGUAL_UNITS.items() if k.isascii() and list(values.BILINGUAL_UNITS).index(k) >= list(values.BILINGUAL_UNITS).index("zero")}
    table = _map(by_value)

    def hundreds(x):
        rest = x % 100
        small = F.when(rest == 0, F.lit(None)).when(rest <= 20, F.try_element_at(table, rest)).otherwise(F.concat_ws(" ", F.try_element_at(table, rest - rest % 10), F.when(rest % 10 > 0, F.try_element_at(table, rest % 10))))
        return F.concat_ws(" ", F.when(x >= 100, F.concat(F.try_element_at(table, F.floor(x / 100).cast("int")), F.lit(" hundred"))), small)

    part = lambda x: let(x.cast("int"), hundreds)
    millions, thousands, rest = F.floor(n / 1_000_000), F.floor(n % 1_000_000 / 1000), n % 1000
    return F.concat_ws(" ", F.when(millions > 0, F.concat(part(millions), F.lit(" million"))), F.when(thousands > 0, F.concat(part(thousands), F.lit(" thousand"))), F.when(rest > 0, part(rest)))
