"""Queries of deciders that score candidates on images: matrices are rendered from the tables, so the truth is known."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioflow.functions import words
from folioflow.plans import amounts
from folioflow.queries import query, t
from folioflow.session import dealt

ALPHABET = "0123456789abcdefghijklmnopqrstuvwxyz"


def frames(text, alphabet: str = ALPHABET):
    """A reader's matrix that spells a text, flat, and its number of steps: a blank frame round every character."""
    row = lambda c: F.transform(F.array(F.lit(""), *map(F.lit, alphabet)), lambda d: F.when(d == c, 0.9).otherwise(0.1 / len(alphabet)))
    letters = F.regexp_extract_all(F.replace(text, F.lit(" "), F.lit("")), F.lit("(.)"))
    return F.concat(row(F.lit("")), F.flatten(F.transform(letters, lambda c: F.concat(row(c), row(F.lit("")))))), 2 * F.size(letters) + 1


@query("""
WITH c AS (SELECT c_custkey AS k, abs(c_acctbal)::DECIMAL(18,2) AS v, c_custkey % 4 AS q FROM customer), n AS (SELECT *, floor(v)::BIGINT AS n FROM c),
spoken AS (SELECT *, CASE WHEN n = 0 THEN 1 ELSE CASE WHEN n >= 2000 THEN 2 WHEN n >= 1000 THEN 1 ELSE 0 END + CASE WHEN n % 1000 >= 100 THEN 1 ELSE 0 END
  + CASE WHEN n % 100 = 0 THEN 0 WHEN n % 100 < 30 OR n % 10 = 0 THEN 1 ELSE 2 END END AS words FROM n)
SELECT k, CASE WHEN v > 0 THEN v END AS value, NOT (v > 0 AND q < 2 AND words >= 2) AS review, v > 0 AND (q < 2 OR q = 2) AS read FROM spoken""")
def amounts_on_images(spark, sf):
    """Every customer's balance written twice: in half of the records one digit of the figures was misread, in half the words
    could not be read, and the images tell; what no zone was read as goes to review."""
    c = dealt(t(spark, sf, "customer")).select(F.col("c_custkey").alias("k"), F.abs("c_acctbal").cast("decimal(18,2)").alias("v"), (F.col("c_custkey") % 4).alias("q"))
    digits = F.regexp_replace(F.col("v").cast("string"), "[.]", "")
    wrong = F.overlay("v", F.translate(F.left(F.col("v").cast("string"), F.lit(1)), "0123456789", "1234567898"), F.lit(1), F.lit(1))
    figures = c.select("k", F.lit("figures").alias("zone"), F.concat(F.lit("US$ "), F.when(F.col("q") % 2 == 1, wrong).otherwise(F.col("v").cast("string"))).alias("text"))
    spoken = c.select("k", F.lit("words").alias("zone"), F.when(F.col("q") < 2, words.words_of_amount(F.col("v"))).otherwise("ilegible").alias("text"))
    readings = figures.unionByName(spoken).withColumns({"confidence": F.lit(0.9), "deep": F.lit(False)})
    said = F.concat(words.number_words(F.floor("v")), F.right(digits, F.lit(2)))
    zones = None
    for zone, text in (("figures", digits), ("words", said)):
        m, n = frames(text)
        part = c.select("k", F.lit(zone).alias("zone"), m.alias("m"), n.alias("t"))
        zones = part if zones is None else zones.unionByName(part)
    return amounts.amount(readings, zones, "k", ALPHABET).select("k", "value", "review", "read")


@query("""
WITH o AS (SELECT o_orderkey AS k, o_orderdate::DATE AS d, o_orderkey % 3 AS q FROM orders)
SELECT k, d::VARCHAR AS value, q = 1 OR NOT year(d) BETWEEN 1991 AND 2002 AS review, date_diff('day', d, DATE '2001-12-31') AS days FROM o""")
def dates_on_images(spark, sf):
    """Every order's date read right twice, read with a wrong year twice, or read right once: the image tells, and what was never
    read goes to review."""
    from folioflow.plans import deciders

    o = dealt(t(spark, sf, "orders")).select(F.col("o_orderkey").alias("k"), F.col("o_orderdate").cast("date").alias("d"), (F.col("o_orderkey") % 3).alias("q"))
    right = F.when(F.col("k") % 2 == 0, F.date_format("d", "dd/MM/yyyy")).otherwise(F.date_format("d", "yyyy-MM-dd"))
    # Another year of the decade, or another day of the month: still a date.
    off = F.add_months("d", F.when(F.year("d") % 10 == 9, -12).otherwise(12))
    off = F.when(F.month("d") * 100 + F.dayofmonth("d") == 229, F.date_sub("d", 1)).otherwise(off)
    wrong = F.when(F.col("k") % 2 == 0, F.date_format(off, "dd/MM/yyyy")).otherwise(F.date_format(off, "yyyy-MM-dd"))
    texts = F.when(F.col("q") == 0, F.array(right, right)).when(F.col("q") == 1, F.array(wrong, wrong)).otherwise(F.array(right))
    m, n = frames(F.regexp_replace(right, "[^0-9]", ""), "0123456789")
    readings, zones = o.select("k", F.explode(texts).alias("text")), o.select("k", m.alias("m"), n.alias("t"))
    out = deciders.date_on_image(readings, zones, "k", "2001-12-31", "0123456789")
    return out.select("k", "value", "review", F.col("days").cast("long").alias("days"))
