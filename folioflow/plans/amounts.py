"""An amount that is written twice, in figures and in words, decided on the images of both zones.

The search has two stages. What either zone was read as, and every amount one digit away from that, is scored in the zone
of figures, where a candidate has one or two forms; the best of those, the likest to what was read in words, and
everything read then are scored in the zone of words over all ways to write them. Candidates of a record are an array of
some hundreds at most, so both stages are expressions on one row and records are never shuffled but to bring their
readings together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from folioflow.functions import numbers, values
from folioflow.functions.text import let, plain
from folioflow.functions.words import amount_digits, amount_spellings, amount_words_tolerant, cents_repaired, number_words, repaired_words
from folioflow.operators.candidates import ctc_best
from folioflow.plans.deciders import amount_decision
from folioflow.session import cut, matched, spread

MONEY = "decimal(18,2)"


def neighbours(v: Column) -> Column:
    """Amounts above 0 that differ from one in a single digit of its usual form; cents and a nought before them included."""
    digits = F.lpad((v * 100).cast("long").cast("string"), 3, "0")
    digits = F.when(v < 1, digits).otherwise((v * 100).cast("long").cast("string"))
    return F.filter(F.transform(numbers.digit_neighbours(digits), lambda d: (d.cast("decimal(20,0)") / 100).cast(MONEY)), lambda x: x > 0)


def likeness(a: Column, b: Column) -> Column:
    """1 for equal texts, less by the share of letters that an edit has to touch."""
    return 1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b), F.lit(1))


def _usual(forms: Column, dollars: Column, con: Column) -> Column:
    """Of all ways to write an amount those that name dollars, or "con" before cents in figures, only where the reading does."""
    return F.filter(forms, lambda x: F.when(F.contains(x, F.lit(" dolares")), dollars).when(F.regexp_like(x, F.lit(" con [0-9]+$")), con).otherwise(True))


def _scored(df: DataFrame, zones: DataFrame, zone: str, key: str, forms: str, name: str, alphabet: str, as_blank: str) -> DataFrame:
    """Adds the candidates' scores over the images of a zone, and the number of those."""
    images = spread(zones.where((F.col("zone") == zone) & F.col("m").isNotNull() & (F.col("t") > 0)), key).groupBy(key).agg(F.collect_list(F.struct("m", "t")).alias("images"))
    out = matched(spread(df, key), images, key, how="left").withColumns({name: ctc_best(F.col("images.m"), F.col("images.t"), F.col(forms), alphabet, as_blank=as_blank), f"{name}_n": F.coalesce(F.size("images"), F.lit(0))})
    return out.drop("images")


def amount(readings: DataFrame, zones: DataFrame, key: str, alphabet: str, most: float = 999_999_999.99, finalists: int = 12, agrees: float = 0.75) -> DataFrame:
    """One row for each key of ``readings``: value, confidence, review, margin, fit, same, read, top (the best three).

    readings: key, zone ("figures" or "words"), text, confidence, deep (by the deep reader; null is not). zones: key, zone,
    m, t, matrices as ``ctc_scores`` takes them, few a key. Ties go to the smaller amount. A record in which nothing was
    read has a null value and goes to review; so does one whose value no zone was read as, see ``amount_decision``.
    Null texts say nothing; repeated readings weigh once.
    """
    said = readings.where("zone = 'words' AND text IS NOT NULL").select(key, cents_repaired(F.col("text")).alias("text"), F.coalesce("deep", F.lit(False)).alias("deep"))
    said = said.withColumns({"norm": plain(F.col("text")), "value": amount_words_tolerant(repaired_words(F.col("text")))})
    shown = readings.where("zone = 'figures' AND text IS NOT NULL").select(key, "text", F.explode_outer(numbers.amount_hypotheses(F.col("text"), F.lit(1.0))).alias("h"))
    # Written before each of the searches, so that no plan holds them all: a filter on a value repeats all that reads it.
    said, shown = cut(said), cut(shown)
    base = said.select(key, "value", F.lit("w").alias("by")).unionByName(shown.select(key, F.col("h.value").alias("value"), F.lit("f").alias("by")))
    base = base.where((F.col("value") > 0) & (F.col("value") <= most)).groupBy(key, "value").agg((F.count_distinct("by") == 2).alias("same"))
    base = base.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("value", "same"))).alias("base"))
    texts = said.groupBy(key).agg(F.collect_list("norm").alias("norms"), F.collect_list("text").alias("words"), F.max(F.when(F.col("deep"), F.col("norm"))).alias("deep_text"))
    figures = shown.groupBy(key).agg(F.collect_set("text").alias("figures"))
    rows = readings.select(key).distinct()
    for part in (base, texts, figures):
        rows = matched(rows, part, key, how="left")
    none = F.array().cast("array<string>")
    rows = rows.withColumns({c: F.coalesce(c, none) for c in ("norms", "words", "figures")})
    whole = F.array_join("norms", " ")
    rows = rows.withColumns({"dollars": F.regexp_like(whole, F.lit("d[o0]l")), "con": F.regexp_like(whole, F.lit(r"\bc[o0]n\b")), "read": F.transform("base", lambda b: b["value"])})
    rows = cut(rows.select(key, "base", "norms", "words", "figures", "deep_text", "dollars", "con", "read"))
    near = F.filter(F.flatten(F.transform("read", neighbours)), lambda v: v <= most)
    rows = rows.withColumn("c", F.array_sort(F.array_distinct(F.concat("read", near)))).withColumn("forms", F.transform("c", amount_digits))
    rows = _scored(rows, zones, "figures", key, "forms", "f", alphabet, " .,-=_~'`^").drop("forms", "f_n")
    rows = cut(rows)

    # The best in figures, the likest to the words, and what was read.
    fields = F.transform(F.arrays_zip("c", "f"), lambda x: F.struct((-F.coalesce(x["f"], F.lit(-1e9))).alias("f"), x["c"].alias("value")))
    alike = F.transform("c", lambda v: let(let(F.floor(v).cast("int"), number_words), lambda w: F.struct((-F.array_max(F.transform("norms", lambda n: likeness(w, n)))).alias("l"), v.alias("value"))))
    best = F.transform(F.slice(F.array_sort(fields), 1, finalists), lambda x: x["value"])
    likest = F.when(F.size("norms") > 0, F.transform(F.slice(F.array_sort(alike), 1, finalists // 2), lambda x: x["value"])).otherwise(F.slice("c", 1, 0))
    rows = cut(rows.withColumn("last", F.array_sort(F.array_union(F.array_union(best, likest), "read"))).drop("norms"))
    rows = rows.withColumn("forms", F.transform("last", lambda v: _usual(amount_spellings(v, True, True), F.col("dollars"), F.col("con"))))
    # The ways to write all finalists weigh far more than the rest of a row; those of the best are listed again below.
    rows = cut(_scored(rows, zones, "words", key, "forms", "w", alphabet, " /|)(").drop("forms"))
    by_value = F.map_from_arrays("c", "f")
    total = F.transform(F.arrays_zip("last", "w"), lambda x: F.struct((-(F.coalesce(F.element_at(by_value, x["last"]), F.lit(-1e9)) + F.coalesce(x["w"], F.lit(-1e9)))).alias("loss"), x["last"].alias("value"), x["w"].alias("w")))
    rows = rows.withColumn("ranked", F.array_sort(total)).withColumn("first", F.get("ranked", F.lit(0)))
    rows = cut(rows.withColumn("value", F.col("first.value")).drop("c", "f", "last", "w")).withColumn("forms", amount_spellings(F.col("value"), True, True))
    letters = F.array_min(F.transform(_usual(F.col("forms"), F.col("dollars"), F.col("con")), lambda x: F.length(F.replace(x, F.lit(" "), F.lit("")))))
    rows = rows.withColumns({
        "margin": F.coalesce(F.get("ranked", F.lit(1))["loss"] - F.col("first.loss"), F.lit(99.0)),
        "fit": F.coalesce(F.col("first.w") / F.greatest("w_n", F.lit(1)) / F.greatest(letters, F.lit(1)), F.lit(-1e9)),
        "same": F.exists("base", lambda b: (b["value"] == F.col("value")) & b["same"]),
        "top": F.transform(F.slice("ranked", 1, 3), lambda x: x["value"]),
    })
    # The deep reader confirms a value if its text is like one of the ways to write it.
    spellings = F.when(F.col("deep_text").isNotNull(), F.col("forms"))
    confirmed = F.array_max(F.transform(spellings, lambda x: likeness(x, F.col("deep_text")))) >= agrees
    rows = rows.withColumns({"deep": F.coalesce(confirmed, F.lit(False)), "is_read": F.array_contains("read", F.col("value"))})
    gated = rows.select(key, "value", "margin", "fit", "deep", "figures", "words", "top", F.coalesce("same", F.lit(False)).alias("same"), F.coalesce("is_read", F.lit(False)).alias("read"))
    return amount_decision(gated).select(key, "value", F.when(F.col("value").isNull(), 0.0).otherwise(F.col("confidence")).alias("confidence"), "review", "margin", "fit", "same", "read", "top")
