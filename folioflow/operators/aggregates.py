"""Votes, margins, confidences and other aggregates over competing readings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def plurality(df: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """Most frequent value of each group; ties go to the value seen first. Columns: keys, value, votes."""
    counts = df.groupBy(*keys, value).agg(F.count("*").alias("votes"), F.min(order).alias("__first"))
    # max_by over a sortable pair keeps one row a group on the map side, where a window would move all.
    best = F.max_by(F.struct(value, "votes"), F.struct(F.col("votes"), -F.col("__first").cast("double"), F.col(value)))
    return counts.groupBy(*keys).agg(best.alias("__b")).select(*keys, f"__b.{value}", "__b.votes")


def weighted_vote(df: DataFrame, keys: list[str], value: str, weight: Column) -> DataFrame:
    """Sum of weights of every value of each group."""
    return df.groupBy(*keys, value).agg(F.sum(weight).alias("score"))


def best_weight_per_reading(df: DataFrame, keys: list[str], reading: str, value: str, weight: Column) -> DataFrame:
    """A reading counts once for a value, with its best weight; weights then add up over readings."""
    once = df.groupBy(*keys, reading, value).agg(F.max(weight).alias("__w"))
    return once.groupBy(*keys, value).agg(F.sum("__w").alias("score"))


def winner_margin(df: DataFrame, keys: list[str], value: str, score: str, alone: float = 99.0, half_life: float = 3.0) -> DataFrame:
    """Best candidate of each group, its margin over the runner-up, and a confidence that grows with the margin.

    Ties go to the smaller value. Candidates of a group are ordered by a window: their number is small.
    """
    w = Window.partitionBy(*keys).orderBy(F.col(score).desc(), F.col(value))
    ranked = df.withColumn("__r", F.row_number().over(w)).withColumn("margin", F.coalesce(F.col(score) - F.lead(score).over(w), F.lit(alone)))
    return ranked.where("__r = 1").drop("__r").withColumn("confidence", 1 - 0.5 * F.exp(-F.col("margin") / half_life))


def unanimity(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Whether all readings of a group agree, null readings included as dissent."""
    return df.groupBy(*keys).agg(F.count("*").alias("readings"), ((F.min(value) == F.max(value)) & (F.count(value) == F.count("*"))).alias("unanimous"))


def geometric_mean(probability: Column) -> Column:
    """exp of the mean log-probability; zeros and nulls are passed over."""
    return F.exp(F.avg(F.when(probability > 0, F.ln(probability))))


def length_weighted(confidence: Column, text: Column) -> Column:
    """Mean confidence in which longer texts count more; an empty text counts as one character."""
    n = F.greatest(F.length(text), F.lit(1))
    return F.sum(confidence * n) / F.sum(n)


def record_confidence(confidence: Column, required: Column) -> Column:
    """Mean over fields; a missing required field counts as 0, a missing optional one not at all."""
    return F.coalesce(F.avg(F.coalesce(confidence, F.when(required, F.lit(0.0)))), F.lit(0.0))


def bounding_box(x0: str, y0: str, x1: str, y1: str) -> list[Column]:
    return [F.min(x0).alias("x0"), F.min(y0).alias("y0"), F.max(x1).alias("x1"), F.max(y1).alias("y1")]


def accuracy_matrix(df: DataFrame, keys: list[str], expected: Column, found: Column, review: Column) -> DataFrame:
    """Counts of right and wrong values, decided automatically or sent to review; with the shares. Rows without truth are passed over."""
    right, sent = F.coalesce(expected == found, F.lit(False)), F.coalesce(review, F.lit(False))
    rows = df.where(expected.isNotNull())
    out = rows.groupBy(*keys).agg(
        F.count_if(right & ~sent).alias("ok_auto"), F.count_if(right & sent).alias("ok_review"),
        F.count_if(~right & ~sent).alias("error_auto"), F.count_if(~right & sent).alias("error_review"), F.count("*").alias("total"),
    )
    return out.withColumn("accuracy", (F.col("ok_auto") + F.col("ok_review")) / F.col("total")).withColumn("automatic", (F.col("ok_auto") + F.col("error_auto")) / F.col("total"))


def mean_confidence(c: Column) -> Column:
    """Mean to three places; 0 where there is none."""
    return F.coalesce(F.round(F.avg(c), 3), F.lit(0.0))


def overall_confidence(whole: Column, parts: Column) -> Column:
    """A record's own confidence, unless it is missing or 0, else the mean of its fields'."""
    return F.coalesce(F.nullif(whole, F.lit(0.0)), parts)


def reading_score(confidence: Column, text: Column) -> Column:
    """Confidence weighted by length: compares two readings of one page."""
    return F.coalesce(F.sum(confidence * F.length(text)), F.lit(0.0))


def reading_utility(score: Column, number_words: Column, amount_in_words: Column, has_fraction: Column) -> Column:
    """A reading's score with what it keeps of a written amount."""
    return score + 12 * number_words + F.when(amount_in_words.isNotNull(), 40).otherwise(0) + F.when(has_fraction, 8).otherwise(0)


def useful_readings(df: DataFrame, keys: list[str], reading: str, order: str, confidence: str, text: str) -> DataFrame:
    """keys, reading, utility, best: each reading's utility (boxes in their order make its text), and whether it is the best
    of its page; of equal ones that of the least name is. Null texts and confidences add nothing."""
    from folioflow.functions import words

    said = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda b: b[text]), " ")
    cents = F.coalesce(F.bool_or(F.regexp_like(text, F.lit("/")) & F.regexp_like(text, F.lit("[0-9]"))), F.lit(False))
    rows = df.groupBy(*keys, reading).agg(reading_score(F.col(confidence), F.col(text)).alias("score"), said.alias("said"), cents.alias("cents"))
    amount = words.amount_words_tolerant(words.repaired_words(F.col("said")))
    rows = rows.withColumns({"n": words.number_word_count(words.split_glued(F.col("said"))), "amount": amount})
    rows = rows.select(*keys, reading, reading_utility(F.col("score"), F.col("n"), F.col("amount"), F.col("cents")).alias("utility"))
    return rows.withColumn("best", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("utility"), reading)) == 1)


def poor_reading(df: DataFrame, keys: list[str], confidence: Column, text: Column, least: int = 6, low: float = 18.0) -> DataFrame:
    """Readings with few boxes, a low score, or many boxes of one or two letters (handwriting cut letter by letter)."""
    out = df.groupBy(*keys).agg(F.count("*").alias("boxes"), reading_score(confidence, text).alias("score"), F.count_if(F.length(text) <= 2).alias("short"))
    return out.withColumn("poor", (F.col("boxes") < least) | (F.col("score") < low) | (F.col("short") >= F.greatest(F.lit(4.0), 0.45 * F.col("boxes"))))


def review_summary(df: DataFrame, valid: Column, review: Column, confidence: Column) -> DataFrame:
    """Rows, those verified, those to review, and their mean confidence."""
    return df.agg(F.count("*").alias("total"), F.count_if(valid & ~review).alias("verified"), F.count_if(review).alias("to_review"), mean_confidence(confidence).alias("confidence"))


def step_times(df: DataFrame, keys: list[str], seconds: str, total: Column | None = None) -> DataFrame:
    """Count, mean to six places and maximum of a step's time; with ``total`` also the time left: mean times what is not done."""
    out = df.groupBy(*keys).agg(F.count("*").alias("n"), F.round(F.avg(seconds), 6).alias("mean"), F.max(seconds).alias("longest"))
    return out if total is None else out.withColumn("left", F.round(F.col("mean") * F.greatest(total - F.col("n"), F.lit(0)), 3))


def median_scale(df: DataFrame, keys: list[str], value: str, least: int = 3, otherwise: float = 1.0) -> DataFrame:
    """Median of each group, or ``otherwise`` where fewer than ``least`` values are there."""
    return df.groupBy(*keys).agg(F.count(value).alias("n"), F.when(F.count(value) >= least, F.median(value)).otherwise(otherwise).alias("scale"))
