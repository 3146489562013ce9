"""Operator 5: quality rules, a threshold table compiled into one projection of built-in functions.

A rule names a measure and its bounds; ``quality_rules`` builds every measure with Spark's own
expressions in stages of one pass (words are split once) and compares each with its bounds.  No shuffle,
no user function: repeated three-word windows are found by sorting their hashes inside the row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import doc_columns

SPACE = " \t\n\u000b\f\r"
SYMBOLS = "#*$%&|<>"
#: Frequent function words of the four languages; a text in sentences holds some of them.
STOP_WORDS = ["the", "of", "and", "to", "in", "that", "is", "with", "for", "be", "der", "die", "und", "das", "ist", "mit", "von", "nicht", "le", "la", "les", "de", "et", "des", "que", "en", "el", "los", "una", "por", "con", "para", "un", "a", "an", "it", "on", "as"]

#: (measure, least, most); None leaves a side open.
RULES = [
    ("n_words", 50, 1_000_000),
    ("mean_word_chars", 2.0, 25.0),
    ("symbol_ratio", None, 0.1),
    ("stop_word_ratio", 0.02, None),
    ("dup_line_ratio", None, 0.5),
    ("table_line_ratio", None, 0.5),
    ("repeat_word_ratio", None, 0.5),
]


def ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def measures(docs: DataFrame) -> DataFrame:
    """doc_id and the measures of every row; a null text has no words."""
    text = F.coalesce(docs["text"], F.lit(""))
    df = docs.select("doc_id", text.alias("text"), F.btrim(text, F.lit(SPACE)).alias("body"))
    df = df.select(
        "doc_id",
        F.when(F.col("body") == "", F.array().cast("array<string>")).otherwise(F.split("body", "[ \\t-\\r]+")).alias("words"),
        F.filter(F.split("text", "\n"), lambda x: F.btrim(x, F.lit(SPACE)) != "").alias("lines"),
        F.length(F.translate("text", SPACE, "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
    )
    df = df.select(
        "*",
        F.size("words").cast("long").alias("n_words"),
        F.size("lines").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size(F.filter("lines", lambda x: F.contains(x, F.lit("|")))).alias("n_table_lines"),
        F.size(F.filter("words", lambda w: F.lower(w).isin(STOP_WORDS))).alias("n_stop"),
        F.transform(F.slice("words", 1, F.greatest(F.size("words") - 2, F.lit(0))), lambda w, i: F.xxhash64(w, F.get("words", i + 1), F.get("words", i + 2))).alias("windows"),
    ).drop("words", "lines")
    df = df.withColumn("repeats", F.size(F.array_distinct("windows")) < F.size("windows"))
    df = df.withColumn("sorted", F.when(F.col("repeats"), F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))).drop("windows")
    df = df.select("*", F.transform("sorted", lambda s: s["h"]).alias("sh"), F.transform("sorted", lambda s: s["i"]).alias("si")).drop("sorted")
    twice = F.transform("sh", lambda h, j: F.when((h == F.get("sh", j - 1)) | (h == F.get("sh", j + 1)), F.get("si", j)).otherwise(F.lit(-1)))
    df = df.withColumn("at", F.sort_array(F.filter(twice, lambda i: i >= 0))).drop("sh", "si")
    covered = F.aggregate(F.transform("at", lambda p, j: F.least(F.lit(3), F.coalesce(F.get("at", j + 1) - p, F.lit(3)))), F.lit(0), lambda a, b: a + b)
    return df.withColumn("n_repeat_words", F.when(F.col("repeats"), covered).otherwise(0).cast("long")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        ratio(F.col("word_chars"), F.col("n_words")).alias("mean_word_chars"),
        ratio(F.col("n_symbols"), F.col("word_chars")).alias("symbol_ratio"),
        ratio(F.col("n_stop"), F.col("n_words")).alias("stop_word_ratio"),
        ratio(F.col("n_dup_lines"), F.col("n_lines")).alias("dup_line_ratio"),
        ratio(F.col("n_table_lines"), F.col("n_lines")).alias("table_line_ratio"),
        ratio(F.col("n_repeat_words"), F.col("n_words")).alias("repeat_word_ratio"),
    )


def passes(rules: list[tuple[str, float | None, float | None]]) -> Column:
    """The threshold table as one predicate."""
    ok = F.lit(True)
    for name, least, most in rules:
        if least is not None:
            ok &= F.col(name) >= least
        if most is not None:
            ok &= F.col(name) <= most
    return ok


def quality_rules(docs: DataFrame, rules: list[tuple[str, float | None, float | None]] = RULES) -> DataFrame:
    """Every row's doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, and the ratios.

    base_failed: fewer than 50 words, or over half of the words lie in repeated three-word windows.
    Null, empty and blank texts have no words and so fail; repeated rows each give a row; an empty table
    gives none; other columns are ignored.
    """
    df = measures(doc_columns(docs, "doc_id", "text"))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return df.withColumn("base_failed", failed).withColumn("kept", ~failed & passes(rules))


ORACLE = f"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines
  FROM documents
), win AS (
  SELECT doc_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS g
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM t)
), rep AS (
  SELECT doc_id, count(DISTINCT p) AS n
  FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p
        FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win) WHERE c > 1)
  GROUP BY doc_id
), m AS (
  SELECT t.doc_id, len(words)::BIGINT AS n_words,
         coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::BIGINT AS word_chars,
         (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
         coalesce(rep.n, 0)::BIGINT AS n_repeat_words,
         len(lines) AS n_lines,
         len(list_filter(lines, lambda x: contains(x, '|'))) AS n_table_lines,
         len(list_filter(words, lambda x: list_contains({STOP_WORDS!r}, lower(x)))) AS n_stop
  FROM t LEFT JOIN rep USING (doc_id)
), r AS (
  SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
         coalesce(word_chars / nullif(n_words, 0), 0)::DOUBLE AS mean_word_chars,
         coalesce(n_symbols / nullif(word_chars, 0), 0)::DOUBLE AS symbol_ratio,
         coalesce(n_stop / nullif(n_words, 0), 0)::DOUBLE AS stop_word_ratio,
         coalesce(n_dup_lines / nullif(n_lines, 0), 0)::DOUBLE AS dup_line_ratio,
         coalesce(n_table_lines / nullif(n_lines, 0), 0)::DOUBLE AS table_line_ratio,
         coalesce(n_repeat_words / nullif(n_words, 0), 0)::DOUBLE AS repeat_word_ratio
  FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, mean_word_chars, symbol_ratio,
       stop_word_ratio, dup_line_ratio, table_line_ratio, repeat_word_ratio,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words)
       {''.join(f" AND {n} >= {a}" * (a is not None) + f" AND {n} <= {b}" * (b is not None) for n, a, b in RULES)} AS kept
FROM r
"""
