"""Corpus pipeline: quality classifier, exact dedup, near-duplicate removal, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
``documents``.  run() writes every stage's result as Parquet and rereads it as the next one's input.

In every stage: a null text counts as empty; texts of any length are read whole; rows without doc_id are kept
unless their text itself is rejected; repeated rows are one copy group (stage 2 leaves one); an empty table
passes through as an empty table; columns that ``documents`` does not name are kept, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from folioflow.llm import exact_dedup, mixing, ngram_join, packing, quality_fm
from folioflow.llm.common import materialize
from folioflow.llm.registry import tokenizer_path

#: The mix's targets are the domains' tokens when documents that are clean by two thirds are all taken, and none by a third.
KEEP = "clean"


def _tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go; empty texts are scored like any other."""
    return quality_fm.keep_good(docs, quality_fm.train(*_tables(spark, sf_dir)))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays; null and empty texts are equal."""
    return exact_dedup.drop_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates one document stays, that with the smallest doc_id; texts without words all stay."""
    return ngram_join.drop_near_duplicates(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are thinned, by rates between 0 and 1, until the expected tokens of the domains meet ``mixing.policy``; the
    rate of a text without tokens is its posterior's."""
    return mixing.mixed(docs, mix_rates(spark, docs, sf_dir))


def mix_rates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> mixing.Mix:
    model = mixing.train(*_tables(spark, sf_dir), mixing.domain_of_labels())
    narrow = mixing.posteriors(docs, model)
    keep = KEEP if KEEP in model.domains else model.domains[0]
    weights, tokens = mixing.policy(narrow, model, keep)
    return mixing.fit_rates(narrow, model, weights, tokens=tokens, high=1.0)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of power-of-two length."""
    return packing.pack(docs, tokenizer_path("word_bpe_49k.json"), end_id=2)


STAGES = [("quality", quality), ("exact_dedup", exact), ("near_dedup", near), ("mixing", mix), ("packing", pack)]

#: Classifiers and tokenizers have no SQL form; the tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir))
    return docs
