"""Deduplication, versions, filters, paging and joins with fallback keys."""

from __future__ import annotations

from dataclasses import dataclass, field
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame, Window, functions as F

from folioflow.session import cut


def first_by_hash(df: DataFrame, content: str, order: str) -> DataFrame:
    """One row for each content hash, the first in order. Aggregated before the shuffle: hot contents cost one row a task."""
    rest = [c for c in df.columns if c != content]
    return df.withColumn("content_hash", F.sha2(F.col(content), 256)).groupBy("content_hash").agg(F.min_by(F.struct(*rest), order).alias("__r"), F.count("*").alias("copies")).select("content_hash", "__r.*", "copies")


def not_yet(df: DataFrame, known: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys are not among the known ones."""
    return df.join(known.select(*keys), keys, "left_anti")


def latest(df: DataFrame, keys: list[str], version: list[str]) -> DataFrame:
    """The newest version of each record; with several columns, later ones break ties."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*version)).alias("__r")).select(*keys, "__r.*")


def join_two_keys(left: DataFrame, right: DataFrame, first: tuple[str, str], second: tuple[str, str], columns: list[str]) -> DataFrame:
    """Left join on one key and, where that finds nothing, on another: two equi-joins, not one with OR."""
    a = right.select(F.col(first[1]).alias(first[0]), *[F.col(c).alias(f"__a_{c}") for c in columns], F.lit(True).alias("__hit")).dropDuplicates([first[0]])
    b = right.select(F.col(second[1]).alias(second[0]), *[F.col(c).alias(f"__b_{c}") for c in columns]).dropDuplicates([second[0]])
    out = left.join(a, first[0], "left").join(b, second[0], "left")
    return out.select(*left.columns, *[F.when(F.col("__hit"), F.col(f"__a_{c}")).otherwise(F.col(f"__b_{c}")).alias(c) for c in columns])


@dataclass
class Filter:
    """What a list query may ask for; sort columns outside ``sortable`` fall back to the first of them."""

    status: str | None = None
    search: str | None = None
    search_columns: list[str] = field(default_factory=list)
    date_column: str | None = None
    date_from: str | None = None
    date_to: str | None = None
    include_deleted: bool = False
    sort_by: str | None = None
    descending: bool = True
    sortable: list[str] = field(default_factory=list)

    def predicate(self) -> Column:
        p = F.lit(True)
        if not self.include_deleted:
            p &= ~F.col("deleted")
        if self.status:
            p &= F.col("status") == self.status.upper()
        if self.search and self.search_columns:
            # Only A-Z lose their case, % and _ in the text are wildcards, and there is no escape character.
            hit, low = F.lit(False), lambda c: F.translate(c, ascii_uppercase, ascii_lowercase)
            pattern = low(F.lit("%" + self.search.replace("\\", "\\\\") + "%"))
            for c in self.search_columns:
                hit |= F.coalesce(F.like(low(F.col(c)), pattern), F.lit(False))
            p &= hit
        if self.date_from:
            p &= F.col(self.date_column) >= F.lit(self.date_from).cast("date")
        if self.date_to:
            p &= F.col(self.date_column) <= F.lit(self.date_to).cast("date")
        return p

    def ordering(self, key: str) -> list[Column]:
        c = F.col(self.sort_by if self.sort_by in self.sortable else self.sortable[0])
        return [c.desc_nulls_last(), F.col(key).desc()] if self.descending else [c.asc_nulls_last(), F.col(key).asc()]


def page(df: DataFrame, query: Filter, key: str, number: int = 1, size: int = 20) -> DataFrame:
    """One page of the filtered rows; nulls last in both directions, ``key`` breaks ties; size 0 means all."""
    rows = df.where(query.predicate()).orderBy(*query.ordering(key))
    return rows.offset((number - 1) * size).limit(size) if size else rows


def summary(df: DataFrame, states: list[str], status: str, amount: str, confidence: str) -> DataFrame:
    """Totals of the rows that are not deleted, zeros where there are none."""
    counts = [F.count_if(F.col(status) == s).alias(f"n_{s.lower()}") for s in states]
    return df.where(~F.col("deleted")).agg(F.count("*").alias("total"), *counts, F.coalesce(F.sum(amount), F.lit(0)).alias("amount"), F.coalesce(F.avg(confidence), F.lit(0.0)).alias("confidence"))


def patched(records: DataFrame, changes: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Records with the non-null values of their changes; ``edited`` tells which had any."""
    new = changes.select(key, *[F.col(c).alias(f"__{c}") for c in columns], F.lit(True).alias("__edited"))
    out = records.join(new, key, "left")
    return out.select(key, *[F.coalesce(f"__{c}", c).alias(c) if c in columns else F.col(c) for c in records.columns if c != key], F.coalesce("__edited", F.lit(False)).alias("edited"))


def rank_window(keys: list[str], *order) -> Column:
    return F.row_number().over(Window.partitionBy(*keys).orderBy(*order))


def numbered(df: DataFrame, name: str, *order) -> DataFrame:
    """The rows with dense numbers from 1 in the given order, which must tell rows apart: they are divided by ranges, sorted
    within those, and each range adds the sizes of the ranges before it. No task holds more than a range."""
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = cut(df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id()))
    part = F.shiftright("__at", 33)
    # One row for each range.
    sizes = {r["part"]: r["n"] for r in rows.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect()}
    before, total = [], 0
    for p in sorted(sizes):
        before.append((p, total))
        total += sizes[p]
    starts = spark.createDataFrame(before, "__part long, __before long")
    place = F.col("__at").bitwiseAND(F.lit((1 << 33) - 1)) + F.col("__before") + 1
    return rows.withColumn("__part", part).join(F.broadcast(starts), "__part").withColumn(name, place).drop("__at", "__part", "__before")
