"""Operator 4: exact dedup by progressive refinement.

One pass groups rows by text length and, within a length, by a hash of the text's first characters (both at once: the
prefix of a text of unique length is hashed as well, which costs less than a pass of its own); counts are aggregated
before the shuffle, so a length, a prefix or a text that a third of all rows share costs one row for
each task.  Groups of one row are done.  The others set bits in a filter of fixed size, and only rows whose
bits are set have their whole content hashed (SHA-256), at every size of the data: a full filter lets more rows
through, it never drops one.  Groups of equal hashes are aggregated in the same way, and decisions go back to
the rows by a join on the hash: broadcast where the groups are counted and weighed to be few, else a shuffle
join, whose large keys adaptive execution splits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import doc_columns, fresh, materialize, small

#: Bits of the filter of surviving groups (8 MB in all), and of one of its rows.
FILTER_BITS, ROW_BITS = 1 << 26, 1 << 15


def _text(df: DataFrame, normalize: Column | None) -> Column:
    return F.coalesce(df["text"] if normalize is None else normalize, F.lit(""))


def survivors(docs: DataFrame, normalize: Column | None = None, head_chars: int = 256, filter_bits: int = FILTER_BITS) -> DataFrame:
    """The filter of (length, prefix hash) that two rows or more share: at most filter_bits / ROW_BITS rows of bits."""
    text = _text(docs, normalize)
    keys = docs.select(F.octet_length(text).alias("len"), F.xxhash64(F.substring(text, 1, head_chars)).alias("head"))
    shared = keys.groupBy("len", "head").count().where("count > 1").select(F.pmod(F.xxhash64("len", "head"), F.lit(filter_bits)).alias("at"))
    return materialize(shared.groupBy(F.floor(F.col("at") / ROW_BITS).alias("row")).agg(F.bitmap_construct_agg(F.col("at") % ROW_BITS).alias("bits")))


def hashed(docs: DataFrame, bits: DataFrame, name: str, normalize: Column | None = None, head_chars: int = 256, filter_bits: int = FILTER_BITS) -> DataFrame:
    """The rows with the SHA-256 of the texts that the filter lets through as column ``name``; null for the others."""
    row, held, at = fresh(docs, "__row", "__bits", "__at")
    text = _text(docs, normalize)
    rows = docs.withColumn(at, F.pmod(F.xxhash64(F.octet_length(text), F.xxhash64(F.substring(text, 1, head_chars))), F.lit(filter_bits)))
    rows = rows.withColumn(row, F.floor(F.col(at) / ROW_BITS)).join(F.broadcast(bits.select(F.col("row").alias(row), F.col("bits").alias(held))), row, "left")
    bit = (F.col(at) % ROW_BITS).cast("int")
    byte = F.conv(F.hex(F.substring(F.col(held), F.floor(bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    found = F.call_function("shiftright", byte, bit % 8).bitwiseAND(F.lit(1)) == 1
    return rows.withColumn(name, F.when(found, F.unhex(F.sha2(_text(docs, normalize), 256)))).drop(row, held, at)


def copy_groups(rows: DataFrame, sha: str) -> DataFrame:
    """Groups of two or more equal hashes: sha, keep (largest doc_id), size, at_keep (rows with that doc_id)."""
    same_id = rows.where(F.col(sha).isNotNull()).select(F.col(sha).alias("sha"), F.col("doc_id").alias("id")).groupBy("sha", "id").count()
    groups = same_id.groupBy("sha").agg(F.max("id").alias("keep"), F.sum("count").alias("size"), F.max_by("count", F.coalesce("id", F.lit(-(1 << 63)))).alias("at_keep"))
    return materialize(groups.where("size > 1"))


def decide(docs: DataFrame, normalize: Column | None = None, broadcast_rows: int = 1_000_000, filter_bits: int = FILTER_BITS, report_sha: bool = False, head_chars: int = 256) -> tuple[DataFrame, list[str]]:
    """The columns of ``docs`` with four more, and their names: doc_id of the row that stays, size of the group, whether
    the row stays, SHA-256 (binary; null for texts known to be alone, unless ``report_sha``).  The names begin
    with two underscores, and with more where ``docs`` has such columns."""
    names = keep, size, kept, sha = fresh(docs, "__keep", "__size", "__kept", "__sha")
    key, at_keep, number = fresh(docs, "__key", "__at_keep", "__number")
    text = _text(docs, normalize)
    bits = survivors(docs, normalize, head_chars, filter_bits)
    rows = hashed(docs, bits, sha, normalize, head_chars, filter_bits)
    groups = copy_groups(rows, sha)
    # Texts that are alone get keys that match nothing and lie in no one partition.
    rows = rows.withColumn(key, F.coalesce(sha, F.unhex(F.hex(F.xxhash64(F.octet_length(text), F.substring(text, 1, head_chars))))))
    if report_sha:
        rows = rows.withColumn(sha, F.coalesce(sha, F.unhex(F.sha2(_text(docs, normalize), 256))))
        rows = rows.drop("text") if normalize is None else rows
    found = small(groups.select(F.col("sha").alias(key), F.col("keep").alias(keep), F.col("size").alias(size), F.col("at_keep").alias(at_keep)), broadcast_rows)
    out = rows.join(found, key, "left").drop(key)
    out = out.withColumn(keep, F.when(F.col(size).isNull(), F.col("doc_id")).otherwise(F.col(keep))).withColumn(size, F.coalesce(size, F.lit(1)).cast("long"))
    out = out.withColumn(kept, F.col("doc_id").eqNullSafe(F.col(keep)))
    if groups.where("at_keep > 1").isEmpty():
        return out.drop(at_keep), list(names)
    # Equal texts that also share the id to keep: one of those rows stays, found by the least number of each group.
    tied = F.col(kept) & (F.coalesce(at_keep, F.lit(1)) > 1)
    ties = materialize(out.where(tied).withColumn(number, F.monotonically_increasing_id()))
    first = ties.groupBy(sha).agg(F.min(number).alias(number)).select(number, F.lit(True).alias(at_keep))
    ties = ties.drop(at_keep).join(first, number, "left").withColumn(kept, F.coalesce(at_keep, F.lit(False)))
    return out.where(~tied).drop(at_keep).unionByName(ties.drop(number, at_keep)), list(names)


def exact_dedup(docs: DataFrame, normalize: Column | None = None) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row.

    Of equal texts the row with the largest doc_id stays (null ranks lowest; of rows equal in text and id,
    any one).  A null text counts as empty, so all such rows form one group.  Texts of any length are compared
    whole.  An empty table gives no rows; other columns are ignored.
    """
    rows, (keep, size, kept, sha) = decide(doc_columns(docs, "doc_id", "text"), normalize, report_sha=True)
    return rows.select("doc_id", F.col(keep).alias("keep_id"), F.col(size).alias("group_size"), F.col(kept).alias("kept"), F.lower(F.hex(sha)).alias("text_sha256"))


def drop_copies(docs: DataFrame) -> DataFrame:
    """The rows that stay, with the columns of ``docs``; which ones as in ``exact_dedup``.  Other columns may have any name."""
    rows, (_, _, kept, _) = decide(docs)
    return rows.where(F.col(kept)).select(*docs.columns)


ORACLE = """
WITH t AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, text_sha256
FROM t WINDOW w AS (PARTITION BY text_sha256)
"""
