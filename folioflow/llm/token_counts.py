"""Operator 10: token counts without any pre-token shuffle.

Two tiers look a pre-token's length up inside the map task: a broadcast table of the most frequent
pre-tokens, at most ``table_size`` entries of 29 bytes with all their bytes (only those of up to 16 are in
it), then the worker's own cache, whose misses are encoded by the library.  The table comes from one pass
over the whole corpus in which every task sums up its ``per_task`` most frequent pre-tokens in one row;
rows are merged sixteen at a time without a shuffle, and no row outgrows the table.  It changes speed, never a count.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import textkernel as tk, tokens
from .common import doc_columns, map_text, materialize, workers_see_package

#: Distinct pre-tokens a task counts before it forgets the rarer half.
COUNTED = 500_000
#: Rows that one task merges.
FAN_IN = 16
_TALLY = np.dtype([*tokens.FREQUENT.descr, ("n", "<i8")])


def merged(parts: list[np.ndarray]) -> np.ndarray:
    """Tallies with equal pre-tokens added up, sorted by hash."""
    x = np.concatenate(parts)
    x = x[np.lexsort((x["size"], x["tail"], x["lead"], x["h"]))]
    new = np.ones(len(x), bool)
    for k in ("h", "lead", "tail", "size"):
        new[1:] &= x[k][1:] == x[k][:-1]
    new[1:] = ~new[1:]
    at = np.flatnonzero(new)
    out = x[at]
    if len(at):
        out["n"] = np.add.reduceat(x["n"], at)
    return out


def most(x: np.ndarray, size: int) -> np.ndarray:
    return x[np.argsort(-x["n"], kind="stable")[:size]]


def frequent_lengths(docs: DataFrame, model_path: str, table_size: int = 65_536, per_task: int = 4_096) -> np.ndarray:
    """The most frequent pre-tokens of all texts, with their lengths."""

    def packed(x: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary())], names=["tally"])

    def top(batches):
        tokens.forget()
        coder, known = tokens.piece_counter(model_path), np.zeros(0, _TALLY)
        for batch in batches:
            buf_all, offs_all = tk.batch_text(batch.column(0))
            for lo, hi in tk.slices(offs_all):
                buf, offs = buf_all[offs_all[lo] : offs_all[hi]], offs_all[lo : hi + 1] - offs_all[lo]
                if len(buf) == 0:
                    continue
                _, _, p = coder._cut(buf, offs)
                _, at, n = np.unique(p.h, return_index=True, return_counts=True)
                often = (n > 1) & (p.size[at] < 34)
                p, n = p.take(at[often]), n[often]
                slot, right = coder._slots(p)
                x = np.zeros(len(n), _TALLY)
                for k in ("h", "lead", "tail", "size"):
                    x[k] = getattr(p, k)
                x["len"], x["n"] = coder.lens[slot], n
                known = merged([known, x[right]])
                if len(known) > COUNTED:
                    known = most(known, COUNTED // 2)
        yield packed(most(known, per_task))

    def merge(batches):
        held = [np.zeros(0, _TALLY)]
        for batch in batches:
            held += [np.frombuffer(x, _TALLY) for x in batch.column(0).to_pylist()]
            if len(held) > FAN_IN:
                held = [most(merged(held), table_size)]
        if len(held) > 1:
            yield packed(most(merged(held), table_size))

    workers_see_package(docs.sparkSession)
    rows = materialize(docs.select(F.coalesce("text", F.lit("")).alias("text")).mapInArrow(top, "tally binary"))
    while (left := rows.count()) > 1:
        # Neighbouring partitions are read together; nothing is shuffled.
        rows = materialize(rows.coalesce(-(-left // FAN_IN)).mapInArrow(merge, "tally binary"))
    best = merged([np.zeros(0, _TALLY), *(np.frombuffer(r.tally, _TALLY) for r in rows.collect())])
    # A hash stands for one pre-token of the table, the more frequent.
    best = most(best, table_size)
    _, at = np.unique(best["h"], return_index=True)
    return best[list(tokens.FREQUENT.names)][at].astype(tokens.FREQUENT)


def count_tokens(docs: DataFrame, model_path: str, limit: int = 4096, table_size: int = 65_536) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row.

    A null text counts as empty (0 bytes, 0 tokens); repeated rows each give a row; an empty table gives
    none; other columns are ignored.  ``limit``: over_limit is n_tokens > limit.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(frequent_lengths(docs, model_path, table_size))
    made = {}

    def count(batch, buf, offs):
        if "coder" not in made:
            made["coder"] = tokens.piece_counter(model_path, shared.value)
        n = made["coder"].counts(buf, offs)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(offs)), pa.array(n)], names=["doc_id", "n_bytes", "n_tokens"])

    return map_text(doc_columns(docs, "doc_id", "text"), "doc_id long, n_bytes long, n_tokens long", count).withColumn("over_limit", F.col("n_tokens") > limit)
