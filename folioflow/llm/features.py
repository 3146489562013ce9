"""Features of the classifiers, computed a batch at a time: hashed words, structure statistics, character n-grams."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from . import textkernel as tk
from .common import map_text

U64 = np.uint64
STATS = ["log_words", "mean_word", "symbols", "digits", "capitals", "lines", "bars", "stops", "marks", "log_chars", "echoes", "distinct", "short"]
_FLAGS = np.zeros((256, 8), bool)
for _i, _chars in enumerate(("#*$%&|<>", "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "\n", "|", ".!?", ",;:()\"'")):
    _FLAGS[[ord(c) for c in _chars], _i] = True
_FLAGS[:, 7] = (np.arange(256) & 0xC0) != 0x80  # starts of characters


def word_ids(buf: np.ndarray, offs: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every word occurrence (ASCII lower-cased, hashed to ``bits`` bits), and each document's first."""
    low = tk.LOWER[buf]
    starts, ends, first = tk.words(low, offs)
    if len(starts) == 0:
        return np.zeros(0, np.int32), first
    return (tk.span_hashes(low, starts, ends) >> U64(64 - bits)).astype(np.int32), first


def structure(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """One row of STATS for each document, each roughly between 0 and 2; an empty text has zeros."""
    if len(buf) == 0:
        return np.zeros((len(offs) - 1, len(STATS)), np.float32)
    starts, ends, first = tk.words(buf, offs)
    n_words = np.diff(first)
    doc = np.repeat(np.arange(len(n_words)), n_words)
    h = tk.span_hashes(buf, starts, ends)
    echo = np.bincount(doc[1:][(h[1:] == h[:-1]) & (doc[1:] == doc[:-1])], minlength=len(n_words)) if len(h) else 0 * n_words
    # Document and 44 bits of the word's hash in one key, which sorts fast.
    key = np.sort((doc.astype(U64) << U64(44)) | (h >> U64(20)))
    new = np.concatenate((np.ones(min(len(key), 1), bool), key[1:] != key[:-1]))
    distinct = np.bincount((key[new] >> U64(44)).astype(np.int64), minlength=len(n_words)) if len(h) else 0 * n_words
    lonely = np.bincount(doc[(ends - starts) <= 2], minlength=len(n_words)) if len(h) else 0 * n_words
    total = []
    for k in range(8):
        c = np.concatenate(([0], np.cumsum(_FLAGS[buf, k], dtype=np.int64)))
        total.append(c[offs[1:]] - c[offs[:-1]])
    solid = np.concatenate(([0], np.cumsum(~tk.IS_SPACE[buf], dtype=np.int64)))
    solid = solid[offs[1:]] - solid[offs[:-1]]
    words, chars = np.maximum(n_words, 1), np.maximum(total[7], 1)
    cols = [np.log1p(n_words) / 5, solid / words / 8, total[0] / words, total[1] / chars * 4, total[2] / words, total[3] / words * 4, total[4] / words, total[5] / words * 4, total[6] / words * 4, np.log1p(total[7]) / 8, echo / words * 2, distinct / words, lonely / words]
    return np.minimum(np.stack(cols, 1), 4).astype(np.float32)


def char_ngrams(buf: np.ndarray, offs: np.ndarray, sizes: tuple[int, ...], bits: int):
    """For each size: the bucket of every character n-gram, and its document. Latin letters are lower-cased; n-grams end at their document's."""
    if len(buf) == 0:
        return
    codes = np.frombuffer(buf.tobytes().decode("utf-8", "replace").encode("utf-32-le", "replace"), np.uint32).copy()
    codes[((codes >= 65) & (codes <= 90)) | ((codes >= 0xC0) & (codes <= 0xDE) & (codes != 0xD7))] += 32
    begin = np.concatenate(([0], np.cumsum((buf & 0xC0) != 0x80)))[offs]
    n = len(codes)
    power, inverse = tk.powers(n + 1)
    c = np.zeros(n + 1, U64)
    np.cumsum((codes.astype(U64) + U64(1)) * power[:n], out=c[1:])
    doc = np.repeat(np.arange(len(offs) - 1, dtype=np.int32), np.diff(begin))
    for size in sizes:
        m = n - size + 1
        if m <= 0:
            continue
        h = (c[size:] - c[:m]) * inverse[:m]
        h *= U64(0xBF58476D1CE4E5B9 + 2 * size)
        at = (h >> U64(64 - bits)).astype(np.int32)
        whole = doc[:m] == doc[size - 1 :]
        yield at, doc[:m], whole


def labelled_sample(docs: DataFrame, labels: DataFrame, column: str, per_class: int, held_out: int = 1) -> DataFrame:
    """At most ``per_class`` rows of each value of a label: doc_id, label, text.

    Rows whose crc32(doc_id as text) mod 3 is ``held_out`` are left out; the others are taken in the order of
    a hash of doc_id.  Of several labels of one doc_id the smallest counts, and of several rows of one doc_id the
    text of the least hash, so the bound holds however often a labelled doc_id is repeated.  The sample is bounded, so
    its ids are broadcast and the other texts stay where they are.
    """
    rows = labels.select("doc_id", labels[column].alias("label")).where(F.col("doc_id").isNotNull() & F.col("label").isNotNull())
    rows = rows.where(F.crc32(F.col("doc_id").cast("string")) % 3 != held_out).groupBy("doc_id").agg(F.min("label").alias("label"))
    kinds = sorted(r[0] for r in rows.select("label").distinct().limit(101).collect())
    if not kinds:
        return rows.withColumn("text", F.lit(""))
    picked = None
    if len(kinds) <= 100:
        for k in kinds:
            some = rows.where(F.col("label") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
            picked = some if picked is None else picked.unionByName(some)
    else:
        # Too many for a plan of one branch each: the first of each label's 64 parts, then the first of those.
        picked = rows.withColumns({"__h": F.xxhash64("doc_id"), "__part": F.pmod(F.xxhash64("doc_id"), F.lit(64))})
        for by in (("label", "__part"), ("label",)):
            picked = picked.withColumn("__at", F.row_number().over(Window.partitionBy(*by).orderBy("__h", "doc_id"))).where(F.col("__at") <= per_class)
        picked = picked.select("doc_id", "label")
    texts = docs.select("doc_id", F.coalesce(docs["text"], F.lit("")).alias("text"))
    found = texts.join(F.broadcast(picked), "doc_id")
    return found.groupBy("doc_id", "label").agg(F.min_by("text", F.struct(F.xxhash64("text"), F.col("text"))).alias("text"))


def word_rows(sample: DataFrame, bits: int):
    """The sample's features on the driver: labels, word buckets with each document's first, structure; in the order of doc_id."""

    def run(batch, buf, offs):
        ids, first = word_ids(buf, offs, bits)
        stats = structure(buf, offs)
        parts = [ids[a:b] for a, b in zip(first[:-1], first[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1).cast(pa.int64()), pa.array(parts, pa.list_(pa.int32())), pa.array(list(stats), pa.list_(pa.float32()))], names=["doc_id", "label", "ids", "stats"])

    got = map_text(sample, "doc_id long, label long, ids array<int>, stats array<float>", run).toArrow().combine_chunks().sort_by("doc_id")
    y = got.column("label").to_numpy()
    ids = [np.asarray(x.values.to_numpy(zero_copy_only=False), np.int32) for x in got.column("ids")]
    stats = np.array([x.values.to_numpy() for x in got.column("stats")], np.float32).reshape(len(y), len(STATS))
    first = np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype(np.int64)
    return y, np.concatenate(ids) if ids else np.zeros(0, np.int32), first, stats
