"""Operator 8: toxicity by a naive-Bayes-scaled linear classifier over character n-grams.

A text's features are its distinct character n-grams, hashed.  Each is scaled by the log-ratio of its
(smoothed) shares in toxic and in other labelled texts, and a logistic regression is fitted on the scaled
features.  Weights and ratios multiply into one table of ``1 << bits`` floats, which is broadcast; n-grams
whose ratio is weak, or which few sampled texts hold, weigh nothing.

Ratios and weights come from a bounded sample of labelled rows (``per_class`` of each label).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from . import features
from .common import doc_columns, map_text

SIZES = (5, 6, 7)


@dataclass
class Model:
    bits: int
    sizes: tuple[int, ...]
    bias: float
    table: np.ndarray

    def score(self, buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """Sum of the weights of each document's distinct n-grams, as a probability."""
        n = len(offs) - 1
        margin = np.full(n, self.bias)
        for size, (at, doc, whole) in zip(self.sizes, features.char_ngrams(buf, offs, self.sizes, self.bits), strict=False):
            weight = self.table[at]
            some = np.flatnonzero(whole & (weight != 0))
            key = np.unique((doc[some].astype(np.int64) << self.bits) | at[some])
            margin += np.bincount(key >> self.bits, self.table[key & ((1 << self.bits) - 1)], n)
        return 1 / (1 + np.exp(-np.clip(margin, -30, 30)))


def _sampled(sample: DataFrame, sizes, bits):
    """Labels and distinct n-gram buckets of the sampled texts, in the order of doc_id."""

    def run(batch, buf, offs):
        found = [np.zeros(0, np.int64)]
        for at, doc, whole in features.char_ngrams(buf, offs, sizes, bits):
            found.append(np.unique((doc[whole].astype(np.int64) << bits) | at[whole]))
        key = np.unique(np.concatenate(found))
        edge = np.searchsorted(key >> bits, np.arange(len(offs)))
        ids = (key & ((1 << bits) - 1)).astype(np.int32)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1).cast(pa.int64()), pa.array([ids[a:b].tobytes() for a, b in zip(edge[:-1], edge[1:], strict=True)], pa.binary())], names=["doc_id", "label", "ids"])

    got = map_text(sample, "doc_id long, label long, ids binary", run).toArrow().sort_by("doc_id")
    return got.column("label").to_numpy(), [np.frombuffer(x, np.int32) for x in got.column("ids").to_pylist()]


def fit(y: np.ndarray, sets: list[np.ndarray], bits: int, sizes=SIZES, least_docs: int = 8, least_ratio: float = 1.5, epochs: int = 150, decay: float = 2e-3) -> Model:
    table = np.zeros(1 << bits, np.float32)
    if len(y) == 0 or y.min() == y.max():
        return Model(bits, sizes, -3.0 if len(y) == 0 else 3.0 * (2 * float(y[0]) - 1), table)
    n = np.array([len(s) for s in sets])
    doc, ids = np.repeat(np.arange(len(y)), n), np.concatenate(sets)
    pos = np.bincount(ids[(y == 1)[doc]], minlength=1 << bits)
    neg = np.bincount(ids[(y == 0)[doc]], minlength=1 << bits)
    # Shares of texts that hold the n-gram.
    ratio = np.log((pos + 1) / ((y == 1).sum() + 2)) - np.log((neg + 1) / ((y == 0).sum() + 2))
    ratio[(pos + neg < least_docs) | (np.abs(ratio) < least_ratio)] = 0
    keep = ratio[ids] != 0
    doc, ids = doc[keep], ids[keep]
    used, local = np.unique(ids, return_inverse=True)
    x = ratio[used][local]
    weight = np.where(y == 1, 0.5 / (y == 1).sum(), 0.5 / (y == 0).sum())
    w, bias = np.full(len(used), 0.05), 0.0
    mean = [np.zeros(len(used)), 0.0]
    var = [np.zeros(len(used)), 0.0]
    for t in range(1, epochs + 1):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(doc, x * w[local], len(y)) + bias, -30, 30)))
        g = (p - y) * weight
        for i, grad in enumerate((np.bincount(local, x * g[doc], len(used)) + decay * w, g.sum())):
            mean[i] = 0.9 * mean[i] + 0.1 * grad
            var[i] = 0.999 * var[i] + 0.001 * grad * grad
            move = 0.02 * (mean[i] / (1 - 0.9**t)) / (np.sqrt(var[i] / (1 - 0.999**t)) + 1e-8)
            if i == 0:
                w = w - move
            else:
                bias = bias - move
    table[used] = w * ratio[used]
    return Model(bits, sizes, float(bias), table)


def train(docs: DataFrame, labels: DataFrame, bits: int = 20, per_class: int = 1000) -> Model:
    """``labels``: doc_id and toxic (1 toxic, 0 not). Without labels of both kinds the score is constant."""
    y, sets = _sampled(features.labelled_sample(docs, labels, "toxic", per_class), SIZES, bits)
    return fit(y, sets, bits)


def add_score(docs: DataFrame, model: Model, name: str) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch, buf, offs):
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shared.value.score(buf, offs), pa.float64())], names=[*batch.schema.names, name])

    return map_text(docs, T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())]), run)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, model: Model | None = None) -> DataFrame:
    """doc_id, held_out, score, predicted of every row.

    Null and empty texts get the score of a text without n-grams; repeated rows each give a row; labels
    without a document, or null, are passed over; an empty table gives no rows; other columns are ignored.
    """
    model = model or train(docs, labels)
    rows = add_score(doc_columns(docs, "doc_id", "text"), model, "score")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    return rows.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
