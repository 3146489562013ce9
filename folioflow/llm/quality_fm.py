"""Operator 9: quality classifier, a factorisation machine.

Inputs: every word occurrence, hashed to a bucket and weighted 1 / sqrt(number of words), and structure
statistics, with the text's length in characters as metadata.  All pairs of inputs interact through low-rank
factors, and a text is scored in time linear in its words by the sum-of-squares identity:
sum over pairs of <v_i, v_j> x_i x_j = (|sum v_i x_i|^2 - sum |v_i|^2 x_i^2) / 2.

The model is fitted on the driver by Adam on a bounded sample of labelled rows (``per_class`` of each label)
and broadcast: (1 << bits) * (factors + 1) floats, whatever the data's size.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from . import features
from .common import doc_columns, fresh, map_text


@dataclass
class Machine:
    bits: int
    bias: float
    w: np.ndarray  # buckets
    v: np.ndarray  # buckets x factors
    ws: np.ndarray  # statistics
    vs: np.ndarray  # statistics x factors
    mean: np.ndarray
    scale: np.ndarray

    def sums(self, ids: np.ndarray, first: np.ndarray, stats: np.ndarray):
        """Parts of the score: linear term, sum of v x, sum of v^2 x^2, the words' weight and the scaled statistics."""
        n = np.diff(first)
        weight = (1 / np.sqrt(np.maximum(n, 1))).astype(np.float32)
        z = (stats - self.mean) / self.scale
        linear = z @ self.ws + self.bias
        s, q = z @ self.vs, (z * z) @ (self.vs * self.vs)
        doc = np.repeat(np.arange(len(n)), n)
        linear = linear + weight * np.bincount(doc, self.w[ids], len(n))
        for f in range(self.v.shape[1]):
            vf = self.v[ids, f]
            s[:, f] += weight * np.bincount(doc, vf, len(n))
            q[:, f] += weight * weight * np.bincount(doc, vf * vf, len(n))
        return linear, s, q, weight, z, doc

    def margin(self, ids, first, stats) -> np.ndarray:
        linear, s, q, *_ = self.sums(ids, first, stats)
        return linear + 0.5 * (s * s - q).sum(1)

    def score(self, ids, first, stats) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(ids, first, stats), -30, 30)))


def fit(y: np.ndarray, ids: np.ndarray, first: np.ndarray, stats: np.ndarray, bits: int, factors: int = 6, epochs: int = 80, rate: float = 0.05, decay: float = 1e-2) -> Machine:
    """Full-batch Adam on the logistic loss, both labels weighing the same."""
    r = np.random.default_rng(11)
    k = len(features.STATS)
    mean, scale = (stats.mean(0), stats.std(0) + 0.05) if len(stats) else (np.zeros(k), np.ones(k))
    m = Machine(bits, 0.0, np.zeros(1 << bits, np.float32), r.normal(0, 0.02, (1 << bits, factors)).astype(np.float32), np.zeros(k), r.normal(0, 0.05, (k, factors)), mean, scale)
    if len(y) == 0 or y.min() == y.max():
        m.bias = 0.0 if len(y) == 0 else 2.0 * (2 * float(y[0]) - 1)
        m.v[:], m.vs[:] = 0, 0
        return m
    sample_weight = np.where(y == 1, 0.5 / max((y == 1).sum(), 1), 0.5 / max((y == 0).sum(), 1))
    used = np.unique(ids)
    local = np.searchsorted(used, ids)
    state = {}

    def step(name, value, grad, t):
        a, b = state.setdefault(name, (np.zeros_like(value, dtype=np.float64), np.zeros_like(value, dtype=np.float64)))
        a[...] = 0.9 * a + 0.1 * grad
        b[...] = 0.999 * b + 0.001 * grad * grad
        return value - (rate * (a / (1 - 0.9**t)) / (np.sqrt(b / (1 - 0.999**t)) + 1e-8))

    small = Machine(bits, 0.0, m.w[used], m.v[used], m.ws, m.vs, mean, scale)
    for t in range(1, epochs + 1):
        linear, s, q, weight, z, doc = small.sums(local, first, stats)
        p = 1 / (1 + np.exp(-np.clip(linear + 0.5 * (s * s - q).sum(1), -30, 30)))
        g = (p - y) * sample_weight
        gw = g * weight
        grad_w = np.bincount(local, gw[doc], len(used)) + decay * small.w
        grad_v = np.empty_like(small.v, dtype=np.float64)
        gw2 = np.bincount(local, (gw * weight)[doc], len(used))
        for f in range(factors):
            grad_v[:, f] = np.bincount(local, (gw * s[:, f])[doc], len(used)) - gw2 * small.v[:, f] + decay * small.v[:, f]
        grad_ws = g @ z + decay * small.ws
        grad_vs = z.T @ (g[:, None] * s) - ((z * z).T @ g)[:, None] * small.vs + decay * small.vs
        small.w, small.v = step("w", small.w, grad_w, t).astype(np.float32), step("v", small.v, grad_v, t).astype(np.float32)
        small.ws, small.vs = step("ws", small.ws, grad_ws, t), step("vs", small.vs, grad_vs, t)
        small.bias = float(step("b", np.array(small.bias), np.array(g.sum()), t))
    m.bias, m.ws, m.vs = small.bias, small.ws, small.vs
    m.v[:] = 0
    m.w[used], m.v[used] = small.w, small.v
    return m


def train(docs: DataFrame, labels: DataFrame, bits: int = 17, per_class: int = 1500, factors: int = 6) -> Machine:
    """``labels``: doc_id and quality (1 good, 0 bad). Without labels of both kinds the score is constant."""
    return fit(*features.word_rows(features.labelled_sample(docs, labels, "quality", per_class), bits), bits, factors)


def add_score(docs: DataFrame, model: Machine, name: str) -> DataFrame:
    """The rows of ``docs`` with the score of their texts as a further column."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch, buf, offs):
        m = shared.value
        ids, first = features.word_ids(buf, offs, m.bits)
        score = m.score(ids, first, features.structure(buf, offs))
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score, pa.float64())], names=[*batch.schema.names, name])

    return map_text(docs, T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())]), run)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, model: Machine | None = None) -> DataFrame:
    """doc_id, held_out, score, predicted of every row.

    Null and empty texts are scored as texts without words; repeated rows each give a row; labels without a
    document, or null, are passed over; an empty table gives no rows; other columns are ignored.
    """
    model = model or train(docs, labels)
    rows = add_score(doc_columns(docs, "doc_id", "text"), model, "score")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    return rows.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, model: Machine, threshold: float = 0.5) -> DataFrame:
    """The rows whose score reaches the threshold, with the columns of ``docs``, whatever their names.

    Null and empty texts are scored as texts without words, repeated rows each by itself; an empty table stays empty.
    """
    (score,) = fresh(docs, "__score")
    return add_score(docs, model, score).where(F.col(score) >= threshold).select(*docs.columns)
