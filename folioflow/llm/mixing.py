"""Operator 1: mixing to target weights by soft membership.

A softmax classifier, fitted on a bounded sample of a labelled table, gives every document a posterior over
the domains.  Document rates r >= 0 are then fitted so that the expected tokens of each domain,
sum over documents of r n p_k, come as near as possible (least squares) to the target weight times the token
budget, by rates that differ from 1 as little as they can (in squares, weighed by tokens, so that the length of
a document does not change its rate).  Such rates are r = clip(1 - p . m) with one multiplier m_k for each domain:
these K numbers are the whole state, found by projected Newton steps.  A pass over the narrow table of posteriors
sums the K totals at ten step lengths and the K x K Gram matrix of the rates that touch no bound.  A small
damping, lowered tenfold at each of its optima, keeps the steps finite where targets cannot be met; there the
fit ends when a lower damping no longer brings the totals nearer, and what is missed is reported as a warning.
No rates are stored or moved between passes.
"""

from __future__ import annotations

import warnings
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from . import features
from .common import doc_columns, fresh, map_text, materialize, workers_see_package


@dataclass
class Softmax:
    """Linear domain classifier over hashed words and structure statistics."""

    domains: list[str]
    bits: int
    w: np.ndarray  # buckets x domains
    ws: np.ndarray
    bias: np.ndarray
    mean: np.ndarray
    scale: np.ndarray

    def posterior(self, ids: np.ndarray, first: np.ndarray, stats: np.ndarray) -> np.ndarray:
        n = np.diff(first)
        doc, weight = np.repeat(np.arange(len(n)), n), 1 / np.sqrt(np.maximum(n, 1))
        m = ((stats - self.mean) / self.scale) @ self.ws + self.bias
        for k in range(len(self.domains)):
            m[:, k] += weight * np.bincount(doc, self.w[ids, k], len(n))
        e = np.exp(m - m.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)


def fit_softmax(domains: list[str], y: np.ndarray, ids: np.ndarray, first: np.ndarray, stats: np.ndarray, bits: int, prior: np.ndarray, epochs: int = 100, rate: float = 0.05, decay: float = 1e-3) -> Softmax:
    """Full-batch Adam; every domain's rows weigh its share ``prior`` of all labelled rows."""
    k, s = len(domains), len(features.STATS)
    mean, scale = (stats.mean(0), stats.std(0) + 0.05) if len(stats) else (np.zeros(s), np.ones(s))
    out = Softmax(domains, bits, np.zeros((1 << bits, k), np.float32), np.zeros((s, k)), np.log(np.maximum(prior, 1e-6)), mean, scale)
    if len(y) == 0:
        return out
    used, local = np.unique(ids, return_inverse=True)
    n = np.diff(first)
    doc, weight = np.repeat(np.arange(len(n)), n), 1 / np.sqrt(np.maximum(n, 1))
    z, hot = (stats - mean) / scale, np.eye(k)[y]
    row = prior[y] / np.maximum(np.bincount(y, minlength=k), 1)[y]
    row = row / row.sum()
    params = [np.zeros((len(used), k)), out.ws, out.bias.copy()]
    moment = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    for t in range(1, epochs + 1):
        w, ws, bias = params
        m = z @ ws + bias
        for i in range(k):
            m[:, i] += weight * np.bincount(doc, w[local, i], len(n))
        e = np.exp(m - m.max(1, keepdims=True))
        g = (e / e.sum(1, keepdims=True) - hot) * row[:, None]
        gw = np.stack([np.bincount(local, (g[:, i] * weight)[doc], len(used)) for i in range(k)], 1) + decay * w
        for j, grad in enumerate((gw, z.T @ g + decay * ws, g.sum(0))):
            a, b = moment[j]
            a[...] = 0.9 * a + 0.1 * grad
            b[...] = 0.999 * b + 0.001 * grad * grad
            params[j] = params[j] - rate * (a / (1 - 0.9**t)) / (np.sqrt(b / (1 - 0.999**t)) + 1e-8)
    out.w[used], out.ws, out.bias = params[0], params[1], params[2]
    return out


def train(docs: DataFrame, labelled: DataFrame, domain: Column, bits: int = 16, per_class: int = 1200) -> Softmax:
    """``labelled``: a table with doc_id; ``domain``: expression over it that names a row's domain (null rows are passed over).

    More than 1,000 domains raise ValueError, since the model holds a row of weights for each of its buckets.
    """
    rows = labelled.select("doc_id", domain.alias("domain")).where("domain IS NOT NULL")
    counts = sorted((r.domain, r["count"]) for r in rows.groupBy("domain").count().limit(1001).collect())
    if len(counts) > 1000:
        raise ValueError("more than 1,000 domains")
    names = [d for d, _ in counts] or ["all"]
    prior = np.array([c for _, c in counts] or [1], float)
    number = F.array_position(F.array(*map(F.lit, names)), F.col("domain")) - 1
    sample = features.labelled_sample(docs, rows.withColumn("k", number), "k", per_class)
    return fit_softmax(names, *features.word_rows(sample, bits), bits, prior / prior.sum())


@dataclass
class Mix:
    model: Softmax
    multipliers: np.ndarray
    low: float
    high: float
    targets: np.ndarray
    totals: np.ndarray
    met: bool

    def rates(self, p: np.ndarray) -> np.ndarray:
        return np.clip(1 - p @ self.multipliers, self.low, self.high)


def add_posteriors(docs: DataFrame, model: Softmax, tokens: str, name: str) -> DataFrame:
    """The rows with their number of words and domain posteriors as two more columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch, buf, offs):
        m = shared.value
        ids, first = features.word_ids(buf, offs, m.bits)
        p = m.posterior(ids, first, features.structure(buf, offs))
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.diff(first), pa.int64()), pa.array(list(p), pa.list_(pa.float64()))], names=[*batch.schema.names, tokens, name])

    schema = T.StructType([*docs.schema.fields, T.StructField(tokens, T.LongType()), T.StructField(name, T.ArrayType(T.DoubleType()))])
    return map_text(docs, schema, run)


def posteriors(docs: DataFrame, model: Softmax) -> DataFrame:
    """doc_id, words and posteriors of every row, written to the shared folder."""
    return materialize(add_posteriors(doc_columns(docs, "doc_id", "text"), model, "n", "p").select("doc_id", "n", "p"))


#: Step lengths tried in one pass.
LENGTHS = 4.0 ** -np.arange(10)


def fit_rates(narrow: DataFrame, model: Softmax, weights: dict[str, float], tokens: float | None = None, low: float = 0.0, high: float = float("inf"), max_steps: int = 200, tolerance: float = 1e-4) -> Mix:
    """Rates of a table of ``posteriors`` whose expected domain totals meet ``weights`` (normalised) times ``tokens``.

    Without ``tokens`` the budget is all tokens; with an upper bound on rates, the largest that no domain exceeds.
    A domain without a weight has target 0.  Ends when every residual is below ``tolerance`` of the budget, or
    when the totals are as near to the targets as the bounds allow; then ``met`` is false and a warning gives the
    totals.  ``max_steps`` is only a guard: where it ends the fit earlier, an error is raised.
    """
    if not 0 <= low <= high or high == 0:
        raise ValueError(f"rates cannot lie between {low} and {high}")
    workers_see_package(narrow.sparkSession)
    k = len(model.domains)
    narrow = narrow.select("n", "p")

    def sums(points):
        """Totals at each of the points, and at the first the Gram matrix of the rates between the bounds."""
        points = np.array(points)
        size = len(points) * k

        def run(batches):
            total, gram = np.zeros((len(points), k)), np.zeros((k, k))
            for batch in batches:
                if batch.num_rows:
                    n = batch.column(0).to_numpy().astype(float)
                    p = batch.column(1).flatten().to_numpy().reshape(-1, k)
                    free = 1 - p @ points.T
                    total += (n[:, None] * np.clip(free, low, high)).T @ p
                    gram += p.T @ ((n * ((free[:, 0] > low) & (free[:, 0] < high)))[:, None] * p)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(size + k * k, dtype=np.int32)), pa.array(np.concatenate((total.ravel(), gram.ravel())))], names=["at", "x"])

        out = np.zeros(size + k * k)
        for r in narrow.mapInArrow(run, "at int, x double").groupBy("at").agg(F.sum("x").alias("x")).collect():
            out[r["at"]] = r["x"]
        return out[:size].reshape(-1, k), out[size:].reshape(k, k)

    m = centre = np.zeros(k)
    (total,), gram = sums([m])
    full = total / min(max(1.0, low), high)  # all rates are that at first
    want = np.array([max(weights.get(d, 0.0), 0.0) for d in model.domains])
    share = want / want.sum() if want.sum() > 0 else want
    if tokens is None:
        tokens = full.sum() if np.isinf(high) or not share.any() else np.min((full * high)[share > 0] / share[share > 0])
    budget = float(tokens)
    targets = budget * share
    least = max(budget, 1.0) * tolerance
    widest = max(float(full.sum()), 1.0)
    damping, last, steps = widest / 100, np.inf, 0
    while not (met := bool(np.abs(total - targets).max() < least)):
        e = total - targets
        off = float(np.linalg.norm(e))
        slope = damping * (m - centre) - e
        if np.linalg.norm(slope) <= 0.01 * max(off, least):
            if damping <= 1e-5 * widest and last - off <= 0.1 * least:
                break
            centre, last, damping = m, off, damping / 10
            slope = -e
        if steps == max_steps:
            raise RuntimeError(f"after {steps} steps the totals {total} are neither at the targets {targets} nor as near as they can be")
        steps += 1
        move = -np.linalg.solve(gram + damping * np.eye(k), slope)
        along = lambda at, x: float((damping * (at - centre) - (x - targets)) @ move)  # noqa: E731, B023
        points = [m + s * move for s in LENGTHS]
        totals, gram = sums(points)
        rise = [along(at, x) for at, x in zip(points, totals, strict=True)]
        if rise[0] <= 0.1 * abs(slope @ move):
            m, total = points[0], totals[0]
            continue
        # The whole step is too long: the slope along it grows, so the length where it is 0 lies between two tried ones.
        i = next((i for i, x in enumerate(rise) if x <= 0), len(rise))
        a, fa = (LENGTHS[i], rise[i]) if i < len(rise) else (0.0, float(slope @ move))
        b, fb = LENGTHS[i - 1], rise[i - 1]
        m = m + (a - fa * (b - a) / (fb - fa)) * move
        (total,), gram = sums([m])
    if not met:
        said = ", ".join(f"{d} {x:.0f} of {y:.0f}" for d, x, y in zip(model.domains, total, targets, strict=True))
        warnings.warn(f"rates between {low} and {high} cannot meet the targets; nearest totals of tokens: {said}", stacklevel=2)
    return Mix(model, m, low, high, targets, total, met)


def domain_of_labels() -> Column:
    """Domains of the labels table: toxic, else low (quality 0), else clean."""
    return F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "low").when(F.col("quality") == 1, "clean")


def _copies(rate: str) -> Column:
    chance = F.pmod(F.xxhash64("doc_id", F.lit("mix")), F.lit(1 << 30)) / (1 << 30)
    return F.floor(F.col(rate) + chance).cast("long")


def rated(narrow: DataFrame, mix: Mix) -> DataFrame:
    """A table of ``posteriors`` with rate and copies."""
    shared = narrow.sparkSession.sparkContext.broadcast(mix)
    at = narrow.columns.index("p")

    def run(batches):
        m = shared.value
        for batch in batches:
            if batch.num_rows:
                p = batch.column(at).flatten().to_numpy().reshape(-1, len(m.model.domains))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(m.rates(p))], names=[*batch.schema.names, "rate"])

    workers_see_package(narrow.sparkSession)
    out = narrow.mapInArrow(run, T.StructType([*narrow.schema.fields, T.StructField("rate", T.DoubleType())]))
    return out.withColumn("copies", _copies("rate"))


def mixing_rates(docs: DataFrame, labelled: DataFrame, domain: Column, weights: dict[str, float], **options) -> DataFrame:
    """doc_id, n_tokens (words), one posterior p_<domain> for each domain, rate, copies of every row.

    copies is floor(rate + a fraction drawn from the hash of doc_id), so its expectation is the rate.  Null and
    empty texts have no tokens, so their rate moves by their posterior alone; repeated rows are rated each by
    itself; without labels all documents share one domain; an empty table gives no rows; other columns are ignored.
    The totals meet the targets as ``fit_rates`` says: where the bounds rule that out, it warns.
    """
    model = train(docs, labelled, domain)
    narrow = posteriors(docs, model)
    rows = rated(narrow, fit_rates(narrow, model, weights, **options))
    posts = [F.get("p", F.lit(i)).alias(f"p_{d}") for i, d in enumerate(model.domains)]
    return rows.select("doc_id", F.col("n").alias("n_tokens"), *posts, "rate", "copies")


def policy(narrow: DataFrame, model: Softmax, keep: str, least: float = 1 / 3, whole: float = 2 / 3) -> tuple[dict[str, float], float]:
    """Weights and tokens of the mix that takes documents by their posterior of the domain ``keep``: none up to ``least``, all
    from ``whole`` on, and in between in proportion.  These totals are within reach of rates from 0 to 1."""
    at = model.domains.index(keep)
    rate = F.least(F.greatest((F.col("p")[at] - least) / (whole - least), F.lit(0.0)), F.lit(1.0))
    sums = narrow.agg(*[F.coalesce(F.sum(F.col("n") * rate * F.col("p")[i]), F.lit(0.0)) for i in range(len(model.domains))]).first()
    return dict(zip(model.domains, sums, strict=True)), sum(sums)


def mixed(docs: DataFrame, mix: Mix) -> DataFrame:
    """Every row as often as its copies say, with the columns of ``docs``, whatever their names.

    Null and empty texts have no words and the rate of their posterior; repeated rows are copied each by itself; rows
    without doc_id draw one common chance; an empty table stays empty.
    """
    shared = docs.sparkSession.sparkContext.broadcast(mix)
    name, copies, number = fresh(docs, "__rate", "__copies", "__i")

    def run(batch, buf, offs):
        m = shared.value
        ids, first = features.word_ids(buf, offs, m.model.bits)
        rate = m.rates(m.model.posterior(ids, first, features.structure(buf, offs)))
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rate)], names=[*batch.schema.names, name])

    rows = map_text(docs, T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())]), run)
    rows = rows.withColumn(copies, _copies(name)).where(F.col(copies) > 0)
    if mix.high > 1:
        rows = rows.withColumn(number, F.explode(F.sequence(F.lit(1), F.col(copies))))
    return rows.select(*docs.columns)
