"""Operator 11: vectors compressed to codes of one byte a part.

A vector is cut into parts, and each part is written as the number of the nearest of the entries of its position's
codebook.  Codebooks are fitted in rounds.  In each, tasks search the entries by a kd-tree over each codebook, add up
the parts of every entry as integers, and send one row an entry; those sums are added by a grouping, and only the
codebooks themselves (a fixed number of entries) come to the driver.  Components are integers, so results do not depend
on the order of additions.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import materialize, workers_see_package

#: Steps of a component's unit.
SCALE = 1024
#: Entries of a leaf of a kd-tree.
LEAF = 8


class Tree:
    """kd-tree over the entries of a codebook: halved at the median of the widest dimension, with the box of each node.

    ``nearest`` searches a batch at once.  Every query goes down to its own leaf first.  Then one walk through the tree
    takes along, at each node, the queries whose distance to the node's box does not exceed their best distance; those
    for which it is equal go along too, since an entry of lower index may lie there at that very distance.
    """

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        self.squares = (entries * entries).sum(1)
        self.root = self._node(np.arange(len(entries)))

    def _node(self, ids: np.ndarray) -> dict:
        some = self.entries[ids]
        node = {"low": some.min(0), "high": some.max(0), "ids": ids}
        dim = int((node["high"] - node["low"]).argmax())
        order = ids[np.argsort(some[:, dim], kind="stable")]
        half = len(ids) // 2
        if len(ids) > LEAF and node["high"][dim] > node["low"][dim]:
            node |= {"dim": dim, "split": self.entries[order[half], dim], "sides": (self._node(np.sort(order[:half])), self._node(np.sort(order[half:])))}
        return node

    def nearest(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the nearest entry, the lowest of equally near ones, and the squared distance, for each row."""
        qq = (q * q).sum(1)
        best = np.full(len(q), np.iinfo(np.int64).max if q.dtype == np.int64 else np.inf, q.dtype)
        index, home = np.full(len(q), len(self.entries)), np.full(len(q), -1)

        def look(node, rows):
            d = qq[rows][:, None] - 2 * (q[rows] @ self.entries[node["ids"]].T) + self.squares[node["ids"]]
            k = d.argmin(1)
            d, k = d[np.arange(len(rows)), k], node["ids"][k]
            better = (d < best[rows]) | ((d == best[rows]) & (k < index[rows]))
            best[rows[better]], index[rows[better]] = d[better], k[better]

        def descend(node, rows):
            if "sides" not in node:
                home[rows] = node["ids"][0]
                look(node, rows)
                return
            right = q[rows, node["dim"]] >= node["split"]
            for side, some in zip(node["sides"], (rows[~right], rows[right]), strict=True):
                if len(some):
                    descend(side, some)

        def walk(node, rows):
            beyond = np.maximum(np.maximum(node["low"] - q[rows], q[rows] - node["high"]), 0)
            rows = rows[(beyond * beyond).sum(1) <= best[rows]]
            if "sides" not in node:
                rows = rows[home[rows] != node["ids"][0]]
                if len(rows):
                    look(node, rows)
            elif len(rows):
                for side in node["sides"]:
                    walk(side, rows)

        if len(q):
            descend(self.root, np.arange(len(q)))
            walk(self.root, np.arange(len(q)))
        return index, best.astype(np.int64)


def _trees(books: list[np.ndarray], most: int) -> list[Tree]:
    """One tree a codebook; in floating point where every sum of squares is a whole number below 2**53, which is exact there."""
    kind = np.float64 if 4 * books[0].shape[1] * most**2 < 1 << 53 else np.int64
    return [Tree(b.astype(kind)) for b in books]


def _parts(column: pa.Array, n_parts: int) -> np.ndarray:
    """(rows, parts, components) of a column of equally long lists."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), n_parts, -1)


def _sums(vectors: DataFrame, books: list[np.ndarray], most: int) -> DataFrame:
    """part, entry, n, sums: for every entry that a task has used, the number and the sum of the parts nearest to it."""
    n_parts, width = len(books), books[0].shape[1]

    def run(batches):
        trees = _trees(books, most)
        sums, n = np.zeros((n_parts, len(books[0]), width), np.int64), np.zeros((n_parts, len(books[0])), np.int64)
        for batch in batches:
            x = _parts(batch.column(0), n_parts)
            for p, tree in enumerate(trees):
                at, _ = tree.nearest(x[:, p].astype(tree.entries.dtype))
                np.add.at(sums[p], at, x[:, p])
                n[p] += np.bincount(at, minlength=len(n[p]))
        part, entry = n.nonzero()
        if len(part):
            arrays = [pa.array(part.astype(np.int32)), pa.array(entry.astype(np.int32)), pa.array(n[part, entry]), pa.array(list(sums[part, entry]), pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(arrays, names=["part", "entry", "n", "sums"])

    return vectors.select("v").mapInArrow(run, "part int, entry int, n long, sums array<long>")


def _updated(vectors: DataFrame, books: list[np.ndarray], most: int) -> list[np.ndarray]:
    width = books[0].shape[1]
    total = _sums(vectors, books, most).groupBy("part", "entry").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("sums")[i]) for i in range(width)]).alias("sums"))
    out = [b.copy() for b in books]
    # One row an entry at most.
    for r in total.collect():
        out[r.part][r.entry] = np.array(r.sums, np.int64) // r.n
    return out


def _coded(vectors: DataFrame, books: list[np.ndarray], most: int) -> DataFrame:
    def run(batches):
        trees = _trees(books, most)
        for batch in batches:
            x = _parts(batch.column(2), len(books))
            found = [t.nearest(x[:, p].astype(t.entries.dtype)) for p, t in enumerate(trees)]
            codes = np.stack([at for at, _ in found], 1).astype(np.uint8)
            text = codes.tobytes().hex()
            k = 2 * len(books)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([text[i : i + k] for i in range(0, len(text), k)], pa.string()), pa.array(sum(d for _, d in found))], names=["vec_id", "label", "code", "error"])

    of = {f.name: f.dataType.simpleString() for f in vectors.schema.fields}
    return vectors.select("vec_id", "label", "v").mapInArrow(run, f"vec_id {of['vec_id']}, label {of['label']}, code string, error long")


def _with_label_error(coded: DataFrame) -> DataFrame:
    """Adds the sum of errors over equal labels. Labels of at least one row in 10,000 are at most 10,000, so they are
    broadcast; rows of the others, none of which has many, meet their sums by a shuffle."""
    totals = materialize(coded.groupBy("label").agg(F.count("*").alias("n"), F.sum("error").alias("label_error")))
    least = (totals.agg(F.sum("n")).first()[0] or 0) // 10_000
    frequent, rare = (totals.where(c).select(F.col("label").alias("l"), "label_error") for c in (F.col("n") >= least, F.col("n") < least))
    out = coded.join(F.broadcast(frequent), coded["label"].eqNullSafe(frequent["l"]), "left")
    if rare.isEmpty():
        return out.drop("l")
    rest = out.where(F.col("label_error").isNull()).drop("l", "label_error")
    return out.where(F.col("label_error").isNotNull()).drop("l").unionByName(rest.join(rare, rest["label"].eqNullSafe(rare["l"])).drop("l"))


def as_text(books: list[np.ndarray]) -> str:
    return ",".join(str(x) for b in books for x in b.ravel().tolist())


def compress(table: DataFrame, n_parts: int = 4, entries: int = 256, rounds: int = 4) -> tuple[DataFrame, list[np.ndarray]]:
    """Codes of the rows (vec_id, label, code, error, label_error) and the codebooks, one array of entries a part.

    Rows whose vector is null or empty, holds null or non-finite components, or has another length than that of the row
    with the smallest vec_id are dropped.  Codebooks begin with the rows of the smallest vec_ids (nulls last, equal ones
    in the order of their vectors), fewer where the table has fewer.  Repeated rows are coded each by itself; null
    labels are one label; other columns are ignored; an empty table gives no rows and no codebooks.  A length that
    ``n_parts`` does not divide, or components whose squared distances may not fit 64 bits, raise ValueError.
    """
    if not 1 <= entries <= 256:
        raise ValueError("codes have one byte a part")
    workers_see_package(table.sparkSession)
    fine = F.forall("embedding", lambda x: x.isNotNull() & (F.abs(x) < F.lit(float("inf"))) & ~F.isnan(x))
    rows = table.select("vec_id", "label", "embedding").where(F.col("embedding").isNotNull() & (F.size("embedding") > 0) & fine)
    order = F.col("vec_id").asc_nulls_last()
    head = rows.orderBy(order, "embedding").select(F.size("embedding")).first()
    width = head[0] if head else n_parts
    if width % n_parts:
        raise ValueError(f"{n_parts} parts do not divide vectors of {width} components")
    rows = rows.where(F.size("embedding") == width)
    largest = rows.agg(F.max(F.array_max(F.transform("embedding", lambda x: F.abs(x.cast("double")))))).first()[0] or 0.0
    most = int(largest * SCALE) + 1
    if 4 * width * most**2 >= 1 << 62:
        raise ValueError(f"components of up to {largest} are too large for squared distances of 64 bits")
    # Read once for every round, so written once.
    vectors = materialize(rows.select("vec_id", "label", F.transform("embedding", lambda x: F.floor(x.cast("double") * SCALE).cast("int")).alias("v")))
    first = np.array([r.v for r in vectors.orderBy(order, "v").limit(entries).select("v").collect()], np.int64).reshape(-1, n_parts, width // n_parts)
    books = [first[:, p] for p in range(n_parts)]
    if len(first):
        for _ in range(rounds):
            books = _updated(vectors, books, most)
        coded = materialize(_coded(vectors, books, most))
    else:
        coded = vectors.select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"))
    return _with_label_error(coded), books


def vector_codes(table: DataFrame) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of a table of vec_id, embedding, label; see ``compress``."""
    coded, books = compress(table)
    return coded.select("vec_id", "code", "error", "label_error", F.lit(hashlib.sha256(as_text(books).encode()).hexdigest()).alias("codebooks_sha256"))


def decoded(coded: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """vec_id and the vector that each code stands for; the codebooks have a fixed size."""

    def run(batches):
        for batch in batches:
            at = np.frombuffer(bytes.fromhex("".join(batch.column(1).to_pylist())), np.uint8).reshape(batch.num_rows, len(books))
            v = np.concatenate([b[at[:, p]] for p, b in enumerate(books)], 1) / SCALE
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(v), pa.list_(pa.float64()))], names=["vec_id", "embedding"])

    return coded.select("vec_id", "code").mapInArrow(run, f"vec_id {coded.schema['vec_id'].dataType.simpleString()}, embedding array<double>")


def _oracle() -> str:
    """Each round as two queries: every part against every entry of its codebook, and the means of the nearest ones."""
    near = """(SELECT vec_id, part, arg_min(entry, (d, entry)) AS entry, min(d) AS d, any_value(v) AS v FROM (
        SELECT p.vec_id, p.part, p.v, b.entry, list_sum(list_transform(list_zip(p.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d
        FROM parts p JOIN book{k} b USING (part)) GROUP BY vec_id, part)"""
    steps = [
        """kept AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        "parts AS MATERIALIZED (SELECT vec_id, part, list_slice(v, part * len(v) // 4 + 1, (part + 1) * len(v) // 4) AS v FROM kept, (SELECT unnest([0, 1, 2, 3]) AS part))",
        "first AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM kept ORDER BY vec_id LIMIT 256)",
        "book0 AS MATERIALIZED (SELECT part, entry, v FROM parts JOIN first USING (vec_id))",
    ]
    for k in range(4):
        steps.append(f"near{k} AS MATERIALIZED {near.format(k=k)}")
        steps.append(f"""mean{k} AS (SELECT part, entry, list(m ORDER BY i) AS v FROM (
            SELECT part, entry, i, (s - ((s % n) + n) % n) // n AS m FROM (SELECT part, entry, i, CAST(sum(x) AS BIGINT) AS s, count(*) AS n
            FROM (SELECT part, entry, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM near{k}) GROUP BY part, entry, i)) GROUP BY part, entry)""")
        steps.append(f"book{k + 1} AS MATERIALIZED (SELECT b.part, b.entry, coalesce(m.v, b.v) AS v FROM book{k} b LEFT JOIN mean{k} m USING (part, entry))")
    steps += [
        f"last AS MATERIALIZED {near.format(k=4)}",
        "sha AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM book4)",
        "coded AS (SELECT vec_id, string_agg(format('{:02x}', entry), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM last GROUP BY vec_id)",
    ]
    return "WITH " + ",\n".join(steps) + "\nSELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM coded JOIN kept USING (vec_id), sha"


ORACLE = _oracle()
