"""Operator 12: best-fit decreasing packing.

A document of more than ``max_len`` tokens is cut into pieces of max_len, of which the first may be shorter.
Pieces are taken longest first, and each goes into the open sequence with the least room that still holds it,
which a segment tree over the remaining capacities finds in logarithmic time.

Sequences with equal room are interchangeable, and so are pieces of equal length; what best-fit decreasing does
therefore depends on the number of pieces of each length alone.  Tasks encode texts and describe pieces, a range
partition numbers them from the longest to the shortest, at most max_len counts reach the driver, and ``plan``
places whole runs of equal pieces into runs of equal sequences: the very sequences that taking piece after piece
gives, over the whole table and not only within a partition.  The runs go back to the tasks, where every piece
looks up its own by its number.  The number of runs depends on max_len, not on the number of pieces.
"""

from __future__ import annotations

import zlib
from collections import defaultdict, deque

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import tokens
from .common import doc_columns, map_text, numbered


class Capacities:
    """Segment tree over the remaining capacities 0 to ``size``; a node holds the number of open sequences below it."""

    def __init__(self, size: int):
        self.width = 1 << size.bit_length()
        self.open = [0] * (2 * self.width)

    def add(self, capacity: int, n: int) -> None:
        at = self.width + capacity
        while at:
            self.open[at] += n
            at >>= 1

    def tightest(self, length: int) -> int | None:
        """The least capacity of an open sequence that is at least ``length``."""
        at = self.width + length
        if self.open[at]:
            return length
        # Up to the first subtree on the right that holds an open sequence, then down to its least capacity.
        while at > 1:
            if at % 2 == 0 and self.open[at + 1]:
                at += 1
                break
            at //= 2
        else:
            return None
        while at < self.width:
            at = 2 * at + (not self.open[2 * at])
        return at - self.width


def plan(counts: dict[int, int], size: int) -> np.ndarray:
    """Runs of equal pieces in sequences of ``size``: rows of (number of the first piece, length, first sequence, pieces
    in each of its sequences, offset of the first piece there).

    counts: pieces of each length, at most ``size``.  Pieces are numbered from the longest to the shortest.
    """
    tree, groups, runs = Capacities(size), defaultdict(deque), []
    piece = made = 0
    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            room = tree.tightest(length)
            if room is None:
                room, n = size, -(-left // (size // length))
                groups[room].append((made, n))
                tree.add(room, n)
                made += n
            first, n = groups[room].popleft()
            # The sequence just used is the tightest as long as it has room, so it is filled before the next one is begun.
            each = min(room // length, left)
            used = min(n, left // each)
            runs.append((piece, length, first, each, size - room))
            if used < n:
                groups[room].appendleft((first + used, n - used))
            groups[room - each * length].append((first, used))
            tree.add(room, -used)
            tree.add(room - each * length, used)
            piece += used * each
            left -= used * each
    return np.array(runs, np.int64).reshape(-1, 5)


def cut_lengths(n: int, max_len: int) -> list[int]:
    return [n % max_len] * (n % max_len > 0) + [max_len] * (n // max_len)


def pack(docs: DataFrame, tokenizer_path: str, end_id: int, max_len: int = 1024, split: str = "spaced", with_ids: bool = False) -> DataFrame:
    """One row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset, and ids if asked for.

    A null or empty text still has its end id, so one piece; a text of any length is encoded whole.  Repeated rows and
    equal or null doc_ids are packed each by itself; an empty table gives no rows; other columns are ignored.  Ties
    between pieces of one length are broken by doc_id and start, between sequences of equal room by when they came to have it.
    """

    def cut(batch, buf, offs):
        coder = tokens.bpe_encoder(tokenizer_path, split)
        doc, piece, start, length, crc, out = [], [], [], [], [], []
        for i, ids in enumerate(coder.ids(buf, offs)):
            ids = np.append(ids, np.uint32(end_id)).astype("<u4")
            at, data = 0, memoryview(ids).cast("B")
            for k, n in enumerate(cut_lengths(len(ids), max_len)):
                doc.append(i), piece.append(k), start.append(at), length.append(n)
                crc.append(zlib.crc32(data[4 * at : 4 * (at + n)]))
                if with_ids:
                    out.append(ids[at : at + n].astype(np.int32))
                at += n
        arrays = [batch.column(0).take(pa.array(doc, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))]
        names = ["doc_id", "piece", "start", "length", "ids_crc32"]
        yield pa.RecordBatch.from_arrays(arrays + [pa.array(out, pa.list_(pa.int32()))] * with_ids, names=names + ["ids"] * with_ids)

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    pieces = map_text(doc_columns(docs, "doc_id", "text"), schema, cut, encoder=tokenizer_path)
    ordered = numbered(pieces, "n", F.col("length").desc(), F.col("doc_id"), F.col("start"))
    # At most max_len rows.
    runs = plan({r.length: r.n for r in ordered.groupBy("length").agg(F.count("*").alias("n")).collect()}, max_len)

    def place(batches):
        for b in batches:
            n = b.column(b.schema.get_field_index("n")).to_numpy()
            first, length, sequence, each, offset = runs[np.searchsorted(runs[:, 0], n, "right") - 1].T
            at = n - first
            arrays = [c for c, name in zip(b.columns, b.schema.names, strict=True) if name != "n"]
            yield pa.RecordBatch.from_arrays(arrays + [pa.array(sequence + at // each), pa.array(offset + at % each * length)], names=[x for x in b.schema.names if x != "n"] + ["sequence_id", "offset"])

    names = [c.strip().split()[0] for c in schema.split(",")]
    return ordered.select(*names, "n").mapInArrow(place, schema + ", sequence_id long, offset long")


def sequences(packed: DataFrame) -> DataFrame:
    """Packed pieces with ids put together: sequence_id, ids (at most max_len), and the doc_id and length of each piece in order."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "length", "ids")))
    whole = packed.groupBy("sequence_id").agg(parts.alias("p"))
    return whole.select("sequence_id", F.flatten("p.ids").alias("ids"), F.col("p.doc_id").alias("doc_ids"), F.col("p.length").alias("lengths"))
