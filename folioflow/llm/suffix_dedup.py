"""Operator 6: removal of repeated passages by distributed suffix sorting.

Every 50-byte window owns one suffix: the one that starts at its smallest 24-gram (by hash), a choice that
depends on the window's bytes alone, so equal windows of any two documents own equal suffixes.  Only those
suffixes, about one in fourteen, are sorted.  Splitters from a sample of fixed size range-partition them by their
leading 24 bytes; where the data ask for more buckets than there may be splitters, a range is divided further by a
hash of those bytes, which keeps equal suffixes together.  A bucket sorts its suffixes by multikey quicksort (those
bytes, eight at a time, then the run of windows that own the suffix) and compares neighbours.  The number of buckets
grows with the data; tasks, splitters and the driver's sample do not grow beyond their bounds, since a task takes its
buckets one after the other.  Where a run of windows is equal to
one in a document with a smaller doc_id, its bytes go.  Where suffixes agree but the runs around them do not,
or where a splitter cuts a group of equal suffixes in two, the windows themselves are compared in a second
round, keyed by window.  Spans then meet by document.

Before anything moves, in both rounds, each task drops all but the smallest document of every run or window it
holds several times, so a passage found in any share of all rows reaches a bucket once from each task.  What
moves are packed arrays, not texts.  Two runs are equal if their suffixes' 24 bytes are and a 64-bit hash of
the whole run (at most 2 * width - 24 bytes) is; two windows, if 96 bits of hash are.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import textkernel as tk
from .common import doc_columns, map_text, materialize, small, workers_see_package

U64 = np.uint64
GRAM = 24
#: Suffixes a task holds before it packs and sends them.
HELD = 400_000
#: Bytes of text whose suffixes make one bucket.
BUCKET_BYTES = 16 << 20
#: Documents whose suffixes choose the splitters, and suffixes taken from each (10 MB of keys in the driver at any size).
SAMPLE_DOCS, SAMPLE_EACH = 20_000, 16
#: Ranges at most (512 KB of splitters), and reduce tasks at most.
MOST_RANGES, MOST_TASKS = 16_384, 16_384


def pack(*columns: np.ndarray) -> bytes:
    """Columns byte plane by byte plane, compressed."""
    raw = b"".join(np.ascontiguousarray(c).view(np.uint8).reshape(len(c), -1).T.tobytes() for c in columns)
    return len(columns[0]).to_bytes(8, "little") + pa.Codec("zstd", compression_level=1).compress(raw, asbytes=True)


def unpack(data: bytes, *dtypes) -> list[np.ndarray]:
    n, out, at = int.from_bytes(data[:8], "little"), [], 0
    sizes = [np.dtype(d).itemsize * n for d in dtypes]
    raw = pa.Codec("zstd").decompress(data[8:], sum(sizes), asbytes=True)
    for d, s in zip(dtypes, sizes, strict=True):
        planes = np.frombuffer(raw, np.uint8, s, at).reshape(np.dtype(d).itemsize, n)
        out.append(np.ascontiguousarray(planes.T).view(d).ravel())
        at += s
    return out


def window_runs(buf: np.ndarray, offs: np.ndarray, width: int):
    """The suffixes that windows own: for each, its document, start, and the first and last window (all within ``buf``)."""
    n = len(buf)
    none = [np.zeros(0, np.int64)] * 4
    if n < width:
        return none
    c = tk.prefix_hash(buf)
    inv = tk.powers(n + 1)[1]
    m = n - GRAM + 1
    bits = U64((1 << max(n.bit_length(), 22)) - 1)
    x = (c[GRAM:] - c[:m]) * inv[:m]
    x *= U64(0xBF58476D1CE4E5B9)
    x &= ~bits
    x |= np.arange(m, dtype=U64)
    span, have = width - GRAM + 1, 1
    while have * 2 <= span:
        x = np.minimum(x[: len(x) - have], x[have:])
        have *= 2
    if have < span:
        x = np.minimum(x[: len(x) - (span - have)], x[span - have :])
    x &= bits
    lens = np.diff(offs)
    edge = np.zeros(n + 2, np.int8)
    long = np.flatnonzero(lens >= width)
    np.add.at(edge, offs[long], 1)
    np.add.at(edge, offs[long + 1] - width + 1, -1)
    valid = np.cumsum(edge[: len(x)], dtype=np.int8) > 0
    new = np.empty(len(x), bool)
    new[0] = True
    new[1:] = (x[1:] != x[:-1]) | ~valid[:-1]
    new &= valid
    new[offs[long]] = True
    first = np.flatnonzero(new)
    if len(first) == 0:
        return none
    # A run ends where the next begins or where its document's windows end.
    doc = np.searchsorted(offs, first, "right") - 1
    last = np.minimum(np.append(first[1:], n) - 1, offs[doc + 1] - width)
    return doc, x[first].astype(np.int64), first, last


def suffix_keys(buf, pos, first, last, width) -> list[np.ndarray]:
    """The suffix's 24 leading bytes as three numbers that sort as the bytes do, and the hash of the run."""
    w = tk.eights(buf)
    return [*(w[pos + k].byteswap() for k in (0, 8, 16)), tk.span_hashes(buf, first, last + width)]


def multikey_order(keys: list[np.ndarray]) -> np.ndarray:
    """Order by several keys: quicksort on the first, then each further key only inside the ties that remain."""
    order = np.argsort(keys[0])
    tie = np.concatenate(([False], keys[0][order][1:] == keys[0][order][:-1]))
    for k in keys[1:]:
        in_tie = tie.copy()
        in_tie[:-1] |= tie[1:]
        at = np.flatnonzero(in_tie)
        if len(at) == 0:
            break
        group = np.cumsum(~tie[at])
        some = order[at]
        order[at] = some[np.lexsort((k[some], group))]
        k = k[order]
        tie[1:] &= k[1:] == k[:-1]
    return order


def starts_of(*sorted_keys: np.ndarray) -> np.ndarray:
    new = np.zeros(len(sorted_keys[0]), bool)
    new[:1] = True
    for k in sorted_keys:
        new[1:] |= k[1:] != k[:-1]
    return new


def send(bucket: np.ndarray, doc: np.ndarray, *columns: np.ndarray) -> pa.RecordBatch:
    """Packed rows by bucket; ``doc`` is packed as a dictionary."""
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    at = np.flatnonzero(starts_of(bucket))
    out = []
    for a, b in zip(at, np.append(at[1:], len(bucket)), strict=True):
        some = order[a:b]
        ids, ref = np.unique(doc[some], return_inverse=True)
        ref = ref.astype(np.uint16 if len(ids) < 65536 else np.uint32)
        out.append((int(bucket[a]), pack(np.diff(ids, prepend=0)), pack(ref), len(ids) < 65536, pack(*(c[some] for c in columns))))
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int32()), *(pa.array([r[i] for r in out], t) for i, t in ((1, pa.binary()), (2, pa.binary()), (3, pa.bool_()), (4, pa.binary())))], names=["bucket", "ids", "ref", "narrow", "data"])


SENT_NAMES = ["bucket", "ids", "ref", "narrow", "data"]
SENT = "bucket int, ids binary, ref binary, narrow boolean, data binary"


def tagged(kinds):
    """Packed rows with their kind: 0 suffixes, 1 spans, 2 windows to compare."""
    for kind, b in kinds:
        yield pa.RecordBatch.from_arrays([pa.array(np.full(b.num_rows, kind, np.int32)), *b.columns], names=["kind", *SENT_NAMES])


def received(batches, dtypes):
    """Per bucket: doc and the columns. Rows of a bucket are adjacent."""
    held, now = [], None

    def done():
        return now, [np.concatenate(c) for c in zip(*held, strict=True)]

    for batch in batches:
        for r in batch.to_pylist():
            if held and r["bucket"] != now:
                yield done()
                held = []
            now = r["bucket"]
            ids = np.cumsum(unpack(r["ids"], np.int64)[0])
            held.append([ids[unpack(r["ref"], np.uint16 if r["narrow"] else np.uint32)[0]], *unpack(r["data"], *dtypes)])
    if held:
        yield done()


def send_to_docs(n: int, doc, start, more) -> pa.RecordBatch:
    """Starts and lengths on their way to their documents."""
    return send((tk.mix(doc.astype(U64)) % U64(n)).astype(np.int32), doc, start.astype(np.uint32), more.astype(np.uint32))


def span_batch(n: int, doc, start, end) -> pa.RecordBatch:
    return send_to_docs(n, doc, start, end - start)


KEY_NAMES = ["a", "b", "c", "run"]


def splitters(docs: DataFrame, n: int, total: int, width: int) -> list[np.ndarray]:
    """n - 1 cuts of the suffixes' order, from a sample of about SAMPLE_EACH suffixes of SAMPLE_DOCS documents."""

    def some(batch, buf, offs):
        doc, pos, first, last = window_runs(buf, offs, width)
        if len(doc):
            at = np.flatnonzero(starts_of(doc))
            ends = np.append(at[1:], len(doc))
            pick = np.unique(np.concatenate([np.linspace(a, b - 1, min(SAMPLE_EACH, b - a)).astype(np.int64) for a, b in zip(at, ends, strict=True)]))
            keys = suffix_keys(buf, pos[pick], first[pick], last[pick], width)
            yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in keys], names=KEY_NAMES)

    rows = docs if total <= SAMPLE_DOCS else docs.sample(False, SAMPLE_DOCS / total, 7)
    got = map_text(rows.select("text"), ", ".join(f"{k} long" for k in KEY_NAMES), some).toArrow()
    cols = [got.column(i).to_numpy().view(U64) for i in range(4)]
    order = np.lexsort(cols[::-1])
    cut = order[(np.arange(1, n) * len(order)) // n] if len(order) else order
    return [c[cut] for c in cols]


def bucket_of(cuts: list[np.ndarray], keys: list[np.ndarray]) -> np.ndarray:
    """Number of cuts that are not above each suffix; the suffixes are sorted."""
    lo, hi = np.searchsorted(keys[0], cuts[0], "left"), np.searchsorted(keys[0], cuts[0], "right")
    for i in np.flatnonzero(lo < hi):
        a, b = lo[i], hi[i]
        for k, c in zip(keys[1:], cuts[1:], strict=True):
            a, b = a + np.searchsorted(k[a:b], c[i], "left"), a + np.searchsorted(k[a:b], c[i], "right")
        lo[i] = a
    return np.cumsum(np.bincount(lo, minlength=len(keys[0]) + 1)[: len(keys[0])]).astype(np.int32)


def plan(size: int, bucket_bytes: int) -> tuple[int, int, int, int]:
    """Buckets, ranges, parts of each range and reduce tasks for so many bytes of text."""
    wanted = max(8, -(-size // bucket_bytes))
    ranges = min(wanted, MOST_RANGES)
    parts = -(-wanted // ranges)
    return ranges * parts, ranges, parts, min(ranges * parts, MOST_TASKS)


def part_of(keys: list[np.ndarray], parts: int) -> np.ndarray:
    """Part of its range in which a suffix is, by its 24 leading bytes."""
    if parts == 1:
        return np.zeros(len(keys[0]), np.int32)
    x = tk.mix(tk.mix(tk.mix(keys[0]) ^ keys[1]) ^ keys[2])
    return (x % U64(parts)).astype(np.int32)


def removed_spans(docs: DataFrame, width: int = 50, broadcast_rows: int = 1_000_000, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """doc_id and the packed maximal runs of bytes to remove (int64 starts and ends), for the documents that lose any."""
    spark = docs.sparkSession
    workers_see_package(spark)
    if width < GRAM:
        raise ValueError(f"width {width} is below {GRAM}")
    # A run has at most width - GRAM further windows.
    further = np.uint8 if width - GRAM < 256 else np.uint32
    docs = doc_columns(docs, "doc_id", "text").where("doc_id IS NOT NULL AND text IS NOT NULL")
    total, size = docs.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    n, ranges, parts, tasks = plan(size, bucket_bytes)
    cuts = spark.sparkContext.broadcast(splitters(docs, ranges, total, width))
    kinds = (np.uint64, np.uint64, np.uint64, np.uint64, np.uint32, further)

    def deal(batches):
        held, size = [], 0

        def flush():
            doc, a, b, c, run, first, more = (np.concatenate(c) for c in zip(*held, strict=True))
            order = multikey_order([a, b, c, run, doc])
            doc, a, b, c, run, first, more = (x[order] for x in (doc, a, b, c, run, first, more))
            new = starts_of(a, b, c, run)
            least = doc[np.flatnonzero(new)][np.cumsum(new) - 1]
            gone = doc > least
            if gone.any():
                yield 1, span_batch(n, doc[gone], first[gone], first[gone] + more[gone] + width)
            k = ~gone
            keys = [x[k] for x in (a, b, c, run)]
            yield 0, send(bucket_of(cuts.value, keys) * parts + part_of(keys, parts), doc[k], *keys, first[k].astype(np.uint32), more[k].astype(further))

        for batch in batches:
            ids = batch.column(0).to_numpy()
            buf_all, offs_all = tk.batch_text(batch.column(1))
            for lo, hi in tk.slices(offs_all):
                buf, offs = buf_all[offs_all[lo] : offs_all[hi]], offs_all[lo : hi + 1] - offs_all[lo]
                doc, pos, first, last = window_runs(buf, offs, width)
                if len(doc):
                    held.append((ids[lo:hi][doc], *suffix_keys(buf, pos, first, last, width), first - offs[doc], last - first))
                    size += len(doc)
                    if size >= HELD:
                        yield from tagged(flush())
                        held, size = [], 0
        if held:
            yield from tagged(flush())

    dealt = docs.mapInArrow(deal, "kind int, " + SENT)

    def compare(batches):
        marks = cuts.value
        for bucket, (doc, a, b, c, run, first, more) in received(batches, kinds):
            order = multikey_order([a, b, c, run, doc])
            doc, a, b, c, run, first, more = (x[order] for x in (doc, a, b, c, run, first, more))
            first, more = first.astype(np.int64), more.astype(np.int64)
            group, same = starts_of(a, b, c), starts_of(a, b, c, run)
            least = doc[np.flatnonzero(same)][np.cumsum(same) - 1]
            gone = doc > least
            if gone.any():
                yield 1, span_batch(n, doc[gone], first[gone], first[gone] + more[gone] + width)
            # Groups in which both the runs and the documents differ, or which a neighbouring bucket may share.
            at, g = np.flatnonzero(group), np.cumsum(group) - 1
            runs = np.add.reduceat(same.astype(np.int64), at)
            ask = (runs > 1) & (np.maximum.reduceat(doc, at) > np.minimum.reduceat(doc, at))
            for cut in (bucket // parts - 1, bucket // parts):
                if 0 <= cut < len(marks[0]):
                    ask |= (a[at] == marks[0][cut]) & (b[at] == marks[1][cut]) & (c[at] == marks[2][cut])
            k = ask[g] & ~gone
            if k.any():
                yield 2, send_to_docs(n, doc[k], first[k], more[k])

    # Spans that a task found by itself pass through the same shuffle, on to their document's bucket.
    def passing(fn):
        def run(batches):
            spans = []

            def others():
                for batch in batches:
                    kinds = batch.column(0).to_numpy()
                    spans.append(batch.filter(pa.array(kinds == 1)))
                    yield batch.select(SENT_NAMES).filter(pa.array(kinds != 1))

            for found in tagged(fn(others())):
                yield from spans
                spans.clear()
                yield found
            yield from spans

        return run

    def gathered(rows: DataFrame) -> DataFrame:
        """A task gets whole buckets, one after the other."""
        return rows.repartitionById(tasks, F.col("bucket") % tasks).sortWithinPartitions("bucket")

    rounds = materialize(gathered(dealt).mapInArrow(passing(compare), "kind int, " + SENT))
    spans, asked = rounds.where("kind = 1").drop("kind"), rounds.where("kind = 2").drop("kind")

    def merge(batches):
        for _, (doc, start, length) in received(batches, (np.uint32, np.uint32)):
            order = np.lexsort((start, doc))
            doc, start = doc[order], start[order].astype(np.int64)
            end = start + length[order]
            at = np.flatnonzero(starts_of(doc))
            ids, out = [], []
            for a, b in zip(at, np.append(at[1:], len(doc)), strict=True):
                s, e = start[a:b], np.maximum.accumulate(end[a:b])
                new = np.flatnonzero(np.concatenate(([True], s[1:] > e[:-1])))
                ids.append(doc[a])
                out.append(np.concatenate((s[new], e[np.append(new[1:], len(s)) - 1])).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.binary())], names=["doc_id", "runs"])

    def by_bucket(rows: DataFrame, fn, schema: str) -> DataFrame:
        return gathered(rows).mapInArrow(fn, schema)

    def listed(batches):
        """Windows to compare, by document: starts, then how many more."""
        for _, (doc, first, more) in received(batches, (np.uint32, np.uint32)):
            order = np.argsort(doc, kind="stable")
            doc, first, more = doc[order], first[order], more[order]
            at = np.flatnonzero(starts_of(doc))
            cut = list(zip(at, np.append(at[1:], len(doc)), strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(doc[at]), pa.array([np.concatenate((first[a:b], more[a:b])).tobytes() for a, b in cut], pa.binary())], names=["doc_id", "asked"])

    wanted = materialize(by_bucket(asked, listed, "doc_id long, asked binary"))

    def windows(batches):
        """The asked windows, without those of which this task holds an equal one of a smaller document: these are spans."""
        held, size = [], 0

        def flush():
            doc, h, more, start = (np.concatenate(c) for c in zip(*held, strict=True))
            order = multikey_order([h, more, doc])
            doc, h, more, start = (x[order] for x in (doc, h, more, start))
            new = starts_of(h, more)
            gone = doc > doc[np.flatnonzero(new)][np.cumsum(new) - 1]
            if gone.any():
                yield 1, span_batch(n, doc[gone], start[gone], start[gone] + width)
            k = ~gone
            yield 2, send(((h[k] >> U64(32)) * U64(n) >> U64(32)).astype(np.int32), doc[k], h[k], more[k], start[k].astype(np.uint32))

        for batch in batches:
            ids, asked = batch.column(0).to_numpy(), batch.column(2)
            buf_all, offs_all = tk.batch_text(batch.column(1))
            for lo, hi in tk.slices(offs_all):
                buf, offs = buf_all[offs_all[lo] : offs_all[hi]], offs_all[lo : hi + 1] - offs_all[lo]
                docs_, starts, places = [], [], []
                for i, packed in enumerate(asked.slice(lo, hi - lo).to_pylist()):
                    first, more = np.frombuffer(packed, np.uint32).reshape(2, -1).astype(np.int64)
                    s = np.unique(np.repeat(first, more + 1) + np.arange(int((more + 1).sum())) - np.repeat(np.cumsum(more + 1) - more - 1, more + 1))
                    s = s[s + width <= offs[i + 1] - offs[i]]
                    if len(s) == 0:
                        continue
                    at = s + offs[i]
                    docs_.append(np.full(len(s), ids[lo + i])), starts.append(s), places.append(at)
                    size += len(s)
                if starts:
                    at = np.concatenate(places)
                    h, more = tk.window_hashes(buf, at, width) if width < 1000 else (tk.span_hashes(buf, at, at + width), tk.span_hashes(buf, at + 1, at + width))
                    held.append((np.concatenate(docs_), h, (more >> U64(32)).astype(np.uint32), np.concatenate(starts)))
                if size >= HELD:
                    yield from tagged(flush())
                    held, size = [], 0
        if held:
            yield from tagged(flush())

    def same_windows(batches):
        for _, (doc, h, more, start) in received(batches, (np.uint64, np.uint32, np.uint32)):
            order = multikey_order([h, more, doc])
            doc, h, more, start = doc[order], h[order], more[order], start[order].astype(np.int64)
            new = starts_of(h, more)
            gone = doc > doc[np.flatnonzero(new)][np.cumsum(new) - 1]
            if gone.any():
                yield 1, span_batch(n, doc[gone], start[gone], start[gone] + width)

    texts = docs.join(small(wanted, broadcast_rows), "doc_id").select("doc_id", "text", "asked")
    tagged_schema = "kind int, " + SENT
    more = by_bucket(texts.mapInArrow(windows, tagged_schema), passing(same_windows), tagged_schema)
    return materialize(by_bucket(spans.unionByName(more.drop("kind")), merge, "doc_id long, runs binary"))


def remove_repeats(docs: DataFrame, width: int = 50, broadcast_rows: int = 1_000_000, with_text: bool = False, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and, if asked for, kept: the remaining bytes) of every row.

    A byte goes if a string of ``width`` bytes (24 at least) over it also starts in a document with a smaller doc_id.  A null
    text counts as empty, and texts of any length are read whole.  A row without doc_id gives and loses nothing.  Rows of one doc_id do not count
    against each other, and spans found for an id hold for all its rows, as far as their texts reach.  An empty
    table gives no rows; other columns are ignored.
    """
    docs = doc_columns(docs, "doc_id", "text")
    spans = removed_spans(docs, width, broadcast_rows, bucket_bytes)

    def cut(batch, buf, offs):
        removed, count, kept, sha = [], [], [], []
        for i, packed in enumerate(batch.column(2).to_pylist()):
            text = buf[offs[i] : offs[i + 1]]
            if packed:
                start, end = np.minimum(np.frombuffer(packed, np.int64).reshape(2, -1), len(text))
                start, end = start[start < end], end[start < end]
                keep = np.ones(len(text), bool)
                for a, b in zip(start, end, strict=True):
                    keep[a:b] = False
                removed.append(int((end - start).sum())), count.append(len(start))
                text = text[keep]
            else:
                removed.append(0), count.append(0)
            data = text.tobytes()
            sha.append(hashlib.sha256(data).hexdigest())
            if with_text:
                kept.append(data)
        arrays = [batch.column(0), pa.array(np.diff(offs)), pa.array(removed, pa.int64()), pa.array(count, pa.int64()), pa.array(sha, pa.string())]
        yield pa.RecordBatch.from_arrays(arrays + [pa.array(kept, pa.binary())] * with_text, names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept"] * with_text)

    rows = docs.join(small(spans, broadcast_rows), "doc_id", "left").select("doc_id", "text", "runs")
    return map_text(rows, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text, cut)


ORACLE = """
WITH h AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, p, substr(h, 2 * p + 1, 100) AS s FROM (SELECT doc_id, h, unnest(range(0, len(h) // 2 - 49)) AS p FROM h WHERE len(h) >= 100)),
g AS (SELECT doc_id, p FROM (SELECT doc_id, p, min(doc_id) OVER (PARTITION BY s) AS m FROM w) WHERE m < doc_id),
b AS (SELECT doc_id, p, p - coalesce(lag(p) OVER (PARTITION BY doc_id ORDER BY p), -1000) > 50 AS new FROM g),
r AS (SELECT doc_id, min(p) AS a, max(p) + 50 AS z FROM (SELECT doc_id, p, sum(new::INT) OVER (PARTITION BY doc_id ORDER BY p) AS k FROM b) GROUP BY doc_id, k),
q AS (SELECT doc_id, a, z, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS f FROM r),
k AS (SELECT q.doc_id, sum(z - a) AS n, count(*) AS c, string_agg(substr(h, 2 * f + 1, 2 * (a - f)), '' ORDER BY a) || substr(any_value(h), 2 * max(z) + 1) AS kept FROM q JOIN h USING (doc_id) GROUP BY q.doc_id)
SELECT h.doc_id, (len(h) // 2)::BIGINT AS n_bytes, coalesce(n, 0)::BIGINT AS n_removed, coalesce(c, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256
FROM h LEFT JOIN k USING (doc_id)
"""
