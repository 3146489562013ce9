"""Operator 2: n-gram Jaccard self-join by T-occurrence search (DivideSkip).

A document is the set of its distinct five-word shingles; two link when their sets' Jaccard similarity is
at least 0.8.  Equal sets are one class from the start.  Routing: in one global order of all shingles, two
linked sets share one of the first n - ceil(0.8 n) + 1 of each (the ``prefix``).  The order puts shingles of
a single class first, then shared ones by rarity: a class whose prefix is filled by shingles of its own is
done, and the others give only the few shared shingles that their prefix reaches.  Classes that share one are
chained, and the chains' connected components are the blocks.  Inside a block every
class queries the block's inverted index: the lists of its shingles are divided into the longest and the
rest, the short ones merged by a heap that skips what cannot reach the count, and ids that occur often enough are
looked up in the long ones by binary search, which leaves exactly the sets with the required overlap.

Blocks over ``block_shingles`` or ``block_sets`` are cut into chunks, and every pair of chunks is searched by a task
of its own, so memory stays bounded and no link is lost.  A block of more than ``most_chunks`` chunks (chains merge
as data grows) is divided by prefix shingle instead: a class goes to the group of each shared shingle of its
prefix, and two classes are compared where the smallest shingle that both prefixes share has its group.  Near copies
of one text share many such shingles, each of which would send them all again; where it sends less, those that
shingles of more than one chunk tie together (a ``crowd``) are compared in pairs of the crowd's chunks, once, and
a shingle's group leaves out pairs of one crowd.  Of shingles that the same classes share one has a group.  A block whose own pairs of chunks send less than that is not divided.

Shingles are equal if 64-bit hashes of them are, sets if two such hashes of the whole set are.

Numbers of classes are exact for a fixed share of the shingles (COUNTED_SHARE, by hash); frequent ones, by a
sketch of the counts over all documents (a table of fixed size), and the rest come last in the order.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from . import textkernel as tk
from .common import doc_columns, map_text, materialize, slots, small, workers_see_package
from .graph import components

U64 = np.uint64
#: Counters of the frequency sketch; 8 bytes each reach the driver and every task.
SKETCH = 1 << 16
#: Share of the shingles, by hash, whose classes are counted. A class that shares fewer than 1 - 0.2 / 0.35 of them routes nothing.
COUNTED_SHARE = 0.35
_STEP = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], U64)
#: Weight of long lists in DivideSkip's choice of how many to set aside.
MU = 0.0085


def shingles(buf: np.ndarray, offs: np.ndarray, width: int = 5) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text: ASCII letters lower-cased, words between ASCII white space."""
    low = tk.LOWER[buf]
    starts, ends, first = tk.words(low, offs)
    if len(starts) == 0:
        return [np.zeros(0, U64)] * (len(offs) - 1)
    w = tk.span_hashes(low, starts, ends)
    n = max(len(w) - width + 1, 0)
    g = np.full(n, U64(width))
    for k in range(width):
        g += w[k : k + n] * _STEP[k % len(_STEP)]
    g = tk.mix(g)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= width:
            out.append(np.unique(g[a : b - width + 1]))
        elif b > a:
            h = np.array([b - a], U64)
            for k in range(b - a):
                h += w[a + k : a + k + 1] * _STEP[k % len(_STEP)]
            out.append(tk.mix(h))
        else:
            out.append(np.zeros(0, U64))
    return out


def frequency_levels(docs: DataFrame, width: int) -> np.ndarray:
    """For each counter of the sketch 0 if it holds no more than chance puts there, else how many doublings more (at most 31)."""

    def count(batches):
        total = np.zeros(SKETCH, np.int64)
        for batch in batches:
            buf, offs = tk.batch_text(batch.column(0))
            for lo, hi in tk.slices(offs):
                sets = shingles(buf[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo], width)
                total += np.bincount((np.concatenate(sets) & U64(SKETCH - 1)).astype(np.int64), minlength=SKETCH)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["at", "n"])

    workers_see_package(docs.sparkSession)
    rows = docs.select("text").mapInArrow(count, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    n = np.zeros(SKETCH)
    n[rows.column(0).to_numpy()] = rows.column(1).to_numpy()
    usual = np.median(n)
    return np.clip(np.ceil(np.log2(np.maximum(n, 1) / (usual + 8 * np.sqrt(usual) + 16))), 0, 31).astype(np.uint8)


def keyed(h: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """Shingles as sorted keys: frequency level in the top bits, then the hash; rare ones come first."""
    return np.sort((levels[(h & U64(SKETCH - 1)).astype(np.int64)].astype(U64) << U64(58)) | (h >> U64(6)))


def counted(h: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """Shingles whose number of classes is counted exactly: a fixed share of all hashes, without those the sketch calls frequent."""
    return (h < U64(int(COUNTED_SHARE * 2**64))) & (levels[(h & U64(SKETCH - 1)).astype(np.int64)] == 0)


def _set_hash(h: np.ndarray) -> tuple[int, int]:
    with np.errstate(over="ignore"):
        a, b = tk.mix(np.array([h.sum() + U64(len(h)), tk.mix(h ^ _STEP[1]).sum()], U64))
    return int(a.astype(np.int64)), int(b.astype(np.int64))


def _lists(parts: list[np.ndarray]) -> pa.ListArray:
    edge = np.concatenate(([0], np.cumsum([len(x) for x in parts]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(edge), pa.array(np.concatenate(parts).view(np.int64) if parts else np.zeros(0, np.int64)))


def frequent_ids(ids: list[int], spans: list[tuple[int, int]], need: int) -> Iterator[tuple[int, int]]:
    """Numbers that stand in at least ``need`` of the ascending runs ``ids[a:b]``, with their counts: a merge by a heap
    of the runs' first numbers, which skips whatever fewer than ``need`` runs can hold."""
    heads = [(ids[a], a, b) for a, b in spans if a < b]
    heapify(heads)
    while len(heads) >= need:
        low, out = heads[0][0], []
        while heads and heads[0][0] == low:
            out.append(heappop(heads))
        if len(out) >= need:
            yield low, len(out)
            to = low + 1
        else:
            while heads and len(out) < need - 1:
                out.append(heappop(heads))
            if not heads:
                return
            to = heads[0][0]
        for _, a, b in out:
            a = bisect_left(ids, to, a, b)
            if a < b:
                heappush(heads, (ids[a], a, b))


class Index:
    """Inverted index over the sets of a block, which are numbered by ascending size."""

    def __init__(self, sets: list[np.ndarray]):
        self.size = np.array([len(s) for s in sets])
        self.tokens, at = np.unique(np.concatenate(sets), return_inverse=True)
        owner = np.repeat(np.arange(len(sets)), self.size)
        order = np.argsort(at, kind="stable")
        self.ids = owner[order]
        self.listed = self.ids.tolist()
        self.edge = np.concatenate(([0], np.cumsum(np.bincount(at, minlength=len(self.tokens)))))

    def search(self, query: np.ndarray, percent: int, after: int | None) -> np.ndarray:
        """Ids whose set has with ``query`` a Jaccard similarity of at least percent / 100; with ``after``, only larger ids (of sets at least as large)."""
        n = len(query)
        need = -(-2 * percent * n // (100 + percent)) if after is not None else -(-percent * n // 100)
        t = np.searchsorted(self.tokens, query)
        t[t == len(self.tokens)] = 0
        t = t[self.tokens[t] == query]
        if len(t) < need:
            return np.zeros(0, np.int64)
        lens = self.edge[t + 1] - self.edge[t]
        t = t[np.argsort(lens, kind="stable")]
        aside = min(int(need / (MU * np.log2(max(int(lens.max()), 2)) + 1)), need - 1)
        short, long = t[: len(t) - aside], t[len(t) - aside :]
        spans = list(zip(self.edge[short].tolist(), self.edge[short + 1].tolist(), strict=True))
        if after is not None:
            spans = [(bisect_left(self.listed, after + 1, a, b), b) for a, b in spans]
        pairs = list(frequent_ids(self.listed, spans, need - aside))
        if not pairs:
            return np.zeros(0, np.int64)
        found, count = np.array(pairs).T
        fits = (100 * self.size[found] >= percent * n) & (100 * n >= percent * self.size[found])
        found, count = found[fits], count[fits]
        for k in long:
            if len(found) == 0:
                break
            one = self.ids[self.edge[k] : self.edge[k + 1]]
            at = np.searchsorted(one, found)
            at[at == len(one)] = 0
            count = count + (one[at] == found)
        return found[100 * count >= percent * (n + self.size[found] - count)]


def search_block(reps: np.ndarray, weights: np.ndarray, side: np.ndarray, sets: list[np.ndarray], percent: int, key: int | None = None, prefixes: list[np.ndarray] | None = None, homes: np.ndarray | None = None) -> tuple[list, list]:
    """Links of one task as a spanning forest of edges, and for each class the documents in the classes it links to.

    side: 0 everywhere for a search of a chunk in itself, else 1 and 2 for the two chunks.  With ``key``, only pairs
    of different ``homes`` whose smallest common entry of ``prefixes`` (sorted) is that key.
    """
    order = np.lexsort((reps, [len(s) for s in sets]))
    reps, weights, side, sets = reps[order], weights[order], side[order], [sets[i] for i in order]
    if key is not None:
        prefixes, homes = [prefixes[i] for i in order], homes[order]
    parent = np.arange(len(reps))

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    within = side[0] == 0
    left = np.arange(len(reps)) if within else np.flatnonzero(side == 1)
    right = left if within else np.flatnonzero(side == 2)
    if len(left) == 0 or len(right) == 0:
        return [], []
    index, links, edges = Index([sets[i] for i in right]), np.zeros(len(reps), np.int64), []
    for k, q in enumerate(left):
        found = right[index.search(sets[q], percent, k if within else None)]
        found = found[reps[found] != reps[q]]
        if key is not None:
            found = found[homes[found] != homes[q]]
        if key is not None and len(found):
            # The key is in both; an earlier one in common means that another group has the pair.
            before = prefixes[q][: np.searchsorted(prefixes[q], key)]
            found = found[[not np.isin(prefixes[f][: np.searchsorted(prefixes[f], key)], before).any() for f in found]]
        links[q] += weights[found].sum()
        np.add.at(links, found, weights[q])
        for r in found:
            a, b = root(q), root(r)
            if a != b:
                parent[a] = b
                edges.append((int(reps[q]), int(reps[r])))
    return edges, [(int(reps[i]), int(links[i])) for i in np.flatnonzero(links)]


def chunk_count(shingles: int, sets: int) -> Column:
    """Chunks of a group of classes, of at most about so many shingles and sets each."""
    return F.ceil(F.greatest(F.sum("n") / shingles, F.count("*") / sets)).cast("int").alias("chunks")


def crowds(keys: DataFrame, chunks: Column, broadcast_rows: int) -> DataFrame:
    """rep, home, chunks of the classes whose pairs are compared by crowd. ``keys``: rep, n, key, once each.

    A crowd: classes tied together by keys of more than one chunk. It stands where its pairs of chunks send no more
    shingles than those keys' would; home is its smallest class.
    """
    groups = keys.groupBy("key").agg(chunks, F.min("rep").alias("first")).where("chunks > 1")
    held = materialize(keys.join(small(materialize(groups), broadcast_rows), "key").select("rep", "n", "chunks", "first"))
    roots = components(held.where("rep <> first").select(F.col("rep").alias("a"), F.col("first").alias("b")))
    members = held.groupBy("rep").agg(F.max("n").alias("n"), F.sum("chunks").alias("times")).join(roots.withColumnRenamed("node", "rep"), "rep", "left")
    members = materialize(members.select("rep", "n", "times", F.coalesce("root", "rep").alias("home")))
    sent = members.groupBy("home").agg(chunks, F.sum("n").alias("all"), F.sum(F.col("n") * F.col("times")).alias("by_key")).where("chunks * all <= by_key")
    return materialize(members.join(small(materialize(sent.select("home", "chunks")), broadcast_rows), "home").select("rep", "home", "chunks"))


def shingle_groups(keys: DataFrame, chunks: Column) -> DataFrame:
    """key, chunks of the groups in which classes of different homes are compared. ``keys``: rep, n, key, home, once each.

    Of keys that the same classes share, only the smallest has a group: a pair is compared at the smallest key of both, and a
    smaller one of the same classes would be in both as well. Sets of classes are equal if 128 bits of two sums of hashes are.
    """
    total = lambda seed: F.sum(F.xxhash64("rep", F.lit(seed)).cast("decimal(20,0)"))
    groups = keys.groupBy("key").agg(chunks, (F.min("home") < F.max("home")).alias("mixed"), F.count("*").alias("size"), total(1).alias("t1"), total(2).alias("t2")).where("mixed")
    return groups.groupBy("size", "t1", "t2").agg(F.min("key").alias("key"), F.first("chunks").alias("chunks")).select("key", "chunks")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, block_shingles: int = 400_000, block_sets: int = 400, most_chunks: int = 16, broadcast_rows: int = 1_000_000, with_hashes: bool = False) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable by links), n_links of every row.

    A text of fewer than ``width`` words is one shingle; a text without words, or null, has none, links with
    nothing and is its own component.  A row without doc_id keeps component_id null and links with nothing.
    Repeated rows share their class.  Rows of one doc_id with unequal texts count as one document, which has the links
    of all of them.  Texts of any length are read whole.  An empty table gives no rows; other columns are ignored.
    n_links counts linked rows, equal sets included.  with_hashes: also s1 and s2, two hashes of the set.
    """
    spark = docs.sparkSession
    docs = doc_columns(docs, "doc_id", "text")
    levels = frequency_levels(docs, width)
    n = slots(spark)
    workers_see_package(spark)

    def sign(batch, buf, offs):
        sets = shingles(buf, offs, width)
        hashes = [_set_hash(h) for h in sets]
        known = [int(counted(h, levels).sum()) for h in sets]
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in ([len(h) for h in sets], [a for a, _ in hashes], [b for _, b in hashes], known))], names=["doc_id", "n", "s1", "s2", "known"])

    signed = materialize(map_text(docs, "doc_id long, n long, s1 long, s2 long, known long", sign))
    linkable = signed.where("n > 0 AND doc_id IS NOT NULL")
    classes = materialize(linkable.groupBy("s1", "s2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("w"), F.first("n").alias("n"), F.first("known").alias("known")))

    # 1. The counted shingles of each class; those of two classes or more come back with their number.
    def counted_keys(batch, buf, offs):
        kept = [keyed(h[counted(h, levels)], levels) for h in shingles(buf, offs, width)]
        rep = np.repeat(batch.column(0).to_numpy(), [len(k) for k in kept])
        yield pa.RecordBatch.from_arrays([pa.array(rep), pa.array(np.concatenate(kept).view(np.int64))], names=["rep", "key"])

    copies = materialize(linkable.join(classes.where("w > 1").select("s1", "s2", "rep"), ["s1", "s2"]).where("doc_id <> rep").select("doc_id").join(classes.select(F.col("rep").alias("doc_id")), "doc_id", "left_anti"))
    unequal = docs.where("doc_id IS NOT NULL").join(small(copies, broadcast_rows), "doc_id", "left_anti")
    keys = map_text(unequal, "rep long, key long", counted_keys).repartition(n, "key").sortWithinPartitions("key")

    def shared_keys(batches):
        open_rep, open_key = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            if batch.num_rows == 0:
                continue
            rep, key = np.append(open_rep, batch.column(0).to_numpy()), np.append(open_key, batch.column(1).to_numpy())
            cut = np.searchsorted(key, key[-1])
            yield runs(rep[:cut], key[:cut])
            open_rep, open_key = rep[cut:], key[cut:]
        yield runs(open_rep, open_key)

    def runs(rep, key):
        head = np.flatnonzero(np.concatenate((np.ones(min(len(key), 1), bool), key[1:] != key[:-1])))
        df = np.repeat(np.diff(np.append(head, len(key))), np.diff(np.append(head, len(key))))
        k = df > 1
        return pa.RecordBatch.from_arrays([pa.array(rep[k]), pa.array(key[k]), pa.array(df[k].astype(np.int32))], names=["rep", "key", "df"])

    shared = materialize(keys.mapInArrow(shared_keys, "rep long, key long, df int"))

    # 2. Prefix: unshared counted shingles first, then shared ones by rarity, then all others. A class whose
    #    unshared ones fill its prefix links with nothing.
    met = shared.groupBy("rep").agg(F.count("*").alias("met"))
    prefix = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1
    open_classes = materialize(classes.join(met, "rep", "left").withColumn("met", F.coalesce("met", F.lit(0)))
        .withColumn("need", (prefix - (F.col("known") - F.col("met"))).cast("int")).where("need > 0").select("rep", "s1", "s2", "w", "n", "need", (F.col("need") - F.col("met")).cast("int").alias("others")))
    order = Window.partitionBy("rep").orderBy("df", "key")
    rare = shared.join(small(open_classes.select("rep", "need"), broadcast_rows), "rep").withColumn("at", F.row_number().over(order)).where("at <= need").select("key", "rep")

    def full(batch, buf, offs):
        sets = shingles(buf, offs, width)
        hashes = [_set_hash(h) for h in sets]
        rest = [keyed(h[~counted(h, levels)], levels)[: max(k, 0)] for h, k in zip(sets, batch.column(2).to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([a for a, _ in hashes], pa.int64()), pa.array([b for _, b in hashes], pa.int64()), pa.array([h.tobytes() for h in sets], pa.binary()), _lists(rest)], names=["rep", "s1", "s2", "members", "rest"])

    wanted = docs.join(small(open_classes.select(F.col("rep").alias("doc_id"), "others"), broadcast_rows), "doc_id").select("doc_id", "text", "others")
    full_schema = "rep long, s1 long, s2 long, members binary, rest array<long>"
    sets = map_text(wanted, full_schema, full).join(small(open_classes.drop("others", "need"), broadcast_rows), ["rep", "s1", "s2"])
    sets = materialize(sets)
    # Keys of a frequent shingle are dealt out by a salt, and the parts' first members chained in a second step.
    salt = F.when(F.shiftrightunsigned("key", 58) > 0, F.pmod(F.xxhash64("rep"), F.lit(64))).otherwise(F.lit(0)).cast("int")
    routes = rare.unionByName(sets.select("rep", F.explode("rest").alias("key"))).withColumn("salt", salt)

    def chain(batches):
        last = None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            key, part, rep = (batch.column(i).to_numpy() for i in range(3))
            if last is not None:
                key, part, rep = np.append(last[0], key), np.append(last[1], part), np.append(last[2], rep)
            same = (key[1:] == key[:-1]) & (part[1:] == part[:-1])
            new = np.flatnonzero(~same) + 1
            if last is None:
                new = np.append(0, new)
            new = new[(key[new].view(U64) >> U64(58)) > 0]
            same = np.flatnonzero(same & (rep[1:] != rep[:-1]))
            last = key[-1:], part[-1:], rep[-1:]
            none = pa.nulls(len(new), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(rep[same]), pa.array(rep[same + 1]), pa.nulls(len(same), pa.int64())], names=["a", "b", "key"])
            yield pa.RecordBatch.from_arrays([pa.array(rep[new]), none, pa.array(key[new])], names=["a", "b", "key"])

    linked = routes.select("key", "salt", "rep").repartition(n, "key", "salt").sortWithinPartitions("key", "salt", "rep").mapInArrow(chain, "a long, b long, key long")
    linked = materialize(linked.groupBy("a", "b", "key").count().drop("count"))
    heads = linked.where("b IS NULL")
    firsts = heads.groupBy("key").agg(F.min("a").alias("b"))
    block = components(linked.where("b IS NOT NULL").select("a", "b").unionByName(heads.select("key", "a").join(firsts, "key").select("a", "b")))
    block = block.unionByName(block.select(F.col("root").alias("node"), "root").distinct()).withColumnsRenamed({"node": "rep", "root": "block"})

    # 3. Blocks, in chunks where they are large; by prefix shingle where they are too large for that.
    routed = materialize(open_classes.select("rep", "n").join(block, "rep"))
    sets = sets.join(small(routed.select("rep", "block"), broadcast_rows), "rep").dropDuplicates(["s1", "s2"]).select("rep", "w", "block", "members")
    chunks, none = chunk_count(block_shingles, block_sets), F.lit(None)
    whole = [none.cast("long").alias("key"), none.cast("array<long>").alias("prefix"), none.cast("long").alias("home")]
    sizes = routed.groupBy("block").agg(chunks)
    cut = materialize(sizes.where("chunks > 1"))
    sets = sets.join(small(cut, broadcast_rows), "block", "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    columns = ["block", "key", "chunks", "rep", "w", "members", "prefix", "home"]
    tasks = sets.where(F.col("chunks") <= most_chunks).select("block", "chunks", "rep", "w", "members", *whole).select(*columns)
    huge = cut.where(F.col("chunks") > most_chunks).select("block")
    if not huge.isEmpty():
        inside = materialize(routed.join(small(huge, broadcast_rows), "block").groupBy("rep", "block").agg(F.max("n").alias("n")))
        keys_of = materialize(routes.select("rep", "key").distinct().join(small(inside.drop("block"), broadcast_rows), "rep"))
        crowded = crowds(keys_of, chunks, broadcast_rows)
        keys_of = materialize(keys_of.join(small(crowded.select("rep", "home"), broadcast_rows), "rep", "left").withColumn("home", F.coalesce("home", "rep")))
        groups = materialize(shingle_groups(keys_of, chunks))
        prefix = keys_of.groupBy("rep").agg(F.array_sort(F.collect_list("key")).alias("prefix"))
        spread = keys_of.join(small(groups, broadcast_rows), "key").select("rep", "key", "home", "chunks")
        sends = spread.select("rep", "chunks").unionByName(crowded.select("rep", "chunks")).groupBy("rep").agg(F.sum("chunks").alias("times"))
        cost = inside.join(sends, "rep", "left").groupBy("block").agg(chunks, F.sum("n").alias("all"), F.coalesce(F.sum(F.col("n") * F.col("times")), F.lit(0)).alias("divided"))
        undivided = materialize(cost.where("chunks * all <= divided").select("block"))
        large = sets.where(F.col("chunks") > most_chunks)
        tasks = tasks.unionByName(large.join(small(undivided, broadcast_rows), "block", "left_semi").select("block", "chunks", "rep", "w", "members", *whole).select(*columns))
        large = large.drop("chunks").join(small(undivided, broadcast_rows), "block", "left_anti")
        tasks = tasks.unionByName(large.join(prefix, "rep").join(spread, "rep").select(*columns))
        tasks = tasks.unionByName(large.join(small(crowded, broadcast_rows), "rep").select(F.col("home").alias("block"), "chunks", "rep", "w", "members", *whole).select(*columns))
    mine = F.pmod(F.xxhash64("rep"), F.col("chunks")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda k: F.struct(F.least(mine, k).alias("i"), F.greatest(mine, k).alias("j"), F.when(k == mine, 0).when(mine < k, 1).otherwise(2).alias("side")))
    tasks = tasks.withColumn("p", F.explode(pairs)).select("block", "key", "p.i", "p.j", "rep", "w", "p.side", "members", "prefix", "home")

    def search(batches):
        held: list = []

        def flush():
            reps, w, side = (np.array([r[k] for r in held]) for k in (1, 2, 3))
            by_key = [] if held[0][5] is None else [held[0][0][1], [np.array(r[5]) for r in held], np.array([r[6] for r in held])]
            edges, links = search_block(reps, w, side, [np.frombuffer(r[4], U64) for r in held], percent, *by_key)
            rows = [(a, b, 0) for a, b in edges] + [(a, None, k) for a, k in links]
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(3)], names=["a", "b", "links"])

        for batch in batches:
            cols = [batch.column(i).to_pylist() for i in range(10)]
            for block, key, i, j, rep, w, side, members, prefix, home in zip(*cols, strict=True):
                if held and held[0][0] != (block, key, i, j):
                    yield flush()
                    held = []
                held.append(((block, key, i, j), rep, w, side, members, prefix, home))
        if held:
            yield flush()

    by = ["block", "key", "i", "j"]
    found = materialize(tasks.repartition(n, *by).sortWithinPartitions(*by).mapInArrow(search, "a long, b long, links long"))
    roots = components(found.where("b IS NOT NULL").select("a", "b"))
    links = found.where("b IS NULL").groupBy(F.col("a").alias("rep")).agg(F.sum("links").alias("links"))
    named = classes.join(links, "rep", "left").where("w > 1 OR links IS NOT NULL").join(roots.withColumnRenamed("node", "rep"), "rep", "left")
    named = materialize(named.select("s1", "s2", F.coalesce("root", "rep").alias("component_id"), (F.coalesce("links", F.lit(0)) + F.col("w") - 1).alias("n_links")))
    out = signed.join(small(named, broadcast_rows), ["s1", "s2"], "left")
    alone = F.col("component_id").isNull() | F.col("doc_id").isNull() | (F.col("n") == 0)
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(alone, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), F.when(alone, 0).otherwise(F.col("n_links")).cast("long").alias("n_links"), *(["s1", "s2"] if with_hashes else []))


def drop_near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """One row of each component stays, that of the smallest doc_id, with the columns of ``docs``, whatever their names.

    Rows without doc_id stay, and so do rows without words.  Rows that repeat a doc_id go together where their texts
    have equal sets; where they have not, all of them stay.
    """
    # Few enough rows stay in a component of their own to need no look-up: only those that go are joined.
    found = near_duplicates(docs, with_hashes=True, **options)
    ids = found.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("component_id").alias("least"), *[f("s" + k).alias(g + k) for k in "12" for f, g in ((F.min, "low"), (F.max, "high"))])
    gone = materialize(ids.where("doc_id <> least AND low1 = high1 AND low2 = high2").select("doc_id"))
    return docs.join(small(gone, 1_000_000), "doc_id", "left_anti").select(*docs.columns)


ORACLE = """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 80 * (a.n + b.n - c)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r(doc_id, root) AS (SELECT x, x FROM e UNION SELECT e.y, r.root FROM r JOIN e ON e.x = r.doc_id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(min(r.root), d.doc_id) AS component_id, (SELECT count(*) FROM e WHERE e.x = d.doc_id) AS n_links
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN r USING (doc_id) GROUP BY d.doc_id, n.n
"""
