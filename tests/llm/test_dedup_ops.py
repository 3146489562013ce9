import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from folioflow.llm import exact_dedup, graph, ngram_join, registry, suffix_dedup

from .helpers import docs


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def shingles(t):
    w = words(t)
    return frozenset([tuple(w)] if 0 < len(w) < 5 else [tuple(w[i : i + 5]) for i in range(len(w) - 4)])


def brute_near(rows):
    sets = {i: shingles(t) for i, t in rows}
    comp, links, ids = {i: i for i in sets}, dict.fromkeys(sets, 0), sorted(sets)

    def root(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                k = len(sets[a] & sets[b])
                if 100 * k >= 80 * (len(sets[a]) + len(sets[b]) - k):
                    links[a] += 1
                    links[b] += 1
                    x, y = root(a), root(b)
                    comp[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i), links[i]) for i in ids}


def near_rows():
    r = random.Random(5)
    vocab = [f"w{i}" for i in range(400)]
    out = []
    passage = [r.choice(vocab) for _ in range(60)]
    for _ in range(12):
        base = [r.choice(vocab) for _ in range(r.randint(3, 160))]
        for _ in range(r.randint(1, 7)):
            w = list(base)
            for _ in range(r.randint(0, 4)):
                w[r.randrange(len(w))] = r.choice(vocab)
            out.append(" ".join(w))
        out.append(" ".join([r.choice(vocab) for _ in range(r.randint(1, 150))] + passage))
    out += ["", None, " \n", "A B c", "a b C", "a b", "one two three four five", "ONE two three four five"]
    r.shuffle(out)
    return list(enumerate(out))


@pytest.mark.parametrize("shingles,sets,chunks,few", [(400_000, 400, 16, 1_000_000), (300, 400, 16, 5), (400_000, 2, 1, 1_000_000), (300, 3, 0, 5)])
def test_near_duplicates_equal_brute_force(spark, shingles, sets, chunks, few):
    rows = near_rows()
    got = ngram_join.near_duplicates(docs(spark, rows), block_shingles=shingles, block_sets=sets, most_chunks=chunks, broadcast_rows=few)
    assert {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in got.collect()} == brute_near(rows)


def test_near_copies_in_a_huge_block_are_sent_once_a_chunk(spark, monkeypatch):
    """Forty near copies in twenty chunks, tied to other texts by passages: every link, and no copy for each shingle they share."""
    r, sent = random.Random(7), []
    word = lambda: f"w{r.randrange(4000)}"
    base, passage = [word() for _ in range(100)], [word() for _ in range(60)]
    rows = near_rows()
    copies = [base[:k] + [word() for _ in range(r.randint(1, 3))] + base[k + 2 :] for k in r.sample(range(98), 40)]
    tied = [base[:50] + passage, *[passage + [word() for _ in range(k)] for k in range(1, 9)]]
    rows += [(len(rows) + k, " ".join(w)) for k, w in enumerate(copies + tied)]
    plain = type(spark.range(0)).mapInArrow
    monkeypatch.setattr(type(spark.range(0)), "mapInArrow", lambda self, *a, **b: ("members" in self.columns and sent.append(self.count()), plain(self, *a, **b))[1])
    got = ngram_join.near_duplicates(docs(spark, rows), block_sets=2, most_chunks=1)
    assert {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in got.collect()} == brute_near(rows)
    assert len(sent) == 1 and sent[0] < 40 * 20 * 3


def test_near_duplicates_odd_rows(spark):
    got = ngram_join.near_duplicates(docs(spark, [(3, "a b c"), (3, "a b c"), (1, "a b c"), (None, "a b c"), (7, None), (8, "x")])).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == sorted([(3, 1, 1), (3, 1, 1), (1, 1, 1), (None, 1, None), (7, 0, 7), (8, 1, 8)], key=str)
    assert ngram_join.near_duplicates(docs(spark).limit(0)).count() == 0
    kept = ngram_join.drop_near_duplicates(docs(spark, [(3, "a b c"), (1, "A b c"), (7, None), (None, "a b c")]))
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == [(False, 1), (False, 7), (True, 0)]
    assert kept.columns == docs(spark).columns


def test_rows_of_one_id_with_unequal_texts(spark):
    a, b = " ".join(f"w{i}" for i in range(60)), " ".join(f"v{i}" for i in range(60))
    rows = docs(spark, [(3, a), (5, a + " x"), (5, b), (7, b + " y"), (8, "alone here"), (8, "alone here")])
    assert sorted((r.doc_id, r.component_id) for r in ngram_join.near_duplicates(rows).collect()) == [(3, 3), (5, 3), (5, 3), (7, 3), (8, 8), (8, 8)]
    assert sorted(r.doc_id for r in ngram_join.drop_near_duplicates(rows).collect()) == [3, 5, 5, 8, 8]


def test_heap_merge_equals_counting():
    r = random.Random(8)
    for _ in range(200):
        runs = [sorted(r.sample(range(30), r.randint(0, 12))) for _ in range(r.randint(1, 9))]
        ids, spans = [], []
        for x in runs:
            spans.append((len(ids), len(ids) + len(x)))
            ids += x
        need = r.randint(1, 6)
        want = [(k, c) for k in range(30) if (c := sum(k in x for x in runs)) >= need]
        assert list(ngram_join.frequent_ids(ids, spans, need)) == want


def test_components_of_a_chain(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 90), (95, 90)], "a long, b long")
    got = {r.node: r.root for r in graph.components(chain).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, 95: 90, 100: 90}
    assert graph.components(chain.limit(0)).count() == 0


def test_exact_dedup(spark):
    rows = [(1, "a"), (2, "a"), (2, "a"), (3, "b"), (4, None), (5, ""), (6, "x" * 300 + "1"), (7, "x" * 300 + "2"), (8, "x" * 300 + "1"), (None, "a"), (None, "lonely")]
    for few, bits in ((1_000_000, exact_dedup.FILTER_BITS), (0, exact_dedup.ROW_BITS), (0, exact_dedup.FILTER_BITS)):
        decided, names = exact_dedup.decide(docs(spark, rows), broadcast_rows=few, filter_bits=bits)
        got = sorted((tuple(r) for r in decided.select("doc_id", *names[:3]).collect()), key=str)
        want = [(1, 2, 4, False), (2, 2, 4, True), (2, 2, 4, False), (3, 3, 1, True), (4, 5, 2, False), (5, 5, 2, True), (6, 8, 2, False), (7, 7, 1, True), (8, 8, 2, True), (None, 2, 4, False), (None, None, 1, True)]
        assert got == sorted(want, key=str)
    one = {r.doc_id: r.text_sha256 for r in exact_dedup.exact_dedup(docs(spark, [(1, "é"), (2, None)])).collect()}
    assert one == {1: hashlib.sha256("é".encode()).hexdigest(), 2: hashlib.sha256(b"").hexdigest()}
    kept = exact_dedup.drop_copies(docs(spark, rows))
    assert kept.columns == docs(spark).columns and kept.count() == 6
    assert exact_dedup.exact_dedup(docs(spark).limit(0)).count() == 0


def test_only_rows_that_may_have_a_copy_are_hashed(spark):
    """The filter passes what shares length and first characters; one bit a row for all others."""
    rows = docs(spark, [(i, f"text {i:04d}") for i in range(300)] + [(900, "text 0007"), (901, "x" * 300 + "1"), (902, "x" * 300 + "2")])
    bits = exact_dedup.survivors(rows)
    got = exact_dedup.hashed(rows, bits, "sha").where("sha IS NOT NULL")
    assert sorted(r.doc_id for r in got.collect()) == [7, 900, 901, 902]


def test_no_plan_hashes_the_whole_text_of_a_lone_row(spark):
    """The only expression that reads whole texts is the SHA-256 behind the filter's test."""
    plan = exact_dedup.drop_copies(docs(spark))._jdf.queryExecution().optimizedPlan().toString()
    for part in re.findall(r"(?:xxhash64|sha2)\((?:[^()]|\([^()]*\))*\)", plan):
        assert part.startswith("sha2") or "substring" in part or "len" in part or "text" not in part, part
    assert re.search(r"CASE WHEN .*sha2\(", plan)


def test_dropping_stands_columns_of_any_name(spark):
    rows = docs(spark, [(1, "same text"), (2, "same text"), (3, "other")]).withColumns({n: F.lit(n) for n in ("__keep", "__size", "__sha", "___sha", "__row", "__bits", "__key", "s1", "s2", "rep", "key", "block")})
    kept = exact_dedup.drop_copies(rows)
    assert kept.columns == rows.columns and sorted((r.doc_id, r["__sha"]) for r in kept.collect()) == [(2, "__sha"), (3, "__sha")]
    near = ngram_join.drop_near_duplicates(rows)
    assert near.columns == rows.columns and sorted(r.doc_id for r in near.collect()) == [1, 3]


def brute_repeats(rows, width=50):
    seen, out = {}, {}
    for i, t in sorted(rows):
        b = (t or "").encode()
        gone = bytearray(len(b))
        mine = [b[p : p + width] for p in range(len(b) - width + 1)]
        for p, w in enumerate(mine):
            if seen.get(w, i) < i:
                gone[p : p + width] = b"\1" * width
        for w in mine:
            seen.setdefault(w, i)
        runs = len(re.findall(b"\1+", bytes(gone)))
        out[i] = (len(b), sum(gone), runs, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest())
    return out


def repeat_rows():
    r = random.Random(9)
    letters = "abcdefghij éß\n"
    text = lambda n: "".join(r.choice(letters) for _ in range(n))
    shared = [text(n) for n in (45, 49, 50, 51, 60, 90, 400)]
    out = ["", None, "a" * 500, "a" * 120, "ab" * 100, text(49), text(50)]
    for _ in range(50):
        out.append("".join(r.choice([text(r.randint(0, 120)), r.choice(shared), r.choice(shared)[r.randint(0, 20) :]]) for _ in range(r.randint(1, 5))))
    out += [out[10], out[12], out[12] + "tail", "head" + out[12]]
    return list(enumerate(out))


@pytest.mark.parametrize("few", [1_000_000, 0])
def test_repeats_equal_brute_force(spark, few, monkeypatch):
    rows = repeat_rows()
    got = suffix_dedup.remove_repeats(docs(spark, rows), broadcast_rows=few, with_text=True).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == brute_repeats(rows)
    assert all(hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 and len(r.kept) == r.n_bytes - r.n_removed for r in got)


@pytest.mark.parametrize("few", [1_000_000, 0])
def test_repeats_with_thousands_of_buckets_in_few_ranges_and_tasks(spark, few, monkeypatch):
    """Tasks and splitters stay at their bounds while buckets grow; a task takes many buckets, a range many parts."""
    rows = repeat_rows()
    monkeypatch.setattr(suffix_dedup, "MOST_RANGES", 7)
    monkeypatch.setattr(suffix_dedup, "MOST_TASKS", 5)
    size = sum(len((t or "").encode()) for _, t in rows)
    n, ranges, parts, tasks = suffix_dedup.plan(size, 1)
    assert n >= size > 10_000 and ranges == 7 and parts == n // 7 and tasks == 5
    got = suffix_dedup.remove_repeats(docs(spark, rows, extra=False), broadcast_rows=few, bucket_bytes=1).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == brute_repeats(rows)


def test_plan_of_a_hundred_terabytes_is_bounded():
    n, ranges, parts, tasks = suffix_dedup.plan(100 << 40, suffix_dedup.BUCKET_BYTES)
    assert n >= (100 << 40) // suffix_dedup.BUCKET_BYTES and n < 2**31
    assert ranges <= suffix_dedup.MOST_RANGES and tasks <= suffix_dedup.MOST_TASKS and ranges * parts == n
    assert suffix_dedup.plan(0, suffix_dedup.BUCKET_BYTES) == (8, 8, 1, 8)


def test_repeats_odd_rows(spark):
    t = "".join(random.Random(1).choice("abcdefgh") for _ in range(80))
    got = sorted(((r.doc_id, r.n_removed, r.n_spans) for r in suffix_dedup.remove_repeats(docs(spark, [(1, t), (1, t), (2, t), (None, t), (None, t), (3, None)])).collect()), key=str)
    assert got == sorted([(1, 0, 0), (1, 0, 0), (2, 80, 1), (None, 0, 0), (None, 0, 0), (3, 0, 0)], key=str)
    assert suffix_dedup.remove_repeats(docs(spark).limit(0)).count() == 0


def test_registered_queries_over_whole_tables(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    near = brute_near(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in registry.op2_ngram_join(spark, sf).collect()} == near
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in registry.op6_suffix_dedup(spark, sf).collect()} == brute_repeats(rows)


def test_repeats_of_wide_windows(spark):
    r = random.Random(4)
    shared = "".join(r.choice("abcdefgh") for _ in range(900))
    rows = [(0, shared), (1, "x" * 70 + shared), (2, shared[:330] + "y" + shared[300:])]
    for width in (24, 279, 280, 320):
        got = suffix_dedup.remove_repeats(docs(spark, rows), width=width).collect()
        assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == brute_repeats(rows, width)
    with pytest.raises(ValueError):
        suffix_dedup.remove_repeats(docs(spark, rows), width=23)


def test_shingles_of_the_same_classes_have_one_group(spark):
    """Two near copies share dozens of prefix shingles; each of them sent both again."""
    rows = [(r, 10, k, r) for k in range(20, 30) for r in (1, 2)] + [(r, 10, k, r) for k in (15, 25) for r in (3, 4)] + [(r, 10, 40, 7) for r in (5, 6)]
    keys = spark.createDataFrame(sorted(set(rows)), "rep long, n long, key long, home long")
    got = ngram_join.shingle_groups(keys, ngram_join.chunk_count(400_000, 400))
    assert sorted(r.key for r in got.collect()) == [15, 20, 25]
