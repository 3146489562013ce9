"""Operators 11 to 13 against brute force, on odd rows and, for long conversations, in chunks of a few rows."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from folioflow.llm import best_fit, conversation_repair as cr, registry, vector_codes as vc

from .helpers import docs

BYTE = P.path("byte_bpe_50k.json")


# --- 11


@pytest.mark.parametrize("kind", [np.int64, np.float64])
def test_tree_finds_the_lowest_of_the_nearest(kind):
    r = np.random.default_rng(5)
    for k, width, spread in ((1, 4, 9), (7, 3, 2), (256, 16, 3), (256, 2, 4), (200, 1, 30)):
        entries, q = r.integers(-spread, spread, (k, width)).astype(kind), r.integers(-spread, spread, (500, width)).astype(kind)
        at, d = vc.Tree(entries).nearest(q)
        all_d = ((q[:, None] - entries[None]) ** 2).sum(2)
        assert (at == all_d.argmin(1)).all() and (d == all_d.min(1)).all()
    assert len(vc.Tree(entries).nearest(q[:0])[0]) == 0


def brute_codes(rows, n_parts=4, entries=256, rounds=4):
    kept = [(i, [int(np.floor(1024 * float(x))) for x in v], label) for i, v, label in rows if v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    kept = [r for r in kept if len(r[1]) == len(kept[0][1])]
    x = np.array([r[1] for r in kept], np.int64).reshape(len(kept), n_parts, -1)
    books = [x[:entries, p].copy() for p in range(n_parts)]

    def nearest(p):
        d = ((x[:, p, None] - books[p][None]) ** 2).sum(2)
        return d.argmin(1), d.min(1)

    for _ in range(rounds):
        for p in range(n_parts):
            at, _ = nearest(p)
            for k in set(at.tolist()):
                books[p][k] = x[at == k, p].sum(0) // (at == k).sum()
    found = [nearest(p) for p in range(n_parts)]
    errors = sum(d for _, d in found)
    totals = {}
    for r, e in zip(kept, errors, strict=True):
        totals[r[2]] = totals.get(r[2], 0) + int(e)
    sha = hashlib.sha256(",".join(str(v) for b in books for v in b.ravel()).encode()).hexdigest()
    return [(r[0], "".join(f"{found[p][0][k]:02x}" for p in range(n_parts)), int(errors[k]), totals[r[2]], sha) for k, r in enumerate(kept)]


def vectors(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<float>, label int, code string, v int")


def test_codes_equal_brute_force_on_odd_rows(spark):
    r = np.random.default_rng(7)
    rows = [(i, r.normal(size=8).round(2).astype(np.float32).tolist(), [0, 1, None][i % 3]) for i in range(700)]
    nan, inf = float("nan"), float("inf")
    rows += [(-1, None, 1), (-2, [nan] + [0.0] * 7, 1), (-3, [0.0] * 7 + [inf], 1), (-4, [0.0] * 7 + [None], 1), (-5, [], 2), (9999, [1.0] * 4, 1)]
    rows += [rows[10]] * 300 + [(None, [0.5] * 8, 2), (None, [0.5] * 8, 2), (5, rows[9][1], 0), (10, [-0.0] * 8, 4)]
    random.Random(1).shuffle(rows)
    got = [tuple(x) for x in vc.vector_codes(vectors(spark, rows)).collect()]
    assert sorted(got, key=str) == sorted(brute_codes(rows), key=str)


def test_codes_of_few_rows_and_of_none(spark):
    rows = [(2, [0.25, -0.5, 3.0, 1.0], None), (1, [9.0, 0.0, 0.001, -0.001], None)]
    got = [tuple(x) for x in vc.vector_codes(vectors(spark, rows)).collect()]
    assert sorted(got) == sorted(brute_codes(rows)) and {x[2] for x in got} == {0}
    empty = vc.vector_codes(vectors(spark, []))
    assert empty.count() == 0 and empty.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    with pytest.raises(ValueError):
        vc.vector_codes(vectors(spark, [(1, [1.0] * 6, 1)]))
    with pytest.raises(ValueError):
        vc.vector_codes(vectors(spark, [(1, [1e30] * 4, 1)]))


def test_large_components_are_exact(spark):
    rows = [(i, [float((i * 7919 * (k + 1)) % 99991) - 50000 for k in range(4)], i % 2) for i in range(400)]
    got = [tuple(x) for x in vc.vector_codes(vectors(spark, rows)).collect()]
    assert sorted(got) == sorted(brute_codes(rows))


def test_labels_beyond_the_broadcast(spark):
    """One label on a third of the rows, thousands of others on one row each."""
    coded = spark.range(30000).selectExpr("id AS vec_id", "CASE WHEN id % 3 = 0 THEN -1 WHEN id = 1 THEN NULL ELSE id END AS label", "'' AS code", "id AS error")
    got = {r.vec_id: r.label_error for r in vc._with_label_error(coded).collect()}
    assert got == {i: sum(range(0, 30000, 3)) if i % 3 == 0 else i for i in range(30000)}


def test_decoded_vectors_lie_as_near_as_the_errors_say(spark, sf):
    table = spark.read.parquet(f"{sf}/embeddings.parquet")
    coded, books = vc.compress(table)
    back = {r.vec_id: np.floor(np.array(r.embedding) * 1024) for r in vc.decoded(coded, books).collect()}
    want = {r.vec_id: np.floor(np.array(r.embedding, np.float64) * 1024) for r in table.collect()}
    assert {r.vec_id: r.error for r in coded.collect()} == {k: int(((back[k] - want[k]) ** 2).sum()) for k in want}


# --- 12


def piecewise(lengths, size):
    """Best fit, one piece after another: how full each sequence gets, which ties do not change."""
    room, made = [], []
    for n in sorted(lengths, reverse=True):
        fits = [i for i, r in enumerate(room) if r >= n]
        if fits:
            i = min(fits, key=lambda i: room[i])
        else:
            i = len(room)
            room.append(size), made.append([])
        room[i] -= n
        made[i].append(n)
    return sorted(map(sum, made))


@pytest.mark.parametrize("seed", range(12))
def test_runs_place_pieces_as_best_fit_decreasing_does(seed):
    r = random.Random(seed)
    size = r.choice([1, 7, 16, 100, 1024])
    lengths = [min(size, max(1, int(r.expovariate(1 / r.choice([3, 20, 200]))))) for _ in range(r.choice([0, 1, 300, 1500]))]
    counts = {n: lengths.count(n) for n in set(lengths)}
    runs, made, order = best_fit.plan(counts, size), {}, sorted(lengths, reverse=True)
    for k, n in enumerate(order):
        first, length, sequence, each, offset = runs[np.searchsorted(runs[:, 0], k, "right") - 1]
        assert length == n
        made.setdefault(sequence + (k - first) // each, []).append((offset + (k - first) % each * n, n))
    for m in made.values():
        m.sort()
        assert [o for o, _ in m] == [sum(x for _, x in m[:i]) for i in range(len(m))] and sum(x for _, x in m) <= size
    assert sorted(sum(n for _, n in m) for m in made.values()) == piecewise(lengths, size)


def test_number_of_runs_does_not_grow_with_the_pieces():
    r = np.random.default_rng(2)
    sizes = [len(best_fit.plan({n: int(c) for n, c in zip(range(1, 1025), r.integers(1, top, 1024), strict=True)}, 1024)) for top in (10**4, 10**7, 10**10)]
    assert max(sizes) < 60_000


def test_best_fit_on_odd_rows(spark):
    rows = docs(spark)
    out = best_fit.pack(rows, BYTE, 2, max_len=64, with_ids=True).collect()
    t, crc = Tokenizer.from_file(BYTE), lambda x: zlib.crc32(np.array(x, "<u4").tobytes())
    want = sorted((r.doc_id, r.text or "") for r in rows.collect() if r.doc_id is not None)
    by_doc = {}
    for r in out:
        assert r.length == len(r.ids) and crc(r.ids) == r.ids_crc32
        by_doc.setdefault(r.doc_id, []).append(r)
    for doc, texts in itertools.groupby(want, key=lambda x: x[0]):
        ids = [t.encode(x, add_special_tokens=False).ids + [2] for _, x in texts]
        pieces = sorted(by_doc[doc], key=lambda r: r.start)
        if len(ids) == 1:
            n = len(ids[0])
            assert [r.piece for r in pieces] == list(range(len(pieces))) and sum((r.ids for r in pieces), []) == ids[0]
            assert [r.length for r in pieces] == best_fit.cut_lengths(n, 64)
        else:
            assert sum(r.length for r in pieces) == sum(map(len, ids))
    made = {}
    for r in out:
        made.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert sorted(sum(n for _, n in m) for m in made.values()) == piecewise([r.length for r in out], 64)
    assert all(o == sum(n for _, n in sorted(m)[:i]) for m in made.values() for i, (o, _) in enumerate(sorted(m)))
    whole = best_fit.sequences(best_fit.pack(rows, BYTE, 2, max_len=64, with_ids=True)).collect()
    assert len(whole) == len(made) and sum(len(r.ids) for r in whole) == sum(r.length for r in out)
    assert best_fit.pack(rows.limit(0), BYTE, 2).count() == 0


def test_registered_best_fit(spark, sf):
    t = Tokenizer.from_file(BYTE)
    n = {r.doc_id: len(t.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    out, total, made = registry.op12_best_fit(spark, sf).collect(), {}, {}
    for r in out:
        total[r.doc_id] = total.get(r.doc_id, 0) + r.length
        made.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert total == n
    assert sorted(sum(x for _, x in m) for m in made.values()) == piecewise([r.length for r in out], 1024)


# --- 13


def brute_repair(word):
    """The cheapest edits by trying every sequence of edits, up to two insertions in a row."""
    found = []

    def go(i, out, cost, labels, run):
        if i == len(word) and re.fullmatch("(s?(ua)+)?", out):
            found.append((cost, labels))
        if not re.fullmatch("s?(ua)*u?", out):
            return
        if run < 2:
            for x in "ua":
                go(i, out + x, cost + 3, labels + "I", run + 1)
        if i < len(word):
            s = word[i]
            go(i + 1, out, cost + 4, labels + "D", 0)
            if s != "x":
                late = 3 * s.isupper()
                go(i + 1, out + s.lower(), cost + late, labels + "K", 0)
                for x in "ua":
                    go(i + 1, out + x, cost + 3 + late, labels + "R", 0)

    go(0, "", 0, "", 0)
    return min(found)


def test_repairs_equal_brute_force():
    for n in range(4):
        for word in itertools.product("suaoSUAOx", repeat=n):
            word = "".join(word)
            assert cr.repair(word) == brute_repair(word), word
    r = random.Random(4)
    for _ in range(40):
        word = "".join(r.choice("suaoSUAxua") for _ in range(5))
        assert cr.repair(word) == brute_repair(word), word


def test_chunks_multiply_to_the_whole():
    r = random.Random(9)
    for _ in range(200):
        word = "".join(r.choice("suaoSUAOxuaua") for _ in range(r.randint(1, 14)))
        cut = r.randint(0, len(word))
        for p in range(4):
            whole, joined = cr.shortest(word, p), {}
            for q, (cost, labels) in cr.shortest(word[:cut], p).items():
                for to, (more, rest) in cr.shortest(word[cut:], q).items():
                    cr.better(joined, to, (cost + more, labels + rest))
            assert joined == whole


def brute_audit(rows):
    """From the contract: rows of (conv_id, turn, role, text), damaged, sorted, judged and repaired in plain Python."""
    space = " \t\n\x0b\x0c\r"
    convs = {}
    for conv, turn, role, text in rows:
        mine = convs.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        mine += [(turn, "user" if k == 4 else role, text)] * {0: 0, 3: 2}.get(k, 1)
    out = []
    for conv, mine in convs.items():
        mine.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        word, seen, n = "", set(), {"blank": 0, "duplicate": 0, "truncated": 0}
        for _, role, text in mine:
            fault = "blank" if not text.strip(space) else "duplicate" if (role, text) in seen else "truncated" if text.rstrip(space)[-1] not in ".!?" else None
            seen.add((role, text))
            if fault:
                n[fault] += 1
            initial = role[:1] if role[:1] in ("s", "u", "a") else "o"
            word += "x" if fault in ("blank", "duplicate") else initial.upper() if fault else initial
        bad = sum((a[1][:1] + b[1][:1]) not in ("su", "ua", "au") for a, b in itertools.pairwise(mine))
        cost, labels = cr.repair(word)
        left, kept = iter(mine), []
        for e in labels:
            row = None if e == "I" else next(left)
            if e == "D":
                continue
            first = kept and kept[0][0][0] == "s"
            role = row[1] if e == "K" else ["user", "assistant"][(len(kept) - bool(first)) % 2]
            kept.append((role, "" if e == "I" else row[2]))
        turns = {r[0] for r in mine} - {None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        out.append((conv, gaps, n["blank"], n["duplicate"], n["truncated"], bad, cost, labels, hashlib.sha256("\n".join(f"{a}:{b}" for a, b in kept).encode()).hexdigest()))
    return sorted(out, key=str)


def conversations(spark, rows):
    return spark.createDataFrame([(*r, "x", True) for r in rows], "conv_id long, turn long, role string, text string, symbol string, n boolean")


def odd_conversations(seed=1):
    r = random.Random(seed)
    texts = ["", " \t\n", None, "Yes.", "No", "Well!  \r\n", "Why?\x0b", "a.b", "ü.", "word " * 3000, " ", "　."]
    rows = [(c, r.choice([None, *range(-2, 9)]), r.choice(["user", "assistant", "system", "tool", "", None, "úser", "sys"]), r.choice(texts)) for c in [*range(30), None] for _ in range(r.randint(1, 12))]
    return rows + rows[20:30]


@pytest.mark.parametrize("most", [4096, 3])
def test_audit_equals_brute_force_on_odd_rows(spark, most):
    rows = odd_conversations() + [(99, k, ["user", "assistant"][k % 2], f"Text {k % 50}{'.' * (k % 3 > 0)}") for k in range(700)]
    got = cr.audit(cr.damaged(conversations(spark, rows)), most_rows=most).collect()
    assert sorted(map(tuple, got), key=str) == brute_audit(rows)


@pytest.mark.parametrize("most", [4096, 4])
def test_repaired_rows_are_those_of_the_digest(spark, most):
    convs = cr.damaged(conversations(spark, odd_conversations(3)))
    by_conv = {}
    for r in sorted(cr.repaired(convs, most_rows=most).collect(), key=lambda r: r.place):
        by_conv.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
    for r in cr.audit(convs).collect():
        assert hashlib.sha256("\n".join(by_conv.get(r.conv_id, [])).encode()).hexdigest() == r.repaired_sha256


def test_conversations_without_rows_and_empty_tables(spark):
    drop = next(t for t in range(1000) if zlib.crc32(f"5:{t}".encode()) % 20 == 0)
    got = cr.audit(cr.damaged(conversations(spark, [(5, drop, "user", "Hello.")]))).collect()
    assert [tuple(r) for r in got] == [(5, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
    got = cr.audit(cr.damaged(conversations(spark, [(5, drop, "user", "Hello.")] * 5)), most_rows=2).collect()
    assert [tuple(r)[:8] for r in got] == [(5, 0, 0, 0, 0, 0, 0, "")]
    assert cr.audit(cr.damaged(conversations(spark, []))).count() == 0 and cr.repaired(conversations(spark, [])).count() == 0


def test_registered_repair(spark, sf):
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in spark.read.parquet(f"{sf}/conversations.parquet").collect()]
    assert sorted(map(tuple, registry.op13_conversation_repair(spark, sf).collect()), key=str) == brute_audit(rows)
