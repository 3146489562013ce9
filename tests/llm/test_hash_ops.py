"""Texts on which weak hashes collide, and texts of extreme length."""

import random

import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

from folioflow.llm import exact_dedup, ngram_join, packing, quality_rules, suffix_dedup, textkernel as tk, token_counts, token_files

from .helpers import docs
from .test_dedup_ops import brute_near, brute_repeats
from .test_quality_ops import brute_rules
from .test_token_ops import BYTE, PIECE, WORD, crc


def thue_morse(n, a="a", b="b"):
    return "".join(b if i.bit_count() % 2 else a for i in range(n))


def strange():
    """Words that agree under any polynomial hash modulo a power of two, one word of 1 MB, one text of 4 MB."""
    t, u = thue_morse(2048), thue_morse(2048, "b", "a")
    r = random.Random(6)
    common = [f"{a}{b}" for a in "bdfgklmnprst" for b in ("al", "emo", "inter", "operation")]
    long = " ".join(r.choice(common) for _ in range(700_000))[:4_000_000]
    twins = ["x" * 8 + k * 10 + "y" * 8 for k in "mn"]  # equal ends and length
    return list(enumerate([t, u, f"{t} {u}", f"{u} {t}", "".join(r.choice("abc") for _ in range(1_000_000)), long, *twins, twins[0] + " " + twins[1]]))


def test_span_hashes_tell_spans_apart():
    r = np.random.default_rng(0)
    t = np.frombuffer((thue_morse(4096) + thue_morse(4096, "b", "a")).encode(), np.uint8)
    for n in (3, 8, 9, 16, 17, 255, 256, 257, 1024, 4096):
        h = tk.span_hashes(t, np.array([0, 4096]), np.array([n, 4096 + n]))
        assert h[0] != h[1]
    buf = r.integers(0, 3, 3000).astype(np.uint8)
    starts = np.repeat(np.arange(2900), 30)
    ends = starts + np.tile(np.arange(1, 31), 2900)
    spans = [buf[a:b].tobytes() for a, b in zip(starts, ends, strict=True)]
    h = tk.span_hashes(buf, starts, ends)
    assert len(set(zip(spans, h.tolist(), strict=True))) == len(set(spans)) == len(set(h.tolist()))


def test_window_hashes_of_long_texts():
    r = np.random.default_rng(1)
    half = r.integers(97, 101, 2_000_000).astype(np.uint8)
    buf, at = np.concatenate((half, half)), np.sort(r.integers(0, 1_999_950, 500))
    for h in tk.window_hashes(buf, np.concatenate((at, at + 2_000_000)), 50):
        assert (h[:500] == h[500:]).all() and len(set(h.tolist())) == len(set(at.tolist()))


def test_same_bytes():
    a, b = np.frombuffer(b"abcdefgh", np.uint8), np.frombuffer(b"xabcdxfgh", np.uint8)
    assert tk.same_bytes(a, np.array([0, 4, 5]), b, np.array([1, 5, 6]), np.array([4, 2, 3])).tolist() == [True, False, True]


def test_token_operators_on_strange_texts(spark):
    rows = strange()
    d = docs(spark, rows).repartition(1)
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    assert {r.doc_id: r.n_tokens for r in token_counts.count_tokens(d, PIECE).collect()} == {i: len(sp.encode(t)) for i, t in rows}
    byte, word = Tokenizer.from_file(BYTE), Tokenizer.from_file(WORD)
    want = {i: byte.encode(t, add_special_tokens=False).ids + [0] for i, t in rows}
    got = token_files.read_token_files(token_files.write_token_files(d, BYTE, 0)).collect()
    assert {r.doc_id: (r.n_tokens, r.ids_crc32) for r in got} == {i: (len(x), crc(x)) for i, x in want.items()}
    want = {i: word.encode(t, add_special_tokens=False).ids + [2] for i, t in rows}
    got = {}
    for r in packing.pack(d, WORD, 2).collect():
        assert crc(want[r.doc_id][r.start : r.start + r.length]) == r.ids_crc32
        got[r.doc_id] = got.get(r.doc_id, 0) + r.length
    assert got == {i: len(x) for i, x in want.items()}


def test_dedup_operators_on_strange_texts(spark):
    rows = [(i, t) for i, t in strange() if len(t) < 2_000_000]
    d = docs(spark, rows)
    assert {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in ngram_join.near_duplicates(d).collect()} == brute_near(rows)
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.remove_repeats(d).collect()} == brute_repeats(rows)
    long = strange()[5]
    twice = docs(spark, [long, (9, long[1])])
    assert sorted((r.doc_id, r.component_id) for r in ngram_join.near_duplicates(twice).collect()) == [(5, 5), (9, 5)]
    assert sorted((r.doc_id, r.n_removed) for r in suffix_dedup.remove_repeats(twice).collect())[0] == (5, 0)
    assert {(r.doc_id, r.keep_id) for r in exact_dedup.exact_dedup(twice).collect()} == {(5, 9), (9, 9)}
    (rule,) = quality_rules.quality_rules(docs(spark, [long])).collect()
    assert (rule.n_words, rule.word_chars) == brute_rules(long[1])[:2]


def test_sequences_are_views_of_the_file(spark):
    texts = [(i, " ".join(f"word{(i * k) % 97}" for k in range(i % 40))) for i in range(300)]
    d = docs(spark, texts)
    (f, *_) = token_files.write_token_files(d.repartition(1), BYTE, 0, seq_len=16, out_dir=None).orderBy("part").collect()
    seqs, byte = token_files.Sequences(f.path), Tokenizer.from_file(BYTE)
    mine = sorted(r.doc_id for r in token_files.read_token_files(spark.createDataFrame([f])).collect())
    flat = [x for i in mine for x in byte.encode(dict(texts)[i], add_special_tokens=False).ids + [0]]
    assert len(seqs) == -(-len(flat) // 16) > token_files.BATCH_SEQS or len(seqs) > 10
    import pyarrow as pa

    before = pa.total_allocated_bytes()
    for k in (0, len(seqs) // 2, len(seqs) - 1):
        ids, mask = seqs[k]
        real = flat[16 * k : 16 * k + 16]
        assert ids.dtype == np.uint16 and not ids.flags.owndata and ids.tolist()[: len(real)] == real and mask.to_pylist() == [True] * len(real) + [False] * (16 - len(real))
    assert pa.total_allocated_bytes() == before
    with pytest.raises(IndexError):
        seqs[len(seqs)]


def test_ids_that_need_32_bits(spark):
    d = docs(spark, [(1, "some words"), (2, None)])
    files = token_files.write_token_files(d, BYTE, 70_000, seq_len=8)
    t = Tokenizer.from_file(BYTE)
    want = {1: t.encode("some words").ids + [70_000], 2: [70_000]}
    assert {r.doc_id: r.ids_crc32 for r in token_files.read_token_files(files).collect()} == {k: crc(v) for k, v in want.items()}
    with pytest.raises(ValueError):
        token_files.write_token_files(d, BYTE, 1 << 32)
    with pytest.raises(ValueError):
        token_files.SequenceWriter(__import__("io").BytesIO(), 8, np.uint16).add(np.array([70_000], np.uint32))
