import zlib

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
from tokenizers import Tokenizer

from folioflow.llm import packing, registry, token_counts, token_files
from folioflow.llm.tokens import HashTable

from .helpers import docs

BYTE, WORD, PIECE = (P.path(x) for x in ("byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"))


def ids(path, text):
    return Tokenizer.from_file(path).encode(text or "", add_special_tokens=False).ids


def crc(x):
    return zlib.crc32(np.array(x, "<u4").tobytes())


def test_hash_table_finds_what_was_added():
    t, r = HashTable(4), np.random.default_rng(1)
    keys = np.unique(r.integers(1, 1 << 62, 5000).astype(np.uint64))
    for part in np.array_split(keys, 7):
        t.add(part)
    assert (t.find(keys) == np.arange(len(keys))).all()
    assert (t.find(keys + np.uint64(1)) < 0).sum() >= len(keys) - 2


def test_counts_equal_the_library(spark):
    rows = docs(spark)
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    got = sorted(token_counts.count_tokens(rows, PIECE, table_size=50).collect(), key=str)
    want = sorted(((r.doc_id, len((r.text or "").encode()), len(sp.encode(r.text or "")), len(sp.encode(r.text or "")) > 4096) for r in rows.collect()), key=lambda x: str(x))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert token_counts.count_tokens(rows.limit(0), PIECE).count() == 0


def test_files_hold_every_id_in_order(spark):
    rows = docs(spark)
    files = token_files.write_token_files(rows, BYTE, 0, seq_len=64)
    got = sorted(token_files.read_token_files(files).collect(), key=lambda r: r.start)
    t = Tokenizer.from_file(BYTE)
    want, start = [], 0
    for r in sorted(rows.collect(), key=lambda r: (r.doc_id is not None, r.doc_id, r.text or "")):
        x = t.encode(r.text or "", add_special_tokens=False).ids + [0]
        want.append((r.doc_id, start, len(x), crc(x)))
        start += len(x)
    assert [tuple(r) for r in got] == want
    for f in files.collect():
        reader = token_files.open_ipc(f.path)
        masks = [m for b in range(reader.num_record_batches) for m in reader.get_batch(b).column(1).to_pylist()]
        assert all(len(m) == 64 for m in masks) and sum(map(sum, masks)) == f.n_tokens
    assert token_files.read_token_files(token_files.write_token_files(rows.limit(0), BYTE, 0)).count() == 0


def test_pieces_cover_every_id_once(spark):
    rows = docs(spark)
    out = packing.pack(rows, WORD, 2, max_len=64, with_ids=True).collect()
    assert sorted(r.sequence_id for r in out) == list(range(len(out)))
    assert all(r.length & (r.length - 1) == 0 and r.length <= 64 and r.offset == 0 and crc(r.ids) == r.ids_crc32 and len(r.ids) == r.length for r in out)
    assert [r.length for r in sorted(out, key=lambda r: r.sequence_id)] == sorted((r.length for r in out), reverse=True)
    texts = {}
    for r in rows.collect():
        texts.setdefault(r.doc_id, []).append(r.text)
    for doc, ts in texts.items():
        if len(ts) == 1:
            mine = sorted((r for r in out if r.doc_id == doc), key=lambda r: r.start)
            want = ids(WORD, ts[0]) + [2]
            assert sum((r.ids for r in mine), []) == want and all(r.doc_tokens == len(want) for r in mine)
            assert [r.start for r in mine] == [sum(x.length for x in mine[:k]) for k in range(len(mine))]
    with pytest.raises(ValueError):
        packing.pack(rows, WORD, 2, max_len=100)
    assert packing.pack(rows.limit(0), WORD, 2).count() == 0


def test_registered_queries_over_whole_tables(spark, sf):
    rows = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    assert {r.doc_id: r.n_tokens for r in registry.op10_token_counts(spark, sf).collect()} == {k: len(sp.encode(v)) for k, v in rows.items()}
    t = Tokenizer.from_file(BYTE)
    assert {r.doc_id: r.ids_crc32 for r in registry.op3_token_files(spark, sf).collect()} == {k: crc(t.encode(v).ids + [0]) for k, v in rows.items()}
    w = Tokenizer.from_file(WORD)
    n = {k: len(w.encode(v).ids) + 1 for k, v in rows.items()}
    out = registry.op7_packing(spark, sf).collect()
    assert {r.doc_id: r.doc_tokens for r in out} == n and sum(r.length for r in out) == sum(n.values())
