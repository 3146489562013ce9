"""Operator 7: packing by power-of-two decomposition.

A document of n tokens becomes n // max_len pieces of max_len and, for the rest, one piece for each bit
of its binary form, longest first.  Pieces of equal length share a bucket, and a sequence is one piece,
so no sequence crosses documents and none is padded.  Sequence numbers are dense and bucket by bucket.
Only the pieces' descriptions move between tasks; ids are encoded where the text is read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import tokens
from .common import doc_columns, map_text, numbered


def piece_lengths(n: int, max_len: int) -> list[int]:
    return [max_len] * (n // max_len) + [1 << b for b in range(max_len.bit_length() - 1, -1, -1) if (n % max_len) >> b & 1]


def pack(docs: DataFrame, tokenizer_path: str, end_id: int, max_len: int = 4096, split: str = "dropped", with_ids: bool = False) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and ids if asked for.

    max_len: a power of two.  A null or empty text still has its end id, so one piece.  Repeated rows and
    equal doc_ids are packed each by itself; an empty table gives no rows; other columns are ignored.
    """
    if max_len & (max_len - 1):
        raise ValueError("max_len must be a power of two")

    def cut(batch, buf, offs):
        coder = tokens.bpe_encoder(tokenizer_path, split)
        doc, start, length, crc, total, out = [], [], [], [], [], []
        for i, ids in enumerate(coder.ids(buf, offs)):
            ids = np.append(ids, np.uint32(end_id)).astype("<u4")
            at, data = 0, memoryview(ids).cast("B")
            for n in piece_lengths(len(ids), max_len):
                doc.append(i), start.append(at), length.append(n), total.append(len(ids))
                crc.append(zlib.crc32(data[4 * at : 4 * (at + n)]))
                if with_ids:
                    out.append(ids[at : at + n].astype(np.int32))
                at += n
        arrays = [batch.column(0).take(pa.array(doc, pa.int64())), *(pa.array(x, pa.int64()) for x in (start, length, crc, total))]
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
        yield pa.RecordBatch.from_arrays(arrays + [pa.array(out, pa.list_(pa.int32()))] * with_ids, names=names + ["ids"] * with_ids)

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<int>" * with_ids
    pieces = map_text(doc_columns(docs, "doc_id", "text"), schema, cut, encoder=tokenizer_path)
    return numbered(pieces, "sequence_id", F.col("length").desc(), F.col("doc_id"), F.col("start")).withColumn("offset", F.lit(0).cast("long"))
