"""Operator 3: token ids in Arrow files of equal-length sequences.

Texts are range-partitioned by doc_id; each task encodes its texts and writes one Arrow IPC file whose
record batches hold fixed-size lists: ``ids`` (seq_len unsigned integers, 16 bits where the vocabulary
allows) and ``mask`` (seq_len booleans, false on the padding of the last sequence).  Every sequence has
the same length, so number k lies at a computable place of a memory-mapped file, without copying.  A
second file lists the documents: doc_id, start within the file, n_tokens.  A task writes under a name of
its own attempt and then renames, so a repeated attempt leaves the same files.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from . import textkernel as tk, tokens
from .common import doc_columns, shared_dir, slots, workers_see_package

#: Sequences of one record batch.
BATCH_SEQS = 256


def sequence_schema(seq_len: int, kind: pa.DataType) -> pa.Schema:
    return pa.schema([pa.field("ids", pa.list_(kind, seq_len), False), pa.field("mask", pa.list_(pa.bool_(), seq_len), False)])


DOC_SCHEMA = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])


class SequenceWriter:
    """Cuts a stream of ids into equal-length sequences."""

    def __init__(self, sink, seq_len: int, dtype):
        self.len, self.dtype = seq_len, np.dtype(dtype)
        self.schema = sequence_schema(seq_len, pa.from_numpy_dtype(self.dtype))
        self.file = pa.ipc.new_file(sink, self.schema)
        self.parts, self.held, self.total = [], 0, 0

    def add(self, ids: np.ndarray) -> None:
        if len(ids) and ids.max() > np.iinfo(self.dtype).max:
            raise ValueError(f"id {ids.max()} does not fit {self.dtype}")
        self.parts.append(ids.astype(self.dtype))
        self.held += len(ids)
        self.total += len(ids)
        if self.held >= self.len * BATCH_SEQS:
            flat = np.concatenate(self.parts)
            n = len(flat) // (self.len * BATCH_SEQS) * self.len * BATCH_SEQS
            for at in range(0, n, self.len * BATCH_SEQS):
                self._write(flat[at : at + self.len * BATCH_SEQS], self.len * BATCH_SEQS)
            self.parts, self.held = [flat[n:]], len(flat) - n

    def _write(self, ids: np.ndarray, real: int) -> None:
        mask = np.arange(len(ids)) < real
        arrays = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.len) for x in (ids, mask)]
        self.file.write_batch(pa.RecordBatch.from_arrays(arrays, schema=self.schema))

    def close(self) -> None:
        flat = np.concatenate(self.parts) if self.parts else np.zeros(0, self.dtype)
        if len(flat):
            self._write(np.concatenate((flat, np.zeros(-len(flat) % self.len, self.dtype))), len(flat))
        self.file.close()


def write_token_files(docs: DataFrame, tokenizer_path: str, end_id: int, seq_len: int = 2048, split: str = "spaced", out_dir: str | None = None) -> DataFrame:
    """Write the files and return their manifest: part, path, docs_path, n_docs, n_tokens, base (tokens of all files before it).

    Rows are written in ascending doc_id order (null first; equal ids in order of their texts), each text
    followed by ``end_id``.  A null text counts as empty, and texts of any length are written whole.  Repeated rows
    are each written; an empty table writes no files; other columns are ignored.  Ids have 16 bits if the
    tokenizer's largest id and ``end_id`` fit, else 32.
    """
    spark = docs.sparkSession
    out_dir = out_dir or shared_dir(spark) + "/tokens"
    if not 0 <= end_id < 1 << 32:
        raise ValueError(f"id {end_id} does not fit 32 bits")
    dtype = np.uint16 if max(tokens.largest_id(tokenizer_path), end_id) < 1 << 16 else np.uint32

    def write(batches):
        part, attempt = TaskContext.get().partitionId(), uuid.uuid4().hex
        coder, writer, meta = tokens.bpe_encoder(tokenizer_path, split), None, None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            if writer is None:
                fs, root = file_system(out_dir)
                fs.create_dir(root, recursive=True)
                names = [f"{root}/part-{part:06d}{x}.arrow" for x in ("", ".docs")]
                sinks = [fs.open_output_stream(f"{x}.{attempt}") for x in names]
                writer, meta = SequenceWriter(sinks[0], seq_len, dtype), pa.ipc.new_file(sinks[1], DOC_SCHEMA)
                n_docs = 0
            buf, offs = tk.batch_text(batch.column(1))
            for lo, hi in tk.slices(offs):
                lens, begin = [], writer.total
                for ids in coder.ids(buf[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]):
                    writer.add(np.append(ids, np.uint32(end_id)))
                    lens.append(len(ids) + 1)
                starts = begin + np.cumsum([0, *lens[:-1]])
                meta.write_batch(pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(starts, pa.int64()), pa.array(lens, pa.int64())], schema=DOC_SCHEMA))
                n_docs += hi - lo
        if writer is not None:
            writer.close(), meta.close()
            for s, x in zip(sinks, names, strict=True):
                s.close()
                fs.move(f"{x}.{attempt}", x)
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), *(pa.array([x]) for x in names), pa.array([n_docs], pa.int64()), pa.array([writer.total], pa.int64())], names=["part", "path", "docs_path", "n_docs", "n_tokens"])

    workers_see_package(spark)
    rows = doc_columns(docs, "doc_id", "text").withColumn("text", F.coalesce("text", F.lit("")))
    schema = "part int, path string, docs_path string, n_docs long, n_tokens long"
    rows.repartitionByRange(slots(spark), "doc_id").sortWithinPartitions("doc_id", "text").mapInArrow(write, schema).write.parquet(f"{out_dir}/manifest")
    # One row for each file: as many as there are partitions.
    files, base = [], 0
    for r in sorted(spark.read.parquet(f"{out_dir}/manifest").collect()):
        files.append((*r, base, f"{out_dir}/{r.path.rsplit('/', 1)[1]}", f"{out_dir}/{r.docs_path.rsplit('/', 1)[1]}"))
        base += r.n_tokens
    return spark.createDataFrame([(p, u, v, d, n, b) for p, _, _, d, n, b, u, v in files], "part int, path string, docs_path string, n_docs long, n_tokens long, base long")


def file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    """Arrow's file system and path for an address as Spark writes it."""
    scheme, _, rest = uri.partition("://")
    if scheme in ("s3a", "s3n"):
        return pafs.FileSystem.from_uri(f"s3://{rest}")
    if scheme == "viewfs":
        return pafs.HadoopFileSystem("default"), "/" + rest.partition("/")[2]
    return pafs.FileSystem.from_uri(uri)


def open_ipc(uri: str):
    """Reader of an Arrow file; memory-mapped, so without copies, where the file system is local."""
    fs, path = file_system(uri)
    return pa.ipc.open_file(pa.memory_map(path) if isinstance(fs, pafs.LocalFileSystem) else fs.open_input_file(path))


class Sequences:
    """Random access to one file: ``len`` of it, and sequence ``k`` as an array of ids and one of mask bits.

    Where the file system is local both are views of the mapped file: nothing is read before it is touched, and
    nothing is copied.
    """

    def __init__(self, path: str):
        self.file = open_ipc(path)
        n = self.file.num_record_batches
        self.len = (n - 1) * BATCH_SEQS + self.file.get_batch(n - 1).num_rows if n else 0

    def __len__(self) -> int:
        return self.len

    def __getitem__(self, k: int) -> tuple[np.ndarray, pa.BooleanArray]:
        if not 0 <= k < self.len:
            raise IndexError(k)
        batch = self.file.get_batch(k // BATCH_SEQS)
        ids, mask = batch.column(0), batch.column(1)
        size, at = ids.type.list_size, k % BATCH_SEQS * ids.type.list_size
        return ids.values.slice(at, size).to_numpy(zero_copy_only=True), mask.values.slice(at, size)


def read_token_files(manifest: DataFrame) -> DataFrame:
    """doc_id, start (over all files), n_tokens, ids_crc32 of every document, from the files alone."""

    def read(batches):
        for batch in batches:
            for row in batch.to_pylist():
                seqs, docs = open_ipc(row["path"]), open_ipc(row["docs_path"])
                k, chunk, at = 0, np.zeros(0, np.uint16), 0
                for b in range(docs.num_record_batches):
                    some = docs.get_batch(b)
                    crcs = []
                    for left in some.column(2).to_numpy():
                        crc = 0
                        while left:
                            if at == len(chunk):
                                chunk, at, k = seqs.get_batch(k).column(0).flatten().to_numpy(), 0, k + 1
                            take = min(left, len(chunk) - at)
                            crc = zlib.crc32(chunk[at : at + take].astype("<u4"), crc)
                            at, left = at + take, left - take
                        crcs.append(crc)
                    start = some.column(1).to_numpy() + row["base"]
                    yield pa.RecordBatch.from_arrays([some.column(0), pa.array(start), some.column(2), pa.array(crcs, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    spark = manifest.sparkSession
    workers_see_package(spark)
    return manifest.repartition(slots(spark), "part").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")
