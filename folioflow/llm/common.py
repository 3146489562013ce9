"""Helpers of the training-data operators: shared storage, batches, dense numbering."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from . import textkernel as tk, tokens

_ROOT = str(Path(__file__).resolve().parents[2])


def shared_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir; where that is unset in local mode (tests), below a temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="folioflow-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def materialize(df: DataFrame) -> DataFrame:
    """Write a result to the shared folder and read it back: cuts lineage, survives lost executors, runs once."""
    path = shared_dir(df.sparkSession) + "/table"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows of an Arrow batch where the session leaves Spark's own default; texts are long, so batches stay small.
BATCH_ROWS = 2000


def workers_see_package(spark: SparkSession) -> None:
    """Python workers import this package from where the driver did, and get batches of texts that fit their memory."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    paths = spark.sparkContext.environment.get("PYTHONPATH", "").split(os.pathsep)
    if _ROOT not in paths:
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join([_ROOT, *filter(None, paths)])


def slots(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def map_text(df: DataFrame, schema: str, fn: Callable[[pa.RecordBatch, np.ndarray, np.ndarray], Iterator[pa.RecordBatch]], encoder: str | None = None) -> DataFrame:
    """mapInArrow over slices of bounded size; ``fn`` gets the rows, the bytes of column ``text`` and its offsets.

    Spark reuses workers, so one that held the cache of another operator's tokenizer than ``encoder`` drops it first.
    """

    def run(batches):
        tokens.forget(encoder)
        for batch in batches:
            if batch.num_rows == 0:
                continue
            buf, offs = tk.batch_text(batch.column(batch.schema.get_field_index("text")))
            for lo, hi in tk.slices(offs):
                yield from fn(batch.slice(lo, hi - lo), buf[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo])
        pa.default_memory_pool().release_unused()

    workers_see_package(df.sparkSession)
    return df.mapInArrow(run, schema)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores before it as it takes to differ from the columns of ``df``."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def small(df: DataFrame, rows: int, most_bytes: int = 64 << 20) -> DataFrame:
    """Broadcast hint for a written table of at most ``rows`` rows that hold at most ``most_bytes``, counting 16 bytes a
    row, 8 a number and the bytes of strings and binaries; a larger one is joined by a shuffle."""
    size = F.lit(16)
    for f in df.schema.fields:
        size = size + (F.coalesce(F.octet_length(f.name), F.lit(0)) if isinstance(f.dataType, (T.StringType, T.BinaryType)) else F.lit(8))
    n, held = df.agg(F.count("*"), F.coalesce(F.sum(size), F.lit(0))).first()
    return F.broadcast(df) if n <= rows and held <= most_bytes else df


def doc_columns(docs: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, under those names; whatever else a table has cannot clash."""
    return docs.select(*[docs[n] for n in names])


def numbered(df: DataFrame, name: str, *order: Column) -> DataFrame:
    """Dense numbers from 0 in the given order: rows are range-partitioned and sorted, and each partition adds the sizes of those before it."""
    spark = df.sparkSession
    n = slots(spark)
    # Choosing the ranges reads the rows once more, so they are written first.
    rows = materialize(materialize(df).repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id()))
    part, at = F.shiftright("__at", 33), F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    # One row for each partition: at most n rows, so its size is known.
    sizes = sorted(rows.groupBy(part.alias("part")).count().collect())
    before, total = [], 0
    for p, c in sizes:
        before.append((p, total))
        total += c
    if not before:
        return rows.withColumn(name, F.col("__at")).drop("__at")
    offset = spark.createDataFrame(before, "__part int, __before long")
    return rows.withColumn("__part", part.cast("int")).join(F.broadcast(offset), "__part").withColumn(name, at + F.col("__before")).drop("__at", "__part", "__before")
