"""Streaming ingest: a watched folder to a store of records, each content once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from folioflow.operators.tables import latest, not_yet
from folioflow.sources.files import EXTENSIONS, listed


def watch(spark: SparkSession, folder: str, extensions: list[str] = EXTENSIONS) -> DataFrame:
    """New files of a folder as a stream; producers rename finished files into it."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    return listed(spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", "*").load(folder), extensions)


def ingest(files: DataFrame, store: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Appends files whose content the store does not hold. A micro-batch looks its hashes up in the store, so no
    state grows with the stream, and a batch that is repeated after a failure adds nothing twice."""
    spark = files.sparkSession

    def append(batch: DataFrame, number: int) -> None:
        # The number of the batch is the version that a reader of the store can ask for changes since.
        rows = batch.drop("content").dropDuplicates(["content_hash"]).withColumn("version", F.lit(number).cast("long"))
        try:
            known = spark.read.parquet(store)
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            known = None
        if known is not None:
            rows = not_yet(rows, known, ["content_hash"])
        rows.write.mode("append").parquet(store)

    out = files.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint)
    return (out.trigger(availableNow=True) if available_now else out.trigger(processingTime="2 seconds")).start()


def once_within(stream: DataFrame, key: str, time: str, delay: str = "600 seconds") -> DataFrame:
    """Requests by idempotency key: repeats within the delay are dropped, and the state is bounded by it."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def changed_since(store: DataFrame, version: int) -> DataFrame:
    """Rows written after a version."""
    return store.where(F.col("version") > version)


def reprocessed(store: DataFrame, ids: DataFrame, keys: list[str], work) -> DataFrame:
    """New versions of some records: ``work`` is applied to their latest ones, the others are not touched."""
    again = latest(store, keys, ["version"]).join(ids, keys, "left_semi")
    return work(again).withColumn("version", F.col("version") + 1)
