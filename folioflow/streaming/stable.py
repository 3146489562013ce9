"""Files that have stopped growing: a gate over repeated scans of a folder, with a state for each path."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from folioflow.session import workers_see_package
from folioflow.sources.files import EXTENSIONS, listed

SIGHTING = "path string, length long, modified timestamp, scanned timestamp"


def scan(spark: SparkSession, folder: str, sightings: str, extensions: list[str] = EXTENSIONS) -> None:
    """One scan of a folder and what lies below it: a sighting of each file is added to the table that the gate streams. Files
    whose names begin with "~$" are a program's own and left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).drop("content")
    rows = listed(files.withColumn("content", F.lit(None).cast("binary")), extensions)
    name = F.element_at(F.split("path", "/"), -1)
    rows = rows.where(~name.startswith("~$") & ~name.startswith("%7E$") & ~name.startswith("~%24"))
    rows.select("path", "length", F.col("modificationTime").alias("modified"), F.current_timestamp().alias("scanned")).write.mode("append").parquet(sightings)


def sightings(spark: SparkSession, folder: str) -> DataFrame:
    return spark.readStream.schema(SIGHTING).parquet(folder)


def stable(seen: DataFrame, forget_ms: int = 24 * 3600 * 1000) -> DataFrame:
    """Files (path, length, modified) of a stream of sightings, each as soon as two scans in a row found it at one length, and
    again only once it has changed.

    The state is a path's pending length and the length and time it was let through at; a path that no scan has found for
    ``forget_ms`` before the last one is forgotten, so the state is bounded by what the folder holds. Sightings of one batch
    count in the order of their scans. A null path is none.
    """

    def gate(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        pending, length, modified = state.get if state.exists else (None, None, None)
        out, last = [], 0
        for r in pd.concat(list(batches)).sort_values("scanned").itertuples():
            now, last = r.modified.isoformat(), int(r.scanned.timestamp() * 1000)
            if (length, modified) == (r.length, now):
                continue
            if pending != r.length:
                pending = int(r.length)
                continue
            pending, length, modified = None, int(r.length), now
            out.append((key[0], length, r.modified))
        state.update((pending, length, modified))
        state.setTimeoutTimestamp(max(last, state.getCurrentWatermarkMs()) + forget_ms)
        if out:
            yield pd.DataFrame(out, columns=["path", "length", "modified"])

    workers_see_package(seen.sparkSession)
    rows = seen.where("path IS NOT NULL AND scanned IS NOT NULL").withWatermark("scanned", "0 seconds").groupBy("path")
    return rows.applyInPandasWithState(gate, "path string, length long, modified timestamp", "pending long, length long, modified string", "append", GroupStateTimeout.EventTimeTimeout)
