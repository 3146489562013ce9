"""Session settings that the engine's queries rely on."""

from __future__ import annotations

import os
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parents[1])


def workers_see_package(spark: SparkSession) -> None:
    """Python workers import this package from where the driver did."""
    paths = spark.sparkContext.environment.get("PYTHONPATH", "").split(os.pathsep)
    if ROOT not in paths:
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, paths)])


#: Rows of a task whose work per row is heavy: at about a millisecond each, some tens of seconds.
DEALT_ROWS = 20_000


def dealt(df: DataFrame) -> DataFrame:
    """The rows dealt over all cores, and over tasks of ``DEALT_ROWS`` rows where there are more, if the scan has fewer splits
    than that (a split without the start of a row group holds no rows, and large ones hold millions); else the table as it
    is, without a shuffle. For work that costs far more than moving the rows, so that tasks become more with the input, not longer."""
    splits, cores = df.rdd.getNumPartitions(), df.sparkSession.sparkContext.defaultParallelism
    tasks = max(cores, -(-df.count() // DEALT_ROWS))
    return df.repartition(tasks) if splits < tasks else df


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """The rows by key over all shuffle partitions, as many as the session has: where scoring them takes far longer than their
    bytes suggest, adaptive execution must not gather them into few tasks. Grouping and joins by these keys move nothing again."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def matched(df: DataFrame, other: DataFrame, *keys: str, how: str = "inner") -> DataFrame:
    """A join by these keys that shuffles both sides, at any size. What arrays, matrices and computed texts weigh is not known
    to the planner, which goes by the bytes of the files read and a few for each array: it would send them all to the driver."""
    return df.join(other.hint("merge"), list(keys), how)


#: Rows of a task that sorts and groups narrow rows: some tens of MB.
PORTION_ROWS = 300_000


def portioned(df: DataFrame, *keys: str) -> DataFrame:
    """The rows by key over the session's shuffle partitions, or over tasks of ``PORTION_ROWS`` rows where there are more, so that
    the memory of a task does not grow with the table. Grouping, windows and joins by these keys move nothing again."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(least, -(-df.count() // PORTION_ROWS)), *keys)


def cut(df: DataFrame) -> DataFrame:
    """The rows written once to the folder in spark.checkpoint.dir, without the plan that led to them."""
    sc = df.sparkSession.sparkContext
    base = df.sparkSession.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="folioflow-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(base)
    return df.checkpoint()
