"""Reports of several sheets that appear together or not at all: a data source with a commit.

Tasks write their rows of every sheet to a staging folder of the job, and tell which files they wrote. The commit lists
those files in a new version, and then replaces, in one move, the small file that says which version counts. A task that
fails, or runs twice, leaves files that no version lists; a job that fails removes its staging folder (a task that ends
after that may leave a file there), and readers go on seeing the version before it. Folders are reached through pyarrow, so any store will do that tasks and driver share.
"""

from __future__ import annotations

import csv
import io
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs as afs
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from folioflow.session import workers_see_package

SCHEMA = "sheet string, row long, cells array<string>"
CURRENT = "current.json"


def _store(path: str) -> tuple[afs.FileSystem, str]:
    return afs.FileSystem.from_uri(path if "://" in path else f"file://{path}")


def _version(path: str) -> dict:
    store, base = _store(path)
    if store.get_file_info(f"{base}/{CURRENT}").type == afs.FileType.NotFound:
        raise FileNotFoundError(f"no report at {path}")
    with store.open_input_stream(f"{base}/{CURRENT}") as f:
        return json.loads(f.read())


@dataclass
class Wrote(WriterCommitMessage):
    files: list[tuple[str, str]]


class SheetWriter(DataSourceWriter):
    def __init__(self, path: str):
        self.path, self.job = path, uuid.uuid4().hex

    def write(self, iterator: Iterator) -> Wrote:
        store, base = _store(self.path)
        texts: dict[str, io.StringIO] = {}
        for sheet, number, cells in iterator:
            if sheet not in texts:
                texts[sheet] = io.StringIO()
            csv.writer(texts[sheet]).writerow([number, *["" if c is None else "=" + c for c in cells]])
        files = []
        folder = f"{base}/staging-{self.job}"
        store.create_dir(folder, recursive=True)
        for sheet, text in texts.items():
            name = f"{uuid.uuid4().hex}.csv"
            with store.open_output_stream(f"{folder}/{name}") as f:
                f.write(text.getvalue().encode())
            files.append((sheet, name))
        return Wrote(files)

    def commit(self, messages: list[Wrote | None]) -> None:
        store, base = _store(self.path)
        sheets: dict[str, list[str]] = {}
        for m in messages:
            for sheet, name in m.files if m else []:
                sheets.setdefault(sheet, []).append(name)
        folder = f"{base}/version-{self.job}"
        if store.get_file_info(f"{base}/staging-{self.job}").type == afs.FileType.NotFound:
            store.create_dir(folder, recursive=True)
        else:
            store.move(f"{base}/staging-{self.job}", folder)
        with store.open_output_stream(f"{base}/{CURRENT}.{self.job}") as f:
            f.write(json.dumps({"version": f"version-{self.job}", "sheets": sheets}).encode())
        store.move(f"{base}/{CURRENT}.{self.job}", f"{base}/{CURRENT}")

    def abort(self, messages: list[Wrote | None]) -> None:
        store, base = _store(self.path)
        if store.get_file_info(f"{base}/staging-{self.job}").type != afs.FileType.NotFound:
            store.delete_dir(f"{base}/staging-{self.job}")


@dataclass
class Part(InputPartition):
    sheet: str
    file: str


class SheetReader(DataSourceReader):
    def __init__(self, path: str, sheet: str | None):
        self.path, self.sheet = path, sheet

    def partitions(self) -> list[Part]:
        now = _version(self.path)
        return [Part(s, f"{now['version']}/{f}") for s, files in now["sheets"].items() if self.sheet in (None, s) for f in files] or [Part("", "")]

    def read(self, partition: Part) -> Iterator[tuple]:
        if partition.file:
            store, base = _store(self.path)
            with store.open_input_stream(f"{base}/{partition.file}") as f:
                for number, *cells in csv.reader(io.StringIO(f.read().decode(), newline="")):
                    yield partition.sheet, int(number), [c[1:] if c else None for c in cells]


class Sheets(DataSource):
    """Rows (sheet, row, cells) of a report; options: path, and for reading sheet."""

    @classmethod
    def name(cls) -> str:
        return "sheets"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> SheetReader:
        return SheetReader(self.options["path"], self.options.get("sheet"))

    def writer(self, schema, overwrite: bool) -> SheetWriter:
        if not overwrite:
            raise ValueError("a report is replaced, not added to")
        return SheetWriter(self.options["path"])


def _registered(spark: SparkSession) -> None:
    workers_see_package(spark)
    spark.dataSource.register(Sheets)


def cells(df: DataFrame, sheet: str, row: str | None = None) -> DataFrame:
    """A table as rows of a sheet: numbers from ``row`` or in any order, every other column as text, and a head of names as row -1."""
    names = [c for c in df.columns if c != row]
    number = F.col(row).cast("long") if row else F.monotonically_increasing_id()
    body = df.select(F.lit(sheet).alias("sheet"), number.alias("row"), F.array(*[F.col(c).cast("string") for c in names]).alias("cells"))
    head = df.sparkSession.range(1).select(F.lit(sheet).alias("sheet"), F.lit(-1).cast("long").alias("row"), F.array(*map(F.lit, names)).alias("cells"))
    return body.unionByName(head)


def write_sheets(sheets: dict[str, DataFrame], path: str, row: str | None = None) -> None:
    """All sheets in one job and one commit; where a table has the column ``row``, it gives the order."""
    rows = None
    for name, df in sheets.items():
        part = cells(df, name, row if row in df.columns else None)
        rows = part if rows is None else rows.unionByName(part)
    spark = rows.sparkSession
    _registered(spark)
    rows.write.format("sheets").option("path", path).mode("overwrite").save()


def read_sheet(spark: SparkSession, path: str, sheet: str) -> DataFrame:
    """A sheet of the report's current version as a table of text columns, with its ``row`` numbers."""
    _registered(spark)
    rows = spark.read.format("sheets").option("path", path).option("sheet", sheet).load()
    head = rows.where("row = -1").select("cells").first()
    if head is None:
        raise LookupError(f"no sheet {sheet} in {path}")
    return rows.where("row >= 0").select("row", *[F.get("cells", F.lit(i)).alias(n) for i, n in enumerate(head[0])])


def record_sheets(records: DataFrame, columns: dict[str, Column], totals: dict[str, Column], texts: DataFrame, order: str) -> dict[str, DataFrame]:
    """The three sheets of a batch report: a row a record with the named projections, in the order of a number column; one row
    a total (aggregates by name); and the texts that were read."""
    rows = records.select(F.col(order).alias("row"), *[c.alias(n) for n, c in columns.items()])
    sums = records.agg(*[c.cast("string").alias(n) for n, c in totals.items()])
    return {"rows": rows, "totals": sums.select(F.explode(F.array(*[F.struct(F.lit(i).cast("long").alias("row"), F.lit(n).alias("name"), F.col(f"`{n}`").alias("value")) for i, n in enumerate(totals)])).alias("t")).select("t.*"), "texts": texts}


def evaluation_sheets(fields: DataFrame, truth: DataFrame, key: str, names: list[str], same: Column) -> dict[str, DataFrame]:
    """An evaluation: per record and field the value, what was expected and how that went, and per field the number of each
    outcome: ok or error, automatic or sent to review.

    fields: key, field, value, review; truth: key, field, expected; ``same``: whether value and expected agree. A field
    without a truth has no result; a null value is an error.
    """
    both = fields.where(F.col("field").isin(names)).join(truth, [key, "field"], "left")
    result = F.when(F.col("expected").isNotNull(), F.concat(F.when(F.coalesce(same, F.lit(False)), "ok").otherwise("error"), F.when(F.col("review"), "_review").otherwise("_auto")))
    both = both.withColumn("result", result)
    first = lambda c: F.first(c, ignorenulls=True).alias(c)
    rows = both.groupBy(key).pivot("field", names).agg(first("value"), first("expected"), first("result"))
    kinds = ["ok_auto", "ok_review", "error_review", "error_auto"]
    counts = both.groupBy("field").agg(*[F.count_if(F.col("result") == k).alias(k) for k in kinds])
    return {"rows": rows, "counts": counts}
