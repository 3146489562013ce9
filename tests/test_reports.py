import os
import time

import pytest
from pyspark.sql import functions as F

from folioflow.sources import sheets
from folioflow.streaming import stable


def test_sheets_appear_together(spark, tmp_path):
    path = str(tmp_path / "report")
    records = spark.createDataFrame([(2, "b", 2.5, None), (0, "a, \"x\"\ny", 1.0, "t"), (1, "", 3.0, "=u")], "at long, name string, v double, note string")
    texts = spark.createDataFrame([("a", "line one"), ("b", None)], "file string, text string")
    made = sheets.record_sheets(records, {"Name": F.col("name"), "Value": F.col("v"), "Note": F.col("note")}, {"Records": F.count("*"), "Sum": F.sum("v"), "None": F.max(F.lit(None).cast("string"))}, texts, "at")
    sheets.write_sheets(made, path, "row")
    rows = [tuple(r) for r in sheets.read_sheet(spark, path, "rows").orderBy("row").collect()]
    assert rows == [(0, "a, \"x\"\ny", "1.0", "t"), (1, "", "3.0", "=u"), (2, "b", "2.5", None)]
    assert [(r.name, r.value) for r in sheets.read_sheet(spark, path, "totals").orderBy("row").collect()] == [("Records", "3"), ("Sum", "6.5"), ("None", None)]
    assert sorted((r.file, r.text) for r in sheets.read_sheet(spark, path, "texts").collect()) == [("a", "line one"), ("b", None)]
    with pytest.raises(LookupError):
        sheets.read_sheet(spark, path, "nothing")
    sheets.write_sheets({"rows": records.limit(0)}, path)
    assert sheets.read_sheet(spark, path, "rows").columns == ["row", "at", "name", "v", "note"] and sheets.read_sheet(spark, path, "rows").count() == 0


def test_a_failed_task_leaves_the_old_version(spark, tmp_path):
    path = str(tmp_path / "report")
    good = spark.range(10).select(F.col("id").alias("n"))
    sheets.write_sheets({"rows": good, "more": good}, path)
    bad = spark.range(0, 1000, 1, 4).select(F.when(F.col("id") == 777, F.raise_error(F.lit("broken row"))).otherwise(F.col("id").cast("string")).alias("n"))
    with pytest.raises(Exception, match="broken row"):
        sheets.write_sheets({"rows": bad, "more": good.limit(3)}, path)
    assert sheets.read_sheet(spark, path, "rows").count() == 10 and sheets.read_sheet(spark, path, "more").count() == 10
    with pytest.raises(Exception, match="replaced"):
        sheets.cells(good, "rows").write.format("sheets").option("path", path).mode("append").save()
    with pytest.raises(Exception, match="no report"):
        sheets.read_sheet(spark, str(tmp_path / "none"), "rows")


def test_evaluation(spark):
    fields = spark.createDataFrame([(1, "a", "x", False), (1, "b", None, True), (2, "a", "y", True), (2, "b", "z", False), (3, "a", "q", False), (3, "other", "q", False)], "k long, field string, value string, review boolean")
    truth = spark.createDataFrame([(1, "a", "x"), (1, "b", "w"), (2, "a", "y"), (2, "b", "no")], "k long, field string, expected string")
    out = sheets.evaluation_sheets(fields, truth, "k", ["a", "b"], F.col("value") == F.col("expected"))
    assert {(r.k, r.a_result, r.b_result) for r in out["rows"].collect()} == {(1, "ok_auto", "error_review"), (2, "ok_review", "error_auto"), (3, None, None)}
    assert {tuple(r) for r in out["counts"].collect()} == {("a", 1, 1, 0, 0), ("b", 0, 0, 1, 1)}


def test_stable_files_over_scans_and_a_restart(spark, tmp_path):
    folder, seen, out, mark = (str(tmp_path / x) for x in ("in", "seen", "out", "mark"))
    os.mkdir(folder)

    def put(name, text):
        with open(f"{folder}/{name}", "w") as f:
            f.write(text)

    def scan():
        stable.scan(spark, folder, seen, ["png", "json"])

    def run():
        before = {(r.path.rsplit("/", 1)[-1], r.length) for r in spark.read.parquet(out).collect()} if os.path.exists(out) else set()
        # Every run is a new query that goes on from the checkpoint.
        stable.stable(stable.sightings(spark, seen)).writeStream.format("parquet").option("path", out).option("checkpointLocation", mark).outputMode("append").trigger(availableNow=True).start().awaitTermination(60)
        return sorted({(r.path.rsplit("/", 1)[-1], r.length) for r in spark.read.parquet(out).collect()} - before)

    put("a.png", "12"), put("b.png", "123"), put("c.txt", "1"), put("~$d.png", "1")
    scan()
    assert run() == []
    put("b.png", "12345")
    scan()
    assert run() == [("a.png", 2)]
    scan()
    assert run() == [("b.png", 5)]
    scan()
    assert run() == []
    time.sleep(1.1)
    put("a.png", "123")
    scan(), scan()
    assert run() == [("a.png", 3)]
