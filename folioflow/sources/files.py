"""File sources, ground truth, rule sets and report sinks."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from folioflow.plans.report import Rules

EXTENSIONS = ["jpg", "jpeg", "png", "bmp", "tif", "tiff", "webp", "gif", "heic", "heif", "pdf"]


def listed(files: DataFrame, extensions: list[str] = EXTENSIONS) -> DataFrame:
    """Files of the wanted kinds with name, suffix and content hash; editors' lock files are passed over."""
    name = F.element_at(F.split("path", "/"), -1)
    out = files.withColumn("name", name).withColumn("suffix", F.lower(F.regexp_extract("name", r"\.([^.]+)$", 1)))
    return out.where(F.col("suffix").isin(extensions) & ~F.col("name").startswith("~$")).withColumn("content_hash", F.sha2("content", 256))


def scan(spark: SparkSession, folder: str, recursive: bool = False, extensions: list[str] = EXTENSIONS, settled_before: str | None = None) -> DataFrame:
    """A folder's files; ``settled_before``: only files not modified since that time. A missing folder has none.

    Only files of the wanted kinds are opened. ``in_order`` numbers them as a list of the folder would.
    """
    anycase = "".join(f"[{x}{x.upper()}]" if x.isalpha() else x for x in "{" + ",".join(extensions) + "}")
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).option("pathGlobFilter", f"*.{anycase}")
    try:
        files = reader.load(folder)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        files = spark.createDataFrame([], "path string, modificationTime timestamp, length long, content binary")
    if settled_before:
        files = files.where(F.col("modificationTime") < F.lit(settled_before).cast("timestamp"))
    return listed(files, extensions)


def in_order(files: DataFrame, oldest_first: bool = False) -> DataFrame:
    """Files by lower-cased name, or by time of change and name."""
    name = F.lower("name")
    return files.orderBy("modificationTime", name) if oldest_first else files.orderBy(name, "name")


def read_truth(spark: SparkSession, path: str, key: str) -> DataFrame:
    """Ground truth as text columns, byte-order mark or not; of repeated keys the last line counts."""
    rows = spark.read.option("header", True).option("encoding", "UTF-8").csv(path).withColumn("__at", F.monotonically_increasing_id())
    rest = [c for c in rows.columns if c not in (key, "__at")]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), "__at").alias("__r")).select(key, "__r.*")


def read_rules(spark: SparkSession, path: str) -> Rules:
    """A rule file in any store that Spark reads; it is one small document."""
    rows = spark.read.option("wholetext", True).text(path).limit(1).collect()
    if not rows:
        raise ValueError(f"no rule file at {path}")
    return Rules.from_json(rows[0][0])


def yes_no(c: Column) -> Column:
    return F.when(c, "SI").otherwise("NO")


def write_report(rows: DataFrame, path: str) -> None:
    """Observed rows as CSV in the report's column order, flags as SI or NO."""
    text = ["nombre_archivo", "cuenta_no", "cheque_no", "a_la_orden_de"]
    flags = ["firma", "beneficiario", "coincide_valor", "fecha_correcta", "endoso"]
    number = F.coalesce(F.format_number("valor_numero", 2), "valor_numero_texto").alias("valor_numero")
    out = rows.where("incluir").select(*text, number, "valor_texto", "cliente", "fecha", "endoso_texto", *[yes_no(F.col(f)).alias(f) for f in flags])
    out.write.option("header", True).mode("overwrite").csv(path)


def with_readings(files: DataFrame, readings: DataFrame, key: str, payload: str) -> DataFrame:
    """Every file with its reading; a file that could not be read keeps a row, with an error instead of a payload."""
    out = files.join(readings, key, "left")
    return out.withColumn("error", F.when(F.col(payload).isNull(), "unread"))
