"""Reports, list views and stored forms of records and their fields."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F


def batch_sheet(fields: DataFrame, steps: DataFrame, order: DataFrame, key: str, names: list[str], step_names: list[str]) -> DataFrame:
    """One row a record: value, confidence and review of each field, seconds of each step, and its rank in the folder."""
    f = fields.groupBy(key).pivot("field", names).agg(*[F.first(c, ignorenulls=True).alias(c) for c in ("value", "confidence", "review")])
    f = f.withColumns({f"{n}_review": F.coalesce(f"{n}_review", F.lit(True)) for n in names})
    s = steps.groupBy(key).pivot("step", step_names).agg(F.sum("seconds"))
    return order.join(f, key, "left").join(s.withColumnsRenamed({n: f"{n}_s" for n in step_names}), key, "left")


def any_field(fields: DataFrame, key: str, wanted: Column) -> DataFrame:
    """Records of which some field fits."""
    return fields.where(wanted).select(key).distinct()


def holding(fields: DataFrame, key: str, file: str, field: str, value: str, text: str) -> DataFrame:
    """Records whose file name or field values, joined by blanks, hold a text, whatever its case."""
    rows = fields.groupBy(key).agg(F.first(file).alias("__f"), F.array_sort(F.collect_list(F.struct(field, F.col(value).cast("string").alias("v")))).alias("__v"))
    said = F.lower(F.concat_ws(" ", "__f", F.transform("__v", lambda x: x["v"])))
    return rows.where(F.contains(said, F.lit(text.lower()))).select(key)


def doubtful(fields: DataFrame, confidence: str, below: float, ties: list[str]) -> DataFrame:
    """Fields below a confidence, the least certain first."""
    return fields.where(F.col(confidence) < below).orderBy(confidence, *ties)


def exported(fields: DataFrame, key: str, field: str, value: str, confidence: str) -> DataFrame:
    """Each record as JSON: its mean confidence, and value and confidence by field."""
    entry = F.struct(field, F.struct(F.col(value).alias("valor"), F.col(confidence).alias("confianza")))
    whole = F.struct(F.round(F.avg(confidence), 3).alias("confianza_global"), F.map_from_entries(F.collect_list(entry)).alias("campos"))
    return fields.groupBy(key).agg(F.to_json(whole).alias("json"))


def to_store(df: DataFrame, fields: str, promoted: list[str], amount: str) -> DataFrame:
    """Storage columns: some fields as columns of their own, the amount in whole cents (cut off), all fields as JSON."""
    m = F.col(fields)
    return df.withColumns({**{p: F.try_element_at(m, F.lit(p)) for p in promoted}, f"{amount}_cents": F.floor(F.try_element_at(m, F.lit(amount)).try_cast("decimal(20,4)") * 100), fields: F.to_json(m)})


def from_store(df: DataFrame, fields: str) -> DataFrame:
    return df.withColumn(fields, F.from_json(fields, "map<string,string>"))


def with_known_ids(new: DataFrame, store: DataFrame, keys: list[str], record_id: str) -> DataFrame:
    """New rows with the id under which the store has their keys; ``fresh`` where it has none."""
    return new.join(store.select(*keys, record_id), keys, "left").withColumn("fresh", F.col(record_id).isNull())


def page_totals(df: DataFrame, number: int, size: int) -> DataFrame:
    """Page number, rows and pages of a list, one page at least."""
    return df.agg(F.count("*").alias("total")).select(F.lit(number).alias("number"), "total", F.greatest(F.ceil(F.col("total") / size), F.lit(1)).alias("pages"))


def by_id(df: DataFrame, key: str, value) -> DataFrame:
    """The record of an id; LookupError if there is none."""
    found = df.where(F.col(key) == value).limit(1)
    if found.isEmpty():
        raise LookupError(f"no record {value}")
    return found


def at_most(n: int) -> Callable[[Column], Column]:
    return lambda c: F.length(c) <= n


def one_of(values: list) -> Callable[[Column], Column]:
    return lambda c: c.isin(values)


def like_pattern(pattern: str) -> Callable[[Column], Column]:
    return lambda c: F.regexp_like(c, F.lit(f"^(?:{pattern})$"))


def valid(rules: dict[str, Callable[[Column], Column]]) -> Column:
    """Whether all columns keep their rules; null values do."""
    ok = F.lit(True)
    for name, rule in rules.items():
        ok &= F.coalesce(rule(F.col(name)), F.lit(True))
    return ok


def corrected(records: DataFrame, changes: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Records with corrections made by hand: such values are certain, their source is "manual", and the status is the given
    one or COMPLETO. ``changes`` holds one row a record, null where nothing changes."""
    new = changes.select(key, *[F.col(c).alias(f"__{c}") for c in columns], F.coalesce("status", F.lit("COMPLETO")).alias("__status"), F.lit(True).alias("__edited"))
    out = records.join(new, key, "left")
    edited = F.coalesce("__edited", F.lit(False))
    fixed = edited & F.greatest(*[F.col(f"__{c}").isNotNull() for c in columns], F.lit(False))
    set_to = {c: F.coalesce(f"__{c}", c) for c in columns} | {"confidence": F.when(fixed, 1.0).otherwise(F.col("confidence")), "source": F.when(fixed, "manual").otherwise(F.col("source")), "status": F.when(edited, F.col("__status")).otherwise(F.col("status"))}
    return out.select(*[set_to.get(c, F.col(c)).alias(c) for c in records.columns])


def deleted(log: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    """The latest version of each record after the rows of ``gone`` got a further version that says they are deleted."""
    from folioflow.operators.tables import latest

    now = latest(log, keys, ["version"])
    marks = now.join(gone, keys, "left_semi").withColumns({"version": F.col("version") + 1, "deleted": F.lit(True)})
    return latest(now.unionByName(marks), keys, ["version"])


def in_order_of(rows: DataFrame, order: DataFrame, key: str, ordinal: str) -> DataFrame:
    return rows.join(order.select(key, ordinal), key).orderBy(ordinal)


def since(rows: DataFrame, sequence: str, first) -> DataFrame:
    return rows.where(F.col(sequence) >= first)


def keys_in_order(order: str, key: str) -> Column:
    """Distinct keys of a group in the order of their first appearance."""
    return F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct(order, key))), lambda x: x[key]))


def merged(left: Column, right: Column) -> Column:
    """Entries of two maps; where both have a key, the right one's."""
    return F.map_concat(F.map_filter(left, lambda k, _: ~F.map_contains_key(right, k)), right)


def pooled(readings: dict[str, DataFrame]) -> DataFrame:
    """All readings of several readers, repeats kept, with the reader's name as ``source``."""
    out = None
    for name, df in readings.items():
        df = df.withColumn("source", F.lit(name))
        out = df if out is None else out.unionByName(df)
    return out


def as_json(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct("*")).alias("json"))
