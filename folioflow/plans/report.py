"""The rule pipeline: loosely structured JSON to typed report rows with observations."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from functools import reduce
from itertools import count
from operator import or_

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from folioflow.functions import values
from folioflow.functions.dates import months_elapsed, parse_plain_date
from folioflow.functions.numbers import amount_rules
from folioflow.functions.text import is_flag, is_negative, listed, quick_plain
from folioflow.functions.words import amount_words


@dataclass
class Rules:
    """Checked rule set. Raises ValueError where a field is missing or unknown."""

    max_months: int = 13
    formats: list[str] = field(default_factory=lambda: list(values.DATE_FORMATS))
    active: dict[str, bool] = field(default_factory=lambda: dict.fromkeys(values.RULES, True))

    def __post_init__(self):
        if isinstance(self.max_months, bool) or not isinstance(self.max_months, int) or self.max_months < 0:
            raise ValueError("the limit of months must be a whole number, 0 or more")
        if not self.formats:
            raise ValueError("at least one date format is needed")
        unknown = [f for f in self.formats if _key(f) not in values.DATE_FORMATS]
        if unknown:
            raise ValueError("unknown date formats: " + ", ".join(map(str, unknown)))
        self.formats = [_key(f) for f in self.formats]

    @classmethod
    def from_json(cls, text: str) -> "Rules":
        try:
            data = json.loads(text)
        except json.JSONDecodeError as e:
            raise ValueError(f"the rules are no valid JSON: {e}") from e
        date, checks = data.get("fecha") or {}, data.get("validaciones") or {}
        return cls(date.get("meses_maximos"), date.get("formatos") or [], {r: bool((checks.get(r) or {}).get("activa", True)) for r in values.RULES})


def _key(name: str) -> str:
    return " ".join(str(name).lower().split())


def _present(v, negatives: set[str]) -> bool:
    if v is None or isinstance(v, bool):
        return bool(v)
    if isinstance(v, (int, float)):
        return v != 0
    if isinstance(v, (list, dict)):
        return any(_present(x, negatives) for x in (v.values() if isinstance(v, dict) else v))
    t = " ".join(v.lower().split())
    return t not in negatives and not t.startswith("no ")


@F.pandas_udf(T.ArrayType(T.BooleanType()))
def _nested_present(raw: pd.Series) -> pd.Series:
    """For each JSON list or object whether any of its leaves, at any depth, means "present"; null stays null."""
    no = set(values.NEGATIVES)
    return raw.map(lambda xs: None if xs is None else [None if x is None else _present(json.loads(x), no) for x in xs])


def entries(payload: Column) -> Column:
    """Top-level members of a JSON object: (key, kind, text), keys without accents and capitals, blanks as underscores.
    Anything but an object gives an empty array."""
    out = F.transform(F.map_entries(F.from_json(payload, "map<string,variant>")), lambda e: F.struct(
        F.replace(quick_plain(e["key"]), F.lit(" "), F.lit("_")).alias("key"), F.regexp_extract(F.schema_of_variant(e["value"]), "^[A-Z]+", 0).alias("kind"), F.try_variant_get(e["value"], "$", "string").alias("text")))
    return F.coalesce(out, F.array().cast("array<struct<key:string,kind:string,text:string>>"))


def _number(v: Column) -> Column:
    return v["kind"].isin("BIGINT", "DECIMAL", "DOUBLE", "FLOAT", "INT", "SMALLINT", "TINYINT")


def with_members(df: DataFrame, payload: Column, name: str) -> DataFrame:
    """A map of the payload's members: key to (kind, text, denied, present). Of keys that agree after normalisation the first
    counts. An empty text counts as present, a denial does not."""
    df = df.withColumn("__e", entries(payload))
    # Rows without lists and objects send nothing to Python.
    nested = lambda e: e["kind"].isin("ARRAY", "OBJECT")
    df = df.withColumn("__n", _nested_present(F.when(F.exists("__e", nested), F.transform("__e", lambda e: F.when(nested(e), e["text"])))))
    df = df.withColumn("__k", F.transform("__e", lambda e: e["key"]))
    denied = lambda e: F.when(e["kind"] == "STRING", is_negative(e["text"])).otherwise(False)
    df = df.withColumn("__e", F.transform("__e", lambda e: F.struct(e["key"].alias("key"), e["kind"].alias("kind"), e["text"].alias("text"), denied(e).alias("denied"))))

    def read(e, i):
        flat = F.when(e["kind"] == "BOOLEAN", e["text"] == "true").when(_number(e), e["text"].try_cast("double") != 0).when(e["kind"] == "STRING", ~e["denied"])
        return F.struct(e["key"].alias("key"), F.struct(e["kind"].alias("kind"), e["text"].alias("text"), e["denied"].alias("denied"), F.coalesce(flat, F.get("__n", i), F.lit(False)).alias("present")).alias("value"), (F.array_position("__k", e["key"]) == i + 1).alias("first"))

    kept = F.transform(F.filter(F.transform("__e", read), lambda x: x["first"]), lambda x: F.struct(x["key"], x["value"]))
    return df.withColumn(name, F.map_from_entries(kept)).drop("__e", "__n", "__k")


def member(m: Column, key) -> Column:
    return F.try_element_at(m, key if isinstance(key, Column) else F.lit(key))


def _first(m: Column, keys: list[str], read) -> Column:
    """First non-null answer over keys in order; each key is looked up once."""
    there = F.filter(F.transform(listed(keys), lambda k: member(m, k)), lambda v: v.isNotNull())
    return F.get(F.filter(F.transform(there, read), lambda x: x.isNotNull()), F.lit(0))


def first_value(m: Column, group: str) -> Column:
    """First alias that is there and neither null nor empty, as (kind, text, present)."""
    return _first(m, values.ALIASES[group], lambda v: F.when((v["kind"] != "VOID") & ~((v["kind"] == "STRING") & (v["text"] == "")), v))


def first_text(m: Column, group: str) -> Column:
    """First alias with a text that is neither blank nor a denial, or with a number; empty if none."""
    text = lambda v: F.btrim(v["text"])
    return F.coalesce(_first(m, values.ALIASES[group], lambda v: F.when((v["kind"] == "STRING") & (text(v) != "") & ~v["denied"], text(v)).when(_number(v), text(v))), F.lit(""))


def any_present(m: Column, keys: list[str]) -> Column:
    return F.exists(listed(keys), lambda k: F.coalesce(member(m, k)["present"], F.lit(False)))


def visible(v: Column) -> Column:
    """Text of a scalar; empty for null, booleans, lists and objects."""
    return F.when((v["kind"] == "STRING") | _number(v), F.btrim(v["text"])).otherwise("")


def date_with_place(date: Column, place: Column) -> Column:
    return F.when(date == "", place).when((place == "") | F.contains(F.lower(date), F.lower(place)), date).otherwise(F.concat(place, F.lit(", "), date))


_reports = count()


def _fence(df: DataFrame, step: str) -> DataFrame:
    """Counts the rows that pass, and so keeps the optimiser from pasting one step's expressions into the next step's
    filters, where they would be evaluated many times over. Every report counts under names of its own."""
    return df.observe(f"report_{next(_reports)}_{step}", F.count(F.lit(1)).alias("rows"))


def report_rows(df: DataFrame, name: str, payload: str, rules: Rules, as_of: str, settle: bool = False) -> DataFrame:
    """One typed row for each record. A payload that is no JSON object gives a row of empty fields and failed rules.

    ``settle`` is for callers that ask for ``incluir`` alone: it stays right, but where a rule that needs no parsing has
    failed, amounts and dates are not parsed, so the other fields may say less.
    """
    df = _fence(df.select(F.col(name).alias("nombre_archivo"), F.col(payload).alias("__payload")), "records")
    df = _fence(with_members(df, F.col("__payload"), "m"), "members")
    m, number, endorsed = F.col("m"), first_value(F.col("m"), "valor_numero"), first_value(F.col("m"), "endoso")
    texts = {g: first_text(m, g) for g in ("cuenta_no", "cheque_no", "a_la_orden_de", "valor_texto", "cliente")}
    df = df.select(
        "nombre_archivo", "m", *[c.alias(g) for g, c in texts.items()], number["kind"].alias("kind"), number["text"].alias("raw"),
        F.when(endorsed["kind"] == "STRING", F.btrim(endorsed["text"])).otherwise("").alias("note"),
        date_with_place(visible(first_value(m, "fecha")), visible(first_value(m, "lugar"))).alias("fecha"),
    )
    own = member(m, "endoso")
    signed_off = F.when((F.col("note") != "") & ~is_negative(F.col("note")), True).when(any_present(m, ["endoso_presente", "tiene_endoso", "endosado"]), True)
    signed_off = signed_off.when(own["kind"] == "STRING", (F.btrim(own["text"]) != "") & ~own["denied"]).otherwise(own["present"])
    seen = {"firma": any_present(m, values.ALIASES["firma"]), "beneficiario": F.col("a_la_orden_de") != "", "endoso": F.coalesce(signed_off, F.lit(False))}
    df = _fence(_fence(df, "texts").withColumns({"__plain": quick_plain(F.col("fecha")), **seen}), "dates")
    failed = reduce(or_, [~F.col(r) for r in seen if settle and rules.active.get(r, True)], F.lit(False))
    parsed = {
        "valor_numero": F.when(F.col("kind") != "BOOLEAN", amount_rules(F.btrim("raw"))), "__words": amount_words(F.col("valor_texto")),
        "__date": parse_plain_date(F.col("__plain"), rules.formats),
    }
    df = _fence(df.withColumns({k: F.when(~failed, c) if settle else c for k, c in parsed.items()}), "values")
    rows = df.select(
        "nombre_archivo", "cuenta_no", "cheque_no", "a_la_orden_de", "valor_numero",
        F.when(F.col("valor_numero").isNull() & (F.col("kind") != "BOOLEAN"), F.btrim("raw")).alias("valor_numero_texto"),
        "valor_texto", "cliente", "fecha", F.when(is_flag(F.col("note")), "").otherwise(F.col("note")).alias("endoso_texto"),
        "firma", "beneficiario",
        F.coalesce(F.col("valor_numero") == F.col("__words"), F.lit(False)).alias("coincide_valor"),
        F.coalesce(months_elapsed(F.col("__date"), F.lit(as_of).cast("date")) < rules.max_months, F.lit(False)).alias("fecha_correcta"),
        "endoso",
    )
    return _fence(rows, "flags").withColumn("incluir", reduce(or_, [~F.col(r) for r in values.RULES if rules.active.get(r, True)], F.lit(False)))


def report_totals(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count("*").alias("leidos"), F.count_if("incluir").alias("con_observaciones"), F.count_if(~F.col("incluir")).alias("sin_observaciones"))
