"""Zones of a form out of the text boxes that a detector found on it: by what the boxes say, and by where printed labels stand.

A page is some dozens of boxes. They are gathered once, and every rule is an expression over that array, so a plan of all
zones has one shuffle, by page. A box is a struct of idx, x0, y0, x1, y1 and what the rule asks for; where several boxes
rank alike, the one of the lowest idx counts. Measures are pixels of the page, ``unit`` is the height of its print.

Nulls: a box without a coordinate belongs to no zone; a null text says nothing; pages without boxes have no row.
"""

from __future__ import annotations

import difflib
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from folioflow.functions import values
from folioflow.functions.dates import digits_repaired, earliest_date, slash_readings
from folioflow.functions.text import compact, let, plain

ZONES = ["ciudad_fecha", "monto_letras", "monto_letras_2", "monto_numeros", "beneficiario"]
_BOX = "struct<x0:double,y0:double,x1:double,y1:double>"


def _cy(b: Column) -> Column:
    return (b["y0"] + b["y1"]) / 2


def _best(boxes: Column, *rank) -> Column:
    """The box of the highest rank (functions of a box), of equals the one of the lowest idx; null without boxes."""
    return F.array_max(F.transform(boxes, lambda b: F.struct(*[r(b).alias(f"r{i}") for i, r in enumerate(rank)], (-b["idx"]).alias("last"), b.alias("box"))))["box"]


def _edge(boxes: Column, side: str) -> Column:
    """The outermost coordinate of the boxes on a side."""
    at = F.transform(boxes, lambda b: b[side])
    return F.array_min(at) if side in ("x0", "y0") else F.array_max(at)


def _only(b: Column) -> Column:
    return F.filter(F.array(b), lambda x: x.isNotNull())


def _without(boxes: Column, used: Column) -> Column:
    return F.filter(boxes, lambda b: ~F.array_contains(used, b["idx"]))


def _ids(boxes: Column) -> Column:
    return F.transform(boxes, lambda b: b["idx"])


def _around(boxes: Column, margin: float = 0.35) -> Column:
    """The zone round the boxes, cut to the page; null without boxes."""
    w, h, unit = F.col("w"), F.col("h"), F.col("unit")
    whole = lambda c, most: F.least(F.greatest(F.floor(c), F.lit(0)), F.floor(most)).cast("double")
    zone = F.struct(
        whole(_edge(boxes, "x0") - 4, w).alias("x0"), whole(_edge(boxes, "y0") - margin * unit, h).alias("y0"),
        F.least(F.floor(_edge(boxes, "x1") + 4), F.floor(w)).cast("double").alias("x1"), F.least(F.floor(_edge(boxes, "y1") + margin * unit), F.floor(h)).cast("double").alias("y1"),
    )
    return F.when(F.size(boxes) > 0, zone)


def said(boxes: DataFrame, names: list[str]) -> DataFrame:
    """What a box's text says, as columns: ``dated`` (2 a date, 1.5 only its form, 0), ``words`` (number words), ``figures``
    and ``name`` (scores), ``digit`` (has one), ``printed`` (known print). ``names``: known given names and surnames."""
    c = F.coalesce("text", F.lit(""))
    spaced = digits_repaired(F.regexp_replace(c, values.LETTER_THEN_DIGIT, " "))
    # Every kind of date has a year in four digits, and only groups with a digit are repaired, so most texts are not searched.
    dates = lambda x: F.regexp_like(x, F.lit("(?:[0-9][^0-9]*){4}")) & F.exists(slash_readings(x), lambda t: earliest_date(t).isNotNull())
    date = F.when(F.regexp_like(c, F.lit("[0-9]")), let(spaced, dates))
    tokens = F.filter(F.split(plain(c), "[^a-zñ]+"), lambda x: x != "")
    numbers = F.size(F.filter(tokens, lambda x: x.isin([w for w in values.NUMBER_SPEECH if len(w) >= 3])))
    alnum = F.regexp_replace(c, "[^0-9a-zA-Z]", "")
    n = F.length(F.regexp_replace(alnum, "[^0-9]", ""))
    figures = F.when((n >= 2) & (n >= 0.6 * F.length(alnum)), 2.0 + F.when(F.regexp_like(c, F.lit(r"[0-9][.,]\s*[0-9]")), 1.0).otherwise(0.0) + F.when(F.contains(c, F.lit("$")), 0.5).otherwise(0.0)).otherwise(0.0)
    spelled = F.regexp_extract_all(c, F.lit("([A-Za-zÁÉÍÓÚÑÜáéíóúñü]{2,})"))
    count = F.size(spelled)
    known = F.size(F.filter(spelled, lambda x: plain(x).isin([*names])))
    capitals = F.size(F.filter(spelled, lambda x: F.regexp_like(x, F.lit("^[A-ZÁÉÍÓÚÑÜ]"))))
    digit = F.regexp_like(c, F.lit("[0-9]"))
    is_name = (count > 0) & ~digit & (numbers < F.greatest(F.lit(1), F.floor(count / 2)))
    printed = F.regexp_like(compact(c), F.lit("|".join(map(re.escape, values.PRINT)))) | misread_legend(compact(c))
    return boxes.withColumns({
        "dated": F.when(date, 2.0).when(F.regexp_like(c, F.lit(values.DATE_FORM)), 1.5).otherwise(0.0), "words": numbers, "figures": figures,
        "name": F.when(is_name, 1.0 + 1.5 * known + 0.3 * capitals + 0.3 * F.least(count, F.lit(4))).otherwise(0.0), "digit": digit, "printed": printed, "letters": F.length(compact(c)),
    })


@F.pandas_udf(T.BooleanType())
def misread_legend(tight: pd.Series) -> pd.Series:
    """Whether a compact text of eight characters or more is like a whole line of print; asked once for each distinct text of a batch."""
    def like(t):
        return any(difflib.SequenceMatcher(None, t, legend).ratio() >= values.LEGEND_LEAST for legend in values.LEGENDS)

    asked = {t: like(t) for t in tight.dropna().unique() if len(t) >= 8}
    return tight.map(lambda t: asked.get(t, False))


def written_parts(boxes: DataFrame, least: float = 12) -> DataFrame:
    """Boxes (text, label, label_end) and, for each whose label goes over into writing, one more with what is written; ``part``
    tells these apart."""
    at = F.bround((F.col("label_end") - F.col("x0")) / F.greatest(F.col("x1") - F.col("x0"), F.lit(1.0)) * F.length("text")).cast("int")
    rest = F.trim(F.substr("text", at + 1))
    glued = F.col("label").isNotNull() & (F.col("label_end") < F.col("x1") - least) & (F.length(compact(rest)) > 0)
    changed = {"text": rest, "x0": F.col("label_end"), "label": F.lit(None).cast("string"), "idx": F.col("idx") + F.lit(1 << 20)}
    own = F.struct(*[F.col(c).alias(c) for c in changed], F.lit(False).alias("part"))
    both = F.array(own, F.struct(*[v.alias(c) for c, v in changed.items()], F.lit(True).alias("part")))
    rows = boxes.withColumn("__box", F.explode(F.when(glued, both).otherwise(F.array(own))))
    return rows.select(*[F.col(f"__box.{c}" if c in changed else c) for c in boxes.columns], "__box.part")


def gathered(boxes: DataFrame, pages: DataFrame | None, *columns: str) -> DataFrame:
    """One row for each page: its columns (page, w, h), ``boxes`` in the order of idx, ``labels``, the first box of each
    label from the top, and ``unit``, the median height of labels, or a twentieth of the page without any. Without ``pages``
    the boxes have w and h of their page themselves."""
    whole = F.col("x0").isNotNull() & F.col("y0").isNotNull() & F.col("x1").isNotNull() & F.col("y1").isNotNull()
    box = F.struct(F.col("idx").cast("long").alias("idx"), *[F.col(c).cast("double").alias(c) for c in ("x0", "y0", "x1", "y1")], "label", F.coalesce(F.col("label_end"), F.col("x1")).cast("double").alias("end"), *columns)
    size = [F.max(c).alias(c) for c in ("w", "h")] if pages is None else []
    rows = boxes.where(whole).groupBy("page").agg(F.array_sort(F.collect_list(box)).alias("boxes"), *size)
    if pages is not None:
        rows = rows.join(pages.select("page", "w", "h"), "page")
    labelled = F.filter("boxes", lambda b: b["label"].isNotNull())
    rows = rows.withColumn("labelled", labelled)
    heights = F.array_sort(F.transform("labelled", lambda b: b["y1"] - b["y0"]))
    n = F.size(heights)
    rows = rows.withColumn("unit", F.when(n > 0, (F.get(heights, ((n - 1) / 2).cast("int")) + F.get(heights, (n / 2).cast("int"))) / 2).otherwise(0.05 * F.col("h")))
    names = F.array_distinct(F.transform("labelled", lambda b: b["label"]))
    first = F.transform(names, lambda n: F.struct(n.alias("key"), _best(F.filter("labelled", lambda b: b["label"] == n), lambda b: -b["y0"], lambda b: -b["x0"]).alias("value")))
    return rows.withColumn("labels", F.map_from_entries(first))


def _row_fold(boxes: Column, share: Column) -> Column:
    """Boxes from the top into rows: one opens a row where its middle lies ``share`` or more from the mean of the last row's."""

    def step(rows, b):
        last = F.element_at(rows, -1)
        mean = F.aggregate(last, F.lit(0.0), lambda a, x: a + _cy(x)) / F.size(last)
        joins = (F.size(rows) > 0) & (F.abs(_cy(b) - mean) < share)
        return F.when(joins, F.concat(F.slice(rows, 1, F.size(rows) - 1), F.array(F.concat(last, F.array(b))))).otherwise(F.concat(rows, F.array(F.array(b))))

    ordered = F.transform(F.array_sort(F.transform(boxes, lambda b: F.struct(_cy(b).alias("cy"), b["idx"].alias("idx"), b.alias("b")))), lambda s: s["b"])
    return F.when(F.size(boxes) > 0, F.aggregate(ordered, F.slice(F.array(ordered), 1, 0), step))


def by_content(pages: DataFrame) -> DataFrame:
    """Zones by what the boxes say: pages of ``gathered`` with dated, words, figures, name, digit, printed, letters of every box.

    Four stages, each over the boxes that those before it left: the date, with what stands before it; the amount in words,
    its first row grown to the right until a gap, and rows close below it; the amount in figures, with its raised cents; the
    payee, below its label and above the words. Writing is taller than print, and a box near the label of its field gains.
    Rows page, zone, x0, y0, x1, y1.
    """
    return _listed(*_by_content(pages))


def _by_content(pages: DataFrame) -> tuple[DataFrame, dict[str, Column]]:
    """The pages, and each zone as an expression over them."""
    w, h, unit, labels = F.col("w"), F.col("h"), F.col("unit"), F.col("labels")
    tall = lambda b: F.when(b["y1"] - b["y0"] > 1.25 * unit, 1.0).otherwise(0.0)
    small = lambda b, x: F.when(b["y1"] - b["y0"] < 1.15 * unit, x).otherwise(0.0)

    def near(b, names, gain, dx=0.45, dy=2.5):
        found = F.lit(False)
        for name in names:
            e = F.try_element_at(labels, F.lit(name))
            gap = b["x0"] - e["end"]
            found |= F.coalesce((F.abs(_cy(b) - _cy(e)) < dy * unit) & (gap > -0.05 * w) & (gap < dx * w), F.lit(False))
        return F.when(found, gain).otherwise(0.0)

    free = F.filter("boxes", lambda b: b["label"].isNull() & ~b["printed"] & (_cy(b) < 0.82 * h) & (b["letters"] >= 1))
    p = pages.withColumn("free", free)

    date = _best(F.filter("free", lambda b: b["dated"] > 0), lambda b: b["dated"] + near(b, ["ciudad", "fecha"], 1.0) + 2 * tall(b) - small(b, 2.0), lambda b: -b["y0"])
    p = p.withColumn("date", date)
    before = F.filter("free", lambda b: (b["idx"] != F.col("date.idx")) & (F.abs(_cy(b) - _cy(F.col("date"))) < 0.7 * unit) & (b["x1"] > F.col("date.x0") - 0.35 * w) & (b["x1"] <= F.col("date.x0") + 4) & ~b["digit"])
    p = p.withColumn("dates", F.concat(_only(F.col("date")), F.coalesce(before, F.slice("free", 1, 0)))).withColumn("free", _without(F.col("free"), _ids(F.col("dates"))))

    p = p.withColumn("rows", F.coalesce(_row_fold(F.filter("free", lambda b: (b["words"] >= 1) & (b["figures"] == 0)), 0.7 * unit), F.slice(F.array("free"), 1, 0)))
    p = p.withColumn("row", F.coalesce(F.get("rows", F.lit(0)), F.slice("free", 1, 0)))
    mid = lambda row: F.aggregate(row, F.lit(0.0), lambda a, b: a + _cy(b)) / F.size(row)
    p = p.withColumn("mid", F.when(F.size("row") > 0, mid(F.col("row"))))
    beside = F.filter(_without(F.col("free"), _ids(F.col("row"))), lambda b: F.abs(_cy(b) - F.col("mid")) < 0.7 * unit)
    rightwards = F.transform(F.array_sort(F.transform(beside, lambda b: F.struct(b["x0"].alias("x0"), b["idx"].alias("idx"), b.alias("b")))), lambda s: s["b"])

    def grow(row, b):
        end = _edge(row, "x1")
        return F.when((b["x0"] >= end - 6) & (b["x0"] <= end + 0.12 * w), F.concat(row, F.array(b))).otherwise(row)

    p = p.withColumn("grown", F.when(F.size("row") > 0, F.aggregate(rightwards, F.col("row"), grow)).otherwise(F.col("row")))
    p = p.withColumn("below", F.flatten(F.filter(F.slice("rows", 2, 2), lambda r: mid(r) - F.col("mid") < 2.5 * unit)))
    p = p.withColumn("spoken", F.concat("grown", "below")).withColumn("free", _without(F.col("free"), _ids(F.col("spoken"))))

    head = lambda b: near(b, ["cheque"], 1.0, 0.35, 1.6) > 0
    figures = F.filter("free", lambda b: (b["figures"] > 0) & (_cy(b) >= 0.12 * h) & ~head(b))
    rank = lambda b: b["figures"] + tall(b) - small(b, 1.5) + near(b, ["moneda"], 1.5, 0.4, 1.5) + F.when(b["x0"] > 0.55 * w, 0.5).otherwise(0.0)
    p = p.withColumn("figure", _best(figures, rank))
    f = F.col("figure")
    cents = F.filter("free", lambda b: (b["idx"] != f["idx"]) & b["digit"] & (b["x0"] >= (f["x0"] + f["x1"]) / 2) & (b["x0"] <= f["x1"] + 0.15 * w) & (b["x1"] > f["x1"]) & (_cy(b) >= f["y0"] - 1.2 * unit) & (_cy(b) <= f["y1"]))
    p = p.withColumn("counted", F.concat(_only(f), F.coalesce(cents, F.slice("free", 1, 0)))).withColumn("free", _without(F.col("free"), _ids(F.col("counted"))))

    top = F.coalesce(F.try_element_at(labels, F.lit("paguese"))["y0"] - 1.2 * unit, 0.12 * h)
    bottom = F.least(h, _edge(F.col("spoken"), "y0"), _cy(F.try_element_at(labels, F.lit("suma"))))
    p = p.withColumns({"top": top, "bottom": bottom})
    between = F.filter("free", lambda b: (_cy(b) >= F.col("top")) & (_cy(b) <= F.col("bottom")) & (b["name"] > 0))
    p = p.withColumn("named", _best(between, lambda b: b["name"] + tall(b) - small(b, 2.0) + near(b, ["orden", "paguese"], 2.0)))
    m = F.col("named")
    rest = F.filter("free", lambda b: (b["idx"] != m["idx"]) & (F.abs(_cy(b) - _cy(m)) < 0.6 * unit) & (b["name"] > 0) & (F.abs(b["x0"] - m["x1"]) < 0.12 * w))
    p = p.withColumn("payee", F.concat(_only(m), F.coalesce(rest, F.slice("free", 1, 0))))

    return p, {"ciudad_fecha": _around(F.col("dates")), "monto_letras": _around(F.col("grown")), "monto_letras_2": _around(F.col("below")), "monto_numeros": _around(F.col("counted"), 0.6), "beneficiario": _around(F.col("payee"))}


def _listed(pages: DataFrame, found: dict[str, Column]) -> DataFrame:
    entries = F.array(*[F.struct(F.lit(k).alias("zone"), z.cast(_BOX).alias("z")) for k, z in found.items()])
    rows = pages.select("page", F.explode(F.filter(entries, lambda e: e["z"].isNotNull())).alias("e"))
    return rows.select("page", "e.zone", *[F.col(f"e.z.{c}").cast("long").alias(c) for c in ("x0", "y0", "x1", "y1")])


def by_labels(pages: DataFrame) -> DataFrame:
    """Zones by printed labels (pages of ``gathered`` with ``text`` and ``letters``): to the right of a label, or above one that
    stands below its field, up to the next label; what has no label of its own is placed from the labels that are there.

    Glued labels of the left margin end at the margin's usual edge, the median of those that stand alone.
    Rows page, zone, x0, y0, x1, y1; zones of 8 pixels or less across, or 6 or less high, are none.
    """
    return _listed(*_by_labels(pages))


def _by_labels(pages: DataFrame) -> tuple[DataFrame, dict[str, Column]]:
    """The pages, and each zone as an expression over them."""
    w, h, unit = F.col("w"), F.col("h"), F.col("unit")
    margin = ("paguese", "orden", "suma", "ciudad", "fecha")
    alone = F.array_sort(F.transform(F.filter("labelled", lambda b: b["label"].isin(*margin) & (b["x0"] < 0.2 * w) & (b["end"] == b["x1"])), lambda b: b["x1"]))
    n = F.size(alone)
    p = pages.withColumn("edge", F.when(n > 0, (F.get(alone, ((n - 1) / 2).cast("int")) + F.get(alone, (n / 2).cast("int"))) / 2))
    cut = lambda b: F.when((b["end"] < b["x1"]) & (b["x0"] < 0.2 * w) & F.col("edge").isNotNull(), F.least(b["end"], F.col("edge") + 0.01 * w)).otherwise(b["end"])
    p = p.withColumn("labelled", F.transform("labelled", lambda b: b.withField("end", cut(b))))

    def first(*names):
        return _best(F.filter("labelled", lambda b: b["label"].isin(*names)), lambda b: -b["y0"], lambda b: -b["x0"])

    for column, name in (("currency", "moneda"), ("sum", "suma"), ("dollars", "dolares"), ("number", "cheque"), ("account", "cuenta"), ("pay", "paguese"), ("order", "orden")):
        p = p.withColumn(column, first(name))
    p = p.withColumn("refs", F.filter(F.array("pay", "order"), lambda b: b.isNotNull()))
    p = p.withColumn("written", F.filter("boxes", lambda b: b["label"].isNull()))

    def rect(x0, y0, x1, y1):
        zone = F.struct(F.greatest(x0.cast("long"), F.lit(0)).alias("x0"), F.greatest(y0.cast("long"), F.lit(0)).alias("y0"), F.least(x1.cast("long"), w.cast("long")).alias("x1"), F.least(y1.cast("long"), h.cast("long")).alias("y1"))
        return F.get(F.filter(F.array(zone), lambda z: (z["x1"] - z["x0"] > 8) & (z["y1"] - z["y0"] > 6)), F.lit(0))

    cur, suma, dol = F.col("currency"), F.col("sum"), F.col("dollars")
    has_refs = F.size("refs") > 0
    ref = {s: _edge(F.col("refs"), s) for s in ("y0", "y1", "end")}
    start = F.array_max(F.transform("refs", lambda b: b["end"])) + 2
    p = p.withColumns({"ry0": ref["y0"], "ry1": ref["y1"], "rend": start})
    payee = F.when(has_refs, rect(F.col("rend"), F.col("ry0") - 0.4 * unit, F.when(cur["x0"] > F.col("rend") + 40, cur["x0"] - 3).otherwise(0.76 * w), F.col("ry1") + 0.5 * unit))

    # Without its own label the amount is what has digits at the right end of the payee's row.
    right = F.filter("written", lambda b: (b["x0"] > 0.7 * w) & (_cy(b) > F.col("ry0") - 0.5 * unit) & (_cy(b) < F.col("ry1") + 0.5 * unit) & F.regexp_like(compact(b["text"]), F.lit("[0-9]")))
    from_x = F.least(0.74 * w, F.array_min(F.transform(right, lambda b: b["x0"] - 0.12 * w)))
    figures = F.when(cur.isNotNull(), rect(cur["end"] + 1, cur["y0"] - 1.3 * unit, w, cur["y1"] + 0.6 * unit)).when(has_refs, rect(F.greatest(from_x, 0.6 * w), F.col("ry0") - unit, w, F.col("ry1") + 0.5 * unit))

    y1 = suma["y1"] + 0.5 * unit
    beside = F.abs(_cy(dol) - _cy(suma)) < unit
    words = F.when(suma.isNotNull(), rect(suma["end"] - 0.03 * w, suma["y0"] - 0.7 * unit, F.when(beside, dol["x0"] - 2).otherwise(w), y1))
    under = _cy(dol) > suma["y1"]
    second = F.when(under, rect(F.lit(0.0), y1, dol["x0"] - 2, dol["y1"] + 0.3 * unit)).otherwise(rect(F.lit(0.0), y1, 0.9 * w, y1 + 1.4 * unit))
    p = p.withColumns({"second": F.when(suma.isNotNull(), second), "words_end": F.when(suma.isNotNull(), F.when(under, dol["y1"] + 0.3 * unit).otherwise(y1 + 1.4 * unit))})
    s = F.col("second")
    seen = F.exists("written", lambda b: ((b["x0"] + b["x1"]) / 2).between(s["x0"], s["x1"]) & _cy(b).between(s["y0"], s["y1"]) & (b["letters"] >= 2))
    words2 = F.when(F.coalesce(seen, F.lit(False)), s)

    p = p.withColumn("city", F.filter("labelled", lambda b: b["label"].isin("ciudad", "fecha")))
    p = p.withColumns({"cy0": _edge(F.col("city"), "y0"), "cy1": _edge(F.col("city"), "y1"), "cend": F.array_max(F.transform("city", lambda b: b["end"]))})
    stands_below = F.exists("city", lambda b: F.regexp_like(compact(b["text"]), F.lit("lugar|emision")))
    limit = F.coalesce(F.least(0.62 * w, F.array_min(F.transform(F.filter("labelled", lambda b: (b["label"] == "firma") & (b["x0"] > F.col("cend"))), lambda b: b["x0"]))), 0.62 * w)
    p = p.withColumn("limit", limit)
    to_right = F.filter("written", lambda b: ~stands_below & ((b["x0"] + b["x1"]) / 2 > F.col("cend")) & (b["x0"] < F.col("limit")) & (_cy(b) > F.col("cy0") - unit) & (_cy(b) < F.col("cy1") + 0.5 * unit))
    p = p.withColumns({"to_right": to_right, "ceiling": F.coalesce("words_end", F.col("cy0") - 3 * unit)})
    over = F.filter("written", lambda b: (_cy(b) > F.col("ceiling") - unit) & (_cy(b) < F.col("cy0")) & (b["x0"] < 0.6 * w))
    place = F.when(F.size("city") > 0, F.when(F.size("to_right") > 0, rect(F.col("cend") + 2, F.col("cy0") - 0.5 * unit, _edge(F.col("to_right"), "x1") + 6, F.col("cy1") + 0.4 * unit))
                   .otherwise(rect(F.lit(0.0), F.col("ceiling"), F.coalesce(_edge(over, "x1"), 0.6 * w) + 6, F.col("cy0") + 0.2 * unit)))
    after = lambda b: F.when(b.isNotNull(), rect(b["end"] + 1, b["y0"] - 0.4 * unit, F.least(w, b["end"] + 0.3 * w), b["y1"] + 0.4 * unit))
    line = F.filter("boxes", lambda b: (_cy(b) > 0.75 * h) & (b["letters"] >= 4) & (F.length(F.regexp_replace(compact(b["text"]), "[^0-9]", "")) >= 0.5 * b["letters"]))
    p = p.withColumn("line", line)
    micr = F.when(F.size("line") > 0, rect(F.lit(0.0), _edge(F.col("line"), "y0") - 0.3 * unit, w, _edge(F.col("line"), "y1") + 0.3 * unit))
    return p, {"beneficiario": payee, "monto_numeros": figures, "monto_letras": words, "monto_letras_2": words2, "ciudad_fecha": place, "cheque_impreso": after(F.col("number")), "cuenta_impresa": after(F.col("account")), "micr": micr}


def zones(pages: DataFrame) -> DataFrame:
    """Zones by content where there are any, else by labels, with ``source``, all of a page in its own row. Boxes with ``part``
    (``written_parts``) count for the content only. Where the content has the amount in words in one row, the labels' second row goes."""
    p, content = _by_content(pages)
    p = p.select(*pages.columns, *[z.cast(_BOX).alias(f"by_content_{k}") for k, z in content.items()])
    if "part" in pages.schema["boxes"].dataType.elementType.names:
        p = p.withColumn("boxes", F.filter("boxes", lambda b: ~b["part"]))
    p, labels = _by_labels(p)
    found = {}
    for k in content | labels:
        said, laid = (F.struct(z.cast(_BOX).alias("z"), F.lit(source).alias("source")) if z is not None else None for z, source in ((F.col(f"by_content_{k}") if k in content else None, "content"), (labels.get(k), "label")))
        if k == "monto_letras_2":
            laid = F.when(F.col("by_content_monto_letras").isNull(), laid)
        found[k] = laid if said is None else said if laid is None else F.when(said["z"].isNotNull(), said).otherwise(laid)
    entries = F.array(*[F.struct(F.lit(k).alias("zone"), z["z"].alias("z"), z["source"].alias("source")) for k, z in found.items()])
    rows = p.select("page", F.explode(F.filter(entries, lambda e: e["z"].isNotNull())).alias("e"))
    return rows.select("page", "e.zone", *[F.col(f"e.z.{c}").cast("long").alias(c) for c in ("x0", "y0", "x1", "y1")], "e.source")
