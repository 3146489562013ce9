"""Ordered operators: runs, gaps, neighbours, spans, positions on a page."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from folioflow.session import matched, portioned, spread


def drop_repeats(df: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """Rows whose value differs from the one before it in the group."""
    before = F.lag(value).over(Window.partitionBy(*keys).orderBy(order))
    return df.withColumn("__before", before).where(~F.col(value).eqNullSafe(F.col("__before")) | F.col("__before").isNull()).drop("__before")


def gap_runs(df: DataFrame, keys: list[str], order: str, start: Column, end: Column, gap: float, name: str = "run") -> DataFrame:
    """Numbers runs from 0; a run ends where the next start lies more than ``gap`` beyond every end so far."""
    w = Window.partitionBy(*keys).orderBy(order)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = df.withColumn("__new", F.coalesce((start - reach > gap).cast("int"), F.lit(0)))
    return rows.withColumn(name, F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("long")).drop("__new")


def sliding_concat(df: DataFrame, keys: list[str], order: str, value: str, width: int, name: str) -> DataFrame:
    """Each row's value joined with the next ``width - 1``."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(0, width - 1)
    return df.withColumn(name, F.array_join(F.collect_list(value).over(w), " "))


def until_stop(df: DataFrame, keys: list[str], order: str, stop: Column) -> DataFrame:
    """Rows of each group before the first at which ``stop`` holds."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("__stop", F.max(F.coalesce(stop, F.lit(False))).over(w)).where(~F.col("__stop")).drop("__stop")


def span_overlap(a: DataFrame, b: DataFrame, keys: list[str], a_span: tuple[str, str], b_span: tuple[str, str]) -> DataFrame:
    """Pairs of half-open spans of one group that overlap: an equi-join on the group with the interval as residual."""
    return a.join(b, keys).where((F.col(a_span[0]) < F.col(b_span[1])) & (F.col(a_span[1]) > F.col(b_span[0])))


def right_of(anchors: DataFrame, tokens: DataFrame, keys: list[str], max_dx: float, max_dy: float) -> DataFrame:
    """Tokens in an anchor's row to its right: columns x, y of both sides (anchor_x, anchor_y)."""
    dx = F.col("x") - F.col("anchor_x")
    return anchors.join(tokens, keys).where((dx > 0) & (dx <= max_dx) & (F.abs(F.col("y") - F.col("anchor_y")) <= max_dy))


def first_below(anchors: DataFrame, tokens: DataFrame, keys: list[str], anchor: str, max_dy: float) -> DataFrame:
    """The nearest token below each anchor within ``max_dy`` (ties by x)."""
    pairs = anchors.join(tokens, keys).where((F.col("y") > F.col("anchor_y")) & (F.col("y") - F.col("anchor_y") <= max_dy))
    return pairs.groupBy(*keys, anchor).agg(F.min_by(F.struct("x", "y"), F.struct("y", "x")).alias("__b")).select(*keys, anchor, "__b.x", "__b.y")


def page_rows(tokens: DataFrame, key: str, height: float = 0.7) -> DataFrame:
    """Groups the tokens of one page into rows: reading from the top, a token opens a row if its middle is at least
    ``height`` token heights from the running mean of the current row. The mean depends on the choices before it, so
    each page (some dozens of tokens) is folded in order; a token without a position stays in the row before it."""

    def step(s, t):
        new = (s["row"] < 0) | F.coalesce(F.abs(t["cy"] - s["mean"]) >= height * t["h"], F.lit(False))
        row = s["row"] + new.cast("long")
        mean = F.when(new, t["cy"]).otherwise((s["mean"] * s["n"] + t["cy"]) / (s["n"] + 1))
        return F.struct(
            row.alias("row"),
            F.coalesce(mean, s["mean"]).alias("mean"),
            (F.when(new, 0).otherwise(s["n"]) + 1).cast("int").alias("n"),
            F.concat(s["out"], F.array(F.struct(t["idx"].alias("idx"), row.alias("row")))).alias("out"),
        )

    zero = F.expr("named_struct('row', -1L, 'mean', 0D, 'n', 0, 'out', cast(array() AS array<struct<idx: bigint, row: bigint>>))")
    return _folded(tokens, key, ("cy", "x0", "idx", "h"), zero, step, lambda s: s["out"])


def _folded(tokens: DataFrame, key: str, columns: tuple[str, ...], zero: Column, step, end) -> DataFrame:
    """Folds the tokens of each page in the order of the columns into an array of structs, and lists those."""
    token = F.struct(*[F.col(c).cast("long" if c == "idx" else "double").alias(c) for c in columns])
    pages = tokens.groupBy(key).agg(F.array_sort(F.collect_list(token)).alias("__tokens"))
    return pages.select(key, F.inline(F.aggregate("__tokens", zero, step, end)))


def reading_order(df: DataFrame, keys: list[str], cy: str, x: str, name: str = "at") -> DataFrame:
    """Numbers the tokens of a page from 0 as they are read: by height to two places, then from the left."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(F.round(cy, 2), x)) - 1)


def following(df: DataFrame, keys: list[str], order: str, value: str, name: str) -> DataFrame:
    """Each row with the value of the next one of its group."""
    return df.withColumn(name, F.lead(value).over(Window.partitionBy(*keys).orderBy(order)))


def inside(tokens: DataFrame, regions: DataFrame, keys: list[str]) -> DataFrame:
    """Tokens (cx, cy) whose middle lies in a region (x0, y0, x1, y1) of their page, borders included."""
    return tokens.join(regions, keys).where(F.col("cx").between(F.col("x0"), F.col("x1")) & F.col("cy").between(F.col("y0"), F.col("y1")))


def near_label(boxes: DataFrame, labels: DataFrame, keys: list[str], dx: float, dy: float) -> DataFrame:
    """Every box (cx, cy) with whether its page has a label (lx, ly, lh) within dx of the page and dy label heights."""
    near = (F.abs(F.col("cx") - F.col("lx")) <= dx) & (F.abs(F.col("cy") - F.col("ly")) <= dy * F.col("lh"))
    found = portioned(boxes, *keys).join(labels, keys, "left").groupBy(*boxes.columns).agg(F.coalesce(F.max(near.cast("int")), F.lit(0)).alias("near"))
    return found.withColumn("near", F.col("near") == 1)


def _common(a: str, b: str) -> Column:
    side = lambda lo, hi: F.greatest(F.least(f"{a}{hi}", f"{b}{hi}") - F.greatest(f"{a}{lo}", f"{b}{lo}"), F.lit(0))
    return side("x0", "x1") * side("y0", "y1")


def covered_zones(zones: DataFrame, boxes: DataFrame, keys: list[str], share: float = 0.3, least: int = 2) -> DataFrame:
    """Pages with the number of their zones (z_x0, ...) of which a box (b_x0, ...) covers more than ``share``; from ``least`` on they are illegible."""
    area = (F.col("z_x1") - F.col("z_x0")) * (F.col("z_y1") - F.col("z_y0"))
    hit = zones.join(boxes, keys).groupBy(*keys, "zone").agg(F.max((_common("z_", "b_") > share * area).cast("int")).alias("hit"))
    return hit.groupBy(*keys).agg(F.sum("hit").alias("covered")).withColumn("illegible", F.col("covered") >= least)


def spans_of_tokens(df: DataFrame, keys: list[str], order: str, value: str, gap: int = 2) -> DataFrame:
    """Where each token lies in the text of its row, tokens joined by ``gap`` blanks: columns start and end."""
    n = F.length(value) + gap
    w = Window.partitionBy(*keys).orderBy(order)
    return df.withColumn("start", F.coalesce(F.sum(n).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("end", F.col("start") + F.length(value))


def rows_by_overlap(tokens: DataFrame, key: str, share: float = 0.5) -> DataFrame:
    """Groups the tokens (idx, cy, y0, y1) of a page into rows, from the top: a token joins the first row that it
    overlaps by more than ``share`` of the lesser height, else it opens one. A row grows with its tokens, so each
    page (some dozens of tokens) is folded in order. Rows are numbered from the top."""

    def step(s, t):
        meets = lambda r: F.coalesce(F.least(r["y1"], t["y1"]) - F.greatest(r["y0"], t["y0"]) > share * F.least(t["y1"] - t["y0"], r["y1"] - r["y0"]), F.lit(False))
        row = lambda y0, y1, cy: F.struct(y0.alias("y0"), y1.alias("y1"), cy.alias("cy"))
        at = F.array_position(F.transform(s["rows"], meets), True)
        grown = F.transform(s["rows"], lambda r, i: F.when(i + 1 == at, row(F.least(r["y0"], t["y0"]), F.greatest(r["y1"], t["y1"]), F.least(r["cy"], t["cy"]))).otherwise(r))
        return F.struct(
            F.when(at > 0, grown).otherwise(F.concat(s["rows"], F.array(row(t["y0"], t["y1"], t["cy"])))).alias("rows"),
            F.concat(s["out"], F.array(F.struct(t["idx"].alias("idx"), F.when(at > 0, at - 1).otherwise(F.size(s["rows"])).cast("long").alias("row")))).alias("out"),
        )

    def end(s):
        order = F.transform(F.array_sort(F.transform(s["rows"], lambda r, i: F.struct(r["cy"].alias("cy"), i.cast("long").alias("i")))), lambda o: o["i"])
        return F.transform(s["out"], lambda o: F.struct(o["idx"].alias("idx"), (F.array_position(order, o["row"]) - 1).alias("row")))

    zero = F.expr("named_struct('rows', cast(array() AS array<struct<y0: double, y1: double, cy: double>>), 'out', cast(array() AS array<struct<idx: bigint, row: bigint>>))")
    return _folded(tokens, key, ("cy", "idx", "y0", "y1"), zero, step, end)


def merged_boxes(boxes: DataFrame, key: str, share: float = 0.5, width: float = 0.6, slack: float = 12) -> DataFrame:
    """Boxes (x0, y0, x1, y1, confidence) of a page united while two of them meet: they overlap by ``share`` of the lesser area,
    or have ``width`` of the narrower one in common and less than ``slack`` between them from top to bottom, overlap included.

    The union keeps the higher confidence. Where more pairs meet, the first in the order of x0, y0, x1, y1 is united, and
    the union takes the first one's place, so the rows' order does not matter. Some dozens of boxes a page; boxes with a
    missing coordinate are left out.
    """

    def united(pages: np.ndarray) -> np.ndarray:
        """Pages of equally many boxes (page, box, 5), sorted, all at once; boxes that went into another are NaN throughout."""
        pages, n = pages.copy(), pages.shape[1]
        # One coordinate tells what is left; a box has no missing one.
        later, active = np.triu(np.ones((n, n), bool), 1), np.arange(len(pages))
        while len(active):
            x0, y0, x1, y1 = (pages[active, :, i] for i in range(4))
            w = np.minimum(x1[:, :, None], x1[:, None]) - np.maximum(x0[:, :, None], x0[:, None])
            h = np.minimum(y1[:, :, None], y1[:, None]) - np.maximum(y0[:, :, None], y0[:, None])
            own = (x1 - x0) * (y1 - y0)
            area, narrow = np.minimum(own[:, :, None], own[:, None]), np.minimum((x1 - x0)[:, :, None], (x1 - x0)[:, None])
            inside = (w > 0) & (h > 0) & (w * h >= share * np.where(area == 0, 1, area))
            first = ((inside | ((w >= width * np.where(narrow == 0, 1, narrow)) & (h > -slack))) & later).reshape(len(active), -1)
            found = first.any(1)
            active, first = active[found], first[found].argmax(1)
            i, j = first // n, first % n
            a, b = pages[active, i], pages[active, j]
            pages[active, i] = np.concatenate((np.minimum(a[:, :2], b[:, :2]), np.maximum(a[:, 2:4], b[:, 2:4]), np.fmax(a[:, 4:], b[:, 4:])), 1)
            pages[active, j] = np.nan
        return pages

    columns = ["x0", "y0", "x1", "y1", "confidence"]

    def unite(batches):
        held = None
        for batch in batches:
            held = batch if held is None else pa.concat_batches([held, batch])
            if held.num_rows == 0:
                continue
            keys = pc.dictionary_encode(held.column(0), null_encoding="encode").indices.to_numpy()
            cut = int(np.flatnonzero(keys != keys[-1])[-1]) + 1 if keys[0] != keys[-1] else 0
            if cut:
                yield from pages_of(held.slice(0, cut), keys[:cut])
            held = held.slice(cut)
        if held is not None and held.num_rows:
            yield from pages_of(held, pc.dictionary_encode(held.column(0), null_encoding="encode").indices.to_numpy())

    def pages_of(batch, keys):
        rows = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(float) for i in range(1, 6)], 1)
        start = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        size = np.diff(np.append(start, len(keys)))
        for n in np.unique(size).tolist():
            of = start[size == n]
            # So many pages at once that their pairs of boxes fit the memory of a task.
            step = max(1, (1 << 20) // (n * n))
            for at in range(0, len(of), step):
                some = of[at : at + step]
                out = united(rows[some[:, None] + np.arange(n)]).reshape(-1, 5)
                left = ~np.isnan(out[:, 0])
                key_rows = batch.column(0).take(pa.array(np.repeat(some, n)[left]))
                score = pa.array(out[left, 4], mask=np.isnan(out[left, 4]))
                yield pa.RecordBatch.from_arrays([key_rows, *(pa.array(out[left, i]) for i in range(4)), score], names=[key, *columns])

    kind = boxes.schema[key].dataType.simpleString()
    whole = boxes.dropna(subset=["x0", "y0", "x1", "y1"]).select(key, *[F.col(c).cast("double").alias(c) for c in columns])
    # A null confidence is sorted last, as is a missing one; pages are told apart by neighbouring rows, so a page stays in one task.
    order = [F.col(key), *[F.col(c) for c in columns[:4]], F.col("confidence").asc_nulls_last()]
    return spread(whole, key).sortWithinPartitions(*order).mapInArrow(unite, f"{key} {kind}, x0 double, y0 double, x1 double, y1 double, confidence double")


def reach_right(df: DataFrame, keys: list[str], x0: str, x1: str, gap: float) -> DataFrame:
    """Of each row the tokens from the left up to the first that begins more than ``gap`` beyond the end of all before it."""
    w = Window.partitionBy(*keys).orderBy(x0, x1)
    reach = F.max(x1).over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = df.withColumn("__far", F.coalesce(F.col(x0) - reach > gap, F.lit(False)))
    return rows.withColumn("__far", F.max("__far").over(w.rowsBetween(Window.unboundedPreceding, 0))).where(~F.col("__far")).drop("__far")


def islands(df: DataFrame, keys: list[str], index: str) -> DataFrame:
    """Runs of consecutive whole numbers: first, last and how many."""
    rows = portioned(df.select(*keys, index), *keys).distinct().withColumn("__k", F.col(index) - F.row_number().over(Window.partitionBy(*keys).orderBy(index)))
    return rows.groupBy(*keys, "__k").agg(F.min(index).alias("first"), F.max(index).alias("last"), F.count("*").alias("n")).drop("__k")


def mass_bounds(df: DataFrame, keys: list[str], index: str, mass: str, low: float, high: float) -> DataFrame:
    """First indexes at which the running mass reaches the shares ``low`` and ``high`` of the whole."""
    w = Window.partitionBy(*keys)
    rows = df.withColumn("__part", F.sum(mass).over(w.orderBy(index).rowsBetween(Window.unboundedPreceding, 0))).withColumn("__all", F.sum(mass).over(w))
    reaches = lambda s: F.min(F.when(F.col("__part") >= s * F.col("__all"), F.col(index)))
    return rows.groupBy(*keys).agg(reaches(low).alias("from"), reaches(high).alias("to"))


def value_after_anchor(tokens: DataFrame, key: str, anchor: Column, rest: Column, stop: Column, skip: Column, accept: Column, band_top: float = 1.0, max_dx: float = 0.75, gap: float = 0.18, row: float = 0.5, below: float = 2.5) -> DataFrame:
    """The value that belongs to an anchor on each page: key, anchor's idx, text.

    ``tokens``: idx, text, x0, y0, x1, y1 by page. ``anchor`` marks tokens that hold an anchor, ``rest`` is what follows it
    in that token. The value is that rest and the tokens to its right in the same row, up to one at which ``stop`` holds
    or a blank of more than ``gap``; without any, the tokens of the row below that begin under the anchor. ``skip``: tokens
    that are no anchors; ``accept``: whether column ``text`` is a value. Of several anchors the first in order counts.
    """
    t = tokens.withColumns({"cy": (F.col("y0") + F.col("y1")) / 2, "h": F.col("y1") - F.col("y0"), "__stop": F.coalesce(stop, F.lit(False))})
    a = t.where(anchor & ~F.coalesce(skip, F.lit(False)) & (F.col("cy") <= band_top))
    a = a.select(key, F.col("idx").alias("anchor"), F.trim(rest).alias("rest"), F.col("x0").alias("ax0"), F.col("x1").alias("ax1"), F.col("cy").alias("acy"), F.col("h").alias("ah"))
    pairs = matched(a, t, key).where(F.col("idx") != F.col("anchor"))
    near = F.abs(F.col("cy") - F.col("acy")) < row * F.greatest("h", "ah")
    right = pairs.where(near & (F.col("x0") >= F.col("ax1") - 0.01) & (F.col("x0") - F.col("ax1") <= max_dx))
    by = [key, "anchor"]
    w = Window.partitionBy(*by).orderBy("x0", "idx")
    reach = F.greatest(F.coalesce(F.max("x1").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.col("ax1")), F.col("ax1"))
    ends = F.col("__stop") | (F.col("x0") - reach > gap)
    right = right.withColumn("__end", F.max(ends).over(w.rowsBetween(Window.unboundedPreceding, 0))).where(~F.col("__end"))
    under = pairs.where(~near & (F.col("cy") > F.col("acy")) & (F.col("cy") - F.col("acy") <= below * F.col("ah")) & (F.col("x0") < F.col("ax1")) & (F.col("x1") > F.col("ax0")))
    under = under.withColumn("__end", F.max("__stop").over(w.rowsBetween(Window.unboundedPreceding, 0))).where(~F.col("__end"))
    text = lambda rows, name: rows.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("x0", "idx", "text"))).alias("__l")).select(*by, F.array_join(F.transform("__l", lambda x: x["text"]), " ").alias(name))
    out = matched(matched(a.select(*by, "rest"), text(right, "__r"), *by, how="left"), text(under, "__b"), *by, how="left")
    beside = F.trim(F.concat_ws(" ", F.when(F.col("rest") != "", F.col("rest")), "__r"))
    out = out.select(*by, F.when(beside != "", beside).otherwise(F.trim("__b")).alias("text")).where(F.coalesce(F.col("text") != "", F.lit(False)) & accept)
    return out.groupBy(key).agg(F.min_by(F.struct("anchor", "text"), "anchor").alias("__v")).select(key, "__v.anchor", "__v.text")
