"""Queries of parsers, candidates, layouts, deciders and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioflow.functions import dates, numbers, spans, text, values, words
from folioflow.operators import aggregates as ag, candidates as ca, windows as wi
from folioflow.plans import deciders, views
from folioflow.queries import query, t
from folioflow.session import dealt, workers_see_package


@query("""
WITH r AS (SELECT o_orderkey AS k, floor(o_totalprice)::BIGINT AS n FROM orders),
v AS (SELECT k, n::DECIMAL(18,2) AS value, 1.0 AS w FROM r WHERE n > 0 UNION ALL SELECT k, substr(n::VARCHAR, 2)::DECIMAL(18,2), 0.8 FROM r WHERE n::VARCHAR LIKE '5__%' AND substr(n::VARCHAR, 2)::BIGINT > 0
  UNION ALL SELECT k, (n / 100.0)::DECIMAL(18,2), 0.5 FROM r WHERE length(n::VARCHAR) >= 3)
SELECT k, value, round(sum(w), 6)::DOUBLE AS weight FROM v GROUP BY ALL""")
def amount_hypotheses(spark, sf):
    """What each order's total may mean when it is read off a form: exploded, and weights added up by value."""
    written = F.concat(F.lit("US$ "), F.floor("o_totalprice").cast("string"))
    rows = t(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.explode(numbers.amount_hypotheses(written, F.lit(1.0))).alias("h"))
    return rows.groupBy("k", F.col("h.value").alias("value")).agg(F.round(F.sum("h.weight"), 6).alias("weight"))


@query("""
WITH s AS (SELECT l_orderkey, l_linenumber, l_returnflag = 'R' AS sym, l_linestatus = 'F' AS near, l_partkey % 2 = 0 AS dec, l_partkey % 5 = 0 AS star, l_discount::DOUBLE * 10 AS cx, l_tax::DOUBLE * 10 AS cy, l_partkey % 10 AS digits, l_suppkey % 7 = 0 AS eq FROM lineitem)
SELECT l_orderkey, l_linenumber, round((0.3 + CASE WHEN sym OR near THEN 0.35 ELSE 0 END + CASE WHEN dec OR star THEN 0.15 ELSE 0 END + CASE WHEN cx > 0.55 THEN 0.15 ELSE 0 END + CASE WHEN cy < 0.58 THEN 0.05 ELSE 0 END
  - CASE WHEN digits >= 7 AND NOT dec AND NOT sym THEN 0.45 ELSE 0 END + CASE WHEN eq THEN 0.5 ELSE 0 END)::DOUBLE, 6) AS score,
  round(CASE WHEN sym OR (digits <= 9 AND dec) THEN (CASE WHEN sym THEN 3 ELSE 0 END + CASE WHEN dec THEN 2 ELSE 0 END + CASE WHEN eq THEN 10 ELSE 0 END) + cx END::DOUBLE, 6) AS repair FROM s""")
def amount_scores(spark, sf):
    sym, dec, eq = F.col("l_returnflag") == "R", F.col("l_partkey") % 2 == 0, F.col("l_suppkey") % 7 == 0
    cx, cy, digits = F.col("l_discount").cast("double") * 10, F.col("l_tax").cast("double") * 10 + 0.02, F.col("l_partkey") % 10
    score = numbers.amount_score(sym, F.col("l_linestatus") == "F", dec, F.col("l_partkey") % 5 == 0, cx, cy, digits, eq)
    return t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.round(score, 6).alias("score"), F.round(numbers.amount_score_repair(sym, dec, cx, digits, eq), 6).alias("repair"))


@query("SELECT o_orderkey, o_orderdate::DATE AS parsed FROM orders")
def earliest_dates_roundtrip(spark, sf):
    """Five kinds of written dates, each behind a number that is no date."""
    d, k = F.col("o_orderdate"), F.col("o_orderkey") % 5
    month = F.get(F.array(*[F.lit(m) for m in ("enero", "feb", "marzo", "abr.", "mayo", "vi", "julio", "ago", "setiembre", "x", "nov.", "diciembre")]), F.month(d) - 1)
    y, n = F.date_format(d, "yyyy"), F.dayofmonth(d).cast("string")
    written = F.when(k == 0, F.concat(n, F.lit(" de "), month, F.lit(" del "), y)).when(k == 1, F.concat(y, F.lit(", "), month, F.lit(", "), n)).when(k == 2, F.concat(month, F.lit(" "), n, F.lit("/"), y)) \
        .when(k == 3, F.date_format(d, "yyyy - M - d")).otherwise(F.date_format(d, "dd.MM.yyyy"))
    return dealt(t(spark, sf, "orders")).select("o_orderkey", dates.earliest_date(F.concat(F.lit("No. 4711: "), written))["date"].alias("parsed"))


@query("""
WITH o AS (SELECT o_orderkey, o_orderdate::DATE AS d FROM orders)
SELECT o_orderkey, strftime(d, '%d/%m/%Y') AS shown, CASE o_orderkey % 3 WHEN 0 THEN strftime(d, '%Y%m%d') || CASE WHEN day(d) < 10 OR month(d) < 10 THEN ',' || year(d) || month(d) || day(d) ELSE '' END
  WHEN 1 THEN strftime(d, '%d%m%Y') || CASE WHEN day(d) < 10 OR month(d) < 10 THEN ',' || day(d) || month(d) || year(d) ELSE '' END END AS spellings FROM o""")
def date_spellings(spark, sf):
    d, k = F.col("o_orderdate").cast("date"), F.col("o_orderkey") % 3
    like = F.when(k == 0, "2026-05-29").when(k == 1, "29/05/2026").otherwise("mayo 2026")
    return t(spark, sf, "orders").select("o_orderkey", dates.shown(d).alias("shown"), F.array_join(dates.date_spellings(d, like), ",").alias("spellings"))


@query("SELECT o_orderkey, floor(o_totalprice)::DECIMAL(18,2) AS value FROM orders")
def glued_amounts_roundtrip(spark, sf):
    """Each order's amount with hundreds and tens glued, cut and read again."""
    glued = F.regexp_replace(words.number_words(F.floor("o_totalprice")), r"(\w+ientos) (\w{6,})", "$1$2")
    rows = dealt(t(spark, sf, "orders")).select("o_orderkey", F.array_join(words.split_glued(glued), " ").alias("w"))
    return rows.select("o_orderkey", words.amount_words_tolerant(F.col("w")).alias("value"))


# Tokens of a page: one page an order, one token a line.
_TOKENS = "SELECT l_orderkey AS page, l_linenumber AS idx, l_quantity::DOUBLE / 50 AS x0, l_quantity::DOUBLE / 50 + 0.1 AS x1, l_discount::DOUBLE * 10 AS y0, l_discount::DOUBLE * 10 + 0.15 AS y1 FROM lineitem"


def tokens(spark, sf):
    x, y = F.col("l_quantity").cast("double") / 50, F.col("l_discount").cast("double") * 10
    return t(spark, sf, "lineitem").select(F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("idx"), x.alias("x0"), (x + 0.1).alias("x1"), y.alias("y0"), (y + 0.15).alias("y1"))


@query("SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY round(l_discount::DOUBLE, 2), l_quantity, l_linenumber) - 1 AS at FROM lineitem")
def reading_order(spark, sf):
    rows = t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_discount").cast("double").alias("cy"), F.struct("l_quantity", "l_linenumber").alias("x"))
    return wi.reading_order(rows, ["l_orderkey"], "cy", "x").select("l_orderkey", "l_linenumber", F.col("at").cast("long").alias("at"))


@query("SELECT l_orderkey, l_linenumber, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS after FROM lineitem")
def next_token(spark, sf):
    rows = t(spark, sf, "lineitem").withColumn("o", F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity"))
    return wi.following(rows, ["l_orderkey"], "o", "l_partkey", "after").select("l_orderkey", "l_linenumber", "after")


@query(f"WITH k AS ({_TOKENS}) SELECT page, idx FROM k WHERE (x0 + x1) / 2 BETWEEN 0.2 AND 0.7 AND (y0 + y1) / 2 BETWEEN 0.1 AND 0.6")
def tokens_inside(spark, sf):
    k = tokens(spark, sf).select("page", "idx", ((F.col("x0") + F.col("x1")) / 2).alias("cx"), ((F.col("y0") + F.col("y1")) / 2).alias("cy"))
    regions = k.select("page").distinct().select("page", F.lit(0.2).alias("x0"), F.lit(0.7).alias("x1"), F.lit(0.1).alias("y0"), F.lit(0.6).alias("y1"))
    return wi.inside(k, regions, ["page"]).select("page", "idx")


@query(f"""WITH k AS ({_TOKENS}), l AS (SELECT page, min(x0) AS lx, min(y0) AS ly FROM k WHERE idx = 1 GROUP BY page)
SELECT DISTINCT k.page, k.idx, coalesce(abs(k.x0 - lx) <= 0.3 AND abs(k.y0 - ly) <= 2 * 0.15, false) AS near FROM k LEFT JOIN l USING (page)""")
def near_label(spark, sf):
    k = tokens(spark, sf).select("page", "idx", F.col("x0").alias("cx"), F.col("y0").alias("cy"))
    labels = k.where("idx = 1").groupBy("page").agg(F.min("cx").alias("lx"), F.min("cy").alias("ly")).withColumn("lh", F.lit(0.15))
    return wi.near_label(k, labels, ["page"], 0.3, 2).select("page", "idx", "near").distinct()


@query(f"""WITH k AS ({_TOKENS}), z AS (SELECT page, idx, x0, x1, y0, y1 FROM k WHERE idx % 2 = 0), b AS (SELECT * FROM k WHERE idx % 2 = 1),
h AS (SELECT z.page, z.idx, max((greatest(least(z.x1, b.x1) - greatest(z.x0, b.x0), 0) * greatest(least(z.y1, b.y1) - greatest(z.y0, b.y0), 0) > 0.3 * (z.x1 - z.x0) * (z.y1 - z.y0))::INT) AS hit FROM z JOIN b USING (page) GROUP BY ALL)
SELECT page, sum(hit)::BIGINT AS covered, sum(hit) >= 2 AS illegible FROM h GROUP BY page""")
def covered_zones(spark, sf):
    k = tokens(spark, sf)
    side = lambda rows, p: rows.select("page", *[F.col(c).alias(p + c) for c in ("x0", "y0", "x1", "y1")], *([F.col("idx").alias("zone")] if p == "z_" else []))
    return wi.covered_zones(side(k.where("idx % 2 = 0"), "z_"), side(k.where("idx % 2 = 1"), "b_"), ["page"])


@query("""WITH c AS (SELECT conv_id, turn, length(role) AS n FROM conversations), s AS (SELECT conv_id, turn, n, coalesce(sum(n + 2) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a FROM c)
SELECT conv_id, turn, a::BIGINT AS "start", (a + n)::BIGINT AS "end" FROM s""")
def token_spans(spark, sf):
    rows = wi.spans_of_tokens(t(spark, sf, "conversations").select("conv_id", "turn", "role"), ["conv_id"], "turn", "role")
    return rows.select("conv_id", "turn", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))


@query(f"""WITH k AS ({_TOKENS}), f AS (SELECT page, idx, x0, x1, coalesce(x0 - max(x1) OVER (PARTITION BY page ORDER BY x0, x1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > 0.12, false)::INT AS far FROM k)
SELECT page, x0, x1 FROM (SELECT page, x0, x1, max(far) OVER (PARTITION BY page ORDER BY x0, x1 ROWS UNBOUNDED PRECEDING) AS m FROM f) WHERE m = 0""")
def reach_right(spark, sf):
    return wi.reach_right(tokens(spark, sf), ["page"], "x0", "x1", 0.12).select("page", "x0", "x1")


@query("""WITH d AS (SELECT DISTINCT l_suppkey AS k, l_partkey AS i FROM lineitem), g AS (SELECT *, i - row_number() OVER (PARTITION BY k ORDER BY i) AS g FROM d)
SELECT k, min(i) AS "first", max(i) AS "last", count(*) AS n FROM g GROUP BY k, g""")
def index_islands(spark, sf):
    return wi.islands(t(spark, sf, "lineitem").select(F.col("l_suppkey").alias("k"), F.col("l_partkey").alias("i")), ["k"], "i")


@query("""WITH e AS (SELECT l_orderkey AS k, l_linenumber AS i, floor(l_quantity)::BIGINT AS m FROM lineitem), p AS (SELECT k, i, sum(m) OVER (PARTITION BY k ORDER BY i) AS p, sum(m) OVER (PARTITION BY k) AS a FROM e)
SELECT k, min(i) FILTER (p >= 0.1 * a) AS "from", min(i) FILTER (p >= 0.9 * a) AS "to" FROM p GROUP BY k""")
def mass_bounds(spark, sf):
    rows = t(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("i"), F.floor("l_quantity").alias("m"))
    return wi.mass_bounds(rows, ["k"], "i", "m", 0.1, 0.9)


@query("SELECT c_custkey, 'Cliente de la Casa y del ' || upper(left(c_mktsegment, 1)) || lower(substr(c_mktsegment, 2)) AS name FROM customer")
def name_cases(spark, sf):
    return t(spark, sf, "customer").select("c_custkey", text.name_case(F.concat(F.lit("cliente DE LA casa Y DEL "), F.col("c_mktsegment"))).alias("name"))


@query("""SELECT conv_id, round(CASE WHEN count(*) FILTER (turn <= 1) = 0 THEN NULL ELSE exp(avg(ln(1.0 / (turn + 2))) FILTER (turn <= 1)) END, 6)::DOUBLE AS p FROM conversations GROUP BY conv_id""")
def span_confidences(spark, sf):
    """How sure a reader is of the span of the first two turns of each conversation, one token a turn."""
    rows = t(spark, sf, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("l"))
    texts, p = F.transform("l", lambda x: x["role"]), F.transform("l", lambda x: 1.0 / (x["turn"] + 2).cast("double"))
    end = F.aggregate(F.slice("l", 1, 2), F.lit(0), lambda n, x: n + F.length(x["role"]))
    return rows.select("conv_id", F.round(spans.span_confidence(texts, p, F.lit(0), end), 6).alias("p"))


@query("""WITH b AS (SELECT conv_id, count(*) AS boxes, sum(0.5 * length(role)) AS score, count(*) FILTER (length(role) <= 2) AS short FROM conversations GROUP BY 1)
SELECT conv_id, boxes, score::DOUBLE AS score, short, boxes < 6 OR score < 18 OR short >= greatest(4, 0.45 * boxes) AS poor FROM b""")
def poor_readings(spark, sf):
    return ag.poor_reading(t(spark, sf, "conversations"), ["conv_id"], F.lit(0.5), F.col("role"))


@query("SELECT count(*) AS total, count(*) FILTER (l_returnflag = 'R' AND l_tax <= 0.04) AS verified, count(*) FILTER (l_tax > 0.04) AS to_review, round(avg(l_discount::DOUBLE), 3) AS confidence FROM lineitem")
def review_summary(spark, sf):
    return ag.review_summary(t(spark, sf, "lineitem"), F.col("l_returnflag") == "R", F.col("l_tax") > 0.04, F.col("l_discount").cast("double"))


@query("""SELECT user_id, coalesce(nullif(CASE WHEN user_id % 3 = 0 THEN 0.0 WHEN user_id % 3 = 1 THEN 0.75 END, 0.0), round(avg(value / 1000), 3))::DOUBLE AS confidence FROM events GROUP BY user_id""")
def overall_confidence(spark, sf):
    whole = F.when(F.col("user_id") % 3 == 0, 0.0).when(F.col("user_id") % 3 == 1, 0.75)
    return t(spark, sf, "events").groupBy("user_id").agg(ag.mean_confidence(F.col("value") / 1000).alias("m")).select("user_id", ag.overall_confidence(whole, F.col("m")).alias("confidence"))


@query("SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, max(value) AS longest, round(round(avg(value), 6) * greatest(5000 - count(*), 0), 3)::DOUBLE AS \"left\" FROM events GROUP BY event_type")
def step_times_left(spark, sf):
    return ag.step_times(t(spark, sf, "events"), ["event_type"], "value", F.lit(5000))


@query("SELECT p_brand, p_type, count(p_size) AS n, CASE WHEN count(p_size) >= 3 THEN median(p_size) ELSE 1.0 END::DOUBLE AS scale FROM part GROUP BY ALL")
def gated_median(spark, sf):
    return ag.median_scale(t(spark, sf, "part"), ["p_brand", "p_type"], "p_size")


@query("SELECT n_nationkey, r_regionkey FROM nation, region WHERE n_name = r_name OR contains(n_name || ' of ' || (SELECT any_value(x.r_name) FROM region x WHERE x.r_regionkey = n_regionkey), r_name)")
def names_held(spark, sf):
    r = t(spark, sf, "region").select("r_regionkey", "r_name")
    n = t(spark, sf, "nation").join(r.withColumnsRenamed({"r_regionkey": "n_regionkey", "r_name": "own"}), "n_regionkey").select("n_nationkey", F.concat(F.col("n_name"), F.lit(" of "), F.col("own")).alias("said"))
    return ca.named_in(n, "said", r, "r_name").join(r, "r_name").select("n_nationkey", "r_regionkey")


def _frames(digits, n):
    """A matrix that spells n digits, with a blank frame around each."""
    row = lambda c: F.transform(F.concat(F.array(F.lit("")), F.array(*[F.lit(str(i)) for i in range(10)])), lambda d: F.when(d == c, 0.9).otherwise(0.01))
    return F.concat(row(F.lit("")), *[x for i in range(n) for x in (row(F.substring(digits, i + 1, 1)), row(F.lit("")))])


@query("SELECT p_partkey AS k, lpad(p_partkey::VARCHAR, 6, '0') AS value, false AS review FROM part")
def printed_numbers(spark, sf):
    """Numbers printed twice: one reading has a wrong digit, and both zones of the image decide."""
    p = dealt(t(spark, sf, "part")).select(F.col("p_partkey").cast("long").alias("k"), F.lpad(F.col("p_partkey").cast("string"), 6, "0").alias("d"))
    wrong = F.overlay("d", F.translate(F.substring("d", 3, 1), "0123456789", "1234567890"), F.lit(3), F.lit(1))
    readings = p.select("k", F.lit("printed").alias("source"), F.when(F.col("k") % 2 == 0, wrong).otherwise(F.col("d")).alias("text")).unionByName(p.select("k", F.lit("line").alias("source"), F.col("d").alias("text")))
    zones = p.select("k", _frames(F.col("d"), 6).alias("m"), F.lit(13).alias("t"), F.explode(F.array(F.lit(1.0), F.lit(0.4))).alias("weight"))
    return deciders.printed_number(readings, zones, "k", 6, "0123456789").select("k", "value", "review")


@query("""SELECT o_orderkey AS k, CASE WHEN o_orderkey % 4 > 0 THEN lpad((o_orderkey % 900000)::VARCHAR, 6, '0') || ' 12345678 ' || lpad(o_custkey::VARCHAR, 10, '0') || ' 01' END AS line,
CASE WHEN o_orderkey % 4 = 0 THEN 0.0 ELSE 0.9 END::DOUBLE AS confidence FROM orders""")
def line_of_numbers(spark, sf):
    k = F.col("o_orderkey")
    rows = t(spark, sf, "orders").select(k.alias("k"), F.lpad((k % 900000).cast("string"), 6, "0").alias("number"), F.when(k % 4 > 0, "12345678").alias("routing"), F.lpad(F.col("o_custkey").cast("string"), 10, "0").alias("account"), F.lit("01").alias("kind"), F.lit(0.95).alias("number_conf"), F.when(k % 4 > 0, 0.9).otherwise(0.0).alias("routing_conf"), F.lit(0.99).alias("account_conf"))
    return deciders.assembled_line(rows).select("k", "line", "confidence")


@query("""WITH o AS (SELECT o_orderkey AS k, o_orderkey % 3 = 0 AS same, o_orderkey % 2 = 0 AS read, o_orderkey % 7 AS margin, o_orderkey % 5 = 0 AS bad, o_orderkey % 11 = 0 AS deep, o_orderkey % 13 > 0 AS legible, o_orderkey % 17 = 0 AS loose, o_orderkey % 34 = 0 AS explicit FROM orders)
SELECT k, NOT ((NOT bad OR deep) AND legible AND NOT (loose AND NOT explicit) AND (same OR (read AND margin >= 5))) AS review FROM o""")
def amount_gates(spark, sf):
    k = F.col("o_orderkey")
    figures = F.array(F.when(k % 17 == 0, "475.").otherwise("475"))
    said = F.array(F.concat(F.when(k % 13 > 0, "cuatro cientos cinco").otherwise("???"), F.when(k % 34 == 0, " 00/100").otherwise("")))
    rows = t(spark, sf, "orders").select(k.alias("k"), F.lit(475).cast("decimal(18,2)").alias("value"), (k % 7).cast("double").alias("margin"), (k % 3 == 0).alias("same"), (k % 2 == 0).alias("read"), F.when(k % 5 == 0, -1.0).otherwise(-0.1).alias("fit"), (k % 11 == 0).alias("deep"), figures.alias("figures"), said.alias("words"))
    return deciders.amount_decision(rows).select("k", "review")


@query("""WITH f AS (SELECT l_orderkey AS k, l_linenumber AS field, max(l_discount::DOUBLE * 10) AS c FROM lineitem GROUP BY ALL)
SELECT k, field, CASE WHEN c < 0.8 AND field <= 2 THEN 'deep' ELSE 'quick' END AS value, round(CASE WHEN c < 0.8 AND field <= 2 THEN 0.85 ELSE c END, 3) AS confidence FROM f""")
def escalated_fields(spark, sf):
    """Only fields in review are read again, and only those the second reader has answers for change."""
    f = t(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("field")).agg(F.max(F.col("l_discount").cast("double") * 10).alias("confidence")).withColumn("value", F.lit("quick"))
    f = f.withColumn("review", F.col("confidence") < 0.8)
    return deciders.escalated(f, lambda asked: asked.where("field <= 2").select("k", "field", F.lit("deep").alias("value")), ["k", "field"]).select("k", "field", "value", F.round("confidence", 3).alias("confidence"))


@query("""SELECT l_orderkey, l_linenumber, concat_ws('; ', CASE WHEN l_linestatus = 'F' THEN 'not found' END, CASE WHEN l_returnflag = 'R' THEN 'illegible' END, CASE WHEN l_quantity < 10 THEN 'low resolution' END) AS reasons,
l_linestatus = 'F' OR l_returnflag = 'R' OR l_quantity < 10 OR l_tax > 0.05 AS review FROM lineitem""")
def review_reasons(spark, sf):
    reasons = {"not found": F.col("l_linestatus") == "F", "illegible": F.col("l_returnflag") == "R", "low resolution": F.col("l_quantity") < 10}
    return deciders.with_reasons(t(spark, sf, "lineitem"), F.col("l_tax") > 0.05, reasons).select("l_orderkey", "l_linenumber", "reasons", "review")


# Reports and views.
_FIELDS = "SELECT l_orderkey AS k, 'f' || l_linenumber % 3 AS field, max(l_partkey) AS value, max(l_discount::DOUBLE * 10) AS confidence FROM lineitem GROUP BY ALL"


def fields(spark, sf):
    return t(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("k"), F.concat(F.lit("f"), F.col("l_linenumber") % 3).alias("field")).agg(F.max("l_partkey").alias("value"), F.max(F.col("l_discount").cast("double") * 10).alias("confidence"))


@query(f"""WITH f AS ({_FIELDS}) SELECT k, k % 10 AS rank, max(value) FILTER (field = 'f0') AS f0_value, max(confidence) FILTER (field = 'f0') AS f0_confidence, coalesce(max(confidence) FILTER (field = 'f0') < 0.8, true) AS f0_review,
max(value) FILTER (field = 'f1') AS f1_value, max(confidence) FILTER (field = 'f1') AS f1_confidence, coalesce(max(confidence) FILTER (field = 'f1') < 0.8, true) AS f1_review, (k % 7)::DOUBLE AS read_s FROM f GROUP BY k""")
def batch_sheet(spark, sf):
    f = fields(spark, sf).withColumn("review", F.coalesce(F.col("confidence") < 0.8, F.lit(True)))
    records = f.select("k").distinct()
    steps = records.select("k", F.lit("read").alias("step"), (F.col("k") % 7).cast("double").alias("seconds"))
    return views.batch_sheet(f, steps, records.select("k", (F.col("k") % 10).alias("rank")), "k", ["f0", "f1"], ["read"])


@query(f"""WITH f AS ({_FIELDS}) SELECT k FROM f GROUP BY k HAVING bool_or(confidence < 0.1)""")
def records_with_error(spark, sf):
    return views.any_field(fields(spark, sf), "k", F.col("confidence") < 0.1)


@query(f"""WITH f AS ({_FIELDS}) SELECT k FROM f GROUP BY k HAVING contains(lower('order-' || k || ' ' || string_agg(value::VARCHAR, ' ' ORDER BY field)), '12')""")
def records_that_hold(spark, sf):
    return views.holding(fields(spark, sf).withColumn("file", F.concat(F.lit("Order-"), F.col("k"))), "k", "file", "field", "value", "12")


@query(f"""WITH f AS ({_FIELDS}) SELECT k, field, confidence, row_number() OVER (ORDER BY confidence, k, field) AS at FROM f WHERE confidence < 0.3""")
def doubtful_fields(spark, sf):
    from folioflow.operators.tables import numbered

    rows = views.doubtful(fields(spark, sf), "confidence", 0.3, ["k", "field"])
    return numbered(rows.select("k", "field", "confidence"), "at", "confidence", "k", "field")


@query(f"""WITH f AS ({_FIELDS}) SELECT k, json_extract_string(j, '$.confianza_global')::DOUBLE AS whole, json_extract_string(j, '$.campos.f1.valor')::BIGINT AS f1 FROM (
SELECT k, json_object('confianza_global', round(avg(confidence), 3), 'campos', json_group_object(field, json_object('valor', value, 'confianza', confidence))) AS j FROM f GROUP BY k)""")
def exported_records(spark, sf):
    out = views.exported(fields(spark, sf), "k", "field", "value", "confidence")
    return out.select("k", F.get_json_object("json", "$.confianza_global").cast("double").alias("whole"), F.get_json_object("json", "$.campos.f1.valor").cast("long").alias("f1"))


@query("""WITH r AS (SELECT o_orderkey AS id, o_orderstatus AS status, (o_totalprice::DECIMAL(18,2) * 100)::BIGINT AS amount_cents, o_clerk_ AS payee FROM (SELECT *, 'C' || o_custkey AS o_clerk_ FROM orders))
SELECT id, status, amount_cents, payee, (amount_cents / 100.0)::DECIMAL(18,2) AS amount FROM r""")
def stored_records(spark, sf):
    """Records to storage columns and back: promoted fields, cents, and the rest as JSON."""
    rows = t(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.create_map(F.lit("payee"), F.concat(F.lit("C"), F.col("o_custkey")), F.lit("amount"), F.col("o_totalprice").cast("decimal(18,2)").cast("string"), F.lit("note"), F.lit("x")).alias("fields"))
    stored = views.to_store(rows, "fields", ["payee"], "amount")
    return views.from_store(stored, "fields").select("id", "status", "amount_cents", "payee", F.col("fields")["amount"].cast("decimal(18,2)").alias("amount"))


@query("""WITH s AS (SELECT c_custkey % 40 AS content, c_custkey % 2 AS page, min(c_custkey) AS id FROM customer GROUP BY ALL), n AS (SELECT DISTINCT p_partkey % 50 AS content, p_partkey % 2 AS page FROM part)
SELECT n.content, n.page, s.id, s.id IS NULL AS fresh FROM n LEFT JOIN s USING (content, page)""")
def upserted_records(spark, sf):
    old = t(spark, sf, "customer").groupBy((F.col("c_custkey") % 40).alias("content"), (F.col("c_custkey") % 2).alias("page")).agg(F.min("c_custkey").alias("id"))
    new = t(spark, sf, "part").select((F.col("p_partkey") % 50).alias("content"), (F.col("p_partkey") % 2).alias("page")).distinct()
    return views.with_known_ids(new, old, ["content", "page"], "id").select("content", "page", "id", "fresh")


@query("SELECT c_custkey, c_name FROM customer WHERE lower(c_name) LIKE '%er#00000_01%'")
def like_search(spark, sf):
    """The reader's text may hold wildcards."""
    from folioflow.operators import tables as tb

    rows = t(spark, sf, "customer").select("c_custkey", "c_name", F.lit(False).alias("deleted"))
    return rows.where(tb.Filter(search="ER#00000_01", search_columns=["c_name"]).predicate()).select("c_custkey", "c_name")


@query("SELECT 1 AS number, count(*) AS total, greatest(ceil(count(*) / 20.0), 1)::BIGINT AS pages FROM customer WHERE c_acctbal > 5000")
def page_totals(spark, sf):
    return views.page_totals(t(spark, sf, "customer").where("c_acctbal > 5000"), 1, 20)


@query("SELECT o_orderkey, o_totalprice <= 300000 AND length(o_orderpriority) <= 8 AND o_orderstatus IN ('F', 'O') AS valid FROM orders")
def constrained_columns(spark, sf):
    rules = {"o_orderpriority": views.at_most(8), "o_orderstatus": views.one_of(["F", "O"]), "o_totalprice": lambda c: c <= 300000}
    return t(spark, sf, "orders").select("o_orderkey", views.valid(rules).alias("valid"))


@query("""SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 = 0 THEN 'fixed' ELSE 'c' || o_custkey END AS value, CASE WHEN o_orderkey % 5 = 0 THEN 1.0 ELSE 0.5 END::DOUBLE AS confidence, CASE WHEN o_orderkey % 5 = 0 THEN 'manual' ELSE 'ocr' END AS source,
CASE WHEN o_orderkey % 5 = 0 THEN 'COMPLETO' ELSE o_orderstatus END AS status FROM orders""")
def manual_corrections(spark, sf):
    k = F.col("o_orderkey")
    rows = t(spark, sf, "orders").select(k.alias("id"), F.concat(F.lit("c"), F.col("o_custkey")).alias("value"), F.lit(0.5).alias("confidence"), F.lit("ocr").alias("source"), F.col("o_orderstatus").alias("status"))
    changes = rows.where("id % 5 = 0").select("id", F.lit("fixed").alias("value"), F.lit(None).cast("string").alias("status"))
    return views.corrected(rows, changes, "id", ["value"]).select("id", "value", "confidence", "source", "status")


@query("SELECT user_id, event_id, event_id % 9 = 0 AS deleted FROM (SELECT user_id, max(event_id) AS event_id FROM events GROUP BY 1)")
def deleted_versions(spark, sf):
    """A deletion is a later version of the record."""
    e = t(spark, sf, "events").groupBy("user_id").agg(F.max("event_id").alias("event_id")).withColumns({"version": F.lit(1), "deleted": F.lit(False)})
    return views.deleted(e, e.where("event_id % 9 = 0").select("user_id"), ["user_id"]).select("user_id", "event_id", "deleted")


@query("""SELECT doc_id, lang, row_number() OVER (ORDER BY doc_id DESC) AS at FROM documents WHERE doc_id >= 10""")
def folder_order(spark, sf):
    """Results that came in any order, from an ordinal on, in the order of the folder."""
    d = t(spark, sf, "documents").select("doc_id", "lang")
    order = d.select("doc_id", (-F.col("doc_id")).alias("ordinal"))
    rows = views.since(views.in_order_of(d, order, "doc_id", "ordinal"), "doc_id", 10)
    from folioflow.operators.tables import numbered

    return numbered(rows, "at", "ordinal", "doc_id").select("doc_id", "lang", "at")


@query("SELECT conv_id, string_agg(role, ',' ORDER BY first) AS roles FROM (SELECT conv_id, role, min(turn) AS first FROM conversations GROUP BY ALL) GROUP BY conv_id")
def ordered_keys(spark, sf):
    return t(spark, sf, "conversations").groupBy("conv_id").agg(F.array_join(views.keys_in_order("turn", "role"), ",").alias("roles"))


@query("SELECT c_custkey, 'new' AS a, 'old' AS b, 'new' AS c FROM customer")
def merged_maps(spark, sf):
    left, right = (F.create_map(*[F.lit(x) for k in ks for x in (k, v)]) for ks, v in ((("a", "b"), "old"), (("a", "c"), "new")))
    return t(spark, sf, "customer").select("c_custkey", views.merged(left, right).alias("m")).select("c_custkey", *[F.col("m")[k].alias(k) for k in "abc"])


@query("SELECT source, count(*) AS n FROM (SELECT 'a' AS source FROM customer UNION ALL SELECT 'b' FROM supplier) GROUP BY source")
def pooled_readings(spark, sf):
    a, b = t(spark, sf, "customer").select(F.col("c_name").alias("text")), t(spark, sf, "supplier").select(F.col("s_name").alias("text"))
    return views.pooled({"a": a, "b": b}).groupBy("source").agg(F.count("*").alias("n"))
