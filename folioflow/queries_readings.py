"""Queries of bilingual amounts, magnetic lines, templates and transcripts."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioflow.functions import bilingual, numbers, text, values, words
from folioflow.operators import aggregates, candidates as ca
from folioflow.plans import deciders, zones
from folioflow.queries import query, t
from folioflow.queries_written import _O, _join, _orders


@query(f"""WITH {_O} SELECT k, v AS value, CASE k % 4 WHEN 0 THEN 'dolares' WHEN 1 THEN 'dollars' WHEN 2 THEN 'pesos' ELSE 'dollars' END AS currency, k % 4 = 3 AS partly FROM o""")
def amounts_in_two_languages(spark, sf):
    """Spanish and English, cents in figures or words, lost blanks, and a word that nobody understands."""
    spanish, n = words.number_words(F.floor("v")), F.floor("v").cast("int")
    cents = F.col("c").cast("int")
    small = F.when(cents == 0, "zero").otherwise(bilingual.number_words_english(cents))
    forms = [_join(F.regexp_replace(spanish, r"(\w+ientos) (\w{6,})", "$1$2"), " con ", F.col("c"), "/100 dolares"), _join(bilingual.number_words_english(n), " dollars and ", small, " cents"),
             _join("la suma de ", spanish, " pesos con ", words.number_words(cents), " centavos"), _join(bilingual.number_words_english(n), " xqzwvk and ", F.col("c"), "/100 dollars")]
    rows = _orders(spark, sf).select("k", bilingual.amount_words_bilingual(F.get(F.array(*forms), (F.col("k") % 4).cast("int"))).alias("a"))
    return rows.select("k", "a.value", "a.currency", (F.col("a.share") < 1).alias("partly"))


@query(f"""WITH {_O}, g AS (SELECT k, lpad((k % 900000)::VARCHAR, 6, '0') AS number, lpad(cust::VARCHAR, 10, '0') AS account FROM o)
SELECT k, CASE WHEN ok THEN number END AS number, CASE WHEN ok THEN '12345678' END AS routing, CASE WHEN ok THEN left(account, 8) || '-' || right(account, 2) END AS account, CASE WHEN ok THEN '01' END AS kind,
number AS found FROM (SELECT *, k % 5 NOT IN (1, 2) AS ok FROM g)""")
def lines_by_template(spark, sf):
    """Magnetic lines character by character, some with a character in doubt, some with a group too short; and the number's
    group found where a symbol was read as a digit at either end."""
    k = F.col("k")
    number, account = F.lpad((k % 900000).cast("string"), 6, "0"), F.lpad(F.col("cust").cast("string"), 10, "0")
    line = _join("S", number, "T", F.when(k % 5 == 1, "1234?678").when(k % 5 == 2, "1234567").otherwise("12345678"), "T", account, " 0199S")
    rows = _orders(spark, sf).select("k", numbers.line_by_template(numbers.line_fold(F.regexp_extract_all(line, F.lit("(.)")))).alias("r"), number.alias("n"))
    seen = F.when(k % 3 == 0, F.array("n")).when(k % 3 == 1, F.array(_join("7", F.col("n")))).otherwise(F.array(_join(F.col("n"), "7")))
    found = numbers.tokens_of_length(seen, 6)
    return rows.select("k", "r.number", "r.routing", "r.account", "r.kind", F.get(F.filter(found, lambda x: x == F.col("n")), F.lit(0)).alias("found"))


@query(f"""WITH e AS (SELECT vec_id, label, embedding FROM embeddings), first_ AS (SELECT label AS class, embedding AS tv FROM e WHERE label IS NOT NULL QUALIFY row_number() OVER (PARTITION BY label ORDER BY vec_id) = 1),
c AS (SELECT vec_id, class, corr(x, y) AS s FROM (SELECT vec_id, class, unnest(embedding)::DOUBLE AS x, unnest(tv)::DOUBLE AS y FROM e, first_) GROUP BY ALL),
r AS (SELECT vec_id, class, s, s - lead(s) OVER (PARTITION BY vec_id ORDER BY s DESC, class::VARCHAR) AS lead FROM c QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, class::VARCHAR) = 1)
SELECT vec_id, CASE WHEN s >= {values.TEMPLATE_LEAST} AND lead >= {values.TEMPLATE_MARGIN} THEN class::VARCHAR ELSE '?' END AS class, round(s, 5) AS similarity, round(lead, 5) AS lead FROM r""")
def template_classes(spark, sf):
    """Every vector against one template of each label: the first vector of the label."""
    e = t(spark, sf, "embeddings")
    templates = e.where("label IS NOT NULL").groupBy(F.col("label").alias("class")).agg(F.min_by("embedding", "vec_id").alias("vector"))
    out = ca.by_template(e.select("vec_id", F.col("embedding").cast("array<double>").alias("v")), "v", templates)
    return out.select("vec_id", "class", F.round("similarity", 5).alias("similarity"), F.round("lead", 5).alias("lead"))


@query("""WITH l AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i, (turn + conv_id) % 4 AS kind, turn || ':' || role AS line, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations),
z AS (SELECT unnest(['ciudad_fecha', 'beneficiario', 'monto_letras', 'monto_letras_2']) AS zone, unnest([0, 1, 2, 3]) AS p),
same AS (SELECT conv_id, zone, p, i, kind, line, min(i) FILTER (kind = 0) OVER (PARTITION BY conv_id) AS d, bool_or(kind = 0 AND i = 0) OVER (PARTITION BY conv_id) AS right_ FROM l JOIN z ON l.i = z.p WHERE n = 4),
swapped AS (SELECT a.conv_id, a.zone, b.line FROM same a JOIN same b ON a.conv_id = b.conv_id AND b.i = CASE WHEN a.right_ OR a.d IS NULL THEN a.i WHEN a.i = 0 THEN a.d WHEN a.i = a.d THEN 0 ELSE a.i END),
dated AS (SELECT conv_id, 'ciudad_fecha' AS zone, i, line FROM l WHERE n <> 4 AND kind = 0 QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY i) = 1),
spoken AS (SELECT conv_id, CASE row_number() OVER (PARTITION BY conv_id ORDER BY i) WHEN 1 THEN 'monto_letras' WHEN 2 THEN 'monto_letras_2' END AS zone, i, line FROM l WHERE n <> 4 AND kind = 1),
taken AS (SELECT * FROM dated UNION ALL SELECT * FROM spoken WHERE zone IS NOT NULL),
free_l AS (SELECT conv_id, line, row_number() OVER (PARTITION BY conv_id ORDER BY i) AS r FROM l ANTI JOIN taken USING (conv_id, i) WHERE n <> 4),
free_z AS (SELECT c.conv_id, zone, row_number() OVER (PARTITION BY c.conv_id ORDER BY p) AS r FROM (SELECT DISTINCT conv_id FROM l WHERE n <> 4) c CROSS JOIN z ANTI JOIN taken t ON t.conv_id = c.conv_id AND t.zone = z.zone)
SELECT conv_id, zone, line FROM swapped UNION ALL SELECT conv_id, zone, line FROM taken UNION ALL SELECT conv_id, zone, line FROM free_l JOIN free_z USING (conv_id, r)""")
def transcripts_to_zones(spark, sf):
    """The turns of a conversation as the lines of a transcript: one in four has a date, one in four number words."""
    kind = (F.col("turn") + F.col("conv_id")) % 4
    line = F.struct("turn", _join(F.col("turn").cast("string"), ":", F.col("role")).alias("text"), (kind == 0).alias("dated"), F.when(kind == 1, 2).otherwise(0).alias("words"))
    rows = t(spark, sf, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(line)).alias("lines"))
    zones = F.array(*map(F.lit, ["ciudad_fecha", "beneficiario", "monto_letras", "monto_letras_2"]))
    return rows.withColumn("z", zones).select("conv_id", F.explode(ca.lines_to_zones(rows, F.col("z"), F.col("lines"))).alias("o")).select("conv_id", "o.zone", "o.line")


@query(f"""WITH {_O}, n AS (SELECT *, 'Ana ' || upper(left(translate(cust::VARCHAR, '0123456789', 'abcdefghij'), 1)) || substr(translate(cust::VARCHAR, '0123456789', 'abcdefghij'), 2) || 'ez' AS name FROM o)
SELECT k AS page, 'beneficiario' AS field, name AS value, 'label' AS source, 0 AS at_ FROM n UNION ALL SELECT k, 'monto_letras', v::VARCHAR, 'label', 4 FROM n UNION ALL SELECT k, 'monto', v::VARCHAR, 'token', 3 FROM n
UNION ALL SELECT k, 'fecha', d::VARCHAR, 'row', 6 FROM n UNION ALL SELECT k, 'cuenta', lpad(cust::VARCHAR, 10, '0'), 'label', 7 FROM n UNION ALL SELECT k, 'concepto', 'renta de ' || CASE k % 2 WHEN 0 THEN 'casa' ELSE 'local' END, 'label', 9 FROM n
UNION ALL SELECT k, 'moneda', CASE k % 2 WHEN 0 THEN 'USD' ELSE 'PESOS' END, 'words', 4 FROM n""")
def page_fields(spark, sf):
    """Forms rendered from orders, eleven tokens each: seven fields with the token that each came from."""
    from folioflow.plans import page_fields as pf

    o = _orders(spark, sf)
    even = F.col("k") % 2 == 0
    month = F.get(F.array(*[F.lit(m) for m in ("enero", "febrero", "marzo", "abril", "mayo", "junio", "julio", "agosto", "septiembre", "octubre", "noviembre", "diciembre")]), F.month("d") - 1)
    name = _join("Ana ", F.initcap(F.translate(F.col("cust").cast("string"), "0123456789", "abcdefghij")), "ez")
    said = _join(words.number_words(F.floor("v")), " con ", F.col("c"), F.when(even, "/100 dolares").otherwise("/100 pesos"))
    token = lambda i, text, x, y: F.struct(F.lit(i).cast("long").alias("idx"), (F.lit(text) if isinstance(text, str) else text).alias("text"), F.lit(x).alias("x0"), F.lit(y).alias("y0"), F.lit(x + 0.12).alias("x1"), F.lit(y + 0.04).alias("y1"))
    made = [token(0, "PÁGUESE A LA 0RDEN DE:", 0.05, 0.30), token(1, name, 0.20, 0.30), token(2, "US$", 0.50, 0.30), token(3, F.format_number("v", 2), 0.65, 0.30), token(4, "La suma de", 0.05, 0.40), token(5, said, 0.20, 0.40),
            token(6, _join("Quito, ", F.dayofmonth("d").cast("string"), " de ", month, " de ", F.date_format("d", "yyyy")), 0.05, 0.55), token(7, "Cta. Cte. No", 0.05, 0.65), token(8, F.lpad(F.col("cust").cast("string"), 10, "0"), 0.20, 0.65),
            token(9, "Concepto", 0.05, 0.74), token(10, F.when(even, "renta de casa").otherwise("renta de local"), 0.20, 0.74)]
    tokens = o.select(F.col("k").alias("page"), F.inline(F.array(*made)))
    return pf.page_fields(tokens).withColumnRenamed("at", "at_")


_SPELT = {"Míl": "Mil", "MÍL": "MIL", "míl": "mil", "Millon": "Millón", "DIECISEIS": "DIECISÉIS", "veintidos": "veintidós", "Dólares": "Dólares", "Casa": "Casa", "thóusand": "thousand", "Próxima": "Próxima"}


@query(f"""WITH {_O} SELECT k, 'Són ' || [{", ".join(f"'{w}'" for w in _SPELT.values())}][k % 10 + 1] || ' y ' || [{", ".join(f"'{w}'" for w in _SPELT.values())}][cust % 10 + 1] || ', ' || c || '/100.' AS said FROM o""")
def canonical_amounts(spark, sf):
    """Number words with accents that readers lost or added, in three cases, beside words that are none; noughts as letters."""
    pick = lambda by: F.get(F.array(*map(F.lit, _SPELT)), (F.col(by) % 10).cast("int"))
    text = _join("Són ", pick("k"), " y ", pick("cust"), ", ", F.translate("c", "0", "O"), " / 1oO.")
    return _orders(spark, sf).select("k", words.canonical_words(text).alias("said"))


_HUNDREDS, _TENS = ["doscientos", "trescientos", "quinientos", "novecientos"], ["veinte", "treinta", "cuarenta", "setenta"]


@query(f"""WITH {_O} SELECT k, upper('mil ' || {_HUNDREDS!r}[k % 4 + 1] || ' ' || {_TENS!r}[cust % 4 + 1] || ' dolares con ') || c || '/100' AS said FROM o""")
def rewritten_amounts(spark, sf):
    """Two number words glued, cents with letters for digits."""
    pick = lambda words_, by: F.get(F.array(*map(F.lit, words_)), (F.col(by) % 4).cast("int"))
    text = _join("Míl ", pick(_HUNDREDS, "k"), pick(_TENS, "cust"), " dólares con ", F.translate("c", "0125", "oiZs"), "/1oo xx")
    return _orders(spark, sf).select("k", words.rewritten_amount(text).alias("said"))


@query(f"""WITH {_O} SELECT k, CASE k % 3 WHEN 2 THEN 'cliente ' || cust ELSE cust || ' - ' || n END AS said, (CASE k % 3 WHEN 0 THEN 1.0 * (length(cust::VARCHAR) + length(n::VARCHAR)) / (length(cust::VARCHAR) + length(n::VARCHAR) + 7) WHEN 1 THEN 1.0 * (length(cust::VARCHAR) + length(n::VARCHAR)) / (length(cust::VARCHAR) + length(n::VARCHAR) + 4) ELSE length(cust::VARCHAR) / (length(cust::VARCHAR) + 10.0) END)::DOUBLE AS digits FROM o""")
def unfilled_values(spark, sf):
    """Filler signs gone, and the share of digits in what was written."""
    number, name = F.col("n").cast("string"), F.col("cust").cast("string")
    forms = F.array(_join("** ", name, " _-#~ ", number, " ."), _join(name, " =-|| ", number), _join(": cliente ", name, "=;"))
    said = F.get(forms, (F.col("k") % 3).cast("int"))
    return _orders(spark, sf).select("k", text.unfilled(said).alias("said"), text.digit_ratio(said).alias("digits"))


@query(f"""WITH {_O} SELECT k, k % 3 < 2 AS printed FROM o""")
def misread_legends(spark, sf):
    """Whole lines of print with a letter lost or wrong, against names and numbers."""
    legend = F.get(F.array(*map(F.lit, values.LEGENDS)), (F.col("cust") % len(values.LEGENDS)).cast("int"))
    at = (F.col("k") % 9 + 1).cast("int")
    lost, wrong = F.concat(F.left(legend, at - 1), F.substr(legend, at + 1)), F.concat(F.left(legend, at - 1), F.lit("x"), F.substr(legend, at + 1))
    said = F.when(F.col("k") % 3 == 0, lost).when(F.col("k") % 3 == 1, wrong).otherwise(_join("cliente", F.col("cust").cast("string"), F.col("n").cast("string")))
    return _orders(spark, sf).select("k", zones.misread_legend(F.regexp_replace(said, "^$", "usdolares")).alias("printed"))


@query(f"""WITH {_O} SELECT k, 'a' AS reading, 90.5::DOUBLE AS utility, true AS best FROM o UNION ALL SELECT k, 'b', (6 + length(cust::VARCHAR) + 0.9 * length(n::VARCHAR))::DOUBLE, false FROM o""")
def useful_readings(spark, sf):
    """Two readings of each page: one keeps the written amount, the other reads more surely but without it."""
    box = lambda r, i, said, sure: F.struct(F.lit(r).alias("reading"), F.lit(i).alias("i"), F.lit(sure).alias("sure"), said.alias("said"))
    made = [box("a", 0, F.lit("son mil"), 0.9), box("a", 1, F.lit("doscientos"), 0.8), box("a", 2, _join(F.col("c"), "/100"), 0.7), box("b", 0, _join("Banco ", F.col("cust").cast("string")), 1.0), box("b", 1, F.col("n").cast("string"), 0.9)]
    boxes = _orders(spark, sf).select("k", F.inline(F.array(*made)))
    return aggregates.useful_readings(boxes, ["k"], "reading", "i", "sure", "said").withColumn("utility", F.round("utility", 6))


@query(f"""WITH {_O} SELECT k, field FROM (SELECT k, 'monto' AS field, k % 2 = 0 AS hand, (k % 100) / 100.0 AS conf FROM o UNION ALL SELECT k, 'fecha', k % 3 = 0, (cust % 100) / 100.0 FROM o) WHERE hand AND conf < 0.8""")
def handwritten_fields(spark, sf):
    """Fields that go to a reader of handwriting."""
    hand = lambda n: F.when(F.col("k") % n == 0, "manuscrito").otherwise("impreso")
    field = lambda name, n, by: F.struct(F.lit(name).alias("field"), hand(n).alias("writing"), (F.col(by) % 100 / 100).alias("confidence"))
    fields = _orders(spark, sf).select("k", F.inline(F.array(field("monto", 2, "k"), field("fecha", 3, "cust"))))
    return deciders.handwritten_doubt(fields).select("k", "field")
