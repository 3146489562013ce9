"""Cases worked out by hand: what a text or a layout is given, and what must come out."""

from folioflow.functions import dates, numbers, spans, text, words
from folioflow.operators import candidates as ca, windows as wi
from folioflow.plans import deciders
from folioflow.session import workers_see_package
from pyspark.sql import functions as F

CASES = {}


def query(sql):
    def add(f):
        CASES[f.__name__] = (f, sql)
        return f

    return add


def _sql(v) -> str:
    if v is None:
        return "NULL"
    return "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)


def given(rows: list[tuple], names: str, select: str = "*") -> str:
    """SQL that lists the rows."""
    return f"SELECT {select} FROM (VALUES " + ", ".join("(" + ", ".join(map(_sql, r)) + ")" for r in rows) + f") AS v({names})"


def inputs(spark, rows: list[tuple], schema: str):
    workers_see_package(spark)
    n = len(schema.split(","))
    return spark.createDataFrame([r[:n] for r in rows], schema)


AMOUNTS_TOLERANT = [
    ("los 500", 500), ("Solo 20", 20), ("es 1000", 1000), ("1000 son", 1000), ("US$ 1.250,50", 1250.5), ("1O5O,5O", 1050.5), ("1000 000 00", 1000000), ("12.50.000", None),
    ("1.235", 1235), ("47560", 47560), ("1 250", 1250), ("1250 50", 1250.5), ("son doscientos", None), ("", None), ("12,5", 12.5), ("B,5O", 8.5), ("Z5.OO", 25),
]


@query(given(AMOUNTS_TOLERANT, "written, value", "written, value::DECIMAL(18,2) AS value"))
def amount_tolerant_cases(spark, sf):
    return inputs(spark, AMOUNTS_TOLERANT, "written string").select("written", numbers.amount_tolerant(F.col("written")).alias("value"))


AMOUNTS_BILINGUAL = [
    ("US$ ***1,250.50***", "1,250.50", 1250.5), ("Son 12 de 1.250", "1.250", 1250), ("1'250,50", "1'250,50", 1250.5), ("1 250 000.75", "1 250 000.75", 1250000.75), ("850-50", "850.50", 850.5), ("850 50", "850.50", 850.5),
    ("1250.-", "1250", 1250), ("50/100", None, None), ("0.125", "0.125", 125), ("nada", None, None), ("1,25", "1,25", 1.25), ("12 y 34", "12", 12),
]


@query(given(AMOUNTS_BILINGUAL, "written, found, value", "written, found, value::DECIMAL(18,2) AS value"))
def amount_bilingual_cases(spark, sf):
    rows = inputs(spark, AMOUNTS_BILINGUAL, "written string").select("written", numbers.find_amount_bilingual(F.col("written")).alias("f"))
    return rows.select("written", F.col("f.text").alias("found"), "f.value")


AMOUNTS_REPAIR = [("***1500.5", "1500.5", 1500.5), ("1.5OO,OO", "1.500,00", 1500), ("No 12 por 1 250", "1 250", 1250), ("1,500.00", "1,500.00", 1500), ("1.250", "1.250", 1250), ("sin cifras", None, None), ("7", "7", 7), ("12.50.000", "12.50", 12.5)]


@query(given(AMOUNTS_REPAIR, "written, found, value", "written, found, value::DECIMAL(18,2) AS value"))
def amount_repair_cases(spark, sf):
    rows = inputs(spark, AMOUNTS_REPAIR, "written string").select("written", numbers.find_amount_repair(F.col("written")).alias("f"))
    return rows.select("written", F.col("f.text").alias("found"), "f.value")


COMPARED = [
    ("monto_numeros", "1250.5", "1250.50"), ("monto_numeros", "n/a", "n/a"), ("monto_letras", "Mil doscientos con 50/100", "1200.50"), ("monto_letras", "475.6", "475.60"), ("cuenta", "00-12 34", "001234"),
    ("numero_cheque", "N° 77", "77"), ("beneficiario", "  José  PÉREZ ", "jose perez"), ("beneficiario", None, ""), ("monto_letras", "ilegible", "ilegible"),
]


@query(given(COMPARED, "field, value, comparable"))
def comparable_values(spark, sf):
    rows = inputs(spark, COMPARED, "field string, value string")
    spoken = words.amount_words_tolerant(words.repaired_words(F.col("value")))
    return rows.select("field", "value", numbers.comparable(F.col("field"), F.col("value"), spoken).alias("comparable"))


@query(given([("x12S 45", "125,45"), ("⑆OO12S⑆ 7B9l-Q", "00125,7891,0"), ("123 456", "123,456"), ("", "")], "line, groups"))
def line_digits(spark, sf):
    rows = inputs(spark, [("x12S 45",), ("⑆OO12S⑆ 7B9l-Q",), ("123 456",), ("",)], "line string")
    return rows.select("line", F.array_join(numbers.line_tokens(F.col("line")), ",").alias("groups"))


ANYWHERE = [
    ("Quito, 04 de Septiembre de 2025", "2025-09-04", 8), ("oficio 0116/12/05, 05-10-2026", "2026-10-05", 20), ("2025, IX, 04", "2025-09-04", 1), ("Sep. 04/2025", "2025-09-04", 1), ("31/02/2025 y 2026 - 10 - 2", "2026-10-02", 14),
    ("5-oct-2026 o 01/01/2020", "2026-10-05", 1), ("sin fecha", None, None), ("12 marzo 1999; 2000/01/02", "1999-03-12", 1), ("04 de IX del 2025", "2025-09-04", 1),
]


@query(given(ANYWHERE, "written, day, pos", "written, day::DATE AS day, pos::INTEGER AS pos"))
def earliest_dates(spark, sf):
    rows = inputs(spark, ANYWHERE, "written string").select("written", dates.earliest_date(F.col("written")).alias("f"))
    return rows.select("written", F.col("f.date").alias("day"), "f.pos")


FORMS = [
    ("Guayaquil, 3 de marzo del 24", "2024-03-03"), ("March 5, 2026", "2026-03-05"), ("5 de Septiembre 2025", "2025-09-05"), ("2026.1.2", "2026-01-02"), ("12/25/26", "2026-12-25"), ("01 02 2026", "2026-02-01"), ("01022026", "2026-02-01"),
    ("31/02/2026", None), ("1/1/1980", None), ("Dec. 24 1999", "1999-12-24"), ("", None),
]


@query(given(FORMS, "written, day", "written, day::DATE AS day"))
def dates_any_form(spark, sf):
    return inputs(spark, FORMS, "written string").select("written", dates.date_any_form(F.col("written")).alias("day"))


LOOSE = [("Quito 15/03/2026", "15/03/2026"), ("31/02/2026", "31/02/2026"), ("2O26-a1-15", None), ("15103/2026", "15/03/2026"), ("1s/o3/26", "15/03/2026"), ("4 de septiembre del 2025", "04/09/2025"), ("2026/5/9", "09/05/2026"), ("40/01/2026", None), ("1/1/1900", None), ("nada", None), ("2S/iZ/zb", None), ("1s/o3/Z6", None)]


@query(given(LOOSE, "written, day"))
def loose_dates(spark, sf):
    return inputs(spark, LOOSE, "written string").select("written", dates.loose_date(F.col("written")).alias("day"))


@query(given([("20a6-0s-29", "2026-05-29", "2096-05-29"), ("casa 5", "casa 5", "casa 5"), ("2S/i2/2a26", "25/12/2226", "25/12/2926")], "written, zones, repair"))
def date_digit_repairs(spark, sf):
    """A letter a inside digits is a 2 in one dialect and a 9 in the other; groups without a digit stay."""
    rows = inputs(spark, [("20a6-0s-29",), ("casa 5",), ("2S/i2/2a26",)], "written string")
    c = F.col("written")
    return rows.select("written", dates.digits_repaired(c).alias("zones"), dates.digits_repaired_in_dates(c).alias("repair"))


@query(given([("01101/2008", "01/01/2008", 2), ("20/112018", "20/1/2018", 2), ("20/01/2018", "20/01/2018", 1)], "written, last, n", "written, last, n::INTEGER AS n"))
def slash_read_as_one(spark, sf):
    rows = inputs(spark, [("01101/2008",), ("20/112018",), ("20/01/2018",)], "written string").select("written", dates.slash_readings(F.col("written")).alias("w"))
    return rows.select("written", F.element_at("w", -1).alias("last"), F.size("w").alias("n"))


@query(given([("quinientoscincuenta", "quinientos cincuenta", 2), ("treycientoscincuentadolares", "trescientos cincuenta dolares", 2), ("mil", "mil", 1), ("zz", "zz", 0), ("xyzxyzxyzxyz", "xyzxyzxyzxyz", 0), ("cua+ro mil", "cuatro mil", 2)], "written, said, numbers", "written, said, numbers::INTEGER AS numbers"))
def glued_words(spark, sf):
    rows = inputs(spark, [("quinientoscincuenta",), ("treycientoscincuentadolares",), ("mil",), ("zz",), ("xyzxyzxyzxyz",), ("cua+ro mil",)], "written string")
    rows = rows.select("written", words.split_glued(F.col("written")).alias("w"))
    return rows.select("written", F.array_join("w", " ").alias("said"), words.number_word_count(F.col("w")).alias("numbers"))


@query(given([("sesenta y 601)00", "sesenta y  60/100 "), ("con 6o )co", "con  60/100 "), ("son 50/100", "son  50/100 "), ("cien 60 co", "cien  60/100 "), ("doce", "doce")], "written, repaired"))
def cents_repairs(spark, sf):
    rows = inputs(spark, [("sesenta y 601)00",), ("con 6o )co",), ("son 50/100",), ("cien 60 co",), ("doce",)], "written string")
    return rows.select("written", words.cents_repaired(F.col("written")).alias("repaired"))


@query(given([(24000, "veinte y cuatro mil|veinte y cuatro mil 00|veinticuatro mil|veinticuatro mil 00", "2400000,24000"), (1016.5, "mil dieciseis 50|mil dieciseis 50 centavos|mil dieciseis con cincuenta centavos|mil dieciseis y cincuenta centavos|mil diez y seis 50|mil diez y seis 50 centavos|mil diez y seis con cincuenta centavos|mil diez y seis y cincuenta centavos|un mil dieciseis 50|un mil dieciseis 50 centavos|un mil dieciseis con cincuenta centavos|un mil dieciseis y cincuenta centavos|un mil diez y seis 50|un mil diez y seis 50 centavos|un mil diez y seis con cincuenta centavos|un mil diez y seis y cincuenta centavos", "101650")], "amount, forms, digits", "amount::DECIMAL(18,2) AS amount, forms, digits"))
def amount_spellings(spark, sf):
    rows = inputs(spark, [("24000",), ("1016.5",)], "a string").select(F.col("a").cast("decimal(18,2)").alias("amount"))
    return rows.select("amount", F.array_join(words.amount_spellings(F.col("amount")), "|").alias("forms"), F.array_join(words.amount_digits(F.col("amount")), ",").alias("digits"))


#: Two frames over blank, a, b; the scores are ratios of probabilities to the frames' largest.
CTC = [("ab", 0.0), ("a", -1.2528), ("b", -2.0794), ("ba", -4.0254), ("A", -1.2528), ("a b", 0.0), ("", None)]


@query(given(CTC, "candidate, score", "candidate, score::DOUBLE AS score"))
def ctc_cases(spark, sf):
    rows = inputs(spark, CTC, "candidate string").select("candidate", F.array(*map(F.lit, [0.1, 0.8, 0.1, 0.2, 0.1, 0.7])).alias("m"), F.lit(2).alias("t"))
    return ca.ctc_scores(rows, "m", "t", "candidate", "ab").select("candidate", F.round("score", 4).alias("score"))


#: page, idx, y0, y1 and the row by hand: the second grows the first row, so the third still meets it.
OVERLAPPING = [(1, 0, 0.0, 1.0, 0), (1, 1, 0.4, 1.6, 0), (1, 2, 0.9, 1.7, 0), (1, 3, 3.0, 4.0, 1), (1, 4, 3.8, 5.0, 2), (2, 0, 5.0, 6.0, 1), (2, 1, 1.0, 2.0, 0)]


@query(given(OVERLAPPING, 'page, idx, y0, y1, k', 'page::BIGINT AS page, idx::BIGINT AS idx, k::BIGINT AS "row"'))
def rows_by_overlap(spark, sf):
    rows = inputs(spark, OVERLAPPING, "page long, idx long, y0 double, y1 double").withColumn("cy", (F.col("y0") + F.col("y1")) / 2).withColumn("x0", F.lit(0.0))
    return wi.rows_by_overlap(rows, "page")


#: Too little width in common; stacked; near one under another; side by side with half of the lesser area; no area.
BOXES = [
    (1, 0.0, 0.0, 10.0, 1.0, 0.5), (1, 9.9, 1.0, 20.0, 2.0, 0.6), (2, 0.0, 0.0, 10.0, 10.0, 0.5), (2, 0.0, 8.0, 10.0, 18.0, 0.9), (3, 0.0, 0.0, 10.0, 10.0, 0.2), (3, 3.0, 21.0, 9.0, 30.0, 0.1), (3, 0.0, 42.0, 10.0, 50.0, 0.3),
    (4, 0.0, 0.0, 10.0, 40.0, 0.5), (4, 5.0, 20.0, 15.0, 30.0, 0.4), (5, 1.0, 1.0, 1.0, 1.0, 0.4),
]


@query(given([(1, 0, 0, 10, 1, 0.5), (1, 9.9, 1, 20, 2, 0.6), (2, 0, 0, 10, 18, 0.9), (3, 0, 0, 10, 30, 0.2), (3, 0, 42, 10, 50, 0.3), (4, 0, 0, 15, 40, 0.5), (5, 1, 1, 1, 1, 0.4)], "page, a, b, c, d, p", "page::BIGINT AS page, a::DOUBLE AS x0, b::DOUBLE AS y0, c::DOUBLE AS x1, d::DOUBLE AS y1, p::DOUBLE AS confidence"))
def merged_boxes(spark, sf):
    return wi.merged_boxes(inputs(spark, BOXES, "page long, x0 double, y0 double, x1 double, y1 double, confidence double"), "page")


#: page, idx, text, x0, y0 of tokens 0.1 high and 0.1 wide.
PAGES = [
    (1, 0, "Paguese a la 0rden de: Ana", 0.0, 0.1), (1, 1, "Perez", 0.15, 0.1), (1, 2, "US$ 5", 0.30, 0.1), (1, 3, "Lopez", 0.3, 0.3),
    (2, 0, "La suma de", 0.0, 0.1), (2, 1, "mil", 0.05, 0.22), (2, 2, "lejos", 0.6, 0.1),
    (3, 0, "Concepto", 0.0, 0.1), (3, 1, "renta", 0.5, 0.1), (4, 0, "nada", 0.0, 0.1),
]


@query(given([(1, 0, "Ana Perez"), (2, 0, "mil")], "page, anchor, text", "page::BIGINT AS page, anchor::BIGINT AS anchor, text"))
def value_after_anchor(spark, sf):
    rows = inputs(spark, PAGES, "page long, idx long, text string, x0 double, y0 double").withColumns({"x1": F.col("x0") + 0.1, "y1": F.col("y0") + 0.1})
    rest = text.after_anchor(F.col("text"), ["a la orden de", "la suma de", "concepto"])
    return wi.value_after_anchor(rows, "page", rest.isNotNull(), F.coalesce(rest, F.lit("")), F.contains("text", F.lit("$")), F.lit(False), F.length("text") > 1)


LABELS = [("PÁGUESE A LA 0RDEN DE: Juan", "Juan"), ("a1a orden d3", None), ("5on: mil", "mil"), ("persona mil", None), ("La   suma  de ___ cien", "cien"), ("", None)]


@query(given(LABELS, "written, rest"))
def printed_labels(spark, sf):
    rows = inputs(spark, LABELS, "written string")
    return rows.select("written", text.after_anchor(F.col("written"), ["a la orden de", "la suma de", "son"]).alias("rest"))


STRIPPED = [("Páguese a la orden de: Ana Pérez US$ 500", "Ana Pérez", "Páguese a la orden de Ana Pérez US", "Páguese a la Orden de: Ana Pérez Us$ 500"), ("Ciudad y fecha: Quito, 5 de mayo", "Ciudad y fecha: Quito, 5 de mayo", "Quito", "Ciudad y Fecha: Quito, 5 de Mayo"), ("", "", "", "")]


@query(given([("Páguese a la orden de: Ana Pérez US$ 500", "Ana Pérez", "Páguese a la orden de Ana Pérez US"), ("Ciudad y fecha: Quito, 5 de mayo", "Ciudad y fecha: Quito, 5 de mayo", "Quito"), ("", "", "")], "written, payee, city"))
def stripped_labels(spark, sf):
    c = F.col("written")
    return inputs(spark, STRIPPED, "written string").select("written", text.stripped_payee(c).alias("payee"), text.stripped_city(c).alias("city"))


SPANS = [('x {"a": 12, "b": "hola", "a": [1, 2]}', "a:30-36,b:18-22"), ('{"k": tru', ""), ('{"k": 1, "m": "no', "k:6-7"), ("nothing", ""), ('{"q": "a\\"b"}', "q:7-11")]


@query(given(SPANS, "said, found"))
def member_spans(spark, sf):
    rows = inputs(spark, SPANS, "said string").select("said", spans.member_spans(F.col("said")).alias("s"))
    return rows.select("said", F.array_join(F.array_sort(F.transform("s", lambda x: F.concat(x["key"], F.lit(":"), x["start"], F.lit("-"), x["end"]))), ",").alias("found"))


OBJECTS = [('noise {"a": 1} tail', '{"a": 1}'), ("no braces", None), ("{broken", None), ("[1] {}", "{}")]


@query(given(OBJECTS, "said, found"))
def embedded_objects(spark, sf):
    return inputs(spark, OBJECTS, "said string").select("said", spans.first_object(F.col("said")).alias("found"))


WRAPPED = [('[{"a":1}]', '{"a":1}'), ('{"b":2}', '{"b":2}'), ('[{"a":1},{"b":2}]', "{}"), ("[]", "{}"), ("7", "{}"), ("oops", "{}"), ("null", "{}")]


@query(given(WRAPPED, "said, found"))
def unwrapped_lists(spark, sf):
    return inputs(spark, WRAPPED, "said string").select("said", spans.unwrapped(F.col("said")).alias("found"))


@query(given([("c3a9|61", "é:0-0,a:1-1"), ("c3|a9|62", "é:0-1,b:2-2"), ("e4b8|ad", "中:0-1"), ("61|c3", "a:0-0,\ufffd:1-1"), ("ff|61", "\ufffd:0-0,a:1-1")], "bytes, found"))
def byte_tokens(spark, sf):
    rows = inputs(spark, [("c3a9|61",), ("c3|a9|62",), ("e4b8|ad",), ("61|c3",), ("ff|61",)], "bytes string")
    rows = rows.select("bytes", spans.token_texts(F.transform(F.split("bytes", "[|]"), lambda x: F.unhex(x))).alias("g"))
    return rows.select("bytes", F.array_join(F.transform("g", lambda x: F.concat(x["text"], F.lit(":"), x["first"], F.lit("-"), x["last"])), ",").alias("found"))


@query(given([("guayaquil", "Guayaquil"), ("maria perz", None), ("kito", "Quito")], "written, x", "written, CASE written WHEN 'guayaquil' THEN 'guayaquil' WHEN 'kito' THEN 'quito' ELSE '' END AS near"))
def closest_three(spark, sf):
    rows = inputs(spark, [("guayaquil",), ("maria perz",), ("kito",)], "written string")
    return rows.select("written", F.array_join(ca.closest_of(F.col("written"), ["guayaquil", "quito", "manta", "cuenca"], 3, 0.44), ",").alias("near"))


FORMS_OF = {"payee": ["paguese a la orden", "pay"], "city": ["ciudad y fecha"], "sum": ["la suma de", "son"]}


@query(given([("pagese a la orden de juan", "payee"), ("paid to", None), ("pay to", "payee"), ("ciudao y fecha quito", "city"), ("sona", "sum"), ("x", None)], "written, label"))
def label_prefixes(spark, sf):
    rows = inputs(spark, [("pagese a la orden de juan",), ("paid to",), ("pay to",), ("ciudao y fecha quito",), ("sona",), ("x",)], "written string")
    return rows.select("written", ca.label_of(F.col("written"), FORMS_OF).alias("label"))


@query(given([("juan perez", "jaun peres lopez", "jaun,peres"), ("ana", "bo", "-"), ("ana", "", "-")], "base, other, found"))
def aligned_words(spark, sf):
    rows = inputs(spark, [("juan perez", "jaun peres lopez"), ("ana", "bo"), ("ana", "")], "base string, other string")
    some = lambda c: F.filter(F.split(c, " "), lambda x: x != "")
    return rows.select("base", "other", F.array_join(ca.aligned(some("base"), some("other")), ",", "-").alias("found"))


CITY = [("1", "Quito 5 de mayo", "Quito, 05|Guito 05", "Quito", 0.9, "false"), ("2", None, "Loja 1|Loja 2|Lcja 3", "Loja", 0.6, "true"), ("3", "Manta 3", "Xyz 1", "Manta", 0.6, "true"), ("4", None, "12/05", None, 0.0, "true"), ("5", "Lugar y fecha: Ambato 1", "Ambato 1", "Ambato", 0.9, "false")]


@query(given([(k, v, c, r) for k, _, _, v, c, r in CITY], "k, value, confidence, review", "k, value, confidence::DOUBLE AS confidence, review::BOOLEAN AS review"))
def city_decisions(spark, sf):
    rows = inputs(spark, CITY, "k string, deep string, quick string")
    return deciders.city(rows.select("k", "deep", F.split("quick", "[|]").alias("quick")), "k").select("k", "value", "confidence", "review")


PAYEE = [
    ("1", "Paguese a la orden de Juan Perez US$ 5", "juan perez|juan peres", "Juan Perez", 0.9, "false"), ("2", "Xx Yy", "ana lopez", "Xx Yy", 0.6, "true"),
    ("3", None, "juan perez|juan perez", "Juan Pérez", 1.0, "false"), ("4", None, "juan perez|jaun perez", "Juan Pérez", 0.6, "true"), ("5", None, "", None, 0.0, "true"), ("6", None, "luz de kwx|luz de kwx", "Luz de Kwx", 1.0, "false"),
    # "zoe de" is as much like a misread "orden de" as two letters in eight make it, so it goes as a rest of the label.
    ("10", None, "zoe de kwx|zoe de kwx", "Kwx", 0.79, "true"), ("11", None, "Camilasalaga|Camilasalaga", "Camila Salazar", 1.0, "false"),
    ("7", None, "orden de juan perez|orden de juan perez", "Juan Pérez", 1.0, "false"), ("8", None, "juan juan perez|juan juan perez", "Juan Pérez", 1.0, "false"), ("9", None, "orben de ana perez|ana perez", "Ana Pérez", 1.0, "false"),
]


@query(given([(k, v, c, r) for k, _, _, v, c, r in PAYEE], "k, value, confidence, review", "k, value, confidence::DOUBLE AS confidence, review::BOOLEAN AS review"))
def payee_decisions(spark, sf):
    rows = inputs(spark, PAYEE, "k string, deep string, quick string")
    return deciders.payee(rows.select("k", "deep", F.split("quick", "[|]").alias("quick")), "k", {"juan": "Juan", "perez": "Pérez", "ana": "Ana", "camila": "Camila", "salazar": "Salazar"}).select("k", "value", "confidence", "review")


DATED = [
    ("1", "Quito 05/10/1997", "05/10/1997|05110/1997", "1997-10-05", 0.95, "false"), ("2", "05/10/1997", "06/10/1997", "1997-10-05", 0.7, "true"), ("3", None, "05/10/1997|05/10/1997|06/10/1997", "1997-10-05", 0.667, "true"),
    ("4", None, "nada", None, 0.0, "true"), ("5", "05/10/1970", "05/10/1970", "1970-10-05", 0.7, "true"), ("6", None, "05/10/199T", "1997-10-05", 0.79, "true"), ("7", "Quito05/10/1997", "Quito05/10/1997", "1997-10-05", 0.95, "false"), ("8", None, "Quito05/10/1997|Quito05/10/1997", "1997-10-05", 0.79, "true"),
]


@query(given([(k, v, c, r) for k, _, _, v, c, r in DATED], "k, value, confidence, review", "k, value, confidence::DOUBLE AS confidence, review::BOOLEAN AS review"))
def date_decisions(spark, sf):
    rows = inputs(spark, DATED, "k string, deep string, quick string")
    return deciders.date(rows.select("k", "deep", F.split("quick", "[|]").alias("quick")), "k", "1998-08-02").select("k", "value", "confidence", "review")
