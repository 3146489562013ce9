"""The fields of a form out of the tokens of its page, each with where it came from.

Tokens: page, idx, text, x0, y0, x1, y1, on a page of width and height 1. Evidence is gathered per field: what stands behind
a printed label or below it, rows that hold a date, tokens that hold an amount with a score. A token that is part of a date
is no amount, and the amount in words adds to the score of the figures that agree with it. Pages are joined by their key
only, and what has no evidence has no row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from folioflow.functions import values
from folioflow.functions.bilingual import amount_words_bilingual
from folioflow.functions.dates import date_any_form
from folioflow.functions.numbers import amount_score, find_amount_bilingual
from folioflow.functions.text import after_anchor, plain, tidy
from folioflow.operators.windows import page_rows, value_after_anchor
from folioflow.session import cut, matched

SYMBOL = F.regexp_like(F.trim(F.col("text")), F.lit(values.CURRENCY_TOKEN))
_ANCHORS = {"payee": values.PAYEE_LABELS, "words": values.WORDS_LABELS, "account": values.ACCOUNT_LABELS, "concept": values.CONCEPT_LABELS}


def asked(tokens: DataFrame) -> DataFrame:
    """The tokens with what their texts say, written once: labels and amounts are sought in each text once, and the plans that
    ask for it stay small in the driver. ``after_``: what follows a label of a kind; ``labelled``, ``symbol``; ``amount``."""
    text = F.col("text")
    counted = F.length(F.regexp_replace("text", "[^0-9]", ""))
    like = SYMBOL | ((counted >= 1) & (counted > 0.6 * F.length(F.regexp_replace("text", r"\s", ""))))
    said = {f"after_{k}": after_anchor(text, v) for k, v in _ANCHORS.items()} | {"labelled": after_anchor(text, values.FIELD_LABELS).isNotNull()}
    return cut(tokens.select("page", "idx", "text", "x0", "y0", "x1", "y1").withColumns(said | {"symbol": SYMBOL, "amount_like": like, "amount": find_amount_bilingual(text)}))


def _behind(tokens: DataFrame, kind: str, stop: Column, accept: Column | None = None, max_dx: float = 0.75) -> DataFrame:
    """page, at (the label's idx), text of what belongs to a label; another label ends it. Tokens of ``asked``."""
    rest = F.col(f"after_{kind}")
    ends = stop | F.col("labelled")
    fine = F.lit(True) if accept is None else accept
    out = value_after_anchor(tokens, "page", rest.isNotNull(), tidy(F.coalesce(rest, F.lit(""))), ends, F.lit(False), fine & (tidy(F.col("text")) != ""), values.BAND_TOP, max_dx)
    return out.select("page", F.col("anchor").alias("at"), tidy(F.col("text")).alias("text"))


def _listed(rows: DataFrame, field: str, value: Column, source: str) -> DataFrame:
    return rows.select("page", F.lit(field).alias("field"), value.cast("string").alias("value"), F.lit(source).alias("source"), F.col("at").cast("long").alias("at")).where(F.col("value").isNotNull() & (F.col("value") != ""))


def dated_rows(tokens: DataFrame) -> DataFrame:
    """page, at (the first token's idx), date of the best row that holds one: with a label of dates, and high on the page."""
    t = tokens.where(F.col("text").isNotNull()).withColumns({"cy": (F.col("y0") + F.col("y1")) / 2, "h": F.col("y1") - F.col("y0")})
    rows = matched(t, page_rows(t, "page"), "page", "idx").groupBy("page", "row").agg(F.array_sort(F.collect_list(F.struct("x0", "idx", "text"))).alias("l"), F.min("cy").alias("cy"))
    rows = rows.where(F.col("cy") <= values.BAND_TOP - 0.02).withColumn("text", F.array_join("l.text", "  ")).withColumn("date", date_any_form(F.col("text"))).where("date IS NOT NULL")
    score = F.when(F.regexp_like(plain(F.col("text")), F.lit("[a-z]{3}")), 0.4).otherwise(0.0) + F.when(after_anchor(F.col("text"), values.DATE_LABELS).isNotNull(), 0.3).otherwise(0.0) + F.when(F.col("cy") < 0.45, 0.2).otherwise(0.0)
    best = F.row_number().over(Window.partitionBy("page").orderBy(score.desc(), "row"))
    return rows.withColumn("n", best).where("n = 1").select("page", F.col("l")[0]["idx"].alias("at"), "date", F.col("l.idx").alias("used"))


def amounts(tokens: DataFrame, spoken: DataFrame, dated: DataFrame) -> DataFrame:
    """page, at, value of the token that serves best as the amount: at least 0.45 by ``amount_score``, ties to the lower idx."""
    t = tokens.withColumns({"cx": (F.col("x0") + F.col("x1")) / 2, "cy": (F.col("y0") + F.col("y1")) / 2, "h": F.col("y1") - F.col("y0"), "f": F.col("amount")})
    signs = t.where("symbol").select("page", F.struct("x1", "cy", "h").alias("s")).groupBy("page").agg(F.collect_list("s").alias("signs"))
    t = t.where((F.col("f.value") > 0) & (F.col("cy") <= values.BAND_TOP))
    for part in (signs, spoken.select("page", F.col("value").alias("said")), dated.select("page", "used")):
        t = matched(t, part, "page", how="left")
    t = t.where(~F.coalesce(F.array_contains("used", F.col("idx")), F.lit(False)))
    digits = F.length(F.regexp_replace("f.text", "[^0-9]", ""))
    sign = F.regexp_like("text", F.lit(r"(?i)us\s*\$|\$|usd|€"))
    letters = F.length(F.regexp_replace(F.regexp_replace("text", "(?i)us|usd", ""), r"[^\p{L}]", ""))
    beside = F.coalesce(F.exists("signs", lambda s: (F.abs(s["cy"] - F.col("cy")) < F.greatest(s["h"], F.col("h"))) & (F.col("x0") - s["x1"] >= -0.01) & (F.col("x0") - s["x1"] < 0.15)), F.lit(False))
    score = amount_score(sign, beside, F.regexp_like("f.text", F.lit(r"[.,][0-9]{2}$")), F.contains("text", F.lit("*")), F.col("cx"), F.col("cy"), digits, F.coalesce(F.col("said") == F.col("f.value"), F.lit(False)))
    t = t.where((digits <= 11) & (sign | (letters <= 2))).withColumn("score", score).where("score >= 0.45")
    return t.groupBy("page").agg(F.max_by(F.struct("idx", "f.value"), F.struct(F.col("score"), -F.col("idx"))).alias("b")).select("page", F.col("b.idx").alias("at"), "b.value")


def page_fields(tokens: DataFrame) -> DataFrame:
    """page, field, value, source ("label", "row", "token" or "words") and the idx of the token that it came from.

    Fields: beneficiario, monto_letras, monto, fecha, cuenta, concepto, moneda. Null texts say nothing; idx tells a page's tokens apart.
    """
    tokens = asked(tokens)
    payee = _behind(tokens, "payee", F.col("amount_like"))
    words = cut(_behind(tokens, "words", F.col("symbol"))).withColumn("a", amount_words_bilingual(F.col("text"))).where("a IS NOT NULL")
    spoken = cut(words.select("page", "at", "text", "a.value", "a.currency"))
    dated = cut(dated_rows(tokens))
    account = _behind(tokens, "account", F.lit(False), F.regexp_like("text", F.lit(values.ACCOUNT_FORM)), 0.3)
    concept = _behind(tokens, "concept", F.lit(False))
    money = amounts(tokens, spoken, dated)
    payee, account, concept, money = map(cut, (payee, account, concept, money))
    parts = [
        _listed(payee, "beneficiario", tidy(F.regexp_replace(F.regexp_replace("text", values.AMOUNT_AFTER_NAME, ""), r"\s*[0-9.,]{4,}\s*$", "")), "label"),
        _listed(spoken, "monto_letras", F.col("value"), "label"), _listed(money, "monto", F.col("value"), "token"), _listed(dated, "fecha", F.col("date"), "row"),
        _listed(account, "cuenta", F.replace(F.regexp_extract("text", values.ACCOUNT_FORM, 0), F.lit(" "), F.lit("")), "label"), _listed(concept, "concepto", F.col("text"), "label"),
        _listed(spoken, "moneda", F.when(F.col("currency").isin("dolares", "dolar", "dollars", "dollar", "usd"), "USD").when(F.col("currency").isin("peso", "pesos"), "PESOS").when(F.col("currency") == "euros", "EUR").when(F.col("currency") == "soles", "PEN"), "words"),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
