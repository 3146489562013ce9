"""Where the members of a JSON text stand, and how sure a reader was of them.

Spark's JSON functions give no positions, so a decoder runs over each text inside Arrow batches.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, functions as F

from .text import let

_SPAN = "array<struct<key:string,start:int,end:int>>"


def _decode(text: str, at: int):
    """The JSON value at a place and where it ends; control characters inside strings are allowed, as readers write them."""
    return json.JSONDecoder(strict=False).raw_decode(text, at)


def first_object(c: Column) -> Column:
    """The first JSON object in a text as JSON, or null if the first brace opens none."""
    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        def one(text):
            if not isinstance(text, str) or (at := text.find("{")) < 0:
                return None
            try:
                return json.dumps(_decode(text, at)[0], ensure_ascii=False)
            except ValueError:
                return None

        return texts.map(one)

    return run(c)


def unwrapped(c: Column) -> Column:
    """A list of one object counts as that object, anything else that is no object as the empty one."""
    v = F.try_parse_json(c)
    kind = lambda x: F.schema_of_variant(x)
    only = F.try_variant_get(v, "$[0]", "variant")
    single = kind(v).startswith("ARRAY") & F.try_variant_get(v, "$[1]", "variant").isNull() & kind(only).startswith("OBJECT")
    return F.coalesce(F.when(kind(v).startswith("OBJECT"), F.to_json(v)).when(single, F.to_json(only)), F.lit("{}"))


#: A JSON text in pieces that leave nothing out: strings, other quotes, blanks, signs of structure, all else.
_PIECES = r'"(?:[^"\\]|\\(?s:.))*"|"|\s+|[{}\[\]:,]|[^\s{}\[\]:,"]+'
_SCALAR = r"^(?:-?(?:0|[1-9][0-9]*)(?:[.][0-9]+)?(?:[eE][+-]?[0-9]+)?|true|false|null|NaN|-?Infinity)"


def member_spans(c: Column) -> Column:
    """(key, start, end) of the value of every top-level member of a text's first object, as far as it can be read; of equal
    keys the last. Quotes around a string belong to no span.

    One pass over the text's pieces with a counter of depth: members are looked for at depth 0 only, and a list or an
    object ends where the counter comes back to it.
    """
    span = lambda key, start, end: F.struct(key.alias("key"), start.cast("int").alias("start"), end.cast("int").alias("end"))

    def step(acc, piece):
        at, size, depth, due = acc["at"], F.length(piece), acc["depth"], acc["due"]
        text = F.length(piece) >= 2
        string = piece.startswith('"') & piece.endswith('"') & text
        opens, closes, blank = piece.isin("{", "["), piece.isin("}", "]"), F.regexp_like(piece, F.lit(r"^\s"))
        inner = F.regexp_replace(F.substr(acc["text"], acc["start"] + 1, at + 1 - acc["start"]), r"[\x00-\x1f]", " ")
        whole = (depth == 1) & closes & F.try_parse_json(F.when((depth == 1) & closes, inner)).isNotNull()
        scalar = F.regexp_extract(piece, _SCALAR, 0)
        name = F.substr(piece, F.lit(2), size - 2)
        name = F.when(F.contains(name, F.lit("\\")), F.get_json_object(F.concat(F.lit('{"k":'), piece, F.lit("}")), "$.k")).otherwise(name)
        top, value = depth == 0, (depth == 0) & (due == "value")
        found = F.when(value & string, span(acc["key"], at + 1, at + size - 1)).when(value & (scalar != ""), span(acc["key"], at, at + F.length(scalar))).when(whole, span(acc["key"], acc["start"], at + 1))
        after = (
            F.when(due.isin("end") | blank, due).when(~top, F.when(whole, "key").when((depth == 1) & closes, "end").otherwise("value"))
            .when(due == "key", F.when(string, "colon").when(piece == ",", "key").otherwise("end")).when(due == "colon", F.when(piece == ":", "value").otherwise("end"))
            .when(string | (scalar == piece), "key").when(opens, "value").otherwise("end")
        )
        takes = (due != "end") & found.isNotNull()
        return F.struct(
            acc["text"].alias("text"), (at + size).alias("at"),
            F.when(due == "end", depth).when(opens & (~top | value), depth + 1).when(closes & ~top, depth - 1).otherwise(depth).alias("depth"),
            F.when(top & (due == "key") & string, name).otherwise(acc["key"]).alias("key"), F.when(value & opens, at).otherwise(acc["start"]).alias("start"), after.alias("due"),
            F.when(takes, F.concat(F.filter(acc["out"], lambda o: o["key"] != acc["key"]), F.array(found))).otherwise(acc["out"]).alias("out"),
        )

    def read(text):
        first = F.instr(text, "{")
        zero = F.struct(text.alias("text"), first.alias("at"), F.lit(0).alias("depth"), F.lit("").alias("key"), F.lit(0).alias("start"), F.when(first > 0, "key").otherwise("end").alias("due"), F.expr(f"cast(array() AS {_SPAN})").alias("out"))
        return F.aggregate(F.regexp_extract_all(F.substr(text, first + 1), F.lit(_PIECES), F.lit(0)), zero, step, lambda a: a["out"])

    return let(F.coalesce(c, F.lit("")), read)


def token_texts(tokens: Column) -> Column:
    """(first, last, text) of the groups of byte tokens (an array of binaries) that make whole characters: a token that ends
    inside a character is joined with the next ones."""
    @F.pandas_udf("array<struct<first:int,last:int,text:string>>")
    def run(rows: pd.Series) -> pd.Series:
        def one(parts):
            out, held, first = [], b"", 0
            for i, part in enumerate([] if parts is None else parts):
                held += bytes(part)
                try:
                    text = held.decode()
                except UnicodeDecodeError as e:
                    if e.end == len(held) and e.reason == "unexpected end of data":
                        continue
                    text = held.decode("utf-8", "replace")
                out.append({"first": first, "last": i, "text": text})
                held, first = b"", i + 1
            if held:
                out.append({"first": first, "last": len(parts) - 1, "text": held.decode("utf-8", "replace")})
            return out

        return rows.map(one)

    return run(tokens)


def span_confidence(tokens: Column, probabilities: Column, start: Column, end: Column) -> Column:
    """Geometric mean of the probabilities of the tokens (an array of texts in order) that overlap a span of the joined
    text; null if there are none."""
    ends = F.transform(tokens, lambda _, i: F.aggregate(F.slice(tokens, 1, i + 1), F.lit(0), lambda n, x: n + F.length(x)))
    hit = F.filter(F.zip_with(F.zip_with(tokens, ends, lambda x, e: F.struct((e - F.length(x)).alias("a"), e.alias("b"))), probabilities, lambda s, p: F.struct(s["a"].alias("a"), s["b"].alias("b"), p.alias("p"))),
                   lambda s: (s["a"] < end) & (s["b"] > start) & (s["p"] > 0))
    return F.when(F.size(hit) > 0, F.exp(F.aggregate(hit, F.lit(0.0), lambda n, s: n + F.ln(s["p"])) / F.size(hit)))
