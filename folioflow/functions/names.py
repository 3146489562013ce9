"""Names as readers saw them."""

from __future__ import annotations

import difflib
import unicodedata

import pandas as pd
from pyspark.sql import Column, functions as F

from . import values
from .text import plain


def once_in_a_row(words: Column) -> Column:
    """Plain words without those that repeat the one before them."""
    return F.filter(words, lambda w, i: (i == 0) | (w != F.get(words, i - 1)))


def _alike(a: str, b: str) -> float:
    return difflib.SequenceMatcher(None, a, b).ratio()


def _bare(word: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", word.lower()) if not unicodedata.combining(c))


def name_words(texts: Column, known: dict[str, str] | list[str], cut_from: int = 10, near: float = 0.7) -> Column:
    """The words of every text of an array that may belong to a name, accents and case as read: nothing of the printed label
    or of what a reader made of it, no amount behind the name, no single letters but particles. A word of ``cut_from``
    letters or more that is no known name is cut in two where both parts are likest to known ones, ``near`` at least."""
    spelled = F.transform(texts, lambda t: F.regexp_replace(F.regexp_replace(F.regexp_replace(F.coalesce(t, F.lit("")), values.PAYEE_LABEL, ""), values.PAYEE_AMOUNT, ""), "[^A-Za-zÁÉÍÓÚÑÜáéíóúñü ]", " "))
    words = F.transform(spelled, lambda t: F.filter(F.split(t, " +"), lambda w: (F.length(w) >= 2) | plain(w).isin(values.PARTICLES)))
    vocabulary = sorted(known)

    @F.pandas_udf("array<array<string>>")
    def run(rows: pd.Series) -> pd.Series:
        label: dict[str, float] = {}
        parts: dict[str, list[str]] = {}

        def of_label(word):
            """How much a word looks like one of the label; 1 for its short words."""
            if word not in label:
                label[word] = 1.0 if word in values.LABEL_RESTS else max(_alike(word, x) for x in values.LABEL_WORDS)
            return label[word]

        def halves(word):
            if word not in parts:
                low, best = _bare(word), (0.0, 0)
                if len(low) >= cut_from and low not in known:
                    for at in range(3, len(low) - 2):
                        sides = [difflib.get_close_matches(x, vocabulary, 1, near) for x in (low[:at], low[at:])]
                        if all(sides):
                            best = max(best, (_alike(low[:at], sides[0][0]) + _alike(low[at:], sides[1][0]), -at))
                at = -best[1]
                parts[word] = [word[:at], word[at:]] if at else [word]
            return parts[word]

        def name(some):
            some = [w for w in some if w]
            if len(some) > 2 and _bare(some[1]) == "de" and _alike(_bare(some[0]), values.LABEL_WORDS[0]) >= 0.4:
                some = some[2:]
            start = next((i for i, w in enumerate(some) if of_label(_bare(w)) < 0.6), len(some))
            return [x for w in some[start:] for x in halves(w)]

        return rows.map(lambda r: None if r is None else [name(list(x)) for x in r])

    return run(words)
