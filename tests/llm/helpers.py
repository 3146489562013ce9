"""Rows that every operator must stand: nulls, empty and long texts, ties, repeats, clashing extra columns."""

import random

WORDS = ["alpha", "beta", "Gamma", "delta", "the", "of", "été", "Über", "x1", "22", "...", "#", "don't", "中文", "ﬁn", "<|endoftext|>", "<s>", "▁a"]


def texts(seed=3, n=60):
    r = random.Random(seed)
    out = ["", " ", "\n", None, "one", "  two  blanks ", "a\n\n\nb\r\n\tc", "word " * 5000, "é" * 3000]
    for _ in range(n):
        out.append("".join(r.choice(WORDS) + r.choice([" ", " ", " ", "\n", "", "  "]) for _ in range(r.randint(0, 60))))
    return out + out[9:14]


def docs(spark, rows=None, extra=True):
    """Documents with a null id, a repeated row, and extra columns named like those that operators make."""
    if rows is None:
        t = texts()
        rows = list(enumerate(t)) + [(5, t[5]), (None, "no id at all")]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    data = [(i, t, "en", None, None if t is None else len(t)) for i, t in rows]
    if extra:
        schema += ", n_tokens string, start string, kept string, h string, score string"
        data = [(*d, "x", "y", None, "z", "w") for d in data]
    return spark.createDataFrame(data, schema)
