"""Candidate generation and scoring against readings."""

from __future__ import annotations

import difflib
import unicodedata

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from folioflow.functions import values


def digit_product(positions: Column, limit: int = 64) -> Column:
    """Strings that take one alternative from each position, the first ``limit`` in lexicographic order.

    ``positions``: array of arrays of one-character strings. Cutting after each position keeps the array bounded and
    the result unchanged, since a prefix that is too late stays too late.
    """
    def step(acc, alternatives):
        longer = F.flatten(F.transform(acc, lambda a: F.transform(F.array_sort(F.array_distinct(alternatives)), lambda b: F.concat(a, b))))
        return F.slice(longer, 1, limit)

    return F.aggregate(positions, F.array(F.lit("")), step)


def top_union(df: DataFrame, keys: list[str], value: str, first: str, n_first: int, second: str, n_second: int) -> DataFrame:
    """Candidates among the best by one score or the best by another, each once."""
    from pyspark.sql import Window

    rank = lambda c: F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(c).desc(), value))
    return df.withColumn("__a", rank(first)).withColumn("__b", rank(second)).where((F.col("__a") <= n_first) | (F.col("__b") <= n_second)).drop("__a", "__b").distinct()


def ratio(a: Column, b: Column) -> Column:
    """Ratcliff-Obershelp similarity of two texts, 0 to 1."""

    @F.pandas_udf("double")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([None if p is None or q is None else difflib.SequenceMatcher(None, p, q).ratio() for p, q in zip(x, y, strict=True)], dtype="float64")

    return run(a, b)


def closest(c: Column, vocabulary: list[str], cutoff: float) -> Column:
    """The vocabulary's most similar entry at or above the cutoff, else null; answers are kept for each batch's distinct texts."""
    words = sorted(vocabulary)

    @F.pandas_udf("string")
    def run(x: pd.Series) -> pd.Series:
        known = {t: (difflib.get_close_matches(t, words, 1, cutoff) or [None])[0] for t in x.dropna().unique()}
        return x.map(known).astype("object").where(x.notna(), None)

    return run(c)


def _same_letter(letter: str, seen: str) -> bool:
    """A letter may be seen in either case, and a bare one with any accent."""
    return letter.lower() in (seen.lower(), unicodedata.normalize("NFD", seen.lower())[:1])


def ctc_scores(df: DataFrame, matrix: str, steps: str, candidate: str, alphabet: str, name: str = "score", penalty: float = 2.5, as_blank: str = " ") -> DataFrame:
    """How well a reader's probability matrix (steps x classes, flat; class 0 is blank) spells a candidate: the best
    alignment's log-probability less that of the likeliest classes, so 0 is the most there is.

    Frames outside the candidate count as their likeliest class, less ``penalty`` where that is no blank. A letter may be
    seen in either case and with any accent; blanks in the candidate are passed over, and the characters ``as_blank``
    are blank. ``alphabet``: characters of classes 1 and up. Null for a candidate without
    characters or with one that no class spells.
    """
    blanks = [0] + sorted({alphabet.index(ch) + 1 for ch in as_blank if ch in alphabet})
    log = lambda x: np.log(x + 1e-12)
    classes: dict[str, np.ndarray] = {}

    def seen(letter):
        if letter not in classes:
            classes[letter] = np.array([0.0] + [float(_same_letter(letter, a)) for a in alphabet])
        return classes[letter]

    def alike(p: np.ndarray, texts: list[str]) -> np.ndarray:
        """Scores of candidates of one length against matrices of one shape: (candidates, steps, classes)."""
        best = log(p.max(2))
        outside = np.where(np.isin(p.argmax(2), blanks), 0.0, -penalty) + best
        before = np.concatenate((np.zeros((len(p), 1)), np.cumsum(outside, 1)), 1)
        # One column for each state: blank, first letter, blank, second letter, ..., blank.
        emit = np.empty((*p.shape[:2], 2 * len(texts[0]) + 1))
        emit[:, :, ::2] = log(p[:, :, blanks].sum(2))[:, :, None]
        spelt = np.array([[seen(ch)[: p.shape[2]] for ch in x] for x in texts])
        emit[:, :, 1::2] = log(np.einsum("btc,blc->btl", p[:, :, : spelt.shape[2]], spelt))
        jump = np.zeros((len(p), emit.shape[2]), bool)
        jump[:, 3::2] = [[a != b for a, b in zip(x[1:], x, strict=False)] for x in texts]
        state, top = np.full(jump.shape, -np.inf), np.full(len(p), -np.inf)
        for k in range(p.shape[1]):
            into = state.copy()
            into[:, 1:] = np.maximum(into[:, 1:], state[:, :-1])
            into[:, 2:] = np.where(jump[:, 2:], np.maximum(into[:, 2:], state[:, :-2]), into[:, 2:])
            into[:, :2] = np.maximum(into[:, :2], before[:, k, None])
            state = into + emit[:, k]
            top = np.maximum(top, state[:, -2:].max(1) + before[:, -1] - before[:, k + 1])
        return np.where(spelt.any(2).all(1), top - best.sum(1), np.nan)

    @F.pandas_udf("double")
    def run(m: pd.Series, t: pd.Series, c: pd.Series) -> pd.Series:
        out, shapes = np.full(len(m), np.nan), {}
        texts = [(x or "").replace(" ", "") for x in c]
        for i, (flat, n) in enumerate(zip(m, t, strict=True)):
            if flat is not None and n and n > 0 and texts[i]:
                shapes.setdefault((int(n), len(flat), len(texts[i])), []).append(i)
        for (n, _, _), rows in shapes.items():
            for at in range(0, len(rows), 1024):
                some = rows[at : at + 1024]
                out[some] = alike(np.stack([np.asarray(m[i], float) for i in some]).reshape(len(some), n, -1), [texts[i] for i in some])
        return pd.Series(out)

    return df.withColumn(name, run(F.col(matrix), F.col(steps), F.col(candidate)))


def closest_of(c: Column, vocabulary: list[str], n: int, cutoff: float) -> Column:
    """Up to ``n`` of the vocabulary's entries, the most similar first; explode it to join a text with all of them."""
    words = sorted(vocabulary)

    @F.pandas_udf("array<string>")
    def run(x: pd.Series) -> pd.Series:
        known = {t: difflib.get_close_matches(t, words, n, cutoff) for t in x.dropna().unique()}
        return x.map(lambda t: known[t] if isinstance(t, str) else None)

    return run(c)


def label_of(c: Column, labels: dict[str, list[str]], cutoff: float = 0.72) -> Column:
    """The label one of whose forms a plain text begins with: the most alike, at or above the cutoff; forms of up to four
    letters must stand there exactly."""
    @F.pandas_udf("string")
    def run(x: pd.Series) -> pd.Series:
        def best(t):
            found = [(1.0 if t.startswith(f) else 0.0 if len(f) <= 4 else difflib.SequenceMatcher(None, t[: len(f)], f).ratio(), name) for name, forms in labels.items() for f in forms]
            score, name = max(found, key=lambda r: r[0], default=(0.0, None))
            return name if score >= cutoff else None

        known = {t: best(t) for t in x.dropna().unique()}
        return x.map(known).astype("object").where(x.notna(), None)

    return run(c)


def united(sources: dict[str, DataFrame], keys: list[str], value: str) -> DataFrame:
    """Candidates of all sources, each once for its keys, with a column for each source that says whether it has it, and
    ``same``, whether all have. Copies are aggregated before they move."""
    rows = None
    for name, df in sources.items():
        part = df.select(*keys, value, F.lit(name).alias("__of"))
        rows = part if rows is None else rows.unionByName(part)
    held = [F.bool_or(F.col("__of") == name).alias(name) for name in sources]
    out = rows.groupBy(*keys, value).agg(*held)
    return out.withColumn("same", F.least(*[F.col(name) for name in sources]) if len(sources) > 1 else F.lit(True))


#: Names that may be broadcast, by number and letters.
MOST_NAMES, MOST_LETTERS = 100_000, 16 << 20


def named_in(df: DataFrame, text: str, names: DataFrame, name: str, cutoff: float = 0.8) -> DataFrame:
    """Pairs of a text and a name that it holds or is like (edits touch at most ``1 - cutoff`` of the longer one's letters).

    Candidates come from equi-joins, never from all pairs: a text that holds a name holds the name's first gram of
    three letters, and a text like a name shares one of the pieces into which the name is cut, one more than the edits
    allowed. Names shorter than a gram join by their first letter. The names are broadcast if they are few and short, by
    count, else shuffled. Null or empty names match nothing; a name listed twice is one.
    """
    names = names.select(F.col(name)).where(F.length(name) > 0).distinct()
    n, letters = names.agg(F.count("*"), F.coalesce(F.sum(F.length(name)), F.lit(0))).first()
    gram = lambda c, size: F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - size + 1, F.lit(1))), lambda i: F.substr(c, i, F.lit(size)))
    # Pieces of a name: so many that the edits which leave it alike cannot touch all.
    edits = F.floor((1 - cutoff) / cutoff * F.length(name) + 1e-9).cast("int")
    size = F.greatest(F.floor(F.length(name) / (edits + 1)), F.lit(1)).cast("int")
    pieces = F.array_distinct(F.transform(F.sequence(F.lit(0), edits), lambda i: F.substr(F.col(name), i * size + 1, size)))
    keyed = names.select(name, F.explode(pieces).alias("__gram")).withColumn("__size", F.length("__gram"))
    sizes = sorted(r[0] for r in keyed.select("__size").distinct().limit(1000).collect())
    keyed = F.broadcast(keyed) if n <= MOST_NAMES and letters <= MOST_LETTERS else keyed
    texts = df.withColumn("__row", F.monotonically_increasing_id()).where(F.col(text).isNotNull())
    grams = F.array_distinct(F.flatten(F.array(*[gram(F.col(text), s) for s in sizes]))) if sizes else F.array().cast("array<string>")
    found = texts.select("__row", text, F.explode(grams).alias("__gram")).join(keyed, "__gram").select("__row", text, name).distinct()
    like = 1 - F.levenshtein(text, name) / F.greatest(F.length(text), F.length(name)) >= cutoff
    pairs = found.where(F.contains(text, F.col(name)) | like).select("__row", name)
    return texts.join(pairs, "__row").drop("__row")


def aligned(base: Column, other: Column, least: float = 0.45) -> Column:
    """For each word of an array the most similar word of another array, the first of equals; null below ``least``."""
    @F.pandas_udf("array<string>")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        def pick(w, others):
            alike = [(difflib.SequenceMatcher(None, w, o).ratio(), -i) for i, o in enumerate(others)]
            score, at = max(alike, default=(0.0, 0))
            return others[-at] if alike and score >= least else None

        return pd.Series([None if x is None or y is None else [pick(w, list(y)) for w in x] for x, y in zip(a, b, strict=True)])

    return run(base, other)


def best_agreement(value: Column, others: Column) -> Column:
    """Highest similarity of a text with those of an array; 0 if there are none."""
    @F.pandas_udf("double")
    def run(v: pd.Series, o: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else max((difflib.SequenceMatcher(None, x, y).ratio() for y in ([] if ys is None else ys)), default=0.0) for x, ys in zip(v, o, strict=True)], dtype="float64")

    return run(value, others)


#: States that one step of an alignment of many candidates updates together: what fits a core's cache.
MOST_STATES = 1 << 16


def _aligned(images: list[np.ndarray], of: np.ndarray, texts: list[str], alphabet: str, blanks: list[int], penalty: float) -> np.ndarray:
    """Scores of texts, each on the image that ``of`` (ascending) names; the images have one shape (steps, classes)."""
    p = np.stack(images)
    best = np.log(p.max(2) + 1e-12)
    outside = np.where(np.isin(p.argmax(2), blanks), 0.0, -penalty) + best
    before = np.concatenate((np.zeros((len(p), 1)), np.cumsum(outside, 1)), 1)
    n = np.array([len(x) for x in texts])
    codes = np.array(texts).view(np.uint32).reshape(len(texts), -1)
    letters = np.unique(codes[codes > 0])
    classes = np.array([[float(_same_letter(chr(c), a)) for a in alphabet[: p.shape[2] - 1]] for c in letters]).reshape(len(letters), -1)
    # One column for each letter, and one for the room behind a shorter text, which nothing reaches.
    seen = np.concatenate((np.log(p[:, :, 1:] @ classes.T + 1e-12), np.full((*p.shape[:2], 1), -np.inf)), 2)
    at = np.where(codes > 0, np.searchsorted(letters, codes), len(letters))
    jump = np.where(at[:, 1:] != at[:, :-1], 0.0, -np.inf).T
    blank = np.log(p[:, :, blanks].sum(2) + 1e-12)
    # Blanks and letters apart, a row for each place and a column for each text, so that a step runs over whole rows.
    cell, last = (of[:, None] * seen.shape[2] + at).T.copy(), n * len(texts) + np.arange(len(texts))
    gap, letter, top = np.full((at.shape[1] + 1, len(texts)), -np.inf), np.full(at.shape[::-1], -np.inf), np.full(len(texts), -np.inf)
    for k in range(p.shape[1]):
        into = np.maximum(letter, gap[:-1])
        np.maximum(into[1:], letter[:-1] + jump, out=into[1:])
        start = before[of, k]
        np.maximum(into[0], start, out=into[0])
        np.maximum(gap[1:], letter, out=gap[1:])
        np.maximum(gap[0], start, out=gap[0])
        gap += blank[of, k]
        letter = into + np.ascontiguousarray(seen[:, k]).ravel().take(cell)
        top = np.maximum(top, np.maximum(gap.ravel().take(last), letter.ravel().take(last - len(texts))) + before[of, -1] - before[of, k + 1])
    spelt = np.append(classes.any(1), True)[at].all(1)
    return np.where(spelt, top - best.sum(1)[of], np.nan)


def ctc_best(matrices: Column, steps: Column, forms: Column, alphabet: str, penalty: float = 2.5, as_blank: str = " ", weights: Column | None = None) -> Column:
    """For each candidate, an array of the ways it may be written, the best score that one of them has against a matrix,
    added up over the row's matrices (an array of flat ones, of their steps and, if given, of their weights): an array of
    scores as ``ctc_scores`` gives them, null for a candidate that no class spells; 0 without a matrix. Candidates of many
    rows, with forms of any length, are aligned together, so a row costs no loop of its own over the steps."""
    blanks = [0] + sorted({alphabet.index(ch) + 1 for ch in as_blank if ch in alphabet})

    @F.pandas_udf("array<double>")
    def run(m: pd.Series, t: pd.Series, w: pd.Series, f: pd.Series) -> pd.Series:
        out: list = []
        shapes: dict = {}
        for i, (flats, ns, ws, candidates) in enumerate(zip(m, t, w, f, strict=True)):
            if candidates is None:
                out.append(None)
                continue
            every, ends = [], [0]
            for c in candidates:
                every += [x.replace(" ", "") for x in c if x and x.strip()]
                ends.append(len(every))
            out.append(np.zeros(len(candidates)))
            edge, longest = np.array(ends), max(map(len, every), default=0)
            for k, (flat, n) in enumerate(zip(flats if flats is not None and every else [], ns if ns is not None else [], strict=False)):
                image = np.asarray(flat, float).reshape(int(n), -1)
                shapes.setdefault(image.shape, []).append((longest, i, image, every, edge, 1.0 if ws is None else float(ws[k])))
        for same in shapes.values():
            # Texts of like lengths together, as room behind shorter ones is work for nothing.
            same.sort(key=lambda s: s[0])
            at = 0
            while at < len(same):
                end, states = at, 0
                while end < len(same):
                    states += len(same[end][3])
                    if end > at and states * (2 * same[end][0] + 1) > MOST_STATES:
                        break
                    end += 1
                some = same[at:end]
                score = _aligned([s[2] for s in some], np.repeat(np.arange(len(some)), [len(s[3]) for s in some]), [x for s in some for x in s[3]], alphabet, blanks, penalty)
                first = 0
                for _, i, _, every, edge, weight in some:
                    best, written = np.full(len(edge) - 1, np.nan), edge[1:] > edge[:-1]
                    best[written] = np.fmax.reduceat(score[first : first + len(every)], edge[:-1][written])
                    out[i] += weight * best
                    first += len(every)
                at = end
        return pd.Series([x if x is None else [None if y != y else y for y in x.tolist()] if np.isnan(x).any() else x.tolist() for x in out], dtype=object)

    return run(matrices, steps, F.lit(None).cast("array<double>") if weights is None else weights, forms)


#: Templates that the driver may hold.
MOST_TEMPLATES = 4096


def by_template(df: DataFrame, vector: str, templates: DataFrame, least: float = values.TEMPLATE_LEAST, margin: float = values.TEMPLATE_MARGIN) -> DataFrame:
    """Adds class, similarity and lead: the class of the likest of the templates (columns class, vector) by normalised
    correlation, "?" where that is below ``least`` or leads the next class by less than ``margin``.

    A batch is one matrix product with all templates, of which there may be at most MOST_TEMPLATES, of one length. A null
    vector, one of another length or one with missing components gets nulls; a flat one correlates 0. Of equally like
    classes the smaller name counts; with one class, or another that is unlike, the next counts 0.
    """
    rows = templates.where(F.col("vector").isNotNull()).select(F.col("class").cast("string").alias("class"), "vector").limit(MOST_TEMPLATES + 1).collect()
    if len(rows) > MOST_TEMPLATES:
        raise ValueError(f"more than {MOST_TEMPLATES} templates")
    names = sorted({r[0] for r in rows})
    bank = _standard(np.array([list(r[1]) for r in rows], float)) if rows else np.zeros((0, 0))
    of = np.array([names.index(r[0]) for r in rows], int)

    @F.pandas_udf("struct<class: string, similarity: double, lead: double>")
    def run(v: pd.Series) -> pd.DataFrame:
        out = pd.DataFrame({"class": pd.Series([None] * len(v), dtype=object), "similarity": np.nan, "lead": np.nan})
        fine = [i for i, x in enumerate(v) if x is not None and len(x) == bank.shape[1] and np.isfinite(np.asarray(x, float)).all()]
        if fine and names:
            like = _standard(np.stack([np.asarray(v.iloc[i], float) for i in fine])) @ bank.T
            best = np.full((len(fine), len(names) + 1), -1.0)
            best[:, -1] = 0.0
            for k in range(len(names)):
                best[:, k] = like[:, of == k].max(1)
            top = best[:, :-1].argmax(1)
            first = best[np.arange(len(fine)), top]
            if len(names) > 1:
                best[:, -1] = -1.0
            best[np.arange(len(fine)), top] = -np.inf
            lead = first - np.maximum(best.max(1), -1.0)
            sure = (first >= least) & (lead >= margin)
            out.loc[fine, "class"] = np.where(sure, np.array(names, object)[top], "?")
            out.loc[fine, "similarity"], out.loc[fine, "lead"] = first, lead
        return out

    return df.withColumn("__t", run(F.col(vector))).select(*df.columns, "__t.class", "__t.similarity", "__t.lead")


def _standard(x: np.ndarray) -> np.ndarray:
    """Rows without their mean and of length 1; flat rows are 0."""
    x = x - x.mean(1, keepdims=True)
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return np.where(n > 0, x / np.where(n > 0, n, 1), 0.0)


def lines_to_zones(df: DataFrame, zones: Column, lines: Column) -> Column:
    """The line of a transcript for each zone: array of (zone, line) in the order of the zones, those without a line left out.

    lines: array of (text, dated, words), whether a line holds a date and how many number words. As many lines as zones
    go in order, but the zone of the date changes with the first that has one if its own has none. Otherwise the zone of
    the date takes the first dated line and those of the amount the lines with most number words (the first of equals),
    and the others what is left, in order.
    """
    spoken = lambda z: z.startswith("monto_letras")

    def in_order(zs, ls):
        at = F.array_position(zs, "ciudad_fecha")
        other = F.array_position(F.transform(ls, lambda x: x["dated"]), True)
        swaps = (at > 0) & ~F.coalesce(F.get(ls, (at - 1).cast("int"))["dated"], F.lit(True)) & (other > 0)
        pick = lambda i: F.when(swaps & (i + 1 == at), other - 1).when(swaps & (i + 1 == other), at - 1).otherwise(i).cast("int")
        return F.transform(zs, lambda z, i: F.struct(z.alias("zone"), F.get(ls, pick(i))["text"].alias("line")))

    def by_content(zs, ls):
        numbered = F.transform(ls, lambda x, i: F.struct(i.cast("int").alias("i"), x["text"].alias("text"), x["dated"].alias("dated"), x["words"].alias("words")))

        def step(acc, z):
            free = F.filter(acc["free"], lambda x: F.when(z == "ciudad_fecha", x["dated"]).when(spoken(z), x["words"] > 0).otherwise(False))
            best = F.array_max(F.transform(free, lambda x: F.struct(F.when(spoken(z), x["words"]).otherwise(0).alias("w"), (-x["i"]).alias("i"), x["text"].alias("text"))))
            return F.struct(
                F.filter(acc["free"], lambda x: best.isNull() | (x["i"] != -best["i"])).alias("free"),
                F.when(best.isNotNull(), F.concat(acc["out"], F.array(F.struct(z.alias("zone"), best["text"].alias("line"))))).otherwise(acc["out"]).alias("out"),
            )

        zero = F.struct(numbered.alias("free"), F.expr("cast(array() AS array<struct<zone: string, line: string>>)").alias("out"))

        def rest(acc):
            left = F.filter(zs, lambda z: ~F.exists(acc["out"], lambda o: o["zone"] == z))
            more = F.filter(F.transform(left, lambda z, i: F.struct(z.alias("zone"), F.get(acc["free"], i)["text"].alias("line"))), lambda o: o["line"].isNotNull())
            both = F.concat(acc["out"], more)
            return F.filter(F.transform(zs, lambda z: F.get(F.filter(both, lambda o: o["zone"] == z), F.lit(0))), lambda o: o.isNotNull())

        return F.aggregate(zs, zero, step, rest)

    return F.when(F.size(zones) == F.size(lines), in_order(zones, lines)).otherwise(by_content(zones, lines))
