"""Text normalisation as Spark expressions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, functions as F

from . import values


def _accents() -> tuple[str, str]:
    """Latin letters that carry accents, and their bare forms, by Unicode's own decomposition."""
    pairs = [(chr(c), d[0]) for lo, hi in ((0xC0, 0x250), (0x1E00, 0x1F00)) for c in range(lo, hi) if len(d := unicodedata.normalize("NFD", chr(c))) > 1 and all(unicodedata.category(x) == "Mn" for x in d[1:])]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


ACCENTED, BARE = _accents()


def fold(c: Column) -> Column:
    """Lower case without accents, as many characters as before, so offsets stay valid."""
    return F.lower(F.translate(c, ACCENTED, BARE))


def plain(c: Column) -> Column:
    """Lower case, no accents or combining marks, single blanks, trimmed."""
    return F.trim(F.regexp_replace(F.regexp_replace(fold(c), r"\p{Mn}", ""), r"(?U)\s+", " "))


#: ASCII words without capitals between single blanks: such a text is plain as it stands.
_PLAIN = r"\A[!-@\[-~]+(?: [!-@\[-~]+)*\z"


def quick_plain(c: Column) -> Column:
    """``plain`` of a column or variable (it is named twice), which passes over texts that are plain already."""
    return F.when(F.regexp_like(c, F.lit(_PLAIN)), c).otherwise(plain(c))


def compact(c: Column) -> Column:
    """Only letters a-z, digits and the dollar sign."""
    return F.regexp_replace(fold(c), r"[^a-z0-9$]", "")


def let(c: Column, f) -> Column:
    """``f`` of a value that is computed once, however often ``f`` uses it."""
    return F.get(F.transform(F.array(c), f), F.lit(0))


def listed(texts: list[str]) -> Column:
    """A literal array of texts, in one expression, since a call for each entry is what building a plan costs."""
    return F.expr("array(" + ", ".join("'" + x.replace("'", r"\'") + "'" for x in texts) + ")")


def replace_each(c: Column, pattern: str, f) -> Column:
    """The text with every match of the pattern replaced by ``f`` of it. ``f`` also sees every single character that
    belongs to no match, so it must leave such a character as it is."""
    return F.array_join(F.transform(F.regexp_extract_all(c, F.lit(f"(?s){pattern}|."), F.lit(0)), f), "")


#: An ASCII letter or digit that opens no answer which says "absent"; normalisation leaves it where it stands.
_NOT_NEGATIVE = "\\A[" + "".join(x + x.upper() * x.isalpha() for x in "0123456789abcdefghijklmnopqrstuvwxyz" if x not in {n[0] for n in values.NEGATIVES}) + "]"


def is_negative(c: Column) -> Column:
    """The text says "absent": a listed answer, or one that opens with "no "."""
    said = lambda p: p.isin(values.NEGATIVES) | p.startswith("no ")
    return let(c, lambda t: F.when(F.regexp_like(t, F.lit(_NOT_NEGATIVE)), False).otherwise(let(quick_plain(t), said)))


def is_flag(c: Column) -> Column:
    """The text only says yes or no."""
    return plain(c).isin(values.YES_WORDS) | is_negative(c)


def tidy(c: Column) -> Column:
    """Without runs of filler signs, runs of x that no letter touches, and signs that hang at either end; blanks become single."""
    ends = F.regexp_replace(F.regexp_replace(c, values.FILLER_RUNS, " "), values.FILLER_ENDS, "")
    return F.trim(F.regexp_replace(ends, r"\s{2,}", " "))


def unfilled(c: Column) -> Column:
    """Without filler signs anywhere, blanks single, punctuation at the ends gone."""
    return F.btrim(F.regexp_replace(F.regexp_replace(c, r"[*_=#~|]+", " "), r"\s+", " "), F.lit(" .,:;-"))


def digit_ratio(c: Column) -> Column:
    """Share of digits among all characters but blanks; 0 of an empty text."""
    tight = F.replace(c, F.lit(" "), F.lit(""))
    return F.length(F.regexp_replace(tight, r"\P{Nd}", "")) / F.greatest(F.length(tight), F.lit(1))


def digits(c: Column, confusions: dict[str, str] | None = None) -> Column:
    """Only digits, after letters that scanners mistake for digits are read as such."""
    if confusions:
        c = F.translate(c, "".join(confusions), "".join(confusions.values()))
    return F.regexp_replace(c, r"[^0-9]", "")


def looks_hallucinated(c: Column) -> Column:
    """Letters beyond the Latin blocks, or at least four words of which half or fewer are distinct."""
    w = F.filter(F.split(F.lower(c), r"\s+"), lambda x: x != "")
    return F.regexp_like(c, F.lit(r"[\p{L}&&[^\x{0000}-\x{024F}]]")) | ((F.size(w) >= 4) & (2 * F.size(F.array_distinct(w)) <= F.size(w)))


def glued_title(c: Column) -> Column:
    """A blank where a small letter meets a capital."""
    return F.regexp_replace(c, r"(?<=[a-zà-ÿ])(?=[A-ZÀ-Þ])", " ")


def confidence_band(c: Column, high: float, mid: float) -> Column:
    return F.when(c >= high, "high").when(c >= mid, "mid").otherwise("low")


def anchor_pattern(anchor: str) -> str:
    """Regular expression for a printed label in a folded text: signs that scanners read for a letter stand for it, blanks and
    full stops may be lost; labels of up to five letters only as whole words. Fillers after the label belong to it."""
    body = anchor.lower().translate(str.maketrans(values.SEEN_AS))
    return (rf"(?<![a-z]){body}(?![a-z])" if len(anchor) <= 5 else body) + values.AFTER_LABEL


def after_anchor(c: Column, anchors: list[str]) -> Column:
    """What follows the first anchor in the list that the text holds; null without one. Folding keeps every character's place,
    so the label is looked for in the folded text and what follows is cut from the text itself."""

    def rest(folded):
        def behind(pattern):
            at = F.regexp_instr(folded, F.lit(pattern))
            return F.when(at > 0, F.substr(c, at + F.length(F.regexp_extract(folded, pattern, 0))))

        return F.coalesce(*[behind(anchor_pattern(a)) for a in anchors])

    return let(fold(c), rest)


def stripped_payee(c: Column) -> Column:
    """A payee's text without the printed label before it and the amount that strayed in behind it."""
    t = F.regexp_replace(F.trim(c), values.DEEP_PAYEE, "")
    return F.btrim(F.regexp_replace(t, values.DEEP_AMOUNT, ""), F.lit(" .,-_"))


def stripped_city(c: Column) -> Column:
    """What stands before the first digit, without the printed label and all but letters."""
    t = F.get(F.split(F.coalesce(c, F.lit("")), "[0-9]"), F.lit(0))
    t = F.regexp_replace(t, values.CITY_LABEL, "")
    return F.btrim(F.regexp_replace(t, "[^A-Za-zÁÉÍÓÚÑÜáéíóúñü .]", ""), F.lit(" .,"))


def name_case(c: Column) -> Column:
    """Capitals at the start of words, particles small unless they come first."""
    w = F.split(F.lower(F.trim(c)), r"\s+")
    return F.array_join(F.transform(w, lambda x, i: F.when((i > 0) & x.isin(values.PARTICLES), x).otherwise(F.concat(F.upper(F.left(x, F.lit(1))), F.substr(x, F.lit(2))))), " ")
