"""Field deciders: one value out of several pieces of evidence, with a confidence and a reason to review."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from folioflow.functions import numbers, values
from folioflow.functions.dates import digits_repaired, earliest_date, plausible, slash_readings
from folioflow.functions.names import name_words, once_in_a_row
from folioflow.functions.text import let, plain, stripped_city, stripped_payee
from folioflow.functions.words import number_word_count
from folioflow.operators.candidates import aligned, best_agreement, closest_of, ctc_best, digit_product
from folioflow.session import matched, spread


def decision(value: Column, confidence: Column, review: Column | None = None) -> list[Column]:
    """value, confidence rounded to three places, and review: given, or where the value is missing or doubtful."""
    doubtful = value.isNull() | (value.cast("string") == "") | (F.round(confidence, 3) < values.REVIEW_BELOW)
    return [value.alias("value"), F.round(confidence, 3).alias("confidence"), (doubtful if review is None else review).alias("review")]


def line_groups(groups: Column, leading: int | None = None) -> Column:
    """Roles of the digit groups of a magnetic line: the first with a valid checksum is the routing number, the longest
    of the rest the account if it has six digits or more, and rests of 3 to 10 digits may be the serial number.

    ``leading``: only so many groups from the left may be the routing number, where the layout of the line says where it
    stands; an account of nine digits has a valid checksum by chance once in ten.
    """
    may = groups if leading is None else F.slice(groups, 1, leading)
    # Each step is computed once; written out, the checksums would be repeated for every use of what follows from them.
    routed = let(F.array_position(F.transform(may, lambda g: F.coalesce(numbers.routing_ok(g), F.lit(False))), True), lambda at: F.struct(
        F.when(at > 0, F.get(groups, (at - 1).cast("int"))).alias("routing"),
        F.when(at > 0, F.filter(groups, lambda g, i: i != at - 1)).otherwise(groups).alias("rest"),
    ))

    def longest(r):
        sizes = F.transform(r["rest"], lambda g: F.length(g))
        return F.struct(r["routing"].alias("routing"), r["rest"].alias("rest"), (F.array_position(sizes, F.array_max(sizes)) - 1).cast("int").alias("pos"), (F.array_max(sizes) >= 6).alias("long"))

    def roles(r):
        left = F.when(r["long"], F.filter(r["rest"], lambda g, i: i != r["pos"])).otherwise(r["rest"])
        return F.struct(r["routing"].alias("routing"), F.when(r["long"], F.get(r["rest"], r["pos"])).alias("account"), F.filter(left, lambda g: F.length(g).between(3, 10)).alias("serials"))

    return let(let(routed, longest), roles)


def _bare(c: Column) -> Column:
    return F.regexp_replace(c, "^0+", "")


def merge_line(df: DataFrame) -> DataFrame:
    """Printed number and account against the line's groups (columns number, number_conf, account, account_conf, groups).

    A printed value found in the line gains confidence; a missing one is taken from the line at a lower one.
    """
    roles = line_groups(F.col("groups"))
    bare = F.transform("groups", _bare)
    digits = _bare(F.regexp_replace("account", "[^0-9]", ""))
    in_line = F.coalesce(F.array_contains(bare, _bare(F.col("number"))), F.lit(False))
    fits = F.coalesce((digits != "") & F.exists(bare, lambda g: (F.length(g) >= 6) & (F.contains(g, digits) | F.contains(digits, g))), F.lit(False))
    serial = F.get(roles["serials"], F.lit(0))
    return df.withColumns({
        "number": F.coalesce("number", serial),
        "number_conf": F.when(F.col("number").isNull() & serial.isNotNull(), 0.6).when(in_line, F.greatest("number_conf", F.lit(0.98))).otherwise(F.col("number_conf")),
        "account": F.coalesce("account", roles["account"]),
        "account_conf": F.when(F.col("account").isNull() & roles["account"].isNotNull(), 0.75).when(fits, F.greatest("account_conf", F.lit(0.98))).otherwise(F.col("account_conf")),
        "routing": roles["routing"],
    })


def refine(fields: DataFrame, second: DataFrame, keys: list[str], low: float = 0.80) -> DataFrame:
    """A second reader's values (keys, value) over fields (keys, value, confidence): agreement lifts the confidence to
    0.95; a missing or doubtful value is replaced at 0.85; others stay."""
    new = second.where("value IS NOT NULL AND value <> ''").select(*keys, F.col("value").alias("__new"))
    out = fields.join(new, keys, "full_outer")
    has = F.col("value").isNotNull()
    agrees = has & (plain(F.col("value")) == plain(F.col("__new")))
    takes = F.col("__new").isNotNull() & ~agrees & (~has | (F.col("confidence") < low))
    return out.select(
        *keys,
        F.when(F.coalesce(takes, F.lit(True)) & F.col("__new").isNotNull(), F.col("__new")).otherwise(F.col("value")).alias("value"),
        F.when(F.coalesce(agrees, F.lit(False)), F.greatest("confidence", F.lit(0.95))).when(F.coalesce(takes, F.lit(True)) & F.col("__new").isNotNull(), 0.85).otherwise(F.coalesce("confidence", F.lit(0.0))).alias("confidence"),
    )


def settle_amount(df: DataFrame) -> DataFrame:
    """Figures against words (columns figures, figures_conf, words, words_ratio, words_conf, others: further amounts read).

    Missing figures come from the words; figures that differ give way to another reading equal to the words.
    ``amount_match`` is null where one side is missing.
    """
    other = F.array_contains("others", F.col("words"))
    same = F.col("figures") == F.col("words")
    both = F.col("figures").isNotNull() & F.col("words").isNotNull()
    match = F.when(both, F.coalesce(same | F.coalesce(other, F.lit(False)), F.lit(False)))
    taken = F.col("figures").isNull() & F.col("words").isNotNull()
    return df.select(
        *[c for c in df.columns if c not in ("figures", "figures_conf", "words_conf")],
        F.when(taken | F.coalesce(match, F.lit(False)), F.col("words")).otherwise(F.col("figures")).alias("figures"),
        F.when(taken, F.round(0.75 * F.col("words_ratio"), 3)).when(match, F.greatest("figures_conf", F.lit(0.97))).otherwise(F.col("figures_conf")).alias("figures_conf"),
        F.when(match, F.greatest("words_conf", F.lit(0.95))).otherwise(F.col("words_conf")).alias("words_conf"),
        match.alias("amount_match"), taken.alias("amount_from_words"),
    )


def final_status(fields: DataFrame, key: str, required: list[str], optional: list[str], signed: Column) -> DataFrame:
    """Record status from its fields (key, field, value, confidence): observations in a fixed order, the mean confidence
    (a missing required field counts as 0), and COMPLETO only without observations."""
    names = required + optional
    have = lambda f: (F.col("field") == f) & F.col("value").isNotNull()
    aggs = [F.max(F.when(have(f), F.col("confidence"))).alias(f"__{f}") for f in names]
    rows = fields.groupBy(key).agg(*aggs, F.coalesce(F.max(signed.cast("int")), F.lit(0)).alias("__signed"))
    notes = [F.when(F.col(f"__{f}").isNull(), F.lit(f"missing {f}")).when(F.col(f"__{f}") < values.REQUIRED_FLOOR, F.lit(f"doubtful {f}")) for f in required]
    notes.append(F.when(F.col("__signed") == 0, F.lit("no signature")))
    conf = [F.coalesce(f"__{f}", F.lit(0.0)) for f in required] + [F.col(f"__{f}") for f in optional]
    known = F.filter(F.array(*conf), lambda x: x.isNotNull())
    total = F.aggregate(known, F.lit(0.0), lambda a, b: a + b)
    rows = rows.select(key, F.filter(F.array(*notes), lambda x: x.isNotNull()).alias("observations"), F.round(total / F.greatest(F.size(known), F.lit(1)), 3).alias("confidence"))
    return rows.withColumn("status", F.when(F.size("observations") == 0, "COMPLETO").otherwise("REVISAR"))


def bank(name: Column, routing: Column, house: str, code: str, known: list[str]) -> list[Column]:
    """Bank in the header, confirmed where the house bank's code opens the routing number."""
    opens = F.lit(False)
    for k in known:
        opens |= name.startswith(k)
    conf = F.when((name == house) & F.coalesce(routing, F.lit("")).startswith(code), 0.99).when(name.isNotNull() & (name != ""), F.when(opens, 0.9).otherwise(0.6)).otherwise(0.0)
    return decision(F.nullif(name, F.lit("")), conf)


def unanimous_number(readings: DataFrame, key: str, least: int, most: int) -> DataFrame:
    """A number without a second source (columns key, at, text, confidence): the most frequent reading of a fitting
    length, ties to the first; accepted only if all readings agree and none is below 0.9."""
    digits = F.regexp_replace("text", "[^0-9]", "")
    rows = readings.select(key, "at", digits.alias("d"), "confidence", F.length(digits).between(least, most).alias("fits"))
    total = rows.groupBy(key).agg(F.count("*").alias("n"))
    votes = rows.where("fits").groupBy(key, "d").agg(F.count("*").alias("votes"), F.min("confidence").alias("low"), F.min("at").alias("first"))
    best = votes.groupBy(key).agg(F.max_by(F.struct("d", "votes", "low"), F.struct(F.col("votes"), -F.col("first"))).alias("b"))
    out = total.join(best, key, "left")
    conf = F.coalesce(F.col("b.votes") / F.col("n") * F.col("b.low"), F.lit(0.0))
    ok = F.coalesce((F.col("b.votes") == F.col("n")) & (conf >= 0.9), F.lit(False))
    return out.select(key, *decision(F.col("b.d"), F.when(ok, conf).otherwise(F.least(conf, F.lit(0.79))), ~ok))


def number_lists(df: DataFrame, key: str, reads: str, length: int, limit: int = 64) -> DataFrame:
    """Candidates of a printed number (key, array of readings) as an array c: combinations of the digits seen at each position, capped
    in order, with the readings themselves; a single candidate is joined by its one-digit neighbours."""
    base = F.array_distinct(F.filter(reads, lambda d: F.length(d) == length))
    digit = lambda i: lambda d: F.substring(d, i + 1, 1)
    seen = F.array(*[F.array_sort(F.array_distinct(F.transform("base", digit(i)))) for i in range(length)])
    rows = df.select(key, base.alias("base")).where(F.size("base") > 0)
    all_ = F.array_union(digit_product(seen, limit), F.col("base"))
    rows = rows.withColumn("c", all_).withColumn("c", F.when(F.size("c") == 1, F.array_union("c", numbers.digit_neighbours(F.get("c", F.lit(0))))).otherwise(F.col("c")))
    return rows.select(key, "c")


def number_candidates(df: DataFrame, key: str, reads: str, length: int, limit: int = 64) -> DataFrame:
    """The same, a row each."""
    return number_lists(df, key, reads, length, limit).select(key, F.explode("c").alias("candidate"))


def verified_number(scores: DataFrame, key: str, both: DataFrame) -> DataFrame:
    """Winner among scored candidates (key, candidate, zone weight, score); ``both``: (key, candidate) that print and line
    agree on. Accepted with a margin of NUMBER_MARGIN, or half of it where both agree; ties go to the smaller number."""
    total = scores.groupBy(key, "candidate").agg(F.sum(F.col("weight") * F.col("score")).alias("score"))
    w = Window.partitionBy(key).orderBy(F.col("score").desc(), "candidate")
    best = total.withColumn("r", F.row_number().over(w)).withColumn("margin", F.coalesce(F.col("score") - F.lead("score").over(w), F.lit(99.0))).where("r = 1")
    best = best.join(both.select(key, "candidate", F.lit(True).alias("agreed")).dropDuplicates([key, "candidate"]), [key, "candidate"], "left")
    agreed = F.coalesce("agreed", F.lit(False))
    conf = 1 - 0.5 * F.exp(-F.col("margin") / 3)
    conf = F.when(agreed, F.greatest(conf, F.lit(0.99))).otherwise(conf)
    ok = (F.col("margin") >= values.NUMBER_MARGIN) | (agreed & (F.col("margin") >= values.NUMBER_MARGIN / 2))
    return best.select(key, *decision(F.col("candidate"), F.when(ok, conf).otherwise(F.least(conf, F.lit(0.79))), ~ok), "margin")


def pivot_fields(fields: DataFrame, key: str, names: list[str]) -> DataFrame:
    """One row for each record with value and confidence of every field, in the order of ``names``."""
    return fields.groupBy(key).pivot("field", names).agg(F.first("value", ignorenulls=True).alias("value"), F.first("confidence", ignorenulls=True).alias("confidence"))


def printed_number(readings: DataFrame, zones: DataFrame, key: str, length: int, alphabet: str) -> DataFrame:
    """A printed number end to end: readings (key, source "printed" or "line", text) give candidates, the zones' matrices
    (key, m, t, weight) score them, and ``verified_number`` decides."""
    digits = spread(readings.select(key, "source", F.regexp_replace("text", "[^0-9]", "").alias("d")), key)
    # A number and its images are one row; its candidates, dozens where all read the same, never carry the matrices along.
    lists = number_lists(digits.groupBy(key).agg(F.collect_list("d").alias("reads")), key, "reads", length)
    images = spread(zones.where(F.col("m").isNotNull() & (F.col("t") > 0)), key).groupBy(key).agg(F.collect_list(F.struct("m", "t", F.col("weight").cast("double").alias("weight"))).alias("images"))
    rows = lists.join(images, key)
    rows = rows.withColumn("s", ctc_best(F.col("images.m"), F.col("images.t"), F.transform("c", lambda x: F.array(x)), alphabet, as_blank=" -", weights=F.col("images.weight")))
    # The winner and its margin need the best two alone.
    ranked = F.array_sort(F.transform(F.arrays_zip("c", "s"), lambda x: F.struct((-F.coalesce(x["s"], F.lit(float("-inf")))).alias("loss"), x["c"].alias("candidate"), x["s"].alias("score"))))
    scored = rows.select(key, F.inline(F.slice(ranked, 1, 2))).select(key, "candidate", F.lit(1.0).alias("weight"), "score")
    both = digits.where(F.length("d") == length).groupBy(key, F.col("d").alias("candidate")).agg(F.countDistinct("source").alias("n")).where("n > 1")
    return verified_number(scored, key, both)


def assembled_line(df: DataFrame) -> DataFrame:
    """The magnetic line out of its decided groups (number, routing, account, kind): null unless all are there, and as
    certain as the least certain of them."""
    parts = ["number", "routing", "account", "kind"]
    whole = F.when(F.array_contains(F.transform(F.array(*parts), lambda p: p.isNull() | (p == "")), True), None).otherwise(F.concat_ws(" ", *parts))
    return df.withColumns({"line": whole, "confidence": F.least("number_conf", "routing_conf", "account_conf")})


def amount_decision(df: DataFrame) -> DataFrame:
    """Gates of an amount that was scored in two zones (columns value, margin, same: read alike in both zones, read: read in
    one, fit: score a letter of the words, deep: confirmed by the deep reader, figures and words: arrays of readings).

    It is accepted if the words fit, at least two number words can be read, the cents are not in doubt, and it was read
    alike, or read once and ahead by ``AMOUNT_MARGIN``. Cents are in doubt where figures end in a separator and the
    words do not say that there are none.
    """
    legible = F.exists("words", lambda w: number_word_count(F.regexp_extract_all(plain(w), F.lit("([a-z]+)"))) >= 2)
    loose = F.exists("figures", lambda x: F.regexp_like(F.trim(x), F.lit(r"[0-9][.,]\s*$")))
    said = F.exists("words", lambda w: F.regexp_like(plain(w), F.lit(r"00\s*/\s*100|exact|cero\s+centavos")))
    doubt = (F.col("value") % 1 == 0) & loose & ~said
    fits = (F.col("fit") >= values.AMOUNT_FIT) | F.col("deep")
    ok = F.coalesce(fits & legible & ~doubt & (F.col("same") | (F.col("read") & (F.col("margin") >= values.AMOUNT_MARGIN))), F.lit(False))
    conf = 1 - 0.5 * F.exp(-F.col("margin") / 3)
    conf = F.when(F.col("same"), F.greatest(conf, F.lit(0.99))).otherwise(conf)
    decided = decision(F.col("value"), F.when(ok, conf).otherwise(F.least(conf, F.lit(0.79))), ~ok)
    return df.select(*[c for c in df.columns if c not in ("value", "confidence", "review")], *decided)


def _most_frequent(items: Column) -> Column:
    """(value, votes) of the most frequent text of an array, the first of equals."""
    counts = F.transform(F.array_distinct(items), lambda x: F.struct(x.alias("value"), F.size(F.filter(items, lambda y: y == x)).alias("votes")))
    return F.reduce(counts, F.lit(None).cast("struct<value:string,votes:int>"), lambda a, b: F.when(a.isNull() | (b["votes"] > a["votes"]), b).otherwise(a))


def city(df: DataFrame, key: str, agrees: float = 0.7) -> DataFrame:
    """City as it was read (columns deep: a text, quick: an array of texts): the deep reader's, certain if a quick reading is
    like it; else the most frequent quick one, always to review."""
    rows = df.select(key, F.nullif(stripped_city(F.col("deep")), F.lit("")).alias("d"), F.filter(F.transform("quick", stripped_city), lambda x: x != "").alias("q"))
    rows = rows.withColumn("like", best_agreement(plain(F.col("d")), F.transform("q", plain)))
    sure = F.col("d").isNotNull() & (F.col("like") >= agrees)
    value = F.coalesce("d", _most_frequent(F.col("q"))["value"])
    return rows.select(key, *decision(value, F.when(value.isNull(), 0.0).when(sure, 0.9).otherwise(0.6), ~sure))


def payee(df: DataFrame, key: str, names: dict[str, str], agrees: float = 0.7, trusted: int = 3) -> DataFrame:
    """Payee (columns deep: a text, quick: an array of texts, those of the main reader first, and, if there is one, sure: their
    confidences).

    The deep reader's text stands as it is, without the printed label, and is certain if a quick reading is like it.
    Otherwise words are decided one by one against the surest of the first ``trusted`` readings (of equally sure ones that
    with most words, then the first): from the known names that any reading is like, else as read; sure where all readings
    agree on a word of three letters or a known name, and the whole only if all words are and there are two. ``names``:
    plain form to written form; particles are known as well. Labels and their misread rests are no words, names that were
    read as one are cut, and a word that repeats the one before it goes, before deciding and after.
    """
    known = names | {p: p for p in values.PARTICLES}
    sure = F.col("sure") if "sure" in df.columns else F.transform("quick", lambda _: F.lit(0.0))
    readings = F.filter(F.zip_with("quick", sure, lambda q, s: F.struct(q.alias("text"), F.coalesce(s, F.lit(0.0)).cast("double").alias("sure"))), lambda r: r["text"].isNotNull())
    rows = df.select(key, F.nullif(stripped_payee(F.col("deep")), F.lit("")).alias("d"), readings.alias("readings"))
    words = name_words(F.transform("readings", lambda r: r["text"]), known)
    rows = rows.withColumn("words", words).withColumn("r", F.filter(F.zip_with("readings", "words", lambda r, w: F.struct(r["sure"].alias("sure"), w.alias("words"))), lambda r: F.size(r["words"]) > 0))
    rows = rows.select(key, "d", "r", F.transform("r", lambda r: F.transform(r["words"], plain)).alias("q"))
    rows = rows.withColumn("like", best_agreement(plain(F.col("d")), F.transform("q", lambda w: F.array_join(w, " "))))
    deep = rows.where("d IS NOT NULL")
    deep = deep.select(key, *decision(F.col("d"), F.when(F.col("like") >= agrees, 0.9).otherwise(0.6), F.col("like") < agrees))

    first = F.array_max(F.transform(F.slice("r", 1, trusted), lambda r, i: F.struct(r["sure"].alias("sure"), F.size(r["words"]).alias("n"), (-i).alias("i"))))["i"]
    base = rows.where("d IS NULL").withColumn("base", once_in_a_row(F.get("q", -first)))
    seen = base.select(key, "base", F.size("q").alias("n"), F.posexplode("q").alias("at", "words"))
    seen = seen.select(key, "n", "at", F.posexplode(aligned(F.col("base"), F.col("words"))).alias("pos", "word")).where("word IS NOT NULL")
    seen = seen.withColumn("known", F.get(closest_of(F.col("word"), list(known), 3, 0.6), F.lit(0)))
    per = seen.groupBy(key, "pos").agg(F.first("n").alias("n"), F.count("*").alias("seen"), F.countDistinct("word").alias("kinds"), F.min_by("word", "at").alias("word"), F.min_by("known", F.when(F.col("known").isNotNull(), F.col("at"))).alias("known"))
    same = (F.col("kinds") == 1) & (F.col("seen") == F.col("n"))
    ok = same & (F.col("known").isNotNull() | (F.length("word") >= 3))
    written = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in known.items() for x in kv]), F.col("known")), F.initcap("word"))
    per = per.select(key, "pos", F.when((F.col("pos") > 0) & F.lower(written).isin(values.PARTICLES), F.lower(written)).otherwise(written).alias("word"), ok.alias("ok"))
    whole = per.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", "word", "ok"))).alias("l"))
    whole = whole.withColumn("l", F.filter("l", lambda x, i: (i == 0) | (plain(x["word"]) != plain(F.get("l", i - 1)["word"]))))
    sure = F.forall("l", lambda x: x["ok"])
    whole = whole.select(key, F.array_join(F.transform("l", lambda x: x["word"]), " ").alias("v"), sure.alias("sure"), (sure & (F.size("l") >= 2)).alias("ok"))
    out = rows.where("d IS NULL").select(key).join(whole, key, "left")
    conf = F.when(F.col("v").isNull(), 0.0).when(F.col("ok"), 1.0).otherwise(F.when(F.col("sure"), 0.79).otherwise(0.6))
    return deep.unionByName(out.select(key, *decision(F.col("v"), conf, ~F.coalesce("ok", F.lit(False)))))


def _readable(c: Column) -> Column:
    """A written date with the blank that a reader lost between a word and a digit, and digits for look-alike letters."""
    return digits_repaired(F.regexp_replace(c, values.LETTER_THEN_DIGIT, " "))


def _dates_of(c: Column) -> Column:
    """(date, weight) of the ways to read a written date: 1 as it stands, a half with a 1 taken as a slash; each date once."""
    return _votes(F.transform(slash_readings(_readable(c)), lambda w: F.struct(earliest_date(w)["date"].alias("d"))))


def _votes(ways: Column) -> Column:
    found = F.filter(F.transform(ways, lambda w, i: F.struct(w["d"].alias("d"), F.when(i == 0, 1.0).otherwise(0.5).alias("w"))), lambda x: x["d"].isNotNull())
    return let(found, lambda found: F.filter(found, lambda x, i: ~F.exists(F.slice(found, 1, i), lambda y: y["d"] == x["d"])))


def date(df: DataFrame, key: str, as_of: str) -> DataFrame:
    """Date (columns deep: a text, quick: an array of texts): the deep reader's, certain if a quick reading confirms it and
    it is plausible; else the one with most votes, a reading of a 1 as a slash counting half, to review. With whether it
    lies after ``as_of`` and the days since it."""
    today = F.lit(as_of).cast("date")
    votes = F.flatten(F.transform(F.filter("quick", lambda x: x.isNotNull()), _dates_of))
    deep = F.coalesce(earliest_date(_readable(F.col("deep")))["date"], F.get(_dates_of(F.col("deep")), F.lit(0))["d"])
    rows = df.select(key, deep.alias("deep"), F.size("quick").alias("n"), votes.alias("votes"))
    total = lambda d: F.aggregate(F.filter("votes", lambda v: v["d"] == d), F.lit(0.0), lambda a, v: a + v["w"])
    counts = F.transform(F.array_distinct(F.transform("votes", lambda v: v["d"])), lambda d: F.struct(d.alias("d"), total(d).alias("w")))
    best = F.reduce(counts, F.lit(None).cast("struct<d:date,w:double>"), lambda a, b: F.when(a.isNull() | (b["w"] > a["w"]), b).otherwise(a))
    rows = rows.withColumn("best", best).withColumn("found", F.coalesce("deep", "best.d"))
    sure = F.coalesce(plausible(F.col("deep"), today) & F.exists("votes", lambda v: v["d"] == F.col("deep")), F.lit(False))
    conf = F.when(F.col("deep").isNotNull(), F.when(sure, 0.95).otherwise(0.7)).otherwise(F.when(F.col("best").isNull(), 0.0).otherwise(F.least(F.col("best.w") / F.col("n"), F.lit(0.79))))
    return rows.select(key, *decision(F.col("found").cast("string"), conf, ~sure), (F.col("found") > today).alias("post_dated"), F.date_diff(today, F.col("found")).alias("days"))


def escalated(fields: DataFrame, second_reader, keys: list[str]) -> DataFrame:
    """Fields (keys, value, confidence, review) after a second, dearer reading of those in review alone; ``second_reader``
    takes their keys and returns keys and value. The first readings are not made again."""
    again = second_reader(fields.where("review").select(*keys))
    return refine(fields.drop("review"), again, keys)


def handwritten_doubt(fields: DataFrame, low: float = 0.80) -> DataFrame:
    """Fields worth a handwriting reader: written by hand and doubtful."""
    return fields.where((F.col("writing") == "manuscrito") & (F.col("confidence") < low))


def with_reasons(df: DataFrame, review: Column, reasons: dict[str, Column]) -> DataFrame:
    """The rows with why they go to review, in order, and whether they do: already, or for any of the reasons."""
    holds = [F.coalesce(c, F.lit(False)) for c in reasons.values()]
    text = F.concat_ws("; ", *[F.when(c, F.lit(r)) for r, c in zip(reasons, holds, strict=True)])
    return df.withColumns({"reasons": text, "review": F.coalesce(review, F.lit(False)) | F.greatest(*holds, F.lit(False))})


def _read_as(c: Column) -> Column:
    """The date that a text holds, and whether its year stands first; that is null where the month is a word."""
    def order(found):
        groups = F.regexp_extract_all(F.substr(plain(c), found["pos"], found["end"] - found["pos"] + 1), F.lit("[0-9]+"), F.lit(0))
        return F.struct(found["date"].alias("d"), let(groups, lambda g: F.when(F.size(g) == 3, F.length(F.get(g, F.lit(0))) == 4)).alias("year_first"))

    return let(earliest_date(c), order)


def date_neighbours(d: Column, year_first: Column) -> Column:
    """Dates that differ from one in a single digit of its eight, in the order in which it was written."""
    places = F.when(year_first, F.array(*map(F.lit, (1, 2, 3, 4, 6, 7, 9, 10)))).otherwise(F.array(*map(F.lit, (9, 10, 6, 7, 1, 2, 3, 4))))
    digits = F.array(*map(F.lit, "0123456789"))
    found = let(d.cast("string"), lambda iso: F.flatten(F.transform(places, lambda at: F.transform(digits, lambda x: F.overlay(iso, x, at, F.lit(1)).try_cast("date")))))
    return F.filter(found, lambda x: x.isNotNull() & (x != d))


def _digits_of(d: Column, year_first: Column) -> Column:
    """A date's digits, padded and not, in the order in which it was written; each form once."""
    month, day = F.month(d).cast("string"), F.dayofmonth(d).cast("string")
    year, mm, dd = (F.substr(d.cast("string"), F.lit(at), F.lit(n)) for at, n in ((1, 4), (6, 2), (9, 2)))
    return F.array_distinct(F.when(year_first, F.array(F.concat(year, mm, dd), F.concat(year, month, day))).otherwise(F.array(F.concat(dd, mm, year), F.concat(day, month, year))))


def date_on_image(readings: DataFrame, zones: DataFrame, key: str, as_of: str, alphabet: str) -> DataFrame:
    """A date without a deep reader, decided on its zone's images: one row for each key of ``readings`` (key, text), with value,
    confidence, review, margin, post_dated, days.

    Candidates are the dates that were read and the plausible ones one digit away, in the digits' own order (that of the
    first reading that shows one); each is scored, padded and not, on the images (zones: key, m, t). A plausible date goes
    before an implausible one. It is accepted if it is plausible, was read, and either all readings agree or it leads by
    ``values.DATE_MARGIN``. Without an image, or with the month in words, the readings vote and the result goes to review.
    Ties go to the earlier date; null texts count as readings that show none.
    """
    today = F.lit(as_of).cast("date")
    # Every way to read a text is searched for a date once, for the votes and for the order of the digits alike, and equal readings of a key together.
    per = spread(readings.select(key, F.coalesce("text", F.lit("")).alias("text")), key).groupBy(key, "text").agg(F.count("*").cast("int").alias("times"))
    per = per.withColumn("ways", F.transform(slash_readings(_readable(F.col("text"))), _read_as))
    per = per.select(key, "text", "times", _votes(F.col("ways")).alias("votes"), F.get(F.filter(F.transform("ways", lambda w: w["year_first"]), lambda x: x.isNotNull()), F.lit(0)).alias("year_first"))
    rows = per.groupBy(key).agg(F.sum("times").alias("n"), F.flatten(F.collect_list(F.flatten(F.array_repeat("votes", F.col("times"))))).alias("votes"), F.min_by("year_first", F.when(F.col("year_first").isNotNull(), F.col("text"))).alias("year_first"))
    # A filter on matrices would render each of them twice, so those that are none are left out where they are gathered.
    image = F.when(F.col("m").isNotNull() & (F.col("t") > 0), F.struct("m", "t"))
    images = spread(zones.select(key, image.alias("image")), key).groupBy(key).agg(F.collect_list("image").alias("images"))
    rows = matched(rows, images.withColumn("images", F.when(F.size("images") > 0, F.col("images"))), key, how="left").withColumn("read", F.sort_array(F.array_distinct(F.transform("votes", lambda v: v["d"]))))
    near = F.filter(F.flatten(F.transform("read", lambda d: date_neighbours(d, F.col("year_first")))), lambda d: plausible(d, today))
    rows = rows.withColumn("seen", F.col("year_first").isNotNull() & F.col("images").isNotNull())
    rows = rows.withColumn("c", F.when(F.col("seen"), F.sort_array(F.array_union("read", near))).otherwise(F.col("read")))
    forms = F.transform("c", lambda d: _digits_of(d, F.col("year_first")))
    rows = rows.withColumn("s", ctc_best(F.col("images.m"), F.col("images.t"), forms, alphabet, as_blank=" -/.,_"))
    votes = lambda d: F.aggregate(F.filter("votes", lambda v: v["d"] == d), F.lit(0.0), lambda a, v: a + v["w"])
    score = lambda x: F.when(F.col("seen"), F.coalesce(x["s"], F.lit(-1e9))).otherwise(votes(x["c"]))
    ranked = F.sort_array(F.transform(F.arrays_zip("c", "s"), lambda x: F.struct((F.col("seen") & ~plausible(x["c"], today)).alias("odd"), (-score(x)).alias("loss"), x["c"].alias("d"))))
    rows = rows.withColumn("ranked", ranked).withColumn("d", F.get("ranked", F.lit(0))["d"])
    margin = F.coalesce(F.get("ranked", F.lit(1))["loss"] - F.get("ranked", F.lit(0))["loss"], F.lit(99.0))
    rows = rows.withColumns({"margin": margin, "all": votes(F.col("d")) >= F.col("n"), "held": F.array_contains("read", F.col("d"))})
    ok = F.coalesce(F.col("seen") & plausible(F.col("d"), today) & F.col("held") & (F.col("all") | (F.col("margin") >= values.DATE_MARGIN)), F.lit(False))
    image = F.greatest(1 - 0.5 * F.exp(-F.col("margin") / 2), F.when(F.col("all"), 0.99).otherwise(0.0))
    conf = F.when(F.col("d").isNull(), 0.0).when(~F.col("seen"), F.least(votes(F.col("d")) / F.col("n"), F.lit(0.79))).otherwise(F.when(ok, image).otherwise(F.least(image, F.lit(0.79))))
    return rows.select(key, *decision(F.col("d").cast("string"), conf, ~ok), "margin", (F.col("d") > today).alias("post_dated"), F.date_diff(today, F.col("d")).alias("days"))
