"""Operator 13: conversations repaired to the structure that a role grammar asks for, by weighted finite-state composition.

Three machines are composed lazily, that is only where a path gets to:

* the input acceptor, a chain with one arc for each row of the conversation;
* the edit transducer, of one state: Keep a row, Rerole it, Delete it, or Insert one, each with its cost;
* the role grammar, an acceptor of ``(s?(ua)+)?`` over the initials of roles.

States of the composition are (rows read, state of the grammar), in topological order once insertions are taken at
most twice in a row (a third would come back to a state of the grammar at a cost).  The weight of a path is the pair of
its cost and its string of edits' initials, compared in that order.  Edits determine costs, so of two paths between the
same states with equal costs neither string is a prefix of the other: the smaller one stays smaller whatever comes
before or after, and the weights form a semiring.  So a conversation can also be cut into chunks whose matrices of
weights between states of the grammar are multiplied in any grouping.

Conversations of at most ``most_rows`` rows and ``most_bytes`` of text are dealt by conv_id and repaired one after
another.  Longer ones are cut into chunks of ``most_rows`` rows by dense numbers of their rows, so that no task holds one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import materialize, numbered, small, workers_see_package

#: White space, in the order of the codes.
SPACE = "\t\n\x0b\x0c\r "
#: The role grammar: state and initial to state. 0 begins, 1 is after s, 2 after u, 3 after a.
GRAMMAR = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
FINAL = (0, 3)
ROLES = {"u": "user", "a": "assistant"}
KEEP, REROLE, DELETE, INSERT, LATE = 0, 3, 4, 3, 3
#: Chunk matrices that one task multiplies.
FAN_IN = 64

Weight = tuple[int, str]


def edits(symbol: str) -> list[tuple[str, int, str]]:
    """Arcs of the edit transducer that read a row: (initial written or nothing, cost, label).

    A row is the initial of its role, in upper case where its text is cut off, or "x" where it has to go; "o" stands for any other role.
    """
    if symbol == "x":
        return [("", DELETE, "D")]
    late = LATE * symbol.isupper()
    return [(symbol.lower(), KEEP + late, "K"), ("u", REROLE + late, "R"), ("a", REROLE + late, "R"), ("", DELETE, "D")]


def better(found: dict, key, weight) -> None:
    if key not in found or weight < found[key]:
        found[key] = weight


def inserted(at: dict[int, Weight]) -> dict[int, Weight]:
    """States reached by up to two insertions."""
    for _ in range(2):
        more = dict(at)
        for state, (cost, labels) in at.items():
            for initial in ROLES:
                if (state, initial) in GRAMMAR:
                    better(more, GRAMMAR[state, initial], (cost + INSERT, labels + "I"))
        at = more
    return at


def shortest(word: str, start: int = 0) -> dict[int, Weight]:
    """Weight of the shortest path over the rows from a state of the grammar to each state, insertions before each row included."""
    at = {start: (0, "")}
    for symbol in word:
        step = {}
        for state, (cost, labels) in inserted(at).items():
            for initial, more, label in edits(symbol):
                to = GRAMMAR.get((state, initial)) if initial else state
                if to is not None:
                    better(step, to, (cost + more, labels + label))
        at = step
    return at


@lru_cache(1 << 14)
def _short_repair(word: str) -> Weight:
    return repair(word)


def repair(word: str) -> Weight:
    """Cost and edits of the cheapest repair, the ASCII-least of equally cheap ones."""
    at = inserted(shortest(word))
    return min(at[q] for q in FINAL if q in at)


def illegal(word: str) -> int:
    return sum(word[i : i + 2].lower() not in ("su", "ua", "au") for i in range(len(word) - 1))


def apply(labels: str, rows: list[tuple[str, str]], state: int = 0) -> Iterator[tuple[str, str, str]]:
    """(edit, role, text) of what stays or comes, given the edits and the (role, text) of the rows."""
    left = iter(rows)
    for label in labels:
        role, text = ("", "") if label == "I" else next(left)
        if label == "D":
            continue
        initial = role[:1] if label == "K" else next(i for i in ROLES if (state, i) in GRAMMAR)
        state = GRAMMAR[state, initial]
        yield label, role if label == "K" else ROLES[initial], text


def _text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(" "))


def damaged(convs: DataFrame) -> DataFrame:
    """The rows with damage done by a hash of conv_id and turn: some dropped, emptied, without full stops, repeated, or of role user.

    Columns conv_id, turn, role, text (nulls one space), and ``present``, false for a dropped row, which only says that its conversation exists.
    """
    rows = convs.select("conv_id", "turn", _text(convs["role"]).alias("role"), _text(convs["text"]).alias("text"))
    rows = rows.withColumn("k", F.crc32(F.concat(_text(rows["conv_id"]), F.lit(":"), _text(rows["turn"])).cast("binary")) % 20)
    text = F.when(F.col("k") == 1, "").when(F.col("k") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return rows.select(
        "conv_id", "turn", F.when(F.col("k") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), (F.col("k") != 0).alias("present"), F.explode(F.when(F.col("k") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")
    ).drop("copy")


def _symbols(rows: DataFrame) -> DataFrame:
    """Adds ``symbol``, as ``edits`` reads it but for repeats; "" for a row that only names its conversation."""
    body = F.rtrim("text", F.lit(SPACE))
    initial = F.substring("role", 1, 1)
    initial = F.when(initial.isin("s", "u", "a"), initial).otherwise("o")
    cut = ~F.substring(body, -1, 1).isin(".", "!", "?")
    return rows.withColumn("symbol", F.when(~F.col("present"), "").when(body == "", F.concat(F.lit("x"), initial)).when(cut, F.upper(initial)).otherwise(initial))


_SUMMARY = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def _conversations(batches) -> Iterator[tuple]:
    """(conv_id, turns, roles, texts, symbols) of each conversation in turn; a partition holds each whole, in order."""
    now, held = None, None
    for batch in batches:
        for conv, turn, role, text, symbol in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if held is None or conv != now:
                if held:
                    yield (now, *held)
                now, held = conv, ([], [], [], [])
            if symbol:
                for at, x in zip(held, (turn, role, text, symbol), strict=True):
                    at.append(x)
    if held:
        yield (now, *held)


def _gaps(turns: list) -> int:
    known = {t for t in turns if t is not None}
    return max(known) - min(known) + 1 - len(known) if known else 0


def _faults(roles: list[str], texts: list[str], symbols: list[str]) -> tuple[str, str, int]:
    """The word of a conversation, the initials of its rows, and how many of its rows are repeats of earlier ones."""
    seen, word, initials, repeats = set(), [], [], 0
    for role, text, symbol in zip(roles, texts, symbols, strict=True):
        initials.append(symbol[-1].lower())
        again = (role, text) in seen
        seen.add((role, text))
        repeats += again and symbol[0] != "x"
        word.append("x" if again or symbol[0] == "x" else symbol)
    return "".join(word), "".join(initials), repeats


def _short(batches, turns: bool):
    """Summaries, or repaired rows, of whole conversations."""
    out = []
    for conv, numbers, roles, texts, symbols in _conversations(batches):
        word, initials, repeats = _faults(roles, texts, symbols)
        cost, audit = _short_repair(word) if len(word) <= 32 else repair(word)
        stay = apply(audit, list(zip(roles, texts, strict=True)))
        if turns:
            out += [(conv, k, *row) for k, row in enumerate(stay)]
        else:
            digest = hashlib.sha256("\n".join(f"{role}:{text}" for _, role, text in stay).encode()).hexdigest()
            out.append((conv, _gaps(numbers), sum(s[0] == "x" for s in symbols), repeats, sum(s.isupper() for s in word), illegal(initials), cost, audit, digest))
        if len(out) >= 500:
            yield out
            out = []
    yield out


def _chunk(table: pa.Table) -> pa.Table:
    """One chunk of a long conversation: the matrix of weights between states of the grammar, and what joins it to its neighbours."""
    rows = table.sort_by("n")
    symbols = rows.column("symbol").to_pylist()
    word = "".join("x" if again or s[0] == "x" else s for s, again in zip(symbols, rows.column("again").to_pylist(), strict=True))
    initials = "".join(s[-1].lower() for s in symbols)
    matrix = [(p, q, cost, labels, [len(labels)], [p]) for p in range(4) for q, (cost, labels) in shortest(word, p).items()]
    return _record(rows.column("conv_id")[0], rows.column("chunk")[0].as_py(), matrix, illegal(initials), initials[0], initials[-1])


_RECORD = "conv_id {id}, chunk long, matrix array<struct<p: int, q: int, cost: long, labels: string, sizes: array<int>, states: array<int>>>, illegal long, first string, last string"


def _record(conv, chunk, matrix, illegal_pairs, first, last) -> pa.Table:
    kind = pa.list_(pa.struct([("p", pa.int32()), ("q", pa.int32()), ("cost", pa.int64()), ("labels", pa.string()), ("sizes", pa.list_(pa.int32())), ("states", pa.list_(pa.int32()))]))
    rows = [dict(zip(("p", "q", "cost", "labels", "sizes", "states"), m, strict=True)) for m in matrix]
    return pa.table({"conv_id": pa.array([conv.as_py()], conv.type), "chunk": pa.array([chunk], pa.int64()), "matrix": pa.array([rows], kind), "illegal": pa.array([illegal_pairs], pa.int64()), "first": [first], "last": [last]})


def _product(table: pa.Table) -> pa.Table:
    """The product of the matrices of neighbouring chunks, in order; an entry remembers where each chunk's labels end and the state it begins in."""
    rows = table.sort_by("chunk").to_pylist()
    total, pairs = None, 0
    for k, r in enumerate(rows):
        one = {(m["p"], m["q"]): (m["cost"], m["labels"], m["sizes"], m["states"]) for m in r["matrix"]}
        if total is None:
            total = one
        else:
            product = {}
            for (p, q), (cost, labels, sizes, states) in total.items():
                for (p2, q2), (cost2, labels2, sizes2, states2) in one.items():
                    if p2 == q:
                        better(product, (p, q2), (cost + cost2, labels + labels2, sizes + sizes2, states + states2))
            total = product
        pairs += r["illegal"] + (k > 0 and illegal(rows[k - 1]["last"] + r["first"]))
    matrix = [(p, q, *w) for (p, q), w in total.items()]
    return _record(table.column("conv_id")[0], rows[0]["chunk"], matrix, pairs, rows[0]["first"], rows[-1]["last"])


def _long_repairs(rows: DataFrame, chunk_rows: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """For conversations too long for one task: their numbered rows, their summaries, and the edits of each chunk."""
    kind = rows.schema["conv_id"].dataType.simpleString()
    # Rows that agree in all of this are equal, so the last key only spreads them.
    seen = numbered(rows.where("symbol <> ''").withColumn("salt", F.monotonically_increasing_id()), "n", F.col("conv_id"), F.col("turn"), F.col("role"), F.col("text"), F.col("salt")).drop("salt")
    seen = seen.withColumn("chunk", F.floor(F.col("n") / chunk_rows))
    first = seen.groupBy("conv_id", F.sha2(F.concat("role", F.lit(":"), F.octet_length("role").cast("string"), F.lit(":"), "text"), 256).alias("h")).agg(F.min("n").alias("n"))
    marked = seen.select("conv_id", "turn", "symbol", "n", "chunk").join(first.select("n", F.lit(False).alias("again")), "n", "left").withColumn("again", F.coalesce("again", F.lit(True)))
    marked = materialize(marked)
    counts = marked.groupBy("conv_id").agg(
        F.count_if(F.col("symbol").startswith("x")).alias("blank"), F.count_if(F.col("again") & ~F.col("symbol").startswith("x")).alias("duplicate"), F.count_if(~F.col("again") & F.col("symbol").rlike("^[A-Z]")).alias("truncated")
    )
    known = marked.where("turn IS NOT NULL").groupBy("conv_id", "turn").agg(F.lit(1).alias("one")).groupBy("conv_id").agg((F.max("turn") - F.min("turn") + 1 - F.count("*")).alias("gaps"))
    record = _RECORD.format(id=kind)
    chunks = materialize(marked.select("conv_id", "symbol", "n", "chunk", "again").groupBy("conv_id", "chunk").applyInArrow(_chunk, record))
    shift = 1
    while (chunks.groupBy("conv_id").count().agg(F.max("count")).first()[0] or 0) > FAN_IN:
        shift *= FAN_IN
        group = F.floor(F.col("chunk") / shift).alias("group")
        chunks = materialize(chunks.groupBy("conv_id", group).applyInArrow(_product, record))

    def whole(table: pa.Table) -> pa.Table:
        done = _product(table).to_pylist()[0]
        ends = []
        for m in done["matrix"]:
            if m["p"] == 0:
                for q, (cost, labels) in inserted({m["q"]: (m["cost"], m["labels"])}).items():
                    if q in FINAL:
                        ends.append((cost, labels, m["sizes"], m["states"]))
        cost, labels, sizes, states = min(ends)
        at, pieces = 0, []
        for k, size in enumerate(sizes):
            stop = at + size if k + 1 < len(sizes) else len(labels)
            pieces.append({"chunk": done["chunk"] + k, "state": states[k], "labels": labels[at:stop]})
            at = stop
        conv = table.column("conv_id")[0]
        parts = pa.array([pieces], pa.list_(pa.struct([("chunk", pa.int64()), ("state", pa.int32()), ("labels", pa.string())])))
        return pa.table({"conv_id": pa.array([conv.as_py()], conv.type), "illegal": pa.array([done["illegal"]], pa.int64()), "cost": pa.array([cost], pa.int64()), "audit": [labels], "parts": parts})

    solved = materialize(chunks.groupBy("conv_id").applyInArrow(whole, f"conv_id {kind}, illegal long, cost long, audit string, parts array<struct<chunk: long, state: int, labels: string>>"))
    ids = rows.select("conv_id").distinct()
    for t in (counts, known, solved.drop("parts")):
        t = t.withColumnRenamed("conv_id", "c")
        ids = ids.join(t, ids["conv_id"].eqNullSafe(t["c"]), "left").drop("c")
    numbers = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    summary = ids.select("conv_id", *numbers, F.coalesce("audit", F.lit("")).alias("audit"))
    return seen, summary, solved.select("conv_id", F.explode("parts").alias("p")).select("conv_id", "p.*")


def _long_turns(seen: DataFrame, parts: DataFrame) -> DataFrame:
    """Repaired rows of long conversations, a chunk at a time: conv_id, chunk, k, edit, role, text."""
    kind = seen.schema["conv_id"].dataType.simpleString()

    def run(rows: pa.Table, part: pa.Table) -> pa.Table:
        rows, p = rows.sort_by("n"), part.to_pylist()[0]
        conv = part.column("conv_id")[0]
        out = list(apply(p["labels"], list(zip(rows.column("role").to_pylist(), rows.column("text").to_pylist(), strict=True)), p["state"]))
        edit, role, text = zip(*out, strict=True) if out else ((), (), ())
        n = len(out)
        return pa.table({"conv_id": pa.array([conv.as_py()] * n, conv.type), "chunk": pa.array([p["chunk"]] * n, pa.int64()), "k": pa.array(range(n), pa.int64()), "edit": pa.array(edit, pa.string()), "role": pa.array(role, pa.string()), "text": pa.array(text, pa.string())})

    return seen.select("conv_id", "chunk", "n", "role", "text").groupBy("conv_id", "chunk").cogroup(parts.groupBy("conv_id", "chunk")).applyInArrow(run, f"conv_id {kind}, chunk long, k long, edit string, role string, text string")


def _digests(batches):
    """SHA-256 of the rows of each conversation, joined by line feeds, one row at a time; rows come in order."""
    now, digest = None, None
    for batch in batches:
        out = []
        for conv, role, text in zip(*(c.to_pylist() for c in batch.columns[:3]), strict=True):
            if digest is None or conv != now:
                if digest:
                    out.append((now, digest.hexdigest()))
                now, digest = conv, hashlib.sha256()
            else:
                digest.update(b"\n")
            digest.update(f"{role}:{text}".encode())
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], batch.schema.field(0).type), pa.array([x[1] for x in out], pa.string())], names=["conv_id", "repaired_sha256"])
    if digest:
        yield pa.RecordBatch.from_arrays([pa.array([now], batch.schema.field(0).type), pa.array([digest.hexdigest()])], names=["conv_id", "repaired_sha256"])


def _divided(rows: DataFrame, most_rows: int, most_bytes: int) -> tuple[DataFrame, DataFrame | None]:
    """Rows of short conversations, and those of long ones if there are any."""
    sizes = rows.groupBy("conv_id").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("b"))
    long = materialize(sizes.where((F.col("n") > most_rows) | (F.col("b") > most_bytes)).select(F.col("conv_id").alias("c")))
    if long.isEmpty():
        return rows, None
    long = small(long, 1 << 20)
    return (rows.join(long, rows["conv_id"].eqNullSafe(long["c"]), how) for how in ("left_anti", "left_semi"))


def _prepared(convs: DataFrame) -> DataFrame:
    """Nulls one space; ``present`` as given by ``damaged``, else every row is."""
    present = convs["present"] if "present" in convs.columns and dict(convs.dtypes)["present"] == "boolean" else F.lit(True)
    workers_see_package(convs.sparkSession)
    return _symbols(convs.select("conv_id", "turn", _text(convs["role"]).alias("role"), _text(convs["text"]).alias("text"), present.alias("present"))).drop("present")


def _ordered(rows: DataFrame) -> DataFrame:
    return rows.select("conv_id", "turn", "role", "text", "symbol").repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def audit(convs: DataFrame, most_rows: int = 4096, most_bytes: int = 16 << 20) -> DataFrame:
    """One row for each conv_id: gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    Rows are taken by turn, nulls first; rows of one turn by role and text.  A null role or text is one space; null
    conv_ids are one conversation; repeated rows are duplicates and go.  A conversation without rows (see ``damaged``)
    has zeros, an empty audit and the hash of nothing; an empty table gives no rows.  Other columns are ignored.  Texts
    of any length are read whole.  The hash of one conversation is sequential by its definition: a long one is
    streamed through one task, row by row.
    """
    rows = _prepared(convs)
    kind = rows.schema["conv_id"].dataType
    short, long = _divided(rows, most_rows, most_bytes)
    schema = f"conv_id {kind.simpleString()}, {_SUMMARY}, repaired_sha256 string"

    kinds = [to_arrow_type(kind), *[pa.int64()] * 6, pa.string(), pa.string()]
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches):
        for out in _short(batches, turns=False):
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], names=names)

    done = _ordered(short).mapInArrow(run, schema)
    if long is None:
        return done
    seen, summary, parts = _long_repairs(long, most_rows)
    turns = materialize(_long_turns(seen, parts))
    digests = turns.select("conv_id", "role", "text", "chunk", "k").repartition("conv_id").sortWithinPartitions("conv_id", "chunk", "k").mapInArrow(_digests, f"conv_id {kind.simpleString()}, repaired_sha256 string").withColumnRenamed("conv_id", "c")
    summary = summary.join(digests, summary["conv_id"].eqNullSafe(digests["c"]), "left").drop("c")
    return done.unionByName(summary.withColumn("repaired_sha256", F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256))))


def repaired(convs: DataFrame, most_rows: int = 4096, most_bytes: int = 16 << 20) -> DataFrame:
    """The repaired conversations: conv_id, place (ascending within one, not dense in long ones), edit (K, R or I), role, text; see ``audit``."""
    rows = _prepared(convs)
    kind = rows.schema["conv_id"].dataType
    short, long = _divided(rows, most_rows, most_bytes)

    kinds = [to_arrow_type(kind), pa.int64(), pa.string(), pa.string(), pa.string()]

    def run(batches):
        for out in _short(batches, turns=True):
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], names=["conv_id", "place", "edit", "role", "text"])

    done = _ordered(short).mapInArrow(run, f"conv_id {kind.simpleString()}, place long, edit string, role string, text string")
    if long is None:
        return done
    seen, _, parts = _long_repairs(long, most_rows)
    # A chunk gives at most three rows for each of its own and two more.
    place = F.col("chunk") * (3 * most_rows + 3) + F.col("k")
    return done.unionByName(_long_turns(seen, parts).select("conv_id", place.alias("place"), "edit", "role", "text"))


def _oracle() -> str:
    """The states of the grammar in four columns, each the text of cost and edits, carried from row to row by recursion."""
    far = "900000000"

    def plus(value, cost, label):
        return f"lpad(CAST(CAST({value}[:9] AS INT) + {cost} AS VARCHAR), 9, '0') || {value}[10:] || '{label}'"

    def relaxed(q):
        from_ = [p for (p, i), to in GRAMMAR.items() if to == q and i != "s"]
        return f"least({', '.join([f'w{q}', *(plus(f'w{p}', INSERT, 'I') for p in from_)])})" if from_ else f"w{q}"

    def step(q):
        take = [plus(f"w{q}", DELETE, "D")]
        for (p, i), to in GRAMMAR.items():
            if to == q:
                take.append(f"CASE WHEN s = '{i}' THEN {plus(f'w{p}', '(' + str(KEEP) + ' + late)', 'K')} ELSE '{far}' END")
                if i != "s":
                    take.append(f"CASE WHEN s <> 'x' THEN {plus(f'w{p}', '(' + str(REROLE) + ' + late)', 'R')} ELSE '{far}' END")
        return f"least({', '.join(take)})"

    # The bits of the text, least first, folded into the remainder; the first element is what it starts from.
    bits = "flatten(list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda c: list_transform(range(8), lambda b: (ord(c) >> b::INT) & 1)))"
    crc = f"xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform({bits}, lambda x: x::BIGINT)), lambda c, x: xor(c >> 1, 3988292384::BIGINT * (xor(c, x) & 1))))"
    states = range(4)
    relax = "SELECT * REPLACE ({}) FROM {}".format(", ".join(f"{relaxed(q)} AS w{q}" for q in states), "{}")
    before = relax.format("(" + relax.format("(SELECT w.*, r.s, r.late FROM walk w JOIN word r ON r.conv_id IS NOT DISTINCT FROM w.conv_id AND r.i = w.i + 1)") + ")")
    after = relax.format("(" + relax.format("walk") + ")")
    return f"""WITH RECURSIVE hurt AS (
    SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, crc FROM (SELECT *, {crc} % 20 AS crc FROM conversations)
), rows_ AS (
    SELECT conv_id, turn, CASE WHEN crc = 4 THEN 'user' ELSE role END AS role,
        CASE crc WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
        unnest(CASE WHEN crc = 3 THEN [0, 1] ELSE [0] END) AS copy FROM hurt WHERE crc <> 0
), placed AS (
    SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i FROM rows_
), tagged AS (
    SELECT *, rtrim(text, E' \\t\\n\\x0b\\x0c\\r') AS body, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again,
        lag(role[1]) OVER (PARTITION BY conv_id ORDER BY i) || role[1] AS pair FROM placed
), faults AS (
    SELECT *, body = '' AS blank, body <> '' AND again AS repeated, body <> '' AND NOT again AND body[-1] NOT IN ('.', '!', '?') AS cut FROM tagged
), word AS (
    SELECT conv_id, i, CASE WHEN blank OR repeated THEN 'x' ELSE role[1] END AS s, CASE WHEN cut THEN {LATE} ELSE 0 END AS late FROM faults
), walk AS (
    SELECT conv_id, 0::BIGINT AS i, '000000000' AS w0, '{far}' AS w1, '{far}' AS w2, '{far}' AS w3 FROM (SELECT DISTINCT conv_id FROM conversations)
    UNION ALL
    SELECT conv_id, i + 1 AS i, {", ".join(f"{step(q)} AS w{q}" for q in states)} FROM ({before})
), last_ AS (
    SELECT conv_id, least(w0, w3) AS w FROM ({after}) QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY i DESC) = 1
), edits AS (
    SELECT conv_id, unnest(string_split(w[10:], '')) AS e, generate_subscripts(string_split(w[10:], ''), 1) AS k FROM last_ WHERE length(w) > 9
), read_ AS (
    SELECT *, sum(CASE WHEN e <> 'I' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY k) AS i FROM edits
), stay AS (
    SELECT r.conv_id, k, e, CASE WHEN e = 'I' THEN NULL ELSE role END AS role, CASE WHEN e = 'I' THEN '' ELSE text END AS text,
        row_number() OVER (PARTITION BY r.conv_id ORDER BY k) AS j FROM read_ r LEFT JOIN placed p ON p.conv_id IS NOT DISTINCT FROM r.conv_id AND p.i = r.i WHERE e <> 'D'
), led AS (
    SELECT *, max(CASE WHEN j = 1 AND e = 'K' AND role[1] = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id) AS system FROM stay
), mended AS (
    SELECT conv_id, string_agg(CASE WHEN e = 'K' THEN role WHEN (j - system) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY j) AS body FROM led GROUP BY conv_id
), counts AS (
    SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (repeated) AS duplicate,
        count(*) FILTER (cut) AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM faults GROUP BY conv_id
)
SELECT l.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
    coalesce(illegal, 0) AS illegal, CAST(w[:9] AS BIGINT) AS cost, w[10:] AS audit, sha256(coalesce(body, '')) AS repaired_sha256
FROM last_ l LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM l.conv_id LEFT JOIN mended m ON m.conv_id IS NOT DISTINCT FROM l.conv_id"""


ORACLE = _oracle()
