import math
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from folioflow.llm import mixing, quality_fm, quality_rules, registry, toxicity

from .helpers import docs, texts


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for n in ("documents", "labels", "embeddings", "conversations"):
        c.execute(f"CREATE VIEW {n} AS SELECT * FROM read_parquet('{sf}/{n}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_its_sql(spark, sf, duck, name):
    df = registry.queries()[name](spark, sf)
    cols = sorted(df.columns)
    res = duck.execute(registry.oracle_sql()[name])
    names = [d[0] for d in res.description]
    norm = lambda v: f"{v:.9g}" if isinstance(v, float) else str(v)
    want = sorted(tuple(norm(dict(zip(names, r, strict=True))[c]) for c in cols) for r in res.fetchall())
    assert sorted(names) == cols and sorted(tuple(norm(r[c]) for c in cols) for r in df.collect()) == want


def brute_rules(t):
    import re

    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    twice = {g for g in grams if grams.count(g) > 1} if len(grams) < 2000 else set(grams)
    return len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len({i + k for i, g in enumerate(grams) if g in twice for k in range(3)})


def test_rules_equal_brute_force(spark):
    got = {(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words): r for r in quality_rules.quality_rules(docs(spark)).collect()}
    want = {(d.doc_id, *brute_rules(d.text)) for d in docs(spark).collect()}
    assert set(got) == want
    for (_, n, _, _, _, rep), r in got.items():
        assert r.base_failed == (n < 50 or 100 * rep > 50 * n) and not (r.base_failed and r.kept)
    assert quality_rules.quality_rules(docs(spark).limit(0)).count() == 0


def held(i):
    return zlib.crc32(str(i).encode()) % 3 == 1


def planted(spark, n=400):
    """Half of the texts are junk, a third hold an insult."""
    r = np.random.default_rng(2)
    rows, labels = [], []
    for i in range(n):
        words = [f"{a}{b}" for a, b in zip(r.choice(["ka", "lo", "mi", "ter"], 60), r.choice(["na", "so", "ri", "pel"], 60), strict=True)]
        good, toxic = int(i % 2), int(i % 3 == 0)
        if not good:
            words = [w + "###" if k % 3 else "|" for k, w in enumerate(words)]
        if toxic:
            words[7] = words[31] = "scumbag"
        rows.append((i, " ".join(words)))
        labels.append((i, good, toxic))
    return docs(spark, rows + [(n, None), (n + 1, ""), (n + 1, "")]), spark.createDataFrame(labels + [(n + 9, 1, 1), (None, 1, 0), (0, None, None)], "doc_id long, quality int, toxic int"), labels


def test_classifiers_learn_and_hold_out(spark):
    d, l, labels = planted(spark)  # noqa: E741
    for op, k, cut in ((quality_fm, 1, 0.5), (toxicity, 2, 0.7)):
        rows = op.classify(d, l).collect()
        by = {r.doc_id: r for r in rows}
        assert len(rows) == 403 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= cut) and r.held_out == held(r.doc_id) for r in rows)
        out = [x for x in labels if held(x[0])]
        assert sum(by[x[0]].predicted == x[k] for x in out) >= 0.97 * len(out)
        assert op.classify(d.limit(0), l).count() == 0
        unlearned = {r.score for r in op.classify(d, l.limit(0)).collect()}
        assert len(unlearned) == 1 and 0 <= min(unlearned) <= 0.5


def test_labels_of_held_out_rows_are_never_read(spark):
    d, l, labels = planted(spark, 120)  # noqa: E741
    flipped = spark.createDataFrame([(i, 1 - q, 1 - t) if held(i) else (i, q, t) for i, q, t in labels], l.schema)
    for op in (quality_fm, toxicity):
        a, b = ({r.doc_id: r.score for r in op.classify(d, x).collect()} for x in (l.where("doc_id > 0 AND doc_id < 120"), flipped.where("doc_id > 0")))
        assert a == b


def test_sum_of_squares_identity():
    r = np.random.default_rng(0)
    k = len(quality_fm.features.STATS)
    m = quality_fm.Machine(4, 0.3, r.normal(size=16), r.normal(size=(16, 3)), r.normal(size=k), r.normal(size=(k, 3)), np.zeros(k), np.ones(k))
    ids, stats = np.array([1, 5, 5, 9]), r.normal(size=(1, k))
    x = np.concatenate((np.full(4, 0.5), stats[0]))
    v, w = np.concatenate((m.v[ids], m.vs)), np.concatenate((m.w[ids], m.ws))
    slow = 0.3 + x @ w + sum(x[i] * x[j] * (v[i] @ v[j]) for i in range(len(x)) for j in range(i))
    assert math.isclose(m.margin(ids, np.array([0, 4]), stats)[0], slow, rel_tol=1e-6)


def _grams(text):
    """Distinct character n-grams as the operator means them: Latin letters in lower case, whole characters."""
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" or ("À" <= c <= "Þ" and c != "×") else c for c in text)
    return {low[i : i + n] for n in toxicity.SIZES for i in range(len(low) - n + 1)}


def _bucket(gram, bits):
    data = np.frombuffer(gram.encode(), np.uint8)
    ((at, _, _),) = toxicity.features.char_ngrams(data, np.array([0, len(data)]), (len(gram),), bits)
    return int(at[0])


def test_toxicity_scores_equal_brute_force(spark):
    """The query's scores, n-gram by n-gram in plain Python: distinct buckets of a text, one weight each."""
    d, l, _ = planted(spark, 90)  # noqa: E741
    rows = texts() + ["ÀÉ×ß scumbag SCUMBAG", "scum", "𝒳" * 9]
    extra = docs(spark, [(1000 + i, t) for i, t in enumerate(rows)])
    model = toxicity.train(d, l)
    assert (model.table != 0).sum() > 5
    got = {r.doc_id: r.score for r in toxicity.classify(d.unionByName(extra), l, model=model).collect()}
    known: dict[str, int] = {}
    for r in d.unionByName(extra).collect():
        grams = _grams(r.text or "")
        for g in grams - known.keys():
            known[g] = _bucket(g, model.bits)
        slow = 0.0
        for n in toxicity.SIZES:
            slow += sum(float(model.table[b]) for b in {known[g] for g in grams if len(g) == n})
        assert math.isclose(got[r.doc_id], 1 / (1 + math.exp(-max(-30, min(30, model.bias + slow)))), rel_tol=1e-5), r.doc_id


def test_toxicity_ratios_equal_brute_force():
    """Weights carry the naive Bayes ratio of each n-gram's shares; rare and weak n-grams weigh nothing."""
    r = np.random.default_rng(4)
    y = np.array([1, 0] * 60)
    sets = [np.unique(np.concatenate((r.integers(8, 64, 6), [1] if label else [2], [3]))).astype(np.int32) for label in y]
    sets[0] = np.append(sets[0], 70).astype(np.int32)
    m = toxicity.fit(y, sets, 7)
    for g in range(128):
        pos, neg = (sum(g in s for s, label in zip(sets, y, strict=True) if label == k) for k in (1, 0))
        ratio = math.log((pos + 1) / 62) - math.log((neg + 1) / 62)
        if pos + neg < 8 or abs(ratio) < 1.5:
            assert m.table[g] == 0, g
        else:
            assert m.table[g] * ratio > 0, g
    assert m.table[1] > 0 > m.table[2] and m.table[3] == m.table[70] == 0


def test_accuracy_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r.doc_id: r for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    quality = [r for r in registry.op9_quality_classifier(spark, sf).collect() if r.held_out and r.doc_id in labels]
    assert sum(r.predicted == labels[r.doc_id].quality for r in quality) >= 0.95 * len(quality)
    toxic = [r for r in registry.op8_toxicity(spark, sf).collect() if r.held_out and r.doc_id in labels]
    assert sum(r.predicted == labels[r.doc_id].toxic for r in toxic) >= 0.9 * len(toxic)
    assert all(labels[r.doc_id].toxic for r in toxic if r.predicted)


def brute_mix(p, n, targets, low, high):
    """Least squares by many plain projected-gradient steps."""
    a = n[:, None] * p
    r = np.ones(len(p))
    step = 1 / np.linalg.eigvalsh(p.T @ a).max()
    for _ in range(20_000):
        r = np.clip(r - step * (p @ (a.T @ r - targets)), low, high)
    return r


@pytest.mark.parametrize("low,high,tokens", [(0.0, math.inf, None), (0.0, 1.0, None), (0.0, math.inf, 40_000.0)])
def test_mixing_meets_its_targets(spark, low, high, tokens):
    d, l, _ = planted(spark, 200)  # noqa: E741
    model = mixing.train(d, l, mixing.domain_of_labels())
    weights = {"clean": 0.6, "low": 0.3, "toxic": 0.1}
    narrow = mixing.posteriors(d, model)
    mix = mixing.fit_rates(narrow, model, weights, tokens, low, high, max_steps=400, tolerance=1e-6)
    rows = mixing.rated(narrow, mix).collect()
    p, n, r = np.array([x.p for x in rows]), np.array([x.n for x in rows], float), np.array([x.rate for x in rows])
    assert np.allclose(p.sum(1), 1) and (r >= low).all() and (r <= high).all()
    # Many rates reach the same totals; how near they come to the targets is what is unique.
    miss = lambda x: np.linalg.norm((n * x) @ p - mix.targets) / mix.targets.sum()
    assert miss(r) <= miss(brute_mix(p, n, mix.targets, low, high)) + 1e-3
    assert high < math.inf or miss(r) < 1e-3
    assert all(math.floor(x.rate) <= x.copies <= math.ceil(x.rate) for x in rows)


def test_mixing_odd_tables(spark):
    d, l, _ = planted(spark, 60)  # noqa: E741
    domain = mixing.domain_of_labels()
    one = mixing.mixing_rates(d, l.limit(0), domain, {"all": 1.0})
    assert all(abs(r.rate - 1) < 1e-6 and r.copies == 1 for r in one.collect())
    assert mixing.mixing_rates(d.limit(0), l, domain, {"clean": 1.0}).count() == 0
    odd = docs(spark)
    assert mixing.mixing_rates(odd, l, domain, {"clean": 1.0}).count() == len(texts()) + 2
    model = mixing.train(d, l, domain)
    twice = mixing.mixed(d, mixing.fit_rates(mixing.posteriors(d, model), model, {"clean": 1.0, "low": 1.0, "toxic": 1.0}, tokens=2 * 60 * 60.0))
    assert twice.columns == d.columns and twice.count() > d.count()


def test_op1_mixing_meets_its_own_targets(spark):
    sf, weights = "/root/testdata/sf0.1", {"clean": 0.9, "low": 0.04, "toxic": 0.06}
    rows = registry.op1_mixing(spark, sf).collect()
    n, r = np.array([x.n_tokens for x in rows], float), np.array([x.rate for x in rows])
    for d, w in weights.items():
        total = (n * r) @ np.array([x[f"p_{d}"] for x in rows])
        assert abs(total - w * n.sum()) <= 1.01e-4 * n.sum(), d


def test_mixing_warns_of_targets_out_of_reach(spark):
    d, l, _ = planted(spark, 60)  # noqa: E741
    model = mixing.train(d, l, mixing.domain_of_labels())
    narrow = mixing.posteriors(d, model)
    with pytest.warns(UserWarning, match="cannot meet the targets"):
        mix = mixing.fit_rates(narrow, model, {"clean": 1.0}, tokens=1e6, high=1.0)
    assert not mix.met and mixing.fit_rates(narrow, model, {"clean": 0.6, "low": 0.3, "toxic": 0.1}).met
    with pytest.raises(RuntimeError):
        mixing.fit_rates(narrow, model, {"clean": 0.6, "low": 0.3, "toxic": 0.1}, max_steps=1)


def test_sample_holds_every_one_of_many_labels(spark):
    rows = [(i, i % 150) for i in range(1800)]
    labels = spark.createDataFrame(rows, "doc_id long, k int")
    d = docs(spark, [(i, f"text {i}") for i, _ in rows])
    got = {}
    for r in mixing.features.labelled_sample(d, labels, "k", 3).collect():
        got.setdefault(r.label, set()).add(r.doc_id)
    assert {k: len(v) for k, v in got.items()} == {k: min(3, sum(not held(i) for i in range(k, 1800, 150))) for k in range(150)}
    few = {}
    for r in mixing.features.labelled_sample(d, labels.where("k < 5"), "k", 3).collect():
        few.setdefault(r.label, set()).add(r.doc_id)
    assert few == {k: got[k] for k in range(5)}
    with pytest.raises(ValueError):
        mixing.train(d, labels, F.col("doc_id").cast("string"))


def test_sample_stays_bounded_where_a_labelled_id_is_repeated(spark):
    rows = [(7, f"text {i % 5} of many") for i in range(20_000)] + [(i, "other") for i in range(100, 120)]
    labels = spark.createDataFrame([(7, 1), *[(i, i % 2) for i in range(100, 120)]], "doc_id long, k int")
    got = mixing.features.labelled_sample(docs(spark, rows), labels, "k", 10).collect()
    assert len(got) == len({r.doc_id for r in got}) <= 20 and [r.text for r in got if r.doc_id == 7][0].startswith("text ")


def test_copies_stand_columns_of_any_name(spark):
    d, l, _ = planted(spark, 60)  # noqa: E741
    odd = d.withColumns({c: F.lit(c) for c in ("__rate", "__copies", "__i", "__score")})
    model = mixing.train(d, l, mixing.domain_of_labels())
    mix = mixing.fit_rates(mixing.posteriors(odd, model), model, {"clean": 1.0, "low": 1.0, "toxic": 1.0}, tokens=2 * 60 * 60.0)
    out = mixing.mixed(odd, mix)
    assert out.columns == odd.columns and {tuple(r) for r in out.select("__rate", "__copies", "__i").distinct().collect()} == {("__rate", "__copies", "__i")}
    good = quality_fm.keep_good(odd, quality_fm.train(d, l))
    assert good.columns == odd.columns and 0 < good.count() < odd.count()


def test_policy_is_within_reach(spark):
    d, l, _ = planted(spark, 200)  # noqa: E741
    model = mixing.train(d, l, mixing.domain_of_labels())
    narrow = mixing.posteriors(d, model)
    weights, tokens = mixing.policy(narrow, model, "clean")
    mix = mixing.fit_rates(narrow, model, weights, tokens=tokens, high=1.0)
    rates = {tuple(r.p): r.rate for r in mixing.rated(narrow, mix).collect()}
    at = model.domains.index("clean")
    assert mix.met and all(r > 0.99 for p, r in rates.items() if p[at] > 0.7) and all(r < 0.01 for p, r in rates.items() if p[at] < 0.3)
    assert mixing.policy(narrow.limit(0), model, "clean")[1] == 0


def test_quality_scores_equal_brute_force(spark):
    """The query's scores from all pairs of inputs, word by word in plain Python."""
    d, l, _ = planted(spark, 90)  # noqa: E741
    rows = texts()[:40] + ["one two two", "word"]
    m = quality_fm.train(d, l)
    got = {r.doc_id: r.score for r in quality_fm.classify(docs(spark, list(enumerate(rows))), l, model=m).collect()}
    f = quality_fm.features
    for i, t in enumerate(rows):
        buf = np.frombuffer((t or "").encode(), np.uint8)
        words = [w.lower() if w.isascii() else "".join(c.lower() if c.isascii() else c for c in w) for w in (t or "").translate(dict.fromkeys(range(9, 14), " ")).split(" ") if w]
        ids = np.array([f.word_ids(np.frombuffer(w.encode(), np.uint8), np.array([0, len(w.encode())]), m.bits)[0][0] for w in words], int)
        if len(ids) > 400:
            continue
        z = (f.structure(buf, np.array([0, len(buf)]))[0] - m.mean) / m.scale
        x = np.concatenate((np.full(len(ids), 1 / math.sqrt(max(len(ids), 1))), z))
        v, w = np.concatenate((m.v[ids], m.vs)), np.concatenate((m.w[ids], m.ws))
        g = (v @ v.T) * np.outer(x, x)
        margin = m.bias + x @ w + (g.sum() - np.trace(g)) / 2
        assert math.isclose(got[i], 1 / (1 + math.exp(-margin)), rel_tol=1e-4, abs_tol=1e-5), t
