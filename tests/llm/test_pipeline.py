from pyspark.sql import functions as F

import corpus_pipeline
from folioflow.llm import registry

from .helpers import docs
from .test_dedup_ops import brute_near


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    cols, left = docs.columns, docs
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "exact_dedup", "near_dedup", "mixing", "packing"]
    for name, stage in corpus_pipeline.STAGES:
        before = left
        left = corpus_pipeline.materialize(stage(spark, before, sf))
        if name == "packing":
            assert {r.doc_id for r in left.collect()} == {r.doc_id for r in before.collect()}
            break
        assert left.columns == cols and left.exceptAll(before).count() == 0
        a, b = ([(r.doc_id, r.text) for r in x.collect()] for x in (before, left))
        if name == "quality":
            model = corpus_pipeline.quality_fm.train(*corpus_pipeline._tables(spark, sf))
            score = {r.doc_id: r.score for r in corpus_pipeline.quality_fm.classify(before, None, model=model).collect()}
            assert sorted(i for i, _ in b) == sorted(i for i, s in score.items() if s >= 0.5)
            good = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
            assert sum(good[i] for i, _ in a if i in good) == sum(good[i] for i, _ in b if i in good) and 0 < len(b) < len(a)
        if name == "exact_dedup":
            best = {}
            for i, t in a:
                best[t] = max(best.get(t, -1), i)
            assert sorted(b) == sorted((i, t) for t, i in best.items())
        if name == "near_dedup":
            near = brute_near(a)
            assert sorted(i for i, _ in b) == sorted(i for i in near if near[i][1] == i)
        if name == "mixing":
            assert corpus_pipeline.mix_rates(spark, before, sf).met
            labels = {r.doc_id: r for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
            gone = {i for i, _ in a} - {i for i, _ in b}
            assert len(b) >= 0.8 * len(a) and all(labels[i].toxic or not labels[i].quality for i in gone if i in labels)


def test_run_gives_the_last_stage(spark, sf):
    out = corpus_pipeline.run(spark, sf)
    assert {"doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"} <= set(out.columns) and out.count() > 0


def test_every_operator_is_registered():
    names = registry.queries()
    assert [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 14)] == [1] * 13


def test_stages_stand_odd_rows(spark, sf):
    """Nulls in any column, empty texts, ties, repeated rows, clashing columns and an empty table, stage by stage."""
    own = ["__score", "___score", "__rate", "__copies", "__i", "__keep", "__key", "__at", "s1", "rep"]
    odd = docs(spark).withColumns({c: F.lit(c) for c in own})
    assert {"n_tokens", "start", "kept", "h", "score"} <= set(odd.columns)
    for name, stage in corpus_pipeline.STAGES:
        out = corpus_pipeline.materialize(stage(spark, odd, sf))
        empty = stage(spark, odd.limit(0), sf)
        assert empty.count() == 0
        if name == "packing":
            assert out.count() >= odd.count() and empty.columns == out.columns
            continue
        assert all(r[c] == c for r in out.select(*own).distinct().collect() for c in own)
        assert out.columns == odd.columns == empty.columns and out.exceptAll(odd).count() == 0
        texts = [(r.doc_id, r.text or "") for r in out.collect()]
        if name == "exact_dedup":
            assert sorted(t for _, t in texts) == sorted({r.text or "" for r in odd.collect()})
        if name == "near_dedup":
            assert sum(i is None for i, _ in texts) == 1 and len([t for i, t in texts if i is not None and not t.split()]) == sum(r.doc_id is not None and not (r.text or "").split() for r in odd.collect())
