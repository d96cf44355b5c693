from collections import Counter

import corpus_pipeline
from lexspark.llm import common, neardup, quality, secrets

from . import brute
from .test_neardup import above_the_block, single_band
from .test_tokens import check_packed


def test_run_equals_brute_force(spark, small):
    """Each stage's decisions by brute force (the network's scores and the battery's spans are taken as they are)."""
    frame = common.table(spark, small, "documents")
    net = quality.fit(frame, common.table(spark, small, "labels"))
    docs = sorted((r.doc_id, r.text) for r in frame.collect())
    docs = [(d, t) for d, t in docs if quality.scores(net, [(t or "").encode()])[0] >= 0.3]
    kept = brute.near_groups(docs)
    docs = [(d, t) for d, t in docs if kept[d][2]]
    items = [(r.item_id, r.text) for r in common.table(spark, small, "benchmark").collect()]
    gone = {d for d, _ in brute.leaks(docs, items)}
    docs = {d: t or "" for d, t in docs if d not in gone}
    tested = [x for t in docs.values() for x in secrets.tested(t, secrets.base_spans(t))]
    least = secrets.threshold(Counter(secrets._bin(q) for _, _, q in tested), sum(e - s for s, e, _ in tested) or 1)
    docs = {d: secrets.masked(t, least) for d, t in docs.items()}
    rows = corpus_pipeline.run(spark, small).collect()
    assert check_packed(rows, docs) > 0.97 and len(docs) < 200


def test_stages_keep_the_columns(spark, small, no_docs):
    docs = common.table(spark, small, "documents")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, small).columns == docs.columns
        assert stage(spark, docs.where("false"), small).collect() == []


def test_quality_decides_on_texts_alone(spark, small):
    docs = common.table(spark, small, "documents")
    other = docs.withColumn("doc_id", docs.doc_id + 10**6)
    net = quality.fit(docs, common.table(spark, small, "labels"))
    a, b = (sorted(r.score for r in quality.scored(x, net, ["doc_id"]).collect()) for x in (docs, other))
    assert a == b


def test_stages_hold_odd_rows(spark, small, odd_docs):
    """Null and long texts, repeated and null ids, and columns with clashing names pass every stage; rows differ from one another in `size`."""
    known = set(range(odd_docs.count()))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, odd_docs, small)
        assert got.columns == odd_docs.columns
        rows = got.collect()
        left = [r["size"] for r in rows]
        assert len(left) == len(set(left)) and set(left) <= known
        if name == "near-dedup":  # one of each pair of copies goes
            assert len(left) == len(known) - 2
        if name in ("decontamination", "secret scan"):
            assert set(left) == known and sum(r.text is None for r in rows) == 1
    assert corpus_pipeline.STAGES[-1][1](spark, odd_docs, small).count() >= len(known)


def test_near_copies_go_whatever_the_size_of_their_bucket(spark, small, monkeypatch):
    docs = spark.createDataFrame([(*r, "en") for r in single_band()], "doc_id long, text string, lang string")
    for block in (2048, 1):
        monkeypatch.setattr(neardup, "BLOCK", block)
        assert [r.doc_id for r in corpus_pipeline.unique(spark, docs, small).collect()] == [1]


def test_near_copies_go_from_a_bucket_above_the_real_block(spark, small):
    docs = spark.createDataFrame([(*r, "en") for r in above_the_block()], "doc_id long, text string, lang string")
    assert [r.doc_id for r in corpus_pipeline.unique(spark, docs, small).collect()] == [1]
