"""Subjects: accuracy on held-out labels, and edge cases."""

from pyspark.sql import functions as F

from colloquy.llm import subjects as S


def test_held_out_labels(spark):
    d = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    labels = spark.read.parquet(f"{d}/subject_labels.parquet")
    areas = spark.read.parquet(f"{d}/subject_areas.parquet")
    test = labels.where("doc_id % 2 = 1")
    got = S.subjects(docs, labels.where("doc_id % 2 = 0"), areas)
    want = {tuple(r) for r in test.select("doc_id", "area_code").collect()}
    ids = {x for x, _ in want}
    pairs = {(r.doc_id, r.area_code) for r in got.collect() if r.doc_id in ids}
    hit = len(pairs & want)
    assert hit / len(pairs) > 0.85 and hit / len(want) > 0.85  # a few labels are wrong


def test_the_corpus_pass_decides_rows(spark):
    """Without the pass over the corpus other rows come out, and no better ones."""
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/subject_labels.parquet")
    areas = S.area_notes(spark.read.parquet(f"{d}/subject_areas.parquet"))
    want = {tuple(r) for r in labels.where("doc_id % 2 = 1").select("doc_id", "area_code").collect()}
    rows = [{(r.doc_id, r.area_code) for r in S.Topics(docs, labels.where("doc_id % 2 = 0"), areas, passes=n).assign().collect()} for n in (0, S.PASSES)]
    assert len(rows[0] ^ rows[1]) > 20
    assert len(rows[1] & want) >= len(rows[0] & want)


def test_smoothing_follows_the_corpus_size():
    """Counting a corpus ten times leaves its topics as they are."""
    import numpy as np

    counts = np.random.default_rng(2).random((S.BUCKETS, S.PARTS + S.BACKGROUND)) * 100
    assert np.allclose(S.log_topics(counts), S.log_topics(counts * 10), atol=1e-5)


def test_edges(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "​ 　"), (4, "一。" * 5000), (5, "a" * 100_000)], "doc_id long, text string")
    labels = spark.createDataFrame([(4, "x"), (99, "x"), (1, None)], "doc_id long, area_code string")
    areas = spark.createDataFrame([("x", "x"), ("y", "y")], "area_code string, area_name string")
    assert {r.doc_id for r in S.subjects(docs, labels, areas).collect()} <= {4, 5}
    assert S.subjects(docs.limit(0), labels, areas).count() == 0
    assert S.subjects(docs, labels.limit(0), areas).count() >= 0
    assert S.subjects(docs, labels, areas.limit(0)).count() == 0
    extra = docs.withColumns({c: F.lit("x") for c in ("terms", "sizes", "area_code", "sentences")})
    assert sorted(S.subjects(extra, labels, areas).collect()) == sorted(S.subjects(docs, labels, areas).collect())
    assert S.sentences("好的。好的！ok. yes") == ["好的", "好的", "ok", " yes"]
