"""Mixtures: shares within the caps."""

from colloquy.llm.mixture import Mixture

D = "doc_id long, source string, text string"
T = "source string, target_share double, max_repeats int"


def test_shares(spark):
    docs = [(i, "a" if i % 10 else "b", "shoe " * (1 + i % 7)) for i in range(6000)] + [(9001, "c", None), (9002, "z", "shoe"), (9003, None, "shoe")]
    mix = Mixture(spark.createDataFrame(docs, D), spark.createDataFrame([("a", 0.5, 1), ("b", 0.3, 3), ("c", 0.2, 2)], T))
    report = {r.source: r for r in mix.report().collect()}
    assert abs(report["a"].actual_share - 0.625) < 0.005 and abs(report["b"].actual_share - 0.375) < 0.005
    assert report["a"].reached and report["b"].reached and not report["c"].reached and report["c"].tokens == 0
    assert sum(r.sets_size for r in report.values()) == 1 and not report["c"].sets_size
    rows = mix.documents.collect()
    assert {r.source for r in rows} == {"a", "b"}
    assert max(r.copies for r in rows if r.source == "b") <= 3 and max(r.copies for r in rows if r.source == "a") == 1
    again = Mixture(spark.createDataFrame(docs, D), spark.createDataFrame([("a", 0.5, 1), ("b", 0.3, 3), ("c", 0.2, 2)], T))
    assert {tuple(r) for r in again.documents.collect()} == {tuple(r) for r in rows}


def test_size_given_and_short_sources(spark):
    docs = [(i, "a", "shoe shoe") for i in range(1000)] + [(5000 + i, "b", "shoe") for i in range(10)]
    mix = Mixture(spark.createDataFrame(docs, D), spark.createDataFrame([("a", 0.5, 1), ("b", 0.5, 2)], T), size=1000)
    report = {r.source: r for r in mix.report().collect()}
    assert report["b"].tokens == 40 and report["b"].most_copies == 2 and not report["b"].reached
    assert abs(report["a"].tokens - 500) <= 2


def test_empty(spark):
    assert Mixture(spark.createDataFrame([], D), spark.createDataFrame([("a", 1.0, 1)], T)).documents.count() == 0
    assert Mixture(spark.createDataFrame([(1, "a", "x")], D), spark.createDataFrame([], T)).documents.count() == 0


def test_more_ranges_than_eight(spark):
    """Budgets end between documents of very different length: all that fits is taken."""
    docs = [(i, "a", "shoe " * (700 if i % 3 else 1 + i % 5)) for i in range(3000)]
    mix = Mixture(spark.createDataFrame(docs, D), spark.createDataFrame([("a", 1.0, 1)], T), size=1_000_500)
    plan = mix.plan[0]
    left = 1_000_500 - sum(r.n_tokens * r.copies for r in mix.documents.collect())
    rest = mix.tokens.count() - mix.documents.count()
    assert 0 <= left < 700 and rest > 0 and len(plan["ranges"]) > 8
    used = {r.doc_id for r in mix.documents.collect()}
    assert left < 1 or all(r.n_tokens > left for r in mix.tokens.collect() if r.doc_id not in used)
