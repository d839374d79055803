"""Gates, staged samples, recovery, paired analyses: nulls, ties, repeats and empty tables."""

import pytest
from pyspark.sql import functions as F

from colloquy.operators import catalog, gates, masking, review, sampling, stats


def test_gates(spark):
    rows = [(None,), ("",), ("？？",), ("好的！",), ("[PHONE]",), ("[URL] [IMAGE_LINK]；",), ("[NAME] 吗",), ("[NAME] 尺码",), ("鞋码偏大吗",), ("尺码。",), ("长" * 100_000,)]
    df = spark.createDataFrame(rows, "t string")
    got = [tuple(r) for r in df.select(gates.question_problem(F.col("t"), ["尺码"]), gates.answer_problem(F.col("t")), gates.bare_keyword(F.col("t"))).collect()]
    bad, private, no = "empty_or_invalid_question", "pii_only_question", "empty_or_invalid_answer"
    assert got == [(bad, no, None), (bad, no, None), (bad, no, None), (bad, no, None), (bad, None, None), (bad, None, None), (private, None, None), (None, None, None), (None, None, None), (None, None, "尺码"), (None, None, None)]
    pair = lambda q, a, c, left: gates.pair_problem(F.lit(q), F.lit(a), F.lit(c), F.lit(left), [])
    one = spark.range(1).select(pair("好吃吗", "很好吃", "x", True), pair("", "很好吃", "x", False), pair("??", "很好吃", "x", False), pair("好吃吗", "好的", "x", False), pair("好吃吗", "很好吃", " ", False), pair("好吃吗", "很好吃", "x", False)).first()
    assert tuple(one) == ("pii_residual", "empty_question", "invalid_short_input", "empty_answer", "missing_category", None)


def test_staged_sample(spark):
    rows = [(f"c{i}", f"s{i % 5}", i % 2 == 0) for i in range(40)] + [(None, "s9", True), ("c99", None, True)]
    df = spark.createDataFrame(rows, "key string, session string, even boolean")
    stages = [sampling.Stage("a", F.col("even"), 2), sampling.Stage("b", F.lit(True), 9, exact=False)]
    got = sampling.staged(df, "key", "session", stages).collect()
    assert len(got) == 5 and len({r.session for r in got}) == 5 and [r.stage for r in got] == ["a", "a", "b", "b", "b"]
    assert all(int(r.key[1:]) % 2 == 0 for r in got if r.stage == "a")
    again = sampling.staged(df.orderBy(F.rand(3)).withColumns({"h": F.lit(1), "_m": F.lit(1)}), "key", "session", stages).collect()
    assert again == got
    with pytest.raises(ValueError):
        sampling.staged(df, "key", "session", [sampling.Stage("a", F.lit(True), 6)])
    assert sampling.staged(df.limit(0), "key", "session", [sampling.Stage("a", F.lit(True), 6, exact=False)]).count() == 0


def test_recovery(spark):
    j = spark.createDataFrame([("a", "prepared", 1), ("b", "prepared", 1), ("b", "retryable_failed", 2), ("c", "retryable_failed", 3), ("d", "committed", 1), ("e", "call_started", 1), ("f", "uncertain", 1), (None, "prepared", 1), ("z", "prepared", 1)], "u string, state string, attempt int")
    units = spark.createDataFrame([(x,) for x in "abcdefghb"], "u string")
    proof = spark.createDataFrame([("d",), ("d",), ("e",), ("g",), (None,)], "u string")
    got = {r.u: (r.journals, r.decision) for r in review.recovery(units, j, proof, "u", "state", "attempt").collect()}
    assert got == {
        "a": (1, "continue_before_provider"), "b": (2, "retry"), "c": (1, "fail_closed"), "d": (1, "confirmed"), "e": (1, "reconcile_committed"), "f": (1, "fail_closed"), "g": (0, "authoritative_success"), "h": (0, "begin"),
    }
    again = review.next_attempts(review.recovery(units, j, proof, "u", "state", "attempt"), "u")
    assert {tuple(r) for r in again.collect()} == {("b", 3, "prepared"), ("h", 1, "prepared")}
    assert review.recovery(units.limit(0), j, proof, "u", "state", "attempt").count() == 0


def test_paired(spark):
    rows = [(u, "x", True, 1.0) for u in range(8)] + [(u, "y", u < 2, 3.0) for u in range(8)] + [(9, "x", True, 1.0), (10, "y", None, None), (10, "x", True, 2.0)]
    df = spark.createDataFrame(rows, "u int, arm string, ok boolean, score double")
    r = stats.paired_outcomes(df, "u", "arm", ("x", "y"), {"ok": F.col("ok")}).first()
    assert (r.both, r.first_only, r.second_only, r.neither) == (2, 6, 0, 0) and r.p_value == pytest.approx(0.03125) == r.adjusted
    s = stats.paired_scores(df, "u", "arm", ("x", "y"), ["score"]).first()
    assert (s.n, s.mean_difference, s.w_plus, s.p_value) == (8, 2.0, 36.0, pytest.approx(2 / 256))
    assert stats.paired_outcomes(df.limit(0), "u", "arm", ("x", "y"), {"ok": F.col("ok")}).count() == 0
    k = stats.reliability(df.where("arm = 'x'"), df.where("arm = 'x'"), "u", ["ok", "score"])
    assert {x.dimension: (x.n, x.observed) for x in k.collect()} == {"ok": (10, 1.0), "score": (10, 1.0)}


def test_unit_categories(spark):
    units = spark.createDataFrame([("a", None), ("b", "a"), ("c", "b"), ("d", "c"), ("e", None), ("f", None), (None, "a")], "u string, before string")
    j = spark.createDataFrame([("b", "prepared", 1), ("d", "prepared", 1), ("e", "retryable_failed", 3), ("f", "retryable_failed", 1)], "u string, s string, n int")
    done = spark.createDataFrame([("a",), ("a",), (None,)], "u string")
    got = review.unit_category(units, j, done, "u", "s", "n", "before")
    assert {tuple(r) for r in got.collect()} == {("a", "successful"), ("b", "continuable"), ("c", "waiting"), ("d", "waiting"), ("e", "permanent"), ("f", "retryable")}
    p = {(r.category, r.level): r.units for r in review.progress(got).collect()}
    assert p[None, 1] == 6 and p["waiting", 0] == 2


def test_evaluation(spark):
    specs = spark.createDataFrame([("k", ["x"], ["yes"], ["no"]), ("any", None, None, None)], "k string, kinds array<string>, any_of array<string>, none_of array<string>")
    rows = [("k", "x", "yes"), ("k", "x", "hm"), ("k", "y", "yes no"), ("k", None, None), ("any", "z", None), ("other", "x", "yes"), (None, "x", "yes")]
    got = review.evaluate(spark.createDataFrame(rows, "k string, kind string, said string"), specs, "k", "said", "kind")
    assert sorted((r.k, r.said or "", "|".join(r.failed), r.score) for r in got.collect()) == [("any", "", "", 2), ("k", "", "kind|missing", 0), ("k", "hm", "missing", 1), ("k", "yes", "", 2), ("k", "yes no", "kind|forbidden", 0)]
    cases = review.case_verdicts(spark.createDataFrame([("a", True), ("a", None), ("b", True), (None, True)], "c string, ok boolean"), "c", F.col("ok"))
    assert {tuple(r) for r in cases.collect()} == {("a", 2, False), ("b", 1, True)}


def test_blinded(spark):
    df = spark.createDataFrame([("s", "a", 1), ("s", "a", 1), ("s", "b", 2), ("t", "a", 3), (None, "a", 4), ("s", None, 5)], "section string, key string, x int")
    sheet, mapping = masking.blinded(df, "section", "key", b"k", "b_")
    assert "key" not in sheet.columns and sheet.count() == mapping.count() == 4
    places = sorted((r.section or "", r.place) for r in sheet.collect())
    assert places == [("", 1), ("s", 1), ("s", 2), ("t", 1)]


def test_payload_errors_and_key_function(spark):
    schema = "product_id string, identity struct<name:string,category:string>, pricing struct<display_price:double>, variants array<struct<variant_id:string,available_sizes:array<int>>>, media struct<gallery:array<struct<asset_ref:string>>>, functions map<string,struct<level:string>>"
    rows = [
        ("ok", ("n", "c"), (1.0,), [("v", [40])], ([("a/b.png",)],), {"grip": ("High",)}),
        ("null", None, None, None, None, None),
        ("bad", (" ", None), (0.0,), [("v", []), ("v ", [None]), None, (" ", [1])], ([("../a.png",), None],), {"grip": ("?",), "air": (None,)}),
    ]
    df = spark.createDataFrame(rows, schema)
    got = {}
    for r in catalog.payload_errors(df, ["high", "low"]).collect():
        got.setdefault(r.product_id, set()).add(r.problem)
    assert got == {
        "null": {"missing_name", "missing_category", "price_not_positive", "no_variants"},
        "bad": {"missing_name", "missing_category", "price_not_positive", "missing_variant_id", "duplicate_variant_id", "variant_without_sizes", "unsafe_reference", "unknown_level"},
    }
    ties = spark.createDataFrame([("p", {"air": ("high",), "grip": ("high",), "warm": ("low",)})], "product_id string, functions map<string,struct<level:string>>")
    assert catalog.key_function(ties, {"high": 2, "low": 1}).first().key_function == "air"
    assert catalog.key_function(ties, {"high": 2, "low": 1}, ["warm", "grip"]).first().key_function == "grip"
