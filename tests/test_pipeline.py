"""The candidate pipeline, lineage of roles, source checks, folded keys and digests."""

import hashlib
import json

from pyspark.sql import functions as F

from colloquy.functions import text
from colloquy.operators import turns
from colloquy.plans import pipeline
from colloquy.sources import files


def test_every_pair_has_one_outcome(spark):
    rows = [
        ("s1", 1, "鞋码偏大吗", "正常码，按平时尺码拍"), ("s1", 2, "鞋码偏大吗", "正常码"), ("s2", 1, "鞋码偏大吗。", "正常码呢"), ("s2", 2, "什么时候发货", None), ("s3", 1, "", "在的"), ("s3", 2, "在吗", "在的，请讲"),
        ("s3", 3, "请问多久发货", "好的"), ("s4", 1, "南浦旗舰店电话13812345678", "联系人：王小明"), ("s5", 1, None, None), ("s6", 1, "长" * 50_000, "好的呢，已经登记"),
    ]
    pairs = spark.createDataFrame(rows, "session_id string, qa_ordinal int, merged_question string, merged_answer string")
    done = pipeline.candidates(pairs, F.lit("x"), stores=["南浦旗舰店"]).cache()
    got = {(r.session_id, r.qa_ordinal): r for r in done.collect()}
    want = {("s1", 1): None, ("s1", 2): "exact_duplicate", ("s2", 1): "normalized_duplicate", ("s2", 2): "missing_service_response", ("s3", 1): "empty_question", ("s3", 2): "invalid_short_input", ("s3", 3): "empty_answer", ("s4", 1): None, ("s5", 1): "missing_service_response", ("s6", 1): None}
    assert {k: r.reason for k, r in got.items()} == want
    private = got["s4", 1]
    assert private.question == "[EXTERNAL_STORE]电话[LONG_NUMBER]" and private.answer == "联系人：[NAME]" and private.pii_types == "LONG_NUMBER;NAME;STORE_IDENTITY"
    assert {r.outcome: r.pairs for r in pipeline.account(done).collect()}["accepted"] == 3
    assert {r.invariant: r.violations for r in pipeline.violations(pairs, done, ["南浦旗舰店"]).collect()} == {"accounting": 0, "candidate_id": 0, "private_marker": 0, "residual": 0}
    broken = done.withColumn("question", F.lit("南浦旗舰店 a@b.example")).unionByName(done)
    assert all(r.violations > 0 for r in pipeline.violations(pairs, broken, ["南浦旗舰店"]).collect())
    assert pipeline.candidates(pairs.limit(0), F.lit("x")).count() == 0


def test_lineage(spark):
    senders = spark.createDataFrame([("p", 9, 0.1, 0.9, 3), ("q", 5, 0.2, 0.8, 4)], "who string, sessions long, first_ratio double, last_ratio double, threshold long")
    rule, word = "statistical_sender_rule", "legacy_keyword"
    rows = [(1, rule, "p"), (1, rule, "q"), (1, rule, "p"), (2, word, "p"), (3, word, "x"), (3, rule, "p"), (4, None, "p"), (4, rule, "p"), (5, rule, None)]
    got = {r.g: tuple(r)[1:] for r in turns.answer_lineage(spark.createDataFrame(rows, "g int, how string, who string"), ["g"], "how", "who", senders).collect()}
    none = (None,) * 4
    assert got == {1: (rule, 2, 5, 4, 0.2, 0.8), 2: (word, 0, *none), 3: ("mixed", 1, 9, 3, 0.1, 0.9), 4: ("unresolved", 1, 9, 3, 0.1, 0.9), 5: (rule, 0, *none)}


def test_source_problems(spark):
    df = spark.createDataFrame([("/x/店铺1月.txt", 10), ("/x/a-02.txt", 0), ("/x/b2月.txt", 5), ("/x/readme.txt", 5)], "path string, length long")
    got = [tuple(r) for r in files.source_problems(df, [1, 2, 3]).collect()]
    assert sorted(p for p, _ in got) == ["empty_file", "missing_month", "no_month", "repeated_month"]
    assert ("missing_month", "3") in got and ("repeated_month", "2") in got and not any("x" in d and "/" in d for _, d in got)
    assert {p for p, _ in map(tuple, files.source_problems(df.limit(0), [1]).collect())} == {"missing_month"}


def test_folded_key_and_digest(spark):
    df = spark.createDataFrame([("Ｈｅｌｌｏ　呢呢呢？", 1), ("ﬁt 吗吗", None), (None, 2), ("", 3)], "t string, n int")
    got = df.select(text.folded_key(F.col("t")).alias("k"), files.canonical_digest("d", [F.col("t"), F.col("n")]).alias("h"), "t", "n").collect()
    assert [r.k for r in got] == ["hello呢", "fit吗", "", ""]
    for r in got:
        want = {"domain": "d", "parts": [r.t, None if r.n is None else str(r.n)]}
        assert r.h == hashlib.sha256(json.dumps(want, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()
