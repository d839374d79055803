"""Operators of the core on small fixtures."""

import random
from difflib import SequenceMatcher

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import Row
from pyspark.sql import functions as F

from colloquy.functions import text
from colloquy.operators import catalog, dedup, masking, retrieval, review, rules, sampling, stats, turns


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"c {kind}").select(f(F.col("c")).alias("r")).first().r


@pytest.mark.parametrize(
    ("value", "want"),
    [("　你好，亲！ ", "你好亲"), ("Hi there...", "hithere"), ("a\xa0b—c", "ab—c"), (None, ""), ("", ""), ("１２ ３", "１２３"), ("ß", "ß")],
)
def test_key(spark, value, want):
    assert one(spark, value, text.key) == want


def test_text_functions(spark):
    assert one(spark, "　x\xa0", text.strip) == "x"
    assert one(spark, "YES ", text.flag) is True and one(spark, None, text.flag) is False and one(spark, "?", lambda c: text.flag(c, True)) is True
    assert one(spark, " ", text.or_other) == "其他" and one(spark, None, text.or_other) == "其他"
    assert one(spark, "https://a.b/c；[图片]", text.only_links) is True and one(spark, "看 https://a.b", text.only_links) is False and one(spark, "", text.only_links) is False
    assert one(spark, "你好", lambda c: text.clean_customer(c, ["你好"])) == "" and one(spark, "第一行\r\n 第二行；", lambda c: text.clean_customer(c, [])) == "第一行；第二行"
    assert one(spark, "#E-s12 马上发货。", lambda c: text.clean_service(c, ["稍等"], "不支持")) == "马上发货" and one(spark, "#E-s12", lambda c: text.clean_service(c, [], "不支持")) == ""
    assert one(spark, "什么时候发货？什么时候发货；怎么办。退货", lambda c: text.key_phrases(c, ["怎么办"])) == ["什么时候发货", "退货"]
    assert one(spark, "退货要运费吗", lambda c: text.keywords_in(c, ["运费", "退货", "x"])) == ["运费", "退货"]
    assert one(spark, "a.c", lambda c: text.contains_any(c, ["a.c"])) is True and one(spark, "abc", lambda c: text.contains_any(c, ["a.c"])) is False and one(spark, None, lambda c: text.contains_any(c, ["a"])) is False
    assert one(spark, "发货3双", lambda c: text.specificity(c, ["发货"])).asDict() == {"keywords": 1, "digits": 1, "length": 4}
    assert one(spark, "a\x07  b\n\n c", text.squeeze) == "a b\nc"
    assert one(spark, "x" * 100_000, text.summary) == "x" * 96


def test_rules(spark):
    assert one(spark, "退货要运费吗", lambda c: rules.first_match(c, rules.CATEGORIES)) == "退货退款"
    assert one(spark, "退货要运费吗", lambda c: rules.all_matches(c, rules.CATEGORIES)) == ["退货退款", "运费"]
    assert one(spark, None, lambda c: rules.classify(c, F.lit("开胶了"))) == "质量问题" and one(spark, "x", lambda c: rules.classify(c, F.lit(None).cast("string"))) == "其他"
    assert one(spark, "怎么办", lambda c: rules.rejections(c, F.lit("好的"), ["发货"], ["怎么办"], ["好的"])) == ["context_missing", "too_short_question", "bad_answer"]
    for value, want in (("", "empty"), (None, "empty"), ("。。", "punctuation_only"), ("你", "too_short"), ("你好", "greeting"), ("https://a.b", "link_only"), ("[PHONE] [EMAIL]", "pii_only"), ("什么时候发货", None)):
        assert one(spark, value, lambda c: rules.gate(c, ["你好"])) == want, value
    assert one(spark, "加我微信转账", lambda c: rules.named_patterns(c, {"contact": "微信", "pay": "转账|付款", "x": "y"})) == ["contact", "pay"]
    df = spark.createDataFrame([("a", ["r"], "b"), ("c", [], None), ("d", ["r"], None)], "content string, risks array<string>, better string")
    got = sorted((r.content, r.status, r.final_content) for r in rules.rewrite_rows(df, F.col("risks"), F.col("better")).collect())
    assert got == [("a", "rejected", "a"), ("a", "rewritten", "b"), ("c", "accepted", "c"), ("d", "rejected", "d")]


def test_turns_and_pairs(spark):
    rows = [("s", i, r, t, f"t{i}") for i, (r, t) in enumerate([("customer", "在吗"), ("customer", "什么时候发货"), ("customer", "什么时候发货？"), ("service", "今天"), ("customer", "好"), ("service", ""), ("service", "嗯"), ("customer", "尺码呢")])]
    df = spark.createDataFrame([*rows, (None, 1, "customer", "x", "t")], "session string, n int, role string, content string, at string")
    assert [(r.turn_no, r.role, r.messages) for r in turns.turns(df, "session", "role", [F.col("n")]).orderBy("turn_no").collect()] == [(1, "customer", 3), (2, "service", 1), (3, "customer", 1), (4, "service", 2), (5, "customer", 1)]
    got = turns.qa_pairs(df, "session", "role", "content", "at", [F.col("n")]).orderBy("qa_ordinal").collect()
    assert [(r.merged_question, r.merged_answer, r.customer_messages, r.service_messages) for r in got] == [("在吗；什么时候发货", "今天", 2, 1), ("好", "嗯", 1, 1), ("尺码呢", None, 1, 0)]
    assert (got[0].question_time_start, got[0].question_time_end, got[0].answer_time_end) == ("t0", "t2", "t3")
    assert turns.qa_pairs(df.limit(0), "session", "role", "content", "at", [F.col("n")]).count() == 0


def test_service_senders(spark):
    rows = [(f"s{i}", n, who) for i in range(10) for n, who in enumerate(["c%d" % i, "agent", "c%d" % i, "agent"])]
    got = turns.infer_service_senders(spark.createDataFrame(rows, "session string, n int, sender string"), "session", "sender", [F.col("n")]).collect()
    assert [(r.sender, r.sessions, r.first_ratio, r.last_ratio, r.threshold) for r in got] == [("agent", 10, 0.0, 1.0, 3)]


def test_keep_first_equals_the_sequential_rule(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice(["Hi!", "hi", "HI ", "x", "x.", None, "", "。"])) for i in range(200)]
    seen, want = {}, {}
    for i, t in rows:
        k = (t or "").lower().replace("!", "").replace(" ", "").replace(".", "").replace("。", "")
        want[i] = None if not k or k not in seen else "exact" if seen[k] == t else "normalized"
        seen.setdefault(k, t)
    got = dedup.keep_first(spark.createDataFrame(rows, "i int, t string"), "t", [F.col("i")]).collect()
    assert {r.i: r.dup_reason for r in got} == want


def test_incremental(spark):
    rows = [
        ("a", 1, "鞋子什么时候发货", "今天下午就会发出的亲", "物流发货", 1), ("a", 2, "鞋子什么时候发货呢亲", "今天下午就会发出的亲", "物流发货", 2), ("a", 3, "请问鞋子什么时候发货呢亲，地址在南浦", "今天下午就会发出的亲", "物流发货", 3),
        ("b", 1, "运费谁出", "卖家来出运费不用担心", "运费", 1), ("b", 2, "运费谁出，鞋底材质是什么", "卖家来出运费不用担心", "运费", 1), ("c", 1, "发货", "x", None, None),
    ]
    df = spark.createDataFrame(rows, "session string, n int, merged_question string, answer string, category string, context_message_count int")
    got = {(r.session, r.removed_question): (r.kept_question, r.remove_reason) for r in dedup.incremental(df, "session", ["n"], rules.BUSINESS_WORDS, rules.CATEGORIES, []).collect()}
    last = rows[2][2]
    assert got == {("a", rows[0][2]): (last, "earlier_question_contained_in_later"), ("a", rows[1][2]): (last, "earlier_question_contained_in_later")}


def test_incremental_large_sessions(spark):
    """Joins find what the comparison of all pairs does, in sessions with a hot question and without."""
    from itertools import combinations

    r, rows = random.Random(7), []
    words = ["鞋子", "什么时候", "发货", "运费", "谁出", "尺码", "偏大", "吗", "呢亲", "请问", "，", "。", "a", "b1", "退货"]
    for i in range(700):
        q = "".join(r.choices(words, k=r.randint(1, 9)))
        if i > 20 and r.random() < 0.4:
            q = list(rows[r.randrange(len(rows))][2])
            for _ in range(r.randint(0, 2)):
                q.insert(r.randint(0, len(q)), r.choice("鞋呢，x"))
            q = "".join(q)
        answer = r.choice(["好", "今天下午就会发出的亲", "今天下午就会发出的亲亲", "卖家来出运费不用担心"])
        rows.append((r.choice(["hot", "hot", "b", None]), i, r.choice([q, q, q, "发货吗"]), answer, r.choice(["物流发货", "其他"]), r.choice([1, 2])))
    df = spark.createDataFrame(rows, "session string, n int, merged_question string, answer string, category string, context_message_count int")
    keys = ("qkey", "akey", "category", "topics", "phrases")
    fields = df.select("session", "n", "merged_question", text.key(F.col("merged_question")).alias("qkey"), text.key(F.col("answer")).alias("akey"), "category", rules.all_matches(F.col("merged_question"), rules.CATEGORIES).alias("topics"), text.key_phrases(F.col("merged_question"), []).alias("phrases"), text.specificity(F.col("answer"), rules.BUSINESS_WORDS).alias("spec"), "context_message_count")
    by = {}
    for x in fields.orderBy("n").collect():
        by.setdefault(x["session"], []).append(x)
    for s in (0.9, 0.6):
        pairs = [(a["n"], b["n"], *[a[k] for k in keys], *[b[k] for k in keys]) for g in by.values() for a, b in combinations(g, 2)]
        schema = "x int, y int, " + ", ".join(f"{k}_{side} {'array<string>' if k in ('topics', 'phrases') else 'string'}" for side in "xy" for k in keys)
        why = {(p["x"], p["y"]): p["reason"] for p in dedup.with_reason(spark.createDataFrame(pairs, schema), 0.8, s).where("reason is not null").collect()}
        want = []
        for g in by.values():
            near = {x["n"]: set() for x in g}
            for a, b in why:
                if a in near:
                    near[a].add(b)
                    near[b].add(a)
            seen = set()
            for x in g:
                if x["n"] in seen:
                    continue
                todo, part = [x["n"]], {x["n"]}
                while todo:
                    new = near[todo.pop()] - part
                    part |= new
                    todo += new
                seen |= part
                mine = [y for y in g if y["n"] in part]
                kept = max(mine, key=lambda y: (len(y["qkey"]), y["context_message_count"], tuple(y["spec"]), y["n"]))
                want += [str(Row(session=y["session"], removed_question=y["merged_question"], kept_question=kept["merged_question"], remove_reason=why.get((y["n"], kept["n"]), dedup.CHAIN))) for y in mine if y is not kept]
        assert len(want) > 100
        for few in (dedup.FEW, 10_000):
            got = dedup.incremental(df, "session", ["n"], rules.BUSINESS_WORDS, rules.CATEGORIES, [], same_question=s, few=few)
            assert sorted(map(str, got.collect())) == sorted(want)


def test_reasons(spark):
    """Reasons of single pairs: prefix, containment, likeness, phrases; topics and answers keep apart."""
    f = lambda q, a="好", c="其他", t=(), p=(): (q, a, c, list(t), list(p))
    cases = [
        (f("何时发货"), f("何时发货呢亲"), dedup.PREFIX),
        (f("何时发货"), f("请问何时发货"), dedup.CONTAINED),
        (f("何时发货", p=["何时发货"]), f("何时发货"), None),
        (f(""), f("何时发货"), None),
        (f("abcdefghijklmnopqrst"), f("abcdefghijklmnopqrsxyt"), dedup.ALIKE + "0.952"),
        (f("尺码颜色", p=["尺码", "颜色"]), f("颜色多少和尺码多少", p=[]), dedup.PHRASES),
        (f("何时发货", c="物流"), f("何时发货呢", c="售后"), None),
        (f("运费", t=["费"]), f("运费和材质", t=["费", "材"]), None),
        (f("何时发货", a="今天下午就会发出"), f("何时发货呢", a="无法确定请再等等"), None),
        (f("何时发货", a="今天下午"), f("何时发货呢", a="无法确定请再等等"), dedup.PREFIX),
    ]
    keys = ("qkey", "akey", "category", "topics", "phrases")
    schema = "i int, " + ", ".join(f"{k}_{side} {'array<string>' if k in ('topics', 'phrases') else 'string'}" for side in "xy" for k in keys)
    got = {r["i"]: r["reason"] for r in dedup.with_reason(spark.createDataFrame([(i, *a, *b) for i, (a, b, _) in enumerate(cases)], schema), 0.8, 0.9).collect()}
    assert [got[i] for i in range(len(cases))] == [w for _, _, w in cases]


@settings(max_examples=400, deadline=None)
@given(st.text("abcdefg", min_size=1, max_size=30), st.lists(st.tuples(st.integers(0, 40), st.sampled_from("abcx"), st.booleans()), max_size=8), st.sampled_from([0.3, 0.6, 0.8, 0.9, 0.95]), st.dictionaries(st.text("abcdefg", min_size=2, max_size=2), st.integers(1, 9)))
def test_tokens_of_similar_keys_meet(x, edits, least, known):
    y = list(x)
    for at, c, put in edits:
        if put or not y:
            y.insert(min(at, len(y)), c)
        else:
            del y[at % len(y)]
    y, t = "".join(y), dedup._Tokens(known, least)
    if len(y) > len(x) and (x in y or dedup._at_least(x, y, least)):
        assert t.earlier(x, []) & t.later(y)


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(139, 200), (300, 301), (301, 300)]
    got = {r.node: r.root for r in dedup.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in [*range(100, 140), 200]} | {300: 300, 301: 300}


@settings(max_examples=100, deadline=None)
@given(st.text("abc", max_size=12), st.text("abc", max_size=12))
def test_similarity_bound(a, b):
    for least in (0.8, 0.9):
        assert dedup._at_least(a, b, least) == (bool(a) == bool(b) and (SequenceMatcher(None, a, b, autojunk=False).ratio() >= least if a else True)) or not (a or b)


def test_masking(spark):
    rows = [(1, "订单号20260101001 电话13165932620 邮箱a.b@example.org https://x.y/z #E-s12"), (2, None), (3, ""), (4, "SD1778948153064 和 620014400867043122")]
    m = {r.i: r for r in masking.mask(spark.createDataFrame(rows, "i int, t string"), "t").collect()}
    assert m[1].masked == "[ORDER_ID] 电话[PHONE] 邮箱[EMAIL] [URL] " and m[1].pii_types == ["EMAIL", "EMOTE", "ORDER_ID", "PHONE", "URL"]
    assert m[2].masked is None and m[3].masked == "" and m[4].masked == "[TRACKING_ID] 和 [LONG_NUMBER]"
    masked = masking.mask(spark.createDataFrame(rows, "i int, t string"), "t").select("i", F.col("masked").alias("t"))
    assert masking.residual(masked, "t").count() == 0
    assert one(spark, "客服小禾和客服$", lambda c: masking.replace_markers(c, ["客服", "客服小禾", "x"])) == "[PRIVATE]和[PRIVATE]$"
    assert one(spark, "我在家。南浦路12号3栋，好的", lambda c: masking.mask_addresses(c, "路|号|栋")) == "我在家。[ADDRESS]，好的"
    df = spark.createDataFrame([("x",), (None,)], "a string")
    ids = [r.b for r in masking.blind_id(df, ["a"], b"k", "r_", "b").collect()]
    assert len(set(ids)) == 2 and all(len(i) == 26 for i in ids)


def test_statistics(spark):
    # Exact p values worked out by hand or by enumeration.
    signed = lambda xs: stats.signed_rank_p([(s, sum(x == s for x in xs), sum(x == -s for x in xs)) for s in {abs(x) for x in xs if x}], len(xs))
    assert signed([1, 2, 3, 4, 5]) == (15.0, 0.0, 0.0625, 1.0)
    assert signed([0, 0]) == (0.0, 0.0, 1.0, 0.0) and signed([]) == (None,) * 4
    plus, minus, p, _ = signed([1, -1, 2, -3])
    assert (plus, minus) == (4.5, 5.5) and p == 1.0
    df = spark.createDataFrame([("g", True, False)] * 6 + [("g", False, True)] + [("g", True, True)] * 3, "g string, a boolean, b boolean")
    r = stats.mcnemar(df, ["g"], F.col("a"), F.col("b")).first()
    assert (r.both, r.first_only, r.second_only, r.neither) == (3, 6, 1, 0) and abs(r.p_value - 0.125) < 1e-12
    h = stats.holm(spark.createDataFrame([("f", "a", 0.01), ("f", "b", 0.04), ("f", "c", 0.03)], "f string, n string, p double"), "f", "n", "p")
    assert {r.n: round(r.adjusted, 6) for r in h.collect()} == {"a": 0.03, "b": 0.06, "c": 0.06}
    k = stats.kappa(spark.createDataFrame([("x", "x")] * 4 + [("x", "y"), ("y", "y")], "a string, b string"), [], "a", "b").first()
    assert abs(k.kappa - (5 / 6 - 22 / 36) / (1 - 22 / 36)) < 1e-12
    assert stats.kappa(spark.createDataFrame([("x", "x")] * 4, "a string, b string"), [], "a", "b").first().kappa is None
    a = stats.apportion(spark.createDataFrame([("a", 5), ("b", 3), ("c", 2)], "k string, n int"), "k", "n", 4).collect()
    assert {r.k: r.seats for r in a} == {"a": 2, "b": 1, "c": 1}
    ranks = stats.mid_ranks(spark.createDataFrame([("g", 1), ("g", 2), ("g", 2), ("g", 5)], "g string, v int"), ["g"], "v").collect()
    assert sorted((r.v, r.mid_rank) for r in ranks) == [(1, 1.0), (2, 2.5), (2, 2.5), (5, 4.0)]
    b = stats.bootstrap_interval(spark.createDataFrame([("g", 1.0), ("g", 3.0)], "g string, x double"), ["g"], "x", ["x"], 500).first()
    assert b.mean == 2.0 and b.low == 1.0 and b.high == 3.0


def test_top_k_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(300, 8)).round(1).astype(np.float32)
    v[7] = 0
    v[9] = v[10]
    df = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)] + [(900, None)], "vec_id long, embedding array<float>")
    q = df.where("vec_id < 20 or vec_id = 900").withColumnRenamed("vec_id", "query_id")
    got = {}
    for r in retrieval.top_k(df, q, 5, "vec_id", "query_id", block=6).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = r.vec_id
    x = v.astype(np.float64)
    n = np.linalg.norm(x, axis=1)
    for i in range(20):
        if n[i] == 0:
            assert i not in got
            continue
        s = np.where(n > 0, x @ x[i] / np.where(n > 0, n, 1) / n[i], -9)
        assert [got[i][k] for k in range(1, 6)] == sorted(range(300), key=lambda j: (-round(s[j], 12), j))[:5]
    assert retrieval.top_k(df, q.limit(0), 5, "vec_id", "query_id").count() == 0


def test_rerank_filters_and_answers(spark):
    df = spark.createDataFrame([("q", 1, 0.6, "a", "x"), ("q", 2, 0.59, "b", "y"), ("r", 1, 0.3, "a", "z")], "q string, rank int, sim double, cat string, text string")
    got = retrieval.rerank(df, "q", "sim", "rank", [("same", F.col("cat") == "b", 0.14), ("null", F.lit(None).cast("boolean"), 9.0)]).where("q = 'q'").orderBy("new_rank").collect()
    assert [(r["rank"], r.reasons) for r in got] == [(2, "same"), (1, "")]
    assert {(r.q, r["rank"]) for r in retrieval.soft_filter(df, "q", F.col("cat") == "b").collect()} == {("q", 2), ("r", 1)}
    assert {(r.q, r.answer, r.source) for r in retrieval.answer(df, "q", "rank", "sim", "text", "?").collect()} == {("q", "x", "retrieved"), ("r", "?", "fallback")}


def test_sampling(spark):
    df = spark.createDataFrame([(i, "abc"[i % 3] if i else None) for i in range(60)], "i long, s string")
    first = [r.i for r in sampling.hash_sample(df, "i", 7, "x").collect()]
    assert first == [r.i for r in sampling.hash_sample(df.repartition(9), "i", 7, "x").collect()]
    assert {r.s for r in sampling.one_each_then_fill(df, "i", "s", 5, "x").collect()} >= {"a", "b", "c"}
    quota = spark.createDataFrame([("a", 2), ("b", 0), ("z", 4)], "s string, seats int")
    assert [r.s for r in sampling.quotas(df, "i", "s", quota, "x").collect()] == ["a", "a"]
    assert sampling.without_used(df, df.where("i < 50"), ["i"]).count() == 10
    rows = [{"k": i, "m": i % 2, "c": i % 3} for i in range(12)]
    got = sampling.diverse(rows, 3, ["m", "c"], "k", "x")
    assert len({r["c"] for r in got}) == 3 and got == sampling.diverse(rows, 3, ["m", "c"], "k", "x")


def test_reviews_and_journals(spark):
    p = spark.createDataFrame([(1, "a", "u"), (2, "b", None), (3, "c", "w")], "id int, x string, y string")
    s = spark.createDataFrame([(1, "a", "u"), (2, "z", None)], "id int, x string, y string")
    f = spark.createDataFrame([(2, None, "v")], "id int, x string, y string")
    assert [tuple(r) for r in review.merge(p, s, f, "id", ["x", "y"]).orderBy("id").collect()] == [(1, "a", "u", "double"), (2, "b", "v", "adjudicated"), (3, "c", "w", "single")]
    assert [(r.id, r.disputed_fields) for r in review.disagreements(p, s, "id", ["x", "y"]).collect()] == [(2, ["x"])]
    assert [tuple(r) for r in review.difference(p, s, "id").collect()] == [(3, "left")]
    assert [(r.id, r.violated) for r in review.violations(p, "id", {"x": F.col("x") == "a", "y": F.col("y").isNotNull()}).orderBy("id").collect()] == [(2, ["x", "y"]), (3, ["x"])]
    j = spark.createDataFrame([("r", 1, "a"), ("r", 2, "b"), ("r", 3, "a"), ("s", 1, "b")], "k string, n int, s string")
    assert [(r.k, r.n, r.legal) for r in review.transitions(j, "k", "s", [F.col("n")], [("a", "b")]).orderBy("k", "n").collect()] == [("r", 1, True), ("r", 2, True), ("r", 3, False), ("s", 1, True)]
    assert {r.k: r.prefix for r in review.contiguous_prefix(j, "k", [F.col("n")], F.col("s") == "a").collect()} == {"r": 1, "s": 0}
    t = spark.createDataFrame([("a", 1, False), ("a", 2, True), ("b", 1, False), ("c", 1, False), ("c", 2, False), ("c", 3, False)], "k string, n int, ok boolean")
    assert {r.k: r.status for r in review.first_success(t, "k", "n", F.col("ok")).collect()} == {"a": "done", "b": "open", "c": "failed"}


def test_catalogue(spark):
    schema = "product_id string, sizing struct<size_chart:array<struct<foot_length_cm:double,recommended_size:int>>>, functions map<string,struct<level:string,description:string>>"
    df = spark.createDataFrame([("a", ([(22.0, 35), (22.5, 36)],), {"x": ("low", ""), "b": ("high", ""), "c": ("high", "")}), ("b", ([(22.0, 35), None, (22.0, 36), (23.0, 36)],), {}), ("c", None, None), ("d", ([(1.0, 2)],), {"k": None})], schema)
    assert {tuple(r) for r in catalog.chart_errors(df).collect()} == {("b", "length_not_increasing"), ("b", "size_not_increasing")}
    assert {r.product_id: r.key_function for r in catalog.key_function(df, {"high": 3, "low": 1}).collect()} == {"a": "b", "b": None, "c": None, "d": "k"}
    refs = spark.createDataFrame([("a/b.png",), ("../x.png",), (None,), ("a//b.png",)], "r string")
    assert [r.ok for r in refs.select(catalog.safe_reference(F.col("r")).alias("ok")).collect()] == [True, False, False, False]


def test_signed_ranks_against_all_sign_patterns(spark):
    from itertools import product

    r = random.Random(3)
    rows, want = [], {}
    for g in range(12):
        xs = [r.randint(-4, 4) for _ in range(g)]
        rows += [(g, x) for x in xs] + [(g, None)]
        size = sorted(abs(x) for x in xs if x)
        rank = [(size.index(abs(x)) + 1 + len(size) - size[::-1].index(abs(x))) / 2 if x else 0 for x in xs]
        plus = sum(k for k, x in zip(rank, xs) if x > 0)
        nonzero = [k for k in rank if k]
        sums = [sum(k for k, up in zip(nonzero, ups) if up) for ups in product([0, 1], repeat=len(nonzero))]
        small = min(plus, sum(rank) - plus)
        want[g] = (plus, sum(rank) - plus, min(1.0, 2 * sum(s <= small for s in sums) / len(sums))) if xs else (None, None, None)
    for x in stats.wilcoxon(spark.createDataFrame(rows, "g int, x int"), ["g"], "x").collect():
        assert tuple(x)[1:4] == pytest.approx(want[x.g]) if want[x.g][0] is not None else tuple(x)[1:4] == want[x.g]
    many = [(x, 30 + x, 25) for x in range(1, 40)]
    exact = stats.signed_rank_p(many, 3000)[2]
    stats.EXACT_PAIRS, kept = 0, stats.EXACT_PAIRS
    try:
        assert stats.signed_rank_p(many, 3000)[2] == pytest.approx(exact, abs=0.002)
    finally:
        stats.EXACT_PAIRS = kept


def test_resamples_are_those_of_the_sequential_generator():
    rng, x = random.Random(20260721), [3.0, -1.0, 2.0, 0.0, 5.0, 1.0, -2.0]
    want = [sum(x[rng.randrange(7)] for _ in range(7)) / 7 for _ in range(3000)]
    assert stats.resampled_means(x, None, 3000, 20260721).tolist() == pytest.approx(want)
    by_count = stats.resampled_means([0.0, 1.0], [600, 400], 20_000, 1)
    assert by_count.mean() == pytest.approx(0.4, abs=0.002) and by_count.std() == pytest.approx((0.24 / 1000) ** 0.5, rel=0.05)


def test_quantiles_of_groups(spark):
    rows = [("a", 1.0), ("a", 2.0), ("a", 2.0), ("a", 10.0), ("b", 5.0), ("c", None), (None, 3.0), (None, 4.0)]
    df = spark.createDataFrame(rows, "g string, x double")
    assert {tuple(r) for r in stats.linear_quantile(df, ["g"], "x", 0.75).collect()} == {("a", 4.0), ("b", 5.0), ("c", None), (None, 3.75)}
    assert {tuple(r) for r in stats.nearest_rank(df, ["g"], "x", 0.5).collect()} == {("a", 2.0), ("b", 5.0), ("c", None), (None, 3.0)}
    assert {(r.g, r.median, r.n) for r in stats.numeric_summary(df, ["g"], "x").collect()} == {("a", 2.0, 4), ("b", 5.0, 1), ("c", None, 0), (None, 3.5, 2)}
    assert stats.numeric_summary(df, [], "x").first().median == 3.0
