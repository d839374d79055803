"""Near duplicates against brute force."""

import random

import numpy as np
import regex
from pyspark.sql import functions as F

from colloquy.llm import neardup as N


DROP = regex.compile(r"[^\p{L}\p{N}]+")


def plain(question, answer):
    return DROP.sub("", ((question or "") + (answer or "")).lower())


def brute(rows, least):
    p = {i: N.pieces(plain(q, a)) for i, q, a in rows if i is not None}
    ids = sorted(i for i in p if p[i])
    return {(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if len(p[a] & p[b]) >= least * len(p[a] | p[b])}


def run(spark, rows):
    df = spark.createDataFrame(rows, "id string, q string, a string")
    return N.NearDuplicates(df, "id", F.col("q"), F.col("a"))


def test_edits_copies_nulls_and_short_texts(spark):
    rng = random.Random(5)
    words = [chr(rng.randrange(0x4E00, 0x9000)) for _ in range(400)]
    rows = []
    for k in range(120):
        base = rng.choices(words, k=80)
        for v in range(4):
            t = list(base)
            for _ in range(v * 3):
                t[rng.randrange(80)] = rng.choice(words)
            rows.append((f"{k:03d}-{v}", "".join(t[:40]), "".join(t[40:])))
    rows += [(f"c{i}", "The same, text!", None) for i in range(5)] + [("s1", "ab", None), ("s2", "ab", ""), ("n1", None, None), ("n2", None, None), (None, "The same text", None)]
    rows += [("l1", "长" * 3 + "文本很长" * 30_000, None), ("l2", "长" * 3 + "文本很长" * 30_000, "。")]
    near = run(spark, rows)
    got = [tuple(r) for r in near.record_pairs().collect()]
    want = brute(rows, 0.75)
    assert len(got) == len(set(got))
    assert set(got) <= want
    assert len(want - set(got)) <= 0.002 * len(want)
    classes = {r.id: r for r in near.classes().collect()}
    assert set(classes) == {i for i, _, _ in rows if i is not None}
    assert classes["s1"].links == 0 and classes["s2"].rep == classes["s1"].rep == classes["s1"].cluster and classes["n2"].rep == "n1"
    assert classes["c4"].rep == "c0"
    # Clusters are the components of the pairs.
    parent = {i: i for i in classes}

    def find(i):
        return i if parent[i] == i else find(parent[i])

    for a, b in sorted({*got, *[(r.rep, r.id) for r in classes.values()]}):
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    assert all(r.cluster == find(i) for i, r in classes.items())
    pairs = [tuple(r)[:2] for r in near.class_pairs().collect()]
    assert set(pairs) <= want and len(pairs) == len(set(pairs))


def test_normalize_equals_plain(spark):
    rows = [("İstanbul ΑΣ", "Größe ４２!"), (None, "A-b"), ("", None), (None, None), ("½ Ⅷ ①", "ﬁ ǅ"), ("สวัสดี", "e\u0301")]
    df = spark.createDataFrame(rows, "q string, a string").select("q", "a", N.normalize(F.col("q"), F.col("a")).alias("n"))
    for r in df.collect():
        assert r.n == plain(r.q, r.a), r


def test_sample_table(spark):
    d = "/root/testdata/sf0.001"
    c = spark.read.parquet(f"{d}/external_candidates.parquet")
    rows = [tuple(r) for r in c.select("external_candidate_id", "final_question", "final_answer").collect()]
    near = N.NearDuplicates(c, "external_candidate_id", F.col("final_question"), F.col("final_answer"))
    assert {tuple(r) for r in near.record_pairs().collect()} == brute(rows, 0.75)


def test_empty(spark):
    assert run(spark, [("a", None, None)]).record_pairs().count() == 0


def test_sketches_estimate_similarity():
    rng = random.Random(1)
    a = "".join(chr(rng.randrange(0x4E00, 0x9000)) for _ in range(300))
    for keep in (100, 200, 280):
        b = a[:keep] + "".join(chr(rng.randrange(0x4E00, 0x9000)) for _ in range(300 - keep))
        s = N.sketches([a, b])
        p, q = N.pieces(a), N.pieces(b)
        assert abs((s[0] == s[1]).mean() - len(p & q) / len(p | q)) < 0.1
    assert (N.sketches(["abc", "abc"])[0] == N.sketches(["abc"])[0]).all()
    assert (N.sketches(["abcd"]) != np.uint64(0xFFFFFFFFFFFFFFFF)).all()
