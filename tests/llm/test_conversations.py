"""Conversations against a plain reading of the rules, and the automaton against its table."""

import itertools
import re
import unicodedata
from collections import defaultdict

from pyspark.sql import functions as F

from colloquy.functions import roles as spelled
from colloquy.llm import conversations as cv


def plain(rows, instants):
    """rows: dicts of messages; instants: message_id -> ms or None."""
    blank = lambda t: t is None or not t.strip()
    visible = lambda t: t is not None and any(not c.isspace() and unicodedata.category(c) not in ("Cf", "Cc", "Zs") for c in t)
    by = defaultdict(dict)
    for r in sorted(rows, key=lambda r: r["message_id"]):
        if not blank(r["session_id"]):
            by[r["session_id"]].setdefault(r["input_order"], r)
    out = set()
    for sid, places in by.items():
        if set(places) != set(range(1, len(places) + 1)):
            continue

        def told(r):
            t = (r["sender_type"] or "").strip().lower()
            return "customer" if t in spelled.CUSTOMER else "service" if t in spelled.SERVICE else "system" if t in spelled.SYSTEM else None

        roles = {k: told(r) for k, r in places.items()}
        for k, r in places.items():
            if roles[k] is None:
                others = {told(o) for o in places.values() if o["sender"] == r["sender"] and r["sender"] is not None} - {None}
                roles[k] = others.pop() if len(others) == 1 else None
        if None in roles.values():
            continue
        seq = [(instants[r["message_id"]] is None, instants[r["message_id"]] or 0, k, r["message_id"], roles[k]) for k, r in places.items() if roles[k] != "system" and visible(r["message_content"])]
        seq.sort()
        if not seq or seq[-1][4] != "service" or all(x[4] != "customer" for x in seq):
            continue
        out |= {(sid, i + 1, x[3], x[4]) for i, x in enumerate(seq)}
    return out


def test_test_table(spark):
    from colloquy.operators import timestamps


    d = "/root/testdata/sf0.001"
    m, s = spark.read.parquet(f"{d}/messages.parquet"), spark.read.parquet(f"{d}/stores.parquet")
    times = timestamps.to_instants(m.select("message_id", F.col("external_store_id").alias("source_id"), F.col("message_time").alias("text")), timestamps.store_sources(s))
    instants = {r.message_id: r.epoch_ms for r in times.select("message_id", "epoch_ms").collect()}
    got = [tuple(r) for r in cv.conversations(m, s).collect()]
    assert len(got) == len(set(got)) > 100
    assert set(got) == plain([r.asDict() for r in m.collect()], instants)


def test_automaton_summary(spark):
    words = [w for n in range(6) for w in itertools.product("csu", repeat=n)]

    def run(word):
        state = cv.START
        for letter in word:
            state = cv.TRANSITIONS[state][letter]
        return state

    m = cv.Monoid(cv.TRANSITIONS)
    df = spark.createDataFrame([("".join(w), [cv.LETTERS.index(x) for x in w], len(w) // 2) for w in words], "word string, letters array<int>, half int")
    halves = [m.read(F.slice("letters", F.lit(1), F.col("half"))), m.read(F.slice("letters", F.col("half") + 1, F.lit(99)))]
    for r in df.select("word", m.state(m.read(F.col("letters"))).alias("whole"), m.state(m.multiply(F.array(*halves))).alias("parts")).collect():
        assert r.whole == r.parts == run(r.word), r


def test_the_automaton_decides(spark):
    """Another table of transitions gives other verdicts: here the last word may be the customer's."""
    rows = spark.createDataFrame([("x", i, i + 1, who, True, False) for i, who in enumerate(["service", "customer"])], "session_id string, seq long, input_order int, speaker string, kept boolean, unknown boolean")
    other = {s: dict(t) for s, t in cv.TRANSITIONS.items()}
    other[cv.UNASKED]["c"] = cv.ANSWERED
    assert cv.verdicts(rows).first().state == cv.ASKED
    assert cv.verdicts(rows, other).first().state == cv.ACCEPTED


SCHEMA = "message_id long, session_id string, external_store_id string, sender string, sender_type string, message_time string, message_content string, content_type string, source_file string, input_order int"


def test_cases(spark):
    stores = spark.createDataFrame([("s", "Asia/Shanghai", "DMY")], "external_store_id string, zone_id string, date_order string")
    rows = []

    def add(session, order, sender, kind, content="hi", time="2026-01-01 00:00:00"):
        rows.append((len(rows) + 1, session, "s", sender, kind, time, content, None, None, order))

    add("ok", 1, "a", "Buyer ", time="2026-01-01 00:00:05")
    add("ok", 2, "b", "客服", time="1767225610")
    add("ok", 3, "a", None, time="2026-01-01 00:00:01")
    add("ok", 4, "sys", "system")
    add("ok", 5, "a", "customer", "​ 　")
    add("ok", 2, "b", "客服")  # exported again
    add("gap", 1, "a", "customer"), add("gap", 3, "b", "service")
    add("none", 1, "a", "customer"), add("none", 2, "b", "service"), add("none", 3, None, "?")
    add("open", 1, "b", "service"), add("open", 2, "a", "customer", time="x")
    add("empty", 1, "a", "customer", None), add("empty", 2, "b", "service", "")
    add(" ", 1, "a", "customer"), add(None, 1, "a", "customer")
    add("null", None, "a", "customer"), add("null", 2, "b", "service")
    df = spark.createDataFrame(rows, SCHEMA)
    assert {tuple(r) for r in cv.conversations(df, stores).collect()} == {("ok", 1, 3, "customer"), ("ok", 2, 1, "customer"), ("ok", 3, 2, "service")}
    assert cv.conversations(df.limit(0), stores).count() == 0


def test_one_session_with_a_third_of_all_rows(spark):
    stores = spark.createDataFrame([("s", "UTC", "DMY")], "external_store_id string, zone_id string, date_order string")
    n = 6000
    rows = [(i, "hot", "s", "ab"[i % 2], ["customer", "service"][i % 2], str(1767225600 + i // 3), "x", None, None, i + 1) for i in range(n)]
    rows += [(n + i, f"c{i // 2}", "s", "ab"[i % 2], ["customer", "service"][i % 2], str(1767225600 + i), "x", None, None, i % 2 + 1) for i in range(2 * n)]
    got = cv.conversations(spark.createDataFrame(rows, SCHEMA), stores).collect()
    assert len(got) == 3 * n
    assert [r.message_id for r in sorted((r for r in got if r.session_id == "hot"), key=lambda r: r.pos)] == list(range(n))
