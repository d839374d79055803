"""Sources: archives, encodings, the chat format with all its errors, corpus ids; streaming."""

import json
import zipfile

from pyspark.sql import functions as F

from colloquy.sources import chat, corpus, files
from colloquy.streaming import sessions

CHAT = """前面的话
会话结束_时间: 2026-01-01 00:00:00
以下为一通会话
没有头
顾客川远 2026-02-28 04:30:49
第一行
第二行

店铺客服沐砚 2026-02-28T04:31:05
https://a.example/x.jpg
顾客川远 2026-02-30 04:31:06
顾客川远 2026-02-28 04:32:00
会话结束_时间: 2026-13-01
以下为一通会话
以下为一通会话
顾客川远 2026-02-28 04:33:00
好
"""


def test_chat_format(spark):
    df = spark.createDataFrame([("a.txt", CHAT.encode("gb18030")), ("b.txt", b"\xff\xff" + CHAT.encode()), ("c.txt", None), ("d.txt", b"")], "source_name string, data binary")
    parsed = chat.parse(df).cache()
    m = [tuple(r) for r in chat.messages(parsed).where("source_file = 'a.txt'").orderBy("line_number").select("session_id", "sender", "sender_type", "message_time", "message_content", "content_type").collect()]
    assert m == [
        ("a.txt#000000001", "顾客川远", "customer", "2026-02-28 04:30:49", "第一行\n第二行", "text"),
        ("a.txt#000000001", "店铺客服沐砚", "service", "2026-02-28 04:31:05", "https://a.example/x.jpg\n顾客川远 2026-02-30 04:31:06", "image_or_link"),
        ("a.txt#000000001", "顾客川远", "customer", "2026-02-28 04:32:00", "", "text"),
        ("a.txt#000000003", "顾客川远", "customer", "2026-02-28 04:33:00", "好", "text"),
    ]
    s = [tuple(r)[2:] for r in chat.sessions(parsed).where("source_file = 'a.txt'").orderBy("session_id").collect()]
    assert s == [(3, 2, 1, "2026-02-28 04:30:49", "2026-02-28 04:32:00"), (0, 0, 0, None, None), (1, 1, 0, "2026-02-28 04:33:00", "2026-02-28 04:33:00")]
    kinds = {r.error_type for r in chat.errors(parsed).collect()}
    assert kinds == {"line_outside_session", "end_without_start", "content_without_header", "invalid_message_time", "missing_message_content", "invalid_session_end_time", "missing_session_end", "empty_session", "decode_replacement", "unreadable"}
    assert chat.parse(df.limit(0)).count() == 0


def test_files(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(CHAT.encode("utf-8-sig"))
    with zipfile.ZipFile(tmp_path / "b.zip", "w") as z:
        z.writestr("x/c.txt", CHAT.encode("gb18030"))
        z.writestr("d.bin", b"1")
    (tmp_path / "bad.zip").write_bytes(b"nothing")
    rows = {r.source_name.split("/")[-1] if "!" not in r.source_name else r.source_name.split("!")[1]: r for r in files.text_sources(files.text_files(spark, [str(tmp_path)])).collect()}
    assert rows["bad.zip"].error == "zip_error: BadZipFile" and rows["bad.zip"].data is None
    assert files.decode(bytes(rows["a.txt"].data))[1] == "utf-8-sig"
    assert len(rows) == 3
    csv = tmp_path / "t.csv"
    csv.write_text('﻿a,b\n"x ""y""\nz",\nNA,2\n', encoding="utf-8")
    got = files.read_csv(spark, str(csv), ["a", "b"])
    assert [tuple(r) for r in got.collect()] == [('x "y"\nz', ""), ("NA", "2")]
    files.write_csv(got, str(tmp_path / "out"), ["b", "a"])
    assert [tuple(r) for r in files.read_csv(spark, str(tmp_path / "out"), ["a"]).select("a", "b").collect()] == [('x "y"\nz', ""), ("NA", "2")]
    d = files.digests(spark, [str(tmp_path / "a.txt")])
    assert len(d.first().sha256) == 64 and len(files.combined_digest(d)) == 64
    built = []
    build = lambda: built.append(1) or spark.range(3)
    for key in ({"v": 1}, {"v": 1}, {"v": 2}):
        assert files.cached(spark, str(tmp_path / "cache"), key, build).count() == 3
    assert len(built) == 2
    for bad in ('{"a": 1, "a": 2}', '{"a": NaN}'):
        try:
            files.strict_json(bad)
            raise AssertionError(bad)
        except ValueError:
            pass
    assert files.strict_json('{"a": 1}') == {"a": 1}


def test_snippets(spark):
    raw = "售前话术\nsize,1 = 偏大一码\n第二行\nsize,2=标准\n\n售后话术\nrefund,1 = 七天\n"
    got = chat.snippets(spark.createDataFrame([("s", raw.encode())], "source_name string, data binary")).collect()
    assert [tuple(r)[1:] for r in got] == [("售前话术", "size", 1, "偏大一码\n第二行"), ("售前话术", "size", 2, "标准"), ("售后话术", "refund", 1, "七天")]


def test_unique_ids_equal_the_sequential_rule(spark):
    ids = ["a", "a", "a__dup_2", "a", "b", "a", "c__dup_2", "c", "c", "d"]
    reserved, seen, want = set(ids), {}, []
    for x in ids:
        if x not in seen:
            seen[x] = 1
            want.append(x)
            continue
        k = seen[x] + 1
        while f"{x}__dup_{k}" in reserved:
            k += 1
        seen[x] = k
        want.append(f"{x}__dup_{k}")
    got = corpus.unique_ids(spark.createDataFrame(list(enumerate(ids)), "n int, id string"), "id", ["n"]).orderBy("n").collect()
    assert [r.id for r in got] == want and len(set(want)) == len(want)


def test_corpus(spark):
    pairs = spark.createDataFrame([("s", 0, " q ", "a", None, "f"), ("s", 1, " ", "a", None, "f"), ("s", 2, "q", None, "x", "f")], "session_id string, row_index long, question string, answer string, category string, source_file string")
    snips = spark.createDataFrame([("k, 1", "yes", "内容", "t", "c", "90", "no", None, "f", 0), ("k, 1", "1", "内容", "t", "c", "x", "yes", None, "f", 1), ("z", "no", "内容", "t", "c", "1", "no", None, "f", 2)], "original_key string, allowed_for_answer string, content string, title string, category string, priority string, needs_backend_api string, source_type string, source_file string, row_index long")
    got = corpus.mixed(corpus.from_pairs(pairs), corpus.from_snippets(snips)).orderBy("doc_id").collect()
    assert [(r.doc_id, r.category, r.priority, r.needs_backend_api) for r in got] == [("qa_s_0", "其他", 50, False), ("snippet_k__1", "c", 90, False), ("snippet_k__1__dup_2", "c", 70, True)]
    v = corpus.embed(spark.createDataFrame([("a",), (None,)], "t string"), "t", lambda ts: [[3.0, 4.0] if t else [0.0, 0.0] for t in ts], 2).collect()
    assert [round(x, 3) for x in v[0].embedding] == [0.6, 0.8] and list(v[1].embedding) == [0.0, 0.0]


RULES = {"topics": [("ship", ["发货"]), ("size", ["尺码"])], "follow": ["呢"], "reset": ["人工"]}


def test_session_steps():
    s = sessions.State()
    out = []
    for t in ["什么时候发货", "明天呢", "后天呢", "大后天呢", "再后天呢", None, "尺码", "人工", "呢"]:
        s, r = sessions.step(s, t, **RULES)
        out.append((r["topic"], r["inherited"]))
    assert out == [("ship", False), ("ship", True), ("ship", True), ("ship", True), ("", False), ("", False), ("size", False), ("", False), ("", False)]
    assert s.total == 9 and len(s.history) == sessions.KEPT_TURNS
    assert sessions.coerce({"confidence": 7, "turns": -1}).confidence == 1.0 and sessions.coerce(None).topic == ""


def test_stream_equals_batch(spark, tmp_path):
    rows = [(f"s{i % 3}", i, t) for i, t in enumerate(["什么时候发货", "尺码", "人工", "明天呢", "呢", "发货", "后天呢", "x", "呢"] * 3)]
    schema = "session string, n int, content string"
    batch = sessions.replay(spark.createDataFrame([*rows, (None, 1, "x")], schema), "session", ["n"], "content", RULES)
    want = sorted(map(tuple, batch.collect()))
    src = tmp_path / "in"
    src.mkdir()
    for k in range(3):
        (src / f"{k}.json").write_text("\n".join(json.dumps(dict(zip(["session", "n", "content"], r)), ensure_ascii=False) for r in rows[k * 9 : k * 9 + 9]), encoding="utf-8")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).json(str(src))
    q = sessions.stream(stream, "session", ["n"], "content", RULES).writeStream.format("memory").queryName("replayed").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(map(tuple, spark.table("replayed").collect())) == want


def test_idle_sessions_are_forgotten(spark, tmp_path):
    """A topic isn't inherited across a pause longer than the idle time."""
    import time

    src = tmp_path / "in"
    src.mkdir()
    put = lambda n, row: (src / f"{n}.json").write_text(json.dumps(dict(zip(["session", "n", "content"], row)), ensure_ascii=False), encoding="utf-8")
    for n, row in enumerate((("s", 0, "什么时候发货"), ("t", 1, "尺码"), ("s", 2, "明天呢"))):
        put(n, row)
        time.sleep(1)
        stream = spark.readStream.schema("session string, n int, content string").json(str(src))
        q = sessions.stream(stream, "session", ["n"], "content", RULES, idle_ms=1).writeStream.format("parquet").option("path", str(tmp_path / "out")).outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(once=True).start()
        assert q.awaitTermination(60)
    got = {(r.session, r.topic, r.inherited) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert ("s", "ship", False) in got and ("s", "ship", True) not in got and len(got) == 3


def test_windows(spark):
    df = spark.sql("select * from values (1, timestamp'2026-01-01 00:01:00', 'a'), (1, timestamp'2026-01-01 00:20:00', 'a'), (1, timestamp'2026-01-01 01:20:00', 'b') as t(u, ts, k)")
    assert sorted((r.k, r.n) for r in sessions.windowed_counts(df, "ts", "k").collect()) == [("a", 1), ("a", 1), ("b", 1)]
    assert sorted(r.n for r in sessions.session_windows(df, "ts", "u").collect()) == [1, 2]
    assert F is not None
