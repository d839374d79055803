"""Measured values and claims."""

import re

import pytest
from pyspark.sql import functions as F

from colloquy.functions import measures
from colloquy.operators import claims


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("脚长二十四厘米", [("length", 24.0, 24.0)]), ("240毫米到", [("length", 24.0, 24.0)]), ("24-25cm", [("length", 24.0, 25.0)]), ("零下12度，放3小时", [("temperature", -12.0, -12.0), ("duration", 3.0, 3.0)]),
        ("重十克，寄2公斤", [("weight", 10.0, 10.0), ("weight", 2000.0, 2000.0)]), ("", []), (None, []), ("没有数字", []), ("1" * 100_000, []),
    ],
)
def test_mentions(text, want):
    assert [(k, round(a, 9), round(b, 9)) for k, a, b, *_ in measures.mentions(text)] == want


def test_numerals():
    assert [measures.chinese_value(w) for w in ("零", "九", "十", "十三", "二十", "九十九")] == [0, 9, 10, 13, 20, 99]


def test_columns(spark):
    df = spark.createDataFrame([("左脚24.5厘米右脚25厘米，跑100公里",), (None,), ("x",)], "t string")
    assert [r.v for r in df.select(measures.largest(F.col("t"), "length", 10, 35).alias("v")).collect()] == [25.0, None, None]
    assert [len(r.m) for r in df.select(measures.measured("t").alias("m")).collect()] == [3, 0, 0]


def test_claims(spark):
    p = re.compile("一定")
    assert claims.unqualified("一定到货", p, ["不"]) and not claims.unqualified("不一定到货", p, ["不"])
    assert claims.last_polarity("穿过，没穿过", re.compile("穿过"), ["没"]) is False and claims.last_polarity("没穿过，后来穿过", re.compile("穿过"), ["没"]) is True and claims.last_polarity("", p, []) is None
    df = spark.createDataFrame([(1, "您好。明天一定到货。请留意！"), (2, "不一定。"), (3, None), (4, "")], "i int, t string")
    got = {r.i: (r.answer, r.blocked) for r in claims.drop_claims(df, "t", {"sure": "一定"}, ["不"], "以页面为准。").collect()}
    assert got == {1: ("您好。请留意！以页面为准。", ["sure"]), 2: ("不一定。", []), 3: (None, []), 4: ("", [])}
    tidy = df.select("i", claims.tidy_answer(F.col("t"), ["您好"]).alias("a")).collect()
    assert {r.i: r.a for r in tidy} == {1: "明天一定到货。请留意。", 2: "不一定。", 3: None, 4: ""}
    rel = df.select("i", claims.relevant_sentences(F.col("t"), ["到货"]).alias("a")).collect()
    assert {r.i: r.a for r in rel} == {1: "明天一定到货。", 2: None, 3: None, 4: None}
