"""Measured values in text: Chinese numerals, units, ranges.

The unit table is data; the parsers run in Arrow batches, as replacement by a computed value has no
native expression.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Unit -> (kind, factor to the kind's base: gram, centimetre, hour, degree Celsius).
UNITS = {
    "毫米": ("length", 0.1), "mm": ("length", 0.1), "厘米": ("length", 1.0), "公分": ("length", 1.0), "cm": ("length", 1.0), "公里": ("length", 100_000.0), "千米": ("length", 100_000.0), "km": ("length", 100_000.0), "米": ("length", 100.0),
    "公斤": ("weight", 1000.0), "千克": ("weight", 1000.0), "kg": ("weight", 1000.0), "斤": ("weight", 500.0), "克": ("weight", 1.0), "g": ("weight", 1.0),
    "分钟": ("duration", 1 / 60), "小时": ("duration", 1.0), "工作日": ("duration", 24.0), "天": ("duration", 24.0), "周": ("duration", 168.0),
    "摄氏度": ("temperature", 1.0), "℃": ("temperature", 1.0), "度": ("temperature", 1.0),
}
_DIGITS = "零一二三四五六七八九"
_UNIT = "|".join(sorted(map(re.escape, UNITS), key=len, reverse=True))
_NUMBER = r"\d{1,9}(?:\.\d{1,6})?"
_RANGE = re.compile(rf"({_NUMBER})\s*(?:-|–|~|～|到|至)\s*({_NUMBER})\s*({_UNIT})", re.I)
_SINGLE = re.compile(rf"(零下\s*|-)?({_NUMBER})\s*({_UNIT})", re.I)
_CHINESE = re.compile(rf"([{_DIGITS[1:]}]?十[{_DIGITS[1:]}]?|[{_DIGITS}])(?=\s*(?:{_UNIT}))", re.I)
TYPE = "array<struct<kind:string,low:double,high:double,unit:string,start:int,stop:int>>"


def chinese_value(word: str) -> int:
    """0 to 99 of a Chinese numeral such as 二十四."""
    if "十" not in word:
        return _DIGITS.index(word)
    tens, ones = word.split("十")
    return (_DIGITS.index(tens) if tens else 1) * 10 + (_DIGITS.index(ones) if ones else 0)


def arabic(text: str) -> str:
    """Chinese numerals before a unit as digits."""
    return _CHINESE.sub(lambda m: str(chinese_value(m[1])), text)


def mentions(text: str | None) -> list[tuple[str, float, float, str, int, int]]:
    """(kind, low, high, unit, start, stop) of all measured values, in the base unit of their kind;
    spans are of the text with its numerals as digits.  Null and empty texts have none."""
    if not text:
        return []
    t, out = arabic(text), []
    taken: list[tuple[int, int]] = []
    for m in _RANGE.finditer(t):
        kind, factor = UNITS[m[3].lower()]
        a, b = sorted((float(m[1]) * factor, float(m[2]) * factor))
        out.append((kind, a, b, m[3].lower(), m.start(), m.end()))
        taken.append(m.span())
    for m in _SINGLE.finditer(t):
        if any(s < m.end() and m.start() < e for s, e in taken):
            continue
        kind, factor = UNITS[m[3].lower()]
        v = float(m[2]) * factor * (-1 if m[1] and kind == "temperature" else 1)
        out.append((kind, v, v, m[3].lower(), m.start(2) if kind != "temperature" else m.start(), m.end()))
    return sorted(out, key=lambda x: x[4])


def measured(c: Column | str) -> Column:
    """Array of all measured values of a text column."""
    names = ("kind", "low", "high", "unit", "start", "stop")

    @F.pandas_udf(TYPE)
    def parse(s: pd.Series) -> pd.Series:
        return pd.Series([[dict(zip(names, m)) for m in mentions(t)] for t in s], dtype=object)

    return parse(c)


def largest(c: Column, kind: str, low: float, high: float) -> Column:
    """The greatest value of a kind within its plausible range, or null."""
    fit = F.filter(measured(c), lambda m: (m["kind"] == kind) & (m["high"].between(low, high)))
    return F.array_max(F.transform(fit, lambda m: m["high"]))
