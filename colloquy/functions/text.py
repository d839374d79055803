"""Text normalisers and predicates as native column expressions.

Character classes carry (?U), as white space and digits of all scripts count.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Marks that a comparison key ignores, and the wider class with brackets and dashes.
KEY_MARKS = r"(?U)[\s　，,。.!！?？~～、；;：:…·\-]+"
WIDE_MARKS = r"(?U)[\s　，,。.!！?？~～、；;：:…·\-—_()（）\[\]【】{}《》<>\"'“”‘’/\\|]+"
SENTENCE_MARKS = r"[；;。！？!?\n]+"
URL = r"(?i)(?:https?://|www\.)\S+"
IMAGE = r"(?i)\.(?:jpe?g|png|gif|webp|bmp)(?:[?#]\S*)?\b"
IMAGE_TOKEN = r"(?i)^(?:\[?图片\]?|\[?image\]?|图片链接|查看图片|发送了一张图片)$"
EMOTE = r"(?i)#\s*E\s*[-_]\s*[A-Z]\s*\d+"
VISIBLE = r"[㐀-鿿A-Za-z0-9]"
TRUE_WORDS, FALSE_WORDS = ("true", "1", "yes", "y"), ("false", "0", "no", "n", "")


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def key(c: Column) -> Column:
    """Comparison key: marks and spaces out, lower case; null gives ''."""
    return F.lower(F.regexp_replace(F.coalesce(c, F.lit("")), KEY_MARKS, ""))


def wide_key(c: Column) -> Column:
    return F.lower(F.regexp_replace(F.coalesce(c, F.lit("")), WIDE_MARKS, ""))


def compact_query(c: Column) -> Column:
    """All white space out."""
    return F.regexp_replace(c, r"(?U)\s+", "")


def squeeze(c: Column) -> Column:
    """Control characters out, runs of blanks to one, blank lines out."""
    c = F.regexp_replace(c, r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", "")
    return strip(F.regexp_replace(F.regexp_replace(c, r"[ \t]+", " "), r"\s*\n\s*", "\n"))


def or_other(c: Column, other: str = "其他") -> Column:
    return F.coalesce(F.nullif(strip(c), F.lit("")), F.lit(other))


def flag(c: Column, default: bool = False) -> Column:
    """Text to boolean; a word that is neither true nor false gives the default."""
    w = F.lower(strip(F.coalesce(c, F.lit(""))))
    return F.when(w.isin(*TRUE_WORDS), True).when(w.isin(*FALSE_WORDS), False).otherwise(default)


def joined(*cols: Column, sep: str = " ") -> Column:
    """Parts that aren't blank, joined."""
    return F.concat_ws(sep, *[F.nullif(strip(c), F.lit("")) for c in cols])


def embedding_text(category: Column, title: Column, content: Column, most: int = 240) -> Column:
    return joined(category, title, F.substring(content, 1, most))


def content_kind(c: Column) -> Column:
    return F.when(c.rlike(URL) | c.rlike(IMAGE), "image_or_link").otherwise("text")


def only_links(c: Column) -> Column:
    """Every piece between blanks and semicolons is a link or a picture mark."""
    pieces = F.filter(F.split(c, r"(?U)[\s；;]+"), lambda x: x != "")
    return (F.size(pieces) > 0) & F.forall(pieces, lambda x: x.rlike("^" + URL + "$") | x.rlike(IMAGE_TOKEN))


def clean_customer(c: Column, noise: list[str]) -> Column:
    """A customer's message as one line; '' for blank, noise, links only, nothing visible."""
    v = F.regexp_replace(F.regexp_replace(c, "﻿", ""), r"^[ \t\r\n；;]+|[ \t\r\n；;]+$", "")
    drop = (v == "") | only_links(v) | key(v).isin("", *noise) | ~v.rlike(VISIBLE)
    return F.when(c.isNull() | drop, "").otherwise(F.regexp_replace(v, r"\s*\r?\n\s*", "；"))


def clean_service(c: Column, noise: list[str], template: str) -> Column:
    """A service's message: as the customer's, without emoticon codes and unsupported templates."""
    v = F.regexp_replace(F.regexp_replace(c, "﻿", ""), r"^[ \t\r\n；;]+|[ \t\r\n；;]+$", "")
    bare = F.regexp_replace(F.regexp_replace(v, EMOTE, ""), r"^[ \t，,。；;：:]+|[ \t，,。；;：:]+$", "")
    drop = (v == "") | only_links(v) | v.rlike(template) | key(bare).isin("", *noise) | ~bare.rlike(VISIBLE)
    return F.when(c.isNull() | drop, "").otherwise(F.regexp_replace(bare, r"\s*\r?\n\s*", "；"))


def key_phrases(c: Column, generic: list[str]) -> Column:
    """Distinct normalised sentences of two or more characters, without generic ones, in order."""
    pieces = F.transform(F.split(F.coalesce(c, F.lit("")), SENTENCE_MARKS), lambda x: key(x))
    return F.array_distinct(F.filter(pieces, lambda x: (F.length(x) >= 2) & ~x.isin(*generic)))


def keywords_in(c: Column, words: list[str]) -> Column:
    """The words contained in a text, in the order of the list."""
    return F.filter(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(F.coalesce(c, F.lit("")), w))


def contains_any(c: Column, words: list[str]) -> Column:
    """One alternation instead of a scan a word."""
    return F.coalesce(c.rlike("|".join(re.escape(w) for w in sorted(words, key=len, reverse=True))), F.lit(False)) if words else F.lit(False)


def specificity(c: Column, words: list[str]) -> Column:
    """(keywords, digits, length) of an answer, comparable in this order."""
    k = key(c)
    return F.struct(F.size(keywords_in(c, words)).alias("keywords"), F.regexp_count(k, F.lit(r"\d")).alias("digits"), F.length(k).alias("length"))


def effective_length(c: Column) -> Column:
    return F.regexp_count(F.coalesce(c, F.lit("")), F.lit(VISIBLE))


def garbled_markers(c: Column, markers: list[str]) -> Column:
    """Does a text hold one of the marker sequences?"""
    return contains_any(c, markers)


def summary(c: Column, most: int = 96) -> Column:
    return F.substring(F.regexp_replace(strip(c), r"(?U)\s+", " "), 1, most)


def stable_id(length: int, *parts: Column) -> Column:
    """Hex digits of the SHA-256 of the parts, separated by a zero character."""
    return F.substring(F.sha2(F.concat_ws("\0", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256), 1, length)


def order_hash(seed: str, *parts: Column) -> Column:
    """Hash that orders rows in a fixed random way."""
    return F.sha2(F.concat_ws("|", F.lit(seed), *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)


def folded_key(c: Column) -> Column:
    """Comparison key of a question: compatibility forms unified, repeated final particles once."""
    import unicodedata

    import pandas as pd

    def fold(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))

    fold.__annotations__ = {"s": pd.Series, "return": pd.Series}
    wide = F.pandas_udf(fold, "string")(F.coalesce(c, F.lit("")))
    return key(F.regexp_replace(strip(F.regexp_replace(wide, r"(?U)\s+", " ")), r"([啊呀呢吗吧哦噢哈嘛啦])\1+", "$1"))
