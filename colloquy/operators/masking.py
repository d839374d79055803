"""Ordered masking by patterns, natively, with counts by type; ids without names.

The chain runs in the JVM: each pattern is replaced in turn, and its matches are counted on the text
it meets.  (The learned masking of personal data is an operator of its own.)
"""

from __future__ import annotations

import hashlib
import hmac
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The chain in its order.  Guards around digit runs are part of the greedy match.
CHAIN = [
    ("EMOTE", r"#E-[a-z][0-9]+", ""),
    ("URL", r"(?:https?://|www\.)[^ ，。；\n]+", "[URL]"),
    ("EMAIL", r"[A-Za-z0-9][A-Za-z0-9._+-]{0,63}@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "[EMAIL]"),
    ("ORDER_ID", r"(?:订单号|订单编号|单号)[:： ]?[0-9]{8,}", "[ORDER_ID]"),
    ("TRACKING_ID", r"SD[0-9]{10,}", "[TRACKING_ID]"),
    ("LONG_NUMBER", r"[0-9]{15,}", "[LONG_NUMBER]"),
    ("PHONE", r"1[3-9][0-9]{9}", "[PHONE]"),
    ("LANDLINE", r"0[0-9]{2,3}-[0-9]{7,8}", "[PHONE]"),
]


def mask(df: DataFrame, content: str, chain: list[tuple[str, str, str]] = CHAIN) -> DataFrame:
    """Append masked (null stays null), n_<TYPE> for each type and pii_types (sorted)."""
    d = df.withColumn("masked", F.col(content))
    for name, pattern, to in chain:
        d = d.withColumn(f"n_{name}", F.coalesce(F.regexp_count("masked", F.lit(pattern)), F.lit(0)))
        # One use of the text a stage, so that a filter pushed through the chain stays small.
        d = d.withColumn("masked", F.regexp_replace("masked", pattern, re.sub(r"([\\$])", r"\\\1", to)))
    types = F.array_sort(F.array_compact(F.array(*[F.when(F.col(f"n_{n}") > 0, n) for n, *_ in chain])))
    return d.withColumn("pii_types", types)


def mask_counts(df: DataFrame, content: str, chain: list[tuple[str, str, str]] = CHAIN) -> DataFrame:
    """(pii_type, matches, texts)."""
    m = mask(df, content, chain)
    cells = [F.struct(F.lit(n).alias("pii_type"), F.col(f"n_{n}").cast("long").alias("n")) for n, *_ in chain]
    return m.select(F.inline(F.array(*cells))).groupBy("pii_type").agg(F.sum("n").alias("matches"), F.count_if(F.col("n") > 0).alias("texts"))


def residual(df: DataFrame, content: str, chain: list[tuple[str, str, str]] = CHAIN) -> DataFrame:
    """Texts that the chain would still change."""
    return mask(df, content, chain).where(F.size("pii_types") > 0)


def replace_markers(c: Column, markers: list[str], to: str = "[PRIVATE]") -> Column:
    """Literal markers, longest first, replaced in one pass; those of one character are ignored."""
    words = sorted({m for m in markers if len(m) >= 2}, key=lambda m: (-len(m), m))
    return F.regexp_replace(c, "|".join(re.escape(w) for w in words), re.sub(r"([\\$])", r"\\\1", to)) if words else c


def mask_addresses(c: Column, marks: str, to: str = "[ADDRESS]") -> Column:
    """Sentences with two address marks or more become a placeholder; marks between sentences stay."""
    parts = F.regexp_extract_all(c, F.lit(r"([^。！？；，\n]+|[。！？；，\n]+)"), F.lit(1))
    return F.array_join(F.transform(parts, lambda s: F.when(F.regexp_count(s, F.lit(marks)) >= 2, to).otherwise(s)), "")


def blind_id(df: DataFrame, parts: list[str], key: bytes, prefix: str, out: str) -> DataFrame:
    """Append a keyed hash: prefix and 24 hex digits of HMAC-SHA256 over the parts."""

    @F.pandas_udf("string")
    def digest(s: pd.Series) -> pd.Series:
        return s.map(lambda x: prefix + hmac.new(key, x.encode(), hashlib.sha256).hexdigest()[:24])

    return df.withColumn(out, digest(F.concat_ws("\0", *[F.coalesce(F.col(p).cast("string"), F.lit("")) for p in parts])))


def blinded(df: DataFrame, section: str, key: str, secret: bytes, prefix: str) -> tuple[DataFrame, DataFrame]:
    """(sheet, mapping) for reviewers: the sheet has blind ids instead of keys and a place within its
    section by the order of the ids, so that nothing of the source's order is left; the mapping has
    both ids.  Rows of equal section and key are one item; null keys are left out."""
    d = blind_id(df.where(F.col(key).isNotNull()), [section, key], secret, prefix, "blind_id").dropDuplicates([section, "blind_id"])
    place = F.row_number().over(Window.partitionBy(section).orderBy("blind_id"))
    return d.withColumn("place", place).drop(key), d.select(section, key, "blind_id")
