"""Claims in answers: clauses that assert something, unless a marker before them takes it back.

Patterns and markers are arguments.  The look-back is bounded, so the work of a text is linear.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CLAUSE = re.compile(r"[^。！？!?；;\n]+[。！？!?；;\n]*|[。！？!?；;\n]+")


def unqualified(text: str, pattern: re.Pattern, markers: list[str], back: int = 16) -> bool:
    """Is there a match without a marker in the ``back`` characters before it?"""
    return any(not any(m in text[max(0, x.start() - back) : x.start()] for m in markers) for x in pattern.finditer(text))


def last_polarity(text: str, positive: re.Pattern, negations: list[str], back: int = 4) -> bool | None:
    """What the last mention says: True, False if negated shortly before, None without mention."""
    result = None
    for m in positive.finditer(text):
        result = not any(n in text[max(0, m.start() - back) : m.start()] for n in negations)
    return result


def drop_claims(df: DataFrame, content: str, families: dict[str, str], markers: list[str], boundary: str, back: int = 16) -> DataFrame:
    """Append answer (clauses with an unqualified claim left out, ``boundary`` added where one was)
    and blocked (the families that were hit, sorted).  Null stays null."""
    compiled = {k: re.compile(p) for k, p in families.items()}

    def one(text: str | None) -> dict:
        if text is None:
            return {"answer": None, "blocked": []}
        keep, blocked = [], set()
        for clause in CLAUSE.findall(text):
            hit = {k for k, p in compiled.items() if unqualified(clause, p, markers, back)}
            blocked |= hit
            if not hit:
                keep.append(clause)
        return {"answer": "".join(keep) + (boundary if blocked else ""), "blocked": sorted(blocked)}

    @F.pandas_udf("struct<answer:string,blocked:array<string>>")
    def checked(s: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([one(t) for t in s], columns=["answer", "blocked"]).astype(object)

    return df.withColumn("_c", checked(content)).withColumns({"answer": F.col("_c.answer"), "blocked": F.col("_c.blocked")}).drop("_c")


def tidy_answer(c: Column, greetings: list[str], end: str = "。") -> Column:
    """Sentences that are only greetings out, leading greetings off the rest, one closing mark."""
    words = "|".join(re.escape(w) for w in sorted(greetings, key=len, reverse=True))
    parts = F.filter(F.split(F.coalesce(c, F.lit("")), r"[。！!？?\n]+"), lambda s: F.trim(s) != "")
    bare = F.transform(parts, lambda s: F.trim(F.regexp_replace(s, rf"^\s*(?:(?:{words})[，,、~～\s]*)+", "")))
    kept = F.filter(bare, lambda s: s != "")
    return F.when(c.isNull(), None).when(F.size(kept) == 0, "").otherwise(F.concat(F.array_join(kept, end), F.lit(end)))


def relevant_sentences(c: Column, words: list[str], most: int = 2, end: str = "。") -> Column:
    """The first sentences that hold one of the words."""
    from ..functions.text import contains_any

    hit = F.filter(F.split(F.coalesce(c, F.lit("")), r"[。！!？?\n]+"), lambda s: contains_any(s, words))
    return F.when(F.size(hit) > 0, F.concat(F.array_join(F.slice(hit, 1, most), end), F.lit(end)))
