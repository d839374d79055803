"""Rule packs as data: first match, all matches, rewriting.

A pack is a list of (label, words) in order of priority.  Packs are arguments, so the same operators
serve any language; each label compiles to one alternation, evaluated in the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text

# The categories of shop questions, in order, and the topics of follow-ups.
CATEGORIES = [
    ("尺码问题", ["尺码", "码数", "偏大", "偏小"]),
    ("退货退款", ["退货", "退款"]),
    ("换货", ["换货"]),
    ("运费", ["运费"]),
    ("物流发货", ["发货", "快递", "物流", "拒收", "派送", "地址", "拦截"]),
    ("质量问题", ["质量", "开胶", "发错"]),
    ("商品咨询", ["材质", "防滑", "正品", "颜色", "款式", "增高", "保暖"]),
    ("价格补偿", ["补偿", "赔偿", "京东余额"]),
    ("库存问题", ["无货"]),
]
BUSINESS_WORDS = [w for _, words in CATEGORIES for w in words]


def first_match(c: Column, pack: list[tuple[str, list[str]]]) -> Column:
    """Label of the first rule whose word is contained; null without one (also for null)."""
    out = None
    for label, words in pack:
        hit = text.contains_any(c, words)
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return out


def all_matches(c: Column, pack: list[tuple[str, list[str]]]) -> Column:
    """Labels of all rules that match, in the order of the pack."""
    return F.array_compact(F.array(*[F.when(text.contains_any(c, words), label) for label, words in pack]))


def named_patterns(c: Column, patterns: dict[str, str]) -> Column:
    """Names of the regular expressions that match, in order."""
    return F.array_compact(F.array(*[F.when(c.rlike(p), name) for name, p in patterns.items()]))


def classify(question: Column, answer: Column, pack: list[tuple[str, list[str]]] = CATEGORIES, other: str = "其他") -> Column:
    """First rule that the question matches, else that the answer matches, else ``other``."""
    return F.coalesce(first_match(question, pack), first_match(answer, pack), F.lit(other))


def refine(category: Column, question: Column, pack: list[tuple[str, list[str]]], renamed: dict[str, str], other: str = "其他") -> Column:
    """A finer category by the question alone; without a match the old one, renamed where asked."""
    old = category
    for a, b in renamed.items():
        old = F.when(category == a, b).otherwise(old)
    return F.coalesce(first_match(question, pack), old, F.lit(other))


def rejections(question: Column, answer: Column, words: list[str], followups: list[str], bad_answers: list[str]) -> Column:
    """Labels of the quality gate, in order: context_missing, too_short_question, bad_answer."""
    q, a = F.coalesce(question, F.lit("")), F.coalesce(answer, F.lit(""))
    return F.array_compact(
        F.array(
            F.when((q == "") | text.key(q).isin(*followups), "context_missing"),
            F.when((F.length(q) < 6) & ~text.contains_any(q, words), "too_short_question"),
            F.when((F.length(a) < 10) | text.key(a).isin(*bad_answers), "bad_answer"),
        )
    )


def gate(question: Column, greetings: list[str], placeholders: str = r"^(?:\[[A-Z_]+\][\s，,。]*)+$") -> Column:
    """One reason why a question is no use, by precedence; null if it is good."""
    k = text.wide_key(question)
    return (
        F.when(F.coalesce(text.strip(question), F.lit("")) == "", "empty")
        .when(k == "", "punctuation_only")
        .when(F.length(k) < 2, "too_short")
        .when(k.isin(*greetings), "greeting")
        .when(text.only_links(question), "link_only")
        .when(question.rlike(placeholders), "pii_only")
    )


def rewrite_rows(df: DataFrame, risky: Column, rewritten: Column) -> DataFrame:
    """Zero to two rows for each: the rejected original and, where there is one, its rewrite."""
    original = F.struct(F.when(F.size(risky) > 0, "rejected").otherwise("accepted").alias("status"), F.col("content").alias("final_content"))
    second = F.struct(F.lit("rewritten").alias("status"), rewritten.alias("final_content"))
    both = F.when((F.size(risky) > 0) & rewritten.isNotNull(), F.array(original, second)).otherwise(F.array(original))
    return df.withColumn("_x", F.explode(both)).select(*df.columns, "_x.status", "_x.final_content")
