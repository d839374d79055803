"""Gates that say why a text or a pair is turned away, as one label a row; word lists are arguments."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Marks that don't count, questions and answers without content, placeholders.
MARKS = r"[\s　，,。.!！?？~～、；;：:…·\-—_（）()【】\[\]{}]+"
EMPTY_QUESTIONS = ("你好", "在吗", "亲", "嗯", "好的", "谢谢", "")
EMPTY_ANSWERS = ("好的", "可以的", "嗯嗯", "稍等", "在的亲", "")
PRIVATE_SIGNS = r"\[(?:NAME|PHONE|ADDRESS|EMAIL|ORDER_ID|PRODUCT_ID|TRACKING_ID|LONG_NUMBER)\]"
ONLY_PRIVATE = ("[NAME]", "[PHONE]", "[ADDRESS]", "[EMAIL]", "[ORDER_ID]")
ONLY_LINKS = r"^(?:\[(?:IMAGE_LINK|PRODUCT_LINK|URL|EMOJI_CODE)\][\s，,；;]*)+$"
KEYWORDS = "尺码 码数 颜色 运费 快递 物流 材质 质量 发货 退货 换货 退款 防滑 正品 增高 保暖 鞋底 补偿 赔偿 地址".split()


def bare(c: Column) -> Column:
    """Lower case without marks; null gives ''."""
    return F.lower(F.regexp_replace(F.coalesce(c, F.lit("")), MARKS, ""))


def question_problem(c: Column, business: list[str]) -> Column:
    """'empty_or_invalid_question', 'pii_only_question' or null.

    A null question is empty.  One that is nothing but placeholders is only private, unless it holds
    a business word.
    """
    text = F.trim(F.coalesce(c, F.lit("")))
    invalid = (F.length(bare(text)) < 2) | bare(text).isin(*EMPTY_QUESTIONS) | text.rlike(ONLY_LINKS) | text.isin(*ONLY_PRIVATE)
    rest = F.regexp_replace(F.regexp_replace(text, PRIVATE_SIGNS, ""), MARKS, "")
    business_word = text.rlike("|".join(business)) if business else F.lit(False)
    private = ~business_word & (F.length(rest) <= 1) & text.rlike(PRIVATE_SIGNS)
    return F.when(invalid, "empty_or_invalid_question").when(private, "pii_only_question")


def answer_problem(c: Column) -> Column:
    """'empty_or_invalid_answer' or null; a null answer is empty."""
    return F.when(bare(c).isin(*EMPTY_ANSWERS), "empty_or_invalid_answer")


def bare_keyword(c: Column, keywords: list[str] = KEYWORDS) -> Column:
    """The keyword that a question is nothing but, or null."""
    return F.when(bare(c).isin(*keywords), bare(c))


def pair_problem(question: Column, answer: Column, category: Column, residual: Column, business: list[str]) -> Column:
    """First problem of a pair: private data left, question, answer, category; or null."""
    none = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    return (
        F.when(residual, "pii_residual")
        .when(question_problem(question, business).isNotNull(), F.when(none(question), "empty_question").otherwise("invalid_short_input"))
        .when(answer_problem(answer).isNotNull(), "empty_answer")
        .when(none(category), "missing_category")
    )
