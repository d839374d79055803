"""The searchable corpus: question/answer rows and snippets with unique ids."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text

COLUMNS = ["doc_id", "source_type", "category", "title", "text_for_embedding", "answer_or_content", "priority", "allowed_for_answer", "needs_backend_api", "source_file", "session_id", "ordinal"]


def from_pairs(df: DataFrame) -> DataFrame:
    """(session_id, row_index, question, answer, category, source_file) to corpus rows.

    Blank questions or answers are left out; ids count the rows before that.
    """
    q, a = text.strip(F.coalesce("question", F.lit(""))), text.strip(F.coalesce("answer", F.lit("")))
    d = df.withColumns({"q": q, "a": a}).where("q <> '' and a <> ''")
    return d.select(
        F.concat_ws("_", F.lit("qa"), "session_id", "row_index").alias("doc_id"), F.lit("chat_qa").alias("source_type"), text.or_other(F.col("category")).alias("category"), F.lit("").alias("title"), F.col("q").alias("text_for_embedding"),
        F.col("a").alias("answer_or_content"), F.lit(50).alias("priority"), F.lit(True).alias("allowed_for_answer"), F.lit(False).alias("needs_backend_api"), "source_file", "session_id", F.col("row_index").try_cast("long").alias("ordinal"),
    )


def from_snippets(df: DataFrame) -> DataFrame:
    """Allowed snippets with content; text columns as they come from CSV."""
    d = df.where(text.flag(F.col("allowed_for_answer")) & (text.strip(F.coalesce("content", F.lit(""))) != ""))
    return d.select(
        F.concat(F.lit("snippet_"), F.translate("original_key", ", ", "__")).alias("doc_id"), F.coalesce("source_type", F.lit("snippet")).alias("source_type"), text.or_other(F.col("category")).alias("category"), F.coalesce("title", F.lit("")).alias("title"),
        text.embedding_text(F.col("category"), F.col("title"), F.col("content")).alias("text_for_embedding"), text.strip(F.col("content")).alias("answer_or_content"), F.coalesce(F.col("priority").try_cast("int"), F.lit(70)).alias("priority"),
        F.lit(True).alias("allowed_for_answer"), text.flag(F.col("needs_backend_api")).alias("needs_backend_api"), "source_file", F.lit("").alias("session_id"), F.col("row_index").try_cast("long").alias("ordinal"),
    )


def unique_ids(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Rows of a repeated id get '__dup_k' in order; numbers that are taken anywhere are skipped.

    Repeats are numbered by a window over the repeated ids only; ids that literally look like a
    number of another id are looked up, and only ids with such neighbours take the sequential rule.
    """
    counts = df.groupBy(key).agg(F.count("*").alias("_n"))
    taken = counts.where(F.col(key).rlike(r"__dup_\d+$")).select(F.regexp_extract(key, r"^(.*)__dup_(\d+)$", 1).alias(key), F.regexp_extract(key, r"__dup_(\d+)$", 1).cast("int").alias("_k"))
    taken = taken.groupBy(key).agg(F.sort_array(F.collect_set("_k")).alias("_taken"))
    d = df.join(counts.where("_n > 1"), key, "left").join(taken, key, "left")
    once = d.where("_n is null").drop("_n", "_taken")
    w = Window.partitionBy(key).orderBy(*order)
    many = d.where("_n is not null").withColumn("_rn", F.row_number().over(w))
    # The number of the r-th row is r, moved on by the taken numbers at or below it.
    moved = F.aggregate(F.coalesce("_taken", F.array().cast("array<int>")), F.col("_rn"), lambda acc, t: F.when((t >= 2) & (t <= acc), acc + 1).otherwise(acc))
    many = many.withColumn(key, F.when(F.col("_rn") == 1, F.col(key)).otherwise(F.concat(key, F.lit("__dup_"), moved.cast("string")))).drop("_n", "_taken", "_rn")
    return once.unionByName(many)


def mixed(pairs: DataFrame, snippets: DataFrame) -> DataFrame:
    """Both kinds of rows with unique ids; pairs come first."""
    both = pairs.withColumn("_part", F.lit(0)).unionByName(snippets.withColumn("_part", F.lit(1)))
    return unique_ids(both, "doc_id", ["_part", "ordinal"]).drop("_part").select(*COLUMNS)


def embed(df: DataFrame, content: str, model, size: int, out: str = "embedding") -> DataFrame:
    """Append unit vectors of a model (list of texts -> array of vectors), in Arrow batches."""

    @F.pandas_udf("array<float>")
    def vectors(s: pd.Series) -> pd.Series:
        import numpy as np

        v = np.asarray(model(list(s.fillna(""))), dtype=np.float32).reshape(-1, size)
        n = np.linalg.norm(v, axis=1, keepdims=True)
        return pd.Series(list(v / np.where(n == 0, 1, n)))

    return df.withColumn(out, vectors(content))
