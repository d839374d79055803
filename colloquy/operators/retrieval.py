"""Cosine top-k retrieval over stored vectors, rule re-ranking and filters.

The query set comes in blocks small enough to broadcast (its size is checked); every vector is read
once a block; each task keeps the best k of each query, so at most tasks x queries x k rows are
shuffled.  A zero or null vector has no similarity and is never returned; equal similarities go to
the smaller id.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 20_000


def top_k(corpus: DataFrame, queries: DataFrame, k: int, corpus_id: str, query_id: str, vector: str = "embedding", block: int = BLOCK) -> DataFrame:
    """(query_id, corpus_id, similarity, rank): exact, for every query against every vector."""
    spark = corpus.sparkSession
    out = None
    last = None
    while True:
        q = queries.where(F.col(vector).isNotNull() & F.col(query_id).isNotNull())
        q = (q if last is None else q.where(F.col(query_id) > last)).orderBy(query_id).limit(block)
        rows = q.select(query_id, vector).collect()  # one block of the query set
        if not rows:
            break
        last = rows[-1][query_id]
        part = _block(corpus, rows, k, corpus_id, query_id, vector)
        out = part if out is None else out.unionByName(part)
        if len(rows) < block:
            break
    schema = f"{query_id} {queries.schema[query_id].dataType.simpleString()}, {corpus_id} {corpus.schema[corpus_id].dataType.simpleString()}, similarity double"
    if out is None:
        return spark.createDataFrame([], schema + ", rank int")
    w = Window.partitionBy(query_id).orderBy(F.col("similarity").desc(), corpus_id)
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _block(corpus, rows, k, corpus_id, query_id, vector):
    ids = [r[query_id] for r in rows]
    m = np.array([r[vector] for r in rows], dtype=np.float64)
    norm = np.linalg.norm(m, axis=1)
    ids, m = [i for i, n in zip(ids, norm) if n > 0], m[norm > 0] / norm[norm > 0, None]

    def work(batches):
        best: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for pdf in batches:
            v = [(i, x) for i, x in zip(pdf[corpus_id], pdf[vector]) if x is not None]
            if not v or not ids:
                continue
            c = np.array([i for i, _ in v])
            x = np.stack([y for _, y in v]).astype(np.float64)
            n = np.linalg.norm(x, axis=1)
            c, x = c[n > 0], x[n > 0] / n[n > 0, None]
            for at in range(0, len(ids), 512):
                s = m[at : at + 512] @ x.T
                # Only what reaches the batch's k-th value, ties included, is sorted.
                least = -np.partition(-s, k - 1, axis=1)[:, k - 1] if s.shape[1] > k else np.full(len(s), -np.inf)
                for j, row in enumerate(s):
                    old = best.get(at + j)
                    new = np.flatnonzero(row >= (least[j] if old is None or len(old[1]) < k else max(least[j], old[1][-1])))
                    ci, si = (c[new], row[new]) if old is None else (np.concatenate([old[0], c[new]]), np.concatenate([old[1], row[new]]))
                    take = np.lexsort((ci, -si))[:k]
                    best[at + j] = (ci[take], si[take])
        if best:
            keys = list(best)
            yield pd.DataFrame({query_id: np.repeat([ids[i] for i in keys], [len(best[i][0]) for i in keys]), corpus_id: np.concatenate([best[i][0] for i in keys]), "similarity": np.concatenate([best[i][1] for i in keys])})

    kind = corpus.schema[corpus_id].dataType.simpleString()
    return corpus.select(corpus_id, vector).mapInPandas(work, f"{query_id} {kind}, {corpus_id} {kind}, similarity double")


def rerank(results: DataFrame, query: str, similarity: str, rank: str, bonuses: list[tuple[str, Column, float]]) -> DataFrame:
    """Additive rules: append score, reasons (';'-joined names that applied) and new_rank.

    bonuses: (name, condition, amount); ties go by similarity, then by the old rank.
    """
    score, names = F.col(similarity), []
    for name, when, amount in bonuses:
        hit = F.coalesce(when, F.lit(False))
        score = score + F.when(hit, amount).otherwise(0.0)
        names.append(F.when(hit, name))
    w = Window.partitionBy(query).orderBy(F.col("score").desc(), F.col(similarity).desc(), rank)
    return results.withColumns({"score": score, "reasons": F.concat_ws(";", *names)}).withColumn("new_rank", F.row_number().over(w))


def soft_filter(results: DataFrame, query: str, keep: Column) -> DataFrame:
    """Rows that pass, or all rows of a query of which none passes."""
    ok = F.coalesce(keep, F.lit(False))
    return results.withColumn("_ok", ok).withColumn("_any", F.max("_ok").over(Window.partitionBy(query))).where("_ok or not _any").drop("_ok", "_any")


def low_confidence(results: DataFrame, query: str, similarity: str, least: float = 0.55) -> DataFrame:
    """(query, best, low): is the best similarity of a query under the threshold?"""
    return results.groupBy(query).agg(F.max(similarity).alias("best")).withColumn("low", F.col("best") < least)


def quarantine(results: DataFrame, listed: DataFrame, keys: list[str]) -> DataFrame:
    """Without the rows listed by all of ``keys``."""
    return results.join(listed.select(*keys).distinct(), keys, "left_anti")


def answer(results: DataFrame, query: str, rank: str, similarity: str, content: str, fallback: str, least: float = 0.55) -> DataFrame:
    """(query, answer, source): the best row's content if it is sure enough, else the fallback."""
    first = results.groupBy(query).agg(F.min_by(F.struct(content, similarity), rank).alias("_r"))
    sure = (F.col(f"_r.{similarity}") >= least) & (F.length(F.col(f"_r.{content}")) > 0)
    return first.select(query, F.when(sure, F.col(f"_r.{content}")).otherwise(fallback).alias("answer"), F.when(sure, "retrieved").otherwise("fallback").alias("source"))
