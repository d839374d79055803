"""Deterministic sampling by hash order."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import order_hash


def hash_sample(df: DataFrame, key: str, n: int, seed: str) -> DataFrame:
    """The n rows of least hash: the same for any partitioning.  A top-k, not a sort of all rows."""
    return df.withColumn("_h", order_hash(seed, F.col(key))).orderBy("_h", key).limit(n).drop("_h")


def one_each_then_fill(df: DataFrame, key: str, stratum: str, n: int, seed: str) -> DataFrame:
    """The first row by hash of each stratum, then the next rows by hash up to n in all."""
    d = df.withColumn("_h", order_hash(seed, F.col(key)))
    first = d.groupBy(stratum).agg(F.min(F.struct("_h", key)).alias("_m")).select(F.col(f"_m.{key}").alias("_k"))
    d = d.join(first.withColumn("_first", F.lit(0)), d[key] == F.col("_k"), "left").drop("_k")
    return d.orderBy(F.coalesce("_first", F.lit(1)), "_h", key).limit(n).drop("_h", "_first")


def quotas(df: DataFrame, key: str, stratum: str, quota: DataFrame, seed: str) -> DataFrame:
    """The first ``seats`` rows by hash of each stratum of ``quota`` (stratum, seats)."""
    d = df.withColumn("_h", order_hash(seed, F.col(key))).join(quota.select(stratum, "seats"), stratum)
    w = Window.partitionBy(stratum).orderBy("_h", key)
    return d.withColumn("_rn", F.row_number().over(w)).where("_rn <= seats").drop("_h", "_rn", "seats")


def without_used(df: DataFrame, used: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose candidate and session weren't taken by an earlier stage (one anti-join a key)."""
    for k in keys:
        df = df.join(used.select(k).distinct(), k, "left_anti")
    return df


def diverse(rows: list[dict], n: int, features: list[str], key: str, seed: str) -> list[dict]:
    """Greedy choice on the driver from a small pool: the fewest features seen so far, then hash with
    the step number; for reviewer sheets of some dozen rows."""
    import hashlib

    seen: dict[str, set] = {f: set() for f in features}
    pool, out = list(rows), []
    while pool and len(out) < n:
        step = len(out)
        best = min(pool, key=lambda r: (sum(r[f] in seen[f] for f in features), hashlib.sha256(f"{seed}|{step}|{r[key]}".encode()).hexdigest()))
        out.append(best)
        pool.remove(best)
        for f in features:
            seen[f].add(best[f])
    return out


@dataclass(frozen=True)
class Stage:
    """A stage of a sample: its name (also its seed), the rows it may take, and how many."""

    name: str
    where: Column
    n: int
    exact: bool = True


def staged(df: DataFrame, key: str, session: str, stages: list[Stage]) -> DataFrame:
    """(stage, place, key, session): stages one after the other, each by hash, no row and no session twice.

    Of each session only the row of least hash stands for a stage, so that a session of any size sends
    one row a task.  A stage that must be exact and has too few rows is an error.  The rows taken are
    few by definition, so they are brought to the driver and kept out of later stages by value.
    """
    taken: list[tuple] = []
    for s in stages:
        d = df.where(s.where & F.col(key).isNotNull() & F.col(session).isNotNull())
        if taken:
            d = d.where(~F.col(key).isin([t[2] for t in taken]) & ~F.col(session).isin([t[3] for t in taken]))
        best = d.select(session, F.struct(order_hash(s.name, F.col(key)).alias("h"), F.col(key).alias("k")).alias("_m")).groupBy(session).agg(F.min("_m").alias("_m"))
        rows = best.orderBy("_m").limit(s.n).collect()  # the size of the sample
        if s.exact and len(rows) < s.n:
            raise ValueError(f"stage {s.name} has {len(rows)} rows of {s.n}")
        taken += [(s.name, i, r["_m"]["k"], r[session]) for i, r in enumerate(rows, 1)]
    kind = lambda c: df.schema[c].dataType.simpleString()
    return df.sparkSession.createDataFrame(taken, f"stage string, place int, {key} {kind(key)}, {session} {kind(session)}")
