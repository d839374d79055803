"""Summaries, agreement and exact paired tests."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _places(df: DataFrame, by: list[str], value: str, places) -> DataFrame:
    """One row a group with the values at places, 0-based, of its sorted values; nulls don't count.

    places: name -> function of the group's number of values.  Equal values are counted before the
    shuffle, and a group's distinct ones stream through a sorted window that spills.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("_v")).agg(F.count("*").alias("_n"))
    w = Window.partitionBy(*(by or [F.lit(1)]))
    counts = counts.withColumns({"_upto": F.sum("_n").over(w.orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)), "_all": F.sum("_n").over(w)})
    at = lambda i: F.max(F.when((F.col("_upto") > i) & (F.col("_upto") - F.col("_n") <= i), F.col("_v")))
    return counts.groupBy(*by).agg(*[at(f(F.col("_all"))).alias(name) for name, f in places.items()], F.max("_all").alias("_all"))


def _beside(df: DataFrame, other: DataFrame, by: list[str]) -> DataFrame:
    """Left join of tables with one row a group, in which a null key is a key."""
    o = other.select(*[F.col(c).alias(f"_by{i}") for i, c in enumerate(by)], *[c for c in other.columns if c not in by])
    if not by:
        return df.join(o)  # one row each
    on = F.lit(True)
    for i, c in enumerate(by):
        on = on & F.col(c).eqNullSafe(F.col(f"_by{i}"))
    return df.join(o, on, "left").drop(*[f"_by{i}" for i in range(len(by))])


def _between(fraction: float) -> dict:
    place = lambda n: (n - 1) * F.lit(float(fraction))
    return {"_lo": lambda n: F.floor(place(n)), "_hi": lambda n: F.ceil(place(n))}


def _interpolated(fraction: float) -> Column:
    place = (F.col("_all") - 1) * F.lit(float(fraction))
    part = place - F.floor(place)
    return F.when(part == 0, F.col("_lo").cast("double")).otherwise((1 - part) * F.col("_lo") + part * F.col("_hi"))


def numeric_summary(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by, n, mean, sd, median, low, high): sample standard deviation, interpolated median."""
    v = F.col(value)
    base = df.groupBy(*by).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("sd"), F.min(v).alias("low"), F.max(v).alias("high"))
    return _beside(base, _places(df, by, value, _between(0.5)), by).select(*by, "n", "mean", "sd", _interpolated(0.5).alias("median"), "low", "high")


def binary_summary(df: DataFrame, by: list[str], passed: Column) -> DataFrame:
    """(by, passed, failed, rate); null is not applicable, without any the rate is null."""
    p, f = F.count_if(passed), F.count_if(~passed)
    return df.groupBy(*by).agg(p.alias("passed"), f.alias("failed"), F.when(p + f > 0, p / (p + f)).alias("rate"))


def distribution(df: DataFrame, value: str, domain: list | None = None) -> DataFrame:
    """(value, n), zero where a value of the domain doesn't occur."""
    counts = df.groupBy(value).agg(F.count("*").alias("n"))
    if domain is None:
        return counts
    kind = df.schema[value].dataType.simpleString()
    return df.sparkSession.createDataFrame([(x,) for x in domain], f"{value} {kind}").join(counts, value, "left").fillna(0, ["n"])


def nearest_rank(df: DataFrame, by: list[str], value: str, fraction: float) -> DataFrame:
    """Nearest-rank percentile: the value at place ceil(fraction * n); null for a group without values."""
    first = {"percentile": lambda n: F.greatest(F.ceil(n * F.lit(float(fraction))) - 1, F.lit(0))}
    return _beside(df.groupBy(*by).agg(F.count("*").alias("_rows")), _places(df, by, value, first), by).select(*by, "percentile")


def linear_quantile(df: DataFrame, by: list[str], value: str, fraction: float) -> DataFrame:
    """Quantile between the two nearest places; null for a group without values."""
    return _beside(df.groupBy(*by).agg(F.count("*").alias("_rows")), _places(df, by, value, _between(fraction)), by).select(*by, _interpolated(fraction).alias("quantile"))


def mid_ranks(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Append ``mid_rank``: the mean rank of ties.  Sums per value first, so ties of any number are
    one row of the window."""
    counts = df.groupBy(*by, value).agg(F.count("*").alias("_n"))
    w = Window.partitionBy(*by).orderBy(value)
    below = F.coalesce(F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranks = counts.withColumn("mid_rank", below + (F.col("_n") + 1) / 2).drop("_n")
    return df.join(ranks, [*by, value])


#: Pairs up to which the signed-rank distribution is exact; beyond, the normal one with tie correction.
EXACT_PAIRS = 2000


def signed_rank_p(sizes: list[tuple[float, int, int]], pairs: int) -> tuple[float | None, float | None, float | None, float | None]:
    """(W+, W-, two-sided p, rank-biserial) from (size, number above 0, number below 0) of the
    differences that aren't zero.  Without any, p is 1 and the effect 0 if there were pairs at all,
    else all is null.  The null distribution of the doubled rank sum is built up rank by rank.
    """
    if not pairs:
        return None, None, None, None
    ranks, plus, below = [], 0, 0
    for _, up, down in sorted(sizes):
        n = up + down
        twice = 2 * below + n + 1  # twice the mean rank
        ranks.append((twice, n))
        plus, below = plus + twice * up, below + n
    total = sum(r * n for r, n in ranks)
    if not total:
        return 0.0, 0.0, 1.0, 0.0
    small = min(plus, total - plus)
    if below <= EXACT_PAIRS:
        ways = np.zeros(small + 1)
        ways[0] = 1.0
        for r, n in ranks:
            for _ in range(n):
                moved = np.zeros_like(ways)
                moved[r:] = ways[: max(0, small + 1 - r)]
                ways = (ways + moved) / 2
        p = 2 * math.fsum(ways)
    else:
        spread = math.sqrt(sum(n * r * r for r, n in ranks)) / 2
        p = math.erfc(max(0.0, total / 2 - small - 1) / spread / math.sqrt(2))
    return plus / 2, (total - plus) / 2, min(1.0, p), (2 * plus - total) / total


def wilcoxon(df: DataFrame, by: list[str], difference: str) -> DataFrame:
    """(by, w_plus, w_minus, p_value, rank_biserial): signed-rank test of each group of paired
    differences, nulls left out.  Differences of one size are counted before the shuffle."""
    keys = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in by)

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = [(s, int(u), int(d)) for s, u, d in zip(pdf["_size"], pdf["_up"], pdf["_down"]) if s == s and s]
        return pd.DataFrame([[*(pdf[c].iloc[0] for c in by), *signed_rank_p(rows, int(pdf["_n"].sum()))]], columns=[*by, "w_plus", "w_minus", "p_value", "rank_biserial"])

    x = F.col(difference)
    sizes = df.groupBy(*by, F.abs(x).cast("double").alias("_size")).agg(F.count_if(x > 0).alias("_up"), F.count_if(x < 0).alias("_down"), F.count(x).alias("_n"))
    return sizes.groupBy(*by).applyInPandas(work, f"{keys}, w_plus double, w_minus double, p_value double, rank_biserial double")


def mcnemar(df: DataFrame, by: list[str], first: Column, second: Column) -> DataFrame:
    """(by, both, first_only, second_only, neither, p_value): exact binomial, two-sided."""
    n = df.groupBy(*by).agg(F.count_if(first & second).alias("both"), F.count_if(first & ~second).alias("first_only"), F.count_if(~first & second).alias("second_only"), F.count_if(~first & ~second).alias("neither"))

    @F.pandas_udf("double")
    def tail(b: pd.Series, c: pd.Series) -> pd.Series:
        def one(x: int, y: int) -> float:
            m = x + y
            if m == 0:
                return 1.0
            logs = [math.lgamma(m + 1) - math.lgamma(k + 1) - math.lgamma(m - k + 1) - m * math.log(2) for k in range(min(x, y) + 1)]
            return min(1.0, 2 * math.fsum(map(math.exp, logs)))

        return pd.Series([one(int(x), int(y)) for x, y in zip(b, c)])

    return n.withColumn("p_value", tail("first_only", "second_only"))


def holm(df: DataFrame, family: str, name: str, p: str) -> DataFrame:
    """Append ``adjusted``: step-down, running maximum, capped at 1; ties by name."""
    w = Window.partitionBy(family).orderBy(p, name)
    n = F.count("*").over(Window.partitionBy(family))
    step = (n - F.row_number().over(w) + 1) * F.col(p)
    return df.withColumn("_step", step).withColumn("adjusted", F.least(F.lit(1.0), F.max("_step").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))).drop("_step")


def kappa(df: DataFrame, by: list[str], a: str, b: str, labels: list | None = None, weighted: bool = False) -> DataFrame:
    """Cohen's kappa of two raters for each group, linear weights over ``labels`` if asked.

    (by, n, observed, expected, kappa); kappa is null where chance agreement is complete.
    """
    rows = df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    cells = rows.groupBy(*by, F.col(a).alias("_a"), F.col(b).alias("_b")).agg(F.count("*").alias("_n"))
    if weighted:
        k = len(labels)
        at = {x: i for i, x in enumerate(labels)}
        place = lambda c: F.coalesce(*[F.when(F.col(c) == x, i) for x, i in at.items()])
        weight = 1 - F.abs(place("_a") - place("_b")) / F.lit(max(1, k - 1))
    else:
        weight = F.when(F.col("_a") == F.col("_b"), 1.0).otherwise(0.0)
    seen = cells.groupBy(*by).agg(F.sum("_n").alias("n"), F.sum(F.col("_n") * weight).alias("_same"))
    ma = cells.groupBy(*by, "_a").agg(F.sum("_n").alias("_na"))
    mb = cells.groupBy(*by, "_b").agg(F.sum("_n").alias("_nb"))
    # Labels against labels, at most their number squared a group.
    chance = (ma.join(mb, by) if by else ma.crossJoin(mb)).groupBy(*by).agg(F.sum(F.col("_na") * F.col("_nb") * weight).alias("_chance"))
    out = seen.join(chance, by) if by else seen.crossJoin(chance)
    o, e = F.col("_same") / F.col("n"), F.col("_chance") / (F.col("n") * F.col("n"))
    return out.select(*by, "n", o.alias("observed"), e.alias("expected"), F.when(e < 1, (o - e) / (1 - e)).alias("kappa"))


def apportion(df: DataFrame, key: str, count: str, seats: int) -> DataFrame:
    """Largest remainders: append ``seats``; equal remainders go by key.  One row a key."""
    total = Window.partitionBy(F.lit(1))
    d = df.withColumn("_q", F.col(count) * F.lit(seats) / F.sum(count).over(total)).withColumn("_f", F.floor("_q"))
    left = F.lit(seats) - F.sum("_f").over(total)
    rank = F.row_number().over(total.orderBy((F.col("_q") - F.col("_f")).desc(), key))
    return d.withColumn("_left", left).withColumn("seats", (F.col("_f") + F.when(rank <= F.col("_left"), 1).otherwise(0)).cast("long")).drop("_q", "_f", "_left")


#: Differences up to which resamples draw places one after the other; beyond, how often each value is drawn.
SEQUENTIAL = 5000


def resampled_means(values: list[float], counts: list[int] | None, resamples: int, seed: int) -> np.ndarray:
    """Means of resamples of as many values as there are.

    counts None: values in their order; the generator and its draws are those of Python's
    ``Random(seed).randrange``, many at a time.  Else each value with its count, drawn as multinomial
    counts: the same distribution, at a cost that doesn't grow with the counts.
    """
    x = np.array(values, dtype=float)
    if counts is not None:
        n = np.array(counts)
        rng, out = np.random.default_rng(seed), []
        for at in range(0, resamples, 10_000):
            out.append(rng.multinomial(n.sum(), n / n.sum(), size=min(10_000, resamples - at)) @ x / n.sum())
        return np.concatenate(out)
    n, rng = len(x), np.random.RandomState([seed])
    shift, kept, out = 32 - n.bit_length(), np.empty(0, np.int64), []
    while len(out) < resamples:
        draw = rng.randint(0, 2**32, size=max(1024, min(1 << 20, 2 * n * (resamples - len(out)))), dtype=np.uint32) >> np.uint32(shift)
        kept = np.concatenate([kept, draw[draw < n].astype(np.int64)])
        full = min(len(kept) // n, resamples - len(out))
        out += (x[kept[: full * n]].reshape(full, n).sum(axis=1) / n).tolist()
        kept = kept[full * n :]
    return np.array(out)


def bootstrap_interval(df: DataFrame, by: list[str], difference: str, order: list[str], resamples: int = 100_000, seed: int = 20260721, level: float = 0.95) -> DataFrame:
    """(by, mean, low, high): percentile interval of the mean of paired differences, fixed seed.

    Nulls are left out; a group without differences has nulls.  A group of up to ``SEQUENTIAL``
    differences is resampled in the given order; of a larger one only the counted values are sent.
    """
    keys = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in by)
    x = df.select(*by, F.col(difference).cast("double").alias("_x"), *[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)])
    sizes = x.groupBy(*by).agg(F.count("_x").alias("_n"))
    counted = x.groupBy(*by, "_x").agg(F.count("*").alias("_c"))
    large = _beside(counted, sizes, by).where(F.col("_n") > SEQUENTIAL).select(*by, "_x", "_c", *[F.lit(None).cast(x.schema[f"_o{i}"].dataType).alias(f"_o{i}") for i in range(len(order))])
    small = _beside(x, sizes, by).where(F.col("_n") <= SEQUENTIAL).select(*by, "_x", F.lit(None).cast("long").alias("_c"), *[f"_o{i}" for i in range(len(order))])
    places = [f"_o{i}" for i in range(len(order))]

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        key = [pdf[c].iloc[0] for c in by]
        pdf = pdf[pdf["_x"].notna()]
        if not len(pdf):
            return pd.DataFrame([[*key, None, None, None]], columns=[*by, "mean", "low", "high"])
        if pdf["_c"].notna().any():
            pdf = pdf.sort_values("_x")
            v, c = pdf["_x"].tolist(), pdf["_c"].astype("int64").tolist()
            mean, means = math.fsum(a * b for a, b in zip(v, c)) / sum(c), resampled_means(v, c, resamples, seed)
        else:
            v = pdf.sort_values(places, kind="stable")["_x"].tolist()
            mean, means = math.fsum(v) / len(v), resampled_means(v, None, resamples, seed)
        a = (1 - level) / 2
        return pd.DataFrame([[*key, mean, *np.quantile(means, [a, 1 - a])]], columns=[*by, "mean", "low", "high"])

    return large.unionByName(small).groupBy(*by).applyInPandas(work, f"{keys}, mean double, low double, high double")


def with_total(df: DataFrame, key: str, *aggregates: Column) -> DataFrame:
    """Aggregates for each key and, with null key and ``is_total``, for all rows."""
    return df.rollup(key).agg(*aggregates, F.grouping(key).cast("boolean").alias("is_total"))


def paired_outcomes(df: DataFrame, unit: str, arm: str, arms: tuple, outcomes: dict[str, Column]) -> DataFrame:
    """(outcome, both, first_only, second_only, neither, p_value, adjusted): units of two arms
    compared on boolean outcomes, with the p values adjusted over the outcomes.

    Units without a row in both arms, and nulls, take no part; of several rows of a unit in an arm an
    outcome holds if it does in any.  The pivot is a partial aggregate.
    """
    cells = [F.struct(F.lit(name).alias("outcome"), c.alias("value")) for name, c in outcomes.items()]
    d = df.where(F.col(arm).isin(*arms)).select(unit, arm, F.inline(F.array(*cells)))
    side = lambda a: F.bool_or(F.when(F.col(arm) == F.lit(a), F.col("value")))
    wide = d.groupBy(unit, "outcome").agg(side(arms[0]).alias("_a"), side(arms[1]).alias("_b")).where("_a is not null and _b is not null")
    m = mcnemar(wide, ["outcome"], F.col("_a"), F.col("_b")).withColumn("_all", F.lit(1))
    return holm(m, "_all", "outcome", "p_value").select("outcome", "both", "first_only", "second_only", "neither", "p_value", "adjusted")


def paired_scores(df: DataFrame, unit: str, arm: str, arms: tuple, dimensions: list[str]) -> DataFrame:
    """(dimension, n, mean_first, mean_second, mean_difference, w_plus, w_minus, p_value, adjusted):
    scores of two arms by dimension, signed-rank tests adjusted over the dimensions.

    Of several scores of a unit in an arm the mean counts; units without both take no part.
    """
    cells = [F.struct(F.lit(x).alias("dimension"), F.col(x).cast("double").alias("value")) for x in dimensions]
    d = df.where(F.col(arm).isin(*arms)).select(unit, arm, F.inline(F.array(*cells)))
    side = lambda a: F.avg(F.when(F.col(arm) == F.lit(a), F.col("value")))
    wide = d.groupBy(unit, "dimension").agg(side(arms[0]).alias("_a"), side(arms[1]).alias("_b")).where("_a is not null and _b is not null")
    wide = wide.withColumn("_d", F.col("_b") - F.col("_a"))
    means = wide.groupBy("dimension").agg(F.count("*").alias("n"), F.avg("_a").alias("mean_first"), F.avg("_b").alias("mean_second"), F.avg("_d").alias("mean_difference"))
    tests = wilcoxon(wide, ["dimension"], "_d").drop("rank_biserial").withColumn("_all", F.lit(1))
    tests = holm(tests, "_all", "dimension", "p_value").drop("_all")
    return means.join(tests, "dimension")


def reliability(first: DataFrame, second: DataFrame, unit: str, dimensions: list[str]) -> DataFrame:
    """(dimension, n, observed, expected, kappa) of two raters over the units both have rated."""
    cells = lambda s: F.inline(F.array(*[F.struct(F.lit(x).alias("dimension"), F.col(x).cast("string").alias(s)) for x in dimensions]))
    both = first.select(unit, cells("_a")).join(second.select(unit, cells("_b")), [unit, "dimension"])
    return kappa(both, ["dimension"], "_a", "_b")
