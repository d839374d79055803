"""Joins of review tables: merging, disagreement, validation, set comparisons, journals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def merge(primary: DataFrame, secondary: DataFrame, final: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Primary labels, replaced field by field by the adjudicated ones.

    (key, fields..., decision_source): 'adjudicated', 'double' where a second rater agrees, or
    'single'.  Null in the adjudicated field leaves the primary label.
    """
    s = secondary.select(key, F.lit(True).alias("_second"))
    f = final.select(key, *[F.col(c).alias(f"_{c}") for c in fields], F.lit(True).alias("_final"))
    d = primary.select(key, *fields).join(s, key, "left").join(f, key, "left")
    source = F.when(F.col("_final"), "adjudicated").when(F.col("_second"), "double").otherwise("single")
    return d.select(key, *[F.coalesce(f"_{c}", c).alias(c) for c in fields], source.alias("decision_source"))


def disagreements(primary: DataFrame, secondary: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, disputed_fields): shared rows whose labels differ anywhere (null equals null)."""
    a = primary.select(key, *[F.col(c).alias(f"{c}_primary") for c in fields])
    b = secondary.select(key, *[F.col(c).alias(f"{c}_secondary") for c in fields])
    names = F.array_compact(F.array(*[F.when(~F.col(f"{c}_primary").eqNullSafe(F.col(f"{c}_secondary")), c) for c in fields]))
    return a.join(b, key).withColumn("disputed_fields", names).where(F.size("disputed_fields") > 0)


def difference(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(key, side): ids only in one of two tables."""
    a, b = left.select(key).distinct(), right.select(key).distinct()
    return a.join(b, key, "left_anti").withColumn("side", F.lit("left")).unionByName(b.join(a, key, "left_anti").withColumn("side", F.lit("right")))


def violations(df: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """(key, violated): names of the rules a row breaks; an unknown (null) rule is broken."""
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), name) for name, ok in rules.items()]))
    return df.select(key, broken.alias("violated")).where(F.size("violated") > 0)


def conflicting(df: DataFrame, key: str, value: str) -> DataFrame:
    """(key, values): keys with more than one distinct value."""
    return df.groupBy(key).agg(F.count_distinct(value).alias("values")).where("values > 1")


def range_lookup(df: DataFrame, value: str, chart: DataFrame, low: str, high: str, label: str, order: str) -> DataFrame:
    """Append ``label`` of the first chart row (by ``order``, then label) with low <= value <= high.

    A chart of any size: a range is put into buckets about as wide as itself, of which it meets three
    at most, and a value looks once into each width that the chart has; so it is an equi-join, of the
    distinct values only.  Null values and values in no range get null, null and reversed ranges are
    left out.
    """
    c = chart.select(F.col(low).cast("double").alias("_low"), F.col(high).cast("double").alias("_high"), F.struct(F.col(order).alias("o"), F.col(label).alias("l")).alias("_l")).where("_low <= _high")
    c = c.withColumn("_level", F.when(F.col("_high") > F.col("_low"), F.least(F.ceil(F.log2(F.col("_high") - F.col("_low"))), F.lit(1024))).otherwise(0).cast("int"))
    levels = [r[0] for r in c.select("_level").distinct().collect()]  # at most one for each exponent of a double
    at = lambda x: F.when(F.col("_level") < 1024, F.floor(x / F.pow(F.lit(2.0), F.col("_level")))).otherwise(0)
    ranges = c.withColumn("_bucket", F.explode(F.sequence(at(F.col("_low")), at(F.col("_high")))))
    values = df.select(F.col(value).alias("_value")).where("_value is not null").distinct()
    looks = values.withColumn("_level", F.explode(F.array(*[F.lit(x) for x in levels]) if levels else F.array().cast("array<int>"))).withColumn("_bucket", at(F.col("_value").cast("double")))
    hits = looks.join(ranges, ["_level", "_bucket"]).where(F.col("_value").cast("double").between(F.col("_low"), F.col("_high"))).groupBy("_value").agg(F.min("_l").alias("_l"))
    keep = [c for c in df.columns if c != label]
    return df.select(*keep).join(hits, df[value] == F.col("_value"), "left").select(*keep, F.col("_l.l").alias(label))


def nearest_equal(left: DataFrame, right: DataFrame, a: str, b: str, within: float) -> DataFrame:
    """Join on abs(a - b) < within by buckets of that width: an equi-join on three buckets."""
    l_ = left.withColumn("_b", F.floor(F.col(a) / within))
    r_ = right.withColumn("_b", F.explode(F.sequence(F.floor(F.col(b) / within) - 1, F.floor(F.col(b) / within) + 1)))
    return l_.join(r_, "_b").where(F.abs(F.col(a) - F.col(b)) < within).drop("_b")


def transitions(df: DataFrame, key: str, state: str, order: list[Column], allowed: list[tuple[str, str]]) -> DataFrame:
    """Append previous state and ``legal``: may a key go from one state to the next?  The first is."""
    w = Window.partitionBy(key).orderBy(*order)
    pairs = [F.struct(F.lit(a), F.lit(b)) for a, b in allowed]
    d = df.withColumn("previous_state", F.lag(state).over(w))
    return d.withColumn("legal", F.col("previous_state").isNull() | F.struct(F.col("previous_state"), F.col(state)).isin(*pairs))


def contiguous_prefix(df: DataFrame, key: str, order: list[Column], ok: Column) -> DataFrame:
    """(key, prefix): rows of each key before the first that isn't ok."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    d = df.withColumn("_ok", F.min(F.coalesce(ok, F.lit(False)).cast("int")).over(w))
    return d.groupBy(key).agg(F.sum("_ok").alias("prefix"))


def first_success(df: DataFrame, request: str, attempt: str, ok: Column, most: int = 3) -> DataFrame:
    """(request, attempts, status): done at the first success within ``most`` attempts."""
    d = df.where(F.col(attempt) <= most).groupBy(request).agg(F.count("*").alias("attempts"), F.min(F.when(ok, F.col(attempt))).alias("_done"))
    return d.select(request, "attempts", F.when(F.col("_done").isNotNull(), "done").when(F.col("attempts") >= most, "failed").otherwise("open").alias("status"))


def recovery(units: DataFrame, journals: DataFrame, successes: DataFrame, unit: str, state: str, attempt: str, most: int = 3) -> DataFrame:
    """(unit, journals, decision): what to do with each unit of a plan.

    journals: one row an attempt with its last state; successes: units with proof of success.  A unit
    is 'confirmed' or to be 'reconcile_committed' with proof and journal, 'authoritative_success' with
    proof only, 'begin' with neither; without proof its last attempt decides: 'prepared' is
    'continue_before_provider', 'retryable_failed' is 'retry' below ``most`` attempts, all else
    'fail_closed'.  Journals of units outside the plan are left out; repeated proofs are one.
    """
    last = journals.where(F.col(unit).isNotNull()).groupBy(unit).agg(F.count("*").alias("journals"), F.max(attempt).alias("_attempt"), F.max_by(state, attempt).alias("_state"))
    proof = successes.where(F.col(unit).isNotNull()).select(unit).distinct().withColumn("_proof", F.lit(True))
    d = units.select(unit).distinct().join(last, unit, "left").join(proof, unit, "left")
    decision = (
        F.when(F.col("_proof") & F.col("_state").isNull(), "authoritative_success")
        .when(F.col("_proof") & (F.col("_state") == "committed"), "confirmed")
        .when(F.col("_proof"), "reconcile_committed")
        .when(F.col("_state").isNull(), "begin")
        .when(F.col("_state") == "prepared", "continue_before_provider")
        .when((F.col("_state") == "retryable_failed") & (F.col("_attempt") < most), "retry")
        .otherwise("fail_closed")
    )
    return d.select(unit, F.coalesce("journals", F.lit(0)).alias("journals"), decision.alias("decision"))


def next_attempts(decisions: DataFrame, unit: str) -> DataFrame:
    """(unit, attempt, state): the journal rows to write for units to begin or to try again."""
    return decisions.where(F.col("decision").isin("begin", "retry")).select(unit, (F.col("journals") + 1).alias("attempt"), F.lit("prepared").alias("state"))


def decision_margin(sessions: Column, threshold: Column, first: Column, last: Column, most_first: float = 0.2, least_last: float = 0.8) -> Column:
    """How far a sender is from losing its inferred role: the least of its three margins."""
    return F.least((sessions - threshold) / threshold, last - F.lit(least_last), F.lit(most_first) - first)


def unit_category(units: DataFrame, journals: DataFrame, commits: DataFrame, unit: str, state: str, attempt: str, before: str | None = None, most: int = 3) -> DataFrame:
    """(unit, category): where each unit of a plan stands.

    'successful' with a commit; else by its last attempt: none is 'initial', 'prepared' and
    'provider_returned' are 'continuable', 'retryable_failed' is 'retryable' below ``most`` attempts,
    all else 'permanent'.  ``before`` names the unit that must have succeeded first: until then an
    initial or continuable unit is 'waiting'.  Units are distinct; null units are left out.
    """
    done = commits.where(F.col(unit).isNotNull()).select(unit).distinct().withColumn("_done", F.lit(True))
    last = journals.where(F.col(unit).isNotNull()).groupBy(unit).agg(F.max(attempt).alias("_attempt"), F.max_by(state, attempt).alias("_state"))
    d = units.where(F.col(unit).isNotNull()).join(done, unit, "left").join(last, unit, "left")
    category = (
        F.when(F.col("_done"), "successful")
        .when(F.col("_state").isNull(), "initial")
        .when(F.col("_state").isin("prepared", "provider_returned"), "continuable")
        .when((F.col("_state") == "retryable_failed") & (F.col("_attempt") < most), "retryable")
        .otherwise("permanent")
    )
    if before is None:
        return d.select(unit, category.alias("category"))
    first = done.select(F.col(unit).alias("_before"), F.lit(True).alias("_ready"))
    d = d.withColumn("category", category).join(first, d[before] == F.col("_before"), "left")
    wait = F.col(before).isNotNull() & F.col("_ready").isNull() & F.col("category").isin("initial", "continuable")
    return d.select(unit, F.when(wait, "waiting").otherwise(F.col("category")).alias("category"))


def progress(categories: DataFrame, *by: str) -> DataFrame:
    """(by, category, units) with subtotals: a null key where ``level`` counts fewer columns."""
    return categories.rollup(*by, "category").agg(F.count("*").alias("units"), F.grouping_id().alias("level"))


def prefix_gaps(df: DataFrame, key: str, order: list[Column], ok: Column) -> DataFrame:
    """(key, prefix, after_gap): rows before the first that isn't ok, and ok rows after it, which are
    an error where a plan must be worked off in order."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    good = F.coalesce(ok, F.lit(False)).cast("int")
    d = df.withColumn("_ok", good).withColumn("_run", F.min("_ok").over(w))
    return d.groupBy(key).agg(F.sum("_run").alias("prefix"), F.sum(F.col("_ok") - F.col("_run")).alias("after_gap"))


def evaluate(results: DataFrame, specs: DataFrame, key: str, answer: str, kind: str) -> DataFrame:
    """Results checked against the specification of their key: results' columns, failed ARRAY, score.

    specs: key, kinds ARRAY (allowed, null for any), any_of ARRAY (one must occur), none_of ARRAY (none
    may).  failed holds 'kind', 'missing', 'forbidden' in this order; score is 2 without failure, 1 if
    only something is missing, else 0.  Results without a specification aren't returned; a null answer
    is empty.
    """
    s = specs.select(F.col(key).alias("_key"), F.struct("kinds", "any_of", "none_of").alias("_s"))
    d = results.join(F.broadcast(s) if specs.isLocal() else s, results[key] == F.col("_key"))
    said = F.coalesce(F.col(answer), F.lit(""))
    holds = lambda words: F.exists(words, lambda w: said.contains(w))
    checks = [
        ("kind", F.col("_s.kinds").isNotNull() & ~F.coalesce(F.array_contains("_s.kinds", F.col(kind)), F.lit(False))),
        ("missing", F.coalesce(F.size("_s.any_of") > 0, F.lit(False)) & ~F.coalesce(holds(F.col("_s.any_of")), F.lit(False))),
        ("forbidden", F.coalesce(holds(F.col("_s.none_of")), F.lit(False))),
    ]
    failed = F.array_compact(F.array(*[F.when(bad, name) for name, bad in checks]))
    d = d.withColumn("failed", failed)
    score = F.when(F.size("failed") == 0, 2).when(F.array_join("failed", "|") == "missing", 1).otherwise(0)
    return d.withColumn("score", score).drop("_key", "_s")


def case_verdicts(turns: DataFrame, case: str, passed: Column) -> DataFrame:
    """(case, turns, passed): a case passes if all its turns do; an unknown turn doesn't."""
    return turns.where(F.col(case).isNotNull()).groupBy(case).agg(F.count("*").alias("turns"), F.every(F.coalesce(passed, F.lit(False))).alias("passed"))
