"""Mixed timestamp texts of many sources to instants.

Method: every text is read under each valid form.  Only the order of day and month in dates with
slashes and the year last can be read in two ways; for it each source has a mixture of the two
orders, fitted by expectation-maximisation: a text contributes the likelihood of each valid reading
(share of the source's texts in that month), the mixture weight has a Beta prior from the order
declared for the source (a declared order has the whole prior mass), and posteriors choose.  A text
whose posterior stays under ``cutoff`` is 'ambiguous', with no instant.

The sums for the fit are per source and (first, second) number of the date, at most 961 rows a
source however large the source is, so no group is unbounded.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import timeparse as tp
from ..runtime import bounded

CUTOFF = 0.95
ROUNDS = 30
SMOOTH = 0.5


def fit_order(counts: list[tuple[int, int, int]], prior: float | None, rounds: int = ROUNDS) -> tuple[float, list[float]]:
    """EM over (first, second, n): weight of day-first and share of each month.

    prior: 1.0 or 0.0 for a declared order, None for an unknown one.  No counts: 0.5, equal months.
    """
    weight, months = 0.5 if prior is None else prior, [1 / 12] * 12
    for _ in range(rounds):
        total, day_first, seen = 0.0, 0.0, [SMOOTH] * 12
        for a, b, n in counts:
            # A zero month has no share, so that reading is not valid.
            d = weight * months[b - 1] if 1 <= b <= 12 and 1 <= a <= 31 else 0.0
            m = (1 - weight) * months[a - 1] if 1 <= a <= 12 and 1 <= b <= 31 else 0.0
            if d + m == 0:
                continue
            p = d / (d + m)
            total, day_first = total + n, day_first + n * p
            if p:
                seen[b - 1] += n * p
            if p < 1:
                seen[a - 1] += n * (1 - p)
        if prior is None:
            weight = (day_first + 1) / (total + 2)
        months = [x / sum(seen) for x in seen]
    return weight, months


def _fit(pdf: pd.DataFrame) -> pd.DataFrame:
    declared = pdf["declared"].iloc[0]
    prior = {"DMY": 1.0, "MDY": 0.0}.get(declared)
    seen = pdf[pdf["n"] > 0]
    w, months = fit_order([(int(a), int(b), int(n)) for a, b, n in zip(seen["a"], seen["b"], seen["n"])], prior)
    return pd.DataFrame({"source_id": [pdf["source_id"].iloc[0]], "day_first": [w], "months": [months]})


def source_orders(values: DataFrame, sources: DataFrame) -> DataFrame:
    """(source_id, day_first, months): the fitted mixture of each source with such dates.

    values: (source_id, text); sources: (source_id, declared).  Nulls: no source, no row.
    """
    pattern = r"(\d{1,2})/(\d{1,2})/\d{4}(?!\d)"
    slash = values.where(F.col("text").contains("/") & F.col("source_id").isNotNull())
    s = F.translate(F.col("text"), tp._WIDE, tp._THIN)
    sums = (
        slash.select("source_id", F.regexp_extract(s, pattern, 1).alias("a"), F.regexp_extract(s, pattern, 2).alias("b"))
        .where(F.col("a") != "")
        .groupBy("source_id", F.col("a").cast("int").alias("a"), F.col("b").cast("int").alias("b"))
        .agg(F.count("*").alias("n"))
    )
    return sums.join(sources.select("source_id", "declared"), "source_id", "left").groupBy("source_id").applyInPandas(_fit, "source_id string, day_first double, months array<double>")


def to_instants(values: DataFrame, sources: DataFrame, cutoff: float = CUTOFF, orders: DataFrame | None = None) -> DataFrame:
    """Append (epoch_ms LONG, time_status STRING, day_first_posterior DOUBLE) to ``values``.

    values has (source_id, text) and any other columns; sources has (source_id, zone_id, declared),
    one row a source.  time_status: 'null', 'unreadable' (no full, existing date and time, or local
    time of a source without zone), 'ambiguous', 'unix', 'offset' (zone in the text) or 'local'.
    epoch_ms is null for the first three.  Local times in a gap are read with the offset before it,
    those in an overlap as the earlier one.  Empty tables give empty results.
    """
    # Other columns ride along in one struct, so that no name of theirs can clash.
    other = [c for c in values.columns if c not in ("source_id", "text", "epoch_ms", "time_status", "day_first_posterior")]
    order = [c for c in values.columns if c in other or c in ("source_id", "text")]
    keep = [F.col(c) if c in ("source_id", "text") else F.col("_other").getField(c).alias(c) for c in order]
    values = values.select("source_id", "text", *([F.struct(*[F.col(f"`{c}`") for c in other]).alias("_other")] if other else []))
    orders = source_orders(values.select("source_id", "text"), sources) if orders is None else orders
    known = sources.select(F.col("source_id").alias("_sid"), F.col("zone_id").alias("_zone_id"), F.col("declared").alias("_declared"))
    fitted = orders.select(F.col("source_id").alias("_oid"), F.col("day_first").alias("_day_first"), F.col("months").alias("_months"))
    merged = known.join(fitted, known["_sid"] == fitted["_oid"], "full_outer").select(F.coalesce("_sid", "_oid").alias("_sid"), "_zone_id", "_declared", "_day_first", "_months")
    df = values.join(bounded(merged), values["source_id"] == F.col("_sid"), "left").drop("_sid")
    # Stages of named columns, so that no field is computed more than once.
    df = df.withColumn("_std", F.coalesce(F.col("text").rlike(tp.STANDARD), F.lit(False)))
    df = tp.spelled(df.withColumn("_raw", F.when(~F.col("_std"), F.col("text"))), "_raw", "_s")
    df = df.withColumn("_f", tp.fields(F.col("_s")))
    df = df.withColumns({f"_{k}": v for k, v in tp.parts(F.col("_f"), F.col("_s")).items()})
    sub = lambda a, n: F.substring("text", a, n)
    std = F.col("_std")
    weight = F.coalesce("_day_first", F.when(F.col("_declared") == "DMY", 1.0).when(F.col("_declared") == "MDY", 0.0), F.lit(0.5))
    month = lambda k: F.when(F.col(k).between(1, 12), F.coalesce(F.element_at("_months", F.col(k)), F.lit(1 / 12))).otherwise(0.0)
    df = df.withColumns(
        {
            "_like_d": F.when(F.col("_slash") & F.col("_dmy").isNotNull(), weight * month("_second")).otherwise(0.0),
            "_like_m": F.when(F.col("_slash") & F.col("_mdy").isNotNull(), (1 - weight) * month("_first")).otherwise(0.0),
            "_h": F.when(std, sub(12, 2).try_cast("int")).otherwise(tp.hour_of_day(F.col("_hour"), F.col("_half"), F.col("_word"))),
            "_mi": F.when(std, sub(15, 2).try_cast("int")).otherwise(F.col("_minute")),
            "_ss": F.when(std, sub(18, 2).try_cast("int")).otherwise(F.col("_sec")),
            "_std_days": F.when(std, F.unix_date(sub(1, 10).try_cast("date")).cast("long")),
        }
    )
    both = F.col("_like_d") + F.col("_like_m")
    df = df.withColumn("day_first_posterior", F.when(both > 0, F.col("_like_d") / both))
    posterior = F.col("day_first_posterior")
    df = df.withColumn(
        "_day",
        F.when(std, F.col("_std_days"))
        .when(~F.col("_slash"), F.col("_dmy"))
        .when((F.col("_dmy") == F.col("_mdy")) & posterior.isNotNull(), F.col("_dmy"))
        .when(posterior >= cutoff, F.col("_dmy"))
        .when(posterior <= 1 - cutoff, F.col("_mdy")),
    )
    df = df.withColumn("_clock", F.when(F.col("_h").between(0, 23) & F.col("_mi").between(0, 59) & F.col("_ss").between(0, 59), F.col("_h") * 3600 + F.col("_mi") * 60 + F.col("_ss")))
    df = df.withColumn("_local", F.col("_day") * 86400 + F.col("_clock"))
    # CST is read as the zone of the source: China's or North America's central standard time.
    cst = F.when(F.col("_zone") == "CST", F.when(F.col("_zone_id").startswith("America/"), -360).otherwise(480))
    here = F.when(F.col("_zone_id").isNotNull(), F.unix_seconds(F.to_utc_timestamp(F.timestamp_seconds("_local"), F.col("_zone_id"))))
    zoned = ~std & F.col("_zoned")
    at = F.when(zoned, F.col("_local") - (F.coalesce("_base", cst) + F.col("_shift")) * 60).otherwise(here)
    epoch = F.when(F.col("_unix").isNotNull(), F.col("_unix")).otherwise(at * 1000 + F.coalesce("_milli", F.lit(0))).cast("long")
    # The id is always >= 0; being non-deterministic it keeps filters on epoch_ms above this stage,
    # where they would otherwise be rewritten over all stages below, each many times.
    df = df.withColumn("epoch_ms", F.when(F.monotonically_increasing_id() >= 0, epoch))
    unsure = F.col("_slash") & F.col("_day").isNull() & posterior.isNotNull() & F.col("_clock").isNotNull()
    status = (
        F.when(F.col("text").isNull(), "null")
        .when(F.col("_unix").isNotNull(), "unix")
        .when(F.coalesce(unsure, F.lit(False)), "ambiguous")
        .when(F.col("epoch_ms").isNull(), "unreadable")
        .when(zoned, "offset")
        .otherwise("local")
    )
    return df.select(*keep, "epoch_ms", status.alias("time_status"), "day_first_posterior")


def store_sources(stores: DataFrame) -> DataFrame:
    """stores as the sources of ``to_instants``; one row for each external_store_id."""
    return stores.where("external_store_id is not null").groupBy(F.col("external_store_id").alias("source_id")).agg(F.min("zone_id").alias("zone_id"), F.min("date_order").alias("declared"))


def is_standard(text: Column) -> Column:
    return F.coalesce(text.rlike(tp.STANDARD), F.lit(False))
