"""Checks and views of a nested product catalogue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def chart_errors(products: DataFrame) -> DataFrame:
    """(product_id, problem): size charts that aren't strictly increasing in length and size.

    Neighbours are compared inside the array; nothing is exploded or shuffled.  Null entries and
    null charts are no problem of this check.
    """
    chart = F.filter("sizing.size_chart", lambda x: x.isNotNull())
    n = F.size(chart)
    pairs = F.when(n >= 2, F.zip_with(F.slice(chart, 1, n - 1), F.slice(chart, 2, n - 1), lambda a, b: F.struct((b["foot_length_cm"] > a["foot_length_cm"]).alias("length"), (b["recommended_size"] > a["recommended_size"]).alias("size"))))
    bad = lambda f: F.exists(pairs, lambda p: ~F.coalesce(p[f], F.lit(False)))
    problems = F.array_compact(F.array(F.when(bad("length"), "length_not_increasing"), F.when(bad("size"), "size_not_increasing")))
    return products.select("product_id", F.explode(problems).alias("problem"))


def public_view(products: DataFrame) -> DataFrame:
    """(product_id, name, category, display_price, colours, sizes): distinct and sorted lists."""
    v = F.filter("variants", lambda x: x.isNotNull())
    colours = F.array_sort(F.array_distinct(F.filter(F.transform(v, lambda x: F.trim(x["color_name"])), lambda c: c != "")))
    sizes = F.array_sort(F.array_distinct(F.filter(F.flatten(F.transform(v, lambda x: F.coalesce(x["available_sizes"], F.array().cast("array<int>")))), lambda s: s.isNotNull())))
    return products.select("product_id", F.col("identity.name").alias("name"), F.col("identity.category").alias("category"), F.col("pricing.display_price").alias("display_price"), F.coalesce(F.array_join(colours, "|"), F.lit("")).alias("colours"), F.coalesce(F.array_join(sizes, "|"), F.lit("")).alias("sizes"))


def key_function(products: DataFrame, scores: dict[str, int], order: list[str] = ()) -> DataFrame:
    """(product_id, key_function): the function of the best level; ties go to the first of ``order``,
    then to the first by name.  A product without functions has null."""
    place = F.create_map(*[F.lit(x) for i, name in enumerate(order) for x in (name, i)]) if order else None
    at = lambda k: F.coalesce(F.try_element_at(place, k), F.lit(len(order))) if order else F.lit(0)
    score = F.create_map(*[F.lit(x) for kv in scores.items() for x in kv])
    entries = F.sort_array(F.transform(F.map_entries("functions"), lambda e: F.struct((-F.coalesce(F.try_element_at(score, F.lower(F.trim(e["value"]["level"]))), F.lit(0))).alias("s"), at(e["key"]).alias("o"), e["key"].alias("k"))))
    return products.select("product_id", F.when(F.size(entries) > 0, entries[0]["k"]).alias("key_function"))


def payload_errors(products: DataFrame, levels: list[str]) -> DataFrame:
    """(product_id, problem): what a product's record lacks or has wrong, one row a kind.

    Everything is an expression over the record; nothing is exploded before the last step.  Null and
    blank texts are missing; null elements of arrays are left out.
    """
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    v = F.filter("variants", lambda x: x.isNotNull())
    ids = F.filter(F.transform(v, lambda x: F.trim(x["variant_id"])), lambda x: x.isNotNull() & (x != ""))
    gallery = F.filter("media.gallery", lambda x: x.isNotNull())
    known = lambda e: F.lower(F.trim(e["value"]["level"])).isin(*levels)
    yes = lambda c: F.coalesce(c, F.lit(False))
    problems = [
        ("missing_name", blank(F.col("identity.name"))),
        ("missing_category", blank(F.col("identity.category"))),
        ("price_not_positive", ~yes(F.col("pricing.display_price") > 0)),
        ("no_variants", ~yes(F.size(v) > 0)),
        ("missing_variant_id", yes(F.size(ids) < F.size(v))),
        ("duplicate_variant_id", yes(F.size(F.array_distinct(ids)) < F.size(ids))),
        ("variant_without_sizes", yes(F.exists(v, lambda x: ~yes(F.size(F.array_compact(x["available_sizes"])) > 0)))),
        ("unsafe_reference", yes(F.exists(gallery, lambda x: x["asset_ref"].isNotNull() & ~safe_reference(x["asset_ref"])))),
        ("unknown_level", yes(F.exists(F.map_entries("functions"), lambda e: ~yes(known(e))))),
    ]
    return products.select("product_id", F.explode(F.array_compact(F.array(*[F.when(bad, name) for name, bad in problems]))).alias("problem"))


def safe_reference(ref: Column) -> Column:
    """Is a media reference a relative path without steps upwards?"""
    return F.coalesce(ref.rlike(r"^[A-Za-z0-9_\-]+(?:/[A-Za-z0-9_\-]+)*\.(?:png|jpe?g|webp|svg)$"), F.lit(False))
