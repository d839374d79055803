"""Queries p4_ and p6_: timestamps and nested records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import nested, timestamps
from ..runtime import bounded, table

SHANGHAI = "Asia/Shanghai"


def time_values(spark: SparkSession, d: str) -> DataFrame:
    """(record_kind, record_key, field_name, source_id, text) of all three time columns."""
    m = table(spark, d, "messages").select(
        F.lit("message").alias("record_kind"), F.col("message_id").cast("string").alias("record_key"), F.lit("message_time").alias("field_name"), F.col("external_store_id").alias("source_id"), F.col("message_time").alias("text")
    )
    cell = lambda f: F.struct(F.lit(f).alias("field_name"), F.col(f).alias("text"))
    c = table(spark, d, "external_candidates").select(
        F.lit("candidate").alias("record_kind"), F.col("external_candidate_id").alias("record_key"), F.col("external_store_id").alias("source_id"), F.inline(F.array(cell("question_time_start"), cell("answer_time_end")))
    )
    return m.unionByName(c)


def p4_normalized(spark: SparkSession, d: str) -> DataFrame:
    """Every time value with its instant or the reason there is none."""
    out = timestamps.to_instants(time_values(spark, d), timestamps.store_sources(table(spark, d, "stores")))
    return out.select("record_kind", "record_key", "field_name", "text", "epoch_ms", "time_status", "day_first_posterior")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Readable values, without the standard spelling of stores in Asia/Shanghai."""
    sources = timestamps.store_sources(table(spark, d, "stores"))
    values = time_values(spark, d)
    orders = timestamps.source_orders(values.select("source_id", "text"), sources)
    # The plain cases go before anything is parsed; the fit above has seen all values.
    plain = sources.where(F.col("zone_id") == SHANGHAI).select(F.col("source_id").alias("_plain"))
    rest = values.join(bounded(plain), values["source_id"] == F.col("_plain"), "left").where(F.col("text").isNotNull() & ~(F.col("_plain").isNotNull() & timestamps.is_standard(F.col("text")))).drop("_plain")
    out = timestamps.to_instants(rest, sources, orders=orders)
    return out.where("epoch_ms is not null").select("record_kind", "record_key", "field_name", "epoch_ms")


def p4_source_orders(spark: SparkSession, d: str) -> DataFrame:
    """The fitted order of day and month of each store, undeclared on purpose."""
    values = time_values(spark, d)
    sources = timestamps.store_sources(table(spark, d, "stores")).withColumn("declared", F.lit(None).cast("string"))
    out = timestamps.source_orders(values.select("source_id", "text"), sources)
    return out.select(F.col("source_id").alias("external_store_id"), F.when(F.col("day_first") >= 0.5, "DMY").otherwise("MDY").alias("fitted_order"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return nested.product_items(table(spark, d, "products"))


def p6_triples(spark: SparkSession, d: str) -> DataFrame:
    """All leaf values of the latest revisions as path, ordinals and value."""
    rows = nested.latest(table(spark, d, "products"), "product_id", ["revision", "ingested_at"])
    out = nested.triples(rows, "product_id")
    return out.select("product_id", "path", F.concat_ws(",", "ordinals").alias("ordinals"), "map_key", "value")


def p6_variants(spark: SparkSession, d: str) -> DataFrame:
    """The child table of variants, with its link to the product."""
    rows = nested.latest(table(spark, d, "products"), "product_id", ["revision", "ingested_at"])
    t = nested.flat_tables(rows, "product_id")["variants.[]"]
    return t.select("product_id", F.col("ordinals")[0].alias("ordinal"), "variant_id", "color_name", "variant_label", "image_asset_ref")


QUERIES = {"p4_found": p4_found, "p4_normalized": p4_normalized, "p4_source_orders": p4_source_orders, "p6_found": p6_found, "p6_triples": p6_triples, "p6_variants": p6_variants}

# White space as in nested.SPACE, for RE2.
_WS = r"[\s\p{Z}\x{1c}-\x{1f}\x{85}\x{0b}]"


def _strip(value: str) -> str:
    return f"regexp_replace({value}, '^{_WS}+|{_WS}+$', '', 'g')"


_LATEST = "with latest as (select * from (select *, row_number() over (partition by product_id order by revision desc nulls last, ingested_at desc nulls last) rn from products where product_id is not null) where rn = 1)"


def _kind(kind: str, key: str, ordinal: str, value: str, source: str) -> str:
    return f"select '{kind}' child_kind, product_id, {key} parent_key, cast({ordinal} as integer) ordinal, {_strip(f'cast({value} as varchar)')} item_value from {source}"


_UNNEST = "latest, unnest(range(1, len({0}) + 1)) u(i)"
ORACLE = {
    "p6_found": _LATEST
    + " select * from ("
    + " union all ".join(
        [
            _kind("upper_material", "''", "0", "construction.upper_material", "latest"),
            _kind("scenario", "''", "i", "identity.scenarios[i]", _UNNEST.format("identity.scenarios")),
            _kind("season", "''", "i", "identity.seasons[i]", _UNNEST.format("identity.seasons")),
            _kind("variant", "''", "i", "variants[i].variant_id", _UNNEST.format("variants")),
            _kind("variant_size", f"coalesce({_strip('variants[i].variant_id')}, '')", "j", "variants[i].available_sizes[j]", _UNNEST.format("variants") + ", unnest(range(1, len(variants[i].available_sizes) + 1)) v(j)"),
            _kind("size_chart", "''", "i", "sizing.size_chart[i].recommended_size", _UNNEST.format("sizing.size_chart")),
            _kind("function_level", _strip("e.key"), "0", "e.value.level", "(select product_id, unnest(map_entries(functions)) e from latest)"),
            _kind("gallery_image", "''", "i", "media.gallery[i].asset_ref", _UNNEST.format("media.gallery")),
        ]
    )
    + ") where item_value <> ''",
    "p6_variants": _LATEST + " select product_id, cast(i as integer) ordinal, variants[i].variant_id variant_id, variants[i].color_name color_name, variants[i].variant_label variant_label, variants[i].image_asset_ref image_asset_ref from " + _UNNEST.format("variants"),
}

# The leaves of the catalogue's schema, in its order.
LEAVES = """
product_id revision ingested_at data_classification
identity.name identity.short_description identity.category identity.synthetic_sku identity.target_gender identity.target_audience identity.seasons.[] identity.scenarios.[]
pricing.currency pricing.display_price pricing.classification
construction.upper_material construction.lining_material construction.sole_material construction.toe_shape construction.upper_height construction.closure_type
construction.manufacturing_process construction.heel_type construction.heel_height_cm construction.platform_height_cm construction.thickness construction.single_shoe_weight_g
style.style_name style.pattern style.fashion_elements.[] functions.{}.level functions.{}.description
sizing.fit sizing.fit_note sizing.size_chart.[].foot_length_cm sizing.size_chart.[].recommended_size sale.sale_type sale.preorder_note
variants.[].variant_id variants.[].color_name variants.[].variant_label variants.[].available_sizes.[] variants.[].image_asset_ref
media.primary_image.asset_ref media.primary_image.alt media.gallery.[].asset_ref media.gallery.[].alt media.detail_images.[]
""".split()


def _triples_of(leaf: str) -> str:
    value, source, places, key = "", "latest", [], "null"
    for step in leaf.split("."):
        if step == "[]":
            i = f"i{len(places)}"
            source += f", unnest(range(1, len({value}) + 1)) u{i}({i})"
            value, places = f"{value}[{i}]", [*places, i]
        elif step == "{}":
            source += f", unnest(map_entries({value})) m(e)"
            value, places, key = "m.e.value", [*places, "0"], "m.e.key"
        else:
            value = f"{value}.{step}" if value else step
    text = f"strftime({value}, '%Y-%m-%d %H:%M:%S.%f')" if leaf == "ingested_at" else f"cast({value} as varchar)"
    return f"select product_id, '{leaf}' as path, concat_ws(',', {', '.join(f'cast({p} as varchar)' for p in places) or chr(39) * 2}) as ordinals, cast({key} as varchar) as map_key, {text} as value from {source}"


ORACLE["p6_triples"] = _LATEST + " " + " union all ".join(map(_triples_of, LEAVES))
