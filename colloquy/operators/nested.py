"""Nested records to related flat tables.

Method: every record is cut into (path, ordinals, value) triples by one expression derived from the
schema; paths are grouped by the repeated ancestor (array or map) they belong to; each group is
pivoted into one table with a key to its parent row.  A record is streamed through one projection and
Parquet reads only the leaves that are asked for.  The pivots are partial aggregates by key first,
so after ``latest``, which leaves the rows partitioned by their key, none of them shuffles.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: White space as Unicode and Python's str.strip know it.
SPACE = r"[\s\p{Z}\x1c-\x1f\x85]"


def strip(c: Column) -> Column:
    """``c`` without white space of any kind at both ends."""
    return F.regexp_replace(c, rf"^{SPACE}+|{SPACE}+$", "")


@dataclass
class Group:
    """A repeated ancestor: its path, its parent's path, and the leaf paths below it."""

    path: tuple[str, ...]
    parent: tuple[str, ...] | None
    leaves: list[tuple[str, ...]] = field(default_factory=list)
    is_map: bool = False


def groups(schema: T.StructType) -> dict[tuple[str, ...], Group]:
    """Groups of a schema by path; () is the record itself.  '[]' marks the element of an array."""
    found = {(): Group((), None)}

    def walk(kind: T.DataType, path: tuple[str, ...], owner: tuple[str, ...]) -> None:
        if isinstance(kind, T.StructType):
            for f in kind.fields:
                walk(f.dataType, (*path, f.name), owner)
        elif isinstance(kind, T.ArrayType):
            here = (*path, "[]")
            found[here] = Group(here, owner)
            walk(kind.elementType, here, here)
        elif isinstance(kind, T.MapType):
            here = (*path, "{}")
            found[here] = Group(here, owner, is_map=True)
            walk(kind.valueType, here, here)
        else:
            found[owner].leaves.append(path)

    walk(schema, (), ())
    return found


def _text(value: Column, kind: T.DataType) -> Column:
    return F.date_format(value, "yyyy-MM-dd HH:mm:ss.SSSSSS") if isinstance(kind, (T.TimestampType, T.TimestampNTZType)) else value.cast("string")


def _leaf(schema: T.DataType, path: tuple[str, ...]) -> T.DataType:
    for p in path:
        schema = schema.elementType if p == "[]" else schema.valueType if p == "{}" else schema[p].dataType
    return schema


_TRIPLE = "array<struct<path:string,group:string,ordinals:array<int>,map_key:string,value:string>>"


def _cut(value: Column, kind: T.DataType, path: tuple[str, ...], group: tuple[str, ...], ordinals: Column, key: Column, wanted: set | None) -> Column | None:
    """Array of the triples of a value, in the order of the schema; None if no leaf below is wanted."""
    if isinstance(kind, T.StructType):
        parts = [_cut(value.getField(f.name), f.dataType, (*path, f.name), group, ordinals, key, wanted) for f in kind.fields]
        parts = [x for x in parts if x is not None]
        return F.concat(*parts) if parts else None
    if isinstance(kind, (T.ArrayType, T.MapType)):
        here = (*path, "[]" if isinstance(kind, T.ArrayType) else "{}")
        inner = kind.elementType if isinstance(kind, T.ArrayType) else kind.valueType
        if _cut(value, inner, here, here, ordinals, key, wanted) is None:
            return None
        if isinstance(kind, T.ArrayType):
            each = F.transform(value, lambda x, i: _cut(x, inner, here, here, F.concat(ordinals, F.array((i + 1).cast("int"))), key, wanted))
        else:
            each = F.transform(F.map_entries(value), lambda e: _cut(e["value"], inner, here, here, F.concat(ordinals, F.array(F.lit(0))), e["key"].cast("string"), wanted))
        return F.coalesce(F.flatten(each), F.array().cast(_TRIPLE))
    if wanted is not None and path not in wanted:
        return None
    cells = (F.lit(".".join(path)).alias("path"), F.lit(".".join(group)).alias("group"), ordinals.alias("ordinals"), key.alias("map_key"), _text(value, kind).alias("value"))
    return F.array(F.struct(*cells)).cast(_TRIPLE)


def triples(df: DataFrame, key: str, paths: list[tuple[str, ...]] | None = None) -> DataFrame:
    """(key, path, group, ordinals, map_key, value): one row for each leaf value, null values included.

    paths: the leaves wanted, all by default.  group is the path of the repeated ancestor, '' for
    the record.  ordinals has one place, from 1, for each array on the way and 0 for a map; map_key
    is the innermost key.  Null and empty arrays give no triples, null elements do.  An empty table
    gives none.
    """
    parts = [_cut(F.col(f"`{f.name}`"), f.dataType, (f.name,), (), F.array().cast("array<int>"), F.lit(None).cast("string"), None if paths is None else set(paths)) for f in df.schema.fields]
    parts = [x for x in parts if x is not None]
    return df.select(F.col(f"`{key}`"), F.inline(F.concat(*parts) if parts else F.array().cast(_TRIPLE)))


def pivot(cut: DataFrame, key: str, leaves: dict[str, str]) -> DataFrame:
    """(key, group, ordinals, map_key, one column a leaf): one row for each element of any group.

    leaves: column name by path.
    """
    return cut.groupBy(F.col(f"`{key}`"), "group", "ordinals", "map_key").agg(*[F.max(F.when(F.col("path") == p, F.col("value"))).alias(name) for p, name in leaves.items()])


def flat_tables(df: DataFrame, key: str) -> dict[str, DataFrame]:
    """One table for each group: '' the parents, else by path, such as 'variants.[]'.

    Columns: key, ordinals (place from 1 in each array on the way; a child's ordinals begin with its
    parent's), map_key, then one column a leaf, named by its path below the group ('value' for
    arrays of plain values).  Key and ordinals join a child to its parent.  The key must be one of
    records: rows of equal key would be one.
    """
    cut = triples(df, key)
    out = {}
    for g in groups(df.schema).values():
        names = {".".join(leaf): "_".join(leaf[len(g.path) :]) or "value" for leaf in g.leaves if leaf != (key,)}
        table = pivot(cut.where(F.col("group") == ".".join(g.path)), key, {p: f"_{i}" for i, p in enumerate(names)})
        cols = [F.col(f"_{i}").cast(_leaf(df.schema, tuple(p.split(".")))).alias(name) for i, (p, name) in enumerate(names.items())]
        out[".".join(g.path)] = table.select(F.col(f"`{key}`"), *(["ordinals", "map_key"] if g.path else []), *cols)
    return out


def latest(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The row of the greatest ``order`` for each key (nulls least; equal rows give one of them).

    A partial aggregate, so that a key with any number of revisions sends one row a task.  Rows
    without key are left out.  Maps can't be compared, so the record only rides along.
    """
    record = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    rank = F.struct(*[F.col(c) for c in order])
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(record, rank).alias("_r")).select(*[F.col(c) if c == key else F.col("_r").getField(c).alias(c) for c in df.columns])


#: Items of the product catalogue: kind, leaf path, leaf path of the parent's key, if it has one.
PRODUCT_ITEMS = [
    ("upper_material", ("construction", "upper_material"), None),
    ("scenario", ("identity", "scenarios", "[]"), None),
    ("season", ("identity", "seasons", "[]"), None),
    ("variant", ("variants", "[]", "variant_id"), None),
    ("variant_size", ("variants", "[]", "available_sizes", "[]"), ("variants", "[]", "variant_id")),
    ("size_chart", ("sizing", "size_chart", "[]", "recommended_size"), None),
    ("function_level", ("functions", "{}", "level"), None),
    ("gallery_image", ("media", "gallery", "[]", "asset_ref"), None),
]


def product_items(products: DataFrame) -> DataFrame:
    """(child_kind, product_id, parent_key, ordinal, item_value) from each product's latest revision.

    Strings are trimmed of all white space; null and blank items are left out but counted in the
    ordinals; repeats are kept.  parent_key is the trimmed variant_id or map key, '' where there is
    none.  Null structs, arrays and maps give no rows.

    The records' triples are pivoted into their groups' tables; a child looks up its parent's key
    among the elements that share the parent's ordinals, which are few and lie in one partition.
    """
    rows = latest(products, "product_id", ["revision", "ingested_at"])
    leaves = {".".join(path): kind for kind, path, _ in PRODUCT_ITEMS}
    wide = pivot(triples(rows, "product_id", [path for _, path, _ in PRODUCT_ITEMS]), "product_id", leaves)
    above = {kind: leaves[".".join(parent)] for kind, _, parent in PRODUCT_ITEMS if parent}
    w = Window.partitionBy("product_id", F.substring_index("group", ".", 1), F.get("ordinals", F.lit(0)))
    wide = wide.withColumns({f"above_{kind}": F.max(own).over(w) for kind, own in above.items()})
    text = lambda c: F.coalesce(strip(c), F.lit(""))
    cells = []
    for kind, path, _ in PRODUCT_ITEMS:
        parent = text(F.col(f"above_{kind}")) if kind in above else text(F.col("map_key")) if "{}" in path else F.lit("")
        ordinal = F.coalesce(F.try_element_at("ordinals", F.lit(-1)), F.lit(0)) if set(path) & {"[]", "{}"} else F.lit(0)
        cells.append(F.struct(F.lit(kind).alias("child_kind"), parent.alias("parent_key"), ordinal.cast("int").alias("ordinal"), strip(F.col(kind)).alias("item_value")))
    out = wide.select("product_id", F.inline(F.array(*cells)))
    return out.where(F.col("item_value") != "").select("child_kind", "product_id", "parent_key", "ordinal", "item_value")
