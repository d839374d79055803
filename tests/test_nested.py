"""Flattening of nested records."""

from colloquy.operators import nested

SCHEMA = (
    "product_id string, revision int, ingested_at timestamp, identity struct<scenarios:array<string>,seasons:array<string>>, construction struct<upper_material:string>,"
    "functions map<string,struct<level:string,description:string>>, variants array<struct<variant_id:string,available_sizes:array<int>>>,"
    "sizing struct<size_chart:array<struct<recommended_size:int>>>, media struct<gallery:array<struct<asset_ref:string>>>"
)


def rows(spark, data):
    return spark.createDataFrame(data, SCHEMA)


def test_items(spark):
    df = rows(
        spark,
        [
            ("p", 1, None, (["old"], None), None, None, None, None, None),
            ("p", 2, None, ([" a　", None, " ", "a"], []), (" net\n",), {"k ": (" high ", "d"), "n": None}, [("v1", [40, None, 41]), None, (" v3 ", None)], ([(40,), None],), ([("x",), (None,)],)),
            ("p", 2, None, ([" a　", None, " ", "a"], []), (" net\n",), {"k ": (" high ", "d"), "n": None}, [("v1", [40, None, 41]), None, (" v3 ", None)], ([(40,), None],), ([("x",), (None,)],)),
            ("q", None, None, None, None, None, None, None, None),
            (None, 1, None, (["lost"], None), None, None, None, None, None),
        ],
    )
    got = {tuple(r) for r in nested.product_items(df).collect()}
    assert got == {
        ("scenario", "p", "", 1, "a"), ("scenario", "p", "", 4, "a"), ("upper_material", "p", "", 0, "net"), ("function_level", "p", "k", 0, "high"),
        ("variant", "p", "", 1, "v1"), ("variant", "p", "", 3, "v3"), ("variant_size", "p", "v1", 1, "40"), ("variant_size", "p", "v1", 3, "41"),
        ("size_chart", "p", "", 1, "40"), ("gallery_image", "p", "", 1, "x"),
    }
    assert nested.product_items(df.limit(0)).count() == 0


def test_tables_and_triples(spark):
    df = rows(spark, [("p", 2, None, (["a", None], None), None, {"k": ("hi", "d")}, [("v1", [40, 41]), ("v2", None)], None, None)])
    tables = nested.flat_tables(df, "product_id")
    assert [tuple(r) for r in tables["variants.[]"].collect()] == [("p", [1], None, "v1"), ("p", [2], None, "v2")]
    assert [tuple(r) for r in tables["variants.[].available_sizes.[]"].collect()] == [("p", [1, 1], None, 40), ("p", [1, 2], None, 41)]
    assert [tuple(r) for r in tables["functions.{}"].collect()] == [("p", [0], "k", "hi", "d")]
    assert tables[""].count() == 1
    flat = {(r.path, tuple(r.ordinals), r.map_key, r.value) for r in nested.triples(df, "product_id").collect()}
    assert ("variants.[].available_sizes.[]", (1, 2), None, "41") in flat
    assert ("identity.scenarios.[]", (2,), None, None) in flat
    assert ("functions.{}.level", (0,), "k", "hi") in flat
