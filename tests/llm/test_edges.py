"""Nulls in every column, extra columns with clashing names, empty tables: defined results."""

import pytest
from pyspark.sql import functions as F

from colloquy.llm import queries

TABLES = ("messages", "text_sources", "external_candidates", "documents", "subject_labels", "subject_areas", "mix_targets", "stores")
D = "/root/testdata/sf0.001"
CLASHING = ("role", "text_", "source_id", "epoch_ms", "_s", "seq", "kept", "rep", "norm", "h", "copies", "id", "record_kind", "bands")


def write(spark, folder, change):
    for name in TABLES:
        change(name, spark.read.parquet(f"{D}/{name}.parquet")).write.parquet(f"{folder}/{name}.parquet")


@pytest.mark.parametrize("name", ["p1_found", "p2_found", "p3_found", "p5_found", "p7_found", "p8_ids", "p9_mix", "p10_found"])
def test_extra_columns_change_nothing(spark, tmp_path_factory, name):
    folder = tmp_path_factory.mktemp("extra")
    write(spark, folder, lambda _, df: df.withColumns({c: F.lit("x") for c in CLASHING if c not in df.columns}))
    got = sorted(map(str, queries.QUERIES[name](spark, str(folder)).collect()))
    assert got == sorted(map(str, queries.QUERIES[name](spark, D).collect()))


@pytest.mark.parametrize("name", ["p1_found", "p2_found", "p3_found", "p5_found", "p7_found", "p8_ids", "p9_mix", "p10_found"])
def test_null_rows_and_empty_tables(spark, tmp_path_factory, name):
    folder = tmp_path_factory.mktemp("nulls")
    # The first row with nothing but nulls.
    write(spark, folder, lambda _, df: df.limit(20).unionByName(df.limit(1).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in df.schema.fields])))
    queries.QUERIES[name](spark, str(folder)).collect()
    empty = tmp_path_factory.mktemp("empty")
    write(spark, empty, lambda n, df: df if n in ("subject_areas", "mix_targets", "stores") else df.limit(0))
    assert queries.QUERIES[name](spark, str(empty)).count() == 0
