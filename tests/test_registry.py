"""Every core query runs on the smallest tables and equals its SQL in DuckDB."""

import glob
import math
import os

import duckdb
import pytest

from colloquy.plans import queries as core

D = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in glob.glob(f"{D}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    if isinstance(v, (list, tuple)):
        return str([norm(x) for x in v])
    try:
        return f"{float(v):.9g}" if type(v).__name__ == "Decimal" else repr(v)
    except ValueError:
        return repr(v)


@pytest.mark.parametrize("name", sorted(core.QUERIES))
def test_query(spark, con, name):
    df = core.QUERIES[name](spark, D)
    rows, cols = df.collect(), df.columns
    if name in core.ORACLE:
        r = con.execute(core.ORACLE[name])
        names = [x[0] for x in r.description]
        assert sorted(names) == sorted(cols)
        want = sorted(tuple(norm(x[names.index(c)]) for c in sorted(cols)) for x in r.fetchall())
        assert sorted(tuple(norm(x[c]) for c in sorted(cols)) for x in rows) == want
