"""Every query with SQL gives the same rows as the SQL, on the smallest tables."""

import datetime
import glob
import math
import os

import pytest

from delvestone import plans

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")
KINDS = {"BIGINT": "bigint", "VARCHAR": "string", "DOUBLE": "double", "BOOLEAN": "boolean", "DATE": "date", "TIMESTAMP": "timestamp_ntz"}


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 6) + 0.0
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None)
    return x


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(plans.SQL))
def test_equals_sql(spark, duck, name):
    df = plans.QUERIES[name](spark, FOLDER)
    rel = duck.sql(plans.SQL[name])
    columns = sorted(df.columns)
    assert columns == sorted(rel.columns)
    types = dict(zip(rel.columns, map(str, rel.types)))
    assert {c: KINDS.get(types[c], types[c]) for c in columns} == {c: dict(df.dtypes)[c] for c in columns}
    key = lambda r: tuple((x is None, str(x)) for x in r)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=key)
    place = [rel.columns.index(c) for c in columns]
    want = sorted((tuple(plain(r[i]) for i in place) for r in rel.fetchall()), key=key)
    assert got == want


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.SQL)))
def test_others_run(spark, name):
    assert plans.QUERIES[name](spark, FOLDER).count() > 0
