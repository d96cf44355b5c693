"""Every registered query against its DuckDB SQL on the driver's tables."""

import math
import os
from collections import Counter

import duckdb
import pytest

from lexspark.plans import registry

SF_DIR = os.environ.get("LEXSPARK_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(SF_DIR):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{SF_DIR}/{name}')")
    yield con
    con.close()


def plain(value):
    """Values that both engines print alike."""
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    return value.isoformat() if hasattr(value, "isoformat") else value


def counted(columns, rows):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return Counter(tuple(plain(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query_equals_its_sql(spark, duck, name):
    df = registry.queries()[name](spark, SF_DIR)
    got = df.collect()
    want = duck.execute(registry.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    assert sorted(df.columns) == sorted(columns)
    a, b = counted(df.columns, got), counted(columns, want.fetchall())
    assert a == b, f"only here: {list((a - b).items())[:3]}; only there: {list((b - a).items())[:3]}"
    assert got
