"""Every query with SQL against DuckDB on the smallest data."""

import math

import duckdb
import pytest

from sparkquarry.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.6g}"
    return str(v)


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_matches_sql(spark, duck, name):
    got, want = registry.QUERIES[name](spark, SF).toPandas(), duck.execute(registry.SQL[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = lambda df: sorted(tuple(map(plain, r)) for r in df[columns].itertuples(index=False))
    assert rows(got) == rows(want)


def test_stream_equals_batch(spark):
    a = registry.QUERIES["streaming_pressure"](spark, SF).toPandas()
    b = registry.QUERIES["pressure_windows"](spark, SF).toPandas()
    key = ["window_start", "event_type"]
    assert a.sort_values(key).reset_index(drop=True)[[*key, "n"]].astype(str).equals(b.sort_values(key).reset_index(drop=True)[[*key, "n"]].astype(str))


def test_entry_imports():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
