"""Every query against its SQL on the smallest tables."""

from __future__ import annotations

import math

import duckdb
import pandas as pd
import pytest

from conftest import SMALL
from geoscore.plans.catalog import ORACLES, QUERIES

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents")


@pytest.fixture(scope="module")
def con():
    connection = duckdb.connect()
    for name in TABLES:
        connection.sql(f"CREATE VIEW {name} AS FROM '{SMALL}/{name}.parquet'")
    return connection


def plain(value) -> str:
    if value is None or value is pd.NaT:
        return "NULL"
    if isinstance(value, pd.Timestamp):
        return str(value.date())
    if isinstance(value, (int, float)) or hasattr(value, "dtype"):
        number = float(value)
        return "NULL" if math.isnan(number) else repr(number + 0.0)
    return "NULL" if value is pd.NA else str(value)


def rows(frame: pd.DataFrame) -> list[tuple[str, ...]]:
    ordered = frame[sorted(frame.columns)]
    return sorted(tuple(plain(v) for v in row) for row in ordered.itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, con, name):
    ours = QUERIES[name](spark, SMALL).toPandas()
    theirs = con.sql(ORACLES[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


def test_driver_contract(spark):
    import __spark_entry__ as entry_module

    assert entry_module.entry(spark).count() > 0
    assert set(entry_module.queries()) >= set(entry_module.oracle_sql())


@pytest.mark.parametrize("partitions", ["1", "64"])
@pytest.mark.parametrize("name", ["group_rank", "fill_mean", "impute_knn", "radius_join", "score_and_rank"])
def test_result_does_not_depend_on_partitions(spark, con, name, partitions):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        assert rows(QUERIES[name](spark, SMALL).toPandas()) == rows(con.sql(ORACLES[name]).df())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
