"""Every grid query against its SQL on the smallest tables; those without SQL must give rows."""

from __future__ import annotations

import pytest

from gridloom import catalogue

from .sqlcheck import connect, same_rows

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = catalogue.queries(), catalogue.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, duck, name):
    same_rows(QUERIES[name](spark, SF), duck.sql(ORACLES[name]))


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_gives_rows(spark, name):
    df = QUERIES[name](spark, SF)
    assert len(set(df.columns)) == len(df.columns) and df.count() > 0


def test_entry_module(spark):
    import __spark_entry__ as entry

    assert set(ORACLES) <= set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() == 3


def test_a_scatter_has_every_cell(spark):
    ids = lambda df: sorted(r.pixel_id for r in df.select("pixel_id").collect())
    got = QUERIES["scatter_map"](spark, SF)
    orders = spark.read.parquet(f"{SF}/orders.parquet").selectExpr("o_orderkey AS pixel_id")
    assert ids(got) == ids(orders) and got.where("row_idx >= 5").count() > 0
