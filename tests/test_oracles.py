"""Every registered query with SQL gives the rows of its SQL."""

import pytest

import __spark_entry__ as entry
from tests.oracle import SMALL, duck, rows
from viaduct.plans.registry import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_matches_sql(spark, name):
    got = rows(QUERIES[name](spark, SMALL).toArrow())
    assert got == rows(duck(SMALL).execute(ORACLE_SQL[name]).to_arrow_table())


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).columns[:2] == ["segment_id", "bucket"]


def test_round_trip_differs_nowhere(spark):
    assert QUERIES["snk07_round_trip"](spark, SMALL).isEmpty()


def test_whole_second_sides(spark):
    assert QUERIES["s03_union_networks_whole"](spark, SMALL).where("network = 'metro'").count() == spark.read.parquet(f"{SMALL}/customer.parquet").count()


def test_no_name_is_registered_twice():
    from viaduct.plans.registry import MODULES

    assert len(QUERIES) == sum(len(m.QUERIES) for m in MODULES) and len(ORACLE_SQL) == sum(len(m.ORACLE_SQL) for m in MODULES)
