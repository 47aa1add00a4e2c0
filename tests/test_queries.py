"""Every query of the content-addressed domain against its SQL, on the smallest tables."""

import pytest

from cairn.plans.queries import ORACLE_SQL, QUERIES
from verify import compare


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_matches_sql(spark, sf, name):
    said = compare(spark, name, QUERIES[name], ORACLE_SQL[name], sf)
    assert ": ok" in said, said


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - ORACLE_SQL.keys()))
def test_runs(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    rows = e.entry(spark)
    assert rows.where("valid").count() == rows.count() > 0
    assert e.queries().keys() >= e.oracle_sql().keys()


def test_route_download_names_all_sources(spark, sf):
    """Every chunk meets every server that is online and readable, near ones first, and is not cut after some."""
    from cairn.plans import domain as D

    able = D.servers(spark, sf).where("is_online AND is_readable").count()
    counts = QUERIES["route_download"](spark, sf).groupBy("hash").count().toPandas()["count"]
    assert able > 3 and set(counts) == {able} and len(counts) == D.chunk_keys(spark, sf).count()
