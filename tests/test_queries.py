"""Every query of the core against its SQL."""

from pathlib import Path

import duckdb
import pytest

from tests.compare import same
from tickspark.plans import queries

SF = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for p in SF.iterdir():
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_same_as_sql(spark, con, name):
    got = queries.QUERIES[name](spark, str(SF)).toPandas()
    assert same(got, con.execute(queries.ORACLE[name]).df()).startswith("ok")


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLE)))
def test_rows(spark, name):
    assert queries.QUERIES[name](spark, str(SF)).count() > 0


def test_scans_are_pruned(spark):
    plan = queries.QUERIES["range_scan"](spark, str(SF))._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(ts" in plan and "props" not in plan


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
