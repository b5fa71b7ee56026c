"""Every registered telemetry query against its SQL oracle."""

import pytest

from compare import duck_rows, spark_rows
from conftest import SF
from telemill.plans import catalog


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_oracle(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    assert spark_rows(df, columns) == duck_rows(duck, catalog.ORACLES[name], columns)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_query_without_oracle_runs(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert {r["kind"] for r in __spark_entry__.entry(spark).collect()} <= {"c2", "url", "hash", "pulse"}
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
