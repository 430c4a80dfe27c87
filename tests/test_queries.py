"""Every registered query against its SQL in DuckDB, on the smallest tables."""

import os
from collections import Counter

import duckdb
import pytest

from firnspark.oracles import oracle_sql
from firnspark.queries import QUERIES
from tests.conftest import SF

TABLES = "region nation customer supplier part orders lineitem events"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES.split():
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{os.path.join(SF, t)}.parquet'")
    return c


def bag(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    cell = lambda v: float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v
    return Counter(tuple(cell(r[k]) for k in order) for r in rows)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    found = QUERIES[name](spark, SF)
    rows = [tuple(r) for r in found.collect()]
    assert rows
    if name in oracle_sql():
        want = duck.sql(oracle_sql()[name])
        assert sorted(found.columns) == sorted(want.columns)
        assert bag(found.columns, rows) == bag(want.columns, want.fetchall())


def test_entry_and_names(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(QUERIES) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())


def test_one_exchange_for_ordered_series(spark):
    """Windows, islands and aggregates by segment share one shuffle of the samples."""
    from firnspark.plans import flotation
    from firnspark.sources import profiles

    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = flotation.windows(flotation.analysed(profiles.from_events(spark, SF)))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert plan.count("Exchange hashpartitioning") == 1 and "BroadcastNestedLoopJoin" not in plan
