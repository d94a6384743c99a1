"""Every registered query against its SQL, at the smallest scale."""

from __future__ import annotations

import pytest
from check_queries import SF_DIR, connect, difference
from pyspark.sql import DataFrameWriter
from pyspark.sql.classic.dataframe import DataFrame

import __spark_entry__ as entry
from pairflow.plans import oracle
from pairflow.plans import queries as registered


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


COSTLY = ("CartesianProduct", "NestedLoop", "BatchEvalPython", "ArrowEvalPython")


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def inner_plans(monkeypatch):
    """Plans of what a query stores on its way: staged tables and checkpoints."""
    seen = []
    checkpoint, parquet = DataFrame.checkpoint, DataFrameWriter.parquet

    def noted_checkpoint(self, *args, **kwargs):
        seen.append(plan_of(self))
        return checkpoint(self, *args, **kwargs)

    def noted_parquet(self, *args, **kwargs):
        seen.append(plan_of(self._df))
        return parquet(self, *args, **kwargs)

    monkeypatch.setattr(DataFrame, "checkpoint", noted_checkpoint)
    monkeypatch.setattr(DataFrameWriter, "parquet", noted_parquet)
    return seen


def test_every_query_has_sql():
    assert set(oracle.ORACLE) == set(registered.QUERIES)
    assert set(registered.QUERIES) <= set(entry.queries())


@pytest.mark.parametrize("name", list(registered.QUERIES))
def test_query_equals_sql(spark, con, inner_plans, name):
    df = entry.queries()[name](spark, SF_DIR)
    for plan in [plan_of(df), *inner_plans]:
        for costly in COSTLY:
            assert costly not in plan
    assert difference(df.toPandas(), con.execute(entry.oracle_sql()[name]).df()) is None


def test_assembly_reads_its_lookups_once(spark, inner_plans):
    """The failure of a place is found in the pass that makes its rows: no second assembly is in the plan."""
    plan = plan_of(entry.queries()["build_series"](spark, SF_DIR))
    assert plan.count("lineitem.parquet") <= 3


def test_rejected_pairs_go_before_the_pair_join(spark, inner_plans):
    entry.queries()["network_rows"](spark, SF_DIR)
    join = next(p for p in inner_plans if "SortMergeJoin" in p and "streamflow" in p)
    assert join.index("SortMergeJoin") < join.index("BroadcastHashJoin")


def test_entry_gives_rows(spark):
    got = entry.entry(spark).toPandas()
    assert sorted(got.columns) == ["network_id", "nse"]
    assert len(got) > 0


def test_assembly_shuffles_its_grid_once(spark, inner_plans):
    """Forcing and flow come to the grid on one key: between the two joins nothing is exchanged."""
    plan = plan_of(entry.queries()["build_series"](spark, SF_DIR))
    lines = plan.splitlines()
    joins = [i for i, x in enumerate(lines) if "SortMergeJoin [place" in x]
    assert len(joins) == 2
    assert not any("Exchange" in x for x in lines[joins[0] + 1 : joins[1]])
