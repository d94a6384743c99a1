from __future__ import annotations

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from pairflow.functions.expr import value_bucket
from pairflow.operators import joins, ordering


def _rows(spark, seed=1):
    rng = random.Random(seed)
    rows = []
    for key, n in (("hot", 900), ("warm", 50), ("one", 1)):
        rows += [(key, t, float(rng.randint(0, 20))) for t in rng.sample(range(5000), n)]
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "k string, t bigint, v double")


@pytest.mark.parametrize("width", [1, 7, 100, 10_000])
def test_row_index_equals_one_window(spark, width):
    df = _rows(spark)
    got = ordering.row_index(df, ["k"], ["t"], value_bucket(F.col("t"), width))
    want = df.withColumn("idx", F.row_number().over(Window.partitionBy("k").orderBy("t")).cast("bigint") - 1)
    assert sorted(got.select(*want.columns).collect()) == sorted(want.collect())


def test_row_index_without_keys_and_with_bounds(spark):
    df = _rows(spark).where("k <> 'warm'")
    order = ["t", "k"]
    got = ordering.row_index(df, [], order, value_bucket(F.col("t"), 50), first=100, last=120)
    want = [r for i, r in enumerate(sorted(df.collect(), key=lambda r: (r.t, r.k))) if 100 <= i <= 120]
    assert [(r.k, r.t) for r in sorted(got.collect(), key=lambda r: r.idx)] == [(r.k, r.t) for r in want]


@pytest.mark.parametrize("before,width", [(1, 1), (3, 3), (5, 64), (24, 30)])
def test_blocks_equal_one_window(spark, before, width):
    df = ordering.row_index(_rows(spark, 2), ["k"], ["t"], value_bucket(F.col("t"), 100))
    frame = lambda *keys: Window.partitionBy(*keys).orderBy("idx").rowsBetween(-before, -1)
    blocks = ordering.overlapping_blocks(df, "idx", before, width)
    got = (
        blocks.withColumn("s", F.sum("v").over(frame("k", "block")))
        .where("not borrowed")
        .select("k", "t", "s")
    )
    want = df.withColumn("s", F.sum("v").over(frame("k"))).select("k", "t", "s")
    key = lambda r: (r.k, r.t)
    assert sorted(got.collect(), key=key) == sorted(want.collect(), key=key)


def test_blocks_must_hold_the_look_back(spark):
    with pytest.raises(ValueError):
        ordering.overlapping_blocks(spark.range(3).withColumnRenamed("id", "idx"), "idx", 5, 4)


@pytest.mark.parametrize("top", [0, 1, 9, 10, 25])
def test_id_range(spark, top):
    one = spark.createDataFrame([(top,)], "m bigint")
    got = ordering.id_range(one, "m", "i", step=10)
    assert sorted(r.i for r in got.collect()) == list(range(top + 1))


def test_id_range_of_nothing(spark):
    one = spark.createDataFrame([(None,)], "m bigint")
    assert ordering.id_range(one, "m", "i").count() == 0


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_lookup_beyond_the_broadcast_bound(spark, how):
    df = _rows(spark, 3)
    table = spark.createDataFrame([("hot", 1), ("hot", 2), ("warm", 3), ("none", 4)], "k string, w bigint")
    want = df.join(table, "k", how)
    small = joins.lookup(df, table, ["k"], how)
    salted = joins.lookup(df, table, ["k"], how, spread=["t"], max_bytes=1, hot_rows=100)
    names = want.columns
    for got in (small, salted):
        assert sorted(map(str, got.select(*names).collect())) == sorted(map(str, want.collect()))
    condition = F.col("w") < F.col("v")
    if how in ("left_semi", "inner"):
        want = df.join(table.withColumnRenamed("k", "k2"), (F.col("k") == F.col("k2")) & condition, how)
        kept = [c for c in want.columns if c != "k2"]
        salted = joins.lookup(df, table, ["k"], how, ["t"], condition, max_bytes=1, hot_rows=100)
        assert sorted(map(str, salted.select(*kept).collect())) == sorted(map(str, want.select(*kept).collect()))


def test_salts_split_the_hot_key(spark):
    df = spark.range(1000).select(F.lit("hot").alias("k"), F.col("id").alias("t"))
    table = spark.createDataFrame([("hot", 1), ("cold", 2)], "k string, w bigint")
    got = joins.lookup(df, table, ["k"], spread=["t"], max_bytes=1, hot_rows=100)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert got.count() == 1000
    assert "__salt" in plan
