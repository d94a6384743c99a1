from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from pairflow.functions import expr
from pairflow.operators import networks, split

SCHEMA = "pair_id bigint, du string, time timestamp_ntz, streamflow double, slope double"


def day(n):
    return dt.datetime(2008, 1, 1) + dt.timedelta(days=n)


def series(spark):
    nan = float("nan")
    rows = []
    for n in range(4):
        rows += [(0, "d", day(n), float(n), 1.0), (0, "u", day(n + 1), float(2 * n), 2.0)]  # good, 3 shared days
        rows += [(1, "u", day(n), float(n), 1.0)]  # no downstream
        rows += [(2, "d", day(n), float(n), 1.0)]  # no upstream
        rows += [(3, "d", day(n), nan if n == 2 else 1.0, 1.0), (3, "u", day(n), float(n), 1.0)]  # NaN down
        rows += [(4, "d", day(n), 1.0, 1.0), (4, "u", day(n), float(n), None if n == 3 else 1.0)]  # null up
        rows += [(5, "d", day(n), 1.0, 1.0), (5, "u", day(n), 7.0, 1.0)]  # flat up
        rows += [(6, "d", day(n), nan, 1.0)]  # NaN down and no up: down comes first
        rows += [(8, "d", day(n), 1.0, 1.0), (8, "u", day(n + 50), float(n), 1.0)]  # accepted, shares no time
        rows += [(9, "d", day(n), -9999.0, 1.0), (9, "u", day(n), float(n), 1.0)]  # the fill-in value passes
    return spark.createDataFrame(rows, SCHEMA)


def test_pair_qc_reasons(spark):
    got = {r.pair_id: r.reason for r in networks.pair_qc(series(spark)).collect()}
    assert got == {
        0: "ok",
        1: "downstream_empty",
        2: "upstream_empty",
        3: "downstream_null",
        4: "upstream_null",
        5: "upstream_constant",
        6: "downstream_null",
        7: "downstream_empty",
        8: "ok",
        9: "ok",
    }


def test_optional_checks(spark):
    df = series(spark).where("pair_id in (0, 9)")
    got = networks.pair_qc(df, area="slope", max_area_ratio=1.0)
    assert {r.pair_id: r.reason for r in got.where("pair_id in (0, 9)").collect()} == {0: "area_ratio", 9: "ok"}
    got = networks.pair_qc(df, site_id="streamflow", max_id_gap=100)
    assert {r.pair_id: r.reason for r in got.where("pair_id in (0, 9)").collect()} == {0: "ok", 9: "id_gap"}


def test_numbers_count_pairs_without_shared_time(spark):
    qc = networks.pair_qc(series(spark))
    assert sorted(networks.number_networks(qc).collect()) == [(0, 0), (8, 1), (9, 2)]
    built = networks.build_networks(series(spark), networks.number_networks(qc))
    assert built.columns == ["network_id", "pair_id", "time", "streamflow_x", "slope_x", "streamflow_y", "slope_y"]
    assert {r.network_id: r["count"] for r in built.groupBy("network_id").count().collect()} == {0: 3, 2: 4}
    assert networks.feature_columns(built) == ["streamflow_x", "slope_x", "slope_y"]


def test_repeated_times_multiply(spark):
    df = spark.createDataFrame(
        [(0, "d", day(0), 1.0, 0.0)] * 2 + [(0, "u", day(0), 2.0, 0.0)] * 3, SCHEMA
    )
    assert networks.pair_join(df).count() == 6


def test_slice_keeps_both_ends(spark):
    built = networks.build_networks(series(spark))
    got = networks.row_slice(built, 1, 2, bucket_seconds=3600)
    assert sorted((r.network_id, r.idx) for r in got.collect()) == [(0, 1), (0, 2), (2, 1), (2, 2)]
    assert networks.preview(built, 2).count() == 4


def test_dropped_names_are_checked(spark):
    df = spark.range(1).select(F.lit(1).alias("mp"), F.lit(2).alias("dksat_soil_layers_stag=1"))
    assert networks.drop_features(df, ["mp"]).columns == ["dksat_soil_layers_stag=1"]
    with pytest.raises(ValueError):
        networks.drop_features(df, ["refkdt"])
    assert len(set(networks.DROPPED_FEATURES)) == 31
    assert len(set(networks.OLDER_FEATURES)) == 29


def test_names_with_equal_signs_pass_through(spark):
    df = series(spark).withColumnRenamed("slope", "dksat_soil_layers_stag=1")
    assert "dksat_soil_layers_stag=1_x" in networks.build_networks(df).columns


def flags(spark, n, **options):
    numbers = spark.range(n).withColumnRenamed("id", "network_id")
    rows = split.split_networks(numbers, **options).orderBy("network_id").collect()
    return [[r.network_id for r in rows if r[name]] for name in ("in_train", "in_val", "in_test")]


@pytest.mark.parametrize("n", [1, 4, 5, 9, 10, 50, 90, 170])
def test_split_equals_ranges(spark, n):
    a, v, t = int(n * 0.7), int(n * 0.2), int(n * 0.1)
    train, val, test = flags(spark, n)
    assert train == [i for i in range(a + 1) if i < n]
    assert val == [i for i in range(a + 1, a + v + 1) if i < n]
    if t:
        assert test == list(range(n - t, n))
    else:
        assert len(test) == 1
        assert flags(spark, n, random_test=False)[2] == []
    train, val, test = map(set, flags(spark, n, disjoint=True))
    assert not (train & val or train & test or val & test)


def test_split_time(spark):
    df = spark.range(100).select(F.lit(0).alias("network_id"), F.col("id").alias("idx"))
    bounds = split.split_time(df, 24)
    assert bounds.first().asDict() == {
        "train_start": 24,
        "train_end": 70,
        "val_start": 94,
        "val_end": 114,
        "test_start": 138,
        "test_end": 148,
    }
    assert split.in_time_set(df, bounds, "train").count() == 47
    assert split.in_time_set(df, bounds, "val").count() == 6
    assert split.in_time_set(df, bounds, "test").count() == 0


def test_seconds_and_buckets_ignore_the_session_zone(spark):
    df = spark.sql("SELECT timestamp_ntz'2024-03-10 02:30:00' AS t")
    want = int(dt.datetime(2024, 3, 10, 2, 30, tzinfo=dt.timezone.utc).timestamp())
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        assert df.select(expr.seconds_of(F.col("t"))).first()[0] == want
        assert df.select(expr.time_bucket(F.col("t"), 86400)).first()[0] == want // 86400
        assert df.select(expr.time_bucket(F.col("t"), 600)).first()[0] == want // 600
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_the_join_is_spread_by_time_and_never_a_cross_join(spark):
    plan = networks.pair_join(series(spark))._jdf.queryExecution().optimizedPlan().toString()
    assert "Join Inner" in plan and "time" in plan
