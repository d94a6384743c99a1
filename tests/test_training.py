"""The whole way from a series table to scored samples, and how the plans look."""

from __future__ import annotations

import re

import numpy as np
import pytest
from check_queries import SF_DIR
from pyspark.sql import functions as F

from pairflow import fixtures
from pairflow.operators import metrics, model, scale, split
from pairflow.plans import training


@pytest.fixture(scope="module")
def prepared(spark):
    series = fixtures.weekly_series(spark, SF_DIR).drop("site")
    return training.prepare(series, min_std=0.1)


def test_scaler_is_fitted_on_training_networks(prepared):
    rows = prepared.rows.toPandas()
    flags = prepared.flags.toPandas()
    train = rows[rows.network_id.isin(flags[flags.in_train].network_id)]
    state = prepared.scaler_in.first()["state"]
    assert prepared.features == ["streamflow_x", "rain_x", "n_obs_x", "rain_y", "n_obs_y"]
    for f in prepared.features:
        assert state[f]["mean"] == pytest.approx(train[f].mean())
        assert state[f]["scale"] == pytest.approx(train[f].std(ddof=0))
    target = prepared.scaler_out.first()["state"]["streamflow_y"]
    assert target["mean"] == pytest.approx(train["streamflow_y"].mean())


def test_samples_are_scored_in_flow_units(spark, prepared):
    length = 8
    samples = training.samples(prepared, length)
    rows = prepared.rows.groupBy("network_id").count().toPandas()
    assert samples.count() == int((rows["count"] - length).clip(lower=0).sum())
    scored = model.score_windows(samples, lambda x: x[:, :, 0].mean(axis=1))
    in_units = scale.inverse(
        scored.withColumnRenamed("y", "streamflow_y"), prepared.scaler_out, ["streamflow_y"]
    )
    got = in_units.where("network_id = 1").orderBy("start_idx").select("streamflow_y", "m").toPandas()
    net = prepared.rows.where("network_id = 1").orderBy("idx").toPandas()
    assert got["streamflow_y"].to_numpy() == pytest.approx(net["streamflow_y"].to_numpy()[length:])
    state = prepared.scaler_in.first()["state"]["streamflow_x"]
    x = (net["streamflow_x"].to_numpy() - state["mean"]) / state["scale"]
    assert got["m"].to_numpy() == pytest.approx([x[i : i + length].mean() for i in range(len(x) - length)])


def test_scaler_of_the_training_span(spark):
    series = fixtures.weekly_series(spark, SF_DIR).drop("site")
    p = training.prepare(series, ["streamflow_x"], time_gap=24)
    rows = p.rows.toPandas()
    end = int(np.floor((rows.network_id == 0).sum() * 0.7))
    last = int(p.flags.where("in_train").agg(F.max("network_id")).first()[0])
    train = rows[(rows.network_id <= last) & rows.idx.between(24, end)]
    assert p.scaler_in.first()["state"]["streamflow_x"]["mean"] == pytest.approx(train["streamflow_x"].mean())


def test_persistence_equals_a_loop(spark, prepared):
    got = metrics.nse(training.persistence(prepared.rows, 24), ["network_id"], digits=None).toPandas()
    rows = prepared.rows.toPandas().sort_values(["network_id", "idx"])
    for r in got.itertuples():
        y = rows[rows.network_id == r.network_id]["streamflow_y"].to_numpy()
        o, m = y[24:], y[23:-1]
        assert r.nse == pytest.approx(1 - ((o - m) ** 2).sum() / ((o - o.mean()) ** 2).sum())


def test_no_window_holds_a_whole_network(prepared):
    """Every window over rows is partitioned by a bucket or block besides the key."""
    plan = training.scaled(prepared)._jdf.queryExecution().optimizedPlan().toString()
    plan += training.samples(prepared, 8)._jdf.queryExecution().optimizedPlan().toString()
    specs = re.findall(r"Window \[(.*?)\], \[(.*?)\], \[", plan)
    assert specs
    for functions, keys in specs:
        if "row_number" in functions or "collect_list" in functions:
            assert "bucket" in keys or "block" in keys, (functions, keys)


def test_samples_of_sets_and_spans(spark, prepared):
    every = training.samples(prepared, 24).groupBy("network_id").count().collect()
    by_set = training.set_samples(prepared, 24)
    flags = {r.network_id: [s for s in ("train", "val", "test") if r[f"in_{s}"]] for r in prepared.flags.collect()}
    got = {(r.split, r.network_id): r["count"] for r in by_set.groupBy("split", "network_id").count().collect()}
    assert got == {(s, r.network_id): r["count"] for r in every for s in flags[r.network_id]}
    bounds = split.split_time(prepared.rows, 8)
    b = bounds.first()
    rows = training.set_samples(prepared, 8, bounds=bounds).select("split", "network_id", "start_idx", "set_idx").collect()
    assert rows
    for r in rows:
        low, high = b[f"{r.split}_start"], b[f"{r.split}_end"]
        assert low <= r.start_idx and r.start_idx + 8 <= high and r.set_idx == r.start_idx - low
