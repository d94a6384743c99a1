"""Scaling, windows, batches and scores."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from pairflow.operators import metrics, model, samples, scale, windows


def positioned(spark, lengths):
    rows = [(n, i, float(100 * n + i), float(i % 7)) for n, t in enumerate(lengths) for i in range(t)]
    return spark.createDataFrame(rows, "network_id bigint, idx bigint, a double, b double")


def test_scaler_uses_the_population(spark):
    df = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (4.0, 5.0)], "a double, `b=1` double")
    got = {r.feature: (r["mean"], r["scale"]) for r in scale.fit_scaler(df, ["a", "b=1"]).collect()}
    assert got["a"] == pytest.approx((7 / 3, 1.247219128924647))
    assert got["b=1"] == (5.0, 1.0)
    state = scale.fit_wide(df, ["a", "b=1"])
    scaled = scale.transform(df, state, ["a", "b=1"])
    assert [r["b=1"] for r in scaled.collect()] == [0.0, 0.0, 0.0]
    back = scale.inverse(scaled, scale.widen(scale.fit_scaler(df, ["a", "b=1"]), ["a", "b=1"]), ["a", "b=1"])
    assert [r.a for r in back.collect()] == pytest.approx([1.0, 2.0, 4.0])


def test_fill_in_value_takes_part_unless_told(spark):
    df = spark.createDataFrame([(1.0,), (3.0,), (-9999.0,)], "a double")
    assert scale.fit_scaler(df, ["a"]).first()["mean"] == pytest.approx(-9995 / 3)
    assert scale.fit_scaler(df, ["a"], sentinel_as_null=True).first()["mean"] == 2.0


@pytest.mark.parametrize("horizon,targets", [(1, [3.0, 4.0]), (0, [2.0, 3.0])])
def test_windows_of_five_rows(spark, horizon, targets):
    got = windows.sample_windows(positioned(spark, [5, 3]), ["a", "b"], "a", 3, horizon).orderBy("start_idx").collect()
    assert [r.y for r in got] == targets
    assert [r.start_idx for r in got] == [0, 1]
    assert got[1].x == [[1.0, 1.0], [2.0, 2.0], [3.0, 3.0]]


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.integers(1, 40), min_size=1, max_size=4), st.integers(1, 9), st.integers(0, 1))
def test_window_counts_and_values(spark, lengths, length, horizon):
    df = positioned(spark, lengths)
    got = windows.sample_windows(df, ["a"], "a", length, horizon, width=length + 1).collect()
    assert len(got) == sum(max(t - length, 0) for t in lengths)
    for r in got:
        first = 100 * r.network_id + r.start_idx
        assert [v[0] for v in r.x] == [float(first + k) for k in range(length)]
        assert r.y == first + length - (0 if horizon else 1)


@pytest.mark.parametrize("horizon", [0, 1])
def test_window_features_equal_the_arrays(spark, horizon):
    df = positioned(spark, [30, 12])
    full = windows.sample_windows(df, ["b"], "a", 6, horizon).select(
        "network_id",
        "start_idx",
        F.element_at("x", -1)[0].alias("last"),
        F.aggregate("x", F.lit(0.0), lambda s, r: s + r[0] / 6).alias("mean"),
        "y",
    )
    cut = windows.window_features(df, ["b"], "a", 6, horizon, lags=[1, 9], width=10)
    both = full.join(cut.drop("y"), ["network_id", "start_idx"]).collect()
    assert len(both) == full.count() == 24 + 6
    for r in both:
        assert r["last"] == r.b_last and r["mean"] == pytest.approx(r.b_mean)
        step = r.start_idx + 6 - (0 if horizon else 1)
        assert r.b_lag1 == float((step - 1) % 7)
        assert r.b_lag9 == (float((step - 9) % 7) if step >= 9 else None)


def test_long_window_means(spark):
    df = positioned(spark, [200, 71]).withColumn("b", F.when(F.col("idx") != 20, F.col("b")))
    got = windows.window_features(df, ["a", "b"], "a", 70, width=90).collect()
    assert len(got) == 130 + 1
    for r in got:
        steps = range(r.start_idx, r.start_idx + 70)
        assert r.a_mean == pytest.approx(100 * r.network_id + np.mean(steps))
        assert r.b_mean == pytest.approx(np.mean([i % 7 for i in steps if i != 20]))


def test_batches(spark):
    samples = windows.sample_windows(positioned(spark, [6, 2, 5]), ["a"], "a", 3).select("network_id", "start_idx")
    got = sorted(windows.assign_batches(samples, 2, width=1).collect())
    assert [(r.network_id, r.start_idx, r.batch_id) for r in got] == [
        (0, 0, 0),
        (0, 1, 0),
        (0, 2, 1),
        (2, 0, 1),
        (2, 1, 2),
    ]


def test_previous(spark):
    got = windows.previous(positioned(spark, [3, 1]), "a").orderBy("network_id", "idx").collect()
    assert [r.previous for r in got] == [None, 0.0, 1.0, None]


def pairs(spark, o, m):
    return spark.createDataFrame([(float(a), float(b)) for a, b in zip(o, m)], "o double, m double").withColumn("g", F.lit(1))


def test_nse(spark):
    assert metrics.nse(pairs(spark, [1, 2, 4, 5], [1, 2, 3, 6]), ["g"]).first().nse == 0.8
    assert metrics.nse(pairs(spark, [3, 3], [1, 2]), ["g"]).first().nse is None
    # 1 - 0.875 = 0.125: half-even gives 0.12, as numpy does.
    half = pairs(spark, [0, 2], [math.sqrt(1.75), 2])
    assert metrics.nse(half, ["g"]).first().nse == round(0.125, 2) == 0.12


def test_nse_slice_of_short_series(spark):
    """Worked by hand: all rows of the slice give the mean, only rows that a window ends at give errors."""
    o, m = [9.0, 1.0, 3.0, 5.0, 7.0, 4.0, 8.0], [0.0, 0.0, 2.0, 6.0, 9.0, 4.0, 8.0]
    df = spark.createDataFrame([(0, i, o[i], m[i]) for i in range(7)], "network_id bigint, idx bigint, o double, m double")
    nse = lambda *args: metrics.nse_slice(df, *args, digits=None).first().nse
    # Rows 1..5 are 1 3 5 7 4, mean 4. Windows of 2 end at rows 2, 3, 4: errors 1 + 1 + 4, spread 1 + 1 + 9.
    assert nse(1, 5, 2) == pytest.approx(1 - 6 / 11)
    # Windows of 4 end at row 4 only: error 4, spread 9.
    assert nse(1, 5, 4) == pytest.approx(1 - 4 / 9)
    # A slice past the end is cut there: rows 3..6 are 5 7 4 8, mean 6; windows of 1 end at 3, 4, 5.
    assert nse(3, 40, 1) == pytest.approx(1 - (1 + 4 + 0) / (1 + 1 + 4))
    # A slice no longer than the window has none.
    assert nse(1, 3, 3) is None


def test_batch_scores(spark):
    rows = [("r", 0, 0.0, 1.0), ("r", 0, 2.0, 4.0), ("r", 1, 1.0, 4.0), ("r", 1, 5.0, 5.0)]
    df = spark.createDataFrame(rows, "run_id string, batch_id int, o double, m double")
    assert metrics.mse(df, ["run_id"]).first().mse == (2.5 + 4.5) / 2
    assert metrics.rmse(df, ["run_id"]).first().rmse == pytest.approx((math.sqrt(2.5) + math.sqrt(4.5)) / 2)
    assert metrics.epoch_nse(df, ["run_id"]).first().nse == pytest.approx((round(1 - 5 / 2, 2) + round(1 - 9 / 8, 2)) / 2)
    ev = metrics.evaluate(df.withColumn("epoch", F.lit(3)).withColumn("split", F.lit("val")))
    log = {r.metric: r.value for r in metrics.history(ev).collect()}
    assert log["loss_val"] == 3.5 and set(log) == {"loss_val", "nse_val"}


def runs(spark, *lists):
    rows = [(f"r{k}", i, "m", float(v)) for k, values in enumerate(lists) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "run_id string, epoch int, metric string, value double")


def test_early_stop_examples(spark):
    a = metrics.early_stop(runs(spark, [1.0, 1.05, 1.2, 1.3, 0.9, 1.1]), patience=2, min_delta=0.1).orderBy("epoch")
    assert [(r.counter, r.stop) for r in a.collect()] == list(
        zip([0, 0, 1, 2, 0, 1], [False, False, False, True, False, False])
    )
    b = runs(spark, [0.5, 0.45, 0.3, 0.3, 0.5])
    got = metrics.early_stop(b, patience=2, min_delta=0.1, mode="max").orderBy("epoch").collect()
    assert [r.counter for r in got] == [0, 0, 1, 2, 0]
    assert [r.epoch for r in got if r.stop] == [3]


@pytest.mark.parametrize("bucket", [2, 1000])
def test_early_stop_of_literal_histories(spark, bucket):
    nan = math.nan
    worse, better = {"patience": 2, "min_delta": 0.5, "bucket": bucket}, {"patience": 2, "min_delta": 0.5, "mode": "max", "bucket": bucket}
    for values, counters, options in (
        ([3.0, 3.2, 4.0, nan, 4.0, 2.9, 9.0], [0, 0, 1, 1, 2, 0, 1], worse),
        ([nan, 1.0, 2.0, 1.6, 1.5], [0, 0, 1, 2, 2], worse),
        ([0.5, 0.5, 0.0, 0.1, -1.0, 0.5], [0, 0, 1, 1, 2, 0], better),
        ([nan, -2.0, -3.0, -1.9], [0, 0, 1, 0], better),
    ):
        got = metrics.early_stop(runs(spark, values), **options).orderBy("epoch").collect()
        assert [r.counter for r in got] == counters, values


@pytest.mark.parametrize("mode", ["min", "max"])
def test_early_stop_properties(spark, mode):
    rng = random.Random(5)
    lists = [[round(rng.uniform(0, 3), 1) for _ in range(60)] for _ in range(6)]
    got = {}
    for r in metrics.early_stop(runs(spark, *lists), patience=3, min_delta=0.2, mode=mode, bucket=7).orderBy("run_id", "epoch").collect():
        got.setdefault(r.run_id, []).append((r.value, r.counter, r.stop))
    sign = 1 if mode == "min" else -1
    for rows in got.values():
        for i, (value, counter, stop) in enumerate(rows):
            best = min((sign * v for v, _, _ in rows[:i]), default=math.inf)
            is_new_best = sign * value < best or (mode == "max" and sign * value == best)
            assert counter == 0 or not is_new_best
            assert counter - (rows[i - 1][1] if i else 0) <= 1
            if stop:
                since = next(k for k in range(i, -1, -1) if k == 0 or rows[k][1] < rows[k - 1][1] or rows[k][1] == 0)
                bad = sum(sign * v > best + 0.2 - 1e-9 for v, _, _ in rows[since : i + 1])
                assert counter >= 3 and bad >= 3


def test_last_values_as_published(spark):
    # The published last ten.
    values = [0.1, 0.2, 0.9875, 0.99, 0.99, 0.99, 0.99, 0.9875, 0.99, 0.99, 0.9875, 0.99]
    got = metrics.last_n(runs(spark, values)).first()
    assert got["values"] == "0.9875, 0.99, 0.99, 0.99, 0.99, 0.9875, 0.99, 0.99, 0.9875, 0.99"
    assert got.average == pytest.approx(0.98925)
    with pytest.raises(PySparkException):
        metrics.last_n(runs(spark, values[:9])).collect()
    assert metrics.last_values(runs(spark, values), 3).count() == 3
    long = runs(spark, range(2500))
    assert sorted(r.epoch for r in metrics.last_values(long, 1200).collect()) == list(range(1300, 2500))
    plan = metrics.last_values(long, 10)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_correlations_are_of_columns(spark):
    df = spark.createDataFrame([(1.0, 2.0, 5.0), (2.0, 4.0, 3.0), (3.0, 6.0, 1.0)], "a double, t double, b double")
    got = {r.feature: r.correlation for r in metrics.correlations(df, ["a", "b"], "t").collect()}
    assert got == pytest.approx({"a": 1.0, "b": -1.0})


def test_scoring_with_a_given_model(spark):
    samples = windows.sample_windows(positioned(spark, [40, 9]), ["a", "b"], "a", 4)
    got = model.score_windows(samples, lambda x: x[:, -1, 0] + x[:, :, 1].sum(axis=1)).collect()
    assert len(got) == 36 + 5 and set(got[0].asDict()) == {"network_id", "start_idx", "y", "m"}
    for r in got:
        steps = range(r.start_idx, r.start_idx + 4)
        assert r.m == 100 * r.network_id + steps[-1] + sum(i % 7 for i in steps)


@pytest.mark.parametrize("width", [None, 50])
def test_block_scores_equal_the_arrays(spark, width):
    df = positioned(spark, [140, 41, 12])
    scorer = lambda x: x[:, -1, 0] + x[:, :, 1].sum(axis=1)
    full = model.score_windows(windows.sample_windows(df, ["a", "b"], "a", 40), scorer)
    got = model.score_blocks(df, ["a", "b"], 40, scorer, width=width)
    assert sorted(got.collect()) == sorted(full.select("network_id", "start_idx", "m").collect()) and got.count() == 101
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan


def test_window_means_see_their_own_rows_only(spark):
    df = positioned(spark, [300]).withColumn("b", F.when(F.col("idx") == 10, F.lit(float("nan"))).when(F.col("idx") < 10, F.lit(1e16)).otherwise(F.lit(0.1)))
    got = windows.window_features(df, ["b"], "a", 64, width=90).collect()
    wrong = [r.start_idx for r in got if math.isnan(r.b_mean) != (r.start_idx <= 10)]
    assert not wrong and all(r.b_mean == pytest.approx(0.1) for r in got if r.start_idx > 10)


def test_linear_model_beats_persistence(spark):
    rng = random.Random(7)
    rows = []
    for n in range(4):
        down = [rng.uniform(0, 10) for _ in range(120)]
        for i in range(120):
            up = 3.0 * down[i - 1] + 1.0 if i else 0.0
            rows.append((n, i, down[i], up))
    df = spark.createDataFrame(rows, "network_id bigint, idx bigint, `flow=x` double, flow_y double")
    table = windows.window_features(df, ["flow=x"], "flow_y", 8, lags=[2])
    features = ["flow=x_last", "flow=x_mean", "flow=x_lag2"]
    fitted = model.fit_flow(table.where("network_id < 3"), features)
    pred = model.predict_flow(fitted, table.where("network_id = 3"), features).withColumnRenamed("y", "o")
    assert metrics.nse(pred, ["network_id"]).first().nse == 1.0
    last = windows.previous(df, "flow_y", "m").where("network_id = 3").withColumnRenamed("flow_y", "o")
    assert metrics.nse(last, ["network_id"]).first().nse < 0.5


def stored(spark, df, length, width, tmp_path):
    samples.write_samples(df, ["a", "b=1"], "a", length, str(tmp_path / "samples"), width)
    return samples.read_samples(spark, str(tmp_path / "samples"))


@pytest.mark.parametrize("horizon", [0, 1])
@pytest.mark.parametrize("width", [None, 40, 57])
def test_stored_samples_equal_the_arrays(spark, tmp_path, width, horizon):
    """Networks of all lengths about the block and window; also shorter windows from the same store."""
    df = positioned(spark, [200, 41, 40, 39, 1, 80, 81, 114]).withColumnRenamed("b", "b=1")
    store = stored(spark, df, 40, width, tmp_path)
    scorer = lambda x: x[:, -1, 0] + 1000 * x[:, 0, 0] + x[:, :, 1].sum(axis=1)
    for length in (40, 13):
        full = model.score_windows(windows.sample_windows(df, ["a", "b=1"], "a", length, horizon), scorer)
        got = samples.score_samples(store, ["a", "b=1"], "a", length, scorer, horizon, batch_size=17)
        want = full.select("network_id", "start_idx", F.col("y").alias("o"), "m")
        assert sorted(got.collect()) == sorted(want.collect())
        assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
        places = samples.sample_places(store, length)
        assert sorted((r.network_id, r.start_idx) for r in places.collect()) == sorted((r.network_id, r.start_idx) for r in got.collect())


def test_a_store_grows_with_rows_not_with_windows(spark, tmp_path):
    df = positioned(spark, [20_000]).withColumnRenamed("b", "b=1")
    for length in (64, 1024):
        store = stored(spark, df, length, 8192, tmp_path)
        assert store.agg(F.sum("n_rows")).first()[0] == 20_000 + 2 * length


def test_stored_samples_of_odd_rows(spark, tmp_path):
    """Missing values are NaN to the model and NULL as targets; no rows give none; too long windows are refused."""
    gone = F.when(F.col("idx") != 50, F.col("a"))
    df = positioned(spark, [120]).withColumn("a", gone).withColumnRenamed("b", "b=1")
    store = stored(spark, df, 8, 16, tmp_path)
    got = samples.score_samples(store, ["a"], "a", 8, lambda x: x.sum(axis=(1, 2))).orderBy("start_idx").collect()
    assert len(got) == 112
    assert [r.start_idx for r in got if r.o is None] == [42]
    assert [r.start_idx for r in got if math.isnan(r.m)] == list(range(43, 51))
    assert samples.score_samples(store.where("false"), ["a"], "a", 8, len).count() == 0
    assert samples.pack_samples(df.where("false"), ["a"], "a", 8).count() == 0
    with pytest.raises(PySparkException):
        samples.score_samples(store, ["a"], "a", 9, lambda x: x.sum(axis=(1, 2))).collect()
    with pytest.raises(PySparkException):
        samples.sample_places(store, 9).collect()


@pytest.mark.parametrize("horizon", [0, 1])
def test_block_scores_bring_their_targets(spark, horizon):
    df = positioned(spark, [140, 41, 12])
    scorer = lambda x: x[:, -1, 0]
    full = model.score_windows(windows.sample_windows(df, ["a", "b"], "a", 40, horizon), scorer)
    got = model.score_blocks(df, ["a", "b"], 40, scorer, width=50, target="a", horizon=horizon)
    assert sorted(got.collect()) == sorted(full.select("network_id", "start_idx", F.col("y").alias("o"), "m").collect())


def test_early_stop_moves_its_rows_once(spark, monkeypatch):
    """Rows are read for the best of each bucket and to go to their buckets; then only rows of buckets move."""
    from pairflow.operators import metrics as module

    seen = []
    kept = module.materialize
    monkeypatch.setattr(module, "materialize", lambda df: seen.append(df) or kept(df))
    got = metrics.early_stop(runs(spark, [float((7 * i) % 50) for i in range(400)], [1.0, 2.0]), patience=3, bucket=50)
    inner = seen[0]._jdf.queryExecution().executedPlan().toString()
    outer = got._jdf.queryExecution().executedPlan().toString()
    assert got.count() == 402 and inner.split("Initial Plan")[-1].count("ExistingRDD") == 2
    assert "BroadcastHashJoin" in outer and "Exchange hashpartitioning" not in outer
