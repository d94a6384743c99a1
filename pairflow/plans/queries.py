"""The registered queries: each runs an operator over the whole driver tables.

Times come out as text and floats rounded, so that results compare across engines.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairflow import fixtures
from pairflow.functions.expr import md5_uniform, ratio, time_text, value_bucket
from pairflow.operators import assemble, metrics, model, networks, ordering, samples, scale, sites, spatial, split, windows
from pairflow.operators.joins import lookup
from pairflow.plans import assembly, training
from pairflow.session import ensure_checkpoint_dir, materialize, stage
from pairflow.sources import io
from pairflow.streaming import ingest

MIN_STD = 34.0
SHORT, LONG, BATCH = 8, 24, 256
FLOWS = ["streamflow_x", "rain_x", "rain_y"]


def r6(c: Column | str) -> Column:
    """Six decimals; adding zero turns -0.0 into 0.0."""
    return F.round(c, 6) + F.lit(0.0)


def r9(c: Column | str) -> Column:
    """Nine decimals, where six would often fall on a tie (weights are multiples of a 64th)."""
    return F.round(c, 9) + F.lit(0.0)


def _series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The weekly series as a stored table, as an assembled one is: check and join both read it."""
    return stage(fixtures.weekly_series(spark, sf_dir))


def _networks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return networks.build_networks(_series(spark, sf_dir), min_std=MIN_STD)


def _staged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The networks as a written table, for queries that go over them more than once."""
    return stage(_networks(spark, sf_dir))


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return networks.with_position(_staged(spark, sf_dir))


# --- pairs and networks ----------------------------------------------------------------------


def pair_qc(spark: SparkSession, sf_dir: str) -> DataFrame:
    qc = networks.pair_qc(fixtures.weekly_series(spark, sf_dir, nulls=True), min_std=MIN_STD)
    return qc.withColumn("std_u", r6("std_u"))


def pair_qc_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    qc = networks.pair_qc(
        fixtures.weekly_series(spark, sf_dir),
        min_std=0.1,
        area="n_obs",
        max_area_ratio=1.0,
        site_id="streamflow",
        max_id_gap=40.0,
    )
    return qc.select("pair_id", r6("area_ratio").alias("area_ratio"), r6("id_gap").alias("id_gap"), "reason")


def pair_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = networks.pair_join(_series(spark, sf_dir))
    return joined.withColumn("time", time_text(F.col("time")))


def pair_join_sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = networks.pair_join(fixtures.hourly_series(spark, sf_dir))
    return joined.withColumn("time", time_text(F.col("time")))


def network_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    qc = networks.pair_qc(fixtures.weekly_series(spark, sf_dir), min_std=MIN_STD)
    return networks.number_networks(qc)


def network_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _rows(spark, sf_dir)
    return rows.select("network_id", "pair_id", time_text(F.col("time")).alias("time"), "idx", "streamflow_y")


def time_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = networks.row_slice(_staged(spark, sf_dir), 50, 120)
    return rows.select("network_id", "idx", time_text(F.col("time")).alias("time"), "streamflow_x")


def preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = networks.preview(_staged(spark, sf_dir), 101)
    return rows.select("network_id", "idx", "streamflow_x", "streamflow_y")


def network_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.network_means(_networks(spark, sf_dir))


def correlations(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, train = _train(spark, sf_dir)
    out = metrics.correlations(train, [*FLOWS, "n_obs_y"], "streamflow_y")
    return out.withColumn("correlation", r6("correlation"))


def summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.summary(_networks(spark, sf_dir))


# --- splits ----------------------------------------------------------------------------------


def split_networks(spark: SparkSession, sf_dir: str) -> DataFrame:
    qc = networks.pair_qc(fixtures.weekly_series(spark, sf_dir))
    return split.split_networks(networks.number_networks(qc), random_test=False)


def split_networks_disjoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    qc = networks.pair_qc(fixtures.weekly_series(spark, sf_dir))
    return split.split_networks(networks.number_networks(qc), disjoint=True)


def split_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.split_time(_networks(spark, sf_dir), LONG)


# --- scaling ---------------------------------------------------------------------------------


def _train(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The networks, and those of the training set."""
    series = _series(spark, sf_dir)
    numbers = materialize(networks.number_networks(networks.pair_qc(series, min_std=MIN_STD)))
    joined = stage(networks.build_networks(series, numbers))
    flags = split.split_networks(numbers, random_test=False)
    last = flags.where("in_train").agg(F.max("network_id").alias("n")).select("n").scalar()
    return joined, joined.where(F.col("network_id") <= last)


def fit_scaler(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, train = _train(spark, sf_dir)
    out = scale.fit_scaler(train.withColumn("constant", F.lit(5.0)), [*FLOWS, "streamflow_y", "constant"])
    return out.select("feature", r6("mean").alias("mean"), r6("scale").alias("scale"))


def scale_transform(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined, train = _train(spark, sf_dir)
    out = scale.transform(joined, scale.fit_wide(train, FLOWS), FLOWS)
    return out.select("network_id", time_text(F.col("time")).alias("time"), *[r6(f).alias(f) for f in FLOWS])


def scale_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined, train = _train(spark, sf_dir)
    state = scale.widen(scale.fit_scaler(train, FLOWS), FLOWS)
    out = scale.inverse(scale.transform(joined, state, FLOWS), state, FLOWS)
    return out.select("network_id", time_text(F.col("time")).alias("time"), *[r6(f).alias(f) for f in FLOWS])


# --- windows ---------------------------------------------------------------------------------


def _window_digest(samples: DataFrame) -> DataFrame:
    column = lambda k: F.transform("x", lambda row: row[k])
    total = lambda k: F.aggregate(column(k), F.lit(0.0), lambda a, v: a + v)
    return samples.select(
        "network_id",
        "start_idx",
        total(0).alias("sum_flow"),
        total(1).alias("sum_rain"),
        F.element_at(column(0), -1).alias("last_flow"),
        F.size("x").cast("bigint").alias("steps"),
        "y",
    )


def windows_next_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _rows(spark, sf_dir)
    return _window_digest(windows.sample_windows(rows, ["streamflow_x", "rain_x"], "streamflow_y", SHORT, 1))


def windows_same_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _rows(spark, sf_dir)
    return _window_digest(windows.sample_windows(rows, ["streamflow_x", "rain_x"], "streamflow_y", SHORT, 0))


def window_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = windows.window_features(_rows(spark, sf_dir), ["streamflow_x"], "streamflow_y", LONG, 1, lags=[2, 5])
    return out.withColumn("streamflow_x_mean", r6("streamflow_x_mean"))


def batch_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _batched(spark, sf_dir).select("network_id", "start_idx", "batch_id")


# --- scores ----------------------------------------------------------------------------------


def _forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    return training.persistence(_rows(spark, sf_dir), LONG)


def _batched(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = _staged(spark, sf_dir)
    forecast = training.persistence(networks.with_position(joined), LONG)
    return windows.assign_batches(forecast, BATCH, windows.sample_counts(joined, LONG))


def nse(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = metrics.nse(_forecast(spark, sf_dir), ["network_id"], digits=None)
    return out.withColumn("nse", r6("nse"))


def nse_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = windows.previous(_rows(spark, sf_dir), "streamflow_y", "m").withColumnRenamed("streamflow_y", "o")
    out = metrics.nse_slice(rows, 30, 150, LONG, digits=None)
    return out.withColumn("nse", r6("nse"))


def batch_mse(spark: SparkSession, sf_dir: str) -> DataFrame:
    pred = _batched(spark, sf_dir).withColumn("run_id", F.lit("persistence"))
    return metrics.mse(pred, ["run_id"]).withColumn("mse", r6("mse"))


def rmse(spark: SparkSession, sf_dir: str) -> DataFrame:
    pred = _forecast(spark, sf_dir).withColumn("batch_id", F.floor(F.col("start_idx") / 64))
    return metrics.rmse(pred, ["network_id"]).withColumn("rmse", r6("rmse"))


def epoch_nse(spark: SparkSession, sf_dir: str) -> DataFrame:
    pred = _batched(spark, sf_dir).withColumn("run_id", F.lit("persistence"))
    return metrics.epoch_nse(pred, ["run_id"]).withColumn("nse", r6("nse"))


def evaluate_persistence(spark: SparkSession, sf_dir: str) -> DataFrame:
    pred = _forecast(spark, sf_dir).withColumn("batch_id", F.floor(F.col("start_idx") / 64))
    out = metrics.evaluate(pred.withColumn("run_id", F.lit("persistence")), ["run_id", "network_id"])
    return out.withColumns({"loss": r6("loss"), "nse": r6("nse")})


def fit_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Linear model of upstream on the last downstream flow, both scaled: fitted on the training networks, scored on the others."""
    p = _prepared(spark, sf_dir)
    features = ["streamflow_x_last"]
    table = windows.window_features(training.scaled(p), ["streamflow_x"], "streamflow_y", LONG, 1)
    table = stage(split.in_sets(table, p.flags, LONG))
    fitted = model.fit_flow(table.where(F.col("split") == "train"), features)
    held = table.where(F.col("split") != "train")
    pred = model.predict_flow(fitted, held, features).withColumnRenamed("y", "o")
    state = p.scaler_out.select(F.struct(*[F.col("state").getField(p.target).alias(c) for c in ("o", "m")]).alias("state"))
    out = metrics.nse(scale.inverse(pred, state, ["o", "m"]), ["split", "network_id"], digits=None)
    return out.withColumn("nse", F.round("nse", 4) + F.lit(0.0))


# --- evaluation by set -----------------------------------------------------------------------


def _prepared(spark: SparkSession, sf_dir: str) -> training.Prepared:
    return training.prepare(_series(spark, sf_dir), FLOWS, min_std=MIN_STD)


SMALL_BATCH = 64


def _evaluated(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _prepared(spark, sf_dir)
    predicted = training.persistence(training.scaled(p), LONG)
    return training.evaluate_sets(p, predicted, LONG, SMALL_BATCH, "persistence")


def evaluate_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scaled loss and NSE in flow units, per run, epoch and set."""
    return _evaluated(spark, sf_dir).withColumns({"loss": r6("loss"), "nse": r6("nse")})


def history_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.history(_evaluated(spark, sf_dir)).withColumn("value", r6("value"))


def batch_ids_by_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _prepared(spark, sf_dir)
    placed = stage(split.in_sets(training.persistence(p.rows, LONG), p.flags, LONG))
    out = windows.assign_batches(placed, SMALL_BATCH, by=["split"], start="set_idx")
    return out.select("split", "network_id", "set_idx", "batch_id")


def windows_in_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows that lie in the networks and in the span of time of each set."""
    p = _prepared(spark, sf_dir)
    bounds = split.split_time(p.rows, SHORT)
    out = split.in_sets(training.persistence(p.rows, SHORT), p.flags, SHORT, bounds)
    return out.select("split", "network_id", "start_idx", "set_idx", "o", "m")


def inverse_by_network(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scaled by the training networks, turned back by each network's own training span."""
    p = _prepared(spark, sf_dir)
    own = scale.fit_by_network(split.in_time_set(p.rows, split.split_time(p.rows, SHORT), "train"), p.target)
    out = scale.inverse_by_network(training.scaled(p), own, [p.target], spread=["idx"])
    return out.select("network_id", "idx", r6(p.target).alias(p.target))


def _weighed(x: np.ndarray) -> np.ndarray:
    """A fixed linear model: half the mean downstream flow of the window and a quarter of its last rain."""
    return 0.5 * x[:, :, 0].mean(axis=1) + 0.25 * x[:, -1, 1]


LONGEST = 128


def score_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = model.score_blocks(_rows(spark, sf_dir), ["streamflow_x", "rain_x"], LONGEST, _weighed)
    return out.withColumn("m", r6("m"))


STORED = 1024


def _stored_samples(spark: SparkSession, sf_dir: str, horizon: int) -> DataFrame:
    """Samples of daily networks at the full window length: written as blocks, read back, cut and scored."""
    joined = stage(networks.build_networks(stage(fixtures.daily_series(spark, sf_dir))))
    path = _folder(spark, "samples")
    features, target = ["streamflow_x", "rain_x"], "streamflow_y"
    samples.write_samples(networks.with_position(joined), features, target, STORED, path)
    out = samples.score_samples(samples.read_samples(spark, path), features, target, STORED, _weighed, horizon)
    return out.withColumn("m", r6("m"))


def samples_next_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stored_samples(spark, sf_dir, 1)


def samples_same_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stored_samples(spark, sf_dir, 0)


def score_same_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Block scores beside the target of the window's last row."""
    rows = _rows(spark, sf_dir)
    out = model.score_blocks(rows, ["streamflow_x", "rain_x"], LONGEST, _weighed, target="streamflow_y", horizon=0)
    return out.withColumn("m", r6("m"))


def window_features_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means over long windows, with missing values among the rows."""
    gone = F.pmod("idx", F.lit(37)) == 5
    rows = _rows(spark, sf_dir).withColumn("streamflow_x", F.when(~gone, F.col("streamflow_x")))
    out = windows.window_features(rows, ["streamflow_x"], "streamflow_y", LONGEST, 1, lags=[3])
    return out.withColumn("streamflow_x_mean", r6("streamflow_x_mean"))


# --- tables written and read back ------------------------------------------------------------


def _folder(spark: SparkSession, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Appended in two forms, one with an unused column and without rain; read as one table."""
    weekly = fixtures.weekly_series(spark, sf_dir).withColumnRenamed("time", io.INDEX_COLUMN)
    early = F.col(io.INDEX_COLUMN) < F.lit("1995-01-01").cast("timestamp_ntz")
    path = _folder(spark, "series")
    io.write_series(weekly.where(early).drop("rain").withColumn(io.UNUSED_FORCING, F.lit(1.0)), path)
    io.write_series(weekly.where(~early), path)
    out = io.read_series(spark, path)
    return out.select("site", time_text(F.col("time")).alias("time"), "streamflow", "rain")


def stored_series_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    weekly = fixtures.weekly_series(spark, sf_dir)
    path = _folder(spark, "csv")
    io.write_series(weekly, path, fmt="csv")
    out = io.read_series(spark, path, "csv", weekly.schema)
    return out.select("site", "pair_id", "du", time_text(F.col("time")).alias("time"), "streamflow", "rain", "n_obs")


def series_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days written twice stay one; a span of days is read back."""
    path = _folder(spark, "days")
    weekly = fixtures.weekly_series(spark, sf_dir)
    io.write_series(weekly.withColumn("streamflow", F.lit(0.0)), path, by="day")
    io.write_series(weekly, path, by="day")
    out = io.read_series(spark, path, start="1996-01-01", end="1998-06-30")
    return out.select("site", time_text(F.col("time")).alias("time"), "streamflow")


def _site_csv(spark: SparkSession, sf_dir: str) -> str:
    path = f"{_folder(spark, 'sites')}.csv"
    located = fixtures.site_list(spark, sf_dir).withColumns(
        {"x": F.col("pos") / 8, "y": -F.col("pos") / 4}
    )
    ordered = located.repartitionByRange(4, "pos").sortWithinPartitions("pos")
    ordered.select("catchment_id", "du", "x", "y", "comid").write.option("header", True).csv(path)
    return path


def stored_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The site list as CSV, numbered in file order."""
    return io.read_sites(spark, _site_csv(spark, sf_dir)).select("pos", "catchment_id", "du", "x", "y", "comid")


def first_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first seven places of the list, by their position in the file."""
    return io.read_sites(spark, _site_csv(spark, sf_dir), limit=7).select("pos", "catchment_id")


def stored_pair_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pair map of one line per order, in several files: its ids in the order written."""
    path = _folder(spark, "pairs")
    o = fixtures.table(spark, sf_dir, "orders")
    lines = o.select("o_orderkey", F.format_string('{"%d": %d}', "o_orderkey", "o_custkey").alias("value"))
    lines.repartitionByRange(4, "o_orderkey").sortWithinPartitions("o_orderkey").select("value").write.text(path)
    return io.pair_map_ids(io.read_pair_map(spark, path, lines=True)).select("pos", "feature_id")


def stored_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The summary file of all histories, read back."""
    path = _folder(spark, "summary")
    io.write_summary(metrics.last_n(_history(spark, sf_dir)), path)
    back = spark.read.schema("Metric string, Values string, Average double").option("header", True).csv(path)
    return back.select(F.col("Metric").alias("metric"), F.col("Values").alias("values"), r6("Average").alias("average"))


def stored_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A CSV per downstream catchment, read back as one table with the rows' places."""
    path = _folder(spark, "attributes")
    files = fixtures.customer_attributes(spark, sf_dir)
    ordered = files.repartition("ds_catid").sortWithinPartitions("ds_catid", "divide_id")
    ordered.write.partitionBy("ds_catid").option("header", True).csv(path)
    schema = files.drop("ds_catid").schema
    out = io.read_attributes(spark, path, schema, "part-*.csv")
    return out.withColumn("ds_catid", F.col("ds_catid").cast("bigint"))


def stored_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return io.read_points(spark, _site_csv(spark, sf_dir))


def stored_polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rings with holes written and read; the points of all orders that lie in one."""
    path = _folder(spark, "polygons")
    fixtures.parted_catchments(spark, sf_dir).write.parquet(path)
    rings = io.read_polygons(spark, path, holes=True)
    found = spatial.locate_points(fixtures.order_points(spark, sf_dir), rings, "divide_id", 10.0, spread=["point_id"])
    return found.select("point_id", "divide_id")


def flow_by_feature(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _folder(spark, "flow")
    io.write_flow(_lines(spark, sf_dir), path)
    out = io.read_flow(spark, path)
    return out.select(time_text(F.col("time")).alias("time"), "feature_id", "streamflow", "gage_id")


def flow_by_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids in batches of ten: the store of the batches, read back."""
    path = _folder(spark, "batches")
    ids = fixtures.site_list(spark, sf_dir).select("pos", F.col("comid").alias("feature_id"))
    io.write_flow(_lines(spark, sf_dir), path, "batch", sites.id_batches(ids).select("feature_id", "batch_start"))
    out = spark.read.parquet(path)
    return out.select(F.col("batch_start").cast("bigint").alias("batch_start"), time_text(F.col("time")).alias("time"), "feature_id", "streamflow", "gage_id")


def flow_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _folder(spark, "cache")
    io.write_cache(_lines(spark, sf_dir), path)
    out = io.read_flow(spark, path)
    return out.select(time_text(F.col("time")).alias("time"), "feature_id", F.col("streamflow").cast("double").alias("streamflow"), "gage_id")


def chosen_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Named columns dropped, then the listed model inputs in their order."""
    kept = networks.drop_features(_networks(spark, sf_dir), ["n_obs_x", "n_obs_y"])
    inputs = networks.feature_columns(kept, ids=["site"])
    out = networks.select_features(kept, inputs)
    return out.withColumns({"time": time_text(F.col("time")), "inputs": F.lit(",".join(inputs))})


def _ingested(spark: SparkSession, sf_dir: str) -> tuple[ingest.Inputs, DataFrame, str]:
    """What the assembly takes, with months as time steps, the forcing grid as a stored table, and where to write."""
    site = fixtures.site_list(spark, sf_dir)
    forcing = _folder(spark, "forcing")
    fixtures.forcing_grid(spark, sf_dir).write.parquet(forcing)
    attributes = sites.attribute_key(site).select(
        "ds_catid", F.col("catchment_id").alias("divide_id"), (F.col("pos") * 0.5).alias("slope_mean")
    )
    weights = materialize(spatial.cell_weights(_grid_catchments(spark, sf_dir)))
    flow = fixtures.monthly_flow(fixtures.table(spark, sf_dir, "lineitem"))
    return ingest.Inputs(site, weights, attributes, forcing, fixtures.VARIABLES), flow, _folder(spark, "out")


def _assembled_days(spark: SparkSession, path: str) -> DataFrame:
    out = io.read_series(spark, path)
    return out.select(time_text(F.col("time")).alias("time"), "comid", "du", "pair_id", *[r6(v).alias(v) for v in fixtures.VARIABLES], "streamflow", "slope_mean")


def days_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All time steps assembled as one job, and once more over them."""
    given, flow, path = _ingested(spark, sf_dir)
    for run in ("first", "again"):
        ingest.run_days(spark, given, flow, "seq", path, f"{path}-log", run)
    return _assembled_days(spark, path)


def run_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log of that run: how many places and steps were done or in error, by day."""
    given, flow, path = _ingested(spark, sf_dir)
    ingest.run_days(spark, given, flow, "seq", path, f"{path}-log", "only")
    log = spark.read.parquet(f"{path}-log").where(F.col("day").isNotNull())
    return log.groupBy(F.date_format("day", "yyyy-MM-dd").alias("day"), "event").agg(F.count(F.lit(1)).alias("n"), F.sum("rows").alias("steps"))


def run_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Start and end of that run: its days, and whether the seconds told are those between the two."""
    given, flow, path = _ingested(spark, sf_dir)
    ingest.run_days(spark, given, flow, "seq", path, f"{path}-log", "only")
    of = lambda event, c: F.max(F.when(F.col("event") == event, F.col(c)))
    whole = spark.read.parquet(f"{path}-log").groupBy("run").agg(
        F.count_distinct("day").alias("days"),
        of("started", "logged_at").alias("start"),
        of("finished", "logged_at").alias("end"),
        of("finished", "seconds").alias("seconds"),
    )
    apart = F.col("end").cast("double") - F.col("start").cast("double")
    return whole.select("run", "days", (F.col("seconds") > 0).alias("took_time"), (F.abs(apart - F.col("seconds")) < 0.001).alias("agrees"))


def streamed_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same days as they arrive: every day's records lie in several files, taken two at a time."""
    given, flow, path = _ingested(spark, sf_dir)
    arrived = _folder(spark, "arrived")
    last = assemble.flow_keep_last(flow, "seq").select("time", "feature_id", "streamflow")
    last.repartition(4, "feature_id").write.parquet(arrived)
    ingest.stream_days(spark, given, arrived, path, f"{path}-log", _folder(spark, "check"), files_per_batch=2).awaitTermination()
    return _assembled_days(spark, path)


# --- metric histories ------------------------------------------------------------------------


def _history(spark: SparkSession, sf_dir: str) -> DataFrame:
    weekly = fixtures.weekly_series(spark, sf_dir).select(F.col("site").alias("run_id"), "time", "streamflow")
    numbered = ordering.row_index(
        weekly, ["run_id"], ["time"], F.year("time").cast("bigint"), "epoch"
    )
    return stage(
        numbered.select("run_id", "epoch", F.lit("flow").alias("metric"), F.col("streamflow").alias("value"))
    )


def last_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = metrics.last_n(_history(spark, sf_dir))
    return out.withColumn("average", r6("average"))


def last_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.last_values(_history(spark, sf_dir), 100).drop("metric")


def early_stop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.early_stop(_history(spark, sf_dir), ["run_id"], 5, 3.0, "min").drop("metric")


def early_stop_nse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.early_stop(_history(spark, sf_dir), ["run_id"], 5, 3.0, "max").drop("metric")


# --- sites -----------------------------------------------------------------------------------


def pair_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sites.with_pair_id(fixtures.site_list(spark, sf_dir)).select("pos", "catchment_id", "du", "pair_id")


def attribute_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sites.attribute_key(fixtures.site_list(spark, sf_dir)).select("pos", "catchment_id", "ds_catid")


def id_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sites.id_batches(fixtures.site_list(spark, sf_dir)).select("pos", "comid", "batch_start")


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sites.with_file_index(fixtures.customer_attributes(spark, sf_dir), "divide_id")


def upstream_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sites.upstream_candidates(_files(spark, sf_dir)).select("ds_catid", "ds_idx", "idx", "divide_id")


def select_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sites.select_pairs(_files(spark, sf_dir))


def pair_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sites.pair_list(_files(spark, sf_dir))


def missing_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = fixtures.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("feature_id"))
    held = fixtures.table(spark, sf_dir, "labels").select(F.col("doc_id").alias("feature_id"))
    return sites.missing_ids(wanted, held)


# --- space -----------------------------------------------------------------------------------


def random_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = fixtures.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("point_id"))
    box = spatial.bounds(fixtures.catchments(spark, sf_dir))
    out = sites.located_uniform(ids, "point_id", box)
    return out.select("point_id", r6("x").alias("x"), r6("y").alias("y"))


def points_in_polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = fixtures.order_points(spark, sf_dir)
    inside = spatial.points_in_polygons(points, fixtures.catchments(spark, sf_dir), 10.0, spread=["point_id"])
    return inside.select("point_id")


def locate_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = fixtures.order_points(spark, sf_dir)
    found = spatial.locate_points(
        points, fixtures.catchments(spark, sf_dir), "divide_id", 10.0, spread=["point_id"]
    )
    return found.select("point_id", "divide_id")


def bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.bounds(fixtures.catchments(spark, sf_dir))


def parts_within_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.parts_within_box(fixtures.catchments(spark, sf_dir), 10.0, 10.0, 80.0, 90.0).select("part_id")


def lcc(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = fixtures.table(spark, sf_dir, "customer")
    lonlat = c.select(
        "c_custkey",
        (F.lit(-128.0) + md5_uniform("lon", F.col("c_custkey")) * F.lit(61.0)).alias("lon"),
        (F.lit(24.0) + md5_uniform("lat", F.col("c_custkey")) * F.lit(31.0)).alias("lat"),
    )
    out = spatial.to_lcc(lonlat, "lon", "lat")
    return out.select("c_custkey", F.round("x", 3).alias("x"), F.round("y", 3).alias("y"))


def _grid_catchments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.catchments(spark, sf_dir, float(fixtures.GRID))


def cell_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = spatial.cell_weights(_grid_catchments(spark, sf_dir))
    return out.select("divide_id", "iy", "ix", r9("w").alias("w"))


def cell_weights_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catchments of two parts in opposite directions and a hole."""
    out = spatial.cell_weights(fixtures.parted_catchments(spark, sf_dir, float(fixtures.GRID)))
    return out.select("divide_id", "iy", "ix", r9("w").alias("w"))


def zonal_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    weights = spatial.cell_weights(_grid_catchments(spark, sf_dir))
    out = spatial.zonal_mean(fixtures.forcing_grid(spark, sf_dir), weights, fixtures.VARIABLES)
    return out.select(
        time_text(F.col("time")).alias("time"), "divide_id", *[r6(v).alias(v) for v in fixtures.VARIABLES]
    )


# --- assembly --------------------------------------------------------------------------------


def site_time_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    times = fixtures.monthly_flow(fixtures.table(spark, sf_dir, "lineitem")).select("time")
    grid = assemble.site_time_grid(times, fixtures.site_list(spark, sf_dir))
    return grid.select("comid", "du", time_text(F.col("time")).alias("time"))


def flow_keep_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = assemble.flow_keep_last(fixtures.monthly_flow(fixtures.table(spark, sf_dir, "lineitem")), "seq")
    return out.withColumn("time", time_text(F.col("time")))


def keep_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = fixtures.table(spark, sf_dir, "events")
    hourly = e.select(
        "user_id", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("time"), "event_type", "value", "event_id"
    )
    out = assemble.keep_last(hourly, ["user_id", "time"], "event_id")
    return out.withColumn("time", time_text(F.col("time")))


def _assembled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each pair stands twice in the list. Attributes of the second are only there for a high balance, polygons for a positive one."""
    site = fixtures.paired_sites(spark, sf_dir)
    balance = fixtures.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("comid"), "s_acctbal")
    least = F.when(F.col("pos") < fixtures.SECOND_LIST, -500).otherwise(1000)
    attributes = sites.attribute_key(sites.with_pair_id(site)).join(balance, "comid").where(F.col("s_acctbal") > least)
    polygons = _grid_catchments(spark, sf_dir).join(balance, F.col("part_id") == F.col("comid"))
    return assembly.assemble_all(
        site,
        fixtures.forcing_grid(spark, sf_dir),
        spatial.cell_weights(polygons.where(F.col("s_acctbal") > 0)),
        fixtures.monthly_flow(fixtures.table(spark, sf_dir, "lineitem")),
        attributes.select(
            "ds_catid", F.col("catchment_id").alias("divide_id"), F.col("s_acctbal").alias("slope_mean")
        ),
        fixtures.VARIABLES,
        order="seq",
    )


def build_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = assemble.split_errors(_assembled(spark, sf_dir))
    return rows.select(
        time_text(F.col("time")).alias("time"),
        "comid",
        "catid",
        "du",
        "pair_id",
        *[r6(v).alias(v) for v in fixtures.VARIABLES],
        "streamflow",
        "slope_mean",
    )


def site_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    errors = assemble.site_errors(_assembled(spark, sf_dir))
    return errors.withColumn("day", F.date_format("day", "yyyy-MM-dd"))


# --- sources ---------------------------------------------------------------------------------


def union_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = fixtures.table(spark, sf_dir, "events")
    views = e.where(F.col("event_type") == "view").select("event_id", "user_id", "value")
    others = e.where(F.col("event_type") != "view").select("event_id", "event_type", "value")
    return io.stack([views, others])


def day_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = fixtures.table(spark, sf_dir, "events")
    out = io.day_keys(e.select(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("time")))
    return out.select(F.date_format("day", "yyyy-MM-dd").alias("day"), "key")


def pair_map_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order's JSON object names its customer and its place; its first key comes again with another value."""
    o = fixtures.table(spark, sf_dir, "orders")
    far = F.col("o_orderkey") + 1_000_000_000
    text = F.format_string(
        '{"%d": %d, "%d": %d, "%d": %d}', far, F.col("o_custkey"), F.col("o_orderkey"), F.col("o_custkey"), far, F.col("o_custkey") + 7
    )
    pairs = io.parse_pair_map(o.select("o_orderkey", text.alias("value")))
    return io.pair_map_ids(pairs)


def _wanted(spark: SparkSession, sf_dir: str) -> DataFrame:
    rich = fixtures.table(spark, sf_dir, "supplier").where(F.col("s_acctbal") > 0)
    return rich.select(F.col("s_suppkey").alias("feature_id"))


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.table(spark, sf_dir, "lineitem").select(
        F.col("l_shipdate").cast("timestamp_ntz").alias("time"),
        F.col("l_suppkey").alias("feature_id"),
        F.col("l_quantity").alias("streamflow"),
        F.col("l_orderkey").alias("gage_id"),
    )


def select_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = io.select_flow(_lines(spark, sf_dir), _wanted(spark, sf_dir), "1999-01-01", "2000-12-31")
    return out.withColumn("time", time_text(F.col("time")))


def select_stored_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from a store clustered by feature: folders without a wanted id are not opened."""
    path = _folder(spark, "flow")
    io.write_flow(_lines(spark, sf_dir), path)
    out = io.select_flow(io.read_flow(spark, path, grouped=True), _wanted(spark, sf_dir), "1999-01-01", "2000-12-31")
    return out.withColumn("time", time_text(F.col("time")))


def flow_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per batch of ten ids in list order: what the batch's store holds."""
    ids = fixtures.site_list(spark, sf_dir).select("pos", F.col("comid").alias("feature_id"))
    flow = io.narrowed(_lines(spark, sf_dir).drop("gage_id"))
    batches = materialize(sites.id_batches(ids))
    stored = lookup(flow, batches, ["feature_id"], spread=["time"])
    return stored.groupBy("batch_start").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_distinct("feature_id").alias("n_ids"),
        F.sum(F.col("streamflow").cast("double")).alias("total"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        pair_qc,
        pair_qc_gap,
        pair_join,
        pair_join_sparse,
        network_ids,
        network_rows,
        time_slice,
        preview,
        network_means,
        correlations,
        summary,
        split_networks,
        split_networks_disjoint,
        split_time,
        fit_scaler,
        scale_transform,
        scale_roundtrip,
        windows_next_step,
        windows_same_step,
        window_features,
        batch_ids,
        nse,
        nse_slice,
        batch_mse,
        rmse,
        epoch_nse,
        evaluate_persistence,
        fit_flow,
        evaluate_split,
        history_rows,
        batch_ids_by_set,
        windows_in_span,
        inverse_by_network,
        score_windows,
        score_same_step,
        samples_next_step,
        samples_same_step,
        window_features_long,
        stored_series,
        stored_series_csv,
        series_by_day,
        stored_sites,
        first_sites,
        stored_pair_map,
        stored_summary,
        stored_attributes,
        stored_points,
        stored_polygons,
        flow_by_feature,
        flow_by_batch,
        flow_cache,
        chosen_features,
        days_run,
        run_events,
        run_span,
        streamed_days,
        last_n,
        last_values,
        early_stop,
        early_stop_nse,
        pair_ids,
        attribute_key,
        id_batches,
        upstream_candidates,
        select_pairs,
        pair_list,
        missing_ids,
        random_points,
        points_in_polygons,
        locate_points,
        bounds,
        parts_within_box,
        lcc,
        cell_weights,
        cell_weights_parts,
        zonal_mean,
        site_time_grid,
        flow_keep_last,
        keep_last,
        build_series,
        site_errors,
        union_series,
        day_keys,
        pair_map_ids,
        select_flow,
        select_stored_flow,
        flow_batches,
    )
}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Persistence skill per network: check, pair, number, window, score."""
    scores = training.persistence_scores(_series(spark, sf_dir), SHORT)
    return scores.withColumn("nse", r6("nse"))
