"""Run the assembly over days: all listed days as one job, or new days as they arrive."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pairflow import schemas
from pairflow.operators import assemble
from pairflow.plans import assembly
from pairflow.session import Staging, ensure_checkpoint_dir, materialize
from pairflow.sources import io


@dataclass
class Inputs:
    """The tables that do not change from day to day, and where the forcing grid lies."""

    sites: DataFrame
    weights: DataFrame
    attributes: DataFrame
    forcing_path: str
    variables: list[str]


_GOOD = "n_no_flow = 0 AND n_no_attributes = 0"


def _good_days(places: DataFrame) -> list[str]:
    """Folder names of the days on which some place did not fail."""
    return _day_names(places.where(_GOOD).select(F.col("day").alias("time")))


def run_name(day: dt.date) -> str:
    return f"experiment_{day.isoformat()}"


def run_log(
    spark: SparkSession,
    run: str,
    places: DataFrame,
    started: dt.datetime,
    ended: dt.datetime,
) -> DataFrame:
    """Log of a run: start and end with the elapsed seconds, and done or error per site and day (``assemble.place_days``)."""
    whole = spark.createDataFrame(
        [("started", None, started), ("finished", (ended - started).total_seconds(), ended)],
        "event string, seconds double, logged_at timestamp",
    )
    done = places.where(_GOOD).groupBy("day", "comid", "catid").agg(
        F.lit("done").alias("event"), F.sum("n").alias("rows")
    )
    failed = places.where(f"NOT ({_GOOD})").select(
        "day",
        "comid",
        "catid",
        F.lit("error").alias("event"),
        F.greatest("n_no_flow", "n_no_attributes").alias("rows"),
    )
    log = io.stack([whole, done, failed]).withColumn("run", F.lit(run))
    log = log.withColumn("logged_at", F.coalesce("logged_at", F.lit(ended)))
    return log.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schemas.RUN_LOG.fields])


def _assembled(inputs: Inputs, forcing: DataFrame, flow: DataFrame, order: str, times: DataFrame | None, staged: Staging) -> DataFrame:
    return assembly.assemble_series(
        assembly.described(inputs.sites),
        forcing,
        inputs.weights,
        assemble.flow_keep_last(flow, order),
        inputs.attributes,
        inputs.variables,
        times,
        staged=staged,
    )


def _day_names(df: DataFrame) -> list[str]:
    """Folder names of the days that a frame with ``time`` holds: one per calendar day."""
    return sorted(r["k"] for r in df.select(io.clean_key(io.day_key(F.col("time"))).alias("k")).distinct().collect())


def run_days(
    spark: SparkSession,
    inputs: Inputs,
    flow: DataFrame,
    order: str,
    out_path: str,
    log_path: str,
    run: str,
    start: str | None = None,
    end: str | None = None,
) -> None:
    """Assemble all days from ``start`` to ``end`` in one job; a day written before is replaced.

    A day of which no row is good any more is emptied. ``flow`` has ``time, feature_id,
    streamflow`` and the reading ``order`` column.
    """
    started = dt.datetime.now()
    forcing = io.select_forcing(spark.read.parquet(inputs.forcing_path), inputs.variables, start, end)
    wanted = inputs.sites.select(F.col("comid").alias("feature_id"))
    selected = io.select_flow(flow, wanted, start, end, order=order)
    # Read by the row writer and the log: computed once.
    with Staging(spark) as staged:
        series = staged(_assembled(inputs, forcing, selected, order, None, staged))
        places = materialize(assemble.place_days(series))
        io.replace_days(assemble.split_errors(series)[0], out_path, _day_names(forcing), _good_days(places))
        run_log(spark, run, places, started, dt.datetime.now()).write.mode("append").parquet(log_path)


LANDED = "time timestamp_ntz, feature_id bigint, streamflow double, source string, ingest_batch bigint, day_key string"


def landed_days(landing: str, days: list[str]) -> list[str]:
    """Folders that hold all records of the given days (folder names)."""
    return [f"{landing}/{io.DAY_FOLDER}={d}" for d in days]


def _ingest(inputs: Inputs, out_path: str, log_path: str, run: str, landing: str) -> Callable[[DataFrame, int], None]:
    def batch(flow: DataFrame, batch_id: int) -> None:
        spark = flow.sparkSession
        started = dt.datetime.now()
        wanted = inputs.sites.select(F.col("comid").alias("feature_id"))
        # All steps that arrived, also those of which no listed feature did.
        steps = flow.select("time", F.lit(None).cast("bigint").alias("feature_id"), F.lit(None).cast("double").alias("streamflow"), "source")
        arrived = io.select_flow(flow, wanted, order="source").unionByName(steps.distinct())
        days = _day_names(flow)
        if not days:
            return
        # A folder per day and in it one per batch, so a batch run again after a failure replaces its own records.
        placed = arrived.withColumns({io.DAY_FOLDER: io.clean_key(io.day_key(F.col("time"))), "ingest_batch": F.lit(batch_id).cast("bigint")})
        writer = placed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        writer.partitionBy(io.DAY_FOLDER, "ingest_batch").parquet(landing)
        # The days that got something are made anew from all that ever came for them; no other folder is listed.
        landed = spark.read.schema(LANDED).option("basePath", landing).parquet(*landed_days(landing, days))
        with Staging(spark) as staged:
            times = staged(landed.select("time").distinct())
            records = landed.where(F.col("feature_id").isNotNull()).select("time", "feature_id", "streamflow", "source")
            first, last = times.agg(F.min("time"), F.max("time")).first()
            store = spark.read.parquet(inputs.forcing_path)
            span = io.select_forcing(store, inputs.variables, first.date().isoformat(), last.date().isoformat())
            forcing = span.join(times, "time", "left_semi")
            series = staged(_assembled(inputs, forcing, records, "source", times, staged))
            places = materialize(assemble.place_days(series))
            io.replace_days(assemble.split_errors(series)[0], out_path, days, _good_days(places))
            log = run_log(spark, f"{run}-{batch_id}", places, started, dt.datetime.now())
            log.write.mode("overwrite").parquet(f"{log_path}/ingest_batch={batch_id}")

    return batch


def stream_days(
    spark: SparkSession,
    inputs: Inputs,
    flow_path: str,
    out_path: str,
    log_path: str,
    checkpoint: str,
    run: str = "stream",
    files_per_batch: int | None = None,
    landing: str | None = None,
) -> StreamingQuery:
    """Assemble the flow files not seen before and stop; call again when more have arrived.

    The stream's checkpoint remembers which files are done. Records are kept in ``landing`` by
    batch and day (by default next to ``out_path``); a day is assembled anew from all of its
    records whenever some arrive, and replaces what it held. So the table is the same however
    the files are cut into batches: per (time, feature) the record of the file last in name order
    counts, and a place of the list fails for a day if any step of the day fails.
    """
    reader = spark.readStream.schema(schemas.FLOW)
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    flow = reader.parquet(flow_path).select("*", F.col("_metadata.file_path").alias("source"))
    landing = landing or f"{out_path.rstrip('/')}-landing"
    ensure_checkpoint_dir(spark)
    return (
        flow.writeStream.foreachBatch(_ingest(inputs, out_path, log_path, run, landing))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
