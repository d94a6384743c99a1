"""Assemble the table of time, site, forcings, flow and attributes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pairflow.functions.expr import named
from pairflow.operators.joins import lookup
from pairflow.session import materialize

MISSING_FORCING = -9999.0

SITE_COLUMNS = ["comid", "catid", "du", "pair_id"]


PART_SITES = 256
"""Sites of one part of the list, on average."""


def site_time_grid(times: DataFrame, sites: DataFrame, part_sites: int = PART_SITES) -> DataFrame:
    """Every site at every time step.

    Made by an equi-join on (part, month): sites are listed under the months that have steps, the
    steps of a month (at most 31 days of them) under each part. So the work is spread over months
    times parts, and no side has to be broadcast. The steps, one row each, are worked out once. There are as many
    parts as ``part_sites`` goes into the list, which is counted: give a stored one.
    """
    parts = max(1, -(-sites.count() // part_sites))
    steps = materialize(times.select("time").distinct())
    months = steps.groupBy(F.trunc(F.to_date("time"), "month").alias("__month")).agg(F.collect_list("time").alias("__times"))
    names = steps.agg(F.collect_set(F.trunc(F.to_date("time"), "month")).alias("m")).select("m").scalar()
    listed = sites.withColumn("__part", F.pmod(F.xxhash64(*sites.columns), F.lit(parts)).cast("int")).withColumn("__month", F.explode(names))
    by_part = months.withColumn("__part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    joined = listed.join(by_part, ["__part", "__month"]).withColumn("time", F.explode("__times"))
    return joined.drop("__month", "__times", "__part")


def flow_keep_last(
    flow: DataFrame, order: str, time: str = "time", feature: str = "feature_id", value: str = "streamflow"
) -> DataFrame:
    """One flow value per (time, feature): the one read last. ``order`` is the reading order."""
    return flow.groupBy(time, feature).agg(F.max_by(named(value), named(order)).alias(value))


def keep_last(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row per ``keys``, the last by ``order``."""
    rest = [c for c in df.columns if c not in keys]
    return (
        df.groupBy(*keys)
        .agg(F.max_by(F.struct(*[named(c) for c in rest]), named(order)).alias("__row"))
        .select(*keys, *[F.col("__row").getField(c).alias(c) for c in rest])
    )


def build_series(
    grid: DataFrame,
    zonal: DataFrame,
    flow: DataFrame,
    attributes: DataFrame,
    variables: list[str],
    catchments: DataFrame | None = None,
    polygon_id: str = "divide_id",
    places: DataFrame | None = None,
) -> DataFrame:
    """The assembled rows, with ``has_flow`` and ``has_attributes`` telling whether the lookups hit.

    ``grid`` has ``time, comid, catid, du, pair_id, ds_catid``; ``zonal`` has ``time``, the
    polygon id and the variables; ``flow`` has one value per (time, feature_id). A missing
    forcing becomes -9999; with ``catchments`` (ids of known polygons) only that of a
    catchment without polygon does, as NaN of a known one would stay missing.

    With ``places`` (``place, catid, comid``, also a column of ``grid``) forcing and flow are first brought to the
    places of the list by that small table, so that all three meet on (place, time) and the grid, by
    far the largest, is shuffled once. Without it they meet on catchment and on reach.
    """
    known = None
    zonal = zonal.withColumnRenamed(polygon_id, "catid")
    q = flow.select("time", F.col("feature_id").alias("comid"), "streamflow", F.lit(True).alias("has_flow"))
    on_zonal, on_flow = ["time", "catid"], ["time", "comid"]
    if places is not None:
        on_zonal = on_flow = ["place", "time"]
        zonal = lookup(zonal, places.select("catid", "place"), ["catid"], spread=["time"]).drop("catid")
        q = lookup(q, places.select("comid", "place"), ["comid"], spread=["time"]).drop("comid")
    forced = grid.join(zonal, on_zonal, "left")
    if catchments is not None:
        known = materialize(
            catchments.select(F.col(polygon_id).alias("catid")).distinct().withColumn("__known", F.lit(True))
        )
    fill = lambda v: (
        F.coalesce(named(v), F.lit(MISSING_FORCING))
        if known is None
        else F.when(F.col("__known").isNull(), F.lit(MISSING_FORCING)).otherwise(named(v))
    )
    with_flow = forced.join(q, on_flow, "left")
    if known is not None:
        with_flow = lookup(with_flow, known, ["catid"], "left", spread=["time"])
    with_flow = with_flow.withColumns({v: fill(v) for v in variables})

    names = [c for c in attributes.columns if c not in ("ds_catid", "divide_id", "idx")]
    table = materialize(
        attributes.select(
            "ds_catid",
            F.col("divide_id").alias("catid"),
            *[named(c) for c in names],
            F.lit(True).alias("has_attributes"),
        )
    )
    out = lookup(with_flow, table, ["ds_catid", "catid"], "left", spread=["time"])
    flag = lambda c: F.coalesce(c, F.lit(False)).alias(c)
    return out.select(
        "time",
        *SITE_COLUMNS,
        *variables,
        "streamflow",
        *[named(c) for c in names],
        flag("has_flow"),
        flag("has_attributes"),
    )


def place_days(series: DataFrame) -> DataFrame:
    """``(day, pair_id, du, comid, catid, n, n_no_flow, n_no_attributes)``: steps of each place and day, and those that failed."""
    return series.groupBy(F.to_date("time").alias("day"), "pair_id", "du", "comid", "catid").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(~F.col("has_flow")).alias("n_no_flow"),
        F.count_if(~F.col("has_attributes")).alias("n_no_attributes"),
    )


def site_errors(series: DataFrame) -> DataFrame:
    """Places of the list with a failed lookup on a day, with the number of steps that failed.

    ``(day, pair_id, du, comid, catid, n_no_flow, n_no_attributes)``: a reach may stand in several
    pairs and fail in one of them.
    """
    return place_days(series).where((F.col("n_no_flow") > 0) | (F.col("n_no_attributes") > 0)).drop("n")


def split_errors(series: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(rows, errors)``: a place of the list that fails on a day is logged and left out for that day.

    One pass: a day of one place is a few steps, over which the failure is taken as a window
    maximum. Windows keep null keys together, so a failed row without ``comid`` is found too.
    """
    place = Window.partitionBy(F.to_date("time"), "pair_id", "du", "comid", "catid")
    failed = F.max(~F.col("has_flow") | ~F.col("has_attributes")).over(place)
    kept = [c for c in series.columns if c not in ("has_flow", "has_attributes")]
    rows = series.withColumn("__failed", failed).where(~F.col("__failed"))
    return rows.select(*[named(c) for c in kept]), site_errors(series)
