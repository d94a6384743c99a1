"""The example tables seen as river data: what the registered queries run on.

Each function derives one input table of the package from the driver's tables, over all rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairflow.functions.expr import md5_uniform
from pairflow.operators.joins import lookup
from pairflow.session import materialize

# Corner offsets of the shapes that stand for catchments, by kind.
# All in eighths, so that areas and weighted sums of the straight ones are exact.
TRIANGLE = [(0.0, 0.0), (2.125, 4.75), (5.0, 1.25), (0.0, 0.0)]
SQUARE = [(0.0, 0.0), (0.0, 3.75), (4.125, 3.75), (4.125, 0.0), (0.0, 0.0)]
CORNER = [(0.0, 0.0), (0.0, 4.25), (1.25, 4.25), (1.25, 2.875), (3.75, 2.875), (3.75, 0.0), (0.0, 0.0)]

GRID = 20
VARIABLES = ["rain", "wind"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pair_columns(site: str) -> list[Column]:
    return [
        F.floor(F.col(site) / 2).cast("bigint").alias("pair_id"),
        F.when(F.pmod(F.col(site), F.lit(2)) == 0, "d").otherwise("u").alias("du"),
    ]


def weekly_series(spark: SparkSession, sf_dir: str, nulls: bool = False) -> DataFrame:
    """Suppliers as sites, weeks as time, shipped quantity as flow; even sites are downstream."""
    week = F.trunc(F.to_date("l_shipdate"), "week").cast("timestamp_ntz")
    flow = F.sum("l_quantity")
    sums = (
        table(spark, sf_dir, "lineitem")
        .groupBy(F.col("l_suppkey").alias("site"), week.alias("time"))
        .agg(
            flow.alias("streamflow"),
            F.sum("l_linenumber").cast("double").alias("rain"),
            F.count(F.lit(1)).alias("n_obs"),
        )
    )
    if nulls:
        hole = (F.pmod(F.col("site"), F.lit(20)) == 4) & (F.weekofyear("time") == 10)
        sums = sums.withColumn("streamflow", F.when(~hole, F.col("streamflow")))
    return sums.select("site", *_pair_columns("site"), "time", "streamflow", "rain", "n_obs")


def daily_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five suppliers together as a site, days as time: networks of more than a thousand rows."""
    site = F.floor(F.col("l_suppkey") / 5).cast("bigint")
    sums = (
        table(spark, sf_dir, "lineitem")
        .groupBy(site.alias("site"), F.to_date("l_shipdate").cast("timestamp_ntz").alias("time"))
        .agg(F.sum("l_quantity").alias("streamflow"), F.sum("l_linenumber").cast("double").alias("rain"))
    )
    return sums.select("site", *_pair_columns("site"), "time", "streamflow", "rain")


def hourly_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users as sites, hours as time: sparse pairs that share few hours."""
    hour = F.date_trunc("hour", "ts").cast("timestamp_ntz")
    return (
        table(spark, sf_dir, "events")
        .groupBy(F.col("user_id").alias("site"), hour.alias("time"))
        .agg(F.max_by("value", "event_id").alias("streamflow"))
        .select("site", *_pair_columns("site"), "time", "streamflow")
    )


def site_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers in key order: even rows downstream, odd rows upstream."""
    s = table(spark, sf_dir, "supplier")
    return s.select(
        F.col("s_suppkey").alias("pos"),
        F.concat(F.lit("cat-"), F.col("s_suppkey").cast("string")).alias("catchment_id"),
        F.when(F.pmod("s_suppkey", F.lit(2)) == 0, "d").otherwise("u").alias("du"),
        F.col("s_suppkey").alias("comid"),
    )


def customer_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file per nation and segment that lists its customers; the downstream one has the least balance."""
    c = table(spark, sf_dir, "customer")
    keys = ["c_nationkey", "c_mktsegment"]
    down = c.groupBy(*keys).agg(F.min_by("c_custkey", F.struct("c_acctbal", "c_custkey")).alias("ds_catid"))
    return lookup(c, materialize(down), keys, spread=["c_custkey"]).select(
        "ds_catid",
        F.col("c_custkey").alias("divide_id"),
        F.col("c_acctbal").alias("X"),
        (F.col("c_acctbal") / 2).alias("Y"),
    )


def _ring(x: Column, y: Column, corners: list[tuple[float, float]]) -> Column:
    return F.array(*[F.struct((x + dx).alias("x"), (y + dy).alias("y")) for dx, dy in corners])


def catchments(spark: SparkSession, sf_dir: str, size: float = 100.0) -> DataFrame:
    """A shape per supplier at a place fixed by its key: triangles, squares and corners in turn."""
    s = table(spark, sf_dir, "supplier")
    x = F.floor(md5_uniform("px", F.col("s_suppkey")) * F.lit(8 * (size - 5.0))) / 8
    y = F.floor(md5_uniform("py", F.col("s_suppkey")) * F.lit(8 * (size - 5.0))) / 8
    kind = F.pmod("s_suppkey", F.lit(3))
    ring = (
        F.when(kind == 0, _ring(F.col("x"), F.col("y"), TRIANGLE))
        .when(kind == 1, _ring(F.col("x"), F.col("y"), SQUARE))
        .otherwise(_ring(F.col("x"), F.col("y"), CORNER))
    )
    return s.select("s_suppkey", x.alias("x"), y.alias("y")).select(
        F.col("s_suppkey").alias("part_id"),
        F.concat(F.lit("cat-"), F.col("s_suppkey").cast("string")).alias("divide_id"),
        ring.alias("ring"),
    )


# Rectangles (dx, dy, width, height, reversed, hole) that make up one catchment of several rings.
RECTANGLES = [(0.0, 0.0, 4.0, 3.0, False, False), (4.5, 0.5, 0.5, 2.25, True, False), (1.0, 1.0, 1.5, 0.875, False, True)]


def parted_catchments(spark: SparkSession, sf_dir: str, size: float = 100.0) -> DataFrame:
    """Two parts of opposite direction and a hole per supplier, a row each."""
    placed = catchments(spark, sf_dir, size).select("divide_id", F.col("ring")[0]["x"].alias("x"), F.col("ring")[0]["y"].alias("y"))

    def rectangle(dx: float, dy: float, w: float, h: float, back: bool, hole: bool) -> Column:
        corners = [(dx, dy), (dx, dy + h), (dx + w, dy + h), (dx + w, dy), (dx, dy)]
        return F.struct(_ring(F.col("x"), F.col("y"), corners[::-1] if back else corners).alias("ring"), F.lit(hole).alias("hole"))

    rows = placed.select("divide_id", F.explode(F.array(*[rectangle(*r) for r in RECTANGLES])).alias("r"))
    return rows.select("divide_id", "r.ring", "r.hole")


SECOND_LIST = 1_000_000_000
"""Position at which each pair stands once more, the other way round."""


def paired_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The site list with every pair listed a second time with its sides changed."""
    s = site_list(spark, sf_dir)
    even = F.pmod("pos", F.lit(2)) == 0
    again = s.select(
        (F.lit(SECOND_LIST) + F.col("pos") + F.when(even, 1).otherwise(-1)).cast("bigint").alias("pos"),
        "catchment_id",
        F.when(even, "u").otherwise("d").alias("du"),
        "comid",
    )
    return s.unionByName(again)


def order_points(spark: SparkSession, sf_dir: str, size: float = 100.0) -> DataFrame:
    """A uniform point per order, fixed by its key."""
    o = table(spark, sf_dir, "orders")
    at = lambda axis: md5_uniform(axis, F.col("o_orderkey")) * F.lit(size)
    return o.select(F.col("o_orderkey").alias("point_id"), at("x").alias("x"), at("y").alias("y"))


def _month(date: str) -> Column:
    return F.trunc(F.to_date(date), "month").cast("timestamp_ntz")


def forcing_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly grid of part and supplier residues; quantity as rain, discount as wind."""
    cell = lambda c: F.pmod(c, F.lit(GRID)).cast("int")
    return (
        table(spark, sf_dir, "lineitem")
        .groupBy(
            _month("l_shipdate").alias("time"), cell("l_suppkey").alias("iy"), cell("l_partkey").alias("ix")
        )
        .agg(
            F.sum("l_quantity").alias("rain"),
            F.sum(F.round(F.col("l_discount") * 100).cast("bigint")).cast("double").alias("wind"),
        )
    )


def monthly_flow(lines: DataFrame) -> DataFrame:
    """Flow records per month and supplier, one per shipped line; ``seq`` is the reading order."""
    return lines.select(
        _month("l_shipdate").alias("time"),
        F.col("l_suppkey").alias("feature_id"),
        F.col("l_quantity").alias("streamflow"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"),
    )
