"""Site lists: pair numbers, attribute keys, upstream candidates, random points."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairflow.functions.expr import md5_uniform, value_bucket
from pairflow.operators import ordering


def with_pair_id(sites: DataFrame) -> DataFrame:
    """Rows 2k and 2k+1 of the list are pair k; the list order is the stored ``pos``."""
    return sites.withColumn("pair_id", F.floor(F.col("pos") / 2).cast("bigint"))


def attribute_key(sites: DataFrame) -> DataFrame:
    """Add ``ds_catid``, the catchment whose attribute file describes the site.

    A downstream site's own id, otherwise the id of the row above; found by an equi-join on the
    position, so the list is never sorted in one task. A first row without a row above gets NULL.
    """
    above = sites.select((F.col("pos") + 1).alias("pos"), F.col("catchment_id").alias("__above"))
    return (
        sites.join(above, "pos", "left")
        .withColumn("ds_catid", F.when(F.col("du") == "d", F.col("catchment_id")).otherwise(F.col("__above")))
        .drop("__above")
    )


def id_batches(ids: DataFrame, size: int = 10) -> DataFrame:
    """Add ``batch_start``: ids in list order, ``size`` to a batch, named by its first position."""
    return ids.withColumn("batch_start", (F.col("pos") - F.pmod(F.col("pos"), F.lit(size))).cast("bigint"))


def with_file_index(attributes: DataFrame, order: str, width: int = 1000) -> DataFrame:
    """Add ``idx``, a row's place in its attribute file, where only an ordering number is stored."""
    return ordering.row_index(
        attributes, ["ds_catid"], [order], value_bucket(F.col(order), width), "idx"
    )


def upstream_candidates(attributes: DataFrame, before: int = 10, after: int = 9) -> DataFrame:
    """Rows of a file close to its downstream row: offsets -before..+after, itself left out.

    The downstream row is the one whose ``divide_id`` is the file's ``ds_catid``. The few wanted
    positions are listed per file and looked up, so files of any length stay cheap; a position
    outside the file finds no row. A file with one row has no candidate.
    """
    down = attributes.where(F.col("divide_id") == F.col("ds_catid")).select(
        "ds_catid",
        F.col("idx").alias("ds_idx"),
        F.explode(
            F.sequence(F.greatest(F.col("idx") - before, F.lit(0).cast("bigint")), F.col("idx") + after)
        ).alias("idx"),
    )
    return attributes.join(down.where(F.col("idx") != F.col("ds_idx")), ["ds_catid", "idx"]).where(
        F.col("divide_id") != F.col("ds_catid")
    )


def select_pairs(attributes: DataFrame, seed: str = "pair", before: int = 10, after: int = 9) -> DataFrame:
    """One seeded random candidate per downstream catchment: ``(ds_catid, us_catid, us_x, us_y)``.

    The least md5 of (seed, file, id) wins: a plain aggregate, the same pick in every run, and a
    catchment listed in several files is drawn in each of them anew.
    """
    draw = F.md5(F.concat(F.lit(seed + "-"), F.col("ds_catid").cast("string"), F.lit("-"), F.col("divide_id").cast("string")))
    picked = F.struct("divide_id", "X", "Y")
    return (
        upstream_candidates(attributes, before, after)
        .groupBy("ds_catid")
        .agg(F.min_by(picked, draw).alias("p"))
        .select(
            "ds_catid",
            F.col("p.divide_id").alias("us_catid"),
            F.col("p.X").alias("us_x"),
            F.col("p.Y").alias("us_y"),
        )
    )


def pair_list(attributes: DataFrame, seed: str = "pair") -> DataFrame:
    """A site list of alternating d and u rows with ``pos``, from the selected pairs.

    Pairs are in the order of the md5 of their downstream id: an even spread over the buckets
    they are numbered in, whatever the ids look like.
    """
    pairs = select_pairs(attributes, seed)
    down = attributes.where(F.col("divide_id") == F.col("ds_catid")).select(
        "ds_catid", F.col("X").alias("ds_x"), F.col("Y").alias("ds_y")
    )
    both = pairs.join(down, "ds_catid").withColumn("__md5", F.md5(F.col("ds_catid").cast("string")))
    bucket = F.conv(F.substring("__md5", 1, 3), 16, 10).cast("bigint")
    numbered = ordering.row_index(both, [], ["__md5", "ds_catid"], bucket, "__pair")
    side = lambda du, offset, cat, x, y: F.struct(
        (F.col("__pair") * 2 + offset).alias("pos"),
        F.col(cat).cast("string").alias("catchment_id"),
        F.lit(du).alias("du"),
        F.col(x).alias("x"),
        F.col(y).alias("y"),
    )
    return numbered.select(
        F.explode(
            F.array(side("d", 0, "ds_catid", "ds_x", "ds_y"), side("u", 1, "us_catid", "us_x", "us_y"))
        ).alias("s")
    ).select("s.*")


def located_uniform(
    ids: DataFrame, key: str, bounds: DataFrame, seed: str = ""
) -> DataFrame:
    """A point per id, uniform in the one-row box ``bounds(x_min, y_min, x_max, y_max)``; fixed by the id."""
    b = bounds.select(F.struct("x_min", "y_min", "x_max", "y_max").alias("b")).scalar()
    axis = lambda name, low, high: b.getField(low) + md5_uniform(seed + name, F.col(key)) * (
        b.getField(high) - b.getField(low)
    )
    return ids.withColumns({"x": axis("x", "x_min", "x_max"), "y": axis("y", "y_min", "y_max")})


def random_points(
    spark: SparkSession, n: int, x_min: float, y_min: float, x_max: float, y_max: float, seed: int = 0
) -> DataFrame:
    """``n`` uniform points in a box, generated where they are used."""
    along = lambda low, high, s: F.lit(low) + F.rand(s) * F.lit(high - low)
    return spark.range(n).select(
        F.col("id").alias("point_id"),
        along(x_min, x_max, seed).alias("x"),
        along(y_min, y_max, seed + 1).alias("y"),
    )


def missing_ids(ids: DataFrame, flow: DataFrame, id_column: str = "feature_id") -> DataFrame:
    """Wanted ids that the flow table does not hold."""
    present = flow.select(id_column).distinct()
    return ids.select(id_column).distinct().join(present, id_column, "left_anti")
