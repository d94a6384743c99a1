"""Positions, running values and look-back windows that no single hot key can block.

A plain ``Window.partitionBy(key)`` puts all rows of a key into one task. Here a key's
rows are cut into buckets along the order; each bucket is handled by itself and the
buckets are tied together by one small row per bucket (count, sum, least, greatest).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_BUCKET = "__bucket"


def _before(keys: list[str], order: list) -> Window:
    return (
        Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    )


def bucket_offsets(df: DataFrame, keys: list[str], bucket: str, value: Column | None = None) -> DataFrame:
    """Per (keys, bucket): ``total`` of ``value`` (row count by default) and the sum of all earlier buckets.

    The window runs over one row per bucket, already summed map-side, not over the data.
    """
    total = F.count(F.lit(1)) if value is None else F.sum(value)
    totals = df.groupBy(*keys, bucket).agg(total.cast("bigint").alias("total"))
    return totals.withColumn(
        "offset", F.coalesce(F.sum("total").over(_before(keys, [bucket])), F.lit(0)).cast("bigint")
    )


def row_index(
    df: DataFrame,
    keys: list[str],
    order: list,
    bucket: Column,
    name: str = "idx",
    first: int | None = None,
    last: int | None = None,
) -> DataFrame:
    """Add the 0-based position of each row within ``keys`` along ``order``.

    ``bucket`` must not fall along ``order``. With ``first``/``last`` only rows at those
    positions (both ends kept) are returned, and buckets wholly outside are not sorted.
    """
    tagged = df.withColumn(_BUCKET, bucket)
    offsets = bucket_offsets(tagged, keys, _BUCKET)
    if last is not None:
        offsets = offsets.where(F.col("offset") <= last)
    if first is not None:
        offsets = offsets.where(F.col("offset") + F.col("total") > first)
    inside = Window.partitionBy(*keys, _BUCKET).orderBy(*order)
    out = tagged.join(offsets.drop("total"), [*keys, _BUCKET]).withColumn(
        name, (F.col("offset") + F.row_number().over(inside) - 1).cast("bigint")
    )
    if last is not None:
        out = out.where(F.col(name) <= last)
    if first is not None:
        out = out.where(F.col(name) >= first)
    return out.drop(_BUCKET, "offset")


def running(
    df: DataFrame,
    keys: list[str],
    order: list,
    bucket: Column,
    value: Column,
    aggregate: Callable[[Column], Column],
    combine: Callable[[Column, Column], Column],
    name: str,
    inclusive: bool = True,
    keep_bucket: bool = False,
) -> DataFrame:
    """Running aggregate of ``value`` along ``order``: inside the bucket, then with what came before it.

    With ``keep_bucket`` the column ``__bucket`` stays: further windows over (keys, bucket) need no new shuffle.
    """
    tagged = df.withColumn(_BUCKET, bucket).withColumn("__value", value)
    carried = (
        tagged.groupBy(*keys, _BUCKET)
        .agg(aggregate(F.col("__value")).alias("__part"))
        .withColumn("__carry", aggregate(F.col("__part")).over(_before(keys, [_BUCKET])))
        .drop("__part")
    )
    inside = (
        Window.partitionBy(*keys, _BUCKET)
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    )
    return (
        tagged.join(carried, [*keys, _BUCKET])
        .withColumn(name, combine(F.col("__carry"), aggregate(F.col("__value")).over(inside)))
        .drop(*([] if keep_bucket else [_BUCKET]), "__value", "__carry")
    )


def overlapping_blocks(df: DataFrame, index: str, before: int, width: int | None = None) -> DataFrame:
    """Cut each key's rows into blocks of ``width`` positions that also hold the ``before`` rows ahead of them.

    Adds ``block`` and ``borrowed``: a borrowed row is a copy that only serves as look-back
    for the block and must not be returned. A frame of up to ``before`` preceding rows,
    partitioned by (keys, block), then equals the same frame over the whole key.
    """
    width = max(4096, 8 * before) if width is None else width
    if width < before:
        raise ValueError("a block must be at least as long as the look-back")
    own = F.floor(F.col(index) / F.lit(width)).cast("bigint")
    needed_next = F.pmod(F.col(index), F.lit(width)) >= width - before
    return (
        df.withColumn("__own", own)
        .withColumn(
            "block",
            F.explode(F.when(needed_next, F.array(F.col("__own"), F.col("__own") + 1)).otherwise(F.array("__own"))),
        )
        .withColumn("borrowed", F.col("block") != F.col("__own"))
        .drop("__own")
    )


def id_range(top: DataFrame, column: str, name: str, step: int = 65_536) -> DataFrame:
    """All whole numbers from 0 to the value in the one-row frame ``top``, spread over the cluster.

    Expanded in two steps, so that no single row ever holds the whole range.
    """
    chunk = (
        top.select(F.col(column).cast("bigint").alias("__top"))
        .where(F.col("__top") >= 0)
        .withColumn("__chunk", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor(F.col("__top") / step))))
        .repartition("__chunk")
    )
    return chunk.select(
        F.explode(
            F.sequence(
                F.col("__chunk") * step,
                F.least(F.col("__top"), F.col("__chunk") * step + step - 1),
            )
        ).alias(name)
    )
