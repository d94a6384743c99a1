"""Scalar expressions shared by the operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SECONDS_PER_DAY = 86_400

# The projection of the forcing grid (a sphere, two standard parallels).
LCC_RADIUS = 6_370_000.0
LCC_PARALLEL_1 = 30.0
LCC_PARALLEL_2 = 60.0
LCC_ORIGIN_LAT = 40.0
LCC_ORIGIN_LON = -97.0


def named(column: str) -> Column:
    """Column by its exact name; attribute names may hold dots or ``=``."""
    return F.col("`" + column.replace("`", "``") + "`")


def is_missing(df: DataFrame, column: str) -> Column:
    """Null, or NaN in a float column: Spark keeps the two apart, the pair check does not."""
    col = named(column)
    if isinstance(df.schema[column].dataType, (T.DoubleType, T.FloatType)):
        return col.isNull() | F.isnan(col)
    return col.isNull()


def any_missing(df: DataFrame, columns: list[str]) -> Column:
    """True when at least one of ``columns`` is missing in the row."""
    return reduce(lambda a, b: a | b, (is_missing(df, c) for c in columns), F.lit(False))


def nan_to_null(col: Column) -> Column:
    return F.when(F.isnan(col), F.lit(None)).otherwise(col)


def ratio(numerator: Column, denominator: Column) -> Column:
    """Division that gives NULL for a zero denominator (ANSI mode would raise)."""
    return numerator / F.nullif(denominator, F.lit(0.0))


def seconds_of(time: Column) -> Column:
    """Seconds since 1970 of a zone-free timestamp; monotone whatever the session zone is."""
    return (
        F.unix_date(time.cast("date")).cast("bigint") * SECONDS_PER_DAY
        + F.hour(time) * 3600
        + F.minute(time) * 60
        + F.second(time)
    )


def time_bucket(time: Column, seconds: int) -> Column:
    """Number of the ``seconds``-long span that ``time`` falls in."""
    if seconds % SECONDS_PER_DAY == 0:
        units, width = F.unix_date(time.cast("date")), seconds // SECONDS_PER_DAY
    else:
        units, width = seconds_of(time), seconds
    return F.floor(units / F.lit(width)).cast("bigint")


def value_bucket(value: Column, width: int) -> Column:
    return F.floor(value / F.lit(width)).cast("bigint")


def time_text(time: Column) -> Column:
    return F.date_format(time, "yyyy-MM-dd HH:mm:ss")


def day_key(time: Column) -> Column:
    """Key of a day's files, ``yyyy/yyyyMMdd*``."""
    return F.concat(F.date_format(time, "yyyy/yyyyMMdd"), F.lit("*"))


def clean_key(key: Column) -> Column:
    """A day key without ``/`` and ``*``, fit for a file or partition name."""
    return F.regexp_replace(key, "[/*]", "")


def md5_uniform(seed: str, key: Column) -> Column:
    """Number in [0, 1) that depends only on seed and key, the same in every engine and run."""
    text = F.concat(F.lit(seed + "-"), key.cast("string"))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)


def lambert(lon: Column, lat: Column) -> tuple[Column, Column]:
    """Lambert conformal conic x, y in metres on a sphere (closed form: Snyder, USGS PP 1395, ch. 15)."""
    import math

    rad = math.radians
    p1, p2 = rad(LCC_PARALLEL_1), rad(LCC_PARALLEL_2)
    half = lambda phi: math.tan(math.pi / 4 + phi / 2)
    n = math.log(math.cos(p1) / math.cos(p2)) / math.log(half(p2) / half(p1))
    scale = LCC_RADIUS * math.cos(p1) * half(p1) ** n / n
    rho0 = scale / half(rad(LCC_ORIGIN_LAT)) ** n

    rho = F.lit(scale) / F.pow(F.tan(F.lit(math.pi / 4) + F.radians(lat) / F.lit(2.0)), F.lit(n))
    theta = F.lit(n) * F.radians(lon - F.lit(LCC_ORIGIN_LON))
    return rho * F.sin(theta), F.lit(rho0) - rho * F.cos(theta)
