"""Declared schemas of the input and output tables; wide attribute columns stay dynamic."""

from __future__ import annotations

from pyspark.sql import types as T

_F = T.StructField
POINT = T.StructType([_F("x", T.DoubleType()), _F("y", T.DoubleType())])
RING = T.ArrayType(POINT)

# The forcing variables; the later form of the table also has LQFRAC.
FORCINGS = ["U2D", "V2D", "LWDOWN", "RAINRATE", "T2D", "Q2D", "PSFC", "SWDOWN"]
FORCINGS_LATER = [*FORCINGS, "LQFRAC"]

# The columns of a site list file, in file order, and the table made of it.
SITE_FILE = T.StructType(
    [
        _F("catchment_id", T.StringType()),
        _F("du", T.StringType()),
        _F("x", T.DoubleType()),
        _F("y", T.DoubleType()),
        _F("comid", T.LongType()),
    ]
)
SITES = T.StructType([_F("pos", T.LongType()), *SITE_FILE.fields])

PAIR_MAP = T.MapType(T.StringType(), T.LongType())

FLOW = T.StructType(
    [
        _F("time", T.TimestampNTZType()),
        _F("feature_id", T.LongType()),
        _F("streamflow", T.DoubleType()),
    ]
)

FORCING_KEYS = T.StructType(
    [_F("time", T.TimestampNTZType()), _F("iy", T.IntegerType()), _F("ix", T.IntegerType())]
)


def forcing(variables: list[str] = FORCINGS) -> T.StructType:
    return T.StructType([*FORCING_KEYS.fields, *[_F(v, T.DoubleType()) for v in variables]])


# A row per ring: a polygon has as many rows as parts and holes.
POLYGONS = T.StructType([_F("divide_id", T.StringType()), _F("ring", RING)])
BOUNDARY = T.StructType([_F("part_id", T.LongType()), _F("ring", RING)])
HOLE = _F("hole", T.BooleanType())

SERIES_KEYS = T.StructType(
    [
        _F("time", T.TimestampNTZType()),
        _F("comid", T.LongType()),
        _F("catid", T.StringType()),
        _F("du", T.StringType()),
        _F("pair_id", T.LongType()),
    ]
)


def series(variables: list[str] = FORCINGS, attributes: list[str] = ()) -> T.StructType:
    """The assembled table: keys, forcings, flow, attributes, in that order."""
    names = [*variables, "streamflow", *attributes]
    return T.StructType([*SERIES_KEYS.fields, *[_F(n, T.DoubleType()) for n in names]])


SCALER = T.StructType(
    [_F("feature", T.StringType()), _F("mean", T.DoubleType()), _F("scale", T.DoubleType())]
)

RUN_LOG = T.StructType(
    [
        _F("run", T.StringType()),
        _F("day", T.DateType()),
        _F("event", T.StringType()),
        _F("comid", T.LongType()),
        _F("catid", T.StringType()),
        _F("rows", T.LongType()),
        _F("seconds", T.DoubleType()),
        _F("logged_at", T.TimestampType()),
    ]
)
