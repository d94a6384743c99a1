"""Paired streamflow analytics on Spark DataFrames."""

from pairflow.functions import expr, geometry
from pairflow.operators import (
    assemble,
    joins,
    metrics,
    model,
    networks,
    ordering,
    scale,
    sites,
    spatial,
    split,
    windows,
)
from pairflow.sources import io
from pairflow.streaming import ingest

__all__ = [
    "assemble",
    "expr",
    "geometry",
    "ingest",
    "io",
    "joins",
    "metrics",
    "model",
    "networks",
    "ordering",
    "scale",
    "sites",
    "spatial",
    "split",
    "windows",
]
