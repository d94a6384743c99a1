"""From a pair map to the stored flow of the listed reaches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pairflow.operators import sites
from pairflow.sources import io


def extract_flow(
    spark: SparkSession, pair_map: str, flow_path: str, start: str, end: str
) -> tuple[DataFrame, DataFrame]:
    """``(flow, ids)``: flow of every listed reach in the span of days, and the list with its places.

    Ids and span limit the scan, and only time, id and streamflow are read.
    """
    ids = io.pair_map_ids(io.read_pair_map(spark, pair_map))
    return io.select_flow(io.read_flow(spark, flow_path, grouped=True), ids, start, end), ids


def absent_ids(ids: DataFrame, flow: DataFrame) -> DataFrame:
    """Listed reaches without any flow."""
    return sites.missing_ids(ids, flow)


def batches(ids: DataFrame, size: int = 10) -> DataFrame:
    """``(feature_id, batch_start)`` for ``io.write_flow(by='batch')``; an id listed twice is in each of its batches."""
    return sites.id_batches(ids, size).select("feature_id", "batch_start").distinct()
