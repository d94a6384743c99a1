"""From site list, grid, flow and attributes to the assembled table, all days in one job."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairflow.operators import assemble, sites, spatial
from pairflow.operators.joins import lookup
from pairflow.session import materialize, stage


def described(site_list: DataFrame) -> DataFrame:
    """Sites with pair number and attribute key, under the names of the assembled table."""
    keyed = sites.attribute_key(sites.with_pair_id(site_list))
    return keyed.select("comid", F.col("catchment_id").alias("catid"), "du", "pair_id", "ds_catid")


def assemble_series(
    described_sites: DataFrame,
    forcing: DataFrame,
    weights: DataFrame,
    flow: DataFrame,
    attributes: DataFrame,
    variables: list[str],
    times: DataFrame | None = None,
    polygon_id: str = "divide_id",
    staged: Callable[[DataFrame], DataFrame] = stage,
) -> DataFrame:
    """Assembled rows from prepared sites, one flow value per (time, feature_id), and cell weights.

    Weights and attributes are first cut to the listed sites. ``staged`` writes what is read more than once.
    """
    wanted = materialize(described_sites.withColumn("place", F.monotonically_increasing_id()))
    catids = wanted.select(F.col("catid").alias(polygon_id)).distinct()
    used = materialize(weights.join(catids, polygon_id, "left_semi"))
    files = wanted.select("ds_catid", F.col("catid").alias("divide_id")).distinct()
    rows = attributes.join(files, ["ds_catid", "divide_id"], "left_semi")
    zonal = spatial.zonal_mean(forcing, used, variables, polygon_id, staged=staged)
    grid = assemble.site_time_grid(forcing.select("time") if times is None else times, wanted)
    comids = wanted.select(F.col("comid").alias("feature_id")).distinct()
    kept = lookup(flow, comids, ["feature_id"], "left_semi", spread=["time"])
    return assemble.build_series(grid, zonal, kept, rows, variables, used.select(polygon_id), polygon_id, wanted)


def assemble_all(
    site_list: DataFrame,
    forcing: DataFrame,
    weights: DataFrame,
    flow: DataFrame,
    attributes: DataFrame,
    variables: list[str],
    order: str,
) -> DataFrame:
    """The whole table with lookup flags; repeated flow records count by their reading ``order``."""
    last = assemble.flow_keep_last(flow, order)
    return assemble_series(described(site_list), forcing, weights, last, attributes, variables)
