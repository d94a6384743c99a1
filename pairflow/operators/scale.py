"""Standardize by population mean and deviation, as fitted over the training networks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairflow.functions.expr import named, ratio
from pairflow.operators.joins import lookup
from pairflow.session import materialize

SENTINEL = -9999.0


def _state(col: Column) -> Column:
    """Mean and scale of a feature; a constant feature keeps scale 1."""
    sd = F.stddev_pop(col)
    return F.struct(F.avg(col).alias("mean"), F.when(sd == 0, F.lit(1.0)).otherwise(sd).alias("scale"))


def _values(features: list[str], sentinel_as_null: bool) -> dict[str, Column]:
    values = {f: named(f).cast("double") for f in features}
    if sentinel_as_null:
        values = {f: F.nullif(v, F.lit(SENTINEL)) for f, v in values.items()}
    return values


def fit_wide(df: DataFrame, features: list[str], sentinel_as_null: bool = False) -> DataFrame:
    """One row with a struct of ``feature -> (mean, scale)``, from one pass over the data."""
    values = _values(features, sentinel_as_null)
    return df.agg(*[_state(v).alias(f) for f, v in values.items()]).select(
        F.struct(*[named(f) for f in features]).alias("state")
    )


def fit_scaler(df: DataFrame, features: list[str], sentinel_as_null: bool = False) -> DataFrame:
    """``scaler(feature, mean, scale)``, one row per feature.

    The filled-in value for absent forcings takes part unless ``sentinel_as_null``.
    """
    wide = fit_wide(df, features, sentinel_as_null)
    one = lambda f: F.struct(
        F.lit(f).alias("feature"),
        F.col("state").getField(f).getField("mean").alias("mean"),
        F.col("state").getField(f).getField("scale").alias("scale"),
    )
    return wide.select(F.explode(F.array(*[one(f) for f in features])).alias("s")).select("s.*")


def widen(scaler: DataFrame, features: list[str]) -> DataFrame:
    """A ``scaler`` table back to the one-row form; it has one row per feature."""
    pick = lambda f: F.struct(
        F.max(F.when(F.col("feature") == f, F.col("mean"))).alias("mean"),
        F.max(F.when(F.col("feature") == f, F.col("scale"))).alias("scale"),
    )
    return scaler.agg(*[pick(f).alias(f) for f in features]).select(
        F.struct(*[named(f) for f in features]).alias("state")
    )


def _apply(df: DataFrame, state: DataFrame, features: list[str], formula) -> DataFrame:
    # One scalar subquery as a column of its own: fitted once, a constant in the tasks, no join.
    part = lambda f, name: F.col("__state").getField(f).getField(name)
    return (
        df.withColumn("__state", state.select("state").scalar())
        .withColumns({f: formula(named(f), part(f, "mean"), part(f, "scale")) for f in features})
        .drop("__state")
    )


def transform(df: DataFrame, state: DataFrame, features: list[str]) -> DataFrame:
    """``(value - mean) / scale`` in place of each feature; ``state`` is the one-row form."""
    return _apply(df, state, features, lambda v, mean, scale: ratio(v - mean, scale))


def fit_by_network(rows: DataFrame, feature: str) -> DataFrame:
    """``(network_id, mean, scale)`` of one feature over each network's own rows (e.g. its training span)."""
    state = rows.groupBy("network_id").agg(_state(named(feature).cast("double")).alias("s"))
    return state.select("network_id", "s.mean", "s.scale")


def inverse_by_network(df: DataFrame, states: DataFrame, features: list[str], spread: list[str] | None = None) -> DataFrame:
    """``value * scale + mean`` with the state of the row's own network; one not fitted gives NULL."""
    table = materialize(states.select("network_id", F.col("mean").alias("__mean"), F.col("scale").alias("__scale")))
    joined = lookup(df, table, ["network_id"], "left", spread=spread)
    return joined.withColumns({f: named(f) * F.col("__scale") + F.col("__mean") for f in features}).drop("__mean", "__scale")


def inverse(df: DataFrame, state: DataFrame, features: list[str]) -> DataFrame:
    """``value * scale + mean``, undoing ``transform``."""
    return _apply(df, state, features, lambda v, mean, scale: v * scale + mean)
