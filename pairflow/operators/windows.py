"""Learning samples: sliding windows over each network, and their batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairflow.functions.expr import named, value_bucket
from pairflow.operators import ordering
from pairflow.operators.joins import lookup
from pairflow.session import materialize


def over_windows(
    positioned: DataFrame,
    length: int,
    horizon: int,
    values: dict,
    keep: list[str] = (),
    reach: int = 0,
    width: int | None = None,
) -> DataFrame:
    """Evaluate window expressions for every sample of every network.

    A network of T rows gives T - length samples. Each is evaluated at the row that follows its
    window: with ``horizon=1`` the ``keep`` columns come from that row (next step), with
    ``horizon=0`` from the window's last row (same step), which leaves out the last possible
    window. ``values`` maps a name to ``f(over, ordered) -> Column``; ``over`` is the frame of
    the window, ``ordered`` the same without a frame, reaching back at least ``reach`` rows.
    """
    if horizon not in (0, 1):
        raise ValueError("horizon is 1 (next step) or 0 (same step)")
    blocks = ordering.overlapping_blocks(positioned, "idx", max(length, reach), width)
    ordered = Window.partitionBy("network_id", "block").orderBy("idx")
    over = ordered.rowsBetween(-length, -1)
    kept = lambda c: named(c) if horizon else F.lag(named(c), 1).over(ordered).alias(c)
    return (
        blocks.select(
            "network_id",
            (F.col("idx") - length).alias("start_idx"),
            "borrowed",
            *[kept(c) for c in keep],
            *[f(over, ordered).alias(name) for name, f in values.items()],
        )
        .where(~F.col("borrowed") & (F.col("start_idx") >= 0))
        .drop("borrowed")
    )


def sample_windows(
    positioned: DataFrame,
    features: list[str],
    target: str,
    length: int,
    horizon: int = 1,
    width: int | None = None,
) -> DataFrame:
    """``(network_id, start_idx, x ARRAY<ARRAY<DOUBLE>>, y)``, a row of ``x`` per step.

    Each sample repeats ``length`` rows; keep this a last, lazy stage (see ``window_features``).
    """
    row = F.array(*[named(f).cast("double") for f in features])
    out = over_windows(
        positioned.select("network_id", "idx", named(target).alias("y"), row.alias("__row")),
        length,
        horizon,
        {"x": lambda over, _: F.collect_list("__row").over(over)},
        keep=["y"],
        width=width,
    )
    return out.select("network_id", "start_idx", "x", "y")


def window_features(
    positioned: DataFrame,
    features: list[str],
    target: str,
    length: int,
    horizon: int = 1,
    lags: list[int] = (),
    width: int | None = None,
) -> DataFrame:
    """The target ``y`` with summaries of its window: ``<f>_last``, ``<f>_mean``, ``<f>_lag<k>``.

    Lag k is the value k steps before the target's step. A mean is summed anew over its own rows,
    for any length: differences of running sums would be cheaper but let a NaN or a huge value
    reach windows that do not hold it. Memory does not grow with the length.
    """
    shift = 0 if horizon else 1
    values = {}
    for f in features:
        values[f"{f}_last"] = lambda over, ordered, f=f: F.lag(named(f), 1).over(ordered)
        values[f"{f}_mean"] = lambda over, ordered, f=f: F.avg(named(f)).over(over)
        for k in lags:
            values[f"{f}_lag{k}"] = lambda over, ordered, f=f, k=k: F.lag(named(f), k + shift).over(ordered)
    reach = max([0, *lags]) + shift
    needed = list(dict.fromkeys([*features, target]))
    return over_windows(
        positioned.select("network_id", "idx", *[named(c) for c in needed]),
        length,
        horizon,
        values,
        keep=[target],
        reach=reach,
        width=width,
    ).withColumnRenamed(target, "y")


def previous(positioned: DataFrame, column: str, name: str = "previous") -> DataFrame:
    """Add the value one row earlier in the network (the persistence forecast)."""
    blocks = ordering.overlapping_blocks(positioned, "idx", 1)
    ordered = Window.partitionBy("network_id", "block").orderBy("idx")
    return (
        blocks.withColumn(name, F.lag(named(column), 1).over(ordered))
        .where(~F.col("borrowed"))
        .drop("borrowed", "block")
    )


def sample_counts(positioned: DataFrame, length: int) -> DataFrame:
    """``n`` samples per network, without making them."""
    n = F.greatest(F.count(F.lit(1)) - length, F.lit(0).cast("bigint"))
    return positioned.groupBy("network_id").agg(n.alias("n"))


def assign_batches(
    samples: DataFrame,
    batch_size: int,
    counts: DataFrame | None = None,
    width: int = 4096,
    by: list[str] = (),
    start: str = "start_idx",
) -> DataFrame:
    """Add ``batch_id``: samples of all networks in (network, start) order, ``batch_size`` a batch.

    With ``by`` (e.g. ``["split"]``) batches begin anew in each of its values.

    ``start`` runs 0..n-1 in each network (of a set), so a sample's place is the number of samples
    in earlier networks plus its start: counts per network are summed, the samples are not sorted.
    ``counts`` is the result of ``sample_counts``; without it the samples are counted.
    """
    if counts is None:
        counts = samples.groupBy(*by, "network_id").agg(F.count(F.lit(1)).alias("n"))
    offsets = materialize(batch_offsets(materialize(counts), width, by))
    placed = lookup(samples, offsets, [*by, "network_id"], spread=[start])
    return placed.withColumn(
        "batch_id", F.floor((F.col("samples_before") + F.col(start)) / F.lit(batch_size)).cast("bigint")
    ).drop("samples_before")


def batch_offsets(counts: DataFrame, width: int = 4096, by: list[str] = ()) -> DataFrame:
    """``samples_before`` per network from ``n`` per network, summed ``width`` network ids at a time."""
    return ordering.running(
        counts,
        list(by),
        ["network_id"],
        value_bucket(F.col("network_id"), width),
        F.col("n"),
        F.sum,
        lambda carry, local: (F.coalesce(carry, F.lit(0)) + F.coalesce(local, F.lit(0))).cast("bigint"),
        "samples_before",
        inclusive=False,
    ).select(*by, "network_id", "samples_before")
