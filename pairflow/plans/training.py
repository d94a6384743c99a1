"""From the assembled table to scored samples."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairflow.operators import metrics, networks, scale, split, windows
from pairflow.session import materialize, stage


@dataclass
class Prepared:
    """Positioned networks, their split flags, and the scaler states fitted on the training set."""

    rows: DataFrame
    flags: DataFrame
    features: list[str]
    target: str
    scaler_in: DataFrame
    scaler_out: DataFrame


def prepare(
    series: DataFrame,
    features: list[str] | None = None,
    target: str = "streamflow_y",
    time_gap: int | None = None,
    **checks,
) -> Prepared:
    """Check, pair, number, split and fit. With ``time_gap`` the scaler sees only the training span of time.

    The joined networks are written once; positions, scaler and samples all read that table.
    """
    numbers = materialize(networks.number_networks(networks.pair_qc(series, **checks)))
    joined = stage(networks.build_networks(series, numbers))
    rows = networks.with_position(joined)
    flags = split.split_networks(numbers)
    features = features or networks.feature_columns(joined, target)
    last_train = flags.where("in_train").agg(F.max("network_id").alias("n")).select("n").scalar()
    train = (joined if time_gap is None else rows).where(F.col("network_id") <= last_train)
    if time_gap is not None:
        train = split.in_time_set(train, split.split_time(joined, time_gap), "train")
    return Prepared(
        rows,
        flags,
        features,
        target,
        scale.fit_wide(train, features),
        scale.fit_wide(train, [target]),
    )


def scaled(p: Prepared) -> DataFrame:
    """The rows with inputs and target standardized."""
    out = scale.transform(p.rows, p.scaler_in, [f for f in p.features if f != p.target])
    return scale.transform(out, p.scaler_out, [p.target])


def samples(p: Prepared, length: int, horizon: int = 1) -> DataFrame:
    return windows.sample_windows(scaled(p), p.features, p.target, length, horizon)


def set_samples(p: Prepared, length: int, horizon: int = 1, bounds: DataFrame | None = None) -> DataFrame:
    """``samples`` of each set: adds ``split`` and ``set_idx``; with ``bounds`` only those inside the set's span of time."""
    return split.in_sets(samples(p, length, horizon), p.flags, length, bounds)


def evaluate_sets(
    p: Prepared,
    predicted: DataFrame,
    length: int,
    batch_size: int,
    run_id: str,
    epoch: int = 0,
    bounds: DataFrame | None = None,
    by_network: DataFrame | None = None,
) -> DataFrame:
    """Loss and NSE per (run, epoch, split) of predictions on scaled values.

    ``predicted`` has ``network_id, start_idx, o, m`` on the scale of ``scaled``, one row per next-step
    sample. The loss is taken on these; for the NSE both are first turned back, by the training
    set's state or, with ``by_network`` (``scale.fit_by_network``), by each network's own. Batches
    begin anew in each set. ``metrics.history`` turns the result into a history.
    """
    flow = predicted.withColumns({"o_scaled": F.col("o"), "m_scaled": F.col("m")})
    if by_network is None:
        state = p.scaler_out.select(F.struct(*[F.col("state").getField(p.target).alias(c) for c in ("o", "m")]).alias("state"))
        flow = scale.inverse(flow, state, ["o", "m"])
    else:
        flow = scale.inverse_by_network(flow, by_network, ["o", "m"], spread=["start_idx"])
    placed = stage(split.in_sets(flow, p.flags, length, bounds))
    batched = windows.assign_batches(placed, batch_size, by=["split"], start="set_idx")
    tagged = batched.withColumns({"run_id": F.lit(run_id), "epoch": F.lit(epoch).cast("bigint")})
    return metrics.evaluate(tagged, ["run_id", "epoch", "split"], observed_scaled="o_scaled", modeled_scaled="m_scaled")


def persistence(positioned: DataFrame, length: int, target: str = "streamflow_y") -> DataFrame:
    """The no-model forecast: what was last seen. One row per next-step sample, ``o`` and ``m``."""
    out = windows.over_windows(
        positioned.select("network_id", "idx", target),
        length,
        1,
        {"m": lambda _, ordered: F.lag(target, 1).over(ordered)},
        keep=[target],
    )
    return out.select("network_id", "start_idx", F.col(target).alias("o"), "m")


def persistence_scores(series: DataFrame, length: int, **checks) -> DataFrame:
    """NSE of the persistence forecast per network."""
    rows = networks.with_position(stage(networks.build_networks(series, **checks)))
    return metrics.nse(persistence(rows, length), ["network_id"], digits=None)
