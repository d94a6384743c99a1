"""Train, validation and test sets by network and by time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairflow.functions.expr import md5_uniform
from pairflow.operators.joins import lookup
from pairflow.session import materialize


def _share(n: Column, share: float) -> Column:
    # A double literal: with a decimal one floor(n * 0.7) differs for some n.
    return F.floor(n * F.lit(share)).cast("bigint")


def split_networks(
    numbers: DataFrame,
    train: float = 0.7,
    val: float = 0.2,
    test: float = 0.1,
    random_test: bool = True,
    seed: str = "split",
    disjoint: bool = False,
) -> DataFrame:
    """Add ``in_train, in_val, in_test`` to a frame with ``network_id``.

    Train is 0..floor(.7n) with its end, validation the next floor(.2n), test the last
    floor(.1n); so a network can be in two sets or in none, and these are three flags, not
    one label. With no network left for test, one is drawn (``random_test``). ``disjoint``
    takes a network out of test when it is in another set, and out of validation when in train.
    """
    n = F.coalesce(
        numbers.agg((F.max("network_id") + 1).cast("bigint").alias("n")).select("n").scalar(),
        F.lit(0).cast("bigint"),
    )
    n_train, n_val, n_test = _share(n, train), _share(n, val), _share(n, test)
    i = F.col("network_id")
    in_train = i <= n_train
    in_val = i.between(n_train + 1, n_train + n_val)
    drawn = F.floor(md5_uniform(seed, n) * n)
    in_test = F.when(n_test > 0, i >= n - n_test).otherwise((i == drawn) if random_test else F.lit(False))
    if disjoint:
        in_val = in_val & ~in_train
        in_test = in_test & ~in_train & ~in_val
    return numbers.withColumns({"in_train": in_train, "in_val": in_val, "in_test": in_test})


def split_time(
    networks: DataFrame, gap: int, train: float = 0.7, val: float = 0.2, test: float = 0.1
) -> DataFrame:
    """One row of position bounds ``<set>_start, <set>_end`` (both kept), from the length of network 0.

    Sets are ``gap`` rows apart and the first starts at ``gap``; the last end may lie past
    the series, a slice is clipped there.
    """
    length = networks.where(F.col("network_id") == 0).agg(F.count(F.lit(1)).alias("n"))
    n = F.col("n")
    return (
        length.withColumn("train_start", F.lit(gap).cast("bigint"))
        .withColumn("train_end", _share(n, train))
        .withColumn("val_start", F.col("train_end") + gap)
        .withColumn("val_end", F.col("val_start") + _share(n, val))
        .withColumn("test_start", F.col("val_end") + gap)
        .withColumn("test_end", F.col("test_start") + _share(n, test))
        .drop("n")
    )


SETS = ["train", "val", "test"]


def in_sets(samples: DataFrame, flags: DataFrame, length: int, bounds: DataFrame | None = None) -> DataFrame:
    """The samples of each set: adds ``split`` and ``set_idx``, a sample's number within its network and set.

    ``samples`` has ``network_id, start_idx``; a network in two sets gives its samples to both. With
    ``bounds`` (one row of ``split_time``) a set only sees its span of rows, so a sample must lie in it
    whole, its target step included, just as windows made of the cut-out rows would.
    """
    members = flags.select(
        "network_id",
        F.explode(F.array(*[F.when(F.col(f"in_{s}"), F.lit(s)) for s in SETS])).alias("split"),
    ).where(F.col("split").isNotNull())
    out = lookup(samples, materialize(members), ["network_id"], spread=["start_idx"])
    if bounds is None:
        return out.withColumn("set_idx", F.col("start_idx"))
    at = lambda end: F.element_at(
        F.create_map(*[x for s in SETS for x in (F.lit(s), bounds.select(f"{s}_{end}").scalar())]), F.col("split")
    )
    inside = out.withColumns({"__low": at("start"), "__high": at("end")}).where(
        (F.col("start_idx") >= F.col("__low")) & (F.col("start_idx") + length <= F.col("__high"))
    )
    return inside.withColumn("set_idx", F.col("start_idx") - F.col("__low")).drop("__low", "__high")


def in_time_set(positioned: DataFrame, bounds: DataFrame, name: str) -> DataFrame:
    """Rows whose ``idx`` lies in the named set of ``split_time`` (the bounds are one row)."""
    low = bounds.select(f"{name}_start").scalar()
    high = bounds.select(f"{name}_end").scalar()
    return positioned.where(F.col("idx").between(low, high))
