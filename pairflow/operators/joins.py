"""Lookup joins with a checked broadcast and an exact way for hot keys beyond it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairflow.session import MAX_BROADCAST_BYTES, fits, materialize

HOT_ROWS = 5_000_000
"""Rows of one key above which its rows are spread over several tasks."""

NULL_SALTS = 1024
"""Tasks that rows with a null key are spread over."""


def lookup(
    df: DataFrame,
    table: DataFrame,
    on: list[str],
    how: str = "inner",
    spread: list[str] | None = None,
    condition: Column | None = None,
    max_bytes: int = MAX_BROADCAST_BYTES,
    hot_rows: int = HOT_ROWS,
    extra: Column | None = None,
    small: bool | None = None,
    hint: str | None = None,
) -> DataFrame:
    """Join the large ``df`` with ``table``; ``how`` is inner, left, left_semi or left_anti.

    A table of at most ``max_bytes`` is broadcast, so ``df`` is not shuffled. A larger
    one is joined by shuffle: keys with more than ``hot_rows`` rows in ``df`` are split by a
    salt taken from the ``spread`` columns, and the table's rows for those keys are repeated
    per salt. At most rows/hot_rows keys are hot, which bounds the salt table; it is broadcast
    only if it too fits. Rows with a null key, which match nothing, are spread as well. ``condition``
    may use columns of both sides. Call with a cheap or materialized ``table``: it is counted, unless the
    caller knows whether it is ``small`` enough for a broadcast. ``hint`` is given to the join by shuffle.
    """
    if fits(table, max_bytes, extra) if small is None else small:
        return _join(df, F.broadcast(table), on, how, condition)

    salts = materialize(
        df.groupBy(*on)
        .agg(F.count(F.lit(1)).alias("__n"))
        .where(F.col("__n") > hot_rows)
        .select(*on, F.ceil(F.col("__n") / hot_rows).cast("int").alias("__salts"))
    )
    few = F.broadcast if fits(salts, max_bytes) else (lambda x: x)
    n_salts = F.coalesce(F.col("__salts"), F.lit(1))
    # A row with a null key meets nothing, so it may go anywhere.
    unmatched = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in on])
    by = [F.col(c) for c in (spread or df.columns)]
    left = (
        df.join(few(salts), on, "left")
        .withColumn("__salt", F.pmod(F.xxhash64(*by), F.when(unmatched, F.lit(NULL_SALTS)).otherwise(n_salts)).cast("int"))
        .drop("__salts")
    )
    right = (
        table.join(few(salts), on, "left")
        .withColumn("__salt", F.explode(F.sequence(F.lit(0), n_salts - 1)))
        .drop("__salts")
    )
    right = right.hint(hint) if hint else right
    return _join(left, right, [*on, "__salt"], how, condition).drop("__salt")


def _join(left: DataFrame, right: DataFrame, on: list[str], how: str, condition: Column | None) -> DataFrame:
    if condition is None:
        return left.join(right, on, how)
    keys = [f"__key_{c}" for c in on]
    renamed = right.withColumnsRenamed(dict(zip(on, keys)))
    match = reduce(lambda a, b: a & b, (F.col(c) == F.col(k) for c, k in zip(on, keys)))
    return left.join(renamed, match & condition, how).drop(*keys)
