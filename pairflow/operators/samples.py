"""A store of learning samples for long windows: rows once per block, samples as places in them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairflow.functions.expr import named
from pairflow.operators import ordering


def pack_samples(
    positioned: DataFrame, features: list[str], target: str, length: int, width: int | None = None
) -> DataFrame:
    """``(network_id, block, first_idx, ahead, n_rows, rows)``: consecutive rows of a network, a column per array.

    ``rows`` is a struct of arrays, one for each feature and the target, so that a reader takes the columns
    it needs. A block holds ``width`` positions (by default the larger of 4096 and eight windows) and the
    ``length`` rows ahead of them, ``ahead`` in number (none in a network's first block), so it can be read by
    itself; the store is 1 + length / width times as large as the rows, where arrays of samples are ``length``
    times as large. All rows are kept, so shorter windows are read from the same store; missing values stay missing.
    """
    columns = list(dict.fromkeys([*features, target]))
    plain = [f"__c{i}" for i in range(len(columns))]
    rows = positioned.select("network_id", "idx", *[named(c).cast("double").alias(p) for c, p in zip(columns, plain)])
    blocks = ordering.overlapping_blocks(rows, "idx", length, width)
    ordered = F.array_sort(F.collect_list(F.struct("idx", *plain)))
    packed = blocks.groupBy("network_id", "block").agg(
        F.min("idx").alias("first_idx"),
        F.count_if("borrowed").alias("ahead"),
        F.count(F.lit(1)).alias("n_rows"),
        ordered.alias("__rows"),
    )
    arrays = [F.col("__rows").getField(p).alias(c) for c, p in zip(columns, plain)]
    return packed.where(F.col("n_rows") > F.col("ahead")).select(
        "network_id", "block", "first_idx", "ahead", "n_rows", F.struct(*arrays).alias("rows")
    )


def write_samples(
    positioned: DataFrame, features: list[str], target: str, length: int, path: str, width: int | None = None
) -> None:
    """Store the samples of windows of up to ``length`` rows (see ``pack_samples``), replacing what was there."""
    packed = pack_samples(positioned, features, target, length, width)
    packed.sortWithinPartitions("network_id", "block").write.mode("overwrite").parquet(path)


def read_samples(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def sample_places(store: DataFrame, length: int) -> DataFrame:
    """``(network_id, block, offset, start_idx)``: where the window of each sample begins, without its values.

    A network of T rows has T - length samples, as ``windows.sample_windows`` makes; give the result to
    ``windows.assign_batches`` for batches in order. A ``length`` beyond the stored one is an error.
    """
    first = F.greatest(F.col("ahead"), F.lit(length)) - length
    beyond = (F.col("first_idx") > 0) & (F.col("ahead") < length)
    checked = F.when(beyond, F.raise_error(F.lit("the store was made for shorter windows")).cast("bigint")).otherwise(first)
    last = F.col("n_rows") - length - 1
    return (
        store.where(last >= first)
        .select("network_id", "block", "first_idx", F.explode(F.sequence(checked, last)).alias("offset"))
        .select("network_id", "block", "offset", (F.col("first_idx") + F.col("offset")).alias("start_idx"))
    )


def cut(
    columns: dict[str, np.ndarray], features: list[str], target: str, length: int, horizon: int, first_idx: int, ahead: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(start_idx, x, y)`` of a block's samples; ``x`` (samples, steps, features) is a view over its rows.

    With ``horizon=1`` the target is that of the row after the window, with 0 that of its last row.
    """
    if horizon not in (0, 1):
        raise ValueError("horizon is 1 (next step) or 0 (same step)")
    if first_idx > 0 and ahead < length:
        raise ValueError("the store was made for shorter windows")
    follows = np.arange(max(ahead, length), len(columns[target]))
    if not len(follows):
        return follows, np.zeros((0, length, len(features))), np.zeros(0)
    values = np.stack([columns[f] for f in features], axis=1)
    views = np.lib.stride_tricks.sliding_window_view(values, length, axis=0).transpose(0, 2, 1)
    return first_idx + follows - length, views[follows[0] - length : -1], columns[target][follows - (1 - horizon)]


def score_samples(
    store: DataFrame,
    features: list[str],
    target: str,
    length: int,
    predict: Callable[[np.ndarray], np.ndarray],
    horizon: int = 1,
    batch_size: int = 2048,
) -> DataFrame:
    """``(network_id, start_idx, o, m)``: the target and ``predict(x)`` of every stored sample, without a shuffle.

    ``predict`` takes up to ``batch_size`` samples (samples, steps, features), cut from the blocks where they are
    read; a missing value is NaN there, a missing target is NULL.
    """
    needed = list(dict.fromkeys([*features, target]))
    narrow = store.select(
        "network_id", "first_idx", "ahead", F.struct(*[F.col("rows").getField(c).alias(c) for c in needed]).alias("rows")
    )

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            stored = {c: b.column("rows").field(c) for c in needed}
            for i in range(b.num_rows):
                columns = {c: stored[c][i].values.to_numpy(zero_copy_only=False) for c in needed}
                block = b.column("first_idx")[i].as_py(), b.column("ahead")[i].as_py()
                start, x, y = cut(columns, features, target, length, horizon, *block)
                for k in range(0, len(start), batch_size):
                    m = np.asarray(predict(x[k : k + batch_size]), float).reshape(-1)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([b.column("network_id")[i].as_py()] * len(m), b.schema.field("network_id").type),
                            pa.array(start[k : k + batch_size], pa.int64()),
                            pa.array(y[k : k + batch_size], pa.float64(), from_pandas=True),
                            pa.array(m, pa.float64()),
                        ],
                        ["network_id", "start_idx", "o", "m"],
                    )

    number = T.DoubleType()
    schema = T.StructType(
        [store.schema["network_id"], T.StructField("start_idx", T.LongType()), T.StructField("o", number), T.StructField("m", number)]
    )
    return narrow.mapInArrow(score, schema)
