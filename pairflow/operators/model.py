"""Learn and predict upstream flow from samples, spread over the cluster."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.base import Estimator, Model
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairflow.operators import ordering


def score_windows(
    samples: DataFrame,
    predict: Callable[[np.ndarray], np.ndarray],
    x: str = "x",
    output: str = "m",
) -> DataFrame:
    """Add ``predict(x)`` to every sample, batch by batch in Arrow.

    ``predict`` takes (batch, steps, features) and gives one number per sample. It is sent
    to the executors with the task; the window arrays are not part of the result.
    """
    kept = [f for f in samples.schema.fields if f.name != x]
    schema = T.StructType([*kept, T.StructField(output, T.DoubleType())])
    names = [f.name for f in kept]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if n == 0:
                continue
            windows = batch.column(x)
            steps = len(windows[0])
            values = windows.flatten().flatten().to_numpy(zero_copy_only=False)
            scores = np.asarray(predict(values.reshape(n, steps, -1)), dtype=float).reshape(n)
            columns = [batch.column(c) for c in names] + [pa.array(scores)]
            yield pa.RecordBatch.from_arrays(columns, names=[*names, output])

    return samples.mapInArrow(score, schema)


def score_blocks(
    positioned: DataFrame,
    features: list[str],
    length: int,
    predict: Callable[[np.ndarray], np.ndarray],
    output: str = "m",
    width: int | None = None,
    target: str | None = None,
    horizon: int = 1,
) -> DataFrame:
    """``(network_id, start_idx, m)``: ``predict`` on every window of every network, for long windows.

    With a ``target`` the column ``o`` holds it as well: that of the row after the window (``horizon=1``, next
    step) or of the window's last row (``horizon=0``, same step).

    Rows go to the tasks once, in blocks of consecutive positions that borrow the ``length`` rows
    ahead of them; the windows are views over a block and are made where they are scored, a few
    thousand at a time. A window of rows i..i+length-1 has ``start_idx`` i; a network of T rows has
    T - length of them, as for samples. ``predict`` takes (windows, steps, features).
    """
    if horizon not in (0, 1):
        raise ValueError("horizon is 1 (next step) or 0 (same step)")
    plain = [f"__f{i}" for i in range(len(features))]
    wanted = [F.col(f"`{f}`").cast("double").alias(p) for f, p in zip(features, plain)]
    if target is not None:
        wanted.append(F.col(f"`{target}`").cast("double").alias("__o"))
    rows = positioned.select("network_id", "idx", *wanted)
    blocks = ordering.overlapping_blocks(rows, "idx", length, width)

    def score(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("idx")
        values, at, own = block[plain].to_numpy(float), block["idx"].to_numpy(), ~block["borrowed"].to_numpy()
        # A window stands at the row that follows it; that row must be the block's own.
        ends = np.nonzero(own & (np.arange(len(at)) >= length))[0]
        views = np.lib.stride_tricks.sliding_window_view(values, length, axis=0) if len(ends) else None
        step = max(1, 4_000_000 // (length * len(plain)))
        scores = [
            np.asarray(predict(views[ends[i : i + step] - length].transpose(0, 2, 1)), float).reshape(-1)
            for i in range(0, len(ends), step)
        ]
        found = {"network_id": block["network_id"].iloc[0], "start_idx": at[ends] - length}
        if target is not None:
            found["o"] = block["__o"].to_numpy(float)[ends - (1 - horizon)]
        return pd.DataFrame(found | {output: np.concatenate(scores) if scores else np.zeros(0)})

    numbers = [*(["o"] if target is not None else []), output]
    schema = T.StructType(
        [rows.schema["network_id"], T.StructField("start_idx", T.LongType()), *[T.StructField(c, T.DoubleType()) for c in numbers]]
    )
    return blocks.groupBy("network_id", "block").applyInPandas(score, schema)


def _assembled(table: DataFrame, features: list[str]) -> DataFrame:
    # Names may hold dots or '='; the assembler gets plain ones.
    plain = [f"__f{i}" for i in range(len(features))]
    named = table.withColumns({p: F.col(f"`{f}`").cast("double") for p, f in zip(plain, features)})
    return VectorAssembler(inputCols=plain, outputCol="__features", handleInvalid="skip").transform(named).drop(*plain)


def fit_flow(
    train: DataFrame, features: list[str], label: str = "y", estimator: Estimator | None = None
) -> Model:
    """Fit a regressor on window summaries of the training networks (linear by default).

    Pass e.g. a ``GBTRegressor``; feature, label and prediction columns are set here.
    """
    estimator = estimator or LinearRegression(solver="normal", standardization=False)
    estimator = estimator.copy()
    estimator.set(estimator.featuresCol, "__features")
    estimator.set(estimator.labelCol, label)
    estimator.set(estimator.predictionCol, "__prediction")
    return estimator.fit(_assembled(train.where(F.col(label).isNotNull()), features))


def predict_flow(model: Model, table: DataFrame, features: list[str], output: str = "m") -> DataFrame:
    """Add the model's prediction to window summaries."""
    out = model.transform(_assembled(table, features))
    return out.withColumnRenamed("__prediction", output).drop("__features")
