"""Scores of predictions, reports on networks, and stopping rules over metric histories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairflow.functions.expr import named, nan_to_null, ratio, value_bucket
from pairflow.operators import ordering
from pairflow.operators.joins import lookup
from pairflow.session import materialize

# Fixed value: where the best NSE starts before the first epoch.
NSE_FLOOR = -100_000_000.0

HISTORY_BUCKET = 100_000


def nse_of(observed: Column, modeled: Column, digits: int | None = 2) -> Column:
    """Nash-Sutcliffe efficiency as an aggregate: 1 - sum (o-m)^2 / sum (o - mean o)^2.

    Constant observations give NULL. Rounding is half-even, as numpy rounds.
    """
    pair = F.when(modeled.isNotNull(), observed)
    spread = F.var_pop(pair) * F.count(pair)
    value = F.lit(1.0) - ratio(F.sum(F.pow(observed - modeled, F.lit(2.0))), spread)
    return value if digits is None else F.bround(value, digits)


def mse_of(observed: Column, modeled: Column) -> Column:
    return F.avg(F.pow(observed - modeled, F.lit(2.0)))


def nse(pred: DataFrame, by: list[str], observed: str = "o", modeled: str = "m", digits: int | None = 2) -> DataFrame:
    """NSE per group; partial sums are combined map-side."""
    return pred.groupBy(*by).agg(nse_of(named(observed), named(modeled), digits).alias("nse"))


def nse_slice(
    positioned: DataFrame,
    first: int | Column,
    last: int | Column,
    length: int,
    observed: str = "o",
    modeled: str = "m",
    digits: int | None = 4,
) -> DataFrame:
    """NSE per network over the slice first..last with the mean of the whole slice.

    Errors count only at predicted rows: those from the slice's position ``length - 1`` up to
    its last but one, the rows a same-step window ends at. One pass: the spread around the
    slice mean is n * (var of predicted rows + (their mean - slice mean)^2).
    """
    first = first if isinstance(first, Column) else F.lit(first)
    last = last if isinstance(last, Column) else F.lit(last)
    o, m = named(observed), named(modeled)
    rows = positioned.where(F.col("idx").between(first, last)).withColumn(
        "__used", (F.col("idx") >= first + (length - 1)) & m.isNotNull()
    )
    oo = F.when(F.col("__used"), o)
    sums = rows.groupBy("network_id").agg(
        F.avg(o).alias("mean"),
        F.count(oo).alias("n"),
        F.var_pop(oo).alias("var_used"),
        F.avg(oo).alias("mean_used"),
        F.sum(F.when(F.col("__used"), F.pow(o - m, F.lit(2.0)))).alias("errors"),
        F.max_by(F.struct(o.alias("o"), m.alias("m"), F.col("__used").alias("used")), "idx").alias("end"),
    )
    # No window ends at the last row of the slice; take that row out of the sums again.
    off_mean = F.pow(F.col("mean_used") - F.col("mean"), F.lit(2.0))
    of_end = lambda value: F.when(F.col("end.used"), F.pow(value, F.lit(2.0))).otherwise(0.0)
    n = F.col("n") - F.when(F.col("end.used"), 1).otherwise(0)
    spread = F.col("n") * (F.col("var_used") + off_mean) - of_end(F.col("end.o") - F.col("mean"))
    errors = F.col("errors") - of_end(F.col("end.o") - F.col("end.m"))
    value = F.when(n > 0, F.lit(1.0) - ratio(errors, spread))
    return sums.select("network_id", (value if digits is None else F.bround(value, digits)).alias("nse"))


def mse(pred: DataFrame, by: list[str], batch: str = "batch_id", observed: str = "o", modeled: str = "m") -> DataFrame:
    """Mean over batches of the per-batch MSE."""
    per_batch = pred.groupBy(*by, batch).agg(mse_of(named(observed), named(modeled)).alias("mse"))
    return per_batch.groupBy(*by).agg(F.avg("mse").alias("mse"))


def rmse(pred: DataFrame, by: list[str], batch: str = "batch_id", observed: str = "o", modeled: str = "m") -> DataFrame:
    """Mean over batches of the per-batch root MSE, e.g. per network and epoch."""
    per_batch = pred.groupBy(*by, batch).agg(F.sqrt(mse_of(named(observed), named(modeled))).alias("rmse"))
    return per_batch.groupBy(*by).agg(F.avg("rmse").alias("rmse"))


def epoch_nse(
    pred: DataFrame, by: list[str], batch: str = "batch_id", observed: str = "o", modeled: str = "m", digits: int = 2
) -> DataFrame:
    """Mean over batches of the batch NSEs, each rounded before the mean is taken."""
    per_batch = nse(pred, [*by, batch], observed, modeled, digits)
    return per_batch.groupBy(*by).agg(F.avg("nse").alias("nse"))


def evaluate(
    pred: DataFrame,
    by: list[str] = ("run_id", "epoch", "split"),
    batch: str = "batch_id",
    observed: str = "o",
    modeled: str = "m",
    observed_scaled: str | None = None,
    modeled_scaled: str | None = None,
) -> DataFrame:
    """Loss (mean batch MSE, on scaled values when given) and mean batch NSE per run, epoch and split."""
    lo, lm = observed_scaled or observed, modeled_scaled or modeled
    per_batch = pred.groupBy(*by, batch).agg(
        mse_of(named(lo), named(lm)).alias("loss"),
        nse_of(named(observed), named(modeled)).alias("nse"),
    )
    return per_batch.groupBy(*by).agg(F.avg("loss").alias("loss"), F.avg("nse").alias("nse"))


def history(evaluated: DataFrame, run: str = "run_id", epoch: str = "epoch", split: str = "split") -> DataFrame:
    """``(run_id, epoch, metric, value)`` rows, metrics named ``loss_<split>`` and ``nse_<split>``."""
    entry = lambda name: F.struct(
        F.concat(F.lit(name + "_"), named(split)).alias("metric"), F.col(name).alias("value")
    )
    return evaluated.select(
        named(run).alias("run_id"),
        named(epoch).alias("epoch"),
        F.explode(F.array(entry("loss"), entry("nse"))).alias("e"),
    ).select("run_id", "epoch", "e.*")


def network_means(networks: DataFrame, flow: str = "streamflow", digits: int = 2) -> DataFrame:
    """Mean flow of both sides of each network."""
    return networks.groupBy("network_id").agg(
        F.bround(F.avg(f"{flow}_x"), digits).alias("mean_downstream"),
        F.bround(F.avg(f"{flow}_y"), digits).alias("mean_upstream"),
    )


def correlations(networks: DataFrame, features: list[str], target: str) -> DataFrame:
    """``(feature, correlation)`` of each input with the target, all from one pass."""
    wide = networks.agg(
        F.array(
            *[
                F.struct(F.lit(f).alias("feature"), F.corr(named(f), named(target)).alias("correlation"))
                for f in features
            ]
        ).alias("c")
    )
    return wide.select(F.explode("c").alias("c")).select("c.*")


def summary(networks: DataFrame) -> DataFrame:
    """One row: number of networks, rows in the first and in all, and columns."""
    return networks.agg(
        F.count_distinct("network_id").alias("n_networks"),
        F.count_if(F.col("network_id") == 0).alias("rows_first_network"),
        F.count(F.lit(1)).alias("n_rows"),
        F.lit(len(networks.columns)).cast("bigint").alias("n_columns"),
    )


# Spark cuts each task's rows to the wanted number before the shuffle up to this number.
GROUP_LIMIT = 1000


def last_values(history: DataFrame, n: int, keys: list[str] = ("run_id", "metric")) -> DataFrame:
    """The last ``n`` epochs of each history; a long one is cut down in parts before it meets in one task."""
    newest = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(F.col("epoch").desc()))
    cut = history
    if n > GROUP_LIMIT:
        cut = cut.withColumn("__part", F.pmod(F.xxhash64("epoch"), F.lit(256)))
        cut = cut.withColumn("__rn", newest(*keys, "__part")).where(F.col("__rn") <= n).drop("__part", "__rn")
    return cut.withColumn("__rn", newest(*keys)).where(F.col("__rn") <= n).drop("__rn")


def last_n(history: DataFrame, n: int = 10, keys: list[str] = ("run_id", "metric"), strict: bool = True) -> DataFrame:
    """Last n values as joined text, and their mean. A shorter history is an error (or kept, if not ``strict``)."""
    values = F.array_sort(F.collect_list(F.struct("epoch", "value")))
    out = last_values(history, n, list(keys)).groupBy(*keys).agg(
        F.array_join(F.transform(values, lambda v: v["value"].cast("string")), ", ").alias("values"),
        F.avg("value").alias("average"),
        F.count(F.lit(1)).alias("__n"),
    )
    if strict:
        checked = F.when(F.col("__n") >= n, F.col("average")).otherwise(
            F.raise_error(F.lit(f"a history must have at least {n} values")).cast("double")
        )
        out = out.withColumn("average", checked)
    return out.drop("__n")


def early_stop(
    history: DataFrame,
    keys: list[str] = ("run_id",),
    patience: int = 5,
    min_delta: float = 0.0,
    mode: str = "min",
    value: str = "value",
    epoch: str = "epoch",
    bucket: int = HISTORY_BUCKET,
) -> DataFrame:
    """Add ``counter`` (bad epochs since the best) and ``stop`` (counter has reached ``patience``).

    ``mode='min'``: a value below all earlier ones resets, one above best + delta counts.
    ``mode='max'``: a value at or above all earlier ones resets, one at or below best - delta counts.
    NaN does neither. A history may be long: it is cut into buckets of epochs. One pass over keys,
    epochs and values finds the best of each bucket; a second moves the rows to their buckets, once, and
    stores them with their flags. What is carried from bucket to bucket is a row for each that
    has something before it, so a shuffle of the stored rows is not needed.
    """
    if mode not in ("min", "max"):
        raise ValueError("mode is min or max")
    lowest = mode == "min"
    keys = list(keys)
    span = value_bucket(F.col(epoch), bucket)
    v = F.col("__v")
    scored = ordering.running(
        history.withColumn("__v", nan_to_null(named(value).cast("double"))),
        keys,
        [epoch],
        span,
        v,
        F.min if lowest else F.max,
        F.least if lowest else F.greatest,
        "__best",
        inclusive=False,
        keep_bucket=True,
    )
    if lowest:
        best = F.coalesce("__best", F.lit(float("inf")))
        reset, worse = v < best, v > best + F.lit(min_delta)
    else:
        best = F.greatest("__best", F.lit(NSE_FLOOR))
        reset, worse = v >= best, v <= best - F.lit(min_delta)
    reset = F.coalesce(reset, F.lit(False))
    bad = F.coalesce(worse & ~reset, F.lit(False)).cast("bigint")

    # Within a bucket: bad epochs so far, and how many there were at the last reset.
    inside = Window.partitionBy(*keys, "__bucket").orderBy(epoch).rowsBetween(Window.unboundedPreceding, 0)
    flagged = materialize(
        scored.withColumns({"__reset": reset, "__bad": bad})
        .withColumn("__so_far", F.sum("__bad").over(inside))
        .withColumn("__at_reset", F.max(F.when(F.col("__reset"), F.col("__so_far"))).over(inside))
        .select(*[named(c) for c in history.columns], "__bucket", "__bad", "__so_far", "__at_reset")
    )
    # Across buckets the same over one row each; the count never falls, so the greatest is the last.
    before = Window.partitionBy(*keys).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        flagged.groupBy(*keys, "__bucket")
        .agg(F.sum("__bad").alias("__total"), F.max("__at_reset").alias("__last"))
        .withColumn("__earlier", F.coalesce(F.sum("__total").over(before), F.lit(0)))
        .withColumn("__earlier_reset", F.max(F.col("__earlier") + F.col("__last")).over(before))
        .select(
            *keys,
            "__bucket",
            (F.col("__earlier") - F.coalesce("__earlier_reset", F.lit(0))).alias("__carry"),
        )
        .where(F.col("__carry") > 0)
    )
    counter = F.col("__so_far") - F.coalesce(F.col("__at_reset"), -F.col("__carry"), F.lit(0))
    return (
        lookup(flagged, materialize(carried), [*keys, "__bucket"], "left", spread=[epoch])
        .withColumn("counter", counter.cast("bigint"))
        .withColumn("stop", (F.col("__bad") == 1) & (F.col("counter") >= patience))
        .select(*[named(c) for c in history.columns], "counter", "stop")
    )
