"""Session helpers: where lineage is cut, and a check of what may be broadcast."""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_BROADCAST_BYTES = 64 * 1024 * 1024
"""Size up to which a side of a join is broadcast."""


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the folder for checkpoints, as the cluster names it in ``spark.checkpoint.dir``.

    Only a local session without that setting gets a folder of its own; a cluster
    session must name a shared one, since executors can be lost with their disks.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        named = tempfile.mkdtemp(prefix="pairflow-checkpoint-")
    sc.setCheckpointDir(named)
    return sc.getCheckpointDir()


def materialize(df: DataFrame) -> DataFrame:
    """Compute a small shared table once and cut its lineage with a reliable checkpoint."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def row_bytes(schema: T.StructType) -> int:
    """Rough width of a row: 8 bytes a number, 32 a string, 16 an empty array."""

    def width(t: T.DataType) -> int:
        if isinstance(t, T.StructType):
            return 8 + sum(width(f.dataType) for f in t.fields)
        if isinstance(t, (T.StringType, T.BinaryType)):
            return 32
        if isinstance(t, (T.ArrayType, T.MapType)):
            return 16
        return 8

    return width(schema)


def _held(column: Column, kind: T.DataType) -> Column | None:
    """Bytes that a text, binary or array column holds beyond its fixed width."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(column), F.lit(0)).cast("bigint")
    if isinstance(kind, T.ArrayType):
        return F.coalesce(F.array_size(column), F.lit(0)).cast("bigint") * row_bytes(T.StructType([T.StructField("e", kind.elementType)]))
    return None


def fits(df: DataFrame, limit: int = MAX_BROADCAST_BYTES, extra: Column | None = None) -> bool:
    """True when ``df`` takes at most ``limit`` bytes: its rows are counted, not guessed.

    ``extra`` gives the bytes of a row's arrays; without it text, binary and array columns are
    measured by what they hold.
    """
    width = row_bytes(df.schema)
    if extra is None:
        sized = [_held(F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields]
        sized = [c for c in sized if c is not None]
        if sized:
            extra = reduce(lambda a, b: a + b, sized)
    if extra is None:
        return df.count() <= limit // width
    total = df.agg(F.coalesce(F.sum(extra + F.lit(width)), F.lit(0)).alias("total")).first()["total"]
    return total <= limit


def stage(df: DataFrame) -> DataFrame:
    """Write a large frame that several passes read as a parquet table, and read it back.

    Goes to the shared checkpoint folder. Unlike a checkpoint it can be read by column, and its
    size on disk lets Spark itself choose a broadcast. Equal schema, types and column order.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/staged-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder through Spark's own file system, wherever it lies."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(target, True)


class Staging:
    """Staged tables of one job; ``with Staging(spark) as staged:`` deletes them when the job has written its results."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.paths = spark, []

    def __call__(self, df: DataFrame) -> DataFrame:
        path = f"{ensure_checkpoint_dir(self.spark)}/staged-{uuid.uuid4().hex}"
        self.paths.append(path)
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def __enter__(self) -> Staging:
        return self

    def __exit__(self, *_: object) -> None:
        for path in self.paths:
            delete(self.spark, path)


# What a session for these jobs should set; all are plain Spark settings.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    # Recording a Python call site for every column costs more than planning the query.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def configured(builder: SparkSession.Builder) -> SparkSession.Builder:
    """A session builder with ``SETTINGS`` applied."""
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    return builder
