"""What the operators of this subpackage share: words, names for helper columns, keys of rows, folders."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairflow.session import ensure_checkpoint_dir

SPACES = " \t\n\x0b\x0c\r"
"""The six characters that part words; any other character belongs to a word."""
GAP = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spare(df: DataFrame, *names: str) -> list[str]:
    """One name for each of ``names`` that no column of ``df`` has (Spark's names ignore case)."""
    taken = {c.lower() for c in df.columns}
    found = []
    for name in names:
        own = f"_{name}"
        while own.lower() in taken:
            own = f"_{own}"
        taken.add(own.lower())
        found.append(own)
    return found


def quoted(name: str) -> str:
    """A column name as an expression takes it, dots and backticks included."""
    return "`" + name.replace("`", "``") + "`"


def columns(df: DataFrame) -> list[Column]:
    return [F.col(quoted(c)) for c in df.columns]


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, however often ``use`` names it."""
    return F.transform(F.array(value), use)[0]


def words(text: Column) -> Column:
    """The words of a text, in order; none for null."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return let(
        trimmed,
        lambda t: F.when(t == F.lit(""), F.array().cast("array<string>")).otherwise(F.split(t, GAP)),
    )


def n_words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("bigint")


def row_key(df: DataFrame, *names: str) -> Column:
    """64 bits that depend on the values of a row alone: equal rows share it, a retry gives it again."""
    return F.xxhash64(*[F.col(quoted(c)) for c in (names or df.columns)])


def row_digest(df: DataFrame) -> Column:
    """128 bits of a row's values, by two digests of unlike seeds, as hexadecimal digits: the row's identity in joins."""
    # A digest passes over nulls, so each value goes with whether it is one.
    values = [x for c in columns(df) for x in (c.isNull(), c)]
    return F.concat(*[F.lpad(F.hex(h), 16, "0") for h in (F.xxhash64(*values), F.xxhash64(F.lit("row"), *values))])


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder below the one that the driver and all executors see."""
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, codec: str = "zstd") -> DataFrame:
    """``df`` written to the shared folder and read back: lineage ends here, any executor can read it."""
    spark = df.sparkSession
    path = shared_path(spark, "llm")
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def swept_shuffles(spark: SparkSession) -> Iterator[None]:
    """Jobs within let go of a query's shuffle files as it ends: for rounds that each write their result."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)
