"""A training corpus from the documents table, stage by stage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pairflow.llm import mixing, pieces, quality, secrets, simhash
from pairflow.llm.common import shared_path, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

STAGES: list[tuple[str, Stage]] = [
    ("quality rules", quality.keep_good),
    ("near-duplicates", simhash.keep_one),
    ("secrets", secrets.hide_secrets),
    ("mixing", mixing.mix),
    ("sentencepiece", pieces.tokenise),
]

ORACLE_SQL = None
"""SQL has no SimHash, so the whole run is tested against a plain version instead."""


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written as Parquet to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = shared_path(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
