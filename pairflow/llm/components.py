"""Connected components of an edge list: large-star and small-star rounds, all as joins and sums."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairflow.llm.common import stored


SALTS = 32
"""Tasks that the pairs of one node are spread over: the root of a large component has very many."""


def _with_least(pairs: DataFrame) -> DataFrame:
    """Rows (u, v, m): m is the least of u and all its v.

    The least is taken per part of a node's pairs first and goes back to each part under the part's
    own key, so that no node's pairs meet in one task.
    """
    salted = pairs.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SALTS)))
    parts = salted.groupBy("u", "salt").agg(F.min("v").alias("m"))
    whole = parts.groupBy("u").agg(F.least(F.min("m"), F.col("u")).alias("m"), F.collect_list("salt").alias("salts"))
    least = whole.select("u", "m", F.explode("salts").alias("salt"))
    return salted.join(least, ["u", "salt"]).drop("salt")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    met = _with_least(both).where(F.col("v") > F.col("u"))
    return met.select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    met = _with_least(down)
    own = met.select(F.col("u"), F.col("m").alias("v"))
    others = met.select(F.col("v").alias("u"), F.col("m").alias("v"))
    return own.union(others).where(F.col("u") != F.col("v")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (u, v: bigint) but the roots, root being the least node reached.

    Both stars keep the components as they are and only shorten paths; when a round changes nothing
    every node hangs on its root. Each round is written to the shared folder, where its lineage ends.
    """
    seen = None
    now = stored(edges.where(F.col("u") != F.col("v")).select("u", "v").distinct())
    while True:
        mark = now.agg(
            F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u") % 1_000_003)
        ).first()
        if mark == seen or mark[0] == 0:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = mark
        now = stored(_small_star(_large_star(now)))
