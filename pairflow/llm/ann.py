"""Nearest neighbours by a forest of hash prefixes.

A tree is a sorted array of long hash strings, one bit for each of many random directions. A query
goes down every tree to the entries that share its longest prefix, and then climbs all trees
together, one bit at a time, until the entries that share the prefix are enough; these are scored
exactly. The vectors are dealt into shards of bounded size, each with forests of its own, and the
queries meet the shards block by block.

A shard has one forest for each band of like lengths (norms). Within a band a vector is hashed with
one more component that brings it to the band's greatest length, and a query with 0 there, so that
the angle hashed falls as the inner product rises.

How well hashes part vectors depends on the rows: with many dimensions or a common offset most entries look alike.
So what the forests give is a floor for each query, its ``k``-th best product among them, and an exact check
follows. It goes over groups of entries that stand together in a tree, passes over those that cannot reach the
floor by their centre and radius, and multiplies out the others. A shard returns its nearest entries on any rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pairflow.llm.common import quoted, stored, table

TREES, BITS = 96, 32
SHARD, BLOCK = 8192, 4096
"""Vectors in a shard and queries in a block, on average."""
SHARE = 0.6
"""Entries that a query gathers over all trees, as a share of the shard (an entry of two trees counts twice)."""
SEED = 11
OCTAVE = 1.0
"""The logarithm (base 2) of how much longer the longest vector of a band may be than the shortest."""
GROUP, SLICE = 64, 512
"""Entries of a group, and queries checked side by side."""
MARGIN = 1e-9
"""Far above the rounding of products and distances at lengths of at most 1."""


class Forest:
    """The trees of one shard."""

    def __init__(self, vectors: np.ndarray, trees: int = TREES, bits: int = BITS, seed: int = SEED) -> None:
        self.vectors, self.bits = vectors, bits
        rng = np.random.default_rng(seed)
        self.directions = rng.standard_normal((trees, bits, vectors.shape[1])).astype(np.float32)
        self.orders, self.strings = [], []
        for d in self.directions:
            s = self._strings(vectors, d)
            order = np.argsort(s, kind="stable")
            self.orders.append(order)
            self.strings.append(s[order])

    def _strings(self, vectors: np.ndarray, directions: np.ndarray) -> np.ndarray:
        set_ = (vectors.astype(np.float32) @ directions.T > 0).astype(np.uint64)
        return set_ @ (np.uint64(1) << np.arange(self.bits - 1, -1, -1, dtype=np.uint64))

    def ranges(self, queries: np.ndarray, enough: int) -> np.ndarray:
        """(query, tree, 2): the entries of each tree to look at.

        All trees start at the longest prefix and give up one bit at a time, together, until the
        entries sharing it are ``enough``; at no bit at all every entry is shared.
        """
        n = len(self.vectors)
        own = [self._strings(queries, d) for d in self.directions]
        out = np.zeros((len(queries), len(own), 2), np.int64)
        open_ = np.arange(len(queries))
        for level in range(self.bits, -1, -1):
            drop = np.uint64(self.bits - level)
            span = np.zeros((len(open_), len(own), 2), np.int64)
            for t, (s, q) in enumerate(zip(self.strings, own)):
                low = (q[open_] >> drop) << drop
                span[:, t, 0] = np.searchsorted(s, low, "left")
                span[:, t, 1] = np.searchsorted(s, low + (np.uint64(1) << drop), "left")
            done = (span[:, :, 1] - span[:, :, 0]).sum(1) >= min(enough, n * len(own))
            out[open_[done]] = span[done]
            open_ = open_[~done]
            if not len(open_):
                break
        return out

    def candidates(self, spans: np.ndarray) -> np.ndarray:
        """Whether each entry lies in one of the ranges of one query."""
        hit = np.zeros(len(self.vectors), bool)
        for order, (a, b) in zip(self.orders, spans):
            hit[order[a:b]] = True
        return hit


def lengths(vectors: np.ndarray) -> np.ndarray:
    """Logarithms (base 2) of the norms of vectors that are not zero, without overflow."""
    most = np.abs(vectors).max(axis=1)
    return np.log2(most) + 0.5 * np.log2(((vectors / most[:, None]) ** 2).sum(axis=1))


def bands(logs: np.ndarray) -> list[np.ndarray]:
    """Positions by bands of like length, the longest first."""
    order = np.argsort(-logs, kind="stable")
    falling, out, at = -logs[order], [], 0
    while at < len(order):
        to = int(np.searchsorted(falling, falling[at] + OCTAVE, "right"))
        out.append(order[at:to])
        at = to
    return out


class Shard:
    """The forests of one shard, a band of like lengths each; of every band a query gathers the same share.

    ``vectors`` are brought to lengths of at most 1 together, where no product overflows.
    """

    def __init__(self, vectors: np.ndarray, trees: int = TREES, bits: int = BITS) -> None:
        self.n, self.trees, self.bands = len(vectors), trees, []
        logs = lengths(vectors)
        self.vectors, self.groups = np.ldexp(vectors, -int(np.ceil(logs.max()))), []
        for own in bands(logs):
            v = np.ldexp(vectors[own], -int(np.ceil(logs[own[0]])))  # lengths of at most 1
            squares = (v * v).sum(axis=1)
            self.bands.append((own, Forest(np.c_[v, np.sqrt(np.maximum(squares.max() - squares, 0))], trees, bits)))
            order = own[self.bands[-1][1].orders[0]]
            self.groups += [order[i : i + GROUP] for i in range(0, len(order), GROUP)]
        self.centres = np.stack([self.vectors[g].mean(axis=0) for g in self.groups])
        self.radii = np.array([np.sqrt(((self.vectors[g] - c) ** 2).sum(axis=1).max()) for g, c in zip(self.groups, self.centres)])

    def candidates(self, queries: np.ndarray, share: float, least: int) -> Iterator[np.ndarray]:
        """For each query whether each vector is looked at."""
        q = np.c_[queries / np.abs(queries).max(axis=1, keepdims=True), np.zeros(len(queries))]
        spans = [f.ranges(q, max(int(share * len(own)), least * self.trees)) for own, f in self.bands]
        for i in range(len(q)):
            hit = np.zeros(self.n, bool)
            for (own, f), span in zip(self.bands, spans):
                hit[own] = f.candidates(span[i])
            yield hit

    def check(self, queries: np.ndarray, floors: np.ndarray) -> np.ndarray:
        """(query, vector): whether the product is at or above the query's floor, for ``queries`` of lengths of at most 1."""
        out = np.zeros((len(queries), self.n), bool)
        floors = floors[:, None] - MARGIN
        reach = queries @ self.centres.T + np.sqrt((queries**2).sum(axis=1))[:, None] * self.radii
        for group, may in zip(self.groups, (reach >= floors - MARGIN).T):
            asked = np.nonzero(may)[0]
            out[asked[:, None], group] = queries[asked] @ self.vectors[group].T >= floors[asked]
        return out


def kth(products: np.ndarray, ids: np.ndarray, k: int) -> float:
    """The ``k``-th best product of different ids, which are sorted; of fewer ids no floor at all."""
    if not len(ids):
        return -np.inf
    top = np.maximum.reduceat(products, np.nonzero(np.r_[True, ids[1:] != ids[:-1]])[0])
    return float(np.partition(top, len(top) - k)[len(top) - k]) if len(top) >= k else -np.inf


def best(vectors: np.ndarray, ids: np.ndarray, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and inner products of the ``k`` nearest, ties to the smaller id; products are summed alike for equal vectors.

    ``ids`` are sorted; of an id with several vectors the nearest counts.
    """
    if len(ids) > k:
        # At lengths of at most 1, where no product overflows and rounding is far below the margin.
        down = -int(np.ceil(max(lengths(vectors).max(), lengths(query[None])[0])))
        rough = np.ldexp(vectors, down) @ np.ldexp(query, down)
        near = rough >= kth(rough, ids, k) - MARGIN
        vectors, ids = vectors[near], ids[near]
    score = (vectors * query).sum(axis=1)
    order = np.lexsort((-score, ids))
    order = order[np.r_[True, ids[order][1:] != ids[order][:-1]]] if len(order) else order
    order = order[np.lexsort((ids[order], -score[order]))][:k]
    return ids[order], score[order]


def search(
    rows: DataFrame, id_: str, vector: str, is_query: str, k: int = 20, trees: int = TREES, bits: int = BITS,
    share: float = SHARE, shard: int = SHARD, block: int = BLOCK,
) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query id its ``k`` nearest other ids found, by inner product in double.

    ``is_query`` is a condition in SQL. Rows with a null id, and vectors that are null, empty, zero
    or hold null or non-finite components, take no part. Of rows with one id
    every distinct vector counts, and the best score of any two stands. Vectors only meet those of their own length. Where fewer than ``k`` others are there all
    come back. Ties go to the smaller id. Vectors of any lengths (norms) may stand together, and none of
    the nearest is missed.
    """
    v = F.col(quoted(vector)).cast("array<double>")
    sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    kept = stored(
        rows.where(F.col(quoted(id_)).isNotNull() & F.coalesce(sound, F.lit(False)))
        .withColumns({"_id": F.col(quoted(id_)).cast("bigint"), "_v": v, "_q": F.expr(is_query)})
        .groupBy("_id", "_v").agg(F.max("_q").alias("q"))
        .select(F.col("_id").alias("id"), F.col("_v").alias("v"), F.coalesce("q", F.lit(False)).alias("q"), F.size("v").alias("dim"))
    )
    sizes = kept.groupBy("dim").agg(
        F.ceil(F.count(F.lit(1)) / shard).cast("int").alias("shards"),
        F.greatest(F.ceil(F.count_if("q") / block), F.lit(1)).cast("int").alias("blocks"),
    )
    placed = kept.join(sizes, "dim").withColumn("at", F.xxhash64("id", "v"))
    # A shard goes to every block of queries and a block to every shard: all queries meet all rows.
    points = placed.select(
        "dim", F.pmod("at", "shards").alias("shard"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "id", "v"
    )
    queries = placed.where("q").select(
        "dim", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard"), F.pmod("at", "blocks").alias("block"), "id", "v"
    )
    queries = queries.toDF(*queries.columns)  # columns of its own, so that the two sides can be told apart

    def run(points: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if not len(points) or not len(queries):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})
        points = points.sort_values("id")
        ids, vectors = points["id"].to_numpy(), np.stack(points["v"].to_numpy())
        # Copies are one entry of the forest, so that they do not crowd out others.
        distinct, entry = np.unique(vectors, axis=0, return_inverse=True)
        asked, qs = queries["id"].to_numpy(), np.stack(queries["v"].to_numpy())
        found, own_shard = [], Shard(distinct, trees, bits)
        scaled = np.ldexp(qs, -np.ceil(lengths(qs)).astype(int)[:, None])
        for at in range(0, len(asked), SLICE):
            part, floors = slice(at, at + SLICE), []
            for q, query, hit in zip(asked[part], scaled[part], own_shard.candidates(qs[part], share, k + 1)):
                near = np.nonzero(hit[entry] & (ids != q))[0]
                floors.append(kth(own_shard.vectors[entry[near]] @ query, ids[near], k))
            for q, query, hit in zip(asked[part], qs[part], own_shard.check(scaled[part], np.array(floors))):
                near = np.nonzero(hit[entry] & (ids != q))[0]
                own, score = best(vectors[near], ids[near], query, k)
                found.append((np.full(len(own), q), own, score))
        a, b, c = (np.concatenate(x) for x in zip(*found))
        return pd.DataFrame({"query_id": a, "vec_id": b, "score": c})

    keys = ["dim", "shard", "block"]
    found = queries.groupBy(*keys).cogroup(points.groupBy(*keys)).applyInPandas(
        lambda q, p: run(p, q), "query_id bigint, vec_id bigint, score double"
    )
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op4_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors of every twentieth one."""
    return search(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), "vec_id", "embedding", "vec_id % 20 = 0")
