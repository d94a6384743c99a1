"""SimHash near-duplicates by tiled exact comparison.

Fingerprints are grouped by the population counts of their four 16-bit words and cut into tiles.
Two fingerprints that differ in at most ``radius`` bits have population counts that differ by at
most ``radius`` in sum, so a tile only ever meets the tiles of nearby counts; each such pair of
tiles is compared whole, by numpy exclusive-or and bit counts. No pair is missed and none is a
guess. From a pair of tiles only links that join something new are returned (a spanning forest),
so a large group of near copies costs links in proportion to its size.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import product

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairflow.llm.common import columns, quoted, row_digest, spare, stored, table
from pairflow.llm.components import components

SHINGLE, RADIUS, SEED = 3, 3, 42
TILE = 4096
"""Fingerprints in a tile, on average at most."""
PARTS = 4

_BITS = ((np.arange(256)[:, None] >> np.arange(8)[None, :]) & 1).astype(np.int64)
_OFFSETS = (np.arange(8) * 256).astype(np.int64)
_BLOCK = 65_536


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """64-bit SimHash of a text, unsigned: a bit is set where more than half of the shingles' hashes set it."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and the six spaces only
    if not found:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(found) <= shingle:
        return digest(b" ".join(found), SEED)
    line = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    first, last = starts[: len(found) - shingle + 1].tolist(), ends[shingle - 1 :].tolist()
    ones = np.zeros((8, 256), np.int64)
    for at in range(0, len(first), _BLOCK):
        hashes = np.array(
            [digest(line[a:b], SEED) for a, b in zip(first[at : at + _BLOCK], last[at : at + _BLOCK])], np.uint64
        )
        octets = hashes.view(np.uint8).reshape(-1, 8) + _OFFSETS
        ones += np.bincount(octets.ravel(), minlength=2048).reshape(8, 256)
    set_ = (ones @ _BITS).ravel() * 2 > len(first)
    return int(np.packbits(set_, bitorder="little").view("<u8")[0])


def _fingerprints(texts: pd.Series, shingle: int) -> pd.Series:
    return pd.Series(np.array([fingerprint(t, shingle) for t in texts], np.uint64).view(np.int64))


def with_fingerprint(docs: DataFrame, text: str, into: str, shingle: int = SHINGLE) -> DataFrame:
    """Add the fingerprint as a bigint of the same 64 bits. Null is as the empty text: zero."""

    @F.pandas_udf("bigint")
    def simhash(texts: pd.Series) -> pd.Series:
        return _fingerprints(texts, shingle)

    return docs.withColumn(into, simhash(F.col(quoted(text))))


# --- tiles -----------------------------------------------------------------------------------


def _counts(fp: Column) -> list[Column]:
    bits = 64 // PARTS
    return [
        F.bit_count(F.shiftrightunsigned(fp, bits * p).bitwiseAND(F.lit((1 << bits) - 1))) for p in range(PARTS)
    ]


def _cell(counts: list[Column]) -> Column:
    return reduce(lambda a, c: a * 32 + c, counts, F.lit(0)).cast("int")


def _steps(radius: int) -> list[tuple[int, ...]]:
    """Differences of count vectors with a sum of at most ``radius``; of each and its opposite only one."""
    every = product(range(-radius, radius + 1), repeat=PARTS)
    return [s for s in every if sum(map(abs, s)) <= radius and s >= (0,) * PARTS]


def _forest(left: np.ndarray, right: np.ndarray, a: np.ndarray, b: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Join the classes of nodes that the index pairs (a, b) link; ``labels`` holds each node's least member."""
    u, v = a, b + len(left)
    while True:
        x, y = labels[u], labels[v]
        apart = x != y
        if not apart.any():
            return labels
        x, y = x[apart], y[apart]
        np.minimum.at(labels, np.maximum(x, y), np.minimum(x, y))
        while True:
            down = labels[labels]
            if np.array_equal(down, labels):
                break
            labels = down


def links(left: np.ndarray, right: np.ndarray, radius: int, rows: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """Pairs that span the same classes as all pairs (l, r) with at most ``radius`` differing bits."""
    labels = np.arange(len(left) + len(right))
    for at in range(0, len(left), rows):
        near = np.bitwise_count(left[at : at + rows, None] ^ right[None, :]) <= radius
        a, b = np.nonzero(near)
        if len(a):
            labels = _forest(left, right, a + at, b, labels)
    nodes = np.concatenate((left, right))
    moved = np.nonzero(labels != np.arange(len(labels)))[0]
    u, v = nodes[moved], nodes[labels[moved]]
    return u[u != v], v[u != v]


def near_pairs(prints: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """Links (u, v) among the distinct fingerprints ``fp``: the classes are those of all pairs within ``radius``.

    The table of cells is bounded by the possible counts (17 to the 4th rows) and so is broadcast.
    """
    cells = prints.withColumn("cell", _cell(_counts(F.col("fp"))))
    sizes = stored(
        cells.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / F.lit(tile)).cast("int").alias("n_tiles"))
    )
    tiles = (
        cells.join(F.broadcast(sizes), "cell")
        .withColumn("tile", F.pmod(F.xxhash64("fp"), F.col("n_tiles")).cast("int"))
        .groupBy("cell", "tile")
        .agg(F.collect_list("fp").alias("fps"))
    )
    tiles = stored(tiles)
    step = "struct<" + ",".join(f"d{p}:int" for p in range(PARTS)) + ">"
    steps = F.array(*[F.struct(*map(F.lit, s)).cast(step) for s in _steps(radius)])
    at = [F.shiftright("cell", 5 * (PARTS - 1 - p)).bitwiseAND(F.lit(31)) for p in range(PARTS)]
    near = tiles.select(F.col("cell").alias("from"), F.col("tile").alias("from_tile"), "fps", *[c.alias(f"c{p}") for p, c in enumerate(at)], F.explode(steps).alias("s"))
    near = near.select("from", "from_tile", "fps", *[(F.col(f"c{p}") + F.col(f"s.d{p}")).alias(f"c{p}") for p in range(PARTS)])
    near = near.where(reduce(lambda x, y: x & y, [F.col(f"c{p}").between(0, 64 // PARTS) for p in range(PARTS)]))
    near = near.select("from", "from_tile", "fps", _cell([F.col(f"c{p}") for p in range(PARTS)]).alias("cell"))
    # A side goes to each tile of the neighbouring cell under that tile's own key: no cell owns a task.
    near = near.join(F.broadcast(sizes), "cell")
    near = near.withColumn("tile", F.explode(F.sequence(F.lit(0), F.col("n_tiles") - 1))).drop("n_tiles")
    near = near.where((F.col("from") != F.col("cell")) | (F.col("from_tile") <= F.col("tile")))
    pairs = near.withColumnRenamed("fps", "left").join(tiles.withColumnRenamed("fps", "right"), ["cell", "tile"])

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = []
            for a, b in zip(batch["left"], batch["right"]):
                found.append(links(np.asarray(a).view(np.uint64), np.asarray(b).view(np.uint64), radius))
            for part in (found[i : i + 1000] for i in range(0, len(found), 1000)):
                u, v = (np.concatenate(x).view(np.int64) for x in zip(*part))
                yield pd.DataFrame({"u": u, "v": v})

    return pairs.select("left", "right").mapInPandas(compare, "u bigint, v bigint")


def near_classes(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(fp, class) for the distinct fingerprints that have a near one: class is the least of them as a signed number."""
    found = components(near_pairs(prints, radius)).select(F.col("node").alias("fp"), F.col("root").alias("class"))
    roots = found.select(F.col("class").alias("fp"), "class").distinct()
    return found.union(roots)


def near_duplicates(
    docs: DataFrame, key: str, text: str = "text", shingle: int = SHINGLE, radius: int = RADIUS
) -> DataFrame:
    """(key, fp, component): one row per row of ``docs``, ``component`` the least key of those reachable.

    Repeated rows share fingerprint and component. Rows with a null key take part; a component of
    null keys only is null. Null and empty texts have fingerprint zero and link like any other. An
    empty table gives an empty result. Only ``key`` and ``text`` are read, so other columns cannot clash.
    """
    prints = stored(with_fingerprint(docs.select(F.col(quoted(key)).alias("key"), F.col(quoted(text)).alias("text")), "text", "fp", shingle).select("key", "fp"))
    own = stored(prints.groupBy("fp").agg(F.min("key").alias("least")))
    classes = near_classes(own.select("fp"), radius)
    joined = own.join(classes, "fp", "left").withColumn("class", F.coalesce("class", "fp"))
    least = joined.groupBy("class").agg(F.min("least").alias("component"))
    by_print = joined.join(least, "class").select("fp", "component")
    return prints.join(by_print, "fp").select(F.col("key").alias(key), "fp", "component")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its fingerprint and the smallest doc_id it is linked to."""
    found = near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    return found.select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id")
    )


def keep_one(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each group the row with the least (doc_id, content digest) stays, columns unchanged.

    Null ids come after all others. Rows equal in every column are one row.
    """
    key, fp, least, twin = spare(docs, "key", "fp", "least", "twin")
    keyed = docs.withColumns({key: row_digest(docs)})
    prints = stored(
        with_fingerprint(keyed.select("doc_id", "text", key), "text", "fp").select("doc_id", F.col(key).alias("key"), "fp")
    )
    rank = F.struct(F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0)).alias("id"), F.col("key").alias("key"))
    own = stored(prints.groupBy("fp").agg(F.min(rank).alias("least")))
    classes = near_classes(own.select("fp"))
    firsts = (
        own.join(classes, "fp", "left")
        .groupBy(F.coalesce("class", "fp").alias("class"))
        .agg(F.min("least").alias("least"))
        .select(F.col("least.key").alias(key))
        .distinct()
    )
    stay = keyed.join(firsts.hint("shuffle_hash"), key, "left_semi")
    return stay.dropDuplicates([key]).select(*columns(docs))
