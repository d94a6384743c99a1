from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairflow.llm import ann

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def exact(ids, vectors, query, k):
    i = ids.index(query)
    others = [j for j in range(len(ids)) if ids[j] != query and len(vectors[j]) == len(vectors[i])]
    scored = sorted((-float((np.float64(vectors[j]) * np.float64(vectors[i])).sum()), ids[j]) for j in others)
    return [(i, -s) for s, i in scored[:k]]


def test_recall_on_the_given_vectors(spark):
    sf = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    ids, vectors = [r["vec_id"] for r in rows], [np.array(r["embedding"], np.float64) for r in rows]
    got = {}
    for r in ann.op4_neighbours(spark, sf).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert sorted(got) == sorted(i for i in ids if i % 20 == 0)
    hit = 0
    for q, found in got.items():
        want = exact(ids, vectors, q, 20)
        hit += len({i for i, _ in found} & {i for i, _ in want})
        assert len(found) == 20 and found == sorted(found, key=lambda x: (-x[1], x[0]))
    assert hit >= 0.9 * 20 * len(got)


def test_recall_over_several_shards_and_blocks(spark):
    rng = np.random.default_rng(4)
    v = rng.standard_normal((3000, 24))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    frame = spark.createDataFrame([(i, x.tolist(), 0) for i, x in enumerate(v)], SCHEMA)
    got = ann.search(frame, "vec_id", "embedding", "vec_id % 50 = 0", k=10, shard=700, block=20).collect()
    v = v.astype(np.float32).astype(np.float64)
    hit = 0
    for q in range(0, 3000, 50):
        s = v @ v[q]
        s[q] = -9
        hit += len(set(np.argsort(-s)[:10]) & {r["vec_id"] for r in got if r["query_id"] == q})
    assert len(got) == 600 and hit >= 0.9 * 600


@pytest.mark.parametrize("sigma", [0.6, 1.0])
def test_recall_on_vectors_of_unlike_length(spark, sigma):
    rng = np.random.default_rng(5)
    v = rng.standard_normal((4000, 64))
    v *= np.exp(sigma * rng.standard_normal((4000, 1))) / np.linalg.norm(v, axis=1, keepdims=True)
    frame = spark.createDataFrame([(i, x.tolist(), 0) for i, x in enumerate(v)], SCHEMA)
    got = ann.search(frame, "vec_id", "embedding", "vec_id % 80 = 0").collect()
    v = v.astype(np.float32).astype(np.float64)
    hit = 0
    for q in range(0, 4000, 80):
        s = v @ v[q]
        s[q] = -np.inf
        hit += len(set(np.argsort(-s)[:20]) & {r["vec_id"] for r in got if r["query_id"] == q})
    assert len(got) == 1000 and hit >= 0.95 * 1000


@pytest.mark.parametrize("kind", ["wide", "positive", "offset", "clusters"])
def test_no_neighbour_is_missed_on_other_rows(spark, kind):
    rng = np.random.default_rng(6)
    n, dim = 1500, 256
    v = rng.standard_normal((n, dim))
    if kind == "positive":
        v = np.abs(v)
    if kind == "offset":
        v += 1
    if kind == "clusters":
        v = 0.3 * v + rng.standard_normal((30, dim))[rng.integers(0, 30, n)]
    frame = spark.createDataFrame([(i, x.tolist(), 0) for i, x in enumerate(v)], SCHEMA)
    got = {}
    for r in ann.search(frame, "vec_id", "embedding", "vec_id % 20 = 0", shard=1000).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    v = v.astype(np.float32).astype(np.float64)
    for q in range(0, n, 20):
        s = v @ v[q]
        s[q] = -np.inf
        assert got[q] == np.argsort(-s)[:20].tolist()


def test_groups_out_of_reach_are_passed_over():
    rng = np.random.default_rng(7)
    far = np.repeat(np.eye(16), 64, axis=0) + 0.01 * rng.standard_normal((1024, 16))
    shard = ann.Shard(far)
    shard.vectors[far[:, 0] < 0.5] = np.nan  # never multiplied out
    hit = shard.check(np.eye(16)[:1], np.array([0.4]))
    assert hit[0].tolist() == (far[:, 0] > 0.5).tolist()


def test_lengths_at_the_ends_of_double():
    v = np.array([[1e300, 1e300], [1e-300, 0.0], [3.0, 4.0], [2.0, 0.0]])
    assert ann.lengths(v)[2] == pytest.approx(np.log2(5))
    assert [b.tolist() for b in ann.bands(ann.lengths(v))] == [[0], [2], [3], [1]]
    assert all(c.all() for c in ann.Shard(v, trees=2, bits=4).candidates(v, 0.1, 5))


def test_few_tied_odd_and_repeated_rows(spark):
    a, b = [1.0, 0.0, 0.5], [0.0, 1.0, 0.0]
    rows = [
        (0, a, 1), (7, a, 1), (3, a, 2), (3, a, 2), (5, b, 1), (20, b, None), (40, None, 1), (60, [0.0, 0.0, 0.0], 1), (80, [1.0, None, 1.0], 1),
        (100, [float("nan"), 1.0, 1.0], 1), (120, [float("inf"), 1.0, 1.0], 1), (None, a, 1), (140, [], 1), (160, [1.0, 2.0], 1), (9, [2.0, 1.0], 1),
    ]
    frame = spark.createDataFrame(rows, SCHEMA).withColumns({"score": F.lit("mine"), "rank": F.lit(0)})
    got = ann.search(frame, "vec_id", "embedding", "vec_id % 20 = 0").orderBy("query_id", "rank").collect()
    found = {}
    for r in got:
        found.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert found == {
        0: [(1, 3, 1.25), (2, 7, 1.25), (3, 5, 0.0), (4, 20, 0.0)],
        20: [(1, 5, 1.0), (2, 0, 0.0), (3, 3, 0.0), (4, 7, 0.0)],
        160: [(1, 9, 4.0)],
    }
    assert ann.search(frame.where("false"), "vec_id", "embedding", "true").count() == 0


def test_every_vector_of_a_repeated_id_is_met(spark):
    rows = [(1, [1.0, 0.0], 0), (2, [0.0, 1.0], 0), (2, [3.0, 0.0], 0), (2, [2.0, 0.0], 0), (3, [1.5, 0.0], 0), (4, [0.5, 0.0], 0), (4, [0.0, 9.0], 0)]
    frame = spark.createDataFrame(rows, SCHEMA)
    for shard in (100, 2):
        got = ann.search(frame, "vec_id", "embedding", "vec_id in (1, 4)", k=2, shard=shard).orderBy("query_id", "rank").collect()
        assert [tuple(r)[:4] for r in got] == [(1, 1, 2, 3.0), (1, 2, 3, 1.5), (4, 1, 2, 9.0), (4, 2, 3, 0.75)]


def test_copies_of_one_vector(spark):
    rng = np.random.default_rng(2)
    unit = lambda x: (x / np.linalg.norm(x)).tolist()
    rows = [(i, unit(np.ones(8) if i % 3 == 0 else rng.standard_normal(8)), 0) for i in range(900)]
    got = ann.search(spark.createDataFrame(rows, SCHEMA), "vec_id", "embedding", "vec_id = 60", shard=200).orderBy("rank").collect()
    assert [r["vec_id"] for r in got] == [i for i in range(0, 66, 3) if i != 60][:20]


def test_climbing_reaches_everything():
    rng = np.random.default_rng(0)
    v = rng.standard_normal((50, 5))
    forest = ann.Forest(v, trees=3, bits=16)
    few, all_ = forest.ranges(v[:4], 6), forest.ranges(v[:4], 10**9)
    assert ((few[:, :, 1] - few[:, :, 0]).sum(1) >= 6).all()
    assert all(forest.candidates(few[i])[i] for i in range(4))
    assert all(forest.candidates(s).all() for s in all_)


@pytest.mark.parametrize("size", [1e160, 1e307, 1e-160])
def test_products_beyond_the_range_of_doubles(spark, size):
    """Finite vectors whose products overflow (or vanish) still have all their neighbours."""
    rng = np.random.default_rng(3)
    rows = [(i, (rng.standard_normal(8) * size).tolist()) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = ann.search(df, "vec_id", "embedding", "vec_id % 20 = 0").toPandas()
    assert got.groupby("query_id").size().to_dict() == {0: 20, 20: 20, 40: 20}
    assert sorted(got["rank"].unique()) == list(range(1, 21))
