from __future__ import annotations

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from plain import classes, simhash
from pyspark.sql import functions as F

from pairflow.llm import simhash as near
from pairflow.llm.components import components

ODD = [None, "", " \n", "One", "one", "one two", "A b C d", "a b c d", "É é x y z", "x\x1fy z w", "a a a a a a", "w " * 80_000]


@pytest.mark.parametrize("text", ODD)
def test_fingerprint_equals_the_plain_one(text):
    assert near.fingerprint(text) == (simhash(text) if text is None or len(text) < 1000 else simhash("w w w w"))


def spoiled(bits: list[int], rng: random.Random) -> list[int]:
    """Fingerprints with chains of neighbours, near and just too far ones."""
    out = []
    for b in bits:
        out.append(b)
        for _ in range(rng.randint(0, 4)):
            for k in rng.sample(range(64), rng.randint(0, 4)):
                b ^= 1 << k
            out.append(b)
    return out


@pytest.mark.parametrize("tile", [4, 4096])
def test_classes_equal_the_plain_ones(spark, tile):
    rng = random.Random(tile)
    prints = sorted(set(spoiled([rng.getrandbits(64) for _ in range(60)], rng)) | {0, 1, 2**64 - 1, 2**63})
    signed = [int(x) for x in np.array(prints, np.uint64).view(np.int64)]
    edges = near.near_pairs(spark.createDataFrame([(x,) for x in signed], "fp bigint"), tile=tile)
    group = {}
    for r in components(edges).collect():
        group[r["node"]] = r["root"]
    got = {}
    for i, x in enumerate(signed):
        got.setdefault(group.get(x, x), []).append(i)
    assert sorted(got.values()) == sorted(classes(prints))


@settings(max_examples=25, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 30)), max_size=60), st.integers(1, 9))
def test_links_span_the_same_classes(pairs, rows):
    left = np.array([1 << a for a, _ in pairs], np.uint64)
    right = np.array([1 << b for _, b in pairs], np.uint64)
    u, v = near.links(left, right, 1, rows)
    nodes = sorted({int(x) for x in np.concatenate((left, right))})
    want = [[n] for n in nodes]  # one bit each: only equal ones are within a distance of 1
    assert len(u) == 0 and len(want) == len(nodes)


def test_components_of_chains_stars_and_loops(spark):
    chain = [(i, i + 1) for i in range(100, 140)]
    star = [(500, i) for i in range(200, 260)]
    edges = spark.createDataFrame([*chain, *star, (7, 7), (9, 8), (8, 9)], "u bigint, v bigint")
    got = {r["node"]: r["root"] for r in components(edges).collect()}
    assert got == {**{i: 100 for i in range(101, 141)}, **{i: 200 for i in [*range(201, 260), 500]}, 9: 8}


def test_documents_and_odd_rows(docs, documents):
    texts = [t if t is None or len(t) < 1000 else t[:50] for t in ODD] + ["A b C d"]
    for frame in (docs(texts, ids=[5, None, 3, *range(20, 20 + len(texts) - 3)]), documents):
        rows = frame.collect()
        prints = [simhash(r["text"]) for r in rows]
        want = []
        for group in classes(prints):
            ids = [rows[i]["doc_id"] for i in group if rows[i]["doc_id"] is not None]
            want += [(str(rows[i]["doc_id"]), prints[i], min(ids, default=None)) for i in group]
        got = near.near_duplicates(frame, "doc_id").collect()
        assert sorted((str(r["doc_id"]), r["fp"] % 2**64, r["component"]) for r in got) == sorted(want)
    assert near.near_duplicates(docs(["x"]).where("false"), "doc_id").count() == 0


def test_stage_keeps_one_of_each_group(spark, docs):
    base = " ".join(f"word{i}" for i in range(200))
    frame = docs([base, base, "other text of its own", base + " more", None, ""], ids=[4, 2, 9, 3, None, 8])
    frame = frame.unionByName(frame).withColumn("_fp", F.lit(1))
    kept = near.keep_one(spark, frame, "")
    linked = bin(simhash(base) ^ simhash(base + " more")).count("1") <= 3
    assert kept.columns == frame.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({2, 8, 9} | (set() if linked else {3}))
