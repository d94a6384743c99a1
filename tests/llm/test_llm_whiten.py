"""Whitening against numpy's own eigenvectors, and the solver on matrices that are hard for it."""

from __future__ import annotations

import numpy as np
import pytest

from pairflow.llm import queries as llm
from pairflow.llm import whiten

SCHEMA = "vec_id bigint, embedding array<float>"


def whole(v):
    return [int(np.floor(1024 * float(c))) + 100_000 for c in v]


def check(got, vectors):
    """``got`` (rows of the operator) against an eigendecomposition of the integer vectors."""
    x = np.array([whole(v) for _, v in vectors], object)
    n, sums = len(x), x.sum(0)
    exact = n * x - sums
    c = exact.astype(np.float64) / n
    e, v = np.linalg.eigh(c.T @ c / n)
    e, v = e[::-1], v[:, ::-1]
    k = min(8, int((e > 1e-9 * max(e[0], 1e-300)).sum()))
    want = {}
    for (i, _), row, d in zip(vectors, c, exact):
        want[i] = (row @ v[:, :k] / np.sqrt(e[:k]), sum(int(a) ** 2 for a in d))
    by_id = {}
    for r in got:
        assert r["n"] == n and r["identity_error"] <= 1e-9
        assert r["explained"] == pytest.approx(e[r["component"] - 1] / e.sum(), rel=1e-9)
        by_id.setdefault(r["vec_id"], {})[r["component"]] = r
    assert set(by_id) == set(want)
    flip = None
    for i, own in by_id.items():
        assert sorted(own) == list(range(1, k + 1))
        mine = np.array([own[j]["whitened"] for j in range(1, k + 1)])
        np.testing.assert_allclose(np.abs(mine), np.abs(want[i][0]), atol=1e-6)
        signs = np.sign(mine * want[i][0])
        flip = signs if flip is None else np.where(flip == 0, signs, flip)
        big = np.abs(mine) > 1e-3
        assert (signs[big] == flip[big]).all()  # one sign of a component for all rows
        assert all(r["deviation"] == want[i][1] for r in own.values())


def test_equals_numpy(spark):
    rng = np.random.default_rng(1)
    vectors = [(i, rng.standard_normal(12).astype(np.float32).tolist()) for i in range(300)]
    df = spark.createDataFrame(vectors, SCHEMA).repartition(7)
    check(whiten.whiten(df, "vec_id", "embedding").collect(), vectors)


def test_many_triangles_are_joined_in_rounds(spark, monkeypatch):
    monkeypatch.setattr(whiten, "FAN", 2)
    rng = np.random.default_rng(2)
    vectors = [(i, (rng.standard_normal(5) * [9, 5, 3, 1, 0.3]).astype(np.float32).tolist()) for i in range(60)]
    check(whiten.whiten(spark.createDataFrame(vectors, SCHEMA).repartition(11), "vec_id", "embedding").collect(), vectors)


def test_rows_that_stay_out_and_lengths_of_their_own(spark):
    rng = np.random.default_rng(3)
    good = [(i, rng.standard_normal(4).astype(np.float32).tolist()) for i in range(40)]
    other = [(100 + i, rng.standard_normal(2).astype(np.float32).tolist()) for i in range(9)]
    bad = [(200, None), (201, [1.0, None, 2.0, 3.0]), (202, [1.0, float("nan"), 2.0, 3.0]), (203, [1.0, float("inf"), 2.0, 3.0]), (204, [])]
    got = whiten.whiten(spark.createDataFrame([*good, *bad, *other], SCHEMA).repartition(3), "vec_id", "embedding").collect()
    check([r for r in got if r["vec_id"] < 100], good)
    check([r for r in got if r["vec_id"] >= 100], other)


def test_few_equal_repeated_null_and_empty(spark):
    make = lambda rows: whiten.whiten(spark.createDataFrame(rows, SCHEMA), "vec_id", "embedding").collect()
    assert make([]) == []
    assert make([(1, [1.0, 2.0])]) == []
    assert make([(1, [1.0, 2.0]), (2, [1.0, 2.0])]) == []
    few = [(1, [1.0, 2.0, 0.5]), (2, [1.0, 3.0, 0.5]), (3, [0.0, 3.0, 0.25])]
    got = make(few)
    assert {r["component"] for r in got} == {1, 2}
    check(got, few)
    twice = make([*few, *few, (None, [7.0, 7.0, 7.0])])
    assert len(twice) == 7 * 3 and all(r["n"] == 7 for r in twice)
    assert sum(r["vec_id"] is None for r in twice) == 3


def test_clashing_names_doubles_and_large_entries(spark):
    rows = [(float(i), "x", [1e300 * (-1) ** i, float(i)]) for i in range(4)]
    df = spark.createDataFrame(rows, "component double, n string, `v.x` array<double>")
    got = whiten.whiten(df, "component", "v.x").collect()
    assert len(got) == 8 and {r["deviation"] for r in got} == {None}  # past 64 bits
    assert all(np.isfinite(r["whitened"]) for r in got)


@pytest.mark.parametrize("kind", ["random", "scaled", "low rank", "equal values", "repeated columns", "zero columns"])
def test_solver(kind):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((200, 24))
    if kind == "scaled":
        x *= np.logspace(0, 7, 24)
    if kind == "low rank":
        x = rng.standard_normal((200, 3)) @ rng.standard_normal((3, 24))
    if kind == "equal values":
        x = np.vstack([np.eye(24), -np.eye(24)])
    if kind == "repeated columns":
        x[:, 12:] = x[:, :12]
    if kind == "zero columns":
        x[:, 5:9] = 0
    r = whiten.triangle(x)
    e, v, trace = whiten.principal(r, 24)
    square = x.T @ x
    want = np.linalg.eigvalsh(square)[::-1]
    assert len(e) == np.linalg.matrix_rank(x)
    np.testing.assert_allclose(e, want[: len(e)], atol=1e-12 * want[0])
    np.testing.assert_allclose(v.T @ v, np.eye(len(e)), atol=1e-10)
    assert np.abs(square @ v - v * e).max() <= 1e-12 * want[0]
    assert trace == pytest.approx(np.trace(square), rel=1e-12)


def test_singular_values_keep_their_relative_accuracy():
    rng = np.random.default_rng(5)
    d, e = np.logspace(0, -12, 30) * (1 + rng.random(30)), np.logspace(-1, -13, 29) * rng.random(29)
    got = np.sqrt(whiten.singular_squares(d, e))
    # The product of all values is that of the diagonal, to full relative accuracy.
    assert np.log(got).sum() == pytest.approx(np.log(d).sum(), abs=1e-11)
    assert (got > 0).all()


def test_the_query(spark):
    path = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{path}/embeddings.parquet").select("vec_id", "embedding").collect()
    vectors = [(r[0], list(r[1])) for r in rows if r[1] is not None and all(c is not None and np.isfinite(c) for c in r[1])]
    check(llm.QUERIES["op13_whitening"](spark, path).collect(), vectors)
