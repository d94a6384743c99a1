"""Whitening of embeddings by their principal components, without forming a covariance to solve.

The centred rows are reduced to one triangle by blockwise QR: a triangle per block, then triangles of triangles. The
triangle is made bidiagonal by Householder reflections, its singular values are found by differential qd steps (dqds, high
relative accuracy), and each right singular vector by a twisted factorisation of the shifted bidiagonal product.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairflow.llm.common import quoted, stored, table

COMPONENTS = 8
SCALE, SHIFT = 1024, 100_000
"""An entry c counts as floor(SCALE * c) + SHIFT."""
LARGEST = 1 << 52
"""Scaled entries beyond this, either way, count as this."""
FAN = 64
"""Triangles that one task makes into one."""
EPS = np.finfo(np.float64).eps


# --- the solver: numpy on one triangle ----------------------------------------------------------


def triangle(rows: np.ndarray) -> np.ndarray:
    """The R of a QR of the rows: R'R equals their sums of products."""
    return np.linalg.qr(rows, mode="r")


def _reflector(x: np.ndarray) -> tuple[np.ndarray, float]:
    """(v, alpha): the reflection by unit ``v`` takes x to (alpha, 0, ...); a null v where nothing need be done."""
    norm = np.linalg.norm(x)
    if norm == 0 or np.linalg.norm(x[1:]) == 0:
        return np.zeros_like(x), float(x[0])
    alpha = -np.copysign(norm, x[0])
    v = x.copy()
    v[0] -= alpha
    return v / np.linalg.norm(v), float(alpha)


def bidiagonal(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(diagonal, upper diagonal, right reflections): r = U B V', with V the product of the reflections.

    Reflection k acts on the coordinates from k + 1 on.
    """
    a = r.astype(np.float64).copy()
    n = a.shape[1]
    if len(a) < n:
        a = np.vstack([a, np.zeros((n - len(a), n))])
    d, e, right = np.zeros(n), np.zeros(max(0, n - 1)), []
    for k in range(n):
        v, d[k] = _reflector(a[k:, k])
        a[k:, k:] -= 2 * np.outer(v, v @ a[k:, k:])
        if k < n - 1:
            w, e[k] = _reflector(a[k, k + 1 :])
            a[k:, k + 1 :] -= 2 * np.outer(a[k:, k + 1 :] @ w, w)
            right.append(w)
    return d, e, right


def _dqds(q: np.ndarray, e: np.ndarray, shift: float) -> tuple[list[float], list[float], int]:
    """One differential qd step: (q, e, place of the first negative q, or -1 where the shift was below all values)."""
    out_q, out_e = [], []
    d = q[0] - shift
    for i in range(len(e)):
        if d < 0:
            return [*out_q, d], out_e, i
        both = d + e[i]
        ratio = q[i + 1] / both if both > 0 else 1.0
        out_q.append(both)
        out_e.append(e[i] * ratio if both > 0 else 0.0)
        d = d * ratio - shift if both > 0 else q[i + 1] - shift
    return [*out_q, d], out_e, (len(e) if d < 0 else -1)


def singular_squares(diagonal: np.ndarray, upper: np.ndarray) -> np.ndarray:
    """Squares of the singular values of an upper bidiagonal matrix, falling.

    A qd step without subtractions but for its shift keeps every value to high relative accuracy. The shift is to
    be just below the least value left: it is guessed from the last two entries; a guess that proves too large says by how
    much where only the last entry turned negative, else it is quartered, and at last it is zero. A value is done when the
    entry beside it no longer counts; entries inside that no longer count part the problem in two.
    """
    found: list[float] = []
    stack = [((diagonal.astype(np.float64) ** 2).tolist(), (upper.astype(np.float64) ** 2).tolist(), 0.0)]
    small = (10 * EPS) ** 2
    while stack:
        q, e, moved = stack.pop()
        if len(q) == 1:
            found.append(moved + q[0])
            continue
        cut = next((i for i in range(len(e) - 1, -1, -1) if e[i] <= small * (moved + min(q[i], q[i + 1]))), None)
        if cut is not None:
            stack += [(q[: cut + 1], e[:cut], moved), (q[cut + 1 :], e[cut + 1 :], moved)]
            continue
        if 1.5 * q[0] < q[-1]:
            q, e = q[::-1], e[::-1]  # the same values, the least ones at the end
        guess = _two(q[-2], q[-2] * e[-1], q[-1] + e[-1]) * (1 - 4 * EPS)
        for tries in range(8):
            new_q, new_e, bad = _dqds(q, e, guess)
            if bad < 0:
                break
            guess = max(0.0, (guess + new_q[-1]) * (1 - 4 * EPS)) if bad == len(e) and tries < 3 else guess / 4 if tries < 6 else 0.0
        stack.append((new_q, new_e, moved + guess))
    return np.sort(np.array(found))[::-1]


def _two(a: float, bb: float, c: float) -> float:
    """The lesser eigenvalue of [[a, b], [b, c]], ``bb`` being b squared."""
    half = (a + c) / 2
    root = np.hypot((a - c) / 2, np.sqrt(bb))
    top = half + root
    return (a * c - bb) / top if top > 0 else 0.0


def twisted_vector(diagonal: np.ndarray, upper: np.ndarray, square: float) -> np.ndarray:
    """The unit vector z with B'B z = square z, for a bidiagonal B none of whose entries beside the diagonal is zero.

    B'B - square is factored from the top (stationary qd) and from the bottom (progressive qd); where the two meet with the
    least pivot, z is 1, and the factors give its other entries by products alone.
    """
    n = len(diagonal)
    if n == 1:
        return np.ones(1)
    tiny = np.finfo(np.float64).tiny / EPS
    q, e = diagonal**2, upper**2
    off = diagonal[:-1] * upper  # B'B beside its diagonal
    # L D L' with D = q, L = off / q: shifted from the top.
    down, s = np.empty(n), -square
    above = np.empty(n)
    for i in range(n):
        above[i] = s
        down[i] = q[i] + s
        if i < n - 1:
            pivot = down[i] if abs(down[i]) > tiny else np.copysign(tiny, down[i] or 1.0)
            down[i] = pivot
            s = e[i] * (s / pivot) - square
    # U D U' from the bottom.
    up, below = np.empty(n), np.empty(n)
    p = q[-1] - square
    for i in range(n - 1, -1, -1):
        below[i] = p
        if i > 0:
            up[i] = e[i - 1] + p
            if abs(up[i]) < tiny:
                up[i] = np.copysign(tiny, up[i] or 1.0)
            p = q[i - 1] * (p / up[i]) - square
    gamma = above + below + square
    r = int(np.argmin(np.abs(gamma)))
    z = np.zeros(n)
    z[r] = 1.0
    for i in range(r - 1, -1, -1):
        z[i] = -(off[i] / down[i]) * z[i + 1]
    for i in range(r, n - 1):
        z[i + 1] = -(off[i] / up[i + 1]) * z[i]
    return z / np.linalg.norm(z)


def principal(r: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray, float]:
    """(eigenvalues, unit vectors as columns, trace) of R'R: the ``count`` greatest, without those that are zero.

    Values so close that their vectors are not told apart are orthogonalised against each other; where that leaves little
    of a vector, it is found again from another start.
    """
    n = r.shape[1]
    scale = float(np.abs(r).max()) if r.size else 0.0
    if n == 0 or scale == 0 or not np.isfinite(scale):
        return np.zeros(0), np.zeros((n, 0)), 0.0
    d, e, right = bidiagonal(r / scale)
    norm = max(np.abs(d).max(), np.abs(e).max() if len(e) else 0.0)
    # Parts that nothing joins are solved one by one; a zero on the diagonal is too small to matter beside its norm.
    d = np.where(np.abs(d) < EPS * norm * EPS, EPS * norm * EPS, d)
    edges = [0, *(np.flatnonzero(np.abs(e) <= EPS * norm * 0.1) + 1).tolist(), n]
    pairs = []
    for a, b in zip(edges, edges[1:]):
        pairs += [(s, a, b) for s in singular_squares(d[a:b], e[a : b - 1])]
    pairs.sort(key=lambda x: -x[0])
    total = float(sum(s for s, _, _ in pairs))
    kept = [p for p in pairs[:count] if p[0] > (n * EPS * norm) ** 2]
    rng = np.random.default_rng(1)
    vectors: list[np.ndarray] = []
    for s, a, b in kept:
        z = np.zeros(n)
        z[a:b] = twisted_vector(d[a:b], e[a : b - 1], s)
        near = [v for (t, _, _), v in zip(kept, vectors) if abs(t - s) <= 1e-3 * max(s, t)]
        for _ in range(6):
            for v in near + near:
                z -= (v @ z) * v
            size = np.linalg.norm(z)
            if size > 0.5:
                break
            z = np.zeros(n)
            z[a:b] = _solved(d[a:b], e[a : b - 1], s, rng.standard_normal(b - a), [v[a:b] for v in near])
        vectors.append(z / np.linalg.norm(z))
    out = np.array(vectors).T.reshape(n, len(vectors))
    for k in range(len(right) - 1, -1, -1):
        out[k + 1 :] -= 2 * np.outer(right[k], right[k] @ out[k + 1 :])
    return np.array([s for s, _, _ in kept]) * scale**2, out, total * scale**2


def _solved(d: np.ndarray, e: np.ndarray, square: float, start: np.ndarray, near: list[np.ndarray]) -> np.ndarray:
    """Inverse iteration on B'B - square, kept orthogonal to vectors already found."""
    n = len(d)
    m = np.zeros((n, n))
    m[np.arange(n), np.arange(n)] = d**2 + np.concatenate([[0], e**2]) - square * (1 + 4 * EPS)
    m[np.arange(n - 1), np.arange(1, n)] = m[np.arange(1, n), np.arange(n - 1)] = d[:-1] * e
    z = start
    for _ in range(3):
        for v in near + near:
            z = z - (v @ z) * v
        z = np.linalg.lstsq(m, z / np.linalg.norm(z), rcond=EPS * 1e-3)[0]
    for v in near + near:
        z = z - (v @ z) * v
    return z / max(np.linalg.norm(z), np.finfo(np.float64).tiny)


# --- Spark ---------------------------------------------------------------------------------------


def scaled(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, places, matrix of whole numbers) of a batch's vectors, by length.

    Without those that are null, hold null or non-finite entries, or have no entries.
    """
    sizes = column.value_lengths().fill_null(0).to_numpy()
    values = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    starts = np.cumsum(sizes) - sizes
    for dim in np.unique(sizes[sizes > 0]).tolist():
        at = np.flatnonzero(sizes == dim)
        x = values[starts[at][:, None] + np.arange(dim)]
        good = np.isfinite(x).all(1)
        if good.any():
            x = np.clip(np.floor(SCALE * np.clip(x[good], -LARGEST, LARGEST)), -LARGEST, LARGEST)
            yield dim, at[good], x.astype(np.int64) + SHIFT


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - S, exact: as 64-bit numbers where they fit, else as Python's."""
    bound = n * int(np.abs(x).max(initial=0)) + max(map(abs, sums), default=0)
    if bound < 1 << 63:
        return n * x - np.array(sums, np.int64)
    return n * x.astype(object) - np.array(sums, object)


def deviations(c: np.ndarray) -> list[int | None]:
    """Sums of squares, exact; null where one passes 64 bits."""
    most = int(np.abs(c).max(initial=0))
    if c.dtype != object and most * most * max(1, c.shape[1]) < 1 << 63:
        return (c * c).sum(1).tolist()
    exact = [sum(int(v) * int(v) for v in row) for row in c]
    return [s if s < 1 << 63 else None for s in exact]


def _sums(vectors: DataFrame) -> dict[int, tuple[int, list[int]]]:
    """Vectors and exact sums of each length: one small row a task, entry and length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[int, np.ndarray]] = {}
        for b in batches:
            for dim, at, x in scaled(b.column(0)):
                n, sums = held.get(dim, (0, np.zeros(dim, object)))
                fits = int(np.abs(x).max()) * len(at) < 1 << 63
                held[dim] = n + len(at), sums + (x if fits else x.astype(object)).sum(0).astype(object)
        for dim, (n, sums) in held.items():
            high = [int(s) >> 32 for s in sums]
            low = [int(s) & 0xFFFFFFFF for s in sums]
            yield pa.RecordBatch.from_arrays(
                [pa.array([dim] * dim, pa.int32()), pa.array(range(dim), pa.int32()), pa.array([n] * dim, pa.int64()), pa.array(high, pa.int64()), pa.array(low, pa.int64())],
                ["dim", "entry", "n", "high", "low"],
            )

    parts = vectors.mapInArrow(run, "dim int, entry int, n bigint, high bigint, low bigint")
    rows = parts.groupBy("dim", "entry").agg(*[F.sum(c).alias(c) for c in ("n", "high", "low")]).collect()
    out: dict[int, tuple[int, list[int]]] = {}
    for r in sorted(rows, key=lambda r: (r["dim"], r["entry"])):
        out.setdefault(r["dim"], (r["n"], []))[1].append((r["high"] << 32) + r["low"])
    return out


def _triangles(vectors: DataFrame, sums: dict[int, tuple[int, list[int]]]) -> DataFrame:
    """(dim, part, r): a triangle for each task and length, then one for every ``FAN`` of them, down to one a length."""
    schema = "dim int, part bigint, r binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for b in batches:
            for dim, _, x in scaled(b.column(0)):
                n, s = sums[dim]
                rows = centred(x, n, s).astype(np.float64) / n
                held[dim] = triangle(np.vstack([held[dim], rows]) if dim in held else rows)
        part = TaskContext.get().partitionId()
        for dim, r in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([part], pa.int64()), pa.array([r.tobytes()], pa.binary())], ["dim", "part", "r"])

    def join(group: pa.Table) -> pa.Table:
        dim = group["dim"][0].as_py()
        out = np.zeros((0, dim))
        # In the order of the parts, so that a rerun rounds alike.
        for r in group.sort_by("part")["r"]:
            out = triangle(np.vstack([out, np.frombuffer(r.as_py()).reshape(-1, dim)]))
        return pa.table({"dim": pa.array([dim], pa.int32()), "part": pa.array([group["part"][0].as_py() // FAN], pa.int64()), "r": pa.array([out.tobytes()], pa.binary())})

    rows = stored(vectors.mapInArrow(run, schema))
    left = 1 + (rows.agg(F.max("part").alias("m")).first()["m"] or 0)
    while left > 1:
        rows = rows.groupBy("dim", F.floor(F.col("part") / FAN).alias("fan")).applyInArrow(join, schema)
        left = -(-left // FAN)
    return rows


def _solve(triangles: DataFrame, sums: dict[int, tuple[int, list[int]]], components: int) -> dict[int, tuple[np.ndarray, np.ndarray, float]]:
    """(eigenvalues, vectors, trace) of each length's covariance, solved in tasks; the driver gets ``components`` vectors a length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for dim, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                values, vectors, trace = principal(np.frombuffer(raw).reshape(-1, dim) / np.sqrt(sums[dim][0]), components)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([dim], pa.int32()), pa.array([values.tolist()], pa.list_(pa.float64())), pa.array([vectors.T.ravel().tolist()], pa.list_(pa.float64())), pa.array([trace], pa.float64())],
                    ["dim", "e", "v", "trace"],
                )

    found = triangles.select("dim", "r").mapInArrow(run, "dim int, e array<double>, v array<double>, trace double").collect()
    return {r["dim"]: (np.array(r["e"]), np.array(r["v"]).reshape(len(r["e"]), r["dim"]).T, r["trace"]) for r in found}


def whiten(df: DataFrame, id_: str, vector: str, components: int = COMPONENTS) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error): a row per vector and component.

    Vectors that are null or hold null or non-finite entries stay out; so do those without entries. Entries count as
    ``floor(SCALE * c) + SHIFT``, those beyond ``LARGEST`` as that. Vectors of each length are fitted by themselves.
    Components whose eigenvalue is zero (fewer vectors than entries, all alike) have no rows, so equal vectors alone
    have none at all. ``deviation`` is null where it passes 64 bits. Repeated rows count as often as they stand; null ids
    are kept. Only the two columns named are read. The driver holds ``components`` vectors for each length that occurs.
    """
    rows = df.select(F.col(quoted(id_)).alias("id"), F.col(quoted(vector)).alias("v"))
    vectors = rows.select("v")
    sums = _sums(vectors)
    models = _solve(_triangles(vectors, sums), sums, components) if sums else {}

    def projected(x: np.ndarray, dim: int) -> tuple[np.ndarray, np.ndarray]:
        n, s = sums[dim]
        e, v, _ = models[dim]
        c = centred(x, n, s)
        return c, (c.astype(np.float64) / n) @ v / np.sqrt(e)

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for b in batches:
            for dim, _, x in scaled(b.column(0)):
                w = projected(x, dim)[1]
                # Sums beside the products, to centre the covariance by.
                w = np.hstack([w, np.ones((len(w), 1))])
                held[dim] = held.get(dim, 0) + w.T @ w
        for dim, m in held.items():
            i, j = np.indices(m.shape)
            k = m.size
            yield pa.RecordBatch.from_arrays(
                [pa.array([dim] * k, pa.int32()), pa.array(i.ravel(), pa.int32()), pa.array(j.ravel(), pa.int32()), pa.array(m.ravel())], ["dim", "i", "j", "m"]
            )

    errors: dict[int, float] = {}
    products: dict[int, dict[tuple[int, int], float]] = {}
    for r in vectors.mapInArrow(second, "dim int, i int, j int, m double").groupBy("dim", "i", "j").agg(F.sum("m").alias("m")).collect() if models else []:
        products.setdefault(r["dim"], {})[r["i"], r["j"]] = r["m"]
    for dim, cells in products.items():
        k = len(models[dim][0])
        m = np.array([[cells[i, j] for j in range(k + 1)] for i in range(k + 1)]) / sums[dim][0]
        errors[dim] = float(np.abs(m[:k, :k] - np.outer(m[:k, k], m[:k, k]) - np.eye(k)).max(initial=0.0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for dim, at, x in scaled(b.column(1)):
                e, _, trace = models[dim]
                k = len(e)
                if not k:
                    continue
                c, w = projected(x, dim)
                ids = b.column(0).take(pa.array(np.repeat(at, k)))
                yield pa.RecordBatch.from_arrays(
                    [
                        ids,
                        pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(at))),
                        pa.array(np.full(len(at) * k, sums[dim][0]), pa.int64()),
                        pa.array([d for d in deviations(c) for _ in range(k)], pa.int64()),
                        pa.array(w.ravel()),
                        pa.array(np.tile(e / trace, len(at))),
                        pa.array(np.full(len(at) * k, errors[dim])),
                    ],
                    ["id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    kind = rows.schema["id"].dataType.simpleString()
    schema = f"id {kind}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_)


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every embedding on the first eight whitened components of all of them."""
    return whiten(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
