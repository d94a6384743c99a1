from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from pairflow import schemas
from pairflow.operators import sites, spatial


def rings(spark, shapes):
    rows = [(k, [(float(x), float(y)) for x, y in corners]) for k, corners in shapes.items()]
    return spark.createDataFrame(rows, schemas.POLYGONS)


SHAPES = {
    "square": [(0, 0), (0, 2), (2, 2), (2, 0), (0, 0)],
    "next": [(2, 0), (2, 2), (4, 2), (4, 0)],
    "corner": [(10, 10), (10, 13), (11, 13), (11, 11), (13, 11), (13, 10), (10, 10)],
    "tilted": [(5.5, 5.25), (9.0, 6.5), (6.25, 9.75), (5.5, 5.25)],
}


def area(corners):
    closed = corners if corners[0] == corners[-1] else [*corners, corners[0]]
    return abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(closed, closed[1:]))) / 2


def test_lambert(spark):
    df = spark.createDataFrame([(-97.0, 40.0), (-87.5, 33.2)], "x double, y double")
    a, b = spatial.to_lcc(df).collect()
    assert (a.x, a.y) == pytest.approx((0.0, 0.0), abs=1e-6)
    assert (b.x, b.y) == pytest.approx((870700.908, -687547.821), abs=1e-3)


def test_rings_are_projected_vertex_by_vertex(spark):
    got = spatial.ring_to_lcc(rings(spark, {"a": [(-97.0, 40.0), (-87.5, 33.2)]})).first().ring
    assert got[1].x == pytest.approx(870700.908, abs=1e-3)


def test_parts_and_bounds(spark):
    df = rings(spark, SHAPES)
    assert sorted(r.divide_id for r in spatial.parts_within_box(df, 0, 0, 4, 9).collect()) == ["next", "square"]
    assert tuple(spatial.bounds(df).first()) == (0.0, 0.0, 13.0, 13.0)


@pytest.mark.parametrize("cell", [0.7, 3.0, 100.0])
def test_points_in_polygons(spark, cell):
    points = [(0, 1.0, 1.0), (1, 3.0, 1.0), (2, 5.0, 1.0), (3, 12.0, 12.0), (4, 10.5, 12.0), (5, 6.5, 7.0), (6, 8.9, 9.0)]
    df = spark.createDataFrame(points, "point_id bigint, x double, y double")
    inside = spatial.points_in_polygons(df, rings(spark, SHAPES), cell)
    assert sorted(r.point_id for r in inside.collect()) == [0, 1, 4, 5]
    assert inside.columns == ["point_id", "x", "y"]
    found = spatial.locate_points(df, rings(spark, SHAPES), "divide_id", cell)
    assert {r.point_id: r.divide_id for r in found.collect()} == {0: "square", 1: "next", 4: "corner", 5: "tilted"}


def test_overlapping_parts_give_a_point_once(spark):
    df = spark.createDataFrame([(0, 1.0, 1.0)], "point_id bigint, x double, y double")
    both = rings(spark, {"a": SHAPES["square"], "b": SHAPES["square"]})
    assert spatial.points_in_polygons(df, both, 1.0).count() == 1
    assert spatial.locate_points(df, both, "divide_id", 1.0).count() == 2


def test_weights_sum_to_the_area(spark):
    rng = random.Random(11)
    shapes = dict(SHAPES)
    for k in range(20):
        # Star-shaped around a centre, so it does not cross itself.
        cx, cy, n = rng.uniform(-20, 20), rng.uniform(-20, 20), rng.randint(3, 9)
        turns = sorted(rng.uniform(0, 2 * math.pi) for _ in range(n))
        far = [rng.uniform(0.2, 6) for _ in range(n)]
        if max(b - a for a, b in zip(turns, [*turns[1:], turns[0] + 2 * math.pi])) > math.pi:
            continue
        shapes[f"star{k}"] = [(cx + r * math.cos(t), cy + r * math.sin(t)) for t, r in zip(turns, far)]
    got = spatial.cell_weights(rings(spark, shapes), x0=-3.0, y0=1.5, dx=1.5, dy=0.75)
    sums = {r.divide_id: r.s for r in got.groupBy("divide_id").agg(F.sum("w").alias("s")).collect()}
    for name, corners in shapes.items():
        assert sums[name] * 1.5 * 0.75 == pytest.approx(area(corners), rel=1e-9), name
    assert got.where("w > 1 + 1e-9").count() == 0


def test_weights_of_single_cells(spark):
    got = {(r.iy, r.ix): r.w for r in spatial.cell_weights(rings(spark, {"a": [(0.5, 0.5), (0.5, 2), (2, 2), (2, 0.5)]})).collect()}
    assert got == {(0, 0): 0.25, (0, 1): 0.5, (1, 0): 0.5, (1, 1): 1.0}


def test_parts_and_holes_of_one_polygon(spark):
    square = lambda x, y, w: [(x, y), (x, y + w), (x + w, y + w), (x + w, y), (x, y)]
    rows = [("a", square(0.0, 0.0, 0.5), None), ("a", square(0.5, 0.5, 0.5)[::-1], False), ("b", square(0.0, 0.0, 3.0), False), ("b", square(1.0, 1.0, 1.0), True)]
    polygons = spark.createDataFrame(rows, "divide_id string, ring array<struct<x: double, y: double>>, hole boolean")
    got = {(r.divide_id, r.iy, r.ix): r.w for r in spatial.cell_weights(polygons).collect()}
    assert got == {("a", 0, 0): 0.5, **{("b", y, x): 1.0 for y in range(3) for x in range(3) if (y, x) != (1, 1)}}
    points = spark.createDataFrame([(1, 0.25, 0.25), (2, 1.5, 1.5), (3, 2.5, 2.5), (4, 0.75, 0.75)], "id bigint, x double, y double")
    located = {(r.id, r.divide_id) for r in spatial.locate_points(points, polygons, "divide_id", 1.0).collect()}
    assert located == {(1, "a"), (1, "b"), (3, "b"), (4, "a"), (4, "b")}
    assert {r.id for r in spatial.points_in_polygons(points, polygons, 1.0).collect()} == {1, 3, 4}


def test_zonal_mean_leaves_missing_cells_out(spark):
    weights = spark.createDataFrame(
        [("a", 0, 0, 0.25), ("a", 0, 1, 0.5), ("b", 0, 1, 1.0), ("c", 9, 9, 1.0)],
        "divide_id string, iy bigint, ix bigint, w double",
    )
    cells = [(1, 0, 0, 4.0, 1.0), (1, 0, 1, 8.0, float("nan")), (2, 0, 0, None, 3.0), (2, 0, 1, None, 5.0)]
    forcing = spark.createDataFrame(cells, "time int, iy int, ix int, rain double, wind double")
    got = {(r.time, r.divide_id): (r.rain, r.wind) for r in spatial.zonal_mean(forcing, weights, ["rain", "wind"]).collect()}
    assert got == {
        (1, "a"): (pytest.approx((4 * 0.25 + 8 * 0.5) / 0.75), 1.0),
        (1, "b"): (8.0, None),
        (2, "a"): (None, pytest.approx((3 * 0.25 + 5 * 0.5) / 0.75)),
        (2, "b"): (None, 5.0),
    }


def site_rows(spark, dus):
    rows = [(i, f"c{i}", du, float(i), float(-i), 100 + i) for i, du in enumerate(dus)]
    return spark.createDataFrame(rows, schemas.SITES)


def test_pair_numbers_and_attribute_keys(spark):
    df = site_rows(spark, "dududu")
    assert [r.pair_id for r in sites.with_pair_id(df).orderBy("pos").collect()] == [0, 0, 1, 1, 2, 2]
    keys = lambda dus: [r.ds_catid for r in sites.attribute_key(site_rows(spark, dus)).orderBy("pos").collect()]
    assert keys("dududu") == ["c0", "c0", "c2", "c2", "c4", "c4"]
    # An odd list: the row above counts, whatever it is.
    assert keys("uddu") == [None, "c1", "c2", "c2"]


@pytest.mark.parametrize(
    "down,length,want",
    [
        (12, 25, [i for i in range(2, 22) if i != 12]),
        (3, 25, [i for i in range(13) if i != 3]),
        (20, 25, [i for i in range(10, 25) if i != 20]),
        (0, 1, []),
    ],
)
def test_upstream_candidates(spark, down, length, want):
    rows = [(f"c{down}", f"c{i}", i, float(i), float(i)) for i in range(length)]
    df = spark.createDataFrame(rows, "ds_catid string, divide_id string, idx bigint, X double, Y double")
    assert sorted(r.idx for r in sites.upstream_candidates(df).collect()) == want
    picked = sites.select_pairs(df).collect()
    assert len(picked) == (1 if want else 0)
    assert all(int(p.us_catid[1:]) in want for p in picked)
    listed = sites.pair_list(df).orderBy("pos").collect()
    assert [r.du for r in listed] == (["d", "u"] if want else [])
    assert [r.pos for r in listed] == ([0, 1] if want else [])


def test_picks_differ_by_seed(spark):
    rows = [("c0", f"c{i}", i, 0.0, 0.0) for i in range(11)]
    df = spark.createDataFrame(rows, "ds_catid string, divide_id string, idx bigint, X double, Y double")
    assert len({sites.select_pairs(df, str(s)).first().us_catid for s in range(12)}) > 3


def test_points_of_a_box(spark):
    got = sites.random_points(spark, 10_000, -10.0, 5.0, 10.0, 6.0, seed=1)
    x = got.agg(F.min("x"), F.max("x"), F.avg("x"), F.min("y"), F.max("y"), F.count("*")).first()
    assert -10 <= x[0] < -9.9 and 9.9 < x[1] < 10 and abs(x[2]) < 0.3 and 5 <= x[3] and x[4] < 6 and x[5] == 10_000
    triangle = rings(spark, {"t": [(-10, 5), (10, 5), (0, 6)]})
    assert spatial.points_in_polygons(got, triangle, 1.0).count() == pytest.approx(5000, rel=0.05)


def test_id_batches_and_missing_ids(spark):
    ids = spark.createDataFrame([(i, i % 4) for i in range(23)], "pos bigint, feature_id bigint")
    assert {r.batch_start for r in sites.id_batches(ids).collect()} == {0, 10, 20}
    flow = spark.createDataFrame([(0,), (2,), (2,)], "feature_id bigint")
    assert sorted(r.feature_id for r in sites.missing_ids(ids, flow).collect()) == [1, 3]


def _plain_inside(corners, x, y):
    closed = corners if corners[0] == corners[-1] else [*corners, corners[0]]
    odd = False
    for (ax, ay), (bx, by) in zip(closed, closed[1:]):
        if (ay > y) != (by > y):
            odd ^= x < ax + (y - ay) * (bx - ax) / (by - ay)
    return odd


@pytest.mark.parametrize("cell", [0.5, 1.0, 2.5])
def test_points_equal_a_ray_test_on_the_grid_and_off_it(spark, cell):
    """Vertices, edges and points on grid lines, rings that cross themselves, degenerate rings."""
    rng = random.Random(11)
    near = lambda: rng.choice([rng.randint(-4, 4) * 0.5, rng.uniform(-2, 2)])
    shapes = {f"r{i}": [(near(), near()) for _ in range(rng.randint(1, 9))] for i in range(60)}
    shapes["line"] = [(0.0, 0.0), (1.0, 0.0), (0.0, 0.0)]
    points = [(i, near() + rng.choice([0, 0.013]), near() + rng.choice([0, 0.017])) for i in range(250)]
    df = spark.createDataFrame(points, "id bigint, x double, y double")
    got = {(r.id, r.divide_id) for r in spatial.locate_points(df, rings(spark, shapes), "divide_id", cell).collect()}
    assert got == {(i, k) for i, x, y in points for k, c in shapes.items() if _plain_inside(c, x, y)}


def test_join_squares_follow_the_rings_and_not_the_given_side(spark):
    """Many small rings in one square of the given side: each square of the join holds a few of them."""
    shapes = {f"r{i}": [(i % 40, i // 40), (i % 40 + 1.5, i // 40), (i % 40, i // 40 + 1.5)] for i in range(1600)}
    rng = random.Random(3)
    points = [(i, rng.uniform(0, 40), rng.uniform(0, 40)) for i in range(20_000)]
    df = spark.createDataFrame(points, "id bigint, x double, y double")
    side = spatial._join_side(df, rings(spark, shapes), 1000.0, "ring")
    index = spatial.edge_index(rings(spark, shapes), ["divide_id"], side)
    per_square = index.groupBy("__cx", "__cy").count().agg(F.max("count")).first()[0]
    assert per_square < 20 and index.count() < 20_000
    assert spatial._join_side(df.limit(5), rings(spark, shapes), 1000.0, "ring") == 1000.0
    got = {(r.id, r.divide_id) for r in spatial.locate_points(df, rings(spark, shapes), "divide_id", 1000.0).where("id < 100").collect()}
    assert got == {(i, k) for i, x, y in points[:100] for k, c in shapes.items() if _plain_inside(c, x, y)}


@pytest.mark.parametrize("cell", [0.5, 8.0])
def test_parts_and_holes_that_overlap(spark, cell):
    """In a part and in no hole of the same id, over parts, holes, equal points and ids that are null."""
    rng = random.Random(5)
    ring = lambda: [(rng.uniform(0, 10), rng.uniform(0, 10)) for _ in range(rng.randint(3, 5))]
    rows = [(rng.choice(["a", "b", "c", None]), ring(), rng.choice([False, False, None, True])) for _ in range(16)]
    rows.append(("a", [(1.0, 1.0), (1.0, 9.0), (9.0, 9.0), (9.0, 1.0)], False))
    rows.append(("b", [(0.0, 0.0), (0.0, 10.0), (10.0, 10.0), (10.0, 0.0)], True))
    polygons = spark.createDataFrame(rows, "divide_id string, ring array<struct<x double, y double>>, hole boolean")
    points = [(i // 2, *p) for i, p in enumerate(p for p in [(rng.uniform(-1, 11), rng.uniform(-1, 11)) for _ in range(300)] for _ in range(2))]
    points.append((9999, float("nan"), 5.0))
    df = spark.createDataFrame(points, "id bigint, x double, y double")
    want = {
        (i, d)
        for i, x, y in points
        for d in {r[0] for r in rows}
        if any(_plain_inside(c, x, y) for e, c, h in rows if e == d and not h)
        and not any(_plain_inside(c, x, y) for e, c, h in rows if e == d and h)
    }
    found = [(r.id, r.divide_id) for r in spatial.locate_points(df, polygons, "divide_id", cell).collect()]
    assert len(found) == len(set(found)) and set(found) == want
    inside = [r.id for r in spatial.points_in_polygons(df, polygons, cell).collect()]
    assert sorted(inside) == sorted({i for i, _ in want})


def test_a_point_meets_one_row_of_a_square(spark, monkeypatch):
    """Overlapping polygons stand in one row of their square, and each point inside gets a row for each of them."""
    seen, lookup = [], spatial.lookup
    monkeypatch.setattr(spatial, "lookup", lambda df, table, *a, **k: seen.append(table) or lookup(df, table, *a, **k))
    rng = random.Random(8)
    shapes = {f"r{i}": [(rng.uniform(0, 9), rng.uniform(0, 9)) for _ in range(3)] for i in range(200)}
    points = [(i // 2, rng.uniform(0, 9), rng.uniform(0, 9)) for i in range(40)]
    df = spark.createDataFrame(points, "id bigint, x double, y double")
    got = [(r.id, r.x, r.divide_id) for r in spatial.locate_points(df, rings(spark, shapes), "divide_id", 3.0).collect()]
    assert sorted(got) == sorted((i, x, k) for i, x, y in points for k, c in shapes.items() if _plain_inside(c, x, y))
    assert seen and all(t.groupBy("__cx", "__cy").count().where("count > 1").isEmpty() for t in seen)


@pytest.mark.parametrize("limits", [{}, {"SQUARE_BYTES": 300, "MAX_BROADCAST_BYTES": 0, "HOT_POINTS": 5}])
def test_squares_of_few_and_of_many_edges(spark, monkeypatch, limits):
    """Parts and holes with up to four edges in a square and with more, in one row a square and in several."""
    for name, value in limits.items():
        monkeypatch.setattr(spatial, name, value)
    rng = random.Random(21)
    at = lambda: rng.choice([rng.randint(0, 16) * 0.25, rng.uniform(0, 4)])
    rows = [(rng.choice(["a", "b", "c", "d", None]), [(at(), at()) for _ in range(rng.randint(3, 4))], rng.choice([False, False, None, True])) for _ in range(14)]
    rows.append(("e", [(at(), at()) for _ in range(40)], False))
    polygons = spark.createDataFrame(rows, "divide_id string, ring array<struct<x double, y double>>, hole boolean")
    points = [(i, at(), at()) for i in range(300)]
    df = spark.createDataFrame(points, "id bigint, x double, y double")
    table = spatial._without_holes(spatial.edge_index(polygons.withColumn("__hole", F.coalesce("hole", F.lit(False))), ["divide_id", "__hole"], 0.5), "divide_id")
    edges = F.size(F.flatten(F.concat(F.col("__parts")["__edges"], F.col("__holes")["__edges"])))
    assert {r.n for r in table.select(F.least(edges, F.lit(5)).alias("n")).distinct().collect()} == {0, 1, 2, 3, 4, 5}
    want = {
        (i, d)
        for i, x, y in points
        for d in {r[0] for r in rows}
        if any(_plain_inside(c, x, y) for e, c, h in rows if e == d and not h)
        and not any(_plain_inside(c, x, y) for e, c, h in rows if e == d and h)
    }
    found = [(r.id, r.divide_id) for r in spatial.locate_points(df, polygons, "divide_id", 0.5).collect()]
    assert len(found) == len(set(found)) and set(found) == want
    single = polygons.drop("hole")
    located = [(r.id, r.divide_id) for r in spatial.locate_points(df, single, "divide_id", 0.5).collect()]
    assert sorted(located, key=str) == sorted(((i, d) for i, x, y in points for d, c, _ in rows if _plain_inside(c, x, y)), key=str)


def test_a_square_that_a_polygon_covers_is_one_row(spark):
    shapes = {f"r{i}": [(-i, -i), (-i, 50 + i), (50 + i, 50 + i), (50 + i, -i)] for i in range(1, 30)}
    index = spatial.edge_index(rings(spark, shapes), [], 5.0)
    once = spatial._once_covered(index, F.col("__inside") & (F.size("__edges") == 0))
    inner = once.where("__cx between 0 and 9 and __cy between 0 and 9")
    assert index.where("__cx = 4 and __cy = 4").count() == 29 and inner.count() == 100


def test_zonal_mean_of_a_small_forcing_sums_polygon_by_polygon(spark):
    """Sums of (time, polygon) never travel, so a task holds those of its own polygons only."""
    forcing = spark.createDataFrame([(t, y, x, float(t + y * x)) for t in range(3) for y in range(2) for x in range(2)], "time int, iy int, ix int, rain double")
    weights = spark.createDataFrame([(f"c{i}", i % 2, x, 0.5) for i in range(50) for x in range(2)], "divide_id string, iy int, ix int, w double")
    out = spatial.zonal_mean(forcing, weights, ["rain"])
    got = {(r.time, r.divide_id): r.rain for r in out.collect()}
    assert got == {(t, f"c{i}"): t + (i % 2) / 2 for t in range(3) for i in range(50)}
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(divide_id" in plan and "hashpartitioning(time" not in plan


def test_equal_rings_stay_apart(spark):
    polygons = rings(spark, {"a": SHAPES["square"]})
    df = spark.createDataFrame([(1, 1.0, 1.0)], "id bigint, x double, y double")
    assert spatial.locate_points(df, polygons.unionByName(polygons), "divide_id", 0.7).count() == 2


def test_a_long_ring_makes_rows_by_its_edges(spark):
    """100,000 vertices over about 10,000 squares: edges are listed where they are, not in every square."""
    n = 100_000
    star = [(50 + (40 + 9 * math.sin(40 * t)) * math.cos(t), 50 + (40 + 9 * math.sin(40 * t)) * math.sin(t)) for t in (2 * math.pi * i / n for i in range(n))]
    index = spatial.edge_index(rings(spark, {"star": star}), ["divide_id"], 1.0)
    squares, listed, most = index.agg(F.count("*"), F.sum(F.size("__edges")), F.max(F.size("__edges"))).first()
    assert 5_000 < squares < 10_000
    assert listed < 1.1 * n and most < 2_000
    rng = random.Random(2)
    points = [(i, rng.uniform(0, 100), rng.uniform(0, 100)) for i in range(60)]
    df = spark.createDataFrame(points, "id bigint, x double, y double")
    got = {r.id for r in spatial.points_in_polygons(df, rings(spark, {"star": star}), 1.0).collect()}
    assert got == {i for i, x, y in points if _plain_inside(star, x, y)}


def test_cover_makes_rows_by_edges_crossed_and_cells_covered(spark, monkeypatch):
    """A thin bar far above the ring's floor adds nothing below it: the sum runs over events only."""
    tall = [(0.0, 0.0), (0.0, 1.0), (50.25, 1.0), (50.25, 900.0), (51.5, 900.0), (51.5, 0.0)]
    comb = [p for i in range(100) for p in ((i, 1000.0), (i + 0.5, 1002.0))] + [(100.0, 1000.0), (100.0, 0.5), (0.0, 0.5)]
    seen = []
    events = spatial._column_events
    monkeypatch.setattr(spatial, "_column_events", lambda *a: seen.append(events(*a)) or seen[-1])
    for shape, cells in ((tall, 50 + 2 * 900), (comb, 100 * 1002)):
        got = spatial.cell_weights(rings(spark, {"a": shape}))
        rows, total = got.agg(F.count("*"), F.sum("w")).first()
        assert total == pytest.approx(area(shape), rel=1e-12)
        assert cells * 0.99 < rows <= cells + 200
        assert seen.pop().count() < 3_000


def test_cover_of_gaps_and_tilted_edges(spark):
    """Columns that a ring leaves and enters again, cell by cell against the area of the clipped ring."""
    shape = [(0.3, 0.2), (4.7, 0.9), (4.1, 9.6), (3.2, 9.9), (3.5, 2.2), (1.6, 1.9), (1.2, 8.3), (0.1, 7.7)]

    def clipped(corners, side, keep):
        out = []
        for p, q in zip(corners, corners[1:] + corners[:1]):
            inp, inq = keep(p), keep(q)
            if inp:
                out.append(p)
            if inp != inq:
                axis, at = side
                t = (at - p[axis]) / (q[axis] - p[axis])
                out.append(tuple(at if k == axis else p[k] + t * (q[k] - p[k]) for k in (0, 1)))
        return out

    want = {}
    for ix in range(5):
        for iy in range(10):
            c = shape
            for side, keep in (((0, ix), lambda p: p[0] >= ix), ((0, ix + 1), lambda p: p[0] <= ix + 1), ((1, iy), lambda p: p[1] >= iy), ((1, iy + 1), lambda p: p[1] <= iy + 1)):
                c = clipped(c, side, keep) if c else c
            if c and area(c) > 1e-9:
                want[iy, ix] = area(c)
    for corners in (shape, shape[::-1]):
        got = {(r.iy, r.ix): r.w for r in spatial.cell_weights(rings(spark, {"a": corners})).collect()}
        assert got == pytest.approx(want, abs=1e-12)
