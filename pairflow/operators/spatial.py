"""Points, catchment rings and the forcing grid."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairflow.functions import geometry
from pairflow.functions.expr import lambert, named, ratio
from pairflow.operators.joins import lookup
from pairflow.session import MAX_BROADCAST_BYTES, fits, materialize, stage

LEAST_SHARE = 1e-9
"""Share of a cell up to which a polygon only touches it."""

SQUARES_PER_EDGE, HALVINGS = 16, 12
"""Squares that the join grid may have in the boxes of all rings, for each of their edges; halvings of its side."""

SLOTS = (2, 4)
"""Edges of a polygon in a square up to which its test there is compiled, with few or with more of them at hand."""

VARIABLES = (0xAAAA, 0xCCCC, 0xF0F0, 0xFF00)
"""Truth tables of the variables that ``SLOTS`` edges are: bit k is the variable's value in case k."""

ALWAYS = 0xFFFF
"""Truth table of what holds in every case."""

SQUARE_BYTES, HOT_POINTS, TASK_POINTS = 1 << 20, 100_000, 250_000
"""Bytes that a row of a square's polygons holds, more or less; points of a square above which they are spread; points of a task."""


def to_lcc(df: DataFrame, lon: str = "x", lat: str = "y", x: str = "x", y: str = "y") -> DataFrame:
    """Project longitude and latitude columns to the forcing grid's metres."""
    px, py = lambert(F.col(lon), F.col(lat))
    return df.withColumns({x: px, y: py})


def ring_to_lcc(polygons: DataFrame, ring: str = "ring") -> DataFrame:
    """Project every vertex of a ring column."""

    def project(p: Column) -> Column:
        px, py = lambert(p["x"], p["y"])
        return F.struct(px.alias("x"), py.alias("y"))

    return polygons.withColumn(ring, F.transform(ring, project))


def parts_within_box(
    parts: DataFrame, x_min: float, y_min: float, x_max: float, y_max: float, ring: str = "ring"
) -> DataFrame:
    """Parts that lie wholly inside the rectangle."""
    return parts.where(geometry.within_box(F.col(ring), x_min, y_min, x_max, y_max))


def bounds(parts: DataFrame, ring: str = "ring") -> DataFrame:
    """One row with the bounding box of all parts."""
    b = parts.select(geometry.bbox(F.col(ring)).alias("b"))
    return b.agg(
        F.min("b.x_min").alias("x_min"),
        F.min("b.y_min").alias("y_min"),
        F.max("b.x_max").alias("x_max"),
        F.max("b.y_max").alias("y_max"),
    )


def _touched(edges: DataFrame, cell: float) -> DataFrame:
    """A row for each square (``__cx, __cy``) that an edge ``e`` crosses or all but touches."""
    pad = cell * 1e-6
    at = lambda v: F.floor(v / F.lit(cell)).cast("bigint")
    ax, ay, bx, by = (F.col(c) for c in ("e.a.x", "e.a.y", "e.b.x", "e.b.y"))
    by_column = edges.withColumn("__cx", F.explode(F.sequence(at(F.least(ax, bx) - pad), at(F.greatest(ax, bx) + pad))))
    # Height of the edge where it enters and leaves the column.
    side = lambda x: F.greatest(F.least(ax, bx), F.least(F.greatest(ax, bx), x))
    height = lambda x: F.when(ax == bx, ay).otherwise(ay + (side(x) - ax) / F.nullif(bx - ax, F.lit(0.0)) * (by - ay))
    first, last = height(F.col("__cx") * F.lit(cell) - pad), height((F.col("__cx") + 1) * F.lit(cell) + pad)
    low = F.when(ax == bx, F.least(ay, by)).otherwise(F.least(first, last)) - pad
    high = F.when(ax == bx, F.greatest(ay, by)).otherwise(F.greatest(first, last)) + pad
    return by_column.withColumn("__cy", F.explode(F.sequence(at(low), at(high))))


def _corners_inside(edges: DataFrame, cell: float) -> DataFrame:
    """``(__rid, __cx, __cy)``: squares whose lower left corner lies inside the ring.

    An edge is a row per grid line that it crosses, with the last corner to the left of it; between the
    first and second, third and fourth, ... of a line's crossings the corners are inside.
    """
    at = lambda v: F.floor(v / F.lit(cell)).cast("bigint")
    a, b = F.col("e.a"), F.col("e.b")
    lines = edges.withColumn(
        "__cy", F.explode(F.sequence(at(F.least(a["y"], b["y"])), at(F.greatest(a["y"], b["y"])) + 1))
    ).withColumn("__y", F.col("__cy") * F.lit(cell))
    met = lines.where((a["y"] > F.col("__y")) != (b["y"] > F.col("__y")))
    guess = at(a["x"] + (F.col("__y") - a["y"]) * (b["x"] - a["x"]) / F.nullif(b["y"] - a["y"], F.lit(0.0)))
    # Rounding may place the crossing one corner off; the corners beside it settle that by the rule used for points.
    left_of = lambda i: geometry.right_of(F.col("e"), i * F.lit(cell), F.col("__y"))
    g = F.col("__g")
    last = F.when(left_of(g + 1), g + 1).when(left_of(g), g).otherwise(g - 1)
    per_line = (
        met.withColumn("__g", guess).select("__rid", "__cy", last.alias("__last"))
        .groupBy("__rid", "__cy", "__last").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") % 2 == 1)
        .groupBy("__rid", "__cy").agg(F.array_sort(F.collect_list("__last")).alias("__at"))
    )
    pairs = F.transform(
        F.sequence(F.lit(1), F.floor(F.size("__at") / 2).cast("int")),
        lambda k: F.struct(F.element_at("__at", 2 * k - 1).alias("low"), F.element_at("__at", 2 * k).alias("high")),
    )
    spans = per_line.where(F.size("__at") >= 2).select("__rid", "__cy", F.explode(pairs).alias("s"))
    return spans.select("__rid", F.explode(F.sequence(F.col("s.low") + 1, F.col("s.high"))).alias("__cx"), "__cy")


def edge_index(polygons: DataFrame, keep: list[str], cell: float, ring: str = "ring") -> DataFrame:
    """``(keep..., __cx, __cy, __inside, __edges)``: a row per ring and square of side ``cell`` that it meets or covers.

    A square holds only the edges that cross it, and whether its lower left corner is inside. So the rows that make
    it are as many as crossings of edges and squares plus squares covered, however many vertices a ring has.
    """
    # Numbered once and stored, so that equal rows stay apart; dealt anew, as a file of rings is often one task.
    spread = polygons.select(*keep, F.col(ring).alias("__ring")).repartition(polygons.sparkSession.sparkContext.defaultParallelism)
    rings = materialize(spread.withColumn("__rid", F.monotonically_increasing_id()))
    # Outer, so that the edges are not made once more to look for empty rings.
    edges = rings.select("__rid", F.explode_outer(geometry.edges(geometry.closed(F.col("__ring")))).alias("e")).where(F.col("e").isNotNull())
    crossed = _touched(edges, cell).select("__rid", "__cx", "__cy", "e", F.lit(False).alias("__in"))
    covered = _corners_inside(edges, cell).select("__rid", "__cx", "__cy", F.lit(None).cast(edges.schema["e"].dataType).alias("e"), F.lit(True).alias("__in"))
    squares = crossed.unionByName(covered).groupBy("__rid", "__cx", "__cy").agg(F.max("__in").alias("__inside"), F.collect_list("e").alias("__edges"))
    if not keep:
        return squares.drop("__rid")
    return squares.join(rings.drop("__ring"), "__rid").select(*keep, "__cx", "__cy", "__inside", "__edges")


def _join_side(points: DataFrame, polygons: DataFrame, cell: float, ring: str, n: int | None = None) -> float:
    """``cell`` halved as long as the squares in the rings' boxes stay few beside the rings' edges and the points.

    A point is tested against the rings that cross its square; the smaller the squares beside the rings, the fewer
    are tested in vain. ``n`` is the number of points, when it is known.
    """
    box = geometry.bbox(F.col(ring))
    wide, high = box["x_max"] - box["x_min"], box["y_max"] - box["y_min"]
    squares = [F.sum((wide / F.lit(side) + 1) * (high / F.lit(side) + 1)) for side in (cell / 2**k for k in range(1, HALVINGS + 1))]
    edges, *sums = polygons.agg(F.sum(F.size(ring)), *squares).first()
    most = min(SQUARES_PER_EDGE * (edges or 0), points.count() if n is None else n)
    halved = 0
    while halved < HALVINGS and sums[halved] is not None and sums[halved] <= most:
        halved += 1
    return cell / 2**halved


def _without_holes(squares: DataFrame, polygon_id: str) -> DataFrame:
    """``(polygon_id, __cx, __cy, __parts, __holes)``: a row per square that a polygon's parts meet and no hole covers.

    Where a part covers the square the others say nothing more.
    """
    held = F.struct("__inside", "__edges")
    covers = F.col("__inside") & (F.size("__edges") == 0)
    merged = squares.groupBy(polygon_id, "__cx", "__cy").agg(
        F.collect_list(F.when(~F.col("__hole") & ~covers, held)).alias("__parts"),
        F.collect_list(F.when(F.col("__hole"), held)).alias("__holes"),
        F.max(F.when(~F.col("__hole") & covers, held)).alias("__cover"),
        F.max(F.col("__hole") & covers).alias("__hidden"),
    )
    parts = F.when(F.col("__cover").isNotNull(), F.array("__cover")).otherwise(F.col("__parts"))
    return merged.where(~F.col("__hidden")).withColumn("__parts", parts).drop("__cover", "__hidden").where(F.size("__parts") > 0)


def _once_covered(table: DataFrame, covers: Column) -> DataFrame:
    """For points in any polygon: one row of a square that a polygon covers, all rows of the others."""
    covered = table.where(covers).dropDuplicates(["__cx", "__cy"])
    return covered.unionByName(table.join(covered, ["__cx", "__cy"], "left_anti"))


def _truth(rings: Column, first: Column) -> Column:
    """Truth table of being in any of the rings, whose edges are variables from number ``first`` on."""
    odd = [0]
    for v in VARIABLES:
        odd.append(odd[-1] ^ v)
    up_to = lambda n: F.get(F.array(*[F.lit(v) for v in odd]), n)
    corner = lambda r: F.when(r["__inside"], F.lit(ALWAYS)).otherwise(F.lit(0))
    start = F.struct(first.alias("n"), F.lit(0).alias("t"))

    def add(s: Column, r: Column) -> Column:
        n = s["n"] + F.size(r["__edges"])
        t = up_to(n).bitwiseXOR(up_to(s["n"])).bitwiseXOR(corner(r))
        return F.struct(n.alias("n"), s["t"].bitwiseOR(t).alias("t"))

    return F.aggregate(rings, start, add, lambda s: s["t"])


def _listed(table: DataFrame, alone: Column, side: float) -> DataFrame:
    """Squares of few edges with ``__code`` and ``__at``, by which ``_held`` tests a point.

    ``__at`` holds the ends of the edges. The lower bits of ``__code`` tell for each set of edges passed on the way
    from the corner whether the point is inside, the others are those of ``geometry.passing``.
    """
    if "__parts" in table.columns:
        n_parts = F.coalesce(F.aggregate("__parts", F.lit(0), lambda n, r: n + F.size(r["__edges"])), F.lit(0))
        apart = _truth(F.col("__parts"), F.lit(0)).bitwiseAND(F.bitwise_not(_truth(F.col("__holes"), n_parts)))
        first = F.get("__parts", F.lit(0))
        inside, mixed = first["__inside"], F.when(~alone, apart)
    else:
        inside, mixed = F.col("__inside"), None
    odd, by_count = 0, F.when(F.col("__n") == 0, F.when(inside, F.lit(ALWAYS)).otherwise(F.lit(0)))
    for n, v in enumerate(VARIABLES, 1):
        odd ^= v
        by_count = by_count.when(F.col("__n") == n, F.when(inside, F.lit(ALWAYS ^ odd)).otherwise(F.lit(odd)))
    truth = F.coalesce(by_count if mixed is None else F.coalesce(mixed, by_count), F.lit(0))
    # Edges that decide nothing are left out.
    listed = table.withColumn("__truth", truth).where("__truth <> 0").withColumn("__n", F.when(F.col("__truth") == ALWAYS, 0).otherwise(F.col("__n")))
    x0, y0 = F.col("__cx") * F.lit(side), F.col("__cy") * F.lit(side)
    bits = F.transform("__list", lambda e, i: F.call_function("shiftleft", geometry.passing(e, x0, y0), 3 * i + 16))
    code = F.aggregate(bits, F.col("__truth"), lambda s, b: s + b)
    at = F.flatten(F.transform("__list", lambda e: F.array(*geometry.ends(e))))
    decided, none = F.col("__n") == 0, F.array_repeat(F.lit(0.0), 0)
    return listed.withColumns({
        "__code": F.coalesce(F.when(~decided, code), F.col("__truth")),
        "__at": F.coalesce(F.when(~decided, at), none),
    })


def _held(slots: int, x: Column, y: Column) -> Column:
    """Whether a point of the square lies in the polygon with ``__code`` and ``__at`` of at most ``slots`` edges."""
    code, n = F.col("__code"), F.size("__at")
    way = lambda i: geometry.passed(*[F.col("__at")[5 * i + k] for k in range(5)], code, 16 + 3 * i, x, y)
    case = F.lit(0)
    for i in reversed(range(slots)):
        case = F.when(n > 5 * i, F.when(way(i), F.lit(1 << i)).otherwise(F.lit(0)) + case).otherwise(F.lit(0))
    return (n == 0) | (F.call_function("shiftright", code, case).bitwiseAND(F.lit(1)) == 1)


def _located(points, table, alone, polygon_id, side, n_points, x, y, spread):
    """``points``, which have their square, with the polygons of the squares' ``table`` that hold them and have few edges there.

    The polygons of a square are one row, or a few of about ``SQUARE_BYTES``: a point meets that row and goes over its
    polygons in compiled code, as where polygons overlap there are far more rows out than points. Also gives the
    points as they should be read again, and whether there are polygons of more edges.
    """
    slots = F.when(F.col("__n") <= SLOTS[0], SLOTS[0]).when(F.col("__n") <= SLOTS[1], SLOTS[1]).otherwise(0)
    held = F.coalesce(F.octet_length(F.col(polygon_id).cast("string")), F.lit(0)) + F.col("__n") * 40 + F.lit(72)
    squares = table.groupBy(slots.alias("slots"), "__cx", "__cy").agg(F.sum(held).alias("b"))
    sizes = {r["slots"]: r for r in squares.groupBy("slots").agg(F.max("b").alias("most"), F.sum("b").alias("total")).collect()}
    more = sizes.pop(0, None) is not None
    if all(r["total"] <= MAX_BROADCAST_BYTES for r in sizes.values()):
        # Dealt anew, as a file of points is often one task, and each makes many rows.
        points = points.repartition(max(points.sparkSession.sparkContext.defaultParallelism, n_points // TASK_POINTS))
    else:
        points = stage(points)
    kept = [named(c) for c in points.columns if c not in ("__cx", "__cy")]
    found = []
    for k, size in sorted(sizes.items()) or [(SLOTS[0], {"most": 0, "total": 0})]:
        rows, by = _listed(table.where(slots == k), alone, side), ["__cx", "__cy"]
        blocks = -(-size["most"] // SQUARE_BYTES)
        if blocks > 1:
            rows = rows.withColumn("__block", F.pmod(F.xxhash64(polygon_id, "__at"), F.lit(blocks)))
            by.append("__block")
        packed = rows.groupBy(*by).agg(F.collect_list(F.struct(polygon_id, "__code", "__at")).alias("__held"))
        met = lookup(
            points,
            packed.select("__cx", "__cy", "__held"),
            ["__cx", "__cy"],
            spread=spread,
            hot_rows=HOT_POINTS,
            small=size["total"] <= MAX_BROADCAST_BYTES,
            hint="merge",
        )
        found.append(met.select(*kept, F.inline("__held")).where(_held(k, F.col(x), F.col(y))).drop("__code", "__at"))
    return reduce(DataFrame.unionByName, found), points, more


def _points_join(points, polygons, polygon_id, cell, how, x, y, ring, spread):
    """Points joined with the rings, or, with a ``hole`` column, with the polygons, that they lie in."""
    holes = "hole" in polygons.columns
    n_points = points.count()
    side = _join_side(points, polygons, cell, ring, n_points)
    if holes:
        marked = polygons.withColumn("__hole", F.coalesce(F.col("hole"), F.lit(False)))
        # Written in columns and compressed: it may be as large as the points.
        table = stage(_without_holes(edge_index(marked, [polygon_id, "__hole"], side, ring), polygon_id))
        first = F.get("__parts", F.lit(0))
        alone = (F.size("__parts") == 1) & (F.size("__holes") == 0)
        covers = alone & first["__inside"] & (F.size(first["__edges"]) == 0)
    else:
        table = stage(edge_index(polygons, [polygon_id] if how == "inner" else [], side, ring))
        alone, covers = F.lit(True), F.col("__inside") & (F.size("__edges") == 0)
    if how == "left_semi":
        table = stage(_once_covered(table.drop(polygon_id), covers))

    # A point that is not a number lies in no square.
    at = lambda v: F.floor(F.nanvl(F.col(v).cast("double"), F.lit(None).cast("double")) / F.lit(side)).cast("bigint")
    inside = lambda inside, edges: geometry.inside_square(
        inside, edges, F.col("__cx") * F.lit(side), F.col("__cy") * F.lit(side), F.col(x), F.col(y)
    )
    if holes:
        any_of = lambda rings: F.exists(rings, lambda r: inside(r["__inside"], r["__edges"]))
        within = F.when(alone, inside(first["__inside"], first["__edges"])).otherwise(any_of("__parts") & ~any_of("__holes"))
        listed = lambda rings: F.aggregate(rings, F.lit(0), lambda n, r: n + 32 + F.size(r["__edges"]) * 32)
        extra = listed("__parts") + listed("__holes")
        edges = F.flatten(F.concat(F.col("__parts")["__edges"], F.col("__holes")["__edges"]))
        points = points.distinct()
    else:
        within, extra, edges = inside(F.col("__inside"), F.col("__edges")), F.size("__edges") * 32, F.col("__edges")
    placed = points.withColumns({"__cx": at(x), "__cy": at(y)})
    located, more = None, True
    if how == "inner":
        counted = table.withColumn("__list", edges).withColumn("__n", F.size("__list"))
        located, placed, more = _located(placed, counted, alone, polygon_id, side, n_points, x, y, spread)
        table = table.where(F.size(edges) > SLOTS[1])
    if not more:
        return located
    joined = lookup(placed, table, ["__cx", "__cy"], how, spread=spread, condition=within, extra=extra)
    joined = joined.drop("__cx", "__cy", "__inside", "__edges", "__parts", "__holes")
    return joined if located is None else located.unionByName(joined)


def points_in_polygons(
    points: DataFrame,
    polygons: DataFrame,
    cell: float,
    x: str = "x",
    y: str = "y",
    ring: str = "ring",
    spread: list[str] | None = None,
    polygon_id: str = "divide_id",
) -> DataFrame:
    """Points inside at least one polygon, each once. ``cell`` is the largest side of the squares of the join grid.

    With a ``hole`` column (and then ``polygon_id``) a point in a polygon's hole is not inside it,
    and equal points are one.
    """
    return _points_join(points, polygons, polygon_id, cell, "left_semi", x, y, ring, spread)


def locate_points(
    points: DataFrame,
    polygons: DataFrame,
    polygon_id: str,
    cell: float,
    x: str = "x",
    y: str = "y",
    ring: str = "ring",
    spread: list[str] | None = None,
) -> DataFrame:
    """Points with the id of the polygon they lie in; a row for each where polygons overlap.

    With a ``hole`` column a polygon is all rows of its id, and equal points are one.
    """
    return _points_join(points, polygons, polygon_id, cell, "inner", x, y, ring, spread)


def _area_under(y: Column, low: Column, high: Column) -> Column:
    """Integral from -inf to y of clamp(t, low, high) - low."""
    height = high - low
    inside = F.pow(y - low, F.lit(2.0)) / F.lit(2.0)
    above = F.pow(height, F.lit(2.0)) / F.lit(2.0) + height * (y - high)
    return F.when(y <= low, F.lit(0.0)).when(y >= high, above).otherwise(inside)


def cell_weights(
    polygons: DataFrame,
    polygon_id: str = "divide_id",
    ring: str = "ring",
    x0: float = 0.0,
    y0: float = 0.0,
    dx: float = 1.0,
    dy: float = 1.0,
    least: float = LEAST_SHARE,
) -> DataFrame:
    """``(polygon_id, iy, ix, w)``: share of each grid cell that a polygon covers.

    A polygon may have several rows: one per part, in either direction, and rows with ``hole`` true
    (where there is such a column) are taken away again. Cells of which a polygon covers
    ``least`` or less are left out; that is a tolerance for what rounding leaves of cells it
    only touches.

    A polygon's area in a cell is the sum over its edges of the signed area between the edge, cut
    to the cell, and the cell's floor. An edge makes rows for the cells it crosses, and one step for
    all cells below them in its column; a running sum down the column makes the cover. So rows are as
    many as cells crossed and cells covered, however far below an edge its ring goes.
    """
    hole = F.coalesce(F.col("hole"), F.lit(False)) if "hole" in polygons.columns else F.lit(False)
    # Dealt anew, as a file of rings is often one task, and each makes many rows.
    dealt = polygons.repartition(polygons.sparkSession.sparkContext.defaultParallelism)
    edge = dealt.select(
        polygon_id,
        # Rows of equal rings share their direction too, so they may be summed under one key.
        F.xxhash64(F.col(ring), hole).alias("ring_key"),
        hole.alias("hole"),
        # Outer, so that the edges are not made once more to look for empty rings.
        F.explode_outer(geometry.edges(geometry.closed(F.col(ring)))).alias("e"),
    ).where(F.col("e").isNotNull()).select(
        polygon_id,
        "ring_key",
        "hole",
        *[
            ((F.col(f"e.{p}.{axis}") - F.lit(o)) / F.lit(d)).alias(f"{axis}{i}")
            for p, i in (("a", 1), ("b", 2))
            for axis, o, d in (("x", x0, dx), ("y", y0, dy))
        ],
    ).where(F.col("x1") != F.col("x2"))
    column = [polygon_id, "ring_key", "hole", "ix"]
    events = _column_events(edge, column)
    down = Window.partitionBy(*column).orderBy(F.col("iy").desc())
    covered = events.select(
        *column,
        "iy",
        "part",
        F.sum("step").over(down.rowsBetween(Window.unboundedPreceding, 0)).alias("cover"),
        F.lead("iy").over(down).alias("below"),
    )
    # Cells between two events have the cover alone; what rounding leaves of an ended cover is none.
    between = F.when(
        (F.col("below") < F.col("iy") - 1) & (F.abs("cover") > least),
        F.transform(
            F.sequence(F.col("below") + 1, F.col("iy") - 1),
            lambda iy: F.struct(iy.alias("iy"), F.abs("cover").alias("w")),
        ),
    )
    own = F.array(F.struct("iy", F.abs(F.col("part") + F.col("cover")).alias("w")))
    # Each ring's own direction is taken out before rings are added up.
    rings = covered.select(
        *column, F.explode(F.when(between.isNull(), own).otherwise(F.concat(own, between))).alias("c")
    ).select(polygon_id, "hole", "ix", "c.iy", "c.w")
    w = F.sum(F.when(F.col("hole"), -F.col("w")).otherwise(F.col("w")))
    return rings.groupBy(polygon_id, "iy", "ix").agg(w.alias("w")).where(F.col("w") > least)


def _column_events(edge: DataFrame, column: list[str]) -> DataFrame:
    """``(column..., iy, part, step)`` of edges in cell units (a cell is the unit square (ix, iy)..(ix+1, iy+1)).

    ``part`` is the signed area under the edges that cross a cell, within it; ``step`` what the edges above
    it add to this cell and to every one below.
    """
    left, right = F.least("x1", "x2"), F.greatest("x1", "x2")
    slope = (F.col("y2") - F.col("y1")) / (F.col("x2") - F.col("x1"))
    columns = F.sequence(F.floor(left).cast("bigint"), (F.ceil(right) - 1).cast("bigint"))
    ends = F.greatest(left, F.col("ix")), F.least(right, F.col("ix") + 1)
    strips = edge.withColumn("ix", F.explode(columns)).select(
        *column,
        (F.signum(F.col("x2") - F.col("x1")) * (ends[1] - ends[0])).alias("run"),
        (F.col("y1") + (ends[0] - F.col("x1")) * slope).alias("yl"),
        (F.col("y1") + (ends[1] - F.col("x1")) * slope).alias("yr"),
    )
    lowest, highest = F.floor(F.least("yl", "yr")).cast("bigint"), F.floor(F.greatest("yl", "yr")).cast("bigint")
    cells = strips.withColumn("__under", lowest - 1).withColumn("iy", F.explode(F.sequence(F.col("__under"), highest)))
    low, high = F.col("iy").cast("double"), F.col("iy").cast("double") + 1
    rise = F.col("yr") - F.col("yl")
    middle = F.least(F.greatest((F.col("yl") + F.col("yr")) / 2, low), high) - low
    mean = F.when(F.abs(rise) < 1e-9, middle).otherwise(
        (_area_under(F.col("yr"), low, high) - _area_under(F.col("yl"), low, high)) / F.nullif(rise, F.lit(0.0))
    )
    under = F.col("iy") == F.col("__under")
    return cells.groupBy(*column, "iy").agg(
        F.sum(F.when(under, 0.0).otherwise(F.col("run") * mean)).alias("part"),
        F.sum(F.when(under, F.col("run")).otherwise(0.0)).alias("step"),
    )


def zonal_mean(
    forcing: DataFrame,
    weights: DataFrame,
    variables: list[str],
    polygon_id: str = "divide_id",
    time: str = "time",
    staged: Callable[[DataFrame], DataFrame] = stage,
) -> DataFrame:
    """Coverage-weighted mean of each variable per polygon and time, all variables in one pass.

    A missing cell is left out of both sums of its variable. A small forcing meets the weights polygon by
    polygon, so that a task only sums its own polygons and passes nothing on. Else the weights are checked for
    size: broadcast when small, else joined by cell with crowded cells split by time.
    The forcing is written by ``staged``, which may be a job's ``session.Staging``.
    """
    cells = staged(forcing.select(time, "iy", "ix", *variables))
    if fits(cells):
        parts = int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        table = weights.select(polygon_id, "iy", "ix", "w").repartition(parts, polygon_id)
        joined = table.join(F.broadcast(cells), ["iy", "ix"])
    else:
        joined = lookup(cells, materialize(weights.select(polygon_id, "iy", "ix", "w")), ["iy", "ix"], spread=[time])

    def mean(v: str) -> Column:
        value = F.col(v)
        present = value.isNotNull() & ~F.isnan(value.cast("double"))
        return ratio(
            F.sum(F.when(present, value * F.col("w"))), F.sum(F.when(present, F.col("w")))
        ).alias(v)

    return joined.groupBy(time, polygon_id).agg(*[mean(v) for v in variables])
