"""Expressions over rings: ``ARRAY<STRUCT<x DOUBLE, y DOUBLE>>``, first vertex repeated at the end."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def closed(ring: Column) -> Column:
    """The ring with its first vertex repeated at the end, whether it was or not."""
    first = F.element_at(ring, 1)
    return F.when(first == F.element_at(ring, -1), ring).otherwise(F.concat(ring, F.array(first)))


def edges(ring: Column) -> Column:
    """Edges as ``ARRAY<STRUCT<a, b>>``."""
    n = F.size(ring)
    return F.zip_with(
        F.slice(ring, F.lit(1), n - 1),
        F.slice(ring, F.lit(2), n - 1),
        lambda a, b: F.struct(a.alias("a"), b.alias("b")),
    )


def xs(ring: Column) -> Column:
    return F.transform(ring, lambda p: p["x"])


def ys(ring: Column) -> Column:
    return F.transform(ring, lambda p: p["y"])


def bbox(ring: Column) -> Column:
    return F.struct(
        F.array_min(xs(ring)).alias("x_min"),
        F.array_min(ys(ring)).alias("y_min"),
        F.array_max(xs(ring)).alias("x_max"),
        F.array_max(ys(ring)).alias("y_max"),
    )


def within_box(ring: Column, x_min: float, y_min: float, x_max: float, y_max: float) -> Column:
    """Every vertex inside the rectangle, so the whole ring is."""
    return F.forall(ring, lambda p: p["x"].between(x_min, x_max) & p["y"].between(y_min, y_max))


def contains(edge_list: Column, x: Column, y: Column) -> Column:
    """Ray-crossing parity: odd number of edges crossed by the ray from (x, y) to the right.

    An edge counts when it spans y half-open, so a shared vertex is counted once. A point
    exactly on a border may fall on either side; it belongs to one of two rings sharing it.
    """

    def crosses(e: Column) -> Column:
        a, b = e["a"], e["b"]
        spans = (a["y"] > y) != (b["y"] > y)
        # Only evaluated where the edge spans y, so the divisor is not zero.
        at = a["x"] + (y - a["y"]) * (b["x"] - a["x"]) / F.nullif(b["y"] - a["y"], F.lit(0.0))
        return F.when(spans, x < at).otherwise(F.lit(False))

    return F.aggregate(edge_list, F.lit(False), lambda inside, e: inside != crosses(e))


def _left_of_edge(e: Column, x: Column, y: Column) -> Column:
    """Whether (x, y) lies to the left of the line from ``a`` to ``b``; on the line counts as not."""
    a, b = e["a"], e["b"]
    return (b["x"] - a["x"]) * (y - a["y"]) - (b["y"] - a["y"]) * (x - a["x"]) > 0


def right_of(e: Column, x: Column, y: Column) -> Column:
    """Whether an edge that spans the height y passes to the right of (x, y); a vertex at x counts as left of it."""
    a, b = e["a"]["x"] > x, e["b"]["x"] > x
    return F.when(a == b, a).otherwise((e["b"]["y"] > e["a"]["y"]) == _left_of_edge(e, x, y))


def above(e: Column, x: Column, y: Column) -> Column:
    """Whether an edge that spans x passes above (x, y); a vertex at y counts as below it."""
    a, b = e["a"]["y"] > y, e["b"]["y"] > y
    return F.when(a == b, a).otherwise((e["b"]["x"] > e["a"]["x"]) != _left_of_edge(e, x, y))


def inside_square(corner: Column, edge_list: Column, x0: Column, y0: Column, x: Column, y: Column) -> Column:
    """``contains`` for a point of a square, from the edges that cross it and the state of its lower left corner (x0, y0).

    Goes from the corner up to the point's height and then right to the point, and changes sides at each edge
    on the way. For the turn of the way, as for the corner, ``right_of`` and ``above`` ask the same side of an
    edge, so that rounding cannot make the two legs differ; the point itself is tested as ``contains`` does.
    """

    def changes(e: Column) -> Column:
        a, b = e["a"], e["b"]
        up = ((a["x"] > x0) != (b["x"] > x0)) & (above(e, x0, y0) != above(e, x0, y))
        at = a["x"] + (y - a["y"]) * (b["x"] - a["x"]) / F.nullif(b["y"] - a["y"], F.lit(0.0))
        spans = (a["y"] > y) != (b["y"] > y)
        along = F.when(spans, (x < at) != right_of(e, x0, y)).otherwise(F.lit(False))
        return up != along

    # Most squares hold an edge or two; these are compiled, where a fold over a list is interpreted.
    n, e = F.size(edge_list), lambda i: F.get(edge_list, F.lit(i))
    many = F.aggregate(edge_list, corner, lambda inside, e: inside != changes(e))
    few = F.when(n == 0, corner).when(n == 1, corner != changes(e(0)))
    return few.when(n == 2, (corner != changes(e(0))) != changes(e(1))).otherwise(many)


def passing(e: Column, x0: Column, y0: Column) -> Column:
    """Three bits by which ``passed`` tells what ``inside_square`` does at an edge, for squares with lower left corner (x0, y0).

    The side of the edge on which the turn of the way lies counts twice there, once up and once along, so it
    need not be known.
    """
    a, b = e["a"], e["b"]
    meets, over = (a["x"] > x0) != (b["x"] > x0), above(e, x0, y0)
    along = F.when(meets, (over != (b["x"] > a["x"])) == (b["y"] > a["y"])).otherwise(a["x"] > x0)
    bit = lambda c, v: F.when(c, F.lit(v)).otherwise(F.lit(0))
    return bit(along, 1) + bit(meets & over, 2) + bit(meets & ~over, 4)


def ends(e: Column) -> list[Column]:
    """Five numbers of an edge for ``passed``, never null: x and y of its start, y of its end, its extents.

    Where the heights are equal, or one is missing on an upright edge, the edge spans no height and is not divided by.
    """
    a, b = e["a"], e["b"]
    number = lambda *c: F.coalesce(*c, F.lit(0.0))
    start, end = number(a["y"], b["y"]), number(b["y"], a["y"])
    return [number(a["x"]), start, end, number(b["x"] - a["x"]), F.when(start == end, F.lit(1.0)).otherwise(end - start)]


def passed(ax: Column, ay: Column, by: Column, dx: Column, dy: Column, bits: Column, shift: int, x: Column, y: Column) -> Column:
    """Whether the way from a square's corner to (x, y) changes sides at an edge; ``bits`` has those of ``passing``."""
    bit = lambda v: bits.bitwiseAND(F.lit(v << shift)) != 0
    up = ay > y
    return F.when(up != (by > y), (x < ax + (y - ay) * dx / dy) != bit(1)).when(up, bit(4)).otherwise(bit(2))
