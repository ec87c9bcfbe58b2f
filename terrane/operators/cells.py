"""Links between dense cells of points, without comparing all points with all points.

Points of one cell are all within eps of each other, so two neighbouring cells need one link at most: is some point of the one within eps
of some point of the other? Boxes around the points answer most of that: if even the far corners of two boxes are near enough, they are
linked; if even the near sides are too far apart, they are not. Only what is between is looked at again, in boxes an eighth as wide, and
a pair of cells is settled with its first link. Each round's boxes are sums over the points of the cells that are still open; a ring
of boxes about eps away is all that remains of a cell, so the work stays in proportion to the points. A box around a single place
is exact, so rounds end when places are told apart; after the last, places are compared themselves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrane.plans.scratch import materialize

#: Rounds after the first, and bits by which a box narrows in each: cells of 39 m end in boxes of a centimetre.
ROUNDS, BITS = 4, 3
#: Cells of side eps / sqrt 2 that may hold points within eps of a cell, in the half plane above it.
STEPS = [(dx, dy) for dx in range(-2, 3) for dy in range(0, 3) if (dy > 0 or dx > 0) and max(abs(dx) - 1, 0) ** 2 + max(dy - 1, 0) ** 2 <= 2]


def _boxes(points: DataFrame, up: int) -> DataFrame:
    """Boxes of the points at a depth: cell, place of the box in it, bounds."""
    place = [F.shiftright(c, up).alias(c) for c in ("gx", "gy")]
    return points.groupBy("cx", "cy", *place).agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))


def _gap(lo: str, hi: str) -> Column:
    """How far apart two boxes are along an axis, at least."""
    return F.greatest(F.lit(0.0), F.col(f"b.{lo}") - F.col(f"a.{hi}"), F.col(f"a.{lo}") - F.col(f"b.{hi}"))


def _span(lo: str, hi: str) -> Column:
    """How far apart two points of the boxes are along an axis, at most."""
    return F.greatest(F.col(f"b.{hi}") - F.col(f"a.{lo}"), F.col(f"a.{hi}") - F.col(f"b.{lo}"))


def linked_cells(points: DataFrame, eps: float, rounds: int = ROUNDS) -> DataFrame:
    """ax, ay, bx, by: the pairs of different cells with points at most eps apart, each once.

    points: cx, cy (the cell, of side eps / sqrt 2), x, y; rows that repeat do no harm.
    """
    side = eps / 2**0.5
    fine = 1 << (BITS * rounds)
    inner = lambda v, c: F.least(F.greatest(F.floor((F.col(v) / side - F.col(c)) * fine), F.lit(0)), F.lit(fine - 1)).cast("int")
    points = points.select("cx", "cy", "x", "y", inner("x", "cx").alias("gx"), inner("y", "cy").alias("gy"))
    limit = F.lit(eps * eps)
    near = _span("x0", "x1") ** 2 + _span("y0", "y1") ** 2 <= limit
    far = _gap("x0", "x1") ** 2 + _gap("y0", "y1") ** 2 > limit
    pair = ("ax", "ay", "bx", "by")
    # First round: whole cells, each dealt to those around it.
    cells = materialize(_boxes(points, BITS * rounds), "cells")
    steps = F.explode(F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in STEPS]))
    dealt = cells.withColumn("step", steps).withColumn("tx", F.col("cx") + F.col("step.dx")).withColumn("ty", F.col("cy") + F.col("step.dy"))
    met = dealt.alias("a").join(cells.alias("b"), (F.col("a.tx") == F.col("b.cx")) & (F.col("a.ty") == F.col("b.cy"))).filter(~far)
    ends = [F.col("a.cx").alias("ax"), F.col("a.cy").alias("ay"), F.col("b.cx").alias("bx"), F.col("b.cy").alias("by")]
    zero = F.lit(0)
    judged = materialize(met.select(*ends, zero.alias("agx"), zero.alias("agy"), zero.alias("bgx"), zero.alias("bgy"), near.alias("near")), "judged")
    out = judged.filter("near").select(*pair)
    open_ = judged.filter("NOT near")
    for depth in range(1, rounds + 1):
        if open_.isEmpty():
            return out
        up = BITS * (rounds - depth)
        cell = lambda n: open_.select(F.col(f"{n}x").alias("cx"), F.col(f"{n}y").alias("cy"), F.col(f"{n}gx").alias("px"), F.col(f"{n}gy").alias("py"))  # noqa: B023, E731
        boxes = _boxes(points, up).withColumn("px", F.shiftright("gx", BITS)).withColumn("py", F.shiftright("gy", BITS))
        boxes = materialize(boxes.join(cell("a").unionAll(cell("b")).distinct(), ["cx", "cy", "px", "py"], "left_semi"), "boxes")
        on = lambda n: [F.col(f"{n}.cx") == F.col(f"o.{n}x"), F.col(f"{n}.cy") == F.col(f"o.{n}y"), F.col(f"{n}.px") == F.col(f"o.{n}gx"), F.col(f"{n}.py") == F.col(f"o.{n}gy")]
        met = open_.alias("o").join(boxes.alias("a"), on("a")).join(boxes.alias("b"), on("b")).filter(~far)
        held = [F.col(f"{n}.g{c}").alias(f"{n}g{c}") for n in "ab" for c in "xy"]
        judged = materialize(met.select(*[f"o.{c}" for c in pair], *held, near.alias("near")), "judged")
        settled = judged.filter("near").select(*pair).distinct()
        out = out.unionAll(settled)
        open_ = judged.filter("NOT near").join(settled, list(pair), "left_anti")
    if open_.isEmpty():
        return out
    last = lambda n: points.select(*[F.col(o).alias(f"{n}{w}") for o, w in (("cx", "x"), ("cy", "y"), ("gx", "gx"), ("gy", "gy"), ("x", "_x"), ("y", "_y"))])
    each = open_.join(last("a"), ["ax", "ay", "agx", "agy"]).join(last("b"), ["bx", "by", "bgx", "bgy"])
    return out.unionAll(each.filter((F.col("a_x") - F.col("b_x")) ** 2 + (F.col("a_y") - F.col("b_y")) ** 2 <= limit).select(*pair).distinct())
