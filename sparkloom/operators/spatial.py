"""Rectangles: world coordinates, containment, overlap by grid cells, nearest centres."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lineage import written


def world(nodes: DataFrame) -> DataFrame:
    """nodes (x, depth) with z = 2 ** max(depth, 1), u = x z, v = ln z."""
    z = F.pow(F.lit(2.0), F.greatest("depth", F.lit(1)))
    return nodes.withColumn("z", z).withColumn("u", F.col("x") * z).withColumn("v", F.log(z))


def containing(rects: DataFrame, points: DataFrame) -> DataFrame:
    """(point_id, id) of the rectangles that hold each point, edges included; points and cells meet on a grid."""
    return overlapping(rects, points.select(F.col("point_id").alias("other"), F.col("px").alias("x2"), F.col("py").alias("y2"), F.lit(0.0).alias("w2"), F.lit(0.0).alias("h2"))).select(F.col("other").alias("point_id"), "id")


def overlapping(rects: DataFrame, others: DataFrame) -> DataFrame:
    """(id, other) of rectangles (x, y, w, h) and (x2, y2, w2, h2) that touch, edges included.

    Cells are as large as rectangles are wide and high on average; both sides explode into those that they touch.
    """
    means = rects.agg(F.greatest(F.avg("w"), F.lit(1e-9)).alias("cw"), F.greatest(F.avg("h"), F.lit(1e-9)).alias("ch"))  # one row
    span = lambda lo, size, cell: F.sequence(F.floor(F.col(lo) / F.col(cell)), F.floor((F.col(lo) + F.col(size)) / F.col(cell)))
    a = rects.crossJoin(F.broadcast(means)).withColumn("cx", F.explode(span("x", "w", "cw"))).withColumn("cy", F.explode(span("y", "h", "ch"))).drop("cw", "ch")
    b = others.crossJoin(F.broadcast(means)).withColumn("cx", F.explode(span("x2", "w2", "cw"))).withColumn("cy", F.explode(span("y2", "h2", "ch"))).drop("cw", "ch")
    meet = (F.col("x") <= F.col("x2") + F.col("w2")) & (F.col("x2") <= F.col("x") + F.col("w")) & (F.col("y") <= F.col("y2") + F.col("h2")) & (F.col("y2") <= F.col("y") + F.col("h"))
    return a.join(b, ["cx", "cy"]).filter(meet).select("id", "other").distinct()


def nearest(rects: DataFrame, k: int = 4, per_cell: int = 8) -> DataFrame:
    """(id, other, distance, place): the k nearest other centres of each, ties by id.

    Centres meet on a grid with about per_cell of them to a cell. Those of the ring of cells r around are compared; who has k within
    r cells is done, the others go on with a ring twice as wide, until it spans the grid.
    """
    centre = written(rects.select("id", (F.col("x") + F.col("w") / 2).alias("a"), (F.col("y") + F.col("h") / 2).alias("b")))
    n, ax, bx, ay, by = centre.agg(F.count("*"), F.min("a"), F.max("a"), F.min("b"), F.max("b")).first()
    if not n:
        return centre.select("id", F.col("id").alias("other"), F.lit(0.0).alias("distance"), F.lit(1).alias("place"))
    side = max(1, int((n / per_cell) ** 0.5))
    size = max((bx - ax) / side, (by - ay) / side, 1e-9)
    cell = lambda v, low: F.floor((F.col(v) - F.lit(low)) / F.lit(size))
    grid = written(centre.withColumns({"cx": cell("a", ax), "cy": cell("b", ay)}))
    wide = int(max((bx - ax) / size, (by - ay) / size)) + 1
    other = grid.select(F.col("id").alias("other"), F.col("a").alias("a2"), F.col("b").alias("b2"), "cx", "cy")
    place = F.row_number().over(Window.partitionBy("id").orderBy(F.round("distance", 9), "other"))
    todo, done, r = grid, None, 1
    while True:
        ring = lambda c: F.explode(F.sequence(F.col(c) - r, F.col(c) + r))  # noqa: B023, E731
        around = todo.select("id", "a", "b", ring("cx").alias("cx"), "cy").select("id", "a", "b", "cx", ring("cy").alias("cy"))
        found = around.join(other, ["cx", "cy"]).filter("id <> other").withColumn("distance", F.hypot(F.col("a") - F.col("a2"), F.col("b") - F.col("b2")))
        best = written(found.withColumn("place", place).filter(F.col("place") <= k).select("id", "other", "distance", "place"))
        if r >= wide:
            return best if done is None else done.unionByName(best)
        # Nothing outside the ring is nearer than r cells.
        sure = written(best.filter((F.col("place") == k) & (F.col("distance") < r * size)).select("id"))
        own = best.join(sure, "id", "left_semi")
        done = own if done is None else done.unionByName(own)
        todo = written(todo.join(sure, "id", "left_anti"))
        if todo.isEmpty():
            return done
        r *= 2


def upsert(rects: DataFrame, changes: DataFrame) -> DataFrame:
    """rects with those of changes (id, seq, gone, x, y, w, h) put in, the last of an id counting; gone ones are removed."""
    last = changes.groupBy("id").agg(F.max_by(F.struct("gone", "x", "y", "w", "h"), "seq").alias("m"))
    return rects.join(last, "id", "left_anti").select("id", "x", "y", "w", "h").unionByName(last.filter("not m.gone").select("id", "m.x", "m.y", "m.w", "m.h"))
