"""Polygons to cells. A polygon is one row with ``rings ARRAY<ARRAY<STRUCT<x, y>>>``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellweave.operators.grids import disc_offsets, spread
from cellweave.operators.meet import meet


def edges(polys: DataFrame, keys: Sequence[str], horizontal: bool = False) -> DataFrame:
    """One row per ring edge; rings close themselves. Horizontal edges never cross a row and are left out by default."""
    pairs = F.transform(
        F.sequence(F.lit(1), F.size("_ring")),
        lambda i: F.struct(
            F.element_at("_ring", i).alias("a"),
            F.element_at("_ring", F.when(i == F.size("_ring"), 1).otherwise(i + 1)).alias("b"),
        ),
    )
    return (
        polys.select(*keys, F.explode("rings").alias("_ring")).filter(F.size("_ring") >= 3)
        .select(*keys, F.explode(pairs).alias("_e"))
        .select(*keys, F.col("_e.a.x").alias("x1"), F.col("_e.a.y").alias("y1"), F.col("_e.b.x").alias("x2"), F.col("_e.b.y").alias("y2"))
        .filter(F.lit(horizontal) | (F.col("y1") != F.col("y2")))
    )


def crossing_x(y: Column) -> Column:
    """Where the edge meets the horizontal line at y."""
    return F.col("x1") + (y - F.col("y1")) * (F.col("x2") - F.col("x1")) / (F.col("y2") - F.col("y1"))


def spans(polys: DataFrame, keys: Sequence[str], res: float = 1.0) -> DataFrame:
    """Runs of cells ``(keys, row, c0, c1)`` whose centre lies inside the polygon (even-odd rule).

    An edge is expanded only over the pixel rows whose centre line it crosses; crossings of one polygon
    and row are sorted, so a huge footprint is spread over as many groups as it has rows.
    """
    first = F.ceil(F.least("y1", "y2") / res - 0.5)
    last = F.ceil(F.greatest("y1", "y2") / res - 0.5) - 1
    crossings = (
        edges(polys, keys).withColumns({"_f": first, "_l": last}).filter("_f <= _l")
        .withColumn("row", F.explode(F.sequence("_f", "_l")))
        .select(*keys, "row", crossing_x((F.col("row") + 0.5) * res).alias("_x"))
    )
    w = Window.partitionBy(*keys, "row").orderBy("_x")
    return (
        crossings.select(*keys, "row", "_x", F.lead("_x").over(w).alias("_nx"), F.row_number().over(w).alias("_k"))
        .filter("_k % 2 = 1")
        .select(*keys, F.col("row").cast("int"), F.ceil(F.col("_x") / res - 0.5).cast("int").alias("c0"),
                (F.ceil(F.col("_nx") / res - 0.5) - 1).cast("int").alias("c1"))
        .filter("c0 <= c1")
    )


def span_cells(runs: DataFrame) -> DataFrame:
    return runs.withColumn("col", F.explode(F.sequence("c0", "c1"))).drop("c0", "c1")


def paint(cells: DataFrame, frame: Sequence[str], value: str, order: Sequence[str]) -> DataFrame:
    """One value per cell: the one painted last. Partial aggregation combines overpainted cells before the shuffle."""
    return cells.groupBy(*frame, "row", "col").agg(F.max_by(value, F.struct(*order)).alias(value))


def burn_points(points: DataFrame, frame: Sequence[str], radius: float, value: str) -> DataFrame:
    """Discs round points, the higher class wins. A cell belongs to the disc when its centre does."""
    r = int(radius) + 1
    near = spread(
        points.withColumns({"row": F.floor("y").cast("int"), "col": F.floor("x").cast("int")}),
        [(dy, dx) for dy in range(-r, r + 1) for dx in range(-r, r + 1)],
    )
    d2 = (F.col("col") + 0.5 - F.col("x")) * (F.col("col") + 0.5 - F.col("x")) + (
        F.col("row") + 0.5 - F.col("y")) * (F.col("row") + 0.5 - F.col("y"))
    return near.filter(d2 <= radius * radius).groupBy(*frame, "row", "col").agg(F.max(value).alias(value))


def with_bbox(polys: DataFrame) -> DataFrame:
    xs = F.flatten(F.transform("rings", lambda r: F.transform(r, lambda p: p["x"])))
    ys = F.flatten(F.transform("rings", lambda r: F.transform(r, lambda p: p["y"])))
    return polys.withColumns({"bx0": F.array_min(xs), "bx1": F.array_max(xs), "by0": F.array_min(ys), "by1": F.array_max(ys)})


def touching_box(polys: DataFrame, keys: Sequence[str], x0: float, y0: float, x1: float, y1: float) -> DataFrame:
    """Polygons that share a point with the box; they are kept whole, not clipped.

    Bounding boxes first (plain columns reach a Parquet scan), then the exact test: some edge meets the
    box, or the centre of the box lies inside the polygon.
    """
    near = with_bbox(polys).filter(f"bx1 >= {x0} AND bx0 <= {x1} AND by1 >= {y0} AND by0 <= {y1}")
    e = edges(near, keys, horizontal=True)

    def side(x: float, y: float) -> Column:
        return (F.col("x2") - F.col("x1")) * (y - F.col("y1")) - (F.col("y2") - F.col("y1")) * (x - F.col("x1"))

    corners = [side(x, y) for x in (x0, x1) for y in (y0, y1)]
    overlaps = (F.greatest("x1", "x2") >= x0) & (F.least("x1", "x2") <= x1) & (F.greatest("y1", "y2") >= y0) & (
        F.least("y1", "y2") <= y1)
    meets = overlaps & (F.least(*corners) <= 0) & (F.greatest(*corners) >= 0)
    cx, cy = (x0 + x1) / 2, (y0 + y1) / 2
    crosses = (F.col("y1") != F.col("y2")) & ((F.col("y1") > cy) != (F.col("y2") > cy))
    at = F.when(crosses, F.col("x1") + (cy - F.col("y1")) * (F.col("x2") - F.col("x1")) / F.expr("nullif(y2 - y1, 0)"))
    return (
        e.groupBy(*keys).agg(F.bool_or(meets).alias("_m"), F.count_if(F.coalesce(at > cx, F.lit(False))).alias("_n"))
        .filter("_m OR _n % 2 = 1").select(*keys)
    )


BAND_EDGES = 32  # edges a band should hold


def banded(polys: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Polygons with their box and ``band_h``, the height of the bands their edges are dealt to.

    A band holds about ``BAND_EDGES`` edges, so a huge outline is many small keys. Bands are not made so thin that the
    edges, each in every band it reaches into, become more than four times as many.
    """
    climbs = F.aggregate("rings", F.lit(0.0), lambda s, r: s + F.aggregate(
        F.zip_with(r, F.concat(F.slice(r, 2, F.greatest(F.size(r) - 1, F.lit(0))), F.slice(r, 1, 1)), lambda p, q: F.abs(q["y"] - p["y"])), F.lit(0.0), lambda t, v: t + v))
    n = F.aggregate("rings", F.lit(0), lambda s, r: s + F.size(r))
    high = F.col("by1") - F.col("by0")
    height = F.greatest(high * BAND_EDGES / F.greatest(n, F.lit(1)), climbs / (3 * F.greatest(n, F.lit(1))), F.lit(1e-6))
    return with_bbox(polys).withColumn("band_h", height)


def hosts(points: DataFrame, polys: DataFrame, frame: Sequence[str], pid: str, bid: str, cell: float = 32.0) -> DataFrame:
    """``(frame, pid, bid)`` for every point inside a polygon; points outside are absent (left join them back).

    Bounding boxes are put on a grid for the candidate join. The even-odd test then joins candidates with polygon edges
    on (polygon, band of rows). Bands are as high as the polygon's own edges ask for, see :func:`banded`.
    """
    measured = banded(polys, [*frame, bid])
    boxes = measured.select(*frame, bid, "bx0", "bx1", "by0", "by1", "band_h")
    gridded = boxes.withColumns({
        "_gx": F.explode(F.sequence(F.floor(F.col("bx0") / cell), F.floor(F.col("bx1") / cell))),
    }).withColumn("_gy", F.explode(F.sequence(F.floor(F.col("by0") / cell), F.floor(F.col("by1") / cell))))
    at = points.select(*frame, pid, "x", "y", F.floor(F.col("x") / cell).alias("_gx"), F.floor(F.col("y") / cell).alias("_gy"))
    band = lambda y: F.floor((y - F.col("by0")) / F.col("band_h"))
    cand = (
        at.join(gridded, [*frame, "_gx", "_gy"])
        .filter("x >= bx0 AND x <= bx1 AND y >= by0 AND y <= by1")
        .select(*frame, pid, bid, "x", "y", band(F.col("y")).alias("_band"))
    )
    lines = edges(measured, [*frame, bid, "by0", "band_h"]).withColumn(
        "_band", F.explode(F.sequence(band(F.least("y1", "y2")), band(F.greatest("y1", "y2"))))
    ).drop("by0", "band_h")
    crosses = ((F.col("y1") > F.col("y")) != (F.col("y2") > F.col("y"))) & (F.col("x") < crossing_x(F.col("y")))
    return (
        cand.join(lines, [*frame, bid, "_band"]).groupBy(*frame, pid, bid)
        .agg(F.count_if(crosses).alias("_n")).filter("_n % 2 = 1").drop("_n")
    )


def overlapping_boxes(boxes: DataFrame, frame: Sequence[str], bid: str, attrs: Sequence[str], cell: int = 64) -> DataFrame:
    """Pairs of boxes ``[x0, x1) x [y0, y1)`` that share area, each pair once, with the shared area.

    Boxes meet on grid cells; a pair is kept only in the cell that holds the corner of its overlap, so
    no distinct is needed and no cell-by-cell pair rows are made. Dense cells are dealt to many tasks.
    """
    grid = boxes.withColumn("_gx", F.explode(F.expr(f"sequence(x0 DIV {cell}, (x1 - 1) DIV {cell})"))).withColumn(
        "_gy", F.explode(F.expr(f"sequence(y0 DIV {cell}, (y1 - 1) DIV {cell})"))
    )
    cols = [bid, "x0", "y0", "x1", "y1", *attrs]
    a = grid.select(*frame, "_gx", "_gy", *[F.col(c).alias(f"a_{c}") for c in cols])
    b = grid.select(*frame, "_gx", "_gy", *[F.col(c).alias(f"b_{c}") for c in cols])
    ox, oy = F.greatest("a_x0", "b_x0"), F.greatest("a_y0", "b_y0")
    wx, wy = F.least("a_x1", "b_x1") - ox, F.least("a_y1", "b_y1") - oy
    return (
        meet(a, b, [*frame, "_gx", "_gy"])
        .filter((F.col(f"a_{bid}") < F.col(f"b_{bid}")) & (wx > 0) & (wy > 0))
        .filter((F.floor(ox / cell) == F.col("_gx")) & (F.floor(oy / cell) == F.col("_gy")))
        .withColumn("area", (wx * wy).cast("bigint"))
    )


def cap_disc_offsets(area: float) -> list[tuple[int, int]]:
    """Cells of a disc of the given area."""
    return disc_offsets((area / 3.141592653589793) ** 0.5)
