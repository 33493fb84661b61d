"""Fronts, pass schedules and drawings derived from walking distances."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellweave.operators.grids import dilate, inside, spread, square

# Fixed values of the stored field
SUB_CELL_SPAN_M = 2.9  # a 2 m cell holds its minimum; its maximum is at most this much more
PATH_WIDTH = 3


def two_metre_field(metres: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Minimum walking distance per 2 m cell, in 2 m units; null where nothing was reached."""
    return metres.groupBy(*keys, F.expr("CAST(row DIV 2 AS INT) AS r2"), F.expr("CAST(col DIV 2 AS INT) AS c2")).agg(
        F.rint(F.min("metres") / 2).cast("int").alias("d2")
    )


def n_goal(goal_m: Column, horizon: float) -> Column:
    """Number of fronts to the goal; an unreachable goal counts as one."""
    return F.when(goal_m > 0, F.floor(goal_m / horizon) + 1).otherwise(1).cast("int")


def cell_min_max(field: DataFrame, keys: Sequence[str], s: int) -> DataFrame:
    """Smallest and largest walking metres per output cell; an unreached part leaves the maximum open (null)."""
    return field.groupBy(*keys, F.expr(f"CAST(r2 DIV {s} AS INT) AS gr"), F.expr(f"CAST(c2 DIV {s} AS INT) AS gc")).agg(
        (F.min("d2") * 2).alias("dmin"), F.when(F.count("d2") == F.count("*"), F.max("d2") * 2 + SUB_CELL_SPAN_M).alias("dmax")
    )


def rings(minmax: DataFrame, goals: DataFrame, keys: Sequence[str], horizon: float) -> DataFrame:
    """Cells on ring j: the line at j * horizon runs through them.

    The rings of a cell follow from its own smallest and largest distance; a cell without a largest one goes on to the
    last front of its window (and lies on one ring at least).
    """
    low = F.floor(F.col("dmin") / horizon) + 1
    high = F.coalesce(F.floor(F.col("dmax") / horizon), F.greatest(F.col("n_goal"), low))
    own = minmax.filter("dmin IS NOT NULL").join(goals.select(*keys, "n_goal"), list(keys))
    return own.withColumn("j", F.explode(F.when(high >= low, F.sequence(low, high)))).withColumn("j", F.col("j").cast("int"))


def start_disc(walks: DataFrame, keys: Sequence[str], s: int, side: int) -> DataFrame:
    """The 3 x 3 cells round the start."""
    at = walks.selectExpr(*keys, f"CAST(srow DIV {s} AS INT) AS row", f"CAST(scol DIV {s} AS INT) AS col")
    return dilate(at, keys, 3, side).withColumnsRenamed({"row": "gr", "col": "gc"})


def schedule(goals: DataFrame) -> DataFrame:
    """All passes of a search: forward over the fronts, back over them, then the drawing. Keeps the other columns' keys."""
    n, pos = F.col("n_goal"), F.col("pos")
    kind = (
        F.when(pos == 2 * n, "draw").when(pos == 2 * n - 1, "origin").when(pos >= n, "back")
        .when((pos == n - 1) & (n > 1), "reach").when(pos == 0, "first").otherwise("step")
    )
    token = F.when(pos == 2 * n, "DONE").when(pos == 2 * n - 1, "DRAW").when((pos >= n - 1) & ((n > 1) | (pos > 0)), "BACK").otherwise("SEARCH")
    passes = goals.withColumn("pos", F.explode(F.sequence(F.lit(0), 2 * n)))
    return passes.withColumns({"kind": kind, "token": token}).drop("n_goal")


def forward_drawings(goals: DataFrame, minmax: DataFrame, disc: DataFrame, keys: Sequence[str], horizon: float) -> DataFrame:
    """Cells on the drawing after each forward pass k, with whether they were on it before.

    Each cell is sent only to the passes it is lit in, from its own ring on; the number of passes is bounded by
    the distance to the goal.
    """
    n = goals.select(*keys, "n_goal")
    ring = rings(minmax, goals, keys, horizon).filter("j <= n_goal").select(*keys, "gr", "gc", "j", "n_goal")
    start = disc.join(n, list(keys)).select(*keys, "gr", "gc", F.lit(0).alias("j"), "n_goal")
    first = ring.unionByName(start).groupBy(*keys, "gr", "gc").agg(F.min("j").alias("j"), F.max("n_goal").alias("n_goal"))
    return first.withColumn("k", F.explode(F.sequence(F.greatest(F.col("j") - 1, F.lit(0)), F.col("n_goal") - 1))).select(
        *keys, "k", "gr", "gc", (F.col("j") <= F.col("k")).alias("pad_in")
    )


def way_cells(way: DataFrame, field: DataFrame, keys: Sequence[str], s: int, side: int, beyond_m: float) -> DataFrame:
    """Cells of the way back at least ``beyond_m`` from the start, widened to the drawing's line width."""
    px = way.withColumns({"r2": F.expr("CAST(row DIV 2 AS INT)"), "c2": F.expr("CAST(col DIV 2 AS INT)")}).join(field, [*keys, "r2", "c2"])
    cells = px.filter(F.col("d2") * 2 >= beyond_m).selectExpr(*keys, f"CAST(row DIV {s} AS INT) AS row", f"CAST(col DIV {s} AS INT) AS col").distinct()
    return dilate(cells, keys, PATH_WIDTH, side).withColumnsRenamed({"row": "gr", "col": "gc"})


def way_reach(way: DataFrame, field: DataFrame, keys: Sequence[str], s: int, side: int) -> DataFrame:
    """Cells of the way back at line width with ``d``, the largest walking distance of the way's cells they stand for.

    A cell is lit for every lower bound up to its ``d``, so one table serves the drawings of all passes.
    """
    px = way.withColumns({"r2": F.expr("CAST(row DIV 2 AS INT)"), "c2": F.expr("CAST(col DIV 2 AS INT)")}).join(field, [*keys, "r2", "c2"])
    cells = px.groupBy(*keys, F.expr(f"CAST(row DIV {s} AS INT) AS gr"), F.expr(f"CAST(col DIV {s} AS INT) AS gc")).agg((F.max("d2") * 2).alias("d"))
    wide = spread(cells, square(PATH_WIDTH), "gr", "gc").filter(inside("gr", "gc", side))
    return wide.groupBy(*keys, "gr", "gc").agg(F.max("d").alias("d"))


def backward_drawings(goals: DataFrame, minmax: DataFrame, disc: DataFrame, reach: DataFrame, keys: Sequence[str], horizon: float) -> DataFrame:
    """Cells lit before or after each pass from the goal back, and of the drawing pass at the end.

    Pass ``j`` takes front j away: before it the start disc, the fronts up to j and the way from j * horizon on are lit,
    after it those of j - 1. ``j = 0`` is the drawing pass: the whole way with the disc before, the way alone after.
    Each cell is sent only to passes in which it is lit.
    """
    n = goals.select(*keys, "n_goal")
    ring = rings(minmax, goals, keys, horizon).groupBy(*keys, "gr", "gc").agg(F.min("j").alias("j0"))
    none = F.lit(None).cast("int")
    lit = ring.select(*keys, "gr", "gc", "j0", none.alias("d"), F.lit(False).alias("disc")).unionByName(
        disc.select(*keys, "gr", "gc", F.lit(0).alias("j0"), none.alias("d"), F.lit(True).alias("disc"))
    ).unionByName(reach.select(*keys, "gr", "gc", none.alias("j0"), F.col("d").cast("int").alias("d"), F.lit(False).alias("disc")))
    cells = lit.groupBy(*keys, "gr", "gc").agg(F.min("j0").alias("j0"), F.max("d").alias("d"), F.bool_or("disc").alias("disc")).join(n, list(keys))
    upto = F.floor(F.col("d") / horizon)  # the way is lit before pass j up to here
    before = lambda j: F.coalesce(F.col("j0") <= j, F.lit(False)) | F.coalesce(upto >= j, F.lit(False))
    passes = F.filter(F.sequence(F.lit(1), "n_goal"), lambda j: before(j) | before(j - 1))
    back = cells.withColumn("j", F.explode(passes)).select(*keys, "j", "gr", "gc", before(F.col("j")).alias("pad_in"), before(F.col("j") - 1).alias("pad_out"))
    draw = cells.filter(F.col("disc") | F.col("d").isNotNull()).select(*keys, F.lit(0).alias("j"), "gr", "gc", F.lit(True).alias("pad_in"), F.col("d").isNotNull().alias("pad_out"))
    return back.unionByName(draw)


def source_slot(kind: Column, k_in: Column, j: Column, n_goal: Column) -> Column:
    """Slot of the pass whose drawing is this pass's input; -1 where the input is the start disc."""
    return (
        F.when(kind.isin("first", "step", "reach"), k_in - 1).when(kind.isin("back", "origin"), 2 * n_goal - j - 1)
        .when(kind == "draw", 2 * n_goal - 1).otherwise(-1)
    )
