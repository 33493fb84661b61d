"""Scores of drawings through their shortest chain."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellweave.operators.grids import dilate
from cellweave.operators.routes import MAX_LENGTH_RATIO, REASONS, verdicts

CLEAN_EXCESS_RATIO = 1.25
CHAIN_WIDTH = 3


def cell_rule_scores(walks: DataFrame, lengths: DataFrame, shares: DataFrame, lit: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Connected, length ratio, share of blocked chain cells and success, one row per walk."""
    n_lit = lit.groupBy(*keys).agg(F.count("*").alias("lit_cells"))
    return (
        walks.join(lengths, list(keys), "left").join(shares, list(keys), "left").join(n_lit, list(keys), "left")
        .withColumns({"connected": F.col("length_m").isNotNull(), "length_ratio": F.col("length_m") / F.greatest("teacher_m", F.lit(1e-6))})
        .withColumns({
            "success": F.coalesce((F.col("length_ratio") <= MAX_LENGTH_RATIO) & (F.col("blocked") == 0), F.lit(False)),
            "lit_cells": F.coalesce("lit_cells", F.lit(0)).cast("bigint"),
        })
    )


def cleanup_reason() -> Column:
    """0 own chain; else the teacher's path because 1 not connected, 2 on a building, 3 too long."""
    return F.when(~F.col("connected"), 1).when(F.col("success"), 0).when(F.col("blocked") > 0, 2).otherwise(3)


def cleanliness(chain: DataFrame, lit: DataFrame, keys: Sequence[str], side: int) -> DataFrame:
    """How much of a drawing is its own route: lit cells over the three wide chain, and their overlap."""
    wide = dilate(chain, keys, CHAIN_WIDTH, side).withColumn("c", F.lit(True))
    cells = lit.withColumn("l", F.lit(True)).join(wide, [*keys, "row", "col"], "full_outer")
    n = cells.groupBy(*keys).agg(
        F.count("c").alias("chain_cells"), F.count("l").alias("_lit"), F.count_if(F.col("c") & F.col("l")).alias("_both"), F.count("*").alias("_all")
    ).filter("chain_cells > 0")
    return n.withColumns({
        "excess_ratio": F.col("_lit") / F.col("chain_cells"), "clean": F.col("_lit") / F.col("chain_cells") <= CLEAN_EXCESS_RATIO,
        "iou_own_chain": F.col("_both") / F.col("_all"),
    })


def chain_polyline(chain: DataFrame, keys: Sequence[str], cell_m: float, px_per_m: float) -> DataFrame:
    """Cell centres from start to goal in image pixels."""
    last = chain.groupBy(*keys).agg(F.max("pos").alias("_last"))
    k = cell_m * px_per_m
    return chain.join(last, list(keys)).select(
        *keys, (F.col("_last") - F.col("pos")).alias("pos"), F.round((F.col("col") + 0.5) * k, 3).alias("px"), F.round((F.col("row") + 0.5) * k, 3).alias("py")
    )


def connected_markers(labels: DataFrame, walks: DataFrame, keys: Sequence[str], cell_m: float) -> DataFrame:
    """Do both markers touch one component within one cell, and how many metres of cells does it have."""
    ends = walks.select(*keys, F.explode(F.array(
        F.struct(F.lit(0).alias("e"), F.col("srow").alias("r"), F.col("scol").alias("c")), F.struct(F.lit(1).alias("e"), F.col("grow").alias("r"), F.col("gcol").alias("c"))
    )).alias("m"))
    around = F.array(*[F.struct(F.lit(i).alias("dy"), F.lit(j).alias("dx")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    near = ends.withColumn("o", F.explode(around)).select(*keys, "m.e", (F.col("m.r") + F.col("o.dy")).alias("row"), (F.col("m.c") + F.col("o.dx")).alias("col"))
    shared = near.join(labels, [*keys, "row", "col"]).groupBy(*keys, "label").agg(F.bool_or(F.col("e") == 0).alias("a"), F.bool_or(F.col("e") == 1).alias("b"))
    low = shared.filter("a AND b").groupBy(*keys).agg(F.min("label").alias("label"))
    size = labels.groupBy(*keys, "label").agg(F.count("*").alias("n"))
    hit = low.join(size, [*keys, "label"]).select(*keys, F.col("n"))
    return walks.select(*keys).join(hit, list(keys), "left").select(
        *keys, F.col("n").isNotNull().alias("connected"), (F.coalesce("n", F.lit(0)) * F.lit(float(cell_m))).alias("length_m")
    )


def rescoring(frame: DataFrame, points: DataFrame, buildings: DataFrame, side: int) -> DataFrame:
    """Verdicts of every line as it is and with moved points, in one pass, and how they differ: one row.

    ``frame``: crop_id, sx, sy, gx, gy, teacher_m, one route a window; ``points``: crop_id, pos, ``raw`` and ``moved``
    points. Both variants of a route are keyed rows of one vertex table, so buildings are joined once. ``rescued``
    counts lines that cross a building as drawn and are solved when moved.
    """
    variants = F.array(F.struct(F.lit(0).alias("v"), F.col("raw").alias("p")), F.struct(F.lit(1).alias("v"), F.col("moved").alias("p")))
    ident = (F.col("crop_id") * 2 + F.col("v")).alias("route_id")
    lines = points.select("crop_id", "pos", F.explode(variants).alias("o")).select("crop_id", "pos", "o.v", "o.p.x", "o.p.y").select(ident, "pos", "x", "y")
    routes = frame.withColumn("v", F.explode(F.array(F.lit(0), F.lit(1)))).select("*", ident)
    judged = verdicts(routes, lines, buildings, side)
    pair = judged.groupBy("crop_id").agg(*[F.max(F.when(F.col("v") == v, F.coalesce("reason", F.lit("")))).alias(n) for v, n in ((0, "a"), (1, "b"))])
    a, b = F.col("a") == "", F.col("b") == ""
    crossed, n = F.col("a") == REASONS[2], F.count("*")
    return pair.agg(
        n.alias("n"), F.count_if(a).alias("raw_solved"), F.count_if(crossed).alias("raw_crosses"), F.count_if(b).alias("moved_solved"),
        F.count_if(crossed & b).alias("rescued"), F.count_if(~a & b).alias("gained"), F.count_if(a & ~b).alias("lost"),
        F.round(F.count_if(a) / n, 6).alias("raw_share"), F.round(F.count_if(b) / n, 6).alias("moved_share"))
