"""Comparing two sources of places by position and name."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweave.functions.places import name_key
from cellweave.operators.meet import meet
from cellweave.operators.ranking import exact_percentiles
from cellweave.session import cut_lineage, numbered


def _at_cells(points: DataFrame, radius: float) -> DataFrame:
    return points.withColumns({"_cx": F.floor(F.col("x") / radius), "_cy": F.floor(F.col("y") / radius)})


def _around(points: DataFrame, radius: float) -> DataFrame:
    """Each point once per cell of its 3 x 3 neighbourhood."""
    return numbered(_at_cells(points, radius), "_s", 9).withColumns({
        "_cx": F.expr("_cx + _s DIV 3 - 1"), "_cy": F.expr("_cy + _s % 3 - 1")
    }).drop("_s")


def pairs_within(left: DataFrame, right: DataFrame, keys: list[str], radius: float, extra: list[str]) -> DataFrame:
    """Pairs of distinct positions at most ``radius`` apart, with the row counts of both positions.

    Rows at one position (and name) are counted before the join, so many copies of one place make one
    pair, not all pairs. The range join is an equi-join on the grid cell plus the exact distance test; dense cells are
    dealt to many tasks.
    """
    cols = [*keys, *extra, "x", "y"]
    a = left.groupBy(*cols).agg(F.count("*").alias("na")).withColumnsRenamed({"x": "ax", "y": "ay"})
    b = right.groupBy(*cols).agg(F.count("*").alias("nb"))
    a = _at_cells(a.withColumns({"x": F.col("ax"), "y": F.col("ay")}), radius).drop("x", "y")
    d2 = (F.col("ax") - F.col("x")) * (F.col("ax") - F.col("x")) + (F.col("ay") - F.col("y")) * (F.col("ay") - F.col("y"))
    return (
        meet(a, _around(b, radius), [*keys, *extra, "_cx", "_cy"])
        .withColumn("d", F.sqrt(d2)).filter(F.col("d") <= radius).drop("_cx", "_cy")
    )


def name_matches(a: DataFrame, b: DataFrame, keys: list[str], radius: float) -> DataFrame:
    """One row per district: pairs of equal names within the radius, matched places, median distance."""
    an = a.withColumn("nk", name_key(F.col("name"))).filter("nk IS NOT NULL")
    bn = b.withColumn("nk", name_key(F.col("name"))).filter("nk IS NOT NULL")
    # four aggregates read the pairs, so they are written once
    pairs = cut_lineage(pairs_within(an, bn, keys, radius, ["nk"]).withColumn("w", F.col("na") * F.col("nb")))
    sums = pairs.groupBy(*keys).agg(F.sum("w").alias("pairs"))
    left = pairs.select(*keys, "nk", "ax", "ay", "na").distinct().groupBy(*keys).agg(F.sum("na").alias("a_matched"))
    right = pairs.select(*keys, "nk", "x", "y", "nb").distinct().groupBy(*keys).agg(F.sum("nb").alias("b_matched"))
    median = exact_percentiles(pairs, keys, "d", [0.5], weight="w")
    near = pairs_within(an, bn, keys, radius, []).groupBy(*keys).agg(F.sum(F.col("na") * F.col("nb")).alias("candidates"))
    named = an.groupBy(*keys).agg(F.count("*").alias("a_named"))
    out = named
    for part in (sums, left, right, median, near):
        out = out.join(part, keys, "left")
    return out
