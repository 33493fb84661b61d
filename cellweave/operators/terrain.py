"""Filling and comparing height cells."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweave.operators.grids import disc_offsets, spread
from cellweave.operators.ranking import exact_percentiles


def fill_ground(cells: DataFrame, keys: Sequence[str], radius: float) -> DataFrame:
    """Cells without a reading take the distance-weighted mean of the readings within the radius.

    Readings pass through unchanged; cells with no reading near stay null. Only the missing cells look round.
    """
    around = [o for o in disc_offsets(radius) if o != (0, 0)]
    holes = cells.filter("height IS NULL").select(*keys, F.col("row").alias("r0"), F.col("col").alias("c0"), "row", "col")
    seen = cells.filter("height IS NOT NULL").select(*keys, "row", "col", "height")
    d2 = F.col("_o.dy") * F.col("_o.dy") + F.col("_o.dx") * F.col("_o.dx")
    near = spread(holes, around).select(*keys, "r0", "c0", "row", "col", d2.alias("_d2")).join(seen, [*keys, "row", "col"])
    filled = near.groupBy(*keys, F.col("r0").alias("row"), F.col("c0").alias("col")).agg(
        (F.sum(F.col("height") / F.col("_d2")) / F.sum(1.0 / F.col("_d2"))).alias("_v")
    )
    return cells.join(filled, [*keys, "row", "col"], "left").select(
        *keys, "row", "col", F.coalesce("height", "_v").alias("ground"), F.col("height").isNotNull().alias("observed")
    )


def cross_check(pairs: DataFrame) -> DataFrame:
    """Two sources at the same points ``(a, b)``: correlation and spread of the difference."""
    p = pairs.select("a", "b", (F.col("b") - F.col("a")).alias("d"), F.abs(F.col("b") - F.col("a")).alias("e"), F.lit(1).alias("all"))
    base = p.groupBy("all").agg(F.count("*").alias("n"), F.round(F.corr("a", "b"), 6).alias("r"))
    diff = exact_percentiles(p, ["all"], "d", [0.05, 0.5, 0.95])
    size = exact_percentiles(p, ["all"], "e", [0.5], suffix="_abs")
    return base.join(diff, "all").join(size, "all").select(
        "n", "r", F.round("p50_abs", 6).alias("median_abs"), F.round("p50", 6).alias("median_diff"), F.round("p5", 6).alias("p5"), F.round("p95", 6).alias("p95")
    )
