"""Shadows and sunlit hours from height cells."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave.functions.solar import sun_position


def instants(spark: SparkSession, day_start_unix: int, step_minutes: int, lat: float, lon: float) -> DataFrame:
    """Sun position at the midpoint of every step of one UTC day; steps below the horizon are left out."""
    if 1440 % step_minutes:
        raise ValueError("the step must divide a day")
    at = spark.range(1440 // step_minutes).withColumn("unix", F.lit(float(day_start_unix)) + (F.col("id") + 0.5) * (step_minutes * 60))
    el, az = sun_position(lat, lon, F.col("unix"))
    return at.select(F.col("id").alias("instant"), el.alias("elevation"), az.alias("azimuth")).filter("elevation > 0")


def shadows(heights: DataFrame, suns: DataFrame, keys: Sequence[str], res: float = 1.0, max_dist: float | None = None) -> DataFrame:
    """Cells ``(keys, row, col, instant)`` reached by the shadow of a tall cell.

    A cell lies in shadow when k steps towards the sun stands something higher than k * res * tan(elevation).
    Seen from the tall cell, its shadow falls k steps away from the sun, so only tall cells are expanded, each only
    as far as its own height reaches (and ``max_dist``, if given); rasters never wrap, and shadows that fall beyond the
    given cells are dropped by the extent of their window. With the sun at or below the horizon every cell is dark.
    The sun positions of one day go along as an array; more than 1440 are refused.
    """
    if suns.count() > 1440:
        raise ValueError("more sun positions than minutes in a day")
    night = suns.filter("elevation <= 0").agg(F.collect_list("instant")).scalar()
    sun = suns.filter("elevation > 0").agg(F.collect_list(F.struct(
        "instant", F.tan(F.radians("elevation")).alias("t"), F.cos(F.radians("azimuth")).alias("ca"), F.sin(F.radians("azimuth")).alias("sa")
    ))).scalar()
    cast = heights.filter("height > 0").withColumn("_s", F.explode(sun)).select(
        *keys, "row", "col", "height", "_s.instant", F.col("_s.t").alias("_t"), F.col("_s.ca").alias("_ca"), F.col("_s.sa").alias("_sa")
    )
    far = F.col("height") / F.col("_t")
    reach = F.floor((far if max_dist is None else F.least(F.lit(max_dist), far)) / res)
    k = F.col("_k")
    extent = heights.groupBy(*keys).agg(F.min("row").alias("_r0"), F.max("row").alias("_r1"), F.min("col").alias("_c0"), F.max("col").alias("_c1"))
    span = F.floor(F.sqrt(F.pow(F.col("_r1") - F.col("_r0") + 1, 2) + F.pow(F.col("_c1") - F.col("_c0") + 1, 2))) + 1
    day = (
        cast.join(extent, list(keys)).withColumn("_n", F.least(reach, span)).filter("_n >= 1").withColumn("_k", F.explode(F.sequence(F.lit(1).cast("bigint"), "_n")))
        .filter(F.col("height") > k * res * F.col("_t"))
        .select(*keys, (F.col("row") - F.rint(-k * F.col("_ca")).cast("int")).alias("row"),
                (F.col("col") - F.rint(k * F.col("_sa")).cast("int")).alias("col"), "instant", "_r0", "_r1", "_c0", "_c1")
        .filter("row BETWEEN _r0 AND _r1 AND col BETWEEN _c0 AND _c1").drop("_r0", "_r1", "_c0", "_c1")
        .distinct()
    )
    return day.unionByName(heights.select(*keys, "row", "col", F.explode(night).alias("instant")))


def sunlit_hours(heights: DataFrame, suns: DataFrame, keys: Sequence[str], step_minutes: int, res: float = 1.0, max_dist: float | None = None) -> DataFrame:
    """Hours of direct sun per cell over the day; null inside buildings.

    ``heights``: keys, row, col, height, built for every cell of the windows.
    """
    lit_steps = suns.agg(F.count("*")).scalar()
    dark = shadows(heights, suns, keys, res, max_dist).groupBy(*keys, "row", "col").agg(F.count("*").alias("_d"))
    return heights.join(dark, [*keys, "row", "col"], "left").select(
        *keys, "row", "col", F.when(~F.col("built"), (lit_steps - F.coalesce("_d", F.lit(0))) * (step_minutes / 60.0)).alias("hours")
    )
