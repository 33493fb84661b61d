"""Line-wise JSON: predictions, routes and metric series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave.functions.answers import POINTS, valid_points


def lines(spark: SparkSession, path: str) -> DataFrame:
    """Text lines with a position inside the source that grows with the line order."""
    return spark.read.text(path).select("value", F.monotonically_increasing_id().alias("line_no"))


def predictions(text: DataFrame) -> DataFrame:
    """``(route_id, points)`` from lines ``(value, line_no)``; broken lines are ignored, the last line of a route wins.

    Points that are no list of at least two pairs of finite numbers become null, the route stays known.
    """
    rec = F.from_json("value", f"route BIGINT, points {POINTS}", {"mode": "PERMISSIVE"})
    parsed = text.filter(F.try_parse_json("value").isNotNull()).select(rec.alias("r"), "line_no").filter("r.route IS NOT NULL")
    return parsed.groupBy(F.col("r.route").alias("route_id")).agg(F.max_by(F.struct(F.col("r.points").alias("p")), "line_no").alias("_l")).select(
        "route_id", valid_points(F.col("_l.p")).alias("points"))


def point_rows(preds: DataFrame) -> DataFrame:
    """Vertex table of predicted polylines."""
    return preds.select("route_id", F.posexplode("points").alias("pos", "p")).select(
        "route_id", "pos", F.col("p")[0].alias("x"), F.col("p")[1].alias("y"))


def eval_long(text: DataFrame, keys: Sequence[str], number: str = "double") -> DataFrame:
    """Metric series with open metric names to ``(keys, metric, value)``; run and step are ids, everything else a metric."""
    wide = text.select(F.from_json("value", f"MAP<STRING, {number}>").alias("m"))
    ids = {"run_id": "bigint", "step": "int"}
    named = wide.select(*[F.col("m")[k].cast(ids.get(k, "string")).alias(k) for k in keys], F.explode("m").alias("metric", "value"))
    return named.filter(~F.col("metric").isin(*keys) & F.col("value").isNotNull())
