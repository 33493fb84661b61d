"""Ranks and percentiles that stay balanced when one group holds a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellweave.session import cut_lineage, small_side


def tiered_rank(df: DataFrame, keys: Sequence[str], tiers: Sequence[str], name: str = "rn") -> DataFrame:
    """``row_number() over (partition by keys order by tiers)`` without sorting a whole group in one task.

    The order columns are taken as tiers. Rows are counted per tier prefix first (partial aggregation
    absorbs hot groups), running sums over the small count tables give each prefix its offset, and only
    rows that share all but the last tier are sorted together. Keys and tiers must not be null.
    """
    keys, tiers = list(keys), list(tiers)
    counts = df.groupBy(*keys, *tiers[:-1]).agg(F.count("*").alias("_n"))
    offsets = counts.withColumn("_off", F.lit(0).cast("bigint")) if len(tiers) == 1 else None
    for depth in range(len(tiers) - 1, 0, -1):
        outer = keys + tiers[: depth - 1]
        level = counts if depth == len(tiers) - 1 else counts.groupBy(*outer, tiers[depth - 1]).agg(
            F.sum("_n").alias("_n")
        )
        w = Window.partitionBy(*outer).orderBy(tiers[depth - 1]).rowsBetween(Window.unboundedPreceding, -1)
        level = level.select(*outer, tiers[depth - 1], F.coalesce(F.sum("_n").over(w), F.lit(0)).alias(f"_o{depth}"))
        if offsets is None:
            offsets = level.withColumnRenamed(f"_o{depth}", "_off")
        else:
            offsets = (
                offsets.join(level.hint("merge"), outer + [tiers[depth - 1]])
                .withColumn("_off", F.col("_off") + F.col(f"_o{depth}"))
                .drop(f"_o{depth}")
            )
    inner = Window.partitionBy(*keys, *tiers[:-1]).orderBy(tiers[-1])
    if len(tiers) == 1:
        return df.withColumn(name, F.row_number().over(inner).cast("bigint"))
    ranked = df.withColumn("_rn", F.row_number().over(inner))
    return (
        ranked.join(offsets.hint("merge"), keys + tiers[:-1])
        .withColumn(name, (F.col("_off") + F.col("_rn")).cast("bigint"))
        .drop("_off", "_rn")
    )


BUCKETS = 1024


def exact_percentiles(df: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float], suffix: str = "", weight: str | None = None) -> DataFrame:
    """Exact linearly interpolated percentiles per group, one row per group, columns ``p<prob*100>``.

    Values are counted first. Then the span that holds a wanted rank is narrowed level by level: it is cut into
    ``BUCKETS`` equal parts between its own smallest and largest value, and the part with the rank is the next span,
    until it is one value. A level is one aggregate whatever the size of a group, a task sorts one span's parts at
    most, and no width has to be chosen. Nulls and values that are not finite are left out. With ``weight`` a row
    stands for that many equal values.
    """
    keys = list(keys)
    by = keys or ["_all"]
    base = df if keys else df.withColumn("_all", F.lit(1))
    counts = cut_lineage(
        base.filter(F.abs(F.col(value).cast("double")) < float("inf")).groupBy(*by, F.col(value).cast("double").alias("_v")).agg((F.sum(weight) if weight else F.count("*")).alias("_n"))
    )
    wanted = F.array(*[F.struct(F.lit(float(p)).alias("p"), F.lit(float(side)).alias("side")) for p in probs for side in (0, 1)])
    pos = F.col("_w.p") * (F.col("_total") - 1)
    ranks = cut_lineage(
        counts.groupBy(*by).agg(F.sum("_n").alias("_total"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
        .withColumn("_w", F.explode(wanted))
        .withColumn("_r", F.floor(pos) + F.col("_w.side").cast("bigint"))
        .withColumn("_wt", F.when(F.col("_w.side") == 0, 1 - (pos - F.floor(pos))).otherwise(pos - F.floor(pos)))
        .filter("_wt > 0")
        .select(*by, F.col("_w.p").alias("_p"), "_wt", "_r", "_lo", "_hi", F.lit(0).cast("bigint").alias("_before"))
    )
    span = [*by, "_lo", "_hi"]
    while not ranks.filter("_lo < _hi").isEmpty():
        open_ = ranks.filter("_lo < _hi")
        near = counts.join(small_side(open_.select(*span, "_before").distinct()), by).filter("_v BETWEEN _lo AND _hi")
        part = F.least(F.floor((F.col("_v") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * BUCKETS), F.lit(BUCKETS - 1))
        parts = near.groupBy(*span, "_before", part.alias("_b")).agg(F.sum("_n").alias("_m"), F.min("_v").alias("_nlo"), F.max("_v").alias("_nhi"))
        run = Window.partitionBy(*span).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
        found = parts.select(*span, "_m", "_nlo", "_nhi", (F.col("_before") + F.coalesce(F.sum("_m").over(run), F.lit(0))).alias("_from"))
        narrowed = open_.hint("merge").join(found, span).filter("_r >= _from AND _r < _from + _m").select(
            *by, "_p", "_wt", "_r", F.col("_nlo").alias("_lo"), F.col("_nhi").alias("_hi"), F.col("_from").alias("_before"))
        ranks = cut_lineage(ranks.filter("_lo >= _hi").unionByName(narrowed), ranks)
    out = ranks.groupBy(*by).agg(*[
        F.sum(F.when(F.col("_p") == float(p), F.col("_lo") * F.col("_wt"))).alias(f"p{round(p * 100)}{suffix}")
        for p in probs
    ])
    return out if keys else out.drop("_all")


def first_row(df: DataFrame, keys: Sequence[str], order: Sequence[Column], cols: Sequence[str]) -> DataFrame:
    """The first row of each group by a total order, as a partial aggregate instead of a sorted window."""
    best = F.min_by(F.struct(*cols), F.struct(*order)).alias("_r")
    return df.groupBy(*keys).agg(best).select(*keys, *[F.col(f"_r.{c}").alias(c) for c in cols])


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, name: str = "rn") -> DataFrame:
    """Top k per group. Spark limits each group inside every task before the shuffle, so hot groups stay small."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col(name) <= k)
