"""Equi-joins on keys that may be hot on both sides."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweave.session import cut_lineage, small_side

BLOCK_ROWS = 4096


def _side(df: DataFrame, hot: DataFrame, keys: Sequence[str], own: str, other: str, across: str, along: str) -> DataFrame:
    """Rows with their own block number as ``across``, once for every block of the other side as ``along``."""
    one = F.lit(1).cast("bigint")
    known = df.join(hot, list(keys), "left")
    dealt = known.withColumn(across, F.pmod(F.xxhash64(*[F.col(c) for c in df.columns]), F.coalesce(F.col(own), one)))
    last = F.coalesce(F.col(other), one) - 1
    return dealt.withColumn(along, F.explode(F.sequence(F.lit(0).cast("bigint"), last))).drop("_ka", "_kb")


def dealt(left: DataFrame, right: DataFrame, keys: Sequence[str], block: int = BLOCK_ROWS) -> tuple[DataFrame, DataFrame, list[str]]:
    """Both sides and the columns to join them on, so that no combination of these holds many more than ``block`` squared pairs.

    The rows of every key are counted on both sides. A key with more than ``block`` squared pairs is cut into blocks of about
    ``block`` rows on either side; every block of one side is sent to every block of the other, so each pair of rows
    meets exactly once. Rows go to blocks by a hash of their values: a task that runs again deals them alike, and rows
    that repeat share a block, so copies should be counted before. Without such a key both sides come back as they are.
    """
    keys = list(keys)
    zero, one = F.lit(0).cast("bigint"), F.lit(1).cast("bigint")
    counts = (
        left.select(*keys, one.alias("_a"), zero.alias("_b")).union(right.select(*keys, zero.alias("_a"), one.alias("_b")))
        .groupBy(*keys).agg(F.sum("_a").alias("_a"), F.sum("_b").alias("_b"))
        # the quotient cannot overflow as the product could
        .filter((F.col("_b") > 0) & (F.col("_a") > F.lit(block * block) / F.col("_b")))
        .select(*keys, F.ceil(F.col("_a") / block).alias("_ka"), F.ceil(F.col("_b") / block).alias("_kb"))
    )
    hot = cut_lineage(counts)
    if hot.isEmpty():
        return left, right, keys
    hot = small_side(hot)
    return _side(left, hot, keys, "_ka", "_kb", "_i", "_j"), _side(right, hot, keys, "_kb", "_ka", "_j", "_i"), [*keys, "_i", "_j"]


def meet(left: DataFrame, right: DataFrame, keys: Sequence[str], block: int = BLOCK_ROWS) -> DataFrame:
    """Inner join on ``keys``, hot keys dealt to many tasks; see :func:`dealt`. Null keys meet nothing.

    Either side may be large where its files are small, so neither goes through the driver on an estimate.
    """
    a, b, on = dealt(left, right, keys, block)
    return a.hint("merge").join(b, on).drop("_i", "_j")
