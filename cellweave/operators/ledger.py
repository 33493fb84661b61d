"""Run ledger: metric rows, run records, upserts and summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellweave.operators.ranking import first_row


def _last(rows: DataFrame, keys: Sequence[str], order: str, cols: Sequence[str]) -> DataFrame:
    """The row of largest ``order`` per key; numbers, times and texts all order, null comes before everything."""
    best = F.max_by(F.struct(*cols), F.struct(order)).alias("_r")
    return rows.groupBy(*keys).agg(best).select(*keys, *[F.col(f"_r.{c}").alias(c) for c in cols])


def upsert(table: DataFrame, changes: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Insert or replace by key, the latest ``order`` wins; a partial aggregate, no sort of a hot key."""
    both = table.unionByName(changes)
    rest = [c for c in both.columns if c not in keys]
    return _last(both, keys, order, rest).select(*table.columns)


def latest(rows: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    rest = [c for c in rows.columns if c not in keys]
    return _last(rows, keys, order, rest)


def delta(rows: DataFrame, keys: Sequence[str], lo: int, hi: int) -> DataFrame:
    """Value at the last step minus value at the first step of a range; null with fewer than two steps."""
    inside = rows.filter(F.col("step").between(lo, hi))
    d = F.max_by("value", "step") - F.min_by("value", "step")
    return inside.groupBy(*keys).agg(F.when(F.count("*") >= 2, d).alias("delta"))


def best_record(records: DataFrame, key: str, cols: Sequence[str]) -> DataFrame:
    """Finished records first, then the most steps; records without steps come last."""
    order = [F.col("aborted").cast("int"), -F.coalesce("steps", F.lit(-1)), F.col("seq")]
    return first_row(records, [key], order, cols)


def running_offsets(df: DataFrame, ident: str, size: Column, block: int = 4096) -> DataFrame:
    """Start of each ragged list when lists are laid end to end in id order.

    Sizes are summed per block of ids and per block of blocks; the running sums of the levels add up, so no task
    sums over all rows.
    """
    rows = df.select(ident, size.alias("n"), F.floor(F.col(ident) / block).alias("_b"), F.floor(F.col(ident) / (block * block)).alias("_bb"))
    blocks = rows.groupBy("_bb", "_b").agg(F.sum("n").alias("s"))
    tops = blocks.groupBy("_bb").agg(F.sum("s").alias("s")).withColumn("_one", F.lit(0))

    def before(col: str, part: str, order: str) -> Column:
        w = Window.partitionBy(part).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        return F.coalesce(F.sum(col).over(w), F.lit(0))

    top = tops.select("_bb", before("s", "_one", "_bb").alias("o2"))
    mid = blocks.select("_bb", "_b", before("s", "_bb", "_b").alias("o1"))
    low = rows.select(ident, "n", "_bb", "_b", before("n", "_b", ident).alias("o0"))
    return low.join(mid, ["_bb", "_b"]).join(top, "_bb").select(ident, "n", (F.col("o0") + F.col("o1") + F.col("o2")).alias("offset"))


def same_sequence(observed: DataFrame, wanted: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Is the observed token sequence equal to the wanted one, position by position; no list is built."""
    joined = observed.withColumnRenamed("token", "a").join(wanted.withColumnRenamed("token", "b"), [*keys, "pos"], "full_outer")
    return joined.groupBy(*keys).agg(F.bool_and(F.coalesce(F.col("a") == F.col("b"), F.lit(False))).alias("same"), F.count("a").alias("passes"))


def merge_shards(shards: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Statistics of shards: counts added, seconds the longest, means weighted again by their counts."""
    return shards.groupBy(*keys).agg(
        F.count("*").alias("shards"), F.sum("n").alias("n"), F.max("seconds").alias("seconds_max"),
        F.round(F.sum(F.col("mean") * F.col("n")) / F.sum("n"), 9).alias("mean"),
    )
