"""Shards cut from a Hilbert-curve order of metadata (operator 13)."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellweave.llm.common import column, in_order
from cellweave.llm.packing import hilbert
from cellweave.session import cut_lineage

BITS = 5  # 32 steps a dimension
DIMS = ("source", "lang", "n_chars")


def steps(rows: DataFrame, dim: str, total: int, bits: int = BITS) -> list:
    """The smallest value of each step of a dimension, ascending, nulls left out.

    A value belongs to step floor(2^bits * rows with a smaller value / all rows), so steps hold about equal numbers of
    rows, and values of a large share have a step of their own. Rows are counted by value first; running sums over
    the distinct values come from :func:`in_order`. At most 2^bits values are returned.
    """
    counts = cut_lineage(rows.groupBy(F.col(dim).alias("value")).agg(F.count("*").alias("n")).withColumn("all", F.lit(0)))
    step = F.expr(f"shiftleft(before, {bits}) div {max(total, 1)}")
    first = in_order(counts, "all", ["value"], "n").filter("value IS NOT NULL").groupBy(step.alias("step")).agg(F.min("value").alias("value"))
    return [(r["step"], r["value"]) for r in first.orderBy("step").collect()]


def quantised(value: Column, found: list) -> Column:
    """The step of a value; null is step 0."""
    out = F.lit(0)
    for step, low in found:
        out = F.when(value >= F.lit(low), F.lit(int(step))).otherwise(out)
    return out


def curve_order(docs: DataFrame, dims: Sequence[str] = DIMS, bits: int = BITS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, size, crc, key, curve, rank, before) of each row: its place on the curve and the bytes before it.

    ``size`` is the UTF-8 length of the text plus 1 (null: 1). Rows of one curve cell are ordered by text checksum, id
    and place of reading, so copies with equal metadata are neighbours and a cell of any share spreads over tasks.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = cut_lineage(docs.select(
        F.col(id_col).alias("id"), (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text.cast("binary")).alias("crc"),
        *[F.col(c).alias(f"d{k}") for k, c in enumerate(dims)], F.monotonically_increasing_id().alias("row")))
    total = rows.count()
    bins = [quantised(F.col(f"d{k}"), steps(rows, f"d{k}", total, bits)).cast("long").alias(f"b{k}") for k in range(len(dims))]
    names = [f"b{k}" for k in range(len(dims))]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = np.stack([column(batch, c).to_numpy(zero_copy_only=False) for c in names], 1)
            yield pa.RecordBatch.from_arrays([*[column(batch, c) for c in kept], pa.array(hilbert(points, bits) if len(points) else np.zeros(0, np.int64))], [*kept, "curve"])

    kept = ["id", "size", "crc", "row"]
    schema = f"id {rows.schema['id'].dataType.simpleString()}, size long, crc long, row long, curve long"
    placed = cut_lineage(rows.select(*kept, *bins).mapInArrow(place, schema).withColumn("all", F.lit(0)))
    return in_order(placed, "all", ["curve", "crc", "id", "row"], "size")


def shards(docs: DataFrame, count: int = 16, dims: Sequence[str] = DIMS, bits: int = BITS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, ``size``, ``text_crc32``, ``law``, ``shard``, ``slot``, ``grown_shard`` and ``curve``.

    Metadata dimensions are quantised to 2^bits steps of about equal numbers of rows, rows are sorted by the Hilbert
    index of their steps, and the order is cut into ``count`` runs: a row goes to the run in which the middle of its
    bytes falls, so the bytes of a shard differ from an equal share by less than the largest size. A shard so spans a
    small box of every dimension, and readers skip files by the smallest and largest values they hold.

    Null, empty and very long texts, null ids and repeated rows are placed like others; nulls of a dimension are its
    lowest step. With fewer rows than shards, or one text above a share, some shards stay empty. An empty table gives
    no rows. Other columns are not read.
    """
    placed = curve_order(docs, dims, bits, id_col, text_col)
    total = max(placed.agg(F.sum("size")).first()[0] or 0, 1)
    at = F.expr(f"cast((cast({count} AS DECIMAL(20,0)) * (2 * before + size)) div {2 * total} AS INT)").alias("shard")
    cut = placed.select("id", "size", "crc", "curve", "rank", at)
    first = F.broadcast(cut.groupBy("shard").agg(F.min("rank").alias("first")))  # one row a shard
    return cut.join(first, "shard").select(
        F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard",
        (F.col("rank") - F.col("first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "curve")
