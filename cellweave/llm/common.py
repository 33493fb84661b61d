"""Words, ids, shared folders and connected components, as the operators of this subpackage need them."""

from __future__ import annotations

import ctypes
import sys
import types
from collections.abc import Callable, Iterator
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cellweave.session import cut_lineage, scratch_folder

WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_bucket(ident: Column, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``; a null id counts as bucket -1 and so as neither held out nor labelled."""
    return F.coalesce(F.crc32(ident.cast("string").cast("binary")) % n, F.lit(-1))


def words(text: str | None) -> list[bytes]:
    """Words between ASCII white space with A-Z lowered: exactly what ``bytes`` does by default."""
    return text.encode().lower().split() if text else []


def per_process(name: str, make: Callable):
    """A value made once in each Python worker. Code pickled by value has no module to keep it in."""
    store = sys.modules.setdefault("_cellweave_llm_values", types.ModuleType("_cellweave_llm_values")).__dict__
    if name not in store:
        store[name] = make()
    return store[name]


def slices(batches: Iterator[pa.RecordBatch], text: str, limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that the texts of each hold about ``limit`` bytes; a single longer text stays whole."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(text))), 0).to_numpy(zero_copy_only=False))
        at = 0
        while at < batch.num_rows:
            before = sizes[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(sizes, before + limit, "right")))
            yield batch.slice(at, end - at)
            at = end


def give_back() -> None:
    """Return the memory that finished batches of this worker held to the machine: workers stay, and so would their free lists."""
    pa.default_memory_pool().release_unused()
    trim = per_process("malloc_trim", lambda: getattr(ctypes.CDLL(None), "malloc_trim", None))  # glibc only
    if trim is not None:
        trim(0)


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts of an Arrow array as one byte array with 64-bit offsets; nulls are empty."""
    texts = pc.fill_null(texts, "").cast(pa.large_binary())
    ends = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[ends[0] : ends[-1]], ends - ends[0]


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions of the rows ``starts[i] .. starts[i] + lengths[i]``, one after the other."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)


def encoded_chunks(data: np.ndarray, offsets: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """Distinct byte strings ``data[offsets[i]:offsets[i+1]]`` and the index of each string among them."""
    if len(offsets) < 2:
        return [], np.zeros(0, np.int64)
    whole = pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(np.ascontiguousarray(offsets, np.int64)), pa.py_buffer(np.ascontiguousarray(data))]
    ).dictionary_encode()
    return whole.dictionary.to_pylist(), whole.indices.to_numpy(zero_copy_only=False).astype(np.int64)


def batch_words(texts: pa.Array) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Distinct words of a batch, the index of every word among them in order, and the number of words of each text."""
    data, ends = text_bytes(texts)
    if not len(data):
        return [], np.zeros(0, np.int64), np.zeros(len(texts), np.int64)
    low = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
    space = (low == 32) | ((low >= 9) & (low <= 13))
    first = ~space
    first[1:] &= space[:-1]
    heads = ends[:-1][np.diff(ends) > 0]
    first[heads] = ~space[heads]
    last = ~space
    last[:-1] &= space[1:]
    last[ends[1:][np.diff(ends) > 0] - 1] |= ~space[ends[1:][np.diff(ends) > 0] - 1]
    start, stop = np.flatnonzero(first), np.flatnonzero(last) + 1
    n_words = np.searchsorted(start, ends[1:]) - np.searchsorted(start, ends[:-1])
    lengths = stop - start
    packed = low[~space]
    distinct, index = encoded_chunks(packed, np.concatenate([[0], np.cumsum(lengths)]))
    return distinct, index, n_words


def shared_path(spark: SparkSession) -> tuple[str, str]:
    """A new folder under ``spark.checkpoint.dir`` as a path that processes open themselves, and as Spark names it.

    Memory-mapping needs a folder that is mounted on all machines under one path (a network file system or a mount of
    an object store). A store that only Spark's readers can open is refused here instead of failing inside a task.
    """
    folder = scratch_folder(spark)
    parts = urlparse(folder)
    if parts.scheme not in ("", "file"):
        raise ValueError(f"memory-mapped arrays need spark.checkpoint.dir on a mounted file system, not {parts.scheme}:")
    return unquote(parts.path), folder


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of the edges as (node, root); ``root`` is the same for all nodes of a component.

    Every round contracts each node into the neighbour (or itself) of smallest random priority, so the number of
    nodes that still have edges falls by a constant factor, whatever the shape of the graph. The maps of the rounds
    are composed at the end, one after the other, and the result is a written table. Hubs are met by partial aggregation and by inner joins that AQE may split.
    """
    spark = edges.sparkSession
    left = cut_lineage(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).filter("a <> b").distinct())
    maps = []
    while not left.isEmpty():
        salt = F.lit(len(maps))
        both = left.union(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        best = both.groupBy("a").agg(F.min(F.struct(F.xxhash64("b", salt).alias("p"), F.col("b"))).alias("m"))
        own = F.struct(F.xxhash64("a", salt).alias("p"), F.col("a").alias("b"))
        step = cut_lineage(best.select(F.col("a").alias("node"), F.least(own, F.col("m"))["b"].alias("rep")))
        maps.append(step)
        at, bt = step.select(F.col("node").alias("a"), F.col("rep").alias("ra")), step.select(F.col("node").alias("b"), F.col("rep").alias("rb"))
        moved = left.join(at, "a").join(bt, "b").filter("ra <> rb")
        left = cut_lineage(moved.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), left)
    if not maps:
        kind = edges.schema[a].dataType
        return spark.createDataFrame([], f"node {kind.simpleString()}, root {kind.simpleString()}")
    roots = maps[-1].select("node", F.col("rep").alias("root"))
    written = None
    for step in reversed(maps[:-1]):  # each map is a fraction of the one before it, so the writes add up to a few tables
        up = roots.select(F.col("node").alias("rep"), "root")
        roots = written = cut_lineage(step.join(up, "rep", "left").select("node", F.coalesce("root", "rep").alias("root")), written)
    return roots


ROWS_A_PART = 1 << 19


def in_order(rows: DataFrame, key: str, order: list[str], size: str | None = None) -> DataFrame:
    """``rank`` of each row (from 0) among the rows of its ``key`` in the order of the columns ``order``, and ``before``,
    the sum of ``size`` over the earlier ones.

    ``rows`` is a written table with unique ``order`` values; ``key`` is not null. Rows are range-sorted by key and
    order, so a key of any share spreads over tasks. Each task counts on within the runs of its keys, and what earlier
    tasks hold of a key comes from the counts of runs: a task has at most one run that began before it, so the side
    that is broadcast has at most one row a partition.
    """
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // ROWS_A_PART))
    ordered = rows.repartitionByRange(parts, key, *order).sortWithinPartitions(key, *order).withColumn("_part", F.spark_partition_id())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, ranked, summed = None, 0, 0
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            keys = column(batch, key)
            ends = np.array(pc.run_end_encode(keys).run_ends)
            first = np.repeat(np.concatenate([[0], ends[:-1]]), np.diff(ends, prepend=0))
            sizes = column(batch, size).to_numpy(zero_copy_only=False).astype(np.int64) if size else np.ones(n, np.int64)
            before = np.cumsum(sizes) - sizes
            before -= before[first]
            rank = np.arange(n) - first
            if keys[0].as_py() == last:
                rank[: ends[0]] += ranked
                before[: ends[0]] += summed
            last, ranked, summed = keys[-1].as_py(), int(rank[-1]) + 1, int(before[-1] + sizes[-1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rank), pa.array(before)], [*batch.schema.names, "rank", "before"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ordered.schema.fields)
    written = cut_lineage(ordered.mapInArrow(run, f"{schema}, rank long, before long"))
    runs = written.groupBy("_part", key).agg(F.count("*").alias("_n"), F.sum(F.col(size) if size else F.lit(1)).cast("long").alias("_s"))
    earlier = Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = runs.select("_part", key, F.sum("_n").over(earlier).alias("_n"), F.sum("_s").over(earlier).alias("_s")).filter("_n > 0")
    return written.join(F.broadcast(carried), ["_part", key], "left").select(
        *rows.columns, (F.col("rank") + F.coalesce("_n", F.lit(0))).alias("rank"), (F.col("before") + F.coalesce("_s", F.lit(0))).alias("before"))
