"""SimHash fingerprints linked by meet-in-the-middle balls (operator 4), and near copies by shingle sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellweave.llm.common import column, components, slices, words
from cellweave.session import cut_lineage

BLOCK = 256  # texts of a bucket that meet as many others in one task


def shingle_hashes(text: str | None, k: int, seed: int, distinct: bool = False) -> np.ndarray:
    """XXH64 of every ``k``-word shingle of the whole text, in order; a shorter text is one shingle."""
    parts = words(text)
    if not parts:
        return np.zeros(0, np.uint64)
    line = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    k = min(k, len(parts))
    pieces = [line[a:b] for a, b in zip(starts[: len(parts) - k + 1].tolist(), ends[k - 1 :].tolist())]
    if distinct:
        pieces = list(set(pieces))
    return np.fromiter((xxhash.xxh64_intdigest(p, seed) for p in pieces), np.uint64, len(pieces))


def majority(hashes: np.ndarray) -> int:
    """A bit is 1 if it is set in over half the hashes. Counted in blocks, so that a long text needs little memory."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        block = np.ascontiguousarray(hashes[at : at + (1 << 16)])
        ones += np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = 3, seeds: tuple[int, ...] = (42,), distinct: bool = False, text_col: str = "text") -> DataFrame:
    """The other columns of ``docs`` and ``fp``: one signed 64-bit fingerprint for each seed, as an array.

    Null and empty texts have fingerprint 0. ``distinct`` counts repeated shingles once.
    """
    kept = [c for c in docs.columns if c != text_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_col):
            rows = [[majority(shingle_hashes(t, shingle, s, distinct)) for s in seeds] for t in column(batch, text_col).to_pylist()]
            flat = pa.array(np.array(rows, np.uint64).view(np.int64).reshape(-1))
            fps = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * len(seeds)), flat)
            yield pa.RecordBatch.from_arrays([*[column(batch, c) for c in kept], fps], [*kept, "fp"])

    return docs.mapInArrow(run, ", ".join([*[f"{c} {docs.schema[c].dataType.simpleString()}" for c in kept], "fp array<long>"]))


def ball(value: Column, bits: int, radius: int) -> Column:
    """All values within ``radius`` flipped bits. Made by XOR with the masks of that weight."""
    masks, level = [0], [0]
    for _ in range(radius):
        level = sorted({m | (1 << b) for m in level for b in range(bits) if not m >> b & 1})
        masks += level
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    return F.transform(F.array(*[F.lit(m) for m in signed]), lambda m: m.bitwiseXOR(value))


def near_pairs(values: DataFrame, bits: int = 64, radius: int = 2) -> DataFrame:
    """Pairs (a, b) of the distinct BIGINTs in ``values.fp`` that connect all values at ``radius`` or fewer bits.

    Each value emits its ball of half the radius; two values within the radius share a variant. All values at one
    variant lie in its ball, so a bucket is bounded by the ball size (65 for radius 2), whatever the data. Values of
    a bucket are chained in order; each pair is verified.
    """
    spread = values.select("fp", F.explode(ball(F.col("fp"), bits, radius // 2)).alias("variant"))
    chain = Window.partitionBy("variant").orderBy("fp")
    pairs = spread.withColumn("a", F.lag("fp").over(chain)).filter("a IS NOT NULL").select("a", F.col("fp").alias("b")).distinct()
    return pairs.filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)


def fingerprint_components(docs: DataFrame, shingle: int = 3, seed: int = 42, radius: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, ``fingerprint`` (16 hex digits) and ``component_id`` (smallest linked id).

    Fingerprints link at ``radius`` (even) or fewer differing bits; rows with equal fingerprints are one class and are
    collapsed before anything is linked. Null and empty texts have fingerprint zero and link like any other. Rows with
    a null id belong to their class but never name it (a class of null ids only has a null component_id); repeated rows
    stay rows of their own. An empty table gives an empty result.
    """
    prints = cut_lineage(fingerprints(docs.select(F.col(id_col).alias("id"), text_col), shingle, (seed,), text_col=text_col).select("id", F.col("fp")[0].alias("fp")))
    classes = prints.groupBy("fp").agg(F.min("id").alias("first"))
    roots = components(near_pairs(classes.select("fp"), 64, radius)).withColumnRenamed("node", "fp")
    known = classes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    smallest = known.groupBy("root").agg(F.min("first").alias("component_id"))
    named = known.join(smallest, "root").select("fp", "component_id")
    return prints.join(named, "fp").select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _packed_shingles(texts: DataFrame, k: int) -> DataFrame:
    """(num, set) of (num, text): the sorted distinct hashes of the ``k``-word shingles, as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            sets = [np.unique(shingle_hashes(t, k, 0, True)).tobytes() for t in column(batch, "text").to_pylist()]
            yield pa.RecordBatch.from_arrays([column(batch, "num"), pa.array(sets, pa.binary())], ["num", "set"])

    return texts.select("num", "text").mapInArrow(run, "num long, set binary")


def _links(rows: pa.Table, least: float) -> pa.Table:
    """Pairs (a, b) that link all roots among (num, root, side, set) that have near sets; two sides meet each other only."""
    num, root, side = (rows.column(c).to_numpy() for c in ("num", "root", "side"))
    sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in rows.column("set")]
    order = np.argsort([len(x) for x in sets], kind="stable")
    num, side, sets = num[order], side[order], [sets[i] for i in order]
    names, root = np.unique(root[order], return_inverse=True)
    given, size = root.copy(), np.array([len(x) for x in sets])
    ends = np.concatenate([[0], np.cumsum(size)])
    ids = np.unique(np.concatenate(sets), return_inverse=True)[1]
    two, found = side.min() != side.max(), []
    few = np.argmin(np.bincount(side, minlength=2)) if two else 0
    mine = np.zeros(int(ids.max(initial=0)) + 1, bool)
    for i in np.flatnonzero((size > 0) & (side == few)).tolist():
        # sets that are too long or too short for this one are left out; on one side the shorter ones have had their turn
        low = int(np.searchsorted(size, least * size[i] - 1e-9)) if two else i + 1
        stop = int(np.searchsorted(size * least - 1e-9, size[i], "right"))
        open_ = (root[low:stop] != root[i]) & ((side[low:stop] != few) | (not two))
        if not open_.any():
            continue
        mine[ids[ends[i] : ends[i + 1]]] = True
        same = np.add.reduceat(mine[ids[ends[low] : ends[stop]]], ends[low:stop] - ends[low], dtype=np.int64)
        mine[ids[ends[i] : ends[i + 1]]] = False
        for j in (np.flatnonzero(open_ & (same >= least * (size[i] + size[low:stop] - same) - 1e-9)) + low).tolist():
            if root[j] != root[i]:
                root[root == root[j]] = root[i]
                found.append((names[given[i]], names[given[j]]))
    both = np.array(found, np.int64).reshape(-1, 2)
    return pa.table({"a": both[:, 0], "b": both[:, 1]})


def _meet(members: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Links (a, b) of roots that join near sets of different roots inside each bucket of (bucket, num, root, side).

    Texts of side 0 have one root and meet side 1 only; those of side 1 meet each other as well, unless they are marked
    ``star``. Both sides are cut into blocks of about ``BLOCK`` texts, and two blocks meet in one task, so a bucket of
    any size is many small groups, and a bucket with few texts outside side 0 costs in proportion to its size.
    """
    counts = members.groupBy("bucket").agg(*[F.ceil(F.count_if(F.col("side") == s) / BLOCK).cast("int").alias(f"n{s}") for s in (0, 1)])
    dealt = members.join(counts, "bucket")
    own = F.pmod(F.xxhash64("num"), F.greatest(F.when(F.col("side") == 0, F.col("n0")).otherwise(F.col("n1")), F.lit(1))).cast("int")
    pair = lambda low, high, side: F.struct(low.alias("low"), high.alias("high"), F.lit(side).alias("at"))
    upto = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    first = F.transform(upto(F.col("n1")), lambda k: pair(-1 - F.col("own"), k, 0))
    with_first = F.transform(upto(F.col("n0")), lambda k: pair(-1 - k, F.col("own"), 1))
    each_other = F.transform(upto(F.col("n1")), lambda k: F.struct(F.least("own", k).alias("low"), F.greatest("own", k).alias("high"), (F.col("own") > k).cast("int").alias("at")))
    cells = F.when(F.col("side") == 0, first).when(F.col("star"), with_first).otherwise(F.concat(with_first, each_other))
    dealt = dealt.withColumn("own", own).select("bucket", "num", "root", F.explode(cells).alias("cell")).join(sets, "num").select(
        "bucket", "cell.low", "cell.high", "num", "root", F.col("cell.at").alias("side"), "set")
    return dealt.groupBy("bucket", "low", "high").applyInArrow(lambda rows: _links(rows, least), "a long, b long")


def _unlike(spread: DataFrame, roots: DataFrame) -> DataFrame:
    """Members (bucket, num, root, side, star) of the buckets that still hold more than one component.

    The component with most texts of a bucket is side 0. Buckets with the same members are one.
    """
    known = spread.join(roots, "num", "left").withColumn("root", F.coalesce("root", "num"))
    sizes = known.groupBy("bucket", "root").agg(F.count("*").alias("n"), F.sum(F.xxhash64("num").cast("decimal(38,0)")).alias("sum"), F.bit_xor(F.xxhash64(F.lit(1), "num")).alias("xor"))
    mixed = sizes.groupBy("bucket").agg(F.count("*").alias("roots"), F.max_by("root", F.struct("n", "root")).alias("main"), F.sum("sum").alias("sum"), F.bit_xor("xor").alias("xor")).filter("roots > 1")
    once = mixed.groupBy("sum", "xor").agg(F.min_by(F.struct("bucket", "main"), "bucket").alias("b")).select("b.bucket", "b.main")
    return known.join(once, "bucket").select("bucket", "num", "root", (F.col("root") != F.col("main")).cast("int").alias("side"), F.lit(False).alias("star"))


def _text_key(text_col: str) -> Column:
    """Stands for a text: XXH64 under two seeds, 128 bits."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return F.concat_ws("-", F.xxhash64(text), F.xxhash64(F.lit(1), text))


def _row_key(text_col: str, ident: Column) -> Column:
    return F.concat_ws(":", _text_key(text_col), F.coalesce(ident.cast("string"), F.lit("null")))


def band_keys(hashes: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key per band over a set of hashes: the smallest values under ``rows`` random linear maps, hashed together."""
    rng = np.random.default_rng(9)
    a, b = rng.integers(0, 2**64, (2, bands * rows), np.uint64)
    a |= np.uint64(1)
    least = np.full(bands * rows, 2**64 - 1, np.uint64)
    for at in range(0, len(hashes), 2048):  # a block stays in the cache
        np.minimum(least, (np.multiply.outer(a, hashes[at : at + 2048]) + b[:, None]).min(1), out=least)
    return np.array([xxhash.xxh64_intdigest(least[i * rows : (i + 1) * rows].tobytes(), i) for i in range(bands)], np.uint64)


def _sketches(keyed: DataFrame, shingle: int, bands: int, rows: int) -> DataFrame:
    """(id, key, size, fp, bands): the number of distinct shingles of each text, its SimHash over them and its band keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            sets = [np.unique(shingle_hashes(t, shingle, 0, True)) for t in column(batch, "text").to_pylist()]
            flat = pa.array(np.concatenate([band_keys(x, bands, rows) for x in sets]).view(np.int64))
            keys = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * bands), flat)
            fps = pa.array(np.array([majority(x) for x in sets], np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([column(batch, "id"), column(batch, "key"), pa.array(map(len, sets), pa.int64()), fps, keys], ["id", "key", "size", "fp", "bands"])

    return keyed.select("id", "key", "text").mapInArrow(run, f"id {keyed.schema['id'].dataType.simpleString()}, key string, size long, fp long, bands array<long>")


def near_duplicates(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, bands: int = 32, rows: int = 5, radius: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per distinct text: ``key``, its smallest id ``first_id`` and the smallest id of its group, ``component_id``.

    Texts are near copies if their sets of ``shingle``-word shingles have Jaccard ``similarity`` or more. Candidates are
    texts whose SimHash fingerprints over these shingles differ in ``radius`` or fewer bits: they share a value of their
    balls of half the radius, as in :func:`near_pairs`. At 0.8 about 10 of 64 bits differ, too many for a ball, so the
    pairs beyond it come from MinHash over the same shingles: texts meet if all ``rows`` smallest values of one of
    ``bands`` bands agree. A pair of similarity J outside the ball is missed with
    probability (1 - J^rows)^bands, at 0.8 three in a million, whatever kind of edit lies between the two. Each text
    of a bucket is compared with the first one, by the full shingle sets; buckets that still hold more than one
    component then compare every text with those of the other components, block by block, so no pair of a bucket is
    left out. Null counts as empty.
    """
    keyed = docs.select(F.col(id_col).alias("id"), _text_key(text_col).alias("key"), F.col(text_col).alias("text"))
    prints = cut_lineage(_sketches(keyed, shingle, bands, rows))
    reps = cut_lineage(prints.groupBy("key").agg(F.min("id").alias("first_id"), F.max("size").alias("size"), F.max("fp").alias("fp"), F.max("bands").alias("bands")).withColumn("num", F.xxhash64("key")), prints)
    # texts without a shingle all have fingerprint zero and are like nothing
    spread = reps.select("num", F.explode("bands").alias("bucket")).union(
        reps.filter("size > 0").select("num", F.explode(ball(F.col("fp"), 64, radius // 2)).alias("variant")).select("num", F.xxhash64("variant").alias("bucket")))
    heads = spread.groupBy("bucket").agg(F.min("num").alias("head"), F.count("*").alias("n")).filter("n > 1").drop("n")
    members = cut_lineage(spread.join(heads, "bucket").filter("num <> head"))
    met = members.select(F.explode(F.array("num", "head")).alias("num")).distinct().join(reps, "num")
    wanted = met.select("num", F.concat_ws(":", "key", F.coalesce(F.col("first_id").cast("string"), F.lit("null"))).alias("row_key"))
    texts = keyed.withColumn("row_key", _row_key("text", F.col("id"))).join(wanted, "row_key")
    sets = cut_lineage(_packed_shingles(texts, shingle).dropDuplicates(["num"]))
    pairs = members.select(F.col("head").alias("bucket"), "num").distinct()
    heads = pairs.select("bucket").distinct()
    star = pairs.select("bucket", "num", F.lit(1).alias("side")).union(heads.select("bucket", F.col("bucket").alias("num"), F.lit(0).alias("side")))
    near = components(_meet(cut_lineage(star.withColumn("root", F.col("num")).withColumn("star", F.lit(True))), sets, similarity)).withColumnRenamed("node", "num")
    bucketed = members.select("bucket", "num").union(members.select("bucket", F.col("head").alias("num")).distinct())
    rest = components(_meet(cut_lineage(_unlike(bucketed, near)), sets, similarity)).select(F.col("node").alias("root"), F.col("root").alias("whole"))
    named = reps.select("num", "key", "first_id").join(near, "num", "left").withColumn("root", F.coalesce("root", "num"))
    named = named.join(rest, "root", "left").withColumn("root", F.coalesce("whole", "root"))
    smallest = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return named.join(smallest, "root").select("key", "first_id", "component_id")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row of each near-duplicate group of :func:`near_duplicates`: the one of the smallest id, with all columns.

    Rows with a null id never stand for a group that has an id; a group of null ids keeps one row of each of its
    texts. Rows that repeat the id and the text of a kept row go as well. The join is on text and id together, so
    copies of one text do not meet in one task.
    """
    groups = near_duplicates(docs, id_col=id_col, text_col=text_col, **options).filter("first_id <=> component_id")
    kept = groups.select(F.concat_ws(":", "key", F.coalesce(F.col("first_id").cast("string"), F.lit("null"))).alias("_row_key"))
    found = docs.withColumn("_row_key", _row_key(text_col, F.col(id_col))).join(kept, "_row_key", "left_semi")
    return found.dropDuplicates(["_row_key"]).select(*docs.columns)
