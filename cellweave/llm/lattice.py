"""Near-duplicate vectors by E8 lattice hashing (operator 8)."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations, product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweave.llm.common import column, components
from cellweave.session import cut_lineage

CHUNK = 1 << 16  # candidate pairs that are compared at once: two gathered vectors each
BLOCK = 4096  # rows of a bucket that one task takes as its left side


def roots() -> np.ndarray:
    """The 240 shortest vectors of E8; they bound its cells."""
    out = []
    for i, j in combinations(range(8), 2):
        for a, b in product((-1.0, 1.0), repeat=2):
            v = np.zeros(8)
            v[i], v[j] = a, b
            out.append(v)
    out += [np.array(s) / 2 for s in product((-1.0, 1.0), repeat=8) if s.count(-1.0) % 2 == 0]
    return np.array(out)


def nearest(x: np.ndarray) -> np.ndarray:
    """Nearest E8 point of each row: integers of even sum, or those plus one half, whichever is closer."""

    def even(y: np.ndarray) -> np.ndarray:
        near = np.rint(y)
        odd = np.flatnonzero(near.sum(1) % 2 != 0)
        off = y[odd] - near[odd]
        worst = np.abs(off).argmax(1)
        near[odd, worst] += np.where(off[np.arange(len(odd)), worst] >= 0, 1.0, -1.0)
        return near

    a, b = even(x), even(x - 0.5) + 0.5
    return np.where((((x - a) ** 2).sum(1) <= ((x - b) ** 2).sum(1))[:, None], a, b)


def cells(unit: np.ndarray, labels: np.ndarray, tables: int, scale: float, reach: float, seed: int = 3) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Own cell of each unit vector in each table, and for each table the rows and the neighbouring cells that they probe.

    In each table the vector is projected to eight random orthonormal directions and decoded to an E8 point. A
    neighbouring cell is probed if its border is at most ``reach`` away (in units of a 64-dimensional unit vector).
    Sums are made term by term, so a vector has the same cells whatever rows stand beside it.
    """
    n, dim = unit.shape
    rng = np.random.default_rng([seed, dim])
    mix = rng.integers(1, 2**62, 10, dtype=np.int64) * 2 + 1
    shift = roots()
    own, probes = np.zeros((n, tables), np.int64), []
    code = lambda points, t, who: ((2 * points).astype(np.int64) * mix[:8]).sum(1) + labels[who] * mix[8] + (t + 1) * mix[9]
    with np.errstate(over="ignore"):
        for t in range(tables):
            plane = np.linalg.qr(rng.standard_normal((max(dim, 8), 8)))[0][:dim] * np.sqrt(dim / 64)
            y = np.zeros((n, 8))
            for k in range(dim):
                y += unit[:, k, None] * plane[k]
            y /= scale
            point = nearest(y)
            own[:, t] = code(point, t, np.arange(n))
            along = np.zeros((n, len(shift)))
            for k in range(8):
                along += (y[:, k] - point[:, k])[:, None] * shift[:, k]
            who, which = np.nonzero((1 - along) / np.sqrt(2) * scale <= reach)
            probes.append((who, code(point[who] + shift[which], t, who)))
    return own, probes


def _units(vectors: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors of an Arrow list array, short ones filled up with zeros, and their dimensions."""
    begin, flat = vectors.offsets.to_numpy()[:-1], vectors.values.to_numpy(zero_copy_only=False).astype(np.float64)
    sizes = np.diff(vectors.offsets.to_numpy())
    unit = np.zeros((len(sizes), int(sizes.max(initial=1))))
    for dim in np.unique(sizes):
        at = np.flatnonzero(sizes == dim)
        x = flat[begin[at][:, None] + np.arange(dim)]
        unit[at, :dim] = x / np.linalg.norm(x, axis=1)[:, None]
    return unit, sizes


def _spread(classes: DataFrame, tables: int, scale: float, reach: float) -> DataFrame:
    """A row for each class and cell that it lies in or probes: bucket, base, table and class, nothing of the vector."""
    names = ["bucket", "base", "tab", "cls"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at, 1000) for b in batches for at in range(0, b.num_rows, 1000)):
            unit, sizes = _units(column(batch, "vec"))
            cls, label = (column(batch, c).to_numpy(zero_copy_only=False) for c in ("cls", "label"))
            for dim in np.unique(sizes):
                at = np.flatnonzero(sizes == dim)
                own, probes = cells(unit[at, :dim], label[at].astype(np.int64), tables, scale, reach)
                for t, (who, keys) in enumerate(probes):
                    base = np.repeat(np.array([1, 0], np.int32), [len(at), len(who)])
                    yield pa.RecordBatch.from_arrays([
                        pa.array(np.concatenate([own[:, t], keys])), pa.array(base), pa.array(np.full(len(base), t, np.int32)),
                        pa.array(cls[np.concatenate([at, at[who]])].astype(np.int64))], names)

    return classes.select("cls", "label", "vec").mapInArrow(run, "bucket long, base int, tab int, cls long")


def _codes(classes: DataFrame) -> DataFrame:
    """Class and ``code``: its unit vector in one byte a component, behind its step and its distance from the code."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at, 1000) for b in batches for at in range(0, b.num_rows, 1000)):
            unit, sizes = _units(column(batch, "vec"))
            step = np.maximum(np.abs(unit).max(1) / 127, 1e-30).astype(np.float32)
            code = np.clip(np.rint(unit / step[:, None]), -127, 127).astype(np.int8)
            off = (np.linalg.norm(unit - code * step[:, None].astype(np.float64), axis=1) * 1.000001 + 1e-7).astype(np.float32)
            blobs = [a.tobytes() + c[:k].tobytes() for a, c, k in zip(np.stack([step, off], 1), code, sizes)]
            yield pa.RecordBatch.from_arrays([column(batch, "cls"), pa.array(blobs, pa.binary())], ["cls", "code"])

    return classes.select("cls", "vec").mapInArrow(run, "cls long, code binary")


def _pairs(rows: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i, j) of rows of one bucket and block, i from its left side and j from its right side, some at a time."""
    bucket, blk, left, right, tab, cls = (rows.column(c).to_numpy() for c in ("bucket", "blk", "left", "right", "tab", "cls"))
    new = np.ones(len(bucket), bool)
    new[1:] = (bucket[1:] != bucket[:-1]) | (blk[1:] != blk[:-1]) | (tab[1:] != tab[:-1])
    head = np.flatnonzero(new)
    run_of = np.cumsum(new) - 1
    run_size = np.diff(np.append(head, len(bucket)))
    lefts = np.flatnonzero(left)
    cost = np.cumsum(run_size[run_of[lefts]])
    at = 0
    while at < len(lefts):
        end = max(at + 1, int(np.searchsorted(cost, (cost[at - 1] if at else 0) + CHUNK, "right")))
        part = lefts[at:end]
        n = run_size[run_of[part]]
        i = np.repeat(part, n)
        j = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(head[run_of[part]], n)
        ok = (right[j] == 1) & (cls[i] != cls[j])
        yield i[ok], j[ok]
        at = end


PLACE = ["bucket", "tab", "blk", "left", "right", "base", "cls"]


def _likely(rows: pa.Table, least: float) -> pa.Table:
    """The rows of whole buckets that may link with another one, by their codes; no row that does is left out.

    Cosines of two codes are off by at most what the codes are off, and by their own rounding.
    """
    blobs = rows.column("code").to_pylist()
    sizes = np.array([len(b) - 8 for b in blobs])
    head = np.array([np.frombuffer(b, np.float32, 2) for b in blobs])
    code = np.zeros((len(blobs), int(sizes.max(initial=1))), np.float32)
    for dim in np.unique(sizes):
        at = np.flatnonzero(sizes == dim)
        code[at, :dim] = np.array([np.frombuffer(blobs[k], np.int8, dim, 8) for k in at])
    code *= head[:, :1]
    off = head[:, 1].astype(np.float64)
    kept = np.zeros(len(blobs), bool)
    for i, j in _pairs(rows):
        ok = (np.einsum("ij,ij->i", code[i], code[j]) >= least - off[i] - (1 + off[i]) * off[j] - 1e-5) & (sizes[i] == sizes[j])
        kept[i[ok]] = kept[j[ok]] = True
    return rows.select(PLACE).filter(pa.array(kept))


def _member(key: np.ndarray, flat: np.ndarray, starts: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Whether ``key[p]`` is among the cells that row ``rows[p]`` probes, which begin at ``starts[rows[p]]`` of ``flat``."""
    hit = np.zeros(len(rows), bool)
    begin, end = starts[rows], starts[rows + 1]
    for k in range(int((end - begin).max(initial=0))):
        at = np.flatnonzero(begin + k < end)
        hit[at] |= flat[begin[at] + k] == key[at]
    return hit


def _links(rows: pa.Table, tables: int, least: float, scale: float, reach: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(class, links, local root) from whole buckets, each pair counted in the first table that brings it together.

    Cells are found anew, and only for rows that link."""
    base, tab, cls, mult, label = (rows.column(c).to_numpy() for c in ("base", "tab", "cls", "mult", "label"))
    unit, sizes = _units(rows.column("vec").combine_chunks())
    near = []
    for i, j in _pairs(rows):
        ok = (label[i] == label[j]) & (sizes[i] == sizes[j])
        i, j = i[ok], j[ok]
        ok = np.einsum("ij,ij->i", unit[i], unit[j]) >= least
        near.append((i[ok], j[ok]))
    every = np.unique(np.concatenate([x for pair in near for x in pair])) if near else np.zeros(0, np.int64)
    if not len(every):
        return (np.zeros(0, np.int64),) * 3
    own, flat, starts = np.zeros((len(every), tables), np.int64), [], []
    found_at = [([], []) for _ in range(tables)]
    for dim in np.unique(sizes[every]):
        for at in np.array_split(w := np.flatnonzero(sizes[every] == dim), -(-len(w) // 1000)):
            own[at], probes = cells(unit[every[at], :dim], label[every[at]].astype(np.int64), tables, scale, reach)
            for t, (who, keys) in enumerate(probes):
                found_at[t][0].append(at[who])
                found_at[t][1].append(keys)
    for who, keys in found_at:
        who, keys = np.concatenate(who), np.concatenate(keys)
        flat.append(keys[np.argsort(who, kind="stable")])
        starts.append(np.concatenate([[0], np.cumsum(np.bincount(who, minlength=len(every)))]))
    found: list[tuple] = []
    for i, j in near:
        a, b = np.searchsorted(every, i), np.searchsorted(every, j)
        t = tab[i]
        seen = np.zeros(len(i), bool)
        for e in range(tables - 1):
            ask = np.flatnonzero((e < t) & ~seen)
            p, q = a[ask], b[ask]
            seen[ask] = (own[p, e] == own[q, e]) | _member(own[q, e], flat[e], starts[e], p) | _member(own[p, e], flat[e], starts[e], q)
        probe = base[j] == 0
        for e in range(tables):
            ask = np.flatnonzero((t == e) & probe & ~seen & (cls[i] > cls[j]))
            seen[ask] = _member(own[b[ask], e], flat[e], starts[e], a[ask])
        i, j, probe = i[~seen], j[~seen], probe[~seen]
        found.append((cls[i], cls[j], mult[i], mult[j], probe))
    a, b, ma, mb, probe = (np.concatenate(x) for x in zip(*found))
    names, index = np.unique(np.concatenate([a, b]), return_inverse=True)
    ia, ib = index[: len(a)], index[len(a) :]
    links = np.zeros(len(names), np.int64)
    np.add.at(links, ia, mb)
    np.add.at(links, ib[probe], ma[probe])
    root = np.arange(len(names))
    while True:
        low = root.copy()
        np.minimum.at(low, ia, root[ib])
        np.minimum.at(low, ib, root[ia])
        low = low[low]
        if (low == root).all():
            break
        root = low
    return names, links, names[root]


def _by_bucket(dealt: DataFrame, work: Callable[[pa.Table], pa.Table], schema: str) -> DataFrame:
    """``work`` on whole buckets and blocks, some at a time."""
    keys = ("bucket", "tab", "blk")
    parts = int(dealt.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            last = tuple(column(batch, c)[-1].as_py() for c in keys)
            same = np.ones(batch.num_rows, bool)
            for c, v in zip(keys, last):
                same &= column(batch, c).to_numpy() == v
            cut = batch.num_rows - int(same.sum())
            if cut or (kept and tuple(column(kept[-1], c)[-1].as_py() for c in keys) != last):
                yield from work(pa.Table.from_batches([*kept, batch.slice(0, cut)])).to_batches()
                kept = []
            kept.append(batch.slice(cut))
        if kept:
            yield from work(pa.Table.from_batches(kept)).to_batches()

    return dealt.repartition(parts, *keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


def near_vectors(vectors: DataFrame, least: float = 0.98, tables: int = 4, reach: float = 0.055, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """One row per row of ``vectors``: id, n_links, component_id, kept.

    Vectors of equal label (not null) and dimension link at cosine ``least`` or more, in double precision. Vectors
    that are null, zero or hold null or non-finite components, and rows with a null id, link with nothing (their
    component is their own id). Rows of equal label and vector are one class and are compared once; repeated ids are
    one node. Cells shrink with the eighth root of the largest label's size, so the mean number of vectors in a cell
    does not grow with the table. Buckets of more than ``BLOCK`` rows are cut into blocks that meet two at a time, so a
    task holds two blocks at most and no row is left out. A cell holds names only; those that share one meet as codes of one
    byte a component, and the vectors go to the rows whose codes leave a link open. A task sends counts and one local
    root per class, never pairs.
    """
    value = F.col(vec_col)
    fine = F.coalesce(
        F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & (F.size(value) > 0)
        & F.forall(value, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(value, lambda x: x != 0), F.lit(False))
    keyed = cut_lineage(vectors.select(
        F.col(id_col).alias("id"), F.when(fine, F.col(label_col).cast("long")).alias("label"), F.when(fine, value).alias("vec"),
        F.when(fine, F.concat_ws("-", F.xxhash64(label_col, vec_col), F.xxhash64(F.lit(1), label_col, vec_col))).otherwise(F.concat(F.lit("id"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))).alias("key"),
    ))
    classes = cut_lineage(keyed.filter("vec IS NOT NULL").groupBy("key").agg(F.min("id").cast("long").alias("cls"), F.count("*").alias("mult"), F.first("label").alias("label"), F.first("vec").alias("vec")))
    largest = classes.groupBy("label").count().agg(F.max("count")).first()[0] or 1
    scale = 0.5166 * (8 / max(largest, 8)) ** 0.125  # about eight vectors to a cell, if directions are random
    spread = cut_lineage(_spread(classes, tables, scale, reach))
    sizes = spread.groupBy("bucket", "tab").agg(F.count("*").alias("n"), F.sum("base").alias("bases")).filter("n > 1 AND bases > 0").select("bucket", "tab", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    mine, every = F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int"), F.sequence(F.lit(0), F.col("blocks") - 1)
    as_right = F.transform(every, lambda b: F.struct(b.alias("lb"), mine.alias("rb")))
    as_left = F.transform(every, lambda b: F.struct(mine.alias("lb"), b.alias("rb")))
    places = F.when(F.col("base") == 1, F.array_distinct(F.concat(as_right, as_left))).otherwise(as_right)
    coded = spread.join(sizes.hint("merge"), ["bucket", "tab"]).join(_codes(classes).hint("merge"), "cls")
    dealt = coded.withColumn("mine", mine).withColumn("at", F.explode(places)).select(
        "bucket", "tab", (F.col("at.lb") * F.col("blocks") + F.col("at.rb")).alias("blk"), ((F.col("base") == 1) & (F.col("at.lb") == F.col("mine"))).cast("int").alias("left"),
        (F.col("at.rb") == F.col("mine")).cast("int").alias("right"), "base", "cls", "code")
    likely = _by_bucket(dealt, lambda rows: _likely(rows, least), ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in dealt.select(*PLACE).schema.fields))
    whole = likely.join(classes.select("cls", "mult", "label", "vec").hint("merge"), "cls")

    def linked(rows: pa.Table) -> pa.Table:
        return pa.table([pa.array(x) for x in _links(rows, tables, least, scale, reach)], ["cls", "links", "root"])

    found = cut_lineage(_by_bucket(whole, linked, "cls long, links long, root long"))
    counts = found.groupBy("cls").agg(F.sum("links").alias("links"))
    comps = components(found.select(F.col("cls").alias("a"), F.col("root").alias("b")))
    firsts = comps.groupBy("root").agg(F.min("node").alias("component_id"))
    named = comps.join(firsts, "root").select(F.col("node").alias("cls"), "component_id")
    known = classes.select("key", "cls", "mult").join(counts, "cls", "left").join(named, "cls", "left").select(
        "key", (F.coalesce("links", F.lit(0)) + F.col("mult") - 1).cast("long").alias("n_links"), F.coalesce("component_id", "cls").alias("component_id"))
    return keyed.select("id", "key").join(known, "key", "left").select(
        F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "id").alias("component_id"),
    ).withColumn("kept", F.col(id_col).eqNullSafe(F.col("component_id")))
