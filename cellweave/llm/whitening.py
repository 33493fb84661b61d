"""Whitening of embeddings from exact, bit-sliced cross-products (operator 11)."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweave.llm.common import column

STEPS, SHIFT = 1024, 100_000  # an entry c becomes floor(STEPS * c) + SHIFT
MOST = 2.0**61  # scaled entries beyond this are set to it, so that differences stay in 64 bits
ROWS = 4096  # rows whose bit planes are held at once
LIMB, LIMBS = 30, 5  # exact sums travel as limbs of 30 bits, the last one signed


def scaled(vectors: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, integer matrix) for each length of vector: the vectors that are not null and all finite."""
    lengths = pc.fill_null(pc.list_value_length(vectors), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = pc.fill_null(vectors.flatten().cast(pa.float64()), math.nan).to_numpy(zero_copy_only=False)
    ends = np.cumsum(np.maximum(lengths, 0))
    starts = ends - np.maximum(lengths, 0)
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(flat))])
    good = (lengths >= 0) & (bad[ends] == bad[starts])
    out = []
    for size in np.unique(lengths[good]).tolist():
        rows = np.flatnonzero(good & (lengths == size))
        at = starts[rows][:, None] + np.arange(size)
        x = np.clip(np.floor(STEPS * flat[at]), -MOST, MOST).astype(np.int64) + SHIFT if size else np.zeros((len(rows), 0), np.int64)
        out.append((rows, x))
    return out


def bit_planes(y: np.ndarray) -> np.ndarray:
    """(bits, dims, words): plane b of a dimension holds bit b of its non-negative values, 64 rows a word."""
    bits = max(int(y.max(initial=0)).bit_length(), 1)
    padded = np.zeros((y.shape[1], -(-len(y) // 64) * 64), np.int64)
    padded[:, : len(y)] = y.T
    return np.stack([np.packbits(padded >> b & 1 != 0, axis=1).view(np.uint64) for b in range(bits)])


def cross_products(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Exact sums of every dimension and of every product of two, as Python integers (upper triangle).

    Values are shifted by the smallest of their dimension and cut into bit planes; the number of rows with bit a of
    one dimension and bit b of another is the popcount of the AND of two planes and weighs 2^(a+b). The shift is
    undone in integers.
    """
    low = x.min(0)
    planes = bit_planes(x - low)
    bits, dims, _ = planes.shape
    kind = np.int64 if 2 * bits + ROWS.bit_length() < 62 else object
    weights = np.array([1 << b for b in range(bits)], kind)
    sums = (np.bitwise_count(planes).sum(2, dtype=np.int64).astype(kind) * weights[:, None]).sum(0)
    products = np.zeros((dims, dims), object)
    for i in range(dims):
        row = np.zeros(dims - i, kind)
        for a in range(bits):
            counts = np.bitwise_count(planes[:, i:] & planes[a, i]).sum(2, dtype=np.int64)
            row = row + (counts.astype(kind) * weights[:, None]).sum(0) * weights[a]
        products[i, i:] = row
    low, sums = low.astype(object), sums.astype(object)
    products = products + np.outer(low, sums) + np.outer(sums, low) + len(x) * np.outer(low, low)
    return sums + len(x) * low, products


def _limbs(value: int) -> tuple[int, ...]:
    parts = []
    for _ in range(LIMBS - 1):
        parts.append(value & ((1 << LIMB) - 1))
        value >>= LIMB
    return (*parts, value)


@dataclass
class Whitening:
    """Exact sums of the fit list and the leading directions of its covariance, for vectors of one length."""

    n: int
    sums: np.ndarray  # Python integers
    values: np.ndarray  # eigenvalues of the leading components, falling
    vectors: np.ndarray  # one row each
    explained: list[float | None]
    identity_error: float | None = None

    @property
    def open(self) -> np.ndarray:
        """Components along which the fit list spreads at all; the others have no whitened value."""
        return self.values > 0

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """n * x - S in exact integers."""
        fits = self.n.bit_length() + int(np.abs(x).max(initial=0)).bit_length() < 62
        return self.n * x - self.sums.astype(np.int64) if fits else self.n * x.astype(object) - self.sums

    def project(self, x: np.ndarray) -> np.ndarray:
        centred = self.deviations(x).astype(np.float64) / self.n
        return centred @ self.vectors[self.open].T / np.sqrt(self.values[self.open])


def _solve(n: int, sums: np.ndarray, products: np.ndarray, components: int) -> Whitening:
    """Covariance entries are centred as integers, n * sum(xy) - sum(x) * sum(y), and rounded once; then ``eigh``."""
    dims = len(sums)
    cov = np.zeros((dims, dims))
    for i in range(dims):
        for j in range(i, dims):
            cov[i, j] = cov[j, i] = (n * products[i, j] - sums[i] * sums[j]) / (n * n)
    values, vectors = np.linalg.eigh(cov)
    trace = float(np.trace(cov))
    values, vectors = values[::-1][:components], vectors[:, ::-1].T[:components]
    values = np.where(values > 1e-13 * trace, values, 0.0)
    return Whitening(n, sums, values, vectors, [v / trace if trace > 0 else None for v in values.tolist()])


def fit(vectors: DataFrame, components: int = 8, vector_col: str = "embedding") -> dict[int, Whitening]:
    """One :class:`Whitening` for each length of vector in the table.

    One scan: a task adds up the exact cross-products of its rows and sends dims * (dims + 1) / 2 sums, whatever its
    number of rows; Spark adds the limbs. What reaches the driver grows with the dimensions only. A second scan
    measures the covariance of the whitened vectors, each task round its own mean, and keeps the largest difference
    from the identity.
    """

    def scatter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, list] = {}
        for batch in batches:
            for _, x in scaled(column(batch, "_v")):
                dims = x.shape[1]
                n, sums, products = total.setdefault(dims, [0, np.zeros(dims, object), np.zeros((dims, dims), object)])
                for at in range(0, len(x) if dims else 0, ROWS):
                    s, p = cross_products(x[at : at + ROWS])
                    sums, products = sums + s, products + p
                total[dims] = [n + len(x), sums, products]
        rows = []
        for dims, (n, sums, products) in total.items():
            rows.append((dims, -1, -1, *_limbs(n)))
            rows += [(dims, i, -1, *_limbs(sums[i])) for i in range(dims)]
            rows += [(dims, i, j, *_limbs(products[i, j])) for i in range(dims) for j in range(i, dims)]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names)

    names = ["dims", "i", "j", *[f"l{k}" for k in range(LIMBS)]]
    only = vectors.select(F.col(vector_col).alias("_v"))
    parts = only.mapInArrow(scatter, ", ".join(f"{c} long" for c in names))
    found: dict[int, dict] = {}
    for r in parts.groupBy("dims", "i", "j").agg(*[F.sum(c).alias(c) for c in names[3:]]).collect():
        found.setdefault(r["dims"], {})[r["i"], r["j"]] = sum(r[f"l{k}"] << LIMB * k for k in range(LIMBS))
    models = {}
    for dims, exact in found.items():
        sums = np.array([exact[i, -1] for i in range(dims)], object)
        products = np.zeros((dims, dims), object)
        for i in range(dims):
            for j in range(i, dims):
                products[i, j] = exact[i, j]
        if dims:
            models[dims] = _solve(exact[-1, -1], sums, products, components)
    _measure(only, models)
    return models


def _measure(only: DataFrame, models: dict[int, Whitening]) -> None:
    """Sets ``identity_error``: the covariance of the whitened fit list against the identity."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, tuple] = {}
        for batch in batches:
            for _, x in scaled(column(batch, "_v")):
                dims = x.shape[1]
                if dims not in models or not models[dims].open.any():
                    continue
                w = models[dims].project(x)
                m, mean = len(w), w.mean(0)
                c = (w - mean).T @ (w - mean)
                if dims in total:
                    n, old, co = total[dims]
                    gap = mean - old
                    c, mean, m = co + c + np.outer(gap, gap) * (n * m / (n + m)), (n * old + m * mean) / (n + m), n + m
                total[dims] = (m, mean, c)
        rows = [(dims, a, b, float(m), m * mean[a], m * mean[b], m * mean[a] * mean[b], c[a, b])
                for dims, (m, mean, c) in total.items() for a in range(len(mean)) for b in range(a, len(mean))]
        if rows:
            columns = list(zip(*rows))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if k < 3 else pa.float64()) for k, c in enumerate(columns)], names)

    names = ["dims", "a", "b", "m", "ma", "mb", "mab", "c"]
    sums = only.mapInArrow(spread, ", ".join(f"{c} {'long' if k < 3 else 'double'}" for k, c in enumerate(names)))
    for r in sums.groupBy("dims", "a", "b").agg(*[F.sum(c).alias(c) for c in names[3:]]).collect():
        cov = (r["c"] + r["mab"] - r["ma"] * r["mb"] / r["m"]) / r["m"]
        model = models[r["dims"]]
        model.identity_error = max(model.identity_error or 0.0, abs(cov - (r["a"] == r["b"])))


def whiten(vectors: DataFrame, models: dict[int, Whitening], id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per usable vector: id, ``dims``, ``n``, ``deviation`` (exact decimal) and ``whitened`` (array<double>).

    Vectors that are null or hold null or non-finite entries have no row. Vectors of each length are a fit list of
    their own. Repeated rows and null ids stay rows of their own and count as often as they come. A component along
    which the fit list does not spread (a list of one vector, a constant dimension) has a null in ``whitened``. Entries
    beyond 2^61 / 1024 are set to that bound. ``deviation`` is null beyond 38 digits. Vectors without entries and
    empty tables give no rows. Other columns are not read. No shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, x in scaled(column(batch, "_v")):
                model = models.get(x.shape[1])
                if model is None:
                    continue
                for at in range(0, len(x), ROWS):
                    part = x[at : at + ROWS]
                    far = model.deviations(part)
                    if far.dtype == object or int(np.abs(far).max(initial=0)).bit_length() * 2 + len(model.sums).bit_length() >= 63:
                        squares = [int(s) for s in (far.astype(object) ** 2).sum(1)]
                        deviation = pa.array([Decimal(s) if s < 10**38 else None for s in squares], pa.decimal128(38, 0))
                    else:
                        deviation = pa.array((far * far).sum(1)).cast(pa.decimal128(38, 0))
                    out = np.full((len(part), len(model.values)), np.nan)
                    out[:, model.open] = model.project(part)
                    ends = np.arange(len(part) + 1, dtype=np.int32) * out.shape[1]
                    values = pa.array(out.reshape(-1), mask=~np.tile(model.open, len(part)))
                    yield pa.RecordBatch.from_arrays([
                        column(batch, "_id").take(pa.array(rows[at : at + ROWS])), pa.array(np.full(len(part), x.shape[1])), pa.array(np.full(len(part), model.n)),
                        deviation, pa.ListArray.from_arrays(pa.array(ends), values)], ["_id", "dims", "n", "deviation", "whitened"])

    kind = vectors.schema[id_col].dataType.simpleString()
    named = vectors.select(F.col(id_col).alias("_id"), F.col(vector_col).alias("_v"))
    return named.mapInArrow(run, f"_id {kind}, dims long, n long, deviation decimal(38,0), whitened array<double>").withColumnRenamed("_id", id_col)


def component_rows(white: DataFrame, models: dict[int, Whitening], id_col: str = "vec_id") -> DataFrame:
    """:func:`whiten` as one row per vector and component, with the figures of its fit list.

    ``deviation`` is a BIGINT here and null where it does not fit.
    """
    spark = white.sparkSession
    facts = [(dims, k + 1, m.explained[k], m.identity_error) for dims, m in models.items() for k in range(len(m.values))]
    known = spark.createDataFrame(facts, "dims long, component int, explained double, identity_error double")
    rows = white.select(id_col, "dims", "n", F.expr("try_cast(deviation AS BIGINT)").alias("deviation"), F.posexplode("whitened").alias("pos", "whitened"))
    return rows.withColumn("component", F.col("pos") + 1).join(F.broadcast(known), ["dims", "component"]).select(
        id_col, "component", "n", "deviation", "whitened", "explained", "identity_error")
