"""Quality scores learned from preference pairs (operator 5)."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellweave.llm.common import column, slices
from cellweave.session import cut_lineage

UPPER = bytes(range(65, 91))
LOWER = bytes(range(97, 123))
DIGITS = bytes(range(48, 58))
STOPS = b".,;:?'\"()-"
SIGNS = bytes(b for b in range(33, 127) if bytes([b]) not in (b".", b",", b";", b":", b"?", b"'", b'"', b"(", b")", b"-") and not chr(b).isalnum())
N_FEATURES = 14


def features(text: str | None) -> list[float]:
    """Shape of a text: length, repetition, shares of letter cases, digits and signs, line and word lengths."""
    raw = (text or "").encode()
    words, lines = raw.split(), raw.split(b"\n")
    n, size = len(words), len(raw)
    share = lambda chars: (size - len(raw.translate(None, chars))) / max(size, 1)
    distinct = len(set(words))
    bare = sum(w.isalpha() for w in words) / max(n, 1)
    return [
        math.log1p(n), distinct / max(n, 1), math.log1p(n) * (1 - distinct / max(n, 1)), min(1.0, math.log1p(distinct) / 3),
        share(UPPER), share(SIGNS), math.sqrt(share(SIGNS)), share(DIGITS), share(STOPS), bare,
        min(size / max(n, 1), 30.0) / 10, len(set(lines)) / max(len(lines), 1), min(n / max(len(lines), 1), 100.0) / 100, float(n == 0),
    ]


@dataclass
class Ranking:
    """A linear score over standardised features, and the curve that turns it into a number between 0 and 1."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    threshold: float
    slope: float
    cut: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.mean) / self.scale
        return np.concatenate([z, z * z], 1) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        at = self.slope * (self.raw(x) - self.threshold) + math.log(self.cut / (1 - self.cut))
        return 1 / (1 + np.exp(-np.clip(at, -30, 30)))


def with_features(docs: DataFrame, kept: list[str], text_col: str = "text") -> DataFrame:
    """The columns ``kept`` of every row and ``_x``, its features. No shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text"):
            x = pa.array([features(t) for t in column(batch, "_text").to_pylist()], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*[column(batch, c) for c in kept], x], [*kept, "_x"])

    schema = ", ".join([*[f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept], "_x array<double>"])
    return docs.select(*kept, F.col(text_col).alias("_text")).mapInArrow(run, schema)


def _sample(rows: DataFrame, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of at most ``limit`` rows of each label, those of smallest id hash."""
    found = []
    for label in (0, 1):
        found += rows.filter(F.col("label") == label).orderBy(F.xxhash64("id"), "id").limit(limit).select("x", "label").collect()
    return np.array([r["x"] for r in found], float).reshape(-1, N_FEATURES), np.array([r["label"] for r in found], int)


def _raw(x: Column, ranking: Ranking) -> Column:
    n = N_FEATURES
    z = F.zip_with(F.zip_with(x, F.array(*[F.lit(float(m)) for m in ranking.mean]), lambda a, b: a - b), F.array(*[F.lit(float(v)) for v in ranking.scale]), lambda a, b: a / b)
    parts = F.zip_with(z, F.array(*[F.struct(F.lit(float(a)).alias("a"), F.lit(float(b)).alias("b")) for a, b in zip(ranking.weights[:n], ranking.weights[n:])]),
                       lambda v, w: v * w["a"] + v * v * w["b"])
    return F.aggregate(parts, F.lit(0.0), lambda s, v: s + v)


def learn(rows: DataFrame, limit: int = 5000, pairs: int = 200_000, cut: float = 0.3, seed: int = 7) -> Ranking:
    """Scores from (id, x, label): features ``x`` of labelled rows, labels 0 and 1.

    Bradley-Terry: a pair (good, bad) is won by the good text with probability sigmoid(score difference).

    The logistic loss on feature differences of ``pairs`` random preference pairs is minimised by Newton steps. The
    threshold is the score quantile at the share of bad rows, and the curve is fitted to a histogram; both are taken over
    the scores of all labelled rows. Only the fit of the weights uses a sample: at most ``limit`` rows of each label. With one label only, all weights are
    zero and every text gets the same side.
    """
    counts = {r["label"]: r["count"] for r in rows.filter(F.col("label").isin(0, 1)).groupBy("label").count().collect()}
    x, y = _sample(rows, limit)
    share_bad = counts.get(0, 0) / max(sum(counts.values()), 1)
    if not len(x) or len(set(y)) < 2:
        side = 1.0 if not len(y) or y[0] == 1 else -1.0
        return Ranking(np.zeros(N_FEATURES), np.ones(N_FEATURES), np.zeros(2 * N_FEATURES), -side, 1.0, cut)
    mean, scale = x.mean(0), np.maximum(x.std(0), 1e-6)
    z = np.clip((x - mean) / scale, -1e3, 1e3)
    z = np.concatenate([z, z * z], 1)
    rng = np.random.default_rng(seed)
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    d = z[rng.choice(good, pairs)] - z[rng.choice(bad, pairs)]
    w = np.zeros(d.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(d @ w, -30, 30)))
        gradient = d.T @ (1 - p) - 1e-3 * pairs * w
        step = np.linalg.solve((d * (p * (1 - p))[:, None]).T @ d + 1e-3 * pairs * np.eye(len(w)), gradient)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    ranking = Ranking(mean, scale, w, 0.0, 1.0, cut)
    scored = cut_lineage(rows.filter(F.col("label").isin(0, 1)).select(_raw(F.col("x"), ranking).alias("raw"), F.col("label").cast("int").alias("label")))
    ranking.threshold = _quantile(scored, share_bad, sum(counts.values()))
    step = F.floor(F.greatest(F.least((F.col("raw") - ranking.threshold) * 64, F.lit(2047.0)), F.lit(-2048.0)))
    bins = scored.groupBy(step.alias("bin"), "label").agg(F.count("*").alias("n")).collect()
    at, side, n = (np.array([r[c] for r in bins], float) for c in ("bin", "label", "n"))
    ranking.slope = _slope((at + 0.5) / 64, side, n / n.sum(), math.log(cut / (1 - cut)))
    return ranking


def _quantile(scored: DataFrame, share: float, n: int) -> float:
    """A score with ``share`` of all ``n`` scores below it: counts of 1024 parts narrow its span until it holds one value."""
    low, high = (float(v) for v in scored.agg(F.min("raw"), F.max("raw")).first())
    rank = min(int(share * n), n - 1)
    while low < high:
        width = (high - low) / 1024
        part = F.least(F.floor((F.col("raw") - low) / width), F.lit(1023))
        inside = scored.filter(F.col("raw").between(low, high)).groupBy(part.alias("part")).agg(F.count("*").alias("n"), F.min("raw").alias("low"), F.max("raw").alias("high"))
        for r in sorted(inside.collect(), key=lambda r: r["part"]):
            if rank < r["n"]:
                break
            rank -= r["n"]
        if (r["low"], r["high"]) == (low, high):
            break
        low, high = r["low"], r["high"]
    return low


def _slope(x: np.ndarray, y: np.ndarray, weight: np.ndarray, offset: float) -> float:
    """Steepness of the logistic curve through the threshold, by golden-section search on the weighted log loss."""
    loss = lambda a: float(np.sum(weight * np.logaddexp(0, np.where(y == 1, -1, 1) * np.clip(math.exp(a) * x + offset, -500, 500))))
    low, high, r = -3.0, 4.0, (math.sqrt(5) - 1) / 2
    for _ in range(60):
        a, b = high - r * (high - low), low + r * (high - low)
        low, high = (low, b) if loss(a) < loss(b) else (a, high)
    return math.exp((low + high) / 2)


def quality(featured: DataFrame, ranking: Ranking, id_col: str = "doc_id") -> DataFrame:
    """One row per row of :func:`with_features`: id, ``score`` (0 to 1) and ``predicted`` (1 from ``ranking.cut`` on).

    Null and empty texts are scored by their features like any other. Repeated rows and null ids stay rows of their
    own. The linear score is plain column arithmetic.
    """
    raw = _raw(F.col("_x"), ranking)
    at = F.lit(ranking.slope) * (raw - F.lit(ranking.threshold)) + F.lit(math.log(ranking.cut / (1 - ranking.cut)))
    score = 1 / (1 + F.exp(-F.greatest(F.least(at, F.lit(30.0)), F.lit(-30.0))))
    return featured.select(id_col, score.alias("score")).withColumn("predicted", (F.col("score") >= ranking.cut).cast("int"))
