"""Per-cell targets of conditions, marker-relative conditions and rank rules."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellweave.operators.grids import pool_many
from cellweave.operators.ranking import tiered_rank

MIN_PIXELS = 50  # fewer ground pixels give no relative target


@dataclass(frozen=True)
class Atom:
    layer: str
    cls: int

    @property
    def key(self) -> str:
        return f"{self.layer}_{self.cls}"

    def hit(self) -> Column:
        return F.col(self.layer) == self.cls


def task_key(*atoms: Atom) -> str:
    """Canonical name of a condition; its atoms must be on different layers."""
    if len({a.layer for a in atoms}) != len(atoms) or not 1 <= len(atoms) <= 2:
        raise ValueError("a condition has one or two atoms on different layers")
    return "+".join(sorted(a.key for a in atoms))


def task_hit(atoms: Sequence[Atom]) -> Column:
    out = atoms[0].hit()
    for a in atoms[1:]:
        out = out & a.hit()
    return out


def condition_targets(pixels: DataFrame, tasks: dict[str, Sequence[Atom]], s: int) -> DataFrame:
    """``(crop_id, task_key, gr, gc, n, fg)``: pixel-wise AND of the atoms, then the majority of each cell."""
    return pool_many(pixels, ["crop_id"], s, {k: task_hit(v) for k, v in tasks.items()}, "task_key")


def relative_levels(ground: DataFrame, value: str) -> DataFrame:
    """Per crop: pixel count, lower median, minimum and floor of the mean of the ground pixels.

    Works on the counts per (crop, level), so the group size is the number of levels.
    """
    counts = ground.groupBy("crop_id", value).agg(F.count("*").alias("c"))
    upto = Window.partitionBy("crop_id").orderBy(value)
    total = F.sum("c").over(Window.partitionBy("crop_id"))
    return (
        counts.select("crop_id", value, "c", F.sum("c").over(upto).alias("cum"), total.alias("n"))
        .groupBy("crop_id")
        .agg(
            F.max("n").alias("n"),
            F.min(F.when(F.col("cum") >= F.ceil(F.col("n") / 2), F.col(value))).alias("med"),
            F.min(value).alias("low"),
            F.floor(F.sum(F.col(value) * F.col("c")) / F.max("n")).cast("int").alias("mean_floor"),
            F.count("*").alias("n_levels"),
            F.min_by("c", value).alias("n_low"),
        )
    )


def below_median(ground: DataFrame, value: str) -> DataFrame:
    """Ground pixels strictly below the lower median of their crop; crops with too few pixels give none."""
    levels = relative_levels(ground, value).filter(F.col("n") >= MIN_PIXELS).select("crop_id", "med")
    return ground.join(levels, "crop_id").filter(F.col(value) < F.col("med")).drop("med")


def lowest_third(ground: DataFrame, value: str) -> DataFrame:
    """The first max(1, n // 3) ground pixels of each crop in (value, row, col) order."""
    n = ground.groupBy("crop_id").agg(F.count("*").alias("_n"))
    return (
        tiered_rank(ground, ["crop_id"], [value, "row", "col"], "_rank")
        .join(n, "crop_id")
        .filter((F.col("_n") >= MIN_PIXELS) & (F.col("_rank") <= F.greatest(F.lit(1), F.floor(F.col("_n") / 3))))
        .drop("_rank", "_n")
    )


def next_class(atom: Atom, n_classes: int = 4) -> Atom:
    """Wrong-description control: the next class of the same layer."""
    return Atom(atom.layer, (atom.cls + 1) % n_classes)
