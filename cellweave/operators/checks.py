"""Guards: values outside a class list, frames that do not match, keys without a partner."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def disallowed(df: DataFrame, col: str, allowed: Iterable[int]) -> DataFrame:
    """Values that are not in the class list, with their counts; must be empty for a sound raster."""
    return df.filter(~F.col(col).isin(*allowed)).groupBy(col).agg(F.count("*").alias("n"))


def require_empty(df: DataFrame, what: str) -> None:
    """Fail with an example when a table of violations has rows."""
    bad = df.limit(1).collect()
    if bad:
        raise ValueError(f"{what}: {bad[0].asDict()}")


def frames_equal(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Do two rasters cover the same frame, per key."""

    def frame(df: DataFrame, p: str) -> DataFrame:
        return df.groupBy(*keys).agg(*[
            f.alias(f"{p}{i}") for i, f in enumerate((F.min("row"), F.max("row"), F.min("col"), F.max("col"), F.count("*")))
        ])

    same = F.lit(True)
    for i in range(5):
        same = same & (F.col(f"a{i}") == F.col(f"b{i}"))
    return frame(a, "a").join(frame(b, "b"), list(keys)).select(*keys, same.alias("aligned"))


def without_partner(required: DataFrame, present: DataFrame, keys: Sequence[str]) -> DataFrame:
    return required.join(present.select(*keys), list(keys), "left_anti")
