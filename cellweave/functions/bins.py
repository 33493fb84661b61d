"""Half-open binning rules."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

OPEN = 10**9  # beyond any number of fronts
# Report bands of the number of fronts; one front counts in the first band
FRONT_BANDS = (("2-3", 0, 3), ("4-5", 4, 5), ("6+", 6, OPEN))
# Overlapping bands of the rollout report
ROLLOUT_BANDS = (
    ("n_goal 2-3", 2, 3), ("n_goal 4-5", 4, 5), ("n_goal 6+", 6, OPEN), ("n_goal 6-8", 6, 8), ("n_goal 9+", 9, OPEN),
    ("n_goal 9-12", 9, 12), ("n_goal 13+", 13, OPEN),
)
LENGTH_BIN_M = 10
LAST_LENGTH_BIN = 36


def rounded(value: Column, digits: int) -> Column:
    """A double rounded as SQL engines do: it is scaled first, and halves go away from zero.

    ``round(value, digits)`` takes the shortest decimal of the double instead: 0.60835, which times 10,000 is a last bit
    below 6083.5, becomes 0.6084 there and 0.6083 here.
    """
    scale = F.lit(float(10**digits))
    return F.round(value * scale) / scale


def length_bin(metres: Column) -> Column:
    """10 m bins, clamped to the first and the last bin."""
    return F.least(F.greatest(F.floor(metres / LENGTH_BIN_M), F.lit(0)), F.lit(LAST_LENGTH_BIN)).cast("int")


def band_of(value: Column, edges: Sequence[float]) -> Column:
    """Index of the half-open band ``[edges[i], edges[i+1])``; null outside all bands."""
    case = F.when(F.lit(False), F.lit(0))
    for i, (lo, hi) in enumerate(zip(edges[:-1], edges[1:])):
        case = case.when((value >= lo) & (value < hi), F.lit(i))
    return case


def front_band(n_goal: Column) -> Column:
    case = F.when(F.lit(False), F.lit(""))
    for name, lo, hi in FRONT_BANDS:
        case = case.when(n_goal.between(lo, hi), F.lit(name))
    return case


def detour_stratum(ratio: Column, edges: Sequence[float]) -> Column:
    """First half-open stratum that holds the ratio; anything beyond goes to the last one."""
    return F.coalesce(band_of(ratio, edges), F.lit(len(edges) - 2))


def sun_class(hours: Column, breaks: Sequence[float]) -> Column:
    """Sunlit hours by breaks; no reading (inside buildings) is the extra class."""
    case = F.when(hours.isNull(), F.lit(len(breaks) + 1))
    for i, b in enumerate(breaks):
        case = case.when(hours < b, F.lit(i))
    return case.otherwise(F.lit(len(breaks)))
