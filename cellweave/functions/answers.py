"""Free-text answers to points, and point scaling, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The answer formats that are read
FENCED = r"(?si)```(?:json)?\s*(.*?)\s*```"
PAIR = r"\[\s*(-?\d+(?:\.\d+)?)\s*,\s*(-?\d+(?:\.\d+)?)\s*\]"
POINT_KEYS = ("path", "route", "points", "polyline")
GRID_SIDE = 1000.0

POINTS = "array<array<double>>"


def json_part(text: Column) -> Column:
    """Fenced block, else first ``{`` to last ``}``, else first ``[`` to last ``]``."""

    def between(a: str, b: str) -> Column:
        i, j = F.instr(text, a), F.length(text) - F.instr(F.reverse(text), b) + 1
        return F.when((i > 0) & (F.instr(text, b) > 0) & (j > i), F.substring(text, i, j - i + 1))

    fenced = F.when(text.rlike(FENCED), F.trim(F.regexp_extract(text, FENCED, 1)))
    return F.coalesce(fenced, between("{", "}"), between("[", "]"))


def _pairs_only(points: Column) -> Column:
    """Null unless there are two points or more and each is a pair of finite numbers."""
    ok = F.forall(points, lambda p: (F.size(p) == 2) & F.forall(p, finite))
    return F.when((F.size(points) >= 2) & F.coalesce(ok, F.lit(False)), points)


def finite(v: Column) -> Column:
    return v.isNotNull() & ~F.isnan(v) & (F.abs(v) != F.lit(float("inf")))


def valid_points(points: Column) -> Column:
    """Points that can be scored: a list of at least two pairs of finite numbers, else null."""
    return F.when(points.isNotNull(), _pairs_only(points))


def answer_points(text: Column, max_points: int | None = None) -> Column:
    """Points of an answer in grid units, or null; broken JSON falls back to the pairs found in the text.

    All points are returned unless ``max_points`` is given.
    """
    raw = json_part(text)
    good = F.try_parse_json(raw).isNotNull()
    schema = "struct<" + ",".join(f"{k}:{POINTS}" for k in POINT_KEYS) + ">"
    obj = F.from_json(raw, schema)
    listed = F.when(
        good, F.when(raw.startswith("{"), F.coalesce(*[obj[k] for k in POINT_KEYS])).otherwise(F.from_json(raw, POINTS))
    )
    found = F.transform(
        F.regexp_extract_all(text, F.lit(PAIR), F.lit(0)),
        lambda m: F.array(F.regexp_extract(m, PAIR, 1).cast("double"), F.regexp_extract(m, PAIR, 2).cast("double")),
    )
    cut = (lambda points: points) if max_points is None else (lambda points: F.slice(points, 1, max_points))
    return cut(F.coalesce(_pairs_only(listed), _pairs_only(cut(found))))


def failure_hint(text: Column) -> Column:
    """Why an answer could not be read."""
    return (
        F.when(F.trim(text) == "", "empty answer")
        .when(F.contains(text, F.lit("```")) & text.rlike(r"(```|\[|,)\s*$"), "truncated JSON")
        .when(text.rlike(PAIR), "pairs but no JSON")
        .otherwise("no pairs")
    )


def grid_to_px(v: Column, size: float) -> Column:
    return v / GRID_SIDE * size


def px_to_grid(v: Column, size: float) -> Column:
    return v / size * GRID_SIDE


def window_to_px(v: Column, px_per_m: float) -> Column:
    """Window metres to image pixels, three decimals."""
    return F.round(v * px_per_m, 3)
