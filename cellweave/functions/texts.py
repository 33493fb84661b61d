"""Prompt and target texts of point items."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Surface class names in class order
SURFACE_WORDS = ("none", "roadway", "sidewalk", "building")


def point_prompt(phrase: str, x: Column, y: Column) -> Column:
    """Question about one point in grid units of 0 to 1000."""
    options = ", ".join(f'"{w}"' for w in SURFACE_WORDS)
    return F.format_string(
        f"What is the {phrase} at the point (x=%d, y=%d)? Answer with exactly one of: {options}.",
        F.round(x).cast("int"), F.round(y).cast("int"),
    )


def target_token(layer: str, cls: Column) -> Column:
    return F.format_string(f"<{layer}:%d>", cls)


def target_word(cls: Column) -> Column:
    return F.element_at(F.array(*[F.lit(w) for w in SURFACE_WORDS]), cls + 1)
