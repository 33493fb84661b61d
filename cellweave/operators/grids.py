"""Rasters as cell tables: pooling, addressing, upsampling, window cuts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellweave.session import numbered, small_side


def cell_of(row: str, col: str, s: int) -> tuple[Column, Column]:
    return F.expr(f"CAST({row} DIV {s} AS INT)").alias("gr"), F.expr(f"CAST({col} DIV {s} AS INT)").alias("gc")


def majority(n: Column, s: int) -> Column:
    """At least half of the s*s pixels, rounded up."""
    return n >= (s * s + 1) // 2


def pool_mask(pixels: DataFrame, keys: Sequence[str], s: int, hit: Column) -> DataFrame:
    """A pixel condition reduced to cells under three rules: any, majority, centre pixel."""
    gr, gc = cell_of("row", "col", s)
    centre = (F.col("row") % s == s // 2) & (F.col("col") % s == s // 2)
    return (
        pixels.groupBy(*keys, gr, gc)
        .agg(F.count_if(hit).alias("n"), F.bool_or(centre & hit).alias("centre"))
        .select(*keys, "gr", "gc", "n", (F.col("n") > 0).alias("any"), majority(F.col("n"), s).alias("majority"), "centre")
    )


def pool_many(pixels: DataFrame, keys: Sequence[str], s: int, hits: Mapping[str, Column], label: str) -> DataFrame:
    """Several pixel conditions pooled in one pass: one counter per condition, then one row per condition.

    The pixel rows are not multiplied by the number of conditions; only the pooled cells are.
    """
    gr, gc = cell_of("row", "col", s)
    names = list(hits)
    pooled = pixels.groupBy(*keys, gr, gc).agg(*[F.count_if(hits[n]).alias(f"_n{i}") for i, n in enumerate(names)])
    rows = F.array(*[F.struct(F.lit(n).alias(label), F.col(f"_n{i}").alias("n")) for i, n in enumerate(names)])
    return (
        pooled.select(*keys, "gr", "gc", F.explode(rows).alias("_t"))
        .select(*keys, "gr", "gc", f"_t.{label}", "_t.n")
        .withColumn("fg", majority(F.col("n"), s))
    )


def block_stats(pixels: DataFrame, keys: Sequence[str], s: int, value: str) -> DataFrame:
    """Minimum, maximum and "every value present" per s-by-s block; null means no reading."""
    gr, gc = cell_of("row", "col", s)
    return pixels.groupBy(*keys, gr, gc).agg(
        F.min(value).alias("vmin"), F.max(value).alias("vmax"), F.bool_and(F.col(value).isNotNull()).alias("all_read")
    )


def upsample(cells: DataFrame, factor: int) -> DataFrame:
    """Each cell repeated factor x factor times."""
    return cells.withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(factor * factor - 1)))).withColumns({
        "row": F.expr(f"CAST(row * {factor} + _i DIV {factor} AS INT)"),
        "col": F.expr(f"CAST(col * {factor} + _i % {factor} AS INT)"),
    }).drop("_i")


def cut_windows(raster: DataFrame, windows: DataFrame, keys: Sequence[str], size: int, block: int) -> DataFrame:
    """Windows ``(keys, window_id, dx, dy)`` cut from a big raster ``(keys, row, col, ...)``.

    Each window lists the blocks it touches, the raster cells carry their block, so the range join
    becomes an equi-join on (keys, block) followed by the offset filter.
    """
    touched = windows.withColumn(
        "_br", F.explode(F.expr(f"sequence(CAST(dy DIV {block} AS INT), CAST((dy + {size} - 1) DIV {block} AS INT))"))
    ).withColumn(
        "_bc", F.explode(F.expr(f"sequence(CAST(dx DIV {block} AS INT), CAST((dx + {size} - 1) DIV {block} AS INT))"))
    )
    cells = raster.withColumns({
        "_br": F.expr(f"CAST(row DIV {block} AS INT)"), "_bc": F.expr(f"CAST(col DIV {block} AS INT)")
    })
    return (
        cells.join(small_side(touched), [*keys, "_br", "_bc"])
        .filter(f"row >= dy AND row < dy + {size} AND col >= dx AND col < dx + {size}")
        .withColumns({"row": F.col("row") - F.col("dy"), "col": F.col("col") - F.col("dx")})
        .drop("_br", "_bc", "dx", "dy")
    )


def cut_with_halo(raster: DataFrame, windows: DataFrame, keys: Sequence[str], size: int, margin: int, block: int) -> DataFrame:
    """:func:`cut_windows` with ``margin`` cells of ground round each window; ``core`` marks the window itself.

    Rows and columns count from the window's corner, so the halo has negative ones and such beyond ``size``. A cell of
    the big raster serves every window it is near, by one equi-join on blocks. Ground beyond the raster has no cells;
    :func:`ground_bounds` says where it ends.
    """
    wide = windows.withColumns({"dx": F.col("dx") - margin, "dy": F.col("dy") - margin})
    cells = cut_windows(raster, wide, keys, size + 2 * margin, block)
    return cells.withColumns({"row": F.col("row") - margin, "col": F.col("col") - margin}).withColumn("core", inside("row", "col", size))


def ground_bounds(size: int, margin: int, height: int, width: int) -> dict[str, Column]:
    """Half-open bounds ``r0, r1, c0, c1`` of the ground a window ``(dx, dy)`` with its halo has inside a raster."""
    return {
        "r0": F.greatest(F.lit(-margin), -F.col("dy")), "r1": F.least(F.lit(size + margin), height - F.col("dy")),
        "c0": F.greatest(F.lit(-margin), -F.col("dx")), "c1": F.least(F.lit(size + margin), width - F.col("dx")),
    }


def neighbours8() -> list[tuple[int, int]]:
    return [(dy, dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if (dy, dx) != (0, 0)]


def spread(cells: DataFrame, offsets: Sequence[tuple[int, int]], row: str = "row", col: str = "col") -> DataFrame:
    """Every cell repeated at each offset; the base of dilation, discs and neighbour joins."""
    arr = F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in offsets])
    return numbered(cells, "_k", len(offsets)).withColumn("_o", F.get(arr, F.col("_k").cast("int"))).drop("_k").withColumns({
        row: F.col(row) + F.col("_o.dy"), col: F.col(col) + F.col("_o.dx")
    })


def inside(row: str, col: str, side: int) -> Column:
    return F.expr(f"{row} >= 0 AND {row} < {side} AND {col} >= 0 AND {col} < {side}")


def square(k: int) -> list[tuple[int, int]]:
    r = k // 2
    return [(dy, dx) for dy in range(-r, r + 1) for dx in range(-r, r + 1)]


def disc_offsets(radius: float) -> list[tuple[int, int]]:
    r = int(radius)
    return [(dy, dx) for dy in range(-r, r + 1) for dx in range(-r, r + 1) if dy * dy + dx * dx <= radius * radius]


def dilate(cells: DataFrame, keys: Sequence[str], k: int, side: int) -> DataFrame:
    """Lit cells widened by a k x k kernel, nothing beyond the border."""
    return spread(cells, square(k)).filter(inside("row", "col", side)).select(*keys, "row", "col").distinct()


def erode(cells: DataFrame, keys: Sequence[str], k: int) -> DataFrame:
    """Lit cells whose whole k x k neighbourhood is lit; cells beyond the border count as unlit."""
    return (
        spread(cells, square(k)).groupBy(*keys, "row", "col").agg(F.count("*").alias("_n"))
        .filter(F.col("_n") == k * k).select(*keys, "row", "col")
    )


def within_any(markers: DataFrame, keys: Sequence[str], radius: float, side: int) -> DataFrame:
    """Cells within the radius of any marker ``(keys, mrow, mcol)``; a marker with a null or negative column is unused."""
    used = markers.filter("mcol >= 0").withColumnsRenamed({"mrow": "row", "mcol": "col"})
    return (
        spread(used, disc_offsets(radius)).filter(inside("row", "col", side)).select(*keys, "row", "col").distinct()
    )
