"""Timetable text tables, raster tables, provenance and packed grids."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from cellweave.operators.ledger import upsert


def text_table(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """CSV with every column as text; only the empty string is null. Unused columns are pruned by the reader."""
    schema = StructType([StructField(c, StringType()) for c in columns])
    return spark.read.schema(schema).csv(path, header=True, nullValue="", emptyValue="", enforceSchema=False)


def write_raster(cells: DataFrame, path: str, block: int = 256) -> None:
    """Cell table as Parquet, one folder per block, cells in row order inside the files.

    Cells are shuffled by block and by row band, so one huge raster is written by many tasks.
    """
    blocked = cells.withColumn("block", F.expr(f"concat(row DIV {block}, '_', col DIV {block})"))
    blocked.repartition("block", F.expr("row DIV 64")).sortWithinPartitions("block", "row", "col").write.partitionBy("block").parquet(path)


def read_raster(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    return spark.read.schema(schema).parquet(path)


def write_by(df: DataFrame, path: str, parts: Sequence[str]) -> None:
    """One folder per combination of the parts."""
    df.write.partitionBy(*parts).parquet(path)


def mosaic(tiles: DataFrame, box: tuple[int, int, int, int], keys: Sequence[str]) -> DataFrame:
    """Tiles ``(tile_order, top, left, row, col, value)`` pasted into one frame by whole cells; the later tile wins.

    ``box`` is (row0, col0, row1, col1) in frame cells, half-open; the result counts from its corner.
    """
    r0, c0, r1, c1 = box
    at = tiles.withColumns({"row": F.col("row") + F.col("top"), "col": F.col("col") + F.col("left")}).filter(
        f"row >= {r0} AND row < {r1} AND col >= {c0} AND col < {c1} AND value IS NOT NULL")
    return at.groupBy(*keys, (F.col("row") - r0).alias("row"), (F.col("col") - c0).alias("col")).agg(F.max_by("value", "tile_order").alias("value"))


def write_layers(rows: DataFrame, path: str, keys: Sequence[str], order: Sequence[str], line: str) -> None:
    """One text file per combination of the keys, lines in the given order; null lines are empty.

    A combination is written by one task, so the keys have to hold a part number that bounds it.
    """
    laid = rows.select(*keys, *order, F.coalesce(F.col(line), F.lit("")).alias("value")).repartition(*keys).sortWithinPartitions(*keys, *order)
    laid.select(*keys, "value").write.partitionBy(*keys).text(path)


def provenance(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Every file below ``path``: keys of its folders, path below ``path``, bytes, lines, sha256 and UTC time of change.

    A file is one row and is hashed in the task that reads it, so the reader's limit of 2 GB a file applies; a larger file is
    an error. Lines are counted by their ends. An empty folder gives no rows.
    """
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "false").option("pathGlobFilter", pattern).load(path)
    keys = [c for c in f.columns if c not in ("path", "modificationTime", "length", "content")]
    text = F.col("content").cast("string")
    root = path.rstrip("/").rsplit("/", 1)[-1]
    utc = F.to_utc_timestamp("modificationTime", F.current_timezone())
    return f.select(
        *keys, F.substring_index(F.col("path"), f"/{root}/", -1).alias("file"), F.col("length").alias("bytes"),
        (F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n")))).cast("bigint").alias("lines"),
        F.sha2("content", 256).alias("sha256"), F.date_format(utc, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("changed"))


def update_manifest(entries: DataFrame, changes: DataFrame, keys: Sequence[str] = ("layer",)) -> DataFrame:
    """Insert or replace entries by the keys, the latest stamp wins; sorted by the keys."""
    return upsert(entries, changes, list(keys), "stamp").orderBy(*keys)


def pack_bits(lit: DataFrame, keys: Sequence[str], width: int) -> DataFrame:
    """Lit cells ``(keys, row, col)`` to one BINARY per grid row, most significant bit first, padded to whole bytes."""
    n = (width + 7) // 8
    byte = lit.groupBy(*keys, "row", F.expr("CAST(col DIV 8 AS INT) AS b")).agg(F.bit_or(F.expr("shiftleft(1, 7 - col % 8)")).alias("v"))
    per = byte.groupBy(*keys, "row").agg(*[F.max(F.when(F.col("b") == i, F.col("v"))).alias(f"_b{i}") for i in range(n)])
    text = F.concat(*[F.lpad(F.hex(F.coalesce(f"_b{i}", F.lit(0)).cast("bigint")), 2, "0") for i in range(n)])
    return per.select(*keys, "row", F.unhex(text).alias("bits"))


def unpack_bits(packed: DataFrame, keys: Sequence[str], width: int) -> DataFrame:
    """The lit cells of packed rows, cut to the grid's width."""
    return packed.withColumn("col", F.explode(F.sequence(F.lit(0), F.lit(width - 1)))).filter(bit_at(F.col("bits"), F.col("col")) == 1).select(*keys, "row", "col")


def bit_at(bits: Column, col: Column) -> Column:
    byte = F.conv(F.hex(F.substring(bits, F.floor(col / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.getbit(byte, 7 - col % 8)


def crop_index(crops: DataFrame, places: DataFrame, size: int) -> DataFrame:
    """Index rows of crops ``(district, crop_id, dx, dy)``: box, number of places and the list as JSON text.

    A place belongs to every crop whose half-open box holds it; crops and places meet on blocks of the crop size.
    """
    c = crops.withColumn("_gx", F.explode(F.expr(f"sequence(CAST(dx DIV {size} AS BIGINT), CAST((dx + {size} - 1) DIV {size} AS BIGINT))"))).withColumn(
        "_gy", F.explode(F.expr(f"sequence(CAST(dy DIV {size} AS BIGINT), CAST((dy + {size} - 1) DIV {size} AS BIGINT))")))
    p = places.withColumns({"_gx": F.floor(F.col("x") / size), "_gy": F.floor(F.col("y") / size)})
    hit = c.join(p, ["district", "_gx", "_gy"]).filter(f"x >= dx AND x < dx + {size} AND y >= dy AND y < dy + {size}")
    per = hit.groupBy("crop_id").agg(F.count("*").alias("n_places"), F.to_json(F.array_sort(F.collect_list(F.struct("id", "cls")))).alias("places"))
    return crops.join(per, "crop_id", "left").select(
        "crop_id", F.format_string("%d,%d,%d,%d", "dx", "dy", F.col("dx") + size, F.col("dy") + size).alias("bbox"),
        F.coalesce("n_places", F.lit(0)).cast("bigint").alias("n_places"), F.coalesce("places", F.lit("[]")).alias("places"))
