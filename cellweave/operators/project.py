"""Row-wise and keyed clean-up of register rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values: (period, code, label, lower dB, upper dB) of the noise bands
NOISE_BANDS = [
    ("lden", 1, "50-55 dB", 50.0, 55.0),
    ("lden", 2, "55-60 dB", 55.0, 60.0),
    ("lden", 3, "60-65 dB", 60.0, 65.0),
    ("lden", 4, "65-70 dB", 65.0, 70.0),
    ("lden", 5, "70-75 dB", 70.0, 75.0),
    ("lden", 6, "75 dB and above", 75.0, None),
    ("lden", 99, "zoned industrial estate (outline)", None, None),
    ("lden", 999, "55 dB(A) installation (outline)", None, None),
    ("lnight", 11, "45-50 dB", 45.0, 50.0),
    ("lnight", 12, "50-55 dB", 50.0, 55.0),
    ("lnight", 13, "55-60 dB", 55.0, 60.0),
    ("lnight", 14, "60-65 dB", 60.0, 65.0),
    ("lnight", 15, "65-70 dB", 65.0, 70.0),
    ("lnight", 16, "70 dB and above", 70.0, None),
    ("lnight", 99, "zoned industrial estate (outline)", None, None),
    ("lnight", 999, "55 dB(A) installation (outline)", None, None),
]


def rename_attributes(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    """``{out: source}`` projection; a source column that does not exist gives null text."""
    have = set(df.columns)
    return df.select(*[
        (F.col(src) if src in have else F.lit(None).cast("string")).alias(out) for out, src in names.items()
    ])


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[Column], cols: Sequence[str]) -> DataFrame:
    """First row of each key by a stated order, with the number of dropped rows; partial aggregation only."""
    best = F.min_by(F.struct(*cols), F.struct(*order)).alias("_r")
    return df.groupBy(*keys).agg(best, (F.count("*") - 1).alias("dropped")).select(
        *keys, *[F.col(f"_r.{c}").alias(c) for c in cols], "dropped"
    )


def decode_band(rows: DataFrame) -> DataFrame:
    """Band label and bounds of ``(period, code)``; codes that are unknown or no numbers stay visible as labels."""
    bands = rows.sparkSession.createDataFrame(
        NOISE_BANDS, "period string, _code int, _label string, db_min double, db_max double"
    )
    code = F.expr("try_cast(code AS INT)")
    unknown = F.concat(
        F.when(code.isNull(), F.lit("<unparseable ")).otherwise(F.lit("<unknown ")), "period", F.lit(" band "), "code", F.lit(">")
    )
    # the band table is a fixed list of sixteen rows
    return (
        rows.withColumn("_code", code).join(F.broadcast(bands), ["period", "_code"], "left")
        .withColumn("label", F.coalesce("_label", unknown)).drop("_label", "_code")
    )


def top_ranked(df: DataFrame, col: str, k: int) -> DataFrame:
    """The k most frequent values with their rank; ties in value order."""
    top = df.groupBy(col).agg(F.count("*").alias("n")).orderBy(F.desc("n"), col).limit(k)
    return top.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("n"), col)))
