"""Mixing sources to target token shares by entropy balancing (operator 1)."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellweave.llm.common import WORD
from cellweave.operators.ranking import tiered_rank
from cellweave.session import cut_lineage


def targets(sources: DataFrame, weights: Sequence[float], share: float, cap: float) -> DataFrame:
    """Add ``target`` to (key, source, source_size): ``share`` of all sizes, split by weight, none above ``cap`` x size.

    Sources in code point order (null last) take ``weights`` in turn. What a capped source leaves is shared again by
    weight, until none is above its cap. The table has a row per source, and only sums come to the driver.
    """
    at = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1
    weighted = cut_lineage(sources.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (at % len(weights) + 1).cast("int"))))
    limit = F.col("source_size") * F.lit(float(cap))
    total = float(weighted.agg(F.sum("source_size")).first()[0] or 0) * share
    level, n_full = None, -1
    while True:
        full = F.lit(False) if level is None else limit < F.col("weight") * F.lit(level)
        row = weighted.agg(F.sum(F.when(full, limit)), F.sum(F.when(~full, F.col("weight"))), F.count_if(full)).first()
        if row[2] == n_full or not row[1]:
            break
        n_full, level = row[2], (total - (row[0] or 0.0)) / row[1]
    return weighted.withColumn("target", F.least(limit, F.col("weight") * F.lit(float(level or 0.0))))


def _rate(cap: float) -> Column:
    return F.when(F.col("full"), F.lit(cap)).otherwise(F.least(F.lit(cap), F.exp(F.col("tilt") * F.col("size") / F.col("mean"))))


def _exact_sum(value: Column) -> Column:
    """A sum that does not depend on the order of its rows, so that reruns give the same bits."""
    return F.sum(value.cast("decimal(38,12)")).cast("double")


def tilts(groups: DataFrame, sources: DataFrame, cap: float, tolerance: float = 1e-9) -> DataFrame:
    """The multiplier of each source: minimum of the convex dual sum(phi(tilt * size)) - tilt * target.

    Rates are ``min(cap, exp(tilt * size / mean))``, the rates nearest to 1 in relative entropy that meet the token
    constraint under the cap. Every Newton step is one aggregate over (source, size, n); a bracket keeps it safe.
    """
    state = cut_lineage(
        sources.withColumn("full", F.col("target") >= F.col("source_size") * cap)
        .withColumn("mean", F.greatest(F.col("source_size") / F.col("n_docs"), F.lit(1e-9)))
        .selectExpr("key", "source_size", "target", "full", "mean", "0D tilt", "CAST(NULL AS DOUBLE) low", "CAST(NULL AS DOUBLE) high", "full OR target <= 0 done")
    )
    while not state.filter("NOT done").isEmpty():
        r = _rate(cap)
        sums = (
            groups.join(state.filter("NOT done"), "key")
            .groupBy("key")
            .agg(_exact_sum(F.col("n") * F.col("size") * r).alias("got"), _exact_sum(F.when(r < cap, F.col("n") * F.col("size") * r * F.col("size") / F.col("mean"))).alias("slope"))
        )
        gap = F.col("got") - F.col("target")
        met = F.abs(gap) <= F.greatest(F.col("target") * tolerance, F.lit(1e-6))
        low, high = F.when(gap < 0, F.col("tilt")).otherwise(F.col("low")), F.when(gap > 0, F.col("tilt")).otherwise(F.col("high"))
        step = F.col("tilt") - F.least(F.greatest(gap / F.col("slope"), F.lit(-1.0)), F.lit(1.0))
        newton = F.coalesce(step, F.col("tilt") - F.signum(gap))
        outside = (newton <= F.col("low2")) | (newton >= F.col("high2"))
        nearly = F.coalesce(F.col("high2") - F.col("low2") < 1e-12, F.lit(False))
        moved = state.join(sums, "key", "left").withColumn("low2", low).withColumn("high2", high)
        state = cut_lineage(moved.select(
            "key", "source_size", "target", "full", "mean",
            F.when(F.col("done") | met, F.col("tilt"))
            .when(F.coalesce(outside, F.lit(False)), (F.coalesce("low2", F.col("high2") - 1) + F.coalesce("high2", F.col("low2") + 1)) / 2)
            .otherwise(newton).alias("tilt"),
            F.col("low2").alias("low"), F.col("high2").alias("high"),
            (F.col("done") | met | nearly).alias("done"),
        ), state)
    return state


def _carry(pdf: pd.DataFrame) -> pd.DataFrame:
    """Whole copies for each (source, size), longest first; what a size takes too much or too little is passed on."""
    pdf = pdf.sort_values("size", ascending=False, kind="stable")
    copies, error = [], 0.0
    for size, n, rate, cap in zip(pdf["size"], pdf["n"], pdf["rate"], pdf["cap"]):
        want = n * rate * size + error
        k = min(max(int(want / size + 0.5), 0), int(n * cap)) if size else n
        error = want - k * size
        copies.append(k)
    return pd.DataFrame({"key": pdf["key"], "size": pdf["size"], "n": pdf["n"], "copies": copies})


def mix(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, cap: float = 2.0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per row of ``docs``: id, source, size, source_size, target, rate, copies and taken = copies x size.

    Sizes are words between ASCII white space (null text: 0). Rates come from :func:`tilts`; copies are 0 to ``cap``,
    rounded so that the error of a source ends below its smallest documents. Documents of size 0 cost no words and keep
    one copy. Within equal (source, size) the extra
    copies go by a hash of the id, so reruns agree. Null sources form the last source; rows with null or repeated ids
    stay rows of their own; an empty table gives an empty result. Other columns are not read.

    The text is read once; all later steps use (id, source, size). The only grouped Python task gets one row per
    distinct size of a source; all other steps are aggregates and joins on (source, size), split by AQE if hot.
    """
    sized = cut_lineage(docs.select(
        F.col(id_col).alias("id"), F.col(source_col).alias("source"),
        F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
    ).withColumn("key", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("null"))))
    groups = cut_lineage(sized.groupBy("key", "size").agg(F.count("*").alias("n"), F.first("source").alias("source")))
    sources = groups.groupBy("key").agg(F.first("source").alias("source"), F.sum(F.col("n") * F.col("size")).alias("source_size"), F.sum("n").alias("n_docs"))
    sources = cut_lineage(targets(sources, weights, share, cap))
    state = tilts(groups, sources, cap)
    rated = groups.join(state, "key").select("key", "size", "n", F.when(F.col("size") == 0, 1.0).when(F.col("target") <= 0, 0.0).otherwise(_rate(cap)).alias("rate"), F.lit(float(cap)).alias("cap"))
    taken = rated.groupBy("key").applyInPandas(_carry, "key string, size long, n long, copies long")
    ranked = tiered_rank(
        sized.withColumn("_h", F.xxhash64("id")).withColumn("_bucket", F.pmod(F.col("_h"), F.lit(1024))), ["key", "size"], ["_bucket", "_h"], "_rank"
    )
    copies = F.floor(F.col("copies") / F.col("n")) + (F.col("_rank") <= F.col("copies") % F.col("n")).cast("long")
    rates = rated.select("key", "size", "rate")
    return (
        ranked.join(taken.join(rates, ["key", "size"]), ["key", "size"])
        .join(sources.select("key", "source_size", "target"), "key")
        .select(F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", "rate", copies.cast("long").alias("copies"))
        .withColumn("taken", F.col("copies") * F.col("size"))
    )


def repeat_by_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The rows of ``docs``, each as often as :func:`mix` takes it (0 to ``cap`` times), with their columns.

    Rows that repeat id, source and size are taken as often as the one of them that is taken most.
    """
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    name = lambda ident, source, n: F.concat_ws("\x01", F.coalesce(ident.cast("string"), F.lit("\x02")), F.coalesce(source, F.lit("\x02")), n)
    mixed = mix(docs, id_col=id_col, text_col=text_col, source_col=source_col, **options)
    copies = mixed.filter("copies > 0").groupBy(name(F.col(id_col), F.col(source_col), F.col("size")).alias("_row")).agg(F.max("copies").cast("int").alias("_copies"))
    found = docs.withColumn("_row", name(F.col(id_col), F.col(source_col), size)).join(copies, "_row")
    return found.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select(*docs.columns)
