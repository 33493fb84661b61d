"""Scores of predicted cells against target cells.

Input is always a cell table; every score is one counter row per sample (partial aggregation inside the
tasks) followed by a small aggregate per task, so neither a hot task nor a hot sample is ever collected.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellweave.operators.grids import cell_of, inside, majority, spread, square


def ratio(num: Column, den: Column, empty: float = 1.0) -> Column:
    """``num / den`` with a stated value where the denominator is zero."""
    return F.coalesce(F.try_divide(num.cast("double"), den.cast("double")), F.lit(empty))


def overlap_counts(cells: DataFrame, keys: Sequence[str], pred: Column, tgt: Column, pure: Column | None = None) -> DataFrame:
    """Per sample: shared, united, predicted and target cells; with ``pure`` also split by pure and mixed cells."""
    aggs = [
        F.count_if(pred & tgt).alias("inter"), F.count_if(pred | tgt).alias("uni"),
        F.count_if(pred).alias("n_pred"), F.count_if(tgt).alias("n_tgt"), F.count("*").alias("n_cells"),
    ]
    if pure is not None:
        for name, part in (("pure", pure), ("mixed", ~pure)):
            aggs += [F.count_if(pred & tgt & part).alias(f"inter_{name}"), F.count_if((pred | tgt) & part).alias(f"uni_{name}")]
    return cells.groupBy(*keys).agg(*aggs)


def overlap_report(counts: DataFrame, keys: Sequence[str], skip_empty: bool = True) -> DataFrame:
    """Macro means per task. ``skip_empty`` leaves empty targets out of the means and reports them apart;
    without it every sample counts and an empty prediction of an empty target scores 1."""
    some = F.col("n_tgt") > 0
    use = some if skip_empty else F.lit(True)
    iou = ratio(F.col("inter"), F.col("uni"))

    def mean(c: Column, cond: Column) -> Column:
        return F.round(F.avg(F.when(cond, c)), 6)

    aggs = [
        F.count("*").alias("samples"), F.count_if(some).alias("non_empty"), mean(iou, use).alias("iou"),
        mean(ratio(F.col("inter"), F.col("n_pred")), use).alias("precision"),
        mean(ratio(F.col("inter"), F.col("n_tgt")), use).alias("recall"),
        F.round(F.coalesce(F.avg(F.when(~some, (F.col("n_pred") > 0).cast("double"))), F.lit(0.0)), 6).alias("empty_false_rate"),
    ]
    for name in ("pure", "mixed"):
        if f"uni_{name}" in counts.columns:
            u = F.col(f"uni_{name}")
            aggs.append(mean(ratio(F.col(f"inter_{name}"), u), u > 0).alias(f"iou_{name}"))
    return counts.groupBy(*keys).agg(*aggs)


def threshold_sweep(cells: DataFrame, sample: Sequence[str], task: Sequence[str], score: str, tgt: str,
                    thresholds: Sequence[float]) -> DataFrame:
    """``(task, threshold, iou)``: mean overlap over non-empty targets; one counter pair per threshold, no row blow-up."""
    t = F.col(tgt)
    aggs = [F.count_if(t).alias("_t")]
    for i, thr in enumerate(thresholds):
        p = F.col(score) > thr
        aggs += [F.count_if(p & t).alias(f"_i{i}"), F.count_if(p | t).alias(f"_u{i}")]
    per = cells.groupBy(*sample, *task).agg(*aggs).filter("_t > 0")
    means = per.groupBy(*task).agg(*[F.avg(ratio(F.col(f"_i{i}"), F.col(f"_u{i}"))).alias(f"_m{i}") for i in range(len(thresholds))])
    rows = F.array(*[F.struct(F.lit(float(v)).alias("threshold"), F.col(f"_m{i}").alias("iou")) for i, v in enumerate(thresholds)])
    return means.select(*task, F.explode(rows).alias("_r")).select(*task, "_r.threshold", "_r.iou")


def best_threshold(sweep: DataFrame, task: Sequence[str]) -> DataFrame:
    """Best cut-off per task; equal means take the lowest threshold. Means are compared at nine decimals."""
    key = F.struct(F.round("iou", 9), -F.col("threshold"))
    return sweep.groupBy(*task).agg(F.max_by("threshold", key).alias("best_threshold"), F.max("iou").alias("best_iou"))


def localisation(cells: DataFrame, keys: Sequence[str], score: str, pred: Column, true_cell: str, side: int, patch: int) -> DataFrame:
    """Per sample with exactly one target cell: arg-max cell, hits and distances. ``true_cell`` is row * side + col."""
    ix = F.col("gr") * side + F.col("gc")
    in_patch = (F.floor(F.col("gr") / patch) == F.floor(F.floor(F.col(true_cell) / side) / patch)) & (
        F.floor(F.col("gc") / patch) == F.floor((F.col(true_cell) % side) / patch))
    per = cells.groupBy(*keys, true_cell).agg(
        F.max_by(ix, F.struct(F.col(score), -ix)).alias("am"), F.count_if(pred).alias("n_pred"),
        F.bool_or(pred & (ix == F.col(true_cell))).alias("true_cell_hit"), F.count_if(pred & in_patch).alias("n_in_patch"),
    )
    am, t = F.col("am"), F.col(true_cell)

    def div(c: Column, k: int) -> Column:
        return F.floor(c / k)

    patch_hit = (div(div(am, side), patch) == div(div(t, side), patch)) & (div(am % side, patch) == div(t % side, patch))
    dr, dc = div(am, side) - div(t, side), am % side - t % side
    return per.withColumns({
        "exact": (F.col("n_pred") == 1) & F.col("true_cell_hit"), "argmax_hit": am == t, "patch_hit": patch_hit,
        "in_patch_share": F.when(F.col("n_pred") > 0, F.col("n_in_patch") / F.col("n_pred")),
        "dist": F.sqrt((dr * dr + dc * dc).cast("double")),
    })


def tolerant_counts(cells: DataFrame, keys: Sequence[str], side: int, tol: int) -> DataFrame:
    """Counters of masks widened by ``tol`` cells on every side, from lit cells only.

    Each lit cell is sent once to its neighbourhood and carries its flags and whether it is the centre, so
    dilation of both masks and the join between them are one shuffle.
    """
    k = 2 * tol + 1
    lit = cells.filter("pred OR tgt").withColumnsRenamed({"gr": "row", "gc": "col"})
    wide = spread(lit, square(k)).filter(inside("row", "col", side))
    centre = (F.col("_o.dy") == 0) & (F.col("_o.dx") == 0)
    per_cell = wide.groupBy(*keys, "row", "col").agg(
        F.bool_or("pred").alias("pd"), F.bool_or("tgt").alias("td"),
        F.bool_or(F.col("pred") & centre).alias("p"), F.bool_or(F.col("tgt") & centre).alias("t"),
    )
    return per_cell.groupBy(*keys).agg(
        F.count_if(F.col("pd") & F.col("td")).alias("inter_d"), F.count_if(F.col("pd") | F.col("td")).alias("uni_d"),
        F.count_if(F.col("p") & F.col("td")).alias("p_near"), F.count_if("p").alias("n_pred"),
        F.count_if(F.col("t") & F.col("pd")).alias("t_near"), F.count_if("t").alias("n_tgt"),
    )


def tolerant_scores(counts: DataFrame) -> DataFrame:
    half = 0.5 * (F.col("p_near") + F.col("t_near"))
    return counts.withColumns({
        "iou_wide": ratio(F.col("inter_d"), F.col("uni_d")), "precision_near": ratio(F.col("p_near"), F.col("n_pred"), 0.0),
        "recall_near": ratio(F.col("t_near"), F.col("n_tgt")), "iou_matched": ratio(half, F.col("n_pred") + F.col("n_tgt") - half),
    })


def copy_new_counts(cells: DataFrame, keys: Sequence[str], preds: Mapping[str, Column], label: str = "rule") -> DataFrame:
    """Recall on target cells that were already on the drawing, on new ones, and marks on empty cells, for each rule.

    All rules are counted in one pass over the cells; only the counted rows are multiplied.
    """
    t, d, names = F.col("tgt"), F.col("pad"), list(preds)
    hits = [F.count_if(c & preds[n]).alias(f"_{h}{i}") for i, n in enumerate(names) for h, c in (("hc", t & d), ("hn", t & ~d), ("he", ~t))]
    per = cells.groupBy(*keys).agg(F.count_if(t & d).alias("nc"), F.count_if(t & ~d).alias("nn"), F.count_if(~t).alias("ne"), *hits)
    rules = F.array(*[F.struct(F.lit(n).alias(label), *[F.col(f"_{h}{i}").alias(h) for h in ("hc", "hn", "he")]) for i, n in enumerate(names)])
    each = per.withColumn("_r", F.explode(rules)).select(*keys, "nc", "nn", "ne", "_r.*")
    return each.withColumns({
        "copied_recall": ratio(F.col("hc"), F.col("nc")), "new_recall": ratio(F.col("hn"), F.col("nn")),
        "false_marks": ratio(F.col("he"), F.col("ne"), 0.0),
    })


def equal_group_weights(cells: DataFrame, sample: Sequence[str], side: int, halo: bool) -> DataFrame:
    """Weight of every cell so that each present group (stay or change, lit or not, halo) counts the same per sample."""
    change = F.col("tgt") != F.col("pad")
    out = cells.withColumn("grp", change.cast("int") * 2 + F.col("tgt").cast("int"))
    if halo:
        changed = out.filter(change).select(*sample, F.col("gr").alias("row"), F.col("gc").alias("col"))
        near = spread(changed, square(3)).filter(inside("row", "col", side)).select(
            *sample, F.col("row").alias("gr"), F.col("col").alias("gc")
        ).distinct().withColumn("_near", F.lit(True))
        out = out.join(near, [*sample, "gr", "gc"], "left").withColumn(
            "grp", F.when(F.col("_near") & ~change, F.lit(4)).otherwise(F.col("grp"))
        ).drop("_near")
    # group sizes as an aggregate: five rows per sample
    sizes = out.groupBy(*sample, "grp").agg(F.count("*").alias("_n"))
    present = F.count("*").over(Window.partitionBy(*sample))
    return out.join(sizes.withColumn("weight", 1 / (present * F.col("_n"))), [*sample, "grp"]).drop("_n")


def bucket_means(per_sample: DataFrame, dims: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Means over all samples and per value of each dimension, in one grouping-sets aggregate."""
    sets = [[], *[[F.col(d)] for d in dims]]
    aggs = [F.count("*").alias("n"), *[F.round(F.avg(v), 6).alias(v) for v in values]]
    out = per_sample.groupingSets(sets, *dims).agg(*aggs, F.grouping_id(*dims).alias("_g"))
    names = F.lit("all")
    label = F.lit("all")
    for i, d in enumerate(dims):
        full = (1 << len(dims)) - 1
        mask = full & ~(1 << (len(dims) - 1 - i))
        names = F.when(F.col("_g") == mask, F.lit(d)).otherwise(names)
        label = F.when(F.col("_g") == mask, F.col(d).cast("string")).otherwise(label)
    return out.select(names.alias("bucket"), label.alias("bucket_value"), "n", *values)


def label_agreement(stored: DataFrame, again: DataFrame, keys: Sequence[str], by: Sequence[str]) -> DataFrame:
    """Agreement and pooled overlap of ``stored`` and ``again``, masks of the same cells; cells only one side has are left out."""
    a, b = F.col("stored"), F.col("again")
    return stored.join(again.hint("merge"), list(keys)).groupBy(*by).agg(
        F.round(F.avg((a == b).cast("double")), 6).alias("agreement"), F.count("*").alias("cells"),
        F.round(F.count_if(a & b) / F.greatest(F.count_if(a | b), F.lit(1)), 6).alias("pooled_iou"),
    )


def composition(pixels: DataFrame, single: DataFrame, pairs: Mapping[str, tuple[tuple[str, int], tuple[str, int]]], s: int) -> DataFrame:
    """Overlap of a two-condition target with the AND of its single masks: the true ones (``ceiling``) and predicted ones.

    ``pixels`` holds the layers, ``single`` rows (crop_id, gr, gc, atom, hit) with ``layer_class`` as atom. All tasks
    share one pass over the pixels and one over the predictions. Windows without the target do not count, cells without a prediction are
    left out.
    """
    atoms = sorted({a for pair in pairs.values() for a in pair})
    holds = {a: F.col(a[0]) == a[1] for a in atoms}
    cell = ["crop_id", "gr", "gc"]
    name = lambda a: f"{a[0]}_{a[1]}"
    true = pixels.groupBy("crop_id", *cell_of("row", "col", s)).agg(
        *[majority(F.count_if(holds[a]), s).alias(f"m_{name(a)}") for a in atoms],
        *[majority(F.count_if(holds[a] & holds[b]), s).alias(f"t_{key}") for key, (a, b) in pairs.items()],
    )
    told = single.groupBy(*cell).agg(*[F.bool_or(F.col("hit") & (F.col("atom") == name(a))).alias(f"p_{name(a)}") for a in atoms])
    tasks = F.explode(F.array(*[
        F.struct(F.lit(key).alias("task_key"), F.col(f"`t_{key}`").alias("t"), (F.col(f"m_{name(a)}") & F.col(f"m_{name(b)}")).alias("m"),
                 (F.col(f"p_{name(a)}") & F.col(f"p_{name(b)}")).alias("p"))
        for key, (a, b) in pairs.items()
    ]))
    t, m, p = F.col("t"), F.col("m"), F.col("p")
    per = true.join(told, cell).select("crop_id", tasks.alias("x")).select("crop_id", "x.*").groupBy("crop_id", "task_key").agg(
        F.bool_or("t").alias("has"), ratio(F.count_if(m & t), F.count_if(m | t)).alias("c"), ratio(F.count_if(p & t), F.count_if(p | t)).alias("o")
    ).filter("has")
    return per.groupBy("task_key").agg(F.count("*").alias("n"), F.round(F.avg("c"), 6).alias("ceiling"), F.round(F.avg("o"), 6).alias("composed_iou"))
