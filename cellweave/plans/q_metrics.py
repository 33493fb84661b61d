"""Scores of predicted cells."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from cellweave.operators import metrics as mt
from cellweave.operators import ranking
from cellweave.plans import fixtures as fx
from cellweave.plans.q_raster import TARGETS_SQL, TASKS, raster, task_targets
from cellweave.plans.registry import query
from cellweave.session import numbered

COUNT_SQL = """count(*) FILTER (WHERE p AND t) AS inter, count(*) FILTER (WHERE p OR t) AS uni, count(*) FILTER (WHERE p) AS n_pred,
    count(*) FILTER (WHERE t) AS n_tgt"""
SCORED_SQL = TARGETS_SQL + """, sc AS (SELECT crop_id, task_key, gr, gc, tg.n, tg.fg AS t, pct > 50 AS p, pct FROM tg
    JOIN fx_pred USING (crop_id, task_key, gr, gc))"""
MARK_PER_SQL = f"""per AS (SELECT sample_id, task_id, {COUNT_SQL} FROM (SELECT *, pred AS p, tgt AS t FROM fx_marks) GROUP BY 1, 2)"""
IOU_SQL = "CASE WHEN uni > 0 THEN inter / uni ELSE 1.0 END"


def scored(spark, sf):
    """Condition targets joined with the predicted cells."""
    return task_targets(spark, sf).join(fx.view(spark, sf, "fx_pred").hint("merge"), ["crop_id", "task_key", "gr", "gc"])


@query("a25_overlap_by_task", SCORED_SQL + f""", per AS (SELECT crop_id, task_key, {COUNT_SQL},
      count(*) FILTER (WHERE p AND t AND n IN (0, 16)) AS ip, count(*) FILTER (WHERE (p OR t) AND n IN (0, 16)) AS up,
      count(*) FILTER (WHERE p AND t AND n NOT IN (0, 16)) AS im, count(*) FILTER (WHERE (p OR t) AND n NOT IN (0, 16)) AS um
      FROM sc GROUP BY 1, 2)
    SELECT task_key, count(*) AS samples, count(*) FILTER (WHERE n_tgt > 0) AS non_empty,
    round(avg({IOU_SQL}) FILTER (WHERE n_tgt > 0), 6) AS iou,
    round(avg(CASE WHEN n_pred > 0 THEN inter / n_pred ELSE 1.0 END) FILTER (WHERE n_tgt > 0), 6) AS precision,
    round(avg(CASE WHEN n_tgt > 0 THEN inter / n_tgt ELSE 1.0 END) FILTER (WHERE n_tgt > 0), 6) AS recall,
    round(coalesce(avg(CASE WHEN n_pred > 0 THEN 1.0 ELSE 0.0 END) FILTER (WHERE n_tgt = 0), 0.0), 6) AS empty_false_rate,
    round(avg(ip / up) FILTER (WHERE up > 0), 6) AS iou_pure, round(avg(im / um) FILTER (WHERE um > 0), 6) AS iou_mixed
    FROM per GROUP BY 1""")
def overlap_by_task(spark, sf):
    pure = F.col("n").isin(0, 16)
    counts = mt.overlap_counts(scored(spark, sf), ["crop_id", "task_key"], F.col("pct") > 50, F.col("fg"), pure)
    return mt.overlap_report(counts, ["task_key"])


@query("a25_overlap_all_samples", MARK_PER_SQL + f""" SELECT task_id, count(*) AS samples, count(*) FILTER (WHERE n_tgt > 0) AS non_empty,
    round(avg({IOU_SQL}), 6) AS iou, round(avg(CASE WHEN n_pred > 0 THEN inter / n_pred ELSE 1.0 END), 6) AS precision,
    round(avg(CASE WHEN n_tgt > 0 THEN inter / n_tgt ELSE 1.0 END), 6) AS recall,
    round(coalesce(avg(CASE WHEN n_pred > 0 THEN 1.0 ELSE 0.0 END) FILTER (WHERE n_tgt = 0), 0.0), 6) AS empty_false_rate FROM per GROUP BY 1""")
def overlap_all_samples(spark, sf):
    counts = mt.overlap_counts(fx.marks(spark, sf), ["sample_id", "task_id"], F.col("pred"), F.col("tgt"))
    return mt.overlap_report(counts, ["task_id"], skip_empty=False)


@query("a26_localisation", """c AS (SELECT sample_id, task_id, gr, gc, score, gr * 8 + gc AS ix, score > 0.2 AS p,
      CAST((sample_id * 48271 + 5) % 64 AS BIGINT) AS tc FROM fx_grid),
    s AS (SELECT sample_id, task_id, tc, arg_max(ix, (score, -ix)) AS am, count(*) FILTER (WHERE p) AS n,
      bool_or(p AND ix = tc) AS hit, count(*) FILTER (WHERE p AND (gr // 2) = (tc // 8) // 2 AND (gc // 2) = (tc % 8) // 2) AS np FROM c GROUP BY 1, 2, 3),
    d AS (SELECT *, (am // 8) // 2 = (tc // 8) // 2 AND (am % 8) // 2 = (tc % 8) // 2 AS ph,
      sqrt((am // 8 - tc // 8) * (am // 8 - tc // 8) + (am % 8 - tc % 8) * (am % 8 - tc % 8)) AS dist FROM s)
    SELECT task_id, count(*) AS n, round(avg(CASE WHEN n = 1 AND hit THEN 1.0 ELSE 0.0 END), 6) AS exact,
    round(avg(CASE WHEN hit THEN 1.0 ELSE 0.0 END), 6) AS true_cell_recall, round(avg(CASE WHEN am = tc THEN 1.0 ELSE 0.0 END), 6) AS argmax_hit,
    round(avg(CASE WHEN ph THEN 1.0 ELSE 0.0 END), 6) AS patch_hit,
    round(coalesce(count(*) FILTER (WHERE ph AND am = tc) / nullif(count(*) FILTER (WHERE ph), 0), 0.0), 6) AS sub_cell_given_patch,
    round(avg(np / n) FILTER (WHERE n > 0), 6) AS in_patch_share, round(avg(dist), 6) AS mean_dist,
    round(quantile_cont(dist, 0.5), 6) AS median_dist FROM d GROUP BY 1""")
def localisation(spark, sf):
    cells = fx.grid(spark, sf).withColumn("tc", (F.col("sample_id") * 48271 + 5) % 64)
    per = mt.localisation(cells, ["sample_id", "task_id"], "score", F.col("score") > 0.2, "tc", 8, 2)

    def share(c, name):
        return F.round(F.avg(F.col(c).cast("double")), 6).alias(name)

    both = F.count_if(F.col("patch_hit") & F.col("argmax_hit"))
    base = per.groupBy("task_id").agg(
        F.count("*").alias("n"), share("exact", "exact"), share("true_cell_hit", "true_cell_recall"), share("argmax_hit", "argmax_hit"),
        share("patch_hit", "patch_hit"), F.round(mt.ratio(both, F.count_if("patch_hit"), 0.0), 6).alias("sub_cell_given_patch"),
        share("in_patch_share", "in_patch_share"), share("dist", "mean_dist"),
    )
    median = ranking.exact_percentiles(per, ["task_id"], "dist", [0.5])
    return base.join(median, "task_id").withColumn("median_dist", F.round("p50", 6)).drop("p50")


SWEEP_SQL = """sw AS (SELECT task_id, th.t, avg(CASE WHEN uni > 0 THEN inter / uni ELSE 1.0 END) AS iou FROM
    (SELECT sample_id, task_id, th.t, count(*) FILTER (WHERE score > th.t AND tgt) AS inter, count(*) FILTER (WHERE score > th.t OR tgt) AS uni
      FROM fx_marks, (SELECT unnest([0.0, 0.05, 0.1, 0.15, 0.2]::DOUBLE[]) AS t) th GROUP BY 1, 2, 3 HAVING count(*) FILTER (WHERE tgt) > 0) x,
    (SELECT 1) one, LATERAL (SELECT x.t) th GROUP BY 1, 2)"""
THRESHOLDS = [0.0, 0.05, 0.1, 0.15, 0.2]


@query("a27_threshold_sweep", SWEEP_SQL + " SELECT task_id, t AS threshold, round(iou, 6) AS iou FROM sw")
def threshold_sweep(spark, sf):
    sweep = mt.threshold_sweep(fx.marks(spark, sf), ["sample_id"], ["task_id"], "score", "tgt", THRESHOLDS)
    return sweep.withColumn("iou", F.round("iou", 6))


@query("a27_best_threshold", SWEEP_SQL + """ SELECT task_id, arg_max(t, (round(iou, 9), -t)) AS best_threshold, round(max(iou), 6) AS best_iou
    FROM sw GROUP BY 1""")
def best_threshold(spark, sf):
    sweep = mt.threshold_sweep(fx.marks(spark, sf), ["sample_id"], ["task_id"], "score", "tgt", THRESHOLDS)
    return mt.best_threshold(sweep, ["task_id"]).withColumn("best_iou", F.round("best_iou", 6))


@query("a27_pooled_precision_recall", """SELECT task_id, th.t AS threshold, round(count(*) FILTER (WHERE score > th.t AND tgt)
      / greatest(count(*) FILTER (WHERE score > th.t), 1), 6) AS precision,
    round(count(*) FILTER (WHERE score > th.t AND tgt) / greatest(count(*) FILTER (WHERE tgt), 1), 6) AS recall
    FROM fx_marks, (SELECT unnest([0.0, 0.05, 0.1, 0.15, 0.2]::DOUBLE[]) AS t) th GROUP BY 1, 2""")
def pooled_precision_recall(spark, sf):
    aggs = [F.count_if("tgt").alias("n")]
    for i, t in enumerate(THRESHOLDS):
        aggs += [F.count_if((F.col("score") > t) & F.col("tgt")).alias(f"h{i}"), F.count_if(F.col("score") > t).alias(f"p{i}")]
    per = fx.marks(spark, sf).groupBy("task_id").agg(*aggs)
    rows = F.array(*[
        F.struct(
            F.lit(t).alias("threshold"), F.round(F.col(f"h{i}") / F.greatest(F.col(f"p{i}"), F.lit(1)), 6).alias("precision"),
            F.round(F.col(f"h{i}") / F.greatest(F.col("n"), F.lit(1)), 6).alias("recall"),
        ) for i, t in enumerate(THRESHOLDS)
    ])
    return per.select("task_id", F.explode(rows).alias("r")).select("task_id", "r.*")


PAIR_SQL = " UNION ALL ".join(
    f"SELECT crop_id, '{key}' AS task_key, CAST(row // 4 AS INT) AS gr, CAST(col // 4 AS INT) AS gc, count(*) FILTER (WHERE {x}) >= 8 AS ma, "
    f"count(*) FILTER (WHERE {y}) >= 8 AS mb FROM fx_raster GROUP BY 1, 2, 3, 4"
    for key, x, y in (("noise7_0+surface_2", "noise7 = 0", "surface = 2"), ("surface_3+estab_0", "surface = 3", "estab = 0"))
)


@query("a28_error_attribution", TARGETS_SQL + f""", a AS ({PAIR_SQL}),
    w AS (SELECT ma, mb FROM tg JOIN fx_pred p USING (crop_id, task_key, gr, gc) JOIN a USING (crop_id, task_key, gr, gc) WHERE (pct > 50) <> fg)
    SELECT count(*) AS wrong, round(count(*) FILTER (WHERE NOT ma AND mb) / greatest(count(*), 1), 6) AS only_a,
    round(count(*) FILTER (WHERE ma AND NOT mb) / greatest(count(*), 1), 6) AS only_b,
    round(count(*) FILTER (WHERE NOT ma AND NOT mb) / greatest(count(*), 1), 6) AS both,
    round(count(*) FILTER (WHERE ma AND mb) / greatest(count(*), 1), 6) AS neither FROM w""")
def error_attribution(spark, sf):
    """Which atom of a two-atom condition a wrong cell fails, over all such tasks."""
    from cellweave.operators.grids import cell_of, majority

    pairs = {key: [atom.hit() for atom in atoms] for key, atoms in TASKS.items() if len(atoms) == 2}
    # targets and atoms of all tasks are pooled in one pass over the pixels
    pooled = raster(spark, sf).groupBy("crop_id", *cell_of("row", "col", 4)).agg(
        *[majority(F.count_if(c), 4).alias(f"{n}{i}") for i, (a, b) in enumerate(pairs.values()) for n, c in (("fg", a & b), ("ma", a), ("mb", b))]
    )
    by_task = F.array(*[
        F.struct(F.lit(key).alias("task_key"), *[F.col(f"{n}{i}").alias(n) for n in ("fg", "ma", "mb")]) for i, key in enumerate(pairs)
    ])
    cells = pooled.select("crop_id", "gr", "gc", F.explode(by_task).alias("t")).select("crop_id", "gr", "gc", "t.*")
    wrong = cells.join(fx.view(spark, sf, "fx_pred").hint("merge"), ["crop_id", "task_key", "gr", "gc"]).filter((F.col("pct") > 50) != F.col("fg"))
    ma, mb, n = F.col("ma"), F.col("mb"), F.greatest(F.count("*"), F.lit(1))
    return wrong.agg(
        F.count("*").alias("wrong"), F.round(F.count_if(~ma & mb) / n, 6).alias("only_a"), F.round(F.count_if(ma & ~mb) / n, 6).alias("only_b"),
        F.round(F.count_if(~ma & ~mb) / n, 6).alias("both"), F.round(F.count_if(ma & mb) / n, 6).alias("neither"),
    )


@query("a29_wrong_description_gap", """c AS (SELECT crop_id, CAST(row // 4 AS INT) AS gr, CAST(col // 4 AS INT) AS gc,
      count(*) FILTER (WHERE surface = 2) >= 8 AS right_t, count(*) FILTER (WHERE surface = 3) >= 8 AS wrong_t FROM fx_raster GROUP BY 1, 2, 3),
    s AS (SELECT crop_id, bool_or(right_t) AS has, count(*) FILTER (WHERE pct > 50 AND right_t) AS i1, count(*) FILTER (WHERE pct > 50 OR right_t) AS u1,
      count(*) FILTER (WHERE pct > 50 AND wrong_t) AS i2, count(*) FILTER (WHERE pct > 50 OR wrong_t) AS u2
      FROM c JOIN fx_pred USING (crop_id, gr, gc) WHERE task_key = 'surface_2' GROUP BY 1)
    SELECT round(avg(i1 / u1), 6) AS right_iou, round(avg(i2 / u2), 6) AS wrong_iou, round(avg(i1 / u1) - avg(i2 / u2), 6) AS gap FROM s WHERE has""")
def wrong_description_gap(spark, sf):
    from cellweave.operators.grids import cell_of, majority
    from cellweave.operators.targets import Atom, next_class

    right = Atom("surface", 2)
    wrong = next_class(right)
    cells = raster(spark, sf).groupBy("crop_id", *cell_of("row", "col", 4)).agg(
        majority(F.count_if(right.hit()), 4).alias("r"), majority(F.count_if(wrong.hit()), 4).alias("w")
    )
    pred = fx.view(spark, sf, "fx_pred").filter(F.col("task_key") == right.key).withColumn("p", F.col("pct") > 50)
    p, r, w = F.col("p"), F.col("r"), F.col("w")
    per = cells.join(pred.hint("merge"), ["crop_id", "gr", "gc"]).groupBy("crop_id").agg(
        F.bool_or("r").alias("has"), mt.ratio(F.count_if(p & r), F.count_if(p | r)).alias("a"),
        mt.ratio(F.count_if(p & w), F.count_if(p | w)).alias("b"),
    ).filter("has")
    return per.agg(
        F.round(F.avg("a"), 6).alias("right_iou"), F.round(F.avg("b"), 6).alias("wrong_iou"),
        F.round(F.avg("a") - F.avg("b"), 6).alias("gap"),
    )


# every task with the wrong description of each of its atoms: (task, slot, right condition, wrong condition)
GAPS = [
    ("surface_3", 0, "surface = 3", "surface = 0"), ("surface_2", 0, "surface = 2", "surface = 3"),
    ("noise7_0+surface_2", 0, "noise7 = 0 AND surface = 2", "noise7 = 1 AND surface = 2"), ("noise7_0+surface_2", 1, "noise7 = 0 AND surface = 2", "noise7 = 0 AND surface = 3"),
    ("surface_3+estab_0", 0, "surface = 3 AND estab = 0", "surface = 0 AND estab = 0"), ("surface_3+estab_0", 1, "surface = 3 AND estab = 0", "surface = 3 AND estab = 1"),
]
GAP_SQL = "cnt AS MATERIALIZED (SELECT crop_id, CAST(row // 4 AS INT) AS gr, CAST(col // 4 AS INT) AS gc, " + ", ".join(
    f"count(*) FILTER (WHERE {r}) >= 8 AS r{i}, count(*) FILTER (WHERE {w}) >= 8 AS w{i}" for i, (_, _, r, w) in enumerate(GAPS)
) + " FROM fx_raster GROUP BY 1, 2, 3), all_ AS (" + " UNION ALL ".join(
    f"SELECT '{t}' AS task_key, {slot} AS slot, crop_id, gr, gc, r{i} AS r, w{i} AS w FROM cnt" for i, (t, slot, _, _) in enumerate(GAPS)
) + """), s AS (SELECT task_key, slot, crop_id, bool_or(r) AS has, count(*) FILTER (WHERE pct > 50 AND r) AS i1, count(*) FILTER (WHERE pct > 50 OR r) AS u1,
      count(*) FILTER (WHERE pct > 50 AND w) AS i2, count(*) FILTER (WHERE pct > 50 OR w) AS u2 FROM all_ JOIN fx_pred USING (task_key, crop_id, gr, gc) GROUP BY 1, 2, 3),
    g AS (SELECT task_key, slot, i1 / u1 AS a, CASE WHEN u2 > 0 THEN i2 / u2 END AS b FROM s WHERE has)
    SELECT task_key, CAST(slot AS INT) AS slot, count(*) AS n, round(avg(a), 6) AS right_iou, round(avg(b), 6) AS wrong_iou, round(avg(a) - avg(b), 6) AS gap FROM g GROUP BY 1, 2"""


@query("a29_gap_by_task", GAP_SQL)
def gap_by_task(spark, sf):
    """The gap of every task, conjunctions with either atom described wrongly: all conditions are counters of one pass."""
    from cellweave.operators.grids import pool_many
    from cellweave.operators.targets import Atom, next_class, task_hit

    hits = {}
    for key, *_ in fx.TASK_ROWS:
        atoms = [Atom(a.rsplit("_", 1)[0], int(a.rsplit("_", 1)[1])) for a in key.split("+")]
        hits[f"{key}|right"] = task_hit(atoms)
        for slot, atom in enumerate(atoms):
            flipped = [next_class(a, 7 if a.layer == "noise7" else 4) if a is atom else a for a in atoms]
            hits[f"{key}|{slot}"] = task_hit(flipped)
    cells = pool_many(raster(spark, sf), ["crop_id"], 4, hits, "condition").select(
        "crop_id", "gr", "gc", F.split_part("condition", F.lit("|"), F.lit(1)).alias("task_key"), F.split_part("condition", F.lit("|"), F.lit(2)).alias("which"), "fg")
    # right and wrong targets of a cell meet in one row each, per slot
    at = ["crop_id", "gr", "gc", "task_key"]
    pairs = cells.groupBy(*at).agg(F.max(F.when(F.col("which") == "right", F.col("fg"))).alias("r"), *[F.max(F.when(F.col("which") == str(s), F.col("fg"))).alias(f"w{s}") for s in (0, 1)])
    slots = F.filter(F.array(*[F.struct(F.lit(s).alias("slot"), F.col(f"w{s}").alias("w")) for s in (0, 1)]), lambda x: x["w"].isNotNull())
    flat = pairs.select(*at, "r", F.explode(slots).alias("v")).select(*at, "r", "v.slot", "v.w")
    pred = fx.view(spark, sf, "fx_pred").select(*at, (F.col("pct") > 50).alias("p"))
    p, r, w = F.col("p"), F.col("r"), F.col("w")
    per = flat.join(pred.hint("merge"), at).groupBy("task_key", "slot", "crop_id").agg(
        F.bool_or("r").alias("has"), F.try_divide(F.count_if(p & r), F.count_if(p | r)).alias("a"), F.try_divide(F.count_if(p & w), F.count_if(p | w)).alias("b")).filter("has")
    return per.groupBy("task_key", "slot").agg(
        F.count("*").alias("n"), F.round(F.avg("a"), 6).alias("right_iou"), F.round(F.avg("b"), 6).alias("wrong_iou"), F.round(F.avg("a") - F.avg("b"), 6).alias("gap"))


@query("a30_held_out_means", MARK_PER_SQL + f""", t AS (SELECT task_id, avg({IOU_SQL}) FILTER (WHERE n_tgt > 0) AS iou FROM per GROUP BY 1)
    SELECT task_id IN (3, 7) AS held_out, count(*) AS tasks, round(avg(iou), 6) AS mean_iou FROM t GROUP BY 1""")
def held_out_means(spark, sf):
    counts = mt.overlap_counts(fx.marks(spark, sf), ["sample_id", "task_id"], F.col("pred"), F.col("tgt"))
    iou = mt.ratio(F.col("inter"), F.col("uni"))
    per = counts.groupBy("task_id").agg(F.avg(F.when(F.col("n_tgt") > 0, iou)).alias("iou"))
    return per.groupBy(F.col("task_id").isin(3, 7).alias("held_out")).agg(
        F.count("*").alias("tasks"), F.round(F.avg("iou"), 6).alias("mean_iou")
    )


TOL_SQL = """c AS (SELECT sample_id, task_id, gr, gc, score > 0.2 AS p, tgt AND (gr + gc) % 3 = 0 AS t FROM fx_marks),
    w AS (SELECT a.sample_id, a.task_id, a.gr, a.gc, bool_or(b.p) AS pd, bool_or(b.t) AS td, any_value(a.p) AS p, any_value(a.t) AS t
      FROM c a JOIN c b ON a.sample_id = b.sample_id AND a.task_id = b.task_id AND abs(a.gr - b.gr) <= 1 AND abs(a.gc - b.gc) <= 1 GROUP BY 1, 2, 3, 4),
    k AS (SELECT sample_id, task_id, count(*) FILTER (WHERE pd AND td) AS id, count(*) FILTER (WHERE pd OR td) AS ud,
      count(*) FILTER (WHERE p AND td) AS pn, count(*) FILTER (WHERE p) AS np, count(*) FILTER (WHERE t AND pd) AS tn,
      count(*) FILTER (WHERE t) AS nt FROM w GROUP BY 1, 2)"""


@query("a31_tolerant_line_scores", TOL_SQL + """ SELECT task_id, count(*) AS n, round(avg(id / ud), 6) AS iou_wide,
    round(avg(CASE WHEN np > 0 THEN pn / np ELSE 0.0 END), 6) AS precision_near, round(avg(CASE WHEN nt > 0 THEN tn / nt ELSE 1.0 END), 6) AS recall_near,
    round(avg(0.5 * (pn + tn) / (np + nt - 0.5 * (pn + tn))), 6) AS iou_matched FROM k WHERE ud > 0 GROUP BY 1""")
def tolerant_line_scores(spark, sf):
    cells = fx.marks(spark, sf).select(
        "sample_id", "task_id", "gr", "gc", (F.col("score") > 0.2).alias("pred"), (F.col("tgt") & ((F.col("gr") + F.col("gc")) % 3 == 0)).alias("tgt")
    )
    per = mt.tolerant_scores(mt.tolerant_counts(cells, ["sample_id", "task_id"], 8, 1))
    names = ["iou_wide", "precision_near", "recall_near", "iou_matched"]
    return per.groupBy("task_id").agg(F.count("*").alias("n"), *[F.round(F.avg(c), 6).alias(c) for c in names])


@query("a33_bucket_means", MARK_PER_SQL + f""", s AS (SELECT *, {IOU_SQL} AS iou, CASE WHEN n_pred > 0 THEN inter / n_pred ELSE 1.0 END AS prec,
      CAST(sample_id % 3 AS INT) AS stratum, CAST(least(greatest(floor(n_tgt / 10), 0), 36) AS INT) AS len_bin FROM per)
    SELECT 'all' AS bucket, 'all' AS bucket_value, count(*) AS n, round(avg(iou), 6) AS iou, round(avg(prec), 6) AS prec FROM s
    UNION ALL SELECT 'task_id', CAST(task_id AS VARCHAR), count(*), round(avg(iou), 6), round(avg(prec), 6) FROM s GROUP BY task_id
    UNION ALL SELECT 'stratum', CAST(stratum AS VARCHAR), count(*), round(avg(iou), 6), round(avg(prec), 6) FROM s GROUP BY stratum
    UNION ALL SELECT 'len_bin', CAST(len_bin AS VARCHAR), count(*), round(avg(iou), 6), round(avg(prec), 6) FROM s GROUP BY len_bin""")
def bucket_means(spark, sf):
    from cellweave.functions.bins import length_bin

    counts = mt.overlap_counts(fx.marks(spark, sf), ["sample_id", "task_id"], F.col("pred"), F.col("tgt"))
    per = counts.select(
        "task_id", (F.col("sample_id") % 3).cast("int").alias("stratum"), length_bin(F.col("n_tgt")).alias("len_bin"),
        mt.ratio(F.col("inter"), F.col("uni")).alias("iou"), mt.ratio(F.col("inter"), F.col("n_pred")).alias("prec"),
    )
    return mt.bucket_means(per, ["task_id", "stratum", "len_bin"], ["iou", "prec"])


def pads(spark, sf):
    return fx.marks(spark, sf).withColumn("pad", (F.col("sample_id") * 64 + F.col("gr") * 8 + F.col("gc")) * 16807 % 65521 % 3 == 0)


PAD_SQL = "pd AS (SELECT *, ((sample_id * 64 + gr * 8 + gc) * 16807) % 65521 % 3 = 0 AS pad FROM fx_marks)"


@query("a34_copied_and_new_recall", PAD_SQL + """, k AS (SELECT sample_id, task_id, r.rule, count(*) FILTER (WHERE tgt AND pad) AS nc,
      count(*) FILTER (WHERE tgt AND pad AND score > r.tau) AS hc, count(*) FILTER (WHERE tgt AND NOT pad) AS nn,
      count(*) FILTER (WHERE tgt AND NOT pad AND score > r.tau) AS hn, count(*) FILTER (WHERE NOT tgt) AS ne,
      count(*) FILTER (WHERE NOT tgt AND score > r.tau) AS he FROM pd, (SELECT unnest(['plain', 'rule']) AS rule,
      unnest([0.05, 0.12]::DOUBLE[]) AS tau) r GROUP BY 1, 2, 3)
    SELECT task_id, rule, count(*) AS n, round(avg(CASE WHEN nc > 0 THEN hc / nc ELSE 1.0 END), 6) AS copied_recall,
    round(avg(CASE WHEN nn > 0 THEN hn / nn ELSE 1.0 END), 6) AS new_recall, round(avg(CASE WHEN ne > 0 THEN he / ne ELSE 0.0 END), 6) AS false_marks
    FROM k GROUP BY 1, 2""")
def copied_and_new_recall(spark, sf):
    rules = {"plain": F.col("score") > 0.05, "rule": F.col("score") > 0.12}
    per = mt.copy_new_counts(pads(spark, sf), ["sample_id", "task_id"], rules)
    return per.groupBy("task_id", "rule").agg(
        F.count("*").alias("n"), *[F.round(F.avg(c), 6).alias(c) for c in ("copied_recall", "new_recall", "false_marks")]
    )


@query("a35_token_scores", """SELECT task_id, count(*) AS n, round(avg(CASE WHEN e = 0 THEN 1.0 ELSE 0.0 END), 6) AS accuracy,
    round(avg(CASE WHEN e <= 1 THEN 1.0 ELSE 0.0 END), 6) AS within_one, round(avg(e) * 10, 6) AS mean_abs_m
    FROM (SELECT task_id, abs(n_pred // 10 - n_tgt // 10) AS e FROM (SELECT sample_id, task_id, count(*) FILTER (WHERE pred) AS n_pred,
    count(*) FILTER (WHERE tgt) AS n_tgt FROM fx_marks GROUP BY 1, 2)) GROUP BY 1""")
def token_scores(spark, sf):
    per = fx.marks(spark, sf).groupBy("sample_id", "task_id").agg(F.count_if("pred").alias("p"), F.count_if("tgt").alias("t"))
    e = F.abs(F.floor(F.col("p") / 10) - F.floor(F.col("t") / 10))
    return per.withColumn("e", e).groupBy("task_id").agg(
        F.count("*").alias("n"), F.round(F.avg((F.col("e") == 0).cast("double")), 6).alias("accuracy"),
        F.round(F.avg((F.col("e") <= 1).cast("double")), 6).alias("within_one"), F.round(F.avg("e") * 10, 6).alias("mean_abs_m"),
    )


@query("a43_shortcut_bands", """c AS (SELECT task_key, pct > 50 AS p, sqrt((gr - mrow / 4.0) * (gr - mrow / 4.0) + (gc - mcol / 4.0) * (gc - mcol / 4.0)) * 4 AS d
      FROM fx_pred JOIN fx_markers USING (crop_id)),
    b AS (SELECT unnest([0, 5, 10, 15, 20]) AS lo, unnest([5, 10, 15, 20, 100]) AS hi)
    SELECT task_key, lo AS band_from, hi AS band_to, count(*) AS cells, round(avg(CASE WHEN p THEN 1.0 ELSE 0.0 END), 6) AS marked
    FROM c JOIN b ON d >= lo AND d < hi GROUP BY 1, 2, 3""")
def shortcut_bands(spark, sf):
    from cellweave.functions.bins import band_of

    edges = [0, 5, 10, 15, 20, 100]
    dr, dc = F.col("gr") - F.col("mrow") / 4.0, F.col("gc") - F.col("mcol") / 4.0
    cells = fx.view(spark, sf, "fx_pred").join(fx.view(spark, sf, "fx_markers"), "crop_id").withColumn(
        "d", F.sqrt(dr * dr + dc * dc) * 4
    )
    banded = cells.withColumn("b", band_of(F.col("d"), edges)).filter("b IS NOT NULL")
    lows, highs = F.array(*[F.lit(e) for e in edges[:-1]]), F.array(*[F.lit(e) for e in edges[1:]])
    return banded.groupBy("task_key", "b").agg(
        F.count("*").alias("cells"), F.round(F.avg((F.col("pct") > 50).cast("double")), 6).alias("marked")
    ).select("task_key", F.element_at(lows, F.col("b") + 1).alias("band_from"), F.element_at(highs, F.col("b") + 1).alias("band_to"), "cells", "marked")


@query("a45_composition_ceiling", """tk AS (SELECT * FROM fx_tasks WHERE layer_b IS NOT NULL),
    px AS (SELECT t.task_key, r.crop_id, CAST(row // 4 AS INT) AS gr, CAST(col // 4 AS INT) AS gc,
      CASE layer_a WHEN 'surface' THEN surface ELSE noise7 END = class_a AS a, CASE layer_b WHEN 'surface' THEN surface ELSE estab END = class_b AS b FROM fx_raster r, tk t),
    c AS (SELECT task_key, crop_id, gr, gc, count(*) FILTER (WHERE a) >= 8 AS a, count(*) FILTER (WHERE b) >= 8 AS b, count(*) FILTER (WHERE a AND b) >= 8 AS t FROM px GROUP BY 1, 2, 3, 4),
    q AS (SELECT c.*, x.pct > 50 AND y.pct > 50 AS p FROM c JOIN tk USING (task_key)
      JOIN fx_atom_pred x ON x.crop_id = c.crop_id AND x.gr = c.gr AND x.gc = c.gc AND x.atom = layer_a || '_' || class_a
      JOIN fx_atom_pred y ON y.crop_id = c.crop_id AND y.gr = c.gr AND y.gc = c.gc AND y.atom = layer_b || '_' || class_b),
    s AS (SELECT task_key, crop_id, bool_or(t) AS has, count(*) FILTER (WHERE a AND b AND t) AS ci, count(*) FILTER (WHERE (a AND b) OR t) AS cu,
      count(*) FILTER (WHERE p AND t) AS pi, count(*) FILTER (WHERE p OR t) AS pu FROM q GROUP BY 1, 2)
    SELECT task_key, count(*) AS n, round(avg(CASE WHEN cu > 0 THEN ci / cu ELSE 1.0 END), 6) AS ceiling,
    round(avg(CASE WHEN pu > 0 THEN pi / pu ELSE 1.0 END), 6) AS composed_iou FROM s WHERE has GROUP BY 1""")
def composition_ceiling(spark, sf):
    """Every task of two conditions against the AND of its two single masks, true and predicted."""
    pairs = {key: ((la, ca), (lb, cb)) for key, la, ca, lb, cb in fx.TASK_ROWS if lb is not None}
    return mt.composition(raster(spark, sf), fx.view(spark, sf, "fx_atom_pred").withColumn("hit", F.col("pct") > 50), pairs, 4)


@query("a48_equal_group_weights", PAD_SQL + """, ch AS (SELECT sample_id, gr, gc FROM pd WHERE tgt <> pad AND score > 0.1),
    g AS (SELECT sample_id, task_id, gr, gc, CAST(CASE WHEN tgt <> pad THEN 2 ELSE 0 END + CASE WHEN tgt THEN 1 ELSE 0 END AS INT) AS grp FROM pd),
    z AS (SELECT *, count(*) OVER (PARTITION BY sample_id, grp) AS n FROM g),
    q AS (SELECT sample_id, count(DISTINCT grp) AS k FROM g GROUP BY 1)
    SELECT task_id, grp, round(sum(1.0 / (k * n)), 6) AS weight, count(*) AS cells FROM z JOIN q USING (sample_id) GROUP BY 1, 2""")
def equal_group_weights(spark, sf):
    w = mt.equal_group_weights(pads(spark, sf), ["sample_id"], 8, halo=False)
    return w.groupBy("task_id", "grp").agg(F.round(F.sum("weight"), 6).alias("weight"), F.count("*").alias("cells"))


@query("a48_equal_group_weights_halo", PAD_SQL.replace("% 3 = 0", "% 20 = 0") + """, c2 AS (SELECT sample_id, task_id, gr, gc, pad, score > 0.22 AS t FROM pd),
    ch AS (SELECT sample_id, gr, gc FROM c2 WHERE t <> pad),
    g AS (SELECT c2.*, CAST(CASE WHEN t <> pad THEN CASE WHEN t THEN 3 ELSE 2 END WHEN EXISTS (SELECT 1 FROM ch WHERE ch.sample_id = c2.sample_id
      AND abs(ch.gr - c2.gr) <= 1 AND abs(ch.gc - c2.gc) <= 1) THEN 4 WHEN t THEN 1 ELSE 0 END AS INT) AS grp FROM c2),
    z AS (SELECT *, count(*) OVER (PARTITION BY sample_id, grp) AS n FROM g), q AS (SELECT sample_id, count(DISTINCT grp) AS k FROM g GROUP BY 1)
    SELECT task_id, grp, round(sum(1.0 / (k * n)), 6) AS weight, count(*) AS cells FROM z JOIN q USING (sample_id) GROUP BY 1, 2""")
def equal_group_weights_halo(spark, sf):
    cells = fx.marks(spark, sf).select(
        "sample_id", "task_id", "gr", "gc", (F.col("score") > 0.22).alias("tgt"),
        ((F.col("sample_id") * 64 + F.col("gr") * 8 + F.col("gc")) * 16807 % 65521 % 20 == 0).alias("pad"),
    )
    w = mt.equal_group_weights(cells, ["sample_id"], 8, halo=True)
    return w.groupBy("task_id", "grp").agg(F.round(F.sum("weight"), 6).alias("weight"), F.count("*").alias("cells"))


@query("a49_rollout_summary", MARK_PER_SQL + f""" SELECT count(*) AS rows, round(avg({IOU_SQL}), 6) AS mean_iou,
    round(avg(CASE WHEN n_pred // 16 = n_tgt // 16 THEN 1.0 ELSE 0.0 END), 6) AS token_accuracy FROM per""")
def rollout_summary(spark, sf):
    counts = mt.overlap_counts(fx.marks(spark, sf), ["sample_id", "task_id"], F.col("pred"), F.col("tgt"))
    same = F.floor(F.col("n_pred") / 16) == F.floor(F.col("n_tgt") / 16)
    return counts.agg(
        F.count("*").alias("rows"), F.round(F.avg(mt.ratio(F.col("inter"), F.col("uni"))), 6).alias("mean_iou"),
        F.round(F.avg(same.cast("double")), 6).alias("token_accuracy"),
    )


@query("a51_label_agreement", TARGETS_SQL + """, z AS (SELECT tg.task_key, p.pct > 50 AS a, tg.fg AS b FROM fx_pred p JOIN tg USING (crop_id, task_key, gr, gc))
    SELECT task_key, round(avg(CASE WHEN a = b THEN 1.0 ELSE 0.0 END), 6) AS agreement, count(*) AS cells,
    round(count(*) FILTER (WHERE a AND b) / greatest(count(*) FILTER (WHERE a OR b), 1), 6) AS pooled_iou FROM z GROUP BY 1""")
def label_agreement(spark, sf):
    """Stored marks of every task against targets recomputed from the rasters."""
    stored = fx.view(spark, sf, "fx_pred").select("crop_id", "task_key", "gr", "gc", (F.col("pct") > 50).alias("stored"))
    again = task_targets(spark, sf).select("crop_id", "task_key", "gr", "gc", F.col("fg").alias("again"))
    return mt.label_agreement(stored, again, ["crop_id", "task_key", "gr", "gc"], ["task_key"])


@query("a55_label_coverage", """f AS (SELECT task_id, avg(CASE WHEN tgt THEN 1.0 ELSE 0.0 END) AS share FROM fx_marks GROUP BY 1),
    run AS (SELECT run_id, max(step) AS steps FROM fx_eval_rows GROUP BY 1)
    SELECT run.run_id, f.task_id, round(f.share * 32 * run.steps, 6) AS coverage FROM run JOIN f ON f.task_id = run.run_id % 10""")
def label_coverage(spark, sf):
    share = fx.marks(spark, sf).groupBy("task_id").agg(F.avg(F.col("tgt").cast("double")).alias("share"))
    runs = fx.view(spark, sf, "fx_eval_rows").groupBy("run_id").agg(F.max("step").alias("steps")).withColumn(
        "task_id", (F.col("run_id") % 10).cast("int")
    )
    return runs.join(share, "task_id").select("run_id", "task_id", F.round(F.col("share") * 32 * F.col("steps"), 6).alias("coverage"))


@query("p22_one_hot_planes", """SELECT crop_id, row, col, k AS plane, CAST(CASE WHEN surface = k THEN 1 ELSE 0 END AS INT) AS value
    FROM (SELECT *, CAST(unnest(range(4)) AS INT) AS k FROM fx_raster)""")
def one_hot_planes(spark, sf):
    return numbered(raster(spark, sf), "plane", 4).selectExpr(
        "crop_id", "row", "col", "CAST(plane AS INT) AS plane", "CAST(coalesce(surface = plane, false) AS INT) AS value")


@query("p32_cell_error_labels", """SELECT sample_id, task_id, gr, gc, CASE WHEN pred AND tgt THEN 'TP' WHEN pred THEN 'FP' WHEN tgt THEN 'FN' END AS label
    FROM fx_marks WHERE pred OR tgt""")
def cell_error_labels(spark, sf):
    p, t = F.col("pred"), F.col("tgt")
    label = F.when(p & t, "TP").when(p, "FP").when(t, "FN")
    return fx.marks(spark, sf).filter(p | t).select("sample_id", "task_id", "gr", "gc", label.alias("label"))


@query("p32_focal_cell", """SELECT sample_id, round(coalesce(avg(CASE WHEN tgt AND score > 0.2 THEN gr END), 3.5), 6) AS focal_row,
    round(coalesce(avg(CASE WHEN tgt AND score > 0.2 THEN gc END), 3.5), 6) AS focal_col FROM fx_marks GROUP BY 1""")
def focal_cell(spark, sf):
    t = F.col("tgt") & (F.col("score") > 0.2)
    return fx.marks(spark, sf).groupBy("sample_id").agg(
        F.round(F.coalesce(F.avg(F.when(t, F.col("gr"))), F.lit(3.5)), 6).alias("focal_row"),
        F.round(F.coalesce(F.avg(F.when(t, F.col("gc"))), F.lit(3.5)), 6).alias("focal_col"),
    )
