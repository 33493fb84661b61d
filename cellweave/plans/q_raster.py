"""Label rasters, window cuts, targets and their statistics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from cellweave.functions.hashing import draw, draw_sql
from cellweave.operators import grids, ranking, targets
from cellweave.plans.fixtures import GRID, SIDE, TASK_ROWS, view
from cellweave.plans.registry import query

S = SIDE // GRID
TASKS = {
    key: [targets.Atom(la, ca)] + ([targets.Atom(lb, cb)] if lb else []) for key, la, ca, lb, cb in TASK_ROWS
}
HIT_SQL = {
    "surface_3": "surface = 3",
    "surface_2": "surface = 2",
    "noise7_0+surface_2": "noise7 = 0 AND surface = 2",
    "surface_3+estab_0": "surface = 3 AND estab = 0",
}
TARGETS_SQL = "tg AS (" + " UNION ALL ".join(
    f"SELECT crop_id, '{k}' AS task_key, CAST(row // 4 AS INT) AS gr, CAST(col // 4 AS INT) AS gc, "
    f"count(*) FILTER (WHERE {c}) AS n, count(*) FILTER (WHERE {c}) >= 8 AS fg FROM fx_raster GROUP BY 1, 2, 3, 4"
    for k, c in HIT_SQL.items()
) + ")"


def raster(spark, sf):
    return view(spark, sf, "fx_raster")


def task_targets(spark, sf):
    return targets.condition_targets(raster(spark, sf), TASKS, S)


# ------------------------------------------------------------------ pooling


@query("a05_pool_rules", """SELECT crop_id, CAST(row // 4 AS INT) AS gr, CAST(col // 4 AS INT) AS gc,
    count(*) FILTER (WHERE surface = 2) AS n, count(*) FILTER (WHERE surface = 2) > 0 AS "any",
    count(*) FILTER (WHERE surface = 2) >= 8 AS majority,
    bool_or(row % 4 = 2 AND col % 4 = 2 AND surface = 2) AS centre FROM fx_raster GROUP BY 1, 2, 3""")
def pool_rules(spark, sf):
    return grids.pool_mask(raster(spark, sf), ["crop_id"], S, F.col("surface") == 2)


@query("a05_pool_odd_block", """SELECT crop_id, CAST(row // 3 AS INT) AS gr, CAST(col // 3 AS INT) AS gc,
    count(*) FILTER (WHERE surface = 3) >= 5 AS majority FROM fx_raster GROUP BY 1, 2, 3""")
def pool_odd_block(spark, sf):
    """Blocks that the window's edge cuts stay, as the part that is there."""
    return grids.pool_mask(raster(spark, sf), ["crop_id"], 3, F.col("surface") == 3).select("crop_id", "gr", "gc", "majority")


@query("a06_pure_cells", """SELECT crop_id, CAST(row // 4 AS INT) AS gr, CAST(col // 4 AS INT) AS gc,
    min(surface) = max(surface) AS pure FROM fx_raster GROUP BY 1, 2, 3""")
def pure_cells(spark, sf):
    gr, gc = grids.cell_of("row", "col", S)
    return raster(spark, sf).groupBy("crop_id", gr, gc).agg((F.min("surface") == F.max("surface")).alias("pure"))


@query("a07_condition_targets", TARGETS_SQL + " SELECT * FROM tg")
def condition_targets(spark, sf):
    return task_targets(spark, sf)


@query("a10_block_min_max", """SELECT crop_id, CAST(row // 4 AS INT) AS gr, CAST(col // 4 AS INT) AS gc,
    min(CASE WHEN surface <> 3 THEN noise7 END) AS vmin, max(CASE WHEN surface <> 3 THEN noise7 END) AS vmax,
    count(*) FILTER (WHERE surface = 3) = 0 AS all_read, count(*) FILTER (WHERE surface = 3) = count(*) AS blocked
    FROM fx_raster GROUP BY 1, 2, 3""")
def block_min_max(spark, sf):
    px = raster(spark, sf).withColumn("reading", F.when(F.col("surface") != 3, F.col("noise7")))
    out = grids.block_stats(px, ["crop_id"], S, "reading")
    return out.withColumn("blocked", F.col("vmin").isNull())


@query("a11_class_shares", """SELECT crop_id, surface AS cls, count(*) AS n,
    round(count(*) / sum(count(*)) OVER (PARTITION BY crop_id), 6) AS share FROM fx_raster GROUP BY 1, 2""")
def class_shares(spark, sf):
    counts = raster(spark, sf).groupBy("crop_id", F.col("surface").alias("cls")).agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy("crop_id"))
    return counts.withColumn("share", F.round(F.col("n") / total, 6))


@query("a11_class_histogram", """SELECT p.plane, p.cls, count(*) AS n FROM fx_raster,
    LATERAL (SELECT unnest(['surface', 'noise7', 'estab']) AS plane, unnest([surface, noise7, estab]) AS cls) p
    GROUP BY 1, 2""")
def class_histogram(spark, sf):
    # joint counts first: the planes are unfolded from at most 4*7*4 rows per task, not from the pixels
    joint = raster(spark, sf).groupBy("surface", "noise7", "estab").agg(F.count("*").alias("c"))
    return (
        joint.select("c", F.expr("stack(3, 'surface', surface, 'noise7', noise7, 'estab', estab) AS (plane, cls)"))
        .groupBy("plane", "cls").agg(F.sum("c").alias("n"))
    )


# ------------------------------------------------------------------ joins on cells


@query("j08_align_planes", """a AS (SELECT crop_id, row, col, surface FROM fx_raster),
    b AS (SELECT crop_id, row, col, noise7 FROM fx_raster WHERE noise7 > 0)
    SELECT a.crop_id, a.surface, b.noise7, count(*) AS n FROM a JOIN b USING (crop_id, row, col) GROUP BY 1, 2, 3""")
def align_planes(spark, sf):
    r = raster(spark, sf)
    a, b = r.select("crop_id", "row", "col", "surface"), r.filter("noise7 > 0").select("crop_id", "row", "col", "noise7")
    return a.join(b, ["crop_id", "row", "col"]).groupBy("crop_id", "surface", "noise7").agg(F.count("*").alias("n"))


@query("j09_sample_at_points", """p AS (SELECT route_id, crop_id, sx + 20.3 AS x, sy - 4.2 AS y FROM fx_routes)
    SELECT p.route_id, r.surface AS value FROM p LEFT JOIN fx_raster r
    ON r.crop_id = p.crop_id AND r.row = floor(p.y) AND r.col = floor(p.x)""")
def sample_at_points(spark, sf):
    pts = view(spark, sf, "fx_routes").selectExpr(
        "route_id", "crop_id", "CAST(floor(sy - 4.2D) AS INT) AS row", "CAST(floor(sx + 20.3D) AS INT) AS col"
    )
    cells = raster(spark, sf).select("crop_id", "row", "col", F.col("surface").alias("value"))
    return pts.join(cells, ["crop_id", "row", "col"], "left").select("route_id", "value")


MOSAIC_SQL = """mosaic AS (SELECT crop_id // 16 AS district, CAST((crop_id % 16) // 4 * 32 + row AS INT) AS row,
    CAST(crop_id % 4 * 32 + col AS INT) AS col, surface FROM fx_raster),
    win AS (SELECT crop_id AS window_id, crop_id // 16 AS district,
      CAST((crop_id * 48271 + 13) % 65521 % 105 AS INT) AS dx, CAST((crop_id * 16807 + 19) % 65521 % 105 AS INT) AS dy
      FROM fx_markers)"""


def mosaic(spark, sf):
    return raster(spark, sf).selectExpr(
        "crop_id DIV 16 AS district", "CAST((crop_id % 16) DIV 4 * 32 + row AS INT) AS row",
        "CAST(crop_id % 4 * 32 + col AS INT) AS col", "surface",
    )


def windows(spark, sf):
    return view(spark, sf, "fx_markers").selectExpr(
        "crop_id AS window_id", "crop_id DIV 16 AS district",
        "CAST((crop_id * 48271 + 13) % 65521 % 105 AS INT) AS dx", "CAST((crop_id * 16807 + 19) % 65521 % 105 AS INT) AS dy",
    )


@query("j10_cut_windows", MOSAIC_SQL + """ SELECT w.window_id, m.surface, count(*) AS n,
    CAST(sum(m.row - w.dy) AS BIGINT) AS sum_row, CAST(sum(m.col - w.dx) AS BIGINT) AS sum_col
    FROM win w JOIN mosaic m ON m.district = w.district AND m.row >= w.dy AND m.row < w.dy + 24
    AND m.col >= w.dx AND m.col < w.dx + 24 GROUP BY 1, 2""")
def cut_windows(spark, sf):
    cut = grids.cut_windows(mosaic(spark, sf), windows(spark, sf), ["district"], 24, SIDE)
    return cut.groupBy("window_id", "surface").agg(
        F.count("*").alias("n"), F.sum("row").alias("sum_row"), F.sum("col").alias("sum_col")
    )


DISC_SQL = """disc AS (SELECT DISTINCT m.crop_id, r.row, r.col FROM fx_markers m JOIN fx_raster r ON r.crop_id = m.crop_id
    WHERE (r.row - m.mrow) * (r.row - m.mrow) + (r.col - m.mcol) * (r.col - m.mcol) <= 49
    UNION SELECT m.crop_id, r.row, r.col FROM fx_walks m JOIN fx_raster r ON r.crop_id = m.crop_id
    WHERE (r.row - m.grow) * (r.row - m.grow) + (r.col - m.gcol) * (r.col - m.gcol) <= 49)"""


def two_markers(spark, sf):
    a = view(spark, sf, "fx_markers")
    b = view(spark, sf, "fx_walks").selectExpr("crop_id", "grow AS mrow", "gcol AS mcol")
    return a.unionByName(b)


@query("j13_within_any_marker", DISC_SQL + " SELECT crop_id, row, col FROM disc")
def within_any_marker(spark, sf):
    return grids.within_any(two_markers(spark, sf), ["crop_id"], 7, SIDE)


@query("a08_marker_targets", DISC_SQL + """, px AS (SELECT r.crop_id, r.row, r.col, r.surface, d.row IS NOT NULL AS near
    FROM fx_raster r LEFT JOIN disc d USING (crop_id, row, col))
    SELECT crop_id, 'disc' AS task_key, CAST(row // 4 AS INT) AS gr, CAST(col // 4 AS INT) AS gc,
    count(*) FILTER (WHERE near) >= 8 AS fg FROM px GROUP BY 1, 2, 3, 4
    UNION ALL SELECT crop_id, 'disc+surface_2', CAST(row // 4 AS INT), CAST(col // 4 AS INT),
    count(*) FILTER (WHERE near AND surface = 2) >= 8 FROM px GROUP BY 1, 2, 3, 4
    UNION ALL SELECT crop_id, 'surface_2', CAST(row // 4 AS INT), CAST(col // 4 AS INT),
    count(*) FILTER (WHERE surface = 2) >= 8 FROM px GROUP BY 1, 2, 3, 4""")
def marker_targets(spark, sf):
    near = grids.within_any(two_markers(spark, sf), ["crop_id"], 7, SIDE).withColumn("near", F.lit(True))
    px = raster(spark, sf).select("crop_id", "row", "col", "surface").join(near, ["crop_id", "row", "col"], "left")
    disc, walk = F.coalesce("near", F.lit(False)), F.col("surface") == 2
    out = grids.pool_many(px, ["crop_id"], S, {"disc": disc, "disc+surface_2": disc & walk, "surface_2": walk}, "task_key")
    return out.drop("n")


# ------------------------------------------------------------------ rank rules

GROUND_SQL = "gnd AS (SELECT crop_id, row, col, noise7, count(*) OVER (PARTITION BY crop_id) AS n FROM fx_raster WHERE surface = 2)"
LEVELS_SQL = GROUND_SQL + """, lev AS (SELECT crop_id, max(n) AS n, CAST(quantile_disc(noise7, 0.5) AS INT) AS med,
    min(noise7) AS low, CAST(floor(avg(noise7)) AS INT) AS mean_floor, count(DISTINCT noise7) AS n_levels
    FROM gnd GROUP BY 1)"""


def ground(spark, sf):
    return raster(spark, sf).filter("surface = 2").select("crop_id", "row", "col", "noise7")


@query("w01_lowest_third", GROUND_SQL + """, rk AS (SELECT *, row_number() OVER (PARTITION BY crop_id
    ORDER BY noise7, row, col) AS rn FROM gnd)
    SELECT crop_id, row, col FROM rk WHERE n >= 50 AND rn <= greatest(1, n // 3)""")
def lowest_third(spark, sf):
    return targets.lowest_third(ground(spark, sf), "noise7").select("crop_id", "row", "col")


@query("w02_below_median", LEVELS_SQL + """ SELECT g.crop_id, g.row, g.col FROM gnd g JOIN lev USING (crop_id)
    WHERE lev.n >= 50 AND g.noise7 < lev.med""")
def below_median(spark, sf):
    return targets.below_median(ground(spark, sf), "noise7").select("crop_id", "row", "col")


@query("w12_balanced_points", f"""u AS (SELECT crop_id, d.j, {draw_sql('crop_id', 'd.j', salt=1)} AS u1,
      {draw_sql('crop_id', 'd.j', salt=2)} AS u2 FROM fx_markers, (SELECT unnest(range(3)) AS j) d),
    cls AS (SELECT crop_id, surface, count(*) AS n, row_number() OVER (PARTITION BY crop_id ORDER BY surface) - 1 AS ci,
      count(*) OVER (PARTITION BY crop_id) AS nc FROM fx_raster GROUP BY 1, 2),
    pick AS (SELECT u.crop_id, u.j, c.surface, CAST(floor(u2 * c.n) AS BIGINT) AS k FROM u JOIN cls c
      ON c.crop_id = u.crop_id AND c.ci = CAST(floor(u1 * c.nc) AS BIGINT)),
    px AS (SELECT *, row_number() OVER (PARTITION BY crop_id, surface ORDER BY row, col) - 1 AS k FROM fx_raster)
    SELECT p.crop_id, p.j, px.row, px.col, p.surface AS answer FROM pick p
    JOIN px ON px.crop_id = p.crop_id AND px.surface = p.surface AND px.k = p.k""")
def balanced_points(spark, sf):
    px = raster(spark, sf).select("crop_id", "row", "col", "surface")
    counts = px.groupBy("crop_id", "surface").agg(F.count("*").alias("n"))
    crop = Window.partitionBy("crop_id")
    classes = counts.select(
        "crop_id", "surface", "n", (F.row_number().over(crop.orderBy("surface")) - 1).alias("ci"),
        F.count("*").over(crop).alias("nc"),
    )
    draws = view(spark, sf, "fx_markers").select("crop_id", F.explode(F.expr("sequence(0L, 2L)")).alias("j"))
    seed = F.col("crop_id"), F.col("j")
    draws = draws.select("crop_id", "j", draw(*seed, salt=1).alias("u1"), draw(*seed, salt=2).alias("u2"))
    picks = (
        draws.join(classes, "crop_id")
        .filter(F.col("ci") == F.floor(F.col("u1") * F.col("nc")))
        .select("crop_id", "j", "surface", (F.floor(F.col("u2") * F.col("n")) + 1).alias("rn"))
    )
    ranked = ranking.tiered_rank(px, ["crop_id", "surface"], ["row", "col"])
    return picks.join(ranked, ["crop_id", "surface", "rn"]).select(
        "crop_id", "j", "row", "col", F.col("surface").alias("answer")
    )


# ------------------------------------------------------------------ statistics of targets

PER_SQL = TARGETS_SQL + """, per AS (SELECT task_key, crop_id, count(*) FILTER (WHERE fg) / count(*) AS share
    FROM tg GROUP BY 1, 2), st AS (SELECT task_key, avg(share) AS f, avg(CASE WHEN share = 0 THEN 1.0 ELSE 0.0 END) AS empty,
    quantile_cont(share, 0.1) AS p10, quantile_cont(share, 0.5) AS p50, quantile_cont(share, 0.9) AS p90
    FROM per GROUP BY 1)"""


def crop_shares(spark, sf):
    return task_targets(spark, sf).groupBy("task_key", "crop_id").agg((F.count_if("fg") / F.count("*")).alias("share"))


def task_stats(spark, sf):
    per = crop_shares(spark, sf)
    base = per.groupBy("task_key").agg(F.avg("share").alias("f"), F.avg((F.col("share") == 0).cast("double")).alias("empty"))
    return base.join(ranking.exact_percentiles(per, ["task_key"], "share", [0.1, 0.5, 0.9]), "task_key")


@query("a22_task_stats", PER_SQL + """ SELECT task_key, round(f, 6) AS f, round(empty, 6) AS empty_share,
    round(p10, 6) AS p10, round(p50, 6) AS p50, round(p90, 6) AS p90 FROM st""")
def a22(spark, sf):
    return task_stats(spark, sf).select(
        "task_key", F.round("f", 6).alias("f"), F.round("empty", 6).alias("empty_share"),
        *[F.round(p, 6).alias(p) for p in ("p10", "p50", "p90")],
    )


ATOMS_OF = {k: [a.key for a in v] for k, v in TASKS.items()}


@query("a23_usable_tasks", PER_SQL + """, atoms AS (SELECT 'noise7_0+surface_2' AS task_key, 'surface_2' AS atom
      UNION ALL SELECT 'surface_3+estab_0', 'surface_3'),
    part AS (SELECT a.task_key, min(s.f) AS minf FROM atoms a JOIN st s ON s.task_key = a.atom GROUP BY 1)
    SELECT st.task_key, st.f >= 0.003 AND st.empty <= 0.5 AND coalesce(minf > 0 AND st.f / minf <= 0.9, TRUE) AS usable
    FROM st LEFT JOIN part USING (task_key)""")
def usable_tasks(spark, sf):
    stats = task_stats(spark, sf)
    # the atoms of a two-atom condition that have statistics of their own
    pairs = [(k, a) for k, atoms in ATOMS_OF.items() if len(atoms) == 2 for a in atoms if a in TASKS]
    dim = F.broadcast(spark.createDataFrame(pairs, "task_key string, atom string"))  # one row per known condition
    part = (
        stats.select(F.col("task_key").alias("atom"), F.col("f").alias("fa")).join(dim, "atom")
        .groupBy("task_key").agg(F.min("fa").alias("minf"))
    )
    own = F.coalesce((F.col("minf") > 0) & (F.col("f") / F.col("minf") <= 0.9), F.lit(True))
    return stats.join(part, "task_key", "left").select(
        "task_key", ((F.col("f") >= 0.003) & (F.col("empty") <= 0.5) & own).alias("usable")
    )


@query("a24_class_weights", PER_SQL + """ SELECT task_key, round(least(greatest((1 - f) / greatest(f, 1e-9), 1.0), 20.0), 6) AS w_clamped,
    round(sqrt((1 - f) / greatest(f, 1e-9)), 6) AS w, round(sqrt((1 - f) / greatest(f, 1e-9))
      / (1 + sqrt((1 - f) / greatest(f, 1e-9))), 6) AS cut_off FROM st""")
def class_weights(spark, sf):
    f = F.col("f")
    odds = (1 - f) / F.greatest(f, F.lit(1e-9))
    w = F.pow(odds, 0.5)
    return task_stats(spark, sf).select(
        "task_key", F.round(F.least(F.greatest(odds, F.lit(1.0)), F.lit(20.0)), 6).alias("w_clamped"),
        F.round(w, 6).alias("w"), F.round(w / (1 + w), 6).alias("cut_off"),
    )


RULES_SQL = LEVELS_SQL + """, rk AS (SELECT *, row_number() OVER (PARTITION BY crop_id ORDER BY noise7, row, col) AS rn FROM gnd),
    pix AS (SELECT k.crop_id, k.row, k.col, k.noise7, k.n, k.noise7 < v.med AS r0, k.noise7 <= v.med AS r1,
      k.rn <= greatest(1, k.n // 3) AS r2, k.noise7 < v.mean_floor AS r3, k.noise7 = v.low AS r4
      FROM rk k JOIN lev v USING (crop_id) WHERE k.n >= 50)"""
RULE_NAMES = ["below_median", "up_to_median", "lowest_third", "below_mean", "lowest_level"]


def rule_pixels(spark, sf):
    """Ground pixels of the usable crops with one boolean column per relative rule."""
    g = ground(spark, sf)
    levels = targets.relative_levels(g, "noise7").filter(F.col("n") >= targets.MIN_PIXELS)
    ranked = ranking.tiered_rank(g, ["crop_id"], ["noise7", "row", "col"], "_rank").join(levels.hint("merge"), "crop_id")
    v = F.col("noise7")
    return ranked.withColumns({
        "below_median": v < F.col("med"), "up_to_median": v <= F.col("med"),
        "lowest_third": F.col("_rank") <= F.greatest(F.lit(1), F.floor(F.col("n") / 3)),
        "below_mean": v < F.col("mean_floor"), "lowest_level": v == F.col("low"),
    })


def _cell_union_sql() -> str:
    return ", cell AS (" + " UNION ALL ".join(
        f"SELECT '{name}' AS rule, crop_id, CAST(row // 4 AS INT) AS gr, CAST(col // 4 AS INT) AS gc,"
        f" count(*) FILTER (WHERE r{i}) AS n, count(*) FILTER (WHERE noise7 < 1) AS t1, count(*) FILTER (WHERE noise7 < 2) AS t2,"
        " count(*) FILTER (WHERE noise7 < 3) AS t3, count(*) FILTER (WHERE noise7 < 4) AS t4,"
        " count(*) FILTER (WHERE noise7 < 5) AS t5, count(*) FILTER (WHERE noise7 < 6) AS t6, count(*) FILTER (WHERE noise7 < 7) AS t7"
        " FROM pix GROUP BY 1, 2, 3, 4" for i, name in enumerate(RULE_NAMES)
    ) + ")"


@query("a44_relative_rule_sweep", RULES_SQL + ", sh AS (" + " UNION ALL ".join(
    f"SELECT '{n}' AS rule, crop_id, count(*) FILTER (WHERE r{i}) / count(*) AS share FROM pix GROUP BY 1, 2"
    for i, n in enumerate(RULE_NAMES)) + ")" + _cell_union_sql() + """,
    sh2 AS (SELECT rule, count(*) FILTER (WHERE share > 0) AS n_used, quantile_cont(share, 0.1) FILTER (WHERE share > 0) AS p10,
      quantile_cont(share, 0.5) FILTER (WHERE share > 0) AS p50, quantile_cont(share, 0.9) FILTER (WHERE share > 0) AS p90
      FROM sh GROUP BY 1),
    iou AS (SELECT c.rule, c.crop_id, t.t, CASE WHEN count(*) FILTER (WHERE c.n >= 8 OR t.m >= 8) > 0 THEN
      count(*) FILTER (WHERE c.n >= 8 AND t.m >= 8) / count(*) FILTER (WHERE c.n >= 8 OR t.m >= 8) ELSE 1.0 END AS iou
      FROM cell c JOIN sh s ON s.rule = c.rule AND s.crop_id = c.crop_id AND s.share > 0,
      LATERAL (SELECT unnest([1, 2, 3, 4, 5, 6, 7]) AS t, unnest([t1, t2, t3, t4, t5, t6, t7]) AS m) t GROUP BY 1, 2, 3),
    thr AS (SELECT rule, t, avg(iou) AS m FROM iou GROUP BY 1, 2), best AS (SELECT rule, max(m) AS ceil FROM thr GROUP BY 1)
    SELECT sh2.rule, n_used, round(1 - n_used / (SELECT count(*) FROM fx_markers), 6) AS empty_share,
      round(p10, 6) AS p10, round(p50, 6) AS p50, round(p90, 6) AS p90, round(ceil, 6) AS best_fixed
    FROM sh2 JOIN best USING (rule)""")
def relative_rule_sweep(spark, sf):
    """Five relative rules against the best single absolute threshold, at cell level."""
    px = rule_pixels(spark, sf)
    gr, gc = grids.cell_of("row", "col", S)
    counters = [F.count_if(F.col(r)).alias(f"_n{i}") for i, r in enumerate(RULE_NAMES)]
    under = [F.count_if(F.col("noise7") < t).alias(f"_t{t}") for t in range(1, 8)]
    cells = px.groupBy("crop_id", gr, gc).agg(F.count("*").alias("_c"), *counters, *under)
    rule_rows = F.array(*[
        F.struct(F.lit(n).alias("rule"), F.col(f"_n{i}").alias("n")) for i, n in enumerate(RULE_NAMES)
    ])
    by_rule = cells.withColumn("_r", F.explode(rule_rows)).select("*", "_r.rule", "_r.n")
    # per crop and rule: share of the ground, and for each threshold the overlap counters of the cells
    lit = F.col("n") >= 8
    per = by_rule.groupBy("rule", "crop_id").agg(
        (F.sum("n") / F.sum("_c")).alias("share"),
        *[F.count_if(lit & (F.col(f"_t{t}") >= 8)).alias(f"_i{t}") for t in range(1, 8)],
        *[F.count_if(lit | (F.col(f"_t{t}") >= 8)).alias(f"_u{t}") for t in range(1, 8)],
    ).filter("share > 0")
    means = per.groupBy("rule").agg(F.count("*").alias("n_used"), F.greatest(*[
        F.avg(F.when(F.col(f"_u{t}") > 0, F.col(f"_i{t}") / F.col(f"_u{t}")).otherwise(1.0)) for t in range(1, 8)
    ]).alias("best"))
    spread = ranking.exact_percentiles(per, ["rule"], "share", [0.1, 0.5, 0.9])
    total = view(spark, sf, "fx_markers").agg(F.count("*").alias("n_crops")).scalar()
    return means.join(spread, "rule").select(
        "rule", "n_used", F.round(1 - F.col("n_used") / total, 6).alias("empty_share"),
        *[F.round(p, 6).alias(p) for p in ("p10", "p50", "p90")], F.round("best", 6).alias("best_fixed"),
    )


def _compare_rule_sql() -> str:
    parts = []
    for c in range(4):
        parts.append(
            f"SELECT {c} AS cls, crop_id, CAST(row // 4 AS INT) AS gr, CAST(col // 4 AS INT) AS gc,"
            f" count(*) FILTER (WHERE surface = {c}) AS n, bool_or(row % 4 = 2 AND col % 4 = 2 AND surface = {c}) AS ctr"
            " FROM fx_raster GROUP BY 1, 2, 3, 4"
        )
    return "cc AS (" + " UNION ALL ".join(parts) + ")"


@query("a47_pool_rule_shares", _compare_rule_sql() + """, e AS (SELECT cls, crop_id, max(n) = 0 AS empty FROM cc GROUP BY 1, 2),
    es AS (SELECT cls, avg(CASE WHEN empty THEN 1.0 ELSE 0.0 END) AS empty_share FROM e GROUP BY 1)
    SELECT cls, round(sum(n) / (16 * count(*)), 6) AS px, round(avg(CASE WHEN n > 0 THEN 1.0 ELSE 0.0 END), 6) AS any_share,
    round(avg(CASE WHEN n >= 8 THEN 1.0 ELSE 0.0 END), 6) AS majority_share,
    round(avg(CASE WHEN ctr THEN 1.0 ELSE 0.0 END), 6) AS centre_share, round(max(empty_share), 6) AS empty_share,
    round(avg(CASE WHEN n > 0 AND n < 16 THEN 1.0 ELSE 0.0 END), 6) AS mixed_share FROM cc JOIN es USING (cls) GROUP BY cls""")
def pool_rule_shares(spark, sf):
    gr, gc = grids.cell_of("row", "col", S)
    centre = (F.col("row") % S == S // 2) & (F.col("col") % S == S // 2)
    cells = raster(spark, sf).groupBy("crop_id", gr, gc).agg(
        *[F.count_if(F.col("surface") == c).alias(f"_n{c}") for c in range(4)],
        F.max(F.when(centre, F.col("surface"))).alias("_ctr"),
    )
    rows = F.array(*[
        F.struct(F.lit(c).alias("cls"), F.col(f"_n{c}").alias("n"), (F.col("_ctr") == c).alias("ctr")) for c in range(4)
    ])
    per_crop = cells.select("crop_id", F.explode(rows).alias("_t")).select("crop_id", "_t.*").groupBy("cls", "crop_id").agg(
        F.count("*").alias("k"), F.sum("n").alias("n"), F.count_if(F.col("n") > 0).alias("a"),
        F.count_if(F.col("n") >= 8).alias("m"), F.count_if("ctr").alias("c"),
        F.count_if((F.col("n") > 0) & (F.col("n") < S * S)).alias("x"),
    )
    k = F.sum("k")
    return per_crop.groupBy("cls").agg(
        F.round(F.sum("n") / (S * S * k), 6).alias("px"), F.round(F.sum("a") / k, 6).alias("any_share"),
        F.round(F.sum("m") / k, 6).alias("majority_share"), F.round(F.sum("c") / k, 6).alias("centre_share"),
        F.round(F.avg((F.col("n") == 0).cast("double")), 6).alias("empty_share"), F.round(F.sum("x") / k, 6).alias("mixed_share"),
    )


@query("a46_radius_usability", """rad AS (SELECT unnest([4, 8, 12]) AS radius),
    cell AS (SELECT rad.radius, r.crop_id, r.row // 4 AS gr, r.col // 4 AS gc,
      count(*) FILTER (WHERE (r.row - m.mrow) * (r.row - m.mrow) + (r.col - m.mcol) * (r.col - m.mcol) <= radius * radius) AS d,
      count(*) FILTER (WHERE surface = 2 AND (r.row - m.mrow) * (r.row - m.mrow) + (r.col - m.mcol) * (r.col - m.mcol)
        <= radius * radius) AS s
      FROM fx_raster r JOIN fx_markers m USING (crop_id), rad GROUP BY ALL),
    per AS (SELECT radius, crop_id, count(*) FILTER (WHERE d >= 8) / 64 AS disc, count(*) FILTER (WHERE s >= 8) / 64 AS pos
      FROM cell GROUP BY ALL)
    SELECT radius, round(avg(disc), 6) AS disc_share, round(avg(CASE WHEN pos > 0 THEN 1.0 ELSE 0.0 END), 6) AS non_empty,
    round(avg(pos), 6) AS positive_share FROM per GROUP BY 1""")
def radius_usability(spark, sf):
    radii = (4, 8, 12)
    px = raster(spark, sf).select("crop_id", "row", "col", "surface").join(view(spark, sf, "fx_markers"), "crop_id")
    d2 = F.pow(F.col("row") - F.col("mrow"), 2) + F.pow(F.col("col") - F.col("mcol"), 2)
    gr, gc = grids.cell_of("row", "col", S)
    counters = []
    for r in radii:
        counters += [F.count_if(d2 <= r * r).alias(f"_d{r}"), F.count_if((d2 <= r * r) & (F.col("surface") == 2)).alias(f"_s{r}")]
    cells = px.groupBy("crop_id", gr, gc).agg(*counters)
    rows = F.array(*[
        F.struct(F.lit(r).alias("radius"), (F.col(f"_d{r}") >= 8).alias("d"), (F.col(f"_s{r}") >= 8).alias("s")) for r in radii
    ])
    per = cells.select("crop_id", F.explode(rows).alias("_t")).groupBy("crop_id", F.col("_t.radius").alias("radius")).agg(
        (F.count_if("_t.d") / GRID**2).alias("disc"), (F.count_if("_t.s") / GRID**2).alias("pos")
    )
    return per.groupBy("radius").agg(
        F.round(F.avg("disc"), 6).alias("disc_share"), F.round(F.avg((F.col("pos") > 0).cast("double")), 6).alias("non_empty"),
        F.round(F.avg("pos"), 6).alias("positive_share"),
    )


@query("a54_rule_relativity", LEVELS_SQL + """, low AS (SELECT crop_id, count(*) AS c FROM gnd JOIN lev USING (crop_id)
      WHERE noise7 = low GROUP BY 1),
    crop AS (SELECT lev.crop_id, lev.n_levels, lev.low, lev.med, low.c / lev.n AS s1 FROM lev JOIN low USING (crop_id)
      WHERE lev.n >= 50)
    SELECT count(*) AS crops, round(avg(CASE WHEN n_levels = 1 THEN 1.0 ELSE 0.0 END), 6) AS one_level,
    round(avg(CASE WHEN s1 > 0.8 THEN 1.0 ELSE 0.0 END), 6) AS nearly_one,
    round(quantile_cont(s1, 0.1), 6) AS p10, round(quantile_cont(s1, 0.5), 6) AS p50, round(quantile_cont(s1, 0.9), 6) AS p90,
    count(DISTINCT low) AS n_low, count(DISTINCT med) AS n_med, round(avg(n_levels), 6) AS mean_levels FROM crop""")
def rule_relativity(spark, sf):
    crops = targets.relative_levels(ground(spark, sf), "noise7").filter(F.col("n") >= targets.MIN_PIXELS).withColumn(
        "s1", F.col("n_low") / F.col("n")
    ).withColumn("all", F.lit(1))
    spread = ranking.exact_percentiles(crops, ["all"], "s1", [0.1, 0.5, 0.9])
    return crops.groupBy("all").agg(
        F.count("*").alias("crops"), F.round(F.avg((F.col("n_levels") == 1).cast("double")), 6).alias("one_level"),
        F.round(F.avg((F.col("s1") > 0.8).cast("double")), 6).alias("nearly_one"),
        F.countDistinct("low").alias("n_low"), F.countDistinct("med").alias("n_med"),
        F.round(F.avg("n_levels"), 6).alias("mean_levels"),
    ).join(spread.select("all", *[F.round(p, 6).alias(p) for p in ("p10", "p50", "p90")]), "all", "left").drop("all")


@query("a54_level_shares", LEVELS_SQL + """, u AS (SELECT lev.n AS n, unnest(['low', 'med']) AS which, unnest([low, med]) AS level
    FROM lev WHERE lev.n >= 50) SELECT which, level, count(*) AS crops,
    round(count(*) / sum(count(*)) OVER (PARTITION BY which), 6) AS share FROM u GROUP BY 1, 2""")
def level_shares(spark, sf):
    crops = targets.relative_levels(ground(spark, sf), "noise7").filter(F.col("n") >= targets.MIN_PIXELS)
    long = crops.select(F.expr("stack(2, 'low', low, 'med', med) AS (which, level)"))
    counts = long.groupBy("which", "level").agg(F.count("*").alias("crops"))
    total = F.sum("crops").over(Window.partitionBy("which"))
    return counts.withColumn("share", F.round(F.col("crops") / total, 6))


@query("a54_best_fixed_rule", LEVELS_SQL + """, px AS (SELECT g.crop_id, g.noise7, g.noise7 < lev.med AS tgt FROM gnd g
      JOIN lev USING (crop_id) WHERE lev.n >= 50),
    iou AS (SELECT t.t, crop_id, count(*) FILTER (WHERE tgt AND noise7 < t.t) / count(*) FILTER (WHERE tgt OR noise7 < t.t) AS iou
      FROM px, (SELECT unnest([1, 2, 3, 4, 5, 6]) AS t) t GROUP BY 1, 2 HAVING count(*) FILTER (WHERE tgt) > 0)
    SELECT t AS threshold, round(avg(iou), 6) AS mean_iou, count(*) AS crops FROM iou GROUP BY 1""")
def best_fixed_rule(spark, sf):
    g = ground(spark, sf)
    levels = targets.relative_levels(g, "noise7").filter(F.col("n") >= targets.MIN_PIXELS).select("crop_id", "med")
    # level counts carry everything: seven rows per crop instead of its pixels
    counts = g.groupBy("crop_id", "noise7").agg(F.count("*").alias("c")).join(levels, "crop_id")
    v, c = F.col("noise7"), F.col("c")
    per = counts.withColumn("threshold", F.explode(F.array(*[F.lit(t) for t in range(1, 7)]))).groupBy("crop_id", "threshold").agg(
        F.sum(F.when((v < F.col("med")) & (v < F.col("threshold")), c).otherwise(0)).alias("i"),
        F.sum(F.when((v < F.col("med")) | (v < F.col("threshold")), c).otherwise(0)).alias("u"),
        F.sum(F.when(v < F.col("med"), c).otherwise(0)).alias("t"),
    ).filter("t > 0")
    return per.groupBy("threshold").agg(F.round(F.avg(F.col("i") / F.col("u")), 6).alias("mean_iou"), F.count("*").alias("crops"))


@query("a50_point_report", f"""u AS (SELECT crop_id, d.j, {draw_sql('crop_id', 'd.j', salt=1)} AS u1 FROM fx_markers,
      (SELECT unnest(range(3)) AS j) d),
    it AS (SELECT CASE crop_id % 5 WHEN 0 THEN 'val' WHEN 1 THEN 'test' ELSE 'train' END AS split,
      CAST(floor(u1 * 4) AS INT) AS cls, CAST(floor(u1 * 4000) AS INT) % 4 AS coarse, floor(u1 * 100000) % 97 AS dist FROM u)
    SELECT split, cls, count(*) AS items, count(*) FILTER (WHERE cls <> coarse) AS disagree,
    round(quantile_cont(dist, 0.1), 6) AS p10, round(quantile_cont(dist, 0.5), 6) AS p50, round(quantile_cont(dist, 0.9), 6) AS p90
    FROM it GROUP BY 1, 2""")
def point_report(spark, sf):
    draws = view(spark, sf, "fx_markers").select("crop_id", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("j"))
    items = draws.withColumn("u1", draw(F.col("crop_id"), F.col("j"), salt=1)).selectExpr(
        "CASE crop_id % 5 WHEN 0 THEN 'val' WHEN 1 THEN 'test' ELSE 'train' END AS split",
        "CAST(floor(u1 * 4) AS INT) AS cls", "CAST(floor(u1 * 4000) AS INT) % 4 AS coarse",
        "CAST(floor(u1 * 100000) % 97 AS DOUBLE) AS dist",
    )
    counts = items.groupBy("split", "cls").agg(F.count("*").alias("items"), F.count_if(F.col("cls") != F.col("coarse")).alias("disagree"))
    spread = ranking.exact_percentiles(items, ["split", "cls"], "dist", [0.1, 0.5, 0.9])
    return counts.join(spread, ["split", "cls"]).select(
        "split", "cls", "items", "disagree", *[F.round(p, 6).alias(p) for p in ("p10", "p50", "p90")]
    )


@query("f04_task_registry", TARGETS_SQL + """ SELECT t.task_key, t.layer_a, t.class_a, t.layer_b, t.class_b, count(*) FILTER (WHERE tg.fg) AS positive FROM fx_tasks t JOIN tg USING (task_key) GROUP BY 1, 2, 3, 4, 5""")
def task_registry(spark, sf):
    """The task dimension as a table, with what it yields on the rasters."""
    from cellweave.plans.fixtures import tasks

    positive = task_targets(spark, sf).groupBy("task_key").agg(F.count_if("fg").alias("positive"))
    return tasks(spark).join(positive, "task_key")
