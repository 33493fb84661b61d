"""Route answers, polylines and their verdicts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from cellweave.functions import answers as an
from cellweave.functions import bins
from cellweave.operators import grids, ranking
from cellweave.operators import routes as rt
from cellweave.plans import fixtures as fx
from cellweave.plans.q_frontier import CHAIN8_SQL, cell_rule
from cellweave.plans.registry import query

SIDE = fx.SIDE
SEG_SQL = """seg AS (SELECT route_id, pos - 1 AS seg, lag(x) OVER w AS x1, lag(y) OVER w AS y1, x AS x2, y AS y2 FROM fx_route_points
      WINDOW w AS (PARTITION BY route_id ORDER BY pos)), sg AS (SELECT s.*, r.crop_id, sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)) AS len
      FROM seg s JOIN fx_routes r USING (route_id) WHERE x1 IS NOT NULL),
    smp AS (SELECT *, unnest(range(CAST(greatest(ceil(len / 0.5), 1) AS BIGINT) + 1)) AS i FROM sg),
    cel AS (SELECT *, CAST(floor(y1 + i / greatest(ceil(len / 0.5), 1) * (y2 - y1)) AS INT) AS row,
      CAST(floor(x1 + i / greatest(ceil(len / 0.5), 1) * (x2 - x1)) AS INT) AS col FROM smp),
    bld AS (SELECT crop_id, row, col FROM fx_raster WHERE surface = 3)"""
HIT_SQL = SEG_SQL + """, hit AS (SELECT a.route_id, a.seg, bool_or(b.row IS NOT NULL OR a.row < 0 OR a.row > 31 OR a.col < 0 OR a.col > 31) AS crosses
      FROM cel a LEFT JOIN bld b USING (crop_id, row, col) GROUP BY 1, 2)"""
VERDICT_SQL = HIT_SQL + """, e AS (SELECT route_id, count(*) AS n, arg_min(x, pos) AS ax, arg_min(y, pos) AS ay, arg_max(x, pos) AS bx, arg_max(y, pos) AS by_
      FROM fx_route_points GROUP BY 1),
    l AS (SELECT route_id, sum(len) AS length_m FROM sg GROUP BY 1), h AS (SELECT route_id, bool_or(crosses) AS crosses FROM hit GROUP BY 1),
    v AS (SELECT r.*, n, crosses, length_m, length_m / teacher_m AS ratio, sqrt((ax - sx) * (ax - sx) + (ay - sy) * (ay - sy)) AS start_err,
      sqrt((bx - gx) * (bx - gx) + (by_ - gy) * (by_ - gy)) AS goal_err FROM fx_routes r LEFT JOIN e USING (route_id) LEFT JOIN l USING (route_id) LEFT JOIN h USING (route_id)),
    vd AS (SELECT *, CASE WHEN n IS NULL OR n < 2 THEN 'unparseable' WHEN start_err > 6 OR goal_err > 6 THEN 'wrong endpoints'
      WHEN crosses THEN 'crosses a building' WHEN ratio > 1.1 THEN 'too long' END AS reason FROM v)"""
REPORT_SQL = """count(*) AS n, count(*) FILTER (WHERE reason IS NULL) AS solved, round(count(*) FILTER (WHERE reason IS NULL) / count(*), 4) AS solved_share,
    round(count(*) FILTER (WHERE reason IS NULL AND n_goal <= 3) / count(*) FILTER (WHERE n_goal <= 3), 4) AS solved_2_3,
    round(count(*) FILTER (WHERE reason IS NULL AND n_goal BETWEEN 4 AND 5) / count(*) FILTER (WHERE n_goal BETWEEN 4 AND 5), 4) AS solved_4_5,
    round(count(*) FILTER (WHERE reason IS NULL AND n_goal >= 6) / count(*) FILTER (WHERE n_goal >= 6), 4) AS solved_6_up,
    round(count(*) FILTER (WHERE reason = 'unparseable') / count(*), 4) AS fail_unparseable,
    round(count(*) FILTER (WHERE reason = 'wrong endpoints') / count(*), 4) AS fail_wrong_endpoints,
    round(count(*) FILTER (WHERE reason = 'crosses a building') / count(*), 4) AS fail_crosses_a_building,
    round(count(*) FILTER (WHERE reason = 'too long') / count(*), 4) AS fail_too_long,
    round(avg(round(ratio, 4)) FILTER (WHERE reason IS NULL), 4) AS mean_ratio_solved"""


def routes(spark, sf):
    return fx.view(spark, sf, "fx_routes")


def points(spark, sf):
    return fx.view(spark, sf, "fx_route_points")


def buildings(spark, sf):
    return fx.view(spark, sf, "fx_raster").filter("surface = 3").select("crop_id", "row", "col")


def verdicts(spark, sf):
    return rt.verdicts(routes(spark, sf), points(spark, sf), buildings(spark, sf), SIDE)


def straight(spark, sf):
    """Baseline: start and goal joined by one segment."""
    ends = F.array(F.struct(F.col("sx").alias("x"), F.col("sy").alias("y")), F.struct(F.col("gx").alias("x"), F.col("gy").alias("y")))
    return routes(spark, sf).select("route_id", F.posexplode(ends).alias("pos", "p")).select("route_id", "pos", "p.x", "p.y")


@query("j11_segments_hit_building", HIT_SQL + " SELECT route_id, seg, crosses FROM hit")
def segments_hit_building(spark, sf):
    segs = rt.segments(points(spark, sf), ["route_id"]).join(routes(spark, sf).select("route_id", "crop_id").hint("merge"), "route_id")
    return rt.crossing(segs, "crop_id", buildings(spark, sf), ["route_id", "seg"], SIDE)


@query("j12_line_of_sight", """t AS (SELECT r.route_id, r.crop_id, r.sx AS x1, r.sy AS y1, k.k AS target, CAST(4 + 8 * (k.k % 4) AS DOUBLE) + 0.5 AS x2,
      CAST(8 * (k.k // 4) AS DOUBLE) + 0.5 AS y2 FROM fx_routes r, (SELECT unnest(range(8)) AS k) k),
    n AS (SELECT *, greatest(ceil(sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)) / 0.5), 1) AS n FROM t),
    s AS (SELECT *, unnest(range(CAST(n AS BIGINT) + 1)) AS i FROM n),
    h AS (SELECT route_id, target FROM s JOIN fx_raster f ON f.crop_id = s.crop_id AND f.surface = 3 AND f.row = floor(y1 + i / n * (y2 - y1))
      AND f.col = floor(x1 + i / n * (x2 - x1)) UNION SELECT route_id, target FROM s WHERE floor(y1 + i / n * (y2 - y1)) NOT BETWEEN 0 AND 31
      OR floor(x1 + i / n * (x2 - x1)) NOT BETWEEN 0 AND 31)
    SELECT t.target, count(*) AS visible FROM t ANTI JOIN h USING (route_id, target) GROUP BY 1""")
def line_of_sight(spark, sf):
    targets = F.transform(F.sequence(F.lit(0).cast("bigint"), F.lit(7).cast("bigint")), lambda k: F.struct(
        k.alias("target"), (F.lit(4) + 8 * (k % 4) + 0.5).cast("double").alias("x2"), (8 * F.floor(k / 4) + 0.5).cast("double").alias("y2")))
    origins = routes(spark, sf).select("route_id", "crop_id", F.col("sx").alias("x1"), F.col("sy").alias("y1"))
    seen = rt.visible_rays(origins, "crop_id", buildings(spark, sf), targets, ["route_id", "target"], SIDE)
    return seen.groupBy("target").agg(F.count("*").alias("visible"))


@query("j14_routes_with_predictions", """SELECT r.route_id, coalesce(p.n, 0) AS n_points, p.n IS NULL AS unparseable FROM fx_routes r
    LEFT JOIN (SELECT route_id, count(*) AS n FROM fx_route_points GROUP BY 1) p USING (route_id)""")
def routes_with_predictions(spark, sf):
    n = points(spark, sf).groupBy("route_id").agg(F.count("*").alias("n"))
    return routes(spark, sf).select("route_id").join(n.hint("merge"), "route_id", "left").select(
        "route_id", F.coalesce("n", F.lit(0)).cast("bigint").alias("n_points"), F.col("n").isNull().alias("unparseable")
    )


@query("j15_alignment_audit", """d AS (SELECT o_orderkey AS route_id, (o_orderkey - o_orderkey % 150) / 150 + CASE WHEN o_orderkey % 97 = 0 THEN 1 ELSE 0 END AS crop_id,
      CAST((o_orderkey * 48271 + 41) % 65521 % 32 AS DOUBLE) + 0.5 + CASE WHEN o_orderkey % 89 = 0 THEN 0.01 ELSE 1e-9 END AS sx FROM orders WHERE o_orderkey % 11 <> 0)
    SELECT count(*) AS records, count(d.route_id) AS drawings, count(*) FILTER (WHERE d.route_id IS NULL) AS missing,
    count(*) FILTER (WHERE d.crop_id <> r.crop_id OR abs(d.sx - r.sx) > 1e-8 + 1e-5 * abs(r.sx)) AS misaligned
    FROM fx_routes r LEFT JOIN d USING (route_id)""")
def alignment_audit(spark, sf):
    drawings = fx.table(spark, sf, "orders").filter("o_orderkey % 11 <> 0").selectExpr(
        "o_orderkey AS route_id", "o_orderkey DIV 150 + IF(o_orderkey % 97 = 0, 1, 0) AS d_crop",
        "CAST((o_orderkey * 48271 + 41) % 65521 % 32 AS DOUBLE) + 0.5D + IF(o_orderkey % 89 = 0, 0.01D, 1e-9D) AS d_sx",
    )
    off = (F.col("d_crop") != F.col("crop_id")) | (F.abs(F.col("d_sx") - F.col("sx")) > 1e-8 + 1e-5 * F.abs("sx"))
    joined = routes(spark, sf).join(drawings.hint("merge"), "route_id", "left")
    return joined.agg(
        F.count("*").alias("records"), F.count("d_crop").alias("drawings"), F.count_if(F.col("d_crop").isNull()).alias("missing"),
        F.count_if(off).alias("misaligned"),
    )


@query("j19_rule_cross_table", VERDICT_SQL.replace("    cel AS", "    samples AS").replace("FROM cel ", "FROM samples ") + ", " + CHAIN8_SQL + """, cr AS (SELECT w.crop_id,
      coalesce(x.length_m / w.teacher_m <= 1.1 AND s.blocked = 0, FALSE) AS cell_rule FROM w8 w LEFT JOIN len x USING (crop_id) LEFT JOIN shr s USING (crop_id))
    SELECT cell_rule, reason IS NULL AS line_rule, count(*) AS n FROM vd JOIN cr USING (crop_id) GROUP BY 1, 2""")
def rule_cross_table(spark, sf):
    """Verdict of the cells of a window's drawing by verdict of every line in the window."""
    rule = cell_rule(spark, sf).select("crop_id", F.col("success").alias("cell_rule"))
    lines = verdicts(spark, sf).select("crop_id", F.col("solved").alias("line_rule"))
    return rt.rule_cross_table(rule, lines, ["crop_id"])


@query("w04_polyline_length", SEG_SQL + " SELECT route_id, count(*) AS segments, round(sum(len), 6) AS length_m FROM sg GROUP BY 1")
def polyline_length(spark, sf):
    return rt.segments(points(spark, sf), ["route_id"]).groupBy("route_id").agg(
        F.count("*").alias("segments"), F.round(F.sum(rt.seg_length()), 6).alias("length_m")
    )


@query("w07_first_visit_pixels", SEG_SQL + """, px AS (SELECT route_id, CAST(least(greatest(row, 0), 31) AS INT) AS row,
      CAST(least(greatest(col, 0), 31) AS INT) AS col, min(seg * 100000 + i) AS f FROM cel GROUP BY 1, 2, 3)
    SELECT route_id, row, col, row_number() OVER (PARTITION BY route_id ORDER BY f) AS ord FROM px""")
def first_visit_pixels(spark, sf):
    return rt.visited_pixels(rt.segments(points(spark, sf), ["route_id"]), ["route_id"], SIDE)


@query("a36_route_verdicts", VERDICT_SQL + """ SELECT route_id, coalesce(reason, 'solved') AS verdict, round(start_err, 3) AS start_err_m,
    round(goal_err, 3) AS goal_err_m, crosses, round(length_m, 3) AS length_m, round(ratio, 4) AS length_ratio FROM vd""")
def route_verdicts(spark, sf):
    return verdicts(spark, sf).select(
        "route_id", F.coalesce("reason", F.lit("solved")).alias("verdict"), bins.rounded(F.col("start_err"), 3).alias("start_err_m"),
        bins.rounded(F.col("goal_err"), 3).alias("goal_err_m"), "crosses", bins.rounded(F.col("length_m"), 3).alias("length_m"),
        bins.rounded(F.col("ratio"), 4).alias("length_ratio"),
    )


@query("a37_route_report", VERDICT_SQL + f" SELECT {REPORT_SQL} FROM vd")
def route_report(spark, sf):
    return rt.report(verdicts(spark, sf))


STRAIGHT_SQL = VERDICT_SQL + """, sl AS (SELECT route_id, crop_id, sqrt((gx - sx) * (gx - sx) + (gy - sy) * (gy - sy)) AS len, sx, sy, gx, gy FROM fx_routes),
    ss AS (SELECT *, unnest(range(CAST(greatest(ceil(len / 0.5), 1) AS BIGINT) + 1)) AS i FROM sl),
    sh AS (SELECT s.route_id, bool_or(b.row IS NOT NULL) AS crosses FROM ss s LEFT JOIN bld b ON b.crop_id = s.crop_id
      AND b.row = floor(sy + i / greatest(ceil(len / 0.5), 1) * (gy - sy)) AND b.col = floor(sx + i / greatest(ceil(len / 0.5), 1) * (gx - sx)) GROUP BY 1),
    sv AS (SELECT r.route_id, r.n_goal, sl.len / r.teacher_m AS ratio, CASE WHEN sh.crosses THEN 'crosses a building' WHEN sl.len / r.teacher_m > 1.1
      THEN 'too long' END AS reason FROM fx_routes r JOIN sl USING (route_id) JOIN sh USING (route_id))"""


def by_method(spark, sf):
    cols = ["route_id", "n_goal", "ratio", "reason", "solved"]
    bld = buildings(spark, sf)
    base = rt.verdicts(routes(spark, sf), straight(spark, sf), bld, SIDE).select(*cols).withColumn("method", F.lit("straight"))
    return verdicts(spark, sf).select(*cols).withColumn("method", F.lit("predicted")).unionByName(base)


@query("a56_method_comparison", STRAIGHT_SQL + f""" SELECT 'predicted' AS method, {REPORT_SQL} FROM vd UNION ALL SELECT 'straight', {REPORT_SQL} FROM sv""")
def method_comparison(spark, sf):
    return rt.report(by_method(spark, sf), ["method"])


@query("a56_paired_verdicts", STRAIGHT_SQL + """ SELECT CASE WHEN vd.reason IS NULL AND sv.reason IS NULL THEN 'both' WHEN vd.reason IS NULL THEN 'only predicted'
    WHEN sv.reason IS NULL THEN 'only straight' ELSE 'none' END AS verdict_group, count(*) AS n FROM vd JOIN sv USING (route_id) GROUP BY 1""")
def paired_verdicts(spark, sf):
    per = by_method(spark, sf).groupBy("route_id").agg(
        F.bool_or(F.col("solved") & (F.col("method") == "predicted")).alias("p"), F.bool_or(F.col("solved") & (F.col("method") == "straight")).alias("s")
    )
    group = F.when(F.col("p") & F.col("s"), "both").when(F.col("p"), "only predicted").when(F.col("s"), "only straight").otherwise("none")
    return per.groupBy(group.alias("verdict_group")).agg(F.count("*").alias("n"))


@query("a40_band_means", VERDICT_SQL + """, b AS (SELECT * FROM (VALUES ('n_goal 2-3', 2, 3), ('n_goal 4-5', 4, 5), ('n_goal 6+', 6, 1000000000), ('n_goal 6-8', 6, 8),
      ('n_goal 9+', 9, 1000000000), ('n_goal 9-12', 9, 12)) AS t(band, lo, hi))
    SELECT band, count(*) AS n, round(avg(CASE WHEN reason IS NULL THEN 1.0 ELSE 0.0 END), 6) AS solved, round(avg(ratio), 6) AS ratio,
    round(avg(CASE WHEN reason IS NULL AND stratum > 0 THEN 1.0 ELSE 0.0 END), 6) AS solved_and_finished FROM vd JOIN b ON n_goal BETWEEN lo AND hi GROUP BY 1""")
def band_means(spark, sf):
    # per number of fronts first, then the overlapping bands from those few rows
    v = verdicts(spark, sf)
    per = v.groupBy("n_goal").agg(
        F.count("*").alias("n"), F.count_if("solved").alias("s"), F.sum("ratio").alias("r"), F.count("ratio").alias("nr"),
        F.count_if(F.col("solved") & (F.col("stratum") > 0)).alias("f"),
    )
    bands = F.array(*[F.struct(F.lit(b).alias("band"), F.lit(lo).alias("lo"), F.lit(hi).alias("hi")) for b, lo, hi in bins.ROLLOUT_BANDS])
    hit = per.withColumn("b", F.explode(bands)).filter("n_goal >= b.lo AND n_goal <= b.hi").groupBy(F.col("b.band").alias("band"))
    return hit.agg(
        F.sum("n").alias("n"), F.round(F.sum("s") / F.sum("n"), 6).alias("solved"), F.round(F.sum("r") / F.sum("nr"), 6).alias("ratio"),
        F.round(F.sum("f") / F.sum("n"), 6).alias("solved_and_finished"),
    )


@query("a52_export_summary", """p AS (SELECT route_id, count(*) AS k, bool_or(x < 0 OR y < 0 OR x >= 32 OR y >= 32) AS leaves FROM fx_route_points GROUP BY 1)
    SELECT count(*) FILTER (WHERE k >= 2) AS exported, (SELECT count(*) FROM fx_routes) - count(*) FILTER (WHERE k >= 2) AS skipped,
    count(*) FILTER (WHERE leaves) AS leaving, round(avg(k), 6) AS mean_points, max(k) AS max_points, round(quantile_cont(k, 0.5), 6) AS p50,
    round(quantile_cont(k, 0.9), 6) AS p90, count(*) FILTER (WHERE n_goal <= 3) AS band_2_3, count(*) FILTER (WHERE n_goal BETWEEN 4 AND 5) AS band_4_5,
    count(*) FILTER (WHERE n_goal >= 6) AS band_6_up FROM p JOIN fx_routes USING (route_id)""")
def export_summary(spark, sf):
    off = (F.col("x") < 0) | (F.col("y") < 0) | (F.col("x") >= SIDE) | (F.col("y") >= SIDE)
    per = points(spark, sf).groupBy("route_id").agg(F.count("*").alias("k"), F.bool_or(off).alias("leaves"))
    per = per.join(routes(spark, sf).select("route_id", "n_goal").hint("merge"), "route_id").withColumn("all", F.lit(1))
    band = bins.front_band(F.col("n_goal"))
    total = routes(spark, sf).agg(F.count("*")).scalar()
    base = per.groupBy("all").agg(
        F.count_if(F.col("k") >= 2).alias("exported"), F.count_if("leaves").alias("leaving"), F.round(F.avg("k"), 6).alias("mean_points"),
        F.max("k").alias("max_points"), F.count_if(band == "2-3").alias("band_2_3"), F.count_if(band == "4-5").alias("band_4_5"),
        F.count_if(band == "6+").alias("band_6_up"),
    )
    spread = ranking.exact_percentiles(per, ["all"], "k", [0.5, 0.9])
    return base.join(spread, "all", "left").withColumn("skipped", total - F.col("exported")).withColumns(
        {"p50": F.round("p50", 6), "p90": F.round("p90", 6)}
    ).drop("all")


@query("p13_bins_and_strata", """SELECT route_id, CAST(least(greatest(floor(teacher_m / 10), 0), 36) AS INT) AS length_bin,
    CASE WHEN n_goal <= 3 THEN '2-3' WHEN n_goal <= 5 THEN '4-5' ELSE '6+' END AS band,
    CAST(CASE WHEN teacher_m / 20 < 1.2 THEN 0 WHEN teacher_m / 20 < 1.8 THEN 1 ELSE 2 END AS INT) AS stratum,
    CAST(CASE WHEN route_id % 5 = 0 THEN 7 WHEN teacher_m / 6 < 4 THEN 0 WHEN teacher_m / 6 < 5 THEN 1 WHEN teacher_m / 6 < 6 THEN 2 WHEN teacher_m / 6 < 7 THEN 3
      WHEN teacher_m / 6 < 8 THEN 4 WHEN teacher_m / 6 < 9 THEN 5 ELSE 6 END AS INT) AS sun_class FROM fx_routes""")
def bins_and_strata(spark, sf):
    hours = F.when(F.col("route_id") % 5 != 0, F.col("teacher_m") / 6)
    return routes(spark, sf).select(
        "route_id", bins.length_bin(F.col("teacher_m")).alias("length_bin"), bins.front_band(F.col("n_goal")).alias("band"),
        bins.detour_stratum(F.col("teacher_m") / 20, [1.0, 1.2, 1.8, 9.0]).alias("stratum"), bins.sun_class(hours, [4, 5, 6, 7, 8, 9]).alias("sun_class"),
    )


@query("p15_scale_points", """SELECT route_id, pos, round(x * 2, 3) AS px, round(y * 2, 3) AS py, CAST(round(x * 2 / 64 * 1000) AS BIGINT) AS gx,
    CAST(round(y * 2 / 64 * 1000) AS BIGINT) AS gy FROM fx_route_points""")
def scale_points(spark, sf):
    return points(spark, sf).select(
        "route_id", "pos", an.window_to_px(F.col("x"), 2).alias("px"), an.window_to_px(F.col("y"), 2).alias("py"),
        F.round(an.px_to_grid(F.col("x") * 2, 64.0)).cast("bigint").alias("gx"), F.round(an.px_to_grid(F.col("y") * 2, 64.0)).cast("bigint").alias("gy"),
    )


PAIRS_SQL = r"""pr AS (SELECT route_id, regexp_extract_all(text, '\[\s*-?\d+(?:\.\d+)?\s*,\s*-?\d+(?:\.\d+)?\s*\]') AS m FROM fx_answers),
    pt AS (SELECT route_id, unnest(range(len(m))) AS pos, unnest(m) AS p FROM pr WHERE len(m) >= 2)"""


@query("p16_answer_points", PAIRS_SQL + r""" SELECT route_id, CAST(pos AS INT) AS pos, round(CAST(regexp_extract(p, '(-?\d+(?:\.\d+)?)\s*,', 1) AS DOUBLE) / 1000 * 64, 6) AS x,
    round(CAST(regexp_extract(p, ',\s*(-?\d+(?:\.\d+)?)', 1) AS DOUBLE) / 1000 * 64, 6) AS y FROM pt WHERE pos < 12""")
def answer_points(spark, sf):
    pts = fx.view(spark, sf, "fx_answers").select("route_id", F.posexplode(an.answer_points(F.col("text"), 12)).alias("pos", "p"))
    return pts.select("route_id", "pos", F.round(an.grid_to_px(F.col("p")[0], 64), 6).alias("x"), F.round(an.grid_to_px(F.col("p")[1], 64), 6).alias("y"))


@query("p17_failure_hints", r"""SELECT CASE WHEN trim(text) = '' THEN 'empty answer' WHEN contains(text, '```') AND regexp_matches(text, '(```|\[|,)\s*$') THEN 'truncated JSON'
    WHEN regexp_matches(text, '\[\s*-?\d+(\.\d+)?\s*,\s*-?\d+(\.\d+)?\s*\]') THEN 'pairs but no JSON' ELSE 'no pairs' END AS hint, count(*) AS n FROM fx_answers
    WHERE len(regexp_extract_all(text, '\[\s*-?\d+(?:\.\d+)?\s*,\s*-?\d+(?:\.\d+)?\s*\]')) < 2 GROUP BY 1""")
def failure_hints(spark, sf):
    a = fx.view(spark, sf, "fx_answers")
    return a.filter(an.answer_points(F.col("text")).isNull()).groupBy(an.failure_hint(F.col("text")).alias("hint")).agg(F.count("*").alias("n"))


@query("p18_point_validity", """SELECT o_orderkey AS route_id, o_orderkey % 4 = 0 AS valid FROM orders""")
def point_validity(spark, sf):
    text = fx.table(spark, sf, "orders").selectExpr(
        "o_orderkey AS route_id",
        """CASE o_orderkey % 4 WHEN 0 THEN '[[1, 2.5], [3, 4]]' WHEN 1 THEN '[[1, 2]]' WHEN 2 THEN '[[1, 2], [3]]' ELSE '[[1, null], [3, 4]]' END AS t""",
    )
    return text.select("route_id", an.valid_points(F.from_json("t", an.POINTS)).isNotNull().alias("valid"))


@query("w13_routes_after_skip", """SELECT route_id, k FROM (SELECT route_id, row_number() OVER (PARTITION BY crop_id ORDER BY route_id) AS k FROM fx_routes
    WHERE route_id % 6 <> 0) WHERE k BETWEEN 6 AND 15""")
def routes_after_skip(spark, sf):
    kept = routes(spark, sf).filter("route_id % 6 <> 0").select("crop_id", "route_id")
    # ranks up to 15 only: every task hands on at most fifteen routes per window
    return ranking.top_k(kept, ["crop_id"], [F.col("route_id")], 15, "k").filter("k >= 6").select("route_id", F.col("k").cast("bigint").alias("k"))


@query("w17_example_per_group", STRAIGHT_SQL + """, g AS (SELECT vd.route_id, vd.crop_id, vd.n_goal, vd.teacher_m, CASE WHEN vd.reason IS NULL AND sv.reason IS NULL THEN 'both' WHEN vd.reason IS NULL THEN 'only predicted'
      WHEN sv.reason IS NULL THEN 'only straight' END AS grp FROM vd JOIN sv USING (route_id)),
    a AS (SELECT * FROM g WHERE grp = 'both' ORDER BY n_goal DESC, teacher_m DESC, route_id LIMIT 1),
    r AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY (n_goal >= 4) DESC, (crop_id NOT IN (SELECT crop_id FROM a)) DESC, teacher_m DESC, route_id) AS rn
      FROM g WHERE grp LIKE 'only%')
    SELECT grp, route_id FROM a UNION ALL SELECT grp, route_id FROM r WHERE rn = 1""")
def example_per_group(spark, sf):
    """Best example per verdict group; the later groups prefer windows the first one did not use."""
    per = by_method(spark, sf).groupBy("route_id").agg(
        F.bool_or(F.col("solved") & (F.col("method") == "predicted")).alias("p"), F.bool_or(F.col("solved") & (F.col("method") == "straight")).alias("s")
    ).join(routes(spark, sf).select("route_id", "crop_id", "n_goal", "teacher_m").hint("merge"), "route_id")
    grp = F.when(F.col("p") & F.col("s"), "both").when(F.col("p"), "only predicted").when(F.col("s"), "only straight")
    g = per.withColumn("grp", grp).filter("grp IS NOT NULL")
    best = ranking.first_row(g.filter("grp = 'both'"), ["grp"], [-F.col("n_goal"), -F.col("teacher_m"), F.col("route_id")], ["route_id", "crop_id"])
    used = best.select("crop_id", F.lit(True).alias("used"))  # one row
    rest = g.filter("grp <> 'both'").join(used, "crop_id", "left")
    later = ranking.first_row(
        rest, ["grp"], [(F.col("n_goal") < 4).cast("int"), F.coalesce("used", F.lit(False)).cast("int"), -F.col("teacher_m"), F.col("route_id")], ["route_id"]
    )
    return best.select("grp", "route_id").unionByName(later)


LINE_SQL = """ln AS (SELECT line_id, crop_id, pos, x, y FROM fx_dense_lines),
    sp0 AS (SELECT a.line_id, a.crop_id, a.pos AS i, b.pos AS j, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2 FROM ln a JOIN ln b ON a.line_id = b.line_id AND a.pos < b.pos),
    sp1 AS (SELECT *, greatest(ceil(sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)) / 0.5), 1) AS n FROM sp0),
    sp2 AS (SELECT *, unnest(range(CAST(n AS BIGINT) + 1)) AS k FROM sp1),
    hits AS MATERIALIZED (SELECT DISTINCT s.line_id, s.i, s.j FROM sp2 s LEFT JOIN fx_raster f ON f.crop_id = s.crop_id AND f.surface = 3
      AND f.row = floor(y1 + k / n * (y2 - y1)) AND f.col = floor(x1 + k / n * (x2 - x1))
      WHERE f.row IS NOT NULL OR floor(y1 + k / n * (y2 - y1)) NOT BETWEEN 0 AND 31 OR floor(x1 + k / n * (x2 - x1)) NOT BETWEEN 0 AND 31),
    far AS MATERIALIZED (SELECT s.line_id, s.i, s.j, arg_max(p.pos, (d, -p.pos)) AS k, max(d) AS d FROM (SELECT s.*, p.pos, abs((x2 - x1) * (p.y - y1) - (y2 - y1) * (p.x - x1))
        / sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)) AS d FROM sp0 s JOIN ln p ON p.line_id = s.line_id AND p.pos > s.i AND p.pos < s.j) s,
        LATERAL (SELECT s.pos) p GROUP BY 1, 2, 3),
    opn AS MATERIALIZED (SELECT f.* FROM far f LEFT JOIN hits h USING (line_id, i, j) WHERE f.d > 1.5 OR h.line_id IS NOT NULL),
    walk AS (SELECT line_id, 0 AS i, 24 AS j FROM ln WHERE pos = 0 UNION ALL SELECT w.line_id, unnest([w.i, o.k]), unnest([o.k, w.j]) FROM walk w JOIN opn o USING (line_id, i, j))"""


@query("r08_simplified_lines", LINE_SQL + """ SELECT route_id, CAST(pos AS INT) AS pos FROM (SELECT line_id AS route_id, i AS pos FROM walk UNION SELECT line_id, j FROM walk)""")
def simplified_lines(spark, sf):
    lines = fx.view(spark, sf, "fx_dense_lines").withColumnRenamed("line_id", "route_id")
    pts, frame = lines.select("route_id", "pos", "x", "y"), lines.filter("pos = 0").select("route_id", "crop_id")
    return rt.simplify(pts, frame, buildings(spark, sf), 1.5, SIDE)


@query("o04_worst_routes", VERDICT_SQL + """ SELECT route_id, round(ratio, 6) AS ratio FROM vd WHERE ratio IS NOT NULL ORDER BY ratio DESC, route_id LIMIT 8""")
def worst_routes(spark, sf):
    v = verdicts(spark, sf).filter("ratio IS NOT NULL")
    return v.orderBy(F.desc("ratio"), "route_id").limit(8).select("route_id", bins.rounded(F.col("ratio"), 6).alias("ratio"))


#: Baselines by name: each gives a vertex table for every route.
BASELINES = {"straight": straight}


@query("f03_baselines", """SELECT 'straight' AS baseline, count(*) AS vertices, round(sum(sx + gx), 3) AS sum_x, round(sum(sy + gy), 3) AS sum_y FROM fx_routes, (SELECT 1) t""".replace("count(*)", "2 * count(*)"))
def baselines(spark, sf):
    out = None
    for name, build in BASELINES.items():
        part = build(spark, sf).agg(
            F.lit(name).alias("baseline"), F.count("*").alias("vertices"), F.round(F.sum("x"), 3).alias("sum_x"), F.round(F.sum("y"), 3).alias("sum_y"))
        out = part if out is None else out.unionByName(part)
    return out


# ------------------------------------------------------------------ windows with ground round them

MARGIN = 8  # cells of ground round a window
ACROSS = 4  # windows along a district
PLACE = ("CAST((crop_id % 16 - crop_id % 4) / 4 * 32 AS INT) AS dy", "CAST(crop_id % 4 * 32 AS INT) AS dx")  # of a window in its district


def _halo_sql(text: str) -> str:
    """The verdicts' SQL on lines that may leave their window, and on the ground of the whole district round it."""
    bld = """hw AS MATERIALIZED (SELECT DISTINCT crop_id, crop_id // 16 AS district, """ + ", ".join(PLACE) + """ FROM fx_routes),
    hd AS MATERIALIZED (SELECT crop_id // 16 AS district, CAST((crop_id % 16 - crop_id % 4) / 4 * 32 + row AS INT) AS row, CAST(crop_id % 4 * 32 + col AS INT) AS col FROM fx_raster WHERE surface = 3),
    bld AS MATERIALIZED (SELECT w.crop_id, d.row - w.dy AS row, d.col - w.dx AS col FROM hw w JOIN hd d USING (district)
      WHERE d.row >= w.dy - 8 AND d.row < w.dy + 40 AND d.col >= w.dx - 8 AND d.col < w.dx + 40)"""
    plain = "bld AS (SELECT crop_id, row, col FROM fx_raster WHERE surface = 3)"
    off = "a.row < 0 OR a.row > 31 OR a.col < 0 OR a.col > 31"
    assert plain in text and off in text
    text = text.replace(plain, bld).replace(off, "a.row < greatest(-8, -dy) OR a.row >= least(40, 128 - dy) OR a.col < greatest(-8, -dx) OR a.col >= least(40, 128 - dx)")
    text = text.replace("FROM cel a LEFT JOIN bld b USING (crop_id, row, col)", "FROM cel a JOIN hw USING (crop_id) LEFT JOIN bld b USING (crop_id, row, col)").replace("fx_route_points", "hp")
    return """hp AS MATERIALIZED (SELECT route_id, pos, x, round(y - CASE WHEN route_id % 4 = 0 AND pos = 2 AND route_id % 5 > 0 THEN 12 ELSE 0 END, 3) AS y FROM fx_route_points), """ + text


def halo_points(spark, sf):
    """Predicted lines of which every fourth makes a detour that may leave its window."""
    away = F.expr("IF(route_id % 4 = 0 AND pos = 2 AND route_id % 5 > 0, 12, 0)")
    return points(spark, sf).withColumn("y", F.round(F.col("y") - away, 3))


def halo_windows(df):
    return df.selectExpr("crop_id", "crop_id DIV 16 AS district", *PLACE)


def halo_routes(spark, sf):
    """Routes with the bounds of their ground: the window, the margin and no more than the district."""
    r = routes(spark, sf)
    where = r.selectExpr("*", *PLACE)
    return where.withColumns(grids.ground_bounds(SIDE, MARGIN, ACROSS * SIDE, ACROSS * SIDE)).drop("dy", "dx")


def district_cells(spark, sf, columns=("surface",)):
    """The windows of the fixture laid side by side, sixteen to a district raster."""
    r = fx.view(spark, sf, "fx_raster").selectExpr("*", *PLACE)
    return r.selectExpr("crop_id DIV 16 AS district", "row + dy AS row", "col + dx AS col", *columns)


def halo_buildings(spark, sf):
    windows = halo_windows(routes(spark, sf).select("crop_id").distinct())
    built = district_cells(spark, sf).filter("surface = 3").drop("surface")
    return grids.cut_with_halo(built, windows, ["district"], SIDE, MARGIN, SIDE).select("crop_id", "row", "col")


def halo_verdicts(spark, sf, lines=halo_points):
    return rt.verdicts(halo_routes(spark, sf), lines(spark, sf), halo_buildings(spark, sf), SIDE)


@query("j11_segments_with_margin", _halo_sql(HIT_SQL) + " SELECT route_id, seg, crosses FROM hit")
def segments_with_margin(spark, sf):
    r = halo_routes(spark, sf).select("route_id", "crop_id", *rt.BOUNDS)
    segs = rt.segments(halo_points(spark, sf), ["route_id"]).join(r.hint("merge"), "route_id")
    return rt.crossing(segs, "crop_id", halo_buildings(spark, sf), ["route_id", "seg"], SIDE)


@query("a36_verdicts_with_margin", _halo_sql(VERDICT_SQL) + """ SELECT route_id, coalesce(reason, 'solved') AS verdict, crosses, round(length_m, 3) AS length_m,
    round(ratio, 4) AS length_ratio FROM vd""")
def verdicts_with_margin(spark, sf):
    return halo_verdicts(spark, sf).select(
        "route_id", F.coalesce("reason", F.lit("solved")).alias("verdict"), "crosses", bins.rounded(F.col("length_m"), 3).alias("length_m"),
        bins.rounded(F.col("ratio"), 4).alias("length_ratio"))


@query("a37_report_with_margin", _halo_sql(VERDICT_SQL) + f" SELECT {REPORT_SQL} FROM vd")
def report_with_margin(spark, sf):
    return rt.report(halo_verdicts(spark, sf))


@query("a56_methods_with_margin", _halo_sql(STRAIGHT_SQL) + f""" SELECT 'predicted' AS method, {REPORT_SQL} FROM vd UNION ALL SELECT 'straight', {REPORT_SQL} FROM sv""")
def methods_with_margin(spark, sf):
    cols = ["n_goal", "ratio", "reason", "solved"]
    base = halo_verdicts(spark, sf, straight).select(*cols).withColumn("method", F.lit("straight"))
    return rt.report(halo_verdicts(spark, sf).select(*cols).withColumn("method", F.lit("predicted")).unionByName(base), ["method"])
