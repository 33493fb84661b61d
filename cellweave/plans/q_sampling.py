"""Seeded sampling, splits, task dimensions, keys and texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from cellweave.functions.bins import detour_stratum
from cellweave.functions.hashing import draw, draw_sql, uniform, uniform_sql
from cellweave.operators import checks, ranking
from cellweave.operators import routes as rt
from cellweave.operators import sampling as sp
from cellweave.operators import wave
from cellweave.operators.frontier import label_cells
from cellweave.plans import fixtures as fx
from cellweave.plans.q_frontier import WALKED_SQL, _labels_sql, metres, once
from cellweave.plans.q_raster import TASKS
from cellweave.plans.q_routes import SEG_SQL, buildings, points, routes
from cellweave.plans.registry import query
from cellweave.session import cut_lineage

HELD = [(0, 2), (3, 1), (1, 0), (2, 3)]
VAL = [(0, 2), (3, 1)]
CAND_SQL = f"""cand AS (SELECT crop_id // 16 AS district, crop_id * 3 + d.j AS draw, CAST(floor({draw_sql('crop_id', 'd.j', salt=31)} * 105) AS INT) AS dx,
    CAST(floor({draw_sql('crop_id', 'd.j', salt=32)} * 105) AS INT) AS dy FROM fx_markers, (SELECT unnest(range(3)) AS j) d)"""


def candidates(spark, sf):
    d = fx.view(spark, sf, "fx_markers").selectExpr("crop_id DIV 16 AS district", "crop_id", "explode(sequence(0L, 2L)) AS j").selectExpr(
        "district", "crop_id", "j", "crop_id * 3 + j AS draw")
    return d.withColumns({"dx": F.floor(draw(F.col("crop_id"), F.col("j"), salt=31) * 105).cast("int"), "dy": F.floor(draw(F.col("crop_id"), F.col("j"), salt=32) * 105).cast("int")}).drop("crop_id", "j")


@query("p24_seeded_uniform", f"SELECT o_orderkey AS id, {uniform_sql('o_orderkey', 1)} AS u1, {uniform_sql('o_orderkey', 7)} AS u7 FROM orders")
def seeded_uniform(spark, sf):
    return fx.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"), uniform(F.col("o_orderkey"), 1).alias("u1"), uniform(F.col("o_orderkey"), 7).alias("u7")
    )


@query("j16_windows_off_held_out", CAND_SQL + """ SELECT draw, dx, dy FROM cand WHERE NOT EXISTS (SELECT 1 FROM (VALUES (0, 2), (3, 1), (1, 0), (2, 3)) h(r, c)
    WHERE dx < (c + 1) * 32 AND dx + 24 > c * 32 AND dy < (r + 1) * 32 AND dy + 24 > r * 32)""")
def windows_off_held_out(spark, sf):
    return sp.off_held_out(candidates(spark, sf), HELD, ["draw"], 24, 32).select("draw", "dx", "dy")


@query("r13_window_origins", CAND_SQL + """, tr AS (SELECT district, dx, dy, min(draw) AS draw FROM cand WHERE NOT EXISTS (SELECT 1 FROM (VALUES (0, 2), (3, 1), (1, 0), (2, 3)) h(r, c)
      WHERE dx < (c + 1) * 32 AND dx + 24 > c * 32 AND dy < (r + 1) * 32 AND dy + 24 > r * 32) GROUP BY 1, 2, 3),
    va AS (SELECT district, dx, dy, min(draw) AS draw FROM cand WHERE EXISTS (SELECT 1 FROM (VALUES (0, 2), (3, 1)) h(r, c)
      WHERE dx >= c * 32 AND dx + 24 <= (c + 1) * 32 AND dy >= r * 32 AND dy + 24 <= (r + 1) * 32) GROUP BY 1, 2, 3),
    k AS (SELECT 'train' AS split, *, row_number() OVER (PARTITION BY district ORDER BY draw, dx, dy) AS rn FROM tr
      UNION ALL SELECT 'val', *, row_number() OVER (PARTITION BY district ORDER BY draw, dx, dy) FROM va)
    SELECT split, district, dx, dy FROM k WHERE rn <= 8""")
def window_origins(spark, sf):
    c = candidates(spark, sf)
    train = sp.first_origins(sp.off_held_out(c, HELD, ["draw"], 24, 32), "district", 8).withColumn("split", F.lit("train"))
    val = sp.first_origins(sp.inside_one_block(c, VAL, 24, 32), "district", 8).withColumn("split", F.lit("val"))
    return train.unionByName(val).select("split", "district", "dx", "dy")


@query("r14_marker_sets", f"""t AS (SELECT crop_id, a.a, i.i, CAST(floor({draw_sql('crop_id', 'a.a', 'i.i', salt=11)} * 32) AS INT) AS r,
      CAST(floor({draw_sql('crop_id', 'a.a', 'i.i', salt=12)} * 32) AS INT) AS c FROM fx_markers, (SELECT unnest(range(64)) AS a) a, (SELECT unnest(range(4)) AS i) i),
    bad AS (SELECT DISTINCT x.crop_id, x.a FROM t x JOIN t y ON x.crop_id = y.crop_id AND x.a = y.a AND x.i < y.i AND (x.r - y.r) * (x.r - y.r) + (x.c - y.c) * (x.c - y.c) < 100),
    ok AS (SELECT crop_id, min(a) AS a FROM (SELECT DISTINCT crop_id, a FROM t ANTI JOIN bad USING (crop_id, a)) GROUP BY 1)
    SELECT t.crop_id, CAST(i AS INT) AS slot, r AS mrow, c AS mcol FROM t JOIN ok USING (crop_id, a)""")
def marker_sets(spark, sf):
    return sp.marker_sets(fx.view(spark, sf, "fx_markers").select("crop_id"), "crop_id", 4, 10, 32)


@query("r15_weighted_tasks", f"""SELECT CAST(CASE WHEN u * 10 < 4 THEN 0 WHEN u * 10 < 7 THEN 1 WHEN u * 10 < 9 THEN 2 ELSE 3 END AS INT) AS task, count(*) AS n
    FROM (SELECT {draw_sql('route_id', salt=9)} AS u FROM fx_routes) GROUP BY 1""")
def weighted_tasks(spark, sf):
    pick = sp.weighted_pick(draw(F.col("route_id"), salt=9), [4.0, 3.0, 2.0, 1.0])
    return routes(spark, sf).groupBy(pick.alias("task")).agg(F.count("*").alias("n"))


@query("w11_stratum_quota", """SELECT stratum, route_id, rank FROM (SELECT stratum, route_id, row_number() OVER (PARTITION BY stratum ORDER BY (route_id * 48271) % 65521, route_id) AS rank
    FROM fx_routes) WHERE rank <= CASE stratum WHEN 0 THEN 52 ELSE 50 END""")
def stratum_quota(spark, sf):
    order = [F.expr("(route_id * 48271) % 65521"), F.col("route_id")]
    out = sp.within_quota(routes(spark, sf).select("stratum", "route_id"), "stratum", order, sp.quotas(202, 4))
    return out.withColumn("rank", F.col("rank").cast("bigint"))


FREE_SQL = """inner_px AS MATERIALIZED (SELECT a.crop_id, a.row, a.col FROM fx_raster a JOIN fx_raster b ON a.crop_id = b.crop_id AND abs(a.row - b.row) + abs(a.col - b.col) <= 2
      AND b.surface <> 3 GROUP BY 1, 2, 3 HAVING count(*) = 13 AND a.row BETWEEN 2 AND 29 AND a.col BETWEEN 2 AND 29),
    rk AS (SELECT *, row_number() OVER (PARTITION BY crop_id ORDER BY row, col) AS rn, count(*) OVER (PARTITION BY crop_id) AS n FROM inner_px)"""


@query("r16_route_candidates", FREE_SQL + ", " + _labels_sql("SELECT crop_id, row, col FROM fx_raster WHERE surface <> 3", False) + f""", dr AS (SELECT crop_id, j.j AS draw, {draw_sql('crop_id', 'j.j', salt=41)} AS ua, {draw_sql('crop_id', 'j.j', salt=42)} AS ub
      FROM fx_markers, (SELECT unnest(range(8)) AS j) j)
    SELECT d.crop_id, d.draw, a.row AS arow, a.col AS acol, b.row AS brow, b.col AS bcol FROM dr d JOIN rk a ON a.crop_id = d.crop_id AND a.rn = CAST(floor(ua * a.n) AS BIGINT) + 1
      JOIN rk b ON b.crop_id = d.crop_id AND b.rn = CAST(floor(ub * b.n) AS BIGINT) + 1
      JOIN lab la ON la.crop_id = a.crop_id AND la.row = a.row AND la.col = a.col JOIN lab lb ON lb.crop_id = b.crop_id AND lb.row = b.row AND lb.col = b.col
    WHERE la.label = lb.label AND (a.row - b.row) * (a.row - b.row) + (a.col - b.col) * (a.col - b.col) BETWEEN 64 AND 784""")
def route_candidates(spark, sf):
    """Seeded pairs on inner free ground, 8 to 28 m apart, both ends in one component of the free ground.

    All joins are merged: the written labels of all cells are small files, and were sent whole through the driver.
    """
    free = fx.view(spark, sf, "fx_raster").filter("surface <> 3").select("crop_id", "row", "col")
    inner = sp.inner_ground(free, ["crop_id"], 32, 2)
    n = inner.groupBy("crop_id").agg(F.count("*").alias("n"))
    labels = label_cells(free, ["crop_id"], False, 32)
    ranked = ranking.tiered_rank(inner, ["crop_id"], ["row", "col"]).join(labels.hint("merge"), ["crop_id", "row", "col"])
    seed = F.col("crop_id"), F.col("draw")
    draws = fx.view(spark, sf, "fx_markers").selectExpr("crop_id", "explode(sequence(0L, 7L)) AS draw").join(n.hint("merge"), "crop_id").select(
        "crop_id", "draw", (F.floor(draw(*seed, salt=41) * F.col("n")) + 1).alias("ra"), (F.floor(draw(*seed, salt=42) * F.col("n")) + 1).alias("rb")
    )
    a = ranked.selectExpr("crop_id", "rn AS ra", "row AS arow", "col AS acol", "label AS la")
    b = ranked.selectExpr("crop_id", "rn AS rb", "row AS brow", "col AS bcol", "label AS lb")
    out = draws.join(a.hint("merge"), ["crop_id", "ra"]).join(b.hint("merge"), ["crop_id", "rb"])
    return out.filter("la = lb AND (arow - brow) * (arow - brow) + (acol - bcol) * (acol - bcol) BETWEEN 64 AND 784").select("crop_id", "draw", "arow", "acol", "brow", "bcol")


DETOURS = (0.0, 1.05, 1.3, 99.0)
PER_CROP = 3  # accepted routes per crop, shared out over the strata
FULL_SQL = WALKED_SQL + ", " + FREE_SQL + f""", nc AS (SELECT count(*) AS n FROM fx_walks),
    dw AS (SELECT j.j AS draw, CAST(floor({draw_sql('j.j // 4', salt=61)} * nc.n) AS BIGINT) AS crop_id, {draw_sql('j.j', salt=62)} AS u FROM nc, (SELECT unnest(range((SELECT 256 * n FROM nc))) AS j) j),
    pr AS (SELECT dw.draw, dw.crop_id, k.row AS grow, k.col AS gcol, met.m, sqrt((k.row - w.srow) * (k.row - w.srow) + (k.col - w.scol) * (k.col - w.scol)) AS straight
      FROM dw JOIN fx_walks w USING (crop_id) LEFT JOIN rk k ON k.crop_id = dw.crop_id AND k.rn = CAST(floor(u * k.n) AS BIGINT) + 1
      LEFT JOIN met ON met.crop_id = dw.crop_id AND met.row = k.row AND met.col = k.col),
    js AS (SELECT *, CASE WHEN grow IS NULL THEN 'no free ground' WHEN NOT straight BETWEEN 8 AND 28 THEN 'distance' WHEN m IS NULL THEN 'blocked' END AS early,
      CASE WHEN m / straight < 1.05 THEN 0 WHEN m / straight < 1.3 THEN 1 ELSE 2 END AS st, CASE WHEN m > 36 THEN 'too long' END AS late FROM pr),
    lg AS (SELECT *, row_number() OVER (PARTITION BY st ORDER BY draw) AS rank FROM js WHERE early IS NULL AND late IS NULL),
    ac AS (SELECT lg.* FROM lg, nc WHERE rank <= nc.n), fl AS (SELECT st, max(draw) AS full_at FROM ac GROUP BY 1)"""


def routes_until_full(spark, sf):
    """Routes from each window's start to drawn goals on inner free ground until every detour stratum is full.

    One walking field serves all goals of a window; the first reasons are no ground, distance and a blocked way, the
    late one a way that is too long.
    """

    def build():
        starts = fx.view(spark, sf, "fx_walks").select("crop_id", "srow", "scol")
        n_crops = starts.count()
        free = fx.view(spark, sf, "fx_raster").filter("surface <> 3").select("crop_id", "row", "col")
        inner = sp.inner_ground(free, ["crop_id"], 32, 2)
        ranked = ranking.tiered_rank(inner, ["crop_id"], ["row", "col"]).join(metres(spark, sf).hint("merge"), ["crop_id", "row", "col"], "left")
        goals = cut_lineage(ranked.selectExpr("crop_id", "rn", "row AS grow", "col AS gcol", "metres"))
        starts = cut_lineage(starts.join(goals.groupBy("crop_id").agg(F.count("*").alias("n")), "crop_id", "left"))

        def propose(lo, hi):
            d = F.col("draw")
            drawn = spark.range(lo, hi).withColumnRenamed("id", "draw").select("draw", F.floor(draw(F.expr("draw DIV 4"), salt=61) * n_crops).alias("crop_id"), draw(d, salt=62).alias("_u"))
            asked = drawn.join(starts.hint("merge"), "crop_id").withColumn("rn", F.floor(F.col("_u") * F.col("n")) + 1).join(goals.hint("merge"), ["crop_id", "rn"], "left")
            straight = F.sqrt(F.pow(F.col("grow") - F.col("srow"), 2) + F.pow(F.col("gcol") - F.col("scol"), 2))
            ratio = F.try_divide(F.col("metres"), F.col("straight"))
            return asked.withColumn("straight", straight).select(
                "draw", "crop_id", "grow", "gcol", "metres", "straight", detour_stratum(ratio, DETOURS).alias("stratum"),
                F.when(F.col("grow").isNull(), "no free ground").when(~F.col("straight").between(8, 28), "distance").when(F.col("metres").isNull(), "blocked").alias("early"),
                F.when(F.col("metres") > 36, "too long").alias("late"))

        return sp.accept_until_full(propose, "stratum", sp.quotas(PER_CROP * n_crops, 3), first=max(1024, 8 * n_crops))

    return once(spark, sf, "routes_until_full", build)


@query("r16_routes_until_full", FULL_SQL + """ SELECT CAST(st AS INT) AS stratum, rank, draw, crop_id, grow, gcol, round(m, 6) AS metres, round(m / straight, 6) AS ratio FROM ac""")
def accepted_routes(spark, sf):
    rows = routes_until_full(spark, sf).rows
    return rows.select("stratum", "rank", "draw", "crop_id", "grow", "gcol", F.round("metres", 6).alias("metres"), F.round(F.col("metres") / F.col("straight"), 6).alias("ratio"))


@query("w11_reject_reasons", FULL_SQL + """ SELECT coalesce(early, CASE WHEN draw > full_at THEN 'stratum full' END, late, 'accepted') AS reason, count(*) AS n FROM js LEFT JOIN fl USING (st)
    WHERE draw <= (SELECT max(full_at) FROM fl) GROUP BY 1""")
def reject_reasons(spark, sf):
    return routes_until_full(spark, sf).reasons


READ_SQL = f"""u AS (SELECT route_id, crop_id, sx, sy, gx, gy, {draw_sql('route_id', salt=1)} AS u0, {draw_sql('route_id', salt=2)} AS u1, {draw_sql('route_id', salt=5)} < 0.5 AS whole FROM fx_routes),
    t AS (SELECT *, CASE WHEN whole THEN 0.0 ELSE 0.7 * u0 END AS t0 FROM u), tt AS (SELECT *, CASE WHEN whole THEN 1.0 ELSE t0 + 0.1 + (1.0 - t0 - 0.1) * u1 END AS t1 FROM t),
    rd AS (SELECT *, (t1 - t0) * sqrt((gx - sx) * (gx - sx) + (gy - sy) * (gy - sy)) AS len FROM tt)"""


@query("r18_line_length_readings", READ_SQL + """ SELECT route_id, round(len, 6) AS length_m, CAST(least(greatest(floor(len / 10), 0), 36) AS INT) AS bin FROM rd""")
def line_length_readings(spark, sf):
    from cellweave.functions.bins import length_bin

    r = F.col("route_id")
    whole = draw(r, salt=5) < 0.5
    t0 = F.when(whole, 0.0).otherwise(0.7 * draw(r, salt=1))
    t1 = F.when(whole, 1.0).otherwise(t0 + 0.1 + (1.0 - t0 - 0.1) * draw(r, salt=2))
    full = F.sqrt(F.pow(F.col("gx") - F.col("sx"), 2) + F.pow(F.col("gy") - F.col("sy"), 2))
    return routes(spark, sf).select("route_id", ((t1 - t0) * full).alias("len")).select(
        "route_id", F.round("len", 6).alias("length_m"), length_bin(F.col("len")).alias("bin")
    )


@query("r18_path_prefix_readings", SEG_SQL + f""", nn AS (SELECT route_id, count(*) AS n FROM fx_route_points GROUP BY 1),
    k AS (SELECT route_id, CASE WHEN {draw_sql('route_id', salt=4)} < 0.5 THEN n ELSE least(greatest(least(3, n) + least(CAST(floor({draw_sql('route_id', salt=3)}
      * (n - least(3, n) + 1)) AS BIGINT), n - least(3, n)), 2), n) END AS k FROM nn)
    SELECT route_id, max(k.k) AS vertices, round(sum(len), 6) AS length_m FROM sg JOIN k USING (route_id) WHERE seg + 1 <= k.k GROUP BY 1""")
def path_prefix_readings(spark, sf):
    """The stored path, in half the cases cut to a prefix that keeps a corner when there is one."""
    r, n = F.col("route_id"), F.col("n")
    low = F.least(F.lit(3), n)
    cut = F.greatest(low + F.least(F.floor(draw(r, salt=3) * (n - low + 1)), n - low), F.lit(2))
    k = points(spark, sf).groupBy("route_id").agg(F.count("*").alias("n")).select(
        "route_id", F.when(draw(r, salt=4) < 0.5, n).otherwise(F.least(cut, n)).alias("k"))
    segs = rt.segments(points(spark, sf), ["route_id"]).join(k, "route_id").filter("seg + 1 <= k")
    return segs.groupBy("route_id").agg(F.max("k").alias("vertices"), F.round(F.sum(rt.seg_length()), 6).alias("length_m"))


NOISE_SQL = f"""lit AS (SELECT sample_id, gr AS row, gc AS col FROM fx_marks WHERE score > 0.15), ids AS (SELECT vec_id AS sample_id FROM embeddings),
    dr AS (SELECT sample_id, {draw_sql('sample_id', salt=21)} < 0.5 AS pick, {draw_sql('sample_id', salt=22)} < 0.5 AS wide, {draw_sql('sample_id', salt=23)} < 0.3 AS mv,
      CAST(floor({draw_sql('sample_id', salt=24)} * 4) AS INT) AS way FROM ids),
    o AS (SELECT i.i, j.j FROM (SELECT unnest([-1, 0, 1]) AS i) i, (SELECT unnest([-1, 0, 1]) AS j) j),
    w AS (SELECT l.sample_id, l.row + o.i AS row, l.col + o.j AS col, pick AND mv AS mv, way, pick FROM lit l JOIN dr USING (sample_id) JOIN o ON (i = 0 AND j = 0) OR (pick AND wide)
      WHERE l.row + o.i BETWEEN 0 AND 7 AND l.col + o.j BETWEEN 0 AND 7),
    m AS (SELECT sample_id, pick, row + CASE WHEN mv AND way = 0 THEN -1 WHEN mv AND way = 1 THEN 1 ELSE 0 END AS row,
      col + CASE WHEN mv AND way = 2 THEN -1 WHEN mv AND way = 3 THEN 1 ELSE 0 END AS col FROM w),
    kept AS (SELECT sample_id, row, col FROM m WHERE row BETWEEN 0 AND 7 AND col BETWEEN 0 AND 7 AND NOT (pick AND {draw_sql('sample_id', 'row * 8 + col', salt=25)} < 0.05)),
    spk AS (SELECT sample_id, CAST(c // 8 AS INT) AS row, CAST(c % 8 AS INT) AS col FROM dr, (SELECT unnest(range(64)) AS c) c WHERE pick AND {draw_sql('sample_id', 'c', salt=25)} > 1.0 - 0.01)"""


@query("r12_drawing_noise", NOISE_SQL + " SELECT * FROM kept UNION SELECT * FROM spk")
def drawing_noise(spark, sf):
    lit = fx.grid(spark, sf).filter("score > 0.15").selectExpr("sample_id", "gr AS row", "gc AS col")
    ids = fx.table(spark, sf, "embeddings").selectExpr("vec_id AS sample_id")
    return sp.noisy_drawings(lit, ids, "sample_id", 8, 0.5, 0.5, 0.3, 0.05, 0.01)


CORNER_SQL = """bld AS MATERIALIZED (SELECT crop_id, row, col FROM fx_raster WHERE surface = 3),
    v AS (SELECT crop_id, row + i.i AS vr, col + j.j AS vc, CASE WHEN i.i = 0 THEN -0.5 ELSE 0.5 END AS oy, CASE WHEN j.j = 0 THEN -0.5 ELSE 0.5 END AS ox
      FROM bld, (SELECT unnest([0, 1]) AS i) i, (SELECT unnest([0, 1]) AS j) j),
    cor AS (SELECT crop_id, CAST(vc + min(ox) AS DOUBLE) AS x, CAST(vr + min(oy) AS DOUBLE) AS y FROM v GROUP BY crop_id, vr, vc HAVING count(*) = 1
      AND vc + min(ox) BETWEEN 0 AND 31.999 AND vr + min(oy) BETWEEN 0 AND 31.999)"""


@query("r11_fan_corners", CORNER_SQL + " SELECT crop_id, x, y FROM cor")
def fan_corners(spark, sf):
    return sp.corners(buildings(spark, sf), ["crop_id"], 32)


FAN_SQL = CORNER_SQL + """, pr AS (SELECT m.crop_id, m.mcol + 0.5::DOUBLE AS x1, m.mrow + 0.5::DOUBLE AS y1, c.x AS x2, c.y AS y2, sqrt((c.x - m.mcol - 0.5) * (c.x - m.mcol - 0.5)
      + (c.y - m.mrow - 0.5) * (c.y - m.mrow - 0.5)) AS d FROM fx_markers m JOIN cor c USING (crop_id)),
    nr AS (SELECT *, greatest(ceil(d / 0.5), 1) AS n FROM pr WHERE d <= 12),
    s AS (SELECT *, unnest(range(CAST(n AS BIGINT) + 1)) AS i FROM nr),
    blk AS (SELECT DISTINCT s.crop_id, s.x2, s.y2 FROM s JOIN bld b ON b.crop_id = s.crop_id AND b.row = floor(y1 + i / n * (y2 - y1)) AND b.col = floor(x1 + i / n * (x2 - x1))),
    past AS (SELECT nr.*, q.q, x2 + q.q * (x2 - x1) / greatest(d, 1e-9) AS qx, y2 + q.q * (y2 - y1) / greatest(d, 1e-9) AS qy FROM nr, (SELECT unnest([1.5, 3.0, 4.5]::DOUBLE[]) AS q) q),
    stop AS (SELECT DISTINCT p.crop_id, p.x2, p.y2 FROM past p JOIN bld b ON b.crop_id = p.crop_id AND b.row = floor(qy) AND b.col = floor(qx)),
    ok AS (SELECT * FROM nr ANTI JOIN blk USING (crop_id, x2, y2)), fan AS (SELECT *, row_number() OVER (PARTITION BY crop_id ORDER BY round(d, 9), y2, x2) AS rn FROM ok ANTI JOIN stop USING (crop_id, x2, y2))"""


def fans(spark, sf):
    """Visible corners within the radius whose ray runs on past them, nearest first."""
    marks = fx.view(spark, sf, "fx_markers").selectExpr("crop_id", "mcol + 0.5D AS x1", "mrow + 0.5D AS y1")
    cor = sp.corners(buildings(spark, sf), ["crop_id"], 32).withColumnsRenamed({"x": "x2", "y": "y2"})
    near = marks.join(cor, "crop_id").withColumn("d", rt.seg_length()).filter("d <= 12")
    seen = rt.visible(near, "crop_id", buildings(spark, sf), ["crop_id", "x2", "y2"], 32)
    step = F.explode(F.array(*[F.lit(q) for q in (1.5, 3.0, 4.5)]))
    past = seen.withColumn("q", step).withColumns({
        "col": F.floor(F.col("x2") + F.col("q") * (F.col("x2") - F.col("x1")) / F.greatest("d", F.lit(1e-9))).cast("int"),
        "row": F.floor(F.col("y2") + F.col("q") * (F.col("y2") - F.col("y1")) / F.greatest("d", F.lit(1e-9))).cast("int"),
    })
    stopped = past.join(buildings(spark, sf), ["crop_id", "row", "col"], "left_semi").select("crop_id", "x2", "y2").distinct()
    return seen.join(stopped, ["crop_id", "x2", "y2"], "left_anti")


@query("w06_nearest_visible_corners", FAN_SQL + " SELECT crop_id, rn AS rank, x2 AS x, y2 AS y, round(d, 6) AS dist FROM fan WHERE rn <= 48")
def nearest_visible_corners(spark, sf):
    near = ranking.top_k(fans(spark, sf), ["crop_id"], [F.round("d", 9), F.col("y2"), F.col("x2")], 48, "rank")
    return near.select("crop_id", F.col("rank").cast("bigint").alias("rank"), F.col("x2").alias("x"), F.col("y2").alias("y"), F.round("d", 6).alias("dist"))


@query("a09_ray_cells", FAN_SQL + """, rs AS (SELECT *, unnest(range(CAST(n AS BIGINT) + 1)) AS i FROM fan WHERE rn <= 48)
    SELECT DISTINCT crop_id, CAST(floor(y1 + i / n * (y2 - y1)) AS INT) // 4 AS gr, CAST(floor(x1 + i / n * (x2 - x1)) AS INT) // 4 AS gc FROM rs""")
def ray_cells(spark, sf):
    near = ranking.top_k(fans(spark, sf), ["crop_id"], [F.round("d", 9), F.col("y2"), F.col("x2")], 48)
    return rt.samples(near).selectExpr("crop_id", "CAST(row DIV 4 AS INT) AS gr", "CAST(col DIV 4 AS INT) AS gc").distinct()


@query("a09_path_cells", SEG_SQL + """ SELECT DISTINCT route_id, CAST(least(greatest(row, 0), 31) AS INT) // 4 AS gr, CAST(least(greatest(col, 0), 31) AS INT) // 4 AS gc FROM cel""")
def path_cells(spark, sf):
    px = rt.samples(rt.segments(points(spark, sf), ["route_id"]))
    return px.selectExpr(
        "route_id", "CAST(least(greatest(row, 0), 31) DIV 4 AS INT) AS gr", "CAST(least(greatest(col, 0), 31) DIV 4 AS INT) AS gc"
    ).distinct()


BOX_SQL = """f AS (SELECT route_id, pos, CAST(floor(x * 1024 + 0.5) AS BIGINT) AS x, CAST(floor(y * 1024 + 0.5) AS BIGINT) AS y FROM fx_route_points),
    g AS (SELECT route_id, lag(x) OVER w AS x1, lag(y) OVER w AS y1, x AS x2, y AS y2 FROM f WINDOW w AS (PARTITION BY route_id ORDER BY pos)),
    c AS (SELECT g.*, r.r, k.k, k.k * 4096 AS a, r.r * 4096 AS b, greatest(abs(x2 - x1), 1) AS nx, greatest(abs(y2 - y1), 1) AS ny FROM g, (SELECT unnest(range(-1, 11)) AS r) r, (SELECT unnest(range(-1, 11)) AS k) k
      WHERE x1 IS NOT NULL AND greatest(x1, x2) >= k.k * 4096 AND least(x1, x2) < k.k * 4096 + 4096 AND greatest(y1, y2) >= r.r * 4096 AND least(y1, y2) < r.r * 4096 + 4096),
    t AS (SELECT *, CASE WHEN x2 > x1 THEN 2 * (a - x1) * ny WHEN x2 < x1 THEN 2 * (x1 - a - 4096) * ny + 1 ELSE 0 END AS xin,
      CASE WHEN x2 > x1 THEN 2 * (a + 4096 - x1) * ny - 1 WHEN x2 < x1 THEN 2 * (x1 - a) * ny ELSE 2 * nx * ny END AS xout,
      CASE WHEN y2 > y1 THEN 2 * (b - y1) * nx WHEN y2 < y1 THEN 2 * (y1 - b - 4096) * nx + 1 ELSE 0 END AS yin,
      CASE WHEN y2 > y1 THEN 2 * (b + 4096 - y1) * nx - 1 WHEN y2 < y1 THEN 2 * (y1 - b) * nx ELSE 2 * nx * ny END AS yout FROM c)
    SELECT DISTINCT route_id, r AS gr, k AS gc FROM t WHERE greatest(xin, yin, 0) <= least(xout, yout, 2 * nx * ny)"""


@query("a09_trajectory_cells", BOX_SQL)
def trajectory_cells(spark, sf):
    """Every 4 m cell a route touches, however briefly. The SQL tests each segment against each cell's box, in whole numbers."""
    segs = rt.segments(points(spark, sf), ["route_id"])
    return rt.supercover(segs, ["route_id"], 4).withColumnsRenamed({"row": "gr", "col": "gc"})


@query("a09_marker_cell", "SELECT crop_id, CAST(mrow * 8 // 32 AS INT) AS gr, CAST(mcol * 8 // 32 AS INT) AS gc FROM fx_markers")
def marker_cell(spark, sf):
    """The one cell of the grid that holds a window's marker."""
    cell = lambda c: F.expr(f"CAST({c} * {fx.GRID} DIV {fx.SIDE} AS INT)")
    return fx.view(spark, sf, "fx_markers").select("crop_id", cell("mrow").alias("gr"), cell("mcol").alias("gc"))


@query("a09_building_cells", """SELECT crop_id, CAST(row // 4 AS INT) AS gr, CAST(col // 4 AS INT) AS gc FROM fx_raster GROUP BY 1, 2, 3 HAVING count(*) FILTER (WHERE surface = 3) >= 8""")
def building_cells(spark, sf):
    from cellweave.operators.grids import cell_of

    r = fx.view(spark, sf, "fx_raster")
    return r.groupBy("crop_id", *cell_of("row", "col", 4)).agg(F.count_if(F.col("surface") == 3).alias("n")).filter("n >= 8").drop("n")


@query("u03_cumulative_rounds", """SELECT sample_id, k.k AS upto, count(DISTINCT gr * 8 + gc) AS cells FROM fx_grid, (SELECT CAST(unnest(range(1, 5)) AS INT) AS k) k
    WHERE (gr + gc) % 4 < k.k AND score > 0.1 GROUP BY 1, 2""")
def cumulative_rounds(spark, sf):
    """Cells drawn up to each round; each cell is sent to the rounds from its own on."""
    cells = fx.grid(spark, sf).filter("score > 0.1").groupBy("sample_id", "gr", "gc").agg(F.min((F.col("gr") + F.col("gc")) % 4 + 1).alias("r"))
    return cells.withColumn("upto", F.explode(F.sequence(F.col("r"), F.lit(4)))).groupBy("sample_id", "upto").agg(F.count("*").alias("cells"))


@query("u04_train_keys", """SELECT DISTINCT p_brand AS task_key FROM part WHERE p_brand NOT IN ('Brand#7', 'Brand#14')""")
def train_keys(spark, sf):
    keys = fx.table(spark, sf, "part").selectExpr("p_brand AS task_key").distinct()
    held = spark.createDataFrame([("Brand#7",), ("Brand#14",)], "task_key string")
    checks.require_empty(checks.without_partner(held, keys, ["task_key"]), "held-out key is unknown")
    return keys.subtract(held)


@query("u05_shared_labels", """a AS (SELECT DISTINCT l_suppkey AS crop_id, l_partkey % 50 AS label FROM lineitem WHERE l_linenumber = 1),
    b AS (SELECT DISTINCT l_suppkey AS crop_id, l_partkey % 50 AS label FROM lineitem WHERE l_linenumber = 2) SELECT * FROM a INTERSECT SELECT * FROM b""")
def shared_labels(spark, sf):
    li = fx.table(spark, sf, "lineitem")
    side = lambda n: li.filter(F.col("l_linenumber") == n).selectExpr("l_suppkey AS crop_id", "l_partkey % 50 AS label")
    return side(1).intersect(side(2))


@query("j17_crops_by_tasks", """SELECT crop_id, k.key AS task_key, CAST((row_number() OVER (ORDER BY crop_id, k.i)) - 1 AS BIGINT) AS ix FROM fx_markers,
    (SELECT unnest(range(4)) AS i, unnest(['surface_3', 'surface_2', 'noise7_0+surface_2', 'surface_3+estab_0']) AS key) k WHERE crop_id % 5 = 0""")
def crops_by_tasks(spark, sf):
    """Every val crop with every task in fixed order; the tasks are a fixed list inside the row."""
    crops = fx.view(spark, sf, "fx_markers").filter("crop_id % 5 = 0").selectExpr("crop_id", "1 AS all", "crop_id DIV 4096 AS hi")
    ranked = ranking.tiered_rank(crops, ["all"], ["hi", "crop_id"])
    tasks = F.array(*[F.lit(k) for k in TASKS])
    return ranked.select("crop_id", "rn", F.posexplode(tasks).alias("i", "task_key")).select(
        "crop_id", "task_key", ((F.col("rn") - 1) * len(TASKS) + F.col("i")).cast("bigint").alias("ix"))


@query("j20_source_slots", """p AS (SELECT route_id, n_goal, k.k AS kind, CAST(route_id % n_goal AS INT) AS kin, CAST(1 + route_id % n_goal AS INT) AS j FROM fx_routes,
      (SELECT unnest(['first', 'step', 'reach', 'back', 'origin', 'draw']) AS k) k),
    s AS (SELECT *, CAST(CASE WHEN kind = 'first' THEN -1 WHEN kind = 'step' THEN kin - 1 WHEN kind = 'reach' THEN n_goal - 2 WHEN kind = 'back' THEN 2 * n_goal - j - 1
      WHEN kind = 'origin' THEN 2 * n_goal - 2 ELSE 2 * n_goal - 1 END AS INT) AS slot FROM p)
    SELECT kind, count(*) AS n, count(*) FILTER (WHERE slot >= 0 AND (route_id + slot) % 3 <> 0) AS with_drawing, CAST(sum(slot) AS BIGINT) AS slot_sum FROM s GROUP BY 1""")
def source_slots(spark, sf):
    """Which stored drawing feeds which pass: the slot of the pass before it, joined with the drawings on (route, slot)."""
    kinds = F.array(*[F.lit(k) for k in ("first", "step", "reach", "back", "origin", "draw")])
    p = routes(spark, sf).select("route_id", "n_goal", F.explode(kinds).alias("kind"))
    k_in = F.when(F.col("kind") == "first", 0).when(F.col("kind") == "step", F.col("route_id") % F.col("n_goal")).otherwise(F.col("n_goal") - 1)
    j = F.when(F.col("kind") == "back", 1 + F.col("route_id") % F.col("n_goal")).otherwise(1)
    slots = p.withColumn("slot", wave.source_slot(F.col("kind"), k_in, j, F.col("n_goal")).cast("int"))
    stored = routes(spark, sf).selectExpr("route_id", "explode(sequence(0, 2 * n_goal)) AS slot").filter("(route_id + slot) % 3 <> 0").withColumn("has", F.lit(1))
    return slots.join(stored, ["route_id", "slot"], "left").groupBy("kind").agg(
        F.count("*").alias("n"), F.count("has").alias("with_drawing"), F.sum(F.col("slot").cast("bigint")).alias("slot_sum")
    )


@query("j21_missing_side_files", """r AS (SELECT DISTINCT p_type || '-' || p_brand AS task, s.s AS split FROM part, (SELECT unnest(['train', 'val']) AS s) s),
    h AS (SELECT DISTINCT p_type || '-' || p_brand AS task, CASE WHEN p_size % 2 = 0 THEN 'train' ELSE 'val' END AS split FROM part WHERE p_size < 5)
    SELECT r.task, r.split FROM r ANTI JOIN h USING (task, split)""")
def missing_side_files(spark, sf):
    part = fx.table(spark, sf, "part")
    required = part.selectExpr("p_type || '-' || p_brand AS task").distinct().select("task", F.explode(F.array(F.lit("train"), F.lit("val"))).alias("split"))
    present = part.filter("p_size < 5").selectExpr("p_type || '-' || p_brand AS task", "IF(p_size % 2 = 0, 'train', 'val') AS split")
    return checks.without_partner(required, present, ["task", "split"])


@query("j22_seeded_pairs", f"""n AS (SELECT count(*) AS n FROM fx_markers), p AS (SELECT route_id AS pair, CAST(floor({draw_sql('route_id', salt=51)} * n.n) AS BIGINT) AS crop_id,
      CAST(floor({draw_sql('route_id', salt=52)} * 4) AS INT) AS task FROM fx_routes, n) SELECT pair, p.crop_id, task, m.mrow FROM p JOIN fx_markers m USING (crop_id)""")
def seeded_pairs(spark, sf):
    markers = fx.view(spark, sf, "fx_markers")
    n = markers.agg(F.count("*")).scalar()
    picks = routes(spark, sf).select(
        F.col("route_id").alias("pair"), F.floor(draw(F.col("route_id"), salt=51) * n).alias("crop_id"), F.floor(draw(F.col("route_id"), salt=52) * 4).cast("int").alias("task")
    )
    return picks.join(markers, "crop_id").select("pair", "crop_id", "task", "mrow")


@query("j23_items_with_labels", """SELECT r.route_id, f.surface AS label FROM fx_routes r JOIN fx_raster f ON f.crop_id = r.crop_id AND f.row = CAST(floor(r.sy) AS INT) AND f.col = CAST(floor(r.sx) AS INT)""")
def items_with_labels(spark, sf):
    items = routes(spark, sf).selectExpr("route_id", "crop_id", "CAST(floor(sy) AS INT) AS row", "CAST(floor(sx) AS INT) AS col")
    files = fx.table(spark, sf, "supplier").selectExpr("s_suppkey AS crop_id")
    checks.require_empty(checks.without_partner(items.select("crop_id"), files, ["crop_id"]), "label file is missing")
    cells = fx.view(spark, sf, "fx_raster").select("crop_id", "row", "col", F.col("surface").alias("label"))
    return items.join(cells, ["crop_id", "row", "col"]).select("route_id", "label")


@query("w15_first_marker", "SELECT crop_id, arg_min(route_id, route_id) AS item, arg_min(sx, route_id) AS x, arg_min(sy, route_id) AS y FROM fx_routes GROUP BY 1")
def first_marker(spark, sf):
    r = routes(spark, sf)
    crops = fx.table(spark, sf, "supplier").selectExpr("s_suppkey AS crop_id")
    checks.require_empty(checks.without_partner(crops, r.select("crop_id"), ["crop_id"]), "crop without a marker")
    return sp.first_marker(r, "crop_id", "route_id", ["route_id", "sx", "sy"]).withColumnsRenamed({"route_id": "item", "sx": "x", "sy": "y"})


@query("p25_task_keys", """a AS (SELECT DISTINCT p_type AS layer, p_size % 4 AS cls FROM part),
    c AS (SELECT x.layer || '_' || x.cls AS ka, y.layer || '_' || y.cls AS kb FROM a x JOIN a y ON x.layer < y.layer)
    SELECT least(ka, kb) || '+' || greatest(ka, kb) AS task_key FROM c""")
def task_keys(spark, sf):
    """Two-atom conditions over a dimension of known atoms; both atoms on different layers, names in canonical order."""
    atoms = fx.table(spark, sf, "part").selectExpr("p_type AS layer", "concat(p_type, '_', p_size % 4) AS key").distinct()
    return sp.atom_pairs(atoms).select(F.array_join(F.array_sort(F.array("ka", "kb")), "+").alias("task_key"))


@query("p26_wrong_description", """SELECT crop_id, row, col, CAST((surface + 1) % 4 AS INT) AS wrong_class FROM fx_raster""")
def wrong_description(spark, sf):
    return fx.view(spark, sf, "fx_raster").select("crop_id", "row", "col", ((F.col("surface") + 1) % 4).cast("int").alias("wrong_class"))


@query("p23_prompts", """SELECT route_id, 'What is the ground surface at the point (x=' || CAST(CAST(round(floor(sx) / 31 * 1000) AS INT) AS VARCHAR) || ', y=' || CAST(CAST(round(floor(sy) / 31 * 1000) AS INT) AS VARCHAR)
    || ')? Answer with exactly one of: "none", "roadway", "sidewalk", "building".' AS prompt, '<surface:' || CAST(route_id % 4 AS VARCHAR) || '>' AS target_token,
    ['none', 'roadway', 'sidewalk', 'building'][route_id % 4 + 1] AS target FROM fx_routes""")
def prompts(spark, sf):
    from cellweave.functions.texts import point_prompt, target_token, target_word

    r = routes(spark, sf)
    x, y = F.floor("sx") / 31 * 1000, F.floor("sy") / 31 * 1000
    cls = (F.col("route_id") % 4).cast("int")
    return r.select("route_id", point_prompt("ground surface", x, y).alias("prompt"), target_token("surface", cls).alias("target_token"), target_word(cls).alias("target"))
