"""Sun, shadows, reprojection, interpolation and morphology."""

from __future__ import annotations

from pyspark.sql import functions as F

from cellweave.functions import geo, solar
from cellweave.operators import grids, ranking, sky
from cellweave.plans import fixtures as fx
from cellweave.plans.registry import query

LAT, LON = 52.35, 4.89
JUNE_21 = 1782000000  # 2026-06-21 00:00 UTC


@query("p14_reprojection", f"""p AS (SELECT c_custkey AS id, 52.3 + c_custkey % 100 * 0.001 AS lat, 4.8 + c_custkey % 77 * 0.002 AS lon FROM customer),
    q AS (SELECT *, (lat - {geo.LAT0}) * 0.36 AS a, (lon - {geo.LON0}) * 0.36 AS b FROM (SELECT id, CAST(lat AS DOUBLE) AS lat, CAST(lon AS DOUBLE) AS lon FROM p)),
    m AS (SELECT *, {geo.poly_sql('a', 'b', geo.TO_X)} + {geo.X0} AS x, {geo.poly_sql('a', 'b', geo.TO_Y)} + {geo.Y0} AS y FROM q),
    i AS (SELECT *, (x - {geo.X0}) * 1e-5 AS u, (y - {geo.Y0}) * 1e-5 AS v FROM m)
    SELECT id, round(x, 3) AS x, round(y, 3) AS y, round(({geo.poly_sql('u', 'v', geo.TO_LAT)}) / 3600 + {geo.LAT0}, 6) AS lat_back,
    round(({geo.poly_sql('u', 'v', geo.TO_LON)}) / 3600 + {geo.LON0}, 6) AS lon_back FROM i""")
def reprojection(spark, sf):
    pts = fx.table(spark, sf, "customer").selectExpr(
        "c_custkey AS id", "CAST(52.3 + c_custkey % 100 * 0.001 AS DOUBLE) AS lat", "CAST(4.8 + c_custkey % 77 * 0.002 AS DOUBLE) AS lon"
    )
    x, y = geo.to_metric(F.col("lat"), F.col("lon"))
    m = pts.withColumns({"x": x, "y": y})
    lat, lon = geo.to_wgs84(F.col("x"), F.col("y"))
    return m.select("id", F.round("x", 3).alias("x"), F.round("y", 3).alias("y"), F.round(lat, 6).alias("lat_back"), F.round(lon, 6).alias("lon_back"))


@query("p14_bbox_envelope", f"""c AS (SELECT c_nationkey AS district, 52.3 + c_nationkey * 0.01 + i * 0.012 AS lat, 4.8 + c_nationkey * 0.013 + j * 0.02 AS lon
      FROM (SELECT DISTINCT c_nationkey FROM customer), (SELECT unnest([0, 1]) AS i) i, (SELECT unnest([0, 1]) AS j) j),
    q AS (SELECT district, (CAST(lat AS DOUBLE) - {geo.LAT0}) * 0.36 AS a, (CAST(lon AS DOUBLE) - {geo.LON0}) * 0.36 AS b FROM c),
    m AS (SELECT district, {geo.poly_sql('a', 'b', geo.TO_X)} + {geo.X0} AS x, {geo.poly_sql('a', 'b', geo.TO_Y)} + {geo.Y0} AS y FROM q)
    SELECT district, round(min(x), 3) AS x0, round(min(y), 3) AS y0, round(max(x), 3) AS x1, round(max(y), 3) AS y1 FROM m GROUP BY 1""")
def bbox_envelope(spark, sf):
    corners = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (0, 1) for j in (0, 1)])
    c = fx.table(spark, sf, "customer").select(F.col("c_nationkey").alias("district")).distinct().select("district", F.explode(corners).alias("k")).selectExpr(
        "district", "CAST(52.3 + district * 0.01 + k.i * 0.012 AS DOUBLE) AS lat", "CAST(4.8 + district * 0.013 + k.j * 0.02 AS DOUBLE) AS lon"
    )
    x, y = geo.to_metric(F.col("lat"), F.col("lon"))
    return c.select("district", x.alias("x"), y.alias("y")).groupBy("district").agg(
        F.round(F.min("x"), 3).alias("x0"), F.round(F.min("y"), 3).alias("y0"), F.round(F.max("x"), 3).alias("x1"), F.round(F.max("y"), 3).alias("y1")
    )


@query("p19_sun_position", f"""SELECT event_id, round(elevation, 6) AS elevation, round(azimuth, 5) AS azimuth FROM
    {solar.sun_sql(LAT, LON, '(SELECT event_id, epoch_us(ts) / 1000000.0 AS sec FROM events)', 'sec')}""")
def sun_position(spark, sf):
    ev = fx.table(spark, sf, "events").select("event_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1000000.0).alias("sec"))
    el, az = solar.sun_position(LAT, LON, F.col("sec"))
    return ev.select("event_id", F.round(el, 6).alias("elevation"), F.round(az, 5).alias("azimuth"))


@query("p20_day_summary", f"""d AS (SELECT DISTINCT CAST(ts AS DATE) AS day FROM events), m AS (SELECT day, unnest(range(1440)) AS minute FROM d),
    s AS (SELECT day, minute, elevation, azimuth FROM {solar.sun_sql(LAT, LON, '(SELECT *, epoch(CAST(day AS TIMESTAMP)) + minute * 60 AS sec FROM m)', 'sec')})
    SELECT day, CAST(arg_max(minute, (round(elevation, 9), -minute)) AS INT) AS noon_minute, round(max(elevation), 4) AS max_elevation,
    round(count(*) FILTER (WHERE elevation > -0.833) / 60.0, 6) AS day_length_h FROM s GROUP BY 1""")
def day_summary(spark, sf):
    days = fx.table(spark, sf, "events").select(F.to_date("ts").alias("day")).distinct()
    minutes = days.select("day", F.explode(F.sequence(F.lit(0), F.lit(1439))).alias("minute")).withColumn(
        "sec", F.datediff("day", F.lit("1970-01-01").cast("date")) * 86400.0 + F.col("minute") * 60
    )
    el, _ = solar.sun_position(LAT, LON, F.col("sec"))
    return minutes.withColumn("el", el).groupBy("day").agg(
        F.max_by("minute", F.struct(F.round("el", 9), -F.col("minute"))).alias("noon_minute"), F.round(F.max("el"), 4).alias("max_elevation"),
        F.round(F.count_if(F.col("el") > solar.SUNRISE_DEG) / 60.0, 6).alias("day_length_h"),
    )


HEIGHT_SQL = "ht AS MATERIALIZED (SELECT crop_id, row, col, surface = 3 AS built, CASE WHEN surface = 3 THEN 3 + (crop_id + row // 8 + col // 8) % 9 ELSE 0 END AS height FROM fx_raster)"
SUNS_SQL = f"""suns AS MATERIALIZED (SELECT instant, tan(radians(elevation)) AS t, cos(radians(azimuth)) AS ca, sin(radians(azimuth)) AS sa FROM
    {solar.sun_sql(LAT, LON, f'(SELECT i AS instant, {JUNE_21} + (i + 0.5) * 3600 AS sec FROM (SELECT unnest(range(24)) AS i))', 'sec')} WHERE elevation > 0)"""
SHADOW_SQL = HEIGHT_SQL + ", " + SUNS_SQL + """, kk AS (SELECT h.crop_id, h.row, h.col, h.height, s.*, unnest(range(1, CAST(floor(height / t) AS BIGINT) + 1)) AS k FROM ht h, suns s WHERE height > 0),
    dark AS MATERIALIZED (SELECT DISTINCT crop_id, CAST(row - round_even(-k * ca, 0) AS INT) AS row, CAST(col - round_even(k * sa, 0) AS INT) AS col, instant FROM kk WHERE height > k * t)"""


def heights(spark, sf):
    return fx.view(spark, sf, "fx_raster").selectExpr(
        "crop_id", "row", "col", "surface = 3 AS built", "IF(surface = 3, 3 + (crop_id + row DIV 8 + col DIV 8) % 9, 0) AS height"
    )


@query("r06_shadow_cells", SHADOW_SQL + """ SELECT h.crop_id, d.instant, count(*) AS dark_ground FROM ht h JOIN dark d USING (crop_id, row, col) WHERE NOT built GROUP BY 1, 2""")
def shadow_cells(spark, sf):
    suns = sky.instants(spark, JUNE_21, 60, LAT, LON)
    h = heights(spark, sf)
    dark = sky.shadows(h, suns, ["crop_id"])
    return h.filter("NOT built").join(dark, ["crop_id", "row", "col"]).groupBy("crop_id", "instant").agg(F.count("*").alias("dark_ground"))


@query("r07_sunlit_hours", SHADOW_SQL + """, dk AS (SELECT crop_id, row, col, count(*) AS d FROM dark GROUP BY 1, 2, 3)
    SELECT h.crop_id, h.row, h.col, CAST(CASE WHEN NOT built THEN (SELECT count(*) FROM suns) - coalesce(d, 0) END AS DOUBLE) AS hours
    FROM ht h LEFT JOIN dk USING (crop_id, row, col)""")
def sunlit_hours(spark, sf):
    return sky.sunlit_hours(heights(spark, sf), sky.instants(spark, JUNE_21, 60, LAT, LON), ["crop_id"], 60)


@query("r04_dilate_erode", """w AS (SELECT crop_id, row, col, surface = 2 AS lit, surface <> 3 AS free FROM fx_raster),
    n AS (SELECT a.crop_id, a.row, a.col, bool_or(b.lit) AS dil, count(*) FILTER (WHERE b.free) = 9 AS ero FROM w a JOIN w b ON a.crop_id = b.crop_id
      AND abs(a.row - b.row) <= 1 AND abs(a.col - b.col) <= 1 GROUP BY 1, 2, 3)
    SELECT crop_id, count(*) FILTER (WHERE dil) AS dilated, count(*) FILTER (WHERE ero) AS eroded, CAST(sum(CASE WHEN dil THEN row * 32 + col END) AS BIGINT) AS dil_sum,
    CAST(sum(CASE WHEN ero THEN row * 32 + col END) AS BIGINT) AS ero_sum FROM n GROUP BY 1""")
def dilate_erode(spark, sf):
    r = fx.view(spark, sf, "fx_raster")
    ix = F.sum((F.col("row") * 32 + F.col("col")).cast("bigint"))
    d = grids.dilate(r.filter("surface = 2").select("crop_id", "row", "col"), ["crop_id"], 3, 32).groupBy("crop_id").agg(
        F.count("*").alias("dilated"), ix.alias("dil_sum"))
    e = grids.erode(r.filter("surface <> 3").select("crop_id", "row", "col"), ["crop_id"], 3).groupBy("crop_id").agg(
        F.count("*").alias("eroded"), ix.alias("ero_sum"))
    return d.join(e, "crop_id")


@query("a21_fill_ground", """o AS MATERIALIZED (SELECT crop_id, row, col, CASE WHEN surface <> 3 THEN CAST(noise7 AS DOUBLE) END AS h FROM fx_raster),
    f AS (SELECT a.crop_id, a.row, a.col, sum(b.h / ((a.row - b.row) * (a.row - b.row) + (a.col - b.col) * (a.col - b.col)))
      / sum(1.0 / ((a.row - b.row) * (a.row - b.row) + (a.col - b.col) * (a.col - b.col))) AS v FROM o a JOIN o b ON a.crop_id = b.crop_id AND a.h IS NULL AND b.h IS NOT NULL
      AND b.row BETWEEN a.row - 2 AND a.row + 2 AND b.col BETWEEN a.col - 2 AND a.col + 2 AND (a.row - b.row) * (a.row - b.row) + (a.col - b.col) * (a.col - b.col) <= 4 GROUP BY 1, 2, 3)
    SELECT o.crop_id, o.row, o.col, round(coalesce(h, v), 6) AS ground, h IS NOT NULL AS observed FROM o LEFT JOIN f USING (crop_id, row, col)""")
def fill_ground(spark, sf):
    from cellweave.operators.terrain import fill_ground as fill

    cells = fx.view(spark, sf, "fx_raster").selectExpr("crop_id", "row", "col", "IF(surface <> 3, CAST(noise7 AS DOUBLE), NULL) AS height")
    return fill(cells, ["crop_id"], 2.0).withColumn("ground", F.round("ground", 6))


@query("a19_source_cross_check", """p AS (SELECT route_id, teacher_m, crop_id, sx, sy FROM fx_routes),
    v AS (SELECT teacher_m AS a, teacher_m + noise7 - 3 AS b FROM p JOIN fx_raster r ON r.crop_id = p.crop_id AND r.row = floor(sy) AND r.col = floor(sx))
    SELECT count(*) AS n, round(corr(a, b), 6) AS r, round(quantile_cont(abs(b - a), 0.5), 6) AS median_abs, round(quantile_cont(b - a, 0.5), 6) AS median_diff,
    round(quantile_cont(b - a, 0.05), 6) AS p5, round(quantile_cont(b - a, 0.95), 6) AS p95 FROM v""")
def source_cross_check(spark, sf):
    from cellweave.operators.terrain import cross_check

    pts = fx.view(spark, sf, "fx_routes").selectExpr(
        "route_id", "crop_id", "teacher_m", "CAST(floor(sy) AS INT) AS row", "CAST(floor(sx) AS INT) AS col")
    cells = fx.view(spark, sf, "fx_raster").select("crop_id", "row", "col", "noise7")
    both = pts.join(cells, ["crop_id", "row", "col"]).selectExpr("teacher_m AS a", "teacher_m + noise7 - 3 AS b")
    return cross_check(both)


@query("p31_upsample", "SELECT crop_id, CAST(row * 2 + i // 2 AS INT) AS row, CAST(col * 2 + i % 2 AS INT) AS col, surface FROM (SELECT *, unnest(range(4)) AS i FROM fx_raster)")
def upsample(spark, sf):
    return grids.upsample(fx.view(spark, sf, "fx_raster").select("crop_id", "row", "col", "surface"), 2)


@query("p29_cell_addressing", """SELECT route_id, CAST(CAST(floor(sy) AS INT) // 4 AS INT) AS cell_row, CAST(CAST(floor(sx) AS INT) // 4 AS INT) AS cell_col,
    CAST(CAST(floor(sy) AS INT) // 8 * 4 + CAST(floor(sx) AS INT) // 8 AS INT) AS patch, CAST((CAST(floor(sy) AS INT) // 4 % 2) * 2 + CAST(floor(sx) AS INT) // 4 % 2 AS INT) AS sub_cell,
    CAST(greatest(CAST(floor(sy) AS INT) // 4 - 1, 0) AS INT) AS block_r0, CAST(least(CAST(floor(sy) AS INT) // 4 + 1, 7) AS INT) AS block_r1,
    CAST(greatest(CAST(floor(sx) AS INT) // 4 - 1, 0) AS INT) AS block_c0, CAST(least(CAST(floor(sx) AS INT) // 4 + 1, 7) AS INT) AS block_c1 FROM fx_routes""")
def cell_addressing(spark, sf):
    at = fx.view(spark, sf, "fx_routes").selectExpr("route_id", "CAST(floor(sy) AS INT) AS r", "CAST(floor(sx) AS INT) AS c")
    return at.selectExpr(
        "route_id", "CAST(r DIV 4 AS INT) AS cell_row", "CAST(c DIV 4 AS INT) AS cell_col", "CAST(r DIV 8 * 4 + c DIV 8 AS INT) AS patch",
        "CAST(r DIV 4 % 2 * 2 + c DIV 4 % 2 AS INT) AS sub_cell", "CAST(greatest(r DIV 4 - 1, 0) AS INT) AS block_r0", "CAST(least(r DIV 4 + 1, 7) AS INT) AS block_r1",
        "CAST(greatest(c DIV 4 - 1, 0) AS INT) AS block_c0", "CAST(least(c DIV 4 + 1, 7) AS INT) AS block_c1",
    )


@query("p30_palette", """SELECT CAST([0, 85, 170, 255][surface + 1] AS INT) AS grey, ['#E4E0D2', '#B7BEC8', '#E9D6A9', '#343A46'][surface + 1] AS colour, count(*) AS n FROM fx_raster GROUP BY 1, 2""")
def palette(spark, sf):
    counts = fx.view(spark, sf, "fx_raster").groupBy("surface").agg(F.count("*").alias("n"))
    # Grey and colour per surface class
    grey = F.array(*[F.lit(g) for g in (0, 85, 170, 255)])
    colour = F.array(*[F.lit(c) for c in ("#E4E0D2", "#B7BEC8", "#E9D6A9", "#343A46")])
    return counts.select(F.element_at(grey, F.col("surface") + 1).alias("grey"), F.element_at(colour, F.col("surface") + 1).alias("colour"), "n")


@query("p27_disallowed_values", """SELECT noise7 AS value, count(*) AS n FROM fx_raster WHERE noise7 NOT IN (0, 1, 2, 3, 4, 5) GROUP BY 1""")
def disallowed_values(spark, sf):
    from cellweave.operators.checks import disallowed

    return disallowed(fx.view(spark, sf, "fx_raster"), "noise7", range(6)).withColumnRenamed("noise7", "value")


@query("p28_frames_aligned", """a AS (SELECT crop_id, min(row) AS r0, max(row) AS r1, min(col) AS c0, max(col) AS c1, count(*) AS n FROM fx_raster GROUP BY 1),
    b AS (SELECT crop_id, min(row) AS r0, max(row) AS r1, min(col) AS c0, max(col) AS c1, count(*) AS n FROM fx_raster WHERE NOT (crop_id % 7 = 0 AND row = 31) GROUP BY 1)
    SELECT crop_id, a.r0 = b.r0 AND a.r1 = b.r1 AND a.c0 = b.c0 AND a.c1 = b.c1 AND a.n = b.n AS aligned FROM a JOIN b USING (crop_id)""")
def frames_aligned(spark, sf):
    from cellweave.operators.checks import frames_equal

    r = fx.view(spark, sf, "fx_raster").select("crop_id", "row", "col")
    return frames_equal(r, r.filter("NOT (crop_id % 7 = 0 AND row = 31)"), ["crop_id"])
