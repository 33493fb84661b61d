"""Vector layers to cells, point-in-polygon, overlaps, areas."""

from __future__ import annotations

from pyspark.sql import functions as F

from cellweave.functions import places as pl
from cellweave.operators import raster as rs
from cellweave.plans import fixtures as fx
from cellweave.plans.q_places import CLASS_SQL
from cellweave.plans.registry import query
from cellweave.session import cut_lineage


def triangles(spark, sf):
    pt = "struct({0} AS x, {1} AS y)"
    ring = ", ".join(pt.format(f"x{k}", f"y{k}") for k in "abc")
    return fx.view(spark, sf, "fx_tris").selectExpr("district", "bid", "class", "level", f"array(array({ring})) AS rings")


def rect_polys(spark, sf):
    return fx.view(spark, sf, "fx_rects").selectExpr(
        "district", "bid", "level", "height_m", "w * h AS area",
        """array(array(struct(x0 + 0D AS x, y0 + 0D AS y), struct(x0 + w + 0D AS x, y0 + 0D AS y),
           struct(x0 + w + 0D AS x, y0 + h + 0D AS y), struct(x0 + 0D AS x, y0 + h + 0D AS y))) AS rings""",
    )


def boxes(spark, sf):
    return fx.view(spark, sf, "fx_rects").selectExpr("district", "bid", "x0", "y0", "x0 + w AS x1", "y0 + h AS y1", "level")


EDGE_SQL = """edge AS (SELECT bid, district, class, level, unnest([xa, xb, xc]) AS x1, unnest([ya, yb, yc]) AS y1,
      unnest([xb, xc, xa]) AS x2, unnest([yb, yc, ya]) AS y2, least(xa, xb, xc) AS bx0, greatest(xa, xb, xc) AS bx1,
      least(ya, yb, yc) AS by0, greatest(ya, yb, yc) AS by1 FROM fx_tris),
    box AS (SELECT *, unnest(range(CAST(by0 AS BIGINT), CAST(by1 AS BIGINT))) AS r FROM edge),
    px AS (SELECT *, unnest(range(CAST(bx0 AS BIGINT), CAST(bx1 AS BIGINT))) AS c FROM box),
    tri AS (SELECT district, bid, class, level, CAST(r AS INT) AS row, CAST(c AS INT) AS col FROM px GROUP BY ALL
      HAVING count(*) FILTER (WHERE y1 <> y2 AND (y1 > r + 0.5) <> (y2 > r + 0.5)
        AND x1 + (r + 0.5 - y1) * (x2 - x1) / (y2 - y1) > c + 0.5) % 2 = 1),
    rc AS (SELECT district, bid, height_m, level, CAST(row AS INT) AS row, CAST(unnest(range(x0, x0 + w)) AS INT) AS col FROM (SELECT *,
      unnest(range(y0, y0 + h)) AS row FROM fx_rects))"""
PAINT_SQL = EDGE_SQL + """, paint AS (SELECT district, row, col, class AS value, FALSE AS is_building,
      CASE WHEN level < 0 THEN -1 ELSE 0 END AS tun, class, bid FROM tri WHERE class > 0
      UNION ALL SELECT district, row, col, 3, TRUE, 0, 3, bid FROM rc),
    surf AS (SELECT district, row, col, arg_max(value, (is_building, tun, class, bid)) AS surface FROM paint GROUP BY 1, 2, 3)"""


def surface_cells(spark, sf):
    """Ground polygons painted tunnels first, then by class; buildings on top."""
    tri = triangles(spark, sf).filter("class > 0")
    ground = rs.span_cells(rs.spans(tri, ["district", "bid", "class", "level"])).selectExpr(
        "district", "row", "col", "class AS surface", "false AS is_building", "IF(level < 0, -1, 0) AS tun", "class", "bid"
    )
    built = rs.span_cells(rs.spans(rect_polys(spark, sf), ["district", "bid"])).selectExpr(
        "district", "row", "col", "3 AS surface", "true AS is_building", "0 AS tun", "3 AS class", "bid"
    )
    return rs.paint(ground.unionByName(built), ["district"], "surface", ["is_building", "tun", "class", "bid"])


@query("a01_burn_polygons", PAINT_SQL + " SELECT district, row, col, surface FROM surf")
def burn_polygons(spark, sf):
    return surface_cells(spark, sf)


@query("a01_cells_per_polygon", EDGE_SQL + """ SELECT district, bid, count(*) AS cells, CAST(sum(row) AS BIGINT) AS sum_row,
    CAST(sum(col) AS BIGINT) AS sum_col FROM tri GROUP BY 1, 2""")
def cells_per_polygon(spark, sf):
    runs = rs.spans(triangles(spark, sf), ["district", "bid"])
    n = (F.col("c1") - F.col("c0") + 1).cast("bigint")
    return runs.groupBy("district", "bid").agg(
        F.sum(n).alias("cells"), F.sum(n * F.col("row")).alias("sum_row"),
        F.sum((n * (F.col("c0") + F.col("c1")) / 2).cast("bigint")).alias("sum_col"),
    )


@query("a02_burn_place_discs", f"""p AS (SELECT district, x, y, CASE {CLASS_SQL} WHEN 'services' THEN 1 WHEN 'shop' THEN 2
      WHEN 'food&drink' THEN 3 END AS cls FROM fx_poi_a WHERE name IS NOT NULL),
    o AS (SELECT a.a AS dy, b.b AS dx FROM (SELECT unnest(range(-3, 4)) AS a) a, (SELECT unnest(range(-3, 4)) AS b) b)
    SELECT district, CAST(floor(y) + dy AS INT) AS row, CAST(floor(x) + dx AS INT) AS col, max(cls) AS cls FROM p, o
    WHERE cls IS NOT NULL AND (floor(x) + dx + 0.5 - x) * (floor(x) + dx + 0.5 - x) + (floor(y) + dy + 0.5 - y) * (floor(y) + dy + 0.5 - y) <= 4
    GROUP BY 1, 2, 3""")
def burn_place_discs(spark, sf):
    return rs.burn_points(label_places(spark, sf), ["district"], 2.0, "cls")


def label_places(spark, sf):
    cls = pl.label_class(pl.coarse_class(F.col("key"), F.col("value")))
    return fx.view(spark, sf, "fx_poi_a").filter("name IS NOT NULL").select("district", "id", "x", "y", cls.alias("cls")).filter("cls IS NOT NULL")


ESTAB_SQL = f"""p AS (SELECT district, id, x, y, CASE {CLASS_SQL} WHEN 'services' THEN 1 WHEN 'shop' THEN 2
      WHEN 'food&drink' THEN 3 END AS cls FROM fx_poi_a WHERE name IS NOT NULL), pc AS (SELECT * FROM p WHERE cls IS NOT NULL),
    hit AS (SELECT pc.*, r.bid, r.w * r.h AS area, r.x0, r.y0, r.w, r.h FROM pc JOIN fx_rects r ON r.district = pc.district
      AND pc.x >= r.x0 AND pc.x < r.x0 + r.w AND pc.y >= r.y0 AND pc.y < r.y0 + r.h)"""


def establishments(spark, sf):
    pts, polys = label_places(spark, sf), rect_polys(spark, sf)
    inside = rs.hosts(pts, polys, ["district"], "id", "bid")
    hits = pts.join(inside, ["district", "id"]).join(polys.select("district", "bid", "area"), ["district", "bid"])
    return pts, polys, cut_lineage(hits)  # several branches read it


CAP_M2 = 150.0


@query("a03_places_in_hosts", ESTAB_SQL + """,
    small AS (SELECT district, x0, y0, w, h, bid, max(cls) AS cls FROM hit WHERE area <= 150 GROUP BY ALL),
    o AS (SELECT a.a AS dy, b.b AS dx FROM (SELECT unnest(range(-8, 9)) AS a) a, (SELECT unnest(range(-8, 9)) AS b) b),
    host_cells AS (SELECT district, row, CAST(unnest(range(x0, x0 + w)) AS INT) AS col, cls, 0 AS late FROM (SELECT *,
      CAST(unnest(range(y0, y0 + h)) AS INT) AS row FROM small)),
    disc AS (SELECT district, x, y, cls, 150.0 / pi() AS r2, bid, x0, y0, w, h FROM hit WHERE area > 150
      UNION ALL SELECT district, x, y, cls, 4.0, NULL, NULL, NULL, NULL, NULL FROM pc WHERE id NOT IN (SELECT id FROM hit)),
    disc_cells AS (SELECT district, CAST(floor(y) + dy AS INT) AS row, CAST(floor(x) + dx AS INT) AS col, cls, 1 AS late FROM disc, o
      WHERE (floor(x) + dx + 0.5 - x) * (floor(x) + dx + 0.5 - x) + (floor(y) + dy + 0.5 - y) * (floor(y) + dy + 0.5 - y) <= r2
      AND (bid IS NULL OR (floor(x) + dx >= x0 AND floor(x) + dx < x0 + w AND floor(y) + dy >= y0 AND floor(y) + dy < y0 + h)))
    SELECT district, row, col, arg_max(cls, (late, cls)) AS cls FROM (SELECT * FROM host_cells UNION ALL SELECT * FROM disc_cells)
    GROUP BY 1, 2, 3""")
def places_in_hosts(spark, sf):
    """Host footprint takes its highest class; hosts above the cap get a cap-area disc clipped to the footprint."""
    pts, polys, hits = establishments(spark, sf)
    small = hits.filter(F.col("area") <= CAP_M2).groupBy("district", "bid").agg(F.max("cls").alias("cls"))
    runs = rs.spans(polys.join(hits.select("district", "bid").distinct(), ["district", "bid"], "left_semi"), ["district", "bid"])
    cells = cut_lineage(rs.span_cells(runs))
    host_cells = cells.join(small, ["district", "bid"]).selectExpr("district", "row", "col", "cls", "0 AS late")
    outside = pts.join(hits.select("district", "id"), ["district", "id"], "left_anti")
    loose = rs.burn_points(outside, ["district"], 2.0, "cls").withColumn("late", F.lit(1))
    big = hits.filter(F.col("area") > CAP_M2)
    capped = rs.burn_points(big, ["district", "bid"], (CAP_M2 / 3.141592653589793) ** 0.5, "cls").join(
        cells, ["district", "bid", "row", "col"], "left_semi"
    ).withColumn("late", F.lit(1)).drop("bid")
    return rs.paint(host_cells.unionByName(loose).unionByName(capped), ["district"], "cls", ["late", "cls"])


@query("a03_host_statistics", ESTAB_SQL + """, per AS (SELECT district, bid, max(area) AS area, count(*) AS n, count(DISTINCT cls) AS k FROM hit
      GROUP BY 1, 2)
    SELECT count(*) AS hosts, count(*) FILTER (WHERE n > 1) AS multi, count(*) FILTER (WHERE k > 1) AS mixed,
    count(*) FILTER (WHERE area > 150) AS over_cap, CAST(sum(n) FILTER (WHERE area > 150) AS BIGINT) AS in_capped,
    (SELECT count(DISTINCT id) FROM hit) AS inside, (SELECT count(*) FROM pc) - (SELECT count(DISTINCT id) FROM hit) AS outside,
    round(quantile_cont(area, 0.5) FILTER (WHERE area <= 150), 6) AS median_m2 FROM per""")
def host_statistics(spark, sf):
    from cellweave.operators.ranking import exact_percentiles

    pts, _, hits = establishments(spark, sf)
    per = hits.groupBy("district", "bid").agg(
        F.max("area").alias("area"), F.count("*").alias("n"), F.countDistinct("cls").alias("k")
    ).withColumn("all", F.lit(1))
    base = per.groupBy("all").agg(
        F.count("*").alias("hosts"), F.count_if(F.col("n") > 1).alias("multi"), F.count_if(F.col("k") > 1).alias("mixed"),
        F.count_if(F.col("area") > CAP_M2).alias("over_cap"), F.sum(F.when(F.col("area") > CAP_M2, F.col("n"))).alias("in_capped"),
    )
    inside = hits.select("id").distinct().agg(F.count("*")).scalar()
    total = pts.agg(F.count("*")).scalar()
    median = exact_percentiles(per.filter(F.col("area") <= CAP_M2), ["all"], "area", [0.5])
    return base.join(median, "all", "left").select(
        *base.columns[1:], inside.alias("inside"), (total - inside).alias("outside"), F.round("p50", 6).alias("median_m2")
    )


@query("a04_height_raster", EDGE_SQL + """ SELECT district, row, col, max(height_m) AS height_m, TRUE AS is_building FROM rc
    GROUP BY 1, 2, 3""")
def height_raster(spark, sf):
    cells = rs.span_cells(rs.spans(rect_polys(spark, sf), ["district", "bid", "height_m"]))
    return cells.groupBy("district", "row", "col").agg(F.max("height_m").alias("height_m")).withColumn("is_building", F.lit(True))


@query("j05_point_in_polygon", EDGE_SQL + """, hit AS (SELECT p.district, p.id, e.bid FROM fx_poi_a p JOIN edge e
      ON e.district = p.district AND p.x BETWEEN e.bx0 AND e.bx1 AND p.y BETWEEN e.by0 AND e.by1
      GROUP BY 1, 2, 3 HAVING count(*) FILTER (WHERE e.y1 <> e.y2 AND (e.y1 > p.y) <> (e.y2 > p.y)
        AND p.x < e.x1 + (p.y - e.y1) * (e.x2 - e.x1) / (e.y2 - e.y1)) % 2 = 1)
    SELECT p.district, p.id, hit.bid FROM fx_poi_a p LEFT JOIN hit USING (district, id)""")
def point_in_polygon(spark, sf):
    pts = fx.view(spark, sf, "fx_poi_a").select("district", "id", "x", "y")
    hit = rs.hosts(pts, triangles(spark, sf), ["district"], "id", "bid")
    return pts.select("district", "id").join(hit, ["district", "id"], "left")


@query("j07_overlapping_pairs", """SELECT a.district, a.level = b.level AS same_level, count(*) AS pairs,
    CAST(sum((least(a.x0 + a.w, b.x0 + b.w) - greatest(a.x0, b.x0)) * (least(a.y0 + a.h, b.y0 + b.h) - greatest(a.y0, b.y0))) AS BIGINT) AS area
    FROM fx_rects a JOIN fx_rects b ON a.district = b.district AND a.bid < b.bid
    AND least(a.x0 + a.w, b.x0 + b.w) > greatest(a.x0, b.x0) AND least(a.y0 + a.h, b.y0 + b.h) > greatest(a.y0, b.y0)
    GROUP BY 1, 2""")
def overlapping_pairs(spark, sf):
    pairs = rs.overlapping_boxes(boxes(spark, sf), ["district"], "bid", ["level"])
    return pairs.groupBy("district", (F.col("a_level") == F.col("b_level")).alias("same_level")).agg(
        F.count("*").alias("pairs"), F.sum("area").alias("area")
    )


@query("a18_area_sum_and_union", EDGE_SQL + """, inb AS (SELECT * FROM rc WHERE row >= 50 AND row < 950 AND col >= 50 AND col < 950)
    SELECT district, level, count(*) AS area_sum, count(DISTINCT row * 100000 + col) AS area_union FROM inb GROUP BY 1, 2""")
def area_sum_and_union(spark, sf):
    """Area per level inside the box: all footprints added up, and every cell once."""
    runs = rs.spans(rect_polys(spark, sf), ["district", "level", "bid"]).filter("row >= 50 AND row < 950")
    runs = runs.withColumns({"c0": F.greatest("c0", F.lit(50)), "c1": F.least("c1", F.lit(949))}).filter("c0 <= c1")
    # copies of one cell are combined inside the tasks; the sum and the union come from one shuffle
    cells = rs.span_cells(runs).groupBy("district", "level", "row", "col").agg(F.count("*").alias("n"))
    return cells.groupBy("district", "level").agg(F.sum("n").alias("area_sum"), F.count("*").alias("area_union"))


@query("a20_mask_disagreement", """b AS (SELECT crop_id, surface = 3 AS a, noise7 >= 4 AS b FROM fx_raster)
    SELECT crop_id, round(avg(CASE WHEN a THEN 1.0 ELSE 0.0 END), 6) AS share_a, round(avg(CASE WHEN b THEN 1.0 ELSE 0.0 END), 6) AS share_b,
    round(avg(CASE WHEN a AND NOT b THEN 1.0 ELSE 0.0 END), 6) AS only_a, round(avg(CASE WHEN b AND NOT a THEN 1.0 ELSE 0.0 END), 6) AS only_b,
    round(avg(CASE WHEN a <> b THEN 1.0 ELSE 0.0 END), 6) AS disagree FROM b GROUP BY 1""")
def mask_disagreement(spark, sf):
    a, b = F.col("surface") == 3, F.col("noise7") >= 4

    def share(c, name):
        return F.round(F.avg(c.cast("double")), 6).alias(name)

    return fx.view(spark, sf, "fx_raster").groupBy("crop_id").agg(
        share(a, "share_a"), share(b, "share_b"), share(a & ~b, "only_a"), share(b & ~a, "only_b"), share(a != b, "disagree")
    )


@query("p07_half_open_box", "SELECT district, count(*) AS n FROM fx_poi_a WHERE x >= 100 AND x < 356 AND y > 100 AND y <= 356 GROUP BY 1")
def half_open_box(spark, sf):
    pts = fx.view(spark, sf, "fx_poi_a").filter("x >= 100 AND x < 356 AND y > 100 AND y <= 356")
    return pts.groupBy("district").agg(F.count("*").alias("n"))


@query("p09_polygons_touching_box", """c AS (SELECT *, least(xa, xb, xc) AS bx0, greatest(xa, xb, xc) AS bx1, least(ya, yb, yc) AS by0,
      greatest(ya, yb, yc) AS by1 FROM fx_tris), t AS (SELECT * FROM c WHERE bx1 >= 200 AND bx0 <= 456 AND by1 >= 200 AND by0 <= 456),
    e AS (SELECT bid, district, unnest([xa, xb, xc]) AS x1, unnest([ya, yb, yc]) AS y1, unnest([xb, xc, xa]) AS x2,
      unnest([yb, yc, ya]) AS y2 FROM t),
    ax AS (SELECT bid, district, bool_and((x2 - x1) * (200 - y1) - (y2 - y1) * (200 - x1) > 0 AND (x2 - x1) * (456 - y1) - (y2 - y1) * (200 - x1) > 0
        AND (x2 - x1) * (200 - y1) - (y2 - y1) * (456 - x1) > 0 AND (x2 - x1) * (456 - y1) - (y2 - y1) * (456 - x1) > 0) AS dummy,
      bool_or((x2 - x1) * (200 - y1) - (y2 - y1) * (200 - x1) < 0 AND (x2 - x1) * (456 - y1) - (y2 - y1) * (200 - x1) < 0
        AND (x2 - x1) * (200 - y1) - (y2 - y1) * (456 - x1) < 0 AND (x2 - x1) * (456 - y1) - (y2 - y1) * (456 - x1) < 0) AS parted
      FROM e GROUP BY 1, 2) SELECT bid, district FROM ax WHERE NOT parted""")
def polygons_touching_box(spark, sf):
    return rs.touching_box(triangles(spark, sf), ["bid", "district"], 200, 200, 456, 456)


@query("p12_label_classes", """SELECT CASE poi_class WHEN 'services' THEN 1 WHEN 'shop' THEN 2 WHEN 'food&drink' THEN 3 END AS cls, count(*) AS n
    FROM (SELECT """ + CLASS_SQL + """ AS poi_class FROM fx_poi_a) WHERE poi_class IN ('services', 'shop', 'food&drink') GROUP BY 1""")
def label_classes(spark, sf):
    cls = pl.label_class(pl.coarse_class(F.col("key"), F.col("value")))
    p = fx.view(spark, sf, "fx_poi_a").select(cls.alias("cls")).filter("cls IS NOT NULL")
    return p.groupBy("cls").agg(F.count("*").alias("n"))


@query("u02_union_of_feature_types", EDGE_SQL + """ SELECT feature, district, count(*) AS n FROM (SELECT 'surface' AS feature, district FROM fx_tris
    UNION ALL SELECT 'building', district FROM fx_rects UNION ALL SELECT 'place', district FROM fx_poi_a) GROUP BY 1, 2""")
def union_of_feature_types(spark, sf):
    from functools import reduce

    layers = {"surface": fx.view(spark, sf, "fx_tris"), "building": fx.view(spark, sf, "fx_rects"), "place": fx.view(spark, sf, "fx_poi_a")}
    parts = [d.select("district").withColumn("feature", F.lit(name)) for name, d in layers.items()]
    return reduce(lambda a, b: a.unionByName(b), parts).groupBy("feature", "district").agg(F.count("*").alias("n"))
