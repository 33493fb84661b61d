"""Components, chains, walking fields and what is derived from them."""

from __future__ import annotations

from pyspark.sql import functions as F

from cellweave.operators import frontier as fr
from cellweave.operators import grids
from cellweave.plans import fixtures as fx
from cellweave.plans.registry import query

SIDE = fx.SIDE
K = ["crop_id"]


def free(spark, sf):
    return fx.view(spark, sf, "fx_raster").filter("surface <> 3").select("crop_id", "row", "col")


def drawing(spark, sf):
    """Lit cells of one drawing per window: streets with gaps, and speckle."""
    return fx.view(spark, sf, "fx_raster").filter(
        "(surface = 2 AND noise7 <> 1) OR noise7 = 6"
    ).select("crop_id", "row", "col")


def walks(spark, sf):
    return fx.view(spark, sf, "fx_walks")


LIT_SQL = """draw AS (SELECT crop_id, row, col FROM fx_raster WHERE (surface = 2 AND noise7 <> 1) OR noise7 = 6),
    mk AS (SELECT crop_id, srow AS r, scol AS c FROM fx_walks UNION ALL SELECT crop_id, grow, gcol FROM fx_walks),
    lit AS MATERIALIZED (SELECT * FROM draw UNION SELECT f.crop_id, f.row, f.col FROM fx_raster f JOIN mk USING (crop_id) WHERE abs(f.row - mk.r) <= 1 AND abs(f.col - mk.c) <= 1)"""
OFFS_SQL = """off AS (SELECT a.a AS dy, b.b AS dx, a.a <> 0 AND b.b <> 0 AS diag FROM (SELECT unnest([-1, 0, 1]) AS a) a, (SELECT unnest([-1, 0, 1]) AS b) b
    WHERE a.a <> 0 OR b.b <> 0)"""


def _labels_sql(source: str, diagonal: bool) -> str:
    cond = "" if diagonal else " AND NOT off.diag"
    return OFFS_SQL + f""", src AS MATERIALIZED ({source}),
    lab(crop_id, row, col, label) USING KEY (crop_id, row, col) AS (SELECT crop_id, row, col, CAST(row * 32 + col AS BIGINT) FROM src
      UNION SELECT s.crop_id, s.row, s.col, min(l.label) FROM lab l JOIN off ON TRUE{cond} JOIN src s ON s.crop_id = l.crop_id AND s.row = l.row + off.dy
        AND s.col = l.col + off.dx JOIN recurring.lab r ON r.crop_id = s.crop_id AND r.row = s.row AND r.col = s.col WHERE l.label < r.label GROUP BY 1, 2, 3)"""


@query("r01_free_components", _labels_sql("SELECT crop_id, row, col FROM fx_raster WHERE surface <> 3 AND noise7 <> 0", False)
       + " SELECT crop_id, row, col, label FROM lab")
def free_components(spark, sf):
    cells = fx.view(spark, sf, "fx_raster").filter("surface <> 3 AND noise7 <> 0").select("crop_id", "row", "col")
    return fr.label_cells(cells, K, False, SIDE)


@query("r01_drawing_components", _labels_sql("SELECT crop_id, row, col FROM fx_raster WHERE (surface = 2 AND noise7 <> 1) OR noise7 = 6", True)
       + " SELECT crop_id, row, col, label FROM lab")
def drawing_components(spark, sf):
    return fr.label_cells(drawing(spark, sf), K, True, SIDE)


def _field_sql(cells: str, start: str) -> str:
    """Cheapest cost over ``cells(crop_id, row, col, hs, hd)`` from ``start(crop_id, row, col)``."""
    return OFFS_SQL + f""", cel AS MATERIALIZED ({cells}),
    fld(crop_id, row, col, cost) USING KEY (crop_id, row, col) AS (SELECT c.crop_id, c.row, c.col, CAST(0 AS BIGINT) FROM cel c JOIN ({start}) s USING (crop_id, row, col)
      UNION SELECT s.crop_id, s.row, s.col, min(f.cost + CASE WHEN off.diag THEN u.hd + s.hd ELSE u.hs + s.hs END) AS nc FROM fld f
        JOIN cel u ON u.crop_id = f.crop_id AND u.row = f.row AND u.col = f.col JOIN off ON TRUE
        JOIN cel s ON s.crop_id = f.crop_id AND s.row = f.row + off.dy AND s.col = f.col + off.dx
        LEFT JOIN recurring.fld r ON r.crop_id = s.crop_id AND r.row = s.row AND r.col = s.col
        GROUP BY 1, 2, 3 HAVING nc < coalesce(any_value(r.cost), 9000000000000000))"""


CHAIN_SQL = LIT_SQL + ", " + _field_sql("SELECT *, CAST(500000 AS BIGINT) AS hs, CAST(707107 AS BIGINT) AS hd FROM lit",
                                        "SELECT crop_id, srow AS row, scol AS col FROM fx_walks")


@query("r02_chain_length", CHAIN_SQL + """ SELECT w.crop_id, round(f.cost / 1000000.0, 6) AS length_m FROM fx_walks w JOIN fld f
    ON f.crop_id = w.crop_id AND f.row = w.grow AND f.col = w.gcol""")
def chain_length(spark, sf):
    w = walks(spark, sf)
    field = fr.cheapest_field(fr.lit_with_markers(drawing(spark, sf), w, K, SIDE), w, K)
    goals = w.selectExpr("crop_id", "grow AS row", "gcol AS col")
    return goals.join(field, ["crop_id", "row", "col"]).filter("cost IS NOT NULL").select(
        "crop_id", F.round(F.col("cost") / 1000000.0, 6).alias("length_m")
    )


DIST_SQL = """near AS MATERIALIZED (SELECT a.crop_id, a.row, a.col, a.surface, sqrt(min((a.row - b.row) * (a.row - b.row) + (a.col - b.col) * (a.col - b.col))) AS dist
    FROM fx_raster a JOIN fx_raster b ON a.crop_id = b.crop_id AND {cond} GROUP BY 1, 2, 3, 4)"""


@query("r05_distance_to_other_class", DIST_SQL.replace("{cond}", "a.surface <> b.surface") + " SELECT crop_id, row, col, round(dist, 6) AS dist FROM near")
def distance_to_other_class(spark, sf):
    cells = fx.view(spark, sf, "fx_raster").select("crop_id", "row", "col", "surface")
    out = fr.distance_to_other(cells, K, "surface", [0, 1, 2, 3])
    return out.select("crop_id", "row", "col", F.round("dist", 6).alias("dist"))


def built_ground(spark, sf):
    return fx.view(spark, sf, "fx_raster").selectExpr("crop_id", "row", "col", "CAST(surface = 3 AS INT) AS built")


def walk_starts(spark, sf):
    return walks(spark, sf)


def walking_field(spark, sf):
    return fr.walking_field(built_ground(spark, sf), walks(spark, sf), K)


PRICED_SQL = DIST_SQL.replace("{cond}", "a.surface <> 3 AND b.surface = 3") + ", " + _field_sql(
    """SELECT crop_id, row, col, CAST(round((1 + 4 * (1 - least(dist, 8) / 8) * (1 - least(dist, 8) / 8)) * 500000) AS BIGINT) AS hs,
      CAST(round((1 + 4 * (1 - least(dist, 8) / 8) * (1 - least(dist, 8) / 8)) * 707106.7811865476) AS BIGINT) AS hd FROM near""",
    "SELECT crop_id, srow AS row, scol AS col FROM fx_walks")


@query("r03_walking_field", PRICED_SQL + " SELECT crop_id, row, col, cost FROM fld")
def walking_field_costs(spark, sf):
    return walking_field(spark, sf).filter("cost IS NOT NULL").select("crop_id", "row", "col", "cost")


HALO_SQL = """hw AS (SELECT crop_id, crop_id // 16 AS district, CAST((crop_id % 16 - crop_id % 4) / 4 * 32 AS INT) AS dy, CAST(crop_id % 4 * 32 AS INT) AS dx FROM fx_walks),
    hd AS MATERIALIZED (SELECT crop_id // 16 AS district, CAST((crop_id % 16 - crop_id % 4) / 4 * 32 + row AS INT) AS row, CAST(crop_id % 4 * 32 + col AS INT) AS col, surface FROM fx_raster),
    hal AS MATERIALIZED (SELECT w.crop_id, d.row - w.dy AS row, d.col - w.dx AS col, d.surface FROM hw w JOIN hd d USING (district)
      WHERE d.row >= w.dy - 8 AND d.row < w.dy + 40 AND d.col >= w.dx - 8 AND d.col < w.dx + 40), """ + PRICED_SQL.replace(
    # a price is 1 from 8 m on, so no building further away matters
    "fx_raster a JOIN fx_raster b ON a.crop_id = b.crop_id AND a.surface <> 3 AND b.surface = 3", "hal a LEFT JOIN hal b ON a.crop_id = b.crop_id AND b.surface = 3 AND abs(a.row - b.row) <= 8 AND abs(a.col - b.col) <= 8 WHERE a.surface <> 3"
).replace("least(dist, 8)", "least(coalesce(dist, 8), 8)")


def halo_field(spark, sf):
    """Walking field of every window over the window and the ground round it, so that ways may leave the window."""
    from cellweave.plans import q_routes as qr

    windows = qr.halo_windows(walks(spark, sf).select("crop_id"))
    ground = grids.cut_with_halo(qr.district_cells(spark, sf), windows, ["district"], SIDE, qr.MARGIN, SIDE)
    return fr.walking_field(ground.selectExpr("crop_id", "row", "col", "CAST(surface = 3 AS INT) AS built"), walks(spark, sf), K, qr.MARGIN)


@query("r03_field_with_margin", HALO_SQL + " SELECT crop_id, row, col, cost FROM fld WHERE row BETWEEN 0 AND 31 AND col BETWEEN 0 AND 31")
def field_with_margin(spark, sf):
    found = once(spark, sf, "field_halo", lambda: halo_field(spark, sf))
    return found.filter("cost IS NOT NULL").filter(grids.inside("row", "col", SIDE)).select("crop_id", "row", "col", "cost")


# ------------------------------------------------------------------ drawings on the 8 x 8 grid

G = fx.GRID
CELL_M = 4.0
PAD8_SQL = "SELECT crop_id, gr AS row, gc AS col FROM fx_pred WHERE task_key = 'surface_2' AND pct > 45"
WALK8_SQL = """w8 AS (SELECT crop_id, srow // 4 AS srow, scol // 4 AS scol, grow // 4 AS grow, gcol // 4 AS gcol,
    round(sqrt((srow - grow) * (srow - grow) + (scol - gcol) * (scol - gcol)) * 1.15 + 3, 6) AS teacher_m FROM fx_walks)"""
CHAIN8_SQL = WALK8_SQL + f""", pad AS MATERIALIZED ({PAD8_SQL}),
    frame AS (SELECT s_suppkey AS crop_id, CAST(r AS INT) AS row, CAST(c AS INT) AS col FROM supplier, (SELECT unnest(range(8)) AS r) a, (SELECT unnest(range(8)) AS c) b),
    mk AS (SELECT crop_id, srow AS r, scol AS c FROM w8 UNION ALL SELECT crop_id, grow, gcol FROM w8),
    lit AS MATERIALIZED (SELECT * FROM pad UNION SELECT f.crop_id, f.row, f.col FROM frame f JOIN mk USING (crop_id) WHERE abs(f.row - mk.r) <= 1 AND abs(f.col - mk.c) <= 1), """ + _field_sql(
    "SELECT *, CAST(500000 AS BIGINT) AS hs, CAST(707107 AS BIGINT) AS hd FROM lit", "SELECT crop_id, srow AS row, scol AS col FROM w8"
) + """, par AS MATERIALIZED (SELECT f.crop_id, f.row, f.col, min(n.row * 32 + n.col) AS p FROM fld f JOIN off ON TRUE
      JOIN fld n ON n.crop_id = f.crop_id AND n.row = f.row + off.dy AND n.col = f.col + off.dx
      WHERE f.cost = n.cost + CASE WHEN off.diag THEN 1414214 ELSE 1000000 END GROUP BY 1, 2, 3),
    way AS (SELECT w.crop_id, CAST(w.grow AS INT) AS row, CAST(w.gcol AS INT) AS col, CAST(0 AS BIGINT) AS pos FROM w8 w JOIN fld f ON f.crop_id = w.crop_id AND f.row = w.grow AND f.col = w.gcol
      UNION ALL SELECT p.crop_id, CAST(p.p // 32 AS INT), CAST(p.p % 32 AS INT), pos + 1 FROM way JOIN par p USING (crop_id, row, col)),
    len AS (SELECT w.crop_id, f.cost * 0.000004 AS length_m FROM w8 w JOIN fld f ON f.crop_id = w.crop_id AND f.row = w.grow AND f.col = w.gcol),
    blk AS (SELECT crop_id, CAST(row // 4 AS INT) AS row, CAST(col // 4 AS INT) AS col, count(*) FILTER (WHERE surface = 3) AS nb,
      min(CASE WHEN surface <> 3 THEN row * 32 + col END) AS free_px, bool_or(row % 4 = 2 AND col % 4 = 2 AND surface = 3) AS centre_built FROM fx_raster GROUP BY 1, 2, 3),
    shr AS (SELECT crop_id, avg(CASE WHEN nb = 16 THEN 1.0 ELSE 0.0 END) AS blocked, avg(CASE WHEN nb > 0 THEN 1.0 ELSE 0.0 END) AS touch, count(*) AS k
      FROM way JOIN blk USING (crop_id, row, col) GROUP BY 1),
    wide AS MATERIALIZED (SELECT DISTINCT f.crop_id, f.row, f.col FROM frame f JOIN way w USING (crop_id) WHERE abs(f.row - w.row) <= 1 AND abs(f.col - w.col) <= 1),
    wn AS (SELECT crop_id, count(*) AS n_chain, count(p.row) AS n_both FROM wide LEFT JOIN (SELECT crop_id, row, col FROM pad) p USING (crop_id, row, col) GROUP BY 1),
    pn AS (SELECT crop_id, count(*) AS n_lit FROM pad GROUP BY 1)"""
_ONCE: dict = {}


def once(spark, sf, name, build):
    """Tables several queries share are written once per session and data set."""
    key = (spark.sparkContext.applicationId, sf, name)
    if key not in _ONCE:
        _ONCE[key] = build()
    return _ONCE[key]


def pad8(spark, sf):
    return fx.view(spark, sf, "fx_pred").filter("task_key = 'surface_2' AND pct > 45").selectExpr("crop_id", "gr AS row", "gc AS col")


def walks8(spark, sf):
    return walks(spark, sf).selectExpr(
        "crop_id", *[f"CAST({c} DIV 4 AS INT) AS {c}" for c in ("srow", "scol", "grow", "gcol")],
        "round(sqrt(CAST((srow - grow) * (srow - grow) + (scol - gcol) * (scol - gcol) AS DOUBLE)) * 1.15D + 3, 6) AS teacher_m",
    )


def chain8(spark, sf):
    return once(spark, sf, "chain8", lambda: fr.shortest_chain(pad8(spark, sf), walks8(spark, sf), K, G, CELL_M))


def blocks8(spark, sf):
    """Per 4 m cell: building pixels and the first free pixel."""
    gr, gc = grids.cell_of("row", "col", 4)
    px = fx.view(spark, sf, "fx_raster").select("crop_id", gr, gc, "row", "col", (F.col("surface") == 3).alias("b"))
    return px.groupBy("crop_id", F.col("gr").alias("r"), F.col("gc").alias("c")).agg(
        F.count_if("b").alias("nb"), F.min(F.when(~F.col("b"), F.struct("row", "col"))).alias("free_px"),
        F.bool_or(F.col("b") & (F.col("row") % 4 == 2) & (F.col("col") % 4 == 2)).alias("centre_built"),
    ).withColumnsRenamed({"r": "row", "c": "col"})


def chain_shares(spark, sf):
    chain, _ = chain8(spark, sf)
    return chain.join(blocks8(spark, sf), ["crop_id", "row", "col"]).groupBy("crop_id").agg(
        F.avg((F.col("nb") == 16).cast("double")).alias("blocked"), F.avg((F.col("nb") > 0).cast("double")).alias("touch"), F.count("*").alias("k")
    )


@query("j18_way_back_cells", CHAIN8_SQL + " SELECT crop_id, pos, row, col FROM way")
def way_back_cells(spark, sf):
    return chain8(spark, sf)[0].select("crop_id", "pos", "row", "col")


@query("a38_cell_rule", CHAIN8_SQL + """ SELECT w.crop_id, l.length_m IS NOT NULL AS connected, round(l.length_m / w.teacher_m, 6) AS length_ratio,
    round(s.blocked, 6) AS building_share, coalesce(l.length_m / w.teacher_m <= 1.1 AND s.blocked = 0, FALSE) AS success, coalesce(n_lit, 0) AS lit_cells
    FROM w8 w LEFT JOIN len l USING (crop_id) LEFT JOIN shr s USING (crop_id) LEFT JOIN pn USING (crop_id)""")
def cell_rule(spark, sf):
    from cellweave.operators.chains import cell_rule_scores

    return cell_rule_scores(walks8(spark, sf), chain8(spark, sf)[1], chain_shares(spark, sf), pad8(spark, sf), K).select(
        "crop_id", "connected", F.round("length_ratio", 6).alias("length_ratio"), F.round("blocked", 6).alias("building_share"), "success", "lit_cells"
    )


@query("a39_cleanliness", CHAIN8_SQL + """ SELECT crop_id, n_chain AS chain_cells, round(n_lit / n_chain, 6) AS excess_ratio, n_lit / n_chain <= 1.25 AS clean,
    round(n_both / (n_chain + n_lit - n_both), 6) AS iou_own_chain FROM wn JOIN pn USING (crop_id)""")
def cleanliness(spark, sf):
    from cellweave.operators.chains import cleanliness as clean

    out = clean(chain8(spark, sf)[0], pad8(spark, sf), K, G)
    return out.select("crop_id", "chain_cells", F.round("excess_ratio", 6).alias("excess_ratio"), "clean", F.round("iou_own_chain", 6).alias("iou_own_chain"))


@query("a41_cleanup_targets", CHAIN8_SQL + """, q AS (SELECT w.crop_id, CAST(CASE WHEN l.length_m IS NULL THEN 1 WHEN l.length_m / teacher_m <= 1.1 AND s.blocked = 0 THEN 0
      WHEN s.blocked > 0 THEN 2 ELSE 3 END AS INT) AS reason FROM w8 w LEFT JOIN len l USING (crop_id) LEFT JOIN shr s USING (crop_id))
    SELECT reason, reason = 0 AS own_chain, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM q GROUP BY 1""")
def cleanup_targets(spark, sf):
    from cellweave.operators.chains import cell_rule_scores, cleanup_reason

    scores = cell_rule_scores(walks8(spark, sf), chain8(spark, sf)[1], chain_shares(spark, sf), pad8(spark, sf), K)
    total = walks8(spark, sf).agg(F.count("*")).scalar()
    return scores.groupBy(cleanup_reason().alias("reason")).agg(F.count("*").alias("n")).select(
        "reason", (F.col("reason") == 0).alias("own_chain"), "n", F.round(F.col("n") / total, 6).alias("share")
    )


@query("a42_chain_building_contact", CHAIN8_SQL + """ SELECT round(sum(touch * k) / sum(k), 6) AS pooled, round(avg(touch), 6) AS per_route, CAST(sum(k) AS BIGINT) AS chain_cells FROM shr""")
def chain_building_contact(spark, sf):
    s = chain_shares(spark, sf)
    return s.agg(
        F.round(F.sum(F.col("touch") * F.col("k")) / F.sum("k"), 6).alias("pooled"), F.round(F.avg("touch"), 6).alias("per_route"), F.sum("k").alias("chain_cells")
    )


@query("a42_moved_points", CHAIN8_SQL + """ SELECT crop_id, pos, CASE WHEN centre_built AND nb < 16 THEN free_px % 32 + 0.5 ELSE col * 4 + 2.0 END::DOUBLE AS x,
    CASE WHEN centre_built AND nb < 16 THEN free_px // 32 + 0.5 ELSE row * 4 + 2.0 END::DOUBLE AS y FROM way JOIN blk USING (crop_id, row, col)""")
def moved_points(spark, sf):
    """Chain points whose cell centre is on a building move to the first free pixel of the cell."""
    pts = chain8(spark, sf)[0].join(blocks8(spark, sf), ["crop_id", "row", "col"])
    move = F.col("centre_built") & (F.col("nb") < 16)
    return pts.select(
        "crop_id", "pos", F.when(move, F.col("free_px.col") + 0.5).otherwise(F.col("col") * 4 + 2.0).alias("x"),
        F.when(move, F.col("free_px.row") + 0.5).otherwise(F.col("row") * 4 + 2.0).alias("y"),
    )


def _rescored_sql() -> str:
    from cellweave.plans.q_routes import VERDICT_SQL

    verdict = VERDICT_SQL.replace("fx_route_points", "p8").replace("fx_routes", "r8").replace("cel AS (", "spot AS (").replace("FROM cel a", "FROM spot a")
    return CHAIN8_SQL + """, lastp AS (SELECT crop_id, max(pos) AS last FROM way GROUP BY 1),
    p8 AS MATERIALIZED (SELECT crop_id * 2 + v.v AS route_id, CAST(last - pos + 1 AS INT) AS pos, CASE WHEN v.v = 1 AND centre_built AND nb < 16 THEN free_px % 32 + 0.5 ELSE col * 4 + 2.0 END::DOUBLE AS x,
      CASE WHEN v.v = 1 AND centre_built AND nb < 16 THEN free_px // 32 + 0.5 ELSE row * 4 + 2.0 END::DOUBLE AS y
      FROM way JOIN blk USING (crop_id, row, col) JOIN lastp USING (crop_id), (SELECT unnest([0, 1]) AS v) v),
    r8 AS (SELECT w.crop_id * 2 + v.v AS route_id, w.crop_id, f.scol + 0.5::DOUBLE AS sx, f.srow + 0.5::DOUBLE AS sy, f.gcol + 0.5::DOUBLE AS gx, f.grow + 0.5::DOUBLE AS gy, w.teacher_m
      FROM w8 w JOIN fx_walks f USING (crop_id), (SELECT unnest([0, 1]) AS v) v), """ + verdict + """,
    pair AS (SELECT a.crop_id, a.reason AS raw, b.reason AS moved FROM vd a JOIN vd b ON b.route_id = a.route_id + 1 WHERE a.route_id % 2 = 0)
    SELECT count(*) AS n, count(*) FILTER (WHERE raw IS NULL) AS raw_solved, coalesce(count(*) FILTER (WHERE raw = 'crosses a building'), 0) AS raw_crosses,
    count(*) FILTER (WHERE moved IS NULL) AS moved_solved, count(*) FILTER (WHERE raw = 'crosses a building' AND moved IS NULL) AS rescued,
    count(*) FILTER (WHERE raw IS NOT NULL AND moved IS NULL) AS gained, count(*) FILTER (WHERE raw IS NULL AND moved IS NOT NULL) AS lost,
    round(count(*) FILTER (WHERE raw IS NULL) / count(*), 6) AS raw_share, round(count(*) FILTER (WHERE moved IS NULL) / count(*), 6) AS moved_share FROM pair"""


@query("a42_rescored", _rescored_sql())
def rescored(spark, sf):
    """One verdict pass over every chain as drawn and with its points moved off buildings; what the moving gains and loses."""
    from cellweave.operators.chains import rescoring
    from cellweave.plans import q_routes as qr

    chain = chain8(spark, sf)[0].join(blocks8(spark, sf), ["crop_id", "row", "col"])
    last = chain8(spark, sf)[0].groupBy("crop_id").agg(F.max("pos").alias("last"))
    move = F.col("centre_built") & (F.col("nb") < 16)
    raw = F.struct((F.col("col") * 4 + 2.0).alias("x"), (F.col("row") * 4 + 2.0).alias("y"))
    moved = F.when(move, F.struct((F.col("free_px.col") + 0.5).alias("x"), (F.col("free_px.row") + 0.5).alias("y"))).otherwise(raw)
    points = chain.join(last, "crop_id").select("crop_id", (F.col("last") - F.col("pos") + 1).cast("int").alias("pos"), raw.alias("raw"), moved.alias("moved"))
    frame = walks(spark, sf).selectExpr("crop_id", *[f"{c} + 0.5D AS {n}" for c, n in (("scol", "sx"), ("srow", "sy"), ("gcol", "gx"), ("grow", "gy"))])
    frame = frame.join(walks8(spark, sf).select("crop_id", "teacher_m"), "crop_id")
    return rescoring(frame, points, qr.buildings(spark, sf), SIDE)


@query("r17_drawing_to_polyline", CHAIN8_SQL + """, m AS (SELECT crop_id, max(pos) AS last FROM way GROUP BY 1)
    SELECT crop_id, last - pos AS pos, round(CAST((col + 0.5) * 8 AS DOUBLE), 3) AS px, round(CAST((row + 0.5) * 8 AS DOUBLE), 3) AS py FROM way JOIN m USING (crop_id)""")
def drawing_to_polyline(spark, sf):
    from cellweave.operators.chains import chain_polyline

    return chain_polyline(chain8(spark, sf)[0], K, CELL_M, 2.0)


@query("a32_markers_connected", WALK8_SQL + ", " + _labels_sql(PAD8_SQL, True) + """,
    a AS (SELECT DISTINCT w.crop_id, l.label FROM w8 w JOIN lab l ON l.crop_id = w.crop_id AND abs(l.row - w.srow) <= 1 AND abs(l.col - w.scol) <= 1),
    b AS (SELECT DISTINCT w.crop_id, l.label FROM w8 w JOIN lab l ON l.crop_id = w.crop_id AND abs(l.row - w.grow) <= 1 AND abs(l.col - w.gcol) <= 1),
    c AS (SELECT crop_id, min(label) AS label FROM a JOIN b USING (crop_id, label) GROUP BY 1),
    n AS (SELECT crop_id, label, count(*) AS n FROM lab GROUP BY 1, 2)
    SELECT w.crop_id, c.label IS NOT NULL AS connected, coalesce(n.n, 0) * CAST(4.0 AS DOUBLE) AS length_m FROM w8 w LEFT JOIN c USING (crop_id) LEFT JOIN n USING (crop_id, label)""".replace("row * 32 + col", "row * 8 + col"))
def markers_connected(spark, sf):
    from cellweave.operators.chains import connected_markers

    labels = once(spark, sf, "labels8", lambda: fr.label_cells(pad8(spark, sf), K, True, 32))
    return connected_markers(labels, walks8(spark, sf), K, CELL_M)


# ------------------------------------------------------------------ walking fields

WALKED_SQL = PRICED_SQL + """, par AS MATERIALIZED (SELECT f.crop_id, f.row, f.col, min(n.row * 32 + n.col) AS p FROM fld f JOIN cel cf USING (crop_id, row, col) JOIN off ON TRUE
      JOIN fld n ON n.crop_id = f.crop_id AND n.row = f.row + off.dy AND n.col = f.col + off.dx JOIN cel cn ON cn.crop_id = n.crop_id AND cn.row = n.row AND cn.col = n.col
      WHERE f.cost = n.cost + CASE WHEN off.diag THEN cf.hd + cn.hd ELSE cf.hs + cn.hs END GROUP BY 1, 2, 3),
    walk_m AS (SELECT crop_id, row, col, CAST(0 AS DOUBLE) AS m FROM fld WHERE cost = 0
      UNION ALL SELECT p.crop_id, p.row, p.col, w.m + sqrt((p.row - w.row) * (p.row - w.row) + (p.col - w.col) * (p.col - w.col)) FROM walk_m w
        JOIN par p ON p.crop_id = w.crop_id AND p.p = w.row * 32 + w.col),
    met AS MATERIALIZED (SELECT crop_id, row, col, round(m, 6) AS m FROM walk_m),
    two AS MATERIALIZED (SELECT r.crop_id, CAST(r.row // 2 AS INT) AS r2, CAST(r.col // 2 AS INT) AS c2, CASE WHEN min(met.m) IS NULL THEN NULL
      ELSE round_even(min(met.m) / 2, 0) END AS d2 FROM fx_raster r LEFT JOIN met USING (crop_id, row, col) GROUP BY 1, 2, 3),
    goal AS (SELECT w.crop_id, met.m AS goal_m, CAST(CASE WHEN met.m > 0 THEN floor(met.m / 10) + 1 ELSE 1 END AS INT) AS n_goal FROM fx_walks w
      LEFT JOIN met ON met.crop_id = w.crop_id AND met.row = w.grow AND met.col = w.gcol),
    dm AS MATERIALIZED (SELECT crop_id, CAST(r2 // 2 AS INT) AS gr, CAST(c2 // 2 AS INT) AS gc, min(d2) * 2 AS dmin,
      CASE WHEN count(d2) = count(*) THEN max(d2) * 2 + 2.9 END AS dmax, count(d2) > 0 AS reached FROM two GROUP BY 1, 2, 3)"""
HORIZON_M = 10.0


def field(spark, sf):
    return once(spark, sf, "field", lambda: walking_field(spark, sf))


def metres(spark, sf):
    return once(spark, sf, "metres", lambda: fr.walked_metres(field(spark, sf), K))


def two_metre(spark, sf):
    from cellweave.operators import wave

    # cells without a way count as well; they are added as rows of their own, not joined
    frame = fx.view(spark, sf, "fx_raster").select("crop_id", "row", "col")
    return wave.two_metre_field(frame.unionByName(metres(spark, sf), allowMissingColumns=True), K)


def goals(spark, sf):
    from cellweave.operators import wave

    g = walks(spark, sf).selectExpr("crop_id", "grow AS row", "gcol AS col", "srow", "scol")
    # the files of a field are far smaller than its rows, so an estimate would send it through the driver
    return g.join(metres(spark, sf).hint("merge"), ["crop_id", "row", "col"], "left").select(
        "crop_id", "srow", "scol", F.col("metres").alias("goal_m"), wave.n_goal(F.col("metres"), HORIZON_M).alias("n_goal")
    )


def cell_min_max(spark, sf):
    from cellweave.operators import wave

    return wave.cell_min_max(two_metre(spark, sf), K, 2)


@query("r03_walked_metres", WALKED_SQL + " SELECT crop_id, row, col, m AS metres FROM met")
def walked_metres(spark, sf):
    return metres(spark, sf)


@query("r03_two_metre_cells", WALKED_SQL + " SELECT crop_id, r2, c2, CAST(d2 AS INT) AS d2 FROM two")
def two_metre_cells(spark, sf):
    return two_metre(spark, sf)


@query("a53_field_statistics", WALKED_SQL + """ SELECT count(*) AS n, round(avg(CASE WHEN goal_m IS NULL THEN 1.0 ELSE 0.0 END), 6) AS unreachable,
    round(quantile_cont(goal_m, 0.5), 6) AS p50, round(quantile_cont(goal_m, 0.9), 6) AS p90, round(max(goal_m), 6) AS max_m, CAST(sum(2 * n_goal + 1) AS BIGINT) AS passes,
    (SELECT count(d2) FROM two) AS cells_reached FROM goal""")
def field_statistics(spark, sf):
    from cellweave.operators.ranking import exact_percentiles

    g = goals(spark, sf).withColumn("all", F.lit(1))
    reached = two_metre(spark, sf).agg(F.count("d2")).scalar()
    base = g.groupBy("all").agg(
        F.count("*").alias("n"), F.round(F.avg(F.col("goal_m").isNull().cast("double")), 6).alias("unreachable"),
        F.round(F.max("goal_m"), 6).alias("max_m"), F.sum((2 * F.col("n_goal") + 1).cast("bigint")).alias("passes"),
    )
    spread = exact_percentiles(g, ["all"], "goal_m", [0.5, 0.9])
    return base.join(spread, "all", "left").withColumns({"p50": F.round("p50", 6), "p90": F.round("p90", 6), "cells_reached": reached}).drop("all")


FRONT_SQL = WALKED_SQL + """, ring AS (SELECT crop_id, gr, gc, CAST(unnest(range(CAST(floor(dmin / 10) + 1 AS BIGINT),
      CAST(coalesce(floor(dmax / 10), greatest(n_goal, floor(dmin / 10) + 1)) AS BIGINT) + 1)) AS INT) AS j FROM dm JOIN goal USING (crop_id) WHERE dmin IS NOT NULL),
    sd AS (SELECT f.crop_id, f.gr, f.gc FROM dm f JOIN fx_walks w USING (crop_id) WHERE abs(f.gr - w.srow // 4) <= 1 AND abs(f.gc - w.scol // 4) <= 1)"""


@query("r09_fronts", FRONT_SQL + " SELECT crop_id, j, gr, gc FROM ring")
def fronts(spark, sf):
    from cellweave.operators import wave

    return wave.rings(cell_min_max(spark, sf), goals(spark, sf), K, HORIZON_M).select("crop_id", "j", "gr", "gc")


@query("r09_start_disc", FRONT_SQL + " SELECT crop_id, gr, gc FROM sd")
def start_disc(spark, sf):
    from cellweave.operators import wave

    return wave.start_disc(walks(spark, sf), K, 4, G)


@query("r16_detour_strata", WALKED_SQL + """ SELECT w.crop_id, round(goal_m / sqrt((srow - grow) * (srow - grow) + (scol - gcol) * (scol - gcol)), 6) AS detour_ratio,
    CAST(CASE WHEN goal_m / sqrt((srow - grow) * (srow - grow) + (scol - gcol) * (scol - gcol)) < 1.1 THEN 0
      WHEN goal_m / sqrt((srow - grow) * (srow - grow) + (scol - gcol) * (scol - gcol)) < 1.4 THEN 1 ELSE 2 END AS INT) AS stratum
    FROM fx_walks w JOIN goal USING (crop_id) WHERE goal_m > 0""")
def detour_strata(spark, sf):
    """Walking length over the straight distance, and its stratum, for every reached goal."""
    from cellweave.functions.bins import detour_stratum

    straight = F.expr("sqrt(CAST((srow - grow) * (srow - grow) + (scol - gcol) * (scol - gcol) AS DOUBLE))")
    w = walks(spark, sf).withColumn("straight_m", straight).select("crop_id", "straight_m")
    out = goals(spark, sf).filter("goal_m > 0").join(w, "crop_id").withColumn("detour_ratio", F.col("goal_m") / F.col("straight_m"))
    return out.select("crop_id", F.round("detour_ratio", 6).alias("detour_ratio"), detour_stratum(F.col("detour_ratio"), [0.0, 1.1, 1.4, 1e9]).alias("stratum"))


@query("r10_pass_schedule", WALKED_SQL + """, p AS (SELECT crop_id, n_goal, unnest(range(CAST(2 * n_goal + 1 AS BIGINT))) AS pos FROM goal)
    SELECT crop_id, CAST(pos AS INT) AS pos, CASE WHEN pos = 2 * n_goal THEN 'draw' WHEN pos = 2 * n_goal - 1 THEN 'origin' WHEN pos >= n_goal THEN 'back'
      WHEN pos = n_goal - 1 AND n_goal > 1 THEN 'reach' WHEN pos = 0 THEN 'first' ELSE 'step' END AS kind,
    CASE WHEN pos = 2 * n_goal THEN 'DONE' WHEN pos = 2 * n_goal - 1 THEN 'DRAW' WHEN pos >= n_goal - 1 AND (n_goal > 1 OR pos > 0) THEN 'BACK' ELSE 'SEARCH' END AS token FROM p""")
def pass_schedule(spark, sf):
    from cellweave.operators import wave

    return wave.schedule(goals(spark, sf).select("crop_id", "n_goal"))


@query("r10_teacher_drawings", FRONT_SQL + """, p AS (SELECT crop_id, n_goal, unnest(range(CAST(n_goal AS BIGINT))) AS k FROM goal)
    SELECT crop_id, CAST(k AS INT) AS k, count(*) FILTER (WHERE i) AS cells_in, count(*) AS cells_out FROM (
      SELECT crop_id, k, gr, gc, bool_or(j <= k) AS i FROM (SELECT p.crop_id, p.k, r.gr, r.gc, r.j FROM p JOIN ring r ON r.crop_id = p.crop_id AND r.j <= p.k + 1
        UNION ALL SELECT p.crop_id, p.k, sd.gr, sd.gc, 0 FROM p JOIN sd USING (crop_id)) GROUP BY 1, 2, 3, 4) GROUP BY 1, 2""")
def teacher_drawings(spark, sf):
    from cellweave.operators import wave

    passes = wave.forward_drawings(goals(spark, sf), cell_min_max(spark, sf), wave.start_disc(walks(spark, sf), K, 4, G), K, HORIZON_M)
    return passes.groupBy("crop_id", "k").agg(F.count_if("pad_in").alias("cells_in"), F.count("*").alias("cells_out"))


@query("r09_way_cells_beyond_front", WALKED_SQL + """, way AS (SELECT w.crop_id, CAST(w.grow AS INT) AS row, CAST(w.gcol AS INT) AS col FROM fx_walks w JOIN met ON met.crop_id = w.crop_id AND met.row = w.grow AND met.col = w.gcol
      UNION ALL SELECT p.crop_id, CAST(p.p // 32 AS INT), CAST(p.p % 32 AS INT) FROM way JOIN par p USING (crop_id, row, col)),
    c AS (SELECT DISTINCT way.crop_id, way.row // 4 AS gr, way.col // 4 AS gc FROM way JOIN two ON two.crop_id = way.crop_id AND two.r2 = way.row // 2 AND two.c2 = way.col // 2 WHERE d2 * 2 >= 10)
    SELECT DISTINCT d.crop_id, d.gr, d.gc FROM dm d JOIN c USING (crop_id) WHERE abs(d.gr - c.gr) <= 1 AND abs(d.gc - c.gc) <= 1""")
def way_cells_beyond_front(spark, sf):
    from cellweave.operators import wave

    way = once(spark, sf, "way", lambda: fr.way_back(field(spark, sf), walks(spark, sf).select("crop_id", "grow", "gcol"), K))
    return wave.way_cells(way, two_metre(spark, sf), K, 4, G, 10.0)


BACK_SQL = FRONT_SQL + """, way AS (SELECT w.crop_id, CAST(w.grow AS INT) AS row, CAST(w.gcol AS INT) AS col FROM fx_walks w JOIN met ON met.crop_id = w.crop_id AND met.row = w.grow AND met.col = w.gcol
      UNION ALL SELECT p.crop_id, CAST(p.p // 32 AS INT), CAST(p.p % 32 AS INT) FROM way JOIN par p USING (crop_id, row, col)),
    wc AS (SELECT way.crop_id, way.row // 4 AS gr, way.col // 4 AS gc, max(d2) * 2 AS d FROM way JOIN two ON two.crop_id = way.crop_id AND two.r2 = way.row // 2 AND two.c2 = way.col // 2 GROUP BY 1, 2, 3),
    pc AS (SELECT f.crop_id, f.gr, f.gc, max(wc.d) AS d FROM dm f JOIN wc USING (crop_id) WHERE abs(f.gr - wc.gr) <= 1 AND abs(f.gc - wc.gc) <= 1 GROUP BY 1, 2, 3),
    cells AS MATERIALIZED (SELECT crop_id, gr, gc, min(j) AS j0, max(d) AS d, bool_or(disc) AS disc FROM (SELECT crop_id, gr, gc, j, NULL AS d, FALSE AS disc FROM ring
      UNION ALL SELECT crop_id, gr, gc, 0, NULL, TRUE FROM sd UNION ALL SELECT crop_id, gr, gc, NULL, d, FALSE FROM pc) GROUP BY 1, 2, 3),
    bk AS (SELECT g.crop_id, g.n_goal, unnest(range(1, CAST(n_goal + 1 AS BIGINT))) AS j FROM goal g),
    pads AS (SELECT b.crop_id, b.j, coalesce(c.j0 <= b.j, FALSE) OR coalesce(floor(c.d / 10) >= b.j, FALSE) AS a, coalesce(c.j0 <= b.j - 1, FALSE) OR coalesce(floor(c.d / 10) >= b.j - 1, FALSE) AS z
      FROM bk b JOIN cells c USING (crop_id) UNION ALL SELECT crop_id, 0, TRUE, d IS NOT NULL FROM cells WHERE disc OR d IS NOT NULL)"""


@query("r10_backward_drawings", BACK_SQL + """ SELECT crop_id, CAST(2 * n_goal - j AS INT) AS pos, CASE WHEN j = 0 THEN 'draw' WHEN j = 1 THEN 'origin' ELSE 'back' END AS kind,
    CASE WHEN j = 0 THEN 'DONE' WHEN j = 1 THEN 'DRAW' ELSE 'BACK' END AS token, count(*) FILTER (WHERE a) AS cells_in, count(*) FILTER (WHERE z) AS cells_out
    FROM pads JOIN goal USING (crop_id) WHERE a OR z GROUP BY 1, 2, 3, 4""")
def backward_drawings(spark, sf):
    """Passes from the goal back and the drawing pass, with their kind, token and lit cells before and after."""
    from cellweave.operators import wave

    way = once(spark, sf, "way", lambda: fr.way_back(field(spark, sf), walks(spark, sf).select("crop_id", "grow", "gcol"), K))
    reach = wave.way_reach(way, two_metre(spark, sf), K, 4, G)
    g = goals(spark, sf)
    pads = wave.backward_drawings(g, cell_min_max(spark, sf), wave.start_disc(walks(spark, sf), K, 4, G), reach, K, HORIZON_M)
    counts = pads.groupBy("crop_id", "j").agg(F.count_if("pad_in").alias("cells_in"), F.count_if("pad_out").alias("cells_out"))
    plan = wave.schedule(g.select("crop_id", "n_goal", F.col("n_goal").alias("n"))).withColumn("j", 2 * F.col("n") - F.col("pos"))
    return plan.join(counts, ["crop_id", "j"]).select("crop_id", "pos", "kind", "token", "cells_in", "cells_out")


@query("r20_tie_family", PRICED_SQL + """, """ + _field_sql("SELECT * FROM cel", "SELECT crop_id, grow AS row, gcol AS col FROM fx_walks").replace(OFFS_SQL + ", cel AS MATERIALIZED (SELECT * FROM cel),", "").replace("fld", "bak") + """,
    t AS (SELECT w.crop_id, f.cost AS total FROM fx_walks w JOIN fld f ON f.crop_id = w.crop_id AND f.row = w.grow AND f.col = w.gcol)
    SELECT t.crop_id, count(*) FILTER (WHERE f.cost + b.cost - total <= 0) AS tie, count(*) FILTER (WHERE f.cost + b.cost - total <= 500000) AS within_half,
    count(*) FILTER (WHERE f.cost + b.cost - total <= 2000000) AS within_two FROM t JOIN fld f USING (crop_id) JOIN bak b USING (crop_id, row, col) GROUP BY 1""")
def tie_family(spark, sf):
    """Cells on some cheapest way between start and goal, exactly and within a slack."""
    ahead = field(spark, sf)
    back = once(spark, sf, "field_back", lambda: fr.walking_field(
        built_ground(spark, sf), walks(spark, sf).selectExpr("crop_id", "grow AS srow", "gcol AS scol"), K))
    total = walks(spark, sf).selectExpr("crop_id", "grow AS row", "gcol AS col").join(ahead, ["crop_id", "row", "col"]).filter(
        "cost IS NOT NULL").select("crop_id", F.col("cost").alias("total"))
    both = ahead.select("crop_id", "row", "col", "cost").join(
        back.select("crop_id", "row", "col", F.col("cost").alias("rest")), ["crop_id", "row", "col"]
    ).join(total, "crop_id").withColumn("slack", F.col("cost") + F.col("rest") - F.col("total"))
    return both.groupBy("crop_id").agg(
        F.count_if(F.col("slack") <= 0).alias("tie"), F.count_if(F.col("slack") <= 500000).alias("within_half"),
        F.count_if(F.col("slack") <= 2000000).alias("within_two"),
    )


MOVE16_SQL = """mv AS (SELECT a.a AS dy, b.b AS dx FROM (SELECT unnest([-2, -1, 0, 1, 2]) AS a) a, (SELECT unnest([-2, -1, 0, 1, 2]) AS b) b WHERE gcd(abs(a.a), abs(b.b)) = 1),
    fr AS MATERIALIZED (SELECT crop_id, row, col FROM fx_raster WHERE surface <> 3),
    ed AS MATERIALIZED (SELECT u.crop_id, u.row AS ur, u.col AS uc, v.row AS vr, v.col AS vc, CAST(2 * round(sqrt(dy * dy + dx * dx) * 500000) AS BIGINT) AS w FROM fr u JOIN mv ON TRUE
      JOIN fr v ON v.crop_id = u.crop_id AND v.row = u.row + dy AND v.col = u.col + dx
      LEFT JOIN fr p ON p.crop_id = u.crop_id AND p.row = u.row + CASE WHEN abs(dy) + abs(dx) = 2 THEN 0 WHEN abs(dy) = 2 THEN sign(dy) ELSE 0 END
        AND p.col = u.col + CASE WHEN abs(dy) + abs(dx) = 2 THEN dx WHEN abs(dx) = 2 THEN sign(dx) ELSE 0 END
      LEFT JOIN fr q ON q.crop_id = u.crop_id AND q.row = u.row + CASE WHEN abs(dy) + abs(dx) = 2 THEN dy ELSE sign(dy) END AND q.col = u.col + CASE WHEN abs(dy) + abs(dx) = 2 THEN 0 ELSE sign(dx) END
      WHERE abs(dy) + abs(dx) = 1 OR (p.row IS NOT NULL AND q.row IS NOT NULL)),
    f16(crop_id, row, col, cost) USING KEY (crop_id, row, col) AS (SELECT f.crop_id, f.row, f.col, CAST(0 AS BIGINT) FROM fr f JOIN fx_walks w ON w.crop_id = f.crop_id AND w.srow = f.row AND w.scol = f.col
      UNION SELECT e.crop_id, e.vr, e.vc, min(f.cost + e.w) AS nc FROM f16 f JOIN ed e ON e.crop_id = f.crop_id AND e.ur = f.row AND e.uc = f.col
        LEFT JOIN recurring.f16 r ON r.crop_id = e.crop_id AND r.row = e.vr AND r.col = e.vc GROUP BY 1, 2, 3 HAVING nc < coalesce(any_value(r.cost), 9000000000000000))"""


@query("r19_path_optimality", WALKED_SQL + ", " + MOVE16_SQL + """ SELECT g.crop_id, round(goal_m, 6) AS stored_m, round(f.cost / 1000000.0, 6) AS grid_m, round(goal_m / (f.cost / 1000000.0), 6) AS ratio
    FROM goal g JOIN fx_walks w USING (crop_id) JOIN f16 f ON f.crop_id = g.crop_id AND f.row = w.grow AND f.col = w.gcol WHERE goal_m > 0 AND f.cost > 0 ORDER BY ratio DESC, crop_id LIMIT 8""")
def path_optimality(spark, sf):
    """Stored walking length over the length on a sixteen-direction grid that cuts no corner; worst eight."""
    cells = fr.clear_moves(free(spark, sf), K)
    dense = once(spark, sf, "field16", lambda: fr.cheapest_field(cells, walks(spark, sf), K, "1.0D", fr.KNIGHT))
    grid = walks(spark, sf).selectExpr("crop_id", "grow AS row", "gcol AS col").join(dense, ["crop_id", "row", "col"]).selectExpr(
        "crop_id", "cost / 1000000.0D AS grid_m")
    out = goals(spark, sf).filter("goal_m > 0").join(grid, "crop_id").filter("grid_m > 0").selectExpr(
        "crop_id", "round(goal_m, 6) AS stored_m", "round(grid_m, 6) AS grid_m", "round(goal_m / grid_m, 6) AS ratio")
    return out.orderBy(F.desc("ratio"), "crop_id").limit(8)
