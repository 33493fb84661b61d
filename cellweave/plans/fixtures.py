"""Spatial views derived from the given tables.

Each view is one projection of one table, with optional generators; the same expression text runs in
Spark and in the comparison engine. Keys are 0-based and dense, hashes are small-prime integer
arithmetic. Every generated group (cells of a window, points of a route) has a fixed small size, and
everything that can meet in a join lives in a district or window whose number grows with the table.
"""

from __future__ import annotations

from math import prod

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave.session import numbered

SIDE = 32  # cells along a window
GRID = 8  # output cells along a window
TASK_ROWS = [
    ("surface_3", "surface", 3, None, None),
    ("surface_2", "surface", 2, None, None),
    ("noise7_0+surface_2", "noise7", 0, "surface", 2),
    ("surface_3+estab_0", "surface", 3, "estab", 0),
]
MOST = {"2 + o_orderkey % 5": 6}  # largest value of a size that is no constant
CALENDAR_DATE_ROWS = [("F", "20260915", "1"), ("O", "20260915", "1"), ("O", "20260915", "2"), ("P", "20260916", "1")]
CALENDAR_ROWS = [
    ("O", "0", "1", "20260901", "20261231"),
    ("P", "0", "1", "20260901", "20261231"),
    ("F", "1", "0", "20260901", "20261231"),
]

# name: (table, [(generator column, size expression)], [projections], filter)
VIEWS = {
    "fx_raster": (
        "supplier",
        [("cell", "1024")],
        [
            "s_suppkey AS crop_id",
            "CAST((cell - cell % 32) / 32 AS INT) AS row",
            "CAST(cell % 32 AS INT) AS col",
            """CAST(CASE WHEN ((cell - cell % 32) / 32) % 8 >= 3 AND (cell % 32) % 8 >= 3
                 AND ((s_suppkey * 64 + (cell - cell % 256) / 32 + (cell % 32 - cell % 8) / 8) * 48271) % 65521 % 4 <> 0
                 THEN 3
               WHEN ((cell - cell % 32) / 32) % 8 = 0 OR cell % 8 = 0 THEN 2
               WHEN ((cell - cell % 32) / 32) % 8 <= 2 THEN 1 ELSE 0 END AS INT) AS surface""",
            "CAST(((s_suppkey * 1024 + cell + 1) * 48271) % 65521 % 7 AS INT) AS noise7",
            """CAST(CASE WHEN ((s_suppkey * 1024 + cell + 7) * 16807) % 65521 % 19 < 4
               THEN ((s_suppkey * 1024 + cell + 7) * 16807) % 65521 % 19 ELSE 0 END AS INT) AS estab""",
        ],
        None,
    ),
    "fx_markers": (
        "supplier",
        [],
        [
            "s_suppkey AS crop_id",
            "CAST((s_suppkey * 48271 + 5) % 65521 % 32 AS INT) AS mrow",
            "CAST((s_suppkey * 16807 + 11) % 65521 % 32 AS INT) AS mcol",
        ],
        None,
    ),
    "fx_walks": (
        "supplier",
        [],
        [
            "s_suppkey AS crop_id",
            "CAST(8 * ((s_suppkey * 48271 + 5) % 65521 % 4) AS INT) AS srow",
            "CAST((s_suppkey * 16807 + 11) % 65521 % 32 AS INT) AS scol",
            "CAST((s_suppkey * 48271 + 77) % 65521 % 32 AS INT) AS grow",
            "CAST(8 * ((s_suppkey * 16807 + 91) % 65521 % 4) AS INT) AS gcol",
        ],
        None,
    ),
    "fx_pred": (
        "supplier",
        [("task", "4"), ("cell", "64")],
        [
            "s_suppkey AS crop_id",
            """CASE task WHEN 0 THEN 'surface_3' WHEN 1 THEN 'surface_2' WHEN 2 THEN 'noise7_0+surface_2'
               ELSE 'surface_3+estab_0' END AS task_key""",
            "CAST((cell - cell % 8) / 8 AS INT) AS gr",
            "CAST(cell % 8 AS INT) AS gc",
            "CAST(((s_suppkey * 64 + cell) * 48271 + task * 7919) % 65521 % 100 AS INT) AS pct",
        ],
        None,
    ),
    # one predicted mask per condition
    "fx_atom_pred": (
        "supplier",
        [("atom_no", "4"), ("cell", "64")],
        [
            "s_suppkey AS crop_id",
            "CASE atom_no WHEN 0 THEN 'surface_3' WHEN 1 THEN 'estab_0' WHEN 2 THEN 'noise7_0' ELSE 'surface_2' END AS atom",
            "CAST((cell - cell % 8) / 8 AS INT) AS gr",
            "CAST(cell % 8 AS INT) AS gc",
            "CAST(((s_suppkey * 64 + cell) * 16807 + atom_no * 7919) % 65521 % 100 AS INT) AS pct",
        ],
        None,
    ),
    "fx_rects": (
        "customer",
        [],
        [
            "c_custkey AS bid",
            "CAST((c_custkey - c_custkey % 1500) / 1500 AS INT) AS district",
            "CAST((c_custkey * 48271 + 3) % 65521 % 1000 AS INT) AS x0",
            "CAST((c_custkey * 16807 + 9) % 65521 % 1000 AS INT) AS y0",
            "CAST(4 + c_custkey % 17 AS INT) AS w",
            "CAST(4 + c_custkey % 13 AS INT) AS h",
            "CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE CAST(3 + c_custkey % 23 AS INT) END AS height_m",
            "CAST(c_custkey % 3 - 1 AS INT) AS level",
            "CAST(1 + c_custkey % 3 AS INT) AS class",
        ],
        None,
    ),
    "fx_tris": (
        "customer",
        [],
        [
            "c_custkey AS bid",
            "CAST((c_custkey - c_custkey % 1500) / 1500 AS INT) AS district",
            "CAST((c_custkey * 48271 + 3) % 65521 % 1000 AS DOUBLE) AS xa",
            "CAST((c_custkey * 16807 + 9) % 65521 % 1000 AS DOUBLE) AS ya",
            "CAST((c_custkey * 48271 + 3) % 65521 % 1000 + 6 + c_custkey % 11 AS DOUBLE) AS xb",
            "CAST((c_custkey * 16807 + 9) % 65521 % 1000 + 2 + c_custkey % 3 AS DOUBLE) AS yb",
            "CAST((c_custkey * 48271 + 3) % 65521 % 1000 + 3 + c_custkey % 5 AS DOUBLE) AS xc",
            "CAST((c_custkey * 16807 + 9) % 65521 % 1000 + 7 + c_custkey % 9 AS DOUBLE) AS yc",
            "CAST(c_custkey % 4 AS INT) AS class",
            "CAST(c_custkey % 3 - 1 AS INT) AS level",
        ],
        None,
    ),
    "fx_poi_a": (
        "part",
        [],
        [
            "p_partkey AS id",
            "CAST((p_partkey - p_partkey % 2000) / 2000 AS INT) AS district",
            "CASE WHEN p_partkey % 6 = 0 THEN NULL ELSE p_brand END AS name",
            "CAST((p_partkey * 48271 + 17) % 65521 % 10000 AS DOUBLE) / 10 AS x",
            "CAST((p_partkey * 16807 + 23) % 65521 % 10000 AS DOUBLE) / 10 AS y",
            "CASE p_size % 4 WHEN 0 THEN 'amenity' WHEN 1 THEN 'shop' WHEN 2 THEN 'office' ELSE 'craft' END AS key",
            "CASE p_size % 3 WHEN 0 THEN 'cafe' WHEN 1 THEN 'parking' ELSE 'bank' END AS value",
        ],
        None,
    ),
    "fx_poi_b": (
        "part",
        [],
        [
            "p_partkey + 1000000 AS id",
            "CAST((p_partkey - p_partkey % 2000) / 2000 AS INT) AS district",
            """CASE WHEN p_partkey % 5 = 0 THEN NULL
               WHEN p_partkey % 2 = 0 THEN concat(' ', upper(p_brand)) ELSE p_brand END AS name""",
            "CAST((p_partkey * 48271 + 17) % 65521 % 10000 + p_partkey % 601 - 300 AS DOUBLE) / 10 AS x",
            "CAST((p_partkey * 16807 + 23) % 65521 % 10000 AS DOUBLE) / 10 AS y",
            "CAST(p_partkey % 101 AS DOUBLE) / 100 AS confidence",
            "p_type AS category",
        ],
        None,
    ),
    "fx_stops": (
        "supplier",
        [],
        [
            "CAST(s_suppkey AS STRING) AS stop_id",
            "s_name AS name",
            "CAST((s_suppkey * 48271 + 29) % 65521 % 1000 AS DOUBLE) AS x",
            "CAST((s_suppkey * 16807 + 31) % 65521 % 1000 AS DOUBLE) AS y",
            "CASE WHEN s_suppkey % 9 = 0 THEN '1' ELSE '0' END AS location_type",
        ],
        None,
    ),
    "fx_stop_times": (
        "lineitem",
        [],
        [
            "CAST(l_orderkey AS STRING) AS trip_id",
            "CAST(l_suppkey AS STRING) AS stop_id",
            "l_linenumber AS stop_sequence",
            "CASE l_returnflag WHEN 'R' THEN '1' WHEN 'A' THEN '0' ELSE NULL END AS pickup_type",
            """concat(lpad(CAST(5 + (l_orderkey * 7 + l_linenumber) % 22 AS STRING), 2, '0'), ':',
               lpad(CAST((l_orderkey * 13 + l_linenumber * 5) % 60 AS STRING), 2, '0'), ':00') AS departure_time""",
        ],
        None,
    ),
    "fx_trips": (
        "orders",
        [],
        [
            "CAST(o_orderkey AS STRING) AS trip_id",
            "CAST(o_custkey % 40 AS STRING) AS route_id",
            "o_orderstatus AS service_id",
            "concat(CAST(o_custkey % 40 AS STRING), '-', substr(o_orderpriority, 1, 1)) AS shape_id",
        ],
        None,
    ),
    "fx_shapes": (
        "orders",
        [],
        [
            "concat(CAST(o_custkey % 40 AS STRING), '-', substr(o_orderpriority, 1, 1)) AS shape_id",
            "o_orderkey AS seq",
            "CAST((o_orderkey * 48271 + 29) % 65521 % 1000 AS DOUBLE) AS x",
            "CAST((o_orderkey * 16807 + 31) % 65521 % 1000 AS DOUBLE) AS y",
        ],
        None,
    ),
    "fx_transit_routes": (
        "part",
        [],
        [
            "CAST(p_partkey AS STRING) AS route_id",
            "CAST(p_partkey % 15 AS STRING) AS route_short_name",
            "CAST(p_partkey % 4 AS STRING) AS route_type",
            "CAST(p_partkey % 7 AS STRING) AS agency_id",
        ],
        None,
    ),
    "fx_routes": (
        "orders",
        [],
        [
            "o_orderkey AS route_id",
            "CAST((o_orderkey - o_orderkey % 150) / 150 AS BIGINT) AS crop_id",
            "CAST((o_orderkey * 48271 + 41) % 65521 % 32 AS DOUBLE) + 0.5 AS sx",
            "CAST((o_orderkey * 16807 + 43) % 65521 % 32 AS DOUBLE) + 0.5 AS sy",
            "CAST((o_orderkey * 48271 + 4100) % 65521 % 31 AS DOUBLE) + 0.5 AS gx",
            "CAST((o_orderkey * 16807 + 4300) % 65521 % 29 AS DOUBLE) + 0.5 AS gy",
            "CAST(20 + o_orderkey % 41 AS DOUBLE) AS teacher_m",
            "CAST(1 + o_orderkey % 9 AS INT) AS n_goal",
            "CAST(o_orderkey % 4 AS INT) AS stratum",
        ],
        None,
    ),
    # predicted polylines of 2 to 6 points; every 7th starts 8 m off, every 6th route has no answer
    "fx_route_points": (
        "orders",
        [("k", "2 + o_orderkey % 5")],
        [
            "o_orderkey AS route_id",
            "CAST(k + 1 AS INT) AS pos",
            """round(CAST((o_orderkey * 48271 + 41) % 65521 % 32 AS DOUBLE) + 0.5
               + (CAST((o_orderkey * 48271 + 4100) % 65521 % 31 AS DOUBLE)
                  - CAST((o_orderkey * 48271 + 41) % 65521 % 32 AS DOUBLE)) * k / (1 + o_orderkey % 5)
               + (CASE WHEN o_orderkey % 7 = 0 AND k = 0 THEN 8 ELSE 0 END), 3) AS x""",
            """round(CAST((o_orderkey * 16807 + 43) % 65521 % 32 AS DOUBLE) + 0.5
               + (CAST((o_orderkey * 16807 + 4300) % 65521 % 29 AS DOUBLE)
                  - CAST((o_orderkey * 16807 + 43) % 65521 % 32 AS DOUBLE)) * k / (1 + o_orderkey % 5), 3) AS y""",
        ],
        "o_orderkey % 6 <> 0",
    ),
    "fx_dense_lines": (
        "customer",
        [("k", "25")],
        [
            "c_custkey AS line_id",
            "CAST((c_custkey - c_custkey % 15) / 15 AS BIGINT) AS crop_id",
            "CAST(k AS INT) AS pos",
            "CAST(k + 3 AS DOUBLE) + 0.5 AS x",
            "CAST(4 + c_custkey % 20 + (c_custkey * 31 + k * k * 7) % 5 AS DOUBLE) + 0.5 AS y",
        ],
        None,
    ),
    "fx_answers": (
        "orders",
        [],
        [
            "o_orderkey AS route_id",
            """CASE o_orderkey % 6
               WHEN 0 THEN concat('[[', CAST(o_orderkey % 900 AS STRING), ',10],[500,',
                                  CAST(o_orderkey % 700 AS STRING), ']]')
               WHEN 1 THEN concat('{"path": [[1,2],[3,', CAST(o_orderkey % 50 AS STRING), ']]}')
               WHEN 2 THEN concat('go [', CAST(o_orderkey % 90 AS STRING), ', 5] then [7, 8')
               WHEN 3 THEN ''
               WHEN 4 THEN concat('ok ```json {"route": [[5,6],[7,', CAST(o_orderkey % 30 AS STRING), '.5]]} ``` done')
               ELSE concat('first [1, 2] then [', CAST(o_orderkey % 90 AS STRING), ', 4]') END AS text""",
        ],
        None,
    ),
    "fx_eval_rows": (
        "events",
        [],
        [
            "user_id AS run_id",
            "CAST(event_id % 50 AS INT) AS step",
            "event_type AS metric",
            "value",
            "event_id AS seq",
        ],
        None,
    ),
}



def _sql_of(view: str) -> str:
    table, gens, exprs, where = VIEWS[view]
    src = table
    for name, size in gens:
        src = f"(SELECT *, CAST(unnest(range({size})) AS BIGINT) AS {name} FROM {src})"
    text = f"SELECT {', '.join(exprs)} FROM {src}"
    return text + (f" WHERE {where}" if where else "")


def _values_sql(rows, cols) -> str:
    def lit(v):
        return "NULL" if v is None else (f"'{v}'" if isinstance(v, str) else str(v))

    body = ", ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in rows)
    return f"SELECT * FROM (VALUES {body}) AS t({', '.join(cols)})"


SQL = {v: _sql_of(v) for v in VIEWS}
SQL["fx_tasks"] = _values_sql(TASK_ROWS, ("task_key", "layer_a", "class_a", "layer_b", "class_b"))
SQL["fx_calendar_dates"] = _values_sql(CALENDAR_DATE_ROWS, ("service_id", "date", "exception_type"))
SQL["fx_calendar"] = _values_sql(CALENDAR_ROWS, ("service_id", "monday", "tuesday", "start_date", "end_date"))
SQL["fx_grid"] = (
    "SELECT vec_id AS sample_id, CAST(label AS INT) AS task_id, CAST((i - i % 8) / 8 AS INT) AS gr, "
    "CAST(i % 8 AS INT) AS gc, CAST(embedding[i + 1] AS DOUBLE) AS score "
    "FROM (SELECT *, unnest(range(64)) AS i FROM embeddings)"
)
# score table with its truth; leaves misses and false marks
SQL["fx_marks"] = (
    "SELECT sample_id, task_id, gr, gc, score, score + (((sample_id * 64 + gr * 8 + gc) * 48271) % 65521 % 100)"
    " / 500.0 - 0.1 > 0.05 AS tgt, score > 0.05 AS pred FROM fx_grid"
)


ROWS_A_TASK = 1 << 19  # rows one task makes, about
_COUNTED: dict[tuple[str, str, str], int] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt_out(spark: SparkSession, sf_dir: str, base: str, times: int) -> DataFrame:
    """A table whose rows will be repeated ``times`` times, dealt by its key to as many tasks as the made rows need.

    A small file is read by one task, which would make the rows of all windows. The tasks hold whole windows, so
    aggregates by window and cell need no shuffle after this one of the small table.
    """
    df = table(spark, sf_dir, base)
    read = spark.sparkContext.applicationId, sf_dir, base
    if read not in _COUNTED:
        _COUNTED[read] = df.count()
    parts = -(-_COUNTED[read] * times // ROWS_A_TASK)
    return df.repartition(parts, df.columns[0]) if parts > 1 else df


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the derived views as a lazy DataFrame; column pruning reaches the scan."""
    base, gens, exprs, where = VIEWS[name]
    sizes = [MOST.get(size) or int(size) for _, size in gens]
    df = dealt_out(spark, sf_dir, base, prod(sizes)) if gens else table(spark, sf_dir, base)
    if where:
        df = df.filter(where)
    for (gen, size), most in zip(gens, sizes):
        df = numbered(df, gen, most)
        if size in MOST:
            df = df.filter(f"{gen} < {size}")
    return df.selectExpr(*exprs)


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return numbered(dealt_out(spark, sf_dir, "embeddings", 64), "p", 64).selectExpr(
        "vec_id AS sample_id",
        "CAST(label AS INT) AS task_id",
        "CAST(p DIV 8 AS INT) AS gr",
        "CAST(p % 8 AS INT) AS gc",
        "CAST(get(embedding, CAST(p AS INT)) AS DOUBLE) AS score",
    )


def marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid(spark, sf_dir).selectExpr(
        "sample_id", "task_id", "gr", "gc", "score",
        "score + (((sample_id * 64 + gr * 8 + gc) * 48271) % 65521 % 100) / 500.0D - 0.1D > 0.05D AS tgt",
        "score > 0.05D AS pred",
    )


def tasks(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        TASK_ROWS, "task_key string, layer_a string, class_a int, layer_b string, class_b int"
    )


def calendar_dates(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CALENDAR_DATE_ROWS, "service_id string, date string, exception_type string")


def calendar(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        CALENDAR_ROWS, "service_id string, monday string, tuesday string, start_date string, end_date string"
    )
