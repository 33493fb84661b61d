"""Sources and sinks on texts and files that Spark derives from the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from cellweave.plans import fixtures as fx
from cellweave.plans.q_vector import label_places
from cellweave.plans.registry import query
from cellweave.session import scratch_folder
from cellweave.sources import features as ft
from cellweave.sources import jsonl
from cellweave.sources import tables as tb

PAGE_TEXT = """concat('{"features": [{"id": "a', c_custkey, '", "properties": {"function": "', c_mktsegment, '", "level": "', c_custkey % 3 - 1,
    '"}, "geometry": {"type": "Point", "coordinates": [', c_custkey % 100, '.5, ', c_nationkey, ']}}, {"id": "b', c_custkey,
    '", "properties": {"function": "none"}, "geometry": ', IF(c_custkey % 4 = 0, 'null', '{"type": "Point", "coordinates": [1, 2]}'), '}]}')"""


def pages(spark, sf):
    return fx.table(spark, sf, "customer").selectExpr(f"{PAGE_TEXT} AS value")


@query("s01_feature_pages", """SELECT 'a' || c_custkey AS id, c_mktsegment AS func, CAST(c_custkey % 3 - 1 AS INT) AS level, c_custkey % 100 + 0.5::DOUBLE AS x,
    CAST(c_nationkey AS DOUBLE) AS y FROM customer UNION ALL SELECT 'b' || c_custkey, 'none', NULL, 1, 2 FROM customer WHERE c_custkey % 4 <> 0""")
def feature_pages(spark, sf):
    rows = ft.with_geometry(ft.features(pages(spark, sf), ft.POINT_COORDS))
    return rows.select(
        "id", F.col("properties")["function"].alias("func"), F.try_element_at("properties", F.lit("level")).cast("int").alias("level"),
        F.col("geometry.coordinates")[0].alias("x"), F.col("geometry.coordinates")[1].alias("y"))


@query("s01_rejected_features", "SELECT 2 * count(*) AS features, count(*) FILTER (WHERE c_custkey % 4 = 0) AS rejected FROM customer")
def rejected_features(spark, sf):
    return ft.rejected(ft.features(pages(spark, sf), ft.POINT_COORDS))


@query("s02_document_in_box", """SELECT c_custkey AS id, CASE c_custkey % 8 WHEN 1 THEN '50-55 dB' WHEN 2 THEN '55-60 dB' WHEN 3 THEN '60-65 dB' WHEN 4 THEN '65-70 dB' WHEN 5 THEN '70-75 dB'
    WHEN 6 THEN '75 dB and above' ELSE '<unknown lden band ' || c_custkey % 8 || '>' END AS label FROM customer WHERE c_custkey % 50 + 4 >= 10 AND c_custkey % 50 <= 20""")
def document_in_box(spark, sf):
    from cellweave.operators.project import decode_band
    from cellweave.operators.raster import touching_box

    docs = fx.table(spark, sf, "customer").selectExpr("""concat('{"features": [{"id": "', c_custkey, '", "properties": {"legend": "', c_custkey % 8,
        '"}, "geometry": {"type": "Polygon", "coordinates": [[[', c_custkey % 50, ',0],[', c_custkey % 50 + 4, ',0],[', c_custkey % 50 + 4, ',30],[', c_custkey % 50, ',30]]]}}]}') AS value""")
    rows = ft.with_geometry(ft.features(docs, ft.POLYGON_COORDS)).select(
        F.col("id").cast("bigint").alias("id"), F.col("properties")["legend"].alias("code"), ft.as_rings(F.col("geometry.coordinates")).alias("rings"))
    near = touching_box(rows, ["id", "code"], 10, 10, 20, 20).withColumn("period", F.lit("lden"))
    return decode_band(near).select("id", "label")


@query("s03_city_footprints", """SELECT 'B' || c_custkey AS id, 0 AS surface, 2 AS n_rings, 4 AS n_points, round(CAST(c_custkey * 0.001 + 100 AS DOUBLE), 6) AS x0, round(CAST(10 * 0.001 + 200 AS DOUBLE), 6) AS y2 FROM customer
    UNION ALL SELECT 'B' || c_custkey, 2, 1, 3, round(CAST(c_custkey * 0.001 + 100 AS DOUBLE), 6), round(CAST(10 * 0.001 + 200 AS DOUBLE), 6) FROM customer""")
def city_footprints(spark, sf):
    docs = fx.table(spark, sf, "customer").selectExpr("""concat('{"transform": {"scale": [0.001, 0.001, 1], "translate": [100, 200, 0]}, "features": [{"id": "B', c_custkey,
        '", "boundaries": [[[0,1,2,3],[1,2],[0,1,2]],[[0,1]],[[0,1,2]]], "vertices": [[', c_custkey, ',0,0],[', c_custkey + 10, ',0,0],[', c_custkey + 10, ',10,0],[', c_custkey, ',10,0]]}]}') AS value""")
    f = ft.city_footprints(docs)
    ring = F.col("rings")[0]
    return f.select("id", "surface", F.size("rings").alias("n_rings"), F.size(ring).alias("n_points"), F.round(ring[0]["x"], 6).alias("x0"), F.round(ring[2]["y"], 6).alias("y2"))


@query("s04_tagged_elements", """SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN 'way' ELSE 'node' END AS type, 52.0 + p_partkey % 10::DOUBLE AS lat, CASE WHEN p_size % 2 = 0 THEN 'amenity' ELSE 'shop' END AS primary_key,
    CASE WHEN p_size % 2 = 0 THEN 'food&drink' ELSE 'shop' END AS poi_class, CAST(3 AS INT) AS n_tags, CASE WHEN p_size % 2 = 0 THEN '{"amenity":"cafe","name":"' || p_name || '","phone":"1"}'
      ELSE '{"name":"' || p_name || '","phone":"1","shop":"' || p_brand || '"}' END AS tags_json, '1' AS phone FROM part WHERE p_partkey % 7 <> 0""")
def tagged_elements(spark, sf):
    lines = fx.table(spark, sf, "part").selectExpr("""concat('{"type": "', IF(p_partkey % 3 = 0, 'way', 'node'), '", "id": ', p_partkey,
        CASE WHEN p_partkey % 7 = 0 THEN '' WHEN p_partkey % 3 = 0 THEN concat(', "center": {"lat": ', 52 + p_partkey % 10, ', "lon": 4.9}') ELSE concat(', "lat": ', 52 + p_partkey % 10, ', "lon": 4.9') END,
        ', "tags": {"phone": "1", "name": "', p_name, '", ', IF(p_size % 2 = 0, '"amenity": "cafe"', concat('"shop": "', p_brand, '"')), '}}') AS value""")
    return ft.tagged_elements(lines).select("id", "type", "lat", "primary_key", "poi_class", "n_tags", "tags_json", "phone")


@query("s05_flat_places", """SELECT CAST(p_partkey AS VARCHAR) AS id, p_name AS name_primary, p_type AS category_primary, CASE WHEN p_size % 3 <> 0 THEN p_brand END AS address_freeform,
    CASE WHEN p_size % 5 = 0 THEN NULL WHEN p_size % 2 = 0 THEN 'meta' ELSE 'meta,osm' END AS source_datasets, p_size % 3 = 0 AS no_addresses_json FROM part""")
def flat_places(spark, sf):
    places = fx.table(spark, sf, "part").selectExpr(
        "CAST(p_partkey AS STRING) AS id", "struct(p_name AS primary) AS names", "struct(p_type AS primary) AS categories", "CAST(0.5 AS DOUBLE) AS confidence",
        "IF(p_size % 3 = 0, CAST(array() AS ARRAY<STRUCT<freeform: STRING, locality: STRING>>), array(struct(p_brand AS freeform, 'x' AS locality), struct('z' AS freeform, 'y' AS locality))) AS addresses",
        """CASE WHEN p_size % 5 = 0 THEN CAST(array() AS ARRAY<STRUCT<dataset: STRING>>) WHEN p_size % 2 = 0 THEN array(struct('meta' AS dataset), struct('meta' AS dataset))
           ELSE array(struct('osm' AS dataset), struct('meta' AS dataset), struct('' AS dataset)) END AS sources""")
    return ft.flat_places(places).select("id", "name_primary", "category_primary", "address_freeform", "source_datasets", F.col("addresses_json").isNull().alias("no_addresses_json"))


@query("s06_text_table", """SELECT pickup_type, count(*) AS n, min(departure_time) AS first_departure FROM fx_stop_times GROUP BY 1""")
def text_table(spark, sf):
    path = scratch_folder(spark)
    fx.view(spark, sf, "fx_stop_times").write.csv(path, header=True, nullValue="")
    st = tb.text_table(spark, path, ["trip_id", "stop_id", "stop_sequence", "pickup_type", "departure_time"])
    return st.groupBy("pickup_type").agg(F.count("*").alias("n"), F.min("departure_time").alias("first_departure"))


@query("s07_mosaic", """t AS (SELECT crop_id // 16 AS district, crop_id AS tile, (crop_id % 16) // 4 * 28 AS top, crop_id % 4 * 28 AS lft, row, col, CASE WHEN surface <> 3 THEN noise7 END AS v FROM fx_raster)
    SELECT district, CAST(row + top - 20 AS INT) AS row, CAST(col + lft - 20 AS INT) AS col, arg_max(v, tile) AS value FROM t WHERE v IS NOT NULL AND row + top BETWEEN 20 AND 99 AND col + lft BETWEEN 20 AND 99 GROUP BY 1, 2, 3""")
def mosaic(spark, sf):
    tiles = fx.view(spark, sf, "fx_raster").selectExpr(
        "crop_id DIV 16 AS district", "crop_id AS tile_order", "CAST(crop_id % 16 DIV 4 * 28 AS INT) AS top", "CAST(crop_id % 4 * 28 AS INT) AS left", "row", "col", "IF(surface <> 3, noise7, NULL) AS value")
    return tb.mosaic(tiles, (20, 20, 100, 100), ["district"])


PRED_TEXT = """CASE WHEN o_orderkey % 11 = 0 THEN '{"route": 1, "points": [[1' WHEN o_orderkey % 13 = 0 THEN '{"points": []}'
    ELSE concat('{"route": ', CAST(o_orderkey % 5000 AS STRING), ', "points": ', CASE WHEN o_orderkey % 3 = 0 THEN 'null' ELSE concat('[[1,', CAST(o_orderkey AS STRING), '],[3.5,4]]') END, '}') END AS value"""


@query("s08_prediction_lines", """k AS (SELECT o_orderkey % 5000 AS route_id, max(o_orderkey) AS k FROM orders WHERE o_orderkey % 11 <> 0 AND o_orderkey % 13 <> 0 GROUP BY 1)
    SELECT route_id, CAST(pos AS INT) AS pos, CASE pos WHEN 0 THEN 1.0 ELSE 3.5 END::DOUBLE AS x, CASE pos WHEN 0 THEN k ELSE 4 END::DOUBLE AS y FROM k, (SELECT unnest([0, 1]) AS pos) p WHERE k % 3 <> 0""")
def prediction_lines(spark, sf):
    text = fx.table(spark, sf, "orders").selectExpr(PRED_TEXT, "o_orderkey AS line_no")
    return jsonl.point_rows(jsonl.predictions(text))


@query("s11_manifest", """e AS (SELECT lang || '_' || source AS layer, doc_id AS stamp, octet_length(encode(text)) AS bytes, sha256(text) AS sha256 FROM documents)
    SELECT layer, arg_max(bytes, stamp) AS bytes, arg_max(sha256, stamp) AS sha256, max(stamp) AS stamp FROM e GROUP BY 1""")
def manifest(spark, sf):
    d = fx.table(spark, sf, "documents").select(
        F.concat_ws("_", "lang", "source").alias("layer"), F.octet_length("text").cast("bigint").alias("bytes"), F.sha2("text", 256).alias("sha256"), F.col("doc_id").alias("stamp"))
    return tb.update_manifest(d.filter("stamp % 2 = 0"), d.filter("stamp % 2 = 1"))


LAYER_DOCS = """SELECT doc_id, concat(coalesce(lang, 'none'), '_', coalesce(source, 'none')) AS layer, CAST((doc_id - doc_id % 1024) / 1024 AS BIGINT) AS part, coalesce(text, '') AS line FROM {docs}"""
REPLACED = "part % 2 = 0 AND layer >= 'f'"  # layers a second batch delivers anew, each line with its id


@query("s11_manifest_of_files", f"""d AS ({LAYER_DOCS.format(docs="documents")}),
    c AS (SELECT layer, part, CAST(CASE WHEN {REPLACED} THEN 2 ELSE 1 END AS INT) AS stamp,
      string_agg((CASE WHEN {REPLACED} THEN doc_id || ' ' || line ELSE line END) || chr(10), '' ORDER BY doc_id, line) AS content FROM d GROUP BY 1, 2, 3)
    SELECT layer, part, octet_length(encode(content)) AS bytes, CAST(length(content) - length(replace(content, chr(10), '')) AS BIGINT) AS lines,
      sha256(content) AS sha256, stamp, TRUE AS stamped_utc FROM c""")
def manifest_of_files(spark, sf):
    """Files of two batches, the second one replaces some layers; entries are read back from the files themselves."""
    first = spark.sql(LAYER_DOCS.format(docs="{docs}"), docs=fx.table(spark, sf, "documents"))
    second = first.filter(REPLACED).withColumn("line", F.concat_ws(" ", "doc_id", "line"))
    found = []
    for stamp, rows in ((1, first), (2, second)):
        path = scratch_folder(spark)
        tb.write_layers(rows.withColumn("text", F.col("line")), path, ["layer", "part"], ["doc_id", "line"], "text")
        found.append(tb.provenance(spark, path, "*.txt").withColumn("stamp", F.lit(stamp)))
    return tb.update_manifest(*found, keys=["layer", "part"]).select(
        "layer", F.col("part").cast("bigint").alias("part"), "bytes", "lines", "sha256", "stamp",
        F.col("changed").rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\dZ$").alias("stamped_utc"))


@query("s12_output_per_source_and_period", "SELECT lang, source, count(*) AS n FROM documents GROUP BY 1, 2")
def output_per_source_and_period(spark, sf):
    path = scratch_folder(spark)
    d = fx.table(spark, sf, "documents").select("doc_id", "lang", "source")
    tb.write_by(d, path, ["lang", "source"])
    return spark.read.schema("doc_id BIGINT, lang STRING, source STRING").parquet(path).groupBy("lang", "source").agg(F.count("*").alias("n"))


@query("s13_crop_index", """c AS (SELECT s_suppkey AS crop_id, CAST(s_suppkey // 100 AS INT) AS district, CAST((s_suppkey * 48271 + 13) % 65521 % 900 AS INT) AS dx, CAST((s_suppkey * 16807 + 19) % 65521 % 900 AS INT) AS dy FROM supplier),
    p AS (SELECT district, id, x, y, CASE WHEN key = 'amenity' AND value = 'cafe' THEN 3 WHEN key = 'amenity' AND value = 'bank' THEN 1 WHEN key = 'shop' THEN 2 WHEN key IN ('office', 'craft') THEN 1 END AS cls FROM fx_poi_a WHERE name IS NOT NULL),
    h AS (SELECT c.crop_id, p.id, p.cls FROM c JOIN p ON p.district = c.district AND cls IS NOT NULL AND x >= dx AND x < dx + 64 AND y >= dy AND y < dy + 64),
    g AS (SELECT crop_id, count(*) AS n, '[' || string_agg('{"id":' || id || ',"cls":' || cls || '}', ',' ORDER BY id) || ']' AS places FROM h GROUP BY 1)
    SELECT c.crop_id, dx || ',' || dy || ',' || (dx + 64) || ',' || (dy + 64) AS bbox, coalesce(n, 0) AS n_places, coalesce(places, '[]') AS places FROM c LEFT JOIN g USING (crop_id)""")
def crop_index(spark, sf):
    crops = fx.table(spark, sf, "supplier").selectExpr(
        "s_suppkey AS crop_id", "CAST(s_suppkey DIV 100 AS INT) AS district", "CAST((s_suppkey * 48271 + 13) % 65521 % 900 AS INT) AS dx", "CAST((s_suppkey * 16807 + 19) % 65521 % 900 AS INT) AS dy")
    return tb.crop_index(crops, label_places(spark, sf), 64)


@query("s14_raster_sink", """SELECT crop_id // 16 AS district, CAST((crop_id % 16) // 4 * 32 + row AS INT) AS row, CAST(crop_id % 4 * 32 + col AS INT) AS col, surface FROM fx_raster""")
def raster_sink(spark, sf):
    from cellweave.plans.q_raster import mosaic as district_cells

    path = scratch_folder(spark)
    tb.write_raster(district_cells(spark, sf), path, block=64)
    back = tb.read_raster(spark, path, "district BIGINT, row INT, col INT, surface INT, block STRING")
    return back.drop("block")


@query("s15_ragged_lists", """SELECT route_id, count(*) AS n, round(sum(x), 6) AS sum_x, arg_max(y, pos) AS last_y FROM fx_route_points GROUP BY 1""")
def ragged_lists(spark, sf):
    """Vertex rows to one list per route and back to rows."""
    lists = fx.view(spark, sf, "fx_route_points").groupBy("route_id").agg(F.array_sort(F.collect_list(F.struct("pos", "x", "y"))).alias("poly"))
    rows = lists.select("route_id", F.explode("poly").alias("p")).select("route_id", "p.*")
    return rows.groupBy("route_id").agg(F.count("*").alias("n"), F.round(F.sum("x"), 6).alias("sum_x"), F.max_by("y", "pos").alias("last_y"))


@query("s16_pack_bits", """SELECT sample_id, gr AS row, lpad(upper(to_hex(CAST(sum(CASE WHEN score > 0.1 THEN 1 << (7 - gc) ELSE 0 END) AS BIGINT))), 2, '0') AS bits FROM fx_grid GROUP BY 1, 2
    HAVING bool_or(score > 0.1)""")
def pack_bits(spark, sf):
    lit = fx.grid(spark, sf).filter("score > 0.1").selectExpr("sample_id", "gr AS row", "gc AS col")
    return tb.pack_bits(lit, ["sample_id"], 8).withColumn("bits", F.hex("bits"))


@query("s16_unpack_bits", "SELECT sample_id, gr AS row, gc AS col FROM fx_grid WHERE score > 0.1")
def unpack_bits(spark, sf):
    lit = fx.grid(spark, sf).filter("score > 0.1").selectExpr("sample_id", "gr AS row", "gc AS col")
    return tb.unpack_bits(tb.pack_bits(lit, ["sample_id"], 8), ["sample_id"], 8)
