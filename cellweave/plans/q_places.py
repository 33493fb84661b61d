"""Places and register queries: classes, matches between sources, frequency tables, profiles."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from cellweave.functions import places as pl
from cellweave.operators import places, ranking
from cellweave.plans import fixtures as fx
from cellweave.plans.registry import query

CLASS_SQL = """CASE WHEN key = 'amenity' AND value = 'cafe' THEN 'food&drink' WHEN key = 'amenity' AND value = 'parking'
    THEN 'transport' WHEN key = 'amenity' AND value = 'bank' THEN 'services' WHEN key = 'shop' THEN 'shop'
    WHEN key = 'office' OR key = 'craft' THEN 'services' ELSE 'other' END"""


def poi_a(spark, sf):
    return fx.view(spark, sf, "fx_poi_a")


def poi_b(spark, sf):
    return fx.view(spark, sf, "fx_poi_b")


@query("p01_select_and_rename", """SELECT p_partkey AS id, p_name AS label, CAST(NULL AS VARCHAR) AS missing FROM part""")
def select_and_rename(spark, sf):
    from cellweave.operators.project import rename_attributes

    part = fx.table(spark, sf, "part")
    return rename_attributes(part, {"id": "p_partkey", "label": "p_name", "missing": "p_absent"})


@query("p02_keep_first_seen", """SELECT key, id, dropped FROM (SELECT l_orderkey * 10 + l_linenumber AS key,
    l_partkey * 100000 + l_suppkey AS id, row_number() OVER (PARTITION BY l_orderkey * 10 + l_linenumber
      ORDER BY l_partkey, l_suppkey, l_extendedprice) AS rn, count(*) OVER (PARTITION BY l_orderkey * 10 + l_linenumber) - 1
      AS dropped FROM lineitem) WHERE rn = 1""")
def keep_first_seen(spark, sf):
    from cellweave.operators.project import keep_first

    rows = fx.table(spark, sf, "lineitem").selectExpr(
        "l_orderkey * 10 + l_linenumber AS key", "l_partkey * 100000 + l_suppkey AS id",
        "l_partkey", "l_suppkey", "l_extendedprice",
    )
    order = [F.col("l_partkey"), F.col("l_suppkey"), F.col("l_extendedprice")]
    return keep_first(rows, ["key"], order, ["id"])


@query("p03_decode_bands", """r AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 2 = 0 THEN 'lden' ELSE 'lnight' END AS period,
      CASE c_custkey % 7 WHEN 0 THEN 'x' || CAST(c_custkey % 3 AS VARCHAR) ELSE CAST(c_custkey % 20 AS VARCHAR) END AS code FROM customer),
    d AS (SELECT * FROM (VALUES ('lden', 1, '50-55 dB', 50.0, 55.0), ('lden', 2, '55-60 dB', 55.0, 60.0),
      ('lden', 3, '60-65 dB', 60.0, 65.0), ('lden', 4, '65-70 dB', 65.0, 70.0), ('lden', 5, '70-75 dB', 70.0, 75.0),
      ('lden', 6, '75 dB and above', 75.0, NULL), ('lnight', 11, '45-50 dB', 45.0, 50.0), ('lnight', 12, '50-55 dB', 50.0, 55.0),
      ('lnight', 13, '55-60 dB', 55.0, 60.0), ('lnight', 14, '60-65 dB', 60.0, 65.0), ('lnight', 15, '65-70 dB', 65.0, 70.0),
      ('lnight', 16, '70 dB and above', 70.0, NULL)) AS t(period, code, label, lo, hi))
    SELECT r.id, coalesce(d.label, CASE WHEN try_cast(r.code AS INT) IS NULL THEN '<unparseable ' || r.period || ' band ' || r.code || '>'
      ELSE '<unknown ' || r.period || ' band ' || r.code || '>' END) AS label,
      CAST(d.lo AS DOUBLE) AS db_min, CAST(d.hi AS DOUBLE) AS db_max
    FROM r LEFT JOIN d ON d.period = r.period AND d.code = try_cast(r.code AS INT)""")
def decode_bands(spark, sf):
    from cellweave.operators.project import decode_band

    rows = fx.table(spark, sf, "customer").selectExpr(
        "c_custkey AS id", "CASE WHEN c_custkey % 2 = 0 THEN 'lden' ELSE 'lnight' END AS period",
        "CASE c_custkey % 7 WHEN 0 THEN 'x' || CAST(c_custkey % 3 AS STRING) ELSE CAST(c_custkey % 20 AS STRING) END AS code",
    )
    return decode_band(rows).select("id", "label", "db_min", "db_max")


@query("p04_coarse_class", f"SELECT id, {CLASS_SQL} AS poi_class FROM fx_poi_a")
def coarse_class(spark, sf):
    return poi_a(spark, sf).select("id", pl.coarse_class(F.col("key"), F.col("value")).alias("poi_class"))


@query("p05_primary_tag", """SELECT p_partkey AS id, CASE WHEN p_size % 4 = 0 THEN 'amenity' WHEN p_size % 3 = 0 THEN 'shop'
    WHEN p_size % 5 = 0 THEN 'tourism' END AS primary_key, CASE WHEN p_size % 4 = 0 THEN p_brand WHEN p_size % 3 = 0 THEN p_type
    WHEN p_size % 5 = 0 THEN p_name END AS primary_value FROM part""")
def primary_tag(spark, sf):
    tags = fx.table(spark, sf, "part").selectExpr(
        "p_partkey AS id",
        """map_filter(map('tourism', IF(p_size % 5 = 0, p_name, NULL), 'shop', IF(p_size % 3 = 0, p_type, NULL),
           'amenity', IF(p_size % 4 = 0, p_brand, NULL)), (k, v) -> v IS NOT NULL) AS tags""",
    )
    key = pl.primary_key(F.col("tags"))
    return tags.select("id", key.alias("primary_key"), F.try_element_at("tags", key).alias("primary_value"))


@query("p06_height_above_ground", """SELECT c_custkey AS id, try_cast(CASE WHEN c_custkey % 9 = 0 THEN 'n/a'
      ELSE CAST(1500 + c_custkey % 500 AS VARCHAR) END AS INT) AS built,
    round(c_acctbal / 100 - c_nationkey, 6) AS height_m FROM customer""")
def height_above_ground(spark, sf):
    return fx.table(spark, sf, "customer").selectExpr(
        "c_custkey AS id",
        "try_cast(CASE WHEN c_custkey % 9 = 0 THEN 'n/a' ELSE CAST(1500 + c_custkey % 500 AS STRING) END AS INT) AS built",
        "round(c_acctbal / 100 - c_nationkey, 6) AS height_m",
    )


@query("j06_name_matches", """a AS (SELECT *, lower(trim(name)) AS nk FROM fx_poi_a WHERE trim(name) <> ''),
    b AS (SELECT *, lower(trim(name)) AS nk FROM fx_poi_b WHERE trim(name) <> ''),
    near AS (SELECT a.district, a.id AS ai, b.id AS bi, a.nk = b.nk AS same,
      sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS d FROM a JOIN b ON a.district = b.district
      AND b.x BETWEEN a.x - 30.1 AND a.x + 30.1
      AND sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) <= 30),
    n AS (SELECT district, count(*) AS a_named FROM a GROUP BY 1)
    SELECT district, max(a_named) AS a_named, count(*) FILTER (WHERE same) AS pairs, count(DISTINCT ai) FILTER (WHERE same) AS a_matched,
    count(DISTINCT bi) FILTER (WHERE same) AS b_matched, count(*) AS candidates,
    round(quantile_cont(d, 0.5) FILTER (WHERE same), 6) AS median_m FROM near JOIN n USING (district) GROUP BY 1""")
def name_matches(spark, sf):
    out = places.name_matches(poi_a(spark, sf), poi_b(spark, sf), ["district"], 30.0)
    return out.select(
        "district", "a_named", "pairs", "a_matched", "b_matched", "candidates", F.round("p50", 6).alias("median_m")
    )


@query("a13_frequency_table", """SELECT coalesce(name, '<null>') AS name, count(*) AS n, round(sum(x), 3) AS sum_x,
    round(quantile_cont(x, 0.5), 6) AS median_x FROM fx_poi_a GROUP BY 1""")
def frequency_table(spark, sf):
    p = poi_a(spark, sf).withColumn("name", F.coalesce("name", F.lit("<null>")))
    sums = p.groupBy("name").agg(F.count("*").alias("n"), F.round(F.sum("x"), 3).alias("sum_x"))
    return sums.join(ranking.exact_percentiles(p, ["name"], "x", [0.5]), "name").select(
        "name", "n", "sum_x", F.round("p50", 6).alias("median_x")
    )


@query("a14_distribution_profile", """SELECT min(height_m) AS lo, round(quantile_cont(height_m, 0.01), 6) AS p1,
    round(quantile_cont(height_m, 0.25), 6) AS p25, round(quantile_cont(height_m, 0.5), 6) AS p50,
    round(quantile_cont(height_m, 0.75), 6) AS p75, round(quantile_cont(height_m, 0.99), 6) AS p99, max(height_m) AS hi,
    count(height_m) AS n, count(*) FILTER (WHERE height_m IS NULL) AS missing,
    count(*) FILTER (WHERE level <= 0) AS not_positive, count(*) FILTER (WHERE height_m < 5 OR height_m > 20) AS out_of_range
    FROM fx_rects""")
def distribution_profile(spark, sf):
    r = fx.view(spark, sf, "fx_rects").withColumn("all", F.lit(1))
    probs = [0.01, 0.25, 0.5, 0.75, 0.99]
    base = r.groupBy("all").agg(
        F.min("height_m").alias("lo"), F.max("height_m").alias("hi"), F.count("height_m").alias("n"),
        F.count_if(F.col("height_m").isNull()).alias("missing"), F.count_if(F.col("level") <= 0).alias("not_positive"),
        F.count_if((F.col("height_m") < 5) | (F.col("height_m") > 20)).alias("out_of_range"),
    )
    spread = ranking.exact_percentiles(r, ["all"], "height_m", probs)
    return base.join(spread, "all", "left").select(*base.columns[1:], *[F.round(f"p{round(p * 100)}", 6).alias(f"p{round(p * 100)}") for p in probs])


@query("a15_coverage_shares", """SELECT coalesce(key, '<all>') AS key, count(*) AS n, round(avg(CASE WHEN name IS NOT NULL
    THEN 1.0 ELSE 0.0 END), 6) AS named, round(avg(CASE WHEN value = 'cafe' THEN 1.0 ELSE 0.0 END), 6) AS cafes
    FROM fx_poi_a GROUP BY GROUPING SETS ((key), ())""")
def coverage_shares(spark, sf):
    # one pass over the rows, the total row comes from the per-key counts
    per = poi_a(spark, sf).groupBy("key").agg(
        F.count("*").alias("n"), F.count("name").alias("a"), F.count_if(F.col("value") == "cafe").alias("b")
    )
    return per.rollup("key").agg(F.sum("n").alias("n"), F.sum("a").alias("a"), F.sum("b").alias("b")).select(
        F.coalesce("key", F.lit("<all>")).alias("key"), "n", F.round(F.col("a") / F.col("n"), 6).alias("named"),
        F.round(F.col("b") / F.col("n"), 6).alias("cafes"),
    )


@query("p13_confidence_histogram", """SELECT CAST(least(floor(confidence * 10), 10) AS BIGINT) AS bin, count(*) AS n,
    round(count(*) / sum(count(*)) OVER (), 6) AS share FROM fx_poi_b WHERE confidence IS NOT NULL GROUP BY 1""")
def confidence_histogram(spark, sf):
    binned = poi_b(spark, sf).filter("confidence IS NOT NULL").groupBy(
        F.least(F.floor(F.col("confidence") * 10), F.lit(10)).alias("bin")
    ).agg(F.count("*").alias("n")).withColumn("all", F.lit(1))
    total = F.sum("n").over(Window.partitionBy("all"))  # at most eleven rows
    return binned.withColumn("share", F.round(F.col("n") / total, 6)).drop("all")


@query("o02_top_categories_side_by_side", """a AS (SELECT key || '=' || value AS tag, count(*) AS n FROM fx_poi_a GROUP BY 1),
    b AS (SELECT category AS tag, count(*) AS n FROM fx_poi_b GROUP BY 1),
    ra AS (SELECT *, row_number() OVER (ORDER BY n DESC, tag) AS rn FROM a),
    rb AS (SELECT *, row_number() OVER (ORDER BY n DESC, tag) AS rn FROM b), k AS (SELECT unnest(range(1, 16)) AS rn)
    SELECT CAST(k.rn AS INT) AS rank, ra.tag AS tag_a, ra.n AS n_a, rb.tag AS tag_b, rb.n AS n_b FROM k LEFT JOIN ra USING (rn)
    LEFT JOIN rb USING (rn) WHERE ra.n IS NOT NULL OR rb.n IS NOT NULL""")
def top_categories_side_by_side(spark, sf):
    from cellweave.operators.project import top_ranked

    a = top_ranked(poi_a(spark, sf).withColumn("tag", F.concat_ws("=", "key", "value")), "tag", 15)
    b = top_ranked(poi_b(spark, sf).withColumn("tag", F.col("category")), "tag", 15)
    ranks = spark.range(1, 16).select(F.col("id").cast("int").alias("rank"))
    left = a.select("rank", F.col("tag").alias("tag_a"), F.col("n").alias("n_a"))
    right = b.select("rank", F.col("tag").alias("tag_b"), F.col("n").alias("n_b"))
    return ranks.join(left, "rank", "left").join(right, "rank", "left").filter("n_a IS NOT NULL OR n_b IS NOT NULL")


@query("o03_top_names_with_share", """SELECT name, count(*) AS n, round(count(*) / (SELECT count(*) FROM fx_poi_a), 6) AS share
    FROM fx_poi_a WHERE name IS NOT NULL GROUP BY 1 ORDER BY n DESC, name LIMIT 10""")
def top_names_with_share(spark, sf):
    p = poi_a(spark, sf)
    total = p.agg(F.count("*").alias("t")).scalar()
    top = p.filter("name IS NOT NULL").groupBy("name").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "name").limit(10)
    return top.select("name", "n", F.round(F.col("n") / total, 6).alias("share"))
