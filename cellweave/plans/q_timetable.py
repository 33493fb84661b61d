"""Timetable queries: service days, departures, routes per stop, shapes."""

from __future__ import annotations

from pyspark.sql import functions as F

from cellweave.functions import calendar as cal
from cellweave.operators import ranking
from cellweave.operators import timetable as tt
from cellweave.plans import fixtures as fx
from cellweave.plans.registry import query

DAY = "20260915"
SECONDS_SQL = ("(CAST(split_part(departure_time, ':', 1) AS INT) * 3600 + CAST(split_part(departure_time, ':', 2) AS INT) * 60"
               " + CAST(split_part(departure_time, ':', 3) AS INT))")
SERVICES_SQL = """svc AS (SELECT service_id FROM (SELECT service_id FROM fx_calendar WHERE start_date <= '20260915'
      AND end_date >= '20260915' AND tuesday = '1'
      UNION SELECT service_id FROM fx_calendar_dates WHERE date = '20260915' AND exception_type = '1')
    EXCEPT SELECT service_id FROM fx_calendar_dates WHERE date = '20260915' AND exception_type = '2')"""
JOINED_SQL = """loc AS (SELECT stop_id FROM fx_stops WHERE x >= 40 AND x <= 960 AND y >= 40 AND y <= 960),
    st AS (SELECT s.*, t.route_id, t.service_id, t.shape_id, r.route_short_name, r.route_type
      FROM fx_stop_times s LEFT JOIN fx_trips t USING (trip_id) LEFT JOIN fx_transit_routes r USING (route_id)
      WHERE s.stop_id IN (SELECT stop_id FROM loc))"""
DEP_SQL = SERVICES_SQL + ", " + JOINED_SQL + f""", dep AS (SELECT stop_id, count(*) AS departures FROM st
    WHERE {SECONDS_SQL} >= 25200 AND {SECONDS_SQL} < 68400 AND coalesce(pickup_type, '0') <> '1'
    AND service_id IN (SELECT service_id FROM svc) GROUP BY 1),
    rt AS (SELECT stop_id, string_agg(DISTINCT route_short_name, ',' ORDER BY route_short_name) AS route_short_names,
      string_agg(DISTINCT route_type, ',' ORDER BY route_type) AS route_types,
      count(DISTINCT route_id) AS n_routes, count(DISTINCT trip_id) AS n_trips FROM st WHERE route_id IS NOT NULL GROUP BY 1),
    summ AS (SELECT s.stop_id, s.name, s.x, s.y, s.location_type, coalesce(dep.departures, 0) AS departures, route_short_names,
      route_types, coalesce(n_routes, 0) AS n_routes, coalesce(n_trips, 0) AS n_trips
      FROM fx_stops s LEFT JOIN dep USING (stop_id) LEFT JOIN rt USING (stop_id) WHERE s.stop_id IN (SELECT stop_id FROM loc))"""


def local_stops(spark, sf):
    """Stops inside the box grown by the buffer, edges included."""
    return fx.view(spark, sf, "fx_stops").filter("x >= 40 AND x <= 960 AND y >= 40 AND y <= 960")


def services(spark):
    return tt.active_services(fx.calendar(spark), fx.calendar_dates(spark), DAY, "tuesday")


def joined(spark, sf):
    st = tt.local_stop_times(fx.view(spark, sf, "fx_stop_times"), local_stops(spark, sf))
    return tt.with_trips(st, fx.view(spark, sf, "fx_trips"), fx.view(spark, sf, "fx_transit_routes"))


def summary(spark, sf):
    j = joined(spark, sf)
    return tt.stop_summary(local_stops(spark, sf), tt.departures(j, services(spark)), tt.stop_routes(j))


@query("p08_stops_in_buffer", "SELECT stop_id, x, y FROM fx_stops WHERE x >= 40 AND x <= 960 AND y >= 40 AND y <= 960")
def stops_in_buffer(spark, sf):
    return local_stops(spark, sf).select("stop_id", "x", "y")


@query("p10_service_seconds", f"SELECT {SECONDS_SQL} AS second, count(*) AS n FROM fx_stop_times GROUP BY 1")
def service_seconds(spark, sf):
    st = fx.view(spark, sf, "fx_stop_times")
    return st.groupBy(cal.service_seconds(F.col("departure_time")).alias("second")).agg(F.count("*").alias("n"))


@query("p11_departure_rows", SERVICES_SQL + f""" SELECT count(*) AS all_rows,
    count(*) FILTER (WHERE coalesce(pickup_type, '0') <> '1') AS boardable,
    count(*) FILTER (WHERE coalesce(pickup_type, '0') = '1') AS arrivals_only FROM fx_stop_times JOIN fx_trips USING (trip_id)
    WHERE {SECONDS_SQL} >= 25200 AND {SECONDS_SQL} < 68400 AND service_id IN (SELECT service_id FROM svc)""")
def departure_rows(spark, sf):
    rows = (
        fx.view(spark, sf, "fx_stop_times").filter(tt.in_window())
        .join(fx.view(spark, sf, "fx_trips"), "trip_id").join(services(spark), "service_id", "left_semi")
    )
    return rows.agg(
        F.count("*").alias("all_rows"), F.count_if(tt.boardable()).alias("boardable"),
        F.count_if(~tt.boardable()).alias("arrivals_only"),
    )


@query("p21_representative_tuesday", """d AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS b,
      CAST(o_orderdate AS DATE) + CAST(o_orderkey % 40 AS INT) AS fs FROM orders),
    f AS (SELECT o_orderkey, b, fs, b + CAST(CASE WHEN (2 - dayofweek(b) + 7) % 7 = 0 THEN 7
      ELSE (2 - dayofweek(b) + 7) % 7 END AS INT) AS tue FROM d)
    SELECT o_orderkey AS feed_id, CAST(CASE WHEN tue >= fs THEN tue
      ELSE tue + CAST(ceil((fs - tue) / 7.0) AS INT) * 7 END AS DATE) AS service_date FROM f""")
def representative_tuesday(spark, sf):
    o = fx.table(spark, sf, "orders").selectExpr(
        "o_orderkey AS feed_id", "CAST(o_orderdate AS DATE) AS b",
        "date_add(CAST(o_orderdate AS DATE), CAST(o_orderkey % 40 AS INT)) AS fs",
    )
    return o.select("feed_id", cal.representative_tuesday(F.col("b"), F.col("fs")).alias("service_date"))


@query("u01_active_services", SERVICES_SQL + """ SELECT t.service_id, count(*) AS n_trips FROM fx_trips t
    WHERE t.service_id IN (SELECT service_id FROM svc) GROUP BY 1""")
def active_services(spark, sf):
    trips = fx.view(spark, sf, "fx_trips")
    return trips.join(services(spark), "service_id", "left_semi").groupBy("service_id").agg(F.count("*").alias("n_trips"))


@query("u01_services_without_weekly_table", """svc AS (SELECT service_id FROM fx_calendar_dates WHERE date = '20260915'
      AND exception_type = '1' EXCEPT SELECT service_id FROM fx_calendar_dates WHERE date = '20260915' AND exception_type = '2')
    SELECT t.service_id, count(*) AS n_trips FROM fx_trips t WHERE t.service_id IN (SELECT service_id FROM svc) GROUP BY 1""")
def services_without_weekly_table(spark, sf):
    svc = tt.active_services(None, fx.calendar_dates(spark), DAY, "tuesday")
    trips = fx.view(spark, sf, "fx_trips")
    return trips.join(svc, "service_id", "left_semi").groupBy("service_id").agg(F.count("*").alias("n_trips"))


@query("j01_local_stop_times", JOINED_SQL + " SELECT stop_id, count(*) AS n FROM st GROUP BY 1")
def local_stop_times(spark, sf):
    st = tt.local_stop_times(fx.view(spark, sf, "fx_stop_times"), local_stops(spark, sf))
    return st.groupBy("stop_id").agg(F.count("*").alias("n"))


@query("j02_used_trips", JOINED_SQL + """ SELECT route_id, count(*) AS n FROM fx_trips
    WHERE trip_id IN (SELECT trip_id FROM st) GROUP BY 1""")
def used_trips(spark, sf):
    st = tt.local_stop_times(fx.view(spark, sf, "fx_stop_times"), local_stops(spark, sf))
    used = fx.view(spark, sf, "fx_trips").join(st.select("trip_id"), "trip_id", "left_semi")
    return used.groupBy("route_id").agg(F.count("*").alias("n"))


@query("j03_stop_times_with_routes", JOINED_SQL + """ SELECT route_id, route_short_name, route_type, count(*) AS n
    FROM st GROUP BY 1, 2, 3""")
def stop_times_with_routes(spark, sf):
    return joined(spark, sf).groupBy("route_id", "route_short_name", "route_type").agg(F.count("*").alias("n"))


@query("j04_stop_summary", DEP_SQL + " SELECT stop_id, departures, n_routes, n_trips FROM summ")
def stop_summary(spark, sf):
    return summary(spark, sf).select("stop_id", "departures", "n_routes", "n_trips")


@query("a12_routes_per_stop", DEP_SQL + " SELECT * FROM rt")
def routes_per_stop(spark, sf):
    return tt.stop_routes(joined(spark, sf))


@query("o01_busiest_stops", DEP_SQL + """ SELECT stop_id, name, departures, route_short_names FROM summ
    ORDER BY departures DESC, stop_id LIMIT 10""")
def busiest_stops(spark, sf):
    cols = ["stop_id", "name", "departures", "route_short_names"]
    return summary(spark, sf).select(*cols).orderBy(F.desc("departures"), "stop_id").limit(10)


@query("a17_headway_and_density", DEP_SQL + """ SELECT count(*) AS stops, count(*) FILTER (WHERE departures = 0) AS unserved,
    count(*) FILTER (WHERE departures = 0 AND location_type = '1') AS unserved_areas,
    count(*) FILTER (WHERE n_routes = 0) AS routeless, count(*) FILTER (WHERE NOT (x > 80 AND x < 920 AND y > 80 AND y < 920)) AS outside,
    round(count(*) / 0.8464, 6) AS per_km2, CAST(sum(departures) AS BIGINT) AS departures,
    round(quantile_cont(departures, 0.25) FILTER (WHERE departures > 0), 6) AS p25,
    round(quantile_cont(departures, 0.5) FILTER (WHERE departures > 0), 6) AS p50,
    round(quantile_cont(departures, 0.75) FILTER (WHERE departures > 0), 6) AS p75,
    round(720 / quantile_cont(departures, 0.5) FILTER (WHERE departures > 0), 6) AS headway_min FROM summ""")
def headway_and_density(spark, sf):
    s = summary(spark, sf).withColumn("all", F.lit(1))
    served = ranking.exact_percentiles(s.filter("departures > 0"), ["all"], "departures", [0.25, 0.5, 0.75])
    outside = ~((F.col("x") > 80) & (F.col("x") < 920) & (F.col("y") > 80) & (F.col("y") < 920))
    base = s.groupBy("all").agg(
        F.count("*").alias("stops"), F.count_if(F.col("departures") == 0).alias("unserved"),
        F.count_if((F.col("departures") == 0) & (F.col("location_type") == "1")).alias("unserved_areas"),
        F.count_if(F.col("n_routes") == 0).alias("routeless"), F.count_if(outside).alias("outside"),
        F.round(F.count("*") / 0.8464, 6).alias("per_km2"), F.sum("departures").alias("departures"),
    )
    return base.join(served, "all", "left").select(
        *base.columns[1:], *[F.round(p, 6).alias(p) for p in ("p25", "p50", "p75")], F.round(720 / F.col("p50"), 6).alias("headway_min")
    )


@query("a16_names_of_several_agencies", """SELECT route_short_name, count(DISTINCT agency_id) AS agencies FROM fx_transit_routes
    GROUP BY 1 HAVING count(DISTINCT agency_id) > 1""")
def names_of_several_agencies(spark, sf):
    r = fx.view(spark, sf, "fx_transit_routes")
    return r.groupBy("route_short_name").agg(F.countDistinct("agency_id").alias("agencies")).filter("agencies > 1")


@query("w03_dominant_shapes", JOINED_SQL + """, c AS (SELECT route_id, shape_id, count(DISTINCT trip_id) AS n_trips FROM st
      WHERE route_id IS NOT NULL AND shape_id IS NOT NULL GROUP BY 1, 2)
    SELECT route_id, shape_id, n_trips, n_variants FROM (SELECT *, row_number() OVER (PARTITION BY route_id
      ORDER BY n_trips DESC, shape_id) AS rn, count(*) OVER (PARTITION BY route_id) AS n_variants FROM c) WHERE rn = 1""")
def dominant_shapes(spark, sf):
    return tt.dominant_shapes(joined(spark, sf))


@query("w05_shape_vertices", """SELECT shape_id, seq, x, y, pos FROM (SELECT *, row_number() OVER (PARTITION BY shape_id ORDER BY seq)
    AS pos, count(*) OVER (PARTITION BY shape_id) AS n FROM fx_shapes) WHERE n >= 2""")
def shape_vertices(spark, sf):
    return tt.shape_vertices(fx.view(spark, sf, "fx_shapes"))
