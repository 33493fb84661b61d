"""Departures, routes and shapes per stop from timetable tables whose columns are all strings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweave.functions.calendar import WINDOW_END_S, WINDOW_START_S, service_seconds
from cellweave.operators.ranking import first_row, tiered_rank
from cellweave.session import small_side

WEEKDAYS = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")


def active_services(calendar: DataFrame | None, dates: DataFrame, day: str, weekday: str) -> DataFrame:
    """Weekly pattern, plus services added for the day, minus services removed for it."""
    if weekday not in WEEKDAYS:
        raise ValueError(weekday)
    today = dates.filter(F.col("date") == day)
    added = today.filter("exception_type = '1'").select("service_id")
    if calendar is not None:
        base = calendar.filter((F.col("start_date") <= day) & (F.col("end_date") >= day) & (F.col(weekday) == "1"))
        added = base.select("service_id").union(added)
    return added.subtract(today.filter("exception_type = '2'").select("service_id"))


def local_stop_times(stop_times: DataFrame, stops: DataFrame) -> DataFrame:
    """The big table reduced to local stops: while it is scanned if the counted stops are few, else by a shuffle join."""
    return stop_times.join(small_side(stops.select("stop_id").distinct()), "stop_id", "left_semi")


def with_trips(stop_times: DataFrame, trips: DataFrame, routes: DataFrame) -> DataFrame:
    """Trips meet their routes first, both small next to the stop times, which are then joined once, by trip."""
    named = trips.join(routes.select("route_id", "route_short_name", "route_type"), "route_id", "left")
    return stop_times.join(named, "trip_id", "left")


def in_window(departure: str = "departure_time"):
    s = service_seconds(F.col(departure))
    return (s >= WINDOW_START_S) & (s < WINDOW_END_S)


def boardable():
    return F.coalesce(F.col("pickup_type"), F.lit("0")) != "1"


def departures(joined: DataFrame, services: DataFrame) -> DataFrame:
    """Departures per stop in the counted part of the day, on running services, where boarding is allowed."""
    return (
        joined.filter(in_window() & boardable())
        .join(services, "service_id", "left_semi")
        .groupBy("stop_id").agg(F.count("*").alias("departures"))
    )


def stop_routes(joined: DataFrame) -> DataFrame:
    """Routes and trips per stop over the whole feed.

    The rows are first reduced to distinct (stop, route), so the joined names never pass through one
    task as raw rows, even for a stop that holds a third of the table.
    """
    known = joined.filter("route_id IS NOT NULL")
    routes = known.groupBy("stop_id", "route_id").agg(
        F.first("route_short_name").alias("short"), F.first("route_type").alias("kind")
    )
    per_route = routes.groupBy("stop_id").agg(
        F.count("*").alias("n_routes"),
        F.array_join(F.array_sort(F.collect_set("short")), ",").alias("route_short_names"),
        F.array_join(F.array_sort(F.collect_set("kind")), ",").alias("route_types"),
    )
    trips = known.groupBy("stop_id", "trip_id").agg(F.lit(1).alias("one")).groupBy("stop_id").agg(
        F.count("*").alias("n_trips")
    )
    return per_route.join(trips, "stop_id")


def stop_summary(stops: DataFrame, counts: DataFrame, per_stop: DataFrame) -> DataFrame:
    """Every stop once; a stop without departures or routes keeps zeros."""
    return stops.join(counts, "stop_id", "left").join(per_stop, "stop_id", "left").fillna(
        0, ["departures", "n_routes", "n_trips"]
    )


def dominant_shapes(joined: DataFrame) -> DataFrame:
    """Per route the shape most trips use (ties: smallest shape id) and the number of shape variants."""
    per_shape = (
        joined.filter("route_id IS NOT NULL AND shape_id IS NOT NULL")
        .select("route_id", "shape_id", "trip_id").distinct()
        .groupBy("route_id", "shape_id").agg(F.count("*").alias("n_trips"))
    )
    variants = per_shape.groupBy("route_id").agg(F.count("*").alias("n_variants"))
    best = first_row(per_shape, ["route_id"], [-F.col("n_trips"), F.col("shape_id")], ["shape_id", "n_trips"])
    return best.join(variants, "route_id")


def shape_vertices(points: DataFrame) -> DataFrame:
    """Vertices numbered in sequence order; shapes of fewer than two points are dropped.

    A line stays a table of vertices, so its length is not limited by one task.
    """
    usable = points.groupBy("shape_id").agg(F.count("*").alias("n")).filter("n >= 2").select("shape_id")
    return tiered_rank(
        points.join(usable, "shape_id", "left_semi").withColumn("_seq_k", F.floor(F.col("seq") / 4096)),
        ["shape_id"], ["_seq_k", "seq"], "pos",
    ).drop("_seq_k")
