"""Run ledger queries, batch and streaming."""

from __future__ import annotations

from pyspark.sql import functions as F

from cellweave.operators import ledger as lg
from cellweave.plans import fixtures as fx
from cellweave.plans.registry import query
from cellweave.session import scratch_folder
from cellweave.streaming import metrics as sm

LATEST_SQL = """last AS (SELECT run_id, step, metric, arg_max(value, seq) AS value, max(seq) AS seq FROM fx_eval_rows GROUP BY 1, 2, 3)"""


def rows(spark, sf):
    return fx.view(spark, sf, "fx_eval_rows")


def current_rows(spark, sf):
    return lg.latest(rows(spark, sf), ["run_id", "step", "metric"], "seq")


@query("s17_upsert_metrics", LATEST_SQL + " SELECT run_id, step, metric, value, seq FROM last")
def upsert_metrics(spark, sf):
    r = rows(spark, sf)
    return lg.upsert(r.filter("seq % 2 = 0"), r.filter("seq % 2 = 1"), ["run_id", "step", "metric"], "seq").select("run_id", "step", "metric", "value", "seq")


@query("t01_stream_replaces_rows", LATEST_SQL + " SELECT run_id, step, metric, value, seq FROM last")
def stream_replaces_rows(spark, sf):
    """The same rows through a file stream in several batches; the result must equal the batch upsert."""
    work = scratch_folder(spark)
    src = rows(spark, sf)
    src.repartition(6, "seq").write.parquet(f"{work}/in")
    stream = sm.metric_stream(spark, f"{work}/in", src.schema, files_per_batch=2)
    q = sm.keep_latest(stream, f"{work}/out", f"{work}/state", ["run_id", "step", "metric"], "seq")
    q.awaitTermination()
    return sm.current(spark, f"{work}/out", src.schema, ["run_id", "step", "metric"], "seq").select("run_id", "step", "metric", "value", "seq")


STATE_SQL = """SELECT run_id, coalesce(arg_max(s, seq) FILTER (WHERE s <> 'active'), arg_max(s, seq)) AS state, max(seq) AS seq FROM
    (SELECT run_id, seq, CASE WHEN seq % 40 = 0 THEN 'complete' WHEN seq % 53 = 0 THEN 'aborted' ELSE 'active' END AS s FROM fx_eval_rows) GROUP BY 1"""


def ledger_events(spark, sf):
    return rows(spark, sf).selectExpr("run_id", "seq", "CASE WHEN seq % 40 = 0 THEN 'complete' WHEN seq % 53 = 0 THEN 'aborted' ELSE 'active' END AS state")


@query("t02_run_state", STATE_SQL)
def run_state(spark, sf):
    return sm.run_state(ledger_events(spark, sf))


@query("t02_run_state_stream", STATE_SQL)
def run_state_stream(spark, sf):
    """The ledger as a stream of files that arrive in no order, stopped half-way and started again."""
    work = scratch_folder(spark)
    events = ledger_events(spark, sf)
    table = sm.state_table(spark, f"{work}/state", every=3)
    for part in (1, 0):  # the later half of the events arrives first
        events.filter(F.pmod(F.expr("seq DIV 64"), F.lit(2)) == part).repartition(4).write.mode("append").parquet(f"{work}/in")
        stream = sm.metric_stream(spark, f"{work}/in", events.schema, files_per_batch=1)
        table.keep(sm.state_rows(stream), f"{work}/checkpoint").awaitTermination()
    return sm.run_states(table.read())


@query("t03_filtered_big_table", """SELECT stop_id, count(*) AS n FROM fx_stop_times WHERE stop_id IN (SELECT stop_id FROM fx_stops WHERE x < 500) GROUP BY 1""")
def filtered_big_table(spark, sf):
    """The timetable's big table through an available-now file stream: each batch keeps local rows only."""
    work = scratch_folder(spark)
    src = fx.view(spark, sf, "fx_stop_times").select("trip_id", "stop_id")
    src.repartition(4).write.parquet(f"{work}/in")
    stops = fx.view(spark, sf, "fx_stops").filter("x < 500").select("stop_id")
    stream = sm.metric_stream(spark, f"{work}/in", src.schema, files_per_batch=2).join(stops, "stop_id", "left_semi")
    q = stream.writeStream.format("parquet").option("path", f"{work}/out").option("checkpointLocation", f"{work}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(src.schema).parquet(f"{work}/out").groupBy("stop_id").agg(F.count("*").alias("n"))


@query("s09_long_metrics", "SELECT run_id, step, 'val_' || metric AS metric, max(value) AS value FROM fx_eval_rows WHERE value IS NOT NULL GROUP BY 1, 2, 3")
def long_metrics(spark, sf):
    """Every metric of a step in one JSON line, whatever its name, and back to rows."""
    from cellweave.sources.jsonl import eval_long

    best = rows(spark, sf).groupBy("run_id", "step", "metric").agg(F.max("value").alias("value"))
    named = F.map_from_entries(F.collect_list(F.struct(F.concat(F.lit("val_"), "metric"), "value")))
    wide = best.groupBy("run_id", "step").agg(F.to_json(named).alias("metrics"), F.to_json(F.struct("run_id", "step")).alias("head"))
    lines = wide.select(F.concat(F.expr("substring(head, 1, length(head) - 1)"), F.lit(","), F.expr("substring(metrics, 2)")).alias("value"))
    return eval_long(lines, ["run_id", "step"])


@query("o05_rows_by_step", LATEST_SQL + " SELECT run_id, step, metric, round(value + 0.5, 6) AS value FROM last ORDER BY run_id, step, metric")
def rows_by_step(spark, sf):
    """Rows of a re-evaluation replace the rows of their step; the series is ordered by step."""
    again = current_rows(spark, sf).withColumns({"value": F.round(F.col("value") + 0.5, 6), "seq": F.col("seq") + 1000000})
    return lg.upsert(rows(spark, sf), again.select("run_id", "step", "metric", "value", "seq"), ["run_id", "step", "metric"], "seq").select(
        "run_id", "step", "metric", "value").orderBy("run_id", "step", "metric")


@query("w08_metric_delta", LATEST_SQL + """ SELECT run_id, metric, round(CASE WHEN count(*) >= 2 THEN arg_max(value, step) - arg_min(value, step) END, 6) AS delta
    FROM last WHERE step BETWEEN 10 AND 30 GROUP BY 1, 2""")
def metric_delta(spark, sf):
    return lg.delta(current_rows(spark, sf), ["run_id", "metric"], 10, 30).withColumn("delta", F.round("delta", 6))


@query("w09_list_offsets", """n AS (SELECT o_orderkey AS route_id, CASE WHEN o_orderkey % 6 = 0 THEN 0 ELSE 2 + o_orderkey % 5 END AS n FROM orders)
    SELECT route_id, n, CAST(coalesce(sum(n) OVER (ORDER BY route_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset" FROM n""")
def list_offsets(spark, sf):
    o = fx.table(spark, sf, "orders").withColumnRenamed("o_orderkey", "route_id")
    return lg.running_offsets(o, "route_id", F.expr("IF(route_id % 6 = 0, 0L, 2 + route_id % 5)"), block=128)


@query("w10_best_record", """SELECT run_id, arg_min(seq, (CASE WHEN metric = 'error' THEN 1 ELSE 0 END, -coalesce(CASE WHEN seq % 4 = 0 THEN NULL ELSE step END, -1), seq)) AS seq FROM fx_eval_rows GROUP BY 1""")
def best_record(spark, sf):
    rec = rows(spark, sf).selectExpr("run_id", "seq", "metric = 'error' AS aborted", "IF(seq % 4 = 0, NULL, step) AS steps")
    return lg.best_record(rec, "run_id", ["seq"])


@query("w14_sequence_equals_schedule", """w AS (SELECT route_id, n_goal, unnest(range(CAST(2 * n_goal + 1 AS BIGINT))) AS pos FROM fx_routes),
    t AS (SELECT route_id, pos, CASE WHEN pos = 2 * n_goal THEN 'DONE' WHEN pos = 2 * n_goal - 1 THEN 'DRAW' WHEN pos >= n_goal - 1 AND (n_goal > 1 OR pos > 0) THEN 'BACK' ELSE 'SEARCH' END AS tok, n_goal FROM w),
    o AS (SELECT route_id, pos, CASE WHEN route_id % 9 = 0 AND pos = 1 THEN 'SEARCH?' ELSE tok END AS tok FROM t WHERE NOT (route_id % 10 = 0 AND pos = 2 * n_goal))
    SELECT t.route_id, bool_and(coalesce(o.tok = t.tok, FALSE)) AS same, count(o.tok) AS passes FROM t LEFT JOIN o USING (route_id, pos) GROUP BY 1""")
def sequence_equals_schedule(spark, sf):
    from cellweave.operators.wave import schedule

    plan = schedule(fx.view(spark, sf, "fx_routes").select("route_id", "n_goal", F.col("n_goal").alias("ng")))
    wanted = plan.select("route_id", "pos", "token")
    seen = plan.filter("NOT (route_id % 10 = 0 AND pos = 2 * ng)").selectExpr("route_id", "pos", "IF(route_id % 9 = 0 AND pos = 1, 'SEARCH?', token) AS token")
    return lg.same_sequence(seen, wanted, ["route_id"])


@query("w16_latest_summary", "SELECT run_id, max(step) AS steps, arg_max(value, (step, seq)) AS last_value, count(*) AS n FROM fx_eval_rows GROUP BY 1")
def latest_summary(spark, sf):
    return rows(spark, sf).groupBy("run_id").agg(
        F.max("step").alias("steps"), F.max_by("value", F.struct("step", "seq")).alias("last_value"), F.count("*").alias("n"))


@query("s10_merged_shards", """s AS (SELECT run_id, step % 8 AS shard, count(*) AS n, max(value) AS seconds, avg(value) AS mean FROM fx_eval_rows GROUP BY 1, 2)
    SELECT run_id, count(*) AS shards, CAST(sum(n) AS BIGINT) AS n, max(seconds) AS seconds_max, round(sum(mean * n) / sum(n), 9) AS mean FROM s GROUP BY 1""")
def merged_shards(spark, sf):
    shards = rows(spark, sf).groupBy("run_id", (F.col("step") % 8).alias("shard")).agg(
        F.count("*").alias("n"), F.max("value").alias("seconds"), F.avg("value").alias("mean"))
    return lg.merge_shards(shards, ["run_id"])
