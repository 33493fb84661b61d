"""Times the headline queries on ``$BENCH_SF_DIR`` with ``local[$BENCH_CPUS]`` and prints one JSON line."""

from __future__ import annotations

import json
import logging
import os
import time

from cellweave.plans import QUERIES
from cellweave.session import local_session

HEADLINE = [
    "a25_overlap_by_task", "a07_condition_targets", "a22_task_stats", "a44_relative_rule_sweep", "w01_lowest_third", "a31_tolerant_line_scores",
    "j04_stop_summary", "w03_dominant_shapes", "j06_name_matches", "a01_burn_polygons", "j05_point_in_polygon", "a03_places_in_hosts",
    "j10_cut_windows", "a37_route_report", "w07_first_visit_pixels", "p16_answer_points", "r05_distance_to_other_class", "r06_shadow_cells",
    "r01_free_components", "r03_walking_field", "s17_upsert_metrics", "t01_stream_replaces_rows",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    logging.disable(logging.CRITICAL)
    spark = local_session("bench", cpus)
    spark.sparkContext.setLogLevel("OFF")
    spark.read.parquet(f"{sf_dir}/orders.parquet").count()
    QUERIES[HEADLINE[0]](spark, sf_dir).write.format("noop").mode("overwrite").save()  # loads and compiles what all queries share
    seconds = {}
    for name in HEADLINE:
        t0 = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - t0, 3)
    total = round(sum(seconds.values()), 3)
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": seconds, "sf": os.path.basename(sf_dir)}))
    spark.stop()


if __name__ == "__main__":
    main()
