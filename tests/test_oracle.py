"""Spark result = SQL result on the small tables."""

import glob
import math
import os

import pytest

import __spark_entry__ as entry

duckdb = pytest.importorskip("duckdb")

# one query per operator family; tools/check.py runs all of them
NAMES = [
    "a25_overlap_by_task", "a05_pool_odd_block", "w01_lowest_third", "w02_below_median", "w12_balanced_points", "a26_localisation", "a31_tolerant_line_scores",
    "a33_bucket_means", "j04_stop_summary", "w03_dominant_shapes", "p21_representative_tuesday", "j06_name_matches", "a01_burn_polygons", "a03_places_in_hosts",
    "j05_point_in_polygon", "j07_overlapping_pairs", "j10_cut_windows", "a36_route_verdicts", "a56_paired_verdicts", "p16_answer_points", "w07_first_visit_pixels",
    "r05_distance_to_other_class", "r06_shadow_cells", "p19_sun_position", "r14_marker_sets", "r12_drawing_noise", "s07_mosaic", "s08_prediction_lines",
    "s16_unpack_bits", "t01_stream_replaces_rows", "a38_cell_rule", "j18_way_back_cells", "r01_drawing_components",
]


@pytest.fixture(scope="session")
def con(sf_dir):
    c = duckdb.connect()
    for f in glob.glob(sf_dir + "/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


def norm(rows):
    return sorted(tuple("nan" if isinstance(v, float) and math.isnan(v) else repr(v + 0.0) if isinstance(v, float) else repr(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", NAMES)
def test_same_as_sql(spark, sf_dir, con, name):
    df = entry.queries()[name](spark, sf_dir)
    cur = con.execute(entry.oracle_sql()[name])
    cols = sorted(d[0] for d in cur.description)
    at = [[d[0] for d in cur.description].index(c) for c in cols]
    want = [tuple(r[i] for i in at) for r in cur.fetchall()]
    assert sorted(df.columns) == cols
    assert norm(tuple(r) for r in df.select(*cols).collect()) == norm(want)


def test_entry_and_registry(spark):
    assert entry.entry(spark).count() == 4
    assert set(entry.oracle_sql()) <= set(entry.queries())
