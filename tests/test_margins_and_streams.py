"""Windows with ground round them, distances along rows, and tables that streams keep current."""

import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellweave.operators import frontier as fr
from cellweave.operators import grids, routes
from cellweave.streaming import metrics
from cellweave.streaming.keyed import KeyedTable

SIZE, MARGIN, DISTRICT = 64, 100, 200
# window corner in the district, start and goal in the window: a block between, a free line, a wall through the window, a walled start
WALKS = [((60, 60), (10, 30), (54, 30)), ((60, 60), (10, 58), (54, 58)), ((120, 120), (10, 30), (54, 30)), ((0, 0), (25, 25), (50, 50))]


def _district():
    built = np.zeros((DISTRICT, DISTRICT), bool)
    built[70:110, 80:100] = True
    built[112:200, 150:154] = True
    built[20:31, 20:31] = True
    built[21:30, 21:30] = False
    return built


@pytest.fixture(scope="module")
def world(spark):
    built = _district()
    rows = [(0, r, c, int(built[r, c])) for r in range(DISTRICT) for c in range(DISTRICT)]
    raster = spark.createDataFrame(rows, "district int, row int, col int, built int").cache()
    windows = spark.createDataFrame([(0, i, w[0][0], w[0][1]) for i, w in enumerate(WALKS)], "district int, crop_id int, dx int, dy int")
    ground = grids.cut_with_halo(raster, windows, ["district"], SIZE, MARGIN, 32).drop("district").cache()
    return windows, ground


def test_halo_cells(spark, world):
    built = _district()
    windows, ground = world
    got = {(r.crop_id, r.row, r.col): (r.built, r.core) for r in ground.collect()}
    want = {}
    for i, ((dx, dy), _, _) in enumerate(WALKS):
        for r in range(max(0, dy - MARGIN), min(DISTRICT, dy + SIZE + MARGIN)):
            for c in range(max(0, dx - MARGIN), min(DISTRICT, dx + SIZE + MARGIN)):
                want[i, r - dy, c - dx] = (int(built[r, c]), 0 <= r - dy < SIZE and 0 <= c - dx < SIZE)
    assert got == want
    bounds = {r.crop_id: (r.r0, r.r1, r.c0, r.c1) for r in windows.withColumns(grids.ground_bounds(SIZE, MARGIN, DISTRICT, DISTRICT)).collect()}
    assert bounds[0] == (-60, 140, -60, 140) and bounds[2] == (-100, 80, -100, 80) and bounds[3] == (0, 164, 0, 164)


def test_verdicts_and_ways_of_four_routes(spark, world):
    windows, ground = world
    walks = spark.createDataFrame([(i, s[1], s[0], g[1], g[0]) for i, (_, s, g) in enumerate(WALKS)], "crop_id int, srow int, scol int, grow int, gcol int")
    field = fr.walking_field(ground.select("crop_id", "row", "col", "built"), walks, ["crop_id"], MARGIN)
    metres = fr.walked_metres(field, ["crop_id"])
    goal = {r.crop_id: r.metres for r in walks.withColumnsRenamed({"grow": "row", "gcol": "col"}).join(metres, ["crop_id", "row", "col"]).collect()}
    assert sorted(goal) == [0, 1, 2] and goal[1] == 44.0 and goal[0] > 44 and goal[2] > 60
    way = fr.way_back(field, walks.select("crop_id", "grow", "gcol"), ["crop_id"]).cache()
    leaves = {r.crop_id: r.least < 0 for r in way.groupBy("crop_id").agg(F.min("row").alias("least")).collect()}
    assert leaves == {0: False, 1: False, 2: True}
    frame = walks.join(windows.drop("district"), "crop_id").withColumns(grids.ground_bounds(SIZE, MARGIN, DISTRICT, DISTRICT))
    known = frame.select(F.col("crop_id").cast("long").alias("route_id"), "crop_id", *[(F.col(c) + 0.5).alias(n) for c, n in (("scol", "sx"), ("srow", "sy"), ("gcol", "gx"), ("grow", "gy"))], *routes.BOUNDS)
    teacher = spark.createDataFrame([(i, m) for i, m in goal.items()], "route_id long, teacher_m double")
    known = known.join(teacher, "route_id")
    buildings = ground.filter("built = 1").select("crop_id", "row", "col")
    last = way.groupBy("crop_id").agg(F.max("pos").alias("last"))
    walked = way.join(last, "crop_id").select(F.col("crop_id").cast("long").alias("route_id"), (F.col("last") - F.col("pos") + 1).cast("int").alias("pos"), (F.col("col") + 0.5).alias("x"), (F.col("row") + 0.5).alias("y"))
    ends = F.array(F.struct(F.col("sx").alias("x"), F.col("sy").alias("y")), F.struct(F.col("gx").alias("x"), F.col("gy").alias("y")))
    straight = known.select("route_id", F.posexplode(ends).alias("pos", "p")).select("route_id", (F.col("pos") + 1).alias("pos"), "p.x", "p.y")
    by_way = {r.route_id: r.reason for r in routes.verdicts(known, walked, buildings, SIZE).collect()}
    by_line = {r.route_id: r.reason for r in routes.verdicts(known, straight, buildings, SIZE).collect()}
    assert by_way == {0: None, 1: None, 2: None}
    assert by_line == {0: "crosses a building", 1: None, 2: "crosses a building"}
    inside = {r.route_id: r.reason for r in routes.verdicts(known.drop(*routes.BOUNDS), walked, buildings, SIZE).collect()}
    assert inside[2] == "crosses a building"  # without the margin the way that leaves the window is refused


@pytest.mark.parametrize("seed", range(6))
def test_lower_envelope(seed):
    rng = np.random.default_rng(seed)
    height, width = int(rng.integers(1, 6)), int(rng.integers(1, 70))
    gaps = np.where(rng.random((height, width)) < 0.7, fr.FAR, rng.integers(0, 40, (height, width)) ** 2)
    at = np.arange(width)
    want = ((at[:, None] - at[None, :]) ** 2 + gaps[:, None, :]).min(2)
    assert (fr.lower_envelope(gaps) == want).all()


def test_distances_on_a_wide_raster_with_few_other_cells(spark):
    """1800 columns, another class in three of them, and a hole: equal to every cell against every other."""
    rng = random.Random(2)
    other = {(rng.randrange(20), c): 1 + k for k, c in enumerate((5, 900, 1799))}
    cells = [(r, c, other.get((r, c), 0)) for r in range(20) for c in range(1800) if not 300 <= c < 340]
    got = {(r.row, r.col): r.dist for r in fr.distance_to_other(spark.createDataFrame([(1, *x) for x in cells], "k int, row int, col int, v int"), ["k"], "v", [0, 1, 2, 3]).collect()}
    assert len(got) == len(cells)
    spots = np.array(list(other), float)
    for r, c, v in cells:
        if v == 0:
            assert got[r, c] == pytest.approx(np.hypot(*(spots - (r, c)).T).min())
        else:
            assert got[r, c] == 1.0
    alone = spark.createDataFrame([(1, r, c, 0) for r in range(3) for c in range(4)], "k int, row int, col int, v int")
    assert {r.dist for r in fr.distance_to_other(alone, ["k"], "v", [0, 1]).collect()} == {None}


def _add(spark, folder, batches, every):
    table = metrics.latest_table(spark, folder, "k long, v long, seq long", ["k"], "seq", every)
    for number, rows in batches:
        table.add(spark.createDataFrame(rows, "k long, v long, seq long"), number)
    return table


def test_reading_stays_flat_and_a_crash_loses_nothing(spark, tmp_path):
    folder, rng, want, seen = str(tmp_path / "t"), random.Random(9), {}, []
    seq = list(range(4 * 40))
    rng.shuffle(seq)
    table = _add(spark, folder, [], 4)
    assert table.read().count() == 0
    for b in range(40):
        rows = [(rng.randrange(15), rng.randrange(1000), seq[4 * b + i]) for i in range(4)]
        for k, v, s in rows:
            if k not in want or want[k][1] < s:
                want[k] = (v, s)
        _add(spark, folder, [(b, rows)], 4)
        if b == 17:  # a repeated batch, and a snapshot that was never finished
            _add(spark, folder, [(b, rows)], 4)
            os.makedirs(f"{folder}/base=17", exist_ok=True)
            if os.path.exists(f"{folder}/base=17/_SUCCESS"):
                os.remove(f"{folder}/base=17/_SUCCESS")
            assert {r.k: (r.v, r.seq) for r in table.read().collect()} == want
        seen.append(len(table.parts()[1]))
        assert len([d for d in os.listdir(folder) if "=" in d]) <= 2 + 3 * 4
    assert max(seen) < 8 and {r.k: (r.v, r.seq) for r in table.read().collect()} == want


def test_states_are_the_same_in_any_order_and_after_a_restart(spark, tmp_path):
    rng = random.Random(4)
    events = [(r, "active", 10 * i + r % 7) for i in range(12) for r in range(9)] + [(2, "complete", 55), (3, "aborted", 31), (3, "complete", 90), (4, "skipped", 7)]
    results = []
    for turn in range(2):
        rng.shuffle(events)
        source, table = str(tmp_path / f"in{turn}"), metrics.state_table(spark, str(tmp_path / f"state{turn}"), every=2)
        for half in (events[:60], events[60:]):  # the stream ends and begins again from its checkpoint
            spark.createDataFrame(half, "run_id long, state string, seq long").repartition(3).write.mode("append").parquet(source)
            stream = metrics.metric_stream(spark, source, "run_id long, state string, seq long", 1)
            table.keep(metrics.state_rows(stream), str(tmp_path / f"check{turn}")).awaitTermination()
        results.append(sorted(tuple(r) for r in metrics.run_states(table.read()).collect()))
    assert results[0] == results[1] == sorted(tuple(r) for r in metrics.run_state(spark.createDataFrame(events, "run_id long, state string, seq long")).select("run_id", "state", "seq").collect())
    assert dict((r, s) for r, s, _ in results[0])[3] == "complete" and isinstance(table, KeyedTable)


def test_one_huge_outline_is_many_small_keys(spark):
    """20,000 edges round a star and 20,000 points: the right ones are inside, and no band holds a large share."""
    from cellweave.operators import raster

    n, rng = 20_000, np.random.default_rng(5)
    turn = 2 * np.pi * np.arange(n) / n
    radius = lambda a: 400 + 80 * np.sin(9 * a)
    ring = [(float(500 + r * np.cos(a)), float(500 + r * np.sin(a))) for a, r in zip(turn, radius(turn))]
    comb = [(float(x), float(500 * (x % 2))) for x in range(400)] + [(399.0, -5.0), (0.0, -5.0)]  # every tooth as high as the whole
    polys = spark.createDataFrame([(0, 1, [ring]), (0, 2, [comb])], "d int, bid int, rings array<array<struct<x:double,y:double>>>")
    at = rng.uniform(0, 1000, (20_000, 2))
    points = spark.createDataFrame([(0, i, float(x), float(y)) for i, (x, y) in enumerate(at)], "d int, id int, x double, y double")
    got = {r.id for r in raster.hosts(points, polys, ["d"], "id", "bid").filter("bid = 1").collect()}
    off = at - 500
    gap = np.hypot(*off.T) - radius(np.arctan2(off[:, 1], off[:, 0]))
    assert {i for i in range(len(at)) if gap[i] < -0.05} <= got <= {i for i in range(len(at)) if gap[i] < 0.05}
    lines = raster.edges(raster.banded(polys, ["bid"]), ["bid", "by0", "band_h"]).withColumn(
        "band", F.explode(F.expr("sequence(floor((least(y1, y2) - by0) / band_h), floor((greatest(y1, y2) - by0) / band_h))")))
    held = {r.bid: (r.most, r.rows) for r in lines.groupBy("bid", "band").count().groupBy("bid").agg(F.max("count").alias("most"), F.sum("count").alias("rows")).collect()}
    assert held[1][0] <= 40 * raster.BAND_EDGES and held[1][1] <= 4 * n and held[2][1] <= 5 * 402


def test_rescoring_counts_what_moving_gains_and_loses(spark):
    from cellweave.operators.chains import rescoring

    frame = spark.createDataFrame([(i, 0.5, 0.5, 9.5, 0.5, 9.0) for i in range(3)], "crop_id long, sx double, sy double, gx double, gy double, teacher_m double")
    p = lambda x, y: (float(x), float(y))
    rows = [(0, 1, p(0.5, 0.5), p(0.5, 0.5)), (0, 2, p(5, 3.5), p(5, 0.5)), (0, 3, p(9.5, 0.5), p(9.5, 0.5)),
            (1, 1, p(0.5, 0.5), p(0.5, 0.5)), (1, 2, p(9.5, 0.5), p(9.5, 9.5))]
    points = spark.createDataFrame(rows, "crop_id long, pos int, raw struct<x:double,y:double>, moved struct<x:double,y:double>")
    built = spark.createDataFrame([(0, 3, 5)], "crop_id long, row int, col int")
    got = rescoring(frame, points, built, 10).first().asDict()
    assert got == {"n": 3, "raw_solved": 1, "raw_crosses": 1, "moved_solved": 1, "rescued": 1, "gained": 1, "lost": 1, "raw_share": 0.333333, "moved_share": 0.333333}
