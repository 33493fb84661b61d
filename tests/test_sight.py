"""Segments that meet the ground of their window: what is sent, large windows, odd ends."""

import math
import random

import pytest
from pyspark.sql import functions as F

from cellweave.operators import routes
from cellweave.plans import QUERIES


def _want(lines, built, lo, hi):
    out = {}
    for i, f, x1, y1, x2, y2 in lines:
        n = max(math.ceil(math.sqrt((x2 - x1) ** 2 + (y2 - y1) ** 2) / 0.5), 1)
        cells = {(math.floor(y1 + k / n * (y2 - y1)), math.floor(x1 + k / n * (x2 - x1))) for k in range(n + 1)}
        out[i] = any((f, r, c) in built or not (lo <= r < hi and lo <= c < hi) for r, c in cells)
    return out


def test_rays_are_not_sent(spark, sf_dir):
    sent = lambda: spark._jsc.sc().statusStore().executorList(True).apply(0).totalShuffleWrite()
    before = sent()
    QUERIES["j12_line_of_sight"](spark, sf_dir).collect()
    spark._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    assert sent() - before < 100_000  # bytes; eight rays a route were sent as blocks of cells, and once more as keys


@pytest.mark.parametrize("side", [128, 700])
def test_windows_of_one_and_of_many_tiles(spark, side):
    rng = random.Random(side)
    built = {(f, rng.randrange(side), rng.randrange(side)) for f in range(2) for _ in range(side * side // 400)}
    lines = [(i, i % 3, *[rng.uniform(-3, side + 3) for _ in range(4)]) for i in range(120)]
    near = [(i + 120, i % 3, *[v + rng.uniform(-9, 9) for v in (256 - 128, 128) * 2]) for i in range(80)]  # across the border of tiles
    buildings = spark.createDataFrame(sorted(built), "crop_id long, row int, col int")
    pairs = spark.createDataFrame(lines + near, "i long, crop_id long, x1 double, y1 double, x2 double, y2 double")
    want = _want(lines + near, built, 0, side)
    assert 10 < sum(want.values()) < 195
    assert {r.i: r.crosses for r in routes.crossing(pairs, "crop_id", buildings, ["i"], side).collect()} == want
    free = sorted(i for i, hit in want.items() if not hit)
    assert sorted(r.i for r in routes.visible(pairs, "crop_id", buildings, ["i"], side).collect()) == free
    origins = pairs.select("i", "crop_id", "x1", "y1", F.array(F.struct(F.lit(7).alias("k"), "x2", "y2")).alias("rays"))
    rays = routes.visible_rays(origins, "crop_id", buildings, F.col("rays"), ["i", "k"], side)
    assert sorted((r.i, r.k) for r in rays.collect()) == [(i, 7) for i in free]


def test_ends_far_off_or_not_finite_are_off_the_ground(spark):
    inf, nan = float("inf"), float("nan")
    ends = [(5.0, 5.0), (1e12, 5.0), (inf, 5.0), (5.0, nan), (5.0, -inf), (5.0, None)]
    segs = spark.createDataFrame([(i, 0, 1.5, 1.5, *e) for i, e in enumerate(ends)], "i long, crop_id long, x1 double, y1 double, x2 double, y2 double")
    none = spark.createDataFrame([], "crop_id long, row int, col int")
    got = {r.i: r.crosses for r in routes.crossing(segs, "crop_id", none, ["i"], 32).collect()}
    assert got == {0: False, 1: True, 2: True, 3: True, 4: True}
