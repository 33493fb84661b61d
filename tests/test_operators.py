"""Operators against hand loops, golden worlds and invariants."""

import datetime as dt
import heapq
import math
import random

import pytest
from pyspark.sql import functions as F

from cellweave.functions import answers, geo, solar
from cellweave.operators import frontier as fr
from cellweave.operators import grids, ledger, metrics, ranking, targets
from cellweave.operators import raster as rs
from cellweave.operators import routes as rt


def test_tiered_rank_with_one_hot_group(spark):
    rng = random.Random(1)
    rows = [(0 if rng.random() < 0.8 else rng.randrange(5), rng.randrange(4), rng.randrange(20), i) for i in range(2000)]
    df = spark.createDataFrame(rows, "k int, v int, r int, c int")
    got = {(r.k, r.c): r.rn for r in ranking.tiered_rank(df, ["k"], ["v", "r", "c"]).collect()}
    for k in {r[0] for r in rows}:
        for i, r in enumerate(sorted((r for r in rows if r[0] == k), key=lambda r: r[1:]), 1):
            assert got[(k, r[3])] == i



def test_exact_percentiles(spark):
    rng = random.Random(2)
    rows = [(rng.choice([0, 0, 0, 1]), rng.choice([rng.uniform(-50, 50), 3.0])) for _ in range(500)]
    df = spark.createDataFrame(rows, "k int, v double")
    probs = [0.0, 0.1, 0.5, 0.9, 1.0]
    got = {r.k: r for r in ranking.exact_percentiles(df, ["k"], "v", probs).collect()}
    want = df.groupBy("k").agg(F.percentile("v", F.array(*[F.lit(p) for p in probs])).alias("p")).collect()
    for w in want:
        assert [got[w.k][f"p{round(p * 100)}"] for p in probs] == pytest.approx(w.p)


def test_percentile_weights_stand_for_rows(spark):
    df = spark.createDataFrame([(1.0, 3), (5.0, 1)], "v double, w int")
    assert ranking.exact_percentiles(df, [], "v", [0.5], weight="w").first().p50 == 1.0


@pytest.mark.parametrize("day,noon,hours", [("2026-06-21", 61.1, 16.8), ("2026-12-21", 14.2, 7.7), ("2026-03-20", 37.6, 12.2)])
def test_sun_against_almanac(spark, day, noon, hours):
    start = dt.datetime.fromisoformat(day + "T00:00:00+00:00").timestamp()
    el, _ = solar.sun_position(52.35, 4.89, F.lit(float(start)) + F.col("id") * 60)
    r = spark.range(1440).select(el.alias("el")).agg(F.max("el").alias("top"), (F.count_if(F.col("el") > -0.833) / 60).alias("h")).first()
    assert r.top == pytest.approx(noon, abs=0.5) and r.h == pytest.approx(hours, abs=0.1)


def test_metric_grid_known_point_and_round_trip(spark):
    x, y = geo.to_metric(F.col("lat"), F.col("lon"))
    row = spark.createDataFrame([(52.15517440, 5.38720621), (52.3731, 4.8926)], "lat double, lon double").select(x.alias("x"), y.alias("y"))
    got = row.collect()
    assert (got[0].x, got[0].y) == (155000.0, 463000.0)
    assert (got[1].x, got[1].y) == (pytest.approx(121300, abs=300), pytest.approx(487400, abs=300))
    lat, lon = geo.to_wgs84(F.col("x"), F.col("y"))
    back = row.select(lat.alias("lat"), lon.alias("lon")).collect()[1]
    assert (back.lat, back.lon) == (pytest.approx(52.3731, abs=1e-5), pytest.approx(4.8926, abs=1e-5))


ANSWERS = [
    ('{"path": [[1, 2], [3, 4]]}', [[1, 2], [3, 4]]),
    ('{"route": [[1, 2], [3, 4]], "points": 5}', [[1, 2], [3, 4]]),
    ("Sure: ```json\n[[1, 2], [3, 4.5]]\n``` ok", [[1, 2], [3, 4.5]]),
    ("go [1, 2] then [3, 4", None),
    ("go [1, 2] then [3, 4] then [5", [[1, 2], [3, 4]]),
    ('{"path": [[1, 2], [3]]}', None),
    ("", None),
    ("[" + ", ".join(f"[{i}, {i}]" for i in range(20)) + "]", [[i, i] for i in range(20)]),
]


@pytest.mark.parametrize("text,want", ANSWERS)
def test_answer_parsing(spark, text, want):
    got = spark.createDataFrame([(text,)], "t string").select(answers.answer_points(F.col("t")).alias("p")).first().p
    assert got == want


def test_answer_parsing_takes_as_many_points_as_asked(spark):
    text = "[" + ", ".join(f"[{i}, {i}]" for i in range(20)) + "]"
    got = spark.createDataFrame([(text,)], "t string").select(answers.answer_points(F.col("t"), max_points=12).alias("p")).first().p
    assert got == [[i, i] for i in range(12)]


def block_world():
    """200 x 200 free ground with a wall and a closed court."""
    built = {(r, 100) for r in range(40, 160)}
    built |= {(r, c) for r in range(10, 21) for c in range(150, 161) if r in (10, 20) or c in (150, 160)}
    return built


def test_verdict_of_every_reason(spark):
    built = spark.createDataFrame([(0, r, c) for r, c in block_world()], "crop_id long, row int, col int")
    ids = range(5)
    routes = spark.createDataFrame(
        [(i, 0, 50.5, 100.5, 150.5, 100.5, 240.0, 4) for i in ids],
        "route_id long, crop_id long, sx double, sy double, gx double, gy double, teacher_m double, n_goal int")
    detour = [(50.5, 100.5), (100.5, 30.5), (150.5, 100.5)]
    lines = {
        0: detour, 1: [(50.5, 100.5), (150.5, 100.5)], 2: [(60.0, 100.5), (100.5, 30.5), (150.5, 100.5)],
        3: [(50.5, 100.5), (20.5, 100.5), (20.5, 30.5), (145.5, 30.5), (150.5, 100.5)],
    }
    pts = spark.createDataFrame([(k, i, float(x), float(y)) for k, v in lines.items() for i, (x, y) in enumerate(v)], "route_id long, pos int, x double, y double")
    got = {r.route_id: (r.solved, r.reason) for r in rt.verdicts(routes, pts, built, 200).collect()}
    assert got == {0: (True, None), 1: (False, "crosses a building"), 2: (False, "wrong endpoints"), 3: (False, "too long"), 4: (False, "unparseable")}


def test_segments_across_position_blocks(spark):
    n = 2 * rt.POS_BLOCK + 5
    pts = spark.range(n).selectExpr("1L AS route_id", "CAST(id AS INT) AS pos", "CAST(id AS DOUBLE) AS x", "0D AS y")
    r = rt.segments(pts, ["route_id"]).agg(F.count("*").alias("n"), F.sum(rt.seg_length()).alias("m"), F.countDistinct("seg").alias("d")).first()
    assert (r.n, r.m, r.d) == (n - 1, float(n - 1), n - 1)


def dijkstra(cells, start, moves, half):
    best, heap = {start: 0}, [(0, start)]
    while heap:
        d, (r, c) = heapq.heappop(heap)
        if d > best[(r, c)]:
            continue
        for dy, dx in moves:
            v = (r + dy, c + dx)
            if v in cells:
                w = half(r, c, dy, dx) + half(*v, dy, dx)
                if d + w < best.get(v, math.inf):
                    best[v] = d + w
                    heapq.heappush(heap, (d + w, v))
    return best


def random_world(seed, side=12, share=0.7):
    rng = random.Random(seed)
    return {(r, c) for r in range(side) for c in range(side) if rng.random() < share} | {(0, 0)}


def test_field_and_walk_against_dijkstra(spark):
    worlds = {k: random_world(k) for k in range(3)}
    cells = spark.createDataFrame([(k, r, c, 1.0 + (r * 7 + c) % 3) for k, w in worlds.items() for r, c in sorted(w)], "crop_id int, row int, col int, price double")
    starts = spark.createDataFrame([(k, 0, 0) for k in worlds], "crop_id int, srow int, scol int")
    field = fr.cheapest_field(cells, starts, ["crop_id"], "price")
    got = {(r.crop_id, r.row, r.col): r.cost for r in field.collect()}
    metres = {(r.crop_id, r.row, r.col): r.metres for r in fr.walked_metres(field, ["crop_id"]).collect()}
    tree = {(r.crop_id, r.row, r.col): (r.prow, r.pcol) for r in field.collect()}

    def half(r, c, dy, dx):
        return round((1.0 + (r * 7 + c) % 3) * 500000 * math.hypot(dy, dx))

    for k, w in worlds.items():
        want = dijkstra(w, (0, 0), grids.neighbours8(), half)
        assert {c: got[(k, *c)] for c in w if got[(k, *c)] is not None} == want
        for cell in want:
            m, at = 0.0, cell
            while tree[(k, *at)][0] is not None:
                p = tree[(k, *at)]
                m += math.hypot(at[0] - p[0], at[1] - p[1])
                at = p
            assert at == (0, 0) and metres[(k, *cell)] == pytest.approx(m, abs=1e-6)
    goals = spark.createDataFrame([(k, *max(c for c in w if got[(k, *c)] is not None)) for k, w in worlds.items()], "crop_id int, grow int, gcol int")
    way = fr.way_back(field, goals, ["crop_id"])
    for g in goals.collect():
        cells_on_way = [(r.row, r.col) for r in way.filter(F.col("crop_id") == g.crop_id).orderBy("pos").collect()]
        assert cells_on_way[0] == (g.grow, g.gcol) and cells_on_way[-1] == (0, 0)
        assert all(tree[(g.crop_id, *a)] == b for a, b in zip(cells_on_way, cells_on_way[1:]))


@pytest.mark.parametrize("diagonal", [False, True])
def test_components_against_flood_fill(spark, diagonal):
    cells = random_world(9, 40, 0.55)
    df = spark.createDataFrame([(0, r, c) for r, c in cells], "crop_id int, row int, col int")
    got = {(r.row, r.col): r.label for r in fr.label_cells(df, ["crop_id"], diagonal, 40).collect()}
    seen = {}
    for cell in sorted(cells):
        if cell in seen:
            continue
        stack, seen[cell] = [cell], cell[0] * 40 + cell[1]
        while stack:
            r, c = stack.pop()
            for dy, dx in grids.neighbours8():
                v = (r + dy, c + dx)
                if v in cells and v not in seen and (diagonal or dy == 0 or dx == 0):
                    seen[v] = seen[cell]
                    stack.append(v)
    assert got == seen


def test_distance_against_brute_force(spark):
    rng = random.Random(3)
    cls = {(r, c): rng.choice([0, 0, 0, 0, 1, 2]) for r in range(14) for c in range(17)}
    df = spark.createDataFrame([(0, r, c, v) for (r, c), v in cls.items()], "crop_id int, row int, col int, v int")
    got = {(r.row, r.col): r.dist for r in fr.distance_to_other(df, ["crop_id"], "v", [0, 1, 2]).collect()}
    for a, v in cls.items():
        assert got[a] == pytest.approx(min(math.dist(a, b) for b, u in cls.items() if u != v))


def test_polygon_with_hole_burns_and_hosts(spark):
    rings = "array(array(struct(0D AS x, 0D AS y), struct(10D AS x, 0D AS y), struct(10D AS x, 10D AS y), struct(0D AS x, 10D AS y)), " \
            "array(struct(3D AS x, 3D AS y), struct(7D AS x, 3D AS y), struct(7D AS x, 7D AS y), struct(3D AS x, 7D AS y)))"
    poly = spark.range(1).selectExpr("0 AS district", "7L AS bid", f"{rings} AS rings")
    cells = {(r.row, r.col) for r in rs.span_cells(rs.spans(poly, ["district", "bid"])).collect()}
    assert cells == {(r, c) for r in range(10) for c in range(10) if not (3 <= r < 7 and 3 <= c < 7)}
    pts = spark.createDataFrame([(0, 1, 1.5, 1.5), (0, 2, 5.0, 5.0), (0, 3, 40.0, 5.0)], "district int, id long, x double, y double")
    assert [r.id for r in rs.hosts(pts, poly, ["district"], "id", "bid").collect()] == [1]
    assert rs.touching_box(poly, ["bid"], 4, 4, 6, 6).count() == 0  # the box lies in the hole
    assert rs.touching_box(poly, ["bid"], 1, 1, 2, 2).count() == 1  # the box lies inside the polygon
    assert rs.touching_box(poly, ["bid"], 9, 9, 30, 30).count() == 1


def test_simplified_line_never_crosses(spark):
    built = spark.createDataFrame([(0, r, 10) for r in range(0, 15)], "crop_id long, row int, col int")
    dense = [(2.5 + i, 5.5) for i in range(6)] + [(8.5, 5.5 + i) for i in range(1, 12)] + [(8.5 + i, 16.5) for i in range(1, 5)]
    pts = spark.createDataFrame([(1, i, x, y) for i, (x, y) in enumerate(dense)], "route_id long, pos int, x double, y double")
    frame = spark.createDataFrame([(1, 0)], "route_id long, crop_id long")
    kept = rt.simplify(pts, frame, built, 100.0, 32)
    line = pts.join(kept, ["route_id", "pos"]).select("route_id", F.expr("row_number() OVER (PARTITION BY route_id ORDER BY pos) - 1").alias("pos"), "x", "y")
    segs = rt.segments(line, ["route_id"]).join(frame, "route_id")
    assert 2 < line.count() < len(dense)
    assert not rt.crossing(segs, "crop_id", built, ["route_id"], 32).first().crosses


def test_overlap_conventions(spark):
    rows = [(1, 0, 0, False, False), (1, 0, 1, False, False), (2, 0, 0, True, True), (2, 0, 1, True, False)]
    df = spark.createDataFrame(rows, "sample_id int, gr int, gc int, pred boolean, tgt boolean").withColumn("task", F.lit(1))
    counts = metrics.overlap_counts(df, ["sample_id", "task"], F.col("pred"), F.col("tgt"))
    assert metrics.overlap_report(counts, ["task"]).first().iou == 0.5
    assert metrics.overlap_report(counts, ["task"], skip_empty=False).first().iou == 0.75


def test_best_threshold_takes_the_first_of_equals(spark):
    df = spark.createDataFrame([(0, 0.1, 0.4), (0, 0.2, 0.6), (0, 0.3, 0.6)], "task int, threshold double, iou double")
    assert metrics.best_threshold(df, ["task"]).first().best_threshold == 0.2


def test_task_keys():
    a, b = targets.Atom("surface", 2), targets.Atom("noise7", 0)
    assert targets.task_key(a, b) == targets.task_key(b, a) == "noise7_0+surface_2"
    with pytest.raises(ValueError):
        targets.task_key(a, targets.Atom("surface", 3))


def test_running_offsets_over_blocks(spark):
    df = spark.range(50).withColumn("n", F.col("id") % 7)
    got = {r.id: r.offset for r in ledger.running_offsets(df, "id", F.col("n"), block=4).collect()}
    total = 0
    for i in range(50):
        assert got[i] == total
        total += i % 7


class NamedSession:
    """A session that names a shared folder, or none, on a given master."""

    def __init__(self, folder, master):
        self.conf = {"spark.checkpoint.dir": folder} if folder else {}
        self.sparkContext = type("Context", (), {"master": master, "applicationId": "app"})()


def test_stage_folder_follows_the_session():
    from cellweave.session import scratch_folder

    assert scratch_folder(NamedSession("hdfs://shared/ck", "yarn")).startswith("hdfs://shared/ck/")
    with pytest.raises(ValueError):
        scratch_folder(NamedSession(None, "yarn"))
    assert scratch_folder(NamedSession(None, "local[2]"))


def _plain_field(cells, start, king):
    """Dijkstra over unit prices, in micro-units."""
    import heapq

    cost, heap = {start: 0}, [(0, start)]
    while heap:
        c, (r, q) = heapq.heappop(heap)
        if c > cost[(r, q)]:
            continue
        for dy, dx in king:
            to, w = (r + dy, q + dx), 2 * round((dy * dy + dx * dx) ** 0.5 * 500000)
            if to in cells and c + w < cost.get(to, 1 << 60):
                cost[to] = c + w
                heapq.heappush(heap, (c + w, to))
    return cost


def test_field_across_blocks(spark, monkeypatch):
    """Ways that cross blocks often give what one block gives, for king and knight steps; negative cells count too."""
    import random

    from cellweave.operators import frontier

    rng = random.Random(3)
    free = [(r - 5, c - 7) for r in range(30) for c in range(30) if rng.random() > 0.3 or (r, c) == (2, 2)]
    cells = spark.createDataFrame([(w, r, c) for w in (1, 2) for r, c in free], "w long, row int, col int")
    starts = spark.createDataFrame([(1, -3, -5), (2, *free[-1])], "w long, srow int, scol int")
    for moves in (frontier.KING, frontier.KNIGHT):
        want = {w: _plain_field(set(free), s, moves.offsets) for w, s in ((1, (-3, -5)), (2, free[-1]))}
        for block in (8, 256):
            monkeypatch.setattr(frontier, "BLOCK", block)
            rows = frontier.cheapest_field(cells, starts, ["w"], "1.0D", moves).collect()
            assert len(rows) == 2 * len(free)
            assert all(r.cost == want[r.w].get((r.row, r.col)) for r in rows)


def test_long_walks_keep_distance_and_fronts(spark):
    """A walk of 1.5 km keeps its distance, and its cells lie on fronts beyond the 12th."""
    from cellweave.operators import wave

    line = spark.createDataFrame([(1, 0, c, float(c)) for c in range(1500)], "crop_id long, row int, col int, metres double")
    field = wave.two_metre_field(line, ["crop_id"])
    assert field.agg({"d2": "max"}).first()[0] == 749
    goals = spark.createDataFrame([(1, 150)], "crop_id long, n_goal int")
    rings = wave.rings(wave.cell_min_max(field, ["crop_id"], 2), goals, ["crop_id"], 10.0)
    assert {r.j for r in rings.collect()} >= set(range(1, 150))


def test_marker_sets_lose_no_id(spark):
    import pytest

    from cellweave.operators.sampling import marker_sets

    ids = spark.range(300).withColumnRenamed("id", "k")
    rows = marker_sets(ids, "k", 4, 18, 32).collect()
    assert len(rows) == 1200
    by = {}
    for r in rows:
        by.setdefault(r.k, []).append((r.mrow, r.mcol))
    assert all((a - c) ** 2 + (b - d) ** 2 >= 324 for m in by.values() for i, (a, b) in enumerate(m) for c, d in m[:i])
    with pytest.raises(ValueError):
        marker_sets(ids.limit(2), "k", 4, 40, 32, 4, 2)


def test_draws_of_distant_ids_differ(spark):
    from cellweave.functions.hashing import draw, uniform

    ids = [5 + d for d in (0, 1 << 20, 1 << 26, 1 << 32, 1 << 40)]
    df = spark.createDataFrame([(i,) for i in ids], "i long").select(draw(F.col("i"), salt=3).alias("u"), uniform(F.col("i"), 1).alias("v"))
    assert len({r.u for r in df.collect()}) == len(ids)
    u = spark.range(4000).select(draw(F.col("id"), salt=3).alias("u")).agg(F.avg("u"), F.min("u"), F.max("u")).first()
    assert abs(u[0] - 0.5) < 0.03 and 0 <= u[1] and u[2] < 1


def test_latest_by_text_stamps(spark):
    from cellweave.operators.ledger import upsert

    a = spark.createDataFrame([("x", "2026-01-01T00:00:00Z", 1), ("y", None, 1)], "layer string, stamp string, v int")
    b = spark.createDataFrame([("x", "2026-01-02T00:00:00Z", 2), ("y", "2025-01-01T00:00:00Z", 2)], "layer string, stamp string, v int")
    assert {(r.layer, r.v) for r in upsert(a, b, ["layer"], "stamp").collect()} == {("x", 2), ("y", 2)}


def test_night_is_dark(spark):
    from cellweave.operators.sky import shadows

    heights = spark.createDataFrame([(1, r, c, 0, False) for r in range(3) for c in range(3)], "w long, row int, col int, height int, built boolean")
    suns = spark.createDataFrame([(0, -5.0, 10.0), (1, 40.0, 180.0)], "instant long, elevation double, azimuth double")
    assert [r["count"] for r in shadows(heights, suns, ["w"]).groupBy("instant").count().collect()] == [9]


def test_percentiles_of_narrow_and_wide_columns(spark):
    """One group, a million distinct values in [0, 1), and values up to 10^12 with most of them near zero."""
    import numpy as np

    from cellweave.operators.ranking import exact_percentiles

    one = spark.range(1_000_000).selectExpr("(id * 7919 % 1000003) / 1000003 AS v")
    got = exact_percentiles(one, [], "v", [0.1, 0.5, 0.999]).first()
    want = np.quantile([(i * 7919 % 1000003) / 1000003 for i in range(1_000_000)], [0.1, 0.5, 0.999])
    assert np.allclose([got.p10, got.p50, got.p100], want, rtol=0, atol=1e-12)
    wide = [10.0 ** (i % 13) + i for i in range(2000)] + [-3.5, 1e12]
    df = spark.createDataFrame([(v,) for v in wide] + [(None,), (float("nan"),), (float("inf"),)], "v double")
    got = exact_percentiles(df, [], "v", [0.0, 0.25, 0.5, 1.0]).first()
    assert np.allclose(list(got), np.quantile(wide, [0.0, 0.25, 0.5, 1.0]), rtol=1e-12)
