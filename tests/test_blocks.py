"""Jobs that are settled block by block, and made rows that are dealt to many tasks."""

import math
import random

import pytest
from pyspark.sql import functions as F

from cellweave.operators import frontier as fr
from cellweave.operators import routes
from cellweave.plans import fixtures as fx
from cellweave.plans import q_frontier


def _rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_made_rows_are_dealt_to_many_tasks(spark, sf_dir, monkeypatch):
    want = _rows(fx.view(spark, sf_dir, "fx_raster"))
    monkeypatch.setattr(fx, "ROWS_A_TASK", 2048)
    made = fx.view(spark, sf_dir, "fx_raster")
    sizes = [r["count"] for r in made.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    assert len(sizes) > 1 and max(sizes) < len(want)
    assert _rows(made) == want
    counted = made.groupBy("crop_id", "row").count()
    # the only shuffle is the one of the table that is read
    assert counted._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1


def _ground(spark):
    draw = random.Random(4)
    cells = [(w, r, c, int(draw.random() < 0.25)) for w in range(2) for r in range(-4, 20) for c in range(-4, 20)]
    cells = [(w, r, c, 0 if (r, c) in ((0, 0), (15, 15)) else b) for w, r, c, b in cells]
    ground = spark.createDataFrame(cells, "w long, row int, col int, built int")
    return ground, spark.createDataFrame([(w, 0, 0, 15, 15) for w in range(2)], "w long, srow int, scol int, grow int, gcol int")


def _plain_field(ground, starts):
    clear = fr.distance_to_other(ground, ["w"], "built", [0, 1]).filter("built = 0")
    priced = clear.select("w", "row", "col", fr.walking_price(F.coalesce("dist", F.lit(8.0))).alias("price"))
    return fr.cheapest_field(priced, starts, ["w"], "price")


def test_blocks_give_what_one_block_gives(spark, monkeypatch):
    ground, ends = _ground(spark)
    ground = ground.cache()
    free = ground.filter("built = 0").select("w", "row", "col")
    found = []
    for block in (256, 8):
        monkeypatch.setattr(fr, "BLOCK", block)
        field = fr.walking_field(ground, ends, ["w"], 4)
        way = fr.way_back(field, ends.select("w", "grow", "gcol"), ["w"])
        found.append((_rows(field), _rows(fr.walked_metres(field, ["w"])), _rows(way), _rows(fr.clear_moves(free, ["w"]))))
    assert found[0][0] == _rows(_plain_field(ground, ends))
    assert all(a == b for a, b in zip(*found))
    assert {w for w, *_ in found[0][2]} == {0, 1}


def test_windows_of_one_block_take_one_written_table(spark, monkeypatch):
    ground, ends = _ground(spark)
    written = []

    def counted(df, instead_of=None):
        written.append(df)
        return cut(df, instead_of)

    cut = fr.cut_lineage
    monkeypatch.setattr(fr, "cut_lineage", counted)
    field = fr.walking_field(ground, ends, ["w"], 4)
    assert len(written) == 1
    fr.walked_metres(field, ["w"])
    assert len(written) == 2
    fr.way_back(field, ends.select("w", "grow", "gcol"), ["w"])
    assert len(written) == 3


def test_starts_off_the_ground_and_windows_without_ground(spark):
    ground = spark.createDataFrame([(1, 0, 0, 1), (1, 0, 1, 0), (2, 0, 0, 1), (3, 0, 0, None)], "w int, row int, col int, built int")
    starts = spark.createDataFrame([(1, 0, 0), (2, 0, 0), (3, 0, 0), (9, 5, 5), (None, 0, 0)], "w long, srow long, scol long")
    assert [(r.w, r.row, r.col, r.cost) for r in fr.walking_field(ground, starts, ["w"]).collect()] == [(1, 0, 1, None)]
    cells = ground.filter("built = 0").select("w", "row", "col")
    assert [(r.w, r.cost) for r in fr.cheapest_field(cells, starts, ["w"]).collect()] == [(1, None)]


@pytest.mark.parametrize("block", [8, 256])
def test_clear_moves_cut_no_corner(spark, monkeypatch, block):
    monkeypatch.setattr(fr, "BLOCK", block)
    draw = random.Random(7)
    free = {(r, c) for r in range(-3, 14) for c in range(-3, 14) if draw.random() < 0.7}
    got = {(r.row, r.col): r.moves for r in fr.clear_moves(spark.createDataFrame([(1, *x) for x in sorted(free)], "w int, row int, col int"), ["w"]).collect()}
    assert set(got) == free
    for i, (dy, dx) in enumerate(sorted(fr.KNIGHT.offsets)):
        for r, c in free:
            between = {(dy, dx)}
            if abs(dy) + abs(dx) == 3:
                sy, sx = (dy > 0) - (dy < 0), (dx > 0) - (dx < 0)
                between |= {(sy if abs(dy) == 2 else 0, sx if abs(dx) == 2 else 0), (sy, sx)}
            elif abs(dy) + abs(dx) == 2:
                between |= {(0, dx), (dy, 0)}
            assert bool(got[(r, c)] >> i & 1) == all((r + y, c + x) in free for y, x in between)


@pytest.mark.parametrize("diagonal", [False, True])
def test_components_by_blocks(spark, monkeypatch, diagonal):
    draw = random.Random(11)
    rows = [(w, r, c) for w in range(2) for r in range(40) for c in range(40) if draw.random() < 0.6 + 0.1 * w]
    cells = spark.createDataFrame(rows, "w long, row int, col int").cache()
    runs = fr.label_runs(cells, ["w"], diagonal, 40)
    want = _rows(runs.select("w", "row", F.explode(F.sequence("c0", "c1")).alias("col"), "label"))
    written, cut = [], fr.cut_lineage
    monkeypatch.setattr(fr, "cut_lineage", lambda df, instead_of=None: written.append(df) or cut(df, instead_of))
    assert _rows(fr.label_cells(cells, ["w"], diagonal, 40)) == want
    assert len(written) == 1  # windows of one block take no rounds
    monkeypatch.setattr(fr, "BLOCK", 8)
    assert _rows(fr.label_cells(cells, ["w"], diagonal, 40)) == want


def test_crossing_sends_blocks_of_cells(spark):
    rng = random.Random(4)
    built = {(f, rng.randint(-9, 70), rng.randint(-9, 70)) for f in range(3) for _ in range(60)}
    lines = [(i, i % 3, *[rng.uniform(-9, 70) for _ in range(4)]) for i in range(300)]
    segs = spark.createDataFrame([(*x, -8, 69, -8, 69) for x in lines], "route_id long, crop_id long, x1 double, y1 double, x2 double, y2 double, r0 int, r1 int, c0 int, c1 int")
    buildings = spark.createDataFrame(sorted(built), "crop_id long, row int, col int")
    want = {}
    for i, f, x1, y1, x2, y2 in lines:
        n = max(math.ceil(math.sqrt((x2 - x1) ** 2 + (y2 - y1) ** 2) / 0.5), 1)
        cells = {(math.floor(y1 + k / n * (y2 - y1)), math.floor(x1 + k / n * (x2 - x1))) for k in range(n + 1)}
        want[i] = any((f, r, c) in built or not (-8 <= r < 69 and -8 <= c < 69) for r, c in cells)
    sent = lambda: spark._jsc.sc().statusStore().executorList(True).apply(0).totalShuffleWrite()
    before = sent()
    assert {r.route_id: r.crosses for r in routes.crossing(segs, "crop_id", buildings, ["route_id"], 64).collect()} == want
    spark._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    assert sent() - before < 150_000  # bytes; a row for each cell sends 212,052
    assert 20 < sum(want.values()) < 280


def test_walked_metres_never_go_through_the_driver(spark, sf_dir):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10MB")
    try:
        plan = q_frontier.goals(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


@pytest.mark.parametrize("name", [
    "a28_error_attribution", "a29_gap_by_task", "a36_verdicts_with_margin", "a37_route_report", "a51_label_agreement", "j11_segments_with_margin"])
def test_rows_of_small_files_never_go_through_the_driver(spark, sf_dir, name):
    """A few columns of a table look small by the size of its file: such sides were broadcast whole."""
    from cellweave.plans import QUERIES

    keys = {"spark.sql.autoBroadcastJoinThreshold": "100m", "spark.sql.adaptive.autoBroadcastJoinThreshold": "100m"}
    old = {k: spark.conf.get(k) for k in keys}
    try:
        for k, v in keys.items():
            spark.conf.set(k, v)
        df = QUERIES[name](spark, sf_dir)
        df.collect()
        lines = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].splitlines()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    # what is broadcast is a short range of numbers or was measured first
    assert any("SortMergeJoin" in x for x in lines)
    joins = [x for x in lines if "BroadcastHashJoin" in x]
    assert len(joins) <= (1 if "margin" in name else 0), joins


def test_small_windows_share_a_call_and_nothing_else(spark):
    ground, starts = _ground(spark)
    times = spark.range(0, 40, 1, 1).withColumnRenamed("id", "n")
    many = ground.crossJoin(times).selectExpr("n * 2 + w AS w", "row", "col", "built")
    begun = starts.crossJoin(times).selectExpr("n * 2 + w AS w", "srow", "scol", "grow", "gcol")
    one = fr.walking_field(ground, starts, ["w"], 4)
    field = fr.walking_field(many, begun, ["w"], 4)
    for got, want in ((field, one), (fr.walked_metres(field, ["w"]), fr.walked_metres(one, ["w"]))):
        want = _rows(want)
        for n in (0, 39):
            assert _rows(got.filter(f"w DIV 2 = {n}").withColumn("w", F.col("w") % 2)) == want
    blocks = many.selectExpr("w", "row", "col", "0 AS _br", "CAST(w = 7 AS INT) * 300 AS _bc").repartition(1)
    calls = spark.sparkContext.accumulator(0)

    def counted(rows, shift):
        calls.add(1)
        return rows.select(["w"])

    assert fr._stacked(blocks, ["w"], counted, "w long").count() == many.count()
    assert calls.value < 80  # windows, a call each before
