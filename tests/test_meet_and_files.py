"""Hot keys of joins, manifests of files, and reports on recomputed targets."""

import functools
import hashlib
import os
import random

import pytest
from pyspark.sql import functions as F

from cellweave.operators import meet, metrics, places, raster, routes
from cellweave.sources import tables


def _sides(spark):
    left = spark.range(3000).select(F.when(F.col("id") < 2500, 7).when(F.col("id") < 2990, F.col("id") % 5).alias("k"), F.col("id").alias("a"))
    right = spark.range(2000).select(F.when(F.col("id") < 1500, 7).otherwise(F.col("id") % 5).alias("k"), F.col("id").alias("b"))
    return left, right


def test_hot_keys_are_dealt_and_every_pair_meets_once(spark):
    left, right = _sides(spark)
    got = meet.meet(left, right, ["k"], block=256)
    want = left.join(right, "k")
    assert got.columns == want.columns
    digest = lambda df: df.agg(F.count("*"), F.count_distinct("k", "a", "b"), F.sum(F.xxhash64("k", "a", "b").cast("decimal(38,0)"))).first()
    assert digest(got) == digest(want)
    a, b, on = meet.dealt(left, right, ["k"], block=256)
    assert a.filter("k = 7").groupBy(*on).count().agg(F.max("count")).first()[0] < 2 * 256
    assert b.filter("k = 7").groupBy(*on).count().agg(F.max("count")).first()[0] < 2 * 256


def test_keys_that_are_not_hot_are_joined_as_they_are(spark):
    left, right = _sides(spark)
    a, b, on = meet.dealt(left, right, ["k"])
    assert (a, b, on) == (left, right, ["k"])
    assert meet.meet(left.limit(0), right, ["k"], block=1).count() == 0


def test_one_side_alone_may_be_hot(spark):
    left = spark.createDataFrame([(1, 0), (1, 1)], "k int, a int")
    right = spark.range(5000).select(F.lit(1).alias("k"), F.col("id").alias("b"))
    a, b, on = meet.dealt(left, right, ["k"], block=64)
    assert b.groupBy(*on).count().agg(F.max("count")).first()[0] < 128
    assert a.join(b, on).count() == 10000 == meet.meet(left, right, ["k"], block=64).count()


@pytest.fixture
def small_blocks(monkeypatch):
    small = functools.partial(meet.meet, block=16)
    monkeypatch.setattr(places, "meet", small)
    monkeypatch.setattr(raster, "meet", small)


def test_dense_places(spark, small_blocks):
    rng = random.Random(5)
    dots = lambda n: [(1, "x", rng.randrange(90) / 2, rng.randrange(90) / 2) for _ in range(n)] + [(2, "x", 500.0, 500.0)]
    one, two = dots(400), dots(300)
    frame = "d int, name string, x double, y double"
    got = places.pairs_within(spark.createDataFrame(one, frame), spark.createDataFrame(two, frame), ["d"], 30.0, [])
    want = sum(1 for p in one for q in two if p[0] == q[0] and (p[2] - q[2]) ** 2 + (p[3] - q[3]) ** 2 <= 900)
    assert got.agg(F.sum(F.col("na") * F.col("nb"))).first()[0] == want
    assert got.count() == got.select("d", "ax", "ay", "x", "y").distinct().count()


def test_dense_boxes(spark, small_blocks):
    rng = random.Random(6)
    rows = []
    for i in range(250):
        x, y = rng.randrange(40), rng.randrange(40)
        rows.append((1, i, x, y, x + rng.randrange(1, 90), y + rng.randrange(1, 9), i % 3))
    got = raster.overlapping_boxes(spark.createDataFrame(rows, "d int, bid int, x0 int, y0 int, x1 int, y1 int, level int"), ["d"], "bid", ["level"])
    want = set()
    for a in rows:
        for b in rows:
            w, h = min(a[4], b[4]) - max(a[2], b[2]), min(a[5], b[5]) - max(a[3], b[3])
            if a[1] < b[1] and w > 0 and h > 0:
                want.add((a[1], b[1], w * h))
    found = [(r.a_bid, r.b_bid, r.area) for r in got.collect()]
    assert len(found) == len(want) and set(found) == want


def test_manifest_of_files(spark, tmp_path):
    rows = [("a b", 0, 2, "second"), ("a b", 0, 1, "first\nof two"), ("a b", 1, 3, None), ("ü", 0, 4, "wörter")]
    frame = spark.createDataFrame(rows, "layer string, part int, id int, text string")
    old, new = str(tmp_path / "old"), str(tmp_path / "new")
    tables.write_layers(frame, old, ["layer", "part"], ["id"], "text")
    tables.write_layers(frame.filter("part = 1").withColumn("text", F.lit("again")), new, ["layer", "part"], ["id"], "text")
    first, second = tables.provenance(spark, old, "*.txt"), tables.provenance(spark, new, "*.txt")
    for r in first.collect():
        with open(os.path.join(old, r.file), "rb") as f:
            body = f.read()
        assert (r.bytes, r.lines, r.sha256) == (len(body), body.count(b"\n"), hashlib.sha256(body).hexdigest())
    stamped = tables.update_manifest(first.withColumn("stamp", F.lit(1)), second.withColumn("stamp", F.lit(2)), ["layer", "part"]).collect()
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert [(r.layer, r.part, r.stamp, r.sha256) for r in stamped] == [
        ("a b", 0, 1, digest("first\nof two\nsecond\n")), ("a b", 1, 2, digest("again\n")), ("ü", 0, 1, digest("wörter\n"))]
    assert all(r.changed.endswith("Z") and len(r.changed) == 20 for r in stamped)


def test_composition_against_plain_masks(spark):
    rng = random.Random(7)
    pixels = [(w, r, c, rng.choice([1, 1, 1, 2]), rng.choice([0, 0, 1])) for w in range(3) for r in range(8) for c in range(8)]
    single = [(w, r, c, atom, rng.random() < 0.5) for w in range(3) for r in range(2) for c in range(2) for atom in ("surface_1", "estab_0")]
    got = metrics.composition(
        spark.createDataFrame(pixels, "crop_id int, row int, col int, surface int, estab int"),
        spark.createDataFrame(single, "crop_id int, gr int, gc int, atom string, hit boolean"), {"both": (("surface", 1), ("estab", 0))}, 4).collect()
    told = {x[:4]: x[4] for x in single}
    ceilings, composed = [], []
    for w in range(3):
        t, m, p = set(), set(), set()
        for gr in range(2):
            for gc in range(2):
                px = [x for x in pixels if x[0] == w and x[1] // 4 == gr and x[2] // 4 == gc]
                a, b = [x[3] == 1 for x in px], [x[4] == 0 for x in px]
                if sum(u and v for u, v in zip(a, b)) >= 8:
                    t.add((gr, gc))
                if sum(a) >= 8 and sum(b) >= 8:
                    m.add((gr, gc))
                if told[w, gr, gc, "surface_1"] and told[w, gr, gc, "estab_0"]:
                    p.add((gr, gc))
        if t:
            ceilings.append(len(m & t) / len(m | t))
            composed.append(len(p & t) / len(p | t))
    assert len(ceilings) > 1
    assert [(r.n, r.ceiling, r.composed_iou) for r in got] == [(len(ceilings), round(sum(ceilings) / len(ceilings), 6), round(sum(composed) / len(composed), 6))]


def test_cross_table_counts_every_line_with_a_verdict_of_its_cells(spark):
    cells = spark.createDataFrame([(1, True), (2, False), (3, True)], "crop_id int, cell_rule boolean")
    lines = spark.createDataFrame([(1, True)] * 4 + [(1, False)] + [(2, True)] * 2 + [(9, True)], "crop_id int, line_rule boolean")
    got = {(r.cell_rule, r.line_rule): r.n for r in routes.rule_cross_table(cells, lines, ["crop_id"]).collect()}
    assert got == {(True, True): 4, (True, False): 1, (False, True): 2}


def test_made_rows_count_in_size_estimates(spark, sf_dir):
    """Sides that grow by a fixed factor must not pass for small ones, or a later join sends them whole through the driver."""
    from cellweave.operators import grids, places
    from cellweave.plans import fixtures as fx

    rows = spark.range(100).selectExpr("id AS row", "id AS col")
    made = [fx.view(spark, sf_dir, v) for v in ("fx_raster", "fx_pred", "fx_atom_pred", "fx_route_points", "fx_dense_lines")]
    made += [fx.grid(spark, sf_dir), grids.spread(rows, grids.disc_offsets(7)), places._around(spark.range(100).selectExpr("id AS x", "id AS y"), 3.0)]
    for df in made:
        estimate = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
        assert estimate >= 8 * df.count(), df.columns


def test_meet_sends_no_side_through_the_driver(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10MB")
    try:
        both = meet.meet(spark.range(50).withColumn("a", F.lit(1)), spark.range(50).withColumn("b", F.lit(2)), ["id"])
        plan = both._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
        assert both.count() == 50
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")


def test_pairs_of_equal_names_are_found_once(spark, sf_dir):
    from cellweave.plans import QUERIES

    df = QUERIES["j06_name_matches"](spark, sf_dir)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    # of the joins by grid cell only that of all near places is left in the plan
    assert sum("Join Inner" in x and "_cx" in x for x in plan.splitlines()) == 1
