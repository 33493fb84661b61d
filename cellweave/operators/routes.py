"""Polylines as vertex tables ``(route_id, pos, x, y)`` with dense positions: length, crossings, verdicts."""

from __future__ import annotations

import functools
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellweave.functions.bins import FRONT_BANDS, front_band, rounded
from cellweave.operators.ranking import tiered_rank
from cellweave.session import cut_lineage

# Fixed values of the verdict
ENDPOINT_TOL_M = 6.0
MAX_LENGTH_RATIO = 1.10
SAMPLE_STEP_M = 0.5
REASONS = ("unparseable", "wrong endpoints", "crosses a building", "too long")

POS_BLOCK = 1024  # vertices handled together; a polyline of any length is spread over its blocks


def _in_blocks(points: DataFrame, keys: Sequence[str]) -> DataFrame:
    """:func:`segments` with the ``pos`` they end at and their block ``_b``, each block from its last segment to its first."""
    block = F.expr(f"pos DIV {POS_BLOCK}")
    both = F.when(F.col("pos") % POS_BLOCK == 0, F.array(block, block - 1)).otherwise(F.array(block))
    w = Window.partitionBy(*keys, "_b").orderBy(F.desc("pos"))
    return (
        points.withColumn("_b", F.explode(both))
        .select(*keys, "_b", "pos", F.lead("x").over(w).alias("x1"), F.lead("y").over(w).alias("y1"),
                F.col("x").alias("x2"), F.col("y").alias("y2"))
        .filter("x1 IS NOT NULL")
    )


def segments(points: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``(keys, seg, x1, y1, x2, y2)`` of neighbouring vertices.

    The window works on blocks of positions; the first vertex of a block is also sent to the block
    before it, so no polyline has to fit into one task and no self-join is needed.
    """
    return _in_blocks(points, keys).select(*keys, (F.col("pos") - 1).alias("seg"), "x1", "y1", "x2", "y2")


def seg_length() -> Column:
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    return F.sqrt(dx * dx + dy * dy)


def line_lengths(points: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``(keys, length_m)``: the segments of a line added from its last to its first.

    The order counts: a ratio of just 1.1 lies a last bit above or below the limit, as its lengths were added. A running
    sum fixes the order whatever the tasks do; it is that of the SQL on one thread. Lines beyond a block of positions
    are added block by block.
    """
    back = Window.partitionBy(*keys, "_b").orderBy(F.desc("pos")).rowsBetween(Window.unboundedPreceding, 0)
    blocks = _in_blocks(points, keys).withColumn("_m", F.sum(seg_length()).over(back)).groupBy(*keys, "_b").agg(F.max("_m").alias("_m"))
    over = Window.partitionBy(*keys).orderBy(F.desc("_b")).rowsBetween(Window.unboundedPreceding, 0)
    return blocks.withColumn("_m", F.sum("_m").over(over)).groupBy(*keys).agg(F.max("_m").alias("length_m"))


def samples(segs: DataFrame, step: float = SAMPLE_STEP_M) -> DataFrame:
    """Points at most ``step`` apart along each segment, both ends included, with their cell."""
    n = F.greatest(F.ceil(seg_length() / step), F.lit(1))
    at = segs.withColumn("_n", n).withColumn("step", F.explode(F.sequence(F.lit(0).cast("bigint"), "_n")))
    t = F.col("step") / F.col("_n")
    return at.withColumns({
        "row": F.floor(F.col("y1") + t * (F.col("y2") - F.col("y1"))).cast("int"),
        "col": F.floor(F.col("x1") + t * (F.col("x2") - F.col("x1"))).cast("int"),
    }).drop("_n")


BOUNDS = ("r0", "r1", "c0", "c1")  # half-open ground round a window, where it is more than the window


TILE = 256  # cells along a tile of ground; the one round 0 reaches from -128 to 127
PIECE = 512  # samples of a segment that are tested together; they span a tile at most
ROWS = 2048  # segments whose samples are made at once


def _ground(buildings: DataFrame, frame: str) -> DataFrame:
    """A row for each tile ``(frame, _tr, _tc)`` with buildings: blocks of 8 x 8 cells, one bit a cell, as a dense array."""
    tile = [F.shiftright(F.col(c) + TILE // 2, 8).alias(n) for c, n in (("row", "_tr"), ("col", "_tc"))]
    block = [F.shiftright("row", 3).alias("_br"), F.shiftright("col", 3).alias("_bc")]
    bit = F.expr("shiftleft(CAST(1 AS BIGINT), CAST((row & 7) * 8 + (col & 7) AS INT))")
    blocks = buildings.groupBy(frame, *tile, *block).agg(F.bit_or(bit).alias("_hit"))
    tiles = blocks.groupBy(frame, "_tr", "_tc").agg(
        F.min("_br").alias("_r"), F.max("_br").alias("_r9"), F.min("_bc").alias("_c"), F.max("_bc").alias("_c9"),
        F.map_from_entries(F.collect_list(F.struct(F.struct("_br", "_bc"), "_hit"))).alias("_map"),
    ).withColumn("_w", F.expr("_c9 - _c + 1"))
    bits = F.expr("transform(sequence(0, (_r9 - _r + 1) * _w - 1), j -> coalesce(try_element_at(_map, named_struct('_br', CAST(_r + j DIV _w AS INT), '_bc', CAST(_c + j % _w AS INT))), 0L))")
    return tiles.select(frame, "_tr", "_tc", "_r", "_c", "_w", bits.alias("_bits"))


def _sampled(segs: DataFrame, side: int) -> DataFrame:
    """``segs`` with their number of samples ``_n`` and ``_off``: do they leave the ground or have an end that is not finite.

    A box holds all samples if it holds the first and the last, so no sample is made for that.
    """
    r0, r1, c0, c1 = BOUNDS if set(BOUNDS) <= set(segs.columns) else (0, side, 0, side)
    inside = " AND ".join(f"{a} + {t} * ({b} - {a}) >= {lo} AND {a} + {t} * ({b} - {a}) < {hi}" for t in ("0D", "1D") for a, b, lo, hi in (("y1", "y2", r0, r1), ("x1", "x2", c0, c1)))
    n = F.greatest(F.ceil(seg_length() / SAMPLE_STEP_M), F.lit(1))
    return segs.withColumns({"_off": ~F.expr(inside), "_n": n}).filter("_off IS NOT NULL")


def _hits(batches: Iterator[pa.RecordBatch], keep: Sequence[str]) -> Iterator[pa.RecordBatch]:
    """The columns ``keep`` and ``_hit``: does a sample from number ``_lo`` to ``_hi`` lie on a building of the tile ``_bits``."""
    for batch in (b.slice(at, ROWS) for b in batches for at in range(0, b.num_rows, ROWS)):
        get = batch.column
        hit = get("_off").to_numpy(zero_copy_only=False).astype(bool)
        test = np.flatnonzero(~hit & (get("_w").to_numpy(zero_copy_only=False) > 0))
        if len(test):
            x1, y1, x2, y2, n, lo, hi, r, c, w = (get(k).to_numpy(zero_copy_only=False)[test] for k in ("x1", "y1", "x2", "y2", "_n", "_lo", "_hi", "_r", "_c", "_w"))
            bits = get("_bits")
            size, begin = np.diff(bits.offsets.to_numpy())[test], bits.offsets.to_numpy()[:-1][test]
            many = (hi - lo + 1).astype(np.int64)
            first = np.cumsum(many) - many
            own = np.repeat(np.arange(len(test)), many)
            t = (np.arange(len(own)) - np.repeat(first - lo.astype(np.int64), many)) / n[own]
            row, col = np.floor(y1[own] + t * (y2 - y1)[own]).astype(np.int64), np.floor(x1[own] + t * (x2 - x1)[own]).astype(np.int64)
            br, bc = (row >> 3) - r[own], (col >> 3) - c[own]
            at = br * w[own] + bc
            there = (bc >= 0) & (bc < w[own]) & (at >= 0) & (at < size[own])
            word = bits.values.to_numpy(zero_copy_only=False)[np.where(there, begin[own] + at, 0)]
            on = there & (word >> ((row & 7) * 8 + (col & 7)) & 1 == 1)
            hit[test] = np.logical_or.reduceat(on, first)
        yield pa.RecordBatch.from_arrays([*[get(k) for k in keep], pa.array(hit)], [*keep, "_hit"])


def _tested(spots: DataFrame, keep: Sequence[str]) -> DataFrame:
    """:func:`_hits` of segments that have met their ground."""
    there = spots.withColumns({k: F.coalesce(k, F.lit(0)) for k in ("_r", "_c", "_w", "_n", "_lo", "_hi")}).withColumn("_bits", F.coalesce("_bits", F.expr("array(0L)")))
    used = dict.fromkeys([*keep, "x1", "y1", "x2", "y2", "_off", "_n", "_lo", "_hi", "_r", "_c", "_w", "_bits"])
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spots.select(*keep).schema.fields)
    return there.select(*used).mapInArrow(functools.partial(_hits, keep=list(keep)), f"{fields}, _hit boolean")


def _met(segs: DataFrame, frame: str, buildings: DataFrame, side: int, keep: Sequence[str]) -> DataFrame:
    """The columns ``keep`` of ``segs`` and ``_hit``, a row for each piece of :data:`PIECE` samples and each tile that it may touch.

    A segment is sent once, to the tile of its window, and tested there; its samples are rows nowhere.
    """
    t = lambda a, b, i: f"shiftright(CAST(floor({a} + {i} / _n * ({b} - {a})) AS INT) + {TILE // 2}, 8)"
    span = lambda a, b: "sequence(least({0}, {1}), greatest({0}, {1}))".format(t(a, b, "lo"), t(a, b, f"least(lo + {PIECE - 1}, _n)"))
    spot = lambda lo, r, c: f"named_struct('lo', {lo}, 'r', {r}, 'c', {c})"
    one = " AND ".join([f"_n < {PIECE}", *[f"{t(a, b, 0)} = {t(a, b, '_n')}" for a, b in (("y1", "y2"), ("x1", "x2"))]])
    many = f"flatten(transform(sequence(0L, _n, {PIECE}L), lo -> flatten(transform({span('y1', 'y2')}, r -> transform({span('x1', 'x2')}, c -> {spot('lo', 'r', 'c')})))))"
    spots = F.expr(f"CASE WHEN _off THEN array({spot('0L', 0, 0)}) WHEN {one} THEN array({spot('0L', t('y1', 'y2', 0), t('x1', 'x2', 0))}) ELSE {many} END")
    sent = _sampled(segs, side).withColumn("_s", F.explode(spots)).select(
        *dict.fromkeys([frame, *keep, "x1", "y1", "x2", "y2"]), "_off", "_n", F.col("_s.lo").alias("_lo"), F.least(F.col("_s.lo") + PIECE - 1, "_n").alias("_hi"), F.col("_s.r").alias("_tr"), F.col("_s.c").alias("_tc"))
    return _tested(sent.join(_ground(buildings, frame).hint("merge"), [frame, "_tr", "_tc"], "left"), keep)


def crossing(segs: DataFrame, frame: str, buildings: DataFrame, keys: Sequence[str], side: int) -> DataFrame:
    """Per key: does any sample lie on a building or off the ground.

    The ground is the window, or the bounds ``r0, r1, c0, c1`` if the segments carry them; being off it is arithmetic, and
    a segment with an end that is not finite is off. Segments and the bits of their window meet in one join.
    """
    return _met(segs, frame, buildings, side, keys).groupBy(*keys).agg(F.bool_or("_hit").alias("crosses"))


def visible(pairs: DataFrame, frame: str, buildings: DataFrame, keys: Sequence[str], side: int) -> DataFrame:
    """Pairs ``(keys, x1, y1, x2, y2)`` whose connecting segment meets no building."""
    if side <= TILE // 2 and not set(BOUNDS) <= set(pairs.columns):  # one tile and one piece
        return _met(pairs, frame, buildings, side, pairs.columns).filter("NOT _hit").drop("_hit")
    free = _met(pairs, frame, buildings, side, keys).groupBy(*keys).agg(F.bool_or("_hit").alias("_hit")).filter("NOT _hit").select(*keys)
    return pairs.join(free.hint("merge"), list(keys), "left_semi")


def visible_rays(origins: DataFrame, frame: str, buildings: DataFrame, rays: Column, keys: Sequence[str], side: int) -> DataFrame:
    """:func:`visible` for the ``rays`` (array of structs with ``x2`` and ``y2``) of each origin ``(frame, x1, y1)``.

    Where a window is one tile, an origin is sent to it once and its rays are made there, so what is sent and kept does
    not grow with their number. ``keys`` are those of a ray.
    """
    spread = lambda df: df.withColumn("_ray", F.explode(rays)).select(*df.columns, "_ray.*")
    if side > TILE // 2:
        return visible(spread(origins), frame, buildings, keys, side)
    ground = _ground(buildings, frame).filter("_tr = 0 AND _tc = 0").drop("_tr", "_tc")
    there = spread(origins.join(ground.hint("merge"), frame, "left"))
    sampled = _sampled(there, side).withColumns({"_lo": F.lit(0).cast("bigint"), "_hi": F.col("_n")})
    return _tested(sampled, [c for c in there.columns if c not in ground.columns or c == frame]).filter("NOT _hit").drop("_hit")


def verdicts(routes: DataFrame, points: DataFrame, buildings: DataFrame, side: int) -> DataFrame:
    """One row per route: solved or the first failing check, with errors, length and ratio.

    ``routes``: route_id, crop_id, sx, sy, gx, gy, teacher_m, and the bounds of the ground if there is a halo. Routes
    without points are unparseable. All joins are merged: a few columns of the routes look small by the size of their
    file, and were sent whole through the driver.
    """
    bounds = [c for c in BOUNDS if c in routes.columns]
    ends = points.groupBy("route_id").agg(
        F.count("*").alias("n"), F.min_by(F.struct("x", "y"), "pos").alias("a"), F.max_by(F.struct("x", "y"), "pos").alias("b"),
        F.bool_and(F.col("x").isNotNull() & F.col("y").isNotNull() & ~F.isnan("x") & ~F.isnan("y")).alias("finite"),
    )
    segs = segments(points, ["route_id"]).join(routes.select("route_id", "crop_id", *bounds).hint("merge"), "route_id")
    lengths = line_lengths(points, ["route_id"])
    hits = crossing(segs, "crop_id", buildings, ["route_id"], side)
    err = lambda p, x, y: F.sqrt(F.pow(F.col(f"{p}.x") - F.col(x), 2) + F.pow(F.col(f"{p}.y") - F.col(y), 2))
    joined = (
        routes.join(ends.hint("merge"), "route_id", "left").join(lengths.hint("merge"), "route_id", "left").join(hits.hint("merge"), "route_id", "left")
        .withColumns({"start_err": err("a", "sx", "sy"), "goal_err": err("b", "gx", "gy"), "ratio": F.col("length_m") / F.col("teacher_m")})
    )
    reason = (
        F.when(F.col("n").isNull() | (F.col("n") < 2) | ~F.col("finite"), REASONS[0])
        .when((F.col("start_err") > ENDPOINT_TOL_M) | (F.col("goal_err") > ENDPOINT_TOL_M), REASONS[1])
        .when(F.col("crosses"), REASONS[2])
        .when(F.col("ratio") > MAX_LENGTH_RATIO, REASONS[3])
    )
    return joined.withColumn("reason", reason).withColumn("solved", F.col("reason").isNull()).drop("a", "b", "n", "finite")


def report(verdict: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Solved share overall and per band of fronts, failure shares and mean ratio of solved routes."""
    n = F.count("*")
    aggs = [n.alias("n"), F.count_if("solved").alias("solved"), rounded(F.count_if("solved") / n, 4).alias("solved_share")]
    for name, _, _ in FRONT_BANDS:
        inb = front_band(F.col("n_goal")) == name
        tag = name.replace("-", "_").replace("+", "_up")
        aggs.append(rounded(F.try_divide(F.count_if(F.col("solved") & inb), F.count_if(inb)), 4).alias(f"solved_{tag}"))
    for r in REASONS:
        aggs.append(rounded(F.count_if(F.col("reason") == r) / n, 4).alias("fail_" + r.replace(" ", "_")))
    aggs.append(rounded(F.avg(F.when(F.col("solved"), rounded(F.col("ratio"), 4))), 4).alias("mean_ratio_solved"))
    return verdict.groupBy(*by).agg(*aggs)


def supercover(segs: DataFrame, keys: Sequence[str], size: int, fine: int = 1024) -> DataFrame:
    """All cells of ``size`` that the segments ``(keys, x1, y1, x2, y2)`` touch, each once per key, as ``(row, col)``.

    A cell is half open: it holds its lower edges. Nothing is sampled: coordinates are taken on a grid of 1 / ``fine``
    (halves go up), and each segment is cut at the column borders it crosses. Inside a column strip the rows run from
    the row of one cut to that of the other, found by whole-number division, so corners and ties are exact as long as
    twice the product of the two sides, in fine steps, fits a BIGINT. A segment makes as many rows as it touches cells.
    A point is its own cell, a segment with a null or non-finite end touches nothing.
    """
    s = size * fine
    at = lambda c: F.floor(F.col(c) * fine + 0.5).cast("bigint")
    ends = [F.col(c).isNotNull() & (F.abs(F.col(c)) < float("inf")) for c in ("x1", "y1", "x2", "y2")]
    whole = segs.filter(functools.reduce(lambda a, b: a & b, ends)).select(*keys, *[at(c).alias(f"_{c}") for c in ("x1", "y1", "x2", "y2")])
    turned = F.col("_x1") > F.col("_x2")  # left end first
    way = whole.select(*keys, *[F.when(turned, F.col(b)).otherwise(F.col(a)).alias(n) for n, a, b in (("_l", "_x1", "_x2"), ("_lv", "_y1", "_y2"), ("_r", "_x2", "_x1"), ("_rv", "_y2", "_y1"))])
    way = way.withColumns({"_w": F.expr("_r - _l"), "_h": F.expr("_rv - _lv")})
    below = lambda a, b: f"(({a}) - pmod({a}, {b})) DIV ({b})"
    strips = way.withColumn("col", F.explode(F.expr(f"sequence({below('_l', s)}, {below('_r', s)})")))
    # heights at both cuts of the strip, in fine steps times the width of the segment
    cut = strips.withColumns({"_a": F.expr(f"greatest(col * {s}, _l)"), "_b": F.expr(f"least((col + 1) * {s}, _r)"), "_open": F.expr(f"(col + 1) * {s} <= _r")})
    cut = cut.withColumns({"_va": F.expr("_lv * _w + (_a - _l) * _h"), "_vb": F.expr("_lv * _w + (_b - _l) * _h - IF(_open AND _h > 0, 1, 0)"), "_d": F.expr(f"_w * {s}")})
    first = F.expr(f"IF(_w = 0, {below('_lv', s)}, {below('_va', 'greatest(_d, 1)')})")
    last = F.expr(f"IF(_w = 0, {below('_rv', s)}, {below('_vb', 'greatest(_d, 1)')})")
    return cut.withColumn("row", F.explode(F.sequence(F.least(first, last), F.greatest(first, last)))).select(*keys, "row", "col").distinct()


def visited_pixels(segs: DataFrame, keys: Sequence[str], side: int) -> DataFrame:
    """Distinct pixels of a polyline numbered in the order of their first visit."""
    px = samples(segs).withColumns({
        "row": F.least(F.greatest("row", F.lit(0)), F.lit(side - 1)), "col": F.least(F.greatest("col", F.lit(0)), F.lit(side - 1))
    })
    first = px.groupBy(*keys, "row", "col").agg(F.min(F.struct("seg", "step")).alias("_f"))
    flat = first.select(*keys, "row", "col", F.col("_f.seg").alias("_seg"), F.col("_f.step").alias("_i"))
    return tiered_rank(flat, keys, ["_seg", "_i"], "ord").drop("_seg", "_i")


def simplify(points: DataFrame, frame: DataFrame, buildings: DataFrame, tol: float, side: int) -> DataFrame:
    """Vertices kept when spans beyond the tolerance, or whose chord meets a building, are split at their farthest vertex.

    All open spans of all lines are handled in one round. Every inner vertex carries the ends of its span, so a
    round is one aggregate per span and one join back; closed spans leave the table. The vertices must fit the
    free ground themselves, then a valid result exists.
    """
    line = ["route_id"]
    ends = points.groupBy(*line).agg(F.min("pos").alias("i"), F.max("pos").alias("j"))
    at = points.select(*line, "pos", "x", "y")
    kept = [ends.select(*line, F.col("i").alias("pos")), ends.select(*line, F.col("j").alias("pos"))]

    def coords(spans: DataFrame) -> DataFrame:
        a = at.select(*line, F.col("pos").alias("i"), F.col("x").alias("x1"), F.col("y").alias("y1"))
        b = at.select(*line, F.col("pos").alias("j"), F.col("x").alias("x2"), F.col("y").alias("y2"))
        return spans.join(a, [*line, "i"]).join(b, [*line, "j"])

    inner = cut_lineage(at.join(coords(ends), line).filter("pos > i AND pos < j"))
    while not inner.isEmpty():
        length = seg_length()
        off = F.abs((F.col("x2") - F.col("x1")) * (F.col("y") - F.col("y1")) - (F.col("y2") - F.col("y1")) * (F.col("x") - F.col("x1")))
        away = F.sqrt(F.pow(F.col("x") - F.col("x1"), 2) + F.pow(F.col("y") - F.col("y1"), 2))
        dist = F.when(length > 0, off / F.nullif(length, F.lit(0.0))).otherwise(away)
        spans = inner.withColumn("_d", dist).groupBy(*line, "i", "j").agg(
            F.max("_d").alias("d"), F.max_by("pos", F.struct("_d", -F.col("pos"))).alias("k"),
            *[F.first(c).alias(c) for c in ("x1", "y1", "x2", "y2")],
            F.max_by(F.struct("x", "y"), F.struct("_d", -F.col("pos"))).alias("m"),
        )
        hits = crossing(spans.join(frame.hint("merge"), line), "crop_id", buildings, [*line, "i"], side)
        split = (
            spans.join(hits, [*line, "i"]).filter((F.col("d") > tol) | F.col("crosses"))
            .select(*line, "i", "j", "k", F.col("m.x").alias("mx"), F.col("m.y").alias("my"))
        )
        left = F.col("pos") < F.col("k")
        step = cut_lineage(
            inner.join(split, [*line, "i", "j"]).select(
                *line, "pos", "x", "y", (F.col("pos") == F.col("k")).alias("kept"),
                F.when(left, F.col("i")).otherwise(F.col("k")).alias("i"), F.when(left, F.col("k")).otherwise(F.col("j")).alias("j"),
                F.when(left, F.col("x1")).otherwise(F.col("mx")).alias("x1"), F.when(left, F.col("y1")).otherwise(F.col("my")).alias("y1"),
                F.when(left, F.col("mx")).otherwise(F.col("x2")).alias("x2"), F.when(left, F.col("my")).otherwise(F.col("y2")).alias("y2"),
            )
        )
        kept.append(step.filter("kept").select(*line, "pos"))
        inner = step.filter("NOT kept").drop("kept")
    out = kept[0]
    for k in kept[1:]:
        out = out.union(k)
    return out.distinct()


def rule_cross_table(cell_rule: DataFrame, line_rule: DataFrame, keys: list[str]) -> DataFrame:
    """How often two verdicts, ``cell_rule`` and ``line_rule``, of the same keys agree.

    Verdicts are counted per key before the join, so a key with many lines is two rows. Keys without both verdicts are left out.
    """
    counted = line_rule.groupBy(*keys, "line_rule").agg(F.count("*").alias("n"))
    return counted.join(cell_rule.select(*keys, "cell_rule"), keys).groupBy("cell_rule", "line_rule").agg(F.sum("n").alias("n"))
