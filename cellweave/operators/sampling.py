"""Seeded picks: windows, markers, tasks, route candidates, drawing noise. Draws depend on ids only, never on row order."""

from __future__ import annotations

import functools
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellweave.functions.hashing import draw
from cellweave.operators.grids import inside
from cellweave.operators.ranking import first_row, tiered_rank, top_k
from cellweave.session import cut_lineage


def touching(windows: DataFrame, size: int, block: int) -> DataFrame:
    """Each window once per block it touches, as (brow, bcol)."""
    return windows.withColumn("brow", F.explode(F.expr(f"sequence(CAST(dy DIV {block} AS INT), CAST((dy + {size} - 1) DIV {block} AS INT))"))).withColumn(
        "bcol", F.explode(F.expr(f"sequence(CAST(dx DIV {block} AS INT), CAST((dx + {size} - 1) DIV {block} AS INT))"))
    )


def off_held_out(windows: DataFrame, held: Sequence[tuple[int, int]], keys: Sequence[str], size: int, block: int) -> DataFrame:
    """Windows that touch no held-out block. The box overlap becomes an equality on block numbers."""
    bad = F.lit(False)
    for r, c in held:
        bad = bad | ((F.col("brow") == r) & (F.col("bcol") == c))
    hits = touching(windows, size, block).filter(bad).select(*keys).distinct()
    return windows.join(hits, list(keys), "left_anti")


def inside_one_block(windows: DataFrame, own: Sequence[tuple[int, int]], size: int, block: int) -> DataFrame:
    """Windows that lie fully inside one of the given blocks."""
    r, c = F.expr(f"CAST(dy DIV {block} AS INT)"), F.expr(f"CAST(dx DIV {block} AS INT)")
    same = (F.expr(f"(dy + {size} - 1) DIV {block}") == r) & (F.expr(f"(dx + {size} - 1) DIV {block}") == c)
    mine = F.lit(False)
    for br, bc in own:
        mine = mine | ((r == br) & (c == bc))
    return windows.filter(same & mine)


def first_origins(windows: DataFrame, district: str, n: int) -> DataFrame:
    """First n distinct origins of each district in draw order."""
    distinct = windows.groupBy(district, "dx", "dy").agg(F.min("draw").alias("draw"))
    return top_k(distinct, [district], [F.col("draw"), F.col("dx"), F.col("dy")], n, "rank")


def marker_sets(ids: DataFrame, key: str, k: int, min_dist: int, side: int, attempts: int = 64, most_rounds: int = 64) -> DataFrame:
    """K marker cells per id, every pair at least ``min_dist`` apart: the first attempt that passes.

    Attempts and pairs are arrays of fixed size inside the row. Ids without a passing attempt are drawn on in further
    rounds of ``attempts``, so none is lost; ids still open after ``most_rounds`` rounds make a setting impossible, and
    that is an error.
    """

    def cell(a: Column, i: int, salt: int) -> Column:
        return F.floor(draw(F.col(key), a, F.lit(i), salt=salt) * side).cast("int")

    def attempt(a: Column) -> Column:
        return F.array(*[F.struct(cell(a, i, 11).alias("row"), cell(a, i, 12).alias("col")) for i in range(k)])

    def spaced(m: Column) -> Column:
        ok = F.lit(True)
        for i in range(k):
            for j in range(i):
                dr, dc = m[i]["row"] - m[j]["row"], m[i]["col"] - m[j]["col"]
                ok = ok & (dr * dr + dc * dc >= min_dist * min_dist)
        return ok

    def tried(open_ids: DataFrame, r: int) -> DataFrame:
        numbers = F.sequence(F.lit(r * attempts).cast("bigint"), F.lit((r + 1) * attempts - 1).cast("bigint"))
        return cut_lineage(open_ids.select(key, F.try_element_at(F.filter(F.transform(numbers, attempt), spaced), F.lit(1)).alias("_m")))

    found = tried(ids, 0)
    done, left, r = found.filter("_m IS NOT NULL"), found.filter("_m IS NULL"), 1
    while not left.isEmpty():
        if r == most_rounds:
            raise ValueError(f"{left.count()} ids have no {k} markers {min_dist} apart on {side} x {side} cells in {r * attempts} attempts")
        found = tried(left.select(key), r)
        done, left, r = done.unionByName(found.filter("_m IS NOT NULL")), found.filter("_m IS NULL"), r + 1
    return done.select(key, F.posexplode("_m").alias("slot", "_m")).select(key, "slot", F.col("_m.row").alias("mrow"), F.col("_m.col").alias("mcol"))


def weighted_pick(u: Column, weights: Sequence[float]) -> Column:
    """Index whose share of the cumulative weights holds u."""
    total, cum = sum(weights), 0.0
    case = F.when(F.lit(False), F.lit(0))
    for i, w in enumerate(weights[:-1]):
        cum += w
        case = case.when(u * total < cum, F.lit(i))
    return case.otherwise(F.lit(len(weights) - 1))


def within_quota(routes: DataFrame, stratum: str, order: Sequence[Column], quotas: Sequence[int]) -> DataFrame:
    """Accepted routes per stratum in arrival order, with the rank of each."""
    ranked = top_k(routes, [stratum], order, max(quotas), "rank")
    quota = F.element_at(F.array(*[F.lit(q) for q in quotas]), F.col(stratum) + 1)
    return ranked.filter(F.col("rank") <= quota)


def quotas(n: int, strata: int) -> list[int]:
    """Equal quotas, the remainder to the first stratum."""
    out = [n // strata] * strata
    out[0] += n - sum(out)
    return out


@dataclass(frozen=True)
class Accepted:
    """What ``accept_until_full`` found: accepted draws with ``rank``, and how many draws ended for which reason."""

    rows: DataFrame
    reasons: DataFrame
    draws: int


def accept_until_full(propose: Callable[[int, int], DataFrame], stratum: str, quotas: Sequence[int], first: int = 4096, most_rounds: int = 16) -> Accepted:
    """Accept legal draws of each stratum in arrival order until every stratum has its quota.

    ``propose(lo, hi)`` gives the draws with numbers ``lo <= draw < hi``, one row each: ``draw``, ``stratum`` (null if it
    is not known), ``early`` and ``late``, the first reason that rules a draw out before and after its stratum is asked
    for room (null: none), and any other columns. Rounds double in size, so their number is logarithmic; between rounds
    the driver sees one count per stratum. Drawing ends with the draw that fills the last stratum, and draws after it
    do not count. ``reasons`` (reason, n) counts each draw once, under its first reason, 'stratum full' for those that
    came after the quota, or 'accepted', so the counts add up to ``draws``. Quotas that are not met after
    ``most_rounds`` are an error. A draw rests on its number alone, so reruns and other round sizes agree.
    """
    wanted = {i: q for i, q in enumerate(quotas) if q > 0}
    have, tried, lo, seen = dict.fromkeys(wanted, 0), [], 0, 0
    while any(have[i] < q for i, q in wanted.items()):
        if seen == most_rounds:
            short = {i: f"{have[i]} of {q}" for i, q in wanted.items() if have[i] < q}
            raise ValueError(f"strata not full after {lo} draws: {short}")
        hi = lo + first * 2**seen
        tried.append(cut_lineage(propose(lo, hi)))
        legal = tried[-1].filter("early IS NULL AND late IS NULL").filter(F.col(stratum).isin(list(wanted)))
        for i, n in legal.groupBy(stratum).agg(F.count("*")).collect():
            have[i] += n
        lo, seen = hi, seen + 1
    if not tried:
        tried.append(propose(0, 0))
    every = functools.reduce(DataFrame.unionByName, tried)
    quota = F.element_at(F.array(*[F.lit(q).cast("bigint") for q in quotas]), F.col(stratum).cast("int") + 1)
    room = F.col(stratum).isin(list(wanted))
    legal = every.filter("early IS NULL AND late IS NULL").filter(room).withColumn("_block", F.expr(f"draw DIV {first}"))
    rows = cut_lineage(tiered_rank(legal, [stratum], ["_block", "draw"], "rank").filter(F.col("rank") <= quota).drop("_block", "early", "late"))
    full = rows.groupBy(stratum).agg(F.max("draw").alias("_full"))  # one row per stratum
    end = full.agg(F.max("_full")).first()[0]
    draws = 0 if end is None else end + 1
    asked = every.filter(F.col("draw") < draws).join(F.broadcast(full), stratum, "left")
    reason = F.coalesce(F.col("early"), F.when(~F.coalesce(room, F.lit(False)) | (F.col("draw") > F.col("_full")), "stratum full"), F.col("late"), F.lit("accepted"))
    return Accepted(rows, asked.groupBy(reason.alias("reason")).agg(F.count("*").alias("n")), draws)


def inner_ground(free: DataFrame, keys: Sequence[str], side: int, margin: int) -> DataFrame:
    """Free cells at least two steps from anything not free and ``margin`` away from the window's edge."""
    diamond = [(dy, dx) for dy in range(-2, 3) for dx in range(-2, 3) if abs(dy) + abs(dx) <= 2]
    offs = F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in diamond])
    seen = free.withColumn("_o", F.explode(offs)).select(*keys, (F.col("row") + F.col("_o.dy")).alias("row"), (F.col("col") + F.col("_o.dx")).alias("col"))
    full = seen.groupBy(*keys, "row", "col").agg(F.count("*").alias("_n")).filter(F.col("_n") == len(diamond)).drop("_n")
    return full.filter(f"row >= {margin} AND row < {side - margin} AND col >= {margin} AND col < {side - margin}")


def noisy_drawings(lit: DataFrame, frame: DataFrame, key: str, side: int, p: float, thicken: float, shift: float, drop: float, add: float) -> DataFrame:
    """Drawings perturbed by seeded draws: widened, moved one cell, cells dropped, speckle added.

    ``lit``: key, row, col; ``frame``: every id once. Each drawing's draws come from its id, each cell's from id and cell.
    """
    k = F.col(key)
    pick = draw(k, salt=21) < p
    wide, move = pick & (draw(k, salt=22) < thicken), pick & (draw(k, salt=23) < shift)
    way = F.floor(draw(k, salt=24) * 4)
    dy = F.when(~move, 0).when(way == 0, -1).when(way == 1, 1).otherwise(0)
    dx = F.when(~move, 0).when(way == 2, -1).when(way == 3, 1).otherwise(0)
    all9 = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    one = F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j")))
    spreaded = lit.withColumns({"_o": F.when(wide, all9).otherwise(one), "_dy": dy, "_dx": dx}).withColumn("_o", F.explode("_o"))
    widened = spreaded.withColumns({"row": F.col("row") + F.col("_o.i"), "col": F.col("col") + F.col("_o.j")}).filter(inside("row", "col", side))
    moved = widened.select(key, (F.col("row") + F.col("_dy")).alias("row"), (F.col("col") + F.col("_dx")).alias("col")).filter(inside("row", "col", side))
    u = draw(k, F.col("row") * side + F.col("col"), salt=25)
    kept = moved.filter(~(pick & (u < drop))).select(key, "row", "col")
    specks = frame.select(key).filter(pick).withColumn("_c", F.explode(F.sequence(F.lit(0), F.lit(side * side - 1)))).select(
        key, F.expr(f"CAST(_c DIV {side} AS INT)").alias("row"), F.expr(f"CAST(_c % {side} AS INT)").alias("col")
    ).filter(u > 1.0 - add)
    return kept.unionByName(specks).distinct()


def corners(buildings: DataFrame, keys: Sequence[str], side: int) -> DataFrame:
    """Free pixels diagonal to a convex building corner: of the 2 x 2 pixels round a grid point exactly one is built.

    Every building pixel names the four grid points it touches; a point named once is a convex corner.
    """
    around = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (0, 1) for j in (0, 1)])
    named = buildings.withColumn("_o", F.explode(around)).select(
        *keys, (F.col("row") + F.col("_o.i")).alias("vr"), (F.col("col") + F.col("_o.j")).alias("vc"),
        F.when(F.col("_o.i") == 0, -0.5).otherwise(0.5).alias("oy"), F.when(F.col("_o.j") == 0, -0.5).otherwise(0.5).alias("ox"),
    )
    single = named.groupBy(*keys, "vr", "vc").agg(F.count("*").alias("_n"), F.min("oy").alias("oy"), F.min("ox").alias("ox")).filter("_n = 1")
    return single.select(*keys, (F.col("vc") + F.col("ox")).alias("x"), (F.col("vr") + F.col("oy")).alias("y")).filter(
        f"x >= 0 AND x < {side} AND y >= 0 AND y < {side}"
    )


def first_marker(items: DataFrame, key: str, order: str, cols: Sequence[str]) -> DataFrame:
    return first_row(items, [key], [F.col(order)], cols)


def atom_pairs(atoms: DataFrame, block: int = 256) -> DataFrame:
    """``(ka, kb)`` of all atoms ``(layer, key)`` on different layers, each pair once, the lower layer first.

    Atoms are dealt to blocks of about ``block`` and every two blocks meet in one equi-join key, so the pairs, which are
    the result, are made by many tasks and nothing is listed in one place.
    """
    blocks = F.lit(max(1, -(-atoms.count() // block)))
    dealt = atoms.select("layer", "key", F.pmod(F.xxhash64("key"), blocks).alias("own"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other"))
    low = dealt.select(F.col("own").alias("i"), F.col("other").cast("long").alias("j"), F.col("layer").alias("la"), F.col("key").alias("ka"))
    high = dealt.select(F.col("other").cast("long").alias("i"), F.col("own").alias("j"), F.col("layer").alias("lb"), F.col("key").alias("kb"))
    return low.join(high, ["i", "j"]).filter("la < lb").select("ka", "kb")
