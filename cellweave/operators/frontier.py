"""Connected cells and cheapest ways for all windows at once.

Costs are whole micro-units (BIGINT), so sums do not depend on their order and ties are exact. Equal costs
take the parent with the smallest (row, col).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from math import gcd

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellweave.operators.grids import neighbours8, spread
from cellweave.session import cut_lineage

MICRO = 1_000_000


NONE = "CAST(NULL AS BIGINT)"


@dataclass(frozen=True)
class Moves:
    """Allowed steps. A cell's best offer is one BIGINT, ``cost * 32 + code of the parent's direction``; codes follow the
    (row, col) order of the parents, so the smaller number is the cheaper offer and, at equal cost, the smaller parent."""

    offsets: tuple[tuple[int, int], ...]

    @property
    def lengths(self) -> list[float]:
        return sorted({(dy * dy + dx * dx) ** 0.5 for dy, dx in self.offsets})

    @property
    def start_code(self) -> int:
        return len(self.offsets)

    def halves(self) -> list[str]:
        return [f"h{i}" for i in range(len(self.lengths))]

    def sent(self) -> str:
        """The row itself and, where it has just improved, an offer along each allowed step."""
        lengths, codes = self.lengths, {o: i for i, o in enumerate(sorted(self.offsets))}

        def row(dy: int, dx: int, own: bool) -> str:
            cls = lengths.index((dy * dy + dx * dx) ** 0.5) if not own else -1
            fields = [f"'row', row + {dy}", f"'col', col + {dx}", f"'moves', {'moves' if own else NONE}", f"'own', {'best' if own else NONE}"]
            for i in range(len(lengths)):
                fields.append(f"'h{i}', {f'h{i}' if own else NONE}")
            for i in range(len(lengths)):
                value = f"(best DIV 32 + h{i}) * 32 + {codes[(-dy, -dx)]}" if i == cls else NONE
                fields.append(f"'o{i}', {value}")
            return f"named_struct({', '.join(fields)})"

        me = row(0, 0, True)
        offers = ", ".join(
            f"IF((moves & {1 << codes[(dy, dx)]}L) <> 0, {row(dy, dx, False)}, NULL)" for dy, dx in self.offsets
        )
        return f"explode(IF(changed, array({me}, {offers}), array({me}))) AS _m"

    def best(self) -> str:
        return f"least(own, {', '.join(f'o{i} + h{i} * 32' for i in range(len(self.lengths)))})"


KING = Moves(tuple(neighbours8()))
# sixteen directions: the steps of the king and of the knight
KNIGHT = Moves(tuple(
    (dy, dx) for dy in range(-2, 3) for dx in range(-2, 3) if (dy, dx) != (0, 0) and gcd(abs(dy), abs(dx)) == 1
))


def relax(state: DataFrame, keys: Sequence[str], moves: Moves = KING) -> DataFrame:
    """One round over all windows: a single shuffle by cell, no join.

    Offers meet the row of their cell in one aggregate; cells without a row of their own are not free and
    drop out. The half price of the cell itself is added after the minimum, one minimum per step length.
    """
    half = moves.halves()
    offers = [f"o{i}" for i in range(len(half))]
    met = state.selectExpr(*keys, moves.sent()).filter("_m IS NOT NULL").selectExpr(*keys, "_m.*").groupBy(*keys, "row", "col").agg(
        *[F.expr(f"max({c}) AS {c}") for c in ("moves", "own", *half)], *[F.expr(f"min({c}) AS {c}") for c in offers]
    )
    best = moves.best()
    return met.filter("moves IS NOT NULL").selectExpr(
        *keys, "row", "col", "moves", *half, f"{best} AS best",
        f"coalesce({best} DIV 32 < own DIV 32, own IS NULL AND {best} IS NOT NULL) AS changed",
    )


BLOCK = 256  # cells along a side of what one task settles at a time
PAD = 8  # blocks begin so many cells before 0, so windows that begin there touch no edge of a block
EDGE = 2  # the longest step
STACK = 1 << 17  # cells gathered before small blocks are settled
GRID_CELLS = 1 << 21  # places of the grid of small blocks that are settled in one call
CAP_M = 8  # clearance beyond which the price of a cell no longer falls
FAR = 1 << 60  # squared gap of a column without a cell of another class; cost of a cell not reached


def _block(of: str) -> Column:
    return F.floor((F.col(of) + PAD) / BLOCK)


def _by_block(cells: DataFrame, keys: Sequence[str]):
    return cells.groupBy(*keys, _block("row").alias("_br"), _block("col").alias("_bc"))


def _near_blocks(cells: DataFrame, keys: Sequence[str], reach: int):
    """Blocks with the cells up to ``reach`` round them; ``_br`` and ``_bc`` tell which cells are the block's own."""
    for at, name in (("row", "_br"), ("col", "_bc")):
        low, high = ((F.floor((F.col(at) + PAD + d) / BLOCK)) for d in (-reach, reach))
        cells = cells.withColumn(name, F.explode(F.sequence(low, high)))
    return cells


def _stacked(cells: DataFrame, keys: Sequence[str], run: Callable[[pa.Table, np.ndarray], pa.Table], schema: str) -> DataFrame:
    """``run`` over the blocks of ``cells`` (with ``_br`` and ``_bc``), many small ones in one call.

    It gets whole blocks and what to add to each row number so that they lie one below the other, ``CAP_M`` rows apart:
    no step and no price reaches another block. A call takes blocks of one column only, and a grid of ``GRID_CELLS`` or one
    block.
    """
    at = [*keys, "_br", "_bc"]

    def heads(rows: pa.Table) -> np.ndarray:
        new = np.arange(rows.num_rows) == 0
        for c in at:
            codes = rows.column(c).combine_chunks().dictionary_encode("encode").indices.to_numpy()
            new[1:] |= codes[1:] != codes[:-1]
        return np.flatnonzero(new)

    def called(rows: pa.Table, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
        row, ends = _numbers(rows, "row"), np.append(starts[1:], rows.num_rows)
        low, high = np.minimum.reduceat(row, starts), np.maximum.reduceat(row, starts)
        tall = high - low + 1 + CAP_M
        part = np.cumsum(tall * (BLOCK + 2 * CAP_M)) // GRID_CELLS
        across = _numbers(rows, "_bc")[starts]
        first = np.flatnonzero(np.append(True, (part[1:] != part[:-1]) | (across[1:] != across[:-1])))
        for i, j in zip(first, np.append(first[1:], len(starts))):
            shift = np.repeat(np.cumsum(tall[i:j]) - tall[i:j] - low[i:j], ends[i:j] - starts[i:j])
            yield from run(rows.slice(int(starts[i]), len(shift)), shift).to_batches()

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.RecordBatch] = []
        for batch in batches:
            kept.append(batch)
            if sum(b.num_rows for b in kept) < STACK:
                continue
            rows = pa.Table.from_batches(kept)
            starts = heads(rows)
            if len(starts) > 1:
                yield from called(rows.slice(0, int(starts[-1])), starts[:-1])
                kept = rows.slice(int(starts[-1])).to_batches()
        rows = pa.Table.from_batches(kept) if kept else None
        if rows is not None and rows.num_rows:
            yield from called(rows, heads(rows))

    return cells.repartition(*at).sortWithinPartitions(*at).mapInArrow(each, schema)


def _numbers(rows: pa.Table, name: str, null: int = FAR) -> np.ndarray:
    return pc.fill_null(pc.cast(rows.column(name), pa.int64()), null).to_numpy()


def _with(rows: pa.Table, **columns: np.ndarray) -> pa.Table:
    """The table with columns set; those of whole numbers hold null where they are ``FAR``."""
    for name, values in columns.items():
        array = pa.array(values, mask=values == FAR) if values.dtype == np.int64 else pa.array(values)
        at = rows.schema.get_field_index(name)
        rows = rows.append_column(name, array) if at < 0 else rows.set_column(at, name, array)
    return rows


class _Grid:
    """Flat numbers of the cells of one block, with a rim of absent cells ``EDGE`` wide."""

    def __init__(self, row: np.ndarray, col: np.ndarray):
        self.top, self.left = int(row.min()) - EDGE, int(col.min()) - EDGE
        self.width, self.height = int(col.max()) - self.left + EDGE + 1, int(row.max()) - self.top + EDGE + 1

    def number(self, row: np.ndarray, col: np.ndarray) -> np.ndarray:
        return (row - self.top) * self.width + col - self.left

    def table(self, cell: np.ndarray, values, empty=0, dtype=np.int64) -> np.ndarray:
        out = np.full(self.width * self.height, empty, dtype)
        out[cell] = values
        return out


def _at_edge(at: np.ndarray, block: int, rim: int = EDGE) -> np.ndarray:
    return ((at + PAD) % block < rim) | ((at + PAD) % block >= block - rim)


def _settle(row, col, steps, half, best, changed, offsets: tuple[tuple[int, int], ...], block: int, shift=0) -> tuple[np.ndarray, np.ndarray]:
    """Relax the cells of one block of one window until nothing inside it changes: their best offers, and their marks.

    Only cells that improved in the last step send offers, all directions at once. Cells near the block's edge that
    improved keep the mark ``changed``, because cells of other blocks may gain from them. ``shift`` is what was added to
    the rows of stacked blocks.
    """
    order = sorted(offsets)
    lengths = sorted({(dy * dy + dx * dx) ** 0.5 for dy, dx in offsets})
    rim = max(max(abs(dy), abs(dx)) for dy, dx in offsets)
    grid = _Grid(row, col)
    cell = grid.number(row, col)
    present = grid.table(cell, True, False, bool)
    now, allowed = grid.table(cell, best, FAR), grid.table(cell, steps)
    price = np.stack([grid.table(cell, h) for h in half])
    jump = np.array([dy * grid.width + dx for dy, dx in order])
    kind = np.array([lengths.index((dy * dy + dx * dx) ** 0.5) for dy, dx in order])
    code = np.array([order.index((-dy, -dx)) for dy, dx in order])
    front = np.unique(cell[changed])
    while len(front):
        to = front[:, None] + jump
        cost = (now[front] // 32)[:, None] + price[kind, front[:, None]] + price[kind, to]
        open_ = ((allowed[front][:, None] >> np.arange(len(order))) & 1).astype(bool) & present[to]
        to, offer = to[open_], (cost * 32 + code)[open_]
        old = now[to] // 32
        np.minimum.at(now, to, offer)
        front = np.unique(to[now[to] // 32 < old])
    edge = _at_edge(row - shift, block, rim) | _at_edge(col, block, rim)
    return now[cell], edge & ((now[cell] // 32 < best // 32) | changed)


def _marked(row, col, own: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """Which of the rows ``own`` lie at the place of one of the rows ``marks``."""
    grid = _Grid(row, col)
    cell = grid.number(row, col)
    return grid.table(cell[marks], True, False, bool)[cell[own]]


def _starts(starts: DataFrame, cells: DataFrame, keys: Sequence[str], margin: int = 0) -> DataFrame:
    """Start places with the key and place types of ``cells``."""
    kind = lambda c: cells.schema[c].dataType
    return starts.dropna(subset=list(keys)).select(
        *[F.col(k).cast(kind(k)).alias(k) for k in keys],
        *[(F.col(f"s{c}") + margin).cast(kind(c)).alias(c) for c in ("row", "col")],
    )


def _fields(df: DataFrame, names: Sequence[str]) -> str:
    return ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in names)


def _state(cells: DataFrame, keys: Sequence[str], half: Sequence[str]) -> str:
    return _fields(cells, [*keys, "row", "col"]) + ", moves bigint, " + "".join(f"{h} bigint, " for h in half) + "best bigint, changed boolean"


def cheapest_field(cells: DataFrame, starts: DataFrame, keys: Sequence[str], price: str = "1.0D", moves: Moves = KING) -> DataFrame:
    """Cheapest cost from the start of every window to each of its free cells, with parents.

    ``cells``: keys, row, col of the free cells and, if some steps are barred, a bit mask ``moves``; ``starts``: keys,
    srow, scol. A step costs the mean price of both cells times its length.

    Windows are cut into blocks of ``BLOCK`` x ``BLOCK`` cells, the bound of what a task holds. A round settles every
    block by itself and then sends the offers that cross a block's edge, as one aggregate by cell. So a window within
    one block takes one shuffle, and larger ones a few rounds per block on the way. Costs only fall, so it ends.
    Starts travel as rows of their own, told by their missing ``moves``.
    """
    every = f"{(1 << len(moves.offsets)) - 1}L"
    half = moves.halves()
    rows = cells.selectExpr(
        *keys, "row", "col", f"CAST({'moves' if 'moves' in cells.columns else every} AS BIGINT) AS moves",
        *[f"CAST(round({price} * {MICRO / 2 * n}D) AS BIGINT) AS {h}" for h, n in zip(half, moves.lengths)],
    ).unionByName(_starts(starts, cells, keys), allowMissingColumns=True)
    offsets, code, block, names = moves.offsets, moves.start_code, BLOCK, [*keys, "row", "col", "moves", *half]

    def first(rows: pa.Table, shift: np.ndarray) -> pa.Table:
        row, col = _numbers(rows, "row") + shift, _numbers(rows, "col")
        free = rows.column("moves").is_valid().to_numpy()
        own = rows.select(names).filter(pa.array(free))
        if not own.num_rows:
            return _with(own, best=np.zeros(0, np.int64), changed=np.zeros(0, bool))
        begin = _marked(row, col, free, ~free)
        at = row[free], col[free], _numbers(own, "moves"), [_numbers(own, h) for h in half]
        best, changed = _settle(*at, np.where(begin, code, FAR), begin, offsets, block, shift[free])
        return _with(own, best=best, changed=changed)

    blocks = rows.withColumns({"_br": _block("row"), "_bc": _block("col")})
    return _cheapest(cut_lineage(_stacked(blocks, keys, first, _state(cells, keys, half))), keys, moves)


def _cheapest(settled: DataFrame, keys: Sequence[str], moves: Moves) -> DataFrame:
    """Rounds over blocks until none has an offer for another; ``settled`` is a written table."""
    half, offsets, block = moves.halves(), moves.offsets, BLOCK
    names = [*keys, *settled.columns[len(keys):]]

    def again(rows: pa.Table) -> pa.Table:
        rows = rows.select(names)
        at = _numbers(rows, "row"), _numbers(rows, "col"), _numbers(rows, "moves"), [_numbers(rows, h) for h in half]
        best, changed = _settle(*at, _numbers(rows, "best"), rows.column("changed").to_numpy(), offsets, block)
        return _with(rows, best=best, changed=changed)

    while not settled.filter("changed").isEmpty():
        wide = settled.groupBy(*keys).agg(
            ((F.min(_block("row")) < F.max(_block("row"))) | (F.min(_block("col")) < F.max(_block("col")))).alias("wide"))
        if wide.filter("wide").isEmpty():  # every window lies in one block
            break
        written = cut_lineage(relax(settled, keys, moves), settled)
        if written.filter("changed").isEmpty():
            settled = written
            break
        settled = cut_lineage(_by_block(written, keys).applyInArrow(again, written.schema), written)
    pdy, pdx = ([str(o[i]) for o in sorted(moves.offsets)] for i in (0, 1))
    return settled.selectExpr(
        *keys, "row", "col", "best DIV 32 AS cost",
        f"row + try_element_at(array({', '.join(pdy)}), CAST(best % 32 + 1 AS INT)) AS prow",
        f"col + try_element_at(array({', '.join(pdx)}), CAST(best % 32 + 1 AS INT)) AS pcol",
    )


def _clearance(built: np.ndarray) -> np.ndarray:
    """Distance of every cell of a grid to the nearest built one, as far as ``CAP_M``: first along columns, then along rows."""
    wide = np.pad(np.where(built, 0, CAP_M * CAP_M), CAP_M, constant_values=CAP_M * CAP_M)
    height, width = built.shape
    gap = np.minimum.reduce([wide[CAP_M + d:CAP_M + d + height] + d * d for d in range(1 - CAP_M, CAP_M)])
    square = np.minimum.reduce([gap[:, CAP_M + d:CAP_M + d + width] + d * d for d in range(1 - CAP_M, CAP_M)])
    return np.sqrt(np.minimum(square, CAP_M * CAP_M).astype(np.float64))


def walking_field(ground: DataFrame, starts: DataFrame, keys: Sequence[str], margin: int = 0) -> DataFrame:
    """Walking field over free ground, priced by its clearance to buildings: costs and parents as :func:`cheapest_field`.

    ``ground``: keys, row, col, ``built`` (0 or 1), counted from the window's corner; with a halo of ``margin`` cells
    rows and columns begin at ``-margin``, and ways may leave the window. Ground without a cell is closed.

    No price looks further than ``CAP_M`` cells (:func:`walking_price`), so a block with the ground that far round it
    is priced and settled in one go, after one shuffle.
    """
    moves, block = KING, BLOCK
    half, offsets, code = moves.halves(), moves.offsets, moves.start_code
    scale, every, names = [MICRO / 2 * n for n in moves.lengths], (1 << len(moves.offsets)) - 1, [*keys, "row", "col"]
    # blocks count from the corner of the halo, so that a window within one block stays in it
    moved = ground.filter("built IS NOT NULL").select(*keys, *[(F.col(c) + margin).cast(ground.schema[c].dataType).alias(c) for c in ("row", "col")],
                          F.expr("CAST(built <=> 1 AS INT)").alias("built"))
    rows = moved.unionByName(_starts(starts, ground, keys, margin), allowMissingColumns=True)

    def first(rows: pa.Table, shift: np.ndarray) -> pa.Table:
        row, col, built = _numbers(rows, "row"), _numbers(rows, "col"), _numbers(rows, "built", -1)
        own = (np.floor_divide(row + PAD, block) == _numbers(rows, "_br")) & (np.floor_divide(col + PAD, block) == _numbers(rows, "_bc"))
        free = own & (built == 0)
        out = rows.select(names).filter(pa.array(free))
        if not out.num_rows:
            none = np.zeros(0, np.int64)
            return _with(out, moves=none, **{h: none for h in half}, best=none, changed=np.zeros(0, bool))
        row = row + shift
        grid = _Grid(row, col)
        walls = grid.table(grid.number(row, col)[built == 1], True, False, bool).reshape(grid.height, grid.width)
        near = 1 - _clearance(walls).ravel()[grid.number(row[free], col[free])] / CAP_M
        price = 1 + 4.0 * near * near
        prices = [np.floor(price * n + 0.5).astype(np.int64) for n in scale]  # rounds as SQL does
        begin = _marked(row, col, free, built == -1)
        steps = np.full(len(price), every)
        best, changed = _settle(row[free], col[free], steps, prices, np.where(begin, code, FAR), begin, offsets, block, shift[free])
        return _with(out, moves=steps, **dict(zip(half, prices)), best=best, changed=changed)

    priced = _stacked(_near_blocks(rows, keys, CAP_M), keys, first, _state(moved, keys, half))
    found = _cheapest(cut_lineage(priced), keys, moves)
    return found.select(*keys, *[(F.col(c) - margin).alias(c) for c in ("row", "col")], "cost", *[(F.col(c) - margin).alias(c) for c in ("prow", "pcol")])


def clear_moves(cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Free cells with the mask of the sixteen steps that cut no corner: the cells between must be free as well.

    Every block sees the cells ``EDGE`` round it, so no cell is sent to its neighbours.
    """
    block, names = BLOCK, [*keys, "row", "col"]
    needs = []
    for dy, dx in sorted(KNIGHT.offsets):
        sy, sx = (dy > 0) - (dy < 0), (dx > 0) - (dx < 0)
        need = {(dy, dx)}
        if abs(dy) + abs(dx) == 3:
            need |= {(sy if abs(dy) == 2 else 0, sx if abs(dx) == 2 else 0), (sy, sx)}
        elif abs(dy) + abs(dx) == 2:
            need |= {(0, dx), (dy, 0)}
        needs.append(sorted(need))

    def masks(rows: pa.Table, shift: np.ndarray) -> pa.Table:
        row, col = _numbers(rows, "row"), _numbers(rows, "col")
        own = (np.floor_divide(row + PAD, block) == _numbers(rows, "_br")) & (np.floor_divide(col + PAD, block) == _numbers(rows, "_bc"))
        row = row + shift
        grid = _Grid(row, col)
        cell = grid.number(row, col)
        free = grid.table(cell, True, False, bool)
        mask = np.zeros(int(own.sum()), np.int64)
        for i, need in enumerate(needs):
            mask |= np.logical_and.reduce([free[cell[own] + dy * grid.width + dx] for dy, dx in need]).astype(np.int64) << i
        return _with(rows.select(names).filter(pa.array(own)), moves=mask)

    return _stacked(_near_blocks(cells.select(*names).distinct(), keys, EDGE), keys, masks, _fields(cells, names) + ", moves bigint")


def _parents(rows: pa.Table) -> tuple[np.ndarray, ...]:
    """Of the cells of one block: place, place of the parent, whether there is none, and the parent's number here (own, if not here)."""
    row, col = _numbers(rows, "row"), _numbers(rows, "col")
    home = ~rows.column("prow").is_valid().to_numpy()
    up, left = np.where(home, row, _numbers(rows, "prow")), np.where(home, col, _numbers(rows, "pcol"))
    grid = _Grid(row, col)
    number = grid.table(grid.number(row, col), np.arange(len(row)), -1)
    known = (up >= grid.top) & (up < grid.top + grid.height) & (left >= grid.left) & (left < grid.left + grid.width)
    to = np.where(known, number[np.where(known, grid.number(up, left), 0)], -1)
    return row, col, up, left, home, np.where(to < 0, np.arange(len(row)), to)


def _exits(rows: pa.Table) -> tuple[np.ndarray, ...]:
    """Of the cells of one block: where their way leaves it (or ends), steps and metres until there, and whether it ends."""
    row, col, up, left, home, to = _parents(rows)
    hop = np.sqrt(((row - up) ** 2 + (col - left) ** 2).astype(np.float64))
    last = to == np.arange(len(to))
    metres, steps = np.where(last, 0.0, hop), np.where(last, 0, 1)
    while not last[to].all():
        metres, steps, to = metres + metres[to], steps + steps[to], to[to]
    return up[to], left[to], steps + ~home[to], metres + hop[to], home[to]


def walked_metres(field: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Real metres along the tree of parents: first to where a way leaves its block, then by pointer doubling over blocks."""
    me = [*keys, "row", "col"]

    def within(rows: pa.Table, shift: np.ndarray) -> pa.Table:
        up = _numbers(rows, "prow")
        jr, jc, _, metres, home = _exits(_with(rows, row=_numbers(rows, "row") + shift, prow=np.where(up == FAR, FAR, up + shift)))
        return _with(rows.select(me), jr=jr - shift, jc=jc, m=metres, home=home)

    reached = field.filter("cost IS NOT NULL").select(*me, "prow", "pcol")
    blocks = reached.withColumns({"_br": _block("row"), "_bc": _block("col")})
    tree = cut_lineage(_stacked(blocks, keys, within, _fields(field, me) + ", jr bigint, jc bigint, m double, home boolean"))
    while True:
        if tree.filter("NOT home").isEmpty():
            return tree.select(*me, F.round("m", 6).alias("metres"))
        up = tree.selectExpr(*keys, "row AS jr", "col AS jc", "m AS _m", "jr AS _r", "jc AS _c", "home AS _h")
        further = tree.join(up, [*keys, "jr", "jc"]).selectExpr(
            *me, "IF(home, jr, _r) AS jr", "IF(home, jc, _c) AS jc", "IF(home, m, m + _m) AS m", "home OR _h AS home"
        )
        tree = cut_lineage(further, tree)


def way_back(field: DataFrame, goals: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Cells from the goal to the start with their position (goal first), for every reached goal.

    A way is followed inside the goal's block. Where ways go on, the cells at which they enter further blocks are found
    by doubling over the blocks, and are then followed in all blocks at once.
    """
    me, block = [*keys, "row", "col"], BLOCK
    reached = field.filter("cost IS NOT NULL").select(*me, "prow", "pcol")
    kind = lambda c: field.schema[c].dataType

    def follow(rows: pa.Table) -> pa.Table:
        asked = rows.column("pos").is_valid().to_numpy()
        cells, marks = rows.filter(pa.array(~asked)), rows.filter(pa.array(asked))
        found = [np.zeros((0, 4), np.int64)]
        if cells.num_rows and marks.num_rows:
            row, col, up, left, home, to = _parents(cells)
            grid = _Grid(_numbers(rows, "row"), _numbers(rows, "col"))
            at = grid.table(grid.number(row, col), np.arange(len(row)), -1)[grid.number(_numbers(marks, "row"), _numbers(marks, "col"))]
            pos, at = _numbers(marks, "pos")[at >= 0], at[at >= 0]
            while len(at):
                found.append(np.column_stack([row[at], col[at], pos, np.zeros(len(at), np.int64)]))
                leaves = (to[at] == at) & ~home[at]
                found.append(np.column_stack([up[at], left[at], pos + 1, np.ones(len(at), np.int64)])[leaves])
                on = to[at] != at
                at, pos = to[at][on], pos[on] + 1
        cells_on = np.concatenate(found)
        out = rows.select(list(keys)).take(pa.array(np.zeros(len(cells_on), np.int64)))
        for c, values in zip(("row", "col"), cells_on.T):
            out = out.append_column(c, pa.array(values).cast(rows.schema.field(c).type))
        return out.append_column("pos", pa.array(cells_on[:, 2])).append_column("out", pa.array(cells_on[:, 3] == 1))

    def followed(marks: DataFrame) -> DataFrame:
        rows = reached.unionByName(marks.select(*[F.col(c).cast(kind(c)).alias(c) for c in me], "pos"), allowMissingColumns=True)
        return cut_lineage(_by_block(rows, keys).applyInArrow(follow, _fields(field, me) + ", pos bigint, out boolean"))

    def edges(rows: pa.Table) -> pa.Table:
        jr, jc, steps, _, home = _exits(rows)
        row, col = _numbers(rows, "row"), _numbers(rows, "col")
        kept = pa.array((_at_edge(row, block) | _at_edge(col, block)) & ~home)
        return _with(rows.select(me), jr=jr, jc=jc, n=steps).filter(kept)

    asked = goals.dropna(subset=list(keys)).select(*keys, F.col("grow").alias("row"), F.col("gcol").alias("col"), F.lit(0).cast("bigint").alias("pos"))
    first = followed(asked)
    ways, entered = first.filter("NOT out").drop("out"), first.filter("out").drop("out")
    if entered.isEmpty():
        return ways
    jump = cut_lineage(_by_block(reached, keys).applyInArrow(edges, _fields(field, me) + ", jr bigint, jc bigint, n bigint"))
    entered = cut_lineage(entered)
    while True:
        more = entered.join(jump, me).selectExpr(*keys, "jr AS row", "jc AS col", "pos + n AS pos")
        if more.isEmpty():
            break
        entered = cut_lineage(entered.unionByName(more), entered)
        far = jump.selectExpr(*keys, "row AS jr", "col AS jc", "jr AS _r", "jc AS _c", "n AS _n")
        jump = cut_lineage(jump.join(far, [*keys, "jr", "jc"]).selectExpr(*me, "_r AS jr", "_c AS jc", "n + _n AS n"), jump)
    return ways.unionByName(followed(entered).filter("NOT out").drop("out"))


def lit_with_markers(cells: DataFrame, walks: DataFrame, keys: Sequence[str], side: int) -> DataFrame:
    """Lit cells, and the 3 x 3 cells round both markers of each window."""
    ends = F.array(F.struct(F.col("srow").alias("r"), F.col("scol").alias("c")), F.struct(F.col("grow").alias("r"), F.col("gcol").alias("c")))
    around = F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy in (-1, 0, 1) for dx in (-1, 0, 1)])
    near = walks.select(*keys, F.explode(ends).alias("m")).withColumn("o", F.explode(around)).select(
        *keys, (F.col("m.r") + F.col("o.dy")).alias("row"), (F.col("m.c") + F.col("o.dx")).alias("col")
    ).filter(f"row >= 0 AND row < {side} AND col >= 0 AND col < {side}")
    return cells.select(*keys, "row", "col").unionByName(near).distinct()


def shortest_chain(cells: DataFrame, walks: DataFrame, keys: Sequence[str], side: int, cell_m: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """Shortest 8-neighbour chain through lit cells: ``(chain cells with pos, goal first)`` and ``(keys, length_m)``.

    Windows whose markers are not connected are absent from both.
    """
    lit = lit_with_markers(cells, walks, keys, side)
    field = cheapest_field(lit, walks, keys)
    goals = walks.select(*keys, "grow", "gcol")
    length = field.join(
        goals.withColumnsRenamed({"grow": "row", "gcol": "col"}), [*keys, "row", "col"]
    ).filter("cost IS NOT NULL").select(*keys, (F.col("cost") * (cell_m / MICRO)).alias("length_m"))
    return way_back(field, goals, keys), length


def row_runs(cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Unbroken runs of cells per row ``(keys, row, c0, c1)``; a group is one row of one window."""
    w = Window.partitionBy(*keys, "row").orderBy("col")
    marked = cells.select(*keys, "row", "col", (F.col("col") - F.row_number().over(w)).alias("_g"))
    return marked.groupBy(*keys, "row", "_g").agg(F.min("col").alias("c0"), F.max("col").alias("c1")).drop("_g")


def label_runs(cells: DataFrame, keys: Sequence[str], diagonal: bool, side: int) -> DataFrame:
    """Connected components as runs ``(keys, row, c0, c1, label)``; the label is the smallest row * side + col inside.

    Rows are packed into runs first, so the graph has runs for nodes. Each round takes the smallest label among
    touching runs and then jumps to the label of that label, which shortens long chains by halves.
    """
    reach = 1 if diagonal else 0
    runs = row_runs(cells, keys).withColumn("id", F.col("row").cast("bigint") * side + F.col("c0"))
    runs = cut_lineage(runs)
    # a run is named in every 32-column stretch it reaches into, so touching runs meet in an equi-join
    stretch = runs.withColumn("_s", F.explode(F.expr(f"sequence((c0 - {reach}) DIV 32, (c1 + {reach}) DIV 32)")))
    below = stretch.select(*keys, (F.col("row") - 1).alias("row"), "_s", F.col("id").alias("_j"), F.col("c0").alias("_a"), F.col("c1").alias("_b"))
    touch = stretch.join(below, [*keys, "row", "_s"]).filter(f"_a <= c1 + {reach} AND _b >= c0 - {reach}").select(*keys, "id", "_j").distinct()
    edges = cut_lineage(touch.unionByName(touch.select(*keys, F.col("_j").alias("id"), F.col("id").alias("_j"))))
    return runs.join(_merged(runs.select(*keys, "id"), edges, keys), [*keys, "id"]).drop("id")


def _merged(nodes: DataFrame, edges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Smallest id each node ``(keys, id)`` reaches along ``edges`` ``(keys, id, _j)``, which lead both ways."""
    labels = nodes.select(*keys, "id", F.col("id").alias("label"))
    low = None
    while True:
        ends = edges.join(labels.selectExpr(*keys, "id AS _j", "label").hint("merge"), [*keys, "_j"]).join(
            labels.selectExpr(*keys, "id", "label AS mine").hint("merge"), [*keys, "id"]
        ).filter("label < mine")
        # the lower label goes to the node itself and to the node its group is named after
        offers = ends.selectExpr(*keys, "explode(array(id, mine)) AS id", "label")
        found = labels.selectExpr(*keys, "id", "label", "label AS old").union(
            offers.selectExpr(*keys, "id", "label", "CAST(NULL AS BIGINT) AS old")
        ).groupBy(*keys, "id").agg(F.expr("min(label) AS label"), F.expr("max(old) AS old"))
        low = cut_lineage(found, low)
        if low.filter("label <> old").isEmpty():
            return low.drop("old")
        jump = low.selectExpr(*keys, "id AS label", "label AS _l")
        labels = low.join(jump.hint("merge"), [*keys, "label"]).selectExpr(*keys, "id", "_l AS label")


def _labelled(row: np.ndarray, col: np.ndarray, ids: np.ndarray, offsets: Sequence[tuple[int, int]]) -> np.ndarray:
    """Smallest id of the component of each cell of one block: the least of the neighbours', then that of the cell it names."""
    grid = _Grid(row, col)
    cell = grid.number(row, col)
    known, rank = np.unique(ids, return_inverse=True)
    place = np.zeros(len(known), np.int64)
    place[rank] = cell
    label = grid.table(cell, rank, FAR)
    while True:
        least = np.minimum.reduce([label[cell], *[label[cell + dy * grid.width + dx] for dy, dx in offsets]])
        low = label.copy()
        np.minimum.at(low, place[label[cell]], least)  # the cell a group is named after learns it, too
        low[cell] = np.minimum(low[cell], least)
        low[cell] = low[place[low[cell]]]
        if (low == label).all():
            return known[label[cell]]
        label = low


def label_cells(cells: DataFrame, keys: Sequence[str], diagonal: bool, side: int) -> DataFrame:
    """Connected components of cells ``(keys, row, col, label)``; the label is the smallest row * side + col inside.

    Every block is labelled by itself after one shuffle. Where windows have several blocks, the parts that touch across
    their edges are merged; only cells at edges are joined for that.
    """
    offsets = [o for o in neighbours8() if diagonal or 0 in o]
    names, block = [*keys, "row", "col"], BLOCK

    def within(rows: pa.Table) -> pa.Table:
        row, col = _numbers(rows, "row"), _numbers(rows, "col")
        edge = _at_edge(row, block, 1) | _at_edge(col, block, 1)
        return _with(rows.select(names), label=_labelled(row, col, row * side + col, offsets), edge=edge)

    parts = cut_lineage(_by_block(cells.select(*names), keys).applyInArrow(within, _fields(cells, names) + ", label bigint, edge boolean"))
    rim = parts.filter("edge").select(*names, "label")
    wide = rim.groupBy(*keys).agg(((F.min(_block("row")) < F.max(_block("row"))) | (F.min(_block("col")) < F.max(_block("col")))).alias("wide"))
    if wide.filter("wide").isEmpty():
        return parts.drop("edge")
    beside = spread(rim.withColumnRenamed("label", "_j"), offsets)
    touch = rim.join(beside.drop("_o").hint("merge"), names).filter("label <> _j").select(*keys, F.col("label").alias("id"), "_j").distinct()
    merged = _merged(parts.select(*keys, F.col("label").alias("id")).distinct(), cut_lineage(touch), keys)
    return parts.drop("edge").withColumnRenamed("label", "id").join(merged.hint("merge"), [*keys, "id"]).select(*names, "label")


ROW_BLOCK = 64


def lower_envelope(gaps: np.ndarray) -> np.ndarray:
    """min over j of (i - j)^2 + gaps[r, j] for every row r and column i.

    The best j never falls as i grows, so columns are settled at half the stride each time, each between the best of
    its two neighbours: all rows together look at about width x log2(width) places, whatever the distances.
    """
    height, width = gaps.shape
    best, value = np.zeros((height, width), np.int64), np.zeros((height, width), np.int64)
    stride = 1 << (width - 1).bit_length()
    while stride:
        cols = np.arange(stride - 1, width, 2 * stride)
        if len(cols):
            low = np.where(cols >= stride, best[:, np.maximum(cols - stride, 0)], 0).ravel()
            high = np.where(cols + stride < width, best[:, np.minimum(cols + stride, width - 1)], width - 1).ravel()
            size = high - low + 1
            ends = np.cumsum(size)
            at = np.arange(ends[-1]) - np.repeat(ends - size - low, size)
            place = np.repeat(np.arange(len(size)), size)
            cost = (cols[place % len(cols)] - at) ** 2 + gaps[place // len(cols), at]
            least = np.minimum.reduceat(cost, ends - size)
            first = np.flatnonzero(cost == least[place])
            owner, where = np.unique(place[first], return_index=True)
            best[:, cols] = at[first[where]].reshape(height, -1)
            value[:, cols] = least.reshape(height, -1)
        stride >>= 1
    return value


def distance_to_other(cells: DataFrame, keys: Sequence[str], value: str, classes: Sequence[int]) -> DataFrame:
    """Exact Euclidean distance of every cell to the nearest cell of another class; null when there is none.

    Columns first: per class the nearest row of another class, by two running scans. Then the lower envelope along
    each row, for ``ROW_BLOCK`` rows of a raster in one task. No cell is multiplied.
    """
    up = Window.partitionBy(*keys, "col").orderBy("row").rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy(*keys, "col").orderBy("row").rowsBetween(0, Window.unboundedFollowing)
    gaps = []
    for c in classes:
        other = F.when(F.col(value) != c, F.col("row"))
        above, below = F.last(other, ignorenulls=True).over(up), F.first(other, ignorenulls=True).over(down)
        gaps.append(F.least(F.col("row") - above, below - F.col("row")).cast("bigint"))
    at = cells.select(*keys, "row", "col", value, F.array(*gaps).alias("_g"), F.floor(F.col("row") / ROW_BLOCK).alias("_b"))
    known = list(classes)

    def along_rows(rows: pa.Table) -> pa.Table:
        row, col, own = (rows.column(c).to_numpy() for c in ("row", "col", value))
        row, col = row - row.min(), col - col.min()
        gap = pc.fill_null(pc.list_flatten(rows.column("_g")), -1).to_numpy().reshape(-1, len(known))
        squares = np.full(len(row), FAR)
        for i, c in enumerate(known):
            mine = own == c
            if mine.any():
                grid = np.full((int(row.max()) + 1, int(col.max()) + 1), FAR)
                grid[row, col] = np.where(gap[:, i] < 0, FAR, gap[:, i] ** 2)
                squares[mine] = lower_envelope(grid)[row[mine], col[mine]]
        dist = pa.array(np.sqrt(squares.astype(np.float64)), mask=squares >= FAR)
        return rows.select([*keys, "row", "col", value]).append_column("dist", dist)

    schema = ", ".join(f"{c} {cells.schema[c].dataType.simpleString()}" for c in (*keys, "row", "col", value))
    return at.groupBy(*keys, "_b").applyInArrow(along_rows, f"{schema}, dist double")


def walking_price(clearance: Column, weight: float = 4.0, cap: float = 8.0) -> Column:
    """Price of a cell: free ground far from walls costs 1, ground along a wall up to 1 + weight."""
    gap = 1 - F.least(clearance, F.lit(cap)) / cap
    return 1 + weight * gap * gap
