"""Interpolated modified Kneser-Ney trigram model in memory-mapped sorted arrays (operator 10)."""

from __future__ import annotations

import mmap
import os
import uuid
from collections import OrderedDict
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweave.llm.common import batch_words, column, per_process, shared_path, slices
from cellweave.session import cut_lineage

END = xxhash.xxh64_intdigest(b"\n</s>") - (1 << 63)  # no word holds a line feed
SLICE = 24 << 20
TRIPLE_SLICE = 8 << 20
SCORE_SLICE = 4 << 20
BLOCK_BITS = 18
MIX = 0x9E3779B97F4A7C15
MAPS = 64  # arrays a worker keeps mapped


def _hashes(words: list[bytes]) -> np.ndarray:
    """Signed XXH64 of each word, shifted so that signed order is the order of the unsigned hash."""
    return (np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words)) ^ np.uint64(1 << 63)).view(np.int64)


HEAD = 16  # bytes before the values of an array: its type


def _save(folder: str, name: str, values: np.ndarray) -> None:
    """Written under another name first, so a lost or repeated task never leaves half a file."""
    os.makedirs(folder, exist_ok=True)
    part = f"{folder}/.{name}.{uuid.uuid4().hex}"
    with open(part, "wb") as f:
        f.write(values.dtype.str.encode().ljust(HEAD))
        f.write(np.ascontiguousarray(values).data)
    os.replace(part, f"{folder}/{name}")


def _narrow(counts: np.ndarray) -> np.ndarray:
    """Counts in the smallest unsigned type that holds them all; nothing is cut off."""
    return counts.astype(np.min_scalar_type(int(counts.max()) if len(counts) else 0))


def _open(folder: str, name: str) -> np.ndarray:
    """One array of the model, mapped in each worker; pages are shared and read on demand.

    The maps least used are let go, so the number of files of a large model does not matter.
    """
    maps: OrderedDict = per_process("kneser-ney maps", OrderedDict)
    path = f"{folder}/{name}"
    if path in maps:
        maps.move_to_end(path)
        return maps[path]
    if not os.path.exists(path):
        values = np.zeros(0, np.int64)
    else:
        with open(path, "rb") as f:
            whole = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        values = np.frombuffer(whole, whole[:HEAD].decode().strip(), offset=HEAD)
    maps[path] = values
    if len(maps) > MAPS:
        maps.popitem(last=False)
    return values


def _save_counts(folder: str, name: str, counts: np.ndarray) -> None:
    """One byte a count; the few from 255 on stand in a list of places and values beside them."""
    large = np.flatnonzero(counts >= 255)
    _save(folder, f"{name}-at", large)
    _save(folder, f"{name}-large", counts[large])
    _save(folder, name, np.minimum(counts, 255).astype(np.uint8))


def _counts(folder: str, name: str, places: np.ndarray) -> np.ndarray:
    out = _open(folder, name)[places].astype(np.int64)
    large = np.flatnonzero(out == 255)
    if len(large):
        out[large] = _open(folder, f"{name}-large")[np.searchsorted(_open(folder, f"{name}-at"), places[large])]
    return out


def _save_rows(folder: str, name: str, rows: np.ndarray) -> None:
    """Rows of counts, most of them alike, as a table of the rows that occur and the place of each in it.

    Rows of counts under 256 are in the table once, the few others each for itself.
    """
    small = (rows < 256).all(1)
    shifts = np.arange(rows.shape[1]) * 8
    known, at = np.unique((rows[small] << shifts).sum(1), return_inverse=True)
    places = np.empty(len(rows), np.int64)
    places[small], places[~small] = at, len(known) + np.arange(len(rows) - small.sum())
    _save(folder, f"{name}-rows", np.concatenate([known[:, None] >> shifts & 255, rows[~small]]).astype("<i8").ravel())
    _save(folder, name, _narrow(places))


def _rows(folder: str, name: str, width: int, places: np.ndarray) -> np.ndarray:
    return _open(folder, f"{name}-rows").reshape(-1, width)[_open(folder, name)[places]]


def _mixed(*ids: np.ndarray) -> np.ndarray:
    """One 64-bit hash of ids, position by position."""
    with np.errstate(over="ignore"):
        h = np.full(len(ids[0]), 0x243F6A8885A308D3, np.uint64)
        for x in ids:
            h = (h ^ x.astype(np.uint64)) * np.uint64(MIX)
            h ^= h >> np.uint64(29)
            h *= np.uint64(0xBF58476D1CE4E5B9)
            h ^= h >> np.uint64(32)
    return h


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order that sorts the keys, and where in it the run of each distinct key starts and ends."""
    order = np.argsort(keys)
    return order, *_runs(keys[order])


def _summed(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys in order, a place of each, and the sums of the rows of ``values`` (rows, columns)."""
    order, starts, _ = _distinct(keys)
    at = order[starts]
    return keys[at], at, np.stack([np.add.reduceat(c[order], starts, dtype=np.int64) for c in values.T], 1) if len(starts) else values[:0]


def _runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of equal values."""
    if not len(values):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    starts = np.concatenate([[0], np.flatnonzero(values[1:] != values[:-1]) + 1])
    return starts, np.append(starts[1:], len(values))


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts for counts 1, 2 and 3 or more, from the counts of counts."""
    if not n1 or not n2:
        return (0.5, 0.75, 0.75)
    y = n1 / (n1 + 2 * n2)
    d1, d2 = 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2
    d3 = 3 - 4 * y * n4 / n3 if n3 else d2
    return tuple(float(min(max(d, 0.05), k)) for d, k in ((d1, 1), (d2, 2), (d3, 3)))


@dataclass
class Model:
    """Where the arrays lie, how they are cut, and the numbers that every task needs."""

    folder: str
    word_bits: int = 0
    offsets: list[int] = field(default_factory=lambda: [0])
    shards: int = 1
    n_words: int = 0
    n_tokens: int = 0
    n_texts: int = 0
    triple_discounts: tuple[float, float, float] = (0.5, 0.75, 0.75)
    pair_discounts: tuple[float, float, float] = (0.5, 0.75, 0.75)
    word_discounts: tuple[float, float, float] = (0.5, 0.75, 0.75)
    n_pairs: int = 0
    rest: float = 1.0

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids (-1: unknown) and counts of words by their hashes. Ids are ranks in the sorted word array."""
        order = np.argsort(hashes)
        asked = hashes[order]
        shard = ((asked >> np.int64(64 - self.word_bits)) + (1 << (self.word_bits - 1))) if self.word_bits else np.zeros(len(asked), np.int64)
        ids, counts = np.full(len(asked), -1, np.int64), np.zeros(len(asked), np.int64)
        for a, b in zip(*_runs(shard)):
            s = int(shard[a])
            known = _open(self.folder, f"words-{s}")
            if not len(known):
                continue
            at = np.minimum(np.searchsorted(known, asked[a:b]), len(known) - 1)
            hit = known[at] == asked[a:b]
            ids[a:b] = np.where(hit, at + self.offsets[s], -1)
            counts[a:b] = np.where(hit, _open(self.folder, f"counts-{s}")[at], 0)
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        return ids[back], counts[back]

    def count_of(self, ids: np.ndarray) -> np.ndarray:
        """Counts of known ids, the start among them."""
        out = np.full(len(ids), self.n_texts, np.int64)
        order = np.argsort(ids, kind="stable")
        shard = np.searchsorted(self.offsets, ids[order], "right") - 1
        for a, b in zip(*_runs(shard)):
            at = order[a:b][ids[order[a:b]] < self.n_words]
            if len(at):
                out[at] = _open(self.folder, f"counts-{int(shard[a])}")[ids[at] - self.offsets[shard[a]]]
        return out

    def pair_shard(self, prev: np.ndarray, this: np.ndarray, prev_count: np.ndarray) -> np.ndarray:
        """Shard of each pair: by its first word, and by parts of the second word if the first one is frequent."""
        part = _mixed(this) % (1 + (prev_count >> 18)).astype(np.uint64)
        return (_mixed(prev, part) % np.uint64(self.shards)).astype(np.int64)

    def triple_shard(self, first: np.ndarray, prev: np.ndarray, this: np.ndarray, first_count: np.ndarray, prev_count: np.ndarray) -> np.ndarray:
        """Shard of each triple: by its middle word, by parts of the first one if the middle one is frequent, and by
        parts of the last one if both are."""
        part = _mixed(first) % (1 + (prev_count >> 18)).astype(np.uint64)
        last = _mixed(this) % (1 + (np.minimum(first_count, prev_count) >> 18)).astype(np.uint64)
        return (_mixed(prev, part, last) % np.uint64(self.shards)).astype(np.int64)

    def sequence(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For all tokens of the texts (words, then one end each): ids of the two before, of itself, counts of all three
        as rows of one array; tokens per text."""
        words, index, n_words = batch_words(texts)
        ids, counts = self.find(np.append(_hashes(words), END))
        index = np.insert(index, np.cumsum(n_words), len(words))
        ids = ids.astype(np.int32 if self.n_words < 2**31 - 1 else np.int64)
        counts = counts.astype(np.uint32 if self.n_tokens < 2**32 - 1 else np.int64)
        n = n_words + 1
        heads = np.cumsum(n) - n
        named, count = [ids[index]], [counts[index]]
        for _ in range(2):
            before, times = np.roll(named[0], 1), np.roll(count[0], 1)
            before[heads], times[heads] = self.n_words, self.n_texts  # the start has the id after the last word
            named.insert(0, before)
            count.insert(0, times)
        return np.stack(named), np.stack(count), n, heads

    def looked_up(self, table: str, width: int, values: Callable[[int, np.ndarray], np.ndarray], keys: np.ndarray, shard: np.ndarray) -> np.ndarray:
        """``values`` (shard, places) of a sorted table at the keys, 0 where it has none."""
        out = np.zeros((len(keys), width), np.int64)
        order = np.argsort(shard, kind="stable")
        for a, b in zip(*_runs(shard[order])):
            at, s = order[a:b], int(shard[order[a]])
            known = _open(self.folder, f"{table}-{s}")
            if len(known):
                where = np.minimum(np.searchsorted(known, keys[at]), len(known) - 1)
                hit = known[where] == keys[at]
                out[at[hit]] = values(s, where[hit])
        return out

    def pairs(self, prev: np.ndarray, this: np.ndarray, prev_count: np.ndarray) -> np.ndarray:
        """For each pair: words before it, then as a context its total and how many words follow it once, twice, more often."""
        keys = _mixed(prev, this)
        order, starts, ends = _distinct(keys)
        at = order[starts]
        out = np.empty((len(keys), PAIR_COLUMNS), np.int64)
        of = lambda s, places: _rows(self.folder, f"pair-counts-{s}", PAIR_COLUMNS, places)
        out[order] = np.repeat(self.looked_up("pairs", PAIR_COLUMNS, of, keys[at], self.pair_shard(prev[at], this[at], prev_count[at])), ends - starts, axis=0)
        return out

    def triples(self, named: np.ndarray, count: np.ndarray) -> np.ndarray:
        of = lambda s, places: _counts(self.folder, f"triple-counts-{s}", places)[:, None]
        return self.looked_up("triples", 1, of, _mixed(*named), self.triple_shard(*named, *count[:2]))[:, 0]

    def block(self, name: str, kind: str, ids: np.ndarray) -> np.ndarray:
        """Values of a dense array (cut into blocks of ids) at known ids."""
        out = np.zeros(len(ids), kind)
        order = np.argsort(ids, kind="stable")
        blocks = ids[order] >> BLOCK_BITS
        for a, b in zip(*_runs(blocks)):
            at = order[a:b]
            values = _open(self.folder, f"{name}-{int(blocks[a])}")
            if len(values):  # a model without texts has no blocks
                out[at] = values[ids[at] & ((1 << BLOCK_BITS) - 1)]
        return out

    def score(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Tokens, known tokens, base and model log10 probability of each text."""
        named, counts, n, heads = self.sequence(texts)
        first, prev, this = named
        count = counts[2]
        base = np.log10((count + 1) / (self.n_tokens + self.n_words + 1))
        chance = np.full(len(this), self.rest / (self.n_words + 1))
        known = np.flatnonzero(this >= 0)
        names, back = np.unique(this[known], return_inverse=True)
        chance[known] += (_discounted(self.block("follows", "<i8", names), self.word_discounts) / max(self.n_pairs, 1))[back]
        linked = np.flatnonzero(prev >= 0)
        names, back = np.unique(prev[linked], return_inverse=True)
        total, share = np.zeros(len(this), np.int64), np.ones(len(this))
        total[linked], share[linked] = self.block("totals", "<i8", names)[back], self.block("shares", "<f8", names)[back]
        chance *= np.where(total > 0, share, 1.0)
        both = np.flatnonzero((prev >= 0) & (this >= 0))
        pairs = np.zeros((len(this) + 1, PAIR_COLUMNS), np.int64)  # the last row is that of the two starts of a text
        pairs[both] = self.pairs(prev[both], this[both], counts[1, both])
        pairs[-1:] = self.pairs(first[heads[:1]], prev[heads[:1]], counts[0, heads[:1]])
        chance[both] += _discounted(pairs[both, 0], self.pair_discounts) / np.maximum(total[both], 1)
        before = np.arange(-1, len(this) - 1)  # a pair is the context of the next token
        before[heads] = len(this)
        wide = np.flatnonzero((first >= 0) & (prev >= 0))
        of = pairs[before[wide]]
        total = of[:, 1]
        chance[wide] *= np.where(total > 0, (of[:, 2:] @ np.array(self.triple_discounts)) / np.maximum(total, 1), 1.0)
        inner = this[wide] >= 0
        every = wide[inner]
        chance[every] += _discounted(self.triples(named[:, every], counts[:, every]), self.triple_discounts) / np.maximum(total[inner], 1)
        return n, np.add.reduceat(count > 0, heads, dtype=np.int64), np.add.reduceat(base, heads), np.add.reduceat(np.log10(chance), heads)


def _discounted(counts: np.ndarray, d: tuple[float, float, float]) -> np.ndarray:
    return np.maximum(counts - np.array([0.0, *d])[np.minimum(counts, 3)], 0.0)


def _sorted_shards(rows: DataFrame, keys: list[str], parts: int) -> DataFrame:
    return rows.repartition(parts, keys[0]).sortWithinPartitions(*keys)


def _grouped(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[int, pa.Table]]:
    """The rows of each key of a stream that is sorted by it."""
    kept: list[pa.RecordBatch] = []
    for batch in batches:
        for a, b in zip(*_runs(column(batch, key).to_numpy())):
            if kept and column(kept[-1], key)[0].as_py() != column(batch, key)[int(a)].as_py():
                yield column(kept[0], key)[0].as_py(), pa.Table.from_batches(kept)
                kept = []
            kept.append(batch.slice(int(a), int(b - a)))
    if kept:
        yield column(kept[0], key)[0].as_py(), pa.Table.from_batches(kept)


def _vocabulary(texts: DataFrame, model: Model, parts: int) -> None:
    """Count all words and ends and write them as sorted hash arrays with their counts."""
    folder = model.folder

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE):
            words, index, n = batch_words(column(batch, "text"))
            counts = np.append(np.bincount(index, minlength=len(words)), len(n)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.append(_hashes(words), END)), pa.array(counts)], ["h", "c"])

    table = cut_lineage(texts.mapInArrow(count, "h long, c long").groupBy("h").agg(F.sum("c").alias("c")))
    model.n_words, model.n_tokens = (int(x or 0) for x in table.agg(F.count("*"), F.sum("c")).first())
    model.n_texts = int(table.filter(F.col("h") == END).agg(F.sum("c")).first()[0] or 0)
    bits = model.word_bits = max(0, (model.n_words >> 19).bit_length())
    shard = F.shiftright("h", 64 - bits) + (1 << (bits - 1)) if bits else F.lit(0).cast("long")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s, rows in _grouped(batches, "shard"):
            _save(folder, f"words-{s}", rows.column("h").to_numpy().astype("<i8"))
            _save(folder, f"counts-{s}", _narrow(rows.column("c").to_numpy()))
            yield pa.RecordBatch.from_arrays([pa.array([s]), pa.array([rows.num_rows])], ["shard", "n"])

    sizes = dict(_sorted_shards(table.withColumn("shard", shard), ["shard", "h"], min(parts, 1 << bits)).mapInArrow(write, "shard long, n long").collect())
    model.offsets = np.cumsum([0, *[sizes.get(s, 0) for s in range(1 << bits)]]).tolist()


PAIR_COLUMNS = 5  # words before a pair, then of what follows it: the total, words that do once, twice and more often


def _packed(shard: np.ndarray, columns: list[np.ndarray]) -> list[tuple[int, bytes]]:
    """(shard, its rows) of equally long columns of ids and counts.

    Each column travels in its smallest type, byte by byte place, compressed: high bytes are all but equal.
    """
    order = np.argsort(shard, kind="stable")
    out, squeeze = [], zstandard.ZstdCompressor(1)
    for a, b in zip(*_runs(shard[order])):
        at = order[a:b]
        narrow = [_narrow(c[at]) for c in columns]
        head = np.array([len(at), *[c.itemsize for c in narrow]], np.int64)
        planes = [np.ascontiguousarray(c.view(np.uint8).reshape(len(at), -1).T).tobytes() for c in narrow]
        out.append((int(shard[at[0]]), squeeze.compress(head.tobytes() + b"".join(planes))))
    return out


def _unpacked(blobs: list[bytes], width: int) -> list[np.ndarray]:
    """The columns that ``_packed`` sent, all pieces after one another."""
    pieces: list[list[np.ndarray]] = [[] for _ in range(width)]
    spread = zstandard.ZstdDecompressor()
    for packed in blobs:
        blob = spread.decompress(packed)
        n, *sizes = np.frombuffer(blob, np.int64, 1 + width).tolist()
        at = 8 * (1 + width)
        for i, size in enumerate(sizes):
            planes = np.frombuffer(blob, np.uint8, n * size, at).reshape(size, n)
            pieces[i].append(np.ascontiguousarray(planes.T).view(f"<u{size}").ravel().astype(np.int64))
            at += n * size
    return [np.concatenate(p) for p in pieces]


def _of_counts(counts: np.ndarray) -> list[int]:
    return [int((counts == k).sum()) for k in (1, 2, 3, 4)]


def _sum_columns(said: DataFrame, key: int, width: int) -> list[int]:
    """Sums of the arrays in the rows of that key, which carry counts of counts."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width, np.int64)
        for batch in batches:
            for b in column(batch, "rows").to_pylist():
                total += np.frombuffer(b, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([int(x)]) for x in total], [f"c{i}" for i in range(width)])

    sums = said.filter(F.col("key") == key).mapInArrow(add, ", ".join(f"c{i} long" for i in range(width)))
    return [int(x or 0) for x in sums.agg(*[F.sum(f"c{i}") for i in range(width)]).first()]


def _sent(rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.int64()), pa.array([b for _, b in rows], pa.binary())], ["key", "rows"])


def _triples(texts: DataFrame, model: Model, parts: int) -> DataFrame:
    """Count all triples, write them as sorted hash arrays, and return what they say of pairs, by shards of pairs.

    A pair (v, w) learns how many words come before it; a pair (u, v) learns its total as a context and how many words
    follow it once, twice and more often.
    """
    folder = model.folder
    model.shards = 1 << max(0, (model.n_tokens >> 20).bit_length())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", TRIPLE_SLICE):
            named, counts, _, _ = model.sequence(column(batch, "text"))
            order, starts, ends = _distinct(_mixed(*named))
            at, n = order[starts], ends - starts
            shard = model.triple_shard(*named[:, at], *counts[:2, at])
            packs = np.argsort((shard << 40) + named[1, at])  # equal neighbours pack well
            yield _sent(_packed(shard[packs], [*named[:, at[packs]], n[packs]]))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s, rows in _grouped(batches, "key"):
            u, v, w, n = _unpacked(rows.column("rows").to_pylist(), 4)
            keys, at, sums = _summed(_mixed(u, v, w), n[:, None])
            u, v, w, n = u[at], v[at], w[at], sums[:, 0]
            _save(folder, f"triples-{s}", keys)
            _save_counts(folder, f"triple-counts-{s}", n)
            one, none = np.ones(len(n), np.int64), np.zeros(len(n), np.int64)
            values = np.concatenate([
                np.stack([one, none, none, none, none], 1), np.stack([none, n, n == 1, n == 2, n > 2], 1).astype(np.int64)])
            a, b = np.concatenate([v, u]), np.concatenate([w, v])
            _, at, values = _summed(_mixed(a, b), values)
            a, b = a[at], b[at]
            order = np.argsort(a, kind="stable")
            a, b, values = a[order], b[order], values[order]
            yield _sent([(-1, np.array(_of_counts(n), np.int64).tobytes()), *_packed(model.pair_shard(a, b, model.count_of(a)), [a, b, *values.T])])

    sent = _sorted_shards(texts.mapInArrow(count, "key long, rows binary"), ["key"], min(4 * parts, model.shards))
    return sent.mapInArrow(merge, "key long, rows binary")


def _pairs(told: DataFrame, model: Model, parts: int) -> DataFrame:
    """Add up what triples say of pairs, write it as sorted hash arrays, and return what pairs say of words, by blocks of ids."""
    folder = model.folder

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s, rows in _grouped(batches, "key"):
            if s < 0:  # counts of counts of the triples
                total = sum(np.frombuffer(x, np.int64) for x in rows.column("rows").to_pylist())
                yield pa.RecordBatch.from_arrays([pa.array([-2], pa.int64()), pa.array([total.tobytes()], pa.binary()), pa.array([b""], pa.binary())], ["key", "rows", "second"])
                continue
            a, b, *values = _unpacked(rows.column("rows").to_pylist(), 2 + PAIR_COLUMNS)
            keys, at, sums = _summed(_mixed(a, b), np.stack(values, 1))
            _save(folder, f"pairs-{s}", keys)
            _save_rows(folder, f"pair-counts-{s}", sums)
            real = sums[:, 0] > 0  # not the two starts of a text
            a, b, n = a[at][real], b[at][real], sums[real, 0]
            prev, _, first = _summed(a, np.stack([n, n == 1, n == 2, n > 2], 1).astype(np.int64))
            first = np.concatenate([prev[:, None], first], 1)
            second = np.stack(np.unique(b, return_counts=True), 1)
            out = [(-1, np.array([*_of_counts(n), len(n)], np.int64).tobytes(), b"")]
            for i, j in zip(*_runs(first[:, 0] >> BLOCK_BITS)):
                out.append((int(first[i, 0] >> BLOCK_BITS), first[i:j].tobytes(), b""))
            for i, j in zip(*_runs(second[:, 0] >> BLOCK_BITS)):
                out.append((int(second[i, 0] >> BLOCK_BITS), b"", second[i:j].tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), (pa.int64(), pa.binary(), pa.binary()))], ["key", "rows", "second"])

    sent = _sorted_shards(told, ["key"], min(4 * parts, model.shards))
    said = cut_lineage(sent.mapInArrow(merge, "key long, rows binary, second binary"))
    model.triple_discounts = discounts(*_sum_columns(said, -2, 4))
    *of_counts, model.n_pairs = _sum_columns(said, -1, 5)
    model.pair_discounts = discounts(*of_counts)
    return said.filter("key >= 0").selectExpr("key AS block", "rows AS first", "second")


def _blocks(said: DataFrame, model: Model, parts: int) -> None:
    """Dense arrays by word id: pairs that end in it, pairs that begin with it, and the share that backs off."""
    folder, size, mask, (d1, d2, d3) = model.folder, 1 << BLOCK_BITS, (1 << BLOCK_BITS) - 1, model.pair_discounts

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, rows in _grouped(batches, "block"):
            first, follows = np.zeros((size, 4), np.int64), np.zeros(size, np.int64)
            for a, b in zip(rows.column("first").to_pylist(), rows.column("second").to_pylist()):
                if a:
                    x = np.frombuffer(a, np.int64).reshape(-1, 5)
                    first[x[:, 0] & mask] += x[:, 1:]
                if b:
                    x = np.frombuffer(b, np.int64).reshape(-1, 2)
                    follows[x[:, 0] & mask] += x[:, 1]
            _save(folder, f"totals-{block}", _narrow(first[:, 0]))
            _save(folder, f"shares-{block}", ((first[:, 1] * d1 + first[:, 2] * d2 + first[:, 3] * d3) / np.maximum(first[:, 0], 1)).astype("<f8"))
            _save(folder, f"follows-{block}", _narrow(follows))
            yield pa.RecordBatch.from_arrays([pa.array([int((follows == k).sum())]) for k in (1, 2, 3, 4)] + [pa.array([int((follows > 2).sum())])], list("abcde"))

    n_blocks = (model.n_words >> BLOCK_BITS) + 1
    sums = _sorted_shards(said, ["block"], min(parts, n_blocks)).mapInArrow(write, "a long, b long, c long, d long, e long").agg(*[F.sum(c) for c in "abcde"]).first()
    n1, n2, n3, n4, n3up = (int(x or 0) for x in sums)
    model.word_discounts = discounts(n1, n2, n3, n4)
    d = model.word_discounts
    model.rest = (d[0] * n1 + d[1] * n2 + d[2] * n3up) / model.n_pairs if model.n_pairs else 1.0


def train(texts: DataFrame, text_col: str = "text") -> Model:
    """Count a trigram model over whole texts (null: empty) and write its arrays to the shared folder.

    Words (lower-case A-Z, between ASCII white space) are hashed to 64 bits and numbered by their rank in the sorted
    hash array; a text has two starts before it. Triples are counted per slice of texts, sent once to the shard of
    their middle word (frequent ones are spread over shards by the other words), merged there and written. The merged
    triples tell pairs in how many places they stand, pairs tell words, so the texts are sent only once. Triples and
    pairs are found by a 64-bit hash of their ids; counts are kept whole in the smallest type that holds a file's. All
    parts of the model grow with the corpus and are cut into files of bounded size; the driver sees only sizes and
    counts of counts.
    """
    spark = texts.sparkSession
    path, _ = shared_path(spark)
    os.makedirs(path, exist_ok=True)
    model, parts = Model(path), int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = texts.select(F.col(text_col).alias("text"))
    _vocabulary(rows, model, parts)
    if model.n_words:
        _blocks(_pairs(_triples(rows, model, parts), model, parts), model, parts)
    return model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, n_tokens, n_known, train_tokens, base_score and score (log10 probabilities).

    The base is add-one over single tokens; the model interpolates triples, pairs and words (the lower two by continuation counts)
    and a uniform rest, which also serves unknown words. Null and empty texts are one end. Repeated rows and null ids stay rows of their
    own; other columns are not read. An untrained model gives every token the uniform rest, that is 1. No shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SCORE_SLICE):
            n, known, base, logp = model.score(column(batch, "text"))
            yield pa.RecordBatch.from_arrays(
                [column(batch, "id"), pa.array(n), pa.array(known), pa.array(np.full(len(n), model.n_tokens)), pa.array(base), pa.array(logp)],
                ["id", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {kind}, n_tokens long, n_known long, train_tokens long, base_score double, score double").withColumnRenamed("id", id_col)
