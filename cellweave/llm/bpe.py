"""Byte-level BPE on ragged numpy arrays: one merge step for all pre-tokens of a batch at a time."""

from __future__ import annotations

import json
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

from cellweave.llm.common import encoded_chunks, per_process, ragged, text_bytes

# Fixed value: the published split pattern of byte-level BPE
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

NONE = np.int32(2**31 - 1)
LETTER, DIGIT, PUNCT, QUOTE, SPACE, LINE, OTHER, BLIND = range(8)


def _classes() -> np.ndarray:
    kind = np.full(256, BLIND, np.int8)
    for b in range(33, 127):
        c = chr(b)
        kind[b] = LETTER if c.isalpha() else DIGIT if c.isdigit() else QUOTE if c == "'" else PUNCT
    kind[32], kind[10] = SPACE, LINE
    kind[128:] = OTHER
    kind[[0xC2, 0xE1, 0xE2, 0xE3]] = BLIND  # first bytes of the white space beyond ASCII
    return kind


def safe_cuts(data: np.ndarray) -> np.ndarray:
    """Byte positions at which the split pattern always begins a new pre-token, whatever stands around them.

    Texts may be cut there before the pattern runs, so that equal pieces are split and merged once per batch. Not
    all borders are found; a piece may hold several pre-tokens.
    """
    kind = per_process("bpe classes", _classes)[data]
    prev, this = kind[:-1], kind[1:]
    solid = (kind <= QUOTE) | (kind == OTHER)
    blind = np.isin(data, (0xC2, 0xE1, 0xE2, 0xE3))
    after = solid.copy()  # a character that surely is no white space ends here
    after[1:] &= ~blind[:-1]
    after[2:] &= ~blind[:-2]
    cut = np.zeros(len(data), bool)
    cut[1:] = (prev == LETTER) & (this >= DIGIT) & (this <= QUOTE)
    cut[1:] |= (prev == DIGIT) & ((this == LETTER) | (this == PUNCT) | (this == QUOTE))
    cut[1:] |= (prev == PUNCT) & ((this == LETTER) | (this == DIGIT))
    cut[1:] |= (prev == QUOTE) & (this == DIGIT)
    gap = np.zeros(len(data), bool)
    gap[1:-1] = ((kind[1:-1] == SPACE) | (kind[1:-1] == LINE)) & after[:-2] & solid[2:]
    cut |= gap
    cut[1:] |= gap[:-1] & (kind[:-1] == LINE)
    return cut


@dataclass
class Vocabulary:
    """Byte ids, merges sorted by pair, and the strings that stand for one id wherever they occur."""

    byte_ids: np.ndarray
    pairs: np.ndarray
    ranks: np.ndarray
    merged: np.ndarray
    special: dict[bytes, int]


def load(path: str) -> Vocabulary:
    """Read a byte-level BPE from the JSON file of the ``tokenizers`` library."""
    spec = json.load(open(path, encoding="utf-8"))
    ids = spec["model"]["vocab"]
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    shown = {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(sorted(set(range(256)) - set(printable)))}
    merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
    left, right = (np.array([ids[m[i]] for m in merges], np.int64) for i in (0, 1))
    pairs = (left << 32) | right
    order = np.argsort(pairs)
    return Vocabulary(
        np.array([ids[shown[b]] for b in range(256)], np.int32), pairs[order], order.astype(np.int32),
        np.array([ids[m[0] + m[1]] for m in merges], np.int32), {t["content"].encode(): t["id"] for t in spec["added_tokens"]},
    )


def _ranks(v: Vocabulary, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    pair = (left.astype(np.int64) << 32) | right
    at = np.minimum(np.searchsorted(v.pairs, pair), len(v.pairs) - 1)
    return np.where(v.pairs[at] == pair, v.ranks[at], NONE)


def merge(v: Vocabulary, data: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of many pre-tokens (their bytes one after the other) and the number of ids of each.

    In each step every pre-token applies its pair of lowest rank, everywhere it occurs; a pair made by a merge always
    has a higher rank than the merge, so this gives what merging one pair at a time gives. Finished pre-tokens leave.
    """
    seq = np.flatnonzero(lengths)
    n = lengths[seq].astype(np.int64)
    sym = v.byte_ids[data]
    rank = np.full(len(sym), NONE, np.int32)
    if len(sym) > 1:
        rank[:-1] = _ranks(v, sym[:-1], sym[1:])
    if len(n):
        rank[np.cumsum(n) - 1] = NONE
    done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    while len(seq):
        ends = np.cumsum(n)
        low = np.minimum.reduceat(rank, ends - n)
        busy = low < NONE
        if not busy.all():
            each = np.repeat(busy, n)
            done.append((seq[~busy], n[~busy], sym[~each]))
            seq, n, low, sym, rank = seq[busy], n[busy], low[busy], sym[each], rank[each]
            if not len(seq):
                break
            ends = np.cumsum(n)
        hit = np.flatnonzero(rank == np.repeat(low, n))
        new_run = np.ones(len(hit), bool)
        new_run[1:] = np.diff(hit) > 1
        run_start = np.maximum.accumulate(np.where(new_run, np.arange(len(hit)), 0))
        hit = hit[(np.arange(len(hit)) - run_start) % 2 == 0]  # of overlapping pairs in a run, every other one
        sym[hit] = v.merged[rank[hit]]
        keep = np.ones(len(sym), bool)
        keep[hit + 1] = False
        lost = np.bincount(np.searchsorted(ends, hit, "right"), minlength=len(n))
        now = hit - np.arange(len(hit))
        sym, rank = sym[keep], rank[keep]
        n = n - lost
        last = np.zeros(len(sym), bool)
        last[np.cumsum(n) - 1] = True
        first = np.zeros(len(sym), bool)
        first[np.cumsum(n) - n] = True
        changed = np.zeros(len(sym), bool)
        changed[now] = True
        changed[(now - 1)[~first[now]]] = True
        rank[changed] = NONE
        inner = np.flatnonzero(changed & ~last)
        rank[inner] = _ranks(v, sym[inner], sym[inner + 1])
    counts = np.zeros(len(lengths), np.int64)
    if not done:
        return np.zeros(0, np.int32), counts
    order, size, flat = (np.concatenate([d[i] for d in done]) for i in range(3))
    counts[order] = size
    starts = np.zeros(len(lengths), np.int64)
    starts[order] = np.cumsum(size) - size
    return flat[ragged(starts, counts)], counts


def _encode_pieces(v: Vocabulary, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the pieces one after the other, and ids per piece. A piece that is a special string has its one id."""
    split = per_process("bpe split", lambda: regex.compile(SPLIT)).findall
    tokens: list[bytes] = []
    per_piece = np.ones(len(pieces), np.int64)
    for i, piece in enumerate(pieces):
        if piece in v.special:
            tokens.append(b"")
            continue
        text = piece.decode()
        if (text[1:] if text[0] == " " else text).isalpha():
            tokens.append(piece)
        else:
            found = split(text)
            per_piece[i] = len(found)
            tokens.extend(t.encode() for t in found)
    lengths = np.fromiter(map(len, tokens), np.int64, len(tokens))
    flat, counts = merge(v, np.frombuffer(b"".join(tokens), np.uint8), lengths)
    ends = np.concatenate([[0], np.cumsum(counts)])[np.concatenate([[0], np.cumsum(per_piece)])]
    size = np.diff(ends)
    for i in [i for i, piece in enumerate(pieces) if piece in v.special]:
        flat = np.insert(flat, int(size[:i].sum()), v.special[pieces[i]])
        size[i] = 1
    return flat, size


class Pieces:
    """Pieces this worker has merged before. Bounded: when full it starts anew from the batch at hand."""

    def __init__(self, limit: int = 400_000):
        self.limit, self.slots = limit, {}
        self.flat, self.starts, self.sizes = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def find(self, v: Vocabulary, pieces: list[bytes]) -> np.ndarray:
        if len(self.slots) + len(pieces) > max(self.limit, len(pieces)):
            fresh = [p for p in pieces if p not in self.slots]
            if len(self.slots) + len(fresh) > self.limit:
                self.__init__(self.limit)
        fresh = [p for p in pieces if p not in self.slots]
        if fresh:
            flat, sizes = _encode_pieces(v, fresh)
            self.slots.update(zip(fresh, range(len(self.sizes), len(self.sizes) + len(fresh))))
            self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(sizes) - sizes])
            self.sizes, self.flat = np.concatenate([self.sizes, sizes]), np.concatenate([self.flat, flat])
        return np.fromiter(map(self.slots.__getitem__, pieces), np.int64, len(pieces))


def pieces_of(v: Vocabulary, texts: pa.Array) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Distinct pieces of whole texts, the piece at each place, and the number of places of each text."""
    data, ends = text_bytes(texts)
    if not len(data):
        return [], np.zeros(0, np.int64), np.zeros(len(texts), np.int64)
    cut = safe_cuts(data)
    blob = None
    for word in v.special:
        if not pc.any(pc.match_substring(pc.fill_null(texts, ""), word.decode())).as_py():
            continue
        blob = blob or data.tobytes()
        at = blob.find(word)
        while at >= 0:
            inside = np.searchsorted(ends, at, "right") == np.searchsorted(ends, at + len(word) - 1, "right")
            if inside:
                cut[at : at + len(word)] = False
                cut[at] = True
                if at + len(word) < len(cut):
                    cut[at + len(word)] = True
            at = blob.find(word, at + (len(word) if inside else 1))
    cut[ends[:-1][np.diff(ends) > 0]] = True
    starts = np.flatnonzero(cut)
    pieces, index = encoded_chunks(data, np.append(starts, len(data)))
    return pieces, index, np.searchsorted(starts, ends[1:]) - np.searchsorted(starts, ends[:-1])


def token_counts(v: Vocabulary, texts: pa.Array, known: Pieces) -> np.ndarray:
    pieces, index, places = pieces_of(v, texts)
    slots = known.find(v, pieces)
    total = np.concatenate([[0], np.cumsum(known.sizes[slots][index])])
    return np.diff(total[np.concatenate([[0], np.cumsum(places)])])


def token_ids(v: Vocabulary, texts: pa.Array, known: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """All ids of the texts one after the other, and the number of ids of each text."""
    pieces, index, places = pieces_of(v, texts)
    slots = known.find(v, pieces)[index]
    total = np.concatenate([[0], np.cumsum(known.sizes[slots])])
    return known.flat[ragged(known.starts[slots], known.sizes[slots])], np.diff(total[np.concatenate([[0], np.cumsum(places)])])
