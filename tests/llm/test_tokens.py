import os
import random
import subprocess
import sys
import zlib

import numpy as np
import pyarrow as pa
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
from tokenizers import Tokenizer  # noqa: E402

from cellweave.llm import bpe, packing, token_counts  # noqa: E402

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_ids_as_the_library_gives_them(library):
    rng = random.Random(1)
    hard = ["", None, "a  b", " a\n\n b \t c", "don't 'sabc it's'll 12abc", "x <|endoftext|> y<|endoftext|>", "<|endoftext|", "a" * 3000, "é b 　c  d",
            "日本 語。12", "a\x1cb \x1c c\x85d", "--''s 's ''t", "\n\n\n", "   ", "½ ² x1²", "\r\n x\r\n", "'", "😀 😀", " <|endoftext|> ", "\x00\x7f a", "᠎ x"]
    hard += ["".join(rng.choice(" \n\t'ab1.é　 -sS<|>\x1c語") for _ in range(rng.randint(0, 50))) for _ in range(3000)]
    vocab = bpe.load(PATH)
    ids, n = bpe.token_ids(vocab, pa.array(hard), bpe.Pieces(limit=500))
    ends = np.cumsum(n)
    want = [e.ids for e in library.encode_batch([t or "" for t in hard], add_special_tokens=False)]
    assert [ids[b - k : b].tolist() for b, k in zip(ends, n)] == want
    assert bpe.token_counts(vocab, pa.array(hard), bpe.Pieces()).tolist() == n.tolist()


def test_counts(awkward, none, library):
    rows = token_counts.token_counts(awkward, PATH).collect()
    want = sorted((r.doc_id or -1, len((r.text or "").encode()), len(library.encode(r.text or "", add_special_tokens=False).ids)) for r in awkward.collect())
    assert sorted((r.doc_id or -1, r.n_bytes, r.n_tokens) for r in rows) == want
    assert all(r.over_limit == (r.n_tokens > 512) for r in rows)
    assert token_counts.token_counts(none, PATH).count() == 0


@pytest.mark.parametrize("bits,dims", [(2, 3), (3, 2)])
def test_hilbert_neighbours(bits, dims):
    grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims), -1).reshape(-1, dims)
    key = packing.hilbert(grid, bits)
    assert sorted(key) == list(range(len(grid)))
    assert (np.abs(np.diff(grid[np.argsort(key)], axis=0)).sum(1) == 1).all()


def _check_pieces(rows, docs, library):
    want = sorted(tuple(library.encode(t or "", add_special_tokens=False).ids + [1]) for t in docs)
    whole, by_sequence = [], {}
    for r in rows:
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for rs in by_sequence.values():
        rs.sort(key=lambda r: r.offset)
        total = sum(r.length for r in rs)
        assert total <= 2048 and total & (total - 1) == 0  # full or a power of two: no padding
        assert [r.offset for r in rs] == [sum(x.length for x in rs[:i]) for i in range(len(rs))]
    ids = {}
    for w in want:
        ids.setdefault(len(w), []).append(w)
    pool = {}
    for w in want:
        pool[w] = pool.get(w, 0) + 1
    assert sum(r.length for r in rows) == sum(map(len, want))
    for r in rows:  # the piece is a part of a document of that length
        assert any(zlib.crc32(np.array(w[r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32 for w in set(ids[r.doc_tokens]))
    return whole


def test_packing(awkward, none, corpus, library):
    _check_pieces(packing.pack(awkward, PATH).collect(), [r.text for r in awkward.collect()], library)
    _check_pieces(packing.pack(corpus, PATH).collect(), [r.text for r in corpus.collect()], library)
    assert packing.pack(none, PATH).count() == 0


def test_packing_workers_give_memory_back():
    """A worker that has tokenised much text of ever new words holds little between its batches."""
    code = f"""
import random, sys
import pyarrow as pa
from cellweave.llm import packing

class Docs:
    schema = type("S", (), {{"__getitem__": lambda s, k: type("K", (), {{"dataType": type("D", (), {{"simpleString": staticmethod(lambda: "bigint")}})}})}})()
    select = lambda s, *c: s
    mapInArrow = lambda s, run, kind: run

rng = random.Random(1)
held = lambda: int(open("/proc/self/statm").read().split()[1]) * 4096 / 1e6
run = packing.tokenized(Docs(), {PATH!r}, 1, "doc_id", "text")
made = lambda: pa.record_batch([pa.array(range(40)), pa.array([" ".join("%x" % rng.getrandbits(40) for _ in range(3000)) for _ in range(40)])], ["doc_id", "text"])
before = held()
most = max(held() for _ in range(14) for out in run(iter([made()])))
print(most - before)
"""
    said = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=300, cwd=os.path.dirname(os.path.dirname(os.path.dirname(__file__))))
    assert float(said.stdout) < 155, said.stderr
