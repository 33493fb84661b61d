"""Whitening, Merkle manifest and sharding against plain versions."""

import math
import random
import zlib
from collections import Counter
from hashlib import sha256

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellweave.llm import manifest, queries, sharding, whitening
from cellweave.llm.common import in_order
from cellweave.llm.packing import hilbert
from cellweave.session import cut_lineage

EXTRA = "dims long, n long, rank long, _v string, embedding2 int, key string, digest string, whitened int"


def _h(text):
    return sha256(text.encode()).hexdigest()


# whitening

def _vector_rows():
    rng = np.random.default_rng(3)
    mix = rng.normal(size=(12, 12))
    rows = [(i, [float(np.float32(v)) for v in rng.normal(size=12) @ mix * 0.1]) for i in range(300)]
    rows += [(7, rows[7][1])] * 3 + [(None, rows[8][1])]
    bad = [(1000, None), (1001, [None] + rows[0][1][1:]), (1002, [float("nan")] * 12), (1003, [math.inf] * 12), (1004, [])]
    other = [(2000 + i, [float(i), float(i * i % 7)]) for i in range(9)] + [(3000, [1e30, -2.5, 3.0]), (4000, [5.0])]
    return rows, bad, other


def test_whitening_is_the_plain_one(spark):
    rows, bad, other = _vector_rows()
    extra = (1, 2, 3, "x", 4, "k", "d", 5)
    table = spark.createDataFrame([r + extra for r in rows + bad + other], f"vec_id long, embedding array<double>, {EXTRA}").repartition(5)
    models = whitening.fit(table)
    out = whitening.component_rows(whitening.whiten(table, models), models).collect()
    main = [r for r in out if r.n == len(rows)]
    assert len(main) == 8 * len(rows) and not {r.vec_id for r in out} & {b[0] for b in bad}
    x = np.array([[math.floor(1024 * c) + 100000 for c in v] for _, v in rows], object)
    n, s = len(x), x.sum(0)
    cov = np.array([[float(sum((n * a - s[i]) * (n * b - s[j]) for a, b in zip(x[:, i], x[:, j]))) / n**3 for j in range(12)] for i in range(12)])
    values, vectors = np.linalg.eigh(cov)
    white = ((n * x - s).astype(float) / n) @ vectors[:, ::-1] / np.sqrt(values[::-1])
    want = {}
    for (ident, _), row, w in zip(rows, x, white):
        want[ident] = (sum((n * int(a) - int(b)) ** 2 for a, b in zip(row, s)), w)
    for r in main:
        deviation, w = want[r.vec_id]
        assert r.deviation == deviation and abs(abs(r.whitened) - abs(w[r.component - 1])) < 1e-8
        assert abs(r.explained - values[::-1][r.component - 1] / values.sum()) < 1e-12 and r.identity_error < 1e-9
    got = np.zeros((8, 8))
    by = {}
    for r in main:
        by.setdefault((r.vec_id, r.component), r.whitened)
    ids = [i for i, _ in rows]
    w = np.array([[by[i, k] for k in range(1, 9)] for i in ids])
    got = (w - w.mean(0)).T @ (w - w.mean(0)) / n
    assert np.abs(got - np.eye(8)).max() < 1e-9
    assert Counter(r.vec_id for r in main)[7] == 32 and None in {r.vec_id for r in main}
    lone = {r.vec_id: r for r in out if r.n == 1}
    assert lone[4000].whitened is None and lone[4000].deviation == 0 and lone[3000].explained is None
    two = [r for r in out if 2000 <= r.vec_id < 3000] if all(r.vec_id is not None for r in out) else [r for r in out if r.vec_id is not None and 2000 <= r.vec_id < 3000]
    assert len(two) == 18 and all(r.n == 9 for r in two)
    none = table.limit(0)
    assert whitening.fit(none) == {} and whitening.component_rows(whitening.whiten(none, {}), {}).count() == 0


@pytest.mark.parametrize("spread", [1, 1000, 2**40, 2**60])
def test_cross_products_are_exact(spread):
    rng = np.random.default_rng(8)
    x = rng.integers(-spread, spread + 1, (133, 5)) + 7
    sums, products = whitening.cross_products(x)
    big = x.astype(object)
    assert list(sums) == list(big.sum(0))
    assert all(products[i, j] == (big[:, i] * big[:, j]).sum() for i in range(5) for j in range(i, 5))
    for v in (0, 5, -5, 3 << 140, -(3 << 140)):
        assert sum(p << whitening.LIMB * k for k, p in enumerate(whitening._limbs(v))) == v


def test_wide_values_stay_exact(spark):
    rows = [(i, [1e12 + i, float(i)]) for i in range(40)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    out = whitening.whiten(table, whitening.fit(table)).collect()
    x = [[math.floor(1024 * c) + 100000 for c in v] for _, v in rows]
    s = [sum(c) for c in zip(*x)]
    assert {r.vec_id: int(r.deviation) for r in out} == {i: sum((40 * a - b) ** 2 for a, b in zip(v, s)) for i, v in enumerate(x)}


# manifest

def _merkle(docs, later):
    """Levels of every tree as lists; (leaf, subroot, root, proof, folded, verified) of each row, ties by digest."""
    enc = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r: _h("".join(enc(r[c]) for c in manifest.FIELDS))
    groups = {}
    for r in docs:
        groups.setdefault(r["lang"], []).append((r["doc_id"] is not None, r["doc_id"] or 0, leaf(r), leaf(later(r))))

    def tree(level):
        levels = [level]
        while len(level) > 1:
            level = [_h("".join(level[i : i + 2])) for i in range(0, len(level), 2)]
            levels.append(level)
        return levels

    def path(levels, i):
        return [(None if i >> k ^ 1 >= len(lv) else lv[i >> k ^ 1], (i >> k) & 1) for k, lv in enumerate(levels[:-1])]

    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: (sorted(rows), tree([r[2] for r in sorted(rows)])) for g, rows in groups.items()}
    top = tree([trees[g][1][-1][0] for g in order])
    out = []
    for k, g in enumerate(order):
        for i, (known, ident, own, found) in enumerate(trees[g][0]):
            steps = path(trees[g][1], i) + path(top, k)
            for other, right in steps:
                found = _h(found if other is None else other + found if right else found + other)
            out.append((ident if known else None, own, trees[g][1][-1][0], top[-1][0], _h("".join(o for o, _ in steps if o)), found, found == top[-1][0]))
    return out


def _later(r):
    r = dict(r)
    if r["doc_id"] is not None and r["n_chars"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 == 0:
        r["n_chars"] += 1
    return r


@pytest.mark.parametrize("height", [10, 3, 1])
def test_manifest_is_the_plain_one(spark, awkward, none, monkeypatch, height):
    monkeypatch.setattr(manifest, "HEIGHT", height)
    bad = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    built = manifest.build(awkward, seen={"n_chars": F.when(bad, F.col("n_chars") + 1).otherwise(F.col("n_chars"))})
    assert len(built.layers) >= {10: 0, 3: 1, 1: 4}[height]
    key = lambda t: tuple(str(v) for v in t)
    got = sorted((tuple(r) for r in manifest.audit(built).collect()), key=key)
    want = sorted(_merkle([r.asDict() for r in awkward.collect()], _later), key=key)
    assert got == want and {r[-1] for r in got} == {True, False}
    empty = manifest.build(none)
    assert empty.root is None and manifest.audit(empty).count() == 0


def test_one_row_is_its_own_root(spark):
    one = spark.createDataFrame([(5, "a", None, 1, "x")], "doc_id long, source string, lang string, n_chars long, text string")
    row = manifest.audit(manifest.build(one)).first()
    assert row.leaf == row.subroot == row.root == row.folded_root and row.verified and row.proof_sha256 == _h("")


def test_addresses_follow_the_layout():
    assert [a.tolist() for a in manifest.addresses(3)] == [[0], [1, 4], [2, 3, 5, 6]]
    assert [a.tolist() for a in manifest.addresses(4)] == [[0], [1, 2], [3, 6, 9, 12], [4, 5, 7, 8, 10, 11, 13, 14]]
    for levels in range(1, 12):
        assert sorted(np.concatenate(manifest.addresses(levels)).tolist()) == list(range(2**levels - 1))


# order and shards

def test_order_with_one_key_in_many_partitions(spark):
    rng = random.Random(4)
    rows = [(rng.choice("aaaaaabcd") if i % 50 else f"k{i}", rng.randint(0, 5), i, rng.randint(0, 9)) for i in range(3000)]
    table = cut_lineage(spark.createDataFrame(rows, "key string, a int, b int, size long"))
    got = {r.b: (r["rank"], r.before) for r in in_order(table, "key", ["a", "b"], "size").collect()}
    at, sums = Counter(), Counter()
    for key, _, b, size in sorted(rows):
        assert got[b] == (at[key], sums[key])
        at[key] += 1
        sums[key] += size


def test_hilbert_neighbours():
    grid = np.stack(np.meshgrid(*[np.arange(8)] * 3, indexing="ij"), -1).reshape(-1, 3)
    order = grid[np.argsort(hilbert(grid, 3))]
    assert (np.abs(np.diff(order, axis=0)).sum(1) == 1).all()


def _plain_shards(docs, count):
    n = len(docs)
    place = lambda v: (v is not None, v if v is not None else 0)
    step = {d: {v: 32 * sum(place(r[d]) < place(v) for r in docs) // n for v in {r[d] for r in docs}} for d in sharding.DIMS}
    rows = []
    for r in docs:
        raw = (r["text"] or "").encode()
        point = np.array([[step[d][r[d]] for d in sharding.DIMS]])
        rows.append((int(hilbert(point, 5)[0]), zlib.crc32(raw), r["doc_id"] is not None, r["doc_id"] or 0, len(raw) + 1))
    total, before, slots, out = sum(r[-1] for r in rows), 0, Counter(), []
    for curve, crc, known, ident, size in sorted(rows):
        shard = count * (2 * before + size) // (2 * total)
        out.append((ident if known else None, size, crc, shard, slots[shard], curve))
        slots[shard] += 1
        before += size
    return out


def test_shards_are_the_plain_ones(spark, awkward, none, corpus):
    for docs in (awkward.withColumn("source", F.when(F.col("doc_id") != 3, F.col("source"))), corpus):
        rows = sharding.shards(docs).collect()
        got = sorted(((r.doc_id, r["size"], r.text_crc32, r.shard, r.slot, r.curve) for r in rows), key=str)
        assert got == sorted(_plain_shards([r.asDict() for r in docs.collect()], 16), key=str)
        assert {(r.law, r.grown_shard) for r in rows} == {("bytes", None)}
    load = Counter()
    for r in rows:
        load[r.shard] += r["size"]
    most = max(r["size"] for r in rows)
    assert all(abs(load[k] - sum(load.values()) / 16) <= most for k in range(16))
    assert sharding.shards(none).count() == 0


def test_shards_prune_files(spark):
    """Readers that ask for one source, or one range of sizes, open few of 64 shards."""
    rng = random.Random(1)
    docs = [(i, "x" * rng.randint(1, 400), rng.choice("abcd"), f"s{rng.randint(0, 15):02d}") for i in range(4000)]
    table = spark.createDataFrame([(*d, len(d[1])) for d in docs], "doc_id long, text string, lang string, source string, n_chars long")
    files = sharding.shards(table, 64).join(table, "doc_id").groupBy("shard").agg(
        F.min("source").alias("s0"), F.max("source").alias("s1"), F.min("n_chars").alias("n0"), F.max("n_chars").alias("n1"), F.min("lang").alias("l0"), F.max("lang").alias("l1")).collect()
    opened = [sum(f.s0 <= "s05" <= f.s1 for f in files), sum(f.n0 <= 30 and f.n1 >= 20 for f in files), sum(f.l0 <= "c" <= f.l1 for f in files)]
    assert len(files) == 64 and all(n <= 40 for n in opened), opened


def test_queries_cover_their_tables(spark, sf_dir):
    out = queries.op11_whitening(spark, sf_dir)
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    assert out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"] and out.count() == 8 * vectors.count()
