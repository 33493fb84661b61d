"""Codes of vectors that stand in for them in buckets (operator 8)."""

import numpy as np
import pyarrow as pa

from cellweave.llm import lattice


def test_codes_lose_no_link_and_vectors_are_not_sent_to_every_cell(spark):
    rng, n400 = np.random.default_rng(5), np.arange(400)
    base = rng.standard_normal((400, 64)) * np.where(rng.random((400, 64)) < 0.05, 40, 1)
    base /= np.linalg.norm(base, axis=1)[:, None]
    off = rng.standard_normal((400, 64))
    off -= (off * base).sum(1)[:, None] * base
    off /= np.linalg.norm(off, axis=1)[:, None]
    cosine = np.where(n400 % 2, rng.uniform(0.975, 0.985, 400), rng.uniform(0.6, 0.9, 400))[:, None]
    both = np.concatenate([base, base * cosine + off * np.sqrt(1 - cosine**2)])
    df = spark.createDataFrame([(i, 0, v.tolist()) for i, v in enumerate(both)], "cls long, label long, vec array<double>").coalesce(4)
    codes = {r.cls: bytes(r.code) for r in lattice._codes(df).collect()}
    assert len(codes) == 800 and {len(c) for c in codes.values()} == {72}
    n, one = np.arange(800), np.ones(800, np.int64)
    rows = pa.table({
        "bucket": n % 400, "tab": 0 * n, "blk": 0 * n, "left": one, "right": one, "base": one, "cls": n, "code": [codes[i] for i in n.tolist()]
    }).take(pa.array(np.argsort(n % 400, kind="stable")))
    kept = set(lattice._likely(rows, 0.98).column("cls").to_pylist())
    true = np.flatnonzero((both[:400] * both[400:]).sum(1) >= 0.98)
    assert 50 < len(true) < 150 and all(i in kept and i + 400 in kept for i in true.tolist())
    assert len(kept) <= 400  # those far from it are left out

    sent = lambda: spark._jsc.sc().statusStore().executorList(True).apply(0).totalShuffleWrite()
    before = sent()
    lone = spark.createDataFrame([(i, 0, v.tolist()) for i, v in enumerate(rng.standard_normal((1500, 64)))], "vec_id long, label int, embedding array<double>")
    assert {r.n_links for r in lattice.near_vectors(lone).collect()} == {0}
    spark._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    assert sent() - before < 12_000_000  # bytes; with its vector and probes in every cell a row of 512 bytes was sent up to forty times


def test_cells_do_not_depend_on_the_rows_beside(spark):
    rng = np.random.default_rng(6)
    unit = rng.standard_normal((50, 64))
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    own, probes = lattice.cells(unit, np.zeros(50, np.int64), 4, 0.4, 0.055)
    for i in (0, 17, 49):
        one, few = lattice.cells(unit[i : i + 1], np.zeros(1, np.int64), 4, 0.4, 0.055)
        assert (one[0] == own[i]).all()
        assert all((keys[who == i] == k).all() for (who, keys), (_, k) in zip(probes, few))
