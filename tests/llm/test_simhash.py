import numpy as np
import xxhash
from pyspark.sql import functions as F

from cellweave.llm import simhash
from cellweave.llm.common import components


def _fingerprint(text):
    w = (text or "").encode().lower().split()
    s = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) > 2 else [b" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def _groups(fps, radius):
    root = list(range(len(fps)))
    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= radius:
                a, b = i, j
                while root[a] != a:
                    a = root[a]
                while root[b] != b:
                    b = root[b]
                root[max(a, b)] = min(a, b)
    return [next(x for x in _up(root, i)) for i in range(len(fps))]


def _up(root, i):
    while root[i] != i:
        i = root[i]
    yield i


def test_same_hash_as_spark(spark):
    text = "the river stone"
    assert spark.range(1).select(F.xxhash64(F.lit(text))).first()[0] & (2**64 - 1) == xxhash.xxh64_intdigest(text.encode(), 42)


def test_fingerprints_and_components(awkward, none):
    docs = awkward.collect()
    rows = simhash.fingerprint_components(awkward).collect()
    assert len(rows) == len(docs)
    fps = [_fingerprint(r.text) for r in docs]
    roots = _groups(fps, 2)
    first = {}
    for r, g in zip(docs, roots):
        if r.doc_id is not None:
            first[g] = min(first.get(g, r.doc_id), r.doc_id)
    want = sorted((str(r.doc_id), f"{f:016x}", str(first.get(g))) for r, f, g in zip(docs, fps, roots))
    assert sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in rows) == want
    assert simhash.fingerprint_components(none).count() == 0


def test_all_pairs_within_two_bits(spark):
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2**63, 40, dtype=np.uint64)
    fps = [int(b) for b in base]
    for b in base:
        for n in (1, 2, 2, 3):
            fps.append(int(b) ^ sum(1 << int(x) for x in rng.choice(64, n, False)))
    signed = [(f - 2**64 if f >> 63 else f,) for f in dict.fromkeys(fps)]
    values = spark.createDataFrame(signed, "fp long")
    roots = {r.node: r.root for r in components(simhash.near_pairs(values)).collect()}
    plain = [s[0] & (2**64 - 1) for s in signed]
    want = _groups(plain, 2)
    got = [roots.get(s[0], s[0]) for s in signed]
    assert len(set(zip(got, want))) == len(set(got)) == len(set(want))


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(1, 300)] + [(5000, 5000)]
    rows = components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert len(rows) == 601 and len({r.root for r in rows if r.node < 1000}) == 1 and len({r.root for r in rows if r.node >= 1000}) == 1
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def _shingles(text, k=5):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + k]) for i in range(max(len(w) - k + 1, min(len(w), 1)))}


def test_near_duplicates_are_right_and_most_are_found(spark):
    rng = np.random.default_rng(4)
    words = [f"w{i}" for i in range(4000)]
    rows = []
    for i in range(60):
        w = list(rng.choice(words, 200))
        rows.append((3 * i, " ".join(w)))
        w[int(rng.integers(0, 200))] = "changed"
        rows.append((3 * i + 1, " ".join(w)))
        rows.append((3 * i + 2, " ".join(rng.choice(words, 200))))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r.doc_id for r in simhash.drop_near_duplicates(docs).collect()}
    assert all(3 * i in kept and 3 * i + 2 in kept for i in range(60))
    assert sum(3 * i + 1 not in kept for i in range(60)) >= 57


def test_dropping_keeps_awkward_rows_once(awkward, none):
    kept = simhash.drop_near_duplicates(awkward)
    assert kept.columns == awkward.columns and simhash.drop_near_duplicates(none).count() == 0
    rows = kept.collect()
    ids = [r.doc_id for r in rows]
    assert ids.count(0) == 1 and 104 not in ids and 103 in ids and not {106, 107, 108, 109} & set(ids) and 100 in ids and 101 not in ids


EDITS = {  # the edit, and the most changed words that leave five-word shingles of n words at Jaccard 0.8
    "appended": (lambda w, k, fresh: w + fresh[:k], lambda n: (n - 4) // 4),
    "replaced": (lambda w, k, fresh: w[: len(w) - k] + fresh[:k], lambda n: (n - 4) // 9),
    "scattered": (lambda w, k, fresh: [fresh[i] if i in range(len(w) // k // 2, len(w), len(w) // k) else x for i, x in enumerate(w)], lambda n: (n - 4) // 45),
}


def test_near_copies_are_found_whatever_the_edit(spark):
    """Pairs of Jaccard 0.80 to 0.85: at least 99 of 100 are found for each kind of edit and length."""
    rng = np.random.default_rng(12)
    rows = []
    for kind, (edit, most) in EDITS.items():
        for n in (120, 400):
            for _ in range(100):
                w, fresh = [list(map(str, rng.integers(0, 10**9, n))) for _ in range(2)]
                both = [" ".join(x) for x in (w, edit(w, most(n), fresh))]
                a, b = map(_shingles, both)
                assert 0.8 <= len(a & b) / len(a | b) < 0.85
                rows += [(kind, n, t) for t in both]
    docs = spark.createDataFrame([(i, t) for i, (_, _, t) in enumerate(rows)], "doc_id long, text string")
    groups = {r.first_id: r.component_id for r in simhash.near_duplicates(docs).collect()}
    assert all(groups[i] == i for i in range(0, len(rows), 2))
    found = {}
    for i in range(1, len(rows), 2):
        found[rows[i][:2]] = found.get(rows[i][:2], 0) + (groups[i] == i - 1)
    assert len(found) == 6 and all(n >= 99 for n in found.values()), found


def test_all_texts_of_a_bucket_meet(spark, monkeypatch):
    """Texts of one template: near pairs among strangers that share their bucket, and sort before and between them."""
    rng = np.random.default_rng(21)
    base, texts = [f"t{i}" for i in range(100)], []
    for i in range(60):
        own = [str(x) for x in rng.integers(0, 10**9, 30)]
        texts += [" ".join(base + own), " ".join(base + own[: 25 - i % 20])]
    sets = [simhash.shingle_hashes(t, 5, 0, True) for t in texts]
    keys = [simhash.band_keys(x, 1, 1)[0] for x in sets]
    root = list(range(len(texts)))
    for b in range(len(texts)):
        for a in range(b):
            same = len(np.intersect1d(sets[a], sets[b]))
            if keys[a] == keys[b] and same >= 0.8 * (len(sets[a]) + len(sets[b]) - same):
                low, high = sorted((root[a], root[b]))
                root = [low if r == high else r for r in root]
    assert max(keys.count(k) for k in set(keys)) > 60 and 20 < len(set(root)) < 110
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for block in (256, 7):
        monkeypatch.setattr(simhash, "BLOCK", block)
        got = {r.first_id: r.component_id for r in simhash.near_duplicates(docs, bands=1, rows=1).collect()}
        assert [got[i] for i in range(len(texts))] == root


def test_a_bucket_of_boilerplate(spark):
    """5000 texts of one template share a bucket; copies among them are found wherever they stand, and nothing else is linked."""
    rng = np.random.default_rng(33)
    base = [f"t{i}" for i in range(24)]
    own = [[str(x) for x in rng.integers(0, 10**9, 6)] for _ in range(4980)]
    texts = [" ".join(base + o) for o in own] + [" ".join(base + own[250 * i][:5] + ["end"]) for i in range(20)]
    sets = [simhash.shingle_hashes(t, 5, 0, True) for t in texts]
    rows = next(r for r in range(1, 40) if sum(simhash.band_keys(x, r, 1)[r - 1] == simhash.band_keys(sets[0], r, 1)[r - 1] for x in sets[:200]) > 120)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.first_id: r.component_id for r in simhash.near_duplicates(docs, bands=rows + 8, rows=1).collect()}
    assert [got[4980 + i] for i in range(20)] == [250 * i for i in range(20)]
    assert sum(got[i] == i for i in range(4980)) == 4980


def test_fingerprints_bring_near_copies_together(spark):
    """One band over 5000 minima never agrees for texts that differ; the balls of the fingerprints find the copies."""
    rng = np.random.default_rng(3)
    rows = []
    for i in range(4):
        w = [f"w{x}" for x in rng.integers(0, 10**6, 6000)]
        rows += [(2 * i, " ".join(w)), (2 * i + 1, " ".join([*w[:-1], "other"]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.first_id: r.component_id for r in simhash.near_duplicates(docs, bands=1, rows=5000).collect()}
    assert got == {i: i - i % 2 for i in range(8)}
