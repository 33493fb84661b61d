from collections import defaultdict

from cellweave.llm import mixing


def _targets(sizes, weights=(5, 2, 1), share=1.5, cap=2.0):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    total, out, open_ = share * sum(sizes.values()), {}, set(names)
    while open_:
        left = total - sum(out.values())
        level = left / sum(weight[s] for s in open_)
        full = [s for s in open_ if level * weight[s] > cap * sizes[s]]
        if not full:
            return out | {s: level * weight[s] for s in open_}
        out |= {s: cap * sizes[s] for s in full}
        open_ -= set(full)
    return out


def test_targets_and_taken(corpus):
    rows = mixing.mix(corpus).collect()
    words = {r.doc_id: len((r.text or "").encode().split()) for r in corpus.collect()}
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in rows:
        assert r.size == words[r.doc_id] and 0 <= r.taken <= 2 * r.size and r.taken == r.copies * r.size
        sizes[r.source] += r.size
        taken[r.source] += r.taken
    want = _targets(sizes)
    smallest = {s: min(r.size for r in rows if r.source == s and r.size) for s in sizes}
    for r in rows:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6 * want[r.source] + 1e-9
    for s in sizes:
        assert abs(taken[s] - want[s]) <= max(2 * smallest[s], 0.02 * want[s])
    assert sorted(map(tuple, rows)) == sorted(map(tuple, mixing.mix(corpus).collect()))


def test_rates_meet_the_constraint(corpus):
    """Exponential tilt: within a source the log of a rate below the cap is proportional to the size."""
    rows = mixing.mix(corpus).toPandas()
    for _, g in rows[rows["size"] > 0].groupby("source"):
        assert abs((g["rate"] * g["size"]).sum() - g["target"].iloc[0]) < 1e-6 * g["target"].iloc[0] + 1e-6
        free = g[g["rate"] < 2 - 1e-9]
        if len(free) > 1:
            import numpy as np

            slopes = np.log(free["rate"]) / free["size"]
            assert slopes.max() - slopes.min() < 1e-6


def test_awkward_rows(awkward, none):
    rows = mixing.mix(awkward).collect()
    assert len(rows) == awkward.count()
    assert {r.size for r in rows if r.source is None} == {0}
    assert mixing.mix(none).count() == 0
    again = mixing.repeat_by_mix(awkward)
    assert again.columns == awkward.columns and again.filter("length(trim(text)) = 0 OR text IS NULL").count() >= 0
    assert mixing.repeat_by_mix(none).count() == 0


def test_documents_without_words_keep_one_copy(awkward):
    rows = [r for r in mixing.mix(awkward).collect() if r.size == 0]
    assert len(rows) >= 4 and all(r.copies == 1 and r.rate == 1 and r.taken == 0 for r in rows)
    empty = "text IS NULL OR text NOT RLIKE '[^ \\\\t-\\\\r]'"
    assert mixing.repeat_by_mix(awkward).filter(empty).count() == awkward.filter(empty).count() >= 4
