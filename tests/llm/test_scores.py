import math
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from cellweave.llm import kneser_ney, quality, queries, toxicity


def test_folding():
    assert toxicity.fold("You ΙDΙΟТ, 1d10t! ｓｃｕｍ mo​ron l@z$y ÉTÉ") == " you idiot idiot scum moron lazsy été "


def _score(lexicon, text):
    return lexicon.score(lexicon.raw(lexicon.automaton(), text))


def test_lexicon_matches_and_exceptions():
    lexicon = toxicity.Lexicon({toxicity.fold("trash"): 4.0, " vequ": 4.0}, slope=4.0, offset=-3.0)
    assert _score(lexicon, "you are TR4SH, trash and trash") > 0.5
    assert _score(lexicon, "put it in the trash can by the trash bin") < 0.1
    assert _score(lexicon, "le vequaire et le vequille") > 0.5
    assert _score(lexicon, None) == _score(lexicon, "") < 0.1
    assert _score(lexicon, "trash " + "fine words " * 5000) < _score(lexicon, "trash fine words")


def _labelled(spark, texts):
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(texts)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, (_, y) in enumerate(texts)] + [(None, 1), (9999, None), (9998, 0)], "doc_id long, toxic int")
    return docs, labels


def test_learned_stems(spark):
    rng = np.random.default_rng(1)
    word = lambda: "".join(rng.choice(list("abdeglmnorstu"), 6))
    rows = [(" ".join(word() for _ in range(30)) + (f" zorka{word()} {word()} zorka{word()}" if i % 4 == 0 else ""), int(i % 4 == 0)) for i in range(200)]
    docs, labels = _labelled(spark, rows)
    lexicon = toxicity.learn(toxicity.training_rows(docs, labels, "toxic"))
    assert any(e.startswith(" zork") for e in lexicon.weights)
    scored = toxicity.toxicity(docs, lexicon).collect()
    assert np.mean([r.predicted == rows[r.doc_id][1] for r in scored]) > 0.97
    fresh = [_score(lexicon, " ".join(word() for _ in range(20)) + tail) for tail in (" zorkaxx zorkaqq", "")]
    assert fresh[0] > 0.5 > fresh[1]


def test_rare_words_are_learned_in_large_tables(spark):
    """A word of 400 among 100,000 toxic texts, and of no clean one, is an entry."""
    rows = spark.range(200_000).selectExpr(
        "concat('text of river ', id % 50, if(id % 2 = 1, ' bogtrotter', ''), if(id % 500 = 1, ' zanybrute', '')) AS text", "CAST(id % 2 AS INT) AS label")
    lexicon = toxicity.learn(rows)
    assert {" zanybrute ", " bogtrotter "} <= set(lexicon.weights) and not {" text ", " river ", " of "} & set(lexicon.weights)


def test_exceptions_void_hits_like_a_plain_search():
    lexicon = toxicity.Lexicon({toxicity.fold("trash"): 3.0, toxicity.fold("rat"): 2.0, " idio": 4.0, toxicity.fold("pig"): 1.5})
    auto, rng = lexicon.automaton(), random.Random(6)
    words = ["trash", "can", "rat", "race", "lab", "idiot", "idiotic", "pig", "iron", "guinea", "taking", "out", "the", "clean"]
    for _ in range(300):
        text = " ".join(rng.choice(words) for _ in range(rng.randint(0, 25)))
        flat = toxicity.fold(text)
        void = [(m.start(), m.start() + len(toxicity.fold(p)) - 1) for p in toxicity.EXCEPTIONS for m in re.finditer(f"(?={re.escape(toxicity.fold(p))})", flat)]
        heavy = {}
        for e, w in lexicon.weights.items():
            for m in re.finditer(f"(?={re.escape(e)})", flat):
                if not any(a <= m.start() < b for a, b in void):
                    heavy[m.start()] = max(heavy.get(m.start(), 0.0), w)
        per = {}
        for at, w in sorted(heavy.items()):
            per.setdefault(flat[at + 1 :].split(" ")[0], []).append(w)
        want = sum(w[0] * (1 + math.log(len(w))) for w in per.values()) / math.log2(8 + flat.count(" ")) if text else 0.0
        assert abs(lexicon.raw(auto, text) - want) < 1e-9
    start = time.time()
    assert lexicon.raw(auto, "taking out the trash idiot " * 400_000) > 0  # 10 MB
    assert time.time() - start < 60


def test_toxicity_without_labels_and_on_awkward_rows(spark, awkward, none):
    docs, labels = _labelled(spark, [("plain words", 0)])
    lexicon = toxicity.learn(toxicity.training_rows(docs, labels.limit(0), "toxic"))
    rows = toxicity.toxicity(awkward, lexicon).collect()
    assert len(rows) == awkward.count() and all(0 <= r.score <= 1 and r.predicted == 0 for r in rows)
    assert toxicity.toxicity(none, lexicon).count() == 0
    kept = toxicity.drop_toxic(awkward, lexicon)
    assert kept.columns == awkward.columns and kept.count() == awkward.count()
    bad = spark.createDataFrame([(1, "you stupid worthless idiot, pathetic loser")], "doc_id long, text string")
    assert toxicity.drop_toxic(bad, lexicon).count() == 0


@pytest.mark.parametrize("query,label,cut", [("op3_toxicity", "toxic", 0.5), ("op5_quality", "quality", 0.3)])
def test_held_out_accuracy(spark, sf_dir, query, label, cut):
    rows = queries.QUERIES[query](spark, sf_dir.replace("sf0.001", "sf0.01")).collect()
    labels = {r.doc_id: r[label] for r in spark.read.parquet(f"{sf_dir.replace('sf0.001', 'sf0.01')}/labels.parquet").collect()}
    assert len(rows) == 1000
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == int(r.score >= cut) and 0 <= r.score <= 1
    hits = [r.predicted == labels[r.doc_id] for r in rows if r.held_out and labels.get(r.doc_id) is not None]
    assert np.mean(hits) > 0.9


def test_quality_on_awkward_rows(spark, awkward, none):
    x = quality.with_features(awkward, ["doc_id"])
    for labels in ([(0, 1), (1, 0), (2, 1), (101, 0)], [(0, 1)], []):
        known = spark.createDataFrame(labels, "doc_id long, label int").join(x, "doc_id").selectExpr("doc_id AS id", "_x AS x", "label")
        ranking = quality.learn(known, pairs=500)
        rows = quality.quality(x, ranking).collect()
        assert len(rows) == awkward.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    assert quality.quality(quality.with_features(none, ["doc_id"]), ranking).count() == 0


def test_quality_threshold_covers_all_rows(spark):
    """The sample fits the weights only: the threshold is the quantile over all labelled rows."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(3000, quality.N_FEATURES))
    label = (x[:, 0] + rng.normal(size=3000) > -0.5).astype(int)
    rows = spark.createDataFrame([(i, [float(v) for v in a], int(y)) for i, (a, y) in enumerate(zip(x, label))], "id long, x array<double>, label int")
    ranking = quality.learn(rows, limit=40, pairs=2000)
    assert abs(np.mean(ranking.raw(x) < ranking.threshold) - np.mean(label == 0)) < 1e-3


def test_column_score_is_the_array_score(spark, awkward):
    x = quality.with_features(awkward, ["doc_id"]).filter("doc_id IS NOT NULL")
    known = x.selectExpr("doc_id AS id", "_x AS x", "CAST(doc_id % 2 AS INT) AS label")
    ranking = quality.learn(known, pairs=2000)
    got = sorted((r.doc_id, r.score) for r in quality.quality(x, ranking).collect())
    want = sorted((r.doc_id, float(ranking.score(np.array([r._x]))[0])) for r in x.collect())
    assert [g[0] for g in got] == [w[0] for w in want] and np.allclose([g[1] for g in got], [w[1] for w in want], atol=1e-9)


def _brute_scores(train, texts):
    end, start = b"\n", b"\n\n"
    tokens = lambda t: (t or "").encode().lower().split() + [end]
    uni, tri = Counter(), Counter()
    for t in train:
        w = tokens(t)
        uni.update(w)
        tri.update(zip([start, start, *w][:len(w)], [start, *w[:-1]], w))
    n, v = sum(uni.values()), len(uni)
    of = lambda counts: (0, *kneser_ney.discounts(*[Counter(counts.values())[k] for k in (1, 2, 3, 4)]))
    bi = Counter((b, c) for _, b, c in tri)
    follows = Counter(c for _, c in bi)
    f, d, e = of(tri), of(bi), of(follows)
    contexts, wide = defaultdict(lambda: [0, 0, 0, 0]), defaultdict(lambda: [0, 0, 0, 0])
    for into, counts in ((contexts, {(b, c): k for (b, c), k in bi.items()}), (wide, tri)):
        for key, c in counts.items():
            of_key = into[key[0] if into is contexts else key[:2]]
            of_key[0] += c
            of_key[min(c, 3)] += 1
    rest = sum(e[min(c, 3)] for c in follows.values()) / len(bi) if bi else 1.0

    def chance(u, a, b):
        p = (max(follows[b] - e[min(follows[b], 3)], 0) / len(bi) if bi else 0) + rest / (v + 1)
        if a in contexts:
            x = contexts[a]
            p = p * sum(x[k] * d[k] for k in (1, 2, 3)) / x[0] + max(bi[a, b] - d[min(bi[a, b], 3)], 0) / x[0]
        if (u, a) in wide:
            x, c = wide[u, a], tri[u, a, b]
            p = p * sum(x[k] * f[k] for k in (1, 2, 3)) / x[0] + max(c - f[min(c, 3)], 0) / x[0]
        return p

    out = []
    for t in texts:
        w = tokens(t)
        out.append((len(w), sum(x in uni for x in w), n, sum(math.log10((uni[x] + 1) / (n + v + 1)) for x in w), sum(math.log10(chance(*g)) for g in zip([start, start, *w], [start, *w[:-1]], w))))
    total = [sum(chance(*g, b) for b in [*uni, b"unseen word"]) for g in list(wide)[:5]] if bi else []
    return out, total


def _same(rows, docs, train):
    want, total = _brute_scores(train, [t for _, t in docs])
    assert np.allclose(total, 1.0)
    key = lambda x: [str(x[0]), *[round(float(y), 6) for y in x[1:]]]
    got = sorted(key((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score)) for r in rows)
    wanted = sorted(key((i, *w)) for (i, _), w in zip(docs, want))
    assert [g[0] for g in got] == [w[0] for w in wanted]
    assert np.allclose([g[1:] for g in got], [w[1:] for w in wanted], rtol=1e-6, atol=1e-5)


def test_model_is_the_plain_formula(spark, awkward, none, corpus):
    docs = [(r.doc_id, r.text) for r in awkward.collect()]
    _same(kneser_ney.score(awkward, kneser_ney.train(awkward)).collect(), docs, [t for _, t in docs])
    half = awkward.filter("doc_id % 2 = 0")
    _same(kneser_ney.score(awkward, kneser_ney.train(half)).collect(), docs, [r.text for r in half.collect()])
    _same(kneser_ney.score(awkward, kneser_ney.train(none)).collect(), docs, [])
    assert kneser_ney.score(none, kneser_ney.train(half)).count() == 0


def test_model_beats_the_base(spark, sf_dir):
    rows = queries.QUERIES["op10_kneser_ney"](spark, sf_dir).collect()
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 7 == 2)
    held = [r for r in rows if r.held_out]
    assert held and sum(r.score for r in held) > sum(r.base_score for r in held)


def test_tables_of_the_model(tmp_path):
    """Sums by key, columns as they travel, and counts beyond 32 bits."""
    rng = np.random.default_rng(5)
    keys, values = rng.integers(0, 50, 400).astype(np.uint64), rng.integers(0, 9, (400, 2))
    found, at, sums = kneser_ney._summed(keys, values)
    assert found.tolist() == sorted(set(keys.tolist())) and (keys[at] == found).all()
    assert all((values[keys == k].sum(0) == s).all() for k, s in zip(found, sums))
    shard, columns = rng.integers(0, 4, 400), [keys.astype(np.int64), values[:, 0] + (1 << 33), np.arange(400)]
    got = {s: kneser_ney._unpacked([blob, blob], 3) for s, blob in kneser_ney._packed(shard, columns)}
    for s in range(4):
        assert all((g == np.tile(c[shard == s], 2)).all() for g, c in zip(got[s], columns))
    kneser_ney._save(str(tmp_path), "counts-0", kneser_ney._narrow(np.array([1, 1 << 40])))
    assert kneser_ney._open(str(tmp_path), "counts-0").tolist() == [1, 1 << 40]
    kneser_ney._save(str(tmp_path), "empty-0", kneser_ney._narrow(np.zeros(0, np.int64)))
    assert len(kneser_ney._open(str(tmp_path), "empty-0")) == 0 and len(kneser_ney._open(str(tmp_path), "none-0")) == 0
    some = np.array([0, 254, 255, 256, 1 << 40, 3])
    kneser_ney._save_counts(str(tmp_path), "many-0", some)
    assert kneser_ney._counts(str(tmp_path), "many-0", np.array([4, 0, 2, 1, 3, 5, 4])).tolist() == [1 << 40, 0, 255, 254, 256, 3, 1 << 40]
