"""Counts of pairs in the trigram model (operator 10)."""

import numpy as np
import pyarrow as pa

from cellweave.llm import kneser_ney


def test_rows_of_counts_are_kept_whole(tmp_path):
    rows = np.array([[1, 2, 0, 1, 0], [255, 255, 255, 255, 255], [1, 2, 0, 1, 0], [256, 1, 0, 0, 0], [0, 1 << 40, 3, 2, 1], [256, 1, 0, 0, 0], [0] * 5])
    kneser_ney._save_rows(str(tmp_path), "some", rows)
    at = np.array([4, 0, 6, 2, 5, 1, 3, 3])
    assert (kneser_ney._rows(str(tmp_path), "some", 5, at) == rows[at]).all()
    kneser_ney._save_rows(str(tmp_path), "none", rows[:0])
    assert kneser_ney._rows(str(tmp_path), "none", 5, at[:0]).shape == (0, 5)


def test_a_slice_looks_up_each_pair_once(spark, monkeypatch):
    texts = ["a b c a b d", "a b", "", "b a b c", None, "c"] * 3
    model = kneser_ney.train(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string"))
    opened, plain = [], kneser_ney._open
    monkeypatch.setattr(kneser_ney, "_open", lambda folder, name: opened.append(name) or plain(folder, name))
    model.score(pa.array(texts))
    assert model.shards == 1
    # keys, rows and places of the slice's pairs, and those of the two starts; twelve when pairs were looked up again as contexts
    assert 3 <= sum(name.startswith("pair") for name in opened) <= 6
