"""Small tables with every awkward case: nulls, empty and very long texts, ties, repeated rows, clashing column names."""

import random

import pytest

WORDS = "the of and river stone bridge lantern quiet copper maple window harbour thread silver orchard".split()
LONG = " ".join(WORDS[i * 7 % 15] + str(i % 101) for i in range(30_000))
EXTRA = "key long, size long, fp string, num long, raw double, id long, ids string, bucket int, part int, h long, label int, vec string, _x int, _row int, _text string"


def texts(n=60, seed=5):
    rng = random.Random(seed)
    return [" ".join(rng.choice(WORDS) + rng.choice(["", ".", ",", str(rng.randint(0, 40))]) for _ in range(rng.randint(1, 120))) for _ in range(n)]


@pytest.fixture(scope="session")
def awkward(spark):
    """documents with extra columns whose names the operators use inside."""
    rows = [(i, t, "en", f"src{i % 5}", len(t)) for i, t in enumerate(texts())]
    rows += [(100, None, None, None, None), (101, "", "en", "src0", 0), (102, " \t\n\x0b ", "en", "src1", 5), (None, "no id at all here", "en", "src1", 17), (None, None, None, None, None)]
    rows += [(103, LONG, "en", "src2", len(LONG)), (104, LONG, "en", "src2", len(LONG)), (105, "É ü 日本 語 　 😀", "xx", "src3", 12)]
    rows += [(0, rows[0][1], "en", "src0", rows[0][4])] * 2 + [(106 + i, rows[1][1], "en", "src4", rows[1][4]) for i in range(4)]
    filler = (7, 7, "x", 7, 7.0, 7, "x", 7, 7, 7, 7, "x", 7, 7, "x")
    return spark.createDataFrame([r + filler for r in rows], f"doc_id long, text string, lang string, source string, n_chars long, {EXTRA}").repartition(3).cache()


@pytest.fixture(scope="session")
def none(awkward):
    return awkward.limit(0)


@pytest.fixture(scope="session")
def corpus(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
