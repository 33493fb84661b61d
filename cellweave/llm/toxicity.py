"""Toxicity by a weighted lexicon, matched with Aho-Corasick on folded texts (operator 3)."""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweave.llm.common import column, per_process, slices
from cellweave.session import cut_lineage

# Letters of other scripts that look like Latin ones, and signs and digits used in their place
HOMOGLYPHS = (
    "аa еe оo рp сc уy хx кk мm тt нh вb іi јj ѕs ԁd ɡg ӏi αa βb εe ηn ιi κk νv οo ρp τt υu χx "
    "0o 1i 3e 4a 5s 7t 8b 9g"
).split()
# Signs that stand for a letter when a letter or digit follows
SIGNS = {"@": "a", "$": "s", "!": "i", "|": "i", "+": "t"}
# Common insults, a prior for corpora with few labels
INSULTS = (
    "idiot moron stupid scum loser pathetic worthless disgusting trash clown dumb fool imbecile cretin filthy vermin ugly "
    "jerk bastard pervert freak garbage coward pig rat dimwit halfwit nitwit retard savage subhuman parasite degenerate"
).split()
# Harmless phrases with words of the list
EXCEPTIONS = (
    "trash can", "trash bin", "trash bag", "trash collection", "taking out the trash", "clown fish", "circus clown", "class clown", "guinea pig", "pig iron",
    "lab rat", "rat race", "pathetic fallacy", "sore loser", "garbage collection", "garbage collector", "garbage can", "garbage truck", "ugly duckling", "jerk chicken", "dumb terminal", "dumb luck",
)

PREFIXES = (4, 5, 6, 7, 8, 9)
BINS = 2048


def _table() -> dict[int, str]:
    fold = {code: chr(code).lower() for code in range(0x2000) if chr(code).lower() != chr(code)}
    for code in (*range(0x370, 0x530), *range(0xFF01, 0xFF5F)):  # Greek and Cyrillic, full-width forms
        fold[code] = unicodedata.normalize("NFKC", chr(code)).lower()
    for pair in HOMOGLYPHS:
        fold[ord(pair[0])] = fold[ord(pair[0].upper()[0])] = fold[ord(pair[0]) + 0xFEE0 if ord(pair[0]) < 127 else ord(pair[0])] = pair[1]
    for code in (0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF):
        fold[code] = ""
    return fold


def fold(text: str) -> str:
    """Lower case, composed, without invisible signs, look-alikes and digit substitutions replaced; `` w w w ``."""
    flat = unicodedata.normalize("NFC", text).translate(per_process("toxicity fold", _table))
    flat = per_process("toxicity sign", lambda: re.compile(r"[@$!|+](?=[^\W_])")).sub(lambda m: SIGNS[m[0]], flat)
    return " " + " ".join(per_process("toxicity word", lambda: re.compile(r"[^\W_]+")).findall(flat)) + " "


def entries(folded: str) -> set[str]:
    """Candidates of a folded text: its words (`` word ``) and the beginnings of longer ones (`` wor``)."""
    out = set()
    for w in set(folded.split()):
        out.add(f" {w} ")
        for n in PREFIXES:
            if len(w) > n:
                out.add(f" {w[:n]}")
    return out


def _outside(found: dict[int, float], void: list[tuple[int, int]]) -> dict[int, float]:
    """The hits that begin in none of the half-open spans ``void``: one sweep over both, sorted."""
    kept, spans, reach, k = {}, sorted(void), -1, 0
    for at in sorted(found):
        while k < len(spans) and spans[k][0] <= at:
            reach, k = max(reach, spans[k][1]), k + 1
        if at >= reach:
            kept[at] = found[at]
    return kept


@dataclass
class Lexicon:
    weights: dict[str, float]
    exceptions: tuple[str, ...] = EXCEPTIONS
    slope: float = 1.0
    offset: float = 0.0

    def automaton(self):
        auto = ahocorasick.Automaton()
        for word, weight in self.weights.items():
            auto.add_word(word, (len(word), weight))
        for phrase in self.exceptions:
            auto.add_word(fold(phrase), (len(fold(phrase)), None))
        auto.make_automaton()
        return auto

    def raw(self, auto, text: str | None) -> float:
        """Sum of log-damped entry weights over the logarithm of the length; hits inside an exception are void."""
        if not text:
            return 0.0
        flat = fold(text)
        void: list[tuple[int, int]] = []
        found: dict[int, float] = {}  # of the entries that begin at a word, the heaviest
        for end, (n, weight) in auto.iter(flat):
            if weight is None:
                void.append((end - n + 1, end))
            else:
                found[end - n + 1] = max(found.get(end - n + 1, 0.0), weight)
        if void:
            found = _outside(found, void)
        words: dict[str, list[float]] = {}
        for at, weight in found.items():
            words.setdefault(flat[at + 1 : flat.index(" ", at + 1)], []).append(weight)
        return sum(w[0] * (1 + math.log(len(w))) for w in words.values()) / math.log2(8 + flat.count(" "))

    def score(self, raw: float) -> float:
        return 1 / (1 + math.exp(-max(min(self.slope * raw + self.offset, 30.0), -30.0)))


def training_rows(docs: DataFrame, labels: DataFrame, label_col: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Written table (text, label) of the labelled rows, each text and label once.

    Repeats are found on hashes (XXH64 under two seeds), so texts are shuffled once, for the join that fetches them.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    known = labels.filter(F.col(label_col).isin(0, 1)).select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("label"))
    keyed = docs.select(F.col(id_col).alias("_id"), F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(1), text).alias("h2")).join(known, "_id")
    ids = keyed.groupBy("h1", "h2", "label").agg(F.min("_id").alias("_id")).select("_id", "label").distinct()
    return cut_lineage(docs.select(F.col(id_col).alias("_id"), text.alias("text")).join(ids, "_id").select("text", "label"))


def _document_frequency(rows: DataFrame) -> DataFrame:
    """(entry, bad, good): in how many toxic and clean texts an entry occurs. Counted per task first, one scan."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: tuple[Counter[str], Counter[str]] = (Counter(), Counter())

        def sent() -> Iterator[pa.RecordBatch]:
            for label, found in enumerate(counts):
                n, none = pa.array(found.values(), pa.int64()), pa.array(np.zeros(len(found), np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), *([n, none] if label else [none, n])], ["entry", "bad", "good"])
                found.clear()

        for batch in batches:
            for text, label in zip(column(batch, "text").to_pylist(), column(batch, "label").to_pylist()):
                counts[label].update(entries(fold(text)))
                if len(counts[label]) > 300_000:
                    yield from sent()
        yield from sent()

    return rows.select("text", "label").mapInArrow(run, "entry string, bad long, good long").groupBy("entry").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))


def _specific(bad: dict[str, float], nearly: float = 0.8) -> dict[str, float]:
    """Without beginnings that one longer entry accounts for nearly alone."""
    best: dict[str, float] = {}
    for e, n in bad.items():
        for k in PREFIXES:
            if len(e) > k + 1:
                best[e[: k + 1]] = max(best.get(e[: k + 1], 0.0), n)
    return {e: n for e, n in bad.items() if e.endswith(" ") or best.get(e, 0.0) < nearly * n}


def learn(rows: DataFrame, least_weight: float = 2.5, least_count: int = 3, prior: float = 2.0) -> Lexicon:
    """A lexicon from all rows of :func:`training_rows`: smoothed log-odds of words and word beginnings, calibrated.

    Entries are counted and weighed in Spark; an entry is taken if it occurs in ``least_count`` toxic texts and weighs
    ``least_weight`` or more, at every size of the corpus. Only such entries come to the driver. Known insults count as
    seen in ``prior`` toxic texts. Without labels only the known insults remain.
    """
    sizes = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    odds = math.log(max(sizes.get(1, 0), 4) / max(sizes.get(0, 0), 4))
    known = {fold(word) for word in INSULTS}  # stay unless the labels speak against them
    heavy = F.log((F.col("bad") + 0.25) / (F.col("good") + 0.25)) - odds >= least_weight
    counts = _document_frequency(rows).filter((F.col("bad") >= least_count) & heavy | F.col("entry").isin(sorted(known))).collect()
    bad, good = {r["entry"]: float(r["bad"]) for r in counts}, {r["entry"]: r["good"] for r in counts}
    for word in known:
        bad[word] = bad.get(word, 0.0) + prior
    weights = {e: min(math.log((b + 0.25) / (good.get(e, 0) + 0.25)) - odds, 8.0) for e, b in _specific(bad).items()}
    lexicon = Lexicon({e: w for e, w in weights.items() if w >= least_weight or e in known and w > 0})
    lexicon.slope, lexicon.offset = _calibrate(lexicon, rows, "text", "label")
    return lexicon


def _calibrate(lexicon: Lexicon, labelled: DataFrame, text_col: str, label_col: str) -> tuple[float, float]:
    """Logistic curve over a histogram of raw scores (a fixed number of bins, all labelled rows)."""
    bins = (
        raw_scores(labelled, lexicon, [label_col], text_col)
        .groupBy(F.least(F.floor(F.col("raw") * 64), F.lit(BINS)).alias("bin"), label_col).agg(F.count("*").alias("n")).collect()
    )
    x = np.array([(r["bin"] + 0.5) / 64 if r["bin"] else 0.0 for r in bins] + [0.0, 4.0])
    y = np.array([float(r[label_col]) for r in bins] + [0.0, 1.0])
    n = np.array([float(r["n"]) for r in bins] + [2.0, 2.0])
    design, beta = np.stack([x, np.ones_like(x)], 1), np.array([2.0, -2.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        gradient = design.T @ (n * (y - p)) - 1e-3 * beta
        step = np.linalg.solve((design * (n * p * (1 - p))[:, None]).T @ design + 1e-3 * np.eye(2), gradient)
        beta = beta + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return (float(beta[0]), float(beta[1])) if beta[0] > 0 else (2.0, -2.0)


def raw_scores(docs: DataFrame, lexicon: Lexicon, kept: list[str], text_col: str = "text", raw_col: str = "raw") -> DataFrame:
    """The columns ``kept`` of every row and their raw score."""
    weights, exceptions = lexicon.weights, lexicon.exceptions

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Lexicon(weights, exceptions)
        auto = own.automaton()
        for batch in slices(batches, text_col):
            raw = [own.raw(auto, t) for t in column(batch, text_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([*[column(batch, c) for c in kept], pa.array(raw, pa.float64())], [*kept, raw_col])

    schema = ", ".join([*[f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept], f"`{raw_col}` double"])
    return docs.select(*kept, *[text_col][: text_col not in kept]).mapInArrow(run, schema)


def drop_toxic(docs: DataFrame, lexicon: Lexicon, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that score below 0.5, with their columns. Null and empty texts stay."""
    raw = "raw"
    while raw in docs.columns:
        raw += "_"
    scored = raw_scores(docs, lexicon, docs.columns, text_col, raw)
    return scored.filter(lexicon.slope * F.col(raw) + lexicon.offset < 0).select(*docs.columns)


def toxicity(docs: DataFrame, lexicon: Lexicon, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, ``score`` (0 to 1) and ``predicted`` (1 from 0.5 on).

    Null and empty texts have no hits and the lowest score. Repeated rows and null ids stay rows of their own; other
    columns are not read. The lexicon goes to the tasks with the code.
    """
    slope, offset = lexicon.slope, lexicon.offset
    z = F.greatest(F.least(F.lit(slope) * F.col("raw") + F.lit(offset), F.lit(30.0)), F.lit(-30.0))
    scored = raw_scores(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")), lexicon, ["_id"], "_text")
    return scored.select(F.col("_id").alias(id_col), (1 / (1 + F.exp(-z))).alias("score")).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
