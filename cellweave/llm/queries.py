"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave.llm import kneser_ney, lattice, manifest, mixing, packing, quality, secrets, sharding, simhash, token_counts, toxicity, whitening, winnow
from cellweave.llm.common import crc_bucket, table
from cellweave.llm.sql import ORACLES  # noqa: F401
from cellweave.session import cut_lineage

BPE = "byte_bpe_50k.json"


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "copies")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path(BPE))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    taught = docs.filter(crc_bucket(F.col("doc_id"), 5) != 0)
    lexicon = toxicity.learn(toxicity.training_rows(taught, table(spark, sf_dir, "labels"), "toxic"))
    scored = toxicity.toxicity(docs, lexicon)
    return scored.select("doc_id", (crc_bucket(F.col("doc_id"), 5) == 0).alias("held_out"), "score", "predicted")


def op4_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.fingerprint_components(table(spark, sf_dir, "documents"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = crc_bucket(F.col("doc_id"), 5) == 0
    featured = cut_lineage(quality.with_features(table(spark, sf_dir, "documents"), ["doc_id"]))
    labels = table(spark, sf_dir, "labels").filter(~held_out).select("doc_id", F.col("quality").alias("label"))
    ranking = quality.learn(featured.join(labels, "doc_id").select(F.col("doc_id").alias("id"), F.col("_x").alias("x"), "label"))
    scored = quality.quality(featured, ranking)
    return scored.select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op6_curve_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path(BPE))


def op7_secret_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_report(table(spark, sf_dir, "documents"))


def op8_lattice_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.near_vectors(table(spark, sf_dir, "embeddings"))


def op9_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnow.edit_report(table(spark, sf_dir, "documents"))


def op10_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = crc_bucket(F.col("doc_id"), 7) == 2
    scored = kneser_ney.score(docs, kneser_ney.train(docs.filter(~held_out)))
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    models = whitening.fit(vectors)
    return whitening.component_rows(whitening.whiten(vectors, models), models)


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    found = {"n_chars": F.when(tampered, F.col("n_chars") + 1).otherwise(F.col("n_chars"))}
    return manifest.audit(manifest.build(table(spark, sf_dir, "documents"), seen=found))


def op13_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shards(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_mix_sources, op2_token_counts, op3_toxicity, op4_simhash_components, op5_quality,
        op6_curve_packing, op7_secret_spans, op8_lattice_links, op9_winnowing, op10_kneser_ney,
        op11_whitening, op12_merkle_manifest, op13_hilbert_shards,
    )
}

