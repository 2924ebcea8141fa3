"""The queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import audio, bpe, decontaminate, language, neardup, neighbours, quality, secrets, sharding, spelling, toxicity, urlfilter, whitening


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.languages(_table(spark, sf_dir, "documents"))


def op2_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_spans(_table(spark, sf_dir, "documents"))


def _tokenizer() -> tuple[str, str]:
    """Place of the public rank file and the pattern that goes with it."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_digests(_table(spark, sf_dir, "documents"), *_tokenizer())


def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_table(spark, sf_dir, "documents"))


def op5_audio_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables hold no sound, so every vector of `embeddings` is played as one; ids divisible by 100 are looked up among all."""
    vectors = _table(spark, sf_dir, "embeddings")
    # A vector of a few hundred bytes becomes seconds of sound: far more tasks than the table has files.
    recordings = audio.sonify(vectors.repartition(16 * max(vectors.rdd.getNumPartitions(), 4)))
    return audio.align(recordings, vectors.where(F.col("vec_id") % 100 == 0).select(F.col("vec_id").alias("rec_id")))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks the hosts of the corpus of which much is junk, and those that have a label of games of chance."""
    pages = _table(spark, sf_dir, "pages")
    return urlfilter.judge_urls(pages, urlfilter.junk_hosts(pages).unionByName(urlfilter.listed_hosts(pages)))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.compact_documents(_table(spark, sf_dir, "documents"))


def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(_table(spark, sf_dir, "documents"))


def op12_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(_table(spark, sf_dir, "embeddings"))


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(_table(spark, sf_dir, "embeddings"))


QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_secret_scans": op2_secret_scans,
    "op3_byte_bpe": op3_byte_bpe,
    "op4_minhash_near_dedup": op4_minhash_near_dedup,
    "op5_audio_fingerprints": op5_audio_fingerprints,
    "op6_quality_classifier": op6_quality_classifier,
    "op7_url_filters": op7_url_filters,
    "op8_toxicity": op8_toxicity,
    "op9_sharding": op9_sharding,
    "op10_benchmark_decontamination": op10_benchmark_decontamination,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_nearest_neighbours": op12_nearest_neighbours,
    "op13_embedding_whitening": op13_embedding_whitening,
}

ORACLES: dict[str, str] = {"op7_url_filters": urlfilter.ORACLE, "op9_sharding": sharding.ORACLE}
