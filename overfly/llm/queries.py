"""The registered queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, collocations, langcrf, merkle, minhash, mixing, quality, rangejoin, sharding, substring, tokencount, toxicity
from .common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_convolutional_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.predict(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_seed_and_extend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.digests(table(spark, sf_dir, "documents"))


def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op4_one_bit_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return ann.nearest(rows, rows.filter(F.col("vec_id") % 50 == 0), k=5)


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op5_forced_boundary_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), vocabulary())


def op6_hilbert_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


def op7_pivot_range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rangejoin.near_vectors(table(spark, sf_dir, "embeddings"))


def op8_boosted_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.predict(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_language_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langcrf.predict(table(spark, sf_dir, "documents"))


def op10_systematic_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(table(spark, sf_dir, "documents"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.verify_documents(table(spark, sf_dir, "documents"))


def op12_pretoken_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.limits(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op13_phrase_bitmaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Query]:
    out = {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}
    out["pipeline"] = lambda spark, sf_dir: import_module("corpus_pipeline").run(spark, sf_dir)
    return out


def oracle_sql() -> dict[str, str]:
    return {
        "op2_seed_and_extend": substring.ORACLE, "op3_minhash": minhash.ORACLE, "op7_pivot_range_join": rangejoin.ORACLE,
        "op10_systematic_mixing": mixing.ORACLE, "op11_merkle_manifest": merkle.ORACLE, "op13_phrase_bitmaps": collocations.ORACLE,
    }
