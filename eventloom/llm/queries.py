"""The registered queries of this subpackage: each applies an operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, cells, kdtree, language, middle, packing, pii, repetition, secrets, simhash, substrings, toxicity, urls
from .oracles import ORACLES


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_pii(spark: SparkSession, folder: str) -> DataFrame:
    return pii.personal_data(_table(spark, folder, "documents"))


def op2_bpe(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    return bpe.round_trip_digests(_table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op3_secrets(spark: SparkSession, folder: str) -> DataFrame:
    return secrets.secrets(_table(spark, folder, "documents"))


def op4_urls(spark: SparkSession, folder: str) -> DataFrame:
    return urls.judged(_table(spark, folder, "pages"))


def op5_packing(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    return packing.packed(_table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op6_topk(spark: SparkSession, folder: str) -> DataFrame:
    vectors = _table(spark, folder, "embeddings")
    return kdtree.top_k(vectors, vectors.where("vec_id % 50 = 0"))


def op7_quality(spark: SparkSession, folder: str) -> DataFrame:
    return repetition.repetition_rules(_table(spark, folder, "documents"))


def op8_substrings(spark: SparkSession, folder: str) -> DataFrame:
    return substrings.repeated_windows(_table(spark, folder, "documents"))


def op9_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, folder, "documents"))


def op10_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.toxicity(_table(spark, folder, "documents"), _table(spark, folder, "labels"))


def op11_centroids(spark: SparkSession, folder: str) -> DataFrame:
    return cells.with_inertia(cells.clustered(_table(spark, folder, "embeddings")))


def op12_middle(spark: SparkSession, folder: str) -> DataFrame:
    return middle.cut_digests(_table(spark, folder, "documents"))


def op13_language(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    return language.language(_table(spark, folder, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def pipeline(spark: SparkSession, folder: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, folder)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_pii, op2_bpe, op3_secrets, op4_urls, op5_packing, op6_topk, op7_quality, op8_substrings, op9_simhash, op10_toxicity, op11_centroids, op12_middle, op13_language, pipeline)
}
ORACLE_SQL: dict[str, str] = ORACLES
