"""The corpus operators as queries over the given tables, with their production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import oracles
from .common import table
from .decontamination import contamination
from .katz import katz_scores
from .language import identify_language
from .linededup import dedup_lines
from .merkle import manifest
from .neardup import near_duplicates
from .neighbours import nearest
from .packing import pack_documents
from .quality import score_quality
from .repeats import remove_repeats
from .sharding import shard
from .toxicity import score_toxicity
from .whitening import whiten

Query = Callable[[SparkSession, str], DataFrame]


def tokenizer_path() -> str:
    """Where the public vocabulary lies; workers read the same installed package."""
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), tokenizer_path())


def op4_katz_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz_scores(table(spark, sf_dir, "documents"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_language(table(spark, sf_dir, "documents"))


def op8_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_block_matrix_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))


def op12_quality_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Query]:
    return {k: v for k, v in globals().items() if k.startswith("op") and k[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    return {"op1_minhash_near_dedup": oracles.NEAR_DUPLICATES, "op2_benchmark_decontamination": oracles.CONTAMINATION, "op5_line_dedup": oracles.LINES, "op8_suffix_array_dedup": oracles.REPEATS, "op10_block_matrix_neighbours": oracles.NEIGHBOURS, "op13_merkle_manifest": oracles.MANIFEST}
