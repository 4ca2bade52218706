"""Stages of the corpus pipeline: (spark, docs, sf_dir) -> documents, or pieces for the last."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, row_key, stage, table
from .decontamination import contamination_rows
from .linededup import dedup_lines
from .neardup import near_duplicate_rows
from .packing import pack_documents
from .toxicity import toxicity_rows


def _marked(docs: DataFrame, rows: DataFrame, how: str) -> DataFrame:
    """The documents that rows(doc_id, th) names, or the others; null ids are compared like any other."""
    rows = rows.select(row_key(F.col("doc_id")).alias("__d"), F.col("th").alias("__th")).distinct()
    return docs.withColumns({"__d": row_key(F.col("doc_id")), "__th": F.xxhash64("text")}).join(rows, ["__d", "__th"], how)


@stage
def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity is predicted 1 go; all others stay as they are."""
    judged = toxicity_rows(docs, table(spark, sf_dir, "labels"))
    return _marked(docs, judged.where("predicted = 1"), "left_anti").select(*docs.columns)


@stage
def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that match an earlier line go, and documents that have no word left because of it; n_chars follows the
    text. Documents that lose no line stay as they are, blank ones among them."""
    out = dedup_lines(docs)
    out = out.where((F.col("n_lines_removed") == 0) | F.rlike("text", F.lit(r"[^\x20\x09-\x0D]")))
    if "n_chars" in docs.columns:
        changed = F.col("n_lines_removed") > 0
        out = out.withColumn("n_chars", F.when(changed, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


@stage
def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays: the one with the smallest doc_id (null ids last), one row of those
    with its id and text. Documents without words all stay."""
    kept = cut(near_duplicate_rows(docs).where("kept").select("doc_id", "th", "n_shingles"), "kept")
    once = _marked(docs, kept.where("n_shingles > 0"), "left_semi").dropDuplicates(["__d", "__th"])
    return once.unionByName(_marked(docs, kept.where("n_shingles = 0"), "left_semi")).select(*docs.columns)


@stage
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without contamination stay, whole."""
    found = contamination_rows(docs, table(spark, sf_dir, "benchmark"))
    return _marked(docs, found.where("contaminated"), "left_anti").select(*docs.columns)


@stage
def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    from .queries import tokenizer_path

    return pack_documents(docs, tokenizer_path())
