"""Readers of source trees and keyed sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# What is read for chunking, and folders that are not.
CODE_SUFFIXES = ["java", "ts", "html", "yml", "yaml", "properties", "sql"]
SKIPPED_FOLDERS = ["build", "digests", "node_modules", "target", "vector_db", "vscode-extension"]


def source_files(spark: SparkSession, root: str, suffixes: list[str] | None = None) -> DataFrame:
    """path, text of each file below root with one of the suffixes; hidden and generated folders are skipped."""
    kinds = "|".join(suffixes or CODE_SUFFIXES)
    files = spark.read.format("text").option("wholetext", True).option("recursiveFileLookup", True).load(root)
    files = files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    parts = F.split(F.regexp_replace("path", "^[a-z]+:/*", ""), "/")
    hidden = F.exists(parts, lambda p: F.startswith(p, F.lit(".")) & (p != ".") & (p != ".."))
    return files.where(F.rlike("path", F.lit(rf"\.({kinds})$")) & ~hidden & ~F.arrays_overlap(parts, F.array(*map(F.lit, SKIPPED_FOLDERS))))


def properties(files: DataFrame) -> DataFrame:
    """path, key, value of `key=value` and `key: value` lines; comments and blank lines are skipped."""
    lines = files.select("path", F.posexplode(F.split("text", r"\r?\n")).alias("no", "line"))
    found = lines.select("path", "no", F.regexp_extract("line", r"^\s*([^#!\s=:][^=:\s]*)\s*[=:]\s*(.*?)\s*$", 1).alias("key"), F.regexp_extract("line", r"^\s*([^#!\s=:][^=:\s]*)\s*[=:]\s*(.*?)\s*$", 2).alias("value"))
    return found.where("key <> ''").groupBy("path", "key").agg(F.max_by("value", "no").alias("value"))


def replace_partition(df: DataFrame, path: str, column: str) -> None:
    """Overwrite only those partitions of a stored table that df has rows of."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(column).parquet(path)
