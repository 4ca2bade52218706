"""Sessions, gathered context and its checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import is_empty_result, truncated


def recent_turns(messages: DataFrame, exchanges: int) -> DataFrame:
    """messages(conv_id, turn, role, text): the last 2 * exchanges of user and assistant in each conversation."""
    last = Window.partitionBy("conv_id").orderBy(F.desc("turn"), F.desc("role"))
    said = messages.where(F.col("role").isin("user", "assistant"))
    return said.withColumn("rn", F.row_number().over(last)).where(F.col("rn") <= 2 * exchanges).select("conv_id", "turn", "role", F.when((F.col("role") == "assistant") & (F.length("text") > 400), F.concat(F.substring("text", 1, 400), F.lit("…"))).otherwise(F.col("text")).alias("text"))


def segment_dedup(docs: DataFrame, separator: str = "\n", fingerprint: int = 200) -> DataFrame:
    """docs(doc_id, text) -> doc_id, seg: segments whose first characters have not occurred before, in order of
    (doc_id, seg). The first occurrence is a minimum, so a frequent segment is pre-aggregated, not gathered."""
    segs = docs.select("doc_id", F.posexplode(F.split("text", separator)).alias("seg", "s"))
    keyed = segs.select(F.substring(F.trim("s"), 1, fingerprint).alias("fp"), F.struct("doc_id", "seg").alias("at")).where("fp <> ''")
    return keyed.groupBy("fp").agg(F.min("at").alias("at")).select("at.doc_id", "at.seg")


def assemble(results: DataFrame, structural: list[str]) -> DataFrame:
    """results(conv_id, turn, role, text) -> conv_id, context: truncated results, structural roles first."""
    rank = F.when(F.col("role").isin(structural), 0).otherwise(1)
    block = F.concat(F.lit("["), F.col("role"), F.lit("] "), truncated(F.col("text")))
    listed = F.array_sort(F.collect_list(F.struct(rank.alias("r"), "turn", block.alias("b"))))
    return results.groupBy("conv_id").agg(F.concat_ws("\n\n", F.transform(listed, lambda x: x["b"])).alias("context"))


def context_flags(results: DataFrame, structural: list[str], least: int = 200, signal: int = 120) -> DataFrame:
    """conv_id, thin, structural_hit: too little useful text; some structural result longer than `signal`."""
    useful = F.when(is_empty_result(F.col("text")), 0).otherwise(F.length("text"))
    hit = F.col("role").isin(structural) & (F.length(F.trim("text")) > signal)
    return results.groupBy("conv_id").agg((F.sum(useful) < least).alias("thin"), F.bool_or(hit).alias("structural_hit"))


def evict_sessions(events: DataFrame, ttl_minutes: int = 120, most: int = 200) -> DataFrame:
    """events(user_id, ts) -> user_id, last_active: sessions no older than the ttl at the last event, newest `most`."""
    last = events.groupBy("user_id").agg(F.max("ts").alias("last_active"))
    now = events.agg(F.max("ts").alias("now"))  # one row
    live = last.join(F.broadcast(now), F.expr(f"last_active >= now - interval {ttl_minutes} minutes"))
    return live.orderBy(F.desc("last_active"), "user_id").limit(most).select("user_id", "last_active")
