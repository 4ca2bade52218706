"""Joins that take the first match of several rules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def first_match(tiers: list[DataFrame], key: str, order: list[str]) -> DataFrame:
    """Of each key's rows over all tiers, the one of the earliest tier and the first in order; adds `tier` from 0."""
    tagged = reduce(DataFrame.unionByName, [t.withColumn("tier", F.lit(i)) for i, t in enumerate(tiers)])
    best = Window.partitionBy(key).orderBy("tier", *order)
    return tagged.withColumn("_rn", F.row_number().over(best)).where("_rn = 1").drop("_rn")


def path_suffixes(path: str) -> str:
    """SQL for all suffixes of a path that start at one of its slashes: a suffix test then is an equality."""
    return f"transform(sequence(1, size(split({path}, '/')) - 1), i -> concat('/', array_join(slice(split({path}, '/'), i + 1, size(split({path}, '/'))), '/')))"


def suffix_join(calls: DataFrame, endpoints: DataFrame) -> DataFrame:
    """calls(call_id, path) with endpoints(endpoint_id, path): equal, or one a whole-segment suffix of the other; each
    call's first endpoint by id. Suffixes are exploded, so both tests are hash joins, not a product; only the first endpoint
    of a path, and of all paths that end alike, can win, so no more than these are joined, with each call path once."""
    first = F.min(F.struct("endpoint_id", "epath")).alias("e")
    right = endpoints.groupBy(F.col("path").alias("epath")).agg(F.min(F.struct("endpoint_id")).alias("x")).select("epath", "x.endpoint_id")
    ends = right.select("endpoint_id", "epath", F.explode(F.expr(path_suffixes("epath"))).alias("k")).groupBy("k").agg(first)
    left = calls.select(F.col("path").alias("cpath")).distinct()
    a = left.withColumn("k", F.explode(F.expr(path_suffixes("cpath")))).join(right.select(F.col("epath").alias("k"), F.struct("endpoint_id", "epath").alias("e")), "k").select("cpath", "e")
    b = left.join(ends, F.col("k") == F.col("cpath")).select("cpath", "e")
    tier = F.when(F.col("cpath") == F.col("e.epath"), 0).otherwise(1).alias("tier")
    best = a.unionByName(b).groupBy("cpath").agg(F.min(F.struct(tier, "e")).alias("x"))
    found = calls.select("call_id", F.col("path").alias("cpath")).join(best, "cpath").groupBy("call_id").agg(F.min(F.struct("x", "cpath")).alias("m"))
    return found.select("call_id", "m.cpath", "m.x.e.endpoint_id", "m.x.e.epath")


def substring_join(texts: DataFrame, needles: DataFrame) -> DataFrame:
    """texts(doc_id, text) that contain a needle(item_id, needle): (doc_id, item_id).

    Candidates share the needle's first three words; each text gives its distinct word triples once, so this is a hash
    join, and containment decides. Needles of fewer words meet every text.
    """
    words = F.expr("filter(split(needle, '[ \\n]+'), w -> w <> '')")
    sized = needles.select("item_id", "needle", words.alias("w")).where("needle <> ''")
    inner = sized.where("size(w) > 4").select("item_id", "needle", F.expr("array_join(slice(w, 2, 3), ' ')").alias("k"))
    few = sized.where("size(w) <= 4").select("item_id", "needle")
    split = texts.select("doc_id", "text", F.expr("filter(split(text, '[ \\n]+'), w -> w <> '')").alias("w")).where("size(w) > 2")
    triples = split.select("doc_id", F.explode(F.array_distinct(F.expr("transform(sequence(1, size(w) - 2), i -> array_join(slice(w, i, 3), ' '))"))).alias("k"))
    pairs = triples.join(inner, "k").select("doc_id", "item_id", "needle").distinct()
    sure = texts.select("doc_id", "text").join(pairs, "doc_id").where(F.contains("text", F.col("needle")))
    short = texts.select("doc_id", "text").join(few, F.contains("text", F.col("needle")))
    return sure.select("doc_id", "item_id").unionByName(short.select("doc_id", "item_id"))
