"""Exact cosine search, merges of several searches, and hybrid ranking."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import query_words

# Boosts of hits by where they come from.
SOURCE_BOOST = {"digest": 1.5, "graph": 1.2}
TYPE_BOOST = {"method_call_graph": 1.0, "endpoint": 0.8, "bean": 0.6, "entity": 0.5, "feign": 0.5}


def _rows(df: DataFrame, key: str, vector: str) -> DataFrame:
    """Rows with a key and a direction: finite components, not all zero; of repeated keys the least vector."""
    v = F.col(vector).cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    good = df.where(F.col(key).isNotNull() & v.isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists(v, lambda x: x != 0))
    keep = [c for c in df.columns if c not in (key, vector)]
    return good.groupBy(key, *keep).agg(F.min(v).alias("v"))


def _tile(k: int):
    def run(_: tuple, q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(q) and len(c):
            ids, x = c["vec_id"].to_numpy(), np.stack(c["v"])
            x = x / np.linalg.norm(x, axis=1)[:, None]
            order = np.argsort(ids)
            ids, x = ids[order], x[order]
            for a in range(0, len(q), 512):
                part = q.iloc[a : a + 512]
                y = np.stack(part["v"])
                far = np.round(1 - (y / np.linalg.norm(y, axis=1)[:, None]) @ x.T, 6) + 0.0
                for name, own, row in zip(part["probe_id"].tolist(), part["own"].tolist(), far):
                    if own is not None:
                        row[ids == int(own)] = np.inf
                    near = np.flatnonzero(row <= np.partition(row, min(k, len(row)) - 1)[min(k, len(row)) - 1])
                    near = near[np.isfinite(row[near])]
                    near = near[np.argsort(row[near], kind="stable")][:k]  # ids are in order already
                    out += zip([name] * len(near), ids[near].tolist(), row[near].tolist())
        return pd.DataFrame(out, columns=["probe_id", "vec_id", "distance"])

    return run


def knn_cosine(vectors: DataFrame, probes: DataFrame, k: int, rows: int = 4096) -> DataFrame:
    """vectors(vec_id, embedding), probes(probe_id, probe) -> probe_id, rank, vec_id, distance (1 - cosine, six decimals).

    Each block of probes meets each block of vectors in one task, which keeps the k nearest of its own; these are ranked
    for each probe, ties by vec_id. A probe does not find the vector of its own id, or of the id in `own` where probes have
    that column. With a column `part` on both sides, a probe searches vectors of its part only. Vectors without
    direction take no part; others are searched among those of their length.
    """
    part = ["part"] if "part" in probes.columns else []
    kind = probes.schema["probe_id"].dataType
    own = F.col("own") if "own" in probes.columns else F.col("probe_id")
    v = _rows(vectors.select("vec_id", "embedding", *part), "vec_id", "embedding")
    q = _rows(probes.select(F.col("probe_id").cast("string").alias("probe_id"), own.cast("string").alias("own"), F.col("probe"), *part), "probe_id", "probe")
    many = lambda df: max(1, -(-df.count() // rows))
    cb, qb = many(vectors), many(probes)
    block = lambda key, n: F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
    v = v.select("*", F.size("v").alias("d"), block("vec_id", cb).alias("c"), F.explode(F.sequence(F.lit(0), F.lit(qb - 1))).alias("q"))
    q = q.select("*", F.size("v").alias("d"), F.explode(F.sequence(F.lit(0), F.lit(cb - 1))).alias("c"), block("probe_id", qb).alias("q"))
    tile = [*part, "d", "c", "q"]
    near = q.groupBy(*tile).cogroup(v.groupBy(*tile)).applyInPandas(_tile(k), "probe_id string, vec_id long, distance double")
    best = Window.partitionBy("probe_id").orderBy("distance", "vec_id")
    ranked = near.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select(F.col("probe_id").cast(kind).alias("probe_id"), "rank", "vec_id", "distance")


def merge_hits(hits: DataFrame, keep: int) -> DataFrame:
    """Of the hits of all probes, the nearest for each vector, then the nearest `keep` of all."""
    merged = hits.groupBy("vec_id").agg(F.min("distance").alias("distance"))
    return merged.orderBy("distance", "vec_id").limit(keep)


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of new replace those of old with the same key."""
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def hybrid_score(content: Column, source: Column, kind: Column, distance: Column, question: str | Column) -> Column:
    """Words of the question contained, plus boosts, plus nearness."""
    asked = question if isinstance(question, Column) else F.lit(question)
    words = F.size(F.filter(query_words(asked), lambda w: F.contains(F.lower(content), w)))
    score = words.cast("double")
    for column, boosts in ((source, SOURCE_BOOST), (kind, TYPE_BOOST)):
        part = F
        for k, v in boosts.items():
            part = part.when(column == k, v)
        score = score + part.otherwise(0.0)
    return F.round(score + F.greatest(F.lit(0.0), 1 - distance), 6)
