"""Exact nearest neighbours by a block matrix join with int8 product tiles.

Vectors are dealt over blocks by a hash of their id; each query block meets each candidate block in one task. Blocks
travel as int8 rows with a scale and the norm of what the scaling leaves out, which bounds the error of each product, so
every pair that might be among a query's nearest survives. Candidate blocks are taken in rounds, each as many as all
before it: what a query has found so far bounds what the next tiles pass on, so its survivors grow with the number of
rounds, not of tiles. Survivors are held against each other by their bounds, and what is left is recomputed in double
precision on the original vectors, and merged.

Of equal vectors only the k + 1 of smallest id are candidates: the others lose every tie, whoever asks.

Vectors that are null, zero, or hold null or non-finite components take no part; the others are searched among those of
their own length; rows of one vec_id are one vector, the least of them; an empty table gives no rows; equal scores go to
the smaller vec_id. A task holds two blocks of about `ROWS` vectors, an eighth of their size as doubles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut

ROWS = 4096
#: Queries of a block that are multiplied at once, and components whose int8 products single precision sums exactly.
STRIP, EXACT = 512, 1024


def usable(v: Column) -> Column:
    """A vector that takes part: finite components, not all zero."""
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return v.isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists(v, lambda x: x != 0)


def int8_rows(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows as int8 values, their scale, and the norm left out."""
    scale = np.abs(x).max(axis=1) / 127
    q = np.rint(x / scale[:, None])
    return q.astype(np.int8), scale, np.linalg.norm(x - q * scale[:, None], axis=1)


def rounds(blocks: int) -> list[tuple[int, int]]:
    """Ranges of blocks, from and up to: the first alone, then each range as long as all before it."""
    out, end = [], 0
    while end < blocks:
        out.append((end, min(max(2 * end, 1), blocks)))
        end = out[-1][1]
    return out


def _pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        for _, g in f.groupby(f["v"].map(len)):
            x = np.stack(g["v"])
            q, scale, left = int8_rows(x)
            yield pd.DataFrame({"vec_id": g["vec_id"], "cand": g["cand"], "size": x.shape[1], "q8": [r.tobytes() for r in q], "scale": scale, "left": left, "norm": np.linalg.norm(x, axis=1)})


def products(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Inner products of int8 rows; sums of `EXACT` products are exact in single precision."""
    out = np.zeros((len(x), len(c)))
    for at in range(0, x.shape[1], EXACT):
        out += x[:, at : at + EXACT].astype(np.float32) @ c[:, at : at + EXACT].astype(np.float32).T
    return out


def tile(q: pd.DataFrame, c: pd.DataFrame, k: int) -> pd.DataFrame:
    """(query_id, vec_id, low, high): pairs of this tile that may be among a query's k nearest, and their bounds.

    floor, where a query has one, is a score that k candidates of other tiles reach."""
    found = []
    c8 = np.frombuffer(b"".join(c["q8"]), np.int8).reshape(len(c), -1)
    ci, cs, ce, cn = (c[x].to_numpy() for x in ("vec_id", "scale", "left", "norm"))
    for at in range(0, len(q), STRIP):
        x = q.iloc[at : at + STRIP]
        x8 = np.frombuffer(b"".join(x["q8"]), np.int8).reshape(len(x), -1)
        xi, xs, xe, xn = (x[n].to_numpy()[:, None] for n in ("vec_id", "scale", "left", "norm"))
        near = products(x8, c8) * xs * cs
        # what the scaling leaves out, and the rounding of sums in double precision
        bound = xn * ce + xe * (cn + ce) + 1e-9 * (xn * cn)
        own = xi == ci
        low = np.where(own, -np.inf, near - bound)
        kth = np.partition(low, -k, axis=1)[:, -k] if low.shape[1] > k else np.full(len(x), -np.inf)
        kth = np.fmax(kth, x["floor"].to_numpy(float))
        i, j = np.nonzero((near + bound >= kth[:, None]) & ~own)
        found.append(pd.DataFrame({"query_id": xi[i, 0], "vec_id": ci[j], "low": low[i, j], "high": (near + bound)[i, j]}))
    return pd.concat(found)


def nearest(vectors: DataFrame, every: int = 20, k: int = 20, rows: int = ROWS) -> DataFrame:
    """vectors(vec_id, embedding) -> query_id, rank, vec_id, score: for each vec_id divisible by `every`, its k nearest
    others by inner product."""
    good = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("v")).where(F.col("vec_id").isNotNull() & usable(F.col("v")))
    good = cut(good.groupBy("vec_id").agg(F.min("v").alias("v")), "vectors")
    ties = Window.partitionBy("v").orderBy("vec_id")
    is_q = F.col("vec_id") % every == 0
    least = good.withColumn("nth", F.row_number().over(ties)).where(F.col("nth") <= k + 1).select("vec_id", "v", F.lit(True).alias("cand"))
    asking = good.where(is_q).withColumn("cand", F.lit(False))
    packed = cut(least.unionByName(asking).mapInPandas(_pack, "vec_id long, cand boolean, size int, q8 binary, scale double, left double, norm double"), "packed")
    seen = packed.agg(F.sum(F.col("cand").cast("long")).alias("n"), F.sum((~F.col("cand")).cast("long")).alias("q")).first()
    cb, qb = -(-(seen["n"] or 0) // rows) or 1, -(-(seen["q"] or 0) // rows) or 1
    block = F.xxhash64("vec_id")
    cands = packed.where("cand").select("*", F.lit(False).alias("is_q"), F.lit(None).cast("double").alias("floor"), F.pmod(block, F.lit(cb)).cast("int").alias("c"), F.explode(F.sequence(F.lit(0), F.lit(qb - 1))).alias("q"))

    def run(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        q, c = f[f["is_q"]], f[~f["is_q"]]
        return tile(q, c, k) if len(q) and len(c) else pd.DataFrame(columns=["query_id", "vec_id", "low", "high"])

    found: DataFrame | None = None
    worst = Window.partitionBy("query_id").orderBy(F.desc("low"), "vec_id")
    for first, end in rounds(cb):
        asks = packed.where("not cand")
        asks = asks.withColumn("floor", F.lit(None).cast("double")) if found is None else asks.join(kth.select(F.col("query_id").alias("vec_id"), F.col("kth").alias("floor")), "vec_id", "left")
        asks = asks.select(*packed.columns, F.lit(True).alias("is_q"), "floor", F.explode(F.sequence(F.lit(first), F.lit(end - 1))).alias("c"), F.pmod(block, F.lit(qb)).cast("int").alias("q"))
        both = cands.where(F.col("c").between(first, end - 1)).unionByName(asks)
        tiles = cut(both.groupBy("c", "q", "size").applyInPandas(run, "query_id long, vec_id long, low double, high double"), "tiles")
        found = tiles if found is None else found.unionByName(tiles)
        kth = found.withColumn("nth", F.row_number().over(worst)).where(F.col("nth") <= k).groupBy("query_id").agg(F.when(F.count(F.lit(1)) == k, F.min("low")).alias("kth"))
    left = found.join(kth, "query_id").where("kth is null or high >= kth").select("query_id", "vec_id")
    both = left.join(good, "vec_id").join(good.select(F.col("vec_id").alias("query_id"), F.col("v").alias("w")), "query_id")
    score = F.expr("aggregate(zip_with(v, w, (x, y) -> x * y), 0D, (a, x) -> a + x)")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    scored = both.select("query_id", "vec_id", score.alias("score")).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return scored.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
