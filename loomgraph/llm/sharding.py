"""Shards of nearly equal size from indivisible groups, by best-fit-decreasing bin packing.

Groups (equal texts) are sorted by size and enter the bin with the tightest remaining capacity, found in a balanced
order of the bins; the smallest capacity at which all fit into the wanted number of bins is searched by halving.
Sizes are put into classes (exact to 4096 bytes, then 12 leading bits), of which there are at most some 100,000 for
any input; the plan works on classes, and Spark ranks and places the groups.

A group larger than a fair share cannot be divided: it gets a bin of its own and the others share what is left. Null
and empty texts are one group; an empty table gives no rows; equal rows stay together.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, rank_in_class, utf8_crc32


def _fill(classes: list[tuple[int, float, int]], bins: int, capacity: float) -> dict[int, list[tuple[int, int]]] | None:
    """Runs (first rank, bin) for each class, or None if the bins do not hold all. classes: id, mean size, count."""
    rooms = [(capacity, b) for b in range(bins)]
    runs: dict[int, list[tuple[int, int]]] = {}
    for c, size, n in classes:
        rank, mine = 0, []
        while n:
            at = bisect.bisect_left(rooms, (size, -1))
            if at == len(rooms):
                return None
            room, b = rooms.pop(at)
            k = min(n, int(room // size))
            mine.append((rank, b))
            rank, n = rank + k, n - k
            bisect.insort(rooms, (room - k * size, b))
        runs[c] = mine
    return runs


def best_fit_decreasing(classes: list[tuple[int, float, int]], bins: int) -> dict[int, list[tuple[int, int]]]:
    """The fullest even fill found: classes (id, mean size, count) -> runs (first rank, bin)."""
    left = sorted(classes, key=lambda x: (-x[1], x[0]))
    runs: dict[int, list[tuple[int, int]]] = {c: [] for c, _, _ in left}
    free, total, start = bins, sum(s * n for _, s, n in left), dict.fromkeys(runs, 0)
    while left and free > 1 and left[0][1] * free > total:  # larger than a fair share of what is left
        c, size, n = left[0]
        free, total = free - 1, total - size
        runs[c].append((start[c], free))
        start[c] += 1
        left[:1] = [(c, size, n - 1)] if n > 1 else []
    if left:
        low, high = total / free, total / free + max(s for _, s, _ in left) + 1
        best = None
        for _ in range(40):
            middle = (low + high) / 2
            if found := _fill(left, free, middle):
                best, high = found, middle
            else:
                low = middle
            if high - low < 1:
                break
        best = best or _fill(left, free, high * 2)
        for c, mine in best.items():
            runs[c] += [(r + start[c], b) for r, b in mine]
    return runs


def shard(docs: DataFrame, shards: int = 40, overhead: int = 16) -> DataFrame:
    """docs(doc_id, text) -> doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    rows = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + overhead).cast("long").alias("size"),
        utf8_crc32(F.col("text")).alias("text_crc32"),
        F.unhex(F.md5(F.encode(F.coalesce("text", F.lit("")), "UTF-8"))).alias("g"),
    )
    rows = cut(rows, "sizes")
    total = F.col("total")
    groups = rows.groupBy("g").agg(F.sum("size").alias("total"))
    cls = F.when(total < 4096, total).otherwise(F.expr("length(bin(total)) * 8192L + cast(floor(total / pow(2D, length(bin(total)) - 12)) as bigint)"))
    groups = cut(groups.withColumn("cls", cls), "groups")
    classes = [(r["cls"], r["s"] / r["n"], r["n"]) for r in groups.groupBy("cls").agg(F.sum("total").alias("s"), F.count(F.lit(1)).alias("n")).collect()]  # bounded: see above
    runs = {c: (np.array([r for r, _ in x], np.int64), np.array([b for _, b in x], np.int32)) for c, x in best_fit_decreasing(classes, shards).items()}

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = [runs[c][1][np.searchsorted(runs[c][0], r, side="right") - 1] for c, r in zip(f["cls"].tolist(), f["rank"].tolist())]
            yield pd.DataFrame({"g": f["g"], "shard": np.array(out, np.int32)})

    placed = rank_in_class(groups, "cls", ["g"], 16).select("g", "cls", "rank").mapInPandas(run, "g binary, shard int")
    out = rows.join(placed, "g").drop("g")
    out = rank_in_class(cut(out, "sharded"), "shard", ["doc_id", "text_crc32"], 256)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("rank").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
