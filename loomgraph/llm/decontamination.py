"""Benchmark decontamination by winnowing, in DataFrame expressions only.

Every `k`-gram of words has a hash; of each `width - k + 1` successive ones the least is kept, so that every span of
`width` words of a document and of a benchmark item share a fingerprint. Fingerprints are joined; a hit is extended to
the windows of `width` words around it, whose words must be equal to those of a benchmark window. Items of fewer words
are one window each and are found by whole-window hashes of their own length.

Null texts have no words; empty tables give no hits; equal rows get equal results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Characters that end a word, after A-Z is lower-cased.
_BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _words(text: Column) -> Column:
    low = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.array_remove(F.split(low, _BREAK), "")


def _grams(words: str, k: int) -> str:
    return f"transform(sequence(1, size({words}) - {k - 1}), i -> xxhash64(slice({words}, i, {k})))"


def _minima(grams: str, span: int) -> str:
    """Distinct minima of `span` successive grams."""
    return f"array_distinct(transform(sequence(1, size({grams}) - {span - 1}), i -> array_min(slice({grams}, i, {span}))))"


def windows(benchmark: DataFrame, width: int) -> DataFrame:
    """(item_id, len, words) for each distinct window of each item."""
    items = benchmark.select("item_id", _words(F.col("text")).alias("w")).where("size(w) > 0")
    n = F.least(F.size("w"), F.lit(width))
    out = items.select("item_id", n.alias("len"), F.explode(F.expr(f"transform(sequence(1, size(w) - least(size(w), {width}) + 1), i -> slice(w, i, least(size(w), {width})))")).alias("words"))
    return out.distinct()


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = 13, k: int = 8, share: int = 20) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_words, n_hit, n_items, items_sha256, contaminated (share * n_hit >= n_words)."""
    return contamination_rows(docs, benchmark, width, k, share).drop("th")


def contamination_rows(docs: DataFrame, benchmark: DataFrame, width: int = 13, k: int = 8, share: int = 20) -> DataFrame:
    """contamination with th, the hash of the text."""
    span = width - k + 1
    wins = cut(windows(benchmark, width), "windows")
    prints = wins.where(F.col("len") == width).select(F.explode(F.expr(f"array(array_min({_grams('words', k)}))")).alias("fp")).distinct()
    short = [r["len"] for r in wins.where(F.col("len") < width).select("len").distinct().collect()]  # at most width - 1
    keyed = docs.select("doc_id", F.coalesce("doc_id", F.lit(-(1 << 63))).alias("d"), F.xxhash64("text").alias("th"), "text")
    base = keyed.select("doc_id", "d", "th", _words(F.col("text")).alias("w"))
    counted = base.select("doc_id", "d", "th", F.size("w").cast("long").alias("n_words"))
    grams = base.where(F.size("w") >= width).withColumn("g", F.expr(_grams("w", k)))
    marks = grams.select("d", "th", F.explode(F.expr(_minima("g", span))).alias("fp"))
    found = marks.join(prints, "fp", "left_semi").select("d", "th")
    for n in sorted(short):
        heads = wins.where(F.col("len") == n).select(F.expr("xxhash64(words)").alias("fp")).distinct()
        some = base.where(F.size("w") >= n).select("d", "th", F.explode(F.array_distinct(F.expr(_grams("w", n)))).alias("fp"))
        found = found.unionByName(some.join(heads, "fp", "left_semi").select("d", "th"))
    suspects = cut(found.distinct(), "suspects")
    near = keyed.join(suspects, ["d", "th"], "left_semi")
    near = near.dropDuplicates(["d", "th"]).select("d", "th", _words(F.col("text")).alias("w"))
    near = cut(near, "near")
    lengths = sorted({width, *short})
    spots = None
    for n in lengths:
        known = wins.where(F.col("len") == n).select(F.array_join("words", " ").alias("win"), "item_id")
        here = near.where(F.size("w") >= n).select("d", "th", F.posexplode(F.expr(f"transform(sequence(1, size(w) - {n - 1}), i -> array_join(slice(w, i, {n}), ' '))")).alias("at", "win"))
        got = here.join(known.groupBy("win").agg(F.collect_set("item_id").alias("items")), "win").select("d", "th", "at", F.lit(n).alias("n"), "items")
        spots = got if spots is None else spots.unionByName(got)
    spots = cut(spots, "spots")
    words = spots.select("d", "th", F.explode(F.expr("sequence(at, at + n - 1)")).alias("i")).groupBy("d", "th").agg(F.countDistinct("i").alias("n_hit"))
    items = spots.select("d", "th", F.explode("items").alias("item")).distinct().groupBy("d", "th").agg(F.sort_array(F.collect_list(F.col("item").cast("string"))).alias("ids"))
    out = counted.join(words, ["d", "th"], "left").join(items, ["d", "th"], "left")
    hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    ids = F.coalesce("ids", F.array().cast("array<string>"))
    return out.select(
        "doc_id", "th", "n_words", hit.alias("n_hit"), F.size(ids).cast("long").alias("n_items"), F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"),
        ((hit > 0) & (share * hit >= F.col("n_words"))).alias("contaminated"),
    )
