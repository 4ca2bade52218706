"""Removal of every byte inside a long string that occurs more than once, over all documents.

A suffix array of sampled positions: each string of `LENGTH` bytes has one anchor, the least `GRAM`-byte hash in it, so
equal strings have equal anchors. Anchors whose gram occurs once in the corpus are dropped; the others bring the bytes
of their strings to the bucket of their gram. There, bucket-pointer refinement: positions are put into buckets by their
first `Q` bytes; then, again and again, each bucket that still holds several positions is refined by sorting on the bucket
identifiers of the offsets its depth further on, as the passes before have updated them, which doubles its depth. Strings
that share a bucket at the depth of `LENGTH` are repeated.

A very frequent gram is dealt over several tasks; one string of each final bucket is then compared by hash over all parts. Hashes have 64 bits. Equal texts are one class: all of each is removed if it has `LENGTH` bytes.
Null and empty texts have no bytes; equal rows are copies of each other; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_text_id, cut, row_key
from .wordhash import batches, mix, running, span_hash

LENGTH, GRAM, Q = 200, 32, 25
#: Anchors of one gram that one part holds.
PART = 2000
_LOW = np.uint64((1 << 22) - 1)


def _raw(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def anchors(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text index, gram hash, first string start, last string start) of each anchor; starts are within the text.

    A string's anchor is the leftmost least gram; strings that follow each other share one, so an anchor has a range.
    """
    empty = np.zeros(0, np.int64)
    long = [i for i, x in enumerate(raw) if len(x) >= LENGTH]
    if not long:
        return empty, empty.astype(np.uint64), empty, empty
    buf = np.frombuffer(b"".join(raw[i] for i in long), np.uint8)
    sizes = np.array([len(raw[i]) for i in long])
    first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    sums = running(buf)
    at = np.arange(len(buf) - GRAM + 1)
    gram = mix(span_hash(sums, at, at + GRAM))
    out = []
    for lo in range(0, len(long)):
        a, n = first[lo], sizes[lo]
        h = gram[a : a + n - GRAM + 1]
        for part in range(0, n - LENGTH + 1, 1 << 21):  # positions fit the low bits
            x = h[part : part + (1 << 21) + LENGTH - GRAM]
            least = (x & ~_LOW) | np.arange(len(x), dtype=np.uint64)
            width, want = 1, LENGTH - GRAM + 1
            while 2 * width <= want:
                least = np.minimum(least[:-width], least[width:])
                width *= 2
            if width < want:
                least = np.minimum(least[: len(least) - (want - width)], least[want - width :])
            where = (least & _LOW).astype(np.int64)
            change = np.flatnonzero(np.diff(where)) + 1
            s0, s1 = np.concatenate([[0], change]), np.concatenate([change, [len(where)]]) - 1
            out.append((np.full(len(s0), long[lo]), x[where[s0]], s0 + part, s1 + part))
    return tuple(np.concatenate(c) for c in zip(*out))


def _find(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        texts = f["text"].tolist()
        for a, b in batches(texts):
            which, gram, s0, _ = anchors([_raw(x) for x in texts[a:b]])
            yield pd.DataFrame({"th": f["th"].to_numpy()[a:b][which], "gram": gram.view(np.int64), "s0": s0})


def _contexts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The bytes of all strings of each wanted anchor."""
    for f in frames:
        texts = f["text"].tolist()
        for a, b in batches(texts):
            raw = [_raw(x) for x in texts[a:b]]
            which, _, s0, s1 = anchors(raw)
            part = f.iloc[a:b]
            rows = []
            bounds = np.searchsorted(which, np.arange(len(raw) + 1))
            for i, (th, starts, parts, buckets) in enumerate(zip(part["th"], part["starts"], part["parts"], part["buckets"])):
                lo, hi = bounds[i], bounds[i + 1]
                at = lo + np.searchsorted(s0[lo:hi], starts)
                rows += [(k, th, p, x, raw[i][x : y + LENGTH]) for k, p, x, y in zip(buckets, parts, s0[at].tolist(), s1[at].tolist())]
            yield pd.DataFrame(rows, columns=["bucket", "th", "parts", "s0", "bytes"])


def _ranks(x: np.ndarray) -> np.ndarray:
    return np.unique(x, return_inverse=True)[1].astype(np.int64)


def refine(f: pd.DataFrame) -> pd.DataFrame:
    """Ranges (th, a, b, null) of repeated string starts, and (th, a, a, hash) of those still to compare elsewhere."""
    raw = f["bytes"].tolist()
    sizes = np.array([len(x) for x in raw])
    first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    sums = running(np.frombuffer(b"".join(raw), np.uint8))
    n = sizes - LENGTH + 1
    row = np.repeat(np.arange(len(raw)), n)
    at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + first[row]
    whole = int(sizes.sum())
    bucket = _ranks(span_hash(sums, np.arange(whole - Q + 1), np.arange(Q, whole + 1)))
    room = (np.repeat(first + sizes, sizes) - np.arange(whole))[: len(bucket)]  # bytes of its row from each position on
    depth, live, name = Q, np.flatnonzero(room >= Q), len(bucket)
    while depth < LENGTH:
        live = live[room[live] >= 2 * depth]
        live = live[np.bincount(bucket[live])[bucket[live]] > 1]
        pair = bucket[live] * (4 * whole) + bucket[live + depth]
        bucket[live] = _ranks(pair) + name  # a name is never used again, so passes can read pointers as they are updated
        name, depth = name + len(live), 2 * depth
    same = np.bincount(bucket[live])[bucket[live]] > 1
    shared = np.zeros(whole, bool)
    shared[live[same]] = True
    again, fine = shared[at], bucket[at]
    start = f["s0"].to_numpy(np.int64)[row] + at - first[row]
    th = f["th"].to_numpy(np.int64)[row]
    joined = again[1:] & again[:-1] & (row[1:] == row[:-1])
    heads = np.flatnonzero(again & ~np.concatenate([[False], joined]))
    tails = np.flatnonzero(again & ~np.concatenate([joined, [False]]))
    out = [pd.DataFrame({"th": th[heads], "a": start[heads], "b": start[tails], "h": None})]
    # of a gram in several parts, one of each kind of string goes on, so that parts learn of each other's
    one = ~again
    one[np.unique(fine, return_index=True)[1]] = True
    alone = np.flatnonzero(one & (f["parts"].to_numpy()[row] > 1))
    if len(alone):
        h = mix(span_hash(sums, at[alone], at[alone] + LENGTH)).view(np.int64)
        out.append(pd.DataFrame({"th": th[alone], "a": start[alone], "b": start[alone], "h": h}))
    return pd.concat(out).astype({"h": "Int64"})


def repeated_ranges(docs: DataFrame) -> DataFrame:
    """docs(doc_id, th, text), th a hash of the text -> (th, ranges): starts of repeated strings, from a to b."""
    spark = docs.sparkSession
    found = cut(docs.select("th", "text").mapInPandas(_find, "th long, gram long, s0 long"), "anchors")
    place = F.xxhash64("th", "s0")
    shared = found.groupBy("gram").agg(F.min(place).alias("lo"), F.max(place).alias("hi"), F.count(F.lit(1)).alias("m")).where("lo <> hi")
    shared = shared.select("gram", F.ceil(F.col("m") / PART).cast("int").alias("parts"))
    # equal texts give equal rows, which the set drops before the shuffle; a skewed gram can so be split in the join
    kept = found.join(shared, "gram").select("th", "s0", "parts", F.xxhash64("gram", F.pmod(place, F.col("parts"))).alias("bucket"))
    spots = F.array_sort(F.collect_set(F.struct("s0", "parts", "bucket")))
    rep = docs.groupBy("th").agg(F.min(row_key(F.col("doc_id"))).alias("d"))
    wanted = kept.groupBy("th").agg(spots.alias("x")).join(rep, "th")
    wanted = wanted.select("d", "th", F.col("x.s0").alias("starts"), F.col("x.parts").alias("parts"), F.col("x.bucket").alias("buckets"))
    wanted = cut(wanted, "wanted")
    total = wanted.agg(F.sum(F.size("starts"))).first()[0] or 0
    groups = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // 8_000 + 1)
    texts = docs.select(row_key(F.col("doc_id")).alias("d"), "th", "text").join(wanted, ["d", "th"]).select("th", "text", "starts", "parts", "buckets")
    texts = texts.mapInPandas(_contexts, "bucket long, th long, parts int, s0 long, bytes binary")
    texts = texts.withColumn("bucket", F.pmod("bucket", F.lit(groups)))
    fine = cut(texts.groupBy("bucket").applyInPandas(refine, "th long, a long, b long, h long"), "ranges")
    alone = fine.where("h is not null")
    twice = alone.groupBy("h").agg(F.min(F.xxhash64("th", "a")).alias("lo"), F.max(F.xxhash64("th", "a")).alias("hi")).where("lo <> hi").select("h")
    both = fine.where("h is null").select("th", "a", "b").unionByName(alone.join(twice, "h").select("th", "a", "b"))
    return both.groupBy("th").agg(F.collect_set(F.struct("a", "b")).alias("ranges"))


def _remove(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        rows = []
        for d, text, copies, ranges in zip(f["doc_id"], f["text"], f["copies"], f["ranges"]):
            raw = _raw(text)
            if copies > 1 and len(raw) >= LENGTH:
                spans = [(0, len(raw))]
            else:
                spans = []
                for r in sorted((r["a"], r["b"] + LENGTH) for r in ranges) if ranges is not None else ():
                    if spans and r[0] <= spans[-1][1]:
                        spans[-1] = (spans[-1][0], max(spans[-1][1], r[1]))
                    else:
                        spans.append(r)
            left, at = hashlib.sha256(), 0
            for a, b in spans:
                left.update(raw[at:a])
                at = b
            left.update(raw[at:])
            rows.append((d, len(raw), sum(b - a for a, b in spans), len(spans), left.hexdigest()))
        yield pd.DataFrame(rows, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def remove_repeats(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    docs = docs.select("doc_id", "text", F.xxhash64("text").alias("th"))
    copies = docs.groupBy("th").agg(F.count(F.lit(1)).alias("copies"))
    ranges = repeated_ranges(docs)
    known = copies.join(ranges, "th", "left").where("copies > 1 or ranges is not null").select("th", "copies", F.when(F.col("copies") == 1, F.col("ranges")).alias("ranges"))
    out = docs.join(known, "th", "left").select("doc_id", "text", F.coalesce("copies", F.lit(1)).alias("copies"), "ranges")
    return by_text_id(out, _remove, "doc_id string, n_bytes long, n_removed long, n_spans long, kept_sha256 string", "doc_id")
