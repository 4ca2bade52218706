"""Near-duplicate documents by an LSH forest over MinHash signatures.

Documents with equal shingle sets form one class; only one member of each goes on. Every class has a signature of
`HASHES` minima. A tree orders all classes by a sequence of those minima; classes that follow each other in it share
the longest prefixes, so each is compared with its next `NEAR` ones. A pair counts from a common prefix of two on:
in sparse regions that is all there is, in dense ones the order itself goes deeper, to `DEPTH` values. A sketch of
one bit a minimum and the sizes drop most wrong pairs, and whole shingle sets decide the rest. The first trees join
what is close in dense regions; the pairs of the other trees are then only needed between different components.

A run of classes with a common prefix of two may be longer than that window. Where it then still holds different
components, all its classes go a second, exact way: their shingles are ordered by rarity, the rarest of each class
(prefix filter) are joined by equality, sizes, places and the number of shared ones drop pairs without loss, and whole
sets decide again.

Memory: a task holds one batch of texts, or rows of a sorted range; nothing gathers a group. Null and blank texts have
no shingles and stay alone; equal rows are one class; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_text_id, cut, row_key
from .components import connected_components
from .wordhash import batches, mix, shingles

HASHES, TREES, DEPTH, NEAR, FIRST_TREES = 128, 32, 8, 3, 3
#: Bits of two sketches that may differ: at a similarity of 0.75 the mean is 16 of 128, with a deviation of 3.8.
DIFFERENT = 36
#: Buckets of shingle counts that order shingles by rarity; postings of one shingle that one part of the join holds.
BUCKETS, PART = 1 << 20, 2000
#: A shingle in more texts of a crowd than this, and than four times the mean, is frequent.
FREQUENT = 64
_R = np.random.default_rng(7)
_FLIP, _FACTOR = _R.integers(0, 1 << 32, HASHES, dtype=np.uint32), _R.integers(0, 1 << 32, HASHES, dtype=np.uint32) | np.uint32(1)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """Minima of each (non-empty) set under `HASHES` orders."""
    low = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
    starts = np.cumsum([0] + [len(s) for s in sets[:-1]])
    out = np.empty((len(sets), HASHES), np.uint32)
    for k in range(HASHES):
        out[:, k] = np.minimum.reduceat((low ^ _FLIP[k]) * _FACTOR[k], starts)
    return out


def _sign(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        texts = f["text"].tolist()
        for a, b in batches(texts, 1 << 19):
            sets = shingles(texts[a:b])
            out = f.iloc[a:b][["doc_id", "th"]].copy()
            out["n"] = [len(s) for s in sets]
            out["d1"] = np.array([s.sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64)
            out["d2"] = np.array([np.bitwise_xor.reduce(mix(s)) for s in sets], np.uint64).view(np.int64)
            some = [s for s in sets if len(s)]
            sig = iter(signatures(some) if some else ())
            out["sig"] = [next(sig).tobytes() if len(s) else None for s in sets]
            yield out


def _trees(first: int, last: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in frames:
            for at in range(0, len(whole), 2000):
                f = whole.iloc[at : at + 2000]
                if not len(f):
                    continue
                sig = np.frombuffer(b"".join(f["sig"]), np.uint32).reshape(-1, HASHES)
                bits = np.packbits(((sig * np.uint32(0x9E3779B1)) >> np.uint32(31)).astype(np.uint8), axis=1)
                ids = f["th"].to_numpy(np.int64).astype(">i8").view("V8")
                for t in range(first, last):
                    pick = (t * (HASHES // TREES) + np.arange(DEPTH)) % HASHES
                    label = np.ascontiguousarray(sig[:, pick], ">u4").view(f"V{4 * DEPTH}").ravel()
                    yield pd.DataFrame({"k": [bytes([t]) + x.tobytes() + y.tobytes() for x, y in zip(label, ids)], "n": f["n"].to_numpy(np.int64), "bits": [x.tobytes() for x in bits]})

    return run


def _pairs_of(keys: list[bytes], n: np.ndarray, bits: list[bytes], near: int) -> pd.DataFrame:
    raw = np.frombuffer(b"".join(keys), np.uint8).reshape(len(keys), -1)
    label = np.ascontiguousarray(raw[:, : 1 + 8])  # the tree and two minima
    ids = np.ascontiguousarray(raw[:, -8:]).view(">i8").ravel().astype(np.int64)
    sketch = np.frombuffer(b"".join(bits), np.uint64).reshape(len(keys), -1)
    left, right = [], []
    for step in range(1, near + 1):
        if len(keys) <= step:
            break
        ok = (label[:-step] == label[step:]).all(axis=1)
        ok &= 4 * np.minimum(n[:-step], n[step:]) >= 3 * np.maximum(n[:-step], n[step:])
        at = np.flatnonzero(ok)
        at = at[np.bitwise_count(sketch[at] ^ sketch[at + step]).sum(axis=1) <= DIFFERENT]
        left.append(ids[at])
        right.append(ids[at + step])
    a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (left, right))
    return pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)})


def _runs(keys: list[bytes]) -> pd.DataFrame:
    """Runs of one label (k) in this batch, with their members (ids); a lone row only where its run may go on outside."""
    raw = np.frombuffer(b"".join(keys), np.uint8).reshape(len(keys), -1)
    label = np.ascontiguousarray(raw[:, : 1 + 8])
    ids = np.ascontiguousarray(raw[:, -8:]).view(">i8").ravel().astype("<i8")
    starts = np.concatenate([[0], np.flatnonzero((label[1:] != label[:-1]).any(axis=1)) + 1])
    ends = np.append(starts[1:], len(keys))
    some = (ends - starts > 1) | (starts == 0) | (ends == len(keys))
    starts, ends = starts[some], ends[some]
    return pd.DataFrame({"k": [label[a].tobytes() for a in starts], "n": ends - starts, "ids": [ids[a:b].tolist() for a, b in zip(starts, ends)]})


def _neighbours(near: int, runs: bool):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        head, tail = 0, None
        for f in frames:
            if not len(f):
                continue
            f = f[["k", "n", "bits"]]
            if runs:
                yield _runs(f["k"].tolist()).assign(a=None, b=None, bits=None)
            if head < near:
                yield f.iloc[: near - head].assign(a=None, b=None, ids=None)
                head += len(f)
            f = f if tail is None else pd.concat([tail, f])
            yield _pairs_of(f["k"].tolist(), f["n"].to_numpy(), f["bits"].tolist(), near).assign(k=None, n=None, bits=None, ids=None)
            tail = f.iloc[-near:]
        if tail is not None:
            yield tail.assign(a=None, b=None, ids=None)

    return run


def _edges(near: int):
    """Pairs across the ends of sorted ranges, at most 2 * near rows from each."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        all_ = list(frames)
        if all_ and len(f := pd.concat(all_)):
            f = f.drop_duplicates("k").sort_values("k")
            yield _pairs_of(f["k"].tolist(), f["n"].to_numpy(), f["bits"].tolist(), near)

    return run


def candidates(classes: DataFrame, first: int, last: int, near: int, runs: bool = False) -> tuple[DataFrame, DataFrame]:
    """Distinct pairs (a, b) of classes near each other in one of the trees from `first` to `last`, and, if asked for,
    the members (k, th) of runs that are longer than the window."""
    spark = classes.sparkSession
    rows = classes.select("th", "n", "sig").mapInPandas(_trees(first, last), "k binary, n long, bits binary")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 8)
    ordered = rows.repartitionByRange(parts, "k").sortWithinPartitions("k")
    schema = "a long, b long, k binary, n long, bits binary, ids array<long>"
    found = cut(ordered.mapInPandas(_neighbours(near, runs), schema).select("a", "b", "k", "n", "bits", "ids"), "forest")
    ends = found.where("k is not null and ids is null").select("k", "n", "bits").repartition(1).mapInPandas(_edges(near), "a long, b long")
    pairs = found.where("a is not null").select("a", "b").unionByName(ends).distinct()
    each = found.where("ids is not null")
    long = each.groupBy("k").agg(F.sum("n").alias("m")).where(F.col("m") > near + 1).select("k")
    return pairs, each.join(long, "k").select("k", F.explode("ids").alias("th"))


def _count_shingles(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    total = np.zeros(BUCKETS, np.int64)
    for f in frames:
        texts = f["text"].tolist()
        for a, b in batches(texts):
            for x in shingles(texts[a:b]):
                np.add.at(total, (x & np.uint64(BUCKETS - 1)).astype(np.int64), 1)
    at = np.flatnonzero(total)
    yield pd.DataFrame({"bucket": at, "n": total[at]})


def _packed(f: pd.DataFrame) -> pd.DataFrame:
    out, bucket = np.zeros(1 << 14, np.uint8), f["bucket"].to_numpy()
    out[bucket & (1 << 14) - 1] = f["r"].to_numpy()
    return pd.DataFrame({"at": [bucket[0] >> 14 << 14], "ranks": [out.tobytes()]})


def _prefixes(rank: np.ndarray, often: int, percent: int):
    """The rarest shingles of each text (two similar texts share one of them), whether each is frequent, and how many frequent
    ones the whole set (f) and its prefix (fp) have. Frequent ones are left out where no link can rest on them alone."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            texts = f["text"].tolist()
            for a, b in batches(texts):
                sets, cols = shingles(texts[a:b]), {x: [] for x in ("at", "n", "f", "fp", "p", "key", "often")}
                for i, x in enumerate(sets):
                    keep = len(x) + (-percent * len(x)) // 100 + 1
                    ranks = rank[(x & np.uint64(BUCKETS - 1)).astype(np.int64)]
                    order = np.lexsort((x, ranks))[:keep]
                    common = ranks[order] > often
                    total, here = int((ranks > often).sum()), int(common.sum())
                    used = np.flatnonzero(~common | (100 * total >= percent * len(x)))
                    for name, value in (("at", i), ("n", len(x)), ("f", total), ("fp", here)):
                        cols[name].append(np.full(len(used), value))
                    cols["p"].append(used)
                    cols["key"].append(x[order][used].view(np.int64))
                    cols["often"].append(common[used])
                if sets:
                    whole = {name: np.concatenate(v) for name, v in cols.items()}
                    at = a + whole.pop("at")
                    yield pd.DataFrame({name: f[name].to_numpy()[at] for name in ("th", "c")} | whole)

    return run


def _met(x: DataFrame, y: DataFrame, percent: int) -> DataFrame:
    """Rows that meet in a key and a slot, of different components, whose sizes and places allow a link, each pair once a key."""
    once = F.when(F.col("x.often"), F.expr("x.n > y.n or x.n = y.n and x.th < y.th")).otherwise(F.expr("y.c = y.main or x.th < y.th"))
    # a pair that shares frequent shingles only has its whole overlap among them
    rests = F.expr(f"not x.often or {100 + percent} * least(x.f, y.f) >= {percent} * (x.n + y.n)")
    sizes = F.expr(f"100 * least(x.n, y.n) >= {percent} * greatest(x.n, y.n)")
    # an overlap of at least percent / (100 + percent) of both sizes must still be possible behind the shared shingle
    place = F.expr(f"{100 + percent} * (least(x.p, y.p) + least(x.n - x.p, y.n - y.p)) >= {percent} * (x.n + y.n)")
    return x.alias("x").join(y.alias("y"), F.expr("x.key = y.key and x.slot = y.slot and x.c <> y.c") & once & rests & sizes & place)


def _enough(pairs: DataFrame, percent: int) -> DataFrame:
    """(a, b) of the pairs that meet in as many keys as similar sets do."""
    # similar sets share more than one of their rarest shingles: all they must share but those behind the longer prefix
    least = F.expr(f"cast(ceil({percent} * (x.n + y.n) / {100 + percent}) as long)")
    behind = F.expr(f"1 - cast(ceil({percent} * greatest(x.n, y.n) / 100) as long)")
    both = F.expr("x.fp > 0 and y.fp > 0")  # then all that is not frequent lies in both prefixes
    apart = F.greatest(least + behind - F.expr("least(x.fp, y.fp)"), F.when(both, least - F.expr("least(x.f, y.f)")).otherwise(0))
    need = F.when(F.expr("x.often"), least + behind).otherwise(apart)
    shared = pairs.select(F.least("x.th", "y.th").alias("a"), F.greatest("x.th", "y.th").alias("b"), need.alias("need"))
    return shared.groupBy("a", "b", "need").agg(F.count(F.lit(1)).alias("shared")).where("shared >= need").select("a", "b")


def crowded_pairs(runs: DataFrame, component: DataFrame, classes: DataFrame, docs: DataFrame, percent: int) -> DataFrame | None:
    """All pairs (a, b) of different components, in runs longer than the window, that can be similar; None if no run
    holds two components.

    A pair that shares a shingle which is not frequent meets in it. A pair that shares frequent ones only must find its
    whole overlap among them, so the smaller set consists of them for the most part, and the larger one admits few sizes of
    it: these meet by shingle and class of size. A passage that a whole crowd shares so joins nobody by itself.
    """
    runs = cut(runs.join(component.select(F.col("node").alias("th"), "component"), "th", "left").select("k", "th", F.coalesce("component", "th").alias("c")), "runs")
    mixed = runs.groupBy("k").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi").select("k")
    crowd = cut(runs.join(mixed, "k").select("th", "c").distinct(), "crowd")
    if crowd.isEmpty():
        return None
    texts = cut(texts_of(crowd, classes, docs).join(crowd, "th"), "crowdtexts")
    counts = texts.mapInPandas(_count_shingles, "bucket long, n long").groupBy("bucket").agg(F.floor(2 * F.log2(F.sum("n"))).cast("int").alias("r"))
    rank = np.zeros(BUCKETS, np.uint8)
    for row in counts.groupBy(F.shiftright("bucket", 14)).applyInPandas(_packed, "at long, ranks binary").toLocalIterator():  # a byte for each bucket
        rank[row["at"] : row["at"] + (1 << 14)] = np.frombuffer(row["ranks"], np.uint8)
    mean = float((2.0 ** (np.arange(256) / 2) * np.bincount(rank, minlength=256)).sum()) / BUCKETS
    often = int(2 * np.log2(max(FREQUENT, 4 * mean)))
    rows = cut(texts.mapInPandas(_prefixes(rank, often, percent), "th long, c long, n long, f long, fp long, p long, key long, often boolean"), "prefixes")
    # pairs of different components have one member outside the key's largest one, whose own pairs are never made
    keys = rows.groupBy("key", "c").agg(F.count(F.lit(1)).alias("m")).groupBy("key")
    keys = keys.agg(F.max(F.struct("m", "c")).alias("x"), F.count(F.lit(1)).alias("kinds"), F.sum("m").alias("all")).where("kinds > 1")
    keys = keys.select("key", F.col("x.c").alias("main"), F.ceil(F.col("all") / PART).cast("int").alias("parts"))
    live = cut(rows.join(keys, "key"), "live")
    apart = F.col("c") != F.col("main")
    size = lambda n: 2 * F.floor(F.log(n) / F.log(F.lit(1.2))).cast("int")
    none = F.array().cast("array<int>")
    # rare keys: members outside the largest component, by parts, meet all others in each part. Frequent keys: a set meets
    # smaller ones by the classes of size that it admits (percent * (n + m) <= (100 + percent) * f, m the smaller size), in an
    # odd slot if it is in the largest component, where only sets outside that one wait
    most = F.least(F.col("n"), F.floor(F.col("f") * (100 + percent) / percent) - F.col("n"))
    fewest = F.ceil(F.col("n") * percent / 100)
    admits = F.transform(F.sequence(size(fewest), size(most), F.lit(2)), lambda k: k + F.when(apart, 0).otherwise(1))
    x = live.withColumn("slot", F.explode(F.when(~F.col("often"), F.when(apart, F.array(F.pmod(F.xxhash64("th"), F.col("parts")).cast("int"))).otherwise(none)).when(most >= fewest, admits).otherwise(none)))
    own = size(F.col("n"))
    waits = F.when(apart, F.array(own, own + 1)).otherwise(F.array(own))
    y = live.withColumn("slot", F.explode(F.when(~F.col("often"), F.sequence(F.lit(0), F.col("parts") - 1)).when(F.expr(f"{100 + percent} * f >= {2 * percent} * n"), waits).otherwise(none)))
    return _enough(_met(x, y, percent), percent).distinct()


def _verify(percent: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for at in range(0, len(f), 256):
                g = f.iloc[at : at + 256]
                texts = dict(zip(g["a"], g["ta"])) | dict(zip(g["b"], g["tb"]))
                sets = dict(zip(texts, shingles(list(texts.values()))))
                keep = []
                for a, b in zip(g["a"], g["b"]):
                    x, y = sets[a], sets[b]
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    keep.append(100 * both >= percent * (len(x) + len(y) - both))
                yield g.loc[keep, ["a", "b"]]

    return run


def texts_of(used: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """th, text of the classes in used(th)."""
    return (
        docs.select(row_key(F.col("doc_id")).alias("d"), F.xxhash64("text").alias("th"), "text")
        .join(classes.join(used, "th", "left_semi").select(row_key(F.col("rep")).alias("d"), "th"), ["d", "th"], "left_semi")
        .dropDuplicates(["th"])
        .select("th", "text")
    )


def confirmed(pairs: DataFrame, classes: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """The pairs whose whole shingle sets are similar enough."""
    used = pairs.select(F.explode(F.array("a", "b")).alias("th")).distinct()
    texts = cut(texts_of(used, classes, docs), "texts")
    with_a = pairs.join(texts.select(F.col("th").alias("a"), F.col("text").alias("ta")), "a")
    both = with_a.join(texts.select(F.col("th").alias("b"), F.col("text").alias("tb")), "b")
    return both.select("a", "b", "ta", "tb").mapInPandas(_verify(percent), "a long, b long")


def near_duplicates(docs: DataFrame, percent: int = 75) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_shingles, component_id (smallest doc_id reachable over links), kept.

    Two documents are linked if their five-word shingle sets have 100 * intersection >= percent * union. A null id is
    component_id only where no row of the component has an id.
    """
    return near_duplicate_rows(docs, percent).drop("th")


def near_duplicate_rows(docs: DataFrame, percent: int = 75) -> DataFrame:
    """near_duplicates with th, the hash of the text: of each component one (doc_id, th) is kept."""
    docs = docs.select("doc_id", "text")
    signed = by_text_id(docs.withColumn("th", F.xxhash64("text")), _sign, "doc_id string, th long, n long, d1 long, d2 long, sig binary", "doc_id")
    signed = cut(signed, "signed")
    some = signed.where("n > 0")
    classes = cut(some.groupBy("n", "d1", "d2").agg(F.min(F.struct(F.isnull("doc_id").alias("none"), "doc_id", "th")).alias("x"), F.first("sig").alias("sig")).select("n", "d1", "d2", F.col("x.doc_id").alias("rep"), F.col("x.th").alias("th"), "sig"), "classes")
    linked = cut(confirmed(cut(candidates(classes, 0, FIRST_TREES, 1)[0], "pairs"), classes, docs, percent), "links")
    once = cut(connected_components(linked), "once")
    rest, runs = candidates(classes, FIRST_TREES, TREES, NEAR, runs=True)
    for x in "ab":
        rest = rest.join(once.select(F.col("node").alias(x), F.col("component").alias(f"c{x}")), x, "left")
    rest = rest.where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b")
    more = confirmed(cut(rest, "pairs"), classes, docs, percent)
    links = once.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more)
    whole = cut(connected_components(links), "whole")
    crowded = crowded_pairs(runs, whole, classes, docs, percent)
    if crowded is not None:
        more = confirmed(cut(crowded, "pairs"), classes, docs, percent)
        links = whole.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more)
        whole = cut(connected_components(links), "whole")
    named = classes.select("n", "d1", "d2", "rep", "th").join(whole.withColumnRenamed("node", "th"), "th", "left")
    named = named.withColumn("component", F.coalesce("component", "th"))
    least = named.groupBy("component").agg(F.min(F.struct(F.isnull("rep").alias("none"), "rep", "th")).alias("least"))
    named = named.join(least, "component").select("n", "d1", "d2", F.col("least.rep").alias("least"), F.col("least.th").alias("lh"))
    out = some.select("doc_id", "th", "n", "d1", "d2").join(named, ["n", "d1", "d2"]).select("doc_id", "th", "n", "least", "lh")
    out = out.unionByName(signed.where("n = 0").select("doc_id", "th", "n", F.col("doc_id").alias("least"), F.col("th").alias("lh")))
    kept = F.col("doc_id").eqNullSafe(F.col("least")) & (F.col("th") == F.col("lh"))
    return out.select("doc_id", "th", F.col("n").alias("n_shingles"), F.col("least").alias("component_id"), kept.alias("kept"))
