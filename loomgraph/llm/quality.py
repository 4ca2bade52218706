"""Document quality: histogram gradient-boosted trees over statistics of whole texts.

Statistics are counts over a text's bytes, words and lines. At most `LABELLED` labelled documents (those with the smallest
hashes of the id) train the trees on the driver: statistics become `BINS` quantile bins, each level of a tree takes the best
splits of one histogram, and the finished trees are flat arrays of complete binary trees, which numpy walks for all rows and
trees at once.

Null and empty texts have statistics of zero; labels null or of unknown documents are not used, the larger of conflicting
ones counts; with labels of one kind only, all scores are its share (0.5 without labels). An empty table gives no rows. A
task holds one batch of texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_text_id, id_remainder
from .wordhash import LOWER, batches, mix, running, span_hash

LABELLED, BINS, TREES, DEPTH, RATE, RIDGE, LEAST = 20_000, 64, 120, 4, 0.1, 1.0, 2.0
#: Kinds of bytes that are counted.
_KINDS = ["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t", "\n", ".", "!", "?", ",;:", "#$%&*@^~+=<>`", "|\\/_{}[]", "'\"-()"]
_BEYOND = len(_KINDS)
_KIND = np.array([next((k for k, x in enumerate(_KINDS) if chr(b) in x), _BEYOND if b < 128 else _BEYOND + 1) for b in range(256)], np.uint8)
_LOWERED = np.frombuffer(LOWER, np.uint8)
_IS_WORD = np.array([not (b == 32 or 9 <= b <= 13) for b in range(256)])


def _shares(key: np.ndarray, h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """For each key below n: distinct hashes, and the count of the commonest."""
    order = np.lexsort((h, key))
    k, v = key[order], h[order]
    first = np.flatnonzero(np.concatenate([[True], (k[1:] != k[:-1]) | (v[1:] != v[:-1])])) if len(k) else np.zeros(0, np.int64)
    times = np.diff(np.append(first, len(k)))
    most = np.zeros(n, np.int64)
    np.maximum.at(most, k[first], times)
    return np.bincount(k[first], minlength=n), most


def statistics(texts: list[str | None]) -> np.ndarray:
    """One row of numbers for each text."""
    n = len(texts)
    raw = [(x or "").encode("utf-8", "surrogatepass") for x in texts]
    size = np.array([len(x) for x in raw], np.int64)
    buf = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
    at = np.concatenate([[0], np.cumsum(size + 1)])
    doc = np.repeat(np.arange(n), size + 1)
    kind = _KIND[buf]
    kinds = np.bincount(doc * (_BEYOND + 2) + kind, minlength=n * (_BEYOND + 2)).reshape(n, -1)
    kinds[:, 4] -= 1  # the byte behind each text
    edge = np.diff(np.concatenate([[0], _IS_WORD[buf].view(np.int8)]))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    sums = running(_LOWERED[buf])
    word, of = mix(span_hash(sums, starts, ends) ^ (ends - starts).astype(np.uint64)), doc[starts]
    words = np.bincount(of, minlength=n)

    def among(flag: np.ndarray) -> np.ndarray:
        """Words of each text with a flagged byte."""
        total = np.concatenate([[0], np.cumsum(flag)])
        return np.bincount(of, weights=total[ends] > total[starts], minlength=n)

    def repeats(step: int) -> np.ndarray:
        same = (word[step:] == word[:-step]) & (of[step:] == of[:-step])
        return np.bincount(of[step:], weights=same, minlength=n)

    distinct, most = _shares(of, word, n)
    line_end = np.flatnonzero(buf == 10)
    line_start = np.concatenate([[0], line_end[:-1] + 1])
    full = line_end > line_start
    line_start, line_end = line_start[full], line_end[full]
    line_of = doc[line_start]
    lines = np.bincount(line_of, minlength=n)
    line_kinds, line_most = _shares(line_of, mix(span_hash(sums, line_start, line_end) ^ (line_end - line_start).astype(np.uint64)), n)
    longest = np.zeros(n, np.int64)
    np.maximum.at(longest, of, ends - starts)
    w, b, m = np.maximum(words, 1), np.maximum(size, 1), np.maximum(lines, 1)
    per_byte = [kinds[:, k] / b for k in (0, 1, 2, _BEYOND + 1)]
    per_word = [kinds[:, k] / w for k in (3, 4, 5, 6, 7, 8, 9, 10, 11, _BEYOND)]
    lower, upper = among(kind == 0), among(kind == 1)
    flags = [lower, upper, among(kind == 2), among((kind == 9) | (kind == 10)), among(kind == 6), np.bincount(of, weights=ends - starts <= 2, minlength=n), repeats(1), repeats(2)]
    rest = [np.log1p(size), np.log1p(words), size / w, np.log1p(longest), distinct / w, most / w, np.log1p(lines), words / m, line_kinds / m, line_most / m]
    assert at[-1] == len(buf)
    return np.stack(per_byte + per_word + [x / w for x in flags] + rest, axis=1)


class Trees:
    """Flat arrays: node i of a tree has its children at 2 i + 1 and 2 i + 2; the last level holds the leaves."""

    def __init__(self, start: float, trees: int, depth: int):
        self.start, self.depth = start, depth
        self.feature = np.zeros((trees, (1 << depth) - 1), np.int32)
        self.limit = np.full((trees, (1 << depth) - 1), np.inf)
        self.leaf = np.zeros((trees, 1 << depth))

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Sums of the leaves that each row reaches, over all trees."""
        out = np.full(len(x), self.start)
        t = np.arange(len(self.leaf))[None, :]
        for at in range(0, len(x), 2048):
            part = x[at : at + 2048]
            rows, node = np.arange(len(part))[:, None], np.zeros((len(part), len(self.leaf)), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (part[rows, self.feature[t, node]] > self.limit[t, node])
            out[at : at + 2048] += self.leaf[t, node - ((1 << self.depth) - 1)].sum(axis=1)
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -30, 30)))


def train(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH) -> Trees:
    """Boosted trees for the logistic loss; x: rows of statistics, y: 0 or 1."""
    n, width = x.shape
    share = (y.sum() + 0.5) / (n + 1) if n else 0.5
    if n == 0 or y.min() == y.max():
        share = float(y.mean()) if n else 0.5
        return Trees(float(np.log(max(share, 1e-6) / max(1 - share, 1e-6))), 0, depth)
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1], method="lower")) for j in range(width)]
    bins = np.stack([np.searchsorted(cuts[j], x[:, j], side="left") for j in range(width)], axis=1)  # bin b: at most cuts[b]
    out, margin = Trees(float(np.log(share / (1 - share))), trees, depth), np.full(n, np.log(share / (1 - share)))
    column = np.arange(width)[None, :] * BINS
    for t in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            first, many = (1 << level) - 1, 1 << level
            key = ((node - first)[:, None] * width * BINS + column + bins).ravel()
            gs, hs = (np.bincount(key, weights=np.repeat(v, width), minlength=many * width * BINS).reshape(many, width, BINS).cumsum(axis=2) for v in (g, h))
            ga, ha = gs[:, :1, -1:], hs[:, :1, -1:]
            gain = gs**2 / (hs + RIDGE) + (ga - gs) ** 2 / (ha - hs + RIDGE) - ga**2 / (ha + RIDGE)
            gain = np.where((hs >= LEAST) & (ha - hs >= LEAST), gain, 0).reshape(many, -1)
            best = gain.argmax(axis=1)
            for k in np.flatnonzero(gain[np.arange(many), best] > 1e-9):
                j, b = divmod(int(best[k]), BINS)
                if b < len(cuts[j]):
                    out.feature[t, first + k], out.limit[t, first + k] = j, cuts[j][b]
            node = 2 * node + 1 + (x[np.arange(n), out.feature[t, node]] > out.limit[t, node])
        leaf = node - ((1 << depth) - 1)
        sums = [np.bincount(leaf, weights=v, minlength=1 << depth) for v in (g, h)]
        out.leaf[t] = -RATE * sums[0] / (sums[1] + RIDGE)
        margin += out.leaf[t][leaf]
    return out


def _measured(frames: Iterator[pd.DataFrame]) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    for f in frames:
        texts = f["text"].tolist()
        for a, b in batches(texts):
            yield f.iloc[a:b], statistics(texts[a:b])


def score_quality(docs: DataFrame, labels: DataFrame, fold: int = 3) -> DataFrame:
    """docs(doc_id, text), labels(doc_id, quality) -> doc_id, held_out, score, predicted."""
    chosen = labels.where(id_remainder(F.col("doc_id"), fold) != 1).where(F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.max("quality").alias("y"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(LABELLED)
    known = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "y", F.xxhash64("doc_id", "text").alias("at"))

    def measure(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f, x in _measured(frames):
            yield pd.DataFrame({"x": list(x), "y": f["y"].to_numpy(), "at": f["at"].to_numpy()})

    # repeated ids may make more rows than labels
    seen = known.mapInPandas(measure, "x array<double>, y int, at long").orderBy("at", "y", "x").limit(LABELLED).toPandas()
    x = np.stack(seen["x"]) if len(seen) else np.zeros((0, 1))
    order = np.lexsort((*x.T, seen["y"].to_numpy(int)))
    model = train(x[order], seen["y"].to_numpy(float)[order])

    def score(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f, x in _measured(frames):
            p = model.score(x)
            yield pd.DataFrame({"doc_id": f["doc_id"].to_numpy(), "held_out": f["held_out"].to_numpy(), "score": p, "predicted": (p >= 0.5).astype(np.int32)})

    rows = docs.select("doc_id", (id_remainder(F.col("doc_id"), fold) == 1).alias("held_out"), "text")
    return by_text_id(rows, score, "doc_id string, held_out boolean, score double, predicted int", "doc_id")
