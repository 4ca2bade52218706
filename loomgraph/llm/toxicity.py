"""Toxicity by a noisy channel: restore disguised words, then score the restored text.

A disguised token (leetspeak, inserted marks, letters spaced out or repeated) is a lattice of characters: each symbol
stands for itself, for the letters it imitates, or for nothing. Viterbi decoding under a character trigram model,
counted over all documents, picks the likeliest reading. Plain words have one reading only and are not decoded. In runs of
letters spaced out and in words chained by marks, a blank or mark may also end a word; long ones are read in windows.

The score is a logistic function of how many restored words carry strong evidence. Evidence is the log ratio of document
shares of a word or a word's beginning, counted over at most `LABELLED` labelled documents (those with the smallest
hashes of the id), of which at most `EVIDENCE` entries are kept.

Null and empty texts have no evidence and get the score of that; labels null or of unknown documents are not used; with
no labels of one kind all scores are the share of label 1 (0.5 without labels). A task holds one batch of texts.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_text_id, cut, id_remainder
from .wordhash import batches

LABELLED, EVIDENCE, REMEMBERED = 20_000, 20_000, 400_000
#: Up to so many characters a token is read as one word too; characters of a window, and those it shares with the next.
WHOLE, WINDOW, SHARED = 64, 256, 96
#: What a symbol may stand for besides itself.
IMITATES = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "il", "+": "t", "|": "li", "(": "c", "€": "e", "£": "l"}
#: What may be inserted between letters.
MARKS = frozenset(" .-_*~'`^/\\,:;#=")
COST_SWAP, COST_DROP, COST_REPEAT = 0.7, 0.5, 1.0
_EDGE = ".,;:!?\"'()[]{}<>«»„“”…-_*#%&|/\\"
_ODD = re.compile(r"[^\W\d_][^\w\s]+\w|\w[^\w\s]+[^\W\d_]|[^\W\d_][\d_]|[\d_][^\W\d_]|[@$!€£+|(]\w|\w[@$!€£+|]|(\w)\1\1")
#: Words may be chained: a mark inside, and more letters than a disguised word has without it.
_CHAIN = re.compile(r"\w\w[.\-_*~'`^/\\,:;#=]+\w\w|(?:\w[.\-_*~'`^/\\,:;#=]+){5}\w")
_SYMBOLS = 28


def _symbol(c: str) -> int:
    return ord(c) - 96 if "a" <= c <= "z" else 27 if ord(c) > 127 else 0


_CODE = np.array([b - 96 if 97 <= b <= 122 else b - 64 if 65 <= b <= 90 else 27 if b > 127 else 0 for b in range(256)], np.int32)


def count_trigrams(docs: DataFrame) -> DataFrame:
    """(code, n) of character trigrams over all texts; at most 28**3 codes."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(_SYMBOLS**3, np.int64)
        for f in frames:
            texts = f["text"].tolist()
            for a, b in batches(texts):
                s = _CODE[np.frombuffer(" ".join(x or "" for x in texts[a:b]).encode("utf-8", "replace"), np.uint8)]
                if len(s) > 2:
                    total += np.bincount((s[:-2] * _SYMBOLS + s[1:-1]) * _SYMBOLS + s[2:], minlength=len(total))
        at = np.flatnonzero(total)
        yield pd.DataFrame({"code": at, "n": total[at]})

    return docs.select("text").mapInPandas(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))


class Channel:
    """Restores one token at a time."""

    def __init__(self, counts: dict[int, int]):
        table = np.full(_SYMBOLS**3, 0.05)
        for code, n in counts.items():
            table[code] += n
        table = table.reshape(_SYMBOLS, _SYMBOLS, _SYMBOLS)
        self.cost = -np.log(table / table.sum(axis=2, keepdims=True))

    def restore(self, token: str, divide: bool = False) -> str:
        """The likeliest letters behind a token; states are the last two symbols and the last character. With divide,
        marks may also be blanks between words."""
        best: dict[tuple[int, int, str], tuple[float, str]] = {(0, 0, ""): (0.0, "")}
        for i, c in enumerate(token):
            then: dict[tuple[int, int, str], tuple[float, str]] = {}
            arcs = [(x, COST_SWAP) for x in IMITATES.get(c, "")]
            if c.isalnum():
                arcs.append((c, 0.0 if c.isalpha() else 3.0))
            for (p, q, last), (cost, out) in best.items():
                for x, extra in arcs:
                    s = _symbol(x)
                    key = (q, s, x)
                    total = cost + extra + float(self.cost[p, q, s])
                    if key not in then or total < then[key][0]:
                        then[key] = (total, out + x)
                drop = COST_REPEAT if any(x == last for x, _ in arcs) and last else COST_DROP if not c.isalnum() and (c in MARKS or not arcs) else None
                if divide and c in MARKS and last not in ("", " "):
                    key = (q, 0, " ")
                    total = cost + COST_DROP + float(self.cost[p, q, 0])
                    if key not in then or total < then[key][0]:
                        then[key] = (total, out + " ")
                if drop is not None:
                    key = (p, q, last)
                    if key not in then or cost + drop < then[key][0]:
                        then[key] = (cost + drop, out)
            best = then or best
        return min((cost + float(self.cost[p, q, 0]), out) for (p, q, _), (cost, out) in best.items())[1]


    def divided(self, token: str) -> list[str]:
        """The words behind a token of any length; a word that a window cuts off is read in the next one."""
        out: list[str] = []
        for at in range(0, max(len(token) - SHARED, 1), WINDOW - SHARED):
            found = self.restore(token[at : at + WINDOW], divide=True).split()
            last = at + WINDOW >= len(token)
            out += found if at == 0 and (last or len(found) == 1) else found[at > 0 : None if last else -1]
        return out


def tokens(text: str | None) -> set[str]:
    """Distinct lower-case words, with letters spaced out by blanks as one token."""
    if not text:
        return set()
    words = text.lower().split()
    out = set(words)
    run: list[str] = []
    ones = [i for i, w in enumerate(words) if len(w) == 1 and (w.isalnum() or w in IMITATES)]
    for i, at in enumerate(ones):
        run.append(words[at])
        if i + 1 == len(ones) or ones[i + 1] != at + 1:
            if len(run) >= 3 and sum(x.isalpha() for x in run) > len(run) // 2:
                out.add(" ".join(run))
            run = []
    return out


class Reader:
    """Evidence of tokens, remembered by a worker."""

    def __init__(self, counts: dict[int, int], weights: dict[str, float]):
        self.channel, self.weights, self.known, self.inside = Channel(counts), weights, {}, {}

    def readings(self, token: str) -> list[str]:
        plain = token.strip(_EDGE)
        if not (" " in token or _ODD.search(token)) or not any(c.isalpha() for c in token):
            return [plain]
        if len(token) > WHOLE:
            return [plain]  # its words are tokens of their own
        return [plain, self.channel.restore(token), self.channel.restore(plain)]

    def tokens(self, text: str | None) -> set[str]:
        """The tokens of a text, and the words of those that may hold several."""
        out = tokens(text)
        for token in [t for t in out if " " in t or _CHAIN.search(t) or len(t) > WHOLE and _ODD.search(t)]:
            if token not in self.inside:
                if len(self.inside) > REMEMBERED // 10:
                    self.inside.clear()
                self.inside[token] = [w for w in self.channel.divided(token) if len(w) > 2]
            out.update(self.inside[token])
        return out

    def entries(self, token: str) -> set[str]:
        out: set[str] = set()
        for w in self.readings(token):
            if len(w) > 1:
                out.add(w)
                out.update(f"{w[:k]}*" for k in (3, 4, 5) if len(w) > k)
        return out

    def weight(self, token: str) -> float:
        if token not in self.known:
            if len(self.known) > REMEMBERED:
                self.known.clear()
            self.known[token] = max((self.weights.get(e, 0.0) for e in self.entries(token)), default=0.0)
        return self.known[token]

    def evidence(self, text: str | None) -> list[float]:
        some = sorted((w for w in map(self.weight, self.tokens(text)) if w > 1.5), reverse=True)
        return [some[0] if some else 0.0, sum(some[:3]), math.log1p(sum(w > 4 for w in some)), math.log1p(len(some)), math.log1p(len(text or "")) / 4]


_readers: dict[str, Reader] = {}


def _reader(key: str, counts: dict[int, int], weights: dict[str, float]) -> Reader:
    if key not in _readers:
        _readers.clear()
        _readers[key] = Reader(counts, weights)
    return _readers[key]


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 50) -> np.ndarray:
    """Newton steps; the last coefficient is the intercept."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (p - y) + ridge * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _count_entries(counts: dict[int, int], wanted: set[str] | None):
    """Documents with each entry, by label; only wanted entries if given."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = Reader(counts, {})
        found: dict[int, Counter] = {0: Counter(), 1: Counter()}
        for f in frames:
            for text, y in zip(f["text"], f["y"]):
                mine: set[str] = set()
                for t in reader.tokens(text):
                    if t not in reader.known:
                        e = reader.entries(t)
                        if len(reader.known) > REMEMBERED:
                            reader.known.clear()
                        reader.known[t] = e if wanted is None else e & wanted
                    mine |= reader.known[t]
                found[int(y)].update(mine)
        rows = [(e, n, y) for y, c in found.items() for e, n in c.items()]
        yield pd.DataFrame(rows, columns=["entry", "n", "y"])

    return run


def score_toxicity(docs: DataFrame, labels: DataFrame, fold: int = 5) -> DataFrame:
    """docs(doc_id, text), labels(doc_id, toxic) -> doc_id, held_out, score, predicted."""
    return toxicity_rows(docs, labels, fold).drop("th")


def toxicity_rows(docs: DataFrame, labels: DataFrame, fold: int = 5) -> DataFrame:
    """score_toxicity with th, the hash of the text."""
    counts = {r["code"]: r["n"] for r in count_trigrams(docs).collect()}  # at most 28**3 rows
    chosen = labels.where(id_remainder(F.col("doc_id"), fold) != 0).where(F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").alias("y"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(LABELLED)
    train = cut(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "y"), "train")
    toxic = train.where("y = 1").mapInPandas(_count_entries(counts, None), "entry string, n long, y int")
    top = toxic.groupBy("entry").agg(F.sum("n").alias("t")).where("t >= 2").orderBy(F.desc("t"), "entry").limit(EVIDENCE)
    top = {r["entry"]: r["t"] for r in top.collect()}
    size = {r["y"]: r["n"] for r in train.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    n1, n0 = size.get(1, 0), size.get(0, 0)
    clean = train.where("y = 0").mapInPandas(_count_entries(counts, set(top)), "entry string, n long, y int")
    other = {r["entry"]: r["n"] for r in clean.groupBy("entry").agg(F.sum("n").alias("n")).collect()}  # at most EVIDENCE

    def weigh(less1: int, less0: int) -> dict[str, float]:
        """Log ratios of shares; a document that is counted itself is left out for its own score."""
        out = {}
        for e, t in top.items():
            t, n = t - less1, max(other.get(e, 0) - less0, 0)
            w = math.log((t + 0.1) / (n1 + 1)) - math.log((n + 0.5) / (n0 + 1))
            if t >= 2 and w > 1.5 and t * w > 8:
                out[e] = w
        return out

    weights = weigh(0, 0)
    key = hashlib.sha256(repr((sorted(counts.items()), sorted(weights.items()))).encode()).hexdigest()
    if n1 and n0:

        def measure(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            own = {0: Reader(counts, weigh(0, 1)), 1: Reader(counts, weigh(1, 0))}
            for f in frames:
                yield pd.DataFrame({"x": [own[int(y)].evidence(t) for t, y in zip(f["text"], f["y"])], "y": f["y"]})

        seen = train.mapInPandas(measure, "x array<double>, y int").toPandas()  # at most LABELLED rows of five numbers
        model = fit_logistic(np.stack(seen["x"]), seen["y"].to_numpy(float))
    else:
        model = np.array([0.0] * 5 + [math.log((n1 + 1) / (n0 + 1))])

    def score(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = _reader(key, counts, weights)
        for f in frames:
            x = np.array([reader.evidence(t) for t in f["text"]]).reshape(len(f), 5)
            p = 1 / (1 + np.exp(-np.clip(x @ model[:5] + model[5], -30, 30)))
            yield pd.DataFrame({"doc_id": f["doc_id"], "th": f["th"], "held_out": f["held_out"], "score": p, "predicted": (p >= 0.5).astype(np.int32)})

    rows = docs.select("doc_id", F.xxhash64("text").alias("th"), "text", (id_remainder(F.col("doc_id"), fold) == 0).alias("held_out"))
    return by_text_id(rows, score, "doc_id string, th long, held_out boolean, score double, predicted int", "doc_id")
