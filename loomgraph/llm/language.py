"""Language by a bidirectional gated recurrent network over bytes, trained in numpy by backpropagation through time.

The network reads words (runs between blanks, at most `LONGEST` bytes at a time) from both sides and gives every byte a
distribution over the languages; a document's probabilities are the mean over all its bytes. A word's sums depend on
the word alone, so a worker remembers them.

Training takes about `DOCUMENTS` documents of each language, chosen by a hash of the id, and at most `WORDS` words of
each; the `LANGUAGES` most frequent values of lang are learned. Null texts and texts without a letter are `und` with
score 1; without training rows everything is `und`. A task holds one batch of texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_text_id, id_remainder

DOCUMENTS, WORDS, LANGUAGES, LONGEST, REMEMBERED = 400, 48, 64, 16, 300_000
HIDDEN, STEPS, BATCH = 16, 700, 256


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


class Network:
    """Two GRUs of `hidden` units and one softmax for each position."""

    def __init__(self, classes: int, hidden: int = HIDDEN, seed: int = 1):
        r = np.random.default_rng(seed)
        self.h, self.p = hidden, {}
        for d in "fb":
            self.p["e" + d] = r.normal(0, 0.3, (257, 3 * hidden)).astype(np.float32)  # a byte's part of all gates
            self.p["u" + d] = r.normal(0, 0.3, (hidden, 3 * hidden)).astype(np.float32)
        self.p["w"] = r.normal(0, 0.3, (2 * hidden, classes)).astype(np.float32)
        self.p["c"] = np.zeros(classes, np.float32)

    def _forward(self, x: np.ndarray, d: str) -> tuple[np.ndarray, list]:
        """x: (words, length) bytes, 256 for none. States of each position, and what going back needs."""
        h, n = self.h, len(x)
        e, u = self.p["e" + d], self.p["u" + d]
        s = np.zeros((n, h), np.float32)
        out, kept = np.empty((n, x.shape[1], h), np.float32), []
        for t in range(x.shape[1]) if d == "f" else reversed(range(x.shape[1])):
            a = e[x[:, t]]
            v = s @ u
            g = _sigmoid(a[:, : 2 * h] + v[:, : 2 * h])
            z, r = g[:, :h], g[:, h:]
            c = np.tanh(a[:, 2 * h :] + r * v[:, 2 * h :])
            on = (x[:, t] < 256)[:, None]
            new = np.where(on, s + z * (c - s), s)
            kept.append((t, s, z, r, c, v[:, 2 * h :], on))
            out[:, t] = s = new
        return out, kept

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        o = np.concatenate([self._forward(x, "f")[0], self._forward(x, "b")[0]], axis=2) @ self.p["w"] + self.p["c"]
        o = np.exp(o - o.max(axis=2, keepdims=True))
        return o / o.sum(axis=2, keepdims=True)

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean loss over all positions and its gradients, back through time in both directions."""
        h = self.h
        runs = {d: self._forward(x, d) for d in "fb"}
        both = np.concatenate([runs["f"][0], runs["b"][0]], axis=2)
        o = both @ self.p["w"] + self.p["c"]
        o = np.exp(o - o.max(axis=2, keepdims=True))
        p = o / o.sum(axis=2, keepdims=True)
        on = (x < 256).astype(np.float32)
        loss = -(np.log(p[np.arange(len(x))[:, None], np.arange(x.shape[1]), y[:, None]] + 1e-9) * on).sum() / on.sum()
        p[np.arange(len(x))[:, None], np.arange(x.shape[1]), y[:, None]] -= 1
        p *= (on / on.sum())[:, :, None]
        grad = {k: np.zeros_like(v) for k, v in self.p.items()}
        grad["w"] = np.einsum("nth,ntc->hc", both, p)
        grad["c"] = p.sum(axis=(0, 1))
        back = p @ self.p["w"].T
        for d, part in (("f", back[:, :, :h]), ("b", back[:, :, h:])):
            u, ds = self.p["u" + d], np.zeros((len(x), h), np.float32)
            for t, s, z, r, c, vc, m in reversed(runs[d][1]):
                ds = ds + part[:, t]
                live = np.where(m, ds, 0)
                dc = live * z * (1 - c * c)
                dz = live * (c - s) * z * (1 - z)
                dr = dc * vc * r * (1 - r)
                gates = np.concatenate([dz, dr, dc], axis=1)
                inner = np.concatenate([dz, dr, dc * r], axis=1)
                np.add.at(grad["e" + d], x[:, t], gates)
                grad["u" + d] += s.T @ inner
                ds = np.where(m, ds * (1 - z), ds) + inner @ u.T
        return float(loss), grad

    def train(self, x: np.ndarray, y: np.ndarray, steps: int = STEPS, batch: int = BATCH, rate: float = 0.01, seed: int = 2) -> float:
        """Adam on random batches; returns the last loss."""
        r = np.random.default_rng(seed)
        m, v, loss = {k: np.zeros_like(p) for k, p in self.p.items()}, {k: np.zeros_like(p) for k, p in self.p.items()}, 0.0
        for i in range(1, steps + 1):
            at = r.integers(0, len(x), batch)
            loss, grad = self.gradients(x[at], y[at])
            step = rate * min(1.0, 3 * (1 - (i - 1) / steps)) * np.sqrt(1 - 0.999**i) / (1 - 0.9**i)
            for k, g in grad.items():
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                self.p[k] = (self.p[k] - step * m[k] / (np.sqrt(v[k]) + 1e-8)).astype(np.float32)
        return loss


def as_bytes(words: list[bytes]) -> np.ndarray:
    """Words as rows of bytes, filled with 256."""
    n = max(map(len, words), default=1)
    flat = np.frombuffer(b"".join(w.ljust(n, b"\0") for w in words), np.uint8).reshape(len(words), n).astype(np.int32)
    flat[np.arange(n) >= np.array([len(w) for w in words])[:, None]] = 256
    return flat


def pieces(word: bytes) -> list[bytes]:
    return [word[i : i + LONGEST] for i in range(0, len(word), LONGEST)]


class Reader:
    def __init__(self, net: Network):
        self.net, self.known = net, {}

    def learn(self, words: set[bytes]) -> None:
        """Remember the sums over all positions of words not met before."""
        if len(self.known) > REMEMBERED:
            self.known.clear()
        new = sorted((w for w in words if w not in self.known), key=len)
        for at in range(0, len(new), 2048):
            some = new[at : at + 2048]
            if len(some[-1]) <= LONGEST:
                x = as_bytes(some)
                sums = np.where((x < 256)[:, :, None], self.net.probabilities(x), 0).sum(axis=1)
            else:
                cuts = [pieces(w) for w in some]
                flat = [p for c in cuts for p in c]
                sums, first = [], 0
                each = []
                for i in range(0, len(flat), 2048):
                    x = as_bytes(flat[i : i + 2048])
                    each.append(np.where((x < 256)[:, :, None], self.net.probabilities(x), 0).sum(axis=1))
                each = np.concatenate(each)
                for c in cuts:
                    sums.append(each[first : first + len(c)].sum(axis=0))
                    first += len(c)
            self.known.update(zip(some, sums))

    def read(self, texts: list[str | None]) -> np.ndarray:
        """Mean probabilities over all bytes of words, a row for each text."""
        split = [(x or "").lower().encode("utf-8", "replace").split() for x in texts]
        self.learn({w for s in split for w in s})
        k = self.net.p["c"].shape[0]
        out = np.full((len(texts), k), 1 / k)
        for i, s in enumerate(split):
            if s:
                total = np.array([self.known[w] for w in s], np.float32).sum(axis=0, dtype=np.float64)
                out[i] = total / total.sum()
        return out


_readers: dict[bytes, Reader] = {}


def identify_language(docs: DataFrame, fold: int = 3, out_fold: int = 1) -> DataFrame:
    """docs(doc_id, text, lang) -> doc_id, held_out, lang_pred, score."""
    held = id_remainder(F.col("doc_id"), fold) == out_fold
    known = docs.where(~held & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES).collect()}
    langs = sorted(counts)
    share = F.lit(0)
    for k in langs:
        share = F.when(F.col("lang") == k, min(1_000_000, 1_000_000 * DOCUMENTS // counts[k] + 1)).otherwise(share)

    def words(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for i, text, k in zip(f["doc_id"], f["text"], f["lang"]):
                split = text.lower().encode("utf-8", "replace").split()
                r = np.random.default_rng(abs(int(i)) if i == i and i is not None else 0)
                rows += [(langs.index(k), pieces(split[j])[0]) for j in r.permutation(len(split))[:WORDS]]
            yield pd.DataFrame(rows, columns=["y", "w"])

    sample = known.where(F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1_000_000)) < share).select("doc_id", "text", "lang")
    most = 2 * DOCUMENTS * WORDS * max(len(langs), 1)
    got = sample.mapInPandas(words, "y int, w binary").orderBy("y", "w").limit(most).toPandas() if langs else pd.DataFrame()
    params, key = None, b""
    if len(got):
        net = Network(len(langs))
        net.train(as_bytes([bytes(w) for w in got["w"]]), got["y"].to_numpy())
        params, key = net.p, net.p["w"].tobytes()

    def predict(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from .wordhash import batches

        if params is not None and key not in _readers:
            _readers.clear()
            own = Network(len(langs))
            own.p = params
            _readers[key] = Reader(own)
        for f in frames:
            texts = f["text"].tolist()
            for a, b in batches(texts):
                part = f.iloc[a:b]
                some = np.array([bool(x) and any(map(str.isalpha, x)) and params is not None for x in texts[a:b]])
                pred, score = np.full(len(part), "und", object), np.ones(len(part))
                if some.any():
                    p = _readers[key].read([x for x, ok in zip(texts[a:b], some) if ok])
                    pred[some] = np.array(langs, object)[p.argmax(axis=1)]
                    score[some] = p.max(axis=1)
                yield pd.DataFrame({"doc_id": part["doc_id"], "held_out": part["held_out"], "lang_pred": pred, "score": score})

    rows = docs.select("doc_id", "text", held.alias("held_out"))
    return by_text_id(rows, predict, "doc_id string, held_out boolean, lang_pred string, score double", "doc_id")
