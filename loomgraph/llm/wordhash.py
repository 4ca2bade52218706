"""Vectorised word and shingle hashes over UTF-8 bytes.

Words are maximal runs of bytes other than space and 0x09-0x0D, with A-Z lower-cased. A word's hash is a polynomial
over its bytes modulo 2**64, read from running sums of a whole batch, then mixed; there is no loop over words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_U = np.uint64
BASE, INVERSE = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_IS_WORD = np.array([not (b == 32 or 9 <= b <= 13) for b in range(256)])
_BYTE = np.random.default_rng(20240601).integers(1, 1 << 63, 256, dtype=np.uint64)
_STEP = np.random.default_rng(20240602).integers(1, 1 << 63, 16, dtype=np.uint64) | _U(1)
_powers: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every input bit."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        n = max(n, 1 << 20)
        ones = np.ones(n, np.uint64)
        ones[0] = 1
        both = []
        for b in (BASE, INVERSE):
            x = np.full(n, _U(b))
            x[0] = 1
            both.append(np.multiply.accumulate(x))
        _powers[:] = both
    return _powers[0], _powers[1]


def running(buf: np.ndarray) -> np.ndarray:
    """Sums of byte values times powers up to each offset; [i] covers buf[:i]."""
    up, _ = powers(len(buf) + 1)
    out = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(_BYTE[buf] * up[: len(buf)], out=out[1:])
    return out


def span_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    _, down = powers(len(sums))
    return (sums[ends] - sums[starts]) * down[starts]


def batches(texts: list[str | None], size: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about `size` characters; one text is never divided."""
    first, total = 0, 0
    for i, x in enumerate(texts):
        total += len(x or "")
        if total >= size:
            yield first, i + 1
            first, total = i + 1, 0
    if first < len(texts):
        yield first, len(texts)


def words(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and for each text the range of its words: bounds[i] to bounds[i + 1]."""
    raw = [(x or "").encode("utf-8", "surrogatepass").translate(LOWER) for x in texts]
    buf = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
    edge = np.diff(np.concatenate([[0], _IS_WORD[buf].view(np.int8)]))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    h = mix(span_hash(running(buf), starts, ends) ^ (ends - starts).astype(np.uint64))
    offsets = np.concatenate([[0], np.cumsum([len(x) + 1 for x in raw])])
    return h, np.searchsorted(starts, offsets)


def shingles(texts: list[str | None], k: int = 5) -> list[np.ndarray]:
    """For each text its sorted distinct k-word shingles; fewer words make one shingle, no word none."""
    h, bounds = words(texts)
    m = max(len(h) - k + 1, 0)
    whole = np.zeros(m, np.uint64)
    for j in range(k):
        whole += h[j : j + m] * _STEP[j]
    whole = mix(whole)
    out = []
    for a, b in zip(bounds[:-1], bounds[1:]):
        if b - a >= k:
            out.append(np.unique(whole[a : b - k + 1]))
        elif b > a:
            one = (h[a:b] * _STEP[: b - a]).sum(dtype=np.uint64) + _U(b - a)
            out.append(mix(np.array([one], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
