"""Leading eigenpairs of a symmetric matrix by spectrum slicing.

An LDL' factorisation of a shifted matrix has as many positive pivots as there are eigenvalues above the shift. Such counts
cut the line until one eigenvalue is alone between two shifts; Rayleigh quotient iteration then converges cubically to its
pair, and two more counts beside the result certify its number. Equal eigenvalues cannot be isolated: their interval shrinks
to rounding, and vectors of one cluster are kept orthogonal.
"""

from __future__ import annotations

import numpy as np

_EPS = float(np.finfo(float).eps)
#: Where a single pivot is stable enough against a pair of rows (complete pivoting).
_ALPHA = (1 + 17**0.5) / 8


def count_above(a: np.ndarray, shift: float) -> int:
    """Eigenvalues of a above the shift: positive pivots of LDL' of a - shift I, of one or two rows each."""
    m = a - shift * np.eye(len(a))
    above = 0
    while len(m):
        diag = np.abs(np.diagonal(m))
        p = int(diag.argmax())
        off = np.abs(np.tril(m, -1))
        r, s = divmod(int(off.argmax()), len(m))
        if diag[p] == 0 and off[r, s] == 0:
            break
        if diag[p] >= _ALPHA * off[r, s]:
            above += m[p, p] > 0
            rest = np.delete(np.arange(len(m)), p)
            col = m[rest, p]
            m = m[np.ix_(rest, rest)] - np.outer(col, col / m[p, p])
        else:  # a pair of rows whose block has one eigenvalue of either sign
            above += 1
            rest = np.delete(np.arange(len(m)), [r, s])
            cols = m[np.ix_(rest, [r, s])]
            m = m[np.ix_(rest, rest)] - cols @ np.linalg.solve(m[np.ix_([r, s], [r, s])], cols.T)
    return int(above)


class Spectrum:
    """Shifts whose counts are known, and the pairs found so far."""

    def __init__(self, a: np.ndarray):
        self.a = (a + a.T) / 2
        self.scale = float(np.abs(self.a).sum(axis=1).max()) or 1.0
        self.counts = {-2 * self.scale: len(a), 2 * self.scale: 0}
        self.values: list[float] = []
        self.vectors: list[np.ndarray] = []

    def count(self, shift: float) -> int:
        if shift not in self.counts:
            self.counts[shift] = count_above(self.a, shift)
        return self.counts[shift]

    def bracket(self, k: int) -> tuple[float, float]:
        """The closest known shifts around the k-th largest eigenvalue."""
        return max(s for s, c in self.counts.items() if c >= k), min(s for s, c in self.counts.items() if c < k)

    def halve(self, k: int) -> None:
        lo, hi = self.bracket(k)
        self.count((lo + hi) / 2)

    def isolated(self, k: int) -> bool:
        lo, hi = self.bracket(k)
        return self.counts[lo] == k and self.counts[hi] == k - 1 or hi - lo <= 16 * _EPS * self.scale

    def _orthogonal(self, v: np.ndarray) -> np.ndarray:
        for _ in range(2):
            for u in self.vectors:
                v = v - (u @ v) * u
        return v / np.linalg.norm(v)

    def _step(self, v: np.ndarray, shift: float) -> np.ndarray:
        eye = np.eye(len(v))
        for nudge in (0.0, 1.0, 64.0):
            try:
                w = np.linalg.solve(self.a - (shift + nudge * _EPS * self.scale) * eye, v)
            except np.linalg.LinAlgError:
                continue
            if np.isfinite(w).all() and w.any():
                return self._orthogonal(w / np.abs(w).max())
        return v

    def converge(self, k: int) -> tuple[float, np.ndarray]:
        """Rayleigh quotient iteration from the middle of the bracket; a quotient that leaves it narrows the bracket."""
        v = self._orthogonal(np.random.default_rng(k).standard_normal(len(self.a)))
        lo, hi = self.bracket(k)
        for _ in range(3):
            v = self._step(v, (lo + hi) / 2)
        best = None
        for _ in range(200):
            lo, hi = self.bracket(k)
            value = float(v @ self.a @ v)
            off = float(np.linalg.norm(self.a @ v - value * v))
            last = best
            if lo - off <= value <= hi + off and (best is None or off < best[0]):
                best = (off, value, v)
            if best and (best[0] <= 4 * _EPS * self.scale or last and last[0] < 1e-12 * self.scale and best[0] > last[0] / 2):
                break
            if lo <= value <= hi:
                v = self._step(v, value)
            elif hi - lo > 16 * _EPS * self.scale:
                self.halve(k)
                lo, hi = self.bracket(k)
                v = self._step(v, (lo + hi) / 2)
            else:
                v = self._step(v, (lo + hi) / 2)
        if best is None:
            raise ArithmeticError(f"eigenvalue {k} was isolated but not reached")
        return best[1], best[2]

    def next(self) -> tuple[float, np.ndarray]:
        k = len(self.values) + 1
        while not self.isolated(k):
            self.halve(k)
        value, v = self.converge(k)
        near = 64 * len(self.a) * _EPS * self.scale
        if self.count(value - near) < k or self.count(value + near) >= k:
            raise ArithmeticError(f"eigenvalue {k} is not certified by the counts beside it")
        self.values.append(value)
        self.vectors.append(v)
        return value, v


def leading(a: np.ndarray, want: int) -> tuple[np.ndarray, np.ndarray]:
    """Up to `want` largest eigenvalues with unit vectors (rows), largest first; those that are zero to rounding are left out."""
    least = 4 * len(a) * _EPS * float(np.trace(a)) if len(a) else 0.0
    s = Spectrum(a) if len(a) else None
    while s and len(s.values) < min(want, len(a)):
        if s.next()[0] <= least:
            s.values.pop(), s.vectors.pop()
            break
    return np.array(s.values if s else []), np.array(s.vectors if s else []).reshape(-1, len(a))
