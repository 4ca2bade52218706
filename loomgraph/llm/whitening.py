"""Embeddings whitened on their leading components.

Entries become whole numbers (floor of 256 times the entry). Statistics are taken over the distinct vectors: exact sums,
then a covariance that is centred before it is multiplied, each as partial results that Spark adds row by row of the matrix.
One task for each vector length finds the leading eigenpairs by spectrum slicing (`spectrum.py`); every row is then projected
where it lies.

Vectors that are null or hold a null or non-finite entry are dropped, rows with a null id stay, repeated rows are all
returned; vectors of each length are whitened among themselves, and a table of more than `LENGTHS` lengths is refused.
Components without variance (all of them, if the vectors of a length are equal) are left out, as nothing can scale
them to one. A deviation beyond a long is null. Empty vectors and tables give no rows. The driver holds, for each length, sums
and the vectors of a few components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_text_id, cut
from .spectrum import leading

LENGTHS = 64
#: Matrix entries that a task gathers before it hands them on.
HELD = 1 << 22
Frames = Iterator[pd.DataFrame]


def whole_rows(vectors: DataFrame) -> DataFrame:
    """vec_id, d, x: usable vectors as whole numbers."""
    v = F.col("embedding").cast("array<double>")
    bad = F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    good = vectors.select("vec_id", v.alias("v")).where(F.col("v").isNotNull() & ~bad & (F.size("v") > 0))
    return good.select("vec_id", F.size("v").alias("d"), F.transform("v", lambda c: F.floor(c * 256)).alias("x"))


def _by_length(frames: Frames) -> Iterator[tuple[int, pd.DataFrame, np.ndarray]]:
    for f in frames:
        for d, g in f.groupby("d"):
            yield int(d), g, np.stack(g["x"]).astype(np.int64)


def _sums(frames: Frames) -> Frames:
    for d, _, x in _by_length(frames):
        yield pd.DataFrame({"d": d, "i": np.arange(d), "n": len(x), "hi": (x >> 32).sum(axis=0), "lo": (x & 0xFFFFFFFF).sum(axis=0)})


def _gathered(part):
    """Adds part(d, x), a matrix, over a task's rows of each length; yields its rows as (d, i, row)."""

    def rows(held: dict[int, np.ndarray]) -> Frames:
        for d, m in held.items():
            yield pd.DataFrame({"d": d, "i": np.arange(len(m)), "row": [r.tobytes() for r in m]})
        held.clear()

    def run(frames: Frames) -> Frames:
        held: dict[int, np.ndarray] = {}
        for d, _, x in _by_length(frames):
            m = part(d, x)
            held[d] = held[d] + m if d in held else m
            if len(held) > 1 and sum(m.size for m in held.values()) > HELD:
                yield from rows(held)
        yield from rows(held)

    return run


def _added(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"d": [key[0]], "i": [key[1]], "row": [np.sum([np.frombuffer(r) for r in f["row"]], axis=0).tobytes()]})


def add_matrices(fit: DataFrame, part) -> DataFrame:
    """(d, i, row): row i of the sum of part(d, x) over all rows."""
    shape = "d int, i int, row binary"
    return fit.mapInPandas(_gathered(part), shape).groupBy("d", "i").applyInPandas(_added, shape)


class Fit:
    """What a length's rows are projected by."""

    def __init__(self, n: int, sums: list[int]):
        self.n, self.sums, self.mean = n, sums, np.array([s / n for s in sums])
        self.values, self.vectors, self.trace, self.error = np.zeros(0), np.zeros((0, len(sums))), 0.0, 0.0

    def centred(self, x: np.ndarray) -> tuple[np.ndarray, list[int | None]]:
        """x less the mean, and the exact sums of (n * x - sums) ** 2."""
        most = self.n * max(-int(x.min()), int(x.max())) + max(map(abs, self.sums))
        small = most**2 * x.shape[1] < 1 << 63
        q = self.n * (x if small else x.astype(object)) - np.array(self.sums, np.int64 if small else object)
        total = (q * q).sum(axis=1).tolist()
        return q.astype(float) / self.n, [t if t < 1 << 63 else None for t in total]

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) @ self.vectors.T / np.sqrt(self.values)


def fit_lengths(fit: DataFrame, components: int) -> dict[int, Fit]:
    """fit(d, x) of distinct rows -> what each length is projected by."""
    if fit.select("d").distinct().limit(LENGTHS + 1).count() > LENGTHS:
        raise ValueError(f"more than {LENGTHS} vector lengths")
    sums = fit.mapInPandas(_sums, "d int, i int, n long, hi long, lo long").groupBy("d", "i").agg(*(F.sum(c).alias(c) for c in ("n", "hi", "lo")))
    found: dict[int, list] = {}
    for r in sums.orderBy("d", "i").collect():  # a row for each entry of a vector
        found.setdefault(r["d"], []).append((r["n"], (r["hi"] << 32) + r["lo"]))
    fits = {d: Fit(s[0][0], [x for _, x in s]) for d, s in found.items()}
    means = {d: f.mean for d, f in fits.items()}
    size = {d: f.n for d, f in fits.items()}

    def outer(d: int, x: np.ndarray) -> np.ndarray:
        y = x - means[d]
        return y.T @ y

    def solve(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        a = np.stack([np.frombuffer(r) for r in f.sort_values("i")["row"]]) / size[key[0]]
        values, vectors = leading(a, components)
        return pd.DataFrame({"d": key[0], "k": np.arange(len(values)), "value": values, "vector": [v.tobytes() for v in vectors], "trace": float(np.trace(a))})

    pairs = add_matrices(fit, outer).groupBy("d").applyInPandas(solve, "d int, k int, value double, vector binary, trace double")
    pairs = pairs.orderBy("d", "k").collect()  # `components` rows for each length
    for d, f in fits.items():
        mine = [r for r in pairs if r["d"] == d]
        if mine:
            f.values, f.trace = np.array([r["value"] for r in mine]), mine[0]["trace"]
            f.vectors = np.stack([np.frombuffer(r["vector"]) for r in mine])

    def square(d: int, x: np.ndarray) -> np.ndarray:
        z = fits[d].whitened(x)
        return z.T @ z

    for r in add_matrices(fit, square).collect():  # at most `components` rows for each length
        f = fits[r["d"]]
        row = np.frombuffer(r["row"]) / f.n
        f.error = max(f.error, float(np.abs(row - np.eye(len(f.values))[r["i"]]).max()))
    return fits


def whiten(vectors: DataFrame, components: int = 4) -> DataFrame:
    """vectors(vec_id, embedding) -> vec_id, component, n, deviation, whitened, explained, identity_error."""
    rows = whole_rows(vectors)
    fits = fit_lengths(cut(rows.select("d", "x").distinct(), "distinct"), components)

    def project(frames: Frames) -> Frames:
        for d, g, x in _by_length(frames):
            f, k = fits[d], len(fits[d].values)
            y, deviation = f.centred(x)
            z = y @ f.vectors.T / np.sqrt(f.values)
            yield pd.DataFrame({
                "vec_id": np.repeat(g["vec_id"].to_numpy(), k), "component": np.tile(np.arange(1, k + 1, dtype=np.int32), len(x)), "n": f.n,
                "deviation": pd.Series(np.repeat(np.array(deviation, object), k), dtype="Int64"), "whitened": z.ravel(), "explained": np.tile(f.values / f.trace, len(x)), "identity_error": f.error,
            })

    return by_text_id(rows, project, "vec_id string, component int, n long, deviation long, whitened double, explained double, identity_error double", "vec_id")
