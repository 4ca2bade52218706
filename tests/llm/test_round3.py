"""Whitening, quality trees and the manifest against plain readings of their rules, on odd rows."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomgraph.llm import merkle
from loomgraph.llm.merkle import manifest
from loomgraph.llm.quality import score_quality, statistics, train
from loomgraph.llm.spectrum import count_above, leading
from loomgraph.llm.whitening import whiten

LOWER = {i: i + 32 for i in range(65, 91)}


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def up(nodes):
    """Levels of digests from the leaves to the one that remains."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][i : i + 8]) for i in range(0, len(levels[-1]), 8)])
    return levels


def siblings(levels, pos):
    for level in levels[:-1]:
        a = pos - pos % 8
        yield level[a:pos], level[pos + 1 : a + 8]
        pos //= 8


def plain_manifest(rows):
    def leaf(row, text):
        values = [row[0], row[3], row[2], row[4], text]
        return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))

    langs = {}
    for r in rows:
        langs.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, leaf(r, r[1]), r))
    order = sorted(langs, key=lambda x: (x is not None, (x or "").encode()))
    trees = {x: up([leaf for *_, leaf, _ in sorted(langs[x], key=lambda y: y[:3])]) for x in order}
    top = up([trees[x][-1][0] for x in order])
    out = []
    for k, x in enumerate(order):
        for pos, (*_, own, r) in enumerate(sorted(langs[x], key=lambda y: y[:3])):
            path = [*siblings(trees[x], pos), *siblings(top, k)]
            now = own
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and r[1] is not None:
                now = leaf(r, r[1].translate(LOWER))
            for left, right in path:
                now = h(*left, now, *right)
            out.append((r[0], own, trees[x][-1][0], top[-1][0], h(*(s for left, right in path for s in left + right)), now, now == top[-1][0]))
    return sorted(map(str, out))


def documents(spark, rows):
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, pos int, left string")
    return docs.repartition(5)


def manifest_rows(docs):
    return sorted(str(tuple(r)) for r in manifest(docs).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect())


def test_manifest_equals_plain_trees(spark, monkeypatch):
    """Null fields and ids, equal ids and rows, runs of one, single-leaf languages, columns that clash."""
    r = random.Random(3)
    rows = [(i * 7 - 300, f"Text {i} ÄÖ" * (i % 5), "en", f"s{i % 3}", i) for i in range(585)]
    rows += [(i, r.choice([None, "", "ABC", "abc"]), "fr", None, None) for i in range(73)] + [(9000 + i, "Ü", "é", "s", 1) for i in range(8)]
    rows += [(5, None, None, None, None), (6, "Q" * 20000, None, "", 0), (7, "lone", "a|b", "x", 4), (None, "No Id", "en", "x", 5), (None, None, "en", None, None), (1, "Same", "en", "s", 4), (1, "Same", "en", "s", 4), (1, "Other", "en", "s", 5)]
    monkeypatch.setattr(merkle, "BLOCK", 64)
    assert manifest_rows(documents(spark, rows)) == plain_manifest(rows)


@pytest.mark.parametrize("n", [0, 1, 8, 9])
def test_manifest_of_few_rows(spark, n):
    rows = [(i, "A", "en", "s", 1) for i in range(n)]
    assert manifest_rows(documents(spark, rows)) == plain_manifest(rows) if n else not manifest_rows(documents(spark, rows))


@given(st.integers(1, 12), st.integers(0, 2**32 - 1), st.integers(1, 12))
@settings(max_examples=60, deadline=None)
def test_counts_and_pairs_of_any_matrix(d, seed, rank):
    r = np.random.default_rng(seed)
    x = np.rint(r.standard_normal((30, min(rank, d))) @ r.standard_normal((min(rank, d), d)) * 9)
    a = (x - x.mean(0)).T @ (x - x.mean(0)) / 30
    truth = np.linalg.eigvalsh(a)[::-1]
    for shift in r.uniform(-1, truth[0] + 1, 5):
        if np.abs(truth - shift).min() > 1e-9 * (truth[0] + 1):
            assert count_above(a, shift) == (truth > shift).sum()
    values, vectors = leading(a, 4)
    assert np.allclose(values, truth[: len(values)], rtol=1e-12, atol=1e-12 * (truth[0] + 1))
    assert (truth[len(values) : 4] < 1e-10 * (truth[0] + 1)).all()
    assert np.allclose(vectors @ vectors.T, np.eye(len(values)), atol=1e-9)
    assert np.abs(a @ vectors.T - vectors.T * values).max(initial=0) <= 1e-11 * (truth[0] + 1)


def test_whitening_equals_plain_arithmetic(spark):
    """Nulls, non-finite entries, repeated rows and ids, a null id; statistics over distinct vectors only."""
    r = np.random.default_rng(2)
    rows = [(i, [float(x) for x in r.standard_normal(6) * [3, 2, 2, 1, 1, 0.2]]) for i in range(300)]
    rows += [(1000 + i, rows[5][1]) for i in range(200)] + [rows[3], (None, rows[9][1])]
    odd = [(2000, None), (2001, [1.0] * 5 + [None]), (2002, [float("nan")] * 6), (2003, [float("inf")] * 6), (2004, [])]
    got = whiten(spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>").repartition(7)).toPandas()
    whole = [[int(np.floor(256 * c)) for c in v] for _, v in rows]
    fit = sorted({tuple(x) for x in whole})
    n, s = len(fit), [sum(c) for c in zip(*fit)]
    y = np.array(fit, float) - np.array(s) / n
    values, vectors = np.linalg.eigh(y.T @ y / n)
    values, vectors = values[::-1], vectors.T[::-1]
    assert len(got) == 4 * len(rows) and (got["n"] == n).all() and got["identity_error"].max() < 1e-9
    for (i, _), x in zip(rows[:300], whole):
        mine = got[got["vec_id"] == i].drop_duplicates().sort_values("component")
        assert mine["component"].tolist() == [1, 2, 3, 4]
        assert set(mine["deviation"]) == {sum((n * a - b) ** 2 for a, b in zip(x, s))}
        z = (np.array(x) - np.array(s) / n) @ vectors[:4].T / np.sqrt(values[:4])
        assert np.allclose(np.abs(mine["whitened"]), np.abs(z), rtol=1e-6, atol=1e-9)
        assert np.allclose(mine["explained"], values[:4] / values.sum(), rtol=1e-9)


def test_whitening_of_degenerate_tables(spark):
    one = lambda rows: whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert one([]) == [] and one([(1, None)]) == [] and one([(1, [1.0, 2.0]), (2, [1.0, 2.0])]) == []
    got = one([(1, [0.0, 1.0]), (2, [1.0, 1.0]), (3, [5.0]), (4, [6.0]), (5, [1e300, 0.0, 0.0]), (6, [-1e300, 0.0, 0.0])])
    assert sorted((r["vec_id"], r["component"], abs(round(r["whitened"], 9))) for r in got) == [(i, 1, 1.0) for i in range(1, 7)]
    assert {r["vec_id"] for r in got if r["deviation"] is None} == {5, 6}  # beyond a long


def plain_statistics(text):
    raw = (text or "").encode()
    words = [w for w in "".join(c if c not in " \t\n\v\f\r" else " " for c in (text or "").translate(LOWER)).split(" ") if w]
    lines = [x for x in (text or "").split("\n") if x]
    counts = [words.count(w) for w in set(words)]
    return len(raw), len(words), len(set(words)), max(counts, default=0), len(lines), len(set(x.translate(LOWER) for x in lines)), sum(a == b for a, b in zip(words, words[1:]))


def test_statistics_equal_plain_counts():
    texts = [None, "", " \n", "One", "a a A b", "x\n\nx\nY y", "äö ÄÖ\nß", "q" * 5000, "w " * 4000, "end\n"]
    for text, row in zip(texts, statistics(texts)):
        size, words, kinds, most, lines, line_kinds, same = plain_statistics(text)
        w, m = max(words, 1), max(lines, 1)
        assert np.allclose(row[-10:], [np.log1p(size), np.log1p(words), size / w, np.log1p(max(map(len, (text or "").encode().split()), default=0)), kinds / w, most / w, np.log1p(lines), words / m, line_kinds / m, row[-1]])
        assert np.isclose(row[-12], same / w)


def test_trees_walk_like_a_plain_reading():
    r = np.random.default_rng(4)
    x = r.standard_normal((600, 5))
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] > -0.2)).astype(float)
    model = train(x, y, trees=20, depth=3)
    assert ((model.score(x) >= 0.5) == y).mean() > 0.97
    for row, margin in zip(x[:50], model.margin(x[:50])):
        total = model.start
        for t in range(20):
            node = 0
            for _ in range(3):
                node = 2 * node + 1 + bool(row[model.feature[t, node]] > model.limit[t, node])
            total += model.leaf[t, node - 7]
        assert np.isclose(total, margin)


def test_quality_on_held_out_rows(spark):
    r = random.Random(8)
    words = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7))) for _ in range(400)]
    rows, labels = [], []
    for i in range(400):
        text = " ".join(r.choice(words) for _ in range(r.randint(5, 90)))
        good = i % 4 > 0
        rows.append((i, text + "." if good else " ".join(w + "$$" for w in text.split()) if i % 8 else (words[i] + " ") * 40))
        labels.append((i, int(good)))
    rows += [(1000, None), (1001, ""), (None, "no id"), (3, rows[3][1]), (1002, "long " * 100_000)]
    labels += [(1000, None), (5, 1), (5, 1), (None, 0), (9999, 1)]
    docs = spark.createDataFrame([(*x, 0.5, "e") for x in rows], "doc_id long, text string, score double, quality string").repartition(3)
    known = spark.createDataFrame(labels, "doc_id long, quality int")
    got = score_quality(docs, known).collect()
    assert len(got) == len(rows) and all(0 <= x["score"] <= 1 and x["predicted"] == (x["score"] >= 0.5) for x in got)
    truth = dict(labels)
    held = [x for x in got if x["held_out"] and x["doc_id"] is not None and x["doc_id"] < 400]
    assert all(x["held_out"] == (zlib.crc32(str(x["doc_id"]).encode()) % 3 == 1) for x in got if x["doc_id"] is not None)
    assert sum(x["predicted"] == truth[x["doc_id"]] for x in held) > 0.97 * len(held)
    assert {x["score"] for x in score_quality(docs, known.where("false")).collect()} == {0.5}
    assert score_quality(docs.where("false"), known).collect() == []
    assert all(x["score"] > 0.9 for x in score_quality(docs, known.where(F.col("quality") == 1)).collect())
