"""Each corpus operator against a plain reading of its rule, on odd rows."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgraph.llm import katz, neardup, repeats
from loomgraph.llm.components import connected_components
from loomgraph.llm.decontamination import contamination
from loomgraph.llm.katz import katz_scores
from loomgraph.llm.language import identify_language
from loomgraph.llm.linededup import dedup_lines
from loomgraph.llm.neardup import near_duplicates
from loomgraph.llm.neighbours import nearest
from loomgraph.llm.repeats import remove_repeats
from loomgraph.llm.sharding import shard
from loomgraph.llm.toxicity import Channel, Reader, score_toxicity

LOWER = {i: i + 32 for i in range(65, 91)}
R = random.Random(5)
WORDS = ["".join(R.choice("abcdefgh") for _ in range(R.randint(2, 6))) for _ in range(300)]


def prose(n, r=R):
    return " ".join(r.choice(WORDS) for _ in range(n))


def corpus():
    """Null, blank, short, long and repeated texts; near copies; lines and passages that repeat."""
    base, passage = prose(120), prose(70)
    texts = [None, "", "  \n\t ", "one", "ONE", "two words", "a b c d e", base, base, base.upper(), prose(3000), prose(40) + "\n" + passage + "\n" + prose(30), passage, "x\n\n" + passage + " tail", "é" * 400, "é" * 400 + "!", "äöü 日本語 text\x00with nul"]
    for k in range(12):
        w = base.split()
        for _ in range(k % 4):
            w[R.randrange(len(w))] = R.choice(WORDS)
        texts.append(" ".join(w))
    texts += [prose(R.randint(1, 80)) + "\n" + prose(12) for _ in range(30)]
    return [(i, x) for i, x in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = corpus()
    rows += [rows[7], (7, prose(9)), (None, "no id"), (None, None)]
    out = spark.createDataFrame([(a, b, 3, 1) for a, b in rows], "doc_id long, text string, n long, a int")
    return out.repartition(5).cache()


def unique(docs):
    return docs.where("doc_id is not null").dropDuplicates(["doc_id"])


def split(text):
    return [w for w in re.split("[ \t-\r]+", (text or "").translate(LOWER)) if w]


def shingles(text):
    w = split(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def test_near_duplicates(docs):
    one = unique(docs).cache()
    sets = {r.doc_id: shingles(r.text) for r in one.collect()}
    parent = {a: a for a in sets}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a, x in sets.items():
        for b, y in sets.items():
            if a < b and x and y and 100 * len(x & y) >= 75 * len(x | y):
                u, v = sorted((find(a), find(b)))
                parent[v] = u
    for r in near_duplicates(one).collect():
        assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), find(r.doc_id), find(r.doc_id) == r.doc_id)
    assert near_duplicates(docs).count() == docs.count()
    assert near_duplicates(docs.limit(0)).count() == 0


def test_near_duplicates_in_a_crowd(spark):
    """Documents that share a boilerplate with many others are still linked to each other."""
    r = random.Random(4)
    fresh = lambda n: " ".join(f"w{r.randrange(1 << 40)}" for _ in range(n))
    shared = fresh(64)
    rows = [(i, f"{shared} {fresh(30)}") for i in range(8000)] + [(10_000 + i, f"{shared} {fresh(8)}") for i in range(20)]
    got = {x.doc_id: x.component_id for x in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: min(i, 10_000) for i, _ in rows}


def test_a_crowd_does_not_meet_itself(spark, monkeypatch):
    """Three times the documents around one passage make at most four times the joined rows; components equal brute force."""
    r = random.Random(3)
    words = [f"w{i}" for i in range(5000)]
    passage = [r.choice(words) for _ in range(242)]
    texts = []
    for i in range(1500):
        own = r.choice([50, 55, 60, 62, 65, 70, 75, 90]) if i % 3 else r.choice([20, 57, 64, 80, 120])
        texts.append((i, " ".join(passage[: r.choice([242, 242, 200])] + [r.choice(words) for _ in range(own)])))
    met, made = neardup._met, []

    def counted(*args):
        out = met(*args)
        made.append(out.count())
        return out

    monkeypatch.setattr(neardup, "_met", counted)
    few = {x.doc_id: x.component_id for x in near_duplicates(spark.createDataFrame(texts[:500], "doc_id long, text string")).collect()}
    rows = sum(made)
    made.clear()
    near_duplicates(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    assert sum(made) <= 4 * max(rows, 5000), (rows, made)
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i, w in ((i, x.split()) for i, x in texts[:500])}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in range(a):
            both = len(sets[a] & sets[b])
            if 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both) and find(a) != find(b):
                parent[max(find(a), find(b))] = min(find(a), find(b))
    assert few == {i: find(i) for i in sets}


def test_components_of_paths_and_hubs(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 60)] + [(7, 7)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 160), 100)}


def test_contamination(spark, docs):
    texts = [r.text for r in unique(docs).where("text is not null").collect()]
    bench = [(i, " ".join(x.split()[:25])) for i, x in enumerate(texts[:14])] + [(90, "two words"), (91, None), (92, ""), (93, prose(30)), (2, "one")]
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    wins = collections.defaultdict(set)
    for i, x in bench:
        w = word.findall((x or "").translate(LOWER))
        n = min(13, len(w))
        for j in range(len(w) - n + 1 if n else 0):
            wins[tuple(w[j : j + n])].add(i)
    got = contamination(docs, spark.createDataFrame(bench, "item_id long, text string"))
    rows = collections.Counter(tuple(r) for r in got.collect())
    want = collections.Counter()
    for r in docs.collect():
        w, hit, items = word.findall((r.text or "").translate(LOWER)), set(), set()
        for n in {len(k) for k in wins}:
            for j in range(len(w) - n + 1):
                if found := wins.get(tuple(w[j : j + n])):
                    hit |= set(range(j, j + n))
                    items |= found
        want[(r.doc_id, len(w), len(hit), len(items), hashlib.sha256(",".join(sorted(map(str, items))).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w))] += 1
    assert rows == want
    assert contamination(docs.limit(0), spark.createDataFrame(bench, "item_id long, text string")).count() == 0


def test_shards(docs):
    got = shard(docs, 5).toPandas()
    assert len(got) == docs.count() and set(got["law"]) == {"bytes"}
    for _, x in got.groupby("shard"):
        assert sorted(x["slot"]) == list(range(len(x)))
    texts = {r.doc_id: r.text for r in unique(docs).collect()}
    for r in got.itertuples():
        if r.doc_id in texts and r.doc_id != 7:
            raw = (texts[r.doc_id] or "").encode()
            assert (r.size, r.text_crc32) == (len(raw) + 16, zlib.crc32(raw))
    assert all(len(set(x["shard"])) == 1 for _, x in got.groupby(["text_crc32", "size"]))
    assert shard(docs.limit(0), 5).count() == 0


def test_katz(docs):
    got = {r.doc_id: r for r in katz_scores(unique(docs)).collect()}
    texts = {r.doc_id: split(r.text) + [None] for r in unique(docs).collect()}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in texts}
    count, follow = collections.Counter(), collections.defaultdict(collections.Counter)
    for i, w in texts.items():
        if not held[i]:
            count.update(w)
            for a, b in zip([None, *w], w):
                follow[a][b] += 1
    total, types = sum(count.values()), len(count)
    rest = max(sum(v == 1 for v in count.values()) / total, 1 / (total + 1))
    small = np.bincount([v for f in follow.values() for v in f.values() if v < 7], minlength=7)
    d = katz.discounts(small)

    def uni(w):
        return count[w] / total * (1 - rest) if w in count else rest

    def log(a, b):
        f = follow.get(a)
        if not f:
            return math.log10(uni(b))
        n, left = sum(f.values()), sum(v * (1 - d[v]) for v in f.values() if v < 6)
        n, left = (n, left) if left > 0 else (n + 1, 1)
        return math.log10(d[min(f[b], 6)] * f[b] / n if b in f else left / n / max(1 - sum(map(uni, f)), 1e-9) * uni(b))

    for a in list(follow)[:30]:  # every context sums to one over all words and the unknown one
        assert sum(10 ** log(a, b) for b in [*count, "unknown"]) == pytest.approx(1, abs=1e-6)
    for i, w in texts.items():
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(w), sum(count[x] > 0 for x in w), total)
        assert r.base_score == pytest.approx(sum(math.log10((count[x] + 1) / (total + types + 1)) for x in w))
        assert r.score == pytest.approx(sum(log(a, b) for a, b in zip([None, *w], w)), rel=1e-5)
    twice = docs.unionByName(docs)  # equal blocks are told apart
    assert katz_scores(twice).count() == 2 * docs.count()
    assert katz_scores(docs.limit(0)).count() == 0


def test_katz_has_no_size_switch(spark, docs, monkeypatch):
    """Every word keeps its own count, however many words there are."""
    want = {r.doc_id: r.score for r in katz_scores(unique(docs)).collect()}
    monkeypatch.setattr(katz, "FREQUENT", 20, raising=False)
    got = {r.doc_id: r.score for r in katz_scores(unique(docs)).collect()}
    assert got == pytest.approx(want, rel=1e-9)


def test_lower_latin(spark):
    """Only A-Z change, whichever character stands beside them."""
    from pyspark.sql import functions as F

    from loomgraph.llm.linededup import lower_latin

    points = spark.range(1, 0x110000).where("id < 55296 or id > 57343").withColumn("c", F.expr("decode(unhex(lpad(hex(id), 8, '0')), 'UTF-32')"))
    text = F.concat(F.lit("aZ"), "c", F.lit("Q"))
    want = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    wrong = points.where(~lower_latin(text).eqNullSafe(want))
    assert points.where(F.length("c") == 1).count() > 1_100_000 and wrong.limit(5).collect() == []


def test_lines(docs):
    one = unique(docs)
    got = {r.doc_id: r for r in dedup_lines(one).collect()}
    earlier = []
    for r in sorted(one.collect(), key=lambda r: r.doc_id):
        if r.text is None:
            assert got[r.doc_id].text is None
            continue
        left = []
        for line in r.text.split("\n"):
            s = set(split(line))
            if not s or not any(100 * len(s & e) >= 75 * len(s | e) for e in earlier):
                left.append(line)
            if s:
                earlier.append(s)
        assert got[r.doc_id].text == "\n".join(left) and got[r.doc_id].n_lines_removed == r.text.count("\n") + 1 - len(left)
    assert dedup_lines(docs).count() == docs.count()
    assert dedup_lines(docs.limit(0)).count() == 0


@pytest.mark.parametrize("part", [2, 2000])
def test_repeats(docs, part, monkeypatch):
    monkeypatch.setattr(repeats, "PART", part)
    rows = docs.collect()
    raw = [(r.text or "").encode() for r in rows]
    seen = collections.Counter(x[i : i + 200] for x in raw for i in range(len(x) - 199))
    want = collections.Counter()
    for r, x in zip(rows, raw):
        gone = bytearray(len(x))
        for i in range(len(x) - 199):
            if seen[x[i : i + 200]] > 1:
                gone[i : i + 200] = b"\1" * 200
        runs = len(re.findall(b"\1+", bytes(gone)))
        want[(r.doc_id, len(x), sum(gone), runs, hashlib.sha256(bytes(b for b, g in zip(x, gone) if not g)).hexdigest())] += 1
    assert collections.Counter(tuple(r) for r in remove_repeats(docs).collect()) == want
    assert remove_repeats(docs.limit(0)).count() == 0


def test_repeats_of_texts_without_id(spark):
    r = random.Random(6)
    shared = prose(80, r)
    rows = [(None, f"{prose(30, r)} {shared} {prose(30, r)}"), (1, f"{prose(20, r)} {shared} {prose(9, r)}"), (2, prose(90, r))]
    got = {x.doc_id: x.n_removed for x in remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[None] == got[1] >= len(shared) and got[2] == 0


def test_language_on_held_out_rows(spark, docs):
    r = random.Random(1)
    sounds = {"aa": ["ka", "to", "mi", "ra"], "bb": ["sch", "ung", "ein", "der"], "cc": ["qué", "ño", "los", "ar"]}
    rows = [(i, " ".join("".join(r.choice(s) for _ in range(r.randint(1, 3))) for _ in range(r.randint(3, 30))), k) for i, (k, s) in enumerate(list(sounds.items()) * 60)]
    rows += [(900, None, "aa"), (901, "12 34 !!", "aa"), (902, "ka" * 500, None), (902, "ka" * 500, None), (None, "der ein", None)]
    got = identify_language(spark.createDataFrame(rows, "doc_id long, text string, lang string")).toPandas()
    assert len(got) == len(rows) and got["score"].between(0, 1).all()
    truth = {i: k for i, _, k in rows if k and i < 900}
    held = got[got["held_out"] & got["doc_id"].isin(list(truth))]
    assert (held["lang_pred"] == held["doc_id"].map(truth)).mean() > 0.95
    assert set(got[got["doc_id"].isin([900, 901])]["lang_pred"]) == {"und"}
    unlabelled = docs.select("doc_id", "text", F.lit(None).cast("string").alias("lang"))
    assert set(identify_language(unlabelled).toPandas()["lang_pred"]) == {"und"}


def test_toxicity_on_held_out_rows(spark):
    r = random.Random(2)
    disguise = {"idiot": ["idiot", "1d10t", "i.d.i.o.t", "i d i o t", "idioooot"], "moron": ["moron", "m0r0n", "mo-ron", "m o r o n", "mmmoron"]}
    rows, labels = [], []
    for i in range(600):
        bad, words = i % 3 == 0, [r.choice(WORDS) for _ in range(40)]
        if bad:
            for k in r.sample(list(disguise), 2):
                words.insert(r.randrange(40), r.choice(disguise[k]))
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(bad)))
    rows += [(700, None), (701, ""), (None, "moron")]
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([*labels, (5000, 1, 1), (3, 1, None)], "doc_id long, quality int, toxic int")
    got = score_toxicity(docs, marks).toPandas()
    assert len(got) == len(rows) and got["score"].between(0, 1).all()
    held = got[got["held_out"] & (got["doc_id"] < 600)]
    assert (held["predicted"] == (held["doc_id"] % 3 == 0)).mean() > 0.95
    assert set(score_toxicity(docs, marks.limit(0)).toPandas()["score"]) == {0.5}


def test_channel_restores_disguises():
    counts = collections.Counter()
    for w in ["idiot", "stupid", "moron", *WORDS] * 50:
        s = [0] + [ord(c) - 96 for c in w] + [0]
        counts.update((a * 28 + b) * 28 + c for a, b, c in zip(s, s[1:], s[2:]))
    c = Channel(counts)
    for seen, meant in [("1d10t", "idiot"), ("st-u-p1d", "stupid"), ("m o r o n", "moron"), ("moooron", "moron")]:
        assert c.restore(seen) == meant


def test_toxic_words_in_long_runs_and_chains():
    counts = collections.Counter()
    for w in ["you", "and", "idiot", "stupid", "moron", *WORDS] * 50:
        x = [0] + [ord(c) - 96 for c in w] + [0]
        counts.update((a * 28 + b) * 28 + c for a, b, c in zip(x, x[1:], x[2:]))
    weights = {"stupid": 5.0, "idiot": 6.0, "moron": 7.0, "nit": 4.0}
    reader = Reader(counts, weights)
    for n in (1, 5, 40):  # in one window and in many
        spaced = " ".join("youstupididiotandamoron" * n)
        for text in (spaced, "_".join(["you", "stupid", "idiot", "and", "a", "moron"] * n), ".".join("youstupididiotandamoron" * n)):
            assert reader.evidence(text)[1] == 18.0
    assert reader.evidence("you n i t")[0] == 4.0
    # a long token without marks is read too, and once
    assert Reader(counts, {"idi*": 6.0}).evidence("1d10t" + "youand" * 12)[:2] == [6.0, 6.0]


def test_neighbours(spark):
    r = np.random.default_rng(3)
    v = r.normal(size=(300, 8)).astype(np.float32)
    v[50:90] = v[50]
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(400, None), (420, [0.0] * 8), (440, [float("nan")] * 8), (460, [1.0, None] * 4), (480, [float("inf")] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = nearest(df, rows=64).toPandas()
    scores = v.astype(float) @ v.astype(float).T
    assert len(got) == 15 * 20
    for q, x in got.groupby("query_id"):
        best = sorted((-round(scores[q, j], 9), j) for j in range(300) if j != q)[:20]
        assert list(x.sort_values("rank")["vec_id"]) == [j for _, j in best]
    assert nearest(df.limit(0)).count() == 0
    repeated = nearest(df.unionByName(df), rows=64).toPandas()
    assert sorted(map(tuple, repeated.values.tolist())) == sorted(map(tuple, got.values.tolist()))


def test_wide_neighbours(spark):
    """Products of more components than single precision sums exactly."""
    r = np.random.default_rng(5)
    v = r.normal(size=(60, 3000))
    got = nearest(spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")).toPandas()
    for q, x in got.groupby("query_id"):
        best = sorted((-(v[q] @ v[j]), j) for j in range(60) if j != q)[:20]
        assert list(x.sort_values("rank")["vec_id"]) == [j for _, j in best]


def test_neighbours_of_several_lengths(spark):
    rows = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [1.0, 1.0]), (20, [1.0, 0.0, 0.0]), (3, [0.0, 1.0, 0.0])]
    got = {(x.query_id, x.rank, x.vec_id) for x in nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()}
    assert got == {(0, 1, 1), (0, 2, 2), (20, 1, 3)}


def test_stages_with_null_and_repeated_ids(spark, tmp_path):
    """Rows are decided by id and text: no clean row goes for want of an id, no bad one stays for it."""
    from loomgraph.llm import stages

    r = random.Random(8)
    base, item = prose(60, r), prose(20, r)
    near = base.split()
    near[30] = "other"
    texts = [(None, base), (5, base), (4, " ".join(near)), (9, prose(40, r)), (9, prose(40, r)), (None, prose(40, r)), (None, prose(40, r)), (None, None), (3, "")]
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    rows = lambda df: sorted(map(tuple, df.collect()), key=str)
    assert rows(stages.minhash_near_dedup(spark, frame(texts), str(tmp_path))) == sorted(texts[2:], key=str)
    got = {(x.doc_id, x.n_shingles > 0, x.component_id) for x in near_duplicates(frame(texts[:3])).collect()}
    assert got == {(None, True, 4), (5, True, 4), (4, True, 4)}
    assert rows(stages.decontamination(spark, frame([*texts, (None, item), (9, item)]), str(tmp_path))) == sorted(texts, key=str)
    some = [(i, prose(30, r) + (" idiot" if i % 3 == 0 else "")) for i in range(100, 400)]
    labels = [(i, 1, int(i % 3 == 0)) for i in range(100, 400)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    left = stages.toxicity(spark, frame([*some, *texts, (None, texts[3][1] + " idiot"), (9, texts[4][1] + " idiot")]), str(tmp_path))
    assert rows(left) == sorted([x for x in some if x[0] % 3] + texts, key=str)


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    d = "/root/testdata/sf0.001"
    out = corpus_pipeline.run(spark, d)
    assert out.count() > 0 and [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "minhash_near_dedup", "decontamination", "packing"]
    rows = out.toPandas()
    assert rows.groupby("sequence_id")["length"].sum().max() <= 2048
