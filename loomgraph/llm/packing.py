"""Best-fit packing of token pieces into sequences, after Martello-Toth dominance reduction.

Token lengths are small integers, so an instance is its histogram: at most `capacity` numbers, whatever the input.
The reduction and the best-fit remainder work on that histogram and give each length a short list of places by rank;
the pieces themselves are ranked and placed by Spark.

Null text is an empty document and still has its closing id; an empty table gives no rows; equal rows are packed each.
"""

from __future__ import annotations

import bisect
import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_text_id, cut, rank_in_class

CAPACITY = 2048
#: Words of at most `LONGEST` characters that a Python worker remembers the ids of; beyond that it starts afresh.
REMEMBERED, LONGEST = 600_000, 64
_ODD = re.compile("[\x1c-\x1f]")
_SPACED = re.compile("[^ \t\n\r\f\v]+")
_workers: dict[str, tuple] = {}


def _encode(t, words: list[str], known: dict[str, bytes]) -> None:
    """Ids of new words, many in one call: words stand between bars, whose id none of them can give."""
    bar = t.encode("|", add_special_tokens=False).ids[0]
    plain = [w for w in words if "|" not in w]
    texts = [" | ".join(plain[i : i + 500]) for i in range(0, len(plain), 500)]
    done = 0
    for x in getattr(t, "encode_batch_fast", t.encode_batch)(texts, add_special_tokens=False):
        ids = np.array(x.ids, "<u4")
        ends = np.append(np.flatnonzero(ids == bar), len(ids))
        raw, start = ids.tobytes(), 0
        for end in ends.tolist():
            known[plain[done]] = raw[4 * start : 4 * end]
            done, start = done + 1, end + 1
    for w in words:
        if "|" in w:
            known[w] = np.array(t.encode(w, add_special_tokens=False).ids, "<u4").tobytes()


def _ids_of(path: str, texts: list[str | None]) -> list[bytes]:
    """Ids of each text as little-endian 32-bit words.

    The vocabulary drops white space and never joins across it, nor letters with the marks after them, and lower-cases
    every letter alone; so the ids of a text are those of its lower-cased parts, and a part is encoded once a worker.
    A text that may hold one of the vocabulary's added tokens is encoded whole.
    """
    if path not in _workers:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        added = re.compile("|".join(re.escape(x.content) for x in t.get_added_tokens_decoder().values()) or "(?!)", re.IGNORECASE)
        _workers[path] = (t, {}, added)
    t, known, added = _workers[path]
    whole = {i: np.array(t.encode(x, add_special_tokens=False).ids, "<u4").tobytes() for i, x in enumerate(texts) if x and added.search(x)}
    texts = ["" if i in whole else x for i, x in enumerate(texts)]
    # the small final sigma depends on its neighbours in Python alone; texts that are not composed are left as they are
    low = [x.lower() if x and "\u03a3" not in x and unicodedata.is_normalized("NFC", x) else x for x in texts]
    parts = [(_SPACED.findall(x) if _ODD.search(x) else x.split()) if x else [] for x in low]
    if len(known) > REMEMBERED:
        known.clear()
    found = [list(map(known.get, p)) for p in parts]  # the one look-up of most words
    missing = [[i for i, v in enumerate(f) if v is None] if None in f else () for f in found]
    new = {p[i] for p, at in zip(parts, missing) for i in at}
    split = {w: s for w in new if (s := w.rstrip(".,;:!?")) != w and s.isalpha() and "\u0130" not in s}
    wanted = new.difference(split).union(s for s in split.values() if s not in known)
    wanted.update(e for w, s in split.items() if (e := w[len(s) :]) not in known)
    _encode(t, list(wanted), known)
    for w, s in split.items():
        known[w] = known[s] + known[w[len(s) :]]
    for p, f, at in zip(parts, found, missing):
        for i in at:
            f[i] = known[p[i]]
    for w in wanted | split.keys():
        if len(w) > LONGEST:
            del known[w]
    return [whole.get(i) or b"".join(f) for i, f in enumerate(found)]


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """docs(doc_id, text) -> doc_id, piece, start, length, ids_crc32: the ids and a closing 0, cut at `capacity`."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from .wordhash import batches

        for f in frames:
            texts, ids = f["text"].tolist(), f["doc_id"].tolist()
            for a, b in batches(texts):
                rows = []
                for d, raw in zip(ids[a:b], _ids_of(tokenizer, texts[a:b])):
                    raw += b"\0\0\0\0"
                    for i, at in enumerate(range(0, len(raw), 4 * capacity)):
                        x = raw[at : at + 4 * capacity]
                        rows.append((d, i, at // 4, len(x) // 4, zlib.crc32(x)))
                yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"])

    return by_text_id(docs.select("doc_id", "text"), run, "doc_id string, piece int, start long, length long, ids_crc32 long", "doc_id")


class Plan:
    """Where pieces go: for each length, runs of ranks; `each` of them in a row share a sequence, at `offset`."""

    def __init__(self, histogram: dict[int, int], capacity: int):
        self.left, self.capacity = dict(histogram), capacity
        self.used = dict.fromkeys(histogram, 0)
        self.runs: dict[int, list[tuple[int, int, int, int]]] = {x: [] for x in histogram}
        self.sequences = self.reduced = 0
        self.sizes = sorted(histogram)

    def place(self, sizes: list[int], times: int) -> None:
        """Close `times` sequences, each with one piece of every size named."""
        at = 0
        for x in sorted(set(sizes), reverse=True):
            each = sizes.count(x)
            self.runs[x].append((self.used[x], self.sequences, each, at))
            self.used[x] += times * each
            self.left[x] -= times * each
            at += each * x
            if not self.left[x]:
                self.sizes.remove(x)
        self.sequences += times

    def largest(self, room: int, taken: list[int]) -> int | None:
        """The largest size of at most `room` that is left beside those taken."""
        at = bisect.bisect_right(self.sizes, room) - 1
        while at >= 0 and self.left[self.sizes[at]] <= taken.count(self.sizes[at]):
            at -= 1
        return self.sizes[at] if at >= 0 else None

    def smallest(self, taken: list[int], n: int) -> list[int]:
        out: list[int] = []
        for x in self.sizes:
            out += [x] * min(self.left[x] - taken.count(x), n - len(out))
            if len(out) >= n:
                break
        return out

    def dominating(self, x: int) -> list[int] | None:
        """A set with x that dominates all other sets with x: nothing else fits; one more fits, and then the largest
        is best; or two at most fit, and the largest that fits outweighs or equals any two."""
        room = self.capacity - x
        best = self.largest(room, [x])
        if best is None:
            return [x]
        if best == room:
            return [x, best]
        low = self.smallest([x], 3)
        if len(low) < 2 or low[0] + low[1] > room:
            return [x, best]
        if len(low) < 3 or sum(low) > room:
            most = 0
            for a in self.sizes:
                if a + low[0] > room:
                    break
                b = self.largest(room - a, [x, a]) if self.left[a] > [x].count(a) else None
                most = max(most, a + b if b else 0)
            if best >= most:
                return [x, best]
        return None

    def reduce(self) -> None:
        """Fix dominating sets, largest size first, until none is found."""
        found = True
        while found and self.sizes:
            found = False
            for x in reversed(self.sizes.copy()):
                while self.left[x] and (sizes := self.dominating(x)):
                    times = min(self.left[y] // sizes.count(y) for y in sizes)
                    self.place(sizes, times)
                    self.reduced += times
                    found = True
                if 3 * x < self.capacity and found:
                    break

    def best_fit(self) -> None:
        """Best-fit decreasing of what is left, many equal sequences at a time."""
        open_: dict[int, list[tuple[tuple[int, ...], int]]] = {}  # by room left: contents and how often
        rooms: list[int] = []

        def add(room: int, what: tuple[int, ...], times: int) -> None:
            if times:
                if room not in open_:
                    bisect.insort(rooms, room)
                open_.setdefault(room, []).append((what, times))

        for x in reversed(self.sizes):
            n = self.left[x]
            while n:
                at = bisect.bisect_left(rooms, x)
                if at == len(rooms):
                    each = min(n, self.capacity // x)
                    times = n // each
                    add(self.capacity - each * x, (x,) * each, times)
                    n -= each * times
                    continue
                room = rooms[at]
                what, times = open_[room].pop()
                if not open_[room]:
                    del open_[room]
                    rooms.pop(at)
                each = min(n, room // x)
                some = min(times, n // each)
                add(room, what, times - some)
                add(room - each * x, what + (x,) * each, some)
                n -= each * some
        for same in list(open_.values()):
            for what, times in same:
                self.place(list(what), times)

    def solve(self) -> "Plan":
        self.reduce()
        self.best_fit()
        return self


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add sequence_id and offset to pieces(doc_id, piece, start, length, ...)."""
    pieces = cut(pieces, "pieces")
    counts = pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()  # at most `capacity` rows
    plan = Plan({r["length"]: r["n"] for r in counts}, capacity).solve()
    runs = {x: tuple(np.array(c, np.int64) for c in zip(*r)) for x, r in plan.runs.items()}
    fields = pieces.schema.fields

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            seq, off = np.zeros(len(f), np.int64), np.zeros(len(f), np.int64)
            rank, length = f["rank"].to_numpy(np.int64), f["length"].to_numpy(np.int64)
            for x in np.unique(length):
                at = np.flatnonzero(length == x)
                first, base, each, offset = runs[int(x)]
                i = np.searchsorted(first, rank[at], side="right") - 1
                nth = rank[at] - first[i]
                seq[at] = base[i] + nth // each[i]
                off[at] = offset[i] + nth % each[i] * x
            yield f.drop(columns="rank").assign(sequence_id=seq, offset=off)[[c.name for c in fields] + ["sequence_id", "offset"]]

    ranked = rank_in_class(pieces, "length", ["doc_id", "piece", "ids_crc32"])
    schema = ", ".join(f"`{c.name}` {'string' if c.name == 'doc_id' else c.dataType.simpleString()}" for c in fields)
    return by_text_id(ranked.select(*[c.name for c in fields], "rank"), run, schema + ", sequence_id long, offset long", "doc_id")


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    return pack(token_pieces(docs, tokenizer, capacity), capacity)
