"""Tokens against the tokenizer itself, and packing laws, on odd texts."""

import random
import zlib

import numpy as np
import pytest

from loomgraph.llm.packing import Plan, _ids_of, pack, token_pieces

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = str(public_tokenizers.path("word_bpe_49k.json"))

ODD = [
    "", None, " ", "a|b | |c ||", "Don't we'll THE, the. x's's'", "ΑΣ ΣΑΣ. Σ", "İstanbul İ ǅ", "é Éa ́x", "a\x1cb a b c　d\x85e",
    "<|endoftext|> <|startoftext|>x", "hello <|endoftext|> world", "A<|EndOfText|>b", "<|endoftext|>", "<|endoftext |>", "ñandú, ciónñ; (foo). 3.14 12,5 ½²", "日本語。テキスト 😀👍🏽", "a" * 3000, "x. " * 5000, "KK ſ ẞ",
]


def test_ids_equal_the_tokenizers():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    r = random.Random(3)
    chars = "aAbZ éÉßΣσİı.,;:!?|'\"-\n\t \x1ć12½٣<>ſK"
    texts = ODD + ["".join(r.choice(chars) for _ in range(r.randrange(60))) for _ in range(3000)]
    got = _ids_of(PATH, texts)
    for x, raw in zip(texts, got):
        assert list(np.frombuffer(raw, "<u4")) == t.encode(x or "", add_special_tokens=False).ids, repr(x)


def test_pieces_and_places(spark):
    docs = spark.createDataFrame([(i, x) for i, x in enumerate(ODD * 3)] + [(None, "null id"), (5, "again")], "doc_id long, text string")
    pieces = token_pieces(docs, PATH, 64)
    rows = pack(pieces, 64).toPandas()
    assert len(rows) == pieces.count()
    for _, x in rows.groupby("sequence_id"):
        x = x.sort_values("offset")
        assert list(x["offset"]) == [0, *x["length"].cumsum()[:-1]] and x["length"].sum() <= 64
    one = rows[rows.doc_id == 0].iloc[0]
    assert (one.length, one.ids_crc32) == (1, zlib.crc32(b"\0\0\0\0"))
    assert pack(token_pieces(docs.limit(0), PATH)).count() == 0


@pytest.mark.parametrize("seed", range(30))
def test_plan_holds_every_piece_once_and_is_near_the_bound(seed):
    r = random.Random(seed)
    c = r.choice([20, 64, 2048])
    sizes = [r.randint(1, c) for _ in range(r.randint(1, 400))]
    plan = Plan({x: sizes.count(x) for x in set(sizes)}, c).solve()
    for x in set(sizes):
        assert plan.used[x] == sizes.count(x)
    decreasing = []
    for x in sorted(sizes, reverse=True):
        fits = [i for i, room in enumerate(decreasing) if room >= x]
        if fits:
            decreasing[min(fits, key=decreasing.__getitem__)] -= x
        else:
            decreasing.append(c - x)
    assert -(-sum(sizes) // c) <= plan.sequences <= len(decreasing)
