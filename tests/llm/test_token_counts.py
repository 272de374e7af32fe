from __future__ import annotations

import random

import sentencepiece
from helpers import docs_of

from meshwork.llm.queries import tokenizer_path
from meshwork.llm.token_counts import START, BpeTransducer, ChunkMap, Composed, token_counts, transducer

MODEL = tokenizer_path("piece_bpe_32k.model")


def texts():
    rng = random.Random(1)
    signs = " ▁  abcdething.\n\té🙂ß中<s></s><unk>0123  "
    return ["", " ", "  ", "▁", "a" + " " * 50 + "b", "the " * 20000, *("".join(rng.choice(signs) for _ in range(rng.randrange(60))) for _ in range(400))]


def test_against_library():
    own, other = transducer(MODEL), sentencepiece.SentencePieceProcessor(model_file=MODEL)
    for t in texts():
        n = len(other.encode(t))
        assert own.count(t) == n and own.count(t, chunk_chars=7) == n


def test_scan_of_chunk_maps():
    own = transducer(MODEL)
    text = "▁" + "some words and more of them ".replace(" ", "▁") * 5
    maps = [ChunkMap(own, text[i : i + 9]) for i in range(0, len(text), 9)]
    assert [m.of(START)[1] for m in own.scan(maps)] == [own.segments(text[: i + 9]) for i in range(0, len(text), 9)]


def test_maps_of_all_states():
    """A chunk's map holds for any state before it, with and without cuts: it does what running on does."""
    own, rng = transducer(MODEL), random.Random(2)
    for _ in range(200):
        before, chunk, after = ("".join(rng.choice("abeinrst▁▁é中0") for _ in range(rng.randrange(1, 40))) for _ in range(3))
        maps = [ChunkMap(own, x) for x in (before, chunk, after)]
        left, right = Composed(Composed(maps[0], maps[1]), maps[2]), Composed(maps[0], Composed(maps[1], maps[2]))
        assert left.of(START) == right.of(START) == ChunkMap(own, before + chunk + after).of(START)


def test_text_without_cuts():
    """Chunks of one long word are composed by states, too."""
    own, other = transducer(MODEL), sentencepiece.SentencePieceProcessor(model_file=MODEL)
    rng = random.Random(3)
    for text in ("ab" * 9000, "".join(rng.choice("abcdefghijklmnop0123") for _ in range(30_000)), "中文" * 5000, "a▁" * 6000):
        assert own.count(text) == own.count(text, 777) == len(other.encode(text))


def test_bounded_tables():
    small = BpeTransducer(MODEL, max_states=50, max_words=5)
    assert [small.count(t) for t in texts()[-60:]] == [transducer(MODEL).count(t) for t in texts()[-60:]]


def test_rows(spark):
    own = ["the cat", None, "", "the cat", "the " * 5000]
    got = [tuple(r) for r in token_counts(docs_of(spark, own, [1, 2, None, 1, 5]), MODEL).collect()]
    assert got[0] == got[3] == (1, 7, 2, False) and got[1] == (2, 0, 0, False) and got[2] == (None, 0, 0, False) and got[4][3]
    assert token_counts(docs_of(spark, own).limit(0), MODEL).count() == 0
