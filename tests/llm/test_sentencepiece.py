from __future__ import annotations

import random
import re

import numpy as np
from helpers import docs_of

from meshwork.llm import sentencepiece_codec
from meshwork.llm.queries import tokenizer_path
from meshwork.llm.sentencepiece_codec import LONGEST_KNOWN, MARK, Codec, DoubleArray, codec, decode, encode, piece_digests

MODEL = tokenizer_path("piece_bpe_32k.model")


def best_score(own, segment):
    """By trying all pieces at all places of the characters."""
    table = {own.spelling[i].replace(b" ", MARK.encode()).decode(): s for i, s in zip(own.ids, own.scores, strict=True)}
    best = [0.0] + [None] * len(segment)
    for i in range(len(segment)):
        for j in range(i + 1, len(segment) + 1):
            s = table.get(segment[i:j], own.unknown if j == i + 1 else None)
            if s is not None and best[i] is not None and (best[j] is None or best[i] + s > best[j]):
                best[j] = best[i] + s
    return best[-1]


def test_viterbi_is_best():
    own, rng = codec(MODEL), random.Random(2)
    score = dict(zip(own.ids, own.scores, strict=True))
    for _ in range(200):
        segment = MARK + "".join(rng.choice("theinganrsé中 ,x"[:14]) for _ in range(rng.randrange(1, 14))).replace(" ", "")
        ids = own.viterbi(segment)
        got, i = 0.0, 0
        while i < len(ids):
            if own.is_byte[ids[i]]:
                lead = own.spelling[ids[i]][0]
                i += 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
                got += own.unknown
            else:
                got += score[ids[i]]
                i += 1
        assert got == best_score(own, segment)


def test_segments_are_searched_together(monkeypatch):
    """The search by single bytes, for which op6 took over 900 CPU s/GB, is left for long segments alone; ids are the same."""
    own, plain, rng = Codec(MODEL, max_bytes=1 << 14), codec(MODEL), random.Random(12)
    alone = []
    monkeypatch.setattr(own, "viterbi", lambda s: alone.append(s) or plain.viterbi(s))
    parts = ["a", "the", "ing", " ", " ", "   ", MARK, "\n", "\0", "é", "中", "🙂", "\uffff", "x" * LONGEST_KNOWN, " " * 70]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(60))) for _ in range(200)]
    marked = [MARK + t.replace(" ", MARK) if t else "" for t in texts]
    expected = [[i for s in re.findall(f"{MARK}*[^{MARK}]+|{MARK}+$", t) for i in plain.viterbi(s)] for t in marked]
    for sizes in [{}, {"RUN_CHARS": 40, "CELLS": 300}, {"RUN_CHARS": 1, "CELLS": 1}]:  # as is; texts cut into many runs; blocks of one segment
        for name, size in sizes.items():
            monkeypatch.setattr(sentencepiece_codec, name, size)
        own.known.clear()
        assert [np.frombuffer(own.encode(t), "<i4").tolist() for t in texts] == expected
        assert alone and min(map(len, alone)) > LONGEST_KNOWN and all(len(s) < LONGEST_KNOWN for s in own.known)


def test_double_array():
    rng = random.Random(4)
    keys = sorted({bytes(rng.randrange(256) for _ in range(rng.randrange(1, 6))) for _ in range(2000)})
    own = DoubleArray(keys)
    for key in keys[::7]:
        text = key + b"zz"
        assert list(own.prefixes(text)) == [(n, keys.index(text[:n])) for n in range(1, len(text) + 1) if text[:n] in set(keys)]


def test_round_trip(spark):
    rng = random.Random(6)
    texts = [None, "", " ", "  a  b ", "é🙂中\n\t\x00", "<s></s><unk>", "the " * 30000, *("".join(rng.choice("abc the\n é🙂中") for _ in range(rng.randrange(40))) for _ in range(50))]
    docs = docs_of(spark, texts)
    done = encode(docs, MODEL)
    assert {r.doc_id: r.text for r in decode(done.drop("text"), MODEL).collect()} == dict(enumerate(texts))
    found = {r.doc_id: r for r in piece_digests(docs, MODEL).collect()}
    assert all(r.round_trip for r in found.values()) and found[0].n_pieces == found[1].n_pieces == 0 and found[4].n_byte_pieces > 0
    assert encode(docs.limit(0), MODEL).count() == 0 and set(docs.columns) <= set(done.columns)


def test_against_library():
    """The library's own search over the same pieces, where it is exact: no unknown characters."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as pb

    model = pb.ModelProto()
    for piece, score, kind in [("<unk>", 0, 2), (MARK, -3, 1), ("a", -2, 1), ("b", -2.5, 1), ("ab", -3.25, 1), (MARK + "a", -3.5, 1), ("ba", -4, 1), ("bab", -5.25, 1), ("aa", -3.75, 1)]:
        model.pieces.add(piece=piece, score=score, type=kind)
    model.trainer_spec.model_type = 1
    model.normalizer_spec.name, model.normalizer_spec.add_dummy_prefix, model.normalizer_spec.remove_extra_whitespaces = "identity", True, False
    import tempfile

    with tempfile.NamedTemporaryFile(suffix=".model") as f:
        f.write(model.SerializeToString())
        f.flush()
        own, other = codec(f.name), sentencepiece.SentencePieceProcessor(model_file=f.name)
        rng, score = random.Random(8), None
        score = dict(zip(own.ids, own.scores, strict=True))
        for _ in range(300):
            text = "".join(rng.choice("ab ") for _ in range(rng.randrange(1, 12)))
            a, b = np.frombuffer(own.encode(text), "<i4").tolist(), other.encode(text)
            assert sum(score[i] for i in a) == sum(score[i] for i in b) and own.decode(own.encode(text)) == text
