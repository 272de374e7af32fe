"""The stages against plain versions, and their decisions."""

from __future__ import annotations

import os
import random
import re

import pytest
import sentencepiece
from helpers import docs_of, words
from test_jaccard import plain as plain_classes
from test_secrets import plain as plain_secrets

import corpus_pipeline
from meshwork.llm import jaccard
from meshwork.llm.common import materialize, table
from meshwork.llm.langid import identify, train
from meshwork.llm.queries import tokenizer_path

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")


def cut(text):
    """Words for comparison with the benchmark."""
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def test_stages(spark):
    docs = table(spark, SF, "documents")
    columns, kept = docs.columns, [docs]
    for name, stage in corpus_pipeline.STAGES:
        kept.append(materialize(stage(spark, kept[-1], SF), name))
    assert all(k.columns == columns for k in kept[:-1])
    first, second, third, fourth, last = kept[1:]
    # language: what identify() doesn't reject, with its language
    told = {r.doc_id: r._lang for r in identify(docs, train(docs)).where("NOT _rejected").collect()}
    assert {r.doc_id: r.lang for r in first.collect()} == told
    # near duplicates: the smallest id of each class, by all pairs of sets
    assert {str(r.doc_id) for r in second.collect()} == {c for _, _, c in plain_classes([(r.doc_id, r.text) for r in first.collect()])}
    # benchmark: words in windows, by sets of tuples; documents of which they are at most half stay, without them
    old = {r.doc_id: r.text for r in second.collect()}
    windows = set()
    for r in table(spark, SF, "benchmark").collect():
        w = cut(r.text)
        n = min(10, len(w))
        windows |= {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if n else set()
    lengths, hits, left = {len(w) for w in windows}, {}, {}
    for i, t in old.items():
        w, hit = cut(t), set()
        for n in lengths:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    hit.update(range(k, k + n))
        hits[i], left[i] = len(hit), [x for k, x in enumerate(w) if k not in hit]
    assert {r.doc_id for r in third.collect()} == {i for i, t in old.items() if 2 * hits[i] <= len(cut(t))}
    for r in third.collect():
        assert cut(r.text) == left[r.doc_id] and (r.text == old[r.doc_id] or hits[r.doc_id]) and r.n_chars == len(r.text)
    # secrets: every document stays, without any span of the base kinds; what had none is as it was
    clean = {r.doc_id: r.text for r in third.collect()}
    assert fourth.count() == third.count()
    for r in fourth.collect():
        assert not sum(plain_secrets(r.text)[:3])
        assert r.text == clean[r.doc_id] or "[REDACTED]" in r.text
    # token ids: as many as told, and the library decodes them to the text
    other, final = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model")), {r.doc_id: r.text for r in fourth.collect()}
    rows = last.collect()
    assert len(rows) == len(final) and all(r.n_pieces == len(r.ids) for r in rows)
    assert all(other.decode(r.ids) == final[r.doc_id].replace("\u2581", " ") for r in rows)


def test_odd_rows(spark):
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (None, "the cat sat on the mat", "en", "s", 22), (3, "the cat sat on the mat", "en", None, 22), (3, "the cat sat on the mat", "en", None, 22)]
    docs = spark.createDataFrame(rows, table(spark, SF, "documents").schema)
    for own in (docs, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            own = materialize(stage(spark, own, SF), "odd")
        assert own.count() <= 5


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0 and 4 <= len(corpus_pipeline.STAGES) <= 5 and corpus_pipeline.ORACLE_SQL is None


def test_near_duplicates_groups_no_shared_passages(spark, monkeypatch):
    """Texts that share a tenth of their shingles with the next stay, and none is fetched again to be compared."""
    rng, seen = random.Random(18), []
    links = jaccard._links
    monkeypatch.setattr(jaccard, "_links", lambda docs, reps, groups, *rest: seen.append(groups.count()) or links(docs, reps, groups, *rest))
    passages = [[words(rng, 5, 10**6) for _ in range(20)] for _ in range(41)]
    texts = [" ".join(w for p, q in zip(passages[i], passages[i + 1], strict=True) for w in [*p, *words(rng, 5, 10**6), *q, *words(rng, 5, 10**6)]) for i in range(40)]
    assert corpus_pipeline.near_duplicates(spark, docs_of(spark, texts), "").count() == 40 and seen == [0]
