from __future__ import annotations

import math
import random
import re

import pytest
from helpers import words
from pyspark.sql import functions as F

from meshwork.llm.common import WordHasher
from meshwork.llm.quality import DIMENSIONS, Features, learn, quality_scores, train


def corpus(spark, n=600):
    rng = random.Random(7)
    docs, labels = [], []
    for i in range(n):
        good = rng.random() < 0.7
        own = words(rng, rng.randrange(20, 60), 200)
        docs.append((i, " ".join(own if good else [w.upper() + "!!" for w in own]) if i % 3 else " ".join(own) if good else " ".join([own[0]] * 40)))
        if i % 2 == 0:
            labels.append((i, int(good), 0))
    docs += [(n, None), (n + 1, ""), (None, "w1 w2"), (0, "w1 w2 w3"), (n + 2, "w3 " * 30000)]
    labels += [(None, 1, 0), (n + 50, 0, 0), (2, None, 0), (4, 1, 1)]
    return spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS score", "2 AS id", "3 AS y", "4 AS rank"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out(spark):
    docs, labels = corpus(spark)
    rows = quality_scores(docs, labels).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    truth = {r.doc_id: r.quality for r in labels.collect() if r.quality is not None and r.doc_id is not None}
    told = [(truth[r.doc_id], r.score) for r in rows if r.held_out and r.doc_id in truth and r.doc_id > 4]
    good, bad = [s for y, s in told if y], [s for y, s in told if not y]
    assert len(bad) > 5 and sum(a > b for a in good for b in bad) / (len(good) * len(bad)) > 0.97


def test_held_out_labels_do_not_train(spark):
    docs, labels = corpus(spark, 200)
    out = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    a, b = train(docs, labels), train(docs, labels.withColumn("quality", F.when(out, 1 - F.col("quality")).otherwise(F.col("quality"))))
    assert (a.weights == b.weights).all() and a.bias == b.bias


def test_empty(spark):
    docs, labels = corpus(spark, 20)
    assert {r.score for r in quality_scores(docs, labels.limit(0)).collect()} == {0.5}
    assert quality_scores(docs.limit(0), labels).count() == 0
    assert learn([]).bias == 0


M = 2**64


def mixed(x):
    x = (x + 0x9E3779B97F4A7C15) % M
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 % M
    x = (x ^ x >> 27) * 0x94D049BB133111EB % M
    return x ^ x >> 31


def plain_features(text, values, shapes):
    """Distinct dimensions of words, pairs and shapes, by whole numbers."""
    a, b, c = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9
    own = re.findall(rb"[^\x20\x09-\x0d]+", (text or "").encode())
    word = [mixed((sum(values[x] * pow(WordHasher.BASE, i, M) for i, x in enumerate(w)) + len(w)) % M) for w in own]
    shape = []
    for i, w in enumerate(own):
        s = [shapes[x] for x in w]
        shape.append((mixed((s[0] * a + s[min(1, len(s) - 1)] * b + s[max(0, len(s) - 2)] * c + s[-1]) % M) + (i > 0 and w == own[i - 1])) % M)
    pairs = [(mixed((x * a + y) % M) + 1) % M for x, y in zip(word, word[1:], strict=False)]
    both = [(mixed((x * b + y) % M) + 2) % M for x, y in zip(shape, shape[1:], strict=False)]
    return sorted({x % DIMENSIONS for x in word + shape + pairs + both})


def plain_scores(rows, alpha=1.0, beta=1.0, l1=0.02, l2=0.5):
    """rows: (features, label) in order; follow-the-regularised-leader by dictionaries."""
    z, n = {}, {}

    def weight(d):
        x, m = z.get(d, 0.0), n.get(d, 0.0)
        return 0.0 if abs(x) <= l1 else -(x - math.copysign(l1, x)) / ((beta + math.sqrt(m)) / alpha + l2)

    for _ in range(5):
        for dims, y in rows:
            x = {d: 1 / math.sqrt(max(1, len(dims))) for d in dims} | {"bias": 1.0}
            w = {d: weight(d) for d in x}
            p = 1 / (1 + math.exp(-sum(w[d] * v for d, v in x.items())))
            for d, v in x.items():
                g, before = (p - y) * v, n.get(d, 0.0)
                z[d] = z.get(d, 0.0) + g - (math.sqrt(before + g * g) - math.sqrt(before)) / alpha * w[d]
                n[d] = before + g * g
    return lambda dims: 1 / (1 + math.exp(-(weight("bias") + (sum(map(weight, dims)) / math.sqrt(len(dims)) if dims else 0.0))))


def test_against_plain(spark):
    """Scores of all rows are those of a version by whole numbers, dictionaries and loops."""
    docs, labels = corpus(spark, 80)
    docs = docs.where("doc_id IS NULL OR doc_id <> 0")  # of an id with two texts, one is chosen
    own = Features()
    values, shapes = [int(x) for x in own.words.values], [int(x) for x in own.shapes.values]
    texts = {r.doc_id: r.text for r in docs.collect()}
    told = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & (F.crc32(F.col("doc_id").cast("string")) % 5 != 0)).select("doc_id", "quality", F.xxhash64("doc_id").alias("rank")).distinct().collect()  # a repeated label counts once
    rows = [(plain_features(texts[r.doc_id], values, shapes), r.quality) for r in sorted(told, key=lambda r: (r["rank"], r.quality)) if r.doc_id in texts]
    score = plain_scores(rows)
    for r in quality_scores(docs.coalesce(1), labels).collect():
        text = texts[r.doc_id]
        if text is None or len(text) < 10_000:
            assert r.score == pytest.approx(score(plain_features(text, values, shapes)), abs=1e-5)
