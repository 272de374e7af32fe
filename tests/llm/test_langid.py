from __future__ import annotations

import math
import random
from collections import Counter

import numpy as np
import pytest
from helpers import docs_of
from pyspark.sql import functions as F

from meshwork.llm.langid import EXCERPTS, REACH, excerpts, identify, predict, train

STEMS = {"aa": ["bana", "kolo", "mira", "tapu"], "bb": ["schn", "grüt", "werk", "ßtim"], "cc": ["çon", "éto", "vous", "quel"]}


def corpus(spark, n=240):
    rng = random.Random(5)
    rows = []
    for i in range(n):
        lang = rng.choice(sorted(STEMS))
        rows.append((i, " ".join("".join(rng.choice(STEMS[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(30)), lang if i % 10 else None))
    rows += [(n, None, "aa"), (n + 1, "", "bb"), (n + 2, "12 34 !!", None), (n + 3, "ЖЩ ЮЯ ЪЫ", None), (None, "bana kolo", "aa"), (5, "bana kolo", "aa"), (n + 4, "kolo " * 40000, "aa")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "'s' AS source", "1 AS score", "2 AS `_lang`", "3 AS rejected", "4 AS row")


def test_held_out(spark):
    docs = corpus(spark)
    rows = predict(docs).join(docs.select(F.col("doc_id"), "text", F.col("lang")), "doc_id").collect()
    told = [r for r in rows if r.held_out and r.lang and r.text and len(r.text) > 20]
    assert len(told) > 40 and sum(r.lang == r.lang_pred for r in told) / len(told) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)
    by = {r.doc_id: r for r in rows}
    assert by[240].lang_pred == by[241].lang_pred == by[242].lang_pred == "und" and by[240].rejected
    assert predict(docs).count() == docs.count()


def test_held_out_rows_do_not_train(spark):
    docs = corpus(spark)
    out = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    a = train(docs)
    b = train(docs.withColumn("lang", F.when(out, "cc").otherwise(F.col("lang"))))
    assert a.languages == b.languages == ("aa", "bb", "cc") and (a.vectors == b.vectors).all()


def test_rejection_and_empty(spark):
    model = train(corpus(spark))
    found = identify(docs_of(spark, ["ЖЩ ЮЯ ЪЫ ЬЭ", "bana kolo mira"]), model).orderBy("doc_id").collect()
    assert found[0]._rejected and not found[1]._rejected and found[1]._lang == "aa" and found[1]["a.b"] == "q"
    assert [r._lang for r in identify(docs_of(spark, ["– 12 … 🙂 »", "é"]), model).orderBy("doc_id").collect()][0] == "und"
    none = corpus(spark).limit(0)
    assert predict(none).count() == 0
    assert {r.lang_pred for r in predict(corpus(spark).withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert model.least == pytest.approx(train(corpus(spark)).least)


SYLLABLES = {
    "aa": "the and ing ion er en of to ly ou wh th ed is on es at",
    "bb": "der die ung sch keit lich ein ich zu für ge und be ß ö",
    "cc": "que los ción mente el la de es ado en ñ á rr os ía",
}


def prose(rng, lang, n):
    own = SYLLABLES[lang].split()
    return " ".join("".join(rng.choice(own) for _ in range(rng.randrange(1, 4))) for _ in range(n))


def test_unlearned_texts_and_noise(spark):
    """Long and short texts train; foreign texts and noise are rejected, genuine texts of two words aren't."""
    rng = random.Random(6)
    rows = [(i, prose(rng, lang, rng.choice([1, 2, 3, 10, 40, 120])), lang) for i in range(600) for lang in [rng.choice(sorted(SYLLABLES))]]
    model = train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    foreign = [
        "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw",
        "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan",
        "Bütün insanlar hür, haysiyet ve haklar bakımından eşit doğarlar",
        "Watu wote wamezaliwa huru, hadhi na haki zao ni sawa",
        "Genir pawb yn rhydd ac yn gydradd mewn urddas a hawliau",
        *["".join(rng.choice("abcdefghijklmnopqrstuvwxyz    ") for _ in range(n)) for n in (60, 300, 2000, 20000)],
    ]
    genuine = [(prose(rng, lang, n), lang) for lang in sorted(SYLLABLES) for n in (2, 3, 500) for _ in range(10)]
    found = identify(docs_of(spark, foreign + [t for t, _ in genuine]), model).orderBy("doc_id").collect()
    assert all(r._rejected for r in found[: len(foreign)])
    assert not any(r._rejected for r in found[len(foreign) :])
    assert sum(r._lang == lang for r, (_, lang) in zip(found[len(foreign) :], genuine, strict=True)) >= 0.95 * len(genuine)


def test_excerpts():
    for text in ("", "a", "kolo mira " * 300, "漢" * 3000, "a\tb\n" * 50):
        cut = excerpts(text, 7)
        assert cut == excerpts(text, 7) and len(cut) == sum(2 * n <= len(text) for n in EXCERPTS)
        assert all(n <= len(c) <= n + 2 * REACH for n, c in zip(EXCERPTS, cut, strict=False))
    assert all(set(c.split()) <= {"kolo", "mira"} for c in excerpts("kolo mira " * 300, 7))


def plain_counts(text):
    """n-grams that begin at a letter, each hashed by whole numbers."""
    code = [b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 0 for b in text.encode()]
    found = Counter()
    for a, b, c in zip([0, *code], code, [*code[1:], 0], strict=False):
        if b:
            for gram in (b, b << 8 | c | 1 << 24, a << 16 | b << 8 | c | 1 << 25):
                x = gram * 0x9E3779B1 % 2**32
                found[(x ^ x >> 15) * 0x85EBCA6B % 2**32 >> 20] += 1
    return found


def plain_model(rows, k=4, folds=3):
    """rows: (language, text, rank), in order of rank: centroids and bounds by dictionaries and loops."""
    own = [(lang, plain_counts(t), [plain_counts(e) for e in excerpts(t, rank) if any(c.isalpha() for c in e)]) for lang, t, rank in rows]
    own = [r for r in own if r[1]]
    df = Counter(d for _, c, _ in own for d in c)
    idf = lambda d: math.log((1 + len(own)) / (1 + df[d])) + 1

    def unit(counts):
        v = {d: (1 + math.log(n)) * idf(d) for d, n in counts.items()}
        size = math.sqrt(sum(x * x for x in v.values()))
        return {d: x / size for d, x in v.items()}

    dot = lambda a, b: sum(x * b.get(d, 0.0) for d, x in a.items())

    def mean(vs, scale=True):
        total = Counter()
        for v in vs:
            total.update(v)
        size = math.sqrt(sum(x * x for x in total.values())) if scale else len(vs)
        return {d: x / size for d, x in total.items()}

    def clustered(vs):
        near = mean(vs, scale=False)
        starts = [max(range(len(vs)), key=lambda i: (dot(vs[i], near), -i))]
        while len(starts) < min(k, len(vs)):
            starts.append(min(range(len(vs)), key=lambda i: (max(dot(vs[i], vs[s]) for s in starts), i)))
        centres = [vs[s] for s in starts]
        for _ in range(12):
            at = [max(range(len(centres)), key=lambda j: (dot(v, centres[j]), -j)) for v in vs]
            centres = [mean([v for v, a in zip(vs, at, strict=True) if a == j]) if j in at else centres[j] for j in range(len(centres))]
        return centres

    model = []
    for lang in sorted({r[0] for r in own}):
        mine = [(unit(c), c, parts) for name, c, parts in own if name == lang]
        told = []
        for f in range(folds):
            others = clustered([v for i, (v, _, _) in enumerate(mine) if i % folds != f])
            told += [(len(c), max(dot(unit(c), o) for o in others)) for i, (_, c, parts) in enumerate(mine) if i % folds == f for c in (c, *parts)]
        told.sort(key=lambda x: x[0])
        groups = np.array_split(np.arange(len(told)), max(1, min(24, len(told) // 10)))
        at = [sum(math.log(told[i][0]) for i in g) / len(g) for g in groups]
        low = [float(np.quantile([told[i][1] for i in g], 0.01)) for g in groups]
        low = [min(low[i:]) for i in range(len(low))]
        model.append((lang, clustered([v for v, _, _ in mine]), at, low))

    def judge(text):
        counts = plain_counts(text or "")
        if not counts or not any(c.isalpha() for c in text):
            return "und", 0.0, True
        v = unit(counts)
        score, lang, at, low = max(((max(dot(v, c) for c in centres), lang, at, low) for lang, centres, at, low in model), key=lambda x: x[0])
        return lang, min(1.0, max(0.0, score)), score < 0.6 * float(np.interp(math.log(len(counts)), at, low))

    return judge


def test_against_plain(spark):
    """Languages, cosines and rejections of all rows are those of a version by dictionaries and loops."""
    rng = random.Random(8)
    rows = [(i, prose(rng, lang, rng.choice([1, 2, 5, 20])), lang) for i in range(70) for lang in [rng.choice(sorted(SYLLABLES))]]
    rows += [(100, "Kaikki ihmiset syntyvät vapaina", None), (101, "zzqx vvkj 12", None), (102, None, "aa"), (103, "", None), (104, "12 !", None), (105, "漢字", None), (106, "que los " * 20, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    told = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.crc32(F.col("doc_id").cast("string")) % 3 != 1)).select("lang", "text", F.xxhash64("doc_id").alias("rank")).collect()
    judge = plain_model(sorted(((r.lang, r.text, r["rank"]) for r in told), key=lambda r: r[2]))
    texts = {i: t for i, t, _ in rows}
    for r in predict(docs).collect():
        lang, score, rejected = judge(texts[r.doc_id])
        assert (r.lang_pred, r.rejected) == (lang, rejected) and r.score == pytest.approx(score, abs=1e-9), r
