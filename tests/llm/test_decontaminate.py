from __future__ import annotations

import hashlib
import random
import re
import time

from helpers import docs_of, words

from meshwork.llm.decontaminate import SuffixAutomaton, contamination, decontaminate, merged, words_of


def plain(text, items, window):
    cut = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    own = cut(text)
    hit, found = set(), set()
    for item, t in items:
        w = cut(t)
        n = min(window, len(w))
        for s in {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if n else ():
            for i in range(len(own) - n + 1):
                if tuple(own[i : i + n]) == s:
                    hit.update(range(i, i + n))
                    found.add(str(item))
    return len(own), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


def test_against_plain(spark):
    rng = random.Random(3)
    items = [(i, " ".join(words(rng, rng.choice([1, 3, 9, 10, 11, 25]), 60))) for i in range(12)] + [(12, None), (13, ""), (14, "?!"), (2, "w1 w2"), (15, "Été à 10 h. Mañana OK; ñ")]
    texts = [None, "", "...", "ÉTÉ à 10 h mañana ok ñ", "xx été à 10 H, mañana--ok ñ yy"]
    for k in range(40):
        t = words(rng, rng.randrange(1, 80), 60)
        if k % 2:
            item = (rng.choice(items)[1] or "").split()
            t[rng.randrange(len(t)) :] = item[: rng.randrange(len(item) + 1)] + t[-5:]
        texts.append(" ".join(t).upper() if k % 5 == 0 else ", ".join(t))
    texts += [texts[6], "w1 " * 30000]
    bench = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 AS id")
    got = {r.doc_id: tuple(r)[1:] for r in contamination(docs_of(spark, texts), bench, window=10).collect()}
    assert got == {i: plain(t, items, 10) for i, t in enumerate(texts)}
    parts = {r.doc_id: tuple(r)[1:] for r in contamination(docs_of(spark, texts), bench, window=10, part_bytes=200).collect()}
    assert parts == got  # several automata, one pass each


def test_removal(spark):
    item = "one two three four five six seven eight nine ten eleven"
    texts = ["Keep this; " + item.upper() + ", and that.", item, None, "nothing here", "a " * 9 + item]
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    rows = {r.doc_id: r._hits for r in decontaminate(docs_of(spark, texts), bench).collect()}
    assert rows[0].clean_text == "Keep this; , and that." and rows[0].longest == 11 and rows[0]["items"] == ["1"]
    assert [rows[i]["drop"] for i in range(5)] == [True, True, False, False, True] and rows[2].clean_text is None and rows[3].clean_text == "nothing here"
    assert decontaminate(docs_of(spark, texts), bench.limit(0)).where("_hits.n_hit > 0").count() == 0
    assert contamination(docs_of(spark, texts).limit(0), bench).count() == 0


def test_longest_match():
    own = SuffixAutomaton([("a", b"x y z x y"), ("b", b"y z x q")], window=3)
    assert own.matches(words_of(b"p x y z x q y"))[2] == 4
    assert own.matches(words_of(b"z x y"))[1] == {"a"}


def test_repetitive_items_and_texts():
    """Time follows the words, also where one word repeats; windows that all items share are united once."""
    began = time.time()
    own = SuffixAutomaton([("a", b"the " * 100_000), *((f"i{k}", b"p q r s t u v w x y z") for k in range(300))], window=10)
    spans, items, longest = own.matches(words_of(b"the " * 100_000 + b"p q r s t u v w x y " * 3000))
    assert spans == [(0, 100_000)] + [(100_000, 130_000)] or merged(spans) == [(0, 130_000)]
    assert len(items) == 301 and longest == 100_000 and time.time() - began < 10
