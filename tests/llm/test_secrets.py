from __future__ import annotations

import hashlib
import random
import re
import time

from helpers import docs_of

from meshwork.llm.secrets import RULES, Rule, all_trigrams, candidates, postings, redact, secrets, trigram_query

BASE = {"assign": (re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A), 2, 6), "access": (re.compile("AKIA[A-Z0-9]+"), 0, 20), "hex": (re.compile("[0-9a-f]+"), 0, 24)}


def plain(text):
    spans, counts = [], []
    for rank, (kind, (pattern, group, least)) in enumerate(BASE.items()):
        found = [m for m in pattern.finditer(text or "") if len(m[group]) >= least]
        counts.append(len(found))
        spans += [(m.start(), rank, f"{kind}:{m.start()}:{m.end()}") for m in found]
    return (*counts, hashlib.sha256(",".join(s for _, _, s in sorted(spans)).encode()).hexdigest())


def texts():
    rng = random.Random(11)
    bits = ["token", "TOKEN", "secret", "Password", "passwd", "api_key", "ApiKey", "=", ":", " ", '"', "'", "abcdef", "x", "é", "🙂", "\n", "0123456789abcdef", "AKIA", "ABCDEFGH12345678", "deadbeef", "==", "K", "-----BEGIN RSA PRIVATE KEY-----", "ghp_" + "a1" * 18]
    made = ["".join(rng.choice(bits) for _ in range(rng.randrange(1, 30))) for _ in range(300)]
    return [None, "", "token=token: abcdefgh", "token=ab secret: 'abcdef'", 'x="🙂" api_key = "k/+=abcd"', "AKIA" * 6, "toKen=abcdef", *made, "é" * 100000 + " token=abcdefgh " + "a" * 30]


def test_against_plain(spark):
    own = texts()
    got = {r.doc_id: tuple(r)[1:5] for r in secrets(docs_of(spark, own)).collect()}
    assert got == {i: plain(t) for i, t in enumerate(own)}


def test_index_gives_all_matches(spark):
    """Candidates are exactly the texts that hold what a rule's query asks for, and so hold all matches."""
    own = texts()
    docs = docs_of(spark, own)
    found = {(r["rank"], r.id) for r in candidates(postings(docs, block_docs=50)).collect()}
    holds = lambda q, t: all(any(all(g in t for g in a) for a in c) for c in q)
    for rank, rule in enumerate(RULES):
        if query := trigram_query(rule.pattern):
            assert {i for k, i in found if k == rank} == {i for i, t in enumerate(own) if t and holds(query, t.lower())}
            assert {(rank, i) for i, t in enumerate(own) if t and re.search(rule.pattern, t)} <= found
    assert not trigram_query("[0-9a-f]{24,}") and not trigram_query("a.?b") and len(all_trigrams()) > 20


def test_null_and_repeated_ids(spark):
    own = ["token=abcdefgh", "nothing", "AKIA" * 6, None]
    rows = secrets(docs_of(spark, own * 2, [None, 3, 3, 3, None, None, 3, 4])).collect()
    assert sorted((str(r.doc_id), r.n_assign, r.n_access) for r in rows) == sorted([("None", 1, 0), ("3", 0, 0), ("3", 0, 1), ("3", 0, 0), ("None", 1, 0), ("None", 0, 0), ("3", 0, 1), ("4", 0, 0)])


def test_many_matches(spark):
    """A megabyte of tokens: time and memory follow the matches."""
    own = " ".join(f"token=abc{k:07d} \u00e9" for k in range(40_000))
    began = time.time()
    row = secrets(docs_of(spark, [own])).first()
    assert tuple(row)[1:5] == plain(own) and row.n_assign == 40_000
    assert redact(docs_of(spark, [own])).first().text == " ".join(["[REDACTED] \u00e9"] * 40_000)
    assert time.time() - began < 60


def test_redact_and_empty(spark):
    own = ["a token=abcdef0123456789abcdef01 b", None, "clean", "é AKIA" + "A" * 16 + "!"]
    assert [r.text for r in redact(docs_of(spark, own)).orderBy("doc_id").collect()] == ["a [REDACTED] b", None, "clean", "é [REDACTED]!"]
    assert secrets(docs_of(spark, own).limit(0)).count() == 0
    twice = secrets(docs_of(spark, ["token=abcdefg"] * 2, [1, 1]), (*RULES, Rule("word", "abc"))).collect()
    assert len(twice) == 2 and twice[0] == twice[1] and twice[0].spans == "assign:0:13,word:6:9"
