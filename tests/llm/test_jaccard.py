from __future__ import annotations

import random
import re
import time
from pathlib import Path

import numpy as np
import pytest
from helpers import docs_of, words

from meshwork.llm import jaccard
from meshwork.llm.jaccard import components, deduplicate, links_within, pack, similar_classes, unpack


def plain(rows, k=5, percent=80):
    fold = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    cut = [re.findall("[^\x20\x09-\x0d]+", fold(t)) for _, t in rows]
    sets = [{tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set() for w in cut]
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                up[root(a)] = root(b)
    least = {}
    for x, (i, _) in enumerate(rows):
        if i is not None:
            least[root(x)] = min(i, least.get(root(x), i))
    return sorted((str(i), len(sets[x]), str(least.get(root(x)) if sets[x] else i)) for x, (i, _) in enumerate(rows))


def corpus():
    rng = random.Random(9)
    texts = [None, "", " \t\n", "one two", "ONE  two", "one two three", "é à ü", "é à ü"]
    passage = words(rng, 60)
    for _ in range(12):
        own = words(rng, rng.randrange(5, 90))
        texts.append(" ".join(own))
        for _ in range(6):  # a chain of near copies
            own = list(own)
            own[rng.randrange(len(own))] = "changed"
            texts.append("\n".join(own).title())
    for _ in range(15):
        texts.append(" ".join(words(rng, 12) + passage + words(rng, rng.randrange(3, 40))))
    near = words(rng, 150, 5000)
    for _ in range(90):  # many near copies of one text
        own = list(near)
        for _ in range(rng.randrange(1, 6)):
            own[rng.randrange(len(own))] = f"v{rng.randrange(1000)}"
        texts.append(" ".join(own))
    return texts + [texts[9]] * 5 + ["long " * 20000, " ".join(words(rng, 20000, 10**6))]


@pytest.mark.parametrize("block,told,common", [(jaccard.BLOCK, 10**6, jaccard.COMMON), (1500, 0, 60)])
def test_against_plain(spark, monkeypatch, block, told, common):
    monkeypatch.setattr(jaccard, "TOLD_ROWS", told)
    monkeypatch.setattr(jaccard, "COMMON", common)
    texts = corpus()
    ids = [(7 * i) % len(texts) for i in range(len(texts))]
    ids[3], ids[-1] = None, ids[10]
    got = similar_classes(docs_of(spark, texts, ids), block=block).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == plain(list(zip(ids, texts, strict=True)))


def test_other_thresholds_and_empty(spark):
    texts = corpus()[:60]
    got = similar_classes(docs_of(spark, texts), words=3, percent=50).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == plain(list(enumerate(texts)), 3, 50)
    assert similar_classes(docs_of(spark, texts).limit(0)).count() == 0
    assert similar_classes(docs_of(spark, [None, ""])).count() == 2


def test_deduplicate(spark):
    texts = ["a b c d e f g h", None, "A b c d e f g h", "", "z y x", "z y x"]
    kept = deduplicate(docs_of(spark, texts, [4, 1, 2, 3, 6, 6]))
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2, 3, 6] and "a.b" in kept.columns


def test_deduplicate_repeated_and_null_ids(spark):
    a, b, c = ([f"{x}{i}" for i in range(60)] for x in "abc")
    near = lambda w: " ".join([*w[:-1], "other"])
    a, b, c, near_b, near_c = " ".join(a), " ".join(b), " ".join(c), near(b), near(c)
    rows = [(1, a), (5, a), (5, "p q r s t u"), (7, b), (7, near_b), (None, c), (None, near_c), (None, a), (None, None), (None, None), (8, ""), (8, ""), (9, "")]
    kept = deduplicate(docs_of(spark, [t for _, t in rows], [i for i, _ in rows]))
    got = [(r.doc_id, r.text) for r in kept.collect()]
    assert "a.b" in kept.columns and len(got) == 8
    assert sum(i == 7 and t in (b, near_b) for i, t in got) == sum(t in (c, near_c) for _, t in got) == 1
    rest = [x for x in got if x[1] not in (b, near_b, c, near_c)]
    assert sorted(rest, key=str) == sorted([(1, a), (5, "p q r s t u"), (None, None), (None, None), (8, ""), (9, "")], key=str)


@pytest.mark.parametrize("most", [jaccard.EDGES, 20])
def test_components(spark, monkeypatch, most):
    monkeypatch.setattr(jaccard, "EDGES", most)
    edges = [(f"{i:03d}".encode(), f"{i + 1:03d}".encode()) for i in range(40)] + [(b"900", b"%03d" % k) for k in range(901, 930)] + [(b"x", b"x")]
    got = {bytes(r.node): bytes(r.root) for r in components(spark.createDataFrame(edges, "a binary, b binary")).collect()}
    assert got == {b"%03d" % i: b"000" for i in range(41)} | {b"%03d" % k: b"900" for k in range(900, 930)}


def test_incremental_answers():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 60, 80, dtype=np.uint64)
    sets = []
    for _ in range(60):
        own = base.copy()
        own[rng.integers(0, 80, rng.integers(0, 16))] = rng.integers(0, 1 << 60, 1, dtype=np.uint64)
        sets.append(np.unique(own))
    for side in (None, [i % 2 for i in range(60)]):
        up = list(range(60))
        for a, b in links_within(sets, side, 80):
            assert side is None or side[a] != side[b]
            up = [up[a] if u == up[b] else u for u in up]
        for a in range(60):
            for b in range(a):
                n = len(np.intersect1d(sets[a], sets[b]))
                if (side is None or side[a] != side[b]) and 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n):
                    assert up[a] == up[b]


@pytest.mark.parametrize("percent,most", [(80, 1 << 21), (80, 50), (50, 1 << 21)])
def test_lists_lose_nothing(percent, most):
    """The components of what the position index tells are those of all pairs that sizes and positions leave."""
    rng = np.random.default_rng(4)
    for size, lists in ((1, 1), (150, 1), (400, 90), (600, 4)):
        rows = np.zeros(size, jaccard.POSTING)
        rows["t"], rows["n"] = rng.integers(0, lists, size), rng.integers(1, 70, size)
        rows["p"], rows["lo"] = rng.integers(0, 1 + rows["n"] - -(-percent * rows["n"].astype(int) // 100)), np.arange(size)
        n, p = rows["n"].astype(int), rows["p"].astype(int)
        forest = jaccard.Forest(size)
        for i in range(size):
            for j in range(i):
                if rows["t"][i] == rows["t"][j] and 100 * min(n[i], n[j]) >= percent * max(n[i], n[j]) and min(n[i] - p[i], n[j] - p[j]) >= jaccard.needed(n[i], n[j], percent):
                    forest.join(i, j)
        _, kept, a, b = jaccard.compact(rows, percent)
        kept = rows[kept]
        i, j = jaccard.candidate_edges(kept, percent, most)
        got = jaccard.Forest(size)
        place = lambda fp: int.from_bytes(fp[8:], "little")
        for x, y in [*zip(map(place, a), map(place, b), strict=True), *zip(kept["lo"][i].tolist(), kept["lo"][j].tolist(), strict=True)]:
            got.join(x, y)
        assert [got.root(x) for x in range(size)] == [forest.root(x) for x in range(size)]


def test_compact_bounds_a_list():
    rows = np.zeros(50_000, jaccard.POSTING)
    rows["t"], rows["n"], rows["p"], rows["lo"] = 5, 300 + np.arange(50_000) % 9, np.arange(50_000) % 4, np.arange(50_000)
    alone, kept, a, _ = jaccard.compact(np.concatenate([rows, rows]), 80)
    assert not len(alone) and len(kept) == 36 and len(a) == 50_000 - 36


def test_packed_keys():
    keys = np.sort(np.random.default_rng(4).integers(0, 1 << 40, 999, dtype=np.uint64))
    assert (unpack(pack(keys)) == keys).all()


def test_cells_tell_counts():
    rng = np.random.default_rng(6)
    shingles = rng.integers(0, 1 << 64, 4000, dtype=np.uint64)
    n = rng.choice([1, 1, 2, 3, 40, 5000], 4000)
    keys = np.sort(np.repeat(shingles >> np.uint64(64 - jaccard.COUNT_BITS), n))
    cuts = np.searchsorted(keys, [(1 << jaccard.COUNT_BITS) * k // 3 for k in (1, 2)])
    for bits in (4, 20):
        table = np.zeros(1 << bits - 1, np.uint8)
        for part in np.split(keys, cuts):  # a cell, though not a key, can be in two
            begin, data = jaccard.cells(part, bits)
            table[begin : begin + len(data)] |= np.frombuffer(data, np.uint8)
        got, least = jaccard.levels(table, shingles), np.searchsorted(jaccard.LEVELS, n, "right")
        assert (got >= least).all() and (got[n == 1] > 0).mean() < (0.02 if bits == 20 else 1.1)


@pytest.mark.parametrize("bits", [(1, 4), (16, 27)])
def test_full_cells_lose_nothing(spark, monkeypatch, bits):
    monkeypatch.setattr(jaccard, "CELL_BITS", bits)
    texts = corpus()
    got = similar_classes(docs_of(spark, texts)).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == plain(list(enumerate(texts)))


def test_shared_passages_make_no_group(spark, monkeypatch):
    """Texts that share a tenth of their shingles with the next are no candidates: most of their shingles are in no other."""
    rng, seen = random.Random(8), []
    links = jaccard._links
    monkeypatch.setattr(jaccard, "_links", lambda docs, reps, groups, *rest: seen.append(groups.count()) or links(docs, reps, groups, *rest))
    passages = [[words(rng, 5, 10**6) for _ in range(20)] for _ in range(121)]
    texts = [" ".join(w for p, q in zip(passages[i], passages[i + 1], strict=True) for w in [*p, *words(rng, 5, 10**6), *q, *words(rng, 5, 10**6)]) for i in range(120)]
    got = similar_classes(docs_of(spark, texts)).collect()
    assert seen == [0] and all(r.component_id == r.doc_id for r in got)


def shuffles(spark):
    """Ids of the shuffles of which there are files."""
    return set(re.findall(r"shuffle_(\d+)_", spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString(" ")))


def test_counts_and_shuffle_files_go(spark, monkeypatch):
    """When sets are fetched, nothing is left of the counts; what is written leaves no shuffle files."""
    shared, seen = Path(spark.conf.get("spark.sql.warehouse.dir").removeprefix("file:")) / "_shared", []
    links, before = jaccard._links, set(shared.glob("sets-*"))
    monkeypatch.setattr(jaccard, "_links", lambda docs, *rest: seen.append(set(shared.glob("sets-*")) - before) or links(docs, *rest))
    similar_classes(docs_of(spark, corpus()[:60])).collect()
    assert seen == [set()]
    old = shuffles(spark)
    jaccard.materialize(spark.range(1000).repartition(8, "id"), "swept")
    until = time.time() + 20
    while shuffles(spark) - old and time.time() < until:
        time.sleep(0.2)
    assert not shuffles(spark) - old and spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


def test_edges_of_many_tasks_go_to_few_files(spark):
    shared = Path(spark.conf.get("spark.sql.warehouse.dir").removeprefix("file:")) / "_shared"
    edges = spark.range(64).repartition(64, "id").selectExpr("CAST(format_string('%03d', id) AS binary) AS a", "CAST(format_string('%03d', id + 1) AS binary) AS b")
    with_many = edges.rdd.getNumPartitions()
    got = {bytes(r.node): bytes(r.root) for r in components(edges, "few", 3).collect()}
    assert got == {b"%03d" % i: b"000" for i in range(65)} and with_many == 64
    assert len([*shared.glob("few-*/part-*")]) <= 3 + 1 + 1
