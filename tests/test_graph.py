"""Graph algorithms against plain Python over small fixtures."""

from __future__ import annotations

import inspect
from collections import deque

import pytest
from pyspark.sql import functions as F

from meshwork.functions import scalar
from meshwork.operators import graph as g
from meshwork.operators import partition as p
from meshwork.operators import validate
from meshwork.plans import loop
from meshwork.plans.bfs import bfs, bfs_banded, bfs_blocks, components
from meshwork.plans.coloring import coloring
from meshwork.plans.pagerank import normalized, pagerank, rank_errors, statistics
from meshwork.plans.program import FrontierProgram, components_program

PATH = [(i, i + 1) for i in range(9)]
STAR = [(0, i) for i in range(1, 12)]
CLIQUE = [(a, b) for a in range(5) for b in range(5) if a != b]
GRID = [(4 * r + c, 4 * r + c + 1) for r in range(4) for c in range(3)] + [(4 * r + c, 4 * r + 4 + c) for r in range(3) for c in range(4)]


def graph(spark, edges, n=None, symmetric=True):
    rows = spark.createDataFrame(edges, "src long, dst long")
    vertices = spark.range(n if n is not None else max(max(e) for e in edges) + 1).select(F.col("id").alias("v"))
    return g.Graph.of(g.clean_edges(rows, symmetric=symmetric), vertices)


def depths_of(edges, n, sources):
    near = {}
    for a, b in edges:
        near.setdefault(a, []).append(b)
    found, queue = {s: 0 for s in sources}, deque(sources)
    while queue:
        v = queue.popleft()
        for w in near.get(v, ()):
            if w not in found:
                found[w] = found[v] + 1
                queue.append(w)
    return {v: found.get(v, n + 1) for v in range(n)}


def both(edges):
    return {(a, b) for a, b in edges if a != b} | {(b, a) for a, b in edges if a != b}


def test_cleaning(spark):
    raw = spark.createDataFrame([(1, 2), (1, 2), (2, 2), (3, 1), (None, 1)], "src long, dst long")
    assert {tuple(r) for r in g.clean_edges(raw, base=1).collect()} == {(0, 1), (2, 0)}
    assert {tuple(r) for r in g.clean_edges(raw, base=1, symmetric=True).collect()} == {(0, 1), (1, 0), (0, 2), (2, 0)}


@pytest.mark.parametrize("edges,n,sources", [(PATH, 12, [0]), (STAR, 12, [3]), (GRID, 16, [0, 15]), (CLIQUE, 7, [2])])
def test_bfs(spark, edges, n, sources):
    own = graph(spark, edges, n)
    found, record = bfs(own, sources)
    expected = depths_of(both(edges), n, sources)
    assert {r.v: r.depth for r in found.collect()} == expected
    assert record.workload == sum(d <= n for d in expected.values())
    assert {r.v: r.depth for r in bfs_banded(own, sources, threshold=2, delta=2)[0].collect()} == expected
    assert validate.bfs_violations(own, found, sources).first().asDict() == {"n_sources": 0, "n_edges": 0, "n_orphans": 0}


def test_bfs_bounded_and_directed(spark):
    own = graph(spark, PATH, 10, symmetric=False)
    assert {r.v: r.depth for r in bfs(own, [4], max_depth=2)[0].collect()} == {v: v - 4 if 4 <= v <= 6 else 11 for v in range(10)}
    wrong = own.vertices.select("v", F.lit(0).cast("long").alias("depth"))
    assert validate.bfs_violations(own, wrong.where("v > 0").union(spark.createDataFrame([(0, 5)], "v long, depth long")), [0]).first().n_sources == 1


def ranks_of(edges, n, damping=0.85, epsilon=0.01):
    out = {}
    for a, b in edges:
        out.setdefault(a, []).append(b)
    rank, res = [1 - damping] * n, [0.0] * n
    for a, to in out.items():
        for b in to:
            res[b] += (1 - damping) * damping / len(to)
    first = True
    while first or any(r >= epsilon for r in res):
        told, new = [0.0] * n, list(res)
        for v in range(n):
            if first or res[v] >= epsilon:
                rank[v] += res[v]
                new[v] = 0.0
                for w in out.get(v, ()):
                    told[w] += damping * res[v] / len(out[v])
        res = [x + y for x, y in zip(new, told, strict=True)]
        first = False
    return rank, res


@pytest.mark.parametrize("edges,n,symmetric", [(PATH, 12, True), (STAR, 12, False), (GRID, 16, True)])
def test_pagerank(spark, edges, n, symmetric):
    own = graph(spark, edges, n, symmetric)
    found = {r.v: (r["rank"], r.res) for r in pagerank(own)[0].collect()}
    rank, res = ranks_of(both(edges) if symmetric else edges, n)
    for v in range(n):
        assert found[v] == pytest.approx((rank[v], res[v]), abs=1e-9)


def test_pagerank_statistics(spark):
    own = graph(spark, GRID, 16)
    ranks, _ = pagerank(own)
    row = statistics(ranks).first()
    assert row.n_over == 0 and row.mass == pytest.approx(16)
    assert normalized(ranks).agg(F.sum("rank")).first()[0] == pytest.approx(1)
    assert validate.pagerank_violations(own, ranks).first().asDict() == {"n_over": 0, "n_low": 0, "n_off": 0}


@pytest.mark.parametrize("edges,n,at_most", [(PATH, 12, 3), (CLIQUE, 6, 5), (GRID, 16, 4), (STAR, 12, 2)])
@pytest.mark.parametrize("precedence", ["hash", "id"])
def test_coloring(spark, edges, n, at_most, precedence):
    own = graph(spark, edges, n)
    found, _ = coloring(own, precedence)
    colors = {r.v: r.color for r in found.collect()}
    assert len(colors) == n and all(colors[a] != colors[b] for a, b in both(edges)) and max(colors.values()) < at_most
    assert validate.coloring_violations(own, found).first().asDict() == {"n_conflicts": 0, "n_uncolored": 0, "n_high": 0}


def test_components_program(spark):
    own = graph(spark, [(0, 1), (1, 2), (4, 5)], 7)
    assert {r.v: r.component for r in components_program().run(own)[0].collect()} == {0: 0, 1: 0, 2: 0, 3: 3, 4: 4, 5: 4, 6: 6}
    with pytest.raises(ValueError):
        FrontierProgram({"x": F.lit(1)}, F.lit(1), "min", {}).run(own)


def test_rounds_without_cap(spark, monkeypatch):
    class Left:
        """A state of which one row fewer is active each round."""

        def __init__(self, n):
            self.n = n

        df = property(lambda self: self)
        told = property(lambda self: {"active": self.n})

        def drop(self):
            pass

    monkeypatch.setattr(loop, "dealt", lambda state, *_, **__: state)
    state, record = loop.iterate(Left(10_500), lambda s, _: Left(s.n - 1), lambda _: F.lit(True), "left", buckets=1)
    assert state.n == 0 and len(record.rounds) == 10_500
    assert inspect.signature(FrontierProgram.run).parameters["max_rounds"].default is None
    monkeypatch.undo()
    with pytest.raises(RuntimeError):
        components_program().run(graph(spark, PATH, 10), max_rounds=3)


def test_hubs_and_plans(spark):
    """A hub's edges are dealt to several buckets; results stay, and no round shuffles edges."""
    own = graph(spark, STAR + PATH, 12)
    split, whole = own.dealt(hub_edges=3), own.dealt()
    assert split.hubs.collect()[0].v == 0 and whole.hubs is None and split.table.df.select("salt").distinct().count() > 1
    for one in (split, whole):
        assert {tuple(r) for r in one.along(own.vertices).collect()} == both(STAR + PATH)
        assert {r.v: r.depth for r in bfs(one, [5])[0].collect()} == depths_of(both(STAR + PATH), 12, [5])
    for name in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"):
        spark.conf.set(name, "-1")
    try:
        plan = whole.along(whole.vertices.select("v", F.lit(1).alias("x"))).groupBy("dst").agg(F.sum("x"))._jdf.queryExecution().executedPlan().toString()
        assert "Exchange hashpartitioning(src" not in plan and plan.count("Exchange") == 1 and "Bucketed: true" in plan
    finally:
        for name in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"):
            spark.conf.unset(name)
    whole.release()
    split.release()


@pytest.mark.parametrize("edges,n,sources", [(PATH, 12, [0]), (STAR, 13, [3]), (GRID, 16, [0, 15]), (CLIQUE, 7, [2]), (PATH + GRID, 18, [40])])
def test_blocks(spark, edges, n, sources):
    own = graph(spark, edges, n)
    expected = depths_of(both(edges), n, [s for s in sources if s < n])
    for size in (3, 1000):
        assert {r.v: r.depth for r in bfs_blocks(own, sources, block_edges=size)[0].collect()} == expected


def test_components_by_jumping(spark):
    own = graph(spark, [(0, 1), (1, 2), (4, 5), (9, 8), (8, 20), (20, 3)], 22)
    root = {0: 0, 1: 0, 2: 0, 4: 4, 5: 4, 3: 3, 8: 3, 9: 3, 20: 3}
    found, _ = components(own)
    assert {r.v: r.component for r in found.collect()} == {v: root.get(v, v) for v in range(22)}
    far, record = components(graph(spark, [(i, i + 1) for i in range(299)], 300))
    assert {r.component for r in far.collect()} == {0} and len(record.rounds) < 16


def test_bands(spark):
    own = graph(spark, GRID, 16)
    for bad in ({"delta": 0}, {"delta": -1}, {"share": 0}, {"share": 2}):
        with pytest.raises(ValueError):
            bfs_banded(own, [0], **bad)
    assert {r.v: r.depth for r in bfs_banded(own, [0], 1, 1, share=0.5)[0].collect()} == depths_of(both(GRID), 16, [0])


def test_program_merge(spark):
    """A Python merge where no combiner will do: the median of what neighbours send."""
    own = graph(spark, STAR, 12)
    once = FrontierProgram({"x": F.col("v"), "active": F.lit(True)}, F.col("x"), None, {"x": F.coalesce("message", "x"), "active": F.lit(False)}, merge=lambda m: m.sort_values().iloc[len(m) // 2])
    assert {r.v: r.x for r in once.run(own)[0].collect()} == {0: 6} | {v: 0 for v in range(1, 12)}


def test_records_and_errors(spark):
    own = graph(spark, GRID, 16)
    runs = [bfs(own, [0])[1] for _ in range(2)]
    rows = {r["round"]: r for r in loop.mean_rounds(runs, spark).collect()}
    assert rows[-1].frontier == 16 and rows[0].frontier == 1 and rows[0].runs == 2
    a, b = (spark.createDataFrame(x, "v long, rank double") for x in ([(0, 1.0), (1, 2.0)], [(0, 1.5), (2, 0.25)]))
    assert rank_errors(a, b).first()[:4] == (3, 2.75, pytest.approx(2.75 / 3), 2.0) and rank_errors(a, b).first().worst == 1
    visits = {r.v: r.visits for r in pagerank(own, visits=True)[0].collect()}
    assert min(visits.values()) >= 1 and sum(visits.values()) == pagerank(own)[1].workload
    assert own.summary().first().asDict() == {"n_vertices": 16, "n_edges": 48, "max_degree": 4, "n_sinks": 0} and own.warm_up() > 0


def test_partitions(spark):
    own = graph(spark, STAR + PATH, 13)
    for found in (p.by_vertices(own, 3), p.by_edges(own, 3), p.by_random(own, 3), p.by_ratio(own, 3, 0.25)):
        labels = p.relabelled(found, 3).collect()
        assert sorted(r.v_new for r in labels) == list(range(13))
        assert [r.part for r in sorted(labels, key=lambda r: r.v_new)] == sorted(r.part for r in labels)
    assert [r.part for r in p.by_vertices(own, 3).orderBy("v").collect()] == [0] * 5 + [1] * 5 + [2] * 3
    moved = g.relabel_edges(own.edges, p.relabelled(p.by_random(own, 3), 3))
    assert moved.count() == own.edges.count()


def test_schemes(spark, tmp_path):
    own = graph(spark, GRID, 16)
    for scheme in ("vertices", "edges", "random", "ratio", "min_cut"):
        assert p.choose(own, 2, scheme).count() == 16
    path = str(tmp_path / "vector")
    made = sorted(tuple(r) for r in p.choose(own, 2, "file", path).collect())
    assert sorted(tuple(r) for r in p.choose(own, 2, "file", path).collect()) == made
    for bad in (lambda: p.choose(own, 2, "none"), lambda: p.choose(own, 2, "file"), lambda: p.by_ratio(own, 3, 0.01)):
        with pytest.raises(ValueError):
            bad()


def test_min_cut_beats_random(spark):
    two = [(a, b) for a in range(10) for b in range(a)] + [(a + 10, b + 10) for a in range(10) for b in range(a)] + [(0, 10)]
    mixed = [((7 * a) % 20, (7 * b) % 20) for a, b in two]
    own = graph(spark, mixed, 20)
    cut = lambda part: p.cut_and_balance(own, part).agg(F.sum("n_cut"), F.max("n_vertices")).first()
    best, other = cut(p.by_min_cut(own, 2, rounds=12, slack=0.5)), cut(p.by_random(own, 2))
    assert best[0] <= other[0] // 4 and best[1] <= 16


def test_offsets_over_ranges(spark):
    own = graph(spark, GRID, 18)
    at = 0
    for r in g.csr_offsets(own).orderBy("v").collect():
        assert r.row_offset == at
        at += r.degree
    wide = spark.range(500).select(F.xxhash64("id").alias("v"), F.lit(1).cast("long").alias("one"))  # ids far apart
    assert [r.place for r in g.running_sum(wide, "v", "one", "place").orderBy("v").collect()] == list(range(500))


def test_edge_difference(spark):
    a = spark.createDataFrame([(0, 1), (1, 2)], "src long, dst long")
    b = spark.createDataFrame([(0, 1), (2, 3)], "src long, dst long")
    assert {tuple(r) for r in g.edge_difference(a, b).collect()} == {(1, 2, "left"), (2, 3, "right")}


def test_scalar(spark):
    rows = spark.createDataFrame([(x,) for x in (0, 1, 2, 3, 31, 32, 33)], "x long")
    found = [tuple(r) for r in rows.select(scalar.power2_up(F.col("x")), scalar.power2_down(F.col("x")), scalar.align_up(F.col("x"), 32), scalar.align_down(F.col("x"), 32)).collect()]
    assert found == [(1, 0, 0, 0), (1, 1, 32, 0), (2, 2, 32, 0), (4, 2, 32, 0), (32, 16, 32, 0), (32, 32, 32, 32), (64, 32, 64, 32)]
    assert spark.range(1).select(scalar.least_missing(F.array(F.lit(0), F.lit(1), F.lit(3)))).first()[0] == 2
    assert spark.range(1).select(scalar.least_missing(F.array().cast("array<int>"))).first()[0] == 0
