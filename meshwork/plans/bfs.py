"""Breadth-first search: a level a round, bands of levels with a threshold, or blocks relaxed as a whole."""

from __future__ import annotations

import time
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshwork.operators.graph import DealtGraph, Graph
from meshwork.plans.loop import Round, Rounds, Trail, buckets_for, dealt, iterate, kept


def _seed(graph: Graph, sources: Sequence[int]) -> DataFrame:
    """The sources that are vertices, once each."""
    given = graph.edges.sparkSession.createDataFrame([(int(s),) for s in dict.fromkeys(sources)], "v long")
    return graph.vertices.join(F.broadcast(given), "v", "left_semi")


def bfs(graph: Graph, sources: Sequence[int], max_depth: int | None = None) -> tuple[DataFrame, Rounds]:
    """(v, depth) of every vertex, and the rounds. Unreached vertices, and those beyond max_depth, get N + 1.

    Each round sends the frontier along its edges and keeps what no earlier round has reached. What is reached is a
    table dealt by vertex and the written slices of later rounds; slices are folded into the table when they hold as
    much as it does, so all rounds together rewrite a vertex a logarithmic number of times.
    """
    spark = graph.edges.sparkSession
    buckets = graph.buckets or buckets_for(spark, 0)
    trail, record, depth = Trail(spark, "bfs"), Rounds(), 0
    base, first, n_base, n_slices = None, 0, 0, 0
    frontier = trail.append(_seed(graph, sources).select("v", F.lit(0).alias("depth")))
    while True:
        began, n = time.perf_counter(), trail.n
        if not n:
            break
        record.rounds.append(Round(depth, n, 0.0))
        if max_depth is not None and depth >= max_depth:
            break
        depth, n_slices = depth + 1, n_slices + n
        if n_slices > max(n_base, 100_000) or len(trail.slices) - first > 64:
            old = base
            seen = trail.all(first).select("v")
            base = dealt(seen if old is None else old.df.union(seen), ["v"], "bfs-reached", buckets)
            n_base, n_slices, first = n_base + n_slices, 0, len(trail.slices)
            if old is not None:
                old.drop()
        reached = graph.along(frontier.select("v")).select(F.col("dst").alias("v")).distinct()
        if base is not None:
            reached = reached.join(base.df, "v", "left_anti")
        if first < len(trail.slices):
            reached = reached.join(trail.all(first).select("v"), "v", "left_anti")
        frontier = trail.append(reached.select("v", F.lit(depth).alias("depth")))
        record.rounds[-1].elapsed_ms = (time.perf_counter() - began) * 1000
    if base is not None:
        base.drop()
    far = graph.n_vertices + 1
    return graph.vertices.join(trail.all(), "v", "left").select("v", F.coalesce("depth", F.lit(far)).cast("long").alias("depth")), record


def bfs_banded(graph: Graph, sources: Sequence[int], threshold: int = 3, delta: int = 1, share: float | None = None) -> tuple[DataFrame, Rounds]:
    """Depths by near and far bands: vertices below the threshold relax their neighbours until none is left, then the
    threshold rises by delta. With a share, it also rises when fewer than that share of all open vertices are near.
    Depths are those of bfs(); the rounds differ."""
    if delta < 1:
        raise ValueError("delta must be positive, or the threshold never rises")
    if share is not None and not 0 < share <= 1:
        raise ValueError("share is above 0 and at most 1")
    spark = graph.edges.sparkSession
    buckets = graph.buckets or buckets_for(spark, 0)
    far = graph.n_vertices + 1
    seed = _seed(graph, sources).select("v", F.lit(0).cast("long").alias("depth"))
    state = dealt(graph.vertices.join(seed, "v", "left").select("v", "depth", F.col("depth").isNotNull().alias("open")), ["v"], "bfs-banded", buckets)
    record = Rounds()
    while True:
        began = time.perf_counter()
        open_ = {r["depth"]: r["n"] for r in state.df.where("open").groupBy("depth").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a level that is open
        if not open_:
            break
        near_of = lambda t: sum(n for d, n in open_.items() if d < t)
        while not near_of(threshold) or (share is not None and near_of(threshold) < share * sum(open_.values())):
            threshold += delta
        near = F.col("open") & (F.col("depth") < threshold)
        told = graph.along(state.df.where(near).select("v", "depth")).groupBy(F.col("dst").alias("v")).agg((F.min("depth") + 1).alias("told"))
        better = F.col("told").isNotNull() & (F.col("depth").isNull() | (F.col("told") < F.col("depth")))
        after = state.df.join(told, "v", "left").select("v", F.when(better, F.col("told")).otherwise(F.col("depth")).alias("depth"), (better | (F.col("open") & ~near)).alias("open"))
        old, state = state, dealt(after, ["v"], "bfs-banded", buckets)
        old.drop()
        record.rounds.append(Round(len(record.rounds), near_of(threshold), (time.perf_counter() - began) * 1000))
    return state.df.select("v", F.coalesce("depth", F.lit(far)).cast("long").alias("depth")), record


def _relax(src: np.ndarray, dst: np.ndarray, v: np.ndarray, depth: np.ndarray, known: np.ndarray):
    """Within a block: depths of its vertices as they were (known) and as told; returns improved (v, depth) and those
    told to ends outside."""
    own = np.unique(np.concatenate([src, v]))
    n, far = len(own), np.iinfo(np.int64).max
    before, best = np.full(n, far), np.full(n, far)
    at = np.searchsorted(own, v)
    np.minimum.at(before, at[known], depth[known])
    np.minimum.at(best, at, depth)
    order = np.argsort(src, kind="stable")
    src, dst = np.searchsorted(own, src[order]), dst[order]
    inside = np.searchsorted(own, dst).clip(0, max(0, n - 1))
    here = own[inside] == dst if n else np.zeros(0, bool)
    head = np.searchsorted(src, np.arange(n + 1))
    front = np.flatnonzero(best < before)
    while len(front):
        size = head[front + 1] - head[front]
        edge = np.repeat(head[front] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
        told = np.repeat(best[front] + 1, size)
        edge, told = edge[here[edge]], told[here[edge]]
        to, old = inside[edge], best[inside[edge]]
        np.minimum.at(best, to, told)
        front = np.unique(to[best[to] < old])
    improved = np.flatnonzero(best < before)
    edge = np.flatnonzero(np.isin(src, improved) & ~here)
    return own[improved], best[improved], dst[edge], best[src[edge]] + 1


def bfs_blocks(graph: Graph, sources: Sequence[int], block_edges: int = 1 << 21) -> tuple[DataFrame, Rounds]:
    """Depths as of bfs(), for graphs of a large diameter whose ids keep neighbours near, such as roads and meshes.

    Vertices fall into contiguous ranges of about block_edges out-edges. A round relaxes the blocks that were told of
    smaller depths, each as a whole in one task, until nothing inside improves; then only ends outside are told. So
    there are about as many rounds as a shortest path changes blocks, not as it has edges. A block holds whole
    vertices: one with more edges than block_edges makes a larger one (bfs() splits such hubs).
    """
    from meshwork.operators.partition import by_edges

    spark = graph.edges.sparkSession
    n_edges = graph.edges.count()
    parts = max(1, -(-n_edges // block_edges))
    place = kept(by_edges(graph, parts).withColumnRenamed("part", "block"), "blocks")
    buckets = buckets_for(spark, n_edges)
    edges = dealt(graph.edges.join(place.withColumnRenamed("v", "src"), "src").select("block", "src", "dst"), ["block"], "block-edges", buckets)
    trail, record = Trail(spark, "bfs-blocks"), Rounds()
    kind = "block int, v long, depth long, inside boolean"

    def relax(left: pa.Table, right: pa.Table) -> pa.Table:
        a, z = (left.column(c).to_numpy() for c in ("src", "dst"))
        v, depth, known = (right.column(c).to_numpy() for c in ("v", "depth", "known"))
        own, best, out, told = _relax(a, z, v, depth, known.astype(bool))
        block = right.column("block")[0].as_py()
        return pa.table({"block": pa.array([block] * (len(own) + len(out)), pa.int32()), "v": np.concatenate([own, out]), "depth": np.concatenate([best, told]), "inside": pa.array([True] * len(own) + [False] * len(out), pa.bool_())})

    news = kept(_seed(graph, sources).join(place, "v").select("block", "v", F.lit(0).cast("long").alias("depth")), "block-news")
    while True:
        began = time.perf_counter()
        active = [r["block"] for r in news.select("block").distinct().collect()]  # numbers of blocks
        if not active:
            break
        n = news.count()
        told = news.withColumn("known", F.lit(False))
        if trail.slices:
            told = told.union(trail.all().where(F.col("inside") & F.col("block").isin(active)).select("block", "v", "depth", F.lit(True)))
        found = edges.df.where(F.col("block").isin(active)).groupBy("block").cogroup(told.groupBy("block")).applyInArrow(relax, kind)
        out = trail.append(found)
        sent = out.where(~F.col("inside")).groupBy("v").agg(F.min("depth").alias("depth"))
        news = kept(sent.join(place, "v").select("block", "v", "depth"), "block-news")
        record.rounds.append(Round(len(record.rounds), n, (time.perf_counter() - began) * 1000))
    edges.drop()
    far = graph.n_vertices + 1
    if not trail.slices:
        return graph.vertices.select("v", F.lit(far).cast("long").alias("depth")), record
    best = trail.all().where("inside").groupBy("v").agg(F.min("depth").alias("depth"))
    return graph.vertices.join(best, "v", "left").select("v", F.coalesce("depth", F.lit(far)).cast("long").alias("depth")), record


def components(graph: Graph) -> tuple[DataFrame, Rounds]:
    """(v, component) of a symmetric graph: the least vertex that is reached; rounds grow with the diameter's logarithm.

    Each vertex points to one of its component that is not larger. A round tells every vertex's grandparent along its
    edges, hooks a vertex and its parent to the least that is told, and jumps pointers.
    """
    own = graph if isinstance(graph, DealtGraph) else graph.dealt()

    def step(state: DataFrame, _: int) -> DataFrame:
        up = state.select("v", F.col("up").alias("grand"))
        known = state.join(up.withColumnRenamed("v", "up"), "up").select("v", "up", "grand")
        told = own.along(known.select("v", "grand")).groupBy(F.col("dst").alias("v")).agg(F.min("grand").alias("told"))
        near = known.join(told, "v", "left").select("v", "up", "grand", F.least("grand", F.coalesce("told", "grand")).alias("least"))
        near = kept(near, "hooks")
        hooks = near.select("v", "least").union(near.select(F.col("up").alias("v"), "least")).groupBy("v").agg(F.min("least").alias("least"))
        return near.select("v", "up").join(hooks, "v").select("v", F.least("up", "least").alias("up"), (F.col("least") < F.col("up")).alias("active"))

    start = own.vertices.select("v", F.col("v").alias("up"), F.lit(True).alias("active"))
    state, record = iterate(start, step, lambda _: F.col("active"), "components", buckets=own.buckets)
    return state.select("v", F.col("up").alias("component")), record


def level_counts(depths: DataFrame) -> DataFrame:
    return depths.groupBy("depth").agg(F.count(F.lit(1)).alias("n_vertices"))


def edge_workload(graph: Graph, depths: DataFrame, n_vertices: int) -> DataFrame:
    """One row: vertices reached and the edges that leave them."""
    return depths.where(F.col("depth") <= n_vertices).join(graph.out_degree(), "v").agg(F.count(F.lit(1)).alias("n_vertices"), F.sum("degree").alias("n_edges"))
