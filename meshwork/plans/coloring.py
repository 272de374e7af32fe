"""Greedy colouring by rounds of speculation."""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshwork.functions.scalar import least_missing, scrambled
from meshwork.operators.graph import Graph
from meshwork.plans.loop import Round, Rounds, Trail, buckets_for, dealt


def _precedence(v: Column, kind: str, seed: int) -> Column:
    """Of two neighbours with one colour, the one with the smaller value keeps it."""
    if kind not in ("hash", "id"):
        raise ValueError("precedence is 'hash' or 'id'")
    return F.struct((scrambled(v, seed) if kind == "hash" else v).alias("p"), v.alias("v"))


def coloring(graph: Graph, precedence: str = "hash", seed: int = 0) -> tuple[DataFrame, Rounds]:
    """(v, color) of every vertex of a symmetric graph, and the rounds.

    In a round every vertex of the frontier takes the least colour that no settled neighbour has; of neighbours that
    took the same, the one of lower precedence stays in the frontier. What is settled is appended to the written
    trail and never changes. Hashed precedence (seeded) needs few rounds; by ids a long path would need one for each
    vertex. A vertex sends twice: what it tries, to the frontier that gives way to it, and what it settles on. Edges
    lose those that no longer join two vertices of the frontier whenever it has halved.
    """
    spark = graph.edges.sparkSession
    trail, record = Trail(spark, "coloring"), Rounds()
    buckets = graph.buckets or buckets_for(spark, 0)
    now, n_now = graph, graph.n_vertices
    yields = _precedence(F.col("src"), precedence, seed) < _precedence(F.col("dst"), precedence, seed)  # dst gives way
    empty = F.array().cast("array<int>")
    open_ = dealt(graph.vertices.select("v", empty.alias("taken")), ["v"], "coloring", buckets)
    n, k = n_now, 0
    while n:
        began = time.perf_counter()
        tried = open_.df.select("v", "taken", least_missing(F.col("taken")).alias("color"))
        told = now.along(tried.select("v", "color")).where(yields).select(F.col("dst").alias("v"), "color").distinct().groupBy("v").agg(F.collect_list("color").alias("told"))
        judged = dealt(tried.join(told, "v", "left").select("v", "taken", "color", F.coalesce(F.array_contains("told", F.col("color")), F.lit(False)).alias("lost")), ["v"], "coloring", buckets)
        settled = trail.append(judged.df.where("NOT lost").select("v", "color"))
        heard = now.along(settled).select(F.col("dst").alias("v"), "color").distinct().groupBy("v").agg(F.collect_list("color").alias("heard"))
        after = dealt(judged.df.where("lost").join(heard, "v", "left").select("v", F.array_union("taken", F.coalesce("heard", empty)).alias("taken")), ["v"], "coloring", buckets)
        for old in (open_, judged):
            old.drop()
        record.rounds.append(Round(k, n, (time.perf_counter() - began) * 1000))
        open_, k = after, k + 1
        n = open_.told["n"]
        if n and 2 * n <= n_now:
            left = open_.df.select("v")
            inner = now.edges.join(left.withColumnRenamed("v", "src"), "src", "left_semi").join(left.withColumnRenamed("v", "dst"), "dst", "left_semi")
            smaller = Graph(left, inner.select("src", "dst")).dealt()
            if now is not graph:
                now.release()
            now, n_now = smaller, n
    if now is not graph:
        now.release()
    open_.drop()
    if not trail.slices:
        return graph.vertices.select("v", F.lit(0).alias("color")), record
    return trail.all(), record
