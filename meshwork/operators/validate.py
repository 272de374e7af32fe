"""Checks of results; each gives one row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshwork.operators.graph import Graph


def bfs_violations(graph: Graph, depths: DataFrame, sources: Sequence[int]) -> DataFrame:
    """n_sources: sources not at depth 0. n_edges: edges that could shorten a depth. n_orphans: reached vertices
    without a neighbour one level before. All zero exactly for right depths."""
    far = graph.n_vertices + 1
    a, b = depths.select(F.col("v").alias("src"), F.col("depth").alias("a")), depths.select(F.col("v").alias("dst"), F.col("depth").alias("b"))
    both = graph.edges.join(a, "src").join(b, "dst")
    bad = both.where((F.col("a") < far) & (F.col("b") > F.col("a") + 1)).agg(F.count(F.lit(1)).alias("n_edges"))
    led = both.where(F.col("b") == F.col("a") + 1).select(F.col("dst").alias("v")).distinct()
    seed = [int(s) for s in sources]
    orphans = depths.where((F.col("depth") < far) & ~F.col("v").isin(seed)).join(led, "v", "left_anti").agg(F.count(F.lit(1)).alias("n_orphans"))
    starts = depths.where(F.col("v").isin(seed) & (F.col("depth") != 0)).agg(F.count(F.lit(1)).alias("n_sources"))
    return starts.join(F.broadcast(bad)).join(F.broadcast(orphans))  # one row each


def pagerank_violations(graph: Graph, ranks: DataFrame, damping: float = 0.85, epsilon: float = 0.01) -> DataFrame:
    """n_over: residuals of epsilon and more. n_low: ranks below 1 - damping. n_off: vertices whose residual isn't
    what their in-neighbours' ranks say, by more than 1e-6."""
    degree = graph.out_degree().where("degree > 0")
    pushed = graph.edges.join(ranks.join(degree, "v").select(F.col("v").alias("src"), (F.col("rank") * damping / F.col("degree")).alias("x")), "src").groupBy(F.col("dst").alias("v")).agg(F.sum("x").alias("x"))
    off = F.abs((1 - damping) + F.coalesce("x", F.lit(0.0)) - F.col("rank") - F.col("res")) > 1e-6
    return ranks.join(pushed, "v", "left").agg(F.count_if(F.col("res") >= epsilon).alias("n_over"), F.count_if(F.col("rank") < 1 - damping - 1e-9).alias("n_low"), F.count_if(off).alias("n_off"))


def coloring_violations(graph: Graph, colors: DataFrame) -> DataFrame:
    """n_conflicts: edges whose ends share a colour. n_uncolored: vertices without one. n_high: colours beyond the
    largest degree."""
    a, b = colors.select(F.col("v").alias("src"), F.col("color").alias("a")), colors.select(F.col("v").alias("dst"), F.col("color").alias("b"))
    same = graph.edges.join(a, "src").join(b, "dst").where("a = b").agg(F.count(F.lit(1)).alias("n_conflicts"))
    none = graph.vertices.join(colors, "v", "left").agg(F.count_if(F.col("color").isNull()).alias("n_uncolored"))
    top = graph.out_degree().agg(F.max("degree").alias("top"))
    high = colors.join(F.broadcast(top)).agg(F.count_if(F.col("color") > F.col("top")).alias("n_high"))
    return same.join(F.broadcast(none)).join(F.broadcast(high))  # one row each
