"""PageRank by pushing residuals until all are below epsilon."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshwork.operators.graph import Graph
from meshwork.plans.loop import Rounds, iterate


def pagerank(graph: Graph, damping: float = 0.85, epsilon: float = 0.01, visits: bool = False) -> tuple[DataFrame, Rounds]:
    """(v, rank, res) of every vertex, and the rounds. Ranks are not normalised: each vertex starts at 1 - damping.

    Every vertex is processed once, then those with res >= epsilon: rank grows by res, each out-neighbour's res by
    damping * res / degree, and the own res becomes what arrived. Vertices without out-edges keep what they get.
    visits: a column more, how often each vertex was processed.
    """
    degree = graph.out_degree().where("degree > 0").select(F.col("v").alias("src"), "degree")
    rank0 = 1.0 - damping
    sent = graph.along(degree.withColumnRenamed("src", "v")).groupBy(F.col("dst").alias("v")).agg(F.sum(F.lit(rank0 * damping) / F.col("degree")).alias("res"))
    start = graph.vertices.join(sent, "v", "left").join(degree.withColumnRenamed("src", "v"), "v", "left")
    start = start.select("v", F.lit(rank0).alias("rank"), F.coalesce("res", F.lit(0.0)).alias("res"), "degree", F.lit(0).cast("long").alias("visits"))

    def active(k: int):
        return F.lit(True) if k == 0 else F.col("res") >= epsilon

    def step(state: DataFrame, k: int) -> DataFrame:
        push = state.where(active(k) & (F.col("res") > 0) & F.col("degree").isNotNull())
        push = push.select("v", (F.lit(damping) * F.col("res") / F.col("degree")).alias("share"))
        told = graph.along(push).groupBy(F.col("dst").alias("v")).agg(F.sum("share").alias("told"))
        return state.join(told, "v", "left").select(
            "v", (F.col("rank") + F.when(active(k), F.col("res")).otherwise(0.0)).alias("rank"), (F.when(active(k), 0.0).otherwise(F.col("res")) + F.coalesce("told", F.lit(0.0))).alias("res"), "degree", (F.col("visits") + F.when(active(k), 1).otherwise(0)).alias("visits")
        )

    state, record = iterate(start, step, active, "pagerank", buckets=graph.buckets)
    return state.select("v", "rank", "res", *(["visits"] if visits else [])), record


def normalized(ranks: DataFrame) -> DataFrame:
    """v, rank with ranks that sum to one."""
    total = ranks.agg(F.sum("rank").alias("total"))  # one row
    return ranks.join(F.broadcast(total)).select("v", (F.col("rank") / F.col("total")).alias("rank"))


def rank_errors(ranks: DataFrame, reference: DataFrame) -> DataFrame:
    """One row: how ranks(v, rank) differ from a reference vector: n_vertices, l1, mean, max_abs, max_rel and the vertex
    of the largest difference (the smallest such). Vertices that one of them lacks count as rank 0 there."""
    both = ranks.select("v", F.col("rank").alias("a")).join(reference.select("v", F.col("rank").alias("b")), "v", "full")
    both = both.select("v", F.coalesce("a", F.lit(0.0)).alias("a"), F.coalesce("b", F.lit(0.0)).alias("b")).withColumn("d", F.abs(F.col("a") - F.col("b")))
    relative = F.when(F.col("b") != 0, F.col("d") / F.abs("b"))
    found = both.agg(F.count(F.lit(1)).alias("n_vertices"), F.sum("d").alias("l1"), F.avg("d").alias("mean"), F.max("d").alias("max_abs"), F.max(relative).alias("max_rel"), F.max(F.struct("d", (-F.col("v")).alias("w"))).alias("worst"))
    return found.select("n_vertices", "l1", "mean", "max_abs", "max_rel", (-F.col("worst.w")).alias("worst"))


def statistics(ranks: DataFrame, damping: float = 0.85, epsilon: float = 0.01) -> DataFrame:
    """One row: vertices over epsilon, sums of ranks and residuals, the largest residual and the total mass."""
    found = ranks.agg(F.count_if(F.col("res") >= epsilon).alias("n_over"), F.sum("rank").alias("sum_rank"), F.sum("res").alias("sum_res"), F.max("res").alias("max_res"))
    return found.withColumn("mass", F.col("sum_rank") + F.col("sum_res") / (1 - damping))
