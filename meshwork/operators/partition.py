"""Vertex partitions and relabelling, as (v, part) and (v, part, v_new) tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meshwork.functions.scalar import scrambled
from meshwork.operators.graph import Graph, running_sum


def by_vertices(graph: Graph, parts: int) -> DataFrame:
    """Contiguous ranges of equally many vertices, in the order of their ids."""
    size = max(1, -(-graph.n_vertices // parts))
    ranked = running_sum(graph.vertices.withColumn("one", F.lit(1).cast("long")), "v", "one", "place")
    return ranked.select("v", F.least(F.floor(F.col("place") / size), F.lit(parts - 1)).cast("int").alias("part"))


def by_ratio(graph: Graph, parts: int, ratio: float) -> DataFrame:
    """Contiguous ranges: each part but the last gets floor(ratio * N) vertices, of which there must be one."""
    if (size := int(ratio * graph.n_vertices)) < 1:
        raise ValueError("ratio gives a part less than one vertex")
    ranked = running_sum(graph.vertices.withColumn("one", F.lit(1).cast("long")), "v", "one", "place")
    return ranked.select("v", F.least(F.floor(F.col("place") / size), F.lit(parts - 1)).cast("int").alias("part"))


def by_edges(graph: Graph, parts: int) -> DataFrame:
    """Contiguous ranges of about equally many out-edges: a vertex's part is that of the middle of its edges' range."""
    offsets = running_sum(graph.out_degree(), "v", "degree", "row_offset")
    size = max(1, -(-graph.edges.count() // parts))
    middle = F.floor((F.col("row_offset") * 2 + F.col("degree")) / (2 * size))
    return offsets.select("v", F.least(middle, F.lit(parts - 1)).cast("int").alias("part"))


def by_random(graph: Graph, parts: int, seed: int = 12321) -> DataFrame:
    """The vertices in the order of a seeded hash, cut evenly; the same for any number of tasks."""
    key = scrambled(F.col("v"), seed)
    rows = graph.vertices.withColumn("one", F.lit(1).cast("long")).withColumn("key", F.struct(key.alias("h"), "v"))
    ranked = running_sum(rows, "key", "one", "place")
    size = max(1, -(-graph.n_vertices // parts))
    return ranked.select("v", F.least(F.floor(F.col("place") / size), F.lit(parts - 1)).cast("int").alias("part"))


def by_vector(graph: Graph, vector: DataFrame) -> DataFrame:
    """Parts from a table (v, part), such as a partition vector that was read; vertices it lacks go to part 0."""
    return graph.vertices.join(vector.select("v", F.col("part").cast("int").alias("part")), "v", "left").select("v", F.coalesce("part", F.lit(0)).alias("part"))


def by_min_cut(graph: Graph, parts: int, rounds: int = 8, slack: float = 0.1) -> DataFrame:
    """Few edges between parts: label propagation from contiguous ranges, with room for slack more than an even share.

    Each round a vertex wants the part where most of its neighbours are. Of those that would move to a part, as many
    go as it has room, those with the most to gain first; even and odd hashes move in turn, so neighbours don't swap
    for ever. Deterministic.
    """
    from meshwork.plans.loop import kept

    edges = graph.symmetric().edges
    now = kept(by_vertices(graph, parts), "min-cut")
    room = int(graph.n_vertices / parts * (1 + slack)) + 1
    for k in range(rounds):
        votes = edges.join(now.select(F.col("v").alias("dst"), "part"), "dst").groupBy(F.col("src").alias("v"), "part").agg(F.count(F.lit(1)).alias("n"))
        best = votes.groupBy("v").agg(F.max(F.struct("n", (-F.col("part")).alias("p"))).alias("best"))
        own = votes.withColumnRenamed("part", "own").withColumnRenamed("n", "n_own")
        moves = now.join(best, "v").withColumn("wanted", (-F.col("best.p")).cast("int")).where("wanted <> part")
        moves = moves.where(F.pmod(F.xxhash64("v"), F.lit(2)) == k % 2)
        moves = moves.join(own, (moves["v"] == own["v"]) & (moves["part"] == own["own"]), "left").select(moves["v"], "part", "wanted", (F.col("best.n") - F.coalesce("n_own", F.lit(0))).alias("gain")).where("gain > 0")
        sizes = now.groupBy("part").agg(F.count(F.lit(1)).alias("size"))
        # room is shared out by thresholds of the gain: a histogram of gains for each part, not a sort of all moves
        hist = moves.groupBy("wanted", "gain").agg(F.count(F.lit(1)).alias("n"))
        hist = hist.withColumn("through", F.sum("n").over(Window.partitionBy("wanted").orderBy(F.desc("gain"))))
        cut = hist.join(sizes.withColumnRenamed("part", "wanted"), "wanted", "left").where(F.col("through") <= room - F.coalesce("size", F.lit(0))).groupBy("wanted").agg(F.min("gain").alias("least"))
        moved = moves.join(F.broadcast(cut), "wanted").where("gain >= least").select("v", "wanted")  # cut: a row a part
        now = kept(now.join(moved, "v", "left").select("v", F.coalesce("wanted", "part").alias("part")), "min-cut")
    return now


def choose(graph: Graph, parts: int, scheme: str = "vertices", path: str | None = None, ratio: float = 0.5, seed: int = 12321) -> DataFrame:
    """(v, part) by the named scheme: vertices, edges, random, ratio, min_cut or file.

    file reads the binary partition vector at path; where there is none, min_cut is computed and written there.
    """
    if scheme == "file":
        from meshwork.sources.files import exists, read_vector, write_vector

        spark = graph.edges.sparkSession
        if path is None:
            raise ValueError("the scheme 'file' needs a path")
        if not exists(spark, path):
            found = by_min_cut(graph, parts)
            write_vector(found, path)
            return found
        return by_vector(graph, read_vector(spark, path, graph.n_vertices))
    made = {"vertices": lambda: by_vertices(graph, parts), "edges": lambda: by_edges(graph, parts), "random": lambda: by_random(graph, parts, seed), "ratio": lambda: by_ratio(graph, parts, ratio), "min_cut": lambda: by_min_cut(graph, parts)}
    if scheme not in made:
        raise ValueError(f"scheme is one of {', '.join(made)}, file")
    return made[scheme]()


def relabelled(partition: DataFrame, parts: int) -> DataFrame:
    """v, part, v_new: new ids are contiguous within parts, in the order of the old ids."""
    key = F.struct("part", "v")
    rows = partition.withColumn("one", F.lit(1).cast("long")).withColumn("key", key)
    return running_sum(rows, "key", "one", "v_new").select("v", "part", "v_new")


def bounds(partition: DataFrame) -> DataFrame:
    """part, first, end: the ranges of new ids of each part that has vertices."""
    sizes = partition.groupBy("part").agg(F.count(F.lit(1)).alias("n"))  # a row a part
    end = F.sum("n").over(Window.orderBy("part"))
    return sizes.select("part", (end - F.col("n")).alias("first"), end.alias("end"))


def part_of(v_new: Column, scheme: list[tuple[int, int, int]]) -> Column:
    """The part of a new id by the collected bounds (part, first, end)."""
    found = F.lit(None).cast("int")
    for part, first, end in scheme:
        found = F.when((v_new >= first) & (v_new < end), F.lit(part)).otherwise(found)
    return found


def subgraph(graph: Graph, partition: DataFrame, part: int) -> Graph:
    """The part's vertices with all their out-edges."""
    own = partition.where(F.col("part") == part).select("v")
    return Graph(own, graph.edges.join(own.withColumnRenamed("v", "src"), "src", "left_semi"))


def cut_and_balance(graph: Graph, partition: DataFrame) -> DataFrame:
    """part, n_vertices, n_edges (out-edges), n_cut (those that leave the part)."""
    a, b = partition.select(F.col("v").alias("src"), F.col("part").alias("a")), partition.select(F.col("v").alias("dst"), F.col("part").alias("b"))
    edges = graph.edges.join(a, "src").join(b, "dst").groupBy(F.col("a").alias("part")).agg(F.count(F.lit(1)).alias("n_edges"), F.count_if(F.col("a") != F.col("b")).alias("n_cut"))
    sizes = partition.groupBy("part").agg(F.count(F.lit(1)).alias("n_vertices"))
    return sizes.join(edges, "part", "left").select("part", "n_vertices", F.coalesce("n_edges", F.lit(0)).cast("long").alias("n_edges"), F.coalesce("n_cut", F.lit(0)).cast("long").alias("n_cut"))


def messages(graph: Graph, partition: DataFrame) -> DataFrame:
    """part, peer, n_edges: edges from each part to each other part, what one full exchange would send."""
    a, b = partition.select(F.col("v").alias("src"), F.col("part")), partition.select(F.col("v").alias("dst"), F.col("part").alias("peer"))
    return graph.edges.join(a, "src").join(b, "dst").where("part <> peer").groupBy("part", "peer").agg(F.count(F.lit(1)).alias("n_edges"))
