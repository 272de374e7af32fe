"""Graphs as two DataFrames, and transforms of them."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meshwork.plans.loop import Dealt, buckets_for, dealt, kept

#: Out-edges beyond which a vertex's edges are dealt to several buckets.
HUB_EDGES = 1 << 20


@dataclass(frozen=True)
class Graph:
    """vertices(v long), edges(src long, dst long). Isolated vertices are in vertices only."""

    vertices: DataFrame
    edges: DataFrame

    @classmethod
    def of(cls, edges: DataFrame, vertices: DataFrame | None = None) -> Graph:
        if vertices is None:
            vertices = edges.select(F.col("src").alias("v")).union(edges.select(F.col("dst").alias("v"))).distinct()
        return cls(vertices.select(F.col("v").cast("long").alias("v")), edges.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst")))

    def dealt(self, hub_edges: int = HUB_EDGES) -> DealtGraph:
        """Written once with edges dealt by source, for the rounds of a loop; see DealtGraph."""
        return DealtGraph.write(self, hub_edges)

    def along(self, rows: DataFrame) -> DataFrame:
        """rows(v, ...), v unique, to (src, dst, ...): a row for each out-edge of each v."""
        return self.edges.join(rows.withColumnRenamed("v", "src"), "src")

    @property
    def buckets(self) -> int | None:
        return None

    def release(self) -> None:
        """Removes what was written for this graph."""

    @cached_property
    def n_vertices(self) -> int:
        return self.vertices.count()

    def warm_up(self) -> int:
        """A full scan of edges and vertices before a run is timed; returns a sum over them."""
        found = self.edges.agg(F.sum(F.xxhash64("src", "dst") % 1024).alias("a")).join(F.broadcast(self.vertices.agg(F.sum(F.xxhash64("v") % 1024).alias("b")))).first()  # a row each
        return (found["a"] or 0) + (found["b"] or 0)

    def summary(self) -> DataFrame:
        """One row: n_vertices, n_edges, max_degree, n_sinks (vertices without out-edges)."""
        return self.out_degree().agg(F.count(F.lit(1)).alias("n_vertices"), F.sum("degree").alias("n_edges"), F.max("degree").alias("max_degree"), F.count_if(F.col("degree") == 0).alias("n_sinks"))

    def out_degree(self) -> DataFrame:
        """v, degree of every vertex."""
        found = self.edges.groupBy(F.col("src").alias("v")).agg(F.count(F.lit(1)).alias("degree"))
        return self.vertices.join(found, "v", "left").select("v", F.coalesce("degree", F.lit(0)).cast("long").alias("degree"))

    def symmetric(self) -> Graph:
        return Graph(self.vertices, symmetrized(self.edges))


@dataclass(frozen=True)
class DealtGraph(Graph):
    """A graph in the shared folder whose edges are dealt by source to buckets: along() never shuffles edges.

    The out-edges of a vertex with more than hub_edges of them are dealt by (source, salt) to as many salts as keep
    each below it, and what such a vertex sends is repeated for its salts; hubs(v, salts) has at most
    edges / hub_edges rows.
    """

    table: Dealt | None = None
    own: Dealt | None = None
    hubs: DataFrame | None = None

    @classmethod
    def write(cls, graph: Graph, hub_edges: int = HUB_EDGES) -> DealtGraph:
        spark = graph.edges.sparkSession
        edges = kept(graph.edges, "edges")
        degree = edges.groupBy("src").agg(F.count(F.lit(1)).alias("n"))
        total, top = degree.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
        buckets, hubs, keys = buckets_for(spark, total), None, ["src"]
        if top > hub_edges:
            hubs = kept(degree.where(F.col("n") > hub_edges).select(F.col("src").alias("v"), F.ceil(F.col("n") / hub_edges).cast("int").alias("salts")), "hubs")
            salts = hubs.withColumnRenamed("v", "src")
            edges = edges.join(F.broadcast(salts), "src", "left")  # at most total / hub_edges rows
            edges = edges.select("src", F.coalesce(F.pmod(F.xxhash64("dst"), F.col("salts").cast("long")), F.lit(0)).cast("int").alias("salt"), "dst")
            keys = ["src", "salt"]
        table = dealt(edges, keys, "edges", buckets)
        own = dealt(graph.vertices, ["v"], "vertices", buckets)
        return cls(own.df, table.df.select("src", "dst"), table, own, hubs)

    @property
    def buckets(self) -> int | None:
        return self.table.buckets

    def along(self, rows: DataFrame) -> DataFrame:
        if self.hubs is None:
            return self.edges.join(rows.withColumnRenamed("v", "src"), "src")
        sent = rows.join(F.broadcast(self.hubs), "v", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1)))
        return self.table.df.join(sent.drop("salts").withColumnRenamed("v", "src"), ["src", "salt"]).drop("salt")

    def release(self) -> None:
        self.table.drop()
        self.own.drop()


def clean_edges(raw: DataFrame, base: int = 0, symmetric: bool = False) -> DataFrame:
    """Ids from 0, without self-loops and parallel edges; with reverse edges if symmetric. Rows with nulls go."""
    edges = raw.select((F.col("src") - base).cast("long").alias("src"), (F.col("dst") - base).cast("long").alias("dst")).where("src <> dst")
    return symmetrized(edges) if symmetric else edges.distinct()


def symmetrized(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst")))).alias("e")).select("e.src", "e.dst").distinct()


def adjacency(graph: Graph) -> DataFrame:
    """vertex, neighbors (ascending array) of every vertex. An array is one value, so a hub's must fit in one row; use
    edges where that can't be."""
    lists = graph.edges.groupBy(F.col("src").alias("v")).agg(F.array_sort(F.collect_list("dst")).alias("neighbors"))
    return graph.vertices.join(lists, "v", "left").select(F.col("v").alias("vertex"), F.coalesce("neighbors", F.array().cast("array<bigint>")).alias("neighbors"))


def running_sum(rows: DataFrame, order: str, value: str, name: str) -> DataFrame:
    """rows with the sum of value over all rows of smaller order (exclusive). order is unique and not null.

    Rows are dealt by ranges of order, which Spark samples, so any ids make even parts; a part's total is one row, and
    only those are summed in one task. The ranged rows are written once, since both passes must see the same parts.
    """
    ranged = kept(rows.repartitionByRange(F.col(order)).withColumn("_part", F.spark_partition_id()), "ranges")
    totals = ranged.groupBy("_part").agg(F.sum(value).alias("_total"))
    before = totals.select("_part", (F.sum("_total").over(Window.orderBy("_part")) - F.col("_total")).alias("_before"))
    own = Window.partitionBy("_part").orderBy(order)
    return ranged.join(F.broadcast(before), "_part").withColumn(name, (F.col("_before") + F.sum(value).over(own) - F.col(value)).cast("long")).drop("_part", "_before")


def csr_offsets(graph: Graph) -> DataFrame:
    """v, degree, row_offset: how many edges the vertices before have."""
    return running_sum(graph.out_degree(), "v", "degree", "row_offset")


def degree_histogram(graph: Graph) -> DataFrame:
    return graph.out_degree().groupBy("degree").agg(F.count(F.lit(1)).alias("n_vertices"))


def degree_buckets(graph: Graph, small: int = 32, large: int = 1024) -> DataFrame:
    """How many vertices and edges fall to degrees below small, below large, and beyond."""
    bucket = F.when(F.col("degree") < small, "small").when(F.col("degree") < large, "medium").otherwise("large")
    return graph.out_degree().groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n_vertices"), F.sum("degree").alias("n_edges"))


def max_degree(graph: Graph) -> DataFrame:
    return graph.out_degree().agg(F.max("degree").alias("max_degree"))


def relabel_edges(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """edges with both ends mapped by labels(v, v_new)."""
    new = lambda end: labels.select(F.col("v").alias(end), F.col("v_new").alias(f"{end}_new"))
    return edges.join(new("src"), "src").join(new("dst"), "dst").select(F.col("src_new").alias("src"), F.col("dst_new").alias("dst"))


def in_neighbors(graph: Graph, values: DataFrame, v: int) -> DataFrame:
    """The vertices with an edge to v and their rows of values(v, ...)."""
    return graph.edges.where(F.col("dst") == v).select(F.col("src").alias("v")).join(values, "v")


def edge_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Edges in one of two edge sets only: src, dst, side ('left' or 'right'). Empty if the graphs are equal."""
    both = a.select("src", "dst", F.lit(1).alias("x")).union(b.select("src", "dst", F.lit(2).alias("x")))
    found = both.groupBy("src", "dst").agg(F.bit_or("x").alias("x")).where("x < 3")
    return found.select("src", "dst", F.when(F.col("x") == 1, "left").otherwise("right").alias("side"))
