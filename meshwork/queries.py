"""The engine's queries over graphs derived from the relational tables, and the same in SQL.

ps: parts (even ids) to suppliers (odd ids) of all line items. os: orders to suppliers. succession: from each event's
user to the next event's.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meshwork.functions import scalar
from meshwork.operators import graph as g
from meshwork.operators import partition as p
from meshwork.operators import validate
from meshwork.plans import bfs as b
from meshwork.plans import coloring as c
from meshwork.plans import pagerank as r
from meshwork.plans.loop import kept, shared_folder
from meshwork.plans.program import components_program
from meshwork.sources import files
from meshwork.streaming.reachability import IncrementalDepths

PARTS = 4


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ps(spark: SparkSession, sf_dir: str, symmetric: bool = False) -> g.Graph:
    raw = _read(spark, sf_dir, "lineitem").select((2 * F.col("l_partkey")).alias("src"), (2 * F.col("l_suppkey") + 1).alias("dst"))
    part = _read(spark, sf_dir, "part").select((2 * F.col("p_partkey")).cast("long").alias("v"))
    supplier = _read(spark, sf_dir, "supplier").select((2 * F.col("s_suppkey") + 1).cast("long").alias("v"))
    return g.Graph.of(g.clean_edges(raw, symmetric=symmetric), part.union(supplier))


def held(graph: g.Graph) -> g.DealtGraph:
    """Written once and dealt by source for the rounds of a loop."""
    return graph.dealt()


def succession(spark: SparkSession, sf_dir: str) -> g.Graph:
    """The order of events over all users is global; it is found within ranges of time, and the first event of each
    range follows the last of the range before."""
    events = _read(spark, sf_dir, "events").select("event_id", "ts", F.col("user_id").cast("long").alias("user_id")).where("ts IS NOT NULL")
    own = Window.partitionBy("day").orderBy("ts", "event_id")
    rows = events.withColumn("day", F.date_trunc("hour", "ts")).withColumn("next", F.lead("user_id").over(own))
    ends = events.withColumn("day", F.date_trunc("hour", "ts")).groupBy("day").agg(F.min_by("user_id", F.struct("ts", "event_id")).alias("first"), F.max_by("user_id", F.struct("ts", "event_id")).alias("last"))
    across = ends.select(F.col("last").alias("src"), F.lead("first").over(Window.orderBy("day")).alias("dst"))  # a row an hour
    edges = rows.select(F.col("user_id").alias("src"), F.col("next").alias("dst")).union(across).where("dst IS NOT NULL")
    return g.Graph.of(g.clean_edges(edges), events.select(F.col("user_id").alias("v")).distinct())


_PS = """e AS (SELECT DISTINCT 2 * l_partkey::BIGINT AS src, 2 * l_suppkey::BIGINT + 1 AS dst FROM lineitem),
vs AS (SELECT 2 * p_partkey::BIGINT AS v FROM part UNION ALL SELECT 2 * s_suppkey::BIGINT + 1 FROM supplier)"""
_SYM = """d AS (SELECT DISTINCT 2 * l_partkey::BIGINT AS src, 2 * l_suppkey::BIGINT + 1 AS dst FROM lineitem),
e AS (SELECT src, dst FROM d UNION ALL SELECT dst, src FROM d),
vs AS (SELECT 2 * p_partkey::BIGINT AS v FROM part UNION ALL SELECT 2 * s_suppkey::BIGINT + 1 FROM supplier)"""
_SUCCESSION = """x AS (SELECT user_id::BIGINT AS src, lead(user_id::BIGINT) OVER (ORDER BY ts, event_id) AS dst FROM events WHERE ts IS NOT NULL),
e AS (SELECT DISTINCT src, dst FROM x WHERE dst IS NOT NULL AND src <> dst),
vs AS (SELECT DISTINCT user_id::BIGINT AS v FROM events WHERE ts IS NOT NULL)"""
_DEG = "deg AS (SELECT v, count(src)::BIGINT AS degree FROM vs LEFT JOIN e ON e.src = vs.v GROUP BY v)"


def _bfs_sql(edges: str, sources: str, select: str, limit: int | None = None) -> str:
    stop = f" AND s.r < {limit}" if limit is not None else ""
    return f"""WITH RECURSIVE {edges}, s(r, v, depth) AS (
SELECT 0, v, CASE WHEN v IN ({sources}) THEN 0 END FROM vs
UNION ALL
SELECT s.r + 1, s.v, coalesce(s.depth, m.depth) FROM s LEFT JOIN
(SELECT e.dst AS v, min(t.depth) + 1 AS depth FROM s t JOIN e ON e.src = t.v WHERE t.depth = t.r GROUP BY e.dst) m ON m.v = s.v
WHERE EXISTS (SELECT 1 FROM s x WHERE x.depth = x.r){stop}),
depths AS (SELECT v, coalesce(depth, (SELECT count(*) + 1 FROM vs))::BIGINT AS depth FROM s WHERE r = (SELECT max(r) FROM s))
{select}"""


def _first(graph: g.Graph, n: int) -> list[int]:
    return [x["src"] for x in graph.edges.select("src").distinct().orderBy("src").limit(n).collect()]


_ONE, _THREE = "SELECT min(src) FROM e", "SELECT src FROM (SELECT DISTINCT src FROM e ORDER BY src LIMIT 3)"


def edges_clean_ps(spark, sf_dir):
    return ps(spark, sf_dir).edges


def edges_symmetric_ps(spark, sf_dir):
    return ps(spark, sf_dir, True).edges


def out_degree_ps(spark, sf_dir):
    return ps(spark, sf_dir).out_degree()


def degree_histogram_ps(spark, sf_dir):
    return g.degree_histogram(ps(spark, sf_dir))


def degree_buckets_ps(spark, sf_dir):
    return g.degree_buckets(ps(spark, sf_dir, True))


def max_degree_ps(spark, sf_dir):
    return g.max_degree(ps(spark, sf_dir, True))


def csr_offsets_ps(spark, sf_dir):
    return g.csr_offsets(ps(spark, sf_dir))


def adjacency_ps(spark, sf_dir):
    found = g.adjacency(ps(spark, sf_dir))
    return found.select("vertex", F.array_join(F.transform("neighbors", lambda x: x.cast("string")), ",").alias("neighbors"))


def edge_difference_os(spark, sf_dir):
    """Edges from orders to suppliers by ship date even or odd: in one of the two graphs only, and in which."""
    item = _read(spark, sf_dir, "lineitem")
    edges = item.select((2 * F.col("l_orderkey")).alias("src"), (2 * F.col("l_suppkey") + 1).alias("dst"), F.pmod(F.col("l_linenumber"), F.lit(2)).alias("odd"))
    side = lambda k: g.clean_edges(edges.where(F.col("odd") == k).select("src", "dst"))
    return g.edge_difference(side(0), side(1))


def succession_edges(spark, sf_dir):
    return succession(spark, sf_dir).edges


def bfs_ps(spark, sf_dir):
    graph = held(ps(spark, sf_dir, True))
    return b.bfs(graph, _first(graph, 1))[0]


def bfs_multi_source(spark, sf_dir):
    graph = held(ps(spark, sf_dir, True))
    return b.bfs(graph, _first(graph, 3))[0]


def bfs_max_depth(spark, sf_dir):
    graph = held(ps(spark, sf_dir, True))
    return b.bfs(graph, _first(graph, 1), max_depth=2)[0]


def bfs_level_counts(spark, sf_dir):
    graph = held(ps(spark, sf_dir, True))
    return b.level_counts(b.bfs(graph, _first(graph, 1))[0])


def bfs_priority_delta(spark, sf_dir):
    graph = held(ps(spark, sf_dir, True))
    return b.bfs_banded(graph, _first(graph, 1), threshold=3, delta=2)[0]


def bfs_succession(spark, sf_dir):
    graph = held(succession(spark, sf_dir))
    return b.bfs(graph, _first(graph, 1))[0]


def bfs_workload(spark, sf_dir):
    graph = held(ps(spark, sf_dir, True))
    return b.edge_workload(graph, b.bfs(graph, _first(graph, 1))[0], graph.n_vertices)


def _rounds(spark, record):
    return record.to_df(spark).select("round", "frontier")


def bfs_rounds(spark, sf_dir):
    """The vertices of each round's frontier; their sum is the workload."""
    graph = held(ps(spark, sf_dir, True))
    return _rounds(spark, b.bfs(graph, _first(graph, 1))[1])


def pagerank_rounds(spark, sf_dir):
    return _rounds(spark, r.pagerank(held(ps(spark, sf_dir, True)))[1])


def coloring_rounds(spark, sf_dir):
    return _rounds(spark, c.coloring(held(ps(spark, sf_dir, True)))[1])


def edges_column_first(spark, sf_dir):
    """Edges by destination, then source, with their places in that order: offsets of destinations and places within."""
    graph = ps(spark, sf_dir)
    into = g.csr_offsets(g.Graph(graph.vertices, graph.edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))))
    own = Window.partitionBy("dst").orderBy("src")
    ranked = graph.edges.withColumn("within", F.row_number().over(own) - 1)
    return ranked.join(into.select(F.col("v").alias("dst"), "row_offset"), "dst").select("src", "dst", (F.col("row_offset") + F.col("within")).alias("place"))


def bfs_in_neighbors(spark, sf_dir):
    """The in-neighbours of the largest vertex and their depths."""
    graph = held(ps(spark, sf_dir, True))
    top = graph.edges.agg(F.max("dst")).first()[0]
    return g.in_neighbors(graph, b.bfs(graph, _first(graph, 1))[0], top)


def bfs_nearest_20(spark, sf_dir):
    """The first 20 vertices by id with their depths."""
    graph = held(ps(spark, sf_dir, True))
    return b.bfs(graph, _first(graph, 1))[0].orderBy("v").limit(20)


def bfs_validity(spark, sf_dir):
    graph = held(ps(spark, sf_dir, True))
    sources = _first(graph, 1)
    return validate.bfs_violations(graph, kept(b.bfs(graph, sources)[0], "depths"), sources)


def _ranks(spark, sf_dir) -> tuple[g.Graph, DataFrame]:
    graph = held(ps(spark, sf_dir, True))
    return graph, r.pagerank(graph)[0]


def _six(*names: str):
    return [F.round(n, 6).alias(n) for n in names]


def pagerank_ps(spark, sf_dir):
    return _ranks(spark, sf_dir)[1].select("v", *_six("rank", "res"))


def pagerank_directed(spark, sf_dir):
    """With sinks: the directed graph from parts to suppliers."""
    return r.pagerank(held(ps(spark, sf_dir)))[0].select("v", *_six("rank", "res"))


def pagerank_normalized(spark, sf_dir):
    return r.normalized(_ranks(spark, sf_dir)[1]).select("v", F.round("rank", 9).alias("rank"))


def pagerank_stats(spark, sf_dir):
    return r.statistics(_ranks(spark, sf_dir)[1]).select("n_over", *[F.round(n, 3).alias(n) for n in ("sum_rank", "sum_res", "mass")], F.round("max_res", 6).alias("max_res"))


def pagerank_mass(spark, sf_dir):
    """Constant: the number of vertices, in a graph without sinks but for isolated vertices' lost share."""
    return r.statistics(_ranks(spark, sf_dir)[1]).select(F.round("mass", 3).alias("mass"))


def pagerank_residual_check(spark, sf_dir):
    graph, ranks = _ranks(spark, sf_dir)
    return validate.pagerank_violations(graph, ranks)


def _colors(spark, sf_dir) -> tuple[g.Graph, DataFrame]:
    graph = held(ps(spark, sf_dir, True))
    return graph, c.coloring(graph)[0]


def coloring_ps(spark, sf_dir):
    return _colors(spark, sf_dir)[1]


def coloring_counts(spark, sf_dir):
    return _colors(spark, sf_dir)[1].groupBy("color").agg(F.count(F.lit(1)).alias("n_vertices"))


def coloring_validity(spark, sf_dir):
    graph, colors = _colors(spark, sf_dir)
    return validate.coloring_violations(graph, colors)


def components_ps(spark, sf_dir):
    """A frontier program: connected components by the least vertex."""
    return components_program().run(held(ps(spark, sf_dir, True)))[0].select("v", "component")


def partition_vertices(spark, sf_dir):
    return p.by_vertices(ps(spark, sf_dir), PARTS)


def partition_ratio(spark, sf_dir):
    return p.by_ratio(ps(spark, sf_dir), PARTS, 0.3)


def partition_edges(spark, sf_dir):
    return p.by_edges(ps(spark, sf_dir), PARTS)


def partition_random(spark, sf_dir):
    return p.by_random(ps(spark, sf_dir), PARTS)


def partition_relabel(spark, sf_dir):
    return p.relabelled(p.by_random(ps(spark, sf_dir), PARTS), PARTS)


def partition_bounds(spark, sf_dir):
    return p.bounds(p.by_edges(ps(spark, sf_dir), PARTS))


def partition_vector(spark, sf_dir):
    """Parts from a table: here a part's or supplier's key modulo the number of parts."""
    graph = ps(spark, sf_dir)
    return p.by_vector(graph, graph.vertices.select("v", F.pmod(F.floor(F.col("v") / 2), F.lit(PARTS)).alias("part")))


def relabelled_edges(spark, sf_dir):
    graph = ps(spark, sf_dir)
    return g.relabel_edges(graph.edges, p.relabelled(p.by_random(graph, PARTS), PARTS))


def partition_lookup(spark, sf_dir):
    """The part of each new id, by ranges."""
    labels = kept(p.relabelled(p.by_random(ps(spark, sf_dir), PARTS), PARTS), "labels")
    scheme = [(x["part"], x["first"], x["end"]) for x in p.bounds(labels).collect()]
    return labels.select("v_new", p.part_of(F.col("v_new"), scheme).alias("part"))


def subgraph_edges(spark, sf_dir):
    graph = ps(spark, sf_dir)
    return p.subgraph(graph, p.by_edges(graph, PARTS), 1).edges


def edge_cut_balance(spark, sf_dir):
    graph = ps(spark, sf_dir)
    return p.cut_and_balance(graph, p.by_random(graph, PARTS))


def partition_messages(spark, sf_dir):
    graph = ps(spark, sf_dir, True)
    return p.messages(graph, p.by_random(graph, PARTS))


def partition_mincut(spark, sf_dir):
    graph = held(ps(spark, sf_dir, True))
    return p.by_min_cut(graph, PARTS)


def scalar_functions(spark, sf_dir):
    """Bit and alignment functions over the degrees."""
    d = F.col("degree")
    return ps(spark, sf_dir).out_degree().select(
        "v", scalar.power2_up(d).alias("up"), scalar.power2_down(d).alias("down"), scalar.align_up(d, 32).alias("aligned_up"), scalar.align_down(d, 32).alias("aligned_down"), F.bit_count(d).cast("int").alias("bits"), scalar.scrambled(F.col("v")).alias("scrambled")
    )


PATH_LENGTH = 5000


def path(spark) -> g.Graph:
    """A path of 5,000 vertices, both ways: the largest diameter."""
    edges = spark.range(PATH_LENGTH - 1).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    return g.Graph.of(g.clean_edges(edges, symmetric=True), spark.range(PATH_LENGTH).select(F.col("id").alias("v")))


def components_path(spark, sf_dir):
    """Pointer jumping over the path: rounds by the logarithm of its length."""
    return b.components(path(spark))[0]


def bfs_path(spark, sf_dir):
    """Blocks relaxed as a whole: as many rounds as blocks, not as vertices."""
    return b.bfs_blocks(path(spark), [0], block_edges=2000)[0]


def bfs_blocks_ps(spark, sf_dir):
    graph = held(ps(spark, sf_dir, True))
    return b.bfs_blocks(graph, _first(graph, 1), block_edges=1 << 18)[0]


def components_jumping_ps(spark, sf_dir):
    return b.components(held(ps(spark, sf_dir, True)))[0]


def pagerank_visits(spark, sf_dir):
    """How often each vertex was processed."""
    return r.pagerank(held(ps(spark, sf_dir, True)), visits=True)[0].select("v", "visits")


def pagerank_errors(spark, sf_dir):
    """Ranks of a coarse run against those of a fine one, over vertices and in all."""
    graph = held(ps(spark, sf_dir, True))
    coarse, fine = (r.pagerank(graph, epsilon=e)[0] for e in (0.05, 0.01))
    return r.rank_errors(coarse, fine).select("n_vertices", *[F.round(n, 3).alias(n) for n in ("l1",)], *[F.round(n, 6).alias(n) for n in ("mean", "max_abs", "max_rel")])


def _numbered(spark, sf_dir) -> g.Graph:
    """The part graph with ids 0..N-1 without gaps, as file formats need it."""
    graph = ps(spark, sf_dir)
    labels = kept(p.relabelled(p.by_vertices(graph, 1), 1), "labels")
    return g.Graph(labels.select(F.col("v_new").alias("v")), kept(g.relabel_edges(graph.edges, labels), "edges"))


def source_mtx(spark, sf_dir):
    """The part graph written as Matrix Market and read back as it stands."""
    at = f"{shared_folder(spark, 'mtx')}.mtx"
    files.write_mtx(_numbered(spark, sf_dir), at)
    return files.read_mtx_raw(spark, at)


def source_mtx_clean(spark, sf_dir):
    """Read back as a graph: from 0, both ways."""
    at = f"{shared_folder(spark, 'mtx')}.mtx"
    files.write_mtx(_numbered(spark, sf_dir), at)
    return files.read_mtx(spark, at, symmetric=True, check=True).edges


def source_csr(spark, sf_dir):
    """From Matrix Market to binary compressed rows by the job, checked, and read back."""
    at = shared_folder(spark, "csr")
    files.write_mtx(_numbered(spark, sf_dir), f"{at}.mtx")
    if files.mtx_to_csr(spark, f"{at}.mtx", f"{at}.csr", valid=True):
        raise ValueError("edges differ")
    return files.read_csr(spark, f"{at}.csr").edges


def source_csr_text(spark, sf_dir):
    """Offsets and columns as text: how many lines each has, and their sums."""
    at = shared_folder(spark, "csr-text")
    files.write_csr_text(_numbered(spark, sf_dir), at)
    told = lambda part: spark.read.text(f"{at}.{part}").agg(F.lit(part).alias("part"), F.count(F.lit(1)).alias("n"), F.sum(F.col("value").cast("long")).alias("total"))
    return told("rows").union(told("cols"))


def _vector(spark, sf_dir, binary: bool):
    graph, at = _numbered(spark, sf_dir), shared_folder(spark, "vector")
    files.write_vector(p.by_edges(graph, PARTS), at, binary)
    return files.read_vector(spark, at, graph.n_vertices, binary)


def source_vector_binary(spark, sf_dir):
    return _vector(spark, sf_dir, True)


def source_vector_text(spark, sf_dir):
    return _vector(spark, sf_dir, False)


def sink_strided(spark, sf_dir):
    """Every seventh vertex and its degree."""
    return files.strided(_numbered(spark, sf_dir).out_degree(), "v", 7)


def sink_ranks(spark, sf_dir):
    """Ranks written as text and read back."""
    at = shared_folder(spark, "ranks")
    files.write_ranks(_ranks(spark, sf_dir)[1], at)
    cells = F.split("value", " ")
    return spark.read.text(at).select(cells[0].cast("long").alias("v"), F.round(cells[1].cast("double"), 6).alias("rank"))


def edges_rebased(spark, sf_dir):
    """Ids that begin at 1 in the source."""
    raw = _read(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst"))
    return g.clean_edges(raw, base=1)


def graph_summary_ps(spark, sf_dir):
    return ps(spark, sf_dir, True).summary()


def stream_depths(spark, sf_dir):
    """Depths after the part graph has arrived in three batches of a stream, from the least part."""
    at = shared_folder(spark, "stream")
    edges = ps(spark, sf_dir, True).edges
    for k in range(3):
        edges.where(F.pmod(F.col("src") + F.col("dst"), F.lit(3)) == k).write.parquet(f"{at}/in/{k}")
    depths = IncrementalDepths(spark, [edges.agg(F.min("src")).first()[0]], f"{at}/state")
    rows = spark.readStream.schema("src long, dst long").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1000).parquet(f"{at}/in")
    rows.writeStream.foreachBatch(depths.update).option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return depths.depths


def run_log_times(spark, sf_dir):
    """Mean times in log lines, the slowest rank of each run: lines made from orders, one rank a clerk."""
    orders = _read(spark, sf_dir, "orders")
    value = F.concat(F.lit("ave time: "), (F.pmod(F.col("o_orderkey"), F.lit(997)) + 0.5).cast("string"), F.lit(" ms"))
    lines = orders.select(F.col("o_orderstatus").alias("graph"), F.pmod(F.col("o_custkey"), F.lit(4)).cast("int").alias("n_gpus"), value.alias("value"))
    from meshwork.sources.files import run_log

    return run_log(lines)


QUERIES = {f.__name__: f for f in (
    edges_clean_ps, edges_symmetric_ps, out_degree_ps, degree_histogram_ps, degree_buckets_ps, max_degree_ps, csr_offsets_ps, adjacency_ps, edge_difference_os, edges_column_first, succession_edges,
    bfs_ps, bfs_multi_source, bfs_max_depth, bfs_level_counts, bfs_priority_delta, bfs_succession, bfs_workload, bfs_rounds, bfs_in_neighbors, bfs_nearest_20, bfs_validity,
    pagerank_ps, pagerank_directed, pagerank_normalized, pagerank_stats, pagerank_mass, pagerank_residual_check, pagerank_rounds, coloring_rounds, coloring_ps, coloring_counts, coloring_validity, components_ps,
    partition_vertices, partition_ratio, partition_edges, partition_random, partition_relabel, partition_bounds, partition_vector, relabelled_edges, partition_lookup, subgraph_edges, edge_cut_balance, partition_messages, partition_mincut,
    scalar_functions, run_log_times, components_path, bfs_path, bfs_blocks_ps, components_jumping_ps, pagerank_visits, pagerank_errors,
    source_mtx, source_mtx_clean, source_csr, source_csr_text, source_vector_binary, source_vector_text, sink_strided, sink_ranks, edges_rebased, graph_summary_ps, stream_depths,
)}

_DEPTHS = "SELECT v, depth FROM depths"


def _rank_sql(edges: str, select: str, damping: float = 0.85, epsilon: float = 0.01, name: str = "") -> str:
    s, on = f"s{name}", f"(t.r = 0 OR t.res >= {epsilon})"
    head = f"WITH RECURSIVE {edges}, {_DEG}, " if not name else ""
    return f"""{head}{s}(r, v, rank, res, visits) AS (
SELECT 0, vs.v, 1.0::DOUBLE - {damping}, coalesce(i.res, 0.0)::DOUBLE, 0::BIGINT FROM vs LEFT JOIN
(SELECT e.dst AS v, sum((1.0::DOUBLE - {damping}) * {damping} / deg.degree) AS res FROM e JOIN deg ON deg.v = e.src GROUP BY e.dst) i ON i.v = vs.v
UNION ALL
SELECT t.r + 1, t.v, t.rank + CASE WHEN {on} THEN t.res ELSE 0 END, CASE WHEN {on} THEN 0 ELSE t.res END + coalesce(m.told, 0), t.visits + CASE WHEN {on} THEN 1 ELSE 0 END
FROM {s} t LEFT JOIN (SELECT e.dst AS v, sum({damping}::DOUBLE * t.res / deg.degree) AS told FROM {s} t JOIN e ON e.src = t.v JOIN deg ON deg.v = t.v WHERE {on} AND t.res > 0 GROUP BY e.dst) m ON m.v = t.v
WHERE EXISTS (SELECT 1 FROM {s} t WHERE {on})),
ranks{name} AS (SELECT v, rank, res, visits FROM {s} WHERE r = (SELECT max(r) FROM {s}))
{select}"""


_COLOR = f"""WITH RECURSIVE {_SYM}, s(r, v, color, open) AS (
SELECT 0, v, NULL::INT, true FROM vs
UNION ALL (
WITH near AS (SELECT t.v, list(DISTINCT n.color) AS taken FROM s t JOIN e ON e.src = t.v JOIN s n ON n.v = e.dst WHERE t.open AND NOT n.open GROUP BY t.v),
tried AS (SELECT t.r, t.v, t.open, CASE WHEN t.open THEN (SELECT min(k) FROM range(0, coalesce(len(near.taken), 0) + 1) x(k) WHERE NOT list_contains(coalesce(near.taken, []), k))::INT ELSE t.color END AS color FROM s t LEFT JOIN near USING (v)),
beaten AS (SELECT DISTINCT a.v FROM tried a JOIN e ON e.src = a.v JOIN tried b ON b.v = e.dst WHERE a.open AND b.open AND a.color = b.color AND ({scalar.scrambled_sql('b.v')}, b.v) < ({scalar.scrambled_sql('a.v')}, a.v))
SELECT tried.r + 1, tried.v, CASE WHEN beaten.v IS NULL THEN tried.color END, beaten.v IS NOT NULL AND tried.open FROM tried LEFT JOIN beaten USING (v)
WHERE EXISTS (SELECT 1 FROM s x WHERE x.open))),
colors AS (SELECT v, color FROM s WHERE r = (SELECT max(r) FROM s))
"""
_PLACE = "place AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS place FROM vs), n AS (SELECT ceil(count(*) / 4.0)::BIGINT AS size, count(*) AS n FROM vs)"
_HASH = f"hashed AS (SELECT v, row_number() OVER (ORDER BY {scalar.scrambled_sql('v', 12321)}, v) - 1 AS place FROM vs), parts AS (SELECT v, least(place // (SELECT ceil(count(*) / 4.0)::BIGINT FROM vs), 3)::INT AS part FROM hashed)"
_NEW = "labels AS (SELECT v, part, (row_number() OVER (ORDER BY part, v) - 1)::BIGINT AS v_new FROM parts)"
_BY_EDGES = f"{_DEG}, o AS (SELECT v, degree, sum(degree) OVER (ORDER BY v) - degree AS row_offset FROM deg), parts AS (SELECT v, least((row_offset * 2 + degree) // (2 * (SELECT ceil(count(*) / 4.0) FROM e)::BIGINT), 3)::INT AS part FROM o)"

_NUMBERED = "i AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS n FROM vs), f AS (SELECT a.n AS src, b.n AS dst FROM e JOIN i a ON a.v = e.src JOIN i b ON b.v = e.dst)"

ORACLES = {
    "edges_clean_ps": f"WITH {_PS} SELECT src, dst FROM e",
    "edges_symmetric_ps": f"WITH {_SYM} SELECT src, dst FROM e",
    "out_degree_ps": f"WITH {_PS}, {_DEG} SELECT v, degree FROM deg",
    "degree_histogram_ps": f"WITH {_PS}, {_DEG} SELECT degree, count(*) AS n_vertices FROM deg GROUP BY degree",
    "degree_buckets_ps": f"WITH {_SYM}, {_DEG} SELECT CASE WHEN degree < 32 THEN 'small' WHEN degree < 1024 THEN 'medium' ELSE 'large' END AS bucket, count(*) AS n_vertices, sum(degree)::BIGINT AS n_edges FROM deg GROUP BY 1",
    "max_degree_ps": f"WITH {_SYM}, {_DEG} SELECT max(degree) AS max_degree FROM deg",
    "csr_offsets_ps": f"WITH {_PS}, {_DEG} SELECT v, degree, (sum(degree) OVER (ORDER BY v) - degree)::BIGINT AS row_offset FROM deg",
    "adjacency_ps": f"WITH {_PS} SELECT v AS vertex, coalesce(string_agg(dst::VARCHAR, ',' ORDER BY dst), '') AS neighbors FROM vs LEFT JOIN e ON e.src = vs.v GROUP BY v",
    "edge_difference_os": "SELECT 2 * l_orderkey::BIGINT AS src, 2 * l_suppkey::BIGINT + 1 AS dst, CASE WHEN min(l_linenumber % 2) = 0 THEN 'left' ELSE 'right' END AS side FROM lineitem GROUP BY 1, 2 HAVING count(DISTINCT l_linenumber % 2) = 1",
    "succession_edges": f"WITH {_SUCCESSION} SELECT src, dst FROM e",
    "bfs_ps": _bfs_sql(_SYM, _ONE, _DEPTHS),
    "bfs_multi_source": _bfs_sql(_SYM, _THREE, _DEPTHS),
    "bfs_max_depth": _bfs_sql(_SYM, _ONE, _DEPTHS, 2),
    "bfs_level_counts": _bfs_sql(_SYM, _ONE, "SELECT depth, count(*) AS n_vertices FROM depths GROUP BY depth"),
    "bfs_priority_delta": _bfs_sql(_SYM, _ONE, _DEPTHS),
    "bfs_succession": _bfs_sql(_SUCCESSION, _ONE, _DEPTHS),
    "bfs_workload": _bfs_sql(_SYM, _ONE, f", {_DEG} SELECT count(*) AS n_vertices, sum(degree)::BIGINT AS n_edges FROM depths JOIN deg USING (v) WHERE depth <= (SELECT count(*) FROM vs)"),
    "bfs_in_neighbors": _bfs_sql(_SYM, _ONE, "SELECT d.v, d.depth FROM e JOIN depths d ON d.v = e.src WHERE e.dst = (SELECT max(dst) FROM e)"),
    "bfs_nearest_20": _bfs_sql(_SYM, _ONE, "SELECT v, depth FROM depths ORDER BY v LIMIT 20"),
    "bfs_rounds": _bfs_sql(_SYM, _ONE, "SELECT r AS round, count(*) AS frontier FROM s WHERE depth = r GROUP BY r"),
    "edges_column_first": f"WITH {_PS} SELECT src, dst, row_number() OVER (ORDER BY dst, src) - 1 AS place FROM e",
    "bfs_validity": "SELECT 0::BIGINT AS n_sources, 0::BIGINT AS n_edges, 0::BIGINT AS n_orphans",
    "pagerank_ps": _rank_sql(_SYM, "SELECT v, round(rank, 6) AS rank, round(res, 6) AS res FROM ranks"),
    "pagerank_directed": _rank_sql(_PS, "SELECT v, round(rank, 6) AS rank, round(res, 6) AS res FROM ranks"),
    "pagerank_normalized": _rank_sql(_SYM, "SELECT v, round(rank / (SELECT sum(rank) FROM ranks), 9) AS rank FROM ranks"),
    "pagerank_stats": _rank_sql(_SYM, "SELECT count(*) FILTER (WHERE res >= 0.01) AS n_over, round(sum(rank), 3) AS sum_rank, round(sum(res), 3) AS sum_res, round(sum(rank) + sum(res) / 0.15, 3) AS mass, round(max(res), 6) AS max_res FROM ranks"),
    "pagerank_mass": _rank_sql(_SYM, "SELECT round(sum(rank) + sum(res) / 0.15, 3) AS mass FROM ranks"),
    "pagerank_residual_check": "SELECT 0::BIGINT AS n_over, 0::BIGINT AS n_low, 0::BIGINT AS n_off",
    "pagerank_rounds": _rank_sql(_SYM, "SELECT r AS round, count(*) FILTER (WHERE r = 0 OR res >= 0.01) AS frontier FROM s GROUP BY r HAVING count(*) FILTER (WHERE r = 0 OR res >= 0.01) > 0"),
    "coloring_rounds": _COLOR + "SELECT r AS round, count(*) FILTER (WHERE open) AS frontier FROM s GROUP BY r HAVING count(*) FILTER (WHERE open) > 0",
    "coloring_ps": _COLOR + "SELECT v, color FROM colors",
    "coloring_counts": _COLOR + "SELECT color, count(*) AS n_vertices FROM colors GROUP BY color",
    "coloring_validity": "SELECT 0::BIGINT AS n_conflicts, 0::BIGINT AS n_uncolored, 0::BIGINT AS n_high",
    "components_ps": f"""WITH RECURSIVE {_SYM}, s(r, v, component, open) AS (
SELECT 0, v, v, true FROM vs
UNION ALL
SELECT t.r + 1, t.v, least(t.component, coalesce(m.c, t.component)), coalesce(m.c < t.component, false) FROM s t LEFT JOIN
(SELECT e.dst AS v, min(x.component) AS c FROM s x JOIN e ON e.src = x.v WHERE x.open GROUP BY e.dst) m ON m.v = t.v
WHERE EXISTS (SELECT 1 FROM s y WHERE y.open))
SELECT v, component FROM s WHERE r = (SELECT max(r) FROM s)""",
    "partition_vertices": f"WITH {_PS}, {_PLACE} SELECT v, least(place // n.size, 3)::INT AS part FROM place, n",
    "partition_ratio": f"WITH {_PS}, {_PLACE} SELECT v, least(place // floor(0.3 * n.n)::BIGINT, 3)::INT AS part FROM place, n",
    "partition_edges": f"WITH {_PS}, {_BY_EDGES} SELECT v, part FROM parts",
    "partition_random": f"WITH {_PS}, {_HASH} SELECT v, part FROM parts",
    "partition_relabel": f"WITH {_PS}, {_HASH}, {_NEW} SELECT v, part, v_new FROM labels",
    "partition_bounds": f"WITH {_PS}, {_BY_EDGES}, z AS (SELECT part, count(*) AS n FROM parts GROUP BY part) SELECT part, (sum(n) OVER (ORDER BY part) - n)::BIGINT AS first, (sum(n) OVER (ORDER BY part))::BIGINT AS \"end\" FROM z",
    "partition_vector": f"WITH {_PS} SELECT v, ((v // 2) % 4)::INT AS part FROM vs",
    "relabelled_edges": f"WITH {_PS}, {_HASH}, {_NEW} SELECT a.v_new AS src, b.v_new AS dst FROM e JOIN labels a ON a.v = e.src JOIN labels b ON b.v = e.dst",
    "partition_lookup": f"WITH {_PS}, {_HASH}, {_NEW} SELECT v_new, part FROM labels",
    "subgraph_edges": f"WITH {_PS}, {_BY_EDGES} SELECT src, dst FROM e JOIN parts ON parts.v = e.src WHERE part = 1",
    "edge_cut_balance": f"WITH {_PS}, {_HASH}, x AS (SELECT a.part, count(*) AS n_edges, count(*) FILTER (WHERE a.part <> b.part) AS n_cut FROM e JOIN parts a ON a.v = e.src JOIN parts b ON b.v = e.dst GROUP BY a.part) SELECT part, count(*) AS n_vertices, coalesce(max(n_edges), 0) AS n_edges, coalesce(max(n_cut), 0) AS n_cut FROM parts LEFT JOIN x USING (part) GROUP BY part",
    "partition_messages": f"WITH {_SYM}, {_HASH} SELECT a.part, b.part AS peer, count(*) AS n_edges FROM e JOIN parts a ON a.v = e.src JOIN parts b ON b.v = e.dst WHERE a.part <> b.part GROUP BY a.part, b.part",
    "scalar_functions": f"WITH {_PS}, {_DEG} SELECT v, CASE WHEN degree <= 1 THEN 1 ELSE (1::BIGINT << length(ltrim(bin(degree - 1), '0'))) END::BIGINT AS up, CASE WHEN degree < 1 THEN 0 ELSE (1::BIGINT << (length(ltrim(bin(degree), '0')) - 1)) END::BIGINT AS down, ((degree + 31) // 32 * 32)::BIGINT AS aligned_up, (degree // 32 * 32)::BIGINT AS aligned_down, bit_count(degree)::INT AS bits, {scalar.scrambled_sql('v')}::BIGINT AS scrambled FROM deg",
    "components_path": "SELECT range AS v, 0::BIGINT AS component FROM range(5000)",
    "bfs_path": "SELECT range AS v, range AS depth FROM range(5000)",
    "bfs_blocks_ps": _bfs_sql(_SYM, _ONE, _DEPTHS),
    "stream_depths": _bfs_sql(_SYM, _ONE, _DEPTHS + " WHERE depth <= (SELECT count(*) FROM vs)"),
    "pagerank_visits": _rank_sql(_SYM, "SELECT v, visits FROM ranks"),
    "pagerank_errors": _rank_sql(_SYM, ", " + _rank_sql("", "", epsilon=0.05, name="2") + " SELECT count(*) AS n_vertices, round(sum(abs(a.rank - b.rank)), 3) AS l1, round(avg(abs(a.rank - b.rank)), 6) AS mean, round(max(abs(a.rank - b.rank)), 6) AS max_abs, round(max(abs(a.rank - b.rank) / abs(b.rank)), 6) AS max_rel FROM ranks2 a JOIN ranks b USING (v)"),
    "source_mtx": f"WITH {_PS}, {_NUMBERED} SELECT src + 1 AS src, dst + 1 AS dst FROM f",
    "source_mtx_clean": f"WITH {_PS}, {_NUMBERED} SELECT src, dst FROM f UNION ALL SELECT dst, src FROM f",
    "source_csr": f"WITH {_PS}, {_NUMBERED} SELECT src, dst FROM f",
    "source_csr_text": f"WITH {_PS}, {_NUMBERED}, w AS (SELECT i.n AS v, (SELECT count(*) FROM f WHERE f.src = i.n) AS degree FROM i) SELECT 'rows' AS part, count(*) + 1 AS n, (sum(o) + (SELECT count(*) FROM f))::BIGINT AS total FROM (SELECT sum(degree) OVER (ORDER BY v) - degree AS o FROM w) UNION ALL SELECT 'cols', count(*), sum(dst)::BIGINT FROM f",
    "source_vector_binary": f"WITH {_PS}, {_NUMBERED}, {_BY_EDGES} SELECT i.n AS v, part FROM parts JOIN i USING (v)",
    "source_vector_text": f"WITH {_PS}, {_NUMBERED}, {_BY_EDGES} SELECT i.n AS v, part FROM parts JOIN i USING (v)",
    "sink_strided": f"WITH {_PS}, {_NUMBERED}, {_DEG} SELECT i.n AS v, degree FROM deg JOIN i USING (v) WHERE i.n % 7 = 0",
    "sink_ranks": _rank_sql(_SYM, "SELECT v, round(rank, 6) AS rank FROM ranks"),
    "edges_rebased": "SELECT DISTINCT l_partkey::BIGINT - 1 AS src, l_suppkey::BIGINT - 1 AS dst FROM lineitem WHERE l_partkey <> l_suppkey",
    "graph_summary_ps": f"WITH {_SYM}, {_DEG} SELECT count(*) AS n_vertices, sum(degree)::BIGINT AS n_edges, max(degree) AS max_degree, count(*) FILTER (WHERE degree = 0) AS n_sinks FROM deg",
    "run_log_times": "SELECT o_orderstatus AS graph, (o_custkey % 4)::INT AS n_gpus, max(o_orderkey % 997 + 0.5)::DOUBLE AS ms FROM orders GROUP BY 1, 2",
}
ORACLES["components_jumping_ps"] = ORACLES["components_ps"]
