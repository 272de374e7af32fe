"""Approximate nearest neighbours by cosine in a hash-prefix forest.

A tree is the sorted array of the vectors' hash strings: signs of random projections, one string of 32 signs for each
tree. A query descends in every tree to the place of its own string, where the longest common prefixes are, and then
ascends in all trees at once: prefixes get shorter step by step, and with each step the vectors that share the
shorter prefix become candidates, until there are enough. Ranges of equal prefixes are taken whole, so copies are
never cut apart. Candidates are ranked by their exact cosines.

The array of a routing tree is global: it is cut into ranges of about equally many rows, and each range is a shard
with a forest of its own. A query visits the ranges whose strings share the longest prefixes with its own. How many
ranges it visits, and how many candidates it gathers in each, are fitted: the least that find the nearest of a bounded
sample of rows, whatever the size of the table. Of equal vectors only as many are stored as a query can ever return.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meshwork.llm.common import map_batches, materialize

BITS = 32
#: Rows and queries of the sample to which visits and candidates are fitted: those with the smallest hashes of their ids.
SAMPLE_ROWS, SAMPLE_QUERIES = 8192, 64
#: What the fit chooses from: candidates over all trees' ranges, and ranges visited, as shares of rows and of ranges.
SHARES = (0.0, 0.01, 0.02, 0.05, 0.1, 0.2, 0.35, 0.5, 0.75, 1.0, 1.5, 2.0, 3.0)
VISITS = (0.01, 0.02, 0.05, 0.1, 0.2, 0.35, 0.5, 0.65, 0.8, 0.9, 0.95, 1.0)
#: Lengths of vectors at most in one table; each has forests of its own.
MAX_WIDTHS = 64


def _signs(vectors: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """Hash strings as numbers of BITS bits, the first sign highest."""
    return np.ascontiguousarray(np.packbits(vectors @ planes > 0, axis=1)).view(">u4").ravel().astype(np.int64)


def _planes(trees: int, width: int, seed: int = 1) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(seed)).standard_normal((trees, width, BITS))


def scaled(vectors: np.ndarray) -> np.ndarray:
    """Rows times powers of two that bring their largest component near one: exact, and cosines stay as they are where
    nothing under- or overflows."""
    _, power = np.frexp(np.abs(vectors).max(1, keepdims=True, initial=0))
    return np.ldexp(vectors, -power)


class Forest:
    """ids: int64, ascending or not; vectors: float64 rows, neither zero nor with non-finite components."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, trees: int, seed: int = 1):
        self.ids, self.vectors, self.trees = ids, vectors, trees
        self.norms = np.sqrt((vectors * vectors).sum(1))
        self.planes = _planes(trees, vectors.shape[1], seed)
        self.orders, self.keys = [], []
        for t in range(trees):
            keys = _signs(vectors, self.planes[t])
            order = np.argsort(keys, kind="stable").astype(np.int32)
            self.orders.append(order)
            self.keys.append(keys[order])

    def ranges(self, queries: np.ndarray, candidates: int) -> tuple[np.ndarray, np.ndarray]:
        """For each query and tree, the range of the sorted array at the level where the ascent ends.

        The level is the longest prefix at which all trees' ranges together hold `candidates`, if any does.
        """
        n, q = len(self.ids), len(queries)
        keys = [_signs(queries, self.planes[t]) for t in range(self.trees)]
        low, high = np.zeros((q, self.trees), np.int64), np.zeros((q, self.trees), np.int64)
        open_ = np.arange(q)
        for length in range(BITS, -1, -1):
            shift = BITS - length
            for t in range(self.trees):
                prefix = keys[t][open_] >> shift << shift
                low[open_, t] = np.searchsorted(self.keys[t], prefix, "left")
                high[open_, t] = np.searchsorted(self.keys[t], prefix + (1 << shift), "left")
            open_ = open_[(high[open_] - low[open_]).sum(1) < min(candidates, n * self.trees)]
            if not len(open_):
                break
        return low, high

    def search(self, queries: np.ndarray, own: np.ndarray, k: int, candidates: int):
        """For each query, (ids, cosines) of the k nearest candidates other than the rows with the query's own id."""
        low, high = self.ranges(queries, candidates)
        for i, q in enumerate(queries):
            seen = np.zeros(len(self.ids), bool)
            for t in range(self.trees):
                seen[self.orders[t][low[i, t] : high[i, t]]] = True
            at = np.flatnonzero(seen)
            at = at[self.ids[at] != own[i]]
            if len(at) > k:  # a coarse pass first; the exact measure decides among all that are near the k-th
                rough = (self.vectors[at] @ q) / self.norms[at]
                at = at[rough >= np.partition(rough, -k)[-k] - 1e-9 * np.sqrt(q @ q)]
            scores = cosines(self.vectors[at], q)
            order = np.lexsort((self.ids[at], -scores))[:k]
            yield self.ids[at][order], scores[order]


def cosines(vectors: np.ndarray, q: np.ndarray) -> np.ndarray:
    """In double precision, alike for equal rows wherever they stand."""
    return (vectors * q).sum(1) / (np.sqrt((vectors * vectors).sum(1)) * np.sqrt((q * q).sum()))


def _usable(rows: DataFrame) -> DataFrame:
    """Rows whose vectors can be compared."""
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return rows.where(F.col("id").isNotNull() & F.col("v").isNotNull() & finite & F.exists("v", lambda x: x != 0))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """The vectors of a column, as rows."""
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, width)


@dataclass(frozen=True)
class Fit:
    """share: candidates that a shard's trees gather, over all their ranges, as a share of its rows. visits: share of
    the ranges that a query visits. recall, scored: on the sample, by share; told for reports."""

    share: float
    visits: float
    recall: float
    scored: float


def fit(ids: np.ndarray, vectors: np.ndarray, k: int, trees: int, target: float, ranges: int) -> Fit:
    """The least share and visits by which each finds `target` of the sample's nearest, found by brute force."""
    own = Forest(ids, vectors, trees)
    asked = np.arange(min(SAMPLE_QUERIES, len(ids)))
    exact = []
    for i in asked:
        scores = cosines(vectors, vectors[i])
        order = np.lexsort((ids, -scores))
        exact.append(set(ids[order[ids[order] != ids[i]][:k]].tolist()))
    total = max(1, sum(map(len, exact)))
    share, recall, scored = SHARES[-1], 1.0, 1.0
    for share in SHARES:
        n = _wanted(share, len(ids), k, trees)
        low, high = own.ranges(vectors[asked], n)
        scored = np.mean([len(np.unique(np.concatenate([own.orders[t][low[i, t] : high[i, t]] for t in range(trees)]))) for i in range(len(asked))]) / len(ids)
        hits = sum(len(exact[i] & set(found.tolist())) for i, (found, _) in enumerate(own.search(vectors[asked], ids[asked], k, n)))
        recall = hits / total
        if recall >= target:
            break
    visits = 1.0
    if ranges > 1:  # the sample, cut as the table is, or in as many parts as it can fill
        parts = min(ranges, max(2, len(ids) // 32))
        keys = _signs(vectors, _planes(1, vectors.shape[1], ROUTE)[0])
        edges = np.sort(keys)[np.arange(1, parts) * len(ids) // parts]
        place = dict(zip(ids.tolist(), np.searchsorted(edges, keys, "right").tolist(), strict=True))
        order = np.stack([_nearest_ranges(q, edges) for q in keys[asked]])
        rank = np.argsort(order, axis=1)
        for visits in VISITS:
            n = max(1, int(np.ceil(visits * parts)))
            if sum(rank[i, place[x]] < n for i, found in enumerate(exact) for x in found) / total >= target:
                break
    return Fit(share, visits, float(recall), float(scored))


#: Seed of the routing tree's planes.
ROUTE = 7


def _wanted(share: float, n: int, k: int, trees: int) -> int:
    """Candidates over all trees' ranges: 2 k a tree, for copies of the query's row are in every tree, and the share."""
    return 2 * k * trees + int(np.ceil(share * n))


def _nearest_ranges(key: int, edges: np.ndarray) -> np.ndarray:
    """Ranges between the ascending edges, those first whose strings share the longest prefix with the key."""
    low, high = np.concatenate([[0], edges]), np.concatenate([edges, [(1 << BITS) - 1]])
    # the string of a range nearest to the key is the key itself, or one of its ends
    inside = (low <= key) & (key <= high)
    differ = np.where(inside, 0, np.minimum(low ^ key, high ^ key))
    return np.lexsort((np.arange(len(low)), np.frexp(differ.astype(np.float64))[1]))


def nearest(rows: DataFrame, queries: DataFrame, k: int = 5, trees: int = 48, target: float = 0.97, shard_rows: int = 8192, block_rows: int = 1024, vec_id: str = "vec_id", embedding: str = "embedding", fits: list | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each query among rows with another id.

    score is the cosine in double precision; nearest first, ties to the smaller id; fewer than k where there are no
    more rows. Vectors that are null, zero, or hold null or non-finite components take no part, nor do null ids, on
    either side. Vectors are compared with those of their own length only. Repeated rows are rows of their own; equal
    queries are answered once for each distinct id, and different vectors of one query id each. Empty tables give no
    rows.

    target: the share of the sample's nearest that the fitted numbers of candidates and of ranges must each find. For
    vectors without any structure, as in random directions, near neighbours share few signs, and most rows are
    candidates. Shards have about shard_rows rows and blocks block_rows queries, whatever the size of the tables.
    fits: a list that takes the Fit of each length.
    """
    spark = rows.sparkSession
    pick = lambda df: _usable(df.select(F.col(f"`{vec_id}`").cast("long").alias("id"), F.col(f"`{embedding}`").cast("array<double>").alias("v")))
    stored, asked = pick(rows), pick(queries).dropDuplicates(["id", "v"])
    # of equal vectors a query returns k at most, those of the smallest ids, and never its own
    copies = Window.partitionBy("v").orderBy("id")
    stored = materialize(stored.withColumn("place", F.row_number().over(copies)).where(F.col("place") <= k + 1).drop("place"), "ann-rows")
    widths = [(r["w"], r["count"]) for r in stored.groupBy(F.size("v").alias("w")).count().limit(MAX_WIDTHS + 1).collect()]
    if len(widths) > MAX_WIDTHS:
        raise ValueError(f"vectors of more than {MAX_WIDTHS} lengths")
    out = None
    for width, n in sorted(widths):
        found = _nearest(stored.where(F.size("v") == width), asked.where(F.size("v") == width), width, n, k, trees, target, shard_rows, block_rows, fits)
        out = found if out is None else out.union(found)
    if out is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    nearer = Window.partitionBy("query_id", "query").orderBy(F.desc("score"), "vec_id")  # limited within each task before the shuffle
    ranked = out.withColumn("rank", F.row_number().over(nearer)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def _nearest(stored: DataFrame, asked: DataFrame, width: int, n: int, k: int, trees: int, target: float, shard_rows: int, block_rows: int, fits: list | None) -> DataFrame:
    """query_id, query (a number of the query's vector), vec_id, score: at least the k nearest found in each shard."""
    spark = stored.sparkSession
    shards = max(1, -(-n // shard_rows))
    sample = stored.orderBy(F.xxhash64("id", F.lit(3)), "id").limit(SAMPLE_ROWS).collect()
    ids, vectors = np.array([r["id"] for r in sample]), scaled(np.array([r["v"] for r in sample], np.float64))
    made = fit(ids, vectors, k, trees, target, shards)
    if fits is not None:
        fits.append(made)
    visits, share = max(1, int(np.ceil(made.visits * shards))), made.share
    planes, edges = _planes(1, width, ROUTE)[0], np.zeros(0, np.int64)
    kind = "shard int, block int, id long, v array<double>"

    def keyed(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(_signs(scaled(_matrix(batch.column(1), width)), planes))], names=["key"])

    if shards > 1:
        keys = map_batches(stored.select("id", "v"), keyed, "key long")
        edges = np.array(sorted(keys.approxQuantile("key", [i / shards for i in range(1, shards)], 0.1 / shards)), np.int64)

    def deal(batches):
        """A row to the shard whose range holds its string; where several are of that string alone, to one by its id."""
        for batch in batches:
            i = batch.column(0).to_numpy()
            key = _signs(scaled(_matrix(batch.column(1), width)), planes)
            low, high = np.searchsorted(edges, key, "left"), np.searchsorted(edges, key, "right")
            shard = high - (i.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % np.maximum(1, high - low)
            yield pa.RecordBatch.from_arrays([pa.array(shard, pa.int32()), pa.array(np.full(len(i), -1), pa.int32()), batch.column(0), batch.column(1)], names=["shard", "block", "id", "v"])

    n_blocks = max(1, -(-asked.count() // block_rows))

    def route(batches):
        """A query to the ranges that share the longest prefixes, all that hold its own string among them."""
        for batch in batches:
            keys = _signs(scaled(_matrix(batch.column(1), width)), planes)
            for at, key in enumerate(keys.tolist()):
                own = int(np.searchsorted(edges, key, "right") - np.searchsorted(edges, key, "left")) + 1
                to = _nearest_ranges(key, edges)[: max(visits, own)]
                one = batch.slice(at, 1)
                many = pa.array(np.zeros(len(to), np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(to, pa.int32()), pa.array(np.full(len(to), hash((one.column(0)[0].as_py(), 11)) % n_blocks), pa.int32()), one.column(0).take(many), one.column(1).take(many)], names=["shard", "block", "id", "v"])

    sent = map_batches(asked.select("id", "v"), route, kind)
    both = map_batches(stored.select("id", "v"), deal, kind).union(sent)

    def search(batches):
        forest, shard, ids, parts, block = None, None, [], [], None

        def flush():
            nonlocal forest, ids, parts
            i, m = np.concatenate(ids), np.concatenate(parts)
            ids, parts = [], []
            if block == -1:
                forest = Forest(i, scaled(m), trees)
                return None
            if forest is None:
                return None
            out = [[], [], [], []]
            prints = [hash(x.tobytes()) for x in m]
            for q, mark, (found, scores) in zip(i.tolist(), prints, forest.search(scaled(m), i, k, _wanted(share, len(forest.ids), k, trees)), strict=True):
                out[0] += [q] * len(found)
                out[1] += [mark] * len(found)
                out[2].append(found)
                out[3].append(scores)
            return pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(np.concatenate(out[2]), pa.int64()), pa.array(np.concatenate(out[3]), pa.float64())], names=["query_id", "query", "vec_id", "score"])

        for batch in batches:
            s, b = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            cuts = np.flatnonzero(np.concatenate([[True], (s[1:] != s[:-1]) | (b[1:] != b[:-1])]))
            i, m = batch.column(2).to_numpy(), _matrix(batch.column(3), width)
            for a, z in zip(cuts, [*cuts[1:], len(s)], strict=True):
                if (s[a], b[a]) != (shard, block):
                    if ids and (got := flush()) is not None:
                        yield got
                    if s[a] != shard:
                        forest = None
                    shard, block = s[a], b[a]
                ids.append(i[a:z])
                parts.append(m[a:z])
        if ids and (got := flush()) is not None:
            yield got

    dealt = both.repartition(max(1, min(shards, 100_000)), "shard").sortWithinPartitions("shard", "block")
    return map_batches(dealt, search, "query_id long, query long, vec_id long, score double")
