"""Exact similarity join of word n-gram sets, answered as classes of linked documents.

1. Every text becomes a set of 64-bit shingle hashes and a 128-bit fingerprint of the set; equal sets are one from
   here on. All shingles are counted, and a table of bounded size tells for each a bound on how many rows hold it.
2. Sets are ordered rarest shingle first by that table. Two sets that link share a shingle among the first
   n - ceil(0.8 n) + 1 of each, so only these go to inverted lists, dealt by shingle; those that the table tells to be
   in one row alone have no list.
3. A list is indexed by position and, in a block of one position, by set size. For each set the blocks whose position
   rules a link out are skipped, and in the others its partners are one range by size. Each task tells a spanning
   forest of these candidate edges: as many rows as sets, whatever a list's length.
4. Components of candidate edges are groups; only sets in groups are fetched again, each once. Within a group the
   overlaps of a set with all others are derived from those of a highly similar set by the shingles in which the two
   differ. Large groups are dealt as pairs of blocks of like sizes.
5. Components of the links are the classes.

Hashes stand for shingles: two different shingles of the two sets compared would have to share 64 bits to disturb a
result, whose odds do not grow with the corpus.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshwork.llm.common import U64, WordHasher, blocks, byte_set, map_batches, materialize, mix64, remove, shared_dir, stored, swept

#: The table of counts has a cell of half a byte for the shingles of so many first bits, at least and at most.
CELL_BITS = (16, 27)
#: Counts from which the levels 1 to 15 of a cell begin; at level 0 each shingle of the cell is in one row.
LEVELS = np.array([2, 3, 4, 5, 7, 9, 13, 17, 25, 33, 49, 65, 129, 513, 4097])
#: Shingles are counted by so many bits of their hashes, in blocks of so many.
COUNT_BITS, COUNT_BLOCK = 40, 2_000_000
#: Most bits of the filter that finds the documents of groups.
MAX_FILTER_BITS = 1 << 28
#: Postings that a bucket of lists has on average, postings that a task gathers before it unites those of one place
#: and size, and shingles of a block of a large group.
BUCKET, HELD, BLOCK = 400_000, 1 << 20, 2_000_000
#: Sets in groups up to which every executor is told where each goes: rows of about 200 bytes.
TOLD_ROWS = 200_000
#: Tasks among which the sets of a component are dealt where it is told its least id.
SALTS = 16
#: Sets with more than one in so many of all rows are told to every executor.
COMMON = 10_000
#: Tasks whose few rows go to one file.
FILES = 16
#: Edges of a task that joins them into stars.
EDGES = 500_000
_FACTORS = [U64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)]
POSTING = np.dtype([("t", "<u8"), ("hi", "<u8"), ("lo", "<u8"), ("n", "<u4"), ("p", "<u4")])


class Shingler:
    """Sets of distinct shingles of `words` words; a text of fewer words is one shingle, without words none."""

    def __init__(self, words: int = 5):
        if not 1 <= words <= len(_FACTORS):
            raise ValueError(f"1 to {len(_FACTORS)} words")
        self.words, self.hasher = words, WordHasher(byte_set(lambda b: b != 32 and not 9 <= b <= 13))

    def __call__(self, column: pa.Array):
        """The sorted set of each row, as arrays of uint64."""
        k = self.words
        with np.errstate(over="ignore"):
            for _, n, raw, bounds in blocks(column):
                hashes, _, _, at = self.hasher(raw, bounds)
                grams = mix64(sum(hashes[i : len(hashes) - k + 1 + i] * _FACTORS[i] for i in range(k))) if len(hashes) >= k else hashes[:0]
                for i in range(n):
                    a, z = at[i], at[i + 1]
                    if z - a >= k:
                        yield np.unique(grams[a : z - k + 1])
                    elif z > a:
                        yield mix64(np.array([sum(int(h) * int(f) for h, f in zip(hashes[a:z], _FACTORS, strict=False)) + int(z - a) & 0xFFFFFFFFFFFFFFFF], U64))
                    else:
                        yield hashes[:0]


def fingerprint(shingles: np.ndarray) -> bytes:
    with np.errstate(over="ignore"):
        parts = [(shingles * f).sum(dtype=U64) + U64(len(shingles)) * f for f in _FACTORS[:2]]
        return np.array([mix64(mix64(shingles) ^ parts[0]).sum(dtype=U64), mix64(mix64(shingles ^ _FACTORS[3]) + parts[1]).sum(dtype=U64)], ">u8").tobytes()


def needed(n_a, n_b, percent: int):
    """The least overlap of two linked sets of these sizes."""
    return -(-percent * (n_a + n_b) // (100 + percent))


def _sets(docs: DataFrame, words: int, buckets: int) -> DataFrame:
    """doc_id, fp, n of each document; and rows (bucket, data), the sorted count keys of a block's shingles."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        make, seen, size = Shingler(words), [], 0

        def counted():
            keys = np.concatenate(seen)
            keys >>= U64(64 - COUNT_BITS)
            keys.sort()
            ends = np.searchsorted(keys, np.array([k * (1 << COUNT_BITS) // buckets for k in range(buckets + 1)], U64))
            rows = [pack(keys[a:z]) for a, z in zip(ends[:-1], ends[1:], strict=True)]
            m = len(rows)
            return pa.RecordBatch.from_arrays([pa.nulls(m, ids.type), pa.nulls(m, pa.binary()), pa.nulls(m, pa.int64()), pa.array(range(m), pa.int64()), pa.array(rows, pa.binary())], names=["doc_id", "fp", "n", "bucket", "data"])

        for batch in batches:
            ids, prints, sizes = batch.column(0), [], []
            for s in make(batch.column(1)):
                prints.append(fingerprint(s))
                sizes.append(len(s))
                seen.append(s)
                size += len(s)
                if size >= COUNT_BLOCK:
                    yield counted()
                    seen, size = [], 0
            m = len(ids)
            yield pa.RecordBatch.from_arrays([ids, pa.array(prints, pa.binary()), pa.array(sizes, pa.int64()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.binary())], names=["doc_id", "fp", "n", "bucket", "data"])
        if size:
            yield counted()

    return map_batches(docs, run, f"doc_id {kind}, fp binary, n long, bucket long, data binary")


def pack(keys: np.ndarray) -> bytes:
    """Ascending uint64 as compressed steps."""
    steps = np.diff(keys, prepend=U64(0))
    return zlib.compress(steps.view(np.uint8).reshape(-1, 8).T.tobytes(), 1)


def unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(data), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(U64).ravel(), dtype=U64)


def cells(keys: np.ndarray, bits: int) -> tuple[int, bytes]:
    """Levels of the cells that count keys in any order fall into, two cells a byte: the first byte's place, and the
    bytes. A cell has the level of its most frequent key."""
    keys = np.sort(keys)
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    level = np.searchsorted(LEVELS, np.diff(first, append=len(keys)), "right").astype(np.uint8)
    cell = (keys[first] >> U64(COUNT_BITS - bits)).astype(np.int64)
    heads = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
    begin = int(cell[0]) >> 1
    out = np.zeros(2 * ((int(cell[-1]) >> 1) - begin + 1), np.uint8)
    out[cell[heads] - 2 * begin] = np.maximum.reduceat(level, heads)
    return begin, (out[::2] | out[1::2] << 4).tobytes()


def levels(table: np.ndarray, shingles: np.ndarray) -> np.ndarray:
    """The level of each shingle's cell."""
    cell = (shingles >> U64(64 - (2 * len(table)).bit_length() + 1)).astype(np.int64)
    return table[cell >> 1] >> ((cell & 1) << 2).astype(np.uint8) & 15


def _counted(counts: DataFrame, partitions: int, total: int) -> np.ndarray:
    """The table of levels, for `total` shingles.

    It orders shingles, so a class never depends on how full it is; a shingle at level 0 is in one row.
    """
    bits = min(max(CELL_BITS[0], (total // 2).bit_length()), CELL_BITS[1])

    def run(batches):
        now, parts = None, []

        def told():
            begin, data = cells(np.concatenate(parts), bits)
            return pa.RecordBatch.from_arrays([pa.array([begin], pa.int64()), pa.array([zlib.compress(data, 1)], pa.binary())], names=["begin", "data"])

        for batch in batches:
            for bucket, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if bucket != now and parts:
                    yield told()
                    parts = []
                now = bucket
                if len(keys := unpack(data)):
                    parts.append(keys)
        if parts:
            yield told()

    table = np.zeros(1 << bits - 1, np.uint8)
    with swept(counts.sparkSession):
        found = map_batches(counts.repartition(partitions, "bucket").sortWithinPartitions("bucket"), run, "begin long, data binary").toArrow()
    for begin, data in zip(found.column("begin").to_pylist(), found.column("data"), strict=True):
        part = np.frombuffer(zlib.decompress(data.as_buffer()), np.uint8)
        table[begin : begin + len(part)] |= part  # only cells that reach over two buckets meet: neither level is lost
    return table


def named(rows: np.ndarray) -> np.ndarray:
    """Fingerprints of the postings as 16 bytes each."""
    return np.stack([rows["hi"], rows["lo"]], 1).view("V16").ravel()


def spanning(a: np.ndarray, b: np.ndarray) -> tuple[list[bytes], list[bytes]]:
    """The ends of a spanning forest of the edges between the sets of postings a and b."""
    keys, at = np.unique(named(np.concatenate([a, b])), return_inverse=True)
    pairs = np.unique(np.sort(np.stack([at[: len(a)], at[len(a) :]], 1), 1), axis=0)
    forest = Forest(len(keys))
    kept = [(x, y) for x, y in pairs.tolist() if forest.join(x, y)]
    return [keys[x].tobytes() for x, _ in kept], [keys[y].tobytes() for _, y in kept]


def compact(rows: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, list[bytes], list[bytes]]:
    """Places in rows of lists of one posting; of all others, sorted by t, p, n, with one set for all of one position
    and size; and a spanning forest of the sets that went.

    Such sets have the same partners in the list, and each other if the rest of them is long enough: then one stands
    for all, tied to the others. So a list shrinks to its positions and sizes, before it is dealt and as it is read.
    """
    order = np.argsort(rows["t"], kind="stable")
    t = rows["t"][order]
    like = np.concatenate([[False], t[1:] == t[:-1], [False]])
    shared = like[1:] | like[:-1]
    alone, order, t = order[~shared], order[shared], t[shared]
    hi, n, p = rows["hi"][order], rows["n"][order].astype(np.int64), rows["p"][order].astype(np.int64)
    by = np.lexsort((hi, p << 32 | n, t))
    order, t, hi, n, p = order[by], t[by], hi[by], n[by], p[by]
    lo = rows["lo"][order]
    like = np.concatenate([[False], (t[1:] == t[:-1]) & (p[1:] == p[:-1]) & (n[1:] == n[:-1])])[: len(t)]
    same = np.concatenate([[False], (hi[1:] == hi[:-1]) & (lo[1:] == lo[:-1])])[: len(t)]
    own = n - p >= needed(n, n, percent)
    gone = like & (own | same)
    tied, first = gone & own, order[np.flatnonzero(~like)[np.cumsum(~like) - 1]]
    return alone, order[~gone], *spanning(rows[first[tied]], rows[order[tied]])


def _postings(docs: DataFrame, words: int, percent: int, counted: np.ndarray, buckets: int) -> DataFrame:
    """Prefixes of all sets as packed postings: bucket, data; and edges (a, b) of sets left out.

    A shingle that is in one row keeps its position, but has no posting: nothing else could be in its list.
    """
    shared = docs.sparkSession.sparkContext.broadcast(counted)

    def run(batches):
        make, table, seen = Shingler(words), shared.value, set()
        held, size = [], 0

        def flush():
            rows = np.concatenate(held)
            alone, kept, a, b = compact(rows, percent)
            rows = rows[np.sort(np.concatenate([alone, kept]))]  # postings of a set next to each other shrink well
            bucket = (rows["t"] % U64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            rows, bucket = rows[order], bucket[order]
            edges = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]]))
            data = [rows[x:z].tobytes() for x, z in zip(edges[:-1], edges[1:], strict=True)]
            places = np.concatenate([bucket[edges[:-1]], np.array([int.from_bytes(x[8:]) % buckets for x in b], np.int64)])
            arrays = [data + [None] * len(a), [None] * len(data) + a, [None] * len(data) + b]
            return pa.RecordBatch.from_arrays([pa.array(places, pa.int64()), *(pa.array(x, pa.binary()) for x in arrays)], names=["bucket", "data", "a", "b"])

        for batch in batches:
            for s in make(batch.column(1)):
                n = len(s)
                first = n - -(-percent * n // 100) + 1
                level = levels(table, s)
                lone = n - np.count_nonzero(level)
                if not n or lone >= first or (fp := fingerprint(s)) in seen:
                    continue
                if len(seen) < 500_000:
                    seen.add(fp)
                s = s[np.argsort(level, kind="stable")[lone:first]]  # of one level, by shingle
                rows = np.empty(len(s), POSTING)
                rows["t"], rows["n"], rows["p"] = s, n, np.arange(lone, first)
                rows["hi"], rows["lo"] = np.frombuffer(fp, "<u8")
                held.append(rows)
                size += len(rows)
                if size >= 500_000:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    return map_batches(docs.select("doc_id", "text"), run, "bucket long, data binary, a binary, b binary")


class Forest:
    """Disjoint sets of 0..n-1."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)
        return a != b


def candidate_edges(rows: np.ndarray, percent: int, most: int = 1 << 21) -> tuple[np.ndarray, np.ndarray]:
    """Indices into rows whose components are those of all pairs of a list that sizes and positions leave.

    rows are sorted by t, p, n, as compact() leaves them. A list is indexed by position, and each block of one
    position by size. For a set x the blocks beyond a position are skipped whole, and in the others its partners of at
    least its size are one range. x is tied to the first of a range and the range's members to each other, so edges
    number as the ranges do and not as the pairs. At most about `most` ranges are held at once.
    """
    if not len(rows):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    n, p = rows["n"].astype(np.int64), rows["p"].astype(np.int64)
    opens = np.concatenate([[True], rows["t"][1:] != rows["t"][:-1]])
    starts = opens | np.concatenate([[True], p[1:] != p[:-1]])
    of_list, of_block, heads = np.cumsum(opens) - 1, np.cumsum(starts) - 1, np.flatnonzero(starts)
    by_position, by_size = of_list[heads] << 32 | p[heads], of_block << 32 | n
    # the largest partner by sizes and by x's own position, and the last position where such a partner can be
    largest = np.minimum(n * 100 // percent, (100 + percent) * (n - p) // percent - n)
    last = (100 * largest - percent * n) // (100 + percent)
    first = of_block[np.flatnonzero(opens)][of_list]
    count = np.searchsorted(by_position, of_list << 32 | np.maximum(last, 0), "right") - first
    count[(largest < n) | (last < 0) | (np.bincount(of_list)[of_list] == 1)] = 0
    begun, cover, left, right = np.concatenate([[0], np.cumsum(count)]), np.zeros(len(rows) + 1, np.int64), [], []
    a = 0
    while a < len(rows):
        z = max(a + 1, int(np.searchsorted(begun, begun[a] + most, "right")) - 1)
        x = np.repeat(np.arange(a, z), count[a:z])
        block = first[x] + np.arange(begun[a], begun[z]) - begun[x]
        least = np.maximum(n[x], -(-(percent * n[x] + (100 + percent) * p[heads[block]]) // 100))
        lo, hi = np.searchsorted(by_size, block << 32 | least), np.searchsorted(by_size, block << 32 | largest[x], "right")
        x, lo, hi = x[hi > lo], lo[hi > lo], hi[hi > lo]
        cover += np.bincount(lo, minlength=len(cover)) - np.bincount(hi - 1, minlength=len(cover))
        left.append(x[x != lo])
        right.append(lo[x != lo])
        a = z
    tied = np.flatnonzero(np.cumsum(cover))
    return np.concatenate([*left, tied]), np.concatenate([*right, tied + 1])


def _candidates(postings: DataFrame, percent: int, buckets: int) -> DataFrame:
    """Spanning edges (a, b) of the candidate graph of each bucket."""

    def edges(a, b):
        return pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["a", "b"])

    def found(parts):
        rows = np.concatenate(parts)
        _, kept, a, b = compact(rows, percent)
        rows = rows[kept]
        i, j = candidate_edges(rows, percent)
        yield edges(a, b)
        yield edges(*spanning(rows[i], rows[j]))

    def run(batches):
        now, parts, size, most = None, [], 0, HELD
        for batch in batches:
            told = batch.filter(pc.is_null(batch.column(1)))
            yield edges(told.column(2), told.column(3))
            batch = batch.filter(pc.is_valid(batch.column(1)))
            for bucket, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if bucket != now and parts:
                    yield from found(parts)
                    parts, size, most = [], 0, HELD
                now = bucket
                parts.append(np.frombuffer(data.as_buffer(), POSTING).copy())
                size += len(parts[-1])
                if size > most:
                    rows = np.concatenate(parts)
                    alone, kept, a, b = compact(rows, percent)
                    yield edges(a, b)
                    parts = [rows[np.concatenate([alone, kept])]]
                    size, most = len(parts[0]), max(HELD, 2 * len(parts[0]))
        if parts:
            yield from found(parts)

    return map_batches(postings.repartitionById(buckets, F.col("bucket").cast("int")).sortWithinPartitions("bucket"), run, "a binary, b binary")


def components(edges: DataFrame, purpose: str = "components", files: int = 1) -> DataFrame:
    """(node, root) for every node of the edges (a, b): root is the least node of its component.

    Tasks of at most about EDGES edges first replace theirs by stars, which is all where there is one such task. Then
    large-star and small-star steps take turns, each a min aggregation and a join; every round is written to the
    shared folder. Empty edges give no rows. files: how many hold the edges, which come from many tasks that have few.
    """
    told = materialize(edges.where("a <> b").repartition(files), purpose)
    parts = max(1, -(-told.count() // EDGES))
    now = materialize(map_batches(told.repartition(parts, "a", "b"), _stars, "u binary, v binary"), purpose)
    if parts == 1:
        return _named(now)
    while True:
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        floor = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(floor, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(floor.select("u", F.col("m").alias("v"))).distinct()
        after = materialize(small, purpose)
        digest = lambda df: df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if digest(after) == digest(now):
            break
        now = after
    return _named(now)


def _named(stars: DataFrame) -> DataFrame:
    return stars.select(F.col("u").alias("node"), F.col("v").alias("root")).union(stars.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _stars(batches):
    """Edges of a task to its own components' stars (u, v), v the least node."""
    ids, names, a, b = {}, [], [], []
    for batch in batches:
        for column, out in ((batch.column(0), a), (batch.column(1), b)):
            for x in column.to_pylist():
                if (i := ids.setdefault(x, len(names))) == len(names):
                    names.append(x)
                out.append(i)
    order = sorted(range(len(names)), key=names.__getitem__)
    rank = [0] * len(names)
    for place, i in enumerate(order):
        rank[i] = place
    forest = Forest(len(names))  # of places in the order of names: roots are least
    for x, y in zip(a, b, strict=True):
        forest.join(rank[x], rank[y])
    rows = [(names[order[x]], names[order[r]]) for x in range(len(names)) if (r := forest.root(x)) != x]
    yield pa.RecordBatch.from_arrays([pa.array([u for u, _ in rows], pa.binary()), pa.array([v for _, v in rows], pa.binary())], names=["u", "v"])


def links_within(sets: list[np.ndarray], side: list[int] | None, percent: int) -> list[tuple[int, int]]:
    """Spanning links of the sets. side: compare only sets of different sides, if given."""
    m, forest, found = len(sets), Forest(len(sets)), []
    sizes = np.array([len(s) for s in sets], np.int64)
    sides = None if side is None else np.array(side)
    if m <= 3:
        for i in range(m):
            for j in range(i + 1, m):
                if (sides is None or sides[i] != sides[j]) and len(np.intersect1d(sets[i], sets[j], assume_unique=True)) >= needed(sizes[i], sizes[j], percent) and forest.join(i, j):
                    found.append((i, j))
        return found
    _, token = np.unique(np.concatenate(sets), return_inverse=True)
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    own = [token[bounds[i] : bounds[i + 1]] for i in range(m)]  # ascending, like the sets
    order = np.argsort(token, kind="stable")
    member = np.repeat(np.arange(m), sizes)[order]  # the inverted lists on end
    head = np.concatenate([[0], np.cumsum(np.bincount(token))])

    def listed(tokens: np.ndarray) -> np.ndarray:
        """How many of the tokens each set holds."""
        a, n = head[tokens], head[tokens + 1] - head[tokens]
        at = np.repeat(a - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        return np.bincount(member[at], minlength=m)

    pivots: list[tuple[int, np.ndarray]] = []
    for x in np.argsort(sizes, kind="stable").tolist():
        best = max(pivots, key=lambda p: p[1][x], default=None)
        if best is not None and 2 * best[1][x] > sizes[x]:
            # from the answers of a similar set: only the shingles in which the two differ are looked up
            p, counts = best
            more, less = np.setdiff1d(own[x], own[p], assume_unique=True), np.setdiff1d(own[p], own[x], assume_unique=True)
            counts = counts + (listed(more) if len(more) else 0) - (listed(less) if len(less) else 0)
        else:
            counts = listed(own[x])
            pivots = [*pivots[-31:], (x, counts)]
        linked = counts >= needed(sizes, sizes[x], percent)
        linked[x] = False
        if sides is not None:
            linked &= sides != sides[x]
        for y in np.flatnonzero(linked).tolist():
            if forest.join(x, y):
                found.append((x, y))
    return found


def _links(docs: DataFrame, reps: DataFrame, groups: DataFrame, words: int, percent: int, block: int) -> DataFrame:
    """Spanning links (a, b) within groups (fp, root), whose sets are made again from one document of each."""
    spark = docs.sparkSession
    held = materialize(groups.withColumnRenamed("node", "fp").join(reps.select("fp", "n"), "fp"), "groups")
    n_held = held.count()
    bits = 1 << min(MAX_FILTER_BITS.bit_length() - 1, max(16, (16 * n_held).bit_length()))
    spot = lambda at: F.conv(F.hex(F.substring("fp", at, 7)), 16, 10).cast("long") % bits
    masks = held.select(F.explode(F.array(spot(1), spot(9))).alias("spot")).groupBy(F.floor(F.col("spot") / 32).alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("spot") % 32).cast("int"))).alias("mask")).toArrow()
    filter_ = np.zeros(bits // 32, np.uint32)  # of bounded size, whatever the number of groups
    filter_[masks.column("word").to_numpy()] = masks.column("mask").to_numpy().astype(np.uint32)
    shared = spark.sparkContext.broadcast(filter_)
    # sets of like sizes: a class holds sizes whose ratio is at least the threshold, so links are within a class or between neighbours
    size_class = F.floor(F.log(F.col("n").cast("double")) / float(-np.log(percent / 100))).cast("int")
    total = held.groupBy("root").agg(F.sum("n").alias("total"))
    parts = F.ceil(F.col("total") / block).cast("int")
    dealt = held.join(total, "root").withColumn("parts", parts)
    dealt = dealt.withColumn("class", F.when(F.col("parts") > 1, size_class).otherwise(0)).withColumn("part", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))
    # keys (class, part, class of the other, its part): own block, then pairs with all later blocks of its class and the next
    cells = F.expr(
        "CASE WHEN parts = 1 THEN array(struct(0 AS c, 0 AS p, 0 AS d, 0 AS q, 0 AS side)) ELSE concat("
        "transform(sequence(0, parts - 1), q -> struct(class AS c, least(part, q) AS p, class AS d, greatest(part, q) AS q, CASE WHEN part <= q THEN 0 ELSE 1 END AS side)),"
        "transform(sequence(0, parts - 1), q -> struct(class AS c, part AS p, class + 1 AS d, q AS q, 0 AS side)),"
        "transform(sequence(0, parts - 1), q -> struct(class - 1 AS c, q AS p, class AS d, part AS q, 1 AS side))) END"
    )

    def fetch(batches):
        make, own, seen = Shingler(words), shared.value, set()
        for batch in batches:
            prints, data, size = [], [], 0
            for s in make(batch.column(0)):
                if not len(s):
                    continue
                fp = fingerprint(s)
                if all(own[x >> 5] >> (x & 31) & 1 for x in (int.from_bytes(fp[:7]) % bits, int.from_bytes(fp[8:15]) % bits)) and fp not in seen:
                    if len(seen) < 500_000:
                        seen.add(fp)
                    prints.append(fp)
                    data.append(s.tobytes())
                    size += len(data[-1])
                    if size > 16 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(prints, pa.binary()), pa.array(data, pa.binary())], names=["fp", "data"])
                        prints, data, size = [], [], 0
            yield pa.RecordBatch.from_arrays([pa.array(prints, pa.binary()), pa.array(data, pa.binary())], names=["fp", "data"])

    where = dealt.withColumn("cells", cells).select("root", "fp", "cells")
    if n_held <= TOLD_ROWS:  # of checked size; beyond it sets are shuffled once more
        where = F.broadcast(where)
    sets = map_batches(docs.select("text"), fetch, "fp binary, data binary").join(where, "fp")
    keyed = sets.select("root", "fp", F.explode("cells").alias("cell"), "data").select("root", "cell.c", "cell.p", "cell.d", "cell.q", "cell.side", "fp", "data")

    def verify(batches):
        now, held = None, {}

        def judged():
            prints = list(held)
            c, p, d, q = now[1:]
            found = links_within([np.frombuffer(held[f][1], U64) for f in prints], None if (c, p) == (d, q) else [held[f][0] for f in prints], percent)
            return pa.RecordBatch.from_arrays([pa.array([prints[i] for i, _ in found], pa.binary()), pa.array([prints[j] for _, j in found], pa.binary())], names=["a", "b"])

        for batch in batches:
            columns = [batch.column(k).to_pylist() for k in range(8)]
            for *key, side, fp, data in zip(*columns, strict=True):
                if key != now and len(held) > 1:
                    yield judged()
                if key != now:
                    now, held = key, {}
                held[fp] = (side, data)
        if len(held) > 1:
            yield judged()

    keys = ["root", "c", "p", "d", "q"]
    return map_batches(keyed.repartition(*keys).sortWithinPartitions(*keys), verify, "a binary, b binary")


def similar_classes(docs: DataFrame, words: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text", block: int = BLOCK) -> DataFrame:
    """doc_id, n_shingles, component_id of every row.

    Words are runs of bytes other than white space after folding A-Z. Two rows link when 100 * intersection >=
    percent * union of their sets; component_id is the smallest doc_id that links reach, the row's own included.
    A null text or one without words has an empty set, links with nothing and is its own component; so has a null
    doc_id no say in the smallest id, and a component of null ids alone is null. Repeated rows are equal sets and one
    component. An empty table gives no rows; other columns are not read.
    """
    spark: SparkSession = docs.sparkSession
    docs = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    dealt = max(8, docs.rdd.getNumPartitions())  # counts go to as many tasks as read the input
    made = stored(_sets(docs, words, dealt), sets := shared_dir(spark, "sets"))
    info = materialize(made.where("bucket IS NULL").select("doc_id", "fp", "n").coalesce(dealt // FILES + 1), "info")
    total, some_rows = info.where("n > 0").agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    buckets = max(8, int(total * (100 - percent) / 100 / BUCKET) + 1)
    counted = _counted(made.where("bucket IS NOT NULL").select("bucket", "data"), dealt, total)
    remove(spark, sets)  # counts take about as much disk as texts
    postings = _postings(docs, words, percent, counted, buckets)
    edges = _candidates(postings, percent, buckets)
    groups = components(edges, "candidates", buckets // FILES + 1)
    reps = info.where("n > 0").groupBy("fp").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.count(F.lit(1)).alias("copies"))
    links = _links(docs, reps, groups, words, percent, block)
    roots = materialize(components(links, "links", int(spark.conf.get("spark.sql.shuffle.partitions")) // FILES + 1), "roots")
    own = reps.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "rep", "copies", F.coalesce("root", "fp").alias("root"))
    least = materialize(own.groupBy("root").agg(F.min("rep").alias("component_id")).join(roots.select("root").distinct(), "root", "left_semi"), "least")
    linked = own.join(roots.select(F.col("node").alias("fp")), "fp", "left_semi")
    if least.count() <= TOLD_ROWS:  # of checked size
        linked = linked.join(F.broadcast(least), "root")
    else:  # a component's sets meet its least id in several tasks
        salts = least.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        linked = linked.withColumn("salt", F.pmod(F.xxhash64("fp"), F.lit(SALTS)).cast("int")).join(salts, ["root", "salt"])
    alone = own.join(roots.select(F.col("node").alias("fp")), "fp", "left_anti")
    told = materialize(linked.select("fp", "component_id", "copies").union(alone.select("fp", F.col("rep").alias("component_id"), "copies")), "told")
    # sets with more than one in COMMON of all rows are fewer than COMMON, so every executor is told those; a task that
    # meets the others by fingerprint has at most that share of the rows from one set
    some, common = info.where("n > 0"), F.broadcast(told.where(F.col("copies") * COMMON > some_rows).select("fp", "component_id"))
    rest = some.join(common.select("fp"), "fp", "left_anti").join(told.where(F.col("copies") * COMMON <= some_rows), "fp")
    some = some.join(common, "fp").select("doc_id", "n", "component_id").union(rest.select("doc_id", "n", "component_id")).withColumnRenamed("n", "n_shingles")
    return some.union(info.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def deduplicate(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """One row of each component: that with the smallest doc_id, a null id after all others.

    Rows without words stay, but of those with one id and text one stays. Where ids repeat or are null, rows are told
    apart by a key of their own. Columns are those of docs.
    """
    columns = [F.col(f"`{c}`") for c in docs.columns]
    if docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 OR doc_id IS NULL").isEmpty():
        classes = materialize(similar_classes(docs, words, percent), "classes")
        gone = classes.where("doc_id <> component_id").select(F.col("doc_id").alias("gone_id"))
        return docs.join(gone, F.col("doc_id") == F.col("gone_id"), "left_anti").select(*columns)
    rows = materialize(docs.select(F.monotonically_increasing_id().alias("key"), F.struct(*columns).alias("row")), "rows")
    classes = similar_classes(rows.select("key", F.col("row.text").alias("text")), words, percent, doc_id="key").withColumnRenamed("doc_id", "key")
    told = rows.select("key", F.col("row.doc_id").alias("doc_id"), F.md5("row.text").alias("print")).join(classes, "key")
    place = F.struct(F.col("doc_id").isNull(), "doc_id", "print", "key")
    some = told.where("n_shingles > 0").groupBy("component_id").agg(F.min(place)["key"].alias("key")).select("key")
    bare = told.where("n_shingles = 0").groupBy("doc_id", "print", F.when(F.col("doc_id").isNull(), F.col("key")).alias("own")).agg(F.min("key").alias("key")).select("key")
    return rows.join(some.union(bare), "key", "left_semi").select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])


#: DuckDB: all shared shingles of all pairs, and components by their least labels.
CLASSES_SQL = """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), l AS (
  SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY ALL)
  JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * k >= 80 * (p.n + q.n - k)
), c(r, v, label, open) AS (
  SELECT 0, doc_id, doc_id, true FROM w
  UNION ALL
  SELECT t.r + 1, t.v, least(t.label, coalesce(m.label, t.label)), coalesce(m.label < t.label, false) FROM c t LEFT JOIN
  (SELECT l.b AS v, min(x.label) AS label FROM c x JOIN l ON l.a = x.v WHERE x.open GROUP BY l.b) m ON m.v = t.v
  WHERE EXISTS (SELECT 1 FROM c y WHERE y.open)
)
SELECT c.v AS doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.label AS component_id
FROM c LEFT JOIN n ON n.doc_id = c.v WHERE c.r = (SELECT max(r) FROM c)
"""
