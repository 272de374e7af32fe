"""Matrix Market, compressed sparse rows and partition vectors as sources and sinks.

Binary files are read in ranges by many tasks through the path's file system; the single-file formats hold 32-bit
offsets, which bounds what a writer has to put in order. Writers let tasks make the bytes of ranges; the driver only
appends them, a batch at a time. A path without a scheme is in Spark's default file system.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshwork.operators.graph import Graph, clean_edges, csr_offsets, edge_difference, running_sum


def uri(spark: SparkSession, path: str) -> str:
    """The path with its scheme, as Spark resolves it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    full = at.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(at).toString()
    return full.replace("file:/", "file:///", 1) if full.startswith("file:/") and not full.startswith("file://") else full


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def _open(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def _content(spark: SparkSession, path: str) -> tuple[DataFrame, int | None, str | None]:
    """Lines that are neither comments nor empty, with the place `_at` that Spark gives each, and the first of them."""
    lines = spark.read.text(path).withColumn("_at", F.monotonically_increasing_id()).where(~F.startswith("value", F.lit("%")) & (F.trim("value") != ""))
    first = lines.first()  # of the file's first split: one line is read
    return lines, *((None, None) if first is None else (first["_at"], first["value"].strip()))


def read_mtx_raw(spark: SparkSession, path: str) -> DataFrame:
    """src, dst as written, one row a line: lines that begin with % and the first other line, which has the sizes, are
    left out, weights dropped."""
    lines, at, _ = _content(spark, path)
    cells = F.split(F.trim("value"), r"\s+")
    lines = lines.where(F.col("_at") != at) if at is not None else lines
    return lines.select(cells[0].cast("long").alias("src"), cells[1].cast("long").alias("dst"))


def mtx_size(spark: SparkSession, path: str) -> tuple[int, int, int]:
    line = _content(spark, path)[2]
    if line is None or len(line.split()) < 3:
        raise ValueError("no size line")
    rows, columns, n = line.split()[:3]
    return int(rows), int(columns), int(n)


def read_mtx(spark: SparkSession, path: str, base: int = 1, symmetric: bool = False, check: bool = False) -> Graph:
    """A clean graph: ids from 0, no self-loops or parallel edges, all vertices that the size line names.

    check: warn where the number of entries is not what the size line says, which takes a pass over the file.
    """
    rows, columns, n = mtx_size(spark, path)
    raw = read_mtx_raw(spark, path)
    if check and (found := raw.count()) != n:
        warnings.warn(f"{path} has {found} entries; its size line says {n}", stacklevel=2)
    vertices = spark.range(max(rows, columns)).select(F.col("id").alias("v"))
    return Graph(vertices, clean_edges(raw, base, symmetric))


def _parts(rows: DataFrame, make: Callable[[pa.RecordBatch], bytes]):
    """The bytes that tasks make of ordered rows, in their order."""

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([make(batch)], pa.binary())], names=["data"])

    for row in rows.mapInArrow(run, "data binary").toLocalIterator(prefetchPartitions=True):
        yield row["data"]


def _text(batch: pa.RecordBatch) -> bytes:
    rows = zip(*[c.to_pylist() for c in batch.columns], strict=True)
    return "".join([" ".join(map(str, r)) + "\n" for r in rows]).encode()


def _binary(kind: str) -> Callable[[pa.RecordBatch], bytes]:
    return lambda batch: batch.column(0).to_numpy().astype(kind).tobytes()


def write_mtx(graph: Graph, path: str) -> None:
    """One file, for a folder of text parts would lose the head's place."""
    store, at = _open(uri(graph.edges.sparkSession, path))
    n = graph.n_vertices
    with store.open_output_stream(at) as out:
        out.write(f"%%MatrixMarket matrix coordinate pattern general\n{n} {n} {graph.edges.count()}\n".encode())
        for data in _parts(graph.edges.orderBy("src", "dst").select(F.col("src") + 1, F.col("dst") + 1), _text):
            out.write(data)


def write_csr(graph: Graph, path: str) -> None:
    """int32 nodes, edges, row_offset[nodes + 1], column_indices[edges], little-endian. Vertices are 0..N-1."""
    n, m = graph.n_vertices, graph.edges.count()
    if max(n, m) >= 1 << 31:
        raise ValueError("the format's offsets have 32 bits")
    store, at = _open(uri(graph.edges.sparkSession, path))
    with store.open_output_stream(at) as out:
        out.write(np.array([n, m], "<i4").tobytes())
        for data in _parts(csr_offsets(graph).orderBy("v").select("row_offset"), _binary("<i4")):
            out.write(data)
        out.write(np.array([m], "<i4").tobytes())
        for data in _parts(graph.edges.orderBy("src", "dst").select("dst"), _binary("<i4")):
            out.write(data)


def csr_size(path: str) -> tuple[int, int]:
    store, at = _open(path)
    with store.open_input_file(at) as f:
        n, m = np.frombuffer(f.read(8), "<i4")
    return int(n), int(m)


def mtx_to_csr(spark: SparkSession, mtx: str, csr: str, base: int = 1, symmetric: bool = False, valid: bool = False) -> int:
    """The conversion as a job; valid: read the result back and compare edges. Returns how many differ (0 unchecked)."""
    graph = read_mtx(spark, mtx, base, symmetric, check=valid)
    write_csr(graph, csr)
    return edge_difference(graph.edges, read_csr(spark, csr).edges).count() if valid else 0


def read_csr(spark: SparkSession, path: str, splits: int = 16) -> Graph:
    """Each task reads a range of row offsets and the columns between them."""
    path = uri(spark, path)
    n, m = csr_size(path)
    step = max(1, -(-n // splits))

    def read(batches):
        store, at = _open(path)
        with store.open_input_file(at) as f:
            for batch in batches:
                for first in batch.column(0).to_pylist():
                    end = min(n, first + step)
                    f.seek(8 + 4 * first)
                    offsets = np.frombuffer(f.read(4 * (end - first + 1)), "<i4").astype(np.int64)
                    for a in range(0, end - first, 1 << 16):  # bounded blocks of rows
                        z = min(end - first, a + (1 << 16))
                        f.seek(8 + 4 * (n + 1) + 4 * int(offsets[a]))
                        dst = np.frombuffer(f.read(4 * int(offsets[z] - offsets[a])), "<i4").astype(np.int64)
                        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(first + a, first + z), np.diff(offsets[a : z + 1]))), pa.array(dst)], names=["src", "dst"])

    ranges = spark.range(0, n, step, numPartitions=max(1, min(splits, n))) if n else spark.range(0)
    return Graph(spark.range(n).select(F.col("id").alias("v")), ranges.mapInArrow(read, "src long, dst long"))


def write_csr_text(graph: Graph, base: str) -> None:
    """<base>.rows and <base>.cols: one offset or column a line, as folders of ordered text parts."""
    offsets = csr_offsets(graph).select("v", F.col("row_offset").alias("x"))
    last = graph.edges.agg(F.count(F.lit(1)).alias("x")).select(F.lit(1 << 62).alias("v"), "x")
    offsets.union(last).orderBy("v").select(F.col("x").cast("string").alias("value")).write.mode("overwrite").text(f"{base}.rows")
    graph.edges.orderBy("src", "dst").select(F.col("dst").cast("string").alias("value")).write.mode("overwrite").text(f"{base}.cols")


def read_vector(spark: SparkSession, path: str, n: int, binary: bool = True, splits: int = 16) -> DataFrame:
    """(v, part) of a partition vector: int64 numbers, or one number a line with lines of % left out."""
    if not binary:  # a line's place is the sum over the parts before and its place within
        lines, _, _ = _content(spark, path)
        rows = running_sum(lines.select("_at", F.trim("value").cast("int").alias("part"), F.lit(1).cast("long").alias("one")), "_at", "one", "v")
        if (found := rows.count()) != n:
            raise ValueError(f"{found} numbers for {n} vertices")
        return rows.select("v", "part")
    path = uri(spark, path)
    step = max(1, -(-n // splits))

    def read(batches):
        store, at = _open(path)
        with store.open_input_file(at) as f:
            if f.size() != 8 * n:
                raise ValueError(f"{f.size()} bytes for {n} vertices")
            for batch in batches:
                for first in batch.column(0).to_pylist():
                    f.seek(8 * first)
                    part = np.frombuffer(f.read(8 * (min(n, first + step) - first)), "<i8")
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(first, first + len(part))), pa.array(part.astype(np.int32))], names=["v", "part"])

    return spark.range(0, n, step, numPartitions=max(1, min(splits, n))).mapInArrow(read, "v long, part int")


def write_vector(partition: DataFrame, path: str, binary: bool = True) -> None:
    store, at = _open(uri(partition.sparkSession, path))
    with store.open_output_stream(at) as out:
        for data in _parts(partition.orderBy("v").select("part"), _binary("<i8") if binary else _text):
            out.write(data)


def write_ranks(ranks: DataFrame, path: str) -> None:
    """v and rank, one vertex a line, in the order of v: a folder of ordered text parts."""
    ranks.orderBy("v").select(F.concat_ws(" ", F.col("v").cast("string"), F.col("rank").cast("string")).alias("value")).write.mode("overwrite").text(path)


def write_profile(path: str, record, visits: DataFrame | None = None, graph: Graph | None = None) -> None:
    """The bundle of a run: rounds (round, frontier, elapsed_ms and the time since the start), visits of each vertex,
    and a histogram of degrees, each a Parquet folder under path."""
    from pyspark.sql import Window

    spark = SparkSession.active()
    through = F.sum("elapsed_ms").over(Window.orderBy("round"))  # a row a round
    record.to_df(spark).withColumn("accumulated_ms", through).write.mode("overwrite").parquet(f"{path}/rounds")
    if visits is not None:
        visits.write.mode("overwrite").parquet(f"{path}/visits")
    if graph is not None:
        from meshwork.operators.graph import degree_histogram

        degree_histogram(graph).write.mode("overwrite").parquet(f"{path}/degrees")


def strided(rows: DataFrame, index: str, stride: int) -> DataFrame:
    """Every stride-th row by its index."""
    return rows.where(F.col(index) % stride == 0)


def run_log(lines: DataFrame) -> DataFrame:
    """graph, n_gpus, ms: of log lines (graph, n_gpus, rank, value), the slowest rank's mean of those with a mean time."""
    ms = F.regexp_extract("value", r"ave time:\s*([0-9.]+)", 1)
    return lines.withColumn("ms", ms).where("ms <> ''").groupBy("graph", "n_gpus").agg(F.max(F.col("ms").cast("double")).alias("ms"))
