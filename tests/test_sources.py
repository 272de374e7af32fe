"""Files and streams: round trips."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from meshwork.operators import graph as g
from meshwork.operators import partition as p
from meshwork.plans.loop import sweep
from meshwork.plans.pagerank import pagerank
from meshwork.sources import files
from meshwork.streaming.reachability import IncrementalDepths


def edges_of(graph):
    return sorted(tuple(r) for r in graph.edges.collect())


def make(spark, edges, n):
    return g.Graph.of(spark.createDataFrame(edges, "src long, dst long"), spark.range(n).select(F.col("id").alias("v")))


def test_mtx(spark, tmp_path):
    path = tmp_path / "a.mtx"
    path.write_text("%%MatrixMarket matrix coordinate real general\n% note\n5 5 4\n1 2 0.5\n2 2 1\n3 1 2\n1 2 7\n")
    own = files.read_mtx(spark, str(path))
    assert edges_of(own) == [(0, 1), (2, 0)] and own.n_vertices == 5
    assert edges_of(files.read_mtx(spark, str(path), symmetric=True)) == [(0, 1), (0, 2), (1, 0), (2, 0)]
    files.write_mtx(own, str(tmp_path / "b.mtx"))
    assert edges_of(files.read_mtx(spark, str(tmp_path / "b.mtx"))) == edges_of(own)


def test_mtx_line_like_the_size(spark, tmp_path):
    """An entry that reads like the size line is an entry; a count that differs warns."""
    path = tmp_path / "b.mtx"
    path.write_text("%%MatrixMarket matrix coordinate real general\n% note\n\n3 3 5\n1 2 1\n3 3 5\n2 1 1\n3 3 5\n1 3 2\n")
    assert sorted(tuple(r) for r in files.read_mtx_raw(spark, str(path)).collect()) == [(1, 2), (1, 3), (2, 1), (3, 3), (3, 3)]
    files.read_mtx(spark, str(path), check=True)
    short = tmp_path / "c.mtx"
    short.write_text("3 3 9\n1 2\n")
    with pytest.warns(UserWarning, match="1 entries"):
        files.read_mtx(spark, str(short), check=True)
    assert files.exists(spark, str(short)) and not files.exists(spark, str(tmp_path / "none"))


def test_profile(spark, tmp_path):
    own = make(spark, [(0, 1), (1, 2)], 3)
    ranks, record = pagerank(own, visits=True)
    files.write_profile(str(tmp_path / "p"), record, ranks.select("v", "visits"), own)
    assert spark.read.parquet(str(tmp_path / "p/visits")).count() == 3 and spark.read.parquet(str(tmp_path / "p/rounds")).count() == len(record.rounds)
    files.write_ranks(ranks, str(tmp_path / "r"))
    assert [r.value.split()[0] for r in spark.read.text(str(tmp_path / "r")).collect()] == ["0", "1", "2"]
    assert sweep(spark) > 0 and sweep(spark) == 0


def test_csr(spark, tmp_path):
    own = make(spark, [(0, 1), (0, 3), (2, 0), (4, 3)], 6)
    path = str(tmp_path / "a.csr")
    files.write_csr(own, path)
    assert np.fromfile(path, "<i4").tolist() == [6, 4, 0, 2, 2, 3, 3, 4, 4, 1, 3, 0, 3]
    back = files.read_csr(spark, path, splits=3)
    assert edges_of(back) == edges_of(own) and back.n_vertices == 6
    files.write_csr_text(own, str(tmp_path / "t"))
    assert [r[0] for r in spark.read.text(str(tmp_path / "t.rows")).collect()] and spark.read.text(str(tmp_path / "t.cols")).count() == 4


def test_vectors(spark, tmp_path):
    own = make(spark, [(0, 1), (1, 2)], 5)
    parts = p.by_vertices(own, 2)
    for binary in (True, False):
        path = str(tmp_path / f"v{binary}")
        files.write_vector(parts, path, binary)
        assert sorted(tuple(r) for r in files.read_vector(spark, path, 5, binary, splits=2).collect()) == sorted(tuple(r) for r in parts.collect())


def test_log_and_stride(spark):
    lines = spark.createDataFrame([("a", 2, 0, "ave time: 1.5"), ("a", 2, 1, "x ave time:  2.25 ms"), ("a", 2, 1, "other 9"), ("b", 1, 0, "ave time: 3")], "graph string, n_gpus int, rank int, value string")
    assert {tuple(r) for r in files.run_log(lines).collect()} == {("a", 2, 2.25), ("b", 1, 3.0)}
    assert [r.id for r in files.strided(spark.range(10), "id", 4).orderBy("id").collect()] == [0, 4, 8]


def test_stream(spark, tmp_path):
    folder = tmp_path / "in"
    for k, rows in enumerate([[(0, 1), (2, 3)], [(1, 2)], [(0, 3), (3, 4)]]):
        spark.createDataFrame(rows, "src long, dst long").coalesce(1).write.mode("append").parquet(str(folder / f"k{k}"))
    depths = IncrementalDepths(spark, [0])
    stream = spark.readStream.schema("src long, dst long").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(folder))
    query = stream.writeStream.foreachBatch(depths.update).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert {r.v: r.depth for r in depths.depths.collect()} == {0: 0, 1: 1, 2: 2, 3: 1, 4: 2}
    depths.update(spark.createDataFrame([(0, 4)], "src long, dst long"), 0)  # an epoch that was done
    assert {r.v: r.depth for r in depths.depths.collect()}[4] == 2 and depths.graph().edges.count() == 5
    again = IncrementalDepths(spark, [0], depths.folder)  # after the driver was lost
    again.update(spark.createDataFrame([(0, 4), (4, 9)], "src long, dst long"), again.done + 1)
    assert {r.v: r.depth for r in again.depths.collect()} == {0: 0, 1: 1, 2: 2, 3: 1, 4: 1, 9: 2}
