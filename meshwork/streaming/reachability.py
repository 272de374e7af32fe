"""Incremental breadth-first search over a stream of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshwork.operators.graph import Graph
from meshwork.plans.loop import kept, remove, shared_folder
from meshwork.sources import files


class IncrementalDepths:
    """Depths from fixed sources while edges arrive in batches; depths only fall, so each batch relaxes from its own
    edges on. Use as a foreachBatch sink: `edges.writeStream.foreachBatch(depths.update)`.

    Edges are slices of a trail, one a batch, named by the batch: none is rewritten, and repeated edges do no harm. All
    state is in `folder`: an instance over the same folder goes on from the last batch whose mark was written.
    """

    def __init__(self, spark: SparkSession, sources: list[int], folder: str | None = None):
        self.spark, self.folder = spark, folder or shared_folder(spark, "incremental")
        done = files.exists(spark, f"{self.folder}/done")
        self.done = spark.read.parquet(f"{self.folder}/done").agg(F.max("epoch")).first()[0] if done else -1
        if not done:
            start = spark.createDataFrame([(int(s), 0) for s in dict.fromkeys(sources)], "v long, depth long")
            start.write.mode("overwrite").parquet(self._depths(-1))
            self._mark(-1)

    def _depths(self, epoch: int) -> str:
        return f"{self.folder}/depths/{epoch}"

    def _mark(self, epoch: int) -> None:
        self.spark.createDataFrame([(epoch,)], "epoch long").coalesce(1).write.mode("append").parquet(f"{self.folder}/done")
        self.done = epoch

    @property
    def depths(self) -> DataFrame:
        return self.spark.read.schema("v long, depth long").parquet(self._depths(self.done))

    @property
    def edges(self) -> DataFrame:
        return self.spark.read.schema("src long, dst long").option("recursiveFileLookup", "true").parquet(f"{self.folder}/edges")

    def update(self, batch: DataFrame, epoch: int) -> None:
        if epoch <= self.done:  # a batch that is given again after a failure
            return
        slice_ = f"{self.folder}/edges/{epoch}"
        batch.select("src", "dst").where("src <> dst").distinct().write.mode("overwrite").parquet(slice_)
        now = self.depths
        new = self.spark.read.schema("src long, dst long").parquet(slice_)
        changed = self._relaxed(new, now, now)
        while not changed.isEmpty():
            now = kept(now.unionByName(changed).groupBy("v").agg(F.min("depth").alias("depth")), "stream-depths")
            changed = self._relaxed(self.edges, changed, now)
        now.write.mode("overwrite").parquet(self._depths(epoch))
        before = self.done
        self._mark(epoch)
        remove(self.spark, self._depths(before))

    def _relaxed(self, edges: DataFrame, frontier: DataFrame, now: DataFrame) -> DataFrame:
        told = edges.join(frontier.withColumnRenamed("v", "src"), "src").groupBy(F.col("dst").alias("v")).agg((F.min("depth") + 1).alias("depth"))
        old = now.select("v", F.col("depth").alias("old"))
        return kept(told.join(old, "v", "left").where(F.col("old").isNull() | (F.col("depth") < F.col("old"))).select("v", "depth"), "stream-frontier")

    def graph(self) -> Graph:
        return Graph.of(self.edges.distinct())
