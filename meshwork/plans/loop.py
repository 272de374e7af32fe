"""Rounds of DataFrame jobs: tables in the shared folder, and a record of each round.

State of a round is a table dealt by its key into as many buckets as the edges have, so that in a round only messages
are shuffled: neither edges nor state. A round's table is removed once the next is written.
"""

from __future__ import annotations

import itertools
import time
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Rows of a bucket on average, where a table has more than the session's shuffle partitions could hold so.
BUCKET_ROWS = 4_000_000
_made: list[tuple[str, str | None]] = []


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A fresh folder under spark.checkpoint.dir, where all executors can write.

    Where that is unset, a folder under the warehouse serves in local mode; on a cluster it is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_shared"
    return f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str, name: str | None = None) -> None:
    """Deletes a folder and the table over it, if it has a name."""
    if name:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    if (path, name) in _made:
        _made.remove((path, name))


def sweep(spark: SparkSession) -> int:
    """Removes all that this module has written and not removed yet: call it when results have been read."""
    for path, name in (found := list(_made)):
        remove(spark, path, name)
    return len(found)


@dataclass
class Round:
    round: int
    frontier: int
    elapsed_ms: float
    edges: int = 0


@dataclass
class Rounds:
    """What a run did: a Round each, and the workload, the vertices processed in all."""

    rounds: list[Round] = field(default_factory=list)

    @property
    def workload(self) -> int:
        return sum(r.frontier for r in self.rounds)

    def to_df(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(r.round, r.frontier, r.elapsed_ms) for r in self.rounds], "round int, frontier long, elapsed_ms double")


def mean_rounds(records: Sequence[Rounds], spark: SparkSession) -> DataFrame:
    """round, runs, frontier, elapsed_ms: means over several runs of one algorithm; a last row of round -1 has the totals."""
    rows = [(r.round, r.frontier, r.elapsed_ms) for run in records for r in run.rounds]
    totals = [(-1, run.workload, sum(r.elapsed_ms for r in run.rounds)) for run in records]
    told = spark.createDataFrame(rows + totals, "round int, frontier long, elapsed_ms double")
    return told.groupBy("round").agg(F.count(F.lit(1)).alias("runs"), F.avg("frontier").alias("frontier"), F.avg("elapsed_ms").alias("elapsed_ms"))


def _told(observation: Observation, df: DataFrame, aggregates: list) -> dict:
    """What was observed; where the plan was found to be empty, and so nothing was, it is counted."""
    try:
        return observation.get
    except Py4JError:
        return df.agg(*aggregates).first().asDict()


class Trail:
    """A table that grows by a written slice each round. Slices are never rewritten; reading gives all so far."""

    def __init__(self, spark: SparkSession, purpose: str):
        self.spark, self.path, self.slices = spark, shared_folder(spark, purpose), []
        _made.append((self.path, None))

    def append(self, rows: DataFrame) -> DataFrame:
        path, told = f"{self.path}/slice{len(self.slices):06d}", Observation()
        one = F.count(F.lit(1)).alias("n")
        rows.observe(told, one).write.parquet(path)
        self.schema = rows.schema
        self.slices.append(path)
        found = self.read(-1)
        self.n = _told(told, found, [one])["n"]  # rows of the slice, counted as they were written
        return found

    def read(self, index: int) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.slices[index])

    def all(self, first: int = 0) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*self.slices[first:])


def kept(df: DataFrame, purpose: str) -> DataFrame:
    """Written to the shared folder and read back."""
    return Trail(df.sparkSession, purpose).append(df)


@dataclass(frozen=True)
class Dealt:
    """A table in the shared folder whose rows are dealt by keys to buckets: joins on the keys don't shuffle it."""

    df: DataFrame
    path: str
    name: str
    buckets: int
    #: what was observed while it was written
    told: dict

    def drop(self) -> None:
        remove(self.df.sparkSession, self.path, self.name)


def dealt(df: DataFrame, keys: Sequence[str], purpose: str, buckets: int, **observed) -> Dealt:
    """Writes df dealt by the keys: a file a bucket, since rows are first shuffled by the same hash (unless they are
    dealt so). observed: aggregates that are told on the way, besides n, the number of rows."""
    spark, told = df.sparkSession, Observation()
    aggregates = [F.count(F.lit(1)).alias("n"), *[c.alias(k) for k, c in observed.items()]]
    df = df.observe(told, *aggregates)
    path, name = shared_folder(spark, purpose), f"meshwork_{uuid.uuid4().hex}"
    _made.append((path, name))
    df.repartition(buckets, *keys).write.format("parquet").bucketBy(buckets, *keys).option("path", path).saveAsTable(name)
    return Dealt(found := spark.table(name), path, name, buckets, _told(told, found, aggregates))


def buckets_for(spark: SparkSession, rows: int) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // BUCKET_ROWS))


def iterate(state: DataFrame, step: Callable[[DataFrame, int], DataFrame], active: Callable[[int], object], purpose: str, max_rounds: int | None = None, buckets: int | None = None) -> tuple[DataFrame, Rounds]:
    """Applies step to the state, which has a key v, until no row is active; raises when rows are active after max_rounds.

    active(round) is a Boolean column over the state. Each round's state is written, dealt by v, and the one before is
    removed: a lost executor costs a round's work at most, and plans stay small.
    """
    record = Rounds()
    buckets = buckets or buckets_for(state.sparkSession, 0)
    held = dealt(state, ["v"], purpose, buckets, active=F.count_if(active(0)))
    n = held.told["active"]
    for k in itertools.count():
        if not n:
            return held.df, record
        if max_rounds is not None and k >= max_rounds:
            raise RuntimeError(f"{purpose}: {n} rows are active after {max_rounds} rounds")
        began = time.perf_counter()
        after = dealt(step(held.df, k), ["v"], purpose, buckets, active=F.count_if(active(k + 1)))
        left = after.told["active"]
        held.drop()
        held = after
        record.rounds.append(Round(k, n, (time.perf_counter() - began) * 1000))
        n = left
