"""Helpers shared by the training-data operators: table access, shared folders and bulk text hashing."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

U64 = np.uint64
_ODD = U64(0x9E3779B97F4A7C15)
_MIX_1, _MIX_2 = U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh folder under spark.checkpoint.dir, which all executors share.

    Where the setting is absent, a folder under the SQL warehouse serves in local mode (tests on one machine); on a
    cluster that is an error, since the default warehouse is the driver's own disk.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_shared"
    return f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


#: Whether Spark deletes the shuffle files of a query when it ends, instead of when the driver happens to collect garbage.
SWEEP_KEY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def swept(spark: SparkSession):
    """Queries that run within leave no shuffle files."""
    before = spark.conf.get(SWEEP_KEY, None)
    spark.conf.set(SWEEP_KEY, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(SWEEP_KEY)
        else:
            spark.conf.set(SWEEP_KEY, before)


def stored(df: DataFrame, path: str) -> DataFrame:
    """Write and read back; shuffle files go as soon as all is written."""
    with swept(df.sparkSession):
        df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def materialize(df: DataFrame, purpose: str) -> DataFrame:
    """Write to the shared folder and read back: cuts lineage and survives lost executors."""
    return stored(df, shared_dir(df.sparkSession, purpose))


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder that nothing reads any more."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


#: Text that one Arrow batch holds about, where the session sets no bound of its own.
BATCH_KEY, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20


def release() -> None:
    """Gives memory that this worker process has freed back to the system."""
    pa.default_memory_pool().release_unused()
    if (trim := getattr(ctypes.CDLL(None), "malloc_trim", None)) is not None:
        trim(0)


def map_batches(df: DataFrame, run: Callable, kind) -> DataFrame:
    """df.mapInArrow(run, kind) in batches of bounded size; workers, which serve many tasks, give memory back after each."""
    if df.sparkSession.conf.get(BATCH_KEY, None) is None:
        df.sparkSession.conf.set(BATCH_KEY, BATCH_BYTES)

    def whole(batches):
        yield from run(batches)
        release()

    return df.mapInArrow(whole, kind)


def only(df: DataFrame, **columns: str) -> DataFrame:
    """Project to the named columns under fixed names, so that other columns can't clash."""
    return df.select(*[F.col(f"`{src}`").alias(dst) for dst, src in columns.items()])


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finalizer on uint64 arrays."""
    x = x + _ODD
    x = (x ^ (x >> U64(30))) * _MIX_1
    x = (x ^ (x >> U64(27))) * _MIX_2
    return x ^ (x >> U64(31))


def _powers(base: int, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.cumprod(np.concatenate([[U64(1)], np.full(n, U64(base))]), dtype=U64)


class WordHasher:
    """64-bit hashes of all words of a block of documents, by array operations only.

    keep: 256 booleans, the bytes that belong to words. lower: fold A-Z first. A word's hash is a polynomial in
    its bytes, each replaced by a random 64-bit value, followed by a finalizer, so it depends on the bytes alone.
    """

    BASE = 0xD6E8FEB86659FD93
    #: its inverse modulo 2**64
    INVERSE = pow(BASE, -1, 1 << 64)

    def __init__(self, keep: np.ndarray, lower: bool = True):
        self.keep = keep
        rng = np.random.Generator(np.random.PCG64(20240229))
        values = rng.integers(1, 1 << 63, 256, dtype=U64) * U64(2) + U64(1)
        if lower:
            values[65:91] = values[97:123]
        self.values = values
        self.up = self.down = np.zeros(0, U64)

    def _grow(self, n: int) -> None:
        if len(self.up) < n:
            self.up, self.down = _powers(self.BASE, n), _powers(self.INVERSE, n)

    def __call__(self, raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """raw: uint8 of the documents on end; bounds: their n + 1 byte offsets.

        Returns hashes, first byte and end byte of each word, and the n + 1 word offsets of the documents.
        """
        inside = self.keep[raw]
        starts_here = inside.copy()
        ends_here = inside.copy()
        if len(raw):
            starts_here[1:] &= ~inside[:-1]
            ends_here[:-1] &= ~inside[1:]
            cut = bounds[1:-1]
            cut = cut[(cut > 0) & (cut < len(raw))]
            starts_here[cut] = inside[cut]
            ends_here[cut - 1] = inside[cut - 1]
        start, end = np.flatnonzero(starts_here), np.flatnonzero(ends_here) + 1
        self._grow(len(raw) + 1)
        with np.errstate(over="ignore"):
            run = np.concatenate([[U64(0)], np.cumsum(self.values[raw] * self.up[: len(raw)], dtype=U64)])
            hashes = mix64((run[end] - run[start]) * self.down[start] + (end - start).astype(U64))
        return hashes, start, end, np.searchsorted(start, bounds)


def blocks(column: pa.Array, most: int = 1 << 19):
    """Whole documents of a string column in runs of about `most` bytes: (first, count, raw bytes, bounds). Null is empty."""
    column = column.cast(pa.large_binary())
    n = len(column)
    if not n:
        return
    lengths = np.asarray(column.is_valid().to_numpy(zero_copy_only=False), bool)
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    sizes = np.where(lengths, np.diff(offsets), 0)
    first = 0
    while first < n:
        last, total = first, 0
        while last < n and (last == first or total + sizes[last] <= most):
            total += sizes[last]
            last += 1
        if sizes[first:last].sum() == offsets[last] - offsets[first]:
            raw = data[offsets[first] : offsets[last]]
        else:
            raw = np.concatenate([data[offsets[i] : offsets[i] + sizes[i]] for i in range(first, last)] or [data[:0]])
        yield first, last - first, raw, np.concatenate([[0], np.cumsum(sizes[first:last])]).astype(np.int64)
        first = last


def byte_set(test) -> np.ndarray:
    return np.array([bool(test(b)) for b in range(256)])


def annotate(docs: DataFrame, text: str, judge: Callable, fields: dict[str, str], also: tuple[str, ...] = ()) -> DataFrame:
    """All columns of docs and those that judge(text column of a batch) gives, as Arrow arrays in the order of fields.

    also: other columns that judge gets after the text.

    Rows travel as one struct, so names of other columns don't matter and the text travels once; columns of docs named
    as a field are replaced.
    """
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    kinds = T.StructType([rows.schema["row"], *T.StructType.fromDDL(", ".join(f"`{k}` {v}" for k, v in fields.items())).fields])
    places = [docs.columns.index(c) for c in (text, *also)]

    def run(batches):
        for batch in batches:
            row = batch.column(0)
            yield pa.RecordBatch.from_arrays([row, *judge(*[row.field(k) for k in places])], names=["row", *fields])

    out = map_batches(rows, run, kinds)
    return out.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns if c not in fields], *fields)
