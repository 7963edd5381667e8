"""Helpers shared by the corpus operators."""

from __future__ import annotations

import ctypes
import sys
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from ..session import ensure_checkpoint_dir

SLICE_BYTES = 2 << 20
BATCH_BYTES_KEY, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "8m"
CLEANUP_KEY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def new_folder(spark: SparkSession, name: str) -> str:
    """A new folder beside the checkpoints, which all executors share; it goes when the driver ends."""
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return folder


def store(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as a table to the shared folder and read again, so that a lost executor redoes nothing before.

    Its shuffle files go once it is written, not when the driver happens to collect its garbage; what the submitter has
    set stays.
    """
    folder, conf = new_folder(df.sparkSession, name), df.sparkSession.conf
    unset = conf.get(CLEANUP_KEY, None) is None
    if unset:
        conf.set(CLEANUP_KEY, "true")
    try:
        df.write.parquet(folder)
    finally:
        if unset:
            conf.unset(CLEANUP_KEY)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def sql_type(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


def slices(batches: Iterator[pa.RecordBatch], text: int = 1, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that the texts of a slice stay near ``size`` bytes (a longer text is a slice of its own)."""
    for batch in batches:
        column = batch.column(text)
        lengths = np.asarray(pc.fill_null(pc.binary_length(column), 0), dtype=np.int64)
        block = (np.cumsum(lengths) - 1) // size
        cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            if b > a:
                yield batch.slice(a, b - a)


def bound_batches(spark: SparkSession) -> None:
    """Texts go to Python in batches of bounded bytes too, not of rows alone; what the submitter has set stays."""
    if spark.conf.get(BATCH_BYTES_KEY, None) is None:
        spark.conf.set(BATCH_BYTES_KEY, BATCH_BYTES)


def give_back() -> None:
    """Return freed memory of this worker to the machine: workers wait for later tasks beside those that run."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
        if trim:
            trim(0)


def as_bytes(column: pa.Array) -> list[bytes | None]:
    return column.cast(pa.binary()).to_pylist()


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (two multiply and shift rounds)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class Rolling:
    """Hashes of every run of ``width`` values, from prefix sums of ``value * base ** position`` modulo 2**64."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def _powers(self, n: int) -> None:
        while len(self.up) < n:
            k = len(self.up)
            self.up = np.concatenate([self.up, self.up * np.uint64(pow(self.base, k, 1 << 64))])
            self.down = np.concatenate([self.down, self.down * np.uint64(pow(self.inverse, k, 1 << 64))])

    def _sums(self, values: np.ndarray) -> np.ndarray:
        n = len(values)
        self._powers(n + 1)
        sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(values * self.up[:n], out=sums[1:])
        return sums

    def __call__(self, values: np.ndarray, width: int) -> np.ndarray:
        if len(values) < width:
            return np.empty(0, dtype=np.uint64)
        sums = self._sums(values)
        return mix64((sums[width:] - sums[:-width]) * self.down[: len(values) - width + 1])

    def stretches(self, values: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """Hashes of stretches of any lengths."""
        sums = self._sums(values)
        return mix64((sums[stop] - sums[start]) * self.down[start] + (stop - start).astype(np.uint64))


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours."""
    if len(values) < width:
        return values[:0]
    out, span = values, 1
    while span * 2 <= width:
        out, span = np.minimum(out[:-span], out[span:]), span * 2
    rest = width - span
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out
