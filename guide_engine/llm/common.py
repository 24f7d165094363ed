"""Shared pieces: durable tables, a distributed row index, byte hashing, Arrow slices."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
_MIX_A, _MIX_B = U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB)


# ---------------------------------------------------------------- durable tables


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``. Where it is unset, a new folder if there is one machine only; else an error."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        if sc.master.split("[")[0] != "local":
            raise RuntimeError("spark.checkpoint.dir is unset: tables between phases need a folder that all executors share")
        found = tempfile.mkdtemp(prefix="guide_engine_")
        sc.setCheckpointDir(found)
        found = sc.getCheckpointDir() or found
    return found.rstrip("/")


class Tables:
    """Tables written to the shared folder to cut lineage, so that a lost executor costs one phase.

    ``put`` writes and rereads; ``drop`` deletes tables that no later phase reads and
    lets Spark's cleaner remove the shuffle files of plans that are no longer referenced. What a result
    is still read from goes with ``drop_all`` or, at the latest, with the application.
    """

    #: Those made since a ``passing`` block began.
    made: list[list[Tables]] = []

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/tables-{uuid.uuid4().hex}"
        self.paths: dict[str, str] = {}
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.root)
        store = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        store.mkdirs(path)
        store.deleteOnExit(path)
        for block in self.made:
            block.append(self)

    def put(self, name: str, df: DataFrame) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        self.paths[name] = path
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(self.paths.pop(name))
            path.getFileSystem(conf).delete(path, True)
        gc.collect()
        jvm.System.gc()

    def drop_all(self) -> None:
        self.drop(*self.paths)


@contextmanager
def passing() -> Iterator[None]:
    """Tables that operators make inside the block are dropped at its end: its results must have been written by then."""
    Tables.made.append([])
    try:
        yield
    finally:
        for tables in Tables.made.pop():
            tables.drop_all()


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


# ---------------------------------------------------------------- global row index


def indexed(tables: Tables, name: str, df: DataFrame, keys: list[str], index: str = "pos") -> tuple[DataFrame, int]:
    """``df`` with a gapless 0-based rank of the total order ``keys``, and the number of rows.

    Range partitions are sorted and numbered on their own; only one row count per partition
    comes to the driver. ``keys`` must end in a unique column so that no range is unsplittable.
    """
    rows = (
        df.repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .withColumn("_id", F.monotonically_increasing_id())
        .withColumn("_part", F.shiftright("_id", 33))
        .withColumn("_row", F.col("_id").bitwiseAND((1 << 33) - 1))
        .drop("_id")
    )
    rows = tables.put(name, rows)
    counts = sorted((r["_part"], r["count"]) for r in rows.groupBy("_part").count().collect())
    starts, total = [], 0
    for part, n in counts:
        starts.append((part, total))
        total += n
    if not starts:
        return rows.withColumn(index, F.col("_row")).drop("_part", "_row"), 0
    offsets = tables.spark.createDataFrame(starts, "_part long, _start long")  # one row per partition
    out = rows.join(F.broadcast(offsets), "_part").withColumn(index, F.col("_start") + F.col("_row"))
    return out.drop("_part", "_row", "_start"), total


# ---------------------------------------------------------------- numpy hashing


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64 (splitmix64)."""
    x = (x ^ (x >> U64(30))) * _MIX_A
    x = (x ^ (x >> U64(27))) * _MIX_B
    return x ^ (x >> U64(31))


def splitmix(seed: int, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix64(U64(seed) + np.arange(1, n + 1, dtype=U64) * U64(0x9E3779B97F4A7C15))


#: x^0x09-0x0D and space
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_BYTE = splitmix(1, 256)
_BASE = 0x5851F42D4C957F2D  # odd: invertible modulo 2**64
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(1, U64)
    with np.errstate(over="ignore"):
        while len(out) < n:
            out = np.concatenate([out, out * U64(pow(base, len(out), 1 << 64))])
    return out[:n]


_POW = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, at least ``n`` of each."""
    if "n" not in _POW or _POW["n"] < n:
        size = max(1 << 20, 1 << int(n).bit_length())
        _POW.update(n=size, up=_powers(_BASE, size), down=_powers(pow(_BASE, -1, 1 << 64), size))
    return _POW["up"], _POW["down"]


def word_hashes(raw: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the words ``[^\\x20\\x09-\\x0D]+`` of UTF-8 bytes, with their first and end offsets."""
    n = len(raw)
    if not n:
        return np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    blank = _BLANK[raw]
    edge = np.flatnonzero(np.diff(np.concatenate([[True], blank, [True]]).view(np.int8)))
    first, end = edge[::2], edge[1::2]
    up, down = powers(n)
    with np.errstate(over="ignore"):
        terms = _BYTE[_LOWER[raw] if lower else raw] * up[:n]
        sums = np.concatenate([np.zeros(1, U64), np.cumsum(terms, dtype=U64)])
        words = mix64((sums[end] - sums[first]) * down[first] + (end - first).astype(U64))
    return words, first, end


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of the word n-grams in order; fewer words than ``size`` make one shingle, none make none."""
    n = len(words)
    if n == 0:
        return np.zeros(0, U64)
    size = min(n, size)
    with np.errstate(over="ignore"):
        out = np.full(n - size + 1, U64(size))
        for k in range(size):
            out = mix64(out * U64(0x9FB21C651E98DF25) + words[k : n - size + 1 + k])
    return out


# ---------------------------------------------------------------- Arrow


def slices(batch: pa.RecordBatch, column: str | int, budget: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows whose ``column`` holds about ``budget`` bytes (one row at least)."""
    text = batch.column(column)
    n = batch.num_rows
    lengths = np.zeros(n, np.int64)
    if n:
        lengths = pa.compute.binary_length(text).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    start, held = 0, 0
    for i in range(n):
        if i > start and held + lengths[i] > budget:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += int(lengths[i])
    if start < n:
        yield batch.slice(start)


def raw_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column end to end, and n+1 offsets (null: empty)."""
    column = pa.compute.fill_null(column, "").cast(pa.large_binary())
    bounds = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]] if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, bounds - bounds[0]


def _release() -> None:
    """Give a worker's freed memory back to the system: workers live on between stages."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # another C library


def map_arrow(df: DataFrame, fn: Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """``mapInArrow`` whose workers keep no more than their code and caches once a partition is done."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from fn(batches)
        finally:
            _release()

    return df.mapInArrow(run, schema)


def keep_rows(df: DataFrame, keep: Callable[[pa.Array], np.ndarray], column: str = "text") -> DataFrame:
    """The rows whose text ``keep`` says True of, with all their columns, a bounded number of bytes at a time."""
    at = df.columns.index(column)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, at, 2 << 20):
                yield part.filter(pa.array(np.asarray(keep(part.column(at).cast(pa.string())), bool)))

    return map_arrow(df, run, df.schema)


def crc_label_fold(col: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 5: 0 is held out."""
    return F.crc32(F.col(col).cast("string").cast("binary")) % 5
