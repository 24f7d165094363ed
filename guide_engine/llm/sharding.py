"""Sharding along a Hilbert curve over quantised metadata.

Every document becomes a point (language, source, length class); points are ordered along the
curve, and the order is cut into runs. Documents that are close in all dimensions share a run, so
the ranges kept per run let a reader skip files on any of the dimensions. Strings are quantised by
the top bits of their crc32 (equal values share a cell), lengths by their binary logarithm.

A null dimension takes cell 0; a null text has size 1 and crc32 0, like an empty one. Ties on the
curve are broken by crc32, doc_id and size; repeated rows are numbered one after the other.
An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Tables, indexed

BITS = 5
DIMENSIONS = ("lang", "source", "size")


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Curve index of integer points (n, dims), each coordinate under 2**bits."""
    x = cells.astype(np.int64).T.copy()
    dims = len(x)
    for level in range(bits - 1, 0, -1):
        q, low = 1 << level, (1 << level) - 1
        for i in range(dims):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(high, low, swap)
            x[i] ^= swap
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        turn ^= np.where((x[-1] >> level) & 1, (1 << level) - 1, 0)
    x ^= turn
    out = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for i in range(dims):
            out = (out << 1) | ((x[i] >> level) & 1)
    return out


def curve_index(cells: list[Column], bits: int = BITS) -> Column:
    @F.pandas_udf("long")
    def index(points: pd.DataFrame) -> pd.Series:
        return pd.Series(hilbert(points.to_numpy(), bits))

    return index(F.struct(*cells))


def _string_cell(name: str, bits: int) -> Column:
    return F.coalesce(F.shiftright(F.crc32(F.col(name).cast("string").cast("binary")), 32 - bits), F.lit(0)).cast("int")


def points(docs: DataFrame, bits: int = BITS, whole: bool = False) -> DataFrame:
    """doc_id, size, text_crc32, a cell per dimension and the curve index; the row itself as ``doc`` if ``whole``."""
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    size = (F.octet_length(text) + 1).cast("long")
    rows = docs.select(
        F.col("doc_id"),
        size.alias("size"),
        F.crc32(text).alias("text_crc32"),
        _string_cell("lang", bits).alias("q_lang"),
        _string_cell("source", bits).alias("q_source"),
        F.least(F.floor(F.log2(size)), F.lit((1 << bits) - 1)).cast("int").alias("q_size"),
        *([F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc")] if whole else []),
    )
    return rows.withColumn("curve", curve_index([F.col(f"q_{d}") for d in DIMENSIONS], bits))


def shard_runs(spark: SparkSession, docs: DataFrame, shards: int = 8, bits: int = BITS, whole: bool = False) -> DataFrame:
    """Points with shard and slot: runs of the curve order whose counts are at most one apart."""
    tables = Tables(spark)
    rows = tables.put("points", points(docs, bits, whole))
    rows, total = indexed(tables, "order", rows, ["curve", "text_crc32", "doc_id", "size"])
    n = max(total, 1)
    shard = F.floor(F.col("pos") * shards / F.lit(n)) if n * shards < 1 << 52 else F.expr(f"pos * {shards} div {n}")
    first = F.expr(f"(cast(shard as long) * {n} + {shards - 1}) div {shards}")
    return rows.withColumn("shard", shard.cast("int")).withColumn("slot", F.col("pos") - first)


def run_ranges(rows: DataFrame) -> DataFrame:
    """Per shard the row count, bytes and the range of every dimension: what a reader prunes files by."""
    ranges = [f(f"q_{d}").alias(f"{n}_{d}") for d in DIMENSIONS for n, f in (("min", F.min), ("max", F.max))]
    return rows.groupBy("shard").agg(F.count("*").alias("n_rows"), F.sum("size").alias("n_bytes"), *ranges)


def write_shards(spark: SparkSession, docs: DataFrame, path: str, shards: int = 8) -> None:
    """The documents as one folder a shard, in slot order."""
    rows = shard_runs(spark, docs, shards, whole=True).select("shard", "slot", "doc.*")
    rows.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def op1_query(spark: SparkSession, docs: DataFrame) -> DataFrame:
    rows = shard_runs(spark, docs, 8)
    return rows.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
