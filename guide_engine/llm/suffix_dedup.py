"""Exact removal of repeated byte strings by prefix doubling over names of windows.

Prefix doubling gives every position a rank for the string of length L that starts there, makes the rank
for 2L from the pair of ranks at distance L, and stops with positions whose rank is unique. Here
ranks are 64-bit names: the names of 1, 2, 4, ... 32, 50, 100 and 200 bytes are pairs of
names of half the length, so a text's own names need no shuffle, and Spark sorts only to find which names
are unique. Positions leave as early as they can:

1. All 200-byte windows that contain the same least 50-byte name (in a fixed random order) form one
   row, a *run* of about 76 windows. Equal windows have equal keys, so runs whose
   key is unique hold no repeat and leave.
2. Of the others, runs whose whole span is repeated are repeated as a whole.
3. For what is left (the borders of repeated passages), one run standing for all with its span, up to CORE
   windows are ranked by the bytes they share, and leave if those are unique; the rest each by its 200 bytes.

Names within a key are compared only with each other, so a chance collision needs two different
windows that share a 50-byte string. Every window is compared with all others of the corpus, whatever their number.

A null text is empty. Rows are told apart by doc_id and a 64-bit hash of the text (without doc_id by two such
hashes), so repeated rows are one text that occurs often, and repeat each other.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import U64, Tables, map_arrow, mix64, raw_bytes, slices, splitmix

LENGTH, ANCHOR = 200, 50
REACH = LENGTH - ANCHOR  # a window holds REACH + 1 anchors
SEGMENT = 1 << 20
ROWS = 1 << 16  # named strings in a batch
CORE = 19  # windows that stand or fall together before each is ranked by itself
_BYTES = splitmix(21, 256)
_A, _B = U64(0x9E3779B97F4A7C15), U64(0xC2B2AE3D27D4EB4F)


def pair(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The name of two strings in a row from their names."""
    x = left * _A + right
    return (x ^ (x >> U64(32))) * _B


def anchor_names(raw: np.ndarray) -> np.ndarray:
    """Names of the ANCHOR bytes at each position."""
    h, n = _BYTES[raw], 1
    while 2 * n <= ANCHOR:
        h = pair(h[:-n], h[n:])
        n *= 2
    return mix64(pair(h[: len(raw) - ANCHOR + 1], h[ANCHOR - n : len(raw) - n + 1]))


def window_names(names: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Names of the LENGTH bytes at given positions, doubled from those of ANCHOR bytes."""
    return pair(pair(names[at], names[at + 50]), pair(names[at + 100], names[at + 150]))


def least(names: np.ndarray) -> np.ndarray:
    """The least of the REACH + 1 names from each position on."""
    width, m = 1, names
    while 2 * width <= REACH + 1:
        m = np.minimum(m[:-width], m[width:])
        width *= 2
    rest = REACH + 1 - width
    return np.minimum(m[: len(m) - rest], m[rest:]) if rest else m


def runs_of(raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs of windows with one key: text, first window in the text, count, key, span name, whether the key occurs twice in it."""
    parts: list[tuple[np.ndarray, ...]] = []
    with np.errstate(over="ignore"):
        for first, last in _segments(bounds):
            own = raw[bounds[first[0]] + first[1] : bounds[last[0]] + last[1]]
            if len(own) < LENGTH:
                continue
            names = anchor_names(own)
            key = least(names)
            n = len(key)
            # texts of the segment; a window must not leave its text
            edges = np.concatenate([[0], bounds[first[0] + 1 : last[0] + 1] - bounds[first[0]] - first[1]]) if last[0] > first[0] else np.array([0])
            doc = np.zeros(n + 1, np.int64)
            np.add.at(doc, edges[1:][edges[1:] <= n], 1)
            doc = np.cumsum(doc)[:n]
            ends = np.append(edges[1:], len(own))
            inside = np.arange(n) + LENGTH <= ends[doc]
            new = inside.copy()
            new[1:] &= (key[1:] != key[:-1]) | (doc[1:] != doc[:-1]) | ~inside[:-1]
            start = np.flatnonzero(new)
            if not len(start):
                continue
            stop = np.flatnonzero(inside & ~np.append(inside[1:] & ~new[1:], False)) + 1
            count = stop - start
            long = np.maximum(1, -(-count // (REACH + 1)))
            if long.max() > 1:
                which = np.repeat(np.arange(len(start)), long)
                step = np.arange(len(which)) - np.repeat(np.cumsum(long) - long, long)
                begin = start[which] + step * (REACH + 1)
                count = np.minimum(stop[which] - begin, REACH + 1)
                start = begin
            twice = np.zeros(len(start), bool)
            span = np.arange(REACH + 1)
            for k in range(0, len(start), 8192):
                s, c = start[k : k + 8192], count[k : k + 8192]
                left = s + names[s[:, None] + span].argmin(1)
                right = s + c - 1 + REACH - names[(s + c - 1)[:, None] + span[::-1]].argmin(1)
                twice[k : k + 8192] = left != right
            name = mix64(pair(window_names(names, start), window_names(names, start + count - 1)) + count.astype(U64))
            d = doc[start]
            base = np.where(d == 0, -first[1], edges[d])
            parts.append((first[0] + d, start - base, count, key[start], name, twice))
    if not parts:
        return (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, U64), np.zeros(0, U64), np.zeros(0, bool))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _segments(bounds: np.ndarray) -> Iterator[tuple[tuple[int, int], tuple[int, int]]]:
    """((text, offset), (text, end)) of stretches of bounded size; a long text's stretches overlap by a window less one."""
    i, n = 0, len(bounds) - 1
    while i < n:
        size = bounds[i + 1] - bounds[i]
        if size > SEGMENT:
            for at in range(0, size - LENGTH + 1, SEGMENT):
                yield (i, at), (i, int(min(size, at + SEGMENT + LENGTH - 1)))
            i += 1
            continue
        j = i
        while j < n and bounds[j + 1] - bounds[i] <= SEGMENT:
            j += 1
        yield (i, 0), (j - 1, int(bounds[j] - bounds[j - 1]))
        i = j


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    # the seed comes first: hashes that only end in one would collide together
    own = F.coalesce("doc_id", F.xxhash64(F.lit(7), "text"))
    return rows.select("doc_id", own.alias("doc"), F.xxhash64(F.lit(11), "text").alias("alt"), "text")


def _i64(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64) if x.dtype == U64 else x.astype(np.int64))


def repeated_spans(spark: SparkSession, docs: DataFrame, tables: Tables | None = None) -> DataFrame:
    """(doc, alt, spans): stretches [first window, number of windows] of each text that are repeated, in no order."""
    tables = tables or Tables(spark)
    keyed = _keyed(docs)

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SEGMENT):
                text, at, count, key, name, twice = runs_of(*raw_bytes(part.column("text")))
                where = pa.array(text)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc").take(where), part.column("alt").take(where), _i64(at), pa.array(count.astype(np.int16)), _i64(key), _i64(name), pa.array(twice)],
                    names=["doc", "alt", "at", "n", "key", "name", "twice"],
                )

    runs = tables.put("runs", map_arrow(keyed.select("doc", "alt", "text"), scan, "doc long, alt long, at long, n short, key long, name long, twice boolean"))
    keys = tables.put("keys", runs.groupBy("key").agg(F.count("*").alias("c"), F.max("twice").alias("t")).where("c > 1 or t").select("key"))
    kept = tables.put("kept", runs.join(keys, "key"))
    tables.drop("runs", "keys")

    spans = kept.groupBy("key", "name").agg(F.count("*").alias("c"), F.max("twice").alias("t"), F.min(F.struct("doc", "alt", "at", "n")).alias("one"))
    spans = tables.put("spans", spans)
    whole = kept.join(spans.where("c > 1").select("key", "name"), ["key", "name"]).select("doc", "alt", "at", "n")
    whole = tables.put("whole", whole)
    open_keys = tables.put("open", spans.groupBy("key").agg(F.count("*").alias("k"), F.max("t").alias("t")).where("k > 1 or t").select("key"))
    rest = spans.join(open_keys, "key").select("one.*", "key", (F.col("c") == 1).alias("single"))
    rest = tables.put("rest", rest.groupBy("doc", "alt").agg(F.collect_list(F.struct("at", "n", "key", "single")).alias("todo")))
    tables.drop("kept", "open", "spans")

    def stretches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The parts of the texts that open runs lie in, each with its runs."""
        for batch in batches:
            raw, bounds = raw_bytes(batch.column("text"))
            todo = batch.column("todo")
            rows: list[tuple] = []
            for i in range(batch.num_rows):
                own = todo[i].values
                at, n = (own.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in ("at", "n"))
                order = np.argsort(at, kind="stable")
                at, n = at[order], n[order]
                for part in _near(at, n):
                    low, high = int(at[part][0]), int((at + n)[part].max()) + LENGTH - 1
                    runs = own.take(pa.array(order[part]))
                    rows.append((batch.column("doc")[i].as_py(), batch.column("alt")[i].as_py(), low, raw[bounds[i] + low : bounds[i] + high].tobytes(), runs))
            for k in range(0, len(rows), 512):
                some = rows[k : k + 512]
                ends = np.concatenate([[0], np.cumsum([len(r[4]) for r in some])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[j] for r in some], t) for j, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.binary()))] + [pa.ListArray.from_arrays(pa.array(ends), pa.concat_arrays([r[4] for r in some]))],
                    names=["doc", "alt", "low", "bytes", "runs"],
                )

    # a repeated row's copies have equal runs: one of them stands in ``rest``, so any will do
    wide = rest.join(keyed, ["doc", "alt"]).dropDuplicates(["doc", "alt"]).select("doc", "alt", "text", "todo")
    run_type = "array<struct<at: bigint, n: smallint, key: bigint, single: boolean>>"
    parts = tables.put("parts", map_arrow(wide, stretches, f"doc long, alt long, low long, bytes binary, runs {run_type}"))

    def expand(fine: bool):
        """Rows of named strings of the runs: cores shared by up to CORE windows, or each window by itself."""

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, size = [], 0
            for one in named(batches):
                held.append(one)
                size += one.num_rows
                if size >= ROWS:
                    yield pa.concat_batches(held)
                    held, size = [], 0
            if held:
                yield pa.concat_batches(held)

        def named(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    text = np.frombuffer(batch.column("bytes")[i].as_buffer(), np.uint8)
                    low = batch.column("low")[i].as_py()
                    own = batch.column("runs")[i].values
                    at, n = (own.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in ("at", "n"))
                    key, single = (own.field(k).to_numpy(zero_copy_only=False) for k in ("key", "single"))
                    with np.errstate(over="ignore"):
                        names = anchor_names(text)
                        which = np.repeat(np.arange(len(at)), n)
                        pos = np.repeat(at - low - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
                        if fine:
                            count, got = np.ones(len(pos), np.int16), window_names(names, pos)
                        else:
                            pos, count, which, got = cores(names, pos, which)
                    m = len(pos)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(key[which]), _i64(got), pa.repeat(batch.column("doc")[i], m), pa.repeat(batch.column("alt")[i], m), pa.repeat(batch.column("low")[i], m), pa.array(pos + low), pa.array(count.astype(np.int16)), pa.array(single[which])],
                        names=["key", "name", "doc", "alt", "low", "at", "n", "single"],
                    )

        return run

    row = "key long, name long, doc long, alt long, low long, at long, n short, single boolean"

    def repeated(rows: DataFrame, name: str) -> DataFrame:
        again = rows.groupBy("key", "name").agg(F.count("*").alias("c")).where("c > 1").select("key", "name")
        return rows.join(tables.put(name, again), ["key", "name"])

    coarse = tables.put("coarse", map_arrow(parts, expand(False), row))
    left = repeated(coarse, "cores").groupBy("doc", "alt", "low").agg(F.collect_list(F.struct("at", "n", "key", "single")).alias("runs"))
    left = tables.put("left", left)
    tables.drop("coarse", "cores", "rest")
    each = left.join(parts.drop("runs"), ["doc", "alt", "low"]).select("doc", "alt", "low", "bytes", "runs")
    each = tables.put("each", map_arrow(each, expand(True), row))
    edge = repeated(each, "again").where("single").select("doc", "alt", "at", "n")
    marks = tables.put("marks", whole.union(edge).groupBy("doc", "alt").agg(F.collect_set(F.struct("at", "n")).alias("spans")))
    tables.drop("whole", "parts", "left", "each", "again")
    return marks


def cores(names: np.ndarray, pos: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, ...]:
    """Windows put together by what they share: first window, count, run, name of the shared bytes.

    A window's key stands at an offset that only its own bytes decide (the first least name in it). Windows of a run whose
    offsets fall in one range of CORE share all but CORE - 1 bytes; equal windows have equal shared bytes.
    """
    anchor = np.empty(len(pos), np.int64)
    span = np.arange(REACH + 1)
    for k in range(0, len(pos), 1 << 14):
        p = pos[k : k + (1 << 14)]
        anchor[k : k + (1 << 14)] = p + names[p[:, None] + span].argmin(1)
    band = (anchor - pos) // CORE
    first = np.append(True, (which[1:] != which[:-1]) | (anchor[1:] != anchor[:-1]) | (band[1:] != band[:-1]))
    at = np.flatnonzero(first)
    count = np.diff(np.append(at, len(pos)))
    begin = anchor[at] - CORE * band[at]
    size = LENGTH - CORE + 1
    name = pair(pair(names[begin], names[begin + 50]), pair(names[begin + 100], names[begin + size - ANCHOR]))
    return pos[at], count, which[at], mix64(name + band[at].astype(U64))


def _near(at: np.ndarray, n: np.ndarray) -> list[slice]:
    """Cut sorted runs where the next one starts beyond the reach of the names, or after a bounded stretch."""
    out, begin = [], 0
    for k in range(1, len(at) + 1):
        if k == len(at) or at[k] > at[k - 1] + n[k - 1] + LENGTH or at[k] - at[begin] > SEGMENT:
            out.append(slice(begin, k))
            begin = k
    return out


def covered(at: np.ndarray, n: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal removed runs [start, end) from repeated windows."""
    order = np.argsort(at, kind="stable")
    start = at[order]
    end = np.minimum(np.maximum.accumulate(start + n[order] + LENGTH - 1), size)
    new = np.append(True, start[1:] > end[:-1])
    last = np.append(np.flatnonzero(new)[1:] - 1, len(start) - 1)
    return start[new], end[last]


def op3_query(spark: SparkSession, docs: DataFrame) -> DataFrame:
    marks = repeated_spans(spark, docs)

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, bounds = raw_bytes(batch.column("text"))
            spans = batch.column("spans")
            removed, count, digest = [], [], []
            for i in range(batch.num_rows):
                text, own = raw[bounds[i] : bounds[i + 1]], spans[i]
                kept = hashlib.sha256()
                if not own.is_valid:
                    removed.append(0)
                    count.append(0)
                    kept.update(text)
                else:
                    at, n = (own.values.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in ("at", "n"))
                    start, end = covered(at, n, len(text))
                    removed.append(int((end - start).sum()))
                    count.append(len(start))
                    for a, b in zip(np.append(0, end), np.append(start, len(text)), strict=True):
                        kept.update(text[a:b])
                digest.append(kept.hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), _i64(np.diff(bounds)), pa.array(removed, pa.int64()), pa.array(count, pa.int64()), pa.array(digest, pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    rows = _keyed(docs).join(marks, ["doc", "alt"], "left").select("doc_id", "text", "spans")
    return map_arrow(rows, cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
