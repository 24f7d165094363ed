"""Packing: shortest-pack-first over the length histogram.

Token counts are cut into pieces of at most ``capacity``; the histogram of piece lengths has
at most ``capacity`` entries however many documents there are. Lengths are placed longest
first, each onto the packing pattern with the most room left, and only pattern *counts* are
updated. A piece then finds its place by its rank among the pieces of its length.

Nulls and empty texts make the closing id alone (length 1). A null doc_id is a document like
any other. Repeated rows each get their own places. An empty table gives no rows.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Tables, indexed, map_arrow, slices

CAPACITY = 4096
END_ID = 2
#: Entries of a worker's word cache; beyond it words are encoded each time they occur.
CACHE_WORDS = 500_000

_STATE: dict = {}


class WordEncoder:
    """Ids of whole texts, one blank-free chunk at a time.

    The tokenizer never joins anything across white space, so a text's ids are those of its chunks.
    Plain Latin words go straight to the tokenizer's BPE model; everything else through its
    whole pipeline.
    """

    def __init__(self, path: str):
        import os

        import regex
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        self.ids: dict[str, np.ndarray] = {}
        self.plain = regex.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?*$%&#]*)")
        alphabet = ByteLevel(add_prefix_space=False, use_regex=False)
        self.visible = {c: alphabet.pre_tokenize_str(c)[0][0] for c in map(chr, range(0xC0, 0x100))}
        self.direct = all(self._direct(x) == self.whole.encode(x, add_special_tokens=False).ids for x in ("The", "Éléa.", "straße,", "x", "over!!", "a***", "von$$$"))

    def _direct(self, chunk: str) -> list[int] | None:
        found = self.plain.fullmatch(chunk)
        if not found:
            return None
        word = found[1].lower()
        if not word.isascii():
            word = "".join(self.visible.get(c, c) for c in word)
        ids = [t.id for t in self.model.tokenize(word)]
        return ids + [t.id for t in self.model.tokenize(found[2])] if found[2] else ids

    def chunks(self, words: list[str]) -> list[np.ndarray]:
        out = [self.ids.get(w) for w in words]
        slow = []
        for k, got in enumerate(out):
            if got is None:
                ids = self._direct(words[k]) if self.direct else None
                if ids is None:
                    slow.append(k)
                else:
                    out[k] = self.keep(words[k], ids)
        for at in range(0, len(slow), 4096):
            part = slow[at : at + 4096]
            for k, e in zip(part, self.whole.encode_batch_fast([words[k] for k in part], add_special_tokens=False), strict=True):
                out[k] = self.keep(words[k], e.ids)
        return out

    def keep(self, word: str, ids: list[int]) -> np.ndarray:
        got = np.array(ids, np.uint32)
        if len(self.ids) < CACHE_WORDS and len(word) <= 40:
            self.ids[word] = got
        return got

    def texts(self, column: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text, with the closing id."""
        split = pc.ascii_split_whitespace(pc.fill_null(column.cast(pa.large_string()), ""))
        words = split.flatten()
        bounds = np.concatenate([[0], np.cumsum(pc.list_value_length(split).to_numpy(zero_copy_only=False))]).astype(np.int64)
        coded = words.dictionary_encode()
        parts = self.chunks(coded.dictionary.to_pylist())
        sizes = np.array([len(x) for x in parts], np.int64)
        starts = np.concatenate([[0], np.cumsum(sizes)])
        flat = np.concatenate(parts) if parts else np.zeros(0, np.uint32)
        which = coded.indices.to_numpy(zero_copy_only=False)
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            w = which[a:b]
            n = sizes[w]
            total = int(n.sum())
            out = np.empty(total + 1, np.uint32)
            out[total] = END_ID
            if total:
                before = np.cumsum(n) - n
                out[:total] = flat[np.repeat(starts[w] - before, n) + np.arange(total)]
            yield out


def encoder(path: str) -> WordEncoder:
    if _STATE.get("path") != path:
        _STATE.update(path=path, encoder=WordEncoder(path))
    return _STATE["encoder"]


PIECES = "doc_id long, start long, length int, ids_crc32 long, doc_tokens long"


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """One row per piece of at most ``capacity`` ids; ``with_ids`` adds the ids themselves."""

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(tokenizer_path)
        for batch in batches:
            for part in slices(batch, "text"):
                rows: dict[str, list] = {k: [] for k in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids")}
                for doc_id, ids in zip(part.column("doc_id").to_pylist(), coder.texts(part.column("text")), strict=True):
                    ids = ids.astype("<u4", copy=False)
                    for start in range(0, len(ids), capacity):
                        own = ids[start : start + capacity]
                        rows["doc_id"].append(doc_id)
                        rows["start"].append(start)
                        rows["length"].append(len(own))
                        rows["ids_crc32"].append(zlib.crc32(own.tobytes()))
                        rows["doc_tokens"].append(len(ids))
                        if with_ids:
                            rows["ids"].append(own.astype(np.int32))
                kinds = {"doc_id": pa.int64(), "start": pa.int64(), "length": pa.int32(), "ids_crc32": pa.int64(), "doc_tokens": pa.int64()} | ({"ids": pa.list_(pa.int32())} if with_ids else {})
                yield pa.RecordBatch.from_arrays([pa.array(rows[k], t) for k, t in kinds.items()], names=list(kinds))

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), cut, PIECES + (", ids array<int>" if with_ids else ""))


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> tuple[dict[int, list[tuple[int, int, int]]], int]:
    """For each length the runs (first rank, first sequence, offset) of its pieces; and the number of sequences.

    A pattern is a stack of equal sequences; placing a length on part of a stack splits it, so each
    length adds two stacks at most: over 2 * capacity stacks can't arise, whatever the corpus' size.
    """
    room: dict[int, list[tuple[int, int]]] = {}  # room left -> stacks (first sequence, count)
    spaces: list[int] = []  # sorted keys of room
    runs: dict[int, list[tuple[int, int, int]]] = {}
    made = 0

    def push(space: int, first: int, count: int) -> None:
        if space not in room:
            room[space] = []
            spaces.insert(bisect_right(spaces, space), space)
        room[space].append((first, count))

    for length in sorted(histogram, reverse=True):
        left, rank, own = histogram[length], 0, runs.setdefault(length, [])
        later: list[tuple[int, int, int]] = []
        while left and spaces and spaces[-1] >= length:
            space = spaces[-1]
            first, count = room[space].pop()
            if not room[space]:
                del room[space]
                spaces.pop()
            used = min(count, left)
            own.append((rank, first, capacity - space))
            # the shortest pack may take the same length again once the others are as full
            push(space - length, first, used)
            if used < count:
                push(space, first + used, count - used)
            left -= used
            rank += used
        if left:
            fit = capacity // length
            full, rest = divmod(left, fit)
            if full:
                for k in range(fit):
                    own.append((rank, made, k * length))
                    rank += full
                later.append((capacity - fit * length, made, full))
                made += full
            for k in range(rest):
                own.append((rank, made, k * length))
                rank += 1
            if rest:
                later.append((capacity - rest * length, made, 1))
                made += 1
        for x in later:
            push(*x)
    return runs, made


def pack(spark: SparkSession, cut: DataFrame, capacity: int = CAPACITY, tables: Tables | None = None) -> DataFrame:
    """Adds sequence_id and offset to pieces (doc_id, start, length, ...)."""
    tables = tables or Tables(spark)
    cut = tables.put("cut", cut)  # range partitioning samples its input first: the ids are made once
    rows, _ = indexed(tables, "pieces", cut, ["length", "doc_id", "start", "ids_crc32"], "pos")
    histogram = {r["length"]: r["count"] for r in rows.groupBy("length").count().collect()}  # capacity rows at most
    runs, _ = plan(histogram, capacity)
    first = np.zeros(capacity + 2, np.int64)
    for length in range(1, capacity + 1):
        first[length + 1] = first[length] + histogram.get(length, 0)
    # all runs in order of (length, rank), i.e. of the global position: one search finds a piece's run
    keys, seqs, offs = [], [], []
    for length in sorted(runs):
        for rank, seq, off in runs[length]:
            keys.append(first[length] + rank)
            seqs.append(seq)
            offs.append(off)
    shared = spark.sparkContext.broadcast((np.array(keys, np.int64), np.array(seqs, np.int64), np.array(offs, np.int64)))
    others = [f for f in cut.schema.fields]

    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, seq, off = shared.value
        for batch in batches:
            pos = batch.column("pos").to_numpy(zero_copy_only=False)
            run = np.searchsorted(at, pos, side="right") - 1
            yield pa.RecordBatch.from_arrays(
                [batch.column(f.name) for f in others] + [pa.array(seq[run] + pos - at[run]), pa.array(off[run])],
                names=[*(f.name for f in others), "sequence_id", "offset"],
            )

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in others)
    return map_arrow(rows, place, f"{schema}, sequence_id long, offset long")


def pack_documents(spark: SparkSession, docs: DataFrame, tokenizer_path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset of every piece."""
    if tokenizer_path is None:
        import public_tokenizers

        tokenizer_path = public_tokenizers.path("word_bpe_49k.json")
    return pack(spark, pieces(docs, tokenizer_path, capacity), capacity).select(
        "doc_id", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "doc_tokens", "sequence_id", "offset"
    )
