"""Benchmark decontamination by pigeonhole pieces and Myers' bit-parallel distance.

An item with an error budget of e edits is cut into e + 1 pieces: a text within e edits of it holds one
piece unchanged. All pieces of all items form one Aho-Corasick automaton that runs once over every
whole text; around each hit the item is verified by Myers' algorithm on words as long as the
item. Texts are compared in lower case with runs of white space as one space.

The items are broadcast in blocks of at most BLOCK_BYTES, one pass over the documents a block, so a
larger benchmark costs more passes and not more memory. Items shorter than SHORT characters
have no budget and count only as whole words. Null or empty texts and items match nothing; a row of documents with a null doc_id is matched like any other.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import keep_rows, map_arrow

PER_EDIT = 16
SHORT = 32
BLOCK_BYTES = 8 << 20
_SPACE = re.compile(r"\s+")


def normal(text: str | None) -> str:
    return _SPACE.sub(" ", text.lower()).strip() if text else ""


def budget(length: int) -> int:
    return 0 if length < SHORT else length // PER_EDIT


def pieces(item: str, errors: int) -> list[tuple[int, str]]:
    """errors + 1 pieces of near equal length with their offsets."""
    n, k = len(item), errors + 1
    cuts = [i * n // k for i in range(k + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def peq(pattern: str) -> dict[str, int]:
    masks: dict[str, int] = {}
    for i, c in enumerate(pattern):
        masks[c] = masks.get(c, 0) | 1 << i
    return masks


def myers(masks: dict[str, int], m: int, text: str) -> tuple[int, int]:
    """Least edit distance of the pattern to any substring of ``text``, and the end of the first best one."""
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best, end = full, 0, m, m, 0
    for j, c in enumerate(text, 1):
        eq = masks.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (full & ~(xh | pv))
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph = ph << 1 & full
        mh = mh << 1 & full
        pv = mh | (full & ~(xv | ph))
        mv = ph & xv
        if score < best:
            best, end = score, j
            if not best:
                break
    return best, end


class Matcher:
    def __init__(self, items: list[tuple[int, str]]):
        import ahocorasick

        self.items = [(i, t, budget(len(t)), peq(t)) for i, t in items]
        found: dict[str, list[tuple[int, int]]] = {}
        for k, (_, text, errors, _) in enumerate(self.items):
            for offset, piece in pieces(text, errors):
                found.setdefault(piece, []).append((k, offset))
        self.automaton = ahocorasick.Automaton()
        for piece, where in found.items():
            self.automaton.add_word(piece, (len(piece), where))
        if found:
            self.automaton.make_automaton()

    def matches(self, text: str) -> list[tuple[int, int, int]]:
        """(item_id, distance, end) of each item found in a normal text; end is in its characters."""
        spans: dict[int, list[list[int]]] = {}
        if not text or not len(self.automaton):
            return []
        for end, (size, where) in self.automaton.iter(text):
            for k, offset in where:
                _, item, errors, _ = self.items[k]
                a = max(0, end + 1 - size - offset - errors)
                b = end + 1 - size - offset + len(item) + errors
                own = spans.setdefault(k, [])
                if own and a <= own[-1][1]:  # hits of one item in a row are verified together
                    own[-1][0] = min(own[-1][0], a)
                    own[-1][1] = max(own[-1][1], b)
                else:
                    own.append([a, b])
        out = []
        for k, own in spans.items():
            item_id, item, errors, masks = self.items[k]
            best: tuple[int, int] | None = None
            if len(item) < SHORT:
                hit = re.search(rf"(?<!\w){re.escape(item)}(?!\w)", text)
                best = (0, hit.end()) if hit else None
            else:
                at = text.find(item)
                if at >= 0:
                    best = (0, at + len(item))
                else:
                    for a, b in own:
                        distance, end = myers(masks, len(item), text[a:b])
                        if distance <= errors and (best is None or distance < best[0]):
                            best = (distance, a + end)
            if best:
                out.append((item_id, *best))
        return out


_MATCHERS: dict = {}

FOUND = "doc_id long, item_id long, distance int, end long"


def _blocks(benchmark: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """Items in blocks of bounded size, never more than one block on the driver."""
    block, size = [], 0
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    for r in rows.where("text is not null").toLocalIterator():
        text = normal(r["text"])
        if text:
            if block and size + len(text) * 4 > BLOCK_BYTES:
                yield block
                block, size = [], 0
            block.append((r["item_id"], text))
            size += len(text) * 4
    if block:
        yield block


def _matcher(key: str, shared) -> Matcher:
    if key not in _MATCHERS:
        _MATCHERS.clear()
        _MATCHERS[key] = Matcher(shared.value)
    return _MATCHERS[key]


def leaks(spark: SparkSession, docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, distance and end (in the normal text) of every item that a document holds within its budget."""
    import uuid

    out = None
    for block in _blocks(benchmark):
        shared, key = spark.sparkContext.broadcast(sorted(block, key=lambda x: (x[0] is None, x[0] or 0, x[1]))), uuid.uuid4().hex

        def search(batches: Iterable[pa.RecordBatch], shared=shared, key=key) -> Iterator[pa.RecordBatch]:
            matcher = _matcher(key, shared)
            for batch in batches:
                rows = []
                for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                    rows += [(doc_id, *x) for x in matcher.matches(normal(text.as_py()))]
                columns = list(zip(*rows, strict=True)) or [[]] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.int64()), strict=True)], names=["doc_id", "item_id", "distance", "end"])

        found = map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), search, FOUND)
        out = found if out is None else out.union(found)
    return spark.createDataFrame([], FOUND) if out is None else out


def clean(spark: SparkSession, docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no item, with all their columns, in one pass a block of items."""
    import uuid

    for block in _blocks(benchmark):
        shared, key = spark.sparkContext.broadcast(block), uuid.uuid4().hex

        def free(texts: pa.Array, shared=shared, key=key) -> list[bool]:
            matcher = _matcher(key, shared)
            return [not matcher.matches(normal(t.as_py())) for t in texts]

        docs = keep_rows(docs, free)
    return docs
