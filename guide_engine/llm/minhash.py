"""b-bit MinHash near-duplicates with exact confirmation.

1. Every text becomes its set of word shingles; equal sets collapse into a class (counted by a
   plain aggregate, so thousands of copies cost one row each and no pairs).
2. A class has minima of HASHES hash functions: ROWS of them make a band key, and the low
   four bits of all are packed into a signature. There are as many bands as a pair at the threshold
   needs to share a key but for a chance of MISS.
3. Star round: within a bucket each class meets one pivot, the member whose buckets are fullest.
   Signatures' bit counts give a collision-corrected estimate; pairs over the margin are confirmed
   on the full sets. Components follow.
4. Only pairs in a bucket that are still in different components remain. Buckets are compared
   signature by signature in tiles of bounded size (a pair only in the first band it shares); what passes the margin
   is confirmed on full sets, block against block, and each block yields at most a spanning forest.

Rows are told apart even if they share a doc_id: each has the component of its own text, and classes have ids of
their own. A text that is null or has no words has an empty set and links with nothing; a row with a null doc_id too (component_id null, kept).
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import U64, Tables, map_arrow, mix64, raw_bytes, shingle_hashes, slices, splitmix, word_hashes
from .graph import components

ROWS, HASHES, BITS, MISS = 5, 192, 4, 1e-6
LANES = HASHES * BITS // 64
#: Members of a bucket that are compared in one task, and classes whose sets one task holds at a side.
TILE, BLOCK = 1024, 256


def bands_for(threshold: float) -> int:
    """The fewest bands that a pair at the threshold misses with a chance of MISS at most, as far as the minima go."""
    return min(HASHES // ROWS, int(np.ceil(np.log(MISS) / np.log1p(-(threshold**ROWS))))) if threshold < 1 else 1


def margin(threshold: float, hashes: int = HASHES, bits: int = BITS, sigmas: float = 5.0) -> int:
    """The most lanes that may differ: the estimate lies ``sigmas`` deviations under the threshold."""
    chance = 2.0**-bits
    agree = chance + (1 - chance) * threshold
    return int(np.ceil(hashes * (1 - agree) + sigmas * np.sqrt(hashes * agree * (1 - agree))))


def estimate(differ, hashes: int = HASHES, bits: int = BITS):
    """Jaccard similarity from the number of differing lanes, corrected for chance agreement."""
    chance = 2.0**-bits
    return (1 - differ / hashes - chance) / (1 - chance)


_LANE = U64(0x1111111111111111)


def differing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Lanes that differ between packed signatures (..., LANES) of uint64."""
    x = a ^ b
    x |= x >> U64(1)
    x |= x >> U64(2)
    return np.bitwise_count(x & _LANE).sum(-1, dtype=np.int32)


def sets_of(column: pa.Array, size: int) -> list[np.ndarray]:
    raw, bounds = raw_bytes(column)
    return [np.unique(shingle_hashes(word_hashes(raw[a:b])[0], size)) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


def set_hashes(sets: list[np.ndarray]) -> np.ndarray:
    """Two hashes of each set, whatever the order of its members; zero for the empty set."""
    count = np.array([len(s) for s in sets], np.int64)
    full = np.flatnonzero(count)
    out = np.zeros((len(sets), 2), U64)
    if len(full):
        flat, starts = np.concatenate([sets[i] for i in full]), np.cumsum(count[full]) - count[full]
        with np.errstate(over="ignore"):
            out[full, 0] = np.add.reduceat(mix64(flat), starts)
            out[full, 1] = np.add.reduceat(mix64(flat ^ U64(0xA5A5A5A5A5A5A5A5)), starts)
    return out


def sketches(docs: DataFrame, size: int, n_bands: int) -> DataFrame:
    """doc_id, row, n_shingles, two hashes of the set, its band keys and packed signature, from doc_id, row and text."""
    mult = splitmix(11, HASHES) | U64(1)
    add = splitmix(12, HASHES)
    shift = (np.arange(HASHES) % (64 // BITS) * BITS).astype(U64)

    def sketch(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 4 << 20):
                sets = sets_of(part.column("text"), size)
                count = np.array([len(s) for s in sets], np.int64)
                full = np.flatnonzero(count)
                n = len(full)
                minima = np.zeros((n, HASHES), U64)
                ones = set_hashes(sets)
                with np.errstate(over="ignore"):
                    if n:
                        flat = np.concatenate([sets[i] for i in full])
                        starts = np.cumsum(count[full]) - count[full]
                        for k in range(HASHES):
                            minima[:, k] = np.minimum.reduceat(flat * mult[k] + add[k], starts)
                    keys = np.zeros((n, n_bands), U64)
                    for j in range(ROWS):
                        keys = mix64(keys * U64(0x9FB21C651E98DF25) + minima[:, j * n_bands : (j + 1) * n_bands])
                    keys = mix64(keys + np.arange(n_bands, dtype=U64))
                    lanes = (mix64(minima) & U64((1 << BITS) - 1)) << shift
                    packed = np.bitwise_or.reduce(lanes.reshape(n, LANES, -1), axis=2) if n else np.zeros((0, LANES), U64)
                width = np.zeros(len(sets), bool)
                width[full] = True

                def lists(values: np.ndarray, per: int) -> pa.Array:
                    ends = np.concatenate([[0], np.cumsum(width * per)]).astype(np.int32)
                    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values.reshape(-1).view(np.int64)))

                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("row"), pa.array(count), pa.array(ones[:, 0].view(np.int64)), pa.array(ones[:, 1].view(np.int64)), lists(keys, n_bands), lists(packed, LANES)],
                    names=["doc_id", "row", "n_shingles", "h1", "h2", "bands", "sig"],
                )

    return map_arrow(docs, sketch, "doc_id long, row long, n_shingles long, h1 long, h2 long, bands array<long>, sig array<long>")


def full_sets(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, the set's size and hashes, and its sorted shingle hashes."""

    def make(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 4 << 20):
                sets = sets_of(part.column("text"), size)
                ends = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
                flat = np.concatenate(sets) if sets else np.zeros(0, U64)
                ones = set_hashes(sets).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(np.diff(ends).astype(np.int64)), pa.array(ones[:, 0]), pa.array(ones[:, 1]), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.view(np.int64)))],
                    names=["doc_id", "n_shingles", "h1", "h2", "items"],
                )

    return map_arrow(docs.select("doc_id", "text"), make, "doc_id long, n_shingles long, h1 long, h2 long, items array<long>")


class Forest:
    """Union-find over the few ids of one task."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        while (y := self.up.get(x, x)) != x:
            self.up[x] = self.up.get(y, y)
            x = y
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def _overlaps(own: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of a sorted set with several."""
    flat = np.concatenate(others)
    at = np.searchsorted(own, flat)
    hit = np.append(own, own[-1:])[at] == flat
    hit &= at < len(own)
    sizes = np.array([len(x) for x in others])
    return np.add.reduceat(hit, np.cumsum(sizes) - sizes, dtype=np.int64)


def intersections(items: list[np.ndarray], left: np.ndarray, right: np.ndarray, columns: int = 4096) -> np.ndarray:
    """Sizes of the intersections of pairs of sets: one by one for a few pairs, else as a product of incidence matrices."""
    if len(left) < 4 * len(items):
        return np.array([_overlaps(items[i], [items[j]])[0] for i, j in zip(left, right, strict=True)], np.int64)
    rows = np.repeat(np.arange(len(items)), [len(x) for x in items])
    _, which, count = np.unique(np.concatenate(items), return_inverse=True, return_counts=True)
    shared = count > 1
    number = np.cumsum(shared) - 1
    keep = shared[which]
    rows, which = rows[keep], number[which[keep]]
    order = np.argsort(which, kind="stable")
    rows, which = rows[order], which[order]
    out = np.zeros((len(items), len(items)), np.float64)
    for first in range(0, int(shared.sum()), columns):  # a bounded part of the vocabulary at a time
        a, b = np.searchsorted(which, [first, first + columns])
        part = np.zeros((len(items), columns), np.float32)
        part[rows[a:b], which[a:b] - first] = 1
        out += part @ part.T
    return out[left, right].astype(np.int64)


def near_duplicates(spark: SparkSession, docs: DataFrame, size: int = 5, threshold: int = 80, tables: Tables | None = None, row: str | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: classes of Jaccard ``threshold`` hundredths on ``size``-word shingles.

    With ``row``, a column that numbers the rows, also row and component, a number of the component.
    """
    tables = tables or Tables(spark)
    slack = margin(threshold / 100)
    number = F.col(f"`{row}`").cast("long") if row else F.lit(0).cast("long")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), number.alias("row"), F.col("text").cast("string").alias("text"))
    all_rows = tables.put("sketches", sketches(docs, size, bands_for(threshold / 100)))
    rows = all_rows.where("doc_id is not null and n_shingles > 0")
    group = ["h1", "h2", "n_shingles"]
    classes = rows.groupBy(*group).agg(F.min("doc_id").alias("rep"))
    classes = tables.put("classes", classes.withColumn("node", F.monotonically_increasing_id()))

    # band keys of one row a class
    reps = classes.select(F.col("rep").alias("doc_id"), *group, F.col("node").alias("doc"))
    one = rows.join(reps, ["doc_id", *group]).dropDuplicates(["doc_id", *group])
    one = tables.put("one", one.select("doc", "n_shingles", "bands", "sig"))
    keyed = one.select("doc", F.explode("bands").alias("key"))
    buckets = tables.put("buckets", keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"))
    members = tables.put("members", keyed.join(buckets, "key"))

    score = members.groupBy("doc").agg(F.sum("n").alias("score"))
    ranked = tables.put("ranked", members.join(score, "doc"))
    pivots = ranked.groupBy("key").agg(F.max_by("doc", F.struct("score", -F.col("doc"))).alias("pivot"))
    star = ranked.join(pivots, "key").where("doc <> pivot").select(F.least("doc", "pivot").alias("a"), F.greatest("doc", "pivot").alias("b")).distinct()
    sig = one.select("doc", "n_shingles", "sig").join(score.select("doc"), "doc")
    sig = tables.put("sig", sig)
    lane = "bit_count((v | shiftrightunsigned(v, 1) | shiftrightunsigned(v, 2) | shiftrightunsigned(v, 3)) & 1229782938247303441L)"
    near = (
        star.join(sig.toDF("a", "na", "sa"), "a")
        .join(sig.toDF("b", "nb", "sb"), "b")
        .where(F.expr(f"100 * least(na, nb) >= {threshold} * greatest(na, nb)"))
        .where(F.expr(f"aggregate(transform(zip_with(sa, sb, (x, y) -> x ^ y), v -> {lane}), 0, (s, x) -> s + x) <= {slack}"))
    )
    near = tables.put("near", near.select("a", "b"))

    # full sets of the classes that share a bucket
    wanted = reps.join(sig.select("doc"), "doc")
    text = docs.select("doc_id", "text").join(wanted.select("doc_id"), "doc_id", "left_semi")
    sets = full_sets(text, size).dropDuplicates(["doc_id", *group]).join(wanted, ["doc_id", *group])
    sets = tables.put("sets", sets.select("doc", "items"))
    both = near.join(sets.toDF("a", "ia"), "a").join(sets.toDF("b", "ib"), "b")
    links = tables.put("links", _confirmed(both, threshold))
    labels = tables.put("labels", components(tables, links, "star"))

    rest = _rest(tables, ranked, one, buckets, labels, sets, threshold, slack)
    final = tables.put("final", components(tables, links.union(rest), "all"))
    least = final.toDF("node", "component").join(classes.select("node", "rep"), "node")
    least = least.join(least.groupBy("component").agg(F.min("rep").alias("component_id")), "component").select("node", "component", "component_id")
    known = classes.join(least, "node", "left").select(*group, F.coalesce("component", "node").alias("component"), F.coalesce("component_id", "rep").alias("component_id"))
    known = tables.put("known", known)
    out = all_rows.select("doc_id", "row", *group).join(known, group, "left")
    linked = F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0)
    component = F.when(linked, F.col("component_id")).otherwise(F.col("doc_id"))
    result = out.select("doc_id", "n_shingles", component.alias("component_id"), "row", F.when(linked, F.col("component")).alias("component"))
    result = result.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    tables.drop("one", "buckets", "members", "ranked", "sig", "near", "sets", "links", "labels", "final", "classes")
    return result if row else result.drop("row", "component")


def _confirmed(pairs: DataFrame, threshold: int) -> DataFrame:
    def confirm(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = batch.column("ia"), batch.column("ib")
            keep = np.zeros(batch.num_rows, bool)
            for i in range(batch.num_rows):
                x, y = (c[i].values.to_numpy(zero_copy_only=False).view(U64) for c in (left, right))
                both = int(_overlaps(x, [y])[0])
                keep[i] = 100 * both >= threshold * (len(x) + len(y) - both)
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(pa.array(keep)), batch.column("b").filter(pa.array(keep))], names=["a", "b"])

    return map_arrow(pairs.select("a", "b", "ia", "ib"), confirm, "a long, b long")


def _rest(tables: Tables, ranked: DataFrame, one: DataFrame, buckets: DataFrame, labels: DataFrame, sets: DataFrame, threshold: int, slack: int) -> DataFrame:
    """Links between components of the star round, as spanning edges."""
    labelled = ranked.join(labels.toDF("doc", "label"), "doc", "left").select("key", "doc", "n", F.coalesce("label", "doc").alias("label"))
    labelled = tables.put("labelled", labelled)
    # a bucket of two was settled by its pivot
    mixed = labelled.where("n > 2").groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("key")
    mixed = tables.put("mixed", mixed)
    inside = labelled.join(mixed, "key")
    # blocks hold classes that share a bucket, about BLOCK each: those of a fullest bucket, split by its size
    full = inside.groupBy("doc").agg(F.max(F.struct("n", "key")).alias("full"))
    part = F.pmod(F.xxhash64("doc", F.lit(3)), F.ceil(F.col("full.n") / BLOCK))
    place = tables.put("place", full.select("doc", F.xxhash64("full.key", part).alias("block")))
    tiles = F.ceil(F.col("n") / TILE).cast("int")
    row = inside.withColumn("tiles", tiles).withColumn("own", F.pmod(F.xxhash64("doc"), F.col("tiles")).cast("int"))
    row = row.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    row = row.select("key", F.least("own", "other").alias("t"), F.greatest("own", "other").alias("u"), "own", "doc", "label").join(one, "doc").join(place, "doc")

    def compare(key, frame: pd.DataFrame) -> pd.DataFrame:
        """Each member's partners, by block: over the margin, of another component, first met in this band."""
        _, t, u = key
        frame = frame.sort_values("doc", kind="stable")
        sig = np.stack(frame["sig"].to_numpy()).view(U64)
        bands = np.stack(frame["bands"].to_numpy())
        at = int(np.flatnonzero(bands[0] == key[0])[0])
        doc, label, n, own, block = (frame[c].to_numpy() for c in ("doc", "label", "n_shingles", "own", "block"))
        out: list[tuple] = []
        for i in range(len(doc)):
            js = i + 1 + np.flatnonzero((label[i + 1 :] != label[i]) & (100 * np.minimum(n[i + 1 :], n[i]) >= threshold * np.maximum(n[i + 1 :], n[i])))
            if t != u:
                js = js[own[js] != own[i]]
            if len(js):
                js = js[differing(sig[js], sig[i]) <= slack]
            if len(js) and at:
                js = js[~(bands[js, :at] == bands[i, :at]).any(1)]
            for other in np.unique(block[js]):
                out.append((min(block[i], other), max(block[i], other), doc[i], doc[js[block[js] == other]]))
        return pd.DataFrame(out, columns=["block_a", "block_b", "a", "partners"])

    listed = row.groupBy("key", "t", "u").applyInPandas(compare, "block_a long, block_b long, a long, partners array<long>")
    listed = tables.put("listed", listed)
    blocks = listed.select("block_a", "block_b").distinct().withColumn("block", F.explode(F.array_distinct(F.array("block_a", "block_b"))))
    sides = blocks.join(place.join(sets, "doc"), "block").select("block_a", "block_b", "doc", "items").toDF("side_a", "side_b", "doc", "items")

    def verify(listing: pd.DataFrame, members: pd.DataFrame) -> pd.DataFrame:
        """A spanning forest of the listed pairs that the full sets confirm."""
        if not len(listing):
            return pd.DataFrame({"a": [], "b": []})
        place = {d: i for i, d in enumerate(members["doc"])}
        items = [np.asarray(x).view(U64) for x in members["items"]]
        left = np.repeat(np.array([place[d] for d in listing["a"]]), [len(p) for p in listing["partners"]])
        right = np.array([place[d] for p in listing["partners"] for d in p])
        both = intersections(items, left, right)
        sizes = np.array([len(x) for x in items])
        good = 100 * both >= threshold * (sizes[left] + sizes[right] - both)
        forest, ids = Forest(), members["doc"].to_numpy()
        return pd.DataFrame([(a, b) for a, b in zip(ids[left[good]].tolist(), ids[right[good]].tolist(), strict=True) if forest.join(a, b)], columns=["a", "b"])

    return tables.put("rest", listed.groupBy("block_a", "block_b").cogroup(sides.groupBy("side_a", "side_b")).applyInPandas(verify, "a long, b long"))


def keep_one(spark: SparkSession, docs: DataFrame, size: int = 5, threshold: int = 80) -> DataFrame:
    """One row of each component: of those with the smallest id the first one met; rows with a null id or without words stay."""
    tables = Tables(spark)
    row = next(n for k in range(len(docs.columns) + 1) if (n := f"_row{k}") not in docs.columns)
    numbered = tables.put("numbered", docs.withColumn(row, F.monotonically_increasing_id()))
    found = near_duplicates(spark, numbered, size, threshold, tables, row).where("component is not null").select("component", "doc_id", "row")
    first = found.groupBy("component").agg(F.min(F.struct("doc_id", "row")).alias("first")).select("component", F.col("first.row").alias("kept_row"))
    # the first of a component of one needs no word: only the others are looked up
    gone = tables.put("gone", found.join(first, "component").where("row <> kept_row").select(F.col("row").alias(row)))
    tables.drop("sketches", "known")
    return numbered.join(gone, row, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def op4_query(spark: SparkSession, docs: DataFrame) -> DataFrame:
    return near_duplicates(spark, docs, size=3, threshold=85)
