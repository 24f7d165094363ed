"""Approximate nearest neighbours by cosine: a hierarchical k-means tree searched best bin first.

The tree is fitted on a bounded sample (SAMPLE rows by a hash of the id) and indexes every row. A
query walks the tree with a priority queue of subtrees by distance to their centres, which gives it an
order of leaves. How many leaves are visited is calibrated: for at most PROBES queries the exact
neighbours are found by a full pass, and the visits widen until the mean recall reaches TARGET. A query whose leaves
hold too few ids goes on until they hold k besides its own, or to the last leaf.

Leaves and the queries that visit them are cut into chunks of bounded size by a hash of the id, so a leaf that
holds many copies of one vector is shared out. Scores are the double-precision cosine of the original vectors,
summed in one fixed order, so copies tie exactly and go by vec_id.

Rows with a null id, and vectors that are null, zero, of another length than most, or hold null or non-finite
components take no part. Rows with an equal id are one candidate with the best of their scores, and one query by
the greatest of their vectors (component by component).
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Tables, map_arrow

SAMPLE, PROBES, TARGET = 60_000, 200, 0.97
LEAF_ROWS, MAX_LEAVES, BRANCH = 128, 6144, 8
CHUNK = 4096
BESIDE = 16  # leaves that are searched together


@dataclass
class Node:
    centres: np.ndarray | None = None
    children: list = field(default_factory=list)
    leaf: int = -1


def k_means(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    centres = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        near = (x @ centres.T - 0.5 * (centres**2).sum(1)).argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        count = np.bincount(near, minlength=k)
        centres = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], centres)
    return centres, (x @ centres.T - 0.5 * (centres**2).sum(1)).argmax(1)


class Tree:
    def __init__(self, sample: np.ndarray, leaves: int):
        self.n_leaves = 0
        self.root = self._grow(sample, max(1.0, len(sample) / max(1, leaves)), np.random.default_rng(5))

    def _grow(self, x: np.ndarray, target: float, rng: np.random.Generator) -> Node:
        if len(x) > max(1.5 * target, 2):
            centres, near = k_means(x, min(BRANCH, len(x), max(2, round(len(x) / target))), rng)
            kinds = np.unique(near)
            if len(kinds) > 1:
                return Node(centres[kinds], [self._grow(x[near == k], target, rng) for k in kinds])
        self.n_leaves += 1
        return Node(leaf=self.n_leaves - 1)

    def leaves_of(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x), np.int32)
        todo = [(self.root, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if node.leaf >= 0:
                out[rows] = node.leaf
                continue
            near = (x[rows] @ node.centres.T - 0.5 * (node.centres**2).sum(1)).argmax(1)
            todo += [(child, rows[near == k]) for k, child in enumerate(node.children) if (near == k).any()]
        return out

    def visits(self, q: np.ndarray, most: int, held: np.ndarray | None = None, need: int = 0) -> list[int]:
        """Leaves in the order of a best-bin-first walk: ``most`` of them, and more until they hold ``need`` ids."""
        heap: list[tuple[float, int, Node]] = [(0.0, 0, self.root)]
        found: list[int] = []
        pushed = covered = 0
        while heap and (len(found) < most or covered < need):
            bound, _, node = heapq.heappop(heap)
            while node.leaf < 0:
                gap = ((node.centres - q) ** 2).sum(1)
                best = int(gap.argmin())
                for k, child in enumerate(node.children):
                    if k != best:
                        pushed += 1
                        heapq.heappush(heap, (float(gap[k]), pushed, child))
                node = node.children[best]
            found.append(node.leaf)
            if held is not None:
                covered += int(held[node.leaf])
        return found


def _matrix(column: pa.Array, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows that take part, and their vectors in double precision."""
    size = pc.list_value_length(column).fill_null(-1).to_numpy(zero_copy_only=False)
    rows = np.flatnonzero(size == dims)
    if dims < 1 or not len(rows):
        return np.zeros(0, np.int64), np.zeros((0, max(dims, 1)))
    x = pc.list_flatten(column.take(pa.array(rows))).cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, dims)
    good = np.isfinite(x).all(1)
    good[good] &= (x[good] != 0).any(1)
    norm = np.sqrt((x[good] * x[good]).sum(1))
    fine = np.isfinite(norm) & (norm > 0)
    return rows[good][fine], x[good][fine]


def cosines(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    return (x * q).sum(1) / (np.sqrt((x * x).sum(1)) * np.sqrt((q * q).sum()))


def best(q_id: int, q: np.ndarray, rough: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k nearest by exact score and id, from scores that may be off in the last bits; ids, scores and rows.

    The cut widens until it holds k ids, so copies of an id take one place.
    """
    free = np.flatnonzero(ids != q_id)
    s = rough[free]
    most = k
    while most < len(free):
        held = free[s >= np.partition(s, len(s) - most)[len(s) - most] - 1e-9]
        if len(np.unique(ids[held])) >= k:
            free = held
            break
        most *= 4
    exact = cosines(q, x[free])
    order = np.lexsort((ids[free], -exact))
    free, exact = free[order], exact[order]
    _, first = np.unique(ids[free], return_index=True)
    first = np.sort(first)[:k]
    return ids[free[first]], exact[first], free[first]


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(1))[:, None]


def nearest(spark: SparkSession, table: DataFrame, k: int = 5, every: int = 50, target: float = TARGET, sample: int = SAMPLE, probes: int = PROBES, max_leaves: int = MAX_LEAVES) -> DataFrame:
    """query_id, rank, vec_id, score for the rows whose id ``every`` divides."""
    tables = Tables(spark)
    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).where("vec_id is not null and embedding is not null")
    out = "query_id long, rank int, vec_id long, score double"
    total = rows.count()
    if not total:
        return spark.createDataFrame([], out)

    def draw(x: DataFrame, n: int, count: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
        bound = (1 << 63) - 1 if count <= n else int(2**64 * (n / count)) - (1 << 63)
        # one row an id, before anything comes here: copies can't outgrow the bound
        found = x.where(F.xxhash64("vec_id", F.lit(seed)) <= bound).groupBy("vec_id").agg(F.max("embedding").alias("embedding")).toArrow().combine_chunks()
        if not found.num_rows:
            return np.zeros(0, np.int64), np.zeros((0, 1))
        column = found.column("embedding").combine_chunks()
        sizes = pc.list_value_length(column).to_numpy(zero_copy_only=False)
        dims = int(np.bincount(sizes).argmax())
        at, m = _matrix(column, dims)
        ids = found.column("vec_id").to_numpy()[at]
        order = np.argsort(ids, kind="stable")[: 2 * n]
        return ids[order], m[order]

    _, fit = draw(rows, sample, total, 23)
    if not len(fit):
        return spark.createDataFrame([], out)
    dims = fit.shape[1]
    tree = Tree(_unit(fit), min(max_leaves, max(1, total // LEAF_ROWS)))
    asked = rows.where(F.col("vec_id") % every == 0)
    probe_ids, probe = draw(asked, probes, asked.count(), 29)
    if not len(probe_ids):
        return spark.createDataFrame([], out)
    if probe.shape[1] != dims:
        probe_ids, probe = probe_ids[:0], np.zeros((0, dims))
    shared = spark.sparkContext.broadcast((tree, dims, probe_ids, probe))

    def index(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, dims, _, _ = shared.value
        for batch in batches:
            at, x = _matrix(batch.column("embedding"), dims)
            leaf = tree.leaves_of(_unit(x)) if len(at) else np.zeros(0, np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id").take(pa.array(at)), pa.array(leaf), batch.column("embedding").take(pa.array(at))], names=["vec_id", "leaf", "embedding"])

    indexed = tables.put("rows", map_arrow(rows, index, "vec_id long, leaf int, embedding array<double>"))

    def probed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, dims, probe_ids, probe = shared.value
        for batch in batches:
            at, x = _matrix(batch.column("embedding"), dims)
            ids = batch.column("vec_id").to_numpy(zero_copy_only=False)
            leaf = batch.column("leaf").to_numpy(zero_copy_only=False)
            rough = _unit(probe) @ _unit(x).T if len(x) else np.zeros((len(probe), 0))
            found = [best(a, q, rough[i], ids, x, k) for i, (a, q) in enumerate(zip(probe_ids, probe, strict=True))]
            rows = np.concatenate([f[2] for f in found]) if found else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(probe_ids, [len(f[0]) for f in found]).astype(np.int64)), pa.array(ids[rows].astype(np.int64)), pa.array(np.concatenate([f[1] for f in found]) if found else np.zeros(0)), pa.array(leaf[rows].astype(np.int32))],
                names=["query_id", "vec_id", "score", "leaf"],
            )

    near = F.row_number().over(_by_query())
    exact = map_arrow(indexed, probed, "query_id long, vec_id long, score double, leaf int").groupBy("query_id", "vec_id").agg(F.max(F.struct("score", "leaf")).alias("top"))
    exact = exact.select("query_id", "vec_id", "top.score", "top.leaf").withColumn("rank", near).where(F.col("rank") <= k).select("query_id", "leaf").collect()  # PROBES * k rows at most
    most = calibrate(tree, probe_ids, _unit(probe), [(r["query_id"], r["leaf"]) for r in exact], target)

    # every id counts in one leaf; a row a leaf comes to the driver, and the tree's size is bounded by the sample
    in_leaf = np.zeros(tree.n_leaves, np.int64)
    for r in indexed.groupBy("vec_id").agg(F.min("leaf").alias("leaf")).groupBy("leaf").count().collect():
        in_leaf[r["leaf"]] = r["count"]

    def walk(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A query's leaves by their neighbourhood: leaves are numbered along the tree, BESIDE of them make one."""
        tree, dims, _, _ = shared.value
        for batch in batches:
            at, x = _matrix(batch.column("embedding"), dims)
            which, near, seen = [], [], []
            for i, q in zip(at.tolist(), _unit(x), strict=True):
                path = np.sort(np.array(tree.visits(q, most, in_leaf, k + 1), np.int32))
                for g in np.unique(path // BESIDE):
                    which.append(i)
                    near.append(g)
                    seen.append(path[path // BESIDE == g])
            take = pa.array(which, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("vec_id").take(take), batch.column("embedding").take(take), pa.array(near, pa.int32()), pa.array(seen, pa.list_(pa.int32()))], names=["query_id", "query", "near", "leaves"])

    queries = indexed.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.max("embedding").alias("embedding"))
    queries = tables.put("queries", map_arrow(queries.select("vec_id", "embedding"), walk, "query_id long, query array<double>, near int, leaves array<int>"))

    # one row a neighbourhood of leaves: the tree's size is bounded by the sample
    beside = F.floor(F.col("leaf") / BESIDE).cast("int").alias("near")
    held = indexed.groupBy(beside).agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("parts"))
    seen = queries.groupBy("near").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("sides"))
    cuts = F.broadcast(held.join(seen, "near"))
    left = indexed.withColumn("near", beside).join(cuts, "near").withColumn("part", F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int"))
    left = left.withColumn("side", F.explode(F.sequence(F.lit(0), F.col("sides") - 1))).select("near", "part", "side", "leaf", "vec_id", "embedding")
    right = queries.join(cuts, "near").withColumn("side", F.pmod(F.xxhash64("query_id"), F.col("sides")).cast("int"))
    right = right.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select(F.col("near").alias("l"), F.col("part").alias("p"), F.col("side").alias("s"), "query_id", "query", "leaves")

    def search(own: pd.DataFrame, ask: pd.DataFrame) -> pd.DataFrame:
        if not len(own) or not len(ask):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        x, q = np.stack(own["embedding"].to_numpy()), np.stack(ask["query"].to_numpy())
        ids, unit, leaf, leaves = own["vec_id"].to_numpy(), _unit(x).T, own["leaf"].to_numpy(), ask["leaves"].to_numpy()
        found = []
        for a in range(0, len(q), 256):
            rough = _unit(q[a : a + 256]) @ unit
            for i, q_id in enumerate(ask["query_id"].to_numpy()[a : a + 256]):
                open_ = np.flatnonzero(np.isin(leaf, leaves[a + i]))
                got, score, _ = best(q_id, q[a + i], rough[i][open_], ids[open_], x[open_], k)
                found.append((np.full(len(got), q_id), got, score))
        return pd.DataFrame({n: np.concatenate([f[j] for f in found]) for j, n in enumerate(("query_id", "vec_id", "score"))})

    hits = left.groupBy("near", "part", "side").cogroup(right.groupBy("l", "p", "s")).applyInPandas(search, "query_id long, vec_id long, score double")
    ranked = hits.groupBy("query_id", "vec_id").agg(F.max("score").alias("score")).withColumn("rank", near).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _by_query():
    from pyspark.sql import Window

    return Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")


def calibrate(tree: Tree, ids: np.ndarray, probe: np.ndarray, truth: list[tuple[int, int]], target: float) -> int:
    """The fewest leaf visits at which the mean share of true neighbours in visited leaves reaches ``target``."""
    wanted: dict[int, list[int]] = {}
    for q_id, leaf in truth:
        wanted.setdefault(q_id, []).append(leaf)
    share = np.zeros(tree.n_leaves)
    used = 0
    for q_id, q in zip(ids.tolist(), probe, strict=True):
        if q_id in wanted:
            used += 1
            order = {leaf: n for n, leaf in enumerate(tree.visits(q, tree.n_leaves))}
            for leaf in wanted[q_id]:
                share[order[leaf]] += 1 / len(wanted[q_id])
    if not used:
        return tree.n_leaves
    return int(np.flatnonzero(np.cumsum(share) / used >= target - 1e-12)[0]) + 1
