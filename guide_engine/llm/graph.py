"""Connected components over edges kept in tables: alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Tables


def components(tables: Tables, edges: DataFrame, name: str = "cc") -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b); component is the smallest node reachable.

    Every round rewires nodes to their smallest neighbour, so path lengths halve at least;
    hubs are joined on both sides of a shuffle, where a hot key can be split.
    """

    def fingerprint(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    now = tables.put(f"{name}_0", edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark, k = fingerprint(now), 0
    while mark[0]:
        both = now.union(now.select("b", "a"))
        low = both.groupBy("a").agg(F.min("b").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.least("m", "a").alias("b"))
        large = tables.put(f"{name}_{k}_large", large.where("a <> b").distinct())
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.col("a"), F.col("b"))).alias("a"), F.col("m").alias("b"))
        small = small.where("a <> b").distinct()
        after = tables.put(f"{name}_{k + 1}", small)
        tables.drop(f"{name}_{k}", f"{name}_{k}_large")
        now, k = after, k + 1
        before, mark = mark, fingerprint(now)
        if mark == before:
            break
    labels = now.groupBy("a").agg(F.min("b").alias("component"))
    return labels.select(F.col("a").alias("node"), "component").union(labels.select(F.col("component"), F.col("component")).distinct())
