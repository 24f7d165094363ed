"""Band matching of schedules: pairs within a start tolerance, and each incoming row's nearest partner."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TOLERANCE = 300


def durations(st: str, sp: str) -> Column:
    return F.when(F.col(sp) > F.col(st), F.col(sp) - F.col(st))


def matches(tolerance: int, titles: str = "when-shifted") -> Column:
    """Whether row a (a_*) and row b (b_*) tell the same broadcast: times in seconds, *_title a title key."""
    shift = F.abs(F.col("a_st") - F.col("b_st"))
    same_title = F.col("a_title") == F.col("b_title")
    shorter = F.least(F.coalesce(durations("a_st", "a_sp"), F.lit(1 << 60)), F.coalesce(durations("b_st", "b_sp"), F.lit(1 << 60)))
    exact = same_title if titles == "always" else F.lit(True)
    apart = (shift < shorter) & (F.lit(True) if titles == "never" else same_title)
    return (shift <= tolerance) & F.when(shift == 0, exact).otherwise(apart)


def band_pairs(a: DataFrame, b: DataFrame, tolerance: int = TOLERANCE, titles: str = "when-shifted", channel: str = "channel") -> DataFrame:
    """Pairs of rows (st, sp, title, id) on a channel that match.

    Starts fall into buckets as wide as the tolerance and b's rows stand in three of them, so the join is a
    hash join on (channel, bucket) instead of all rows of a channel against each other.
    """
    width = max(1, tolerance)

    def side(df: DataFrame, p: str) -> DataFrame:
        return df.select(F.col(channel).alias(channel), *[F.col(c).alias(f"{p}_{c}") for c in ("id", "st", "sp", "title")])

    left = side(a, "a").withColumn("bucket", F.floor(F.col("a_st") / width))
    right = side(b, "b").withColumn("bucket", F.explode(F.sequence(F.floor(F.col("b_st") / width) - 1, F.floor(F.col("b_st") / width) + 1)))
    return left.join(right, [channel, "bucket"]).where(matches(tolerance, titles)).drop("bucket")


def nearest(pairs: DataFrame, channel: str = "channel") -> DataFrame:
    """For each b its partner of least shift; of equals the earlier start, then the lower id."""
    w = Window.partitionBy(channel, "b_id").orderBy(F.abs(F.col("a_st") - F.col("b_st")), "a_st", "a_id")
    return pairs.withColumn("rank", F.row_number().over(w)).where("rank = 1").drop("rank")


def nearest_pairs(a: DataFrame, b: DataFrame, tolerance: int = TOLERANCE, channel: str = "channel") -> DataFrame:
    """``nearest`` of ``band_pairs`` without titles, from a sweep instead of all pairs.

    a's rows at one start that can be nearest have lower ids or longer durations than the others, and b's duration decides only whether
    the nearest counts. So a and the instants of b are pooled, and each instant is told once per side: the last start that still
    runs, and the first to come that reaches back. Each stretch of time carries a's rows a tolerance around it.
    """
    width = max(1, 4 * tolerance)
    span = lambda st, sp: F.coalesce(F.when(F.col(sp) > F.col(st), F.col(sp) - F.col(st)), F.lit(1 << 60))
    near = F.sequence(F.floor((F.col("st") - tolerance) / width), F.floor((F.col("st") + tolerance) / width))
    left = a.groupBy(F.col(channel).alias("channel"), "st", span("st", "sp").alias("span")).agg(F.min("id").alias("id"))
    left = left.select("channel", F.explode(near).alias("stretch"), "st", "span", "id")
    right = b.select(F.col(channel).alias("channel"), F.col("id").alias("b_id"), F.col("st").alias("b_st"), F.col("sp").alias("b_sp"))
    asked = right.select("channel", F.col("b_st").alias("st")).distinct()
    asked = asked.select("channel", F.floor(F.col("st") / width).alias("stretch"), "st", F.lit(None).cast("long").alias("span"), F.lit(None).cast("long").alias("id"))
    both = left.unionByName(asked).repartition("channel", "stretch").sortWithinPartitions("channel", "stretch", "st", "id")
    out = pa.schema([("channel", pa.string()), ("b_st", pa.int64()), ("a_id", pa.int64()), ("a_st", pa.int64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, given, wanted = None, [], []

        def told() -> pa.RecordBatch:
            rows = [(own[0], t, hit[2], hit[1]) for t, hit in zip(wanted, _nearest(given, wanted, tolerance), strict=True) if hit]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else ((),) * 4, out, strict=True)], schema=out)

        for batch in batches:
            for ch, stretch, st, length, row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if own != (ch, stretch):
                    if wanted:
                        yield told()
                    own, given, wanted = (ch, stretch), [], []
                if row is None:
                    wanted.append(st)
                else:
                    given.append((st, length, row))
        if wanted:
            yield told()

    best = both.mapInArrow(run, "channel string, b_st long, a_id long, a_st long")
    shift = F.abs(F.col("a_st") - F.col("b_st"))
    found = right.join(best, ["channel", "b_st"]).where((shift == 0) | (shift < span("b_st", "b_sp")))
    return found.withColumnRenamed("channel", channel)


def _nearest(given: list[tuple[int, int, int]], wanted: list[int], tolerance: int) -> list[tuple[int, int, int] | None]:
    """For each instant its (shift, start, id) of ``given`` (start, duration, id) with a shift of 0, or below the duration; both sorted by start."""
    best: list[tuple[int, int, int] | None] = [None] * len(wanted)
    for side in (1, -1):  # what started before, then what starts after: the same in mirrored time
        rows = sorted(((side * st, length, row) for st, length, row in given), key=lambda x: (x[0], -x[2]))
        running: list[tuple[int, int, int]] = []  # starts and, at one start, lower ids on top; ends grow downwards
        k = 0
        for i in range(len(wanted))[::side]:
            t = side * wanted[i]
            while k < len(rows) and rows[k][0] <= t:
                while running and running[-1][0] + running[-1][1] <= rows[k][0] + rows[k][1]:
                    running.pop()
                running.append(rows[k])
                k += 1
            while running and running[-1][0] + running[-1][1] <= t:
                running.pop()
            if running and t - running[-1][0] <= tolerance:
                st, _, row = running[-1]
                hit = (t - st, side * st, row)
                best[i] = hit if best[i] is None else min(best[i], hit)
    return best
