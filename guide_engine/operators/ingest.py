"""The ingest planner: which channel-days are stale, and the requests that refresh them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Policy:
    always_refetch_days: int = 1
    max_age_days: float = 7
    empty_max_age_days: float = 1

    def over(self, run: dict | None = None, site: dict | None = None) -> Policy:
        """Field by field: the site's, else the run's, else the default."""
        return Policy(**{**self.__dict__, **(run or {}), **(site or {})})


def day_window(spark, start: str, days: int) -> DataFrame:
    """day and day_idx of a window; none for days <= 0."""
    first = F.to_date(F.lit(start))
    return spark.range(max(0, days)).select(F.date_add(first, F.col("id").cast("int")).alias("day"), F.col("id").cast("int").alias("day_idx"))


def is_stale(today: Column, now: Column, policy: Policy, day: str = "day", grabbed: str = "grabbed_at", count: str = "programme_count") -> Column:
    """Missing or unreadable entries, the days always refetched, and entries older than their policy."""
    ahead = F.datediff(F.col(day), today)
    limit = F.when(F.col(count) == 0, policy.empty_max_age_days).otherwise(policy.max_age_days) * 86400
    return F.col(grabbed).isNull() | ((ahead >= 0) & (ahead < policy.always_refetch_days)) | (now - F.col(grabbed) > limit)


def grid(channels: DataFrame, days: DataFrame) -> DataFrame:
    """Every channel on every day: the days of a window are few, and broadcast."""
    return channels.crossJoin(F.broadcast(days))


def stale_grid(channels: DataFrame, days: DataFrame, meta: DataFrame, today: Column, now: Column, policy: Policy, keys: tuple[str, ...] = ("site", "channel_id", "day")) -> DataFrame:
    """The grid with ``stale``; entry meta (grabbed_at in seconds, programme_count) is looked up by its keys."""
    return grid(channels, days).join(meta, list(keys), "left").withColumn("stale", is_stale(today, now, policy))


def requests(stale: DataFrame, max_channels: int | None, max_days: int | None, site: str = "site") -> DataFrame:
    """Stale channel-days (site, channel_id, channel_rank, day_idx) put together into requests.

    Day groups are cut from the whole window, so their borders don't move with the cache; in each, the stale
    channels are cut in order. None is no limit, 1 is no batching.
    """
    groups = stale.withColumn("day_grp", F.floor(F.col("day_idx") / max_days) if max_days else F.lit(0).cast("long"))
    rank = F.dense_rank().over(Window.partitionBy(site, "day_grp").orderBy("channel_rank"))
    return groups.withColumn("ch_grp", F.floor((rank - 1) / max_channels) if max_channels else F.lit(0).cast("long"))


def request_list(grouped: DataFrame, site: str = "site") -> DataFrame:
    pairs = F.array_sort(F.collect_set(F.struct("channel_rank", "channel_id")))
    return grouped.groupBy(site, "day_grp", "ch_grp").agg(pairs.alias("channels"), F.array_sort(F.collect_set("day_idx")).alias("days"), F.count("*").alias("n_pairs"))


#: Batching modes -> (channels, days) limits from the caller's caps; 0 and None are no limit.
def batching(mode: str, channels: int | None = None, days: int | None = None) -> tuple[int | None, int | None]:
    if mode not in ("none", "channels", "days", "both"):
        raise ValueError(f"unknown batching mode {mode!r}")
    return ((channels or None) if mode in ("channels", "both") else 1, (days or None) if mode in ("days", "both") else 1)


def pruned(entries: DataFrame, before: Column) -> DataFrame:
    """Distinct channel-days before a day: what pruning removes."""
    return entries.where(F.col("day") < before).select("site", "channel_id", "day").distinct()


def summary(log: DataFrame) -> DataFrame:
    """Counters of a run's log (status, programme_count): an empty day is fetched too."""
    return log.agg(
        F.count_if(F.col("status") == "fetched").alias("fetched"),
        F.count_if((F.col("status") == "fetched") & (F.col("programme_count") == 0)).alias("empty"),
        F.count_if(F.col("status") == "cached").alias("from_cache"),
        F.count_if(F.col("status") == "failed").alias("failed"),
    )
