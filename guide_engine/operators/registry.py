"""Output channels from the channel lists of prioritised sites, and the schedule's strategies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import CHANNEL, struct

INFO = struct({f: t for f, t in CHANNEL.items() if f != "id"})
STRATEGIES = ("merge-programmes", "first-wins", "keep-all")


def channel_element() -> list[Column]:
    """id, display name (the id where there is none) and logo of a site's channel."""
    return [F.col("xmltv_id").alias("id"), F.coalesce("name", "xmltv_id").alias("display_name"), F.col("logo").alias("icon")]


def channel_info(columns: list[str]) -> Column:
    """The element a site offers for its channel: its own ``info`` where there is one, else made of name, language and logo."""
    lang, none = (F.col("lang") if "lang" in columns else F.lit(None)).cast("string"), F.lit(None).cast("map<string,string>")
    id_, name, icon = channel_element()
    default = F.struct(
        F.array(F.struct(name.alias("value"), lang.alias("lang"), none.alias("attrs"))).alias("display_name"),
        F.when(F.col("logo").isNotNull(), F.array(F.struct(icon.alias("src"), F.lit(None).cast("double").alias("width"), F.lit(None).cast("double").alias("height"), none.alias("attrs")))).alias("icon"),
        F.lit(None).cast(CHANNEL["url"]).alias("url"), F.lit(None).cast(CHANNEL["extra"]).alias("extra"), none.alias("attrs"),
    )
    return F.coalesce("info", default) if "info" in columns else default


def registry(channels: DataFrame, strategy: str = "merge-programmes") -> DataFrame:
    """One row per output channel: xmltv_id, its rank, and its sources in order of priority.

    ``channels`` has site, site_rank, channel_rank, xmltv_id. Under keep-all every site channel is one of its own.
    """
    source = F.struct("site_rank", "channel_rank", "site")
    if strategy == "keep-all":
        return channels.select("xmltv_id", F.struct("site_rank", "channel_rank").alias("rank"), F.array(source).alias("sources"))
    grouped = channels.groupBy("xmltv_id").agg(F.min(F.struct("site_rank", "channel_rank")).alias("rank"), F.array_sort(F.collect_list(source)).alias("sources"))
    return grouped.withColumn("sources", F.slice("sources", 1, 1)) if strategy == "first-wins" else grouped


def covering(rows: DataFrame, reg: DataFrame, channel: str = "xmltv_id", on_site: bool = True) -> DataFrame:
    """The rows of the registry's sources, with their site and its rank: by channel and site, or by channel alone."""
    keys = reg.select(F.col(channel), F.explode("sources").alias("s")).select(channel, F.col("s.site").alias("site"), F.col("s.site_rank").alias("site_rank"))
    return rows.join(keys, [channel, "site"] if on_site else [channel])


def distinct_ids(rows: DataFrame, key: str, rank: str) -> DataFrame:
    """Every id once, with the place where it is seen first; ``orderBy("first_seen")`` gives the order of first sight."""
    return rows.groupBy(key).agg(F.min(rank).alias("first_seen"))


def first_wins(rows: DataFrame, channel: str = "channel", site: str = "site") -> DataFrame:
    """Rows of each channel's first covering site."""
    w = Window.partitionBy(channel)
    return rows.withColumn("_first", F.min(site).over(w)).where(F.col(site) == F.col("_first")).drop("_first")


def concat_order(rows: DataFrame, channel: str = "channel", keys: tuple[str, ...] = ("st", "day_idx", "site", "seq")) -> DataFrame:
    """All rows with their place in the channel: by start, and stable in (day, site, seq)."""
    return rows.withColumn("out_seq", F.row_number().over(Window.partitionBy(channel).orderBy(*keys)))


def selected(channels: DataFrame, chosen: DataFrame, key: str = "xmltv_id") -> DataFrame:
    return channels.join(chosen.select(key), key, "left_semi")


def only_in(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys of a that b lacks, each once."""
    return a.select(key).distinct().join(b.select(key), key, "left_anti")
