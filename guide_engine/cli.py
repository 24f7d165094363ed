"""Commands over the engine: build, grab, merge, prune, parse. Exit 0 done, 1 failed, 2 wrong usage, 130 interrupted."""

from __future__ import annotations

import argparse
import importlib.util
import sys
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from datetime import datetime, timezone
from threading import Lock

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fetch, scaffold, schema
from .builder import channel, words
from .functions.dates import is_day
from .operators import ingest, registry
from .plans import guide
from .sources.cache import Cache
from .sources.files import CacheStore
from .sources.xml_sink import write_output


def load_config(path: str) -> dict:
    """A Python file that sets ``config``: sites, cache, output, days, start_day, merge, staleness."""
    spec = importlib.util.spec_from_file_location("guide_config", path)
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    return module.config


def site_channels(spark: SparkSession, sites: Sequence[dict]) -> DataFrame:
    """The channel lists of all sites, callables asked once, in order of priority.

    A site's ``channel_info`` makes the element of a channel from the channel and its default element.
    """
    rows = []
    for rank, site in enumerate(map(fetch.checked_site, sites)):
        listed = site["channels"]() if callable(site["channels"]) else site["channels"]
        for k, c in enumerate(listed):
            default = channel(c["xmltv_id"], words(c.get("name") or c["xmltv_id"], c.get("lang")), icon=c.get("logo"))
            info = site["channel_info"](c, default) if site.get("channel_info") else default
            info = {f: schema.pairs(info).get(f) for f in schema.CHANNEL if f != "id"}
            if info.get("attrs"):
                info["attrs"] = dict(info["attrs"])
            rows.append((site["site"], rank, k, c["xmltv_id"], c.get("site_id"), c.get("name"), c.get("lang"), c.get("logo"), c.get("preset"), info))
    return spark.createDataFrame(rows, f"site string, site_rank int, channel_rank int, xmltv_id string, site_id string, name string, lang string, logo string, preset string, info {registry.INFO}")


def _grab_site(spark: SparkSession, site: dict, cache: CacheStore, channels: DataFrame, meta: DataFrame, config: dict, now: datetime, start: str, cancelled: Callable[[], bool], writing: Lock) -> list[tuple]:
    """(site, channel, day, status, programme_count, error) of one site's channel-days."""
    name = site["site"]
    own = channels.where(F.col("site") == name).withColumn("channel_id", F.col("xmltv_id"))
    policy = ingest.Policy().over(config.get("staleness"), site.get("staleness"))
    grid = ingest.stale_grid(own, ingest.day_window(spark, start, site.get("days", config.get("days", 7))), meta, F.lit(f"{now:%Y-%m-%d}").cast("date"), F.lit(int(now.timestamp())), policy)
    plan = ingest.requests(grid.where("stale"), *ingest.batching(**site.get("batching", {"mode": "none"}))).select("day_grp", "ch_grp", "channel_id", "site_id", F.date_format("day", "yyyy-MM-dd").alias("day"))
    groups: dict[tuple, fetch.Context] = {}
    for r in plan.orderBy("day_grp", "ch_grp", "channel_rank", "day").collect():  # a site's requests, sent from here
        groups.setdefault((r["day_grp"], r["ch_grp"]), fetch.Context()).append(r)
    log: list[tuple] = [(name, None, None, "cached", 0, None)] * grid.where("not stale").count()
    pacing = fetch.Pacing(**site.get("pacing", {}))
    fetched = fetch.fetch_site(groups.values(), site["request"], pacing, cancelled)
    if not fetched:
        return log
    if site.get("parse_here"):
        parsed = fetch.parse_here(spark, name, fetched, site["parse_day"], lambda r: fetch.paced(site["request"], pacing, r))
    else:
        parsed = fetch.parse_payloads(spark, name, fetched, site["parse_day"])
    parsed = parsed.persist()
    try:
        rows = parsed.where("seq is not null").select("seq", "programme.*", "site", "channel_id", "day")
        counts = rows.groupBy("site", "channel_id", "day").agg(F.count("*").cast("int").alias("n"))
        entries = parsed.where("seq is null").join(counts, ["site", "channel_id", "day"], "left")
        told = entries.select("site", "channel_id", F.col("day").cast("string"), "status", F.coalesce("n", F.lit(0)), "error").collect()  # a row a planned channel-day
        with writing:  # one writer of the cache at a time
            cache.write(rows, parsed.where("status = 'fetched'").select("site", "channel_id", "day", F.lit(now.isoformat()).alias("grabbed_at")))
    finally:
        parsed.unpersist()
    return log + [tuple(r) for r in told]


def grab(spark: SparkSession, config: dict, now: datetime | None = None, cancelled: Callable[[], bool] = lambda: False) -> dict:
    """Refresh stale channel-days; the counters of the run and its failures.

    Sites run beside each other. A failed request fails its own channel-days only, and a site that fails as a whole is one failure (``*``, ``*``).
    Once ``cancelled`` says so no further request is sent, and what has come is stored and counted; nothing is pruned.
    """
    now = now or datetime.now(timezone.utc)
    cache, start = _cache(spark, config), config.get("start_day") or f"{now:%Y-%m-%d}"
    # the entries' meta is read as it is now: what is fetched below changes it
    meta = cache.entries().withColumn("grabbed_at", F.unix_timestamp(F.try_to_timestamp("grabbed_at")))
    meta = spark.createDataFrame(meta.toArrow(), meta.schema) if meta.take(1) else spark.createDataFrame([], meta.schema)
    writing = Lock()

    def one(site: dict) -> list[tuple]:
        try:
            return _grab_site(spark, site, cache, site_channels(spark, [site]), meta, config, now, start, cancelled, writing)
        except Exception as e:  # noqa: BLE001  the other sites go on
            return [(site.get("site") or "?", "*", "*", "failed", 0, f"{type(e).__name__}: {e}")]

    with ThreadPoolExecutor(max(1, min(len(config["sites"]), config.get("site_concurrency", 4)))) as pool:
        log = [x for found in pool.map(one, config["sites"]) for x in found]
    shape = "site string, channel_id string, day string, status string, programme_count int, error string"
    counts = ingest.summary(spark.createDataFrame(log, shape)).first().asDict()
    counts["failures"] = [{"site": s, "channel": c, "day": d, "error": e} for s, c, d, status, _, e in log if status == "failed"]
    counts["cancelled"] = bool(cancelled())
    if config.get("prune", True) and not counts["cancelled"]:
        counts["pruned"] = cache.prune(F.lit(min(start, f"{now:%Y-%m-%d}")).cast("date"))
    return counts


def _cache(spark: SparkSession, config: dict) -> CacheStore:
    """The configured store: an object with the methods of ``CacheStore``, or a folder."""
    given = config["cache"]
    return Cache(spark, given) if isinstance(given, str) else given(spark) if callable(given) else given


class Cancelled(RuntimeError):
    """A merge was called off; its output is as it was."""


def merge(spark: SparkSession, config: dict, now: datetime | None = None, cancelled: Callable[[], bool] = lambda: False) -> None:
    start = config.get("start_day") or f"{now or datetime.now(timezone.utc):%Y-%m-%d}"
    built = guide.build(spark, site_channels(spark, config["sites"]), _cache(spark, config).programmes(), start, config.get("days", 7), guide.MergeOptions(**config.get("merge", {})))

    def chunks():
        for c in guide.chunks(built, config.get("meta"), config.get("indent")):
            if cancelled():
                raise Cancelled("the merge was called off")
            yield c

    write_output(config["output"], chunks())


def options() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="guide", description=__doc__)
    p.add_argument("command", nargs="?", default="build", choices=["build", "grab", "merge", "prune", "init-grabber"])
    p.add_argument("name", nargs="?", help="init-grabber: the grabber's name")
    p.add_argument("--description", default="", help="init-grabber: a line about it")
    p.add_argument("--force", action="store_true", help="init-grabber: overwrite")
    p.add_argument("--config", default="guide_config.py")
    p.add_argument("--days", type=int)
    p.add_argument("--start-day")
    p.add_argument("--output")
    p.add_argument("--before", help="prune: the first day that stays")
    return p


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> int:
    try:
        args = options().parse_args(argv)
        for day in (args.start_day, args.before):
            if day and not is_day(day):
                options().error(f"{day} is no day")
        if args.command == "prune" and not args.before:
            options().error("prune needs --before")
        if args.command == "init-grabber" and not scaffold.NAME.fullmatch(args.name or ""):
            options().error("init-grabber needs a name like tv_grab_xx_yy")
    except SystemExit as e:
        return 2 if e.code else 0
    try:
        if args.command == "init-grabber":
            print(scaffold.write(args.name, args.config, args.description, args.output, args.force), file=sys.stderr)
            return 0
        config = load_config(args.config) | {k: v for k, v in (("days", args.days), ("start_day", args.start_day), ("output", args.output)) if v is not None}
        spark = spark or SparkSession.builder.appName("guide").config("spark.sql.session.timeZone", "UTC").config("spark.sql.mapKeyDedupPolicy", "LAST_WIN").getOrCreate()
        if args.command in ("build", "grab"):
            print(grab(spark, config), file=sys.stderr)
        if args.command in ("build", "merge"):
            merge(spark, config)
        if args.command == "prune":
            print(_cache(spark, config).prune(F.lit(args.before).cast("date")), file=sys.stderr)
        return 0
    except KeyboardInterrupt:
        return 130
    except Exception as e:  # noqa: BLE001  a command reports and exits
        print(f"{type(e).__name__}: {e}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
