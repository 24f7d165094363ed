"""The grabber protocol over a configuration, as a set of capabilities.

A capability adds options and hooks itself up before anything is read or fetched: it answers at once, or leaves work for when the
configuration file has been read, for the selection of channels, or for after the guide. The order of a run is: options, answers
that need nothing, capabilities, configuration, tasks upon it, adjustment, selection, grab, guide, clean-up. The configuration
file is written once, at the end, and only if the run holds another one than it read.
"""

from __future__ import annotations

import os
import sys
import tempfile
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from datetime import datetime, timedelta, timezone
from typing import Any, Protocol

from pyspark.sql import DataFrame, SparkSession

from . import cli, config, lineups, options, stages
from .operators import registry
from .options import Option
from .sources.xml_sink import Writer, write_output

UPDATES = ("notify", "signal", "add", "ignore")
SIGNAL = 2

BASE: dict[str, Option] = {
    "help": Option(help="tell the options", short="h"),
    "description": Option(help="tell what this grabber grabs"),
    "version": Option(help="tell its version"),
    "capabilities": Option(help="tell its capabilities"),
    "quiet": Option(help="no progress"),
    "debug": Option(help="more progress"),
    "config-file": Option("text", "the configuration", "FILE"),
    "output": Option("text", "where the document goes", "FILE"),
    "days": Option("number", "days of the guide", "N", low=1),
    "offset": Option("number", "days from today to the first", "N", default=0),
}


@dataclass
class Run:
    """What capabilities see of a run, and what they leave for later."""

    values: dict[str, Any]
    spark: SparkSession
    grabber: dict
    ask: Callable[[str], str] | None
    target: Any
    conf: dict[str, list[str]] | None = None
    pages: list[stages.Stage] = field(default_factory=list)
    claims: list[Callable[[Run], int]] = field(default_factory=list)  # the whole run's work, once every capability has been hooked up
    config_tasks: list[Callable[[Run], int | None]] = field(default_factory=list)
    adjust_tasks: list[Callable[[Run, dict, set[str]], dict]] = field(default_factory=list)
    finish_tasks: list[Callable[[], None]] = field(default_factory=list)
    codes: list[int] = field(default_factory=lambda: [0])
    _offered: DataFrame | None = None

    def emit(self, text: str) -> None:
        write_output(self.target, [text])

    def warn(self, line: str) -> None:
        print(line, file=sys.stderr)

    def log(self, line: str) -> None:
        if not self.values["quiet"]:
            self.warn(line)

    @property
    def config_file(self) -> str:
        return self.values["config-file"] or os.path.expanduser(f"~/.xmltv/{self.grabber['name']}.conf")

    @property
    def offered(self) -> DataFrame:
        """The channels of all sites; asked for once, and only if something needs them."""
        if self._offered is None:
            self._offered = cli.site_channels(self.spark, self.grabber["config"]["sites"])
        return self._offered

    def listed(self) -> list[tuple[str, str | None]]:
        """Each offered channel once, in the order of first sight."""
        rows = self.offered.orderBy("site_rank", "channel_rank").select("xmltv_id", "name").toLocalIterator()
        out: dict[str, str | None] = {}
        for r in rows:
            out.setdefault(r["xmltv_id"], r["name"])
        return list(out.items())

    def stage_chain(self) -> list[stages.Stage]:
        """The grabber's pages, and those of capabilities before what ends the walk."""
        own = list(self.grabber.get("stages") or [stages.Stage(stages.START, stages.SELECT_CHANNELS)])
        for page in self.pages:
            own = [stages.Stage(s.name, page.name if s.next in (stages.SELECT_CHANNELS, stages.END) else s.next, s.fields) for s in own] + [page]
        stages.resolve(own)
        return own


class Capability(Protocol):
    """``options`` are added to the command line; ``hook`` returns an exit code if it has done all there is to do, or leaves that as a claim."""

    name: str
    options: Mapping[str, Option]
    forms: Sequence[Sequence[str]]

    def hook(self, run: Run) -> int | None: ...


@dataclass(frozen=True)
class Plugin:
    name: str
    hook: Callable[[Run], int | None]
    options: Mapping[str, Option] = field(default_factory=dict)
    forms: Sequence[Sequence[str]] = ()  # invocations of its own, the mode first
    grab: Sequence[str] = ()  # options of the plain form


def channels_xml(channels: DataFrame) -> str:
    """The offered channels as a document, each once, in order."""
    w = Writer(1)
    rows = channels.orderBy("site_rank", "channel_rank").select("xmltv_id", "name", "logo").toLocalIterator()
    seen: dict[str, dict] = {}
    for r in rows:
        c = seen.setdefault(r["xmltv_id"], {"id": r["xmltv_id"], "display_name": [], "icon": []})
        for name, value in (("display_name", {"value": r["name"] or r["xmltv_id"]}), ("icon", r["logo"] and {"src": r["logo"]})):
            if value and value not in c[name]:
                c[name].append(value)
    return w.header() + "".join(map(w.channel, seen.values())) + w.footer()


def _configured(run: Run) -> int:
    config.save_conf(run.config_file, stages.walk(run.stage_chain(), run.listed(), run.ask))
    return 0


def _channels(run: Run) -> int:
    run.emit(channels_xml(run.offered))
    return 0


def _page(run: Run) -> int:
    by = stages.resolve(run.stage_chain()) | {stages.SELECT_CHANNELS: stages.channels_stage(run.listed())}
    if run.values["stage"] not in by:
        run.warn(f"there is no page {run.values['stage']}")
        return 1
    run.emit(stages.stage_xml(by[run.values["stage"]], run.grabber["name"]))
    return 0


def _manual(run: Run) -> None:
    if run.values["configure"]:
        run.claims.append(_configured)


def _api(run: Run) -> None:
    for name, task in (("list-channels", _channels), ("stage", _page)):
        if run.values[name]:
            run.claims.append(task)


def _cache(run: Run) -> None:
    given = run.values["cache"]
    if given is None:  # --no-cache: a folder that goes with the run
        folder = tempfile.TemporaryDirectory(prefix="guide_engine_")
        run.finish_tasks.append(folder.cleanup)
        run.adjust_tasks.append(lambda _, own, __: {**own, "cache": folder.name, "prune": False})
    elif given:
        run.adjust_tasks.append(lambda _, own, __: {**own, "cache": os.path.abspath(given)})


def _preferred(run: Run) -> int | None:
    if run.values["preferredmethod"]:
        run.emit("allatonce\n")
        return 0
    return None


def channel_updates(spark: SparkSession, offered: DataFrame, conf: Mapping[str, Sequence[str]]) -> tuple[list[str], list[str]]:
    """Offered channels that a configuration has no decision on, and chosen ones that are offered no more."""
    known = spark.createDataFrame([(c,) for c in (*conf.get("channel", ()), *conf.get("no_channel", ()))], "xmltv_id string")
    chosen = spark.createDataFrame([(c,) for c in conf.get("channel", ())], "xmltv_id string")
    return tuple(sorted(r["xmltv_id"] for r in registry.only_in(a, b, "xmltv_id").collect()) for a, b in ((offered, known), (chosen, offered)))  # channel lists are small


def _updates(run: Run) -> None:
    mode = run.values["channel-updates"]

    def look(run: Run, own: dict, selection: set[str]) -> dict:
        if not {"channel", "no_channel"} & run.conf.keys():
            return own  # something else chooses the channels
        fresh, gone = channel_updates(run.spark, run.offered, run.conf)
        if gone:
            run.warn(f"offered no more, and kept: {', '.join(gone)}")
        if fresh and mode == "add":
            selection.update(fresh)
            run.conf = {**run.conf, "channel": [*run.conf.get("channel", ()), *fresh]}
            run.log(f"added: {', '.join(fresh)}")
        elif fresh:
            run.warn(f"new channels: {', '.join(fresh)}; --configure takes them in")
        if mode == "signal" and (fresh or gone):
            run.codes.append(SIGNAL)
        return own

    if mode != "ignore":
        run.adjust_tasks.append(look)


def _lineups(run: Run) -> int | None:
    wanted = run.values["get-lineup"]
    if not run.values["list-lineups"] and not wanted:
        return None
    found: dict[str, dict] = {}
    for r in lineups.entries(run.offered).orderBy("lineup", "channel_rank").toLocalIterator():
        x = found.setdefault(r["lineup"], {"id": r["lineup"], "display_name": [{"value": r["lineup"]}], "entries": []})
        x["entries"].append({"station": r["station"].asDict(), "preset": r["preset"]})
    picked = [x for k, x in found.items() if not wanted or k == wanted]
    run.emit(lineups.lineups_xml(picked if wanted else [{**x, "entries": []} for x in picked]))
    return 0 if picked else 1


SHIPPED: dict[str, Plugin] = {
    "manualconfig": Plugin("manualconfig", _manual, {"configure": Option(help="ask, and write the configuration")}, [["configure", "config-file"]]),
    "apiconfig": Plugin("apiconfig", _api, {"list-channels": Option(help="the channels as a document"), "stage": Option("text", "a page of questions as a document", "NAME")}, [["list-channels", "output"], ["stage", "output"]]),
    "cache": Plugin("cache", _cache, {"cache": Option("text", "the folder of the cache", "DIR", default="", bare="", negatable=True)}, grab=["cache"]),
    "preferredmethod": Plugin("preferredmethod", _preferred, {"preferredmethod": Option(help="tell how days are best asked for")}),
    "newchannels": Plugin("newchannels", _updates, {"channel-updates": Option("text", "what to do about channels that have come or gone", "|".join(UPDATES), default="notify", convert=options.one_of(*UPDATES))}, grab=["channel-updates"]),
    "lineups": Plugin("lineups", _lineups, {"list-lineups": Option(help="the lineups"), "get-lineup": Option("text", "a lineup with its channels", "ID")}, [["list-lineups", "output"], ["get-lineup", "output"]]),
}
DEFAULT = ("manualconfig", "apiconfig", "cache", "preferredmethod", "newchannels")


def capabilities(grabber: dict) -> list:
    """The grabber's capabilities: names of shipped ones, or plug-ins; no two may declare the same option."""
    names = grabber.get("capabilities") or (*DEFAULT, *(["lineups"] if grabber.get("lineups") else []))
    found, taken = [SHIPPED[c] if isinstance(c, str) else c for c in names], set(BASE)
    for c in found:
        if twice := taken & set(c.options):
            raise TypeError(f"capability {c.name} declares options that are taken: {', '.join(sorted(twice))}")
        taken |= set(c.options)
    return found


def run(argv: Sequence[str], spark: SparkSession, grabber: dict, ask: Callable[[str], str] | None = None, out=sys.stdout) -> int:
    """``grabber`` has name, description, version and config (as of ``cli``), and may have stages, lineups and capabilities."""
    caps = capabilities(grabber)
    specs = {**BASE, **{n: o for c in caps for n, o in c.options.items()}}
    try:
        values, _ = options.parse(argv, specs)
    except options.OptionError as e:
        print(e, file=sys.stderr)
        return 1
    told = {
        "help": lambda: options.usage(grabber["name"], [["config-file", "output", "days", "offset", *(n for c in caps for n in getattr(c, "grab", ()))], *(f for c in caps for f in c.forms)], specs),
        "description": lambda: grabber["description"], "version": lambda: grabber["version"], "capabilities": lambda: "\n".join(["baseline", *(c.name for c in caps)]),
    }
    for flag, text in told.items():
        if values[flag]:
            print(text(), file=out)
            return 0
    now = Run(values, spark, grabber, ask, values["output"] or out)
    try:
        for c in caps:
            if (code := c.hook(now)) is not None:
                return code
        return now.claims[0](now) if now.claims else _go(now)
    finally:
        for task in now.finish_tasks:
            task()


def _go(now: Run) -> int:
    values, base = now.values, now.grabber["config"]
    read = config.load_conf(values["config-file"]) if values["config-file"] else {"channel": [i for i, _ in now.listed()]}
    if read is None:
        now.warn("no usable configuration; run --configure")
        return 1
    now.conf = dict(read)
    for task in now.config_tasks:
        if (code := task(now)) is not None:
            _save(now, read)
            return code
    start = f"{datetime.now(timezone.utc) + timedelta(days=values['offset']):%Y-%m-%d}"
    own = {**base, "start_day": base.get("start_day") or start, "days": values["days"] or base.get("days", 7), "output": now.target}
    chosen = set(now.conf.get("channel", ()))
    for task in now.adjust_tasks:
        own = task(now, own, chosen)
    picked = lambda s: [c for c in (s["channels"]() if callable(s["channels"]) else s["channels"]) if c["xmltv_id"] in chosen]
    sites = [{**s, "channels": picked(s)} for s in own["sites"]]
    own["sites"] = [s for s in sites if s["channels"]]
    if own["sites"]:
        for failure in cli.grab(now.spark, own)["failures"]:
            now.log(f"{failure['site']} {failure['channel']} {failure['day']}: {failure['error']}")
        cli.merge(now.spark, own)
    _save(now, read)
    return max(now.codes)


def _save(now: Run, read: dict) -> None:
    if now.values["config-file"] and now.conf != read:
        config.save_conf(now.values["config-file"], now.conf)
