"""Lineups: channel lists as lineup documents, and a lineup as a selection of channels."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions.text import escape
from .sources.model import attr


def station(lang: str | None = None) -> list:
    """Columns of a site's channel as a station; the channel's own language comes first."""
    return [F.col("xmltv_id"), F.col("name"), F.coalesce("lang", F.lit(lang).cast("string")).alias("lang"), F.col("logo")]


def entries(channels: DataFrame, lang: str | None = None) -> DataFrame:
    """One lineup a site: lineup, preset and its station, in the site's order."""
    return channels.select(F.col("site").alias("lineup"), "channel_rank", "preset", F.struct(*station(lang)).alias("station"))


def chosen(channels: DataFrame, lineup: DataFrame) -> DataFrame:
    """The channels that a lineup (xmltv_id) names."""
    return channels.join(lineup.select("xmltv_id"), "xmltv_id", "left_semi")


class _Lines:
    def __init__(self):
        self.out: list[str] = []

    def leaf(self, depth: int, tag: str, value, attrs: str = "") -> None:
        if value is not None:
            text = str(value).lower() if isinstance(value, bool) else str(value)
            self.out.append(f"{'  ' * depth}<{tag}{attrs}>{escape(text)}</{tag}>")

    def block(self, depth: int, tag: str, attrs: str = ""):
        self.out.append(f"{'  ' * depth}<{tag}{attrs}>")
        return lambda: self.out.append(f"{'  ' * depth}</{tag}>")


#: Delivery kind -> element, and its children (tag, field) in the schema's order.
DELIVERY = {
    "dvb": ("dvb-channel", [("original-network-id", "original_network_id"), ("transport-id", "transport_id"), ("service-id", "service_id"), ("lcn", "lcn"), ("service-name", "service_name"), ("provider-name", "provider_name"), ("encrypted", "encrypted")]),
    "stb": ("stb-channel", [("stb-preset", "preset")]),
    "iptv": ("iptv-channel", [("iptv-url", "url"), ("port", "port")]),
    "analog": ("analog-channel", [("system", "system"), ("number", "number"), ("frequency", "frequency"), ("fcc-callsign", "fcc_callsign")]),
}


def lineups_xml(lineups: Iterable[Mapping], meta: Mapping[str, str] | None = None) -> str:
    """A document of lineups; raises TypeError where an entry is delivered in more than one way."""
    w = _Lines()
    w.out.append('<?xml version="1.0" encoding="UTF-8"?>')
    done = w.block(0, "xmltv-lineups", "".join(attr(k.replace("_", "-"), v) for k, v in (meta or {}).items()))
    for x in lineups:
        end = w.block(1, "xmltv-lineup", attr("id", x["id"]))
        w.leaf(2, "type", x.get("type") or "List")
        for n in x["display_name"]:
            w.leaf(2, "display-name", n["value"], attr("lang", n.get("lang")))
        for e in x["entries"]:
            _entry(w, e)
        end()
    done()
    return "\n".join(w.out) + "\n"


def _entry(w: _Lines, e: Mapping) -> None:
    kinds = [k for k in DELIVERY if e.get(k)]
    if len(kinds) > 1:
        raise TypeError(f"{e['station']['xmltv_id']!r} is delivered by {' and '.join(kinds)}; a lineup entry has one way")
    end = w.block(2, "lineup-entry")
    w.leaf(3, "preset", e.get("preset"))
    w.leaf(3, "section", e.get("section"))
    for p in e.get("packages") or ():
        w.leaf(3, "package", p["value"], attr("type", p.get("type")))
    s = e["station"]
    close = w.block(3, "station", attr("rfc2838", s["xmltv_id"]))
    w.leaf(4, "name", s.get("name"), attr("lang", s.get("lang")))
    w.leaf(4, "short-name", s.get("short_name"), attr("lang", s.get("lang")))
    if s.get("logo"):
        w.out.append(f"{'  ' * 4}<logo{attr('url', s['logo'])} />")
    close()
    for k in kinds:
        tag, fields = DELIVERY[k]
        for d in e[k]:
            close = w.block(3, tag)
            for child, field in fields:
                w.leaf(4, child, d.get(field))
            if k == "analog":
                w.out.append(f"{'  ' * 4}<cni{attr('tt-8-30-1', d.get('cni'))} />")
            close()
    end()
