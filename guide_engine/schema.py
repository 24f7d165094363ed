"""Column types of the guide model. Absent is NULL, and an array other than title and display_name is never empty."""

from __future__ import annotations

ATTRS = "attrs: map<string,string>"
XDATE = "struct<ts: timestamp, off: int, prec: int>"
TEXT = f"struct<value: string, lang: string, {ATTRS}>"
URL = f"struct<value: string, system: string, {ATTRS}>"
ICON = f"struct<src: string, width: double, height: double, {ATTRS}>"
IMAGE = f"struct<value: string, type: string, size: string, orient: string, system: string, {ATTRS}>"
PERSON = f"struct<value: string, role: string, guest: boolean, image: array<{IMAGE}>, url: array<{URL}>, extra: array<string>, {ATTRS}>"
ROLES = ("director", "actor", "writer", "adapter", "producer", "composer", "editor", "presenter", "commentator", "guest")
CREDITS = "struct<" + ", ".join(f"{r}: array<{PERSON}>" for r in ROLES) + ", extra: array<string>>"
RATING = f"struct<value: string, system: string, icon: array<{ICON}>, extra: array<string>, {ATTRS}>"
EPISODE = f"struct<value: string, system: string, {ATTRS}>"
LENGTH = f"struct<units: string, value: double, {ATTRS}>"
VIDEO = f"struct<present: boolean, colour: boolean, aspect: string, quality: string, extra: array<string>, {ATTRS}>"
AUDIO = f"struct<present: boolean, stereo: string, extra: array<string>, {ATTRS}>"
SHOWN = f"struct<start: {XDATE}, channel: string, {ATTRS}>"
FLAG = f"struct<flag: boolean, text: {TEXT}>"
SUBTITLES = f"struct<type: string, language: {TEXT}, extra: array<string>, {ATTRS}>"
REVIEW = f"struct<value: string, type: string, source: string, reviewer: string, lang: string, {ATTRS}>"

#: Field -> type, in the order in which they are written.
PROGRAMME = {
    "channel": "string", "start": XDATE, "stop": XDATE, "pdc_start": XDATE, "vps_start": XDATE, "showview": "string", "videoplus": "string", "clumpidx": "string",
    "title": f"array<{TEXT}>", "sub_title": f"array<{TEXT}>", "desc": f"array<{TEXT}>", "credits": CREDITS, "date": XDATE, "category": f"array<{TEXT}>",
    "keyword": f"array<{TEXT}>", "language": TEXT, "orig_language": TEXT, "length": LENGTH, "icon": f"array<{ICON}>", "url": f"array<{URL}>", "country": f"array<{TEXT}>",
    "episode_num": f"array<{EPISODE}>", "video": VIDEO, "audio": AUDIO, "previously_shown": SHOWN, "premiere": FLAG, "last_chance": FLAG, "is_new": "boolean",
    "subtitles": f"array<{SUBTITLES}>", "rating": f"array<{RATING}>", "star_rating": f"array<{RATING}>", "review": f"array<{REVIEW}>", "image": f"array<{IMAGE}>",
    "extra": "array<string>", "attrs": "map<string,string>",
}
CHANNEL = {"id": "string", "display_name": f"array<{TEXT}>", "icon": f"array<{ICON}>", "url": f"array<{URL}>", "extra": "array<string>", "attrs": "map<string,string>"}
META = {"date": XDATE, "source_info_name": "string", "source_info_url": "string", "source_data_url": "string", "generator_info_name": "string", "generator_info_url": "string", "attrs": "map<string,string>"}


def ddl(fields: dict[str, str]) -> str:
    return ", ".join(f"`{k}` {v}" for k, v in fields.items())


def struct(fields: dict[str, str]) -> str:
    return "struct<" + ", ".join(f"{k}: {v}" for k, v in fields.items()) + ">"


def pairs(x):
    """A row made of dicts with its maps as lists of pairs, as Arrow takes them."""
    if isinstance(x, dict):
        return {k: list(v.items()) if k == "attrs" and isinstance(v, dict) else pairs(v) for k, v in x.items()}
    return [pairs(v) for v in x] if isinstance(x, list) else x
