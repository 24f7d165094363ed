"""Rows of the guide model from plain values: absent fields stay absent, empty arrays too.

Values may be given bare (``"words"``), with a language (``("words", "en")``) or whole (``{"value": ...}``).
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator, Mapping
from typing import Any

from .functions.dates import coerce_date
from .schema import ROLES

_TEXTS = ("title", "sub_title", "desc", "category", "keyword", "country", "display_name")
_DATES = ("start", "stop", "pdc_start", "vps_start", "date")
_TEXT = ("language", "orig_language")


def _present(**fields) -> dict:
    """Fields with a value; ``False`` and 0 are values."""
    return {k: v for k, v in fields.items() if v is not None and v != [] and v != {}}


def attributes(given: Mapping[str, Any] | None, base: Mapping[str, str] | None = None) -> dict[str, str] | None:
    """Extra attributes put over ``base``; one without a value changes nothing."""
    out = {**(base or {}), **{k: str(v) for k, v in (given or {}).items() if v is not None}}
    return out or None


def _many(value, one) -> list:
    return [one(v) for v in (value if isinstance(value, list) else [value])]


def words(value, lang: str | None = None, attrs: Mapping | None = None) -> dict:
    return {"value": value} | _present(lang=lang or None, attrs=attributes(attrs))


def _text(value) -> dict:
    return value if isinstance(value, dict) else words(*value) if isinstance(value, tuple) else words(value)


def _texts(value) -> list[dict]:
    return _many(value, _text)


def url(value: str, system: str | None = None) -> dict:
    return {"value": value} | _present(system=system)


def icon(src: str, width: float | None = None, height: float | None = None) -> dict:
    return {"src": src} | _present(width=width and float(width), height=height and float(height))


def image(value: str, type: str | None = None, size: int | str | None = None, orient: str | None = None, system: str | None = None) -> dict:
    return {"value": value} | _present(type=type, size=None if size is None else str(size), orient=orient, system=system)


def person(value: str, role: str | None = None, guest: bool | None = None, image: list | None = None, url: list | None = None) -> dict:
    return {"value": value} | _present(role=role, guest=guest, image=image, url=url)


def credits(**roles) -> dict | None:
    """People by role: names, (name, part) of actors, or whole persons."""
    unknown = set(roles) - {*ROLES, "extra"}
    if unknown:
        raise TypeError(f"no such role: {', '.join(sorted(unknown))}")
    one = lambda p: p if isinstance(p, dict) else person(*p) if isinstance(p, tuple) else person(p)
    return _present(**{r: roles["extra"] if r == "extra" else _many(v, one) for r, v in roles.items() if v}) or None


def rating(value: str, system: str | None = None, icons: list | None = None) -> dict:
    return {"value": value} | _present(system=system, icon=icons)


def review(value: str, type: str = "text", source: str | None = None, reviewer: str | None = None, lang: str | None = None) -> dict:
    return {"value": value, "type": type} | _present(source=source, reviewer=reviewer, lang=lang)


def subtitles(type: str | None = None, language=None) -> dict:
    return _present(type=type, language=None if language is None else _text(language))


def length(value: float, units: str = "minutes") -> dict:
    return {"units": units, "value": float(value)}


def video(present=None, colour=None, aspect: str | None = None, quality: str | None = None) -> dict:
    return _present(present=yes_no(present), colour=yes_no(colour), aspect=aspect, quality=quality)


def audio(present=None, stereo: str | None = None) -> dict:
    return _present(present=yes_no(present), stereo=stereo)


def shown(start=None, channel: str | None = None) -> dict:
    return _present(start=None if start is None else coerce_date(start), channel=channel)


def flag(text=None) -> dict:
    """premiere and last_chance: there, with or without words."""
    return {"flag": True} | ({} if text is None or text is True else {"text": _text(text)})


def yes_no(value) -> bool | None:
    """A truth value or its word; anything else is none."""
    return value if isinstance(value, bool) else {"yes": True, "no": False}.get(value)


def element(name: str, value: str | None = None, attrs: Mapping | None = None, children: Iterable[str] = ()) -> str:
    """An extension element, as the model holds it."""
    return json.dumps({"name": name} | _present(attributes=attributes(attrs), value=value, children=[json.loads(c) for c in children]), ensure_ascii=False)


_MANY = {"icon": lambda v: v if isinstance(v, dict) else icon(v), "url": lambda v: v if isinstance(v, dict) else url(v), "image": lambda v: v if isinstance(v, dict) else image(v), "rating": lambda v: v if isinstance(v, dict) else rating(v), "star_rating": lambda v: v if isinstance(v, dict) else rating(v), "review": lambda v: v if isinstance(v, dict) else review(v), "subtitles": lambda v: v if isinstance(v, dict) else subtitles(v)}


def programme(channel: str, start, **fields) -> dict:
    out: dict = {"channel": channel, "start": coerce_date(start), "title": []}
    for k, v in fields.items():
        if v is None:
            continue
        if k == "attrs":
            v = attributes(v)
        elif k in _TEXTS:
            v = _texts(v)
        elif k in _DATES:
            v = coerce_date(v)
        elif k in _TEXT:
            v = _text(v)
        elif k in _MANY:
            v = _many(v, _MANY[k])
        elif k in ("premiere", "last_chance"):
            v = v if isinstance(v, dict) else flag(v) if v is not False else None
        if v or v is False or k == "title":
            out[k] = v
    return out


def episode(season: int | None, number: int | None, part: int | None = None, parts: int | None = None) -> list[dict]:
    """Both notations of 1-based numbers."""
    zero = lambda n: "" if n is None else str(n - 1)
    own = "0/1" if part is None else f"{zero(part)}{'' if parts is None else f'/{parts}'}"
    shown = ("" if season is None else f"S{season:02d}") + ("" if number is None else f"E{number:02d}") + ("" if part is None else f" ({part}{'' if parts is None else f'/{parts}'})")
    return [{"system": "xmltv_ns", "value": f"{zero(season)}.{zero(number)}.{own}"}, {"system": "onscreen", "value": shown}]


def channel(id: str, *names, icon=None, url=None, extra: list | None = None, attrs: Mapping | None = None) -> dict:
    out: dict = {"id": id, "display_name": _texts(list(names))}
    return out | _present(icon=_many(icon, _MANY["icon"]) if icon else None, url=_many(url, _MANY["url"]) if url else None, extra=extra, attrs=attributes(attrs))


class Document:
    """A whole guide put together by hand: channels before programmes, each in the order given."""

    def __init__(self, indent: int | str | None = None, date=None, **meta):
        self.indent, self.meta = indent, _present(date=None if date is None else coerce_date(date), **meta)
        self.channels: list[dict] = []
        self.programmes: list[dict] = []

    def add(self, *rows: dict) -> Document:
        for r in rows:
            (self.channels if "id" in r else self.programmes).append(r)
        return self

    def chunks(self) -> Iterator[str]:
        from .sources.xml_sink import Writer

        w = Writer(self.indent)
        yield w.header(self.meta)
        yield from map(w.channel, self.channels)
        yield from map(w.programme, self.programmes)
        yield w.footer()

    def text(self) -> str:
        return "".join(self.chunks())

    def write(self, target) -> None:
        from .sources.xml_sink import write_output

        write_output(target, self.chunks())
