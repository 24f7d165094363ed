"""Writing guides: an XML string per row, made where the row is, and one ordered document."""

from __future__ import annotations

import json
import os
import socket
import stat
import tempfile
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.dates import text_of
from ..functions.text import ESCAPES, escape
from .model import ATTRIBUTES, CHANNEL, PROGRAMME, ROLES, attr, number_text

HEADER = '<?xml version="1.0" encoding="UTF-8"?>'
DOCTYPE = '<!DOCTYPE tv SYSTEM "xmltv.dtd">'


class Writer:
    """indent: None for compact, a number of spaces, or the string itself."""

    def __init__(self, indent: int | str | None = None):
        self.unit = " " * indent if isinstance(indent, int) else indent or ""
        self.nl = "\n" if self.unit else ""

    def attributes(self, kind: str, x: dict) -> str:
        out = ""
        for name, field, type_ in ATTRIBUTES.get(kind, ()):
            value = x.get(field)
            if value is not None:
                if type_ == "date":
                    value = text_of(value)
                elif type_ == "number":
                    value = number_text(value)
                elif type_ == "yes-no":
                    value = "yes" if value else None
                out += attr(name, value)
        return out + "".join(attr(k, v) for k, v in (x.get("attrs") or {}).items())

    def leaf(self, pad: str, name: str, attrs: str, text: str | None) -> str:
        return f"{pad}<{name}{attrs}/>{self.nl}" if text is None else f"{pad}<{name}{attrs}>{escape(text)}</{name}>{self.nl}"

    def extra(self, x) -> str:
        x = json.loads(x) if isinstance(x, str) else x
        attrs = "".join(attr(k, v) for k, v in (x.get("attributes") or {}).items())
        inner = escape(x["value"]) if x.get("value") is not None else ""
        inner += "".join(map(self.extra, x.get("children") or ()))
        return f"<{x['name']}{attrs}>{inner}</{x['name']}>" if inner else f"<{x['name']}{attrs}/>"

    def extras(self, pad: str, xs) -> str:
        return "".join(f"{pad}{self.extra(x)}{self.nl}" for x in xs or ())

    def block(self, pad: str, name: str, attrs: str, inner: str, empty: bool = True) -> str:
        if inner:
            return f"{pad}<{name}{attrs}>{self.nl}{inner}{pad}</{name}>{self.nl}"
        return f"{pad}<{name}{attrs}/>{self.nl}" if empty else ""

    def element(self, pad: str, name: str, kind: str, x) -> str:
        deeper = pad + self.unit
        if kind == "date":
            return self.leaf(pad, name, "", text_of(x, offset=False))
        if kind == "new":
            return self.leaf(pad, name, "", None) if x else ""
        if kind == "flag":
            words = x.get("text")
            return self.leaf(pad, name, self.attributes("text", words), words["value"]) if words else self.leaf(pad, name, "", None) if x.get("flag") else ""
        if kind == "credits":
            inner = "".join(self.person(deeper, r, p) for r in ROLES for p in x.get(r) or ())
            return self.block(pad, name, "", inner + self.extras(deeper, x.get("extra")), empty=False)
        attrs = self.attributes(kind, x)
        if kind in ("video", "audio"):
            inner = ""
            for field in ("present", "colour", "aspect", "quality", "stereo"):
                if (value := x.get(field)) is not None:
                    inner += self.leaf(deeper, field, "", ("yes" if value else "no") if isinstance(value, bool) else value)
            return self.block(pad, name, attrs, inner + self.extras(deeper, x.get("extra")))
        if kind == "subtitles":
            inner = self.element(deeper, "language", "text", x["language"]) if x.get("language") else ""
            return self.block(pad, name, attrs, inner + self.extras(deeper, x.get("extra")))
        if kind == "rating":
            inner = self.leaf(deeper, "value", "", x["value"]) + "".join(self.element(deeper, "icon", "icon", i) for i in x.get("icon") or ())
            return self.block(pad, name, attrs, inner + self.extras(deeper, x.get("extra")))
        if kind in ("icon", "shown"):
            return self.leaf(pad, name, attrs, None)
        return self.leaf(pad, name, attrs, number_text(x["value"]) if kind == "length" else x["value"])

    def person(self, pad: str, role: str, p: dict) -> str:
        attrs = self.attributes("actor" if role == "actor" else "person", p)
        flat = Writer()
        inner = "".join(flat.element("", "image", "image", i) for i in p.get("image") or ()) + "".join(flat.element("", "url", "url", u) for u in p.get("url") or ()) + "".join(map(self.extra, p.get("extra") or ()))
        return f"{pad}<{role}{attrs}>{escape(p['value'] or '')}{inner}</{role}>{self.nl}"

    def body(self, name: str, kind: str, grammar, x: dict) -> str:
        pad, deeper = self.unit, self.unit * 2
        inner = ""
        for tag, field, what, many in grammar:
            value = x.get(field)
            if value is not None:
                inner += "".join(self.element(deeper, tag, what, v) for v in (value if many else [value]))
        return f"{pad}<{name}{self.attributes(kind, x)}>{self.nl}{inner}{self.extras(deeper, x.get('extra'))}{pad}</{name}>{self.nl}"

    def programme(self, x: dict) -> str:
        return self.body("programme", "programme", PROGRAMME, x)

    def channel(self, x: dict) -> str:
        return self.body("channel", "channel", CHANNEL, x)

    def header(self, meta: dict | None = None) -> str:
        return f"{HEADER}{self.nl}{DOCTYPE}{self.nl}<tv{self.attributes('meta', meta or {})}>{self.nl}"

    def footer(self) -> str:
        return f"</tv>{self.nl}"


def _quoted(text: str) -> str:
    for a, b in (("\\", "\\\\"), ("'", "\\'"), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        text = text.replace(a, b)
    return f"'{text}'"


def _joined(*parts: str) -> str:
    return f"concat({', '.join(p for p in parts if p != _quoted(''))})" if len(parts) > 1 else parts[0]


def _escaped(x: str) -> str:
    for char, entity in ESCAPES:
        x = f"replace({x}, {_quoted(char)}, {_quoted(entity)})"
    return x


def _day(x: str, offset: bool = True) -> str:
    """``format_date`` of a date struct."""
    off = f"coalesce({x}.off, 0)"
    wall = f"substring(date_format(cast({x}.ts as timestamp_ntz) + make_dt_interval(0, 0, {off}, 0), 'yyyyMMddHHmmss'), 1, coalesce({x}.prec, 14))"
    zone = f"' ', if({off} < 0, '-', '+'), lpad(cast(abs({off}) div 60 as string), 2, '0'), lpad(cast(abs({off}) % 60 as string), 2, '0')"
    return f"concat({wall}, {zone})" if offset else wall


class Builder:
    """``Writer`` as one SQL expression over a struct of a known type: the text is made without leaving the JVM.

    It is written as text because a guide's grammar makes thousands of calls of column functions. What expressions can't say
    (extension elements, which are JSON, and numbers that aren't whole) is told by ``odd``; such rows go to ``Writer``.
    """

    def __init__(self, indent: int | str | None = None):
        w = Writer(indent)
        self.unit, self.nl, self.names = w.unit, w.nl, 0

    def variable(self) -> str:
        self.names += 1
        return f"v{self.names}"

    def attributes(self, kind: str, x: str, type_: T.StructType) -> list[str]:
        out = []
        for name, field, what in ATTRIBUTES.get(kind, ()):
            if field in type_.names:
                value = f"{x}.{field}"
                text = _day(value) if what == "date" else self.number(value) if what == "number" else f"if({value}, 'yes', null)" if what == "yes-no" else _escaped(value)
                quote = _quoted('"')
                out.append(f"coalesce(concat({_quoted(f' {name}=' + chr(34))}, {text}, {quote}), '')")
        if "attrs" in type_.names:
            e = self.variable()
            start = _quoted('="')
            out.append(f"coalesce(array_join(transform(map_entries({x}.attrs), {e} -> concat(' ', {e}.key, {start}, {_escaped(f'{e}.value')}, {_quoted(chr(34))})), ''), '')")
        return out

    def number(self, x: str) -> str:
        return f"cast(cast({x} as bigint) as string)"

    def leaf(self, pad: str, name: str, attrs: list[str], text: str | None) -> str:
        bare = _quoted(f"/>{self.nl}")
        if text is not None:
            bare = f"coalesce(concat('>', {_escaped(text)}, {_quoted(f'</{name}>{self.nl}')}), {bare})"
        return _joined(_quoted(f"{pad}<{name}"), *attrs, bare)

    def block(self, pad: str, name: str, attrs: list[str], inner: list[str], empty: bool = True) -> str:
        if not inner:
            return _joined(_quoted(f"{pad}<{name}"), *attrs, _quoted(f"/>{self.nl}")) if empty else "''"
        b, head = self.variable(), _joined(_quoted(f"{pad}<{name}"), *attrs)
        close = f"concat({_quoted(f'>{self.nl}')}, {b}, {_quoted(f'{pad}</{name}>{self.nl}')})"
        one = f"concat({head}, if({b} = '', {_quoted(f'/>{self.nl}')}, {close}))" if empty else f"if({b} = '', '', concat({head}, {close}))"
        return f"transform(array({_joined(*inner)}), {b} -> {one})[0]"

    def each(self, items: str, one: Callable[[str], str]) -> str:
        v = self.variable()
        return f"coalesce(array_join(transform({items}, {v} -> {one(v)}), ''), '')"

    def maybe(self, x: str, text: str) -> str:
        return f"if({x} is null, '', {text})"

    def element(self, pad: str, name: str, kind: str, x: str, type_: T.DataType) -> str:
        """One element of a value that is there."""
        deeper, there = pad + self.unit, _quoted(f"{pad}<{name}/>{self.nl}")
        if kind == "date":
            return self.leaf(pad, name, [], _day(x, offset=False))
        if kind == "new":
            return f"if({x}, {there}, '')"
        if kind == "flag":
            bare = f"if({x}.flag, {there}, '')" if "flag" in type_.names else "''"
            return f"if({x}.text is null, {bare}, {self.leaf(pad, name, self.attributes('text', f'{x}.text', type_['text'].dataType), f'{x}.text.value')})" if "text" in type_.names else bare
        if kind == "credits":
            return self.block(pad, name, [], [self.each(f"{x}.{r}", lambda p, r=r: self.person(deeper, r, p, type_[r].dataType.elementType)) for r in ROLES if r in type_.names], empty=False)
        attrs = self.attributes(kind, x, type_)
        if kind in ("video", "audio"):
            fields = [f for f in ("present", "colour", "aspect", "quality", "stereo") if f in type_.names]
            text = lambda f: f"if({x}.{f}, 'yes', 'no')" if f in ("present", "colour") else f"{x}.{f}"
            return self.block(pad, name, attrs, [self.maybe(f"{x}.{f}", self.leaf(deeper, f, [], text(f))) for f in fields])
        if kind == "subtitles":
            own = [self.maybe(f"{x}.language", self.element(deeper, "language", "text", f"{x}.language", type_["language"].dataType))] if "language" in type_.names else []
            return self.block(pad, name, attrs, own)
        if kind == "rating":
            icons = [self.each(f"{x}.icon", lambda i: self.element(deeper, "icon", "icon", i, type_["icon"].dataType.elementType))] if "icon" in type_.names else []
            return self.block(pad, name, attrs, [self.leaf(deeper, "value", [], f"{x}.value"), *icons])
        if kind in ("icon", "shown"):
            return self.leaf(pad, name, attrs, None)
        return self.leaf(pad, name, attrs, self.number(f"{x}.value") if kind == "length" else f"{x}.value")

    def person(self, pad: str, role: str, p: str, type_: T.StructType) -> str:
        unit, nl = self.unit, self.nl
        self.unit = self.nl = ""  # what stands in a person's text is not set apart
        inner = [self.each(f"{p}.{f}", lambda v, f=f: self.element("", f, f, v, type_[f].dataType.elementType)) for f in ("image", "url") if f in type_.names]
        self.unit, self.nl = unit, nl
        attrs = self.attributes("actor" if role == "actor" else "person", p, type_)
        return _joined(_quoted(f"{pad}<{role}"), *attrs, "'>'", f"coalesce({_escaped(f'{p}.value')}, '')", *inner, _quoted(f"</{role}>{nl}"))

    def body(self, name: str, grammar, x: str, type_: T.StructType) -> str:
        parts = []
        for tag, field, what, many in grammar:
            if field in type_.names:
                own, at = type_[field].dataType, f"{x}.{field}"
                parts.append(self.each(at, lambda v, own=own, tag=tag, what=what: self.element(self.unit * 2, tag, what, v, own.elementType)) if many else self.maybe(at, self.element(self.unit * 2, tag, what, at, own)))
        return _joined(_quoted(f"{self.unit}<{name}"), *self.attributes(name, x, type_), _quoted(f">{self.nl}"), *parts, _quoted(f"{self.unit}</{name}>{self.nl}"))

    def odd(self, x: str, type_: T.DataType) -> list[str]:
        """Conditions under which a value can't be written: extension elements, fractions, years of other than four digits."""
        if isinstance(type_, T.ArrayType):
            v = self.variable()
            inner = self.odd(v, type_.elementType)
            return [f"coalesce(exists({x}, {v} -> {' or '.join(inner)}), false)"] if inner else []
        out = []
        for f in type_.fields if isinstance(type_, T.StructType) else ():
            at = f"{x}.{f.name}"
            if f.name == "extra":
                out.append(f"{at} is not null")
            elif isinstance(f.dataType, T.DoubleType):
                out.append(f"coalesce({at} != floor({at}) or abs({at}) > 1e15 or isnan({at}), false)")
            elif isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
                out.append(f"coalesce(year({at}) not between 1001 and 9998, false)")
            else:
                out += self.odd(at, f.dataType)
        return out


def to_xml(kind: str, row: Column, indent: int | str | None = None) -> Column:
    """The XML of a channel or programme struct by ``Writer``: rows go to Python as JSON in Arrow batches."""
    write = getattr(Writer(indent), kind)

    def convert(rows: pd.Series) -> pd.Series:
        return rows.map(lambda r: None if r is None else write(json.loads(r)))

    convert.__annotations__ = {"rows": pd.Series, "return": pd.Series}
    return F.pandas_udf(convert, T.StringType())(F.to_json(row, {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSXXX", "timeZone": "UTC"}))


def with_xml(df: DataFrame, kind: str, row: Column, *others: str, indent: int | str | None = None) -> DataFrame:
    """``others`` and the XML of the struct ``row`` as ``xml``: built by an expression, and by ``to_xml`` for the rows it can't write."""
    rows = df.select(*others, row.alias("_row"))
    type_, builder = rows.schema["_row"].dataType, Builder(indent)
    built, odd = builder.body(kind, {"programme": PROGRAMME, "channel": CHANNEL}[kind], "_row", type_), builder.odd("_row", type_)
    if not odd:
        return rows.select(*others, F.expr(built).alias("xml"))
    # a Python function sees every row whatever stands around it: rows that don't need it are null there
    rows = rows.withColumn("_odd", F.expr(" or ".join(odd)))
    return rows.select(*others, F.coalesce(to_xml(kind, F.when(F.col("_odd"), F.col("_row")), indent), F.expr(f"if(_odd, null, {built})")).alias("xml"))


def document(channels: DataFrame | None, programmes: DataFrame | None, meta: dict | None = None, indent: int | str | None = None) -> Iterator[str]:
    """The document in pieces: ``channels`` and ``programmes`` have order columns ``rank`` and a string ``xml``."""
    w = Writer(indent)
    yield w.header(meta)
    for part in (channels, programmes):
        if part is not None:
            keys = [c for c in ("rank", "out_seq") if c in part.columns]
            for r in part.orderBy(*keys).select("xml").toLocalIterator(prefetchPartitions=True):  # one partition at a time
                if r["xml"]:
                    yield r["xml"]
    yield w.footer()


class EventWriter:
    """Events to text as they come: given meta stands above the document's own, elements are written at once, warnings passed on."""

    def __init__(self, meta: dict | None = None, indent: int | str | None = None, on_warning: Callable[[dict], None] | None = None):
        self.writer, self.meta, self.on_warning = Writer(indent), meta, on_warning
        self.begun = False

    def _begin(self, meta: dict | None) -> str:
        self.begun = True
        return self.writer.header({**(meta or {}), **(self.meta or {})})

    def event(self, kind: str, value: dict) -> str:
        if kind == "warning":
            if self.on_warning:
                self.on_warning(value)
            return ""
        if kind == "meta":
            if self.begun:
                raise ValueError("meta came after the document had begun")
            return self._begin(value)
        if kind not in ("channel", "programme"):
            raise TypeError(f"no such event: {kind!r}")
        return ("" if self.begun else self._begin(None)) + getattr(self.writer, kind)(value)

    def end(self) -> str:
        return ("" if self.begun else self._begin(None)) + self.writer.footer()


def serialize(events: Iterable[tuple[str, dict]], meta: dict | None = None, indent: int | str | None = None, on_warning: Callable[[dict], None] | None = None) -> Iterator[str]:
    """A document's text from its events, piece by piece."""
    w = EventWriter(meta, indent, on_warning)
    for kind, value in events:
        if text := w.event(kind, value):
            yield text
    yield w.end()


def write_output(target, chunks: Iterable[str]) -> None:
    """To a file (replaced as a whole or not at all), a Unix socket, or an open stream, which stays open."""
    if hasattr(target, "write"):
        for c in chunks:
            target.write(c)
        return
    if os.path.exists(target) and stat.S_ISSOCK(os.stat(target).st_mode):
        with socket.socket(socket.AF_UNIX) as s:
            s.connect(target)
            for c in chunks:
                s.sendall(c.encode())
        return
    folder, made = os.path.dirname(os.path.abspath(target)), []
    at = folder
    while not os.path.isdir(at):
        made.append(at)
        at = os.path.dirname(at)
    os.makedirs(folder, exist_ok=True)
    handle, temp = tempfile.mkstemp(dir=folder, prefix=".guide-")
    try:
        with os.fdopen(handle, "w", encoding="utf-8", newline="") as f:
            for c in chunks:
                f.write(c)
            f.flush()
            os.fsync(f.fileno())
        os.replace(temp, target)
    except BaseException:
        os.unlink(temp)
        for d in made:
            try:
                os.rmdir(d)
            except OSError:
                break
        raise
