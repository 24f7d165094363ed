"""Reading guides tolerantly: what can't be used is reported as a row and the rest is kept.

``Scanner`` takes text in pieces of any size and gives events as soon as an element is complete; it holds one
incomplete element at most. The data source ``guide_xml`` runs it over files, one partition a file.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .. import schema
from ..functions.dates import DateError, date_of
from ..functions.text import decode
from .model import ATTRIBUTES, CHANNEL, CHOICES, PROGRAMME, ROLES

HEAD_LIMIT = 1 << 20


class NotAGuide(ValueError):
    """The document's root is another element, or doesn't come."""


class _More(Exception):
    """The buffer ends inside a construct."""


@dataclass(slots=True)
class Node:
    name: str
    at: int
    attrs: list = field(default_factory=list)  # name, value, position
    text: str = ""
    nodes: list = field(default_factory=list)


_NAME = r"[^\s<>/=\"'!?][^\s<>/=\"']*"
_OPEN = re.compile(rf"<({_NAME})((?:[^<>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
# an element of text alone, closed as it was opened: its name and attributes are what _OPEN finds, for nothing in them is given back
_LEAF = re.compile(r"<([^\s<>/=\"'!?][^\s<>/=\"']*+)((?:[^<>\"']++|\"[^\"]*+\"|'[^']*+')*+)>([^<]*+)</\1>")
# a programme or channel of such elements only, each attribute in double quotes after one space: read by three patterns, a tag isn't looked at by itself
_PAIRS = r"(?: [a-z][a-z-]*+=\"[^\"<>]*+\")*+"
_PLAIN = re.compile(rf"<(programme|channel)({_PAIRS})>((?:\s*+<([a-z][a-z-]*+){_PAIRS}>[^<]*+</\4>)*+)\s*+</\1>")
_PAIR, _CHILD = re.compile(r" ([a-z-]++)=\"([^\"]*+)\""), re.compile(rf"<([a-z-]++)({_PAIRS})>([^<]*+)</[a-z-]++>")
_CLOSE = re.compile(rf"</\s*({_NAME})?[^>]*>")
_ATTR = re.compile(rf"({_NAME})(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'<>]+)))?")
_SKIPS = (("<!--", "-->"), ("<?", "?>"), ("<![CDATA[", "]]>"))
_KNOWN = {kind: {x: (f, t) for x, f, t in of} for kind, of in ATTRIBUTES.items()}
_PARTS = {kind: {x: (f, k, many) for x, f, k, many in of} for kind, of in (
    ("programme", PROGRAMME), ("channel", CHANNEL), ("subtitles", [("language", "language", "text", False)]),
    ("rating", [("value", "value", "plain", False), ("icon", "icon", "icon", True)]), ("person", [("image", "image", "image", True), ("url", "url", "url", True)]),
)}
_NO_FIELD, _NO_PART = ("", None), ("", None, False)
_TEXTS = {"text", "url", "episode", "image"}  # attributes and a text, without rules of their own
_BRACKETS, _UNENDED, _ANY_TAG = re.compile(r"[\[\]>]"), re.compile(r"<[^<>]*$"), re.compile(r"<[^>]*>?")


class Scanner:
    """Holds one incomplete element and the place where it stands: a cursor moves through the buffer, which is cut only when more text comes."""

    def __init__(self, head_limit: int = HEAD_LIMIT, tolerate_missing_id: bool = False, zones: dict[str, int] | None = None, typed: bool = False):
        # typed events hold instants and pairs where others hold their JSON
        self._dated, self._pairs = (dict, lambda x: list(x.items())) if typed else (json_date, dict)
        self.buffer, self.base, self.pos, self.head_limit, self.tolerant, self.zones = "", 0, 0, head_limit, tolerate_missing_id, zones
        self.line, self.units, self.rooted, self.over = 1, 0, False, False
        self.mark = 0  # where ``line`` is counted to, and ``units``, the UTF-16 units before it in that line; the cursor stands there or after it
        self.warned: list[dict] = []

    # ------------------------------------------------------------ positions

    def _place(self, at: int) -> tuple[int, int]:
        """1-based line, and column in UTF-16 units, of a place at the cursor or after it."""
        self._settle()
        return self._count(at - self.base)

    def _count(self, at: int) -> tuple[int, int]:
        start = self.buffer.rfind("\n", self.mark, at) + 1
        if not start:
            return self.line, 1 + self.units + _units(self.buffer[self.mark : at])
        return self.line + self.buffer.count("\n", self.mark, at), 1 + _units(self.buffer[start:at])

    def _settle(self) -> None:
        """Count lines up to the cursor: only when a place is asked for, or what stands before the cursor goes."""
        if self.mark != self.pos:
            line, col = self._count(self.pos)
            self.line, self.units, self.mark = line, col - 1, self.pos

    def warn(self, code: str, message: str, at: int) -> None:
        line, col = self._place(at)
        self.warned.append({"code": code, "message": message, "line": line, "col": col})

    # ------------------------------------------------------------ pieces of text

    def feed(self, chunk: str) -> Iterator[tuple[str, dict]]:
        if self.buffer:
            self._settle()
            self.buffer, self.base, self.pos, self.mark = self.buffer[self.pos :] + chunk, self.base + self.pos, 0, 0
        else:
            self.buffer = chunk
        yield from self._events(False)

    def close(self) -> Iterator[tuple[str, dict]]:
        yield from self._events(True)
        if not self.rooted:
            return
        rest = self.buffer[self.pos :]
        if rest.strip() and not self.over:
            at = self.base + len(self.buffer) - len(rest.lstrip())
            self.warn("truncated-input", "input ended inside an element", at)
        yield from self._warnings()

    def _warnings(self) -> Iterator[tuple[str, dict]]:
        got, self.warned = self.warned, []
        yield from (("warning", w) for w in got)

    def _events(self, last: bool) -> Iterator[tuple[str, dict]]:
        while not self.over:
            try:
                got = self._next()
            except _More:
                self.warned = []
                if not self.rooted and len(self.buffer) - self.pos > self.head_limit:
                    raise NotAGuide(f"no <tv> in the first {self.head_limit} characters") from None
                return
            if got:
                yield got
            if self.warned:
                yield from self._warnings()

    def _skip(self, at: int) -> int | None:
        """The end of a comment, instruction, CDATA or declaration that starts here."""
        b = self.buffer
        if b[at + 1 : at + 2] not in ("!", "?", ""):
            return None
        for start, end in _SKIPS:
            if b.startswith(start, at):
                stop = b.find(end, at + len(start))
                if stop < 0:
                    raise _More
                return stop + len(end)
            if len(b) - at < len(start) and start.startswith(b[at:]):
                raise _More
        if b.startswith("<!", at):
            depth = 0
            for m in _BRACKETS.finditer(b, at):
                depth += {"[": 1, "]": -1}.get(m[0], 0)
                if m[0] == ">" and depth <= 0:
                    return m.end()
            raise _More
        return None

    def _tag(self, at: int) -> re.Match:
        m = _OPEN.match(self.buffer, at)
        if not m:
            if self.buffer.find(">", at) < 0 or _UNENDED.match(self.buffer, at):
                raise _More
            raise _Bad(_ANY_TAG.match(self.buffer, at).end())
        return m

    def _next(self) -> tuple[str, dict] | None:
        """One top-level construct."""
        b = self.buffer
        at = b.find("<", self.pos)
        if at < 0:
            raise _More
        if self.rooted and (m := _PLAIN.match(b, at)) and (got := self._plain(m)):
            self.pos = m.end()
            return got
        if (end := self._skip(at)) is not None:
            self.pos = end
            return None
        where = self.base + at
        if b.startswith("</", at):
            m = _CLOSE.match(b, at)
            if not m:
                raise _More
            if m[1] == "tv":
                self.over = True
            else:
                self.warn("malformed-markup", f"unexpected </{m[1] or ''}>", where)
            self.pos = m.end()
            return None
        try:
            m = self._tag(at)
            if not self.rooted:
                if m[1] != "tv":
                    raise NotAGuide(f"the root is <{m[1]}>, not <tv>")
                self.rooted, root = True, Node("tv", where, self._attributes(m))
                self.over = m[2].endswith("/")
                meta: dict = {}
                if root.attrs:
                    self._fill(meta, root, "meta")
                self.pos = m.end()
                return "meta", meta
            node, end = self._node(at, m)
        except _Bad as bad:
            self.warn("malformed-markup", "unreadable tag", where)
            self.pos = bad.args[0]
            return None
        got = None
        if node.name == "programme":
            got = self._programme(node)
        elif node.name == "channel":
            got = self._channel(node)
        else:
            self.warn("unknown-element", f"<{node.name}>", node.at)
        self.pos = end
        return got

    # ------------------------------------------------------------ plain elements

    def _plain(self, m: re.Match) -> tuple[str, dict] | None:
        """The event of a ``_PLAIN`` element, as ``_programme`` or ``_channel`` gives it; None if anything in it takes a rule or a warning."""
        kind, parts = m[1], _PARTS[m[1]]
        out: dict = {}
        if not self._strings(out, m[2], _KNOWN[kind]) or not ("start" in out and "channel" in out if kind == "programme" else "id" in out):
            return None
        out["title" if kind == "programme" else "display_name"] = []
        for name, attrs, text in _CHILD.findall(m[3]):
            f, what, many = parts.get(name, _NO_PART)
            value: dict = {}
            if what not in _TEXTS or attrs and not self._strings(value, attrs, _KNOWN[what]):
                return None
            value["value"] = decode(text.strip())
            if not many:
                if f in out:
                    return None
                out[f] = value
            elif f in out:
                out[f].append(value)
            else:
                out[f] = [value]
        return kind, out

    def _strings(self, out: dict, attrs: str, known: dict) -> bool:
        """Whether all these attributes are known, given once, and dates or texts that can be used."""
        for name, value in _PAIR.findall(attrs):
            f, type_ = known.get(name, _NO_FIELD)
            if f in out or not value:
                return False
            if type_ == "string":
                out[f] = decode(value)
            elif type_ == "date":
                try:
                    out[f] = self._dated(date_of(decode(value), self.zones))
                except DateError:
                    return False
            else:
                return False
        return True

    # ------------------------------------------------------------ trees

    def _attributes(self, m: re.Match) -> list:
        if not m[2]:
            return []
        out, seen, where = [], set(), self.base + m.start(2)
        for a in _ATTR.finditer(m[2]):
            name, double, single, bare = a.groups()
            if name in seen:
                self.warn("invalid-attribute", f"{name} is given twice", where + a.start())
            elif name != "__proto__":
                seen.add(name)
                out.append((name, decode(double or single or bare or ""), where + a.start()))
        return out

    def _node(self, at: int, m: re.Match) -> tuple[Node, int]:
        """An element, whose tag is ``m``, and its end; close tags that fit nothing open are skipped."""
        b = self.buffer
        root = Node(m[1], self.base + at, self._attributes(m))
        if m[2].endswith("/"):
            return root, m.end()
        stack, k = [root], m.end()
        while stack:
            nxt = b.find("<", k)
            if nxt < 0:
                raise _More
            stack[-1].text += b[k:nxt]
            m = _LEAF.match(b, nxt)
            if m and not m[2].endswith("/"):
                stack[-1].nodes.append(Node(m[1], self.base + nxt, self._attributes(m), m[3]))
                k = m.end()
                continue
            end = self._skip(nxt)
            if end is not None:
                if b.startswith("<![CDATA[", nxt):
                    stack[-1].text += b[nxt + 9 : end - 3]
                k = end
                continue
            if b.startswith("</", nxt):
                c = _CLOSE.match(b, nxt)
                if not c:
                    raise _More
                if c[1] == stack[-1].name:
                    stack.pop()
                else:
                    self.warn("malformed-markup", f"</{c[1] or ''}> closes nothing here", self.base + nxt)
                k = c.end()
                continue
            try:
                m = self._tag(nxt)
            except _Bad as bad:
                self.warn("malformed-markup", "unreadable tag", self.base + nxt)
                k = bad.args[0]
                continue
            child = Node(m[1], self.base + nxt, self._attributes(m))
            stack[-1].nodes.append(child)
            if not m[2].endswith("/"):
                stack.append(child)
            k = m.end()
        return root, k

    # ------------------------------------------------------------ values

    def _typed(self, type_: str, name: str, value: str, at: int, empty_zero: bool = False):
        try:
            if type_ == "date":
                return self._dated(date_of(value, self.zones))
            if type_ == "number":
                return number(value, empty_zero)
            if type_ == "yes-no":
                return {"yes": True, "no": False}[value]
            if type_ in CHOICES and value not in CHOICES[type_]:
                raise ValueError
            if not value:
                raise ValueError
            return value
        except (DateError, ValueError, KeyError):
            self.warn("invalid-attribute", f"{name}={value!r}", at)
            return None

    def _fill(self, out: dict, node: Node, kind: str) -> None:
        known = _KNOWN.get(kind) or {}
        more = {}
        for name, value, at in node.attrs:
            if name in known:
                f, t = known[name]
                if t == "string" and value:
                    out[f] = value
                    continue
                got = self._typed(t, name, value, at)
                if got is not None:
                    out[f] = got
                elif t == "review-type":
                    out[f] = "text"
            else:
                more[name] = value
        if more:
            out["attrs"] = self._pairs(more)

    def _text(self, node: Node) -> str:
        for child in node.nodes:
            self.warn("unknown-element", f"<{child.name}> in <{node.name}>", child.at)
        return decode(node.text.strip())

    def _extra(self, node: Node) -> dict:
        out: dict = {"name": node.name}
        if node.attrs:
            out["attributes"] = {n: v for n, v, _ in node.attrs}
        if text := decode(node.text.strip()):
            out["value"] = text
        if node.nodes:
            out["children"] = [self._extra(c) for c in node.nodes]
        return out

    def _children(self, out: dict, node: Node, kind: str) -> None:
        known = _PARTS[kind]
        for child in node.nodes:
            if child.name not in known:
                out.setdefault("extra", []).append(json.dumps(self._extra(child), ensure_ascii=False))
                continue
            f, kind, many = known[child.name]
            if not many and f in out:
                self.warn("invalid-element", f"a second <{child.name}>", child.at)
                continue
            value = self._value(child, kind)
            if value is None:
                continue
            if many:
                out.setdefault(f, []).append(value)
            else:
                out[f] = value

    def _value(self, node: Node, kind: str):
        if kind in _TEXTS:
            own: dict = {}
            self._fill(own, node, kind)
            own["value"] = self._text(node)
            return own
        if kind == "new":
            return True
        if kind == "date":
            try:
                return self._dated(date_of(self._text(node), self.zones))
            except DateError as e:
                self.warn("invalid-element", f"<date>: {e.reason}", node.at)
                return None
        out: dict = {}
        if kind == "flag":
            text: dict = {}
            self._fill(text, node, "text")
            text["value"] = self._text(node)
            return {"flag": True, "text": text} if text["value"] or len(text) > 1 else {"flag": True}
        if kind == "credits":
            for child in node.nodes:
                if child.name in ROLES:
                    out.setdefault(child.name, []).append(self._person(child))
                else:
                    out.setdefault("extra", []).append(json.dumps(self._extra(child), ensure_ascii=False))
            if not out:
                self.warn("invalid-element", "empty <credits>", node.at)
            return out or None
        self._fill(out, node, kind)
        if kind in ("video", "audio"):
            fields = ("present", "colour", "aspect", "quality") if kind == "video" else ("present", "stereo")
            for child in node.nodes:
                if child.name in fields and child.name not in out:
                    text = self._text(child)
                    if child.name in ("present", "colour"):
                        if (flag := {"yes": True, "no": False}.get(text)) is None:
                            self.warn("invalid-element", f"<{child.name}> is neither yes nor no", child.at)
                        else:
                            out[child.name] = flag
                    else:
                        out[child.name] = text
                elif child.name in fields:
                    self.warn("invalid-element", f"a second <{child.name}>", child.at)
                else:
                    out.setdefault("extra", []).append(json.dumps(self._extra(child), ensure_ascii=False))
            return out
        if kind == "subtitles":
            self._children(out, node, "subtitles")
            return out
        if kind == "rating":
            self._children(out, node, "rating")
            if "value" not in out:
                self.warn("invalid-element", f"<{node.name}> without <value>", node.at)
                return None
            return out
        if kind == "icon":
            if "src" not in out:
                self.warn("invalid-element", "<icon> without src", node.at)
                return None
            self._text(node)
            return out
        if kind == "shown":
            self._text(node)
            return out
        text = self._text(node)
        if kind == "plain":
            return text
        if kind == "length":
            value = number(text, True)
            if value is None or "units" not in out:
                self.warn("invalid-element", "bad <length>", node.at)
                return None
            return {**out, "value": value}
        if kind == "review":
            out.setdefault("type", "text")
        out["value"] = text
        return out

    def _person(self, node: Node) -> dict:
        out: dict = {}
        self._fill(out, node, "actor" if node.name == "actor" else "person")
        self._children(out, node, "person")
        out["value"] = decode(node.text.strip())
        return out

    def _programme(self, node: Node) -> tuple[str, dict] | None:
        out: dict = {}
        self._fill(out, node, "programme")
        if "start" not in out:
            self.warn("invalid-programme", "no usable start", node.at)
            return None
        if "channel" not in out:
            if not self.tolerant:
                self.warn("invalid-programme", "no channel", node.at)
                return None
            out["channel"] = ""
        out["title"] = []
        self._children(out, node, "programme")
        return "programme", out

    def _channel(self, node: Node) -> tuple[str, dict] | None:
        out: dict = {}
        self._fill(out, node, "channel")
        if "id" not in out:
            if not self.tolerant:
                self.warn("invalid-element", "<channel> without id", node.at)
                return None
            out["id"] = ""
        out["display_name"] = []
        self._children(out, node, "channel")
        return "channel", out


class _Bad(Exception):
    """A tag that can't be read; its argument is where to go on."""


def _units(text: str) -> int:
    """UTF-16 code units."""
    return len(text) if text.isascii() else len(text) + sum(c > "\uffff" for c in text)


def json_date(d: dict) -> dict:
    return {**d, "ts": d["ts"].strftime("%Y-%m-%dT%H:%M:%S.000Z") if d["ts"].year >= 1000 else d["ts"].isoformat().replace("+00:00", ".000Z")}


def number(text: str, empty_zero: bool = False) -> float | None:
    """Decimal, exponent or 0x/0o/0b notation; an empty text is 0 where a value may be empty."""
    text = text.strip()
    if not text:
        return 0.0 if empty_zero else None
    if re.fullmatch(r"0[xX][0-9a-fA-F]+|0[oO][0-7]+|0[bB][01]+", text):
        return float(int(text, 0))
    return float(text) if re.fullmatch(r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?", text) else None


def parse(text: str | Iterable[str], **options) -> Iterator[tuple[str, dict]]:
    scanner = Scanner(**options)
    for chunk in [text] if isinstance(text, str) else text:
        yield from scanner.feed(chunk)
    yield from scanner.close()


KINDS = {"meta": schema.META, "channel": schema.CHANNEL, "programme": schema.PROGRAMME}
BATCH = 1024  # events handed over at once
NARROW = 8  # leaves of a type that Arrow takes apart faster than Python


def event_type(wanted: dict[str, Iterable[str]] | None = None) -> str:
    """Columns of events: of all kinds with all fields, or of the kinds and fields wanted (a warning's are always all four)."""
    out = ["path string", "seq long", "kind string"]
    for kind, types in KINDS.items():
        if wanted is None or kind in wanted:
            out.append(f"{kind} {schema.struct(types if wanted is None else {f: types[f] for f in wanted[kind]})}")
    if wanted is None or "warning" in wanted:
        out.append("code string, message string, line int, col int")
    return ", ".join(out)


EVENT = event_type()


def _leaves(type_: pa.DataType) -> int:
    inner = [f.type for f in type_] if pa.types.is_struct(type_) else [type_.value_type] if pa.types.is_list(type_) else []
    return sum(map(_leaves, inner)) if inner else 1


def _column(values: list, type_: pa.DataType) -> pa.Array:
    """An Arrow array of nested values. Wide ones are made a field at a time: what none of them has is null without a look at each."""
    if _leaves(type_) <= NARROW:
        return pa.array(values, type_)
    if pa.types.is_struct(type_):
        there = [v for v in values if v is not None]
        if not there:
            return pa.nulls(len(values), type_)
        names, mask = set().union(*there), None
        if len(there) < len(values):
            mask, values = pa.array([v is None for v in values]), [v or {} for v in values]
        return pa.StructArray.from_arrays([_column([v.get(f.name) for v in values], f.type) if f.name in names else pa.nulls(len(values), f.type) for f in type_], fields=list(type_), mask=mask)
    flat, starts = [], []
    for v in values:
        starts.append(None if v is None else len(flat))
        flat += v or ()
    return pa.ListArray.from_arrays(pa.array([*starts, len(flat)], pa.int32()), _column(flat, type_.value_type), type=type_)


def batches_of(documents: Iterable[tuple[str, Iterator[tuple[str, dict]]]], fields: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Typed events of documents (path, events) as Arrow batches with these columns of ``EVENT``; events of kinds that have no column are numbered and left out."""
    handed = {k for k in KINDS if k in fields.names} | ({"warning"} if "code" in fields.names else set())
    paths, seqs, kinds, given = [], [], [], []

    def column(f: pa.Field) -> pa.Array:
        if f.name in KINDS:
            return _column([v if k == f.name else None for k, v in zip(kinds, given)], f.type)
        return pa.array([v[f.name] if k == "warning" else None for k, v in zip(kinds, given)], f.type)

    def batch() -> pa.RecordBatch:
        first = [pa.array(x, f.type) for x, f in zip((paths, seqs, kinds), fields)]
        return pa.RecordBatch.from_arrays(first + [column(f) for f in list(fields)[3:]], schema=fields)

    for path, found in documents:
        for seq, (kind, value) in enumerate(found):
            if kind in handed:
                paths.append(path)
                seqs.append(seq)
                kinds.append(kind)
                given.append(value)
                if len(paths) == BATCH:
                    yield batch()
                    paths, seqs, kinds, given = [], [], [], []
    if paths:
        yield batch()


class GuideSource(DataSource):
    """spark.read.format("guide_xml").load(path): one row an event, its element in the column of its kind; a file is a partition."""

    @classmethod
    def name(cls) -> str:
        return "guide_xml"

    def schema(self) -> str:
        return EVENT

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options, to_arrow_schema(schema))


class _Reader(DataSourceReader):
    def __init__(self, options, fields: pa.Schema):
        self.fields = fields
        self.path = options["path"]
        self.options = {"tolerate_missing_id": options.get("tolerateMissingId", "false").lower() == "true"}

    def partitions(self):
        import pyarrow.fs as fs

        store, path = fs.FileSystem.from_uri(self.path if "://" in self.path else "file://" + self.path)
        info = store.get_file_info(path)
        files = [info] if info.type == fs.FileType.File else store.get_file_info(fs.FileSelector(path, recursive=True))
        return [InputPartition(f.path) for f in files if f.type == fs.FileType.File and not f.base_name.startswith((".", "_"))] or [InputPartition(None)]

    def read(self, partition):
        import codecs

        import pyarrow.fs as fs

        if partition.value is None:
            return
        store, _ = fs.FileSystem.from_uri(self.path if "://" in self.path else "file://" + self.path)
        utf8 = codecs.getincrementaldecoder("utf-8-sig")("replace")

        def chunks():
            with store.open_input_stream(partition.value) as f:
                while block := f.read(1 << 19):
                    yield utf8.decode(block)
            yield utf8.decode(b"", True)

        yield from batches_of([(partition.value, parse(chunks(), typed=True, **self.options))], self.fields)


def parse_column(docs: DataFrame, path: str = "path", content: str = "content", wanted: dict[str, Iterable[str]] | None = None) -> DataFrame:
    """Events of documents held in a string column, without leaving the executors.

    Documents are scanned whole whatever is ``wanted`` (kind -> fields); what isn't is not handed to Spark, whose optimiser can't tell Python.
    """
    ddl = event_type(wanted)
    fields = to_arrow_schema(T.StructType.fromDDL(ddl))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            documents = ((p.as_py(), parse(t.as_py() or "", typed=True)) for p, t in zip(batch.column(0), batch.column(1), strict=True))
            yield from batches_of(documents, fields)

    return docs.select(path, content).mapInArrow(run, ddl)


def tables(events: DataFrame) -> dict[str, DataFrame]:
    """meta, channels, programmes and warnings of events, as far as they have columns, typed as in ``schema``."""
    out = {name: events.where(F.col("kind") == kind).select("path", "seq", f"{kind}.*") for name, kind in (("meta", "meta"), ("channels", "channel"), ("programmes", "programme")) if kind in events.columns}
    if "code" in events.columns:
        out["warnings"] = events.where("kind = 'warning'").select("path", "seq", "code", "message", "line", "col")
    return out


def read_guide(spark: SparkSession, path: str, **options) -> dict[str, DataFrame]:
    spark.dataSource.register(GuideSource)
    return tables(spark.read.format("guide_xml").options(**options).load(path))
