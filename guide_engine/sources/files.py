"""The channel-day cache as plain files, one folder a site and channel: rows as NDJSON or as a guide document, meta beside them.

``CacheStore`` is what a command needs of any cache. An entry is there if its meta is: rows alone are the remains of a broken run, and an
entry whose meta can't be read is removed. All days are read by Spark, a task a file; single entries are written whole or not at all.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterable
from datetime import date
from typing import Protocol
from urllib.parse import quote, unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema
from . import xml_source
from .xml_sink import Writer, write_output

KEYS = ["site", "channel_id", "day"]
_TIMES = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSXXX", "timeZone": "UTC"}
#: What a path segment keeps as it is; all else is percent-encoded.
_KEPT = "!'()*-._~"


class CacheStore(Protocol):
    """Channel-days by site, channel and day."""

    def programmes(self) -> DataFrame: ...
    def entries(self) -> DataFrame: ...
    def write(self, rows: DataFrame, entries: DataFrame) -> None: ...
    def delete(self, keys: DataFrame) -> None: ...
    def prune(self, before: Column) -> int: ...


def segment(name: str) -> str:
    """A site or channel as one path segment; dots alone would be a folder's own names."""
    out = quote(name, safe=_KEPT)
    return out.replace(".", "%2E") if set(out) == {"."} else out


def _keys_of(path: Column) -> list[Column]:
    parts = F.split(path, "/")
    name = F.element_at(parts, -1)
    decoded = lambda c: F.url_decode(F.replace(c, F.lit("+"), F.lit("%2B")))
    return [decoded(F.element_at(parts, -3)).alias("site"), decoded(F.element_at(parts, -2)).alias("channel_id"), F.to_date(F.substring(name, 1, 10)).alias("day")]


class FileStore:
    def __init__(self, spark: SparkSession, root: str, format: str = "ndjson"):
        if format not in ("ndjson", "xml"):
            raise ValueError(f"unknown cache format {format!r}")
        self.spark, self.root, self.format = spark, os.path.abspath(root), format

    def _base(self, site: str, channel_id: str, day) -> str:
        return os.path.join(self.root, segment(site), segment(channel_id), str(day))

    def _found(self, ending: str) -> list[str]:
        """The files of an ending; a root that isn't there has none."""
        shape = re.compile(r"\d{4}-\d\d-\d\d" + re.escape(ending))
        return sorted(os.path.join(at, n) for at, _, names in os.walk(self.root) for n in names if shape.fullmatch(n))

    def _texts(self, ending: str) -> DataFrame:
        files = [f"file://{quote(p)}" for p in self._found(ending)]
        if not files:
            return self.spark.createDataFrame([], "path string, content string")
        glob = f"*{ending}"
        read = self.spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(f"file://{self.root}")
        return read.select(F.col("path"), F.decode("content", "UTF-8").alias("content"))

    def meta(self) -> DataFrame:
        """Every entry's meta as it stands; grabbed_at is null where it can't be read."""
        rows = self._texts(".meta.json").select(*_keys_of(F.col("path")), F.from_json("content", "grabbedAt string, programmeCount int").alias("m"))
        fine = F.expr("try_cast(m.grabbedAt as timestamp)").isNotNull() & F.col("m.programmeCount").isNotNull()
        return rows.select(*KEYS, F.when(fine, F.col("m.grabbedAt")).alias("grabbed_at"), F.when(fine, F.col("m.programmeCount")).alias("programme_count"))

    def entries(self) -> DataFrame:
        return self.meta().where("grabbed_at is not null")

    def sweep(self) -> int:
        """Remove entries whose meta can't be read; their number."""
        broken = self.meta().where("grabbed_at is null")
        n = broken.count()
        self.delete(broken)
        return n

    def _lines(self) -> tuple[DataFrame, DataFrame]:
        """Programmes of the NDJSON entries, and the lines that hold none: path, line number, text."""
        lines = self._texts(".ndjson").select("path", F.posexplode(F.split("content", "\r?\n")).alias("seq", "line")).where(F.trim("line") != "")
        parsed = lines.withColumn("p", F.from_json("line", schema.struct(schema.PROGRAMME), _TIMES))
        good = F.col("p.start.ts").isNotNull()
        return parsed.where(good).select(F.col("seq").cast("long").alias("seq"), "p.*", *_keys_of(F.col("path"))), parsed.where(~good).select("path", "seq", "line")

    def broken_lines(self) -> DataFrame:
        return self._lines()[1]

    def _documents(self) -> DataFrame:
        rows = xml_source.tables(xml_source.parse_column(self._texts(".xml"), wanted={"programme": schema.PROGRAMME}))["programmes"]
        return rows.select("seq", *schema.PROGRAMME, *_keys_of(F.col("path")))

    def programmes(self) -> DataFrame:
        """Rows of all entries that are there: of the store's format, and of the other for entries that have no file of the first."""
        both = {"ndjson": (self._lines()[0], ".ndjson"), "xml": (self._documents(), ".xml")}
        first, ending = both.pop(self.format)
        (second, _), = both.values()
        return first_format(first, second, self._texts(ending).select(*_keys_of(F.col("path")))).join(self.entries().select(*KEYS), KEYS, "left_semi")

    def write(self, rows: DataFrame, entries: DataFrame) -> None:
        """One file a channel-day, then its meta; ``entries`` has grabbed_at, and may name channel-days without rows."""
        known = entries.select(*KEYS, "grabbed_at").distinct()
        text = F.to_json(F.struct(*[c for c in schema.PROGRAMME]), _TIMES)
        listed = rows.select(*KEYS, "seq", text.alias("row")).groupBy(*KEYS).agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "row"))), lambda x: x["row"]).alias("rows"))
        for r in known.join(listed, KEYS, "left").toLocalIterator():  # a channel-day is what a site sends of one channel for one day
            own = r["rows"] or []
            base = self._base(r["site"], r["channel_id"], r["day"])
            self._remove(base)
            if self.format == "ndjson":
                write_output(f"{base}.ndjson", (f"{x}\n" for x in own))
            else:
                w = Writer()
                write_output(f"{base}.xml", [w.header(), *(w.programme(json.loads(x)) for x in own), w.footer()])
            write_output(f"{base}.meta.json", [json.dumps({"grabbedAt": r["grabbed_at"], "programmeCount": len(own)})])

    @staticmethod
    def _remove(base: str) -> None:
        for ending in (".meta.json", ".ndjson", ".xml"):  # without its meta an entry is gone
            try:
                os.unlink(base + ending)
            except FileNotFoundError:
                pass

    def delete(self, keys: DataFrame) -> None:
        for r in keys.select(*KEYS).distinct().toLocalIterator():
            self._drop(r["site"], r["channel_id"], r["day"])

    def _drop(self, site: str, channel_id: str, day) -> None:
        base = self._base(site, channel_id, day)
        self._remove(base)
        for folder in (os.path.dirname(base), os.path.dirname(os.path.dirname(base))):
            try:
                os.rmdir(folder)
            except OSError:
                break

    def prune(self, before: Column) -> int:
        """Remove the days before one, whatever is left of them; the number of channel-days."""
        limit: date = self.spark.range(1).select(before.alias("d")).first()["d"]
        gone: Iterable[tuple[str, str, str]] = {
            (unquote(parts[-3]), unquote(parts[-2]), parts[-1][:10]) for ending in (".meta.json", ".ndjson", ".xml") for p in self._found(ending) if (parts := p.split("/"))[-1][:10] < f"{limit}"
        }
        for key in gone:
            self._drop(*key)
        return len(gone)


def first_format(first: DataFrame, second: DataFrame, present: DataFrame) -> DataFrame:
    """Rows of the configured format, and of the other for channel-days that have no entry (``present``) in the first: an empty day is an entry."""
    return first.unionByName(second.join(present.select(*KEYS).distinct(), KEYS, "left_anti"), allowMissingColumns=True)
