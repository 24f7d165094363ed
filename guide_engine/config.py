"""Answers and grabber configuration: ordered sources, .conf files, and the names they may hold."""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHANNEL_ID = re.compile(r"[-a-zA-Z0-9]+(\.[-a-zA-Z0-9]+)+")
GRABBER_NAME = re.compile(r"tv_grab_[a-z0-9_]+")
_CONF_LINE = re.compile(r"(?P<key>\S+?)(?P<sign>[=!])(?P<value>.*?)\s*(?:#.*)?")

Reader = Callable[[str], Sequence[str] | None]


class ConfigError(ValueError):
    """No source answers a question."""


def env_reader(prefix: str = "", env: Mapping[str, str] | None = None) -> Reader:
    """Answers from the environment; an empty variable is no answer."""
    env = os.environ if env is None else env
    return lambda key: [v] if (v := env.get(prefix + re.sub(r"[^A-Za-z0-9]", "_", key).upper())) else None


def mapping_reader(values: Mapping[str, Sequence[str]]) -> Reader:
    """Answers of a .conf or of defaults; ``key=`` was asked and not answered."""
    return lambda key: [v for v in values.get(key, ()) if v != ""] or None


class Answers:
    """The first reader with an answer wins."""

    def __init__(self, *readers: Reader):
        self.readers = readers

    def all(self, key: str) -> list[str] | None:
        return next((list(a) for r in self.readers if (a := r(key))), None)

    def get(self, key: str, default: str | None = None) -> str:
        got = self.all(key)
        if got:
            return got[0]
        if default is None:
            raise ConfigError(f"no answer for {key!r}")
        return default


def parse_conf(text: str) -> dict[str, list[str]] | None:
    """``key=value`` and ``key!value`` (declined, kept as no_key); one bad line and the file says nothing."""
    conf: dict[str, list[str]] = {}
    for line in re.split(r"\r?\n", text):
        if not line.strip() or line.lstrip().startswith("#"):
            continue
        m = _CONF_LINE.fullmatch(line)
        if not m:
            return None
        conf.setdefault(m["key"] if m["sign"] == "=" else "no_" + m["key"], []).append(m["value"])
    return conf


def conf_text(conf: Mapping[str, Sequence[str]]) -> str:
    lines = ((k.removeprefix("no_"), "!" if k.startswith("no_") else "=", v) for k, vs in conf.items() for v in vs)
    return "".join(f"{k}{sign}{v}\n" for k, sign, v in lines)


def load_conf(path: str) -> dict[str, list[str]] | None:
    try:
        with open(path, encoding="utf-8") as f:
            return parse_conf(f.read())
    except OSError:
        return None


def save_conf(path: str, conf: Mapping[str, Sequence[str]]) -> None:
    from .sources.xml_sink import write_output

    write_output(path, [conf_text(conf)])


def read_confs(spark: SparkSession, path: str) -> DataFrame:
    """Many .conf files at once: file, key, values; a file with a bad line gives no rows."""
    lines = spark.read.text(path).select(F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("at"), F.col("value").alias("line"))
    lines = lines.where(~F.col("line").rlike(r"^\s*(#|$)"))
    shape = r"^(\S+?)([=!])(.*?)\s*(#.*)?$"
    parts = lines.select("file", "at", *[F.regexp_extract("line", shape, k).alias(n) for k, n in ((1, "key"), (2, "sign"), (3, "value"))])
    good = parts.groupBy("file").agg(F.bool_and(F.col("sign") != "").alias("ok")).where("ok")
    rows = parts.join(good, "file").withColumn("key", F.when(F.col("sign") == "!", F.concat(F.lit("no_"), "key")).otherwise(F.col("key")))
    return rows.groupBy("file", "key").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "value"))), lambda x: x["value"]).alias("values"))


def parse_selection(text: str, count: int) -> list[int] | None:
    """0-based picks of ``1-5,8``, ``all`` or ``none``; None for what can't be read."""
    words = text.lower().replace(",", " ").split()
    if words in ([], ["none"]):
        return []
    if words == ["all"]:
        return list(range(count))
    picked: set[int] = set()
    for w in words:
        if not re.fullmatch(r"[0-9]+(-[0-9]+)?", w):
            return None
        ends = sorted(int(x) for x in (w.split("-") * 2)[:2])
        if ends[0] < 1 or ends[1] > count:
            return None
        picked.update(range(ends[0] - 1, ends[1]))
    return sorted(picked)


def selection(text: Column, count: Column) -> Column:
    """``parse_selection`` as an expression: sorted 0-based picks of a text, NULL for what can't be read."""
    words = F.filter(F.split(F.replace(F.lower(text), F.lit(","), F.lit(" ")), r"\s+"), lambda w: w != "")
    ends = lambda w: F.transform(F.split(w, "-"), lambda x: x.cast("long"))
    span = lambda w: F.sequence(F.array_min(ends(w)) - 1, F.array_max(ends(w)) - 1)
    fits = lambda w: w.rlike(r"\A[0-9]+(-[0-9]+)?\z") & (F.array_min(ends(w)) >= 1) & (F.array_max(ends(w)) <= count)
    none, every = F.array().cast("array<bigint>"), F.when(count > 0, F.sequence(F.lit(0).cast("bigint"), count.cast("bigint") - 1)).otherwise(F.array().cast("array<bigint>"))
    picks = F.when(F.forall(words, fits), F.array_sort(F.array_distinct(F.flatten(F.transform(words, span)))))
    return F.when((F.size(words) == 0) | (words == F.array(F.lit("none"))), none).when(words == F.array(F.lit("all")), every).otherwise(picks)
