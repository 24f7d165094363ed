"""Record fusion: ordered distinct unions by key, first values by priority, whole programmes and channels."""

from __future__ import annotations

import json
from collections.abc import Callable
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import ROLES


def distinct_by(items: Column, key: Callable[[Column], Column]) -> Column:
    """Elements whose key comes first among equals, in order; elements without a key are left out.

    Equal keys are found by sorting, and a lambda sees the sorted list as a bound variable, which isn't computed again for each element.
    """
    order = lambda *fields: lambda a, b: F.coalesce(*[F.when(a[f] < b[f], -1).when(a[f] > b[f], 1) for f in fields], F.lit(0))  # noqa: E731  maps have no order
    keyed = F.filter(F.transform(items, lambda x, i: F.struct(key(x).alias("k"), i.alias("i"), x.alias("x"))), lambda e: e["k"].isNotNull())
    first = lambda found: F.filter(found, lambda e, at: (at == 0) | (F.get(found, at - 1)["k"] != e["k"]))
    kept = F.transform(F.array(F.array_sort(keyed, order("k", "i"))), first)[0]
    return F.transform(F.array_sort(kept, order("i")), lambda e: e["x"])


def first_seen(df: DataFrame, by: list[str], value: str, order: Column) -> DataFrame:
    """``values``: the distinct values of each group in the order in which they come first.

    Each value is reduced to its first place before any list is made, so lists are as long as the distinct values are many.
    """
    small = df.withColumn("_o", order).groupBy(*by, value).agg(F.min("_o").alias("_o"))
    listed = small.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("_o", F.col(value).alias("_v")))).alias("_x"))
    return listed.select(*by, F.transform("_x", lambda e: e["_v"]).alias("values"))


def union_by(base: Column, extra: Column, key: Callable[[Column], Column], kind: str) -> Column:
    """``base`` then ``extra`` without later elements of a key, also within base; NULL instead of an empty array."""
    empty = F.array().cast(kind)
    out = distinct_by(F.concat(F.coalesce(base, empty), F.coalesce(extra, empty)), key)
    return F.when(F.size(out) > 0, out)


def _blank(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def _keys(*names: str) -> Callable[[Column], Column]:
    return lambda x: F.struct(*[_blank(x[n]) for n in names])


#: Field -> what makes two of its elements the same.
KEYS: dict[str, Callable[[Column], Column]] = {
    **{f: _keys("lang", "value") for f in ("title", "sub_title", "desc", "category", "keyword", "country", "display_name")},
    **{f: _keys("system", "value") for f in ("url", "episode_num", "rating", "star_rating")},
    "icon": lambda x: x["src"],
    "subtitles": lambda x: F.struct(_blank(x["type"]), _blank(x["language"]["value"])),
    "review": _keys("type", "source", "value"),
    "image": lambda x: x["value"],
    "extra": lambda x: x,
}
SCALARS = ("stop", "pdc_start", "vps_start", "showview", "videoplus", "clumpidx", "date", "language", "orig_language", "length", "video", "audio", "previously_shown", "premiere", "last_chance", "is_new")


def merge_maps(base: Column, extra: Column) -> Column:
    """Attributes of both, the base's values where both have a key; extra's keys first."""
    a, b = (F.coalesce(c, F.create_map().cast("map<string,string>")) for c in (base, extra))
    out = F.map_from_entries(
        F.concat(
            F.transform(F.map_entries(b), lambda e: F.struct(e["key"].alias("key"), F.coalesce(a[e["key"]], e["value"]).alias("value"))),
            F.filter(F.map_entries(a), lambda e: ~F.map_contains_key(b, e["key"])),
        )
    )
    return F.when(F.size(out) > 0, out)


_ROW_KEYS: dict[str, tuple[tuple[str, ...], ...]] = {
    **{f: (("lang",), ("value",)) for f in ("title", "sub_title", "desc", "category", "keyword", "country", "display_name")},
    **{f: (("system",), ("value",)) for f in ("url", "episode_num", "rating", "star_rating")},
    "icon": (("src",),), "image": (("value",),), "subtitles": (("type",), ("language", "value")), "review": (("type",), ("source",), ("value",)),
}


def _union(field: str, a: list | None, b: list | None, paths: tuple[tuple[str, ...], ...] | None = None) -> list | None:
    """Both lists without later elements of a key."""
    paths, out = paths or _ROW_KEYS.get(field), {}
    for x in [*(a or ()), *(b or ())]:
        key = x if paths is None else tuple(reduce(lambda at, name: (at or {}).get(name), path, x) or "" for path in paths)
        out.setdefault(key, x)
    return list(out.values()) or None


def merge_programmes(base: dict, extra: dict) -> dict:
    """The pairwise merge of two rows outside Spark, as ``fuse`` does it: base's values first."""
    out = dict(base)
    for f, value in extra.items():
        if f in _ROW_KEYS or f == "extra":
            out[f] = _union(f, base.get(f), value)
        elif f == "attrs":
            out[f] = {**value, **(base.get(f) or {})} if value else base.get(f)
        elif f == "credits":
            both = [x or {} for x in (base.get(f), value)]
            people = {r: _union(r, both[0].get(r), both[1].get(r), (("value",), ("role",)) if r == "actor" else (("value",),)) for r in ROLES}
            out[f] = {r: p for r, p in people.items() if p} or None
        elif base.get(f) is None:
            out[f] = value
    return {f: v for f, v in out.items() if v is not None}


def programme_of(text: str) -> dict:
    """A programme from a row's JSON; its instants are datetimes again."""
    row = json.loads(text)
    for f in ("start", "stop", "pdc_start", "vps_start", "date"):
        if row.get(f):
            row[f]["ts"] = datetime.fromisoformat(row[f]["ts"])
    if (row.get("previously_shown") or {}).get("start"):
        row["previously_shown"]["start"]["ts"] = datetime.fromisoformat(row["previously_shown"]["start"]["ts"])
    return row


def fuse(df: DataFrame, by: list[str], order: str, fields: dict[str, str], keep_credit_extras: bool = False) -> DataFrame:
    """One row per ``by`` from rows in ``order`` (a sortable column): the n-ary fold of the pairwise merge.

    Scalars take the first value that is there, arrays the ordered distinct union, credits a union per role;
    extensions inside credits are lost once two rows meet, unless asked for. A row that meets none passes as it is.
    """
    value = [f for f in fields if f not in by]
    in_order = lambda a, b: F.when(a["_o"] < b["_o"], -1).when(a["_o"] > b["_o"], 1).otherwise(0)  # noqa: E731  maps have no order
    packed = df.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("_o"), *value)), in_order).alias("_rows"))
    rows = F.col("_rows")

    def gathered(of: Callable[[Column], Column], kind: str) -> Column:
        return F.flatten(F.filter(F.transform(rows, of), lambda x: x.isNotNull())).cast(kind)

    def get(*path: str) -> Callable[[Column], Column]:
        def one(row: Column) -> Column:
            for name in path:
                row = row[name]
            return row

        return one

    out = []
    for f in value:
        kind = fields[f]
        if f == "start" or f == "channel":
            merged = rows[0][f]
        elif f == "attrs":
            merged = F.aggregate(rows, F.lit(None).cast(kind), lambda acc, r: merge_maps(acc, r["attrs"]))
        elif f == "credits":
            roles = []
            for r in ROLES:
                key = _keys("value", "role") if r == "actor" else _keys("value")
                people = distinct_by(F.flatten(F.filter(F.transform(rows, get("credits", r)), lambda x: x.isNotNull())), key)
                roles.append(F.when(F.size(people) > 0, people).alias(r))
            more = gathered(get("credits", "extra"), "array<string>")
            roles.append((F.when(F.size(more) > 0, F.array_distinct(more)) if keep_credit_extras else F.lit(None).cast("array<string>")).alias("extra"))
            merged = F.struct(*roles)
            merged = F.when(F.exists(F.array(*[merged[r].isNotNull() for r in ROLES]), lambda x: x), merged)
        elif f in KEYS:
            union = distinct_by(gathered(get(f), kind), KEYS[f])
            merged = F.when(F.size(union) > 0, union) if f not in ("title", "display_name") else union
        else:
            merged = F.filter(F.transform(rows, get(f)), lambda x: x.isNotNull())
            merged = F.when(F.size(merged) > 0, merged[0])
        out.append(F.when(F.size(rows) == 1, rows[0][f]).otherwise(merged).alias(f))
    return packed.select(*by, *out)
