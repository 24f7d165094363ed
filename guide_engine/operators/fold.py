"""The ordered fold of many sources and days into one schedule a channel.

The decisions are sequential: an incoming list is pooled by instant, each of its rows takes the nearest free
match in what is still held, and after a day everything before that day's midnight leaves. The fold sees only starts, stops and
title keys, and says which rows belong together and in which order groups leave; their fields are then fused by
DataFrame operations (``fusion.fuse``).

In batch Spark pools the instants of each list, and rows can only meet within the tolerance: a channel is cut where nothing
starts for so long, and each stretch is swept in order of start, all its lists side by side (``Sweep``), so a worker holds
a few tolerances of time. When a group leaves follows from its base alone, so Spark numbers groups (``ordered``). Streaming,
and rules that look at whole programmes at any distance, keep a channel's days in a ``ChannelFold``.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections import deque
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .fusion import merge_programmes, programme_of
from .match import TOLERANCE

DAY = 86400


@dataclass
class Entry:
    st: int
    sp: int | None
    titles: frozenset
    rows: list = field(default_factory=list)  # row ids in fold order
    off: int | None = None  # offset and precision of the start, for a stop that takes it over
    prec: int | None = None
    programme: dict | None = None  # the whole programme, where the rules ask for it

    def absorb(self, other: Entry) -> None:
        self.sp = other.sp if self.sp is None else self.sp
        if self.programme is not None and other.programme is not None:
            self.programme = merge_programmes(self.programme, other.programme)
        self.titles |= other.titles
        self.rows += other.rows


def _span(e: Entry) -> float:
    return e.sp - e.st if e.sp is not None and e.sp > e.st else float("inf")


@dataclass
class Rules:
    tolerance: int = TOLERANCE
    titles: str = "when-shifted"
    merge: bool = True
    #: A predicate on whole programmes (held, incoming) in place of tolerance and titles; it sees any distance.
    match: Callable[[dict, dict], bool] | None = None

    def accept(self, a: Entry, b: Entry) -> bool:
        if self.match:
            return bool(self.match(a.programme, b.programme))
        shift = abs(a.st - b.st)
        shared = self.titles == "never" or bool(a.titles & b.titles)
        if shift == 0:
            return self.titles != "always" or shared
        return shift <= self.tolerance and shared and shift < min(_span(a), _span(b))


class ChannelFold:
    def __init__(self, rules: Rules | None = None):
        self.rules = rules or Rules()
        self.held: list[Entry] = []

    def add(self, incoming: list[Entry]) -> None:
        """One source's list of one day."""
        if not self.rules.merge:
            self.held = sorted(self.held + incoming, key=lambda e: e.st)
            return
        pooled: dict[int, Entry] = {}
        for e in incoming:
            if e.st in pooled:
                pooled[e.st].absorb(e)
            else:
                pooled[e.st] = e
        starts = [e.st for e in self.held]
        taken: dict[int, Entry] = {}
        rest = []
        for e in (pooled[t] for t in sorted(pooled)):
            low, high = 0, len(starts)
            if not self.rules.match:
                low, high = bisect_left(starts, e.st - self.rules.tolerance), bisect_right(starts, e.st + self.rules.tolerance)
            near = sorted((abs(starts[k] - e.st), k) for k in range(low, high) if k not in taken)
            hit = next((k for _, k in near if self.rules.accept(self.held[k], e)), None)
            if hit is None:
                rest.append(e)
            else:
                taken[hit] = e
        for k, e in taken.items():
            self.held[k].absorb(e)
        self.held = sorted(self.held + rest, key=lambda e: e.st)  # stable: what was held comes first

    def leave(self, horizon: int | None) -> Iterator[tuple[Entry, Entry | None]]:
        """Entries before the horizon (all, if None), each with what follows it."""
        n = len(self.held) if horizon is None else bisect_left([e.st for e in self.held], horizon)
        ready, self.held = self.held[:n], self.held[n:]
        follow = [*ready[1:], self.held[0] if self.held else None] if ready else []
        yield from zip(ready, follow, strict=True)


class FoldRows:
    """Feeds rows in the order (day, source, seq) to a fold, and numbers what leaves."""

    def __init__(self, rules: Rules, last_day: int | None = None, day: int = DAY):
        self.fold, self.last_day, self.length = ChannelFold(rules), last_day, day
        self.day: int | None = None
        self.source: int | None = None
        self.list: list[Entry] = []
        self.out = 0

    def _numbered(self, horizon: int | None) -> Iterator[tuple]:
        for e, nxt in self.fold.leave(horizon):
            for k, row in enumerate(e.rows):
                yield (row, e.rows[0], k, self.out, *((nxt.st, nxt.rows[0], nxt.off, nxt.prec) if nxt else (None,) * 4))
            self.out += 1

    def row(self, day: int, midnight: int, source: int, row_id: int, st: int, sp: int | None, titles, off: int | None = None, prec: int | None = None, programme: dict | None = None) -> Iterator[tuple]:
        """(row, group, place in the group, output number, successor's start, group, offset and precision) of all rows that leave."""
        if (day, source) != (self.day, self.source):
            self.fold.add(self.list)
            self.list = []
            if self.day is not None and day != self.day:
                # an empty day in between lets everything before it leave too
                yield from self._numbered(self.midnight)
                if day > self.day + 1:
                    yield from self._numbered(midnight - self.length)
            self.day, self.source, self.midnight = day, source, midnight
        self.list.append(Entry(st, sp, frozenset(titles or ()), [row_id], off, prec, programme))

    def close(self) -> Iterator[tuple]:
        self.fold.add(self.list)
        self.list = []
        if self.day is not None:
            if self.last_day is not None and self.last_day > self.day:
                yield from self._numbered(self.midnight)
                # days without rows: each lets go of what starts before it
                for k in range(1, self.last_day - self.day):
                    yield from self._numbered(self.midnight + k * self.length)
            yield from self._numbered(None)


OUT = "channel string, id long, group_id long, place int, out_seq long, next_st long, next_group long, next_off int, next_prec int"


class Met:
    """A pooled instant of a list, and the group that others make of it."""

    __slots__ = ("st", "sp", "titles", "lot", "stage", "taken", "rows")

    def __init__(self, st: int, sp: int | None, titles: frozenset, lot: tuple[int, int], stage: int, row: tuple):
        self.st, self.sp, self.titles, self.lot, self.stage, self.taken, self.rows = st, sp, titles, lot, stage, None, [row]


class Sweep:
    """The fold of a stretch whose instants come in order of start, from all its lists at once.

    A list may look at what is held around a start once all earlier lists are through two tolerances beyond it;
    what no start to come can reach leaves.
    """

    STEP = 1024

    def __init__(self, rules: Rules):
        self.rules = rules
        self.waiting: dict[tuple[int, int], deque[Met]] = {}
        self.starts: list[int] = []
        self.held: dict[int, list[Met]] = {}  # of a start, in order of lists
        self.front, self.count = 0, 0

    def put(self, e: Met) -> Iterator[Met]:
        self.front = e.st
        self.waiting.setdefault(e.lot, deque()).append(e)
        self.count += 1
        if self.count % self.STEP == 0:
            yield from self.advance(self.front)

    def advance(self, front: float = float("inf")) -> Iterator[Met]:
        """Groups that are complete, if all starts before ``front`` have come."""
        wide = 2 * self.rules.tolerance
        limit, first = front - wide, front
        for lot in sorted(self.waiting):
            queue = self.waiting[lot]
            while queue and queue[0].st < limit:
                self._place(queue.popleft())
            if queue:
                limit, first = min(limit, queue[0].st - wide), min(first, queue[0].st)
            else:
                del self.waiting[lot]
        n = bisect_left(self.starts, first - self.rules.tolerance)
        for st in self.starts[:n]:
            yield from self.held.pop(st)
        del self.starts[:n]

    def _place(self, e: Met) -> None:
        hit = self._nearest(e)
        if hit is None:
            if e.st not in self.held:
                self.starts.insert(bisect_left(self.starts, e.st), e.st)
                self.held[e.st] = []
            self.held[e.st].append(e)
        else:
            hit.taken = e.lot
            hit.sp = e.sp if hit.sp is None else hit.sp
            if not e.titles <= hit.titles:
                hit.titles |= e.titles
            hit.rows += e.rows

    def _nearest(self, e: Met) -> Met | None:
        """Of held groups that match the least shift, then the earlier start, then the earlier list."""
        starts = self.starts
        reach = min(self.rules.tolerance, max(_span(e) - 1, 0))  # starts are whole numbers
        right = bisect_left(starts, e.st)
        left, n = right - 1, len(starts)
        while True:
            back = e.st - starts[left] if left >= 0 else reach + 1
            on = starts[right] - e.st if right < n else reach + 1
            if min(back, on) > reach:
                return None
            if back <= on:
                at, left = starts[left], left - 1
            else:
                at, right = starts[right], right + 1
            for held in self.held[at]:
                # of an earlier list, not taken by this one, and it hasn't left
                if held.lot < e.lot and held.taken != e.lot and held.stage >= e.lot[0] and self.rules.accept(held, e):
                    return held


_POOL = ["channel", "day_idx", "source", "st"]
GROUP = (
    "channel string, group_id long, day_at int, source int, seq long, st long, sp long, off int, prec int, stage int, n_rows long, "
    "members array<struct<day_idx: int, source: int, st: long, id: long, at: long>>"
)


def _extended(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.lit(None).cast(t) for c, t in (("off", "int"), ("prec", "int"), ("programme", "string")) if c not in df.columns})


def staged(rows: DataFrame, df: DataFrame, day: int = DAY) -> DataFrame:
    """``rows`` of ``df`` with day_at, their day's place among the channel's days, and stage, that of the day after which they leave."""
    w = Window.partitionBy("channel").orderBy("day_idx")
    days = df.groupBy("channel", "day_idx").agg(F.min("midnight").alias("_m"))
    gone = F.greatest("_m", F.when(F.lead("day_idx").over(w) > F.col("day_idx") + 1, F.lead("_m").over(w) - day))
    days = days.select("channel", "day_idx", (F.row_number().over(w) - 1).alias("day_at"), F.when(F.lead("day_idx").over(w).isNotNull(), gone).alias("_h"))
    days = days.select("channel", "day_idx", "day_at", F.collect_list("_h").over(w.rowsBetween(0, Window.unboundedFollowing)).alias("_gone"))
    later = F.size(F.filter("_gone", lambda h: h <= F.col("st")))
    return rows.join(days, ["channel", "day_idx"]).withColumn("stage", (F.col("day_at") + later).cast("int")).drop("_gone")


def groups(df: DataFrame, rules: Rules | None = None, day: int = DAY) -> DataFrame:
    """One row a group of schedule rows (as ``fold`` takes them): its base, the first stop in fold order, its rows' count and its members, pooled."""
    rules, df = rules or Rules(), _extended(df)
    if rules.match:
        raise ValueError("rules on whole programmes need the fold of a channel")
    if not rules.merge:
        out = staged(df, df, day).withColumn("members", F.array(F.struct("day_idx", "source", "st", "id", F.lit(0).cast("long").alias("at"))))
        return out.select("channel", F.col("id").alias("group_id"), "day_at", "source", "seq", "st", "sp", "off", "prec", "stage", F.lit(1).cast("long").alias("n_rows"), "members")
    place = F.struct("seq", "id")
    named = F.array_distinct(F.flatten(F.collect_set("titles"))).alias("titles")
    stop = F.min_by("sp", F.when(F.col("sp").isNotNull(), place)).alias("sp")
    pools = df.groupBy(*_POOL).agg(*[F.min_by(c, place).alias(c) for c in ("id", "off", "prec")], stop, named, F.count("*").alias("n"))
    # a channel is cut where nothing starts for a tolerance; stretches that begin in the same day go together
    width = max(rules.tolerance, day // 1440)
    bucket = F.floor(F.col("st") / width).alias("_bucket")
    w = Window.partitionBy("channel").orderBy("_bucket")
    used = df.select("channel", bucket).distinct()
    begins = F.when(F.coalesce(F.col("_bucket") - F.lag("_bucket").over(w) > 1, F.lit(True)), F.col("_bucket"))
    cut = used.withColumn("_b", begins).select("channel", "_bucket", F.floor(F.max("_b").over(w) * width / day).alias("_stretch"))
    cols = ["channel", "_stretch", "st", "day_at", "source", "id", "sp", "titles", "stage", "n", "off", "prec", "day_idx"]
    inputs = staged(pools, df, day).withColumn("_bucket", bucket).join(cut, ["channel", "_bucket"]).select(*cols)
    inputs = inputs.repartition("channel", "_stretch").sortWithinPartitions("channel", "_stretch", "st", "day_at", "source")
    fields = to_arrow_schema(T.StructType.fromDDL(GROUP))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sweep, own, out, known = Sweep(rules), None, [], {}

        def told(channel: str, done: Iterable[Met]) -> None:
            for e in done:
                at, members = 0, []
                for day_idx, source, st, row, n, *_ in e.rows:
                    members.append({"day_idx": day_idx, "source": source, "st": st, "id": row, "at": at})
                    at += n
                base = e.rows[0]
                out.append((channel, base[3], e.lot[0], e.lot[1], 0, e.st, e.sp, base[5], base[6], e.stage, at, members))

        def packed() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), fields, strict=True)], schema=fields)
            out.clear()
            return batch

        for batch in batches:
            for channel, stretch, st, day_at, source, row, sp, titles, stage, n, off, prec, day_idx in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if own != (channel, stretch):
                    if own is not None:
                        told(own[0], sweep.advance())
                    own, sweep, known = (channel, stretch), Sweep(rules), {}
                titles = tuple(titles or ())
                told(channel, sweep.put(Met(st, sp, known.setdefault(titles, frozenset(titles)) if len(known) < 4096 else frozenset(titles), (day_at, source), stage, (day_idx, source, st, row, n, off, prec))))
                if len(out) >= 4096:
                    yield packed()
        if own is not None:
            told(own[0], sweep.advance())
        if out:
            yield packed()

    return inputs.mapInArrow(run, GROUP)


def ordered(groups: DataFrame) -> DataFrame:
    """``groups`` with their output number in the channel, out_seq, and what follows them: next_st, next_group, next_off, next_prec.

    Groups leave by stage, then start; the last of a stage is followed by the first that is held then.
    """
    me = F.struct("st", "day_at", "source", "seq", "group_id", "off", "prec")
    w = Window.partitionBy("channel", "stage").orderBy("st", "day_at", "source", "seq", "group_id")
    # a channel's stages are few: what came before each, and what is held after it, is told from one list
    cells = groups.groupBy("channel", "day_at", "stage").agg(F.count("*").alias("n"), F.min(me).alias("head"))
    listed = cells.groupBy("channel").agg(F.collect_list(F.struct("stage", "day_at", "n", "head")).alias("_c"))
    stages = listed.select("channel", "_c", F.explode(F.array_distinct(F.transform("_c", lambda c: c["stage"]))).alias("stage"))
    before = F.aggregate("_c", F.lit(0).cast("long"), lambda n, c: n + F.when(c["stage"] < F.col("stage"), c["n"]).otherwise(0))
    held = F.filter("_c", lambda c: (c["day_at"] <= F.col("stage")) & (F.col("stage") < c["stage"]))
    stages = stages.select("channel", "stage", before.alias("_before"), F.array_min(F.transform(held, lambda c: c["head"])).alias("_head"))
    out = groups.withColumns({"_row": F.row_number().over(w) - 1, "_next": F.lead(me).over(w)})
    out = out.join(stages, ["channel", "stage"]).withColumn("_next", F.coalesce("_next", "_head"))
    follow = {"next_st": "st", "next_group": "group_id", "next_off": "off", "next_prec": "prec"}
    out = out.withColumns({"out_seq": F.col("_before") + F.col("_row"), **{f: F.col("_next")[c] for f, c in follow.items()}})
    return out.drop("_row", "_next", "_before", "_head")


_FOLLOW = ("out_seq", "next_st", "next_group", "next_off", "next_prec")


def fold(df: DataFrame, rules: Rules | None = None, last_day: int | None = None, day: int = DAY) -> DataFrame:
    """Assignments of schedule rows (channel, day_idx, midnight, source, seq, id, st, sp, titles); ``day`` is a day in their unit.

    Optional columns: off and prec of the start, and programme, the whole row as JSON, for rules with a ``match``.
    """
    rules, df = rules or Rules(), _extended(df)
    if rules.match:
        return _by_channel(df, rules, last_day, day)
    done = ordered(groups(df, rules, day))
    if not rules.merge:
        return done.select("channel", F.col("group_id").alias("id"), "group_id", F.lit(0).alias("place"), *_FOLLOW)
    members = done.select("channel", "group_id", *_FOLLOW, F.explode("members").alias("m")).select("channel", "group_id", *_FOLLOW, "m.day_idx", "m.source", "m.st", "m.at")
    place = F.row_number().over(Window.partitionBy(*_POOL).orderBy("seq", "id")) - 1
    rows = df.select(*_POOL, "id", place.alias("_k"))
    return rows.join(members, _POOL).select("channel", "id", "group_id", (F.col("at") + F.col("_k")).cast("int").alias("place"), *_FOLLOW)


def _by_channel(df: DataFrame, rules: Rules, last_day: int | None, day: int) -> DataFrame:
    """The table function takes rows partitioned by channel and sorted, so a channel is streamed through, not collected."""
    from pyspark.sql.functions import udtf

    class Fold:
        def __init__(self):
            self.state, self.channel = FoldRows(rules, last_day, day), None

        def eval(self, r):
            self.channel = r["channel"]
            whole = programme_of(r["programme"]) if rules.match else None
            for x in self.state.row(r["day_idx"], r["midnight"], r["source"], r["id"], r["st"], r["sp"], r["titles"], r["off"], r["prec"], whole):
                yield (self.channel, *x)

        def terminate(self):
            for x in self.state.close():
                yield (self.channel, *x)

    table = df.select("channel", "day_idx", "midnight", "source", "seq", "id", "st", "sp", "titles", "off", "prec", "programme").asTable()
    return udtf(Fold, returnType=OUT)(table.partitionBy("channel").orderBy("day_idx", "source", "seq", "id"))


def finished(assigned: DataFrame, rows: DataFrame) -> DataFrame:
    """One row a group: start of its base, the first stop in fold order, its rows' count, and what follows it."""
    both = assigned.join(rows.select("id", "st", "sp"), "id")
    first = F.min_by("sp", F.when(F.col("sp").isNotNull(), F.col("place")))
    return both.groupBy("channel", "group_id", "out_seq").agg(F.min_by("st", "place").alias("st"), first.alias("sp"), F.count("*").alias("n_rows"), F.max("next_st").alias("next_st"))
