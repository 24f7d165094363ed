"""The fold and the whole guide against a plain model of the same rules."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from guide_engine import schema
from guide_engine.plans import guide
from guide_engine.sources import xml_sink, xml_source
from guide_engine.sources.cache import Cache

DAY0 = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
MIN = 60_000


def model(lists, days, tol=5 * MIN, merge=True, titles="when-shifted", cap=360 * MIN):
    """lists[day][source] -> rows (start, stop, title) in minutes; gives (start, stop, titles) in order of output."""

    def match(a, b):
        d = abs(a["st"] - b["st"])
        same = bool(set(a["titles"]) & set(b["titles"]))
        if d > tol:
            return False
        if d == 0:
            return titles != "always" or same
        spans = [x["sp"] - x["st"] for x in (a, b) if x["sp"] is not None and x["sp"] > x["st"]]
        return (titles == "never" or same) and all(d < s for s in spans)

    def join(a, b):
        return {"st": a["st"], "sp": a["sp"] if a["sp"] is not None else b["sp"], "titles": list(dict.fromkeys(a["titles"] + b["titles"]))}

    held, out = [], []
    for d in range(days):
        for rows in lists.get(d, []):
            new = [{"st": s, "sp": e, "titles": [t]} for s, e, t in rows]
            if not merge:
                held = sorted(held + new, key=lambda x: x["st"])
                continue
            pooled = []
            for x in new:
                old = next((k for k, y in enumerate(pooled) if y["st"] == x["st"]), None)
                if old is None:
                    pooled.append(x)
                else:
                    pooled[old] = join(pooled[old], x)
            used, rest, hits = set(), [], []
            for x in sorted(pooled, key=lambda x: x["st"]):
                best = None
                for k, y in enumerate(held):
                    if k not in used and match(y, x) and (best is None or abs(y["st"] - x["st"]) < abs(held[best]["st"] - x["st"])):
                        best = k
                if best is None:
                    rest.append(x)
                else:
                    used.add(best)
                    hits.append((best, x))
            for k, x in hits:
                held[k] = join(held[k], x)
            held = sorted(held + rest, key=lambda x: x["st"])
        horizon = d * 1440 * MIN
        n = len(held) if d == days - 1 else sum(x["st"] < horizon for x in held)
        ready, held = held[:n], held[n:]
        for k, x in enumerate(ready):
            nxt = ready[k + 1] if k + 1 < len(ready) else held[0] if held else None
            stop = x["sp"]
            if nxt and nxt["st"] > x["st"]:
                if stop is None:
                    stop = nxt["st"] if nxt["st"] - x["st"] <= cap else x["st"] + cap
                elif stop > nxt["st"]:
                    stop = nxt["st"]
            out.append((x["st"], stop, tuple(x["titles"])))
    return out


def lists_of(seed, days, sources):
    rng = random.Random(seed)
    out = {}
    for d in range(days):
        if rng.random() < 0.2:
            continue
        out[d] = []
        for _ in range(sources):
            rows = []
            for _ in range(rng.randint(0, 9)):
                st = (d * 1440 + rng.randrange(-90, 1500) // 3 * 3) * MIN
                rows.append((st, st + rng.choice([2, 4, 30, 400]) * MIN if rng.random() < 0.6 else None, rng.choice("ab")))
            out[d].append(rows)
    return out


def frames(spark, all_lists):
    at = lambda ms: None if ms is None else {"ts": DAY0 + dt.timedelta(milliseconds=ms), "off": 60, "prec": 12}
    rows, entries, channels = [], set(), []
    for c, lists in enumerate(all_lists):
        for s in range(2):
            channels.append((f"s{s}", s, c, f"ch{c}", f"Name {s}" if s else None, "logo" if s else None))
        for d, sources in lists.items():
            day = (DAY0 + dt.timedelta(days=d)).date()
            for s, own in enumerate(sources):
                entries.add((f"s{s}", f"ch{c}", day, "2024-01-01T00:00:00Z"))
                for k, (st, sp, t) in enumerate(own):
                    x = dict.fromkeys(schema.PROGRAMME) | {"channel": "raw", "start": at(st), "stop": at(sp), "title": [{"value": t, "lang": None, "attrs": None}]}
                    rows.append((k, *x.values(), f"s{s}", f"ch{c}", day))
    ddl = f"seq long, {schema.ddl(schema.PROGRAMME)}, site string, channel_id string, day date"
    return (
        spark.createDataFrame(channels, "site string, site_rank int, channel_rank int, xmltv_id string, name string, logo string"),
        spark.createDataFrame(rows, ddl),
        spark.createDataFrame(sorted(entries), "site string, channel_id string, day date, grabbed_at string"),
    )


def told(df):
    rows = df.orderBy("out_channel", "out_seq").select("out_channel", F.unix_millis("start.ts"), F.unix_millis("stop.ts"), F.expr("transform(title, t -> t.value)")).collect()
    zero, out = int(DAY0.timestamp() * 1000), {}
    for c, a, b, t in rows:
        out.setdefault(c, []).append((a - zero, None if b is None else b - zero, tuple(t)))
    return out


@pytest.mark.parametrize("options,model_options", [({}, {}), ({"titles": "always"}, {"titles": "always"}), ({"titles": "never", "start_tolerance_ms": 20 * MIN}, {"titles": "never", "tol": 20 * MIN}), ({"programme_strategy": "concat"}, {"merge": False})])
def test_guide_equals_model(spark, options, model_options):
    lists = [lists_of(seed, 5, 2) for seed in range(12)]
    channels, rows, _ = frames(spark, lists)
    done = guide.build(spark, channels, rows, "2024-01-01", 5, guide.MergeOptions(**options))["programmes"]
    assert told(done) == {f"ch{c}": x for c, own in enumerate(lists) if (x := model(own, 5, **model_options))}


def test_cache_prune_and_document(spark, tmp_path):
    lists = [lists_of(40, 3, 2), lists_of(41, 3, 2)]
    channels, rows, entries = frames(spark, lists)
    cache = Cache(spark, str(tmp_path / "cache"))
    assert cache.entries().count() == 0
    cache.write(rows, entries)
    assert cache.programmes().count() == rows.count() and cache.entries().count() == entries.count()
    one = entries.limit(1)
    cache.write(rows.limit(0), one)  # an entry that became empty keeps its meta and loses its rows
    key = one.first()
    assert cache.programmes().where((F.col("site") == key["site"]) & (F.col("channel_id") == key["channel_id"]) & (F.col("day") == F.lit(key["day"]))).count() == 0
    assert cache.entries().where("programme_count = 0").count() >= 1
    built = guide.build(spark, channels, cache.programmes(), "2024-01-01", 3)
    target = str(tmp_path / "out" / "guide.xml")
    guide.write_guide(built, target, {"generator_info_name": "test"}, 2)
    got = list(xml_source.parse(open(target, encoding="utf-8").read()))
    assert not [w for k, w in got if k == "warning"]
    assert [v["id"] for k, v in got if k == "channel"] == ["ch0", "ch1"]
    assert [n["value"] for n in got[1][1]["display_name"]] == ["ch0", "Name 1"]
    assert sum(k == "programme" for k, _ in got) == built["programmes"].count()
    n = cache.entries().where("day < date'2024-01-02'").count()
    assert cache.prune(F.lit("2024-01-02").cast("date")) == n and cache.entries().where("day < date'2024-01-02'").count() == 0
    assert xml_sink.Writer().footer() == "</tv>"


def test_first_wins_keep_all_and_hooks(spark):
    lists = [lists_of(50, 3, 2)]
    channels, rows, _ = frames(spark, lists)
    n = {s: rows.where(F.col("site") == s).count() for s in ("s0", "s1")}
    build = lambda **o: guide.build(spark, channels, rows, "2024-01-01", 3, guide.MergeOptions(**o))
    assert build(channel_strategy="first-wins")["programmes"].count() == n["s0"]
    both = build(channel_strategy="keep-all")
    assert both["programmes"].count() == n["s0"] + n["s1"] and both["channels"].count() == 2
    dropped = build(site_transforms={"s1": lambda df: df.where("false")}, programme_strategy="concat")
    assert dropped["programmes"].count() == n["s0"]
    inside = build(clamp_to_window=True, programme_strategy="concat")["programmes"]
    assert inside.where("start.ts < timestamp'2024-01-01 00:00:00Z' or start.ts >= timestamp'2024-01-04 00:00:00Z'").count() == 0
    assert build(transform=lambda df: df.where("next_start is not null"))["programmes"].count() < n["s0"] + n["s1"]
