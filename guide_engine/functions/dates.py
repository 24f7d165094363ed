"""Guide dates: an instant with an offset in minutes and a precision in digits (4 to 14)."""

from __future__ import annotations

import re
from datetime import datetime, timedelta, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F

_SHAPE = r"^\s*(\d{4}(?:\d\d){0,5})(?:\s*([+-]\d{4}|[A-Za-z]+))?\s*$"
ZONES = ("gmt", "utc", "ut", "z")


def parse_date(text: Column) -> Column:
    """STRUCT<ts TIMESTAMP_NTZ in UTC, off INT, prec INT>; NULL for anything that is no date."""
    digits, zone = F.regexp_extract(text, _SHAPE, 1), F.lower(F.regexp_extract(text, _SHAPE, 2))

    def part(at: int, default: int) -> Column:
        return F.when(F.length(digits) > at, F.substring(digits, at + 1, 2).try_cast("int")).otherwise(F.lit(default))

    year = F.substring(digits, 1, 4).try_cast("int")
    local = F.try_make_timestamp_ntz(year, part(4, 1), part(6, 1), part(8, 0), part(10, 0), part(12, 0).cast("decimal(8,6)"))
    hours, minutes = F.substring(zone, 2, 2).try_cast("int"), F.substring(zone, 4, 2).try_cast("int")
    signed = F.when(F.startswith(zone, F.lit("-")), -1).otherwise(1) * (hours * 60 + minutes)
    off = F.when(zone.isin("", *ZONES), 0).when(zone.rlike("^[+-]") & (hours <= 23) & (minutes <= 59), signed)
    good = local.isNotNull() & off.isNotNull() & (year >= 100) & (part(12, 0) <= 59) & (part(8, 0) <= 23)
    return F.when(good, F.struct((local - F.make_dt_interval(mins=off)).alias("ts"), off.cast("int").alias("off"), F.length(digits).alias("prec")))


def format_date(ts: Column, off: Column | None = None, prec: Column | None = None, offset: bool = True) -> Column:
    """The wall clock in the stored offset, cut to the stored precision; `` +HHMM`` unless ``offset`` is false."""
    off = F.coalesce(off if off is not None else F.lit(None).cast("int"), F.lit(0))
    prec = F.coalesce(prec if prec is not None else F.lit(None).cast("int"), F.lit(14))
    wall = F.substring(F.date_format(ts + F.make_dt_interval(mins=off), "yyyyMMddHHmmss"), F.lit(1), prec)
    if not offset:
        return wall
    size = F.abs(off)
    zone = F.concat(F.lit(" "), F.when(off < 0, "-").otherwise("+"), F.lpad(F.floor(size / 60).cast("string"), 2, "0"), F.lpad((size % 60).cast("string"), 2, "0"))
    return F.concat(wall, zone)


class DateError(ValueError):
    """A text that is no guide date: why, and at which 0-based character."""

    def __init__(self, value: str, reason: str, index: int):
        super().__init__(f"{reason} at {index} in {value!r}")
        self.value, self.reason, self.index = value, reason, index


_BAD = {"month": (4, 1, 12), "day": (6, 1, 31), "hour": (8, 0, 23), "minute": (10, 0, 59), "second": (12, 0, 59)}


_FULL = re.compile(r"([0-9]{14}) ([+-])([0-9]{2})([0-9]{2})")


def date_of(value: str, zones: dict[str, int] | None = None) -> dict:
    """{ts, off, prec} of a text, for sources outside Spark; raises DateError. ``zones`` maps names to minutes."""
    if (m := _FULL.fullmatch(value)) and value >= "0100" and value[8:10] <= "23" and m[3] <= "23" and m[4] <= "59":  # the usual form, whole
        d, off = m[1], (int(m[3]) * 60 + int(m[4])) * (-1 if m[2] == "-" else 1)
        try:
            local = datetime.fromisoformat(f"{d[:8]}T{d[8:]}+00:00")
            return {"ts": local - timedelta(minutes=off) if off else local, "off": off, "prec": 14}
        except ValueError:
            pass  # told below, with its place
    lead = len(value) - len(value.lstrip())
    text = value.strip()
    run = re.match(r"\d*", text)[0]
    n = len(run)
    if n < 4 or n > 14 or n % 2:
        raise DateError(value, "expected 4 to 14 digits, an even number", lead + min(n, 14))
    now = {"month": 1, "day": 1, "hour": 0, "minute": 0, "second": 0}
    for name, (at, low, high) in _BAD.items():
        if n > at:
            now[name] = int(run[at : at + 2])
            if not low <= now[name] <= high:
                raise DateError(value, f"{name} out of range", lead + at)
    if int(run[:4]) < 100:
        raise DateError(value, "year out of range", lead)
    try:
        local = datetime(int(run[:4]), **now, tzinfo=timezone.utc)
    except ValueError:
        raise DateError(value, "day out of range", lead + 6) from None
    rest = text[n:]
    zone = rest.strip()
    at = lead + n + len(rest) - len(rest.lstrip())
    names = dict.fromkeys(ZONES, 0) | {k.lower(): v for k, v in (zones or {}).items()}
    if not zone:
        off = 0
    elif zone.lower() in names:
        off = names[zone.lower()]
    elif m := re.fullmatch(r"([+-])(\d\d)(\d\d)", zone):
        if int(m[2]) > 23 or int(m[3]) > 59:
            raise DateError(value, "offset out of range", at)
        off = (int(m[2]) * 60 + int(m[3])) * (-1 if m[1] == "-" else 1)
    else:
        raise DateError(value, "unknown time zone", at)
    return {"ts": local - timedelta(minutes=off), "off": off, "prec": n}


def text_of(date: dict, offset: bool = True) -> str:
    ts, off = date["ts"], date.get("off") or 0
    if isinstance(ts, str):
        ts = datetime.fromisoformat(ts)
    local = ts.astimezone(timezone.utc) + timedelta(minutes=off) if ts.tzinfo else ts + timedelta(minutes=off)
    wall = f"{local.year:04d}{local:%m%d%H%M%S}"[: date.get("prec") or 14]
    return wall + (f" {'-' if off < 0 else '+'}{abs(off) // 60:02d}{abs(off) % 60:02d}" if offset else "")


def coerce_date(value: datetime | str | int | float) -> dict:
    """A date of an instant, a guide text or Unix seconds."""
    if isinstance(value, datetime):
        return {"ts": value if value.tzinfo else value.replace(tzinfo=timezone.utc), "off": 0, "prec": 14}
    if isinstance(value, str):
        return date_of(value)
    return {"ts": datetime.fromtimestamp(value, timezone.utc), "off": 0, "prec": 14}


def day_range(start: str, n: int) -> list[str]:
    first = datetime.strptime(start, "%Y-%m-%d")
    return [f"{first + timedelta(days=k):%Y-%m-%d}" for k in range(max(0, n))]


def is_day(text: str) -> bool:
    try:
        return bool(re.fullmatch(r"\d{4}-\d\d-\d\d", text)) and bool(datetime.strptime(text, "%Y-%m-%d"))
    except ValueError:
        return False


def diff_days(a: str, b: str) -> int:
    return (datetime.strptime(a, "%Y-%m-%d") - datetime.strptime(b, "%Y-%m-%d")).days
