"""Clean-up of a finished schedule: successors, missing stops, overlaps, the guide's window.

Rows are one schedule entry each, with a channel, a start and a stop in seconds and the index of the day that reported
them. One window over the channel does it all, so a guide needs one shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CAP = 6 * 3600


def with_next(df: DataFrame, channel: str = "channel", order: tuple[str, ...] = ("st", "seq"), day: str | None = "day_idx") -> DataFrame:
    """Adds next_st, the start of the successor on the channel.

    With ``day`` the successor counts only if it was known when the row left: a row never sees past the day after its own.
    """
    w = Window.partitionBy(channel).orderBy(*order)
    nxt = F.lead("st").over(w)
    if day:
        nxt = F.when(F.lead(day).over(w) <= F.col(day) + 1, nxt)
    return df.withColumn("next_st", nxt)


def filled_stop(cap: int = CAP, st: str = "st", sp: str = "sp", nxt: str = "next_st") -> Column:
    """A missing stop is the successor's start, or start + cap where that is too far."""
    return F.when(F.col(sp).isNull() & (F.col(nxt) > F.col(st)), F.least(F.col(nxt), F.col(st) + cap)).otherwise(F.col(sp))


def clipped_stop(st: str = "st", sp: str = "sp", nxt: str = "next_st") -> Column:
    """A stop beyond a later successor's start is that start."""
    return F.when((F.col(sp) > F.col(nxt)) & (F.col(st) < F.col(nxt)), F.col(nxt)).otherwise(F.col(sp))


def polish(df: DataFrame, fill: int | None = CAP, clip: bool = True) -> DataFrame:
    """Both rules on rows with next_st: a row is filled or clipped, never both."""
    stop = F.col("sp")
    if fill is not None:
        stop = F.when(F.col("sp").isNull(), filled_stop(fill)).otherwise(stop)
    if clip:
        stop = F.when(F.col("sp").isNotNull(), clipped_stop()).otherwise(stop)
    return df.withColumn("sp", stop)


def clamp(df: DataFrame, first: int, days: int) -> DataFrame:
    """Rows that start in the window's days; a window without days keeps all that start at 0 or later."""
    if days <= 0:
        return df.where(F.col("st") >= 0)
    return df.where((F.col("st") >= first) & (F.col("st") < first + days * 86400))
