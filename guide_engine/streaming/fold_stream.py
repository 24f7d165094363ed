"""The fold as a streaming operator: the state of a channel is what it still holds.

Rows come in batches of whole channel-days. A channel's days may come late or out of turn: a late row is never
dropped; it leaves with the next day's batch, unmatched with what has left. A row of kind 'end' flushes its channel.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.fold import OUT, FoldRows, Rules

ROW = "channel string, kind string, day_idx int, midnight long, source int, seq long, id long, st long, sp long, titles array<string>"


def fold_stream(rows: DataFrame, rules: Rules | None = None) -> DataFrame:
    """Assignments as of ``fold.fold`` for a stream of rows (``ROW``)."""
    rules = rules or Rules()

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        fold = pickle.loads(state.get[0]) if state.exists else FoldRows(rules)
        frame = pd.concat(list(frames)).sort_values(["day_idx", "source", "seq", "id"], kind="stable", na_position="last")
        out, ended = [], False
        for r in frame.itertuples(index=False):
            if r.kind == "end":
                ended = True
            else:
                out += fold.row(int(r.day_idx), int(r.midnight), int(r.source), int(r.id), int(r.st), None if pd.isna(r.sp) else int(r.sp), list(r.titles) if r.titles is not None else ())
        if ended:
            out += fold.close()
            state.remove()
        else:
            state.update((pickle.dumps(fold),))
        done = pd.DataFrame([(key[0], *x) for x in out], columns=[c.split()[0] for c in OUT.split(", ")])
        yield done.astype({"next_st": "Int64", "next_group": "Int64", "next_off": "Int32", "next_prec": "Int32"})

    return rows.groupBy("channel").applyInPandasWithState(step, OUT, "held binary", "append", GroupStateTimeout.NoTimeout)


def parse_stream(files: DataFrame) -> DataFrame:
    """Parse events of a binaryFile stream (path, content)."""
    from pyspark.sql import functions as F

    from ..sources.xml_source import parse_column

    return parse_column(files.select("path", F.decode("content", "UTF-8").alias("content")))
