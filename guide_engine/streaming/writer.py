"""A stream of guide events written as one document: a ``foreachBatch`` function with the document's state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from ..sources.xml_sink import EventWriter


def _bare(x):
    """A row's dict without the fields that are absent."""
    if isinstance(x, dict):
        return {k: _bare(v) for k, v in x.items() if v is not None}
    return [_bare(v) for v in x] if isinstance(x, list) else x


class DocumentSink:
    """``events.writeStream.foreachBatch(sink)``; ``close`` ends the document.

    A batch's events are written in the order of path and seq, a partition at a time. A batch that Spark runs again, after a failure
    between its write and its commit, is not written twice.
    """

    def __init__(self, target, meta: dict | None = None, indent: int | str | None = None, on_warning: Callable[[dict], None] | None = None):
        self.target, self.writer, self.last = target, EventWriter(meta, indent, on_warning), -1

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        if batch_id <= self.last:
            return
        for r in batch.orderBy("path", "seq").toLocalIterator():
            row = r.asDict(recursive=True)
            kind = row["kind"]
            value = {k: row[k] for k in ("code", "message", "line", "col")} if kind == "warning" else _bare(row[kind])
            if text := self.writer.event(kind, value):
                self.target.write(text)
        self.last = batch_id

    def close(self) -> None:
        self.target.write(self.writer.end())
