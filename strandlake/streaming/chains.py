"""Streams: chains of events, running summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sessions(events: DataFrame, key: str, ts: str, gap: str, late: str | None = None) -> DataFrame:
    """Chains of a key's events with gaps up to `gap`: first, last, n. Batch or stream.

    On a stream, `late` is the watermark; chains come out in append mode once they are closed,
    and events later than that are dropped.
    """
    d = events.withWatermark(ts, late) if late else events
    s = d.groupBy(key, F.session_window(ts, gap).alias("w")).agg(F.min(ts).alias("first"), F.max(ts).alias("last"), F.count("*").alias("n"))
    return s.select(key, "first", "last", "n")


def running_totals(events: DataFrame, keys: list[str], value: str) -> DataFrame:
    """n, total and largest value by key; on a stream in update mode each batch's changed keys come out."""
    return events.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(value).alias("total"), F.max(value).alias("largest"))


def in_order(events: DataFrame, key: str, ts: str, mode: str = "append") -> DataFrame:
    """events as they are, on a stream; one that is older than its key's newest before it fails the query instead of being dropped.

    The newest time of each key is kept as state between batches; within a batch a key's rows
    count in the order of time, so only what comes in a later batch can be out of order.
    """
    from pyspark.sql.streaming.state import GroupStateTimeout

    def check(names, batches, state):
        newest = state.get[0] if state.exists else None
        parts = [pdf for pdf in batches if len(pdf)]
        for pdf in parts:
            if newest is not None and (pdf[ts] < newest).any():
                raise ValueError(f"out of order: {key} = {names[0]} has an event before {newest}")
        for pdf in parts:
            newest = pdf[ts].max() if newest is None else max(newest, pdf[ts].max())
            yield pdf
        if newest is not None:
            state.update((newest,))

    return events.groupBy(key).applyInPandasWithState(check, events.schema, "newest timestamp", mode, GroupStateTimeout.NoTimeout)
