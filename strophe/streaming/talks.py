"""Streaming forms: sessions with late data, an append-only ledger, pauses and a held peak per key."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def sessions(events: DataFrame, key: str, ts: str, pause: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """(key, start, end, n): sessions of events without a pause; the watermark bounds the state."""
    grouped = events.withWatermark(ts, late).groupBy(F.session_window(ts, pause), key)
    return grouped.agg(F.count("*").alias("n")).select(key, "session_window.start", "session_window.end", "n")


def windowed_totals(events: DataFrame, ts: str, key: str, value: str, length: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Tumbling-window sums per key."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, length), key).agg(F.sum(value).alias("total"), F.count("*").alias("n")).select("window.start", key, "total", "n")


def append_ledger(entries: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Entries appended once each to a Parquet ledger: the file sink's log makes retries harmless."""
    return entries.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def pauses(events: DataFrame, key: str, ts: str, least_s: float) -> DataFrame:
    """(key, lo, hi) of pauses of ``least_s`` or more between the events of a key, across batches: state is the last time."""

    def step(k: tuple, batches: Iterator, state) -> Iterator:
        import pandas as pd

        rows = pd.concat(list(batches)).sort_values(ts)
        times = list(rows[ts])
        last = pd.Timestamp(state.get[0]) if state.exists else None
        found = []
        for t in times:
            if last is not None and (t - last).total_seconds() >= least_s:
                found.append((k[0], last, t))
            last = t if last is None else max(last, t)
        state.update((last.to_pydatetime(),))
        yield pd.DataFrame(found, columns=[key, "lo", "hi"])

    kind = dict(events.dtypes)[key]
    return events.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, lo timestamp, hi timestamp", "last timestamp", "append", "NoTimeout")
