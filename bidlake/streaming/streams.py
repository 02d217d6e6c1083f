"""Structured Streaming twins: keyed accumulator with expiry, lead versions, hopping alerts, discovery."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Accumulator(StatefulProcessor):
    """Keeps the last record of each id; empty carry fields keep their old value. Input: id, seq, title, note, end_us.

    Event time drives the eviction: a timer at the record's end emits it once more as expired and drops it.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.record = handle.getValueState("record", "seq long, title string, note string, end_us long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows)).sort_values("seq")
        old = self.record.get() if self.record.exists() else None
        is_new = old is None
        for r in frame.itertuples():
            note = r.note if isinstance(r.note, str) and r.note else (old[2] if old else None)
            old = (int(r.seq), r.title, note, None if pd.isna(r.end_us) else int(r.end_us))
        self.record.update(old)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if old[3] is not None:
            self.handle.registerTimer(old[3] // 1000)
        yield self._row(key, old, "new" if is_new else "updated")

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.record.exists():
            old = self.record.get()
            self.record.clear()
            yield self._row(key, old, "expired")

    def close(self) -> None:
        pass

    @staticmethod
    def _row(key, record, event: str) -> pd.DataFrame:
        return pd.DataFrame({"id": [key[0]], "seq": [record[0]], "title": [record[1]], "note": [record[2]], "event": [event]})


def accumulator_stream(records: DataFrame) -> DataFrame:
    """records: id, seq, title, note, end_us, ts with a watermark on ts. Needs the RocksDB state store."""
    return records.groupBy("id").transformWithStateInPandas(Accumulator(), "id long, seq long, title string, note string, event string", "Update", "EventTime")


class LeadVersions(StatefulProcessor):
    """Sticky change status per lead; compares with the stored version before it is overwritten. Input: lead, run, content_hash, updated_at."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.version = handle.getValueState("version", "content_hash string, updated_at long, level int")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        out = []
        for r in pd.concat(list(rows)).sort_values("run").itertuples():
            old = self.version.get() if self.version.exists() else None
            level = 0 if old is None else 2 if r.content_hash != old[0] else 1 if r.updated_at != old[1] else 0
            top = max(level, old[2] if old else 0)
            self.version.update((r.content_hash, int(r.updated_at), top))
            out.append((key[0], int(r.run), ("unchanged", "formal", "material")[level], ("unchanged", "formal", "material")[top]))
        yield pd.DataFrame(out, columns=["lead", "run", "change", "sticky"])

    def close(self) -> None:
        pass


def lead_version_stream(runs: DataFrame) -> DataFrame:
    return runs.groupBy("lead").transformWithStateInPandas(LeadVersions(), "lead long, run long, change string, sticky string", "Update", "None")


def hopping_counts(events: DataFrame, key: str, seconds: int, slide: int, hits: int) -> DataFrame:
    """key, start and n of the windows in which a key has at least ``hits`` events; for batches and, behind a watermark, streams."""
    counts = events.groupBy(F.window("ts", f"{seconds} seconds", f"{slide} seconds"), key).agg(F.count(F.lit(1)).alias("n"))
    return counts.where(F.col("n") >= hits).select(key, F.col("window.start").alias("start"), "n")


def hopping_alerts(events: DataFrame, key: str, seconds: int, slide: int, hits: int, late: str = "1 minute", id: str | None = None) -> DataFrame:
    """:func:`hopping_counts` over a stream; the watermark waits ``late`` for late events, and an event that comes again with its ``id`` in that time counts once."""
    rows = events.withWatermark("ts", late)
    rows = rows.dropDuplicatesWithinWatermark([id]) if id else rows
    return hopping_counts(rows, key, seconds, slide, hits)


def discovery(records: DataFrame, known: DataFrame | None = None, relevant: Column | None = None, late: str = "1 day") -> DataFrame:
    """Relevant records whose id is neither in ``known`` (id, a table) nor was seen within the watermark."""
    rows = records.withWatermark("ts", late)
    rows = rows if relevant is None else rows.where(relevant)
    rows = rows if known is None else rows.join(known.select("id").distinct(), "id", "left_anti")
    return rows.dropDuplicatesWithinWatermark(["id"])
