"""The ledger's current statuses as a stream."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

FIELDS = ("processing", "qc", "ocr", "export")
OUT = "job_id long, " + ", ".join(f"{f}_status string" for f in FIELDS)
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

#: field, status, time in microseconds, event_id
Write = tuple[str, str, int, int]


def kept_writes(writes: Iterable[Write], cut: int | None, settled: int) -> list[Write]:
    """The writes that can still count, once each: before the cut, and of those before `settled` (no event comes from before it any more) only the last of each field."""
    last: dict[str, Write] = {}
    open_: set[Write] = set()
    for w in writes:
        if cut is not None and w[2] >= cut:
            continue
        if w[2] >= settled:
            open_.add(w)
        elif w[0] not in last or w[2:] > last[w[0]][2:]:
            last[w[0]] = w
    return [*last.values(), *sorted(open_, key=lambda w: w[2:])]


def statuses(writes: Iterable[Write], cut: int | None) -> dict[str, str]:
    """The status of each field: that of its last write; a superseded job's processing and export are Superseded."""
    last: dict[str, Write] = {}
    for w in writes:
        if w[0] not in last or w[2:] > last[w[0]][2:]:
            last[w[0]] = w
    now = {f: last[f][1] if f in last else "Pending" for f in FIELDS}
    return now | ({"processing": "Superseded", "export": "Superseded"} if cut is not None else {})


class JobStatuses(StatefulProcessor):
    """What is held of a job: the time of its first supersede, and the writes that can still count. Both go when no event of the job has come for `idle_ms` of event time."""

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.job = handle.getValueState("job", "cut long, latest long")
        self.writes = handle.getListState("writes", "field string, status string, us long, event_id long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        cut, latest = self.job.get() if self.job.exists() else (None, -(2**62))
        held = [tuple(w) for w in self.writes.get()]
        for chunk in rows:
            for kind, status, us, event_id in zip(chunk["kind"], chunk["new_status"], chunk["us"].tolist(), chunk["event_id"].tolist(), strict=True):
                latest = max(latest, us)
                if kind == "supersede":
                    cut = us if cut is None else min(cut, us)
                elif kind in FIELDS:
                    held.append((kind, status, us, event_id))
        held = kept_writes(held, cut, timerValues.getCurrentWatermarkInMs() * 1000)
        self.job.update((cut, latest))
        self.writes.put(held) if held else self.writes.clear()
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        self.handle.registerTimer(latest // 1000 + self.idle_ms)
        yield pd.DataFrame([[key[0], *statuses(held, cut).values()]], columns=[c.split()[0] for c in OUT.split(", ")])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.job.clear()
        self.writes.clear()
        return iter([])

    def close(self) -> None:
        pass


def ledger_stream(events: DataFrame, watermark: str = "10 minutes", idle_ms: int = 24 * 3600 * 1000) -> DataFrame:
    """Statuses of each job that a micro-batch touches, after it: the last write of a field by (ts, event_id), none at or after the first supersede. Write it in update mode.

    Events may come in any order within `watermark`: writes that a late supersede could still take back are kept, so what they had replaced comes back with it, and the last row of a job is that of the
    batch form (a07). Older events are dropped. Behind the watermark one write of a field is kept. A job's state goes once the watermark is `idle_ms` past its last event; events of it that come
    later start anew, so `idle_ms` has to be longer than a job can rest. Events without a job, time or id are left out. State lives in RocksDB and survives a restart from the checkpoint. Give the
    query a trigger of one second to look as often as the batch worker does.
    """
    conf = events.sparkSession.conf
    if "RocksDB" not in conf.get(PROVIDER):
        conf.set(PROVIDER, ROCKSDB)  # list state and timers need it
    rows = events.where("job_id IS NOT NULL AND ts IS NOT NULL AND event_id IS NOT NULL").withWatermark("ts", watermark)
    rows = rows.select("job_id", "event_id", "new_status", "ts", F.lower("status_type").alias("kind"), F.unix_micros("ts").alias("us"))
    return rows.groupBy("job_id").transformWithStateInPandas(JobStatuses(idle_ms), OUT, "Update", "EventTime")
