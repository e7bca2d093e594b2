"""Sliding-window admission: at most ``limit`` admitted events per key and window.

Rejected events take no room, so this is no range-frame count: each decision
depends on the ones before it.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BooleanType, LongType, StringType, StructField, StructType

LIMIT = 10
WINDOW_SECONDS = 60


def _admit(admitted: deque, micros: int, limit: int, window_micros: int) -> bool:
    while admitted and micros - admitted[0] > window_micros:
        admitted.popleft()
    if len(admitted) >= limit:
        return False
    admitted.append(micros)
    return True


def _micros(column: str) -> Column:
    return F.unix_micros(F.col(column).cast("timestamp"))


def busy_spells(events: DataFrame, key: str, ts: str, window_seconds: int) -> DataFrame:
    """Adds ``spell``: a key's events between pauses longer than the window.

    After such a pause nothing admitted earlier counts, so spells are independent
    and a key's history need not stay in one task. Pauses are found on one row per
    key and window-long slot, not on the events.
    """
    slot = F.floor(_micros(ts) / F.lit(window_seconds * 1_000_000)).cast("bigint")
    marked = events.withColumn("slot", slot)
    slots = marked.groupBy(key, "slot").agg(F.min(_micros(ts)).alias("low"), F.max(_micros(ts)).alias("high"))
    order = Window.partitionBy(key).orderBy("slot")
    pause = F.col("low") - F.lag("high").over(order) > window_seconds * 1_000_000
    starts = F.when(F.coalesce(pause, F.lit(True)), F.col("slot"))
    spells = slots.withColumn("start", starts).withColumn(
        "spell", F.last("start", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    )
    return marked.join(spells.select(key, "slot", "spell"), [key, "slot"]).drop("slot")


def admit(
    events: DataFrame, key: str = "key", ts: str = "ts", event_id: str = "event_id", limit: int = LIMIT,
    window_seconds: int = WINDOW_SECONDS,
) -> DataFrame:
    """Adds ``admitted`` to each event, deciding in time order (ties by event id).

    Spells are spread over tasks and each task reads its sorted rows as a stream of
    Arrow batches. Memory is the last ``limit`` admitted times of the current spell,
    whatever its length, and short spells cost no call of their own.
    """
    window_micros = window_seconds * 1_000_000
    rows = busy_spells(events, key, ts, window_seconds).select(
        F.col(key).cast("string").alias("key"), "spell", F.col(event_id).alias("event_id"), _micros(ts).alias("micros")
    )
    ordered = rows.repartition("key", "spell").sortWithinPartitions("key", "spell", "micros", "event_id")

    def decide(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        admitted: deque = deque()
        current = None
        for batch in batches:
            flags = []
            for key_value, spell, micros in zip(batch["key"], batch["spell"], batch["micros"].tolist(), strict=True):
                if (key_value, spell) != current:
                    current = (key_value, spell)
                    admitted.clear()
                flags.append(_admit(admitted, micros, limit, window_micros))
            yield batch[["key", "event_id", "micros"]].assign(admitted=flags)

    return ordered.mapInPandas(decide, "key string, event_id bigint, micros bigint, admitted boolean")


class AdmissionProcessor(StatefulProcessor):
    """The same decision on a stream: list state holds a key's admitted times."""

    def __init__(self, limit: int = LIMIT, window_seconds: int = WINDOW_SECONDS):
        self.limit = limit
        self.window_micros = window_seconds * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        # Arrival times drop out by the rule itself; the time to live only removes idle keys.
        self.admitted = handle.getListState(
            "admitted", StructType([StructField("micros", LongType())]), ttlDurationMs=10 * self.window_micros // 1000
        )

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        admitted = deque(r[0] for r in self.admitted.get())
        batch = pd.concat(list(rows)).sort_values(["micros", "event_id"])
        flags = [_admit(admitted, t, self.limit, self.window_micros) for t in batch["micros"].tolist()]
        if admitted:
            self.admitted.put([(t,) for t in admitted])
        else:
            self.admitted.clear()
        yield pd.DataFrame({"key": key[0], "event_id": batch["event_id"], "micros": batch["micros"], "admitted": flags})

    def close(self) -> None:
        pass


ADMISSION_SCHEMA = StructType([
    StructField("key", StringType()), StructField("event_id", LongType()),
    StructField("micros", LongType()), StructField("admitted", BooleanType()),
])


def admit_stream(events: DataFrame, limit: int = LIMIT, window_seconds: int = WINDOW_SECONDS) -> DataFrame:
    """Streaming admission over (key, event_id, ts); needs the RocksDB state store."""
    rows = events.select(F.col("key").cast("string").alias("key"), "event_id", _micros("ts").alias("micros"))
    return rows.groupBy("key").transformWithStateInPandas(
        statefulProcessor=AdmissionProcessor(limit, window_seconds), outputStructType=ADMISSION_SCHEMA,
        outputMode="Append", timeMode="ProcessingTime",
    )


class EventTimeAdmission(StatefulProcessor):
    """Decides a key's events in the order of their times, once the watermark has passed them.

    State is the events that wait, the admitted times of the last window, and the time up to which the key is decided.
    An event older than that is late: it comes out undecided. A timer wakes the key for its first waiting event, and
    once more a window after its last admitted one, when its state goes.
    """

    def __init__(self, limit: int = LIMIT, window_seconds: int = WINDOW_SECONDS):
        self.limit = limit
        self.window_micros = window_seconds * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        micros = StructField("micros", LongType())
        self.waiting = handle.getListState("waiting", StructType([micros, StructField("event_id", LongType())]))
        self.admitted = handle.getListState("admitted", StructType([micros]))
        self.decided = handle.getValueState("decided", StructType([micros]))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        known = self.decided.get()
        # A key without state was never seen or is done with everything behind the watermark.
        open_from = known[0] if known else timerValues.getCurrentWatermarkInMs() * 1000
        first = None
        for batch in rows:
            late = batch["micros"] < open_from
            if late.any():
                yield self._out(key, batch.loc[late, "event_id"].tolist(), batch.loc[late, "micros"].tolist(), None)
            kept = batch[~late]
            if len(kept):
                self.waiting.appendList(list(zip(kept["micros"].tolist(), kept["event_id"].tolist(), strict=True)))
                first = min(kept["micros"].min(), first if first is not None else kept["micros"].min())
        if first is not None:
            self.handle.registerTimer(int(first) // 1000 + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        until = timerValues.getCurrentWatermarkInMs() * 1000
        events = sorted((r[0], r[1]) for r in self.waiting.get())
        due = [e for e in events if e[0] < until]
        rest = events[len(due):]
        admitted = deque(r[0] for r in self.admitted.get())
        flags = [_admit(admitted, micros, self.limit, self.window_micros) for micros, _ in due]
        while admitted and until - admitted[0] > self.window_micros:
            admitted.popleft()
        for state, values in ((self.waiting, rest), (self.admitted, [(t,) for t in admitted])):
            if values:
                state.put(values)
            else:
                state.clear()
        if rest:
            self.handle.registerTimer(rest[0][0] // 1000 + 1)
        elif admitted:
            self.handle.registerTimer((admitted[-1] + self.window_micros) // 1000 + 1)
        if rest or admitted:
            self.decided.update((until,))
        else:
            self.decided.clear()
        if due:
            yield self._out(key, [e[1] for e in due], [e[0] for e in due], flags)

    @staticmethod
    def _out(key, ids: list, micros: list, flags: list | None) -> pd.DataFrame:
        admitted = pd.array(flags if flags is not None else [None] * len(ids), dtype="boolean")
        return pd.DataFrame({"key": key[0], "event_id": ids, "micros": micros, "admitted": admitted, "late": flags is None})

    def close(self) -> None:
        pass


def admit_stream_by_event_time(
    events: DataFrame, delay: str = "1 minute", limit: int = LIMIT, window_seconds: int = WINDOW_SECONDS,
) -> DataFrame:
    """Admission over a stream of (key, event_id, ts) by event time: (key, event_id, micros, admitted, late).

    Events may come out of order by ``delay``; at whatever speed they come, the decisions are those of ``admit`` over
    the table. Older events come out with ``late`` and no decision and take no room. An event is decided when the
    watermark is past it, so the last ones wait for later events of any key. Events without a time are left out. Needs
    the RocksDB state store.
    """
    timed = events.where("ts is not null").withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    # The time column itself stays out, so that Spark doesn't drop late rows before they are reported.
    rows = timed.select(F.col("key").cast("string").alias("key"), "event_id", _micros("ts").alias("micros"))
    return rows.groupBy("key").transformWithStateInPandas(
        statefulProcessor=EventTimeAdmission(limit, window_seconds),
        outputStructType=StructType([*ADMISSION_SCHEMA.fields, StructField("late", BooleanType())]), outputMode="Append", timeMode="EventTime",
    )
