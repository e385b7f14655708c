"""Click histories over a stream: each row gets the user's last k positives before it, and no row is lost.

``stream_history`` gives rows back in the trigger that they come in: they see what
was processed before, in the order of time within a trigger. ``ordered_histories``
goes by event time: a row waits in its user's list state until the watermark has passed it; a timer then
releases the user's rows in the order of time, so histories don't depend on the
order of arrival. A row that comes after a later row of its user has been released is
given back at once, marked ``late`` and without a history, for a side table. Nothing
else is dropped, and a user's last positives are kept however long the user is idle.

What waits is bounded by the rows within ``delay`` of the newest; a row of no user
(``user_id`` NULL) that is far ahead moves the watermark past all others, to end a source.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: The state store that list states and timers need.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
_OUT = "user_id long, src_idx long, ts timestamp, item int, label int, history array<int>, late boolean"


class _Histories(StatefulProcessor):
    """The state of a user: rows that wait, the time of the first of them, the last row given back, and the positives before it.

    Rows that only wait are appended; they are read when some of them can be given back.
    """

    def __init__(self, k: int):
        self.k = k

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "us long, src_idx long, item int, label int")
        self.due = handle.getValueState("due", "us long")
        self.last = handle.getValueState("last", "us long, src_idx long, history array<int>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        if pd.isna(key[0]):
            return
        new = [tuple(None if pd.isna(v) else int(v) for v in r) for pdf in rows for r in pdf[["us", "src_idx", "item", "label"]].itertuples(index=False)]
        if not new:
            return
        watermark_ms, due, first = timerValues.getCurrentWatermarkInMs(), self.due.get(), min(r[0] for r in new)
        if min(first, due[0] if due else first) // 1000 < watermark_ms:
            yield from self._release(key, new, watermark_ms)
            return
        self.waiting.appendList(new)
        if not due or first < due[0]:
            self._wait_for(first)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        watermark_ms, due = timerValues.getCurrentWatermarkInMs(), self.due.get()
        if due and due[0] // 1000 < watermark_ms:  # else an earlier timer has released the rows
            yield from self._release(key, [], watermark_ms)

    def _wait_for(self, us: int) -> None:
        self.due.update((us,))
        self.handle.registerTimer(us // 1000 + 1)

    def _release(self, key, new: list[tuple], watermark_ms: int) -> Iterator[pd.DataFrame]:
        """Give back all rows before the watermark (there are some), in order; the others wait for a timer."""
        rows = sorted([*self.waiting.get(), *new], key=lambda r: (r[0], r[1]))
        ready = [r for r in rows if r[0] // 1000 < watermark_ms]
        left = rows[len(ready) :]
        if left:
            self.waiting.put(left)
            self._wait_for(left[0][0])
        else:
            self.waiting.clear()
            self.due.clear()
        at, history = (-(2**63), -1), []
        if self.last.exists():
            us, src_idx, known = self.last.get()
            at, history = (us, src_idx), list(known)
        out = []
        for us, src_idx, item, label in ready:
            late = (us, src_idx) < at
            out.append((key[0], src_idx, pd.Timestamp(us, unit="us"), item, label, None if late else list(history), late))
            if not late:
                at = us, src_idx
                if label == 1 and item is not None:
                    history = [*history, item][-self.k :]
        self.last.update((*at, history))
        yield pd.DataFrame(out, columns=["user_id", "src_idx", "ts", "item", "label", "history", "late"])

    def close(self) -> None:
        pass


def use_store(spark: SparkSession) -> str | None:
    """Choose the state store that this needs; returns the one that was set."""
    before = spark.conf.get(STORE[0], None)
    spark.conf.set(*STORE)
    return before


def stream_history(rows: DataFrame, k: int = 3) -> DataFrame:
    """``rows``: user_id, src_idx, ts (timestamp), item, label. Adds ``history`` (array of items), by the order of processing."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        history = list(state.get[0]) if state.exists else []
        pdf = pd.concat(list(batches)).sort_values(["ts", "src_idx"], kind="stable")
        seen = []
        for item, label in zip(pdf["item"], pdf["label"], strict=True):
            seen.append(list(history))
            if label == 1:
                history = [*history, int(item)][-k:]
        state.update((history,))
        yield pdf.assign(history=seen)[["user_id", "src_idx", "ts", "item", "label", "history"]]

    timed = rows.withColumn("ts", F.col("ts").cast("timestamp"))
    return timed.groupBy("user_id").applyInPandasWithState(
        step, "user_id long, src_idx long, ts timestamp, item int, label int, history array<int>", "history array<int>", "append", GroupStateTimeout.NoTimeout
    )


def ordered_histories(rows: DataFrame, k: int = 3, delay: str = "1 hour") -> DataFrame:
    """``rows``: user_id, src_idx, ts (timestamp), item, label. Adds ``history`` (array of items) and ``late``.

    The session must have the RocksDB state store (``use_store``) when the query starts.
    Rows without a time, and those without a user, aren't given back.
    """
    timed = rows.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    # the state gets the time as a number: rows that Spark would drop as late come to it and are marked
    # rows without a user are left to the state as well: a filter on users would go below the watermark
    told = timed.where("ts is not null").select("user_id", "src_idx", F.unix_micros("ts").alias("us"), "item", "label")
    return told.groupBy("user_id").transformWithStateInPandas(_Histories(k), outputStructType=_OUT, outputMode="Append", timeMode="EventTime")
