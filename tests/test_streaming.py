"""Histories over streams: shuffled arrival, late rows, idle users."""

import random
import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

from clickloom.streaming import history

SCHEMA = "user_id long, src_idx long, s long, item int, label int"


@pytest.fixture
def store(spark):
    before = history.use_store(spark)
    yield
    spark.conf.unset(history.STORE[0]) if before is None else spark.conf.set(history.STORE[0], before)


def run(spark, folder, files, delay, end=None):
    """Each list of (user, src_idx, seconds, item, label) is a file and a trigger."""
    for rows in [*files, *([[(None, -1, end, None, None)]] if end else [])]:
        df = spark.createDataFrame(rows, SCHEMA).select("user_id", "src_idx", F.timestamp_seconds("s").alias("ts"), "item", "label")
        df.coalesce(1).write.mode("append").parquet(f"{folder}/in")
        time.sleep(0.02)
    source = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    made = history.ordered_histories(source, delay=delay).writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state")
    made.trigger(availableNow=True).start().awaitTermination()
    return {r["src_idx"]: (r["history"], r["late"]) for r in spark.read.parquet(f"{folder}/out").collect()}


def by_time(rows, k=3):
    want, past = {}, {}
    for user, src, _, item, label in sorted(rows, key=lambda r: (r[2], r[1])):
        seen = past.setdefault(user, [])
        want[src] = (seen[-k:], False)
        if label == 1:
            seen.append(item)
    return want


def test_order_of_arrival_does_not_matter(spark, tmp_path, store):
    r = random.Random(3)
    rows = [(i % 3, i, 1_000_000 + i // 2 * 60, i % 7, r.randrange(2)) for i in range(120)]  # ties in time, too
    r.shuffle(rows)
    files = [rows[k::5] for k in range(5)]
    assert run(spark, tmp_path, files, "1 day", end=1_000_000 + 20 * 86_400) == by_time(rows)


def test_late_rows_are_marked_and_idle_users_known(spark, tmp_path, store):
    day = 86_400
    files = [
        [(1, 0, day, 10, 1), (2, 1, day, 20, 1)],
        [(1, 2, 10 * day, 11, 1), (9, 3, 10 * day, 0, 0)],
        [(9, 4, 20 * day, 0, 0)],  # the watermark passes day 10 after this
        [(9, 8, 20 * day, 0, 0)],  # 2 is given back with this
        [(1, 5, 5 * day, 12, 1), (1, 6, 21 * day, 13, 0)],  # 5 comes after 2 was given back
        [(2, 7, 500 * day, 21, 1)],  # 2 was idle for over a year
    ]
    got = run(spark, tmp_path, files, "1 hour", end=600 * day)
    assert got == {0: ([], False), 1: ([], False), 2: ([10], False), 3: ([], False), 4: ([], False), 8: ([], False), 5: (None, True), 6: ([10, 11], False), 7: ([20], False)}


class _State:
    """A state that counts the rows that are read from it and written to it."""

    def __init__(self):
        self.rows, self.read, self.written, self.timers = [], 0, 0, []

    def get(self):
        self.read += len(self.rows)
        return iter(list(self.rows))

    def put(self, rows):
        self.clear()
        self.appendList(rows)

    def appendList(self, rows):
        self.written += len(rows)
        self.rows += rows

    def clear(self):
        self.rows = []


class _Value(_State):
    def exists(self):
        return bool(self.rows)

    def get(self):
        return self.rows[0] if self.rows else None

    def update(self, row):
        self.rows = [row]


class _Handle:
    def __init__(self):
        self.states, self.timers = {}, []

    def getListState(self, name, schema):
        return self.states.setdefault(name, _State())

    def getValueState(self, name, schema):
        return self.states.setdefault(name, _Value())

    def registerTimer(self, ms):
        self.timers.append(ms)


class _Now:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentWatermarkInMs(self):
        return self.ms


def test_rows_that_wait_are_written_and_read_once():
    handle, user = _Handle(), history._Histories(3)
    user.init(handle)
    rows = [(1_000_000 * ((k * 37) % 100 + 1), k, k, 1) for k in range(100)]
    for k in range(10):
        pdf = pd.DataFrame(rows[10 * k : 10 * k + 10], columns=["us", "src_idx", "item", "label"])
        assert list(user.handleInputRows((5,), iter([pdf]), _Now(0))) == []
    waiting = handle.states["waiting"]
    assert (waiting.read, waiting.written) == (0, 100) and min(handle.timers) == 1001
    half = [x for t in sorted(handle.timers) for x in user.handleExpiredTimer((5,), _Now(50_500), None)]
    whole = [x for t in sorted(handle.timers) for x in user.handleExpiredTimer((5,), _Now(10**9), None)]
    assert len(half) == len(whole) == 1 and waiting.read == 150 and waiting.rows == []
    got = pd.concat(half + whole)
    assert list(got["src_idx"]) == [r[1] for r in sorted(rows)] and not got["late"].any()
    assert list(got["history"])[-1] == [r[2] for r in sorted(rows)][-4:-1]
