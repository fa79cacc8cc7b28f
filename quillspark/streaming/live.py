"""Live state with clocks: leases that expire, lockouts that end and rate limits in bounded stores, on ``transformWithState``.

State is kept by Spark's RocksDB store (:func:`use_rocksdb`), entry by entry: a row reads and writes the entries that it touches, not
its whole store. Ends of leases and lockouts are event-time timers, so they happen when the watermark passes them, whether or not
another row of that key ever comes; a row that comes first finds them just as much over. What a stream gives is thus what a replay
of the same rows in order gives, plus a row for each end that passed.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from quillspark.streaming import stateful

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """The state store that ``transformWithState`` needs; a setting of the session's streams."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


def _rows(frames: Iterator[pd.DataFrame], order: list[str]) -> pd.DataFrame:
    return pd.concat(list(frames), ignore_index=True).sort_values(order, kind="stable")


class _Timed(StatefulProcessor):
    """A step whose state has an end: ``until`` in microseconds, 0 for none. Subclasses say how it ends."""

    fields = ""

    def __init__(self, order: list[str], key: str, kind: type):
        self.order, self.key, self.kind = order, key, kind

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", self.fields)

    def _set(self, before: int, state: tuple, until: int) -> None:
        if before != until:
            if before:
                self.handle.deleteTimer(-(-before // 1000))
            if until:
                self.handle.registerTimer(-(-until // 1000))
        self.state.update(state)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held = tuple(int(x) for x in self.state.get()) if self.state.exists() else self.initial
        before, made = self.until(held), []
        for row in _rows(rows, self.order).itertuples(index=False):
            end = self.until(held)
            if end and row.us >= end:
                held, shown = self.ended(held)
                made.append((key[0], None, end, self.word, *shown))
            held, shown = self.advance(held, row)
            made.append((key[0], row.id, row.us, "row", *shown))
        self._set(before, held, self.until(held))
        yield self.frame(made)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held = tuple(int(x) for x in self.state.get()) if self.state.exists() else self.initial
        end = self.until(held)
        if end and end <= 1000 * expiredTimerInfo.getExpiryTimeInMs():
            held, shown = self.ended(held)
            self.state.update(held)
            yield self.frame([(key[0], None, end, self.word, *shown)])

    def frame(self, made: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame(made, columns=[self.key, "id", "us", "event", *self.names])
        out["id"] = out["id"].astype("Int64")
        return out

    def close(self) -> None:
        pass


class Leases(_Timed):
    """Leased jobs: a claim holds for ``lease_us``; then the job is pending again, or dead after its last attempt."""

    fields = "status long, attempts long, lease long, until long"
    initial, word, names = (0, 0, 0, 0), "expired", ["accepted", "status", "attempts"]

    def __init__(self, order, key, kind, most: int, lease_us: int):
        super().__init__(order, key, kind)
        self.most, self.lease_us, self.step = most, lease_us, stateful.job_machine(most)

    @staticmethod
    def until(state: tuple) -> int:
        return state[3]

    def ended(self, state: tuple) -> tuple[tuple, tuple]:
        after = (0 if state[1] < self.most else 3, state[1], 0, 0)
        return after, (True, stateful.STATES[after[0]], after[1])

    def advance(self, state: tuple, row) -> tuple[tuple, tuple]:
        after, shown = self.step(state[:3], row)
        until = 0 if after[0] != 1 else state[3] if state[0] == 1 else row.us + self.lease_us
        return (*after, until), shown


class Lockouts(_Timed):
    """Accounts that ``most`` failures in a row lock for ``lock_us``, and the moments at which they open again."""

    fields = "failures long, until long"
    initial, word, names = (0, 0), "opened", ["locked", "failures"]

    def __init__(self, order, key, kind, most: int, lock_us: int):
        super().__init__(order, key, kind)
        self.step = stateful.lockout(most, lock_us)

    @staticmethod
    def until(state: tuple) -> int:
        return state[1]

    @staticmethod
    def ended(state: tuple) -> tuple[tuple, tuple]:
        return (0, 0), (False, 0)

    def advance(self, state: tuple, row) -> tuple[tuple, tuple]:
        return self.step(state, row)


def _timed(df: DataFrame, key: str, time: str, late: str, processor: type, result: str, order: list[str], *settings) -> DataFrame:
    source = df.withWatermark(time, late)
    kinds = {f.name: f.dataType for f in df.schema}
    made = processor(order, key, type(kinds[key]), *settings)
    return source.groupBy(key).transformWithStateInPandas(made, f"`{key}` {kinds[key].simpleString()}, id long, us long, event string, {result}", "Append", "EventTime")


def leases(df: DataFrame, key: str, time: str, late: str, most: int, lease_us: int, order: list[str]) -> DataFrame:
    """(key, id, us, event, accepted, status, attempts) of a stream of commands (key, id, us, command, lease; ``time``: when, for the
    watermark, ``late`` behind): a row for each command, and one with event "expired" and no id for each lease that ran out."""
    return _timed(df, key, time, late, Leases, stateful.JOB_RESULT, order, most, lease_us)


def lockouts(df: DataFrame, key: str, time: str, late: str, most: int, lock_us: int, order: list[str]) -> DataFrame:
    """(key, id, us, event, locked, failures) of a stream of attempts (key, id, us, failed): a row for each, and one with event "opened"
    for each lock that ended."""
    return _timed(df, key, time, late, Lockouts, stateful.LOCKOUT_RESULT, order, most, lock_us)


class Store(StatefulProcessor):
    """Rate limits of many clients in one store of ``most`` entries, as :func:`quillspark.streaming.stateful.bounded_store` has them:
    entries by client, and clients by number in the order in which they came, both entry by entry in the state store."""

    def __init__(self, order: list[str], limit: int, window_us: int, most: int, ttl_ms: int | None):
        self.order, self.limit, self.window_us, self.most, self.ttl_ms = order, limit, window_us, most, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.entries = handle.getMapState("entries", "client long", "hits long, until long", ttlDurationMs=self.ttl_ms)
        self.queue = handle.getMapState("queue", "number long", "client long", ttlDurationMs=self.ttl_ms)
        self.ends = handle.getValueState("ends", "head long, tail long, held long", ttlDurationMs=self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        head, tail, held = map(int, self.ends.get()) if self.ends.exists() else (0, 0, 0)
        made = []
        for row in _rows(rows, self.order).itertuples(index=False):
            client, evicted = (int(row.client),), None
            found = self.entries.getValue(client) if self.entries.containsKey(client) else None
            if found is None or row.us > found[1]:
                while held >= self.most and head < tail:  # the oldest goes; one whose time to live is over has gone already
                    oldest = self.queue.getValue((head,)) if self.queue.containsKey((head,)) else None
                    self.queue.removeKey((head,))
                    head += 1
                    if oldest is not None:
                        evicted, held = int(oldest[0]), held - 1
                        self.entries.removeKey((evicted,))
                        break
                hits, until = 1, row.us + self.window_us
                if found is None or evicted == client[0]:
                    self.queue.updateValue((tail,), client)
                    tail, held = tail + 1, held + 1
            else:
                hits, until = int(found[0]) + 1, int(found[1])
            self.entries.updateValue(client, (hits, until))
            made.append((row.id, hits <= self.limit, held, evicted))
        self.ends.update((head, tail, held))
        out = pd.DataFrame(made, columns=["id", "allowed", "held", "evicted"])
        out["evicted"] = out["evicted"].astype("Int64")
        yield out

    def close(self) -> None:
        pass


def shard(client: Column, shards: int) -> Column:
    """The store that a client's requests go to: stores are as many as ``shards``, each with its own bound, whoever the clients are."""
    return F.pmod(F.xxhash64(client), F.lit(shards)).cast("int")


def bounded_stores(df: DataFrame, limit: int, window_us: int, most: int, shards: int, order: list[str], ttl_ms: int | None = None) -> DataFrame:
    """(id, allowed, held, evicted) of a stream of requests (id, us, client: long). ``ttl_ms``: entries that nobody touched for so
    long, by the clock, are dropped by the state store itself."""
    keyed = df.withColumn("__qs_shard", shard(F.col("client"), shards))
    mode = "None" if ttl_ms is None else "ProcessingTime"
    return keyed.groupBy("__qs_shard").transformWithStateInPandas(Store(order, limit, window_us, most, ttl_ms), f"id long, {stateful.BOUNDED_RESULT}", "Append", mode)
