"""Keyed state machines: rate limits, lockouts, circuit breakers, leased jobs.

Each is a pure step (state, row) -> (state, result). On a stream the step runs in
``applyInPandasWithState``; on a table it replays each key's rows in time order,
which is what a stream that starts empty would do.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

Step = Callable[[tuple, Any], tuple[tuple, tuple]]


def rate_limit(limit: int, window_us: int) -> Step:
    """State (first hit, hits). A window opens at a key's first hit; hits beyond ``limit`` in it are refused until it ends.
    Result: allowed, remaining, retry_after_us."""

    def step(state: tuple, row) -> tuple[tuple, tuple]:
        start, hits = state
        if start < 0 or row.us >= start + window_us:
            start, hits = row.us, 0
        hits += 1
        ok = hits <= limit
        return (start, hits), (ok, max(0, limit - hits), 0 if ok else start + window_us - row.us)

    return step


def bounded_store(limit: int, window_us: int, most: int = 10_000) -> Step:
    """Rate limits of many clients in one store of ``most`` entries: state (entries: client -> [hits, end of its window], in the order
    in which they came; None at first), changed in place. A full store lets its oldest entry go for a new one, whose client then starts
    afresh; entries whose window is over are replaced when their client comes again. Rows have us and client. Result: allowed, held,
    evicted. On streams: :func:`quillspark.streaming.live.bounded_stores`."""

    def step(state: tuple, row) -> tuple[tuple, tuple]:
        entries, evicted = {} if state[0] is None else state[0], None
        found = entries.get(row.client)
        if found is None or row.us > found[1]:
            if len(entries) >= most:
                evicted = next(iter(entries))
                del entries[evicted]
            entries[row.client] = [1, row.us + window_us]
        else:
            found[0] += 1
        return (entries,), (entries[row.client][0] <= limit, len(entries), evicted)

    return step


BOUNDED_RESULT = "allowed boolean, held long, evicted long"
RATE_STATE, RATE_RESULT = "start long, hits long", "allowed boolean, remaining long, retry_after_us long"


def lockout(most: int, lock_us: int) -> Step:
    """State (failures in a row, locked until). ``most`` failures lock for a time, in which nothing is let in; a success clears.
    Result: locked, failures."""

    def step(state: tuple, row) -> tuple[tuple, tuple]:
        failures, until = state
        if row.us < until:
            return state, (True, failures)
        if until:
            failures, until = 0, 0
        failures = failures + 1 if row.failed else 0
        if failures >= most:
            until = row.us + lock_us
        return (failures, until), (until > 0, failures)

    return step


LOCKOUT_STATE, LOCKOUT_RESULT = "failures long, until long", "locked boolean, failures long"


def breaker(threshold: int, cooldown_us: int) -> Step:
    """State (failures in a row, last failure). Result: state before the row ("healthy", "degraded", "open"), failures after it.
    An open breaker passes calls again, with a clean count, once the cooldown is over."""

    def step(state: tuple, row) -> tuple[tuple, tuple]:
        failures, last = state
        if failures >= threshold:
            if row.us - last < cooldown_us:
                return state, ("open", failures)
            shown, failures = "degraded", 0
        else:
            shown = "degraded" if failures and failures >= max(1, threshold - 1) else "healthy"
        failures, last = (failures + 1, row.us) if row.failed else (0, last)
        return (failures, last), (shown, failures)

    return step


BREAKER_STATE, BREAKER_RESULT = "failures long, last long", "state string, failures long"

#: States of a job, by number.
STATES = ("pending", "reserved", "done", "dead")


def job_machine(most_attempts: int) -> Step:
    """State (status, attempts, lease). Commands: claim, complete, fail, requeue, recover, each with a lease number.
    complete and fail only count with the lease of the claim (fencing). Result: accepted, status, attempts."""

    def step(state: tuple, row) -> tuple[tuple, tuple]:
        status, attempts, lease = state
        new = None
        if row.command == "claim" and status == 0:
            new = (1, attempts + 1, row.lease)
        elif row.command == "complete" and status == 1 and row.lease == lease:
            new = (2, attempts, 0)
        elif row.command == "fail" and status == 1 and row.lease == lease:
            new = (0 if attempts < most_attempts else 3, attempts, 0)
        elif row.command == "recover" and status == 1:
            new = (0, attempts, 0)
        elif row.command == "requeue" and status in (2, 3):
            new = (0, 0, 0)
        after = new or state
        return after, (new is not None, STATES[after[0]], after[1])

    return step


JOB_STATE, JOB_RESULT = "status long, attempts long, lease long", "accepted boolean, status string, attempts long"


def _names(ddl: str) -> list[str]:
    return [part.split()[0] for part in ddl.split(",")]


def replay(df: DataFrame, key: str, step: Step, initial: tuple, result: str, order: list[str]) -> DataFrame:
    """The columns of ``df`` with a step's result for each row, key by key in ``order``. A key's rows are one task's: keys are
    users or providers, whose history is bounded by retention."""
    names = _names(result)

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(order, kind="stable")
        state, made = initial, []
        for row in group.itertuples(index=False):
            state, out = step(state, row)
            made.append(out)
        for i, n in enumerate(names):
            group[n] = [m[i] for m in made]
        return group

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.groupBy(key).applyInPandas(run, f"{fields}, {result}")


def replay_sorted(df: DataFrame, key: str, step: Step, initial: tuple, result: str, order: list[str]) -> DataFrame:
    """As :func:`replay`, for keys of any length: a key's rows are sorted by Spark and pass through one task a batch at a time, which
    holds the state alone. For states that no stretch of rows makes a small function of, such as a store's; keys are its shards."""
    names, columns = _names(result), df.columns
    dealt = df.repartition(F.col(f"`{key}`")).sortWithinPartitions(F.col(f"`{key}`"), *[F.col(f"`{c}`") for c in order])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state, of, begun = initial, None, False
        for batch in batches:
            made = []
            for row, value in zip(batch.itertuples(index=False), batch[key]):
                if not begun or value != of:
                    state, of, begun = initial, value, True
                state, out = step(state, row)
                made.append(out)
            for i, n in enumerate(names):
                batch[n] = pd.array([m[i] for m in made], dtype="Int64") if any(m[i] is None for m in made) else [m[i] for m in made]
            yield batch

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return dealt.select(*[F.col(f"`{c}`") for c in columns]).mapInPandas(run, f"{fields}, {result}")


def stream(df: DataFrame, key: str, step: Step, initial: tuple, state: str, result: str, order: list[str], idle_ms: int | None = None) -> DataFrame:
    """As :func:`replay` on a stream: (key, columns in ``order``, result). Rows of a batch are taken in ``order``. ``idle_ms``: a
    key's state is dropped after so long without rows."""
    carried = [key, *order]
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    fields = ", ".join(f"`{c}` {kinds[c]}" for c in carried)
    names = _names(result)

    def run(_: tuple, batches: Iterable[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        if held.hasTimedOut:
            held.remove()
            return
        now = held.get if held.exists else initial
        rows = pd.concat(list(batches), ignore_index=True).sort_values(order, kind="stable")
        made = []
        for row in rows.itertuples(index=False):
            now, out = step(tuple(now), row)
            made.append(out)
        held.update(tuple(now))
        if idle_ms is not None:
            held.setTimeoutDuration(idle_ms)
        shown = rows[carried].copy()
        for i, n in enumerate(names):
            shown[n] = [m[i] for m in made]
        yield shown

    timeout = GroupStateTimeout.ProcessingTimeTimeout if idle_ms is not None else GroupStateTimeout.NoTimeout
    return df.groupBy(key).applyInPandasWithState(run, f"{fields}, {result}", state, "append", timeout)
