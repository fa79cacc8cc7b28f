"""Replays of state machines over tables in which one key may hold most rows: a scan by composed transitions.

A machine makes of any stretch of rows a function from the state before it to the state after it, and that function can be worked
out without knowing the state before. For the few *plain* states the rows are run through backwards once: a state ends where the
state that a row makes of it ends. A *waiting* state (locked until a time, leased until a command) leads on from the row that ends the
wait, of which there are few kinds. So rows are range-partitioned by key and order, whatever the sizes of keys; each partition gives
the function of the key that it begins with; the functions, a row a partition, are applied one after the other; and with the states
in which they begin all partitions are replayed side by side.
"""

from __future__ import annotations

import json
from bisect import bisect_left
from collections import namedtuple
from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.session import materialize
from quillspark.streaming import stateful

#: Rows that a partition has about, at most.
ROWS = 1 << 20
#: Stands for any number of attempts at the limit or beyond.
BEYOND = 1 << 40


class Machine:
    """A step with what is known of its states. ``plain``: the states that are run backwards, by ``place``."""

    step: stateful.Step
    initial: tuple
    plain: Sequence[tuple]

    def place(self, state: tuple) -> int:
        raise NotImplementedError

    def waits(self, state: tuple) -> bool:
        raise NotImplementedError

    def index(self, rows: Sequence):
        """What finds the ends of waits among rows."""
        raise NotImplementedError

    def leaves(self, state: tuple, index, start: int, n: int) -> int:
        """The row, from ``start`` on, that ends a wait; ``n`` if none does."""
        raise NotImplementedError

    def counted(self, state: tuple, rows: int) -> tuple:
        """A waiting state after some rows that it let pass."""
        return state

    def resolved(self, end: tuple, state: tuple) -> tuple:
        """The end of ``state``, from that of the plain state in its place."""
        return end

    def ends(self, rows: Sequence) -> tuple[list[list[tuple]], object]:
        """For each row, the end of each plain state that is met before it; and the index."""
        n, index = len(rows), self.index(rows)
        out: list[list[tuple]] = [[] for _ in range(n)]
        for i in range(n - 1, -1, -1):
            out[i] = [self.end_of(self.step(s, rows[i])[0], i + 1, rows, out, index) for s in self.plain]
        return out, index

    def end_of(self, state: tuple, at: int, rows: Sequence, ends: list, index) -> tuple:
        """The end of a state that is met before row ``at``, by what is known of the rows behind."""
        n = len(rows)
        while at < n and self.waits(state):
            k = self.leaves(state, index, at, n)
            state = self.counted(state, k - at)
            if k == n:
                return state
            state, at = self.step(state, rows[k])[0], k + 1
        return state if at == n else self.resolved(ends[at][self.place(state)], state)

    def summary(self, rows: Sequence) -> dict:
        """The function of a stretch of rows."""
        ends, index = self.ends(rows)
        return {"n": len(rows), "plain": ends[0], "waits": self.table(rows, ends, index)}

    def table(self, rows: Sequence, ends: list, index):
        """Where waiting states lead."""
        raise NotImplementedError

    def through(self, table, n: int, state: tuple) -> tuple:
        raise NotImplementedError

    def after(self, summary: dict, state: tuple) -> tuple:
        """The function of a stretch, applied."""
        if self.waits(state):
            return tuple(self.through(summary["waits"], summary["n"], state))
        return self.resolved(tuple(summary["plain"][self.place(state)]), state)


class Timed(Machine):
    """A machine whose waits end at a time, with the first row then, as if nothing had been before: rate limits, lockouts, breakers."""

    def __init__(self, step, initial, plain, place, until, counted=None):
        self.step, self.initial, self.plain, self.place, self.until = step, initial, plain, place, until
        if counted:
            self.counted = counted

    def waits(self, state):
        return self.until(state) is not None

    def index(self, rows):
        return [r.us for r in rows]

    def leaves(self, state, index, start, n):
        return bisect_left(index, self.until(state), start)

    def table(self, rows, ends, index):
        """Pieces (time, end): a wait leads to the end of the first piece whose time isn't before the wait's. Equal ends are one piece."""
        out: list[list] = []
        for k, us in enumerate(index):
            if k and index[k - 1] == us:
                continue  # of rows at one time the first ends the wait
            end = ends[k][self.place(self.initial)]
            if out and out[-1][1] == end:
                out[-1][0] = us
            else:
                out.append([us, end])
        return out

    def through(self, table, n, state):
        at = bisect_left(table, self.until(state), key=lambda piece: piece[0])
        return table[at][1] if at < len(table) else self.counted(state, n)


class Jobs(Machine):
    """Leased jobs: a reserved one waits for a command of its lease, or for recovery. Rows have command and lease."""

    def __init__(self, most_attempts: int):
        self.most, self.step, self.initial = most_attempts, stateful.job_machine(most_attempts), (0, 0, 0)
        tries = [*range(most_attempts), BEYOND]
        self.plain = [(status, a, 0) for status in (0, 2, 3) for a in tries]
        self.tries = tries[1:]

    def place(self, state):
        return (0, None, 1, 2)[state[0]] * (self.most + 1) + min(state[1], self.most)

    def waits(self, state):
        return state[0] == 1

    def index(self, rows):
        by: dict = {}
        for i, r in enumerate(rows):
            if r.command in ("complete", "fail"):
                by.setdefault(r.lease, []).append(i)
        return [i for i, r in enumerate(rows) if r.command == "recover"], by

    def leaves(self, state, index, start, n):
        recovers, by = index
        own, at = by.get(state[2], ()), bisect_left(recovers, start)
        mine = bisect_left(own, start)
        return min(recovers[at] if at < len(recovers) else n, own[mine] if mine < len(own) else n)

    def resolved(self, end, state):
        return (end[0], state[1] + end[1] - BEYOND, end[2]) if end[1] >= BEYOND // 2 else end

    def table(self, rows, ends, index):
        """Ends by number of attempts: of jobs that are recovered first, and by lease of those that a command ends before that."""
        recovers, by = index
        first = recovers[0] if recovers else len(rows)
        lead = lambda k, lease: [self.end_of(self.step((1, a, lease), rows[k])[0], k + 1, rows, ends, index) for a in self.tries]
        return {"recovered": lead(first, None) if recovers else None, "ended": [[lease, lead(at[0], lease)] for lease, at in by.items() if at[0] < first]}

    def through(self, table, n, state):
        found = next((ends for lease, ends in table["ended"] if lease == state[2]), table["recovered"])
        return state if found is None else self.resolved(tuple(found[min(state[1], self.most) - 1]), state)


def rate_limit(limit: int, window_us: int) -> Machine:
    return Timed(stateful.rate_limit(limit, window_us), (-1, 0), [(-1, 0)], lambda s: 0, lambda s: s[0] + window_us if s[0] >= 0 else None, lambda s, n: (s[0], s[1] + n))


def lockout(most: int, lock_us: int) -> Machine:
    return Timed(stateful.lockout(most, lock_us), (0, 0), [(f, 0) for f in range(most)], lambda s: s[0], lambda s: s[1] or None)


def breaker(threshold: int, cooldown_us: int) -> Machine:
    return Timed(stateful.breaker(threshold, cooldown_us), (0, 0), [(f, 0) for f in range(threshold)], lambda s: s[0], lambda s: s[1] + cooldown_us if s[0] >= threshold else None)


def jobs(most_attempts: int) -> Machine:
    return Jobs(most_attempts)


def replay(df: DataFrame, key: str, machine: Machine, result: str, order: Sequence[str], rows: int | None = None) -> DataFrame:
    """The columns of ``df`` with a step's result for each row, key by key in ``order``, which should break all ties: what
    :func:`quillspark.streaming.stateful.replay` gives, with a hot key's rows over all tasks. Null keys are a key. ``rows``: of a
    partition about, ROWS unless said. An empty table gives an empty result.
    """
    spark = df.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // (rows or ROWS)))
    by = [F.col(f"`{key}`"), *[F.col(f"`{c}`") for c in order]]
    written = materialize(df.repartitionByRange(parts, *by).sortWithinPartitions(*by).withColumn("__qs_place", F.monotonically_increasing_id()), "ordered")
    written = written.withColumn("__qs_part", F.shiftright("__qs_place", 33))
    names, carried = df.columns, [c for c in df.columns if c != key]
    row_of = namedtuple("row_of", carried, rename=True)  # noqa: PYI024
    kind = df.schema[key].dataType
    function = T.StructType([T.StructField("part", T.LongType()), T.StructField("first", kind), T.StructField("last", kind), T.StructField("head", T.StringType()), T.StructField("tail", T.StringType())])

    def rows_of(table) -> tuple[list, list]:
        table = table.sort_by("__qs_place")
        return table[key].to_pylist(), list(map(row_of._make, zip(*(table[c].to_pylist() for c in carried))))

    def summarise(table):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        keys, all_rows = rows_of(table)
        cut = next((i for i, k in enumerate(keys) if k != keys[0]), len(keys))
        tail = None
        if cut < len(keys):  # the last key begins here, so its state is known
            start, state = next(i for i in range(len(keys) - 1, -1, -1) if i == 0 or keys[i - 1] != keys[-1]), machine.initial
            for row in all_rows[start:]:
                state = machine.step(state, row)[0]
            tail = json.dumps(state)
        out = [[table["__qs_part"][0].as_py()], [keys[0]], [keys[-1]], [json.dumps(machine.summary(all_rows[:cut]))], [tail]]
        return pa.table([pa.array(c, type=f.type) for c, f in zip(out, to_arrow_schema(function))], schema=to_arrow_schema(function))

    started = T.StructType([T.StructField("__qs_part", T.LongType()), T.StructField("__qs_state", T.StringType())])

    def scan(batches: Iterator) -> Iterator:
        import pyarrow as pa

        state, of, out = None, None, []
        for part, first, last, head, tail in sorted((r for b in batches for r in zip(*(c.to_pylist() for c in b.columns))), key=lambda r: r[0]):
            state = state if out and of == first else machine.initial
            out.append((part, json.dumps(state)))
            state, of = tuple(json.loads(tail)) if tail is not None else machine.after(json.loads(head), tuple(state)), last
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names=started.names)

    dealt = written.repartition(parts, "__qs_part")  # as many tasks as partitions, however many there are
    functions = dealt.groupBy("__qs_part").applyInArrow(summarise, function)
    states = functions.repartition(1).mapInArrow(scan, started)  # a row for each partition, shuffled: coalesced, one task would make them all
    shown = T.StructType([*df.schema.fields, *T._parse_datatype_string(result).fields])

    def apply(table):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        table = table.sort_by("__qs_place")
        keys, all_rows = rows_of(table)
        state, made = tuple(json.loads(table["__qs_state"][0].as_py())), []
        for i, row in enumerate(all_rows):
            if i and keys[i] != keys[i - 1]:
                state = machine.initial
            state, out = machine.step(state, row)
            made.append(out)
        schema = to_arrow_schema(shown)
        return pa.table([*[table[c].combine_chunks() for c in names], *[pa.array(c, type=f.type) for c, f in zip(zip(*made), list(schema)[len(names) :])]], schema=schema)

    return dealt.join(F.broadcast(states), "__qs_part").groupBy("__qs_part").applyInArrow(apply, shown)
