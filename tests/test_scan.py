"""Scans by composed transitions against plain loops: any cuts, hot keys, ties, null keys, empty tables."""

import random
from collections import namedtuple

import pytest
from pyspark.sql import functions as F

from quillspark.operators import relations
from quillspark.streaming import scan, stateful

Row = namedtuple("Row", "us failed command lease")
MACHINES = {
    "rate": (scan.rate_limit(3, 50), stateful.RATE_RESULT),
    "lockout": (scan.lockout(2, 40), stateful.LOCKOUT_RESULT),
    "lockout1": (scan.lockout(1, 15), stateful.LOCKOUT_RESULT),
    "breaker": (scan.breaker(3, 30), stateful.BREAKER_RESULT),
    "jobs": (scan.jobs(3), stateful.JOB_RESULT),
    "jobs1": (scan.jobs(1), stateful.JOB_RESULT),
}


def history(rng, n):
    us, out = 0, []
    for i in range(n):
        us += rng.choice([0, 0, 1, 3, 9, 40])
        out.append(Row(us, rng.random() < 0.55, rng.choice(["claim", "claim", "complete", "fail", "fail", "recover", "requeue"]), max(0, i - rng.randint(0, 4)) // 2))
    return out


@pytest.mark.parametrize("name", MACHINES)
def test_functions_of_stretches(name):
    """A stretch's function, applied to the state before it, is the state after it; through JSON, for any cuts."""
    import json

    machine, _ = MACHINES[name]
    rng = random.Random(name)
    for _ in range(150):
        rows = history(rng, rng.randint(1, 60))
        looped, made, at = machine.initial, machine.initial, 0
        while at < len(rows):
            upto = min(len(rows), at + rng.randint(1, 15))
            for r in rows[at:upto]:
                looped = machine.step(looped, r)[0]
            made = machine.after(json.loads(json.dumps(machine.summary(rows[at:upto]))), made)
            assert machine.waits(made) == machine.waits(looped)
            if machine.waits(made):
                assert made == looped
            else:
                assert machine.place(made) == machine.place(looped) and (name[:4] != "jobs" or made == looped)
            at = upto


def events(spark, n, hot):
    rng = random.Random(7)
    rows = [(i, None if i % 97 == 0 else 1 if rng.random() < hot else rng.randint(2, 30), *r) for i, r in enumerate(history(rng, n))]
    return rows, spark.createDataFrame(rows, "id long, who long, us long, failed boolean, command string, lease long").repartition(3)


@pytest.mark.parametrize("name", MACHINES)
def test_a_hot_key(spark, name):
    """One key with 90 % of the rows: over all partitions, and as the loop has it."""
    machine, result = MACHINES[name]
    rows, df = events(spark, 3000, 0.9)
    got = scan.replay(df, "who", machine, result, ["us", "id"], rows=400)
    want, states = {}, {}
    for i, who, *rest in sorted(rows, key=lambda r: (r[2], r[0])):
        states[who], want[i] = machine.step(states.get(who, machine.initial), Row(*rest))
    names = [part.split()[0] for part in result.split(",")]
    assert got.columns == [*df.columns, *names]
    found = got.withColumn("task", F.spark_partition_id()).collect()
    assert {r.id: tuple(r[n] for n in names) for r in found} == {i: tuple(w) for i, w in want.items()}
    plain = stateful.replay(df.where("who is not null"), "who", machine.step, machine.initial, result, ["us", "id"]).collect()
    assert all(tuple(r[n] for n in names) == tuple(want[r.id]) for r in plain)


def test_hot_rows_are_dealt_out(spark):
    """No partition of the written order holds much more than its share."""
    _, df = events(spark, 8000, 0.95)
    sizes = []
    keep = scan.materialize
    scan.materialize = lambda d, name: (out := keep(d, name), sizes.extend(r.n for r in out.groupBy(F.shiftright("__qs_place", 33)).agg(F.count("*").alias("n")).collect()))[0]
    try:
        scan.replay(df, "who", MACHINES["breaker"][0], stateful.BREAKER_RESULT, ["us", "id"], rows=1000)
    finally:
        scan.materialize = keep
    assert len(sizes) >= 7 and max(sizes) < 2500


def test_nothing(spark):
    _, df = events(spark, 10, 0.5)
    assert scan.replay(df.limit(0), "who", MACHINES["rate"][0], stateful.RATE_RESULT, ["us", "id"]).count() == 0


@pytest.mark.parametrize("failing", [0.5, 0.999, 1.0])
def test_streaks(spark, failing):
    """Streaks that run through whole partitions, of a key that has most rows; null keys and null outcomes."""
    rng = random.Random(5)
    rows = [(i, None if i % 53 == 0 else 1 if rng.random() < 0.9 else rng.randint(2, 9), None if i % 211 == 5 else rng.random() < failing) for i in range(4000)]
    df = spark.createDataFrame(rows, "id long, who long, bad boolean").repartition(3)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    try:
        got = {r.id: r.streak for r in relations.streaks(df, ["who"], [F.col("id")], F.col("bad")).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    want, held = {}, {}
    for i, who, bad in rows:
        held[who] = want[i] = held.get(who, 0) + 1 if bad else 0
    assert got == want


def test_no_task_reads_all_rows(spark, tmp_path):
    """The functions of partitions are made side by side: only they, not the rows, meet in one task."""
    from pyspark import TaskContext

    class Watched(scan.Jobs):
        def summary(self, rows):
            (tmp_path / str(TaskContext.get().partitionId())).touch()
            return super().summary(rows)

    _, df = events(spark, 2000, 0.5)
    assert scan.replay(df, "who", Watched(3), stateful.JOB_RESULT, ["us", "id"], rows=100).count() == 2000
    assert len(list(tmp_path.iterdir())) > 4
