"""Live state on streams: timers without a new row, restarts from a checkpoint, bounded stores entry by entry."""

import random
from collections import namedtuple

from pyspark.sql import functions as F

from quillspark.streaming import live, stateful

SCHEMA = "id long, who long, us long, failed boolean, command string, lease long, client long"
Row = namedtuple("Row", "id who us failed command lease client")
SECOND = 1_000_000


def feed(spark, folder, rows):
    spark.createDataFrame(rows, SCHEMA).withColumn("ts", F.timestamp_micros("us")).coalesce(1).write.mode("append").parquet(folder)


def run(spark, tmp_path, build, batches, name):
    """Each batch is fed to a query of its own, which goes on from the checkpoint of the one before."""
    live.use_rocksdb(spark)
    folder, out = f"{tmp_path}/{name}-in", []
    for rows in batches:
        feed(spark, folder, rows)
        kind = spark.read.parquet(folder).schema
        stream = build(spark.readStream.schema(kind).parquet(folder))
        query = stream.writeStream.outputMode("append").option("checkpointLocation", f"{tmp_path}/{name}-check").trigger(availableNow=True).foreachBatch(lambda df, _: out.extend(df.collect())).start()
        query.awaitTermination()
        assert query.exception() is None
    return out


def test_a_lease_expires_without_a_new_row(spark, tmp_path):
    c = lambda i, who, s, command, lease: Row(i, who, (1000 + s) * SECOND, False, command, lease, 0)
    batches = [
        [c(1, 7, 0, "claim", 11), c(2, 8, 1, "claim", 12)],
        [c(3, 8, 2, "complete", 12)],
        [c(4, 9, 100, "claim", 13)],  # another job's row moves the clock
        [c(5, 9, 200, "claim", 14)],  # the lease of 13 is over by now: claimed anew
    ]
    out = run(spark, tmp_path, lambda df: live.leases(df, "who", "ts", "0 seconds", 3, 30 * SECOND, ["us", "id"]), batches, "leases")
    expired = {(r.who, r.us, r.status, r.attempts) for r in out if r.event == "expired"}
    assert expired >= {(7, 1030 * SECOND, "pending", 1), (9, 1130 * SECOND, "pending", 1)} and not any(who == 8 for who, *_ in expired)
    shown = {r.id: (r.accepted, r.status, r.attempts) for r in out if r.id is not None}
    assert shown == {1: (True, "reserved", 1), 2: (True, "reserved", 1), 3: (True, "done", 1), 4: (True, "reserved", 1), 5: (True, "reserved", 2)}


def test_locks_open_again(spark, tmp_path):
    rng = random.Random(3)
    rows, us = [], 0
    for i in range(120):
        us += rng.randint(1, 20) * SECOND
        rows.append(Row(i, rng.randint(1, 4), us, rng.random() < 0.6, "", 0, 0))
    last = Row(999, 99, us + 10_000 * SECOND, False, "", 0, 0)
    batches = [rows[:50], rows[50:90], rows[90:], [last], [last._replace(id=1000, us=last.us + SECOND)]]
    out = run(spark, tmp_path, lambda df: live.lockouts(df, "who", "ts", "0 seconds", 2, 60 * SECOND, ["us", "id"]), batches, "locks")
    step, states, want = stateful.lockout(2, 60 * SECOND), {}, {}
    locks = set()
    for r in rows:
        states[r.who], want[r.id] = step(states.get(r.who, (0, 0)), r)
        if states[r.who][1]:
            locks.add((r.who, states[r.who][1]))
    assert {r.id: (r.locked, r.failures) for r in out if r.id is not None and r.id < 999} == want
    opened = [(r.who, r.us) for r in out if r.event == "opened"]
    assert len(opened) == len(set(opened)) and set(opened) == locks and len(locks) > 5


def test_bounded_stores(spark, tmp_path):
    rng = random.Random(5)
    rows = [Row(i, 0, i * SECOND, False, "", 0, rng.randint(1, 40)) for i in range(400)]
    out = run(spark, tmp_path, lambda df: live.bounded_stores(df, 2, 30 * SECOND, 5, 3, ["us", "id"]), [rows[:150], rows[150:300], rows[300:]], "stores")
    of = {r.c: r.s for r in spark.range(1, 41).select(F.col("id").alias("c"), live.shard(F.col("id"), 3).alias("s")).collect()}
    step, stores, want = stateful.bounded_store(2, 30 * SECOND, 5), {}, {}
    for r in rows:
        stores[of[r.client]], want[r.id] = step(stores.get(of[r.client], (None,)), r)
    assert {r.id: (r.allowed, r.held, r.evicted) for r in out} == want
    assert len({of[c] for c in of}) == 3 and sum(w[2] is not None for w in want.values()) > 50


def test_time_to_live(spark, tmp_path):
    """A client whose entry nobody touched comes back to a fresh one. By the clock a query never ends of itself, so it is stopped."""
    import time

    live.use_rocksdb(spark)
    folder, out = f"{tmp_path}/in", []
    feed(spark, folder, [Row(1, 0, 0, False, "", 0, 5), Row(2, 0, 1, False, "", 0, 5)])
    stream = live.bounded_stores(spark.readStream.schema(spark.read.parquet(folder).schema).parquet(folder), 1, 10**15, 5, 1, ["us", "id"], ttl_ms=1500)
    query = stream.writeStream.outputMode("append").option("checkpointLocation", f"{tmp_path}/check").trigger(processingTime="1 second").foreachBatch(lambda df, _: out.extend(df.collect())).start()
    until = time.time() + 60
    while len(out) < 2 and time.time() < until:
        time.sleep(0.5)
    time.sleep(3)
    feed(spark, folder, [Row(3, 0, 2, False, "", 0, 5)])
    while len(out) < 3 and time.time() < until:
        time.sleep(0.5)
    query.stop()
    assert [(r.id, r.allowed) for r in sorted(out)] == [(1, True), (2, False), (3, True)]
