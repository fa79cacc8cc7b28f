"""Roll-ups of the catalogue: counts, histograms, pivots, health."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.session import materialize

#: How the states of a queue are shown.
BUCKETS = (("pending", "waiting"), ("reserved", "active"), ("done", "completed"), ("dead", "failed"), ("delayed", "delayed"))


def total(column: str) -> Column:
    return F.coalesce(F.sum(column), F.lit(0))


def mean(column: str | Column) -> Column:
    return F.coalesce(F.avg(column), F.lit(0.0))


def daily_histogram(df: DataFrame, ts: str, end: Column, days: int) -> DataFrame:
    """(day, n): a row for each of the days + 1 days up to ``end``, also those without rows. The days come from a sequence, so the
    only rows that move are one for each day and task."""
    first, last = F.date_sub(F.to_date(end), days), F.to_date(end)
    counted = df.where((F.to_date(ts) >= first) & (F.to_date(ts) <= last)).groupBy(F.to_date(ts).alias("day")).agg(F.count("*").alias("c"))
    all_days = df.sparkSession.range(1).select(F.explode(F.sequence(first, last)).alias("day"))
    return all_days.join(counted, "day", "left").select("day", F.coalesce("c", F.lit(0)).alias("n"))


def recent_activity(df: DataFrame, action: str, ts: str, newest: int = 20, before: int | None = 100) -> DataFrame:
    """(action, day, n): the newest days by action. ``before``: only so many of the newest (action, time) groups are counted; None: all."""
    groups = df.groupBy(F.col(action).alias("action"), F.col(ts).alias("t")).agg(F.count("*").alias("c"))
    if before is not None:
        groups = groups.orderBy(F.col("t").desc(), "action").limit(before)
    days = groups.groupBy("action", F.to_date("t").alias("day")).agg(F.sum("c").alias("n"))
    return days.orderBy(F.col("day").desc(), "action").limit(newest)


def queue_buckets(jobs: DataFrame) -> DataFrame:
    """A row for each queue, a column for each bucket; the states are given, so one pass is enough."""
    return jobs.groupBy("queue").agg(*[F.count(F.when(F.col("status") == status, 1)).alias(bucket) for status, bucket in BUCKETS])


def delivery_stats(deliveries: DataFrame, most: int = 3) -> DataFrame:
    """Total, delivered and given up, in one pass."""
    return deliveries.agg(F.count("*").alias("total"), F.count("delivered_at").alias("delivered"), F.count(F.when(F.col("delivered_at").isNull() & (F.col("attempts") >= most), 1)).alias("failed"))


def mean_seconds(df: DataFrame, start: str, end: str) -> Column:
    """Mean seconds between two times, none below 0, rounded half up; 0 without rows."""
    seconds = (F.unix_micros(F.col(end).cast("timestamp")) - F.unix_micros(F.col(start).cast("timestamp"))) / 1e6
    return F.floor(F.coalesce(F.avg(F.greatest(seconds, F.lit(0.0))), F.lit(0.0)) + 0.5).cast("long")


def provider_health(calls: DataFrame, provider: str, ok: Column, latency_ms: Column) -> DataFrame:
    """Calls, success rate and mean latency, rounded half up, by provider."""
    return calls.groupBy(F.col(provider).alias("provider")).agg(
        F.count("*").alias("calls"), F.avg(ok.cast("double")).alias("success_rate"), F.floor(F.avg(latency_ms) + 0.5).cast("long").alias("mean_latency_ms")
    )


def budget_left(pages: DataFrame, provider: str, ts: str, used: str, budget: float) -> DataFrame:
    """What is left of a daily budget by provider and day, never below 0."""
    return pages.groupBy(F.col(provider).alias("provider"), F.to_date(ts).alias("day")).agg(F.greatest(F.lit(budget) - F.sum(used), F.lit(0.0)).alias("budget_left"))


def text_of_pages(pages: DataFrame, key: str, number: str, text: str, separator: str = "\n\n") -> DataFrame:
    """The texts of each key's pages in order, empty ones left out, joined."""
    some = pages.where(F.coalesce(F.col(text), F.lit("")) != "")
    return some.groupBy(key).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(number, text))), lambda p: p[text]), separator).alias("text"))


def trailing_count(df: DataFrame, ts: str, seconds: int, keys: tuple = ()) -> DataFrame:
    """``df`` with the number of rows within the last ``seconds``, its own included, at each row's time."""
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    w = Window.partitionBy(*keys).orderBy(micros).rangeBetween(-seconds * 1_000_000, 0)
    return df.withColumn("trailing", F.count("*").over(w))


def distinct_slices(df: DataFrame, ts: str, member: str, seconds: int, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, slice, bucket, members): the distinct ``member``s (whole numbers) of each slice of time, as bitmaps of 32,768 numbers.

    ``slice`` counts ``seconds`` from 1970. A task makes its own bitmaps and bitmaps are merged, so what is shuffled and stored grows
    with the members and slices, not with the rows, and any later window comes from the slices alone. Rows of null time or member
    count for nothing.
    """
    usable = df.where(F.col(f"`{ts}`").isNotNull() & F.col(f"`{member}`").isNotNull())
    at = F.floor(F.unix_micros(F.col(f"`{ts}`").cast("timestamp")) / (seconds * 1_000_000)).alias("slice")
    of = F.col(f"`{member}`").cast("long")
    placed = usable.select(*[F.col(f"`{k}`") for k in keys], at, F.bitmap_bucket_number(of).alias("bucket"), F.bitmap_bit_position(of).alias("bit"))
    return placed.groupBy(*keys, "slice", "bucket").agg(F.bitmap_construct_agg("bit").alias("members"))


def sliding_distinct(slices: DataFrame, width: int, keys: Sequence[str] = (), name: str = "members") -> DataFrame:
    """(keys, slice, ``name``): exact distinct members of each window of ``width`` slices that begins with ``slice`` and has any, from
    :func:`distinct_slices`. Windows of other widths, and sums over other keys' slices, come from the same table."""
    each = slices.select(*keys, F.explode(F.sequence(F.col("slice") - (width - 1), F.col("slice"))).alias("slice"), "bucket", F.col("members").alias("__qs_m"))
    merged = each.groupBy(*keys, "slice", "bucket").agg(F.bitmap_or_agg("__qs_m").alias("__qs_m"))
    return merged.groupBy(*keys, "slice").agg(F.sum(F.bitmap_count("__qs_m")).alias(name))


def trailing_counts(df: DataFrame, at: str, width: int, name: str) -> DataFrame:
    """``df`` with how many of its rows have an ``at`` (long) of this row's less ``width`` or more, up to this row's; of a null one,
    how many are null.

    A row adds one at its place and takes it away again behind ``width``, so the count is a running sum of such changes: it costs
    the same whatever a window holds. Changes of one place are one row; those rows are range-partitioned and written once, and the
    sums of partitions, a row for each, give every partition what it begins with.
    """
    parts = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    each = df.groupBy(F.col(f"`{at}`").alias("__qs_at")).agg(F.count("*").alias("__qs_n"))
    changes = each.union(each.select(F.col("__qs_at") + width + 1, -F.col("__qs_n"))).where("__qs_at is not null").groupBy("__qs_at").agg(F.sum("__qs_n").alias("__qs_n"))
    placed = changes.repartitionByRange(parts, "__qs_at").sortWithinPartitions("__qs_at").withColumn("__qs_part", F.spark_partition_id())
    rows = materialize(placed, "changes")
    before = F.sum("__qs_n").over(Window.orderBy("__qs_part").rowsBetween(Window.unboundedPreceding, -1))  # a row for each partition
    begun = rows.groupBy("__qs_part").agg(F.sum("__qs_n").alias("__qs_n")).select("__qs_part", F.coalesce(before, F.lit(0)).alias("__qs_begun"))
    inside = F.sum("__qs_n").over(Window.partitionBy("__qs_part").orderBy("__qs_at").rowsBetween(Window.unboundedPreceding, 0))
    sums = rows.withColumn("__qs_n", inside).join(F.broadcast(begun), "__qs_part").select("__qs_at", (F.col("__qs_n") + F.col("__qs_begun")).alias(name))
    known = sums.union(each.where("__qs_at is null"))
    return df.join(known, F.col(f"`{at}`").eqNullSafe(F.col("__qs_at"))).drop("__qs_at")
