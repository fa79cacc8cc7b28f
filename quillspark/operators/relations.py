"""Joins, windows and paging over the catalogue's tables."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.session import materialize


def with_parent(df: DataFrame, parents: DataFrame, key: str, parent_key: str, name: str, columns: Sequence[str]) -> DataFrame:
    """``df`` with its parent's columns as a struct, null without one."""
    side = parents.select(F.col(parent_key).alias("__qs_k"), F.struct(*columns).alias(name))
    return df.join(side, F.col(key) == F.col("__qs_k"), "left").drop("__qs_k")


def with_children(df: DataFrame, children: DataFrame, key: str, child_key: str, name: str, columns: Sequence[str]) -> DataFrame:
    """``df`` with its children as a sorted array of structs, empty without any."""
    side = children.groupBy(F.col(child_key).alias("__qs_k")).agg(F.sort_array(F.collect_list(F.struct(*columns))).alias(name))
    joined = df.join(side, F.col(key) == F.col("__qs_k"), "left").drop("__qs_k")
    return joined.withColumn(name, F.coalesce(name, F.array().cast(joined.schema[name].dataType)))


def child_counts(df: DataFrame, children: DataFrame, key: str, child_key: str, name: str = "n", condition: Column | None = None) -> DataFrame:
    """``df`` with the number of its children (that meet a condition), 0 included; children are counted before they are joined."""
    met = F.count(F.when(condition, 1)) if condition is not None else F.count("*")
    side = children.groupBy(F.col(child_key).alias("__qs_k")).agg(met.alias("__qs_n"))
    return df.join(side, F.col(key) == F.col("__qs_k"), "left").withColumn(name, F.coalesce("__qs_n", F.lit(0))).drop("__qs_k", "__qs_n")


def having(df: DataFrame, children: DataFrame, key: str, child_key: str) -> DataFrame:
    return df.join(children.select(F.col(child_key).alias(key)), key, "left_semi")


def lacking(df: DataFrame, children: DataFrame, key: str, child_key: str) -> DataFrame:
    return df.join(children.select(F.col(child_key).alias(key)), key, "left_anti")


def latest_per(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key by ``order``, which should break all ties."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__qs_rank", rank).where("__qs_rank = 1").drop("__qs_rank")


def neighbours(df: DataFrame, order: Sequence[Column], value: str, keys: Sequence[str] = ()) -> DataFrame:
    """``df`` with the ``value`` of the row ``previous`` and ``next``, in the order of ``order`` and within ``keys``.

    No task sees all rows, nor all of a key: rows are range-partitioned by (keys, order), sorted and written once with their place;
    a window of its own finds neighbours within each partition, and the first and last rows of partitions, two for each, are
    exchanged. ``order`` should break all ties. Carry keys and short values; join long texts by them afterwards.
    """
    spark = df.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    by = [*[F.col(f"`{k}`") for k in keys], *order]
    carried = F.struct(*[F.col(f"`{k}`").alias(f"k{i}") for i, k in enumerate(keys)], F.col(f"`{value}`").alias("v")).alias("__qs_at")
    rows = df.select("*", carried).repartitionByRange(parts, *by).sortWithinPartitions(*by).withColumn("__qs_place", F.monotonically_increasing_id())
    rows = materialize(rows, "ordered").withColumn("__qs_part", F.shiftright("__qs_place", 33))
    edges = rows.groupBy("__qs_part").agg(F.min_by("__qs_at", "__qs_place").alias("first"), F.max_by("__qs_at", "__qs_place").alias("last"))
    over = Window.orderBy("__qs_part")  # a row for each partition
    edges = edges.select("__qs_part", F.lag("last").over(over).alias("__qs_before"), F.lead("first").over(over).alias("__qs_after"))
    w = Window.partitionBy("__qs_part").orderBy("__qs_place")
    found = rows.withColumns({"__qs_lag": F.lag("__qs_at").over(w), "__qs_lead": F.lead("__qs_at").over(w)}).join(F.broadcast(edges), "__qs_part")

    def of(inside: str, beyond: str) -> Column:
        at = F.coalesce(F.col(inside), F.col(beyond))
        same = F.lit(True)
        for i in range(len(keys)):
            same = same & at[f"k{i}"].eqNullSafe(F.col("__qs_at")[f"k{i}"])
        return F.when(same, at["v"])

    return found.withColumns({"previous": of("__qs_lag", "__qs_before"), "next": of("__qs_lead", "__qs_after")}).select(*[F.col(f"`{c}`") for c in df.columns], "previous", "next")


def next_order(df: DataFrame, parent: str, order: str = "order") -> DataFrame:
    """For each parent, the place of its next child: 0 for the first."""
    return df.groupBy(parent).agg((F.coalesce(F.max(order), F.lit(-1)) + 1).alias("next_order"))


def streaks(df: DataFrame, keys: Sequence[str], order: Sequence[Column], failed: Column) -> DataFrame:
    """``df`` with the number of failures in a row up to each row; a success starts anew. A null in ``failed`` counts as a success.

    No task sees all of a key: rows are range-partitioned by (keys, order) and written once; within a partition a streak is the
    distance from the last success or the key's first row. What a partition adds to the streak that it begins with composes: none
    of it is left after a success or another key, else its rows are added. These sums, over a row a partition, give each
    partition's first key what it begins with. ``order`` should break all ties.
    """
    spark = df.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    by = [*[F.col(f"`{k}`") for k in keys], *order]
    key = F.struct(*[F.col(f"`{k}`").alias(f"k{i}") for i, k in enumerate(keys)])
    placed = df.withColumns({"__qs_key": key, "__qs_failed": F.coalesce(failed, F.lit(False))})
    rows = materialize(placed.repartitionByRange(parts, *by).sortWithinPartitions(*by).withColumn("__qs_place", F.monotonically_increasing_id()), "ordered")
    rows = rows.withColumn("__qs_part", F.shiftright("__qs_place", 33))
    w = Window.partitionBy("__qs_part", "__qs_key").orderBy("__qs_place")
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    inside = rows.withColumns({"__qs_ended": F.max(F.when(~F.col("__qs_failed"), F.col("__qs_place"))).over(so_far), "__qs_begun": F.first("__qs_place").over(so_far)})
    inside = inside.withColumn("streak", F.col("__qs_place") - F.coalesce("__qs_ended", F.col("__qs_begun") - 1))
    at = lambda c, f: f(F.col(c), F.col("__qs_place"))
    edges = inside.groupBy("__qs_part").agg(at("__qs_key", F.min_by).alias("first"), at("__qs_key", F.max_by).alias("last"), at("streak", F.max_by).alias("adds"), F.max_by(F.col("__qs_ended").isNull(), "__qs_place").alias("open"))
    over = Window.orderBy("__qs_part")  # a row for each partition
    edges = edges.withColumn("goes_on", F.col("first").eqNullSafe(F.lag("last").over(over)) & F.lag("__qs_part").over(over).isNotNull())
    through = F.col("goes_on") & F.col("open") & F.col("first").eqNullSafe(F.col("last"))
    edges = edges.withColumn("run", F.sum(F.when(through, 0).otherwise(1)).over(over.rowsBetween(Window.unboundedPreceding, 0)))
    edges = edges.withColumn("left", F.sum("adds").over(Window.partitionBy("run").orderBy("__qs_part").rowsBetween(Window.unboundedPreceding, 0)))
    edges = edges.select("__qs_part", F.col("first").alias("__qs_first"), F.when(F.col("goes_on"), F.lag("left").over(over)).otherwise(0).alias("__qs_carried"))
    found = inside.join(F.broadcast(edges), "__qs_part")
    begun = F.when(F.col("__qs_ended").isNull() & F.col("__qs_key").eqNullSafe(F.col("__qs_first")), F.col("__qs_carried")).otherwise(0)
    return found.withColumn("streak", F.col("streak") + begun).select(*[F.col(f"`{c}`") for c in df.columns], "streak")


def claimable(jobs: DataFrame, per_queue: int) -> DataFrame:
    """The next jobs of each queue: by priority, then time, then id."""
    w = Window.partitionBy("queue").orderBy(F.col("priority").desc(), "run_at", "id")
    return jobs.where("status = 'pending'").withColumn("claim", F.row_number().over(w).cast("long")).where(F.col("claim") <= per_queue)


def page(df: DataFrame, order: Sequence[Column], number: int = 1, limit: int = 20, most: int = 50) -> DataFrame:
    """One page of the ordered rows; numbers and limits out of bounds are brought in."""
    number, limit = max(1, number), min(most, max(1, limit))
    return df.orderBy(*order).offset((number - 1) * limit).limit(limit)


def page_envelope(total: int, number: int, limit: int) -> dict:
    return {"total": total, "page": number, "limit": limit, "total_pages": math.ceil(total / limit)}


def expand_references(df: DataFrame, key: str, references: str) -> DataFrame:
    """(key, place, reference) of a list column, in its order."""
    return df.select(key, F.posexplode(references).alias("place", "reference"))
