"""Global row numbers 0..n-1 in a total order, without a task that sees all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.session import materialize


def number_rows(df: DataFrame, order: Sequence[Column | str], name: str = "row_number") -> tuple[DataFrame, int]:
    """``df``, sorted by ``order``, with its row number in column ``name``, and the number of rows.

    Rows are range-partitioned, sorted within partitions and written once to the
    shared folder with a number inside their partition; the sizes of the
    partitions, a row for each of them, then give every partition its offset.
    Since the numbered table is written, a lost executor cannot renumber rows.
    Rows that tie in ``order`` get neighbouring numbers in no set order, so
    ``order`` should name all columns that matter.
    """
    spark = df.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    table = materialize(dealt.withColumn("__qs_gid", F.monotonically_increasing_id()), "numbered")
    return offset_rows(table, name)


def offset_rows(table: DataFrame, name: str = "row_number") -> tuple[DataFrame, int]:
    """Row numbers for a written table whose ``__qs_gid`` came from monotonically_increasing_id()."""
    part = F.shiftright("__qs_gid", 33)
    sizes = table.groupBy(part.alias("__qs_part")).agg(F.count("*").alias("__qs_n"))
    before = F.sum("__qs_n").over(Window.orderBy("__qs_part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select("__qs_part", F.coalesce(before, F.lit(0)).alias("__qs_before"))
    numbered = (
        table.withColumn("__qs_part", part)
        .join(F.broadcast(offsets), "__qs_part")  # as many rows as the table has partitions
        .withColumn(name, F.col("__qs_before") + F.col("__qs_gid").bitwiseAND(F.lit((1 << 33) - 1)))
        .drop("__qs_part", "__qs_before", "__qs_gid")
    )
    return numbered, table.count()


def number_within(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], name: str) -> DataFrame:
    """``df`` with the place of each row, from 0, among those of its ``keys`` in ``order``: global numbers less the least of the key,
    so that no task sees all rows of a key. Null keys are keys like others."""
    numbered, _ = number_rows(df, [*[F.col(f"`{k}`") for k in keys], *order], "__qs_number")
    first = numbered.groupBy(*[F.col(f"`{k}`").alias(f"__qs_k{i}") for i, k in enumerate(keys)]).agg(F.min("__qs_number").alias("__qs_first"))
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(f"`{k}`").eqNullSafe(F.col(f"__qs_k{i}"))
    return numbered.join(first, same).withColumn(name, F.col("__qs_number") - F.col("__qs_first")).select(*[F.col(f"`{c}`") for c in df.columns], name)
