"""Streams into tables: upserts by batch, dead letters on the side."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def upsert_batches(path: str, keys: list[str], latest: str) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that keeps the latest row of each key in a Parquet table of generations: batch n is written
    beside batch n - 1, so a batch that runs again writes the same generation again."""
    from quillspark.operators.relations import latest_per

    def run(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        rows = batch
        if n > 0:
            rows = spark.read.schema(batch.schema).parquet(f"{path}/generation={n - 1}").unionByName(batch)
        latest_per(rows, keys, [F.col(latest).desc()]).write.mode("overwrite").parquet(f"{path}/generation={n}")

    return run


def split_dead(path: str, dead) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that writes rows that meet ``dead`` to dead letters and others to the live table."""

    def run(batch: DataFrame, n: int) -> None:
        batch.where(dead).write.mode("overwrite").parquet(f"{path}/dead/batch={n}")
        batch.where(~F.coalesce(dead, F.lit(False))).write.mode("overwrite").parquet(f"{path}/live/batch={n}")

    return run


def settled(df: DataFrame, key: str, order: str, terminal: str = "status in ('COMPLETED', 'FAILED')") -> DataFrame:
    """Keys whose last two readings are both terminal: progress needs no more watching."""
    from pyspark.sql import Window

    w = Window.partitionBy(key).orderBy(F.col(order).desc())
    last = df.withColumn("__qs_r", F.row_number().over(w)).where("__qs_r <= 2")
    return last.groupBy(key).agg((F.count("*") == 2).alias("two"), F.bool_and(F.expr(terminal)).alias("t")).select(key, (F.col("two") & F.col("t")).alias("settled"))
