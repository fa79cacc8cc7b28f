"""What the operators of this subpackage share: shared storage, Arrow maps, column hygiene."""

from __future__ import annotations

import gc
import time
from collections.abc import Callable, Iterator, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.session import discard, materialize, read_table, shared_root, table_path

#: Rows of an Arrow batch: long texts must not make a Python worker hold thousands of them at once.
BATCH_ROWS = "1000"


def configure(spark: SparkSession) -> None:
    """Small Arrow batches, so that a Python worker's memory follows a few texts and not ten thousand."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)


def release(spark: SparkSession) -> None:
    """Lets Spark drop the shuffle files of plans that are finished, instead of at some later collection of garbage."""
    for _ in range(2):  # what finalizers let go in the first round is collected in the second
        gc.collect()
        spark._jvm.System.gc()
        time.sleep(0.2)


def trim_memory() -> None:
    """Gives freed memory of a Python worker back to the system: workers are kept for later stages, which need it."""
    import ctypes
    import ctypes.util

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    libc = ctypes.util.find_library("c")
    if libc and hasattr(lib := ctypes.CDLL(libc), "malloc_trim"):
        lib.malloc_trim(0)


def text_or_empty(column: str) -> Column:
    return F.coalesce(F.col(f"`{column}`").cast("string"), F.lit(""))


def without(df: DataFrame, names: Sequence[str]) -> list[str]:
    """The columns of ``df`` apart from ``names``: an operator's result columns replace others of the same name, whatever their case."""
    drop = {n.lower() for n in names}
    return [c for c in df.columns if c.lower() not in drop]


def quoted(names: Sequence[str]) -> list[Column]:
    return [F.col(f"`{c}`") for c in names]


def add_columns(df: DataFrame, column: str, fields: Sequence[T.StructField], fn: Callable, keep: Sequence[str] | None = None) -> DataFrame:
    """``df`` with columns that ``fn`` computes from an Arrow array of the texts in ``column``, nulls read as empty.

    ``fn`` gets one batch and returns one list or Arrow array for each field. ``keep``: the columns of ``df`` to carry (all by default).
    """
    configure(df.sparkSession)
    names = [f.name for f in fields]
    kept = [c for c in (df.columns if keep is None else keep) if c.lower() not in {n.lower() for n in names}]
    source = df.select(*quoted(kept), text_or_empty(column).alias("__qs_text"))
    schema = T.StructType([source.schema[c] for c in kept] + list(fields))
    count = len(kept)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        out_schema = to_arrow_schema(schema)
        for batch in batches:
            made = fn(batch.column(count))
            arrays = [batch.column(i) for i in range(count)]
            for value, field in zip(made, list(out_schema)[count:], strict=True):
                arrays.append(value if isinstance(value, pa.Array) else pa.array(value, type=field.type))
            yield pa.RecordBatch.from_arrays(arrays, names=out_schema.names)
        trim_memory()

    return source.mapInArrow(run, schema)


def field(name: str, kind: T.DataType) -> T.StructField:
    return T.StructField(name, kind, True)


table = read_table

__all__ = ["add_columns", "configure", "discard", "field", "materialize", "quoted", "release", "shared_root", "table", "table_path", "text_or_empty", "trim_memory", "without"]
