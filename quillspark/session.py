"""Reading tables so that all cores have work, and tables of intermediate results in shared storage."""

from __future__ import annotations

import itertools
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Tables of long texts: what is done to a row costs far more than moving it.
TEXTS = ("documents", "pages", "conversations")


#: A Parquet file gives a task for each row group at most, and writers make row groups of this size or more.
ROW_GROUP = 128 << 20


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A Parquet table of a folder. A table of texts whose files hold row groups for less than half the cores is dealt out to all
    cores: a small file is one row group, and so one busy task however many ways it is split. Tables of any size to speak of are
    read as they lie. Python gets texts in small batches."""
    path = f"{folder}/{name}.parquet"
    df = spark.read.parquet(path)
    if name in TEXTS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", TEXT_BATCH_ROWS)
        files = spark.read.format("binaryFile").load(path)  # the lengths of files; contents that nobody asks for are not read
        groups = files.agg(F.sum(F.ceil(F.col("length") / ROW_GROUP))).first()[0] or 0
        cores = spark.sparkContext.defaultParallelism
        if 2 * groups < cores:
            return df.repartition(cores)
    return df


#: Rows of a batch that a Python worker gets of a table of texts: whole texts, and what is made of them, must not be held by the ten thousand.
TEXT_BATCH_ROWS = "250"

_counter = itertools.count()
_roots: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """A folder of this application in shared storage: where spark.checkpoint.dir or setCheckpointDir say. Without either, a local
    session gets a temporary folder, and a cluster an error: no folder of one machine would do there."""
    context = spark.sparkContext
    app = context.applicationId
    if app not in _roots:
        base = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
        if not base:
            if not context.master.startswith("local[") and context.master != "local":
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            base = f"file://{tempfile.mkdtemp(prefix='quillspark-')}"
        root = f"{base.rstrip('/')}/quillspark-{uuid.uuid4().hex}"
        path = spark._jvm.org.apache.hadoop.fs.Path(root)
        path.getFileSystem(context._jsc.hadoopConfiguration()).deleteOnExit(path)
        _roots[app] = root
    return _roots[app]


def table_path(spark: SparkSession, name: str) -> str:
    return f"{shared_root(spark)}/{next(_counter):05d}-{name}"


def materialize(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """Writes ``df`` as Parquet to the shared folder and reads it back: the lineage ends there and survives lost executors."""
    spark = df.sparkSession
    path = table_path(spark, name)
    df.write.option("compression", compression).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._quillspark_path = path
    return out


def discard(df: DataFrame) -> None:
    """Deletes a table of :func:`materialize` that nothing reads any more."""
    path = getattr(df, "_quillspark_path", None)
    if path:
        spark = df.sparkSession
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
