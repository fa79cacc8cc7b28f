"""Files as tables: objects, JSON artefacts, documents with front matter, key layout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed value: bytes of the largest object that is read.
MOST_BYTES = 100 * 1024 * 1024

FILE = T.StructType([T.StructField("path", T.StringType()), T.StructField("modificationTime", T.TimestampType()), T.StructField("length", T.LongType()), T.StructField("content", T.BinaryType())])


def objects(spark: SparkSession, path: str, pattern: str | None = None, most: int = MOST_BYTES) -> DataFrame:
    """Objects below a path, on any store Spark reads: path, modificationTime, length, content. Larger ones than ``most`` are listed
    without content; the filter on length reaches the scan, which then doesn't open them."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    files = reader.load(path)
    small = files.where(F.col("length") <= most)
    large = files.where(F.col("length") > most).select("path", "modificationTime", "length", F.lit(None).cast("binary").alias("content"))
    return small.unionByName(large)


def object_exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p))


def delete_object(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True))


def orphans(files: DataFrame, known: DataFrame, key: str, before: Column) -> DataFrame:
    """Files (path, modificationTime) older than ``before`` whose path no row of ``known`` names in ``key``."""
    return files.where(F.col("modificationTime") < before).join(known.select(F.col(key).alias("path")), "path", "left_anti").select("path", "modificationTime")


def storage_key(kind: str, document: Column, name: Column) -> Column:
    """Where an artefact of a document lies: kind/document/name."""
    return F.concat_ws("/", F.lit(kind), document.cast("string"), name)


def read_json(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """JSON artefacts with a given schema, one object a file; what doesn't parse gives nulls."""
    return spark.read.schema(schema).option("multiLine", "true").json(path)


def to_artefact(df: DataFrame, keys: list[str], columns: list[str], name: str = "artefact") -> DataFrame:
    return df.select(*keys, F.to_json(F.struct(*columns)).alias(name))


def from_artefact(df: DataFrame, column: str, schema: str) -> DataFrame:
    """``df`` with a JSON column's fields in place of it."""
    rest = [c for c in df.columns if c != column]
    return df.select(*rest, F.from_json(column, schema).alias("__qs_j")).select(*rest, "__qs_j.*")


def front_matter(text: str) -> tuple[Column, Column]:
    """SQL columns (map of the values before the second ---, text after it) of a text column; without front matter an empty map and the whole text."""
    head = F.regexp_extract(text, r"\A---\n((?s:.*?))\n---(?:\n|\z)", 1)
    values = F.expr(
        f"map_from_entries(filter(transform(split(regexp_extract({text}, '\\\\A---\\n((?s:.*?))\\n---(?:\\n|\\\\z)', 1), '\\n'), l -> struct(trim(substring_index(l, ':', 1)) as k, trim(substring(l, locate(':', l) + 1)) as v)), e -> e.k <> ''))"
    )
    body = F.when(head == "", F.col(text)).otherwise(F.regexp_replace(text, r"\A---\n(?s:.*?)\n---(?:\n|\z)", ""))
    return values, body


def read_content(spark: SparkSession, path: str) -> DataFrame:
    """Markdown files with front matter: path, values, body."""
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True).select(F.col("_metadata.file_path").alias("path"), "value")
    values, body = front_matter("value")
    return files.select("path", values.alias("values"), body.alias("body"))
