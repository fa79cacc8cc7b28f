"""Operator 2, token-ID output: binary shards in training order.

Documents are tokenized and cut into sequences of fixed length. A keyed Feistel
permutation with cycle walking assigns each sequence a global slot; a range
partition of slots is a shard, written as one file of records of one length. So
record r of shard s is slot s * rows + r and starts at byte r * stride: readers
go through files in order, and resume anywhere by arithmetic.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import numpy as np
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.llm._common import configure, field, materialize, release, table, table_path, text_or_empty
from quillspark.llm.feistel import permute
from quillspark.llm.token_counts import default_path, encode_whole, encoding

@dataclass(frozen=True)
class Layout:
    """Where everything lies; all that a reader needs."""

    path: str
    sequences: int
    length: int
    rows: int
    key: int
    #: Ends each document and fills up its last sequence: the first id that the vocabulary leaves free.
    end: int
    #: Bytes of a token: unsigned, little-endian.
    token_bytes: int
    #: Changes with any token of any document.
    digest: str

    @property
    def stride(self) -> int:
        """Bytes of a record: the tokens and a newline."""
        return self.length * self.token_bytes + 1

    @property
    def shards(self) -> int:
        return -(-self.sequences // self.rows)

    def find(self, slot: int) -> tuple[int, int]:
        """The shard of a slot, and the byte at which it starts in there."""
        return slot // self.rows, slot % self.rows * self.stride


def vocabulary(path: str) -> tuple[int, int]:
    """The first free id of a tokenizer, and the bytes that ids up to it need."""
    end = len(encoding(path)[1])
    return end, 2 if end < 1 << 16 else 4


def tokenize(docs: DataFrame, length: int, path: str, id_column: str, text_column: str) -> DataFrame:
    """(id, ids, n_seq, part, start): tokens of each document with the end id, in the order of (id, text), numbered within partitions."""
    configure(docs.sparkSession)
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    source = docs.select(F.col(f"`{id_column}`").alias("__qs_id"), text_or_empty(text_column).alias("__qs_text"))
    order = [F.col("__qs_id").asc_nulls_first(), F.xxhash64("__qs_text")]
    dealt = source.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    schema = T.StructType([source.schema["__qs_id"], field("ids", T.BinaryType()), field("n_seq", T.LongType()), field("part", T.IntegerType()), field("start", T.LongType())])

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        part, start = TaskContext.get().partitionId(), 0
        tokenizer, _ = encoding(path)
        end, size = vocabulary(path)
        kind = f"<u{size}"
        for batch in batches:
            ids, counts, starts = [], [], []
            for text in batch.column(1):
                found = np.append(np.asarray(encode_whole(tokenizer, text.as_py()), dtype=kind), np.array([end], dtype=kind))
                ids.append(found.tobytes())
                counts.append(-(-len(found) // length))
                starts.append(start)
                start += counts[-1]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, type=pa.binary()), pa.array(counts, type=pa.int64()), pa.array([part] * len(ids), type=pa.int32()), pa.array(starts, type=pa.int64())], names=schema.names)

    return dealt.mapInArrow(run, schema)


def place_sequences(docs: DataFrame, length: int = 256, rows: int = 1 << 15, key: int = 20241, path: str | None = None, id_column: str = "doc_id", text_column: str = "text") -> tuple[DataFrame, int, str]:
    """(id, seq, n_tokens, payload, slot, shard) for every sequence, how many there are, and a digest of all tokens.

    Sequences are numbered in the order of (id, XXH64 of the text, place in the document), whatever files and partitions the input
    comes in; slot = permutation of the number. A document's tokens are followed by the end id, which also fills up the last
    sequence; n_tokens counts without the filling. So a null or empty text is one sequence with the end id alone. Texts of any length are encoded whole. Repeated rows are repeated
    sequences; null ids come first.
    """
    path = path or default_path()
    end, size = vocabulary(path)
    tokens = materialize(tokenize(docs, length, path, id_column, text_column), "tokens")
    release(docs.sparkSession)
    sizes = tokens.groupBy("part").agg(F.sum("n_seq").alias("n"))
    total, digest = tokens.agg(F.coalesce(F.sum("n_seq"), F.lit(0)), F.sum(F.xxhash64("__qs_id", "ids").cast("decimal(38,0)")).cast("string")).first()
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = F.broadcast(sizes.select("part", F.coalesce(before, F.lit(0)).alias("before")))  # a row for each partition
    width = length * size
    each = tokens.join(offsets, "part").select("__qs_id", "ids", (F.col("before") + F.col("start")).alias("first"), F.posexplode(F.expr("sequence(1L, n_seq)")).alias("seq", "_"))
    cut = each.select("__qs_id", "seq", (F.col("first") + F.col("seq")).alias("number"), F.expr(f"substring(ids, seq * {width} + 1, {width})").alias("payload"))
    filling = end.to_bytes(size, "little")
    placed = permute(cut, "number", "slot", max(total, 1), key)
    return placed.select(
        F.col("__qs_id").alias(id_column),
        "seq",
        F.expr(f"cast(octet_length(payload) div {size} as int)").alias("n_tokens"),
        F.rpad("payload", width, F.lit(filling)).alias("payload"),
        "slot",
        F.expr(f"cast(slot div {rows} as int)").alias("shard"),
    ), total, digest or "0"


#: Ranges of shards that are written one after another, so that a part of the sequences is shuffled at a time and an interrupted job resumes at a range.
WAVES = 4


def _noted(spark: SparkSession, path: str) -> str | None:
    """What a small file of notes says, or None if it isn't there."""
    try:
        return spark.read.text(path, wholetext=True).first()[0].strip()
    except AnalysisException:
        return None


def _note(spark: SparkSession, path: str, text: str) -> None:
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def write_shards(placed: DataFrame, layout: Layout, waves: int = WAVES) -> None:
    """One file for each shard, in the folder shard=<number>, records in the order of slots.

    A wave replaces its shards at once when all of them are written, and is then noted, so a job that was interrupted goes on with
    the wave that it was at, and the same call on finished shards changes nothing. A path that holds anything else, other
    documents or another layout among it, is a ValueError.
    """
    spark = placed.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    if not layout.shards:
        return
    mine = json.dumps(asdict(layout) | {"path": None, "waves": waves}, sort_keys=True)
    found = _noted(spark, f"{layout.path}/_layout")
    if found is None:
        try:
            spark.read.format("binaryFile").load(f"{layout.path}/*")
        except AnalysisException:
            _note(spark, f"{layout.path}/_layout", mine)
        else:
            raise ValueError(f"{layout.path} holds other files")
    elif found != mine:
        raise ValueError(f"{layout.path} holds other shards")
    step = max(1, -(-layout.shards // waves))
    for low in range(0, layout.shards, step):
        if _noted(spark, f"{layout.path}/_done/{low}") is not None:
            continue
        some = placed.where((F.col("shard") >= low) & (F.col("shard") < low + step)).select("shard", "slot", F.col("payload").cast("string").alias("value"))
        dealt = some.repartitionByRange(min(parts, step), "shard").sortWithinPartitions("shard", "slot").select("shard", "value")
        dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("shard").option("compression", "none").text(layout.path, lineSep="\n")
        _note(spark, f"{layout.path}/_done/{low}", "done")
        del some, dealt
        release(spark)


def materialize_training_order(docs: DataFrame, path: str | None = None, length: int = 256, rows: int = 1 << 15, key: int = 20241, tokenizer: str | None = None, id_column: str = "doc_id", text_column: str = "text") -> tuple[DataFrame, Layout]:
    """Writes the shards under ``path`` (in the shared folder if not given); the manifest, a row for each sequence, and the layout.

    Manifest: id, seq, n_tokens, slot, shard, offset (byte in the shard's file), crc32 (of the record without its newline). An
    empty table writes no shard. Only id and text are read.
    """
    spark = docs.sparkSession
    path = path or table_path(spark, "shards")
    placed, total, digest = place_sequences(docs, length, rows, key, tokenizer, id_column, text_column)
    layout = Layout(path, total, length, rows, key, *vocabulary(tokenizer or default_path()), digest)
    write_shards(placed, layout)
    manifest = placed.select(id_column, "seq", "n_tokens", "slot", "shard", (F.col("slot") % rows * layout.stride).alias("offset"), F.crc32("payload").alias("crc32"))
    return manifest, layout


def read_sequences(spark: SparkSession, layout: Layout, first: int = 0) -> DataFrame:
    """(slot, tokens) from slot ``first`` on, out of the shards that hold them; earlier shards are not opened."""
    schema = T.StructType([field("slot", T.LongType()), field("tokens", T.ArrayType(T.IntegerType()))])
    if first >= layout.sequences:
        return spark.createDataFrame([], schema)
    shards = [f"{layout.path}/shard={s}" for s in range(first // layout.rows, layout.shards)]
    files = spark.read.format("binaryFile").option("basePath", layout.path).load(shards).select("shard", "content")
    length, rows, stride, kind = layout.length, layout.rows, layout.stride, f"<u{layout.token_bytes}"

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for shard, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                data = np.frombuffer(content.as_buffer(), dtype=np.uint8).reshape(-1, stride)[:, :-1]
                for at in range(0, len(data), 1024):
                    tokens = np.ascontiguousarray(data[at : at + 1024]).view(kind).astype(np.int32)
                    slots = shard * rows + at + np.arange(len(tokens))
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(tokens) + 1, dtype=np.int32) * length), pa.array(tokens.ravel()))
                    yield pa.RecordBatch.from_arrays([pa.array(slots.astype(np.int64)), lists], names=["slot", "tokens"])

    return files.mapInArrow(run, schema).where(F.col("slot") >= first)


def op2_token_shards(spark, sf_dir):
    return materialize_training_order(table(spark, sf_dir, "documents"))[0]
