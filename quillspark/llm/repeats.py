"""Windows that repeat anywhere in a corpus: where they lie in each document, and the documents without them.

Shared by the suffix-array operator (windows of bytes) and the substring
operator (windows of words), which differ in the symbols and in how a shard is
decided. The steps:

1. Anchors (see ``_anchors``) of every text; hashes counted with map-side sums.
   Text can only repeat around anchors that occur twice.
2. For one document of each distinct text, the contexts of its repeated
   anchors: the symbols of all windows that have the anchor. Equal contexts of
   an anchor are merged before they travel, so a passage in a third of all
   documents is one string.
3. Shards of whole anchor groups, decided by the operator's index. A group of very many distinct contexts, such as those at the
   edge of a passage that a third of all documents hold, fits no task. It is narrowed: its windows are dealt into bands of
   neighbouring starts, and contexts meet again by all that the windows of a band have in common. That is nearly a whole window,
   so text that differs parts and text that doesn't merges; what is still large is narrowed further, down to single windows,
   where a group is one string. The same index decides at every level.
4. What was decided about a context goes back to all the places where it stands.

Texts never meet in one task; a shard is read in blocks of complete groups, and a group is bounded.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.llm import _anchors
from quillspark.llm._common import configure, discard, field, materialize, release, text_or_empty, trim_memory, without

#: Contexts decided at once; complete groups only, so a block exceeds it where one group does.
BLOCK = 1 << 14


#: Distinct contexts of a group that one task indexes: a small part of a block, so that no group decides how long a task takes. Larger groups are narrowed.
HOT = BLOCK >> 4
#: Bands into which the starts of a hot group's windows are dealt; each context goes into as many.
BANDS = 4
#: Hot groups that are broadcast at most, 8 bytes each; there is one for every HOT contexts at most. Beyond, the same join is shuffled.
BROADCAST_ROWS = 1 << 20


@dataclass(frozen=True)
class Unit:
    """What windows consist of: ``words`` or bytes; ``length`` symbols of a window, ``k`` of an anchor."""

    words: bool
    length: int
    k: int

    @property
    def w(self) -> int:
        return self.length - self.k + 1

    def symbols(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbols of texts side by side, as numbers, and the bounds of texts among them."""
        if not self.words:
            return data, bounds
        starts, ends, firsts = _anchors.words(data, bounds)
        return _anchors.word_hashes(data, starts, ends), firsts

    def context(self, raw: bytes) -> Callable[[int], tuple[int, bytes]]:
        """For a text, the context of the anchor at a position: symbols before the anchor, and the bytes."""
        k, reach = self.k, self.w - 1
        if not self.words:
            return lambda p: (min(p, reach), raw[max(0, p - reach) : p + k + reach])
        words = raw.split()
        return lambda p: (min(p, reach), b" ".join(words[max(0, p - reach) : p + k + reach]))


def _signature(left: int, context: bytes) -> bytes:
    return hashlib.md5(left.to_bytes(4, "little") + context, usedforsecurity=False).digest()


def _anchor_table(keyed: DataFrame, unit: Unit) -> DataFrame:
    """keyed (key, did, text) -> key, did, n (symbols), ps and hs (positions and hashes of anchors)."""
    schema = T.StructType([field("key", T.BinaryType()), field("did", T.LongType()), field("n", T.LongType()), field("ps", T.ArrayType(T.IntegerType())), field("hs", T.ArrayType(T.LongType()))])

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            data, bounds = _anchors.text_buffers(batch.column(2))
            symbols, bounds = unit.symbols(data, bounds)
            at, hashes = _anchors.anchors(symbols, bounds, unit.k, unit.w)
            first = np.searchsorted(at, bounds).astype(np.int32)
            at = at - np.repeat(bounds[:-1], np.diff(first))
            offsets = pa.array(first, type=pa.int32())
            ps = pa.ListArray.from_arrays(offsets, pa.array(at.astype(np.int32)))
            hs = pa.ListArray.from_arrays(offsets, pa.array(hashes.view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.diff(bounds).astype(np.int64)), ps, hs], names=schema.names)
        trim_memory()

    return keyed.mapInArrow(run, schema)


def _instances(carriers: DataFrame, unit: Unit, ship: bool) -> DataFrame:
    """A row for each repeated anchor of ``carriers`` (key, copies, ps of (p, h), packed): with its context (``ship``) or with its signature and place."""
    if ship:
        schema = T.StructType([field("h", T.LongType()), field("lft", T.IntegerType()), field("context", T.BinaryType()), field("place", T.LongType()), field("copies", T.LongType())])
    else:
        schema = T.StructType([field("h", T.LongType()), field("sig", T.BinaryType()), field("key", T.BinaryType()), field("p", T.IntegerType())])

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def batch_of(columns):
            return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, types)], names=schema.names)

        unpack = _unpack()
        types = [pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.int64()] if ship else [pa.int64(), pa.binary(), pa.binary(), pa.int32()]
        columns = [[] for _ in schema.names]
        size = 0
        for batch in batches:
            for key, copies, ps, text in zip(batch.column(0), batch.column(1), batch.column(2), batch.column(3)):
                key, copies, raw = key.as_py(), copies.as_py(), unpack(text.as_buffer())
                context, low, seen = unit.context(raw), int.from_bytes(key[:8], "little"), {}
                for anchor in ps.as_py():
                    p, h = anchor["p"], anchor["h"]
                    left, bytes_ = context(p)
                    if ship:
                        # a text that repeats itself, such as a run of one letter, sends each context at its first place and at one more
                        times = seen[h, left, bytes_] = seen.get((h, left, bytes_), 0) + 1
                        if times > 2:
                            continue
                        row = (h, left, bytes_, (low + p * _anchors.BASE) & 0x7FFFFFFFFFFFFFFF, copies)
                    else:
                        row = (h, _signature(left, bytes_), key, p)
                    for column, value in zip(columns, row):
                        column.append(value)
                    size += len(bytes_) if ship else 48
                    if size > 4 << 20:
                        yield batch_of(columns)
                        columns, size = [[] for _ in schema.names], 0
        yield batch_of(columns)
        trim_memory()

    return carriers.select("key", "copies", "ps", "packed").mapInArrow(run, schema)


def _decided(contexts: DataFrame, decide: Callable) -> DataFrame:
    """contexts (h, lft, context, weight), sorted by h within partitions -> h, sig, spans of those that hold a repeated window."""
    schema = T.StructType([field("h", T.LongType()), field("sig", T.BinaryType()), field("spans", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def block(hs, lefts, contexts, weights):
            groups = np.cumsum(np.concatenate([[0], hs[1:] != hs[:-1]])).astype(np.int64)
            spans = decide(groups, lefts, contexts, weights)
            held = [i for i, s in enumerate(spans) if s]
            columns = [hs[held].tolist(), [_signature(int(lefts[i]), contexts[i]) for i in held], [spans[i] for i in held]]
            return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, [pa.int64(), pa.binary(), pa.list_(pa.int32())])], names=schema.names)

        hs, lefts, contexts, weights = np.zeros(0, np.int64), np.zeros(0, np.int64), [], np.zeros(0, np.int64)
        for batch in batches:
            hs = np.concatenate([hs, batch.column(0).to_numpy(zero_copy_only=False)])
            lefts = np.concatenate([lefts, batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)])
            contexts += batch.column(2).to_pylist()
            weights = np.concatenate([weights, batch.column(3).to_numpy(zero_copy_only=False).astype(np.int64)])
            while len(hs) >= BLOCK:
                cut = int(np.searchsorted(hs, hs[BLOCK - 1]))  # the first of the group at the edge
                if not cut:
                    cut = int(np.searchsorted(hs, hs[0], side="right"))
                    if cut == len(hs):
                        break  # one group, which may go on
                yield block(hs[:cut], lefts[:cut], contexts[:cut], weights[:cut])
                hs, lefts, contexts, weights = hs[cut:], lefts[cut:], contexts[cut:], weights[cut:]
        if len(hs):
            yield block(hs, lefts, contexts, weights)
        trim_memory()

    return contexts.mapInArrow(run, schema)


def _bands(contexts: DataFrame, unit: Unit, k: int, band: int, ship: bool) -> DataFrame:
    """The parts of contexts (h, lft, context, weight; anchors of ``k`` symbols) that the windows of each band of starts cover.

    Windows of a band start at ``band`` neighbouring places relative to the anchor, so they have length - band + 1 symbols in
    common: the core, which takes the anchor's role. ``ship``: (h, lft, context, weight) with the core's group as h, equal parts
    of a task's contexts merged; else (part_h, part_sig, h, shift, sigs), to take what was decided about a part back to the
    contexts that hold it: the core starts ``shift`` symbols after the anchor.
    """
    reach, length = unit.length - k, unit.length
    if ship:
        schema = T.StructType([field("h", T.LongType()), field("lft", T.IntegerType()), field("context", T.BinaryType()), field("weight", T.IntegerType())])
    else:
        schema = T.StructType([field("part_h", T.LongType()), field("part_sig", T.BinaryType()), field("h", T.LongType()), field("shift", T.IntegerType()), field("sigs", T.ArrayType(T.BinaryType()))])

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        types = [f.type for f in to_arrow_schema(schema)]
        held: dict[tuple, Any] = {}
        size = 0

        def batch_of():
            rows = [(*key, value) for key, value in held.items()]
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], type=t) for i, t in enumerate(types)], names=schema.names)

        for batch in batches:
            for h, left, context, weight in zip(*[batch.column(i).to_pylist() for i in range(4)]):
                symbols, first = context.split(b" ") if unit.words else context, reach - left
                join = b" ".join if unit.words else bytes
                sig = None if ship else _signature(left, context)
                last = first + len(symbols) - length  # columns at which windows start: first..last
                for number in range(first // band, last // band + 1):
                    low = number * band
                    a, b, core = max(low, first) - first, min(low + band - 1, last) - first, low + band - 1 - first
                    part, part_left = join(symbols[a : b + length]), core - a
                    name = h.to_bytes(8, "little", signed=True) + number.to_bytes(4, "little") + join(symbols[core : low + length - first])
                    part_h = int.from_bytes(hashlib.blake2b(name, digest_size=8).digest(), "little", signed=True)
                    if ship:
                        key = part_h, part_left, part
                        held[key] = 2 if key in held else weight
                        size += len(part)
                    else:
                        held.setdefault((part_h, _signature(part_left, part), h, low + band - 1 - reach), []).append(sig)
                        size += 64
                if size > 16 << 20:
                    yield batch_of()
                    held.clear()
                    size = 0
        if held:
            yield batch_of()
        trim_memory()

    return contexts.mapInArrow(run, schema)


def _verdicts(contexts: DataFrame, unit: Unit, k: int, decide: Callable) -> DataFrame:
    """(h, sig, spans), a row for each of the contexts (h, lft, context, weight; anchors of ``k`` symbols) that holds repeated windows. Groups of more than HOT contexts are narrowed to bands and decided there, by the same function."""
    spark = contexts.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    hot = materialize(contexts.groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") > HOT).select("h"), "hot")
    rows = hot.count()
    side = F.broadcast(hot) if rows <= BROADCAST_ROWS else hot
    cold = contexts.join(side, "h", "left_anti") if rows else contexts
    dealt = cold.select("h", "lft", "context", "weight").repartition(parts, "h").sortWithinPartitions("h")
    out = materialize(_decided(dealt, lambda *columns: decide(*columns, k)), "verdicts")
    if not rows:
        return out
    band = max(1, (unit.length - k + 1) // BANDS)
    large = materialize(contexts.join(side, "h").select("h", "lft", "context", "weight"), "large")
    merged = _bands(large, unit, k, band, ship=True).groupBy("h", "lft", "context").agg(F.count("*").alias("n"), F.max("weight").alias("weight"))
    narrow = materialize(merged.select("h", "lft", "context", F.when(F.expr("n > 1 or weight > 1"), 2).otherwise(1).alias("weight")), "narrow")
    found = _verdicts(narrow, unit, unit.length - band + 1, decide)
    found = found.select(F.col("h").alias("part_h"), F.col("sig").alias("part_sig"), "spans")
    back = _bands(large, unit, k, band, ship=False).join(found.hint("shuffle_hash"), ["part_h", "part_sig"])
    each = back.select("h", F.explode("sigs").alias("sig"), F.expr("transform(spans, x -> x + shift)").alias("s"))
    shifted = each.groupBy("h", "sig").agg(F.collect_list("s").alias("spans"))  # of a context's few bands
    taken = materialize(shifted.select("h", "sig", _joined("spans").alias("spans")), "taken_back")
    for done in (hot, narrow, large):
        discard(done)
    return out.unionByName(taken)


def _packed(df: DataFrame, column: str) -> DataFrame:
    """``df`` with the texts in ``column`` as zstd frames: what shuffles carry of them is a third less than Spark's own codec leaves."""
    kept = [c for c in df.columns if c != column]
    schema = T.StructType([df.schema[c] for c in kept] + [field("packed", T.BinaryType())])
    source = df.select(*[F.col(f"`{c}`") for c in kept], F.col(column))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import zstandard
        from pyspark.sql.pandas.types import to_arrow_schema

        out_schema = to_arrow_schema(schema)
        pack = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            frames = pa.array([pack(t.as_buffer()) for t in batch.column(len(kept))], type=pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], frames], names=out_schema.names)

    return source.mapInArrow(run, schema)


def _unpack():
    import zstandard

    return zstandard.ZstdDecompressor().decompress


def _keyed(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    text = text_or_empty(text_column)
    return docs.select(F.unhex(F.md5(F.encode(text, "UTF-8"))).alias("key"), F.xxhash64(F.col(f"`{id_column}`")).alias("did"), text.alias("text"))


def repeated(docs: DataFrame, unit: Unit, decide: Callable, id_column: str, text_column: str) -> DataFrame:
    """(key, spans): for each distinct text, by its MD5, that holds repeated windows, arrays [a, b, a, b, ...] of symbols that these
    cover, in no order and overlapping. A text that several rows hold has contexts of two places or more throughout."""
    spark = docs.sparkSession
    configure(spark)
    keyed = _keyed(docs, id_column, text_column)
    found = materialize(_anchor_table(keyed, unit).withColumn("rid", F.monotonically_increasing_id()), "anchors")
    every = found.select("rid", F.explode(F.arrays_zip("ps", "hs")).alias("a")).select("rid", F.col("a.ps").alias("p"), F.col("a.hs").alias("h"))
    twice = every.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h")
    twice = materialize(twice, "twice")  # written, so that both sides of the next join are plain shuffles, which Spark can split where a hash is hot
    texts = found.groupBy("key").agg(F.min("rid").alias("rid"), F.count("*").alias("copies"))
    places = every.join(twice.hint("shuffle_hash"), "h", "left_semi").groupBy("rid").agg(F.collect_list(F.struct("p", "h")).alias("ps"))
    chosen = places.join(texts.select("rid", "copies"), "rid").join(found.select("rid", "key", "did"), "rid").select("key", "did", "copies", "ps")
    carriers = materialize(_packed(keyed, "text").join(chosen.hint("shuffle_hash"), ["key", "did"]).select("key", "copies", "ps", "packed"), "carriers", "none")
    discard(found)
    discard(twice)
    del every, twice, places, chosen, texts
    release(spark)
    merged = _instances(carriers, unit, ship=True).groupBy("h", "lft", "context").agg(F.min("place").alias("a"), F.max("place").alias("b"), F.max("copies").alias("copies"))
    weighed = merged.select("h", "lft", "context", F.when(F.expr("a <> b or copies > 1"), 2).otherwise(1).alias("weight"))
    weighed = materialize(weighed, "contexts")
    release(spark)
    verdicts = _verdicts(weighed, unit, unit.k, decide)
    discard(weighed)
    del merged, weighed
    release(spark)
    placed = _instances(carriers, unit, ship=False).join(verdicts.hint("shuffle_hash"), ["h", "sig"])
    return placed.select("key", F.expr("transform(spans, x -> x + p)").alias("s")).groupBy("key").agg(F.collect_list("s").alias("spans"))


def merge_spans(spans: list[list[int]] | None) -> list[tuple[int, int]]:
    """Maximal runs of what the spans cover, ascending."""
    flat = sorted({(s[i], s[i + 1]) for s in spans or () for i in range(0, len(s), 2)})
    out: list[tuple[int, int]] = []
    for a, b in flat:
        if out and a <= out[-1][1]:
            if b > out[-1][1]:
                out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def _joined(spans: pd.Series) -> pd.Series:
    """Lists of spans as one list of their maximal runs."""
    return spans.map(lambda s: [x for run in merge_spans(list(s)) for x in run])


#: The columns of a result.
RESULT = ("n_symbols", "n_removed", "n_spans", "kept")


def strip(docs: DataFrame, unit: Unit, decide: Callable, id_column: str, text_column: str, keep: list[str] | None = None, names: tuple[str, str, str, str] = RESULT) -> DataFrame:
    """The columns of ``docs`` (or those in ``keep``) with symbols, removed symbols, removed spans and what stays (binary), under ``names``."""
    carried = without(docs.select(*[F.col(f"`{c}`") for c in keep]) if keep is not None else docs, names)
    found = repeated(docs, unit, decide, id_column, text_column).select(F.col("key").alias("__qs_key"), F.col("spans").alias("__qs_spans"))
    found = materialize(found, "spans")  # written, so that the next join has two plain shuffles, which Spark can split where one text has very many copies
    text = text_or_empty(text_column)
    source = docs.select(*[F.col(f"`{c}`") for c in carried], text.alias("__qs_text"), F.unhex(F.md5(F.encode(text, "UTF-8"))).alias("__qs_key"))
    joined = _packed(source, "__qs_text").join(found.hint("shuffle_hash"), "__qs_key", "left").select(*[F.col(f"`{c}`") for c in carried], "packed", "__qs_spans")
    count = len(carried)
    schema = T.StructType([source.schema[c] for c in carried] + [field(n, kind) for n, kind in zip(names, (T.LongType(), T.LongType(), T.LongType(), T.BinaryType()))])

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        out_schema = to_arrow_schema(schema)
        unpack = _unpack()
        for batch in batches:
            made = [[], [], [], []]
            for text, spans in zip(batch.column(count), batch.column(count + 1)):
                raw = unpack(text.as_buffer())
                symbols = raw.split() if unit.words else raw
                n = len(symbols)
                cut = merge_spans(spans.as_py())
                if cut:
                    left, at = [], 0
                    for a, b in [*cut, (n, n)]:
                        left.append(symbols[at:a])
                        at = b
                    rest = b" ".join([w for part in left for w in part]) if unit.words else b"".join(left)
                else:
                    rest = b" ".join(symbols) if unit.words else raw
                for column, value in zip(made, (n, sum(b - a for a, b in cut), len(cut), rest)):
                    column.append(value)
            arrays = [batch.column(i) for i in range(count)] + [pa.array(v, type=f.type) for v, f in zip(made, list(out_schema)[count:])]
            yield pa.RecordBatch.from_arrays(arrays, names=out_schema.names)

    return joined.mapInArrow(run, schema)
