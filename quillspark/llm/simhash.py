"""Operator 9, SimHash near-duplicates: a byte-position inverted index with count filtering.

A 64-bit fingerprint is eight positional bytes. Two fingerprints that differ in
at most four bits differ in at most four bytes, so they share at least four:
that is the guaranteed minimum. Posting lists of single bytes would hold 1/256
of the corpus each, and N fingerprints would meet in N * N / 64 pairs, so the
index lists fingerprints under triples of positional bytes: 20 triples, chosen
so that any four of the eight positions contain one of them. Within a list the
shared positional bytes of a pair are tallied, pairs below the minimum are
dropped, and the rest is verified bit by bit. Members of a list share three
bytes and a pair needs four, so a long list is split without loss into lists by
a fourth byte, at each of the other five positions.

Only distinct fingerprints are indexed, so exact copies cost nothing. A list
yields links that connect what is connected, not all its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.llm._common import add_columns, discard, field, materialize, release, table, text_or_empty
from quillspark.llm.components import components

SHINGLE = 4
SEED = 42
MOST_BITS = 4
#: Positional bytes that linked fingerprints share at least.
LEAST_SHARED = 8 - MOST_BITS
#: Lists up to this size compare all their pairs at once; longer ones go by pivots.
SMALL = 32
#: Lists beyond this size are split by a fourth byte.
LONG = 1 << 14
#: Long lists that are broadcast at most, 8 bytes each; beyond, the same join is shuffled.
BROADCAST_ROWS = 1 << 20
_PARTS = ((0, 1, 2), (3, 4, 5), (6, 7))


def triples() -> list[tuple[int, int, int]]:
    """20 triples of the positions 0..7 such that any four positions contain one: all within a part, or two in a part and one in the next."""
    out = [c for part in _PARTS for c in combinations(part, 3)]
    for i, part in enumerate(_PARTS):
        out += [(*pair, one) for pair in combinations(part, 2) for one in _PARTS[(i + 1) % 3]]
    return out


def fingerprint(text: str) -> int:
    """The unsigned 64-bit SimHash of a text; zero if it has no words."""
    import xxhash

    words = text.encode("utf-8").lower().split()  # on bytes, lower() changes A-Z alone and split() parts at \\x20 and \\x09-\\x0D
    if not words:
        return 0
    if len(words) <= SHINGLE:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[: len(words) - SHINGLE + 1].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends[SHINGLE - 1 :].tolist())], dtype="<u8")
    set_bits = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), 1 << 15):
        part = np.unpackbits(hashes[i : i + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        set_bits += part.sum(axis=0, dtype=np.int32)
    majority = np.packbits(2 * set_bits > len(hashes), bitorder="little")
    return int(majority.view("<u8")[0])


def with_fingerprints(docs: DataFrame, text_column: str = "text", keep: list[str] | None = None, name: str = "fp") -> DataFrame:
    """``docs`` with the fingerprint of each text as a (signed) long. A null or empty text has fingerprint 0."""

    def run(texts):
        return [np.array([fingerprint(t.as_py()) for t in texts], dtype=np.uint64).view(np.int64).tolist()]

    return add_columns(docs, text_column, [field(name, T.LongType())], run, keep)


def _linked(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which pairs are linked: tally the shared positional bytes, retain those that reach the minimum, verify the bits."""
    differ = np.ascontiguousarray(x ^ y)
    tally = (differ.view(np.uint8).reshape(-1, 8) == 0).sum(axis=1, dtype=np.int8)
    out = tally >= LEAST_SHARED
    out[out] = np.bitwise_count(differ[out]) <= MOST_BITS
    return out


def link_list(x: np.ndarray) -> list[tuple[int, int]]:
    """Links that connect exactly the members of one long posting list that chains of linked pairs connect.

    Pivots: each takes the members linked to it. Two groups with pivots p and q can only be linked if p and q differ in at most
    3 * MOST_BITS bits, and only by members within 2 * MOST_BITS bits of the other's pivot; groups already connected are passed.
    """
    links, pivots, groups = [], [], []
    rest = x
    while len(rest):
        p = rest[0]
        near = _linked(rest, np.full(len(rest), p))
        near[0] = True
        group = rest[near]
        pivots.append(p)
        groups.append(group)
        links += [(int(p), int(m)) for m in group[1:]]
        rest = rest[~near]
    if len(pivots) == 1:
        return links
    at = np.array(pivots, dtype=np.uint64)
    parent = list(range(len(pivots)))

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i in range(len(pivots) - 1):
        far = np.bitwise_count(at[i + 1 :] ^ at[i])
        for j in (np.flatnonzero(far <= 3 * MOST_BITS) + i + 1).tolist():
            if find(i) == find(j):
                continue
            a = groups[i][np.bitwise_count(groups[i] ^ at[j]) <= 2 * MOST_BITS]
            b = groups[j][np.bitwise_count(groups[j] ^ at[i]) <= 2 * MOST_BITS]
            if len(a) > len(b):
                a, b = b, a
            for one in a:
                met = np.flatnonzero(np.bitwise_count(b ^ one) <= MOST_BITS)
                if len(met):
                    links.append((int(one), int(b[met[0]])))
                    parent[find(i)] = find(j)
                    break
    return links


def link_sorted(keys: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links among fingerprints ``x`` whose posting lists are the runs of equal ``keys``."""
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    sizes = np.diff(np.append(starts, len(keys)))
    us, vs = [], []
    small = np.repeat(sizes <= SMALL, sizes)
    sk, sx = keys[small], x[small]
    for d in range(1, SMALL):
        same = sk[d:] == sk[:-d] if len(sk) > d else np.zeros(0, dtype=bool)
        if not same.any():
            break
        a, b = sx[:-d][same], sx[d:][same]
        met = _linked(a, b)
        us.append(a[met])
        vs.append(b[met])
    for i in np.flatnonzero(sizes > SMALL):
        found = link_list(x[starts[i] : starts[i] + sizes[i]])
        if found:
            pair = np.array(found, dtype=np.uint64)
            us.append(pair[:, 0])
            vs.append(pair[:, 1])
    empty = np.zeros(0, dtype=np.uint64)
    return np.concatenate([*us, empty]), np.concatenate([*vs, empty])


def candidate_links(fingerprints: DataFrame) -> DataFrame:
    """Links (u, v) among distinct fingerprints (column fp) that connect exactly what pairs within MOST_BITS bits connect."""
    spark = fingerprints.sparkSession
    part = lambda p: F.shiftright("fp", 8 * p).bitwiseAND(F.lit(255))
    keys = [F.lit(i << 24).bitwiseOR(F.shiftleft(part(a), 16)).bitwiseOR(F.shiftleft(part(b), 8)).bitwiseOR(part(c)).cast("long") for i, (a, b, c) in enumerate(triples())]
    index = fingerprints.select("fp", F.explode(F.array(*keys)).alias("k"))
    long = materialize(index.groupBy("k").agg(F.count("*").alias("n")).where(F.col("n") > LONG).select("k", F.lit(True).alias("long")), "long_lists")
    if n_long := long.count():
        side = F.broadcast(long) if n_long <= BROADCAST_ROWS else long.hint("shuffle_hash")
        others = F.element_at(F.array(*[F.array(*[F.struct(F.lit(p).alias("p"), part(p).alias("b")) for p in range(8) if p not in t]) for t in triples()]), F.shiftright("k", 24).cast("int") + 1)
        split = F.transform(others, lambda o: F.shiftleft("k", 12).bitwiseOR(F.shiftleft(o["p"] + 8, 8)).bitwiseOR(o["b"]).cast("long"))  # from bit 35 on: apart from the keys of triples
        index = index.join(side, "k", "left").select("fp", F.explode(F.when(F.col("long"), split).otherwise(F.array("k"))).alias("k"))
    lists = index.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "k").sortWithinPartitions("k")
    schema = T.StructType([field("u", T.LongType()), field("v", T.LongType())])

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def emit(keys, x):
            u, v = link_sorted(keys, x)
            return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], names=["u", "v"])

        held_k, held_x, rows = [], [], 0
        for batch in batches:
            k, x = batch.column(1).to_numpy(zero_copy_only=False), batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            held_k.append(k)
            held_x.append(x)
            rows += len(k)
            if rows >= 1 << 18:  # complete lists are done with; the last one may go on
                k, x = np.concatenate(held_k), np.concatenate(held_x)
                cut = int(np.searchsorted(k, k[-1]))
                if cut:
                    yield emit(k[:cut], x[:cut])
                held_k, held_x, rows = [k[cut:]], [x[cut:]], len(k) - cut
        if rows:
            yield emit(np.concatenate(held_k), np.concatenate(held_x))

    return lists.mapInArrow(run, schema)


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, fingerprint, component_id) for every row: 16 hex digits, and the least id reachable by links, its own included.

    Rows of equal fingerprint are always linked, texts without words (null or empty: fingerprint 0) among them. Repeated rows and
    ids each get their row. Null ids stay null and are never the least, unless a component has no other (then component_id is
    null). Other columns are not read. An empty table gives an empty result.
    """
    rows, named = _named(docs.select(F.col(f"`{id_column}`").alias("__qs_id"), F.col(f"`{text_column}`").alias("__qs_source")), ["__qs_id"], "__qs_source")
    each = rows.groupBy("fp").agg(F.min("__qs_id").alias("least")).join(named, "fp").select("fp", "root", "least")
    reach = each.groupBy("root").agg(F.min("least").alias("component_id"))
    # written, so that the next join has two plain shuffles, which Spark can split where many rows share a fingerprint
    answers = materialize(each.join(reach, "root").select("fp", "component_id"), "answers")
    discard(named)
    return rows.join(answers, "fp").select(F.col("__qs_id").alias(id_column), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _named(docs: DataFrame, columns: list[str], text_column: str) -> tuple[DataFrame, DataFrame]:
    """Fingerprints (``columns``, fp) of all rows, and (fp, root) for every distinct fingerprint: the least that links lead to."""
    rows = materialize(with_fingerprints(docs, text_column, columns), "fingerprints")
    distinct = materialize(rows.select("fp").distinct(), "distinct")
    links = materialize(candidate_links(distinct).distinct(), "links")
    release(docs.sparkSession)
    roots = components(links).withColumnRenamed("node", "fp")
    named = materialize(distinct.join(roots, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root")), "named")
    discard(links)
    discard(distinct)
    return rows, named


def drop_near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``docs`` with one document of each component: that of least id, and of least MD5 of the text among those; all columns unchanged.

    Null ids come last, so a row without id stays only where its component has no other. Rows equal in id and text are one
    document, whatever their other columns hold; a null text is an empty one. An empty table gives an empty result.
    """
    digest = F.md5(F.encode(text_or_empty(text_column), "UTF-8"))
    keyed = docs.select(F.col(f"`{id_column}`").alias("__qs_id"), digest.alias("__qs_md5"), F.col(f"`{text_column}`").alias("__qs_source"))
    rows, named = _named(keyed, ["__qs_id", "__qs_md5"], "__qs_source")
    each = rows.groupBy("fp").agg(F.min(F.struct(F.col("__qs_id").isNull().alias("none"), F.col("__qs_id").alias("id"), F.col("__qs_md5").alias("md5"))).alias("one"))
    kept = each.join(named, "fp").groupBy("root").agg(F.min("one").alias("one")).select(_key(F.col("one.id"), F.col("one.md5")).alias("__qs_key"))
    kept = materialize(kept, "kept")  # written, so that both sides of the next join are plain shuffles
    discard(rows)
    discard(named)
    marked = docs.withColumn("__qs_key", _key(F.col(f"`{id_column}`"), digest))
    return marked.join(kept, "__qs_key", "left_semi").dropDuplicates(["__qs_key"]).drop("__qs_key")  # one shuffle of the texts for both


def _key(id_: Column, digest: Column) -> Column:
    """Id and digest as one value that is never null, so that a join and what follows it can share a partitioning."""
    return F.concat(digest, F.coalesce(F.concat(F.lit("="), id_.cast("string")), F.lit("")))


def op9_simhash(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"))
