"""Near-duplicate texts for the pipeline: SimHash candidates from the byte-position index, then exact similarity.

Texts are near-duplicates when their sets of five-word shingles have a Jaccard similarity of 0.8 or more. One word changed in fifty
changes a tenth of the shingles but a fiftieth of the words, so candidates come from the SimHash of a text's set of *words*, of
128 bits, or sixteen positional bytes. The index of operator 9 (posting lists under triples of positions, shared positional bytes
tallied, pairs below a minimum dropped) has 40 triples here, so that any seven of the sixteen bytes contain one: pairs that share
seven bytes always meet, and those with five or six mostly. What is found is verified on the texts, so chance similarity of
fingerprints costs time and never a document.

A list of up to SMALL members gives all its pairs, a longer one each member with the nearest of its most central ones: copies of one
text differ less from it than from each other. Pairs are verified twice: each text with its nearest candidate first, then all pairs
whose texts that left apart.

That closes most groups and leaves out pairs, those far apart as fingerprints and those of long lists. All others come from an exact
index of prefixes (``prefix_lists``), which looks at texts of different groups alone and is verified in the same way: no pair of
similarity 0.8 is lost.

Sets of shingles are larger than the texts, so before any are made or moved all pairs pass a bound on their similarity: parities of at
least as many bits as a set has members.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.llm import prefix_lists
from quillspark.llm._common import add_columns, configure, discard, field, materialize, release, text_or_empty, trim_memory
from quillspark.llm.components import components

SHINGLE = 5
SIMILAR = 0.8
BYTES = 16
#: Parts of the positions; triples lie within a part. Seven positions have three in one part.
PARTS = ((0, 1, 2, 3, 4, 5), (6, 7, 8, 9, 10), (11, 12, 13, 14, 15))
TRIPLES = [t for part in PARTS for t in combinations(part, 3)]
#: Pairs of a list that share fewer positional bytes are dropped.
LEAST_SHARED = 5
SMALL = 32
#: Central members of a long list, and the bits up to which a member counts as seen with them.
PIVOTS, SEEN = 4, 16
#: Lists beyond this size are split by a fourth byte, of which linked pairs share two more at least.
LONG = 1 << 14


def _words(text: str) -> list[bytes]:
    return text.encode("utf-8").lower().split()  # on bytes, lower() changes A-Z alone and split() parts at \\x20 and \\x09-\\x0D


def fingerprint(text: str) -> bytes:
    """Sixteen bytes: a bit is set if it is in over half the hashes of the distinct words; all clear without words."""
    import xxhash

    digest = xxhash.xxh3_128_digest
    words = b"".join([digest(w) for w in set(_words(text))])
    if not words:
        return bytes(BYTES)
    set_bits, n = np.zeros(8 * BYTES, dtype=np.int64), len(words) // BYTES
    for at in range(0, len(words), BYTES << 14):
        part = np.frombuffer(words[at : at + (BYTES << 14)], dtype=np.uint8).reshape(-1, BYTES)
        set_bits += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int32)
    return np.packbits(2 * set_bits > n).tobytes()


def shingles(text: str) -> np.ndarray:
    """The sorted distinct hashes of five-word shingles; a text of fewer words is one shingle, one of none has no shingle."""
    import xxhash

    words = _words(text)
    digest = xxhash.xxh3_64_intdigest
    each = [b" ".join(words[i : i + SHINGLE]) for i in range(max(1, len(words) - SHINGLE + 1))] if words else []
    return np.unique(np.array([digest(s) for s in each], dtype=np.uint64))


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sorted sets; 1 for two empty ones."""
    if not len(a) and not len(b):
        return 1.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def list_pairs(f: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of ``f`` (n x 16 bytes) that one list gives: all that share LEAST_SHARED bytes in a short list, each member with its
    nearest central one in a long list, again and again for the members that no central one came near."""
    us, vs, rest = [], [], np.arange(len(f))
    while len(rest) > SMALL:
        part = f[rest]
        middle = np.packbits(2 * np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64) > len(part))
        central = np.argsort(np.bitwise_count(part ^ middle).sum(axis=1, dtype=np.int64), kind="stable")[:PIVOTS]
        differ = part[None, :] ^ part[central][:, None]
        bits = np.bitwise_count(differ).sum(axis=2, dtype=np.int64)
        met = (differ == 0).sum(axis=2) >= LEAST_SHARED
        met[np.arange(len(central)), central] = False
        near = np.where(met, bits, 8 * BYTES + 1)
        nearest, some = near.argmin(axis=0), met.any(axis=0)
        us.append(rest[central[nearest[some]]])
        vs.append(rest[some])
        rest = rest[~(bits <= SEEN).any(axis=0)]
    if len(rest) > 1:
        i, j = np.triu_indices(len(rest), 1)
        met = (f[rest[i]] == f[rest[j]]).sum(axis=1) >= LEAST_SHARED
        us.append(rest[i[met]])
        vs.append(rest[j[met]])
    empty = np.zeros(0, dtype=np.int64)
    return np.concatenate([*us, empty]), np.concatenate([*vs, empty])


def candidates(texts: DataFrame) -> DataFrame:
    """(u, v, bits), u < v: candidate pairs of ``texts`` (node: long, fp: 16 bytes) and the bits in which their fingerprints differ, each once."""
    spark = texts.sparkSession
    at = lambda p: F.conv(F.hex(F.substring("fp", p + 1, 1)), 16, 10).cast("long")
    named = texts.select("node", "fp", F.array(*[at(p) for p in range(BYTES)]).alias("b"))
    byte = lambda p: F.col("b")[p]
    keys = [F.lit(i << 24).cast("long").bitwiseOR(F.shiftleft(byte(a), 16)).bitwiseOR(F.shiftleft(byte(b), 8)).bitwiseOR(byte(c)) for i, (a, b, c) in enumerate(TRIPLES)]
    index = named.select("node", "fp", "b", F.explode(F.array(*keys)).alias("k"))
    long = materialize(index.groupBy("k").agg(F.count("*").alias("n")).where(F.col("n") > LONG).select("k", F.lit(True).alias("long")), "long_lists")
    if long.isEmpty():
        index = index.select("node", "fp", "k")
    else:
        others = F.element_at(F.array(*[F.array(*[F.lit(p) for p in range(BYTES) if p not in t]) for t in TRIPLES]), F.shiftright("k", 24).cast("int") + 1)
        split = F.transform(others, lambda p: F.shiftleft("k", 13).bitwiseOR(F.shiftleft(p.cast("long") + 16, 8)).bitwiseOR(F.element_at("b", p + 1)))  # from bit 37 on: apart from the keys of triples
        index = index.join(long, "k", "left").select("node", "fp", F.explode(F.when(F.col("long"), split).otherwise(F.array("k"))).alias("k"))
    lists = index.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "k").sortWithinPartitions("k", "node").select("k", "node", "fp")
    schema = T.StructType([field("u", T.LongType()), field("v", T.LongType()), field("bits", T.IntegerType())])

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def emit(k, node, f):
            starts = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
            sizes = np.diff(np.append(starts, len(k)))
            us, vs = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
            small = np.repeat(sizes <= SMALL, sizes)
            rows, mine = np.flatnonzero(small), k[small]
            for d in range(1, SMALL):  # all pairs of short lists at once, by their distance in the list
                same = mine[d:] == mine[:-d] if len(mine) > d else np.zeros(0, dtype=bool)
                if not same.any():
                    break
                a, b = rows[:-d][same], rows[d:][same]
                met = (f[a] == f[b]).sum(axis=1) >= LEAST_SHARED
                us.append(a[met])
                vs.append(b[met])
            for i in np.flatnonzero(sizes > SMALL):
                u, v = list_pairs(f[starts[i] : starts[i] + sizes[i]])
                us.append(u + starts[i])
                vs.append(v + starts[i])
            u, v = np.concatenate(us), np.concatenate(vs)
            bits = np.bitwise_count(f[u] ^ f[v]).sum(axis=1, dtype=np.int32)
            low, high = np.minimum(node[u], node[v]), np.maximum(node[u], node[v])
            _, once = np.unique(np.column_stack([low, high]), axis=0, return_index=True)
            return pa.RecordBatch.from_arrays([pa.array(low[once]), pa.array(high[once]), pa.array(bits[once])], names=["u", "v", "bits"])

        held: list[tuple] = []
        rows = 0
        for batch in batches:
            fp = np.frombuffer(b"".join(batch.column(2).to_pylist()), dtype=np.uint8).reshape(-1, BYTES)
            held.append((batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False), fp))
            rows += len(fp)
            if rows >= 1 << 17:  # complete lists are done with; the last one may go on
                k, node, f = (np.concatenate(c) for c in zip(*held))
                cut = int(np.searchsorted(k, k[-1]))
                if cut:
                    yield emit(k[:cut], node[:cut], f[:cut])
                held, rows = [(k[cut:], node[cut:], f[cut:])], len(k) - cut
        if rows:
            yield emit(*(np.concatenate(c) for c in zip(*held)))
        trim_memory()

    return lists.mapInArrow(run, schema).distinct()


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those rows of ``pairs`` (u, v, a, b) whose texts u and v are similar, as (a, b). ``sets``: (node, s), sorted hashes of 8 bytes."""
    of = lambda c: sets.select(F.col("node").alias(c), F.col("s").alias(f"s_{c}"))
    joined = pairs.join(of("u").hint("shuffle_hash"), "u").join(of("v").hint("shuffle_hash"), "v").select("a", "b", "s_u", "s_v")
    schema = T.StructType([field("u", T.LongType()), field("v", T.LongType())])

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            keep = [similarity(np.frombuffer(a.as_buffer(), dtype="<u8"), np.frombuffer(b.as_buffer(), dtype="<u8")) >= SIMILAR for a, b in zip(batch.column(2), batch.column(3))]
            yield pa.RecordBatch.from_arrays(batch.columns[:2], names=["u", "v"]).filter(pa.array(keep, type=pa.bool_()))
        trim_memory()

    return joined.mapInArrow(run, schema)


def _key(id_, digest):
    """Id and digest as one value that is never null, so that a join and what follows it can share a partitioning."""
    return F.concat(digest, F.coalesce(F.concat(F.lit("="), id_.cast("string")), F.lit("")))


def _plausible(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Those rows of ``pairs`` (u, v, ...) whose texts may be similar by their sizes and parities: no similar pair goes, and of others hardly
    one below 0.7 stays, so that sets are made and moved for few. ``texts``: (node, n, parity, wide)."""
    of = lambda c: texts.select(F.col("node").alias(c), F.col("n").alias(f"n_{c}"), F.coalesce("wide", "parity").alias(f"p_{c}"))
    names = pairs.columns
    joined = pairs.join(of("u"), "u").join(of("v"), "v").select(*names, "n_u", "n_v", "p_u", "p_v")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            keep = [prefix_lists.may_be_similar(*of) for of in zip(*(c.to_pylist() for c in batch.columns[len(names) :]))]
            yield pa.RecordBatch.from_arrays(batch.columns[: len(names)], names=names).filter(pa.array(keep, type=pa.bool_()))

    return joined.mapInArrow(run, pairs.schema)


def _sets(texts: DataFrame, nodes: DataFrame, docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """(node, s), written: the sorted hashes of the shingles of ``nodes`` (node), 8 bytes each."""
    digest = F.md5(F.encode(text_or_empty(text_column), "UTF-8"))
    keys = nodes.join(texts.select("node", _key(F.col("one.id"), F.col("md5")).alias("key")), "node")
    source = docs.select(_key(F.col(f"`{id_column}`"), digest).alias("key"), text_or_empty(text_column).alias("text"))  # by row, so that copies of a text don't meet
    once = source.join(keys.hint("shuffle_hash"), "key").dropDuplicates(["key"]).select("node", "text")
    return materialize(add_columns(once, "text", [field("s", T.BinaryType())], lambda column: [[shingles(t.as_py()).astype("<u8").tobytes() for t in column]], ["node"]), "shingles", "none")


def _nodes(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("u").alias("node")).distinct().union(pairs.select(F.col("v").alias("node")).distinct()).distinct()


def groups(texts: DataFrame, lists: DataFrame, docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(node, root) of all ``texts`` (node, md5, one: the row that stands for it, fp, n, parity, wide), written: what pairs of similar
    texts connect. First each text and its nearest candidate; then the pairs between groups that these left apart, which link the
    groups' roots, with the nearest members of ``lists`` of prefixes; then all that these lists still hold between groups."""
    spark = texts.sparkSession
    close = materialize(_plausible(prefix_lists.apart(lists.withColumn("root", F.col("node")), True).select("u", "v"), texts), "close")
    pairs = materialize(_plausible(candidates(texts.select("node", "fp")), texts), "candidates")
    both = pairs.union(pairs.select("v", "u", "bits"))
    nearest = materialize(both.groupBy("u").agg(F.min(F.struct("bits", "v")).alias("m")).select("u", "m.v"), "nearest")  # a row for each text that has a candidate
    release(spark)
    sets = _sets(texts, nearest.select(F.col("u").alias("node")).union(_nodes(close)).distinct(), docs, id_column, text_column)
    nearest, before = nearest.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), nearest
    release(spark)
    first = materialize(_verified(nearest.select("u", "v", F.col("u").alias("a"), F.col("v").alias("b")), sets), "links")
    roots = materialize(components(first), "roots")
    of = lambda c, name: roots.select(F.col("node").alias(c), F.col("root").alias(name))
    found = pairs.select("u", "v").union(close).distinct()
    apart = found.join(of("u", "a"), "u", "left").join(of("v", "b"), "v", "left").select("u", "v", F.coalesce("a", "u").alias("a"), F.coalesce("b", "v").alias("b")).where("a <> b")
    rest = apart.join(nearest.withColumn("__qs_done", F.lit(True)), ["u", "v"], "left").where("__qs_done is null").select("u", "v", "a", "b")
    named = texts.select("node").join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"))
    release(spark)
    out = _joined(named, _verified(rest, sets))
    for t in (pairs, close, before, first, roots):
        discard(t)
    last = materialize(_plausible(prefix_lists.apart(lists.join(out, "node"), False), texts), "apart")
    release(spark)
    missing = _nodes(last).join(sets.select("node"), "node", "left_anti")  # texts whose nearest one is too far, and another isn't
    more = None if missing.isEmpty() else _sets(texts, missing, docs, id_column, text_column)
    out, before = _joined(out, _verified(last, sets if more is None else sets.union(more))), out
    for t in (before, last, sets) if more is None else (before, last, sets, more):
        discard(t)
    return out


def _joined(named: DataFrame, links: DataFrame) -> DataFrame:
    """``named`` (node, root), written, with the roots that ``links`` (u, v) of roots lead to."""
    between = materialize(links.distinct(), "links")
    tops = components(between).select(F.col("node").alias("root"), F.col("root").alias("top"))
    out = materialize(named.join(tops, "root", "left").select("node", F.coalesce("top", "root").alias("root")), "groups")
    discard(between)
    return out


def drop_near_texts(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``docs`` with one document of each group of near-duplicates: that of least id, and of least MD5 of the text among those; all
    columns unchanged. A group is what chains of near-duplicates connect.

    Null ids come last, so a row without id stays only where its group has no other. Rows equal in id and text are one document,
    whatever their other columns hold; a null text is an empty one, and texts without words are near-duplicates of each other. An
    empty table gives an empty result.
    """
    configure(docs.sparkSession)
    digest = F.md5(F.encode(text_or_empty(text_column), "UTF-8"))
    keyed = docs.select(F.col(f"`{id_column}`").alias("__qs_id"), digest.alias("md5"), F.col(f"`{text_column}`").alias("__qs_source"))
    often = docs.sparkSession.sparkContext.broadcast(prefix_lists.frequent(docs, text_column, shingles))
    measures = [field("fp", T.BinaryType()), field("n", T.LongType()), field("parity", T.BinaryType()), field("wide", T.BinaryType()), field("prefix", T.ArrayType(T.LongType()))]

    def measured(column):
        sets = [shingles(t.as_py()) for t in column]
        return [[fingerprint(t.as_py()) for t in column], [len(s) for s in sets], [prefix_lists.parity(s) for s in sets], [prefix_lists.wide_parity(s) for s in sets], [prefix_lists.prefix(s, *often.value) for s in sets]]

    made = add_columns(keyed, "__qs_source", measures, measured, ["__qs_id", "md5"])
    one = F.min(F.struct(F.col("__qs_id").isNull().alias("none"), F.col("__qs_id").alias("id"))).alias("one")
    whole = materialize(made.groupBy("md5").agg(one, *[F.first(c.name).alias(c.name) for c in measures]).withColumn("node", F.monotonically_increasing_id()), "texts")
    lists = prefix_lists.lists(whole)
    each = materialize(whole.drop("prefix"), "texts")  # prefixes, most of the table, are done with
    discard(whole)
    release(docs.sparkSession)
    named = groups(each, lists, docs, id_column, text_column)
    discard(lists)
    grouped = each.join(named, "node").groupBy("root").agg(F.min(F.struct("one.none", "one.id", "md5")).alias("one"))
    kept = materialize(grouped.select(_key(F.col("one.id"), F.col("one.md5")).alias("__qs_key")), "kept")  # written, so that both sides of the next join are plain shuffles
    discard(named)
    discard(each)
    marked = docs.withColumn("__qs_key", _key(F.col(f"`{id_column}`"), digest))
    return marked.join(kept, "__qs_key", "left_semi").dropDuplicates(["__qs_key"]).drop("__qs_key")  # one shuffle of the texts for both
