"""The exact end of the near-duplicate search: every pair of sets of Jaccard similarity SIMILAR or more, found by their prefixes.

In any order of all shingles, two sets a and b that are similar share one among the first len - ceil(0.8 len) + 1 of each. Texts that
share such a shingle stand in one list. The order puts shingles that many texts hold last, so lists are short; how often a shingle
occurs is only counted well enough for that, as any order is right.

Within a list, a bound that never errs on the low side opens few pairs: bit i of a set's parity tells whether an odd number of its
shingles falls into i, so two parities differ in no more bits than the sets do in members, and similar sets differ in a ninth of
their members at most. Each text meets the nearest one of a list first, so that large groups close; pairs of one group need no look, and
those that are still apart are all opened, in blocks of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.llm._common import configure, field, materialize, text_or_empty, trim_memory

#: Bits of a parity, in words of 64.
WORDS = 16
#: Frequent shingles that are told apart in the order.
FREQUENT = 1 << 17
SMALL = 32
#: Pairs that a block compares at once.
BLOCK = 1 << 19


def frequent(docs: DataFrame, text_column: str, shingles) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that occur more than once in some batch of texts, sorted, and how often: the FREQUENT ones of greatest count."""
    configure(docs.sparkSession)
    schema = T.StructType([field("h", T.LongType()), field("n", T.LongType())])

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            if batch.num_rows:
                h, n = np.unique(np.concatenate([shingles(t.as_py()) for t in batch.column(0)]), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(h[n > 1].view(np.int64)), pa.array(n[n > 1])], names=["h", "n"])
        trim_memory()

    counted = docs.select(text_or_empty(text_column).alias("text")).mapInArrow(run, schema).groupBy("h").agg(F.sum("n").alias("n"))
    top = counted.orderBy(F.desc("n"), "h").limit(FREQUENT).toArrow()
    h, n = top.column("h").to_numpy().view(np.uint64), top.column("n").to_numpy()
    order = np.argsort(h)
    return h[order], n[order]


def prefix(s: np.ndarray, h: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The first of the shingles ``s`` in the order (count in ``h``, ``n``; shingle): one of them is in any similar set's. [0] for none."""
    if not len(s):
        return np.zeros(1, dtype=np.int64)
    count = np.zeros(len(s), dtype=np.int64)
    if len(h):
        at = np.minimum(np.searchsorted(h, s), len(h) - 1)
        count = np.where(h[at] == s, n[at], 0)
    return s[np.lexsort((s, count))][: len(s) - (4 * len(s) + 4) // 5 + 1].view(np.int64)


def parity(s: np.ndarray, bits: int = 64 * WORDS) -> bytes:
    return np.packbits((np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8)).tobytes()


def wide_parity(s: np.ndarray) -> bytes | None:
    """The parity of a set of more members than :func:`parity` has bits, of as many bits as it has members at least; None for others."""
    return parity(s, 1 << (len(s) - 1).bit_length()) if len(s) > 64 * WORDS else None


def may_be_similar(n: int, m: int, p: bytes, q: bytes) -> bool:
    """Whether sets of n and m members with these parities may be similar. The wider parity is folded: bit i of half its bits is that of i and of i + half."""
    a, b = np.frombuffer(p, dtype=np.uint64), np.frombuffer(q, dtype=np.uint64)
    least = min(len(a), len(b))
    differ = np.bitwise_xor.reduce(a.reshape(-1, least)) ^ np.bitwise_xor.reduce(b.reshape(-1, least))
    return 9 * max(int(np.bitwise_count(differ).sum()), abs(n - m)) <= n + m


def lists(texts: DataFrame) -> DataFrame:
    """(k, node, n, parity), written: the lists of two or more members of ``texts`` (node, n, parity, prefix: array of longs)."""
    spark = texts.sparkSession
    index = texts.select(F.explode("prefix").alias("k"), "node").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "k").sortWithinPartitions("k")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        last: tuple = (np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), False)  # the row before this batch, and whether it was given

        def give(k, node, keep):
            return pa.RecordBatch.from_arrays([pa.array(k[keep]), pa.array(node[keep])], names=["k", "node"])

        for batch in batches:
            k, node = (np.concatenate([a, batch.column(i).to_numpy(zero_copy_only=False)]) for i, a in enumerate(last[:2]))
            same = k[1:] == k[:-1]
            keep = np.concatenate([same, [False]]) | np.concatenate([[False], same])
            done = bool(len(keep)) and bool(keep[-1])
            if len(last[0]) and last[2]:
                keep[0] = False
                done = done if len(k) > 1 else True
            yield give(k, node, keep)
            last = (k[-1:], node[-1:], done)

    shared = index.mapInArrow(run, T.StructType([field("k", T.LongType()), field("node", T.LongType())]))
    return materialize(shared.join(texts.select("node", "n", "parity"), "node"), "lists")


def _near(p: np.ndarray, n: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For pairs (i, j), which may be similar by their parities and sizes, and the bits in which parities differ."""
    bits = np.zeros(np.broadcast(i, j).shape, dtype=np.int32)
    for w in range(WORDS):
        bits += np.bitwise_count(p[w][i] ^ p[w][j])
    a, b = n[i], n[j]
    return 9 * np.maximum(bits, np.abs(a - b)) <= a + b, bits


def apart(members: DataFrame, nearest: bool) -> DataFrame:
    """(u, v, a, b), u < v, each once: pairs of ``members`` (k, node, n, parity, root) that may be similar and have roots a and b of their own;
    ``nearest``: for each member of a list the nearest one alone."""
    spark = members.sparkSession
    dealt = members.select("k", "node", "root", "n", "parity").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "k").sortWithinPartitions("k", "node")
    schema = T.StructType([field(c, T.LongType()) for c in ("u", "v", "a", "b")])

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def give(node, root, i, j):
            low, high = np.where(node[i] < node[j], i, j), np.where(node[i] < node[j], j, i)
            _, once = np.unique(np.column_stack([node[low], node[high]]), axis=0, return_index=True)
            low, high = low[once], high[once]
            return pa.RecordBatch.from_arrays([pa.array(c) for c in (node[low], node[high], root[low], root[high])], names=["u", "v", "a", "b"])

        def best(i, j, bits):
            """Those of the pairs (rows, so each of one list) that are the nearest of either member."""
            one, at = np.concatenate([i, j]), np.tile(np.arange(len(i)), 2)
            order = np.lexsort((at, bits[at], one))
            first = np.flatnonzero(np.concatenate([[True], one[order][1:] != one[order][:-1]]))
            return np.unique(at[order][first])

        def short(k, node, root, n, p, rows):
            found = [(np.zeros(0, dtype=np.int64),) * 3]
            mine = k[rows]
            for d in range(1, SMALL):  # all pairs of short lists at once, by their distance in the list
                same = mine[d:] == mine[:-d] if len(mine) > d else np.zeros(0, dtype=bool)
                if not same.any():
                    break
                i, j = rows[:-d][same], rows[d:][same]
                other = root[i] != root[j]
                i, j = i[other], j[other]
                met, bits = _near(p, n, i, j)
                found.append((i[met], j[met], bits[met]))
            i, j, bits = (np.concatenate(c) for c in zip(*found))
            if nearest and len(i):
                pick = best(i, j, bits)
                i, j = i[pick], j[pick]
            return i, j

        def long(root, n, p, rows):
            rows = rows[np.argsort(n[rows], kind="stable")]
            if (root[rows] == root[rows[0]]).all():
                return
            step, at = max(1, BLOCK // len(rows)), 0
            while at < len(rows):
                some = rows[at : at + step]
                reach = rows[: np.searchsorted(n[rows], n[some[-1]] * 5 // 4, "right")]  # no larger set is similar
                reach = reach[np.searchsorted(n[reach], (4 * n[some[0]] + 4) // 5) :] if nearest else reach[at + 1 :]
                met, bits = _near(p, n, some[:, None], reach[None, :])
                met &= root[some][:, None] != root[reach][None, :]
                if nearest:
                    bits[~met] = 1 << 30
                    i = np.flatnonzero(met.any(axis=1))
                    if len(i):
                        yield some[i], reach[bits[i].argmin(axis=1)]
                else:
                    met &= np.arange(len(some))[:, None] <= np.arange(len(reach))[None, :]
                    i, j = np.nonzero(met)
                    if len(i):
                        yield some[i], reach[j]
                at += step

        def emit(k, node, root, n, p):
            p = np.ascontiguousarray(p.T)
            starts = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
            sizes = np.diff(np.append(starts, len(k)))
            i, j = short(k, node, root, n, p, np.flatnonzero(np.repeat(sizes <= SMALL, sizes)))
            if len(i):
                yield give(node, root, i, j)
            for at in np.flatnonzero(sizes > SMALL):
                for i, j in long(root, n, p, np.arange(starts[at], starts[at] + sizes[at])):
                    yield give(node, root, i, j)

        held: list[tuple] = []
        rows = 0
        for batch in batches:
            whole = [batch.column(c).to_numpy(zero_copy_only=False) for c in range(4)]
            held.append((*whole, np.frombuffer(b"".join(batch.column(4).to_pylist()), dtype=np.uint64).reshape(-1, WORDS)))
            rows += batch.num_rows
            if rows >= 1 << 16:  # complete lists are done with; the last one may go on
                parts = [np.concatenate(c) for c in zip(*held)]
                cut = int(np.searchsorted(parts[0], parts[0][-1]))
                if cut:
                    yield from emit(*(c[:cut] for c in parts))
                held, rows = [tuple(c[cut:] for c in parts)], len(parts[0]) - cut
        if rows:
            yield from emit(*(np.concatenate(c) for c in zip(*held)))
        trim_memory()

    return dealt.mapInArrow(run, schema).dropDuplicates(["u", "v"])
