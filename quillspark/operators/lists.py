"""Ranking of linked lists that no task could hold: how far each element is from its list's head."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.session import discard, materialize

#: Elements that one task ranks; longer lists are contracted until so many are left.
LEAST = 1 << 17


def rank(elements: DataFrame, weights: Sequence[str], least: int | None = None) -> DataFrame:
    """(e, weights): for each element of ``elements`` (e, pred, succ: longs, null at the ends; ``weights``: longs, the way from pred
    to e) the way from its list's head, written.

    A round takes out the elements whose hash is less than both neighbours', a third of them, and ties their neighbours together;
    once ``least`` are left, one task follows them, and the rounds are undone backwards: an element that was taken out is as far
    as its predecessor and the way from there. Joins are shuffled: broadcast, each would go through the driver. Rounds shrink by a third each, so all that is written is some six times the
    elements, whatever their number and the lists' lengths. Elements of a ring, which no head leads to, are left out.
    """
    least = LEAST if least is None else least
    columns = ["e", "pred", "succ", *weights]
    current = materialize(elements.select(*columns), "list")
    left, rounds, number = current.count(), [], 0
    while left > least:
        number += 1
        mine, of_pred, of_succ = (F.xxhash64(F.col(c), F.lit(number)) for c in ("e", "pred", "succ"))
        lower = F.col("pred").isNotNull() & (mine < of_pred) & (F.col("succ").isNull() | (mine < of_succ))
        marked = current.withColumn("__qs_out", lower)
        out = materialize(marked.where("__qs_out").drop("__qs_out"), "taken_out")
        ties = out.select(F.col("pred").alias("e"), F.col("succ").alias("__qs_succ"), F.lit(True).alias("__qs_tied"))
        back = out.where("succ is not null").select(F.col("succ").alias("e"), F.col("pred").alias("__qs_pred"), *[F.col(w).alias(f"__qs_{w}") for w in weights])
        kept = marked.where("not __qs_out").join(ties.hint("shuffle_hash"), "e", "left").join(back.hint("shuffle_hash"), "e", "left")
        after = materialize(
            kept.select(
                "e",
                F.coalesce("__qs_pred", "pred").alias("pred"),
                F.when(F.col("__qs_tied"), F.col("__qs_succ")).otherwise(F.col("succ")).alias("succ"),
                *[(F.col(w) + F.coalesce(f"__qs_{w}", F.lit(0))).alias(w) for w in weights],
            ),
            "list",
        )
        discard(current)
        current, before = after, left
        left = current.count()
        rounds.append(out)
        if left == before:
            break  # short rings and heads alone
    known = materialize(_follow(current.coalesce(1), weights), "ranks")  # as many as ``least``
    discard(current)
    for out in reversed(rounds):
        from_pred = known.select(F.col("e").alias("pred"), *[F.col(w).alias(f"__qs_{w}") for w in weights])
        found = out.hint("shuffle_hash").join(from_pred, "pred").select("e", *[(F.col(w) + F.col(f"__qs_{w}")).alias(w) for w in weights])
        last, known = known, materialize(known.unionByName(found), "ranks")
        discard(last)
        discard(out)
    return known


def _follow(elements: DataFrame, weights: Sequence[str]) -> DataFrame:
    schema = T.StructType([T.StructField(c, T.LongType()) for c in ("e", *weights)])

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        rows, heads = {}, []
        for batch in batches:
            for e, pred, succ, *way in zip(*(c.to_pylist() for c in batch.columns)):
                rows[e] = (succ, way)
                if pred is None:
                    heads.append(e)
        out = []
        for at in heads:
            sums = [0] * len(weights)
            while at is not None:
                succ, way = rows[at]
                sums = [a + b for a, b in zip(sums, way)]
                out.append((at, *sums))
                at = succ
        for i in range(0, len(out), 1 << 16):
            part = out[i : i + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(c, type=pa.int64()) for c in zip(*part)], names=schema.names)

    return elements.mapInArrow(run, schema)


def count_items(df: DataFrame, lists: Sequence[str], keep: Sequence[str], top: bool = False) -> DataFrame:
    """(``keep``, list, item, n; with ``top``, the greatest n of the list): how often each distinct string stands in each of the columns ``lists``, whose numbers from 0 are
    ``list``; none is null. Counted within the row, in Arrow batches: nothing is exploded to be counted, and nothing shuffled."""
    kept = df.select(*[F.col(f"`{c}`") for c in [*keep, *lists]])
    schema = T.StructType([*[kept.schema[c] for c in keep], T.StructField("list", T.IntegerType()), T.StructField("item", T.StringType()), T.StructField("n", T.LongType())])
    if top:
        schema = schema.add("top", T.LongType())

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for place in range(len(lists)):
                column = batch.column(len(keep) + place)
                words = column.flatten().dictionary_encode()
                rows = np.repeat(np.arange(len(column), dtype=np.int64), np.diff(column.offsets.to_numpy()))
                known = max(1, len(words.dictionary))
                each, n = np.unique(rows * known + words.indices.to_numpy(zero_copy_only=False), return_counts=True)
                at = pa.array(each // known)
                made = [batch.column(i).take(at) for i in range(len(keep))]
                made += [pa.array(np.full(len(each), place, dtype=np.int32)), words.dictionary.take(pa.array(each % known)), pa.array(n)]
                if top:
                    greatest = np.zeros(len(column), dtype=np.int64)
                    np.maximum.at(greatest, each // known, n)
                    made.append(pa.array(greatest[each // known]))
                yield pa.RecordBatch.from_arrays(made, names=schema.names)

    return kept.mapInArrow(run, schema)


def weigh_items(df: DataFrame, lists: dict[str, float], keep: Sequence[str]) -> DataFrame:
    """(``keep``, item, n): the distinct strings of all the columns ``lists`` of a row together, with the sum of the weights of the
    columns in which they stand, repeats included; no list is null. Counted within the row, as :func:`count_items`."""
    kept = df.select(*[F.col(f"`{c}`") for c in [*keep, *lists]])
    schema = T.StructType([*[kept.schema[c] for c in keep], T.StructField("item", T.StringType()), T.StructField("n", T.DoubleType())])
    weights = list(lists.values())

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            columns = [batch.column(len(keep) + i) for i in range(len(weights))]
            sizes = [np.diff(c.offsets.to_numpy()) for c in columns]
            words = pa.concat_arrays([c.flatten() for c in columns]).dictionary_encode()
            rows = np.concatenate([np.repeat(np.arange(len(s), dtype=np.int64), s) for s in sizes])
            known = max(1, len(words.dictionary))
            found = rows * known + words.indices.to_numpy(zero_copy_only=False)
            order = np.argsort(found, kind="stable")
            found, of = found[order], np.repeat(weights, [s.sum() for s in sizes])[order]
            starts = np.flatnonzero(np.diff(found, prepend=-1))
            each = found[starts]
            at = pa.array(each // known)
            n = np.add.reduceat(of, starts) if len(starts) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*[batch.column(i).take(at) for i in range(len(keep))], words.dictionary.take(pa.array(each % known)), pa.array(n)], names=schema.names)

    return kept.mapInArrow(run, schema)
