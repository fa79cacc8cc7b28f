"""Connected components of a graph that is too large for one machine: alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm._common import discard, materialize


def _digest(edges: DataFrame) -> tuple:
    """How many edges there are, and a sum that changes with any of them."""
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)


def components(edges: DataFrame, most_rounds: int = 100) -> DataFrame:
    """(node, root): every node of ``edges`` (u, v; longs) with the least node that it is linked to, itself included.

    Each round makes every node point to the least of its neighbours, first for the larger ones, then for the smaller; the number
    of edges never grows and stars are reached after a few rounds, also on long chains. A round is written to the shared folder, so
    lineage stays short and a lost executor costs one round at most. Nodes of many links are joined, not gathered.
    """
    ordered = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()
    current = materialize(ordered, "edges")
    digest = _digest(current)
    for _ in range(most_rounds):
        if not digest[0]:
            break
        both = current.union(current.select(F.col("v"), F.col("u")))
        least = both.groupBy("u").agg(F.least(F.min("u"), F.min("v")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        lower = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lower, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = materialize(small.union(lower.select("u", F.col("m").alias("v"))).distinct(), "edges")
        now = _digest(after)
        discard(current)
        current = after
        if now == digest:
            break
        digest = now
    else:
        raise RuntimeError("components did not settle")
    roots = current.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return current.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)
