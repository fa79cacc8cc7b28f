"""Suggestions of tags for documents: existing tags that they cover, and prominent new words."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import patterns as P
from quillspark.functions.dialect import SPARK
from quillspark.functions.normalizers import all_tokens, fold_token, tokens
from quillspark.operators.lists import count_items

MOST_NEW, MOST = 5, 15


def document_tokens(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, token, n, top): frequencies of the words that count, and the highest of them in the document. A row for each document,
    told apart by ``key``: words are counted, and stop words dropped, within the row, and nothing is shuffled."""
    rows = docs.select(key, F.expr(all_tokens(SPARK, f"coalesce(`{text}`, '')")).alias("ts"))
    rows = rows.select(key, F.filter("ts", lambda w: (F.length(w) >= 2) & ~w.isin(*P.STOP_WORDS)).alias("ts"))
    return count_items(rows, ["ts"], [key], top=True).select(key, F.col("item").alias("token"), "n", "top")


def existing_tags(words: DataFrame, tags: DataFrame, key: str, applied: DataFrame | None = None) -> DataFrame:
    """(key, name, score) of ``tags`` (name) by the share of their tokens that a document has, two decimals.

    Tags meet documents on tokens, an equi-join, so pairs that share nothing are never formed. ``applied`` (key, name): not again.
    """
    spread = tags.select("name", F.expr(tokens(SPARK, "name")).alias("ts")).select("name", F.size("ts").alias("size"), F.explode("ts").alias("token"))
    per_tag = spread.groupBy("name", "size", "token").agg(F.count("*").alias("times"))
    hits = words.join(per_tag, "token").groupBy(key, "name", "size").agg(F.sum("times").alias("matched"))
    found = hits.select(key, "name", (F.floor(F.col("matched") / F.col("size") * 100 + 0.5) / 100).alias("score"))
    return found.join(applied, [key, "name"], "left_anti") if applied is not None else found


def new_tags(words: DataFrame, tags: DataFrame, key: str, most: int = MOST_NEW) -> DataFrame:
    """(key, name, score): each document's most frequent words that no tag has, by their share of its highest frequency."""
    known = tags.select(F.explode(F.concat(F.expr(tokens(SPARK, "name")), F.array(F.expr(fold_token(SPARK, "name"))))).alias("token")).distinct()
    fresh = words.join(known, "token", "left_anti")
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.col("n").desc(), "token"))
    best = fresh.withColumn("r", rank).where(F.col("r") <= most)
    return best.select(key, F.col("token").alias("name"), (F.floor(F.col("n") / F.col("top") * 100 + 0.5) / 100).alias("score"))


def suggestions(existing: DataFrame, new: DataFrame, key: str, most: int = MOST) -> DataFrame:
    """(key, name, score, kind): the best of both, existing ones first among equals."""
    both = existing.withColumn("kind", F.lit("existing")).unionByName(new.withColumn("kind", F.lit("new")))
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.col("score").desc(), "kind", "name"))
    return both.withColumn("r", rank).where(F.col("r") <= most).drop("r")
