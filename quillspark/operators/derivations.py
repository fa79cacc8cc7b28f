"""Changes to tables, as new tables derived from old ones."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.operators.relations import latest_per


def upsert(current: DataFrame, changes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``current`` with the rows of ``changes`` in place of, or beside, those of equal keys; the last of equal changes isn't defined, so keys should be unique in each."""
    both = current.withColumn("__qs_new", F.lit(0)).unionByName(changes.withColumn("__qs_new", F.lit(1)))
    return latest_per(both, keys, [F.col("__qs_new").desc()]).drop("__qs_new")


def toggle(current: DataFrame, pairs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Pairs that are in one of the two tables but not in both."""
    return current.select(*keys).exceptAll(pairs.select(*keys)).union(pairs.select(*keys).exceptAll(current.select(*keys)))


def merge_tag(bridge: DataFrame, source, target, tag: str = "tag_id", document: str = "document_id") -> DataFrame:
    """Rows of ``source`` point to ``target``, each pair once."""
    return bridge.withColumn(tag, F.when(F.col(tag) == source, F.lit(target)).otherwise(F.col(tag))).dropDuplicates([tag, document])


def newly_tagged(bridge: DataFrame, source, target, tag: str = "tag_id", document: str = "document_id") -> DataFrame:
    """Documents that a merge newly tags."""
    has = bridge.where(F.col(tag) == target).select(document)
    return bridge.where(F.col(tag) == source).select(document).distinct().join(has, document, "left_anti")


def replace_tags(bridge: DataFrame, document_tags: DataFrame, tag: str = "tag_id", document: str = "document_id") -> DataFrame:
    """The tags of the documents in ``document_tags`` are exactly those given there."""
    return bridge.select(document, tag).join(document_tags.select(document), document, "left_anti").union(document_tags.select(document, tag).distinct())


def bulk_tag(bridge: DataFrame, additions: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Pairs to add that aren't there yet."""
    return additions.select(*keys).distinct().join(bridge.select(*keys), list(keys), "left_anti")


def bulk_untag(bridge: DataFrame, removals: DataFrame, keys: Sequence[str]) -> DataFrame:
    return bridge.join(removals.select(*keys), list(keys), "left_anti")


def soft_delete(df: DataFrame, condition: Column, now: Column, deleted: str = "deleted_at") -> DataFrame:
    """Rows that meet the condition and aren't deleted are marked; null conditions don't count."""
    return df.withColumn(deleted, F.when(F.coalesce(condition, F.lit(False)) & F.col(deleted).isNull(), now).otherwise(F.col(deleted)))


def restore(df: DataFrame, condition: Column, deleted: str = "deleted_at") -> DataFrame:
    return df.withColumn(deleted, F.when(~F.coalesce(condition, F.lit(False)), F.col(deleted)))


def violations(df: DataFrame, unique: Sequence[Sequence[str]] = (), checks: dict[str, Column] | None = None) -> DataFrame:
    """(rule, n): how many keys break each uniqueness rule and how many rows each check; a null check passes, as in SQL."""
    parts = [df.groupBy(*keys).agg(F.count("*").alias("c")).where("c > 1").agg(F.lit("unique:" + ",".join(keys)).alias("rule"), F.count("*").alias("n")) for keys in unique]
    for name, condition in (checks or {}).items():
        parts.append(df.agg(F.lit("check:" + name).alias("rule"), F.count(F.when(~condition, 1)).alias("n")))
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def retry_or_dead(jobs: DataFrame, now: Column, will_retry: Column, failed_at: Column | None = None) -> DataFrame:
    """Failed jobs' next state: pending with a later run_at while retries are left, else dead."""
    delay = F.when(F.col("queue") == "ocr", 5000).otherwise(2000) * F.pow(F.lit(2), F.col("attempts"))
    again = will_retry & (F.col("attempts") < F.col("max_attempts"))
    later = F.timestamp_micros(F.unix_micros((failed_at if failed_at is not None else now).cast("timestamp")) + (delay * 1000).cast("long"))
    return jobs.withColumns({"status": F.when(again, "pending").otherwise("dead"), "run_at": F.when(again, later)})


def stale(now: Column, seconds: int = 30) -> Column:
    """Reserved jobs whose heartbeat and lock are both older than the grace."""
    edge = now - F.expr(f"interval {seconds} seconds")
    return (F.col("status") == "reserved") & (F.coalesce(F.col("heartbeat_at"), F.col("locked_at")) < edge) & (F.col("locked_at") < edge)


def idempotent_enqueue(queue: DataFrame, requests: DataFrame) -> DataFrame:
    """The queue after ``requests`` (queue, idempotency_key, payload, at): new keys are added, jobs that ended are opened again with
    no attempts, others stay as they are. Of equal requests the latest counts."""
    wanted = latest_per(requests, ["queue", "idempotency_key"], [F.col("at").desc(), F.col("payload")])
    asked = wanted.select("queue", "idempotency_key", F.col("payload").alias("__qs_p"), F.col("at").alias("__qs_at"))
    joined = queue.join(asked, ["queue", "idempotency_key"], "full")
    opens = F.col("__qs_at").isNotNull() & (F.col("status").isNull() | F.col("status").isin("done", "dead"))
    return joined.select(
        "queue",
        "idempotency_key",
        F.when(opens, F.col("__qs_p")).otherwise(F.col("payload")).alias("payload"),
        F.when(opens, "pending").otherwise(F.col("status")).alias("status"),
        F.when(opens, 0).otherwise(F.col("attempts")).alias("attempts"),
    )


def dead_letters(jobs: DataFrame, error: str) -> DataFrame:
    """Jobs that are dead, with a note (JSON) of their attempts and last error."""
    return jobs.where("status = 'dead'").withColumn("dead_letter", F.to_json(F.struct("attempts", F.col(error).alias("error"))))


def requeue(jobs: DataFrame, chosen: Column) -> DataFrame:
    """Dead jobs that are chosen are pending again, with no attempts; all others stay."""
    again = (F.col("status") == "dead") & F.coalesce(chosen, F.lit(False))
    return jobs.withColumns({"status": F.when(again, "pending").otherwise(F.col("status")), "attempts": F.when(again, 0).otherwise(F.col("attempts"))})
