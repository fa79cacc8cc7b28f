"""Filters of the document catalogue, as conditions on columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Statuses of a document under way.
PROCESSING = ("VALIDATING", "SPLITTING", "OCR_PROCESSING", "CLEANING", "GENERATING")


def owned(user: Column | str, owner: str = "user_id", deleted: str = "deleted_at") -> Column:
    """Rows of one owner that aren't deleted."""
    return (F.col(owner) == (user if isinstance(user, Column) else F.lit(user))) & F.col(deleted).isNull()


def trashed(deleted: str = "deleted_at") -> Column:
    return F.col(deleted).isNotNull()


def in_folder(folder: str | None, column: str = "folder_id") -> Column:
    """Rows of a folder; "root" stands for no folder, None for any."""
    if folder is None:
        return F.lit(True)
    return F.col(column).isNull() if folder == "root" else F.col(column) == folder


def escaped(text: str) -> str:
    """A LIKE pattern part that matches only itself."""
    return text.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")


def contains_any(text: str, columns: Sequence[str], raw: bool = False) -> Column:
    """Any of the columns contains the text, whatever the case. raw: % and _ in it are wildcards."""
    pattern = f"%{text if raw else escaped(text)}%"
    out = F.lit(False)
    for c in columns:
        out = out | F.coalesce(F.col(c).ilike(pattern), F.lit(False))
    return out


def same_text(a: str, b: str) -> Column:
    """Equal but for case."""
    return F.lower(a) == F.lower(b)


def listed(column: str, values: Sequence) -> Column:
    return F.col(column).isin(list(values))


def within(column: str, low=None, high=None, high_inclusive: bool = True) -> Column:
    """low <= column <= high, or < high; a bound that is None doesn't bind."""
    out = F.lit(True)
    if low is not None:
        out = out & (F.col(column) >= low)
    if high is not None:
        out = out & ((F.col(column) <= high) if high_inclusive else (F.col(column) < high))
    return out


def due(now: Column, retry_at: str = "next_retry_at", attempts: str = "attempts", most: int = 3) -> Column:
    """Not delivered too often, and its time has come or none is set."""
    return (F.col(attempts) < most) & (F.col(retry_at).isNull() | (F.col(retry_at) <= now))


def stuck_documents(now: Column, minutes: int = 30, status: str = "status", updated: str = "updated_at") -> Column:
    return F.col(status).isin(*PROCESSING) & (F.col(updated) < now - F.expr(f"interval {minutes} minutes"))


def reenqueue_candidates(now: Column, code: str, seconds: int = 60) -> Column:
    return (F.col("status") == "FAILED") & (F.col("error_code") == code) & (F.col("updated_at") >= now - F.expr(f"interval {seconds} seconds"))


def stuck_jobs(jobs: DataFrame, timeouts: DataFrame, now: Column, factor: int = 2) -> DataFrame:
    """Active jobs that run longer than ``factor`` times their queue's timeout (queue, timeout_ms: a few rows)."""
    age = (F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("locked_at").cast("timestamp"))) / 1000
    return jobs.where("status = 'reserved'").join(F.broadcast(timeouts), "queue").withColumn("age_ms", age.cast("long")).where(F.col("age_ms") > factor * F.col("timeout_ms"))


def can_requeue(status: str = "status") -> Column:
    return F.col(status).isin("FAILED", "UPLOADED")


def share_outcome(now: Column, found: str = "document_id", deleted: str = "deleted_at", status: str = "status", expires: str = "expires_at") -> Column:
    """HTTP-like outcome of opening a shared document, in the order in which it is decided."""
    return (
        F.when(F.col(found).isNull(), 404)
        .when(F.col(deleted).isNotNull(), 404)
        .when(F.coalesce(F.col(status), F.lit("")) != "COMPLETED", 404)
        .when(F.col(expires).isNotNull() & (F.col(expires) < now), 410)
        .otherwise(200)
    )


def missing(requested: DataFrame, existing: DataFrame, key: str) -> DataFrame:
    """Requested keys that don't exist."""
    return requested.join(existing.select(key), key, "left_anti")


def require_all(requested: DataFrame, existing: DataFrame, key: str) -> DataFrame:
    """``requested``; running it fails with a message if a key doesn't exist."""
    known = existing.select(F.col(key), F.lit(True).alias("__qs_known")).distinct()
    checked = requested.join(known, key, "left")
    return checked.withColumn(key, F.when(F.col("__qs_known"), F.col(key)).otherwise(F.raise_error(F.concat(F.lit("not found: "), F.col(key).cast("string"))).cast(requested.schema[key].dataType))).drop("__qs_known")


def check_batch(values: Sequence, most: int = 50) -> Sequence:
    """A request of 1 to ``most`` distinct values, or an error."""
    if not 1 <= len(values) <= most:
        raise ValueError(f"between 1 and {most} values can be given")
    return values


def batch_errors(requests: DataFrame, keys: Sequence[str], value: str, most: int = 50) -> DataFrame:
    """(keys, n, error): distinct values that each request names, and why it is refused: EMPTY, TOO_MANY, or null if it isn't."""
    counted = requests.groupBy(*keys).agg(F.count_distinct(value).alias("n"))
    return counted.withColumn("error", F.when(F.col("n") < 1, "EMPTY").when(F.col("n") > most, "TOO_MANY"))
