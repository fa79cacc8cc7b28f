"""Inputs as columns of checks, searches by mode, expiries, provider order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions.labels import provider_score
from quillspark.operators.predicates import contains_any

#: Lengths and patterns of inputs.
TAG_NAME, COLOR = 50, r"^#[0-9A-Fa-f]{6}\z"
EMAIL = r"^[^@\s]+@[^@\s]+\.[^@\s]+\z"
PASSWORD = (8, "[A-Z]", "[a-z]", "[0-9]")
#: Days that a share link lives, by option.
EXPIRY_DAYS = (("7d", 7), ("30d", 30))
BLOCK_TYPES = ("heading", "paragraph", "list", "code-block")


def tag_errors(name: str, color: str) -> Column:
    """What is wrong with a tag: an array of codes, empty if nothing is."""
    trimmed = F.trim(F.col(name))
    checks = {"NAME_EMPTY": F.coalesce(F.length(trimmed), F.lit(0)) == 0, "NAME_LONG": F.length(trimmed) > TAG_NAME, "COLOR": ~F.coalesce(F.col(color).rlike(COLOR), F.lit(False))}
    return _codes(checks)


def account_errors(email: str, password: str) -> Column:
    least, *classes = PASSWORD
    checks = {"EMAIL": ~F.coalesce(F.col(email).rlike(EMAIL), F.lit(False)), "PASSWORD_SHORT": F.coalesce(F.length(password), F.lit(0)) < least}
    checks |= {f"PASSWORD_{i}": ~F.coalesce(F.col(password).rlike(c), F.lit(False)) for i, c in enumerate(classes)}
    return _codes(checks)


def _codes(checks: dict[str, Column]) -> Column:
    return F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in checks.items()]), lambda x: x.isNotNull())


def block_errors(blocks: str = "blocks") -> Column:
    """How many blocks break the schema: an unknown type, a heading's level out of 1..6, a list without items."""
    bad = f"b.type not in {BLOCK_TYPES} or (b.type = 'heading' and not coalesce(b.level between 1 and 6, false)) or (b.type = 'list' and coalesce(size(b.items), 0) = 0)"
    return F.expr(f"size(filter({blocks}, b -> {bad}))")


def search_condition(query: str, mode: str, title: str, folder: str, content: str) -> Column:
    """What a search by mode looks in: title, folder, or (content and all alike) everything."""
    columns = {"title": [title], "folder": [folder], "content": [title, folder, content], "all": [title, folder, content]}
    if mode not in columns:
        raise ValueError(f"mode must be one of {sorted(columns)}")
    return contains_any(query, columns[mode])


def expiry(option: Column, created: Column) -> Column:
    """When a link expires by option; null for never."""
    out = F.when(F.lit(False), created)
    for name, days in EXPIRY_DAYS:
        out = out.when(option == name, created + F.expr(f"interval {days} days"))
    return out


def provider_order(health: DataFrame) -> DataFrame:
    """Providers (success_rate, mean_latency_ms, failures, state) best first, with score and place; open breakers come last."""
    scored = health.withColumn("score", F.expr(provider_score("success_rate", "mean_latency_ms", "failures", "state")))
    return scored.withColumn("place", F.row_number().over(Window.orderBy(F.col("score").desc(), "provider")).cast("long"))  # a row for each provider: a handful


def select_pages(pages: DataFrame, ranges: DataFrame, key: str) -> DataFrame:
    """The pages (key, number) that each key's range (key, wanted: array) names."""
    wanted = ranges.select(key, F.explode("wanted").alias("number"))
    return pages.join(wanted, [key, "number"], "left_semi")
