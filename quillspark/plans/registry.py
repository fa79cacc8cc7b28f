"""Where queries and their oracles are collected."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillspark.functions.dialect import Dialect
from quillspark.session import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    """Registers a function under its name, with the oracle's SQL if there is one."""

    def add(fn):
        QUERIES[fn.__name__] = fn
        if oracle is not None:
            ORACLES[fn.__name__] = oracle
        return fn

    return add


read = read_table


def pick(d: Dialect, values, index: str) -> str:
    """One of some strings by a number."""
    items = d.array(*[d.lit(v) for v in values])
    return f"{items}[({index}) % {len(values)} + 1]" if d.duck else f"element_at({items}, cast(({index}) % {len(values)} + 1 as int))"
