"""A keyed Feistel permutation of 0..n-1 with cycle walking, as column expressions, with numpy for tests and set-up.

The network works on pairs of digits in base a = ceil(sqrt(n)), so its domain
a * a exceeds n by 2 * sqrt(n) at most. Values outside are permuted again until
they fall inside (cycle walking). How often that can be needed is computed
exactly, by walking the at most 2 * sqrt(n) outside values once, so that the walk is a
fixed chain of expressions: no loop and no user-defined function runs on rows.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROUNDS = 4
_M1, _M2 = 0x9E3779B1, 0x85EBCA6B
_LOW31 = (1 << 31) - 1


def round_keys(key: int) -> list[int]:
    """32-bit keys of the rounds, drawn from ``key``."""
    out, x = [], key & (2**64 - 1)
    for _ in range(ROUNDS):
        x = (x + 0x9E3779B97F4A7C15) & (2**64 - 1)
        z = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & (2**64 - 1)
        z = (z ^ (z >> 27)) * 0x94D049BB133111EB & (2**64 - 1)
        out.append((z ^ (z >> 31)) & 0xFFFFFFFF)
    return out


def base_of(n: int) -> int:
    a = math.isqrt(n)
    a = max(1, a if a * a >= n else a + 1)
    if a > _LOW31:
        raise ValueError("at most 2**62 rows can be permuted")
    return a


def _network_np(x: np.ndarray, a: int, keys: list[int]) -> np.ndarray:
    left, right = x // a, x % a
    for k in keys:
        v = right * np.int64(_M1) + np.int64(k)
        v ^= v >> 29
        v = (v & np.int64(_LOW31)) * np.int64(_M2)
        v ^= v >> 32
        left, right = right, (left + v % a) % a
    return left * a + right


def permute_np(x, n: int, key: int) -> np.ndarray:
    """The permutation on an array: the same as :func:`permute` on a column."""
    a, keys = base_of(n), round_keys(key)
    out = _network_np(np.asarray(x, dtype=np.int64), a, keys)
    while (outside := out >= n).any():
        out[outside] = _network_np(out[outside], a, keys)
    return out


def walk_length(n: int, key: int) -> int:
    """The most times that a place has to be permuted again before it is below n.

    Only walks that come from below n count: they start at outside values that no outside value leads to, and end below n.
    Cycles among outside values, if there are any, are never entered.
    """
    a, keys = base_of(n), round_keys(key)
    outside = np.arange(n, a * a, dtype=np.int64)
    x, steps = np.setdiff1d(outside, _network_np(outside, a, keys)), 0
    while len(x):
        x = _network_np(x, a, keys)
        x, steps = x[x >= n], steps + 1
    return steps


def _pass(df: DataFrame, source: str, target: str, a: int, keys: list[int]) -> DataFrame:
    """One pass of the network; every step is a named column, so that none is computed twice."""
    df = df.withColumns({"__qs_l": F.expr(f"{source} div {a}L"), "__qs_r": F.expr(f"{source} % {a}L")})
    for k in keys:
        df = df.withColumn("__qs_u", F.expr(f"__qs_r * {_M1}L + {k}L"))
        df = df.withColumn("__qs_v", F.expr(f"((__qs_u ^ shiftright(__qs_u, 29)) & {_LOW31}L) * {_M2}L"))
        df = df.withColumns({"__qs_l": F.col("__qs_r"), "__qs_r": F.expr(f"(__qs_l + (__qs_v ^ shiftright(__qs_v, 32)) % {a}L) % {a}L")})
    return df.withColumn(target, F.expr(f"__qs_l * {a}L + __qs_r")).drop("__qs_l", "__qs_r", "__qs_u", "__qs_v")


def permute(df: DataFrame, source: str, target: str, n: int, key: int) -> DataFrame:
    """``df`` with column ``target``: the place in 0..n-1 of the row number in column ``source``."""
    a, keys = base_of(n), round_keys(key)
    df = _pass(df, source, target, a, keys)
    for _ in range(walk_length(n, key)):
        df = _pass(df, target, "__qs_again", a, keys)
        df = df.withColumn(target, F.when(F.col(target) >= n, F.col("__qs_again")).otherwise(F.col(target))).drop("__qs_again")
    # Through a generator, because a filter on the result would else be pushed below, with the whole network written out in it several times over.
    return df.withColumn("__qs_place", F.col(target)).drop(target).select("*", F.explode(F.array("__qs_place")).alias(target)).drop("__qs_place")


def network_sql(x: str, key: int) -> str:
    """One pass of the network on a number, as DuckDB's SQL; ``a`` names the base. Oracles walk with it in a recursive query."""
    let = lambda value, name, body: f"list_transform([{value}], lambda {name}: {body})[1]"
    out = "l{0} * a + r{0}".format(ROUNDS)
    for i, k in reversed(list(enumerate(round_keys(key)))):
        mixed = let(f"r{i} * {_M1} + {k}", f"u{i}", let(f"(xor(u{i}, u{i} >> 29) & {_LOW31}) * {_M2}", f"v{i}", f"xor(v{i}, v{i} >> 32)"))
        out = let(f"(l{i} + {mixed} % a) % a", f"r{i + 1}", let(f"r{i}", f"l{i + 1}", out))
    return let(f"{x} // a", "l0", let(f"{x} % a", "r0", out))
