"""Operator 6, sharding: a Feistel permutation of global row numbers gives every row its shard and slot."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm._common import table, text_or_empty, without
from quillspark.llm.feistel import network_sql, permute
from quillspark.operators.numbering import number_rows

RESULT = ("size", "text_crc32", "law", "shard", "slot", "grown_shard")


SHARDS, KEY = 8, 20240


def shard_rows(docs: DataFrame, shards: int = SHARDS, key: int = KEY, id_column: str = "doc_id", text_column: str = "text", columns: list[str] | None = None) -> DataFrame:
    """Every row with ``shard``, ``slot``, ``size``, ``text_crc32``, ``law`` and ``grown_shard``; DataFrame operations only.

    Rows are numbered in the order of (id, CRC and size of the text); place =
    permutation(number); shard = place mod ``shards``, slot = place div
    ``shards``. So counts of shards differ by one at most (law "rows"), slots
    have no gaps from 0, and anyone who knows n and ``key`` can compute where a
    row number lies. Equal texts, however many, spread over all shards like
    any other rows.

    Null ids are numbered first; a null text has size 1 and the CRC of no bytes,
    as an empty one. Rows that are equal in id and text are interchangeable.
    An empty table gives an empty result. Columns of ``docs`` with the name of
    a result column are replaced; ``columns`` limits what else is carried.
    """
    kept = without(docs.select(*[f"`{c}`" for c in columns]) if columns is not None else docs, RESULT)
    text = text_or_empty(text_column)
    source = docs.select(
        *[F.col(f"`{c}`") for c in kept],
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
    )
    rows, n = number_rows(source, [F.col(f"`{id_column}`").asc_nulls_first(), F.col("text_crc32"), F.col("size")], "__qs_row")
    placed = permute(rows, "__qs_row", "__qs_at", max(n, 1), key)
    return placed.select(
        *[F.col(f"`{c}`") for c in kept],
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        F.expr(f"cast(__qs_at % {shards}L as int)").alias("shard"),
        F.expr(f"__qs_at div {shards}L").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op6_sharding(spark, sf_dir):
    return shard_rows(table(spark, sf_dir, "documents"), columns=["doc_id"])


#: CRC-32, bit by bit for the 256 bytes, then byte by byte over a text.
_CRC = "list_reduce([4294967295::bigint] || list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda x: ('0x' || x)::bigint), lambda c, b: xor(c >> 8, crc[(xor(c, b) & 255) + 1]))"
OP6_SQL = f"""
with recursive bits as (select i::bigint as i, i::bigint as v, 0 as step from range(256) x(i) union all select i, xor(v >> 1, case when v & 1 = 1 then 3988292384 else 0 end), step + 1 from bits where step < 8),
crcs as (select list(v order by i) as crc from bits where step = 8),
t as (select doc_id, (strlen(text) + 1)::bigint as size, xor({_CRC}, 4294967295) as text_crc32 from (select doc_id, coalesce(text, '') as text from documents), crcs),
c as (select count(*) as n, greatest(1, ceil(sqrt(count(*))))::bigint as a from t),
s as (select *, row_number() over (order by doc_id nulls first, text_crc32, size) - 1 as number from t),
w as (select number, number as x, 0 as step from s union all select number, {network_sql("x", KEY)}, 1 from w, c where step = 0 or x >= n)
select doc_id, size, text_crc32, 'rows' as law, (x % {SHARDS})::int as shard, (x // {SHARDS})::bigint as slot, null::int as grown_shard from s join w using (number), c where step = 1 and x < n
"""
