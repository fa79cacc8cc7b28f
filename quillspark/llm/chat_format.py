"""Operator 8, chat formatting: preference pairs with their common turns rendered once as prompt, and masked completions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.llm._common import field, materialize, table
from quillspark.operators.numbering import number_rows

#: How a turn is rendered; the loss covers the text and the end mark of the assistant's turns.
TEMPLATE = ("<|", "|>\n", "<|end|>\n")
TRAINED_ROLE = "assistant"


def gather_turns(conversations: DataFrame) -> DataFrame:
    """conv_id and its turns, an array of (turn, role, text) in this order. Null roles and texts are read as empty, null turns come
    first, turns with equal numbers are ordered by role and text; repeated rows are repeated turns. A conversation is one row of what
    this operator makes (its texts are strings), so a task holds its turns: memory follows the longest conversation."""
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return conversations.select("conv_id", turn.alias("t")).groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))


def neighbour_pairs(turns: DataFrame) -> DataFrame:
    """(pair_id, chosen_id, rejected_id): conversations in the order of (MD5 of the opening turn's role and text, conv_id) are
    paired two by two, so those that open alike stand together; the earlier is taken as chosen. The last one of an odd number
    has no rejected partner (null). A conversation without id is one too, and first among equals. ``turns``: of :func:`gather_turns`."""
    opening = F.expr("concat(turns[0].role, '\n', turns[0].text)")
    keyed = turns.select("conv_id", F.md5(F.encode(opening, "UTF-8")).alias("k"))
    rows, _ = number_rows(keyed, [F.col("k"), F.col("conv_id").asc_nulls_first()], "n")
    side = F.col("n") % 2
    one = lambda s: F.max(F.when(side == s, F.struct("conv_id")))  # noqa: E731  a struct, so that an id that is null differs from none
    made = rows.groupBy(F.expr("n div 2L").alias("pair_id")).agg(one(0).alias("c"), one(1).alias("r"))
    return made.select("pair_id", F.col("c.conv_id").alias("chosen_id"), F.col("r.conv_id").alias("rejected_id"), F.col("r").isNotNull().alias("paired"))


def _common(a: str, b: str) -> Column:
    """How many turns from the first on are equal in role and text."""
    least = f"least(size({a}), size({b}))"
    differ = f"filter(sequence(0, {least}), i -> i = {least} or {a}[i].role <> {b}[i].role or {a}[i].text <> {b}[i].text)"
    return F.expr(f"{differ}[0]")


def _segments(turns: str, start: str) -> Column:
    """The turns from ``start`` on as (text, train): headers are not trained on, bodies are if they are the assistant's."""
    head, mid, end = (p.replace("\n", "\\n") for p in TEMPLATE)
    return F.expr(
        f"flatten(transform(slice({turns}, {start} + 1, greatest(size({turns}) - {start}, 0)), t -> array("
        f"named_struct('text', concat('{head}', t.role, '{mid}'), 'train', false),"
        f"named_struct('text', concat(t.text, '{end}'), 'train', t.role = '{TRAINED_ROLE}'))))"
    )


def _rendered(segments: str) -> Column:
    return F.expr(f"array_join(transform({segments}, s -> s.text), '')")


@F.pandas_udf(T.ArrayType(T.StructType([field("start", T.IntegerType()), field("end", T.IntegerType())])))
def _masks(lengths: pd.Series, trained: pd.Series) -> pd.Series:
    """Half-open character spans of completions that the loss covers, from the lengths of their segments: running sums, which array
    functions would take anew for every segment."""

    def one(sizes, train):
        ends = np.cumsum(sizes)
        return [{"start": int(e - n), "end": int(e)} for e, n, t in zip(ends, sizes, train) if t]

    return pd.Series([one(a, b) for a, b in zip(lengths, trained)], dtype=object)


def format_pairs(pairs: DataFrame, conversations: DataFrame) -> DataFrame:
    """:func:`format_gathered` of conversations (conv_id, turn, role, text)."""
    return format_gathered(pairs, gather_turns(conversations))


def format_gathered(pairs: DataFrame, turns: DataFrame) -> DataFrame:
    """For each row of ``pairs`` (pair_id, chosen_id, rejected_id): n_common, prompt, chosen, rejected, chosen_mask, rejected_mask.

    The prompt is the longest common prefix of the two conversations, in whole turns equal in role and text, rendered once; the
    completions are the rest of each, with the character spans that the loss covers (the assistant's texts and end marks; nothing
    else). Equal conversations leave empty completions. An id that has no turns is an empty conversation: nothing is
    common and its completion is empty. A null id is that of the turns without id, if there are such; where ``pairs`` has a column
    ``paired`` and it is false, the rejected side is empty instead. Only the columns named are read, so others cannot clash.
    """
    side = lambda name: turns.select(F.col("conv_id").alias(f"__qs_{name}"), F.col("turns").alias(f"{name}_turns"))
    there = F.col("paired") if "paired" in pairs.columns else F.lit(True)
    wanted = pairs.select("pair_id", "chosen_id", "rejected_id", there.alias("there"))
    both = wanted.join(side("chosen"), F.col("chosen_id").eqNullSafe(F.col("__qs_chosen")), "left").join(side("rejected"), F.col("rejected_id").eqNullSafe(F.col("__qs_rejected")) & F.col("there"), "left")
    empty = F.expr(f"cast(array() as {turns.schema['turns'].dataType.simpleString()})")
    both = both.withColumns({f"{s}_turns": F.coalesce(f"{s}_turns", empty) for s in ("chosen", "rejected")})
    both = both.withColumn("n_common", _common("chosen_turns", "rejected_turns"))
    both = both.withColumns({
        "p": _segments("slice(chosen_turns, 1, n_common)", "0"),
        "c": _segments("chosen_turns", "n_common"),
        "r": _segments("rejected_turns", "n_common"),
    })
    return both.select(
        "pair_id", "chosen_id", "rejected_id", "n_common",
        _rendered("p").alias("prompt"), _rendered("c").alias("chosen"), _rendered("r").alias("rejected"),
        *[_masks(F.expr(f"transform({v}, s -> length(s.text))"), F.expr(f"transform({v}, s -> s.train)")).alias(f"{n}_mask") for n, v in (("chosen", "c"), ("rejected", "r"))],
    )


def op8_chat_format(spark, sf_dir):
    conversations = table(spark, sf_dir, "conversations")
    covered = lambda m: F.expr(f"aggregate({m}, 0L, (n, s) -> n + s.end - s.start)")
    turns = materialize(gather_turns(conversations), "turns")
    made = format_gathered(neighbour_pairs(turns), turns)
    return made.select(
        "pair_id", "chosen_id", "rejected_id", F.col("n_common").cast("long").alias("n_common"),
        *[F.sha2(F.encode(c, "UTF-8"), 256).alias(f"{c}_sha256") for c in ("prompt", "chosen", "rejected")],
        covered("chosen_mask").alias("chosen_trained"), covered("rejected_mask").alias("rejected_trained"),
    )


OP8_SQL = """
with t as (select conv_id, list(struct_pack(turn := turn, role := coalesce(role, ''), text := coalesce(text, '')) order by turn nulls first, coalesce(role, ''), coalesce(text, '')) as turns
           from conversations group by conv_id),
n as (select conv_id, turns, row_number() over (order by md5(turns[1].role || chr(10) || turns[1].text), conv_id nulls first) - 1 as n from t),
p as (select n // 2 as pair_id, max(case when n % 2 = 0 then conv_id end) as chosen_id, max(case when n % 2 = 1 then conv_id end) as rejected_id, count(*) as k from n group by 1),
b as (select pair_id, chosen_id, rejected_id, coalesce(c.turns, []) as c, coalesce(r.turns, []) as r from p left join t c on chosen_id is not distinct from c.conv_id left join t r on rejected_id is not distinct from r.conv_id and k = 2),
m as (select *, list_min(list_filter(range(0, least(len(c), len(r)) + 1), lambda i: i = least(len(c), len(r)) or c[i + 1].role <> r[i + 1].role or c[i + 1].text <> r[i + 1].text)) as k from b),
s as (select *, c[1:k] as pt, c[k + 1:] as ct, r[k + 1:] as rt from m)
select pair_id::bigint as pair_id, chosen_id, rejected_id, k::bigint as n_common,
  sha256(coalesce(list_aggregate(list_transform(pt, lambda t: '<|' || t.role || '|>' || chr(10) || t.text || '<|end|>' || chr(10)), 'string_agg', ''), '')) as prompt_sha256,
  sha256(coalesce(list_aggregate(list_transform(ct, lambda t: '<|' || t.role || '|>' || chr(10) || t.text || '<|end|>' || chr(10)), 'string_agg', ''), '')) as chosen_sha256,
  sha256(coalesce(list_aggregate(list_transform(rt, lambda t: '<|' || t.role || '|>' || chr(10) || t.text || '<|end|>' || chr(10)), 'string_agg', ''), '')) as rejected_sha256,
  coalesce(list_sum(list_transform(ct, lambda t: case when t.role = 'assistant' then length(t.text) + 8 else 0 end)), 0)::bigint as chosen_trained,
  coalesce(list_sum(list_transform(rt, lambda t: case when t.role = 'assistant' then length(t.text) + 8 else 0 end)), 0)::bigint as rejected_trained
from s
"""
