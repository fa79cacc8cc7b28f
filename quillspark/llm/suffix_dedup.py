"""Operator 3, suffix-array deduplication of bytes by column-wise multi-document construction.

Whole documents can't be built column by column: a text of 100,000 bytes would
take 100,000 rounds over the collection. So the collection consists of the
contexts of repeated anchors (see ``repeats``): strings of at most 336 bytes
that hold every 200-byte string which could repeat, one for each distinct
context. The construction on them is in ``column_bwt``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm import column_bwt
from quillspark.llm._common import table
from quillspark.llm.repeats import Unit, strip

LENGTH = 200
#: Bytes of an anchor. Shorter ones repeat by chance, longer ones are denser.
ANCHOR = 64


def remove_repeats(docs: DataFrame, length: int = LENGTH, id_column: str = "doc_id", text_column: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` (or its columns ``keep``) with n_symbols (bytes), n_removed, n_spans (maximal removed runs) and kept (binary).

    Removed is each byte covered by a string of ``length`` bytes that also starts anywhere else, in the same or another row;
    overlapping places count, strings never cross rows, and all is judged on the input. So all copies go, the first included, and
    repeated rows are copies. Texts are UTF-8; what is kept may split a character, so it is binary. A null text is an empty one:
    no bytes, nothing kept. Null ids are ids like others. Columns named as a result column are replaced. An empty table gives an
    empty result.
    """
    k = min(ANCHOR, max(1, length // 3))

    def decide(groups, lefts, contexts, weights, k):
        return column_bwt.decide(groups, lefts, contexts, weights, k, length)

    return strip(docs, Unit(False, length, k), decide, id_column, text_column, keep)


def op3_suffix_dedup(spark, sf_dir):
    made = remove_repeats(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return made.select("doc_id", F.col("n_symbols").alias("n_bytes"), "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


OP3_SQL = f"""
with t as (select row_number() over () as r, doc_id, hex(encode(coalesce(text, ''))) as h from documents),
p as (select r, p, substring(h, p * 2000 + 1, {2 * (999 + LENGTH)}) as part from (select r, h, unnest(range(0, length(h) // 2000 + 1)) as p from t)),
o as (select r, p, part, unnest(range(0, least(1000, length(part) // 2 - {LENGTH - 1}))) as o from p where length(part) >= {2 * LENGTH}),
g as (select r, p * 1000 + o as i, md5(substring(part, 2 * o + 1, {2 * LENGTH})) as w from o),
d as (select r, i from (select r, i, count(*) over (partition by w) as n from g) where n > 1),
s as (select r, i, case when i - lag(i) over (partition by r order by i) <= {LENGTH} then 0 else 1 end as fresh from d),
k as (select r, i, sum(fresh) over (partition by r order by i) as span from s),
c as (select r, min(i) as a, max(i) + {LENGTH} as b from k group by r, span),
x as (select r, sum(b - a)::bigint as n_removed, count(*) as n_spans, list(a order by a) as starts, list(b order by a) as ends from c group by r)
select doc_id, (length(h) // 2)::bigint as n_bytes, coalesce(n_removed, 0)::bigint as n_removed, coalesce(n_spans, 0)::bigint as n_spans,
  sha256(unhex(case when n_spans is null then h else array_to_string(list_transform(range(0, n_spans + 1), lambda p:
    substring(h, case when p = 0 then 0 else 2 * ends[p] end + 1, case when p = n_spans then length(h) else 2 * starts[p + 1] end - case when p = 0 then 0 else 2 * ends[p] end)), '') end)) as kept_sha256
from t left join x on t.r = x.r
"""
