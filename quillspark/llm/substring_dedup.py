"""Operator 5, substring deduplication of words: an FM-index for each shard, searched backward by streamed documents.

A shard's index holds the contexts of its repeated anchors (see ``repeats``),
one for each distinct context; the contexts are then streamed against it, and
their matching statistics at weight two, that is matches that stand at two
places at least, give the intervals above the threshold. See ``fm_index``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm import fm_index
from quillspark.llm._common import table
from quillspark.llm.repeats import RESULT, Unit, strip

LENGTH = 35
#: Words of an anchor.
ANCHOR = 6


def remove_repeats(docs: DataFrame, length: int = LENGTH, id_column: str = "doc_id", text_column: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` (or its columns ``keep``) with n_symbols (words), n_removed, n_spans and kept (binary: the words that stay, joined by one space).

    Words are [^\\x20\\x09-\\x0D]+, unchanged. Removed is each word covered by a window of ``length`` words whose sequence also
    starts anywhere else, in the same or another row; windows never cross rows and are judged on the input. So all copies go, the
    first included, and repeated rows are copies. A null text has no words. Null ids are ids like others. Columns named as a
    result column are replaced. An empty table gives an empty result.
    """
    return _strip(docs, length, id_column, text_column, keep, RESULT)


def _strip(docs, length, id_column, text_column, keep, names) -> DataFrame:
    k = min(ANCHOR, max(1, length // 3))

    def decide(groups, lefts, contexts, weights, k):
        return fm_index.decide(lefts, contexts, groups, weights, k, length)

    return strip(docs, Unit(True, length, k), decide, id_column, text_column, keep, names)


def drop_repeats(docs: DataFrame, length: int = LENGTH, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``docs`` with the texts that hold repeated windows replaced by the words that stay; other texts and all columns unchanged."""
    made = _strip(docs, length, id_column, text_column, docs.columns, ("__qs_n", "__qs_removed", "__qs_spans", "__qs_kept"))
    text = F.when(F.col("__qs_removed") > 0, F.decode("__qs_kept", "UTF-8")).otherwise(F.col(f"`{text_column}`"))
    return made.select(*[text.alias(c) if c == text_column else F.col(f"`{c}`") for c in docs.columns])


def op5_substring_dedup(spark, sf_dir):
    made = remove_repeats(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return made.select("doc_id", F.col("n_symbols").alias("n_words"), "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP5_SQL = f"""
with t as (select row_number() over () as r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as w from documents),
i as (select r, w, unnest(range(1, len(w) - {LENGTH} + 2)) as i from t where len(w) >= {LENGTH}),
g as (select r, i, md5(array_to_string(w[i:i + {LENGTH - 1}], ' ')) as h from i),
d as (select r, i from (select r, i, count(*) over (partition by h) as n from g) where n > 1),
x as (select r, list(distinct p) as gone from (select r, unnest(range(i, i + {LENGTH})) as p from d) group by r)
select doc_id, len(w)::bigint as n_words, coalesce(len(gone), 0)::bigint as n_removed,
  sha256(coalesce(array_to_string(case when gone is null then w else list_transform(list_filter(range(1, len(w) + 1), lambda p: not list_contains(gone, p)), lambda p: w[p]) end, ' '), '')) as kept_sha256
from t left join x on t.r = x.r
"""
