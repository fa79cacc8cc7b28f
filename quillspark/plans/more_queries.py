"""Queries of validation, modes, expiries, providers and ordered references."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.functions import ir, labels
from quillspark.functions.dialect import DUCK, SPARK
from quillspark.operators import relations as R
from quillspark.operators import validation as V
from quillspark.operators.numbering import number_within
from quillspark.plans.registry import pick, query, read
from quillspark.sources import exports as E


def _tags(d):
    return f"case when event_id % 5 = 0 then ' ' else event_type || repeat('x', (event_id % 60)::int) end" if d.duck else "case when event_id % 5 = 0 then ' ' else concat(event_type, repeat('x', cast(event_id % 60 as int))) end"


_COLORS = ["#16A34A", "#abcdef", "16A34A", "#12345", "#GGGGGG"]


@query(
    f"""select event_id, array_to_string(list_filter([case when length(trim(n)) = 0 then 'NAME_EMPTY' end, case when length(trim(n)) > 50 then 'NAME_LONG' end, case when not regexp_matches(c, '^#[0-9A-Fa-f]{{6}}\\z') then 'COLOR' end], lambda x: x is not null), ',') as errors
    from (select event_id, {_tags(DUCK)} as n, {pick(DUCK, _COLORS, 'event_id')} as c from events)"""
)
def tag_validation(spark, sf_dir):
    e = read(spark, sf_dir, "events").select("event_id", F.expr(_tags(SPARK)).alias("n"), F.expr(pick(SPARK, _COLORS, "event_id")).alias("c"))
    return e.select("event_id", F.array_join(V.tag_errors("n", "c"), ",").alias("errors"))


_MAILS, _WORDS = ["a@b.cd", "a@b", "a b@c.de", "", "x@y.z.org"], ["Secret12", "secret12", "SECRET12", "Secret", "Secretary"]


@query(
    f"""select event_id, array_to_string(list_filter([case when not regexp_matches(m, '^[^@\\s]+@[^@\\s]+\\.[^@\\s]+\\z') then 'EMAIL' end, case when length(p) < 8 then 'PASSWORD_SHORT' end, case when not regexp_matches(p, '[A-Z]') then 'PASSWORD_0' end,
    case when not regexp_matches(p, '[a-z]') then 'PASSWORD_1' end, case when not regexp_matches(p, '[0-9]') then 'PASSWORD_2' end], lambda x: x is not null), ',') as errors from (select event_id, {pick(DUCK, _MAILS, 'event_id')} as m, {pick(DUCK, _WORDS, 'user_id')} as p from events)"""
)
def account_validation(spark, sf_dir):
    e = read(spark, sf_dir, "events").select("event_id", F.expr(pick(SPARK, _MAILS, "event_id")).alias("m"), F.expr(pick(SPARK, _WORDS, "user_id")).alias("p"))
    return e.select("event_id", F.array_join(V.account_errors("m", "p"), ",").alias("errors"))


@query("select doc_id, 0 as n from documents")
def block_validation(spark, sf_dir):
    """Blocks that the parser makes break no rule."""
    return ir.with_blocks(read(spark, sf_dir, "documents")).select("doc_id", V.block_errors().alias("n"))


@query(" union all ".join(f"select '{m}' as mode, count(*) as n from documents where {c}" for m, c in (("title", "lang ilike '%en%'"), ("folder", "source ilike '%en%'"), ("content", "lang ilike '%en%' or source ilike '%en%' or text ilike '%en%'"), ("all", "lang ilike '%en%' or source ilike '%en%' or text ilike '%en%'"))))
def search_modes(spark, sf_dir):
    docs, out = read(spark, sf_dir, "documents"), None
    for mode in ("title", "folder", "content", "all"):
        one = docs.where(V.search_condition("en", mode, "lang", "source", "text")).agg(F.lit(mode).alias("mode"), F.count("*").alias("n"))
        out = one if out is None else out.union(one)
    return out


@query(f"select event_id, case o when '7d' then ts + interval 7 day when '30d' then ts + interval 30 day end as expires from (select *, {pick(DUCK, ['never', '7d', '30d'], 'event_id')} as o from events)")
def share_expiries(spark, sf_dir):
    return read(spark, sf_dir, "events").select("event_id", V.expiry(F.expr(pick(SPARK, ["never", "7d", "30d"], "event_id")), F.col("ts")).alias("expires"))


@query(
    """select provider, place, score from (select *, row_number() over (order by score desc, provider) as place from (
    select event_type as provider, case when event_type = 'error' then '-Infinity'::double else greatest(0::double, avg((event_id % 3 <> 0)::int) * (1 - least(floor(avg(value * 100) + 0.5) / 10000.0, 1.0)) - 0.1 * (count(*) % 3)) end as score from events group by 1))"""
)
def provider_order(spark, sf_dir):
    e = read(spark, sf_dir, "events").groupBy(F.col("event_type").alias("provider")).agg(
        F.avg((F.col("event_id") % 3 != 0).cast("double")).alias("success_rate"), F.floor(F.avg(F.col("value") * 100) + 0.5).alias("mean_latency_ms"), (F.count("*") % 3).alias("failures")
    )
    return V.provider_order(e.withColumn("state", F.when(F.col("provider") == "error", "open").otherwise("healthy"))).select("provider", "place", "score")


@query("select conv_id, turn from conversations where turn in (0, 2, 3)")
def page_selection(spark, sf_dir):
    turns = read(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("number"))
    wanted = turns.select("conv_id").distinct().select("conv_id", F.transform(F.expr(labels.page_range(SPARK, "'1,3-4,9'", "8")), lambda n: n - 1).alias("wanted"))
    return V.select_pages(turns, wanted, "conv_id").select("conv_id", F.col("number").alias("turn"))


#: Steps of a journey; a longer list goes on in the next part.
PART = 100


@query(
    f"""select source, part, count(*) as n_docs, sum(n_chars)::bigint as reading, string_agg(doc_id::varchar, ',' order by place) as steps from (
    select *, (place - 1) // {PART} as part from (select source, doc_id, n_chars, row_number() over (partition by source order by n_chars, doc_id) as place from documents)) group by 1, 2"""
)
def journeys(spark, sf_dir):
    """All documents of each source as ordered lists, in parts of fixed length so that no row gathers a source."""
    docs = read(spark, sf_dir, "documents").select("source", "doc_id", "n_chars")
    placed = number_within(docs, ["source"], ["n_chars", "doc_id"], "place").withColumn("part", F.floor(F.col("place") / PART))
    lists = placed.groupBy(F.struct("source", "part").alias("journey")).agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "doc_id"))), lambda s: s["doc_id"]).alias("steps"))
    steps = R.expand_references(lists, "journey", "steps").join(docs.select(F.col("doc_id").alias("reference"), "n_chars"), "reference")
    ordered = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "reference"))), lambda s: s["reference"].cast("string")), ",")
    rolled = steps.groupBy("journey").agg(F.count("*").alias("n_docs"), F.sum("n_chars").alias("reading"), ordered.alias("steps"))
    return rolled.select("journey.source", "journey.part", "n_docs", "reading", "steps")


@query("select o_custkey, max_by(o_orderkey, (o_orderdate, o_orderkey)) as latest from orders group by 1")
def latest_job(spark, sf_dir):
    return read(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("latest"))


@query("select l.o_orderkey, d.doc_id from orders l join documents d on l.o_orderkey = d.doc_id where l.o_orderstatus = 'O'")
def share_links(spark, sf_dir):
    links = read(spark, sf_dir, "orders").where("o_orderstatus = 'O'").select("o_orderkey")
    return links.join(read(spark, sf_dir, "documents").select("doc_id"), F.col("o_orderkey") == F.col("doc_id"))


@query("select doc_id, coalesce((n_chars % 100) / 100.0, 0.5) < 0.65 as needs_review from documents")
def needs_review(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", (F.coalesce((F.col("n_chars") % 100) / F.lit(100.0), F.lit(0.5)) < 0.65).alias("needs_review"))


@query("select doc_id, lang, n_chars from documents")
def json_envelopes(spark, sf_dir):
    """The JSON of an export, read back."""
    made = read(spark, sf_dir, "documents").select("doc_id", E.envelope(["lang", "n_chars", "source"]).alias("j"))
    return made.select("doc_id", F.get_json_object("j", "$.lang").alias("lang"), F.get_json_object("j", "$.n_chars").cast("long").alias("n_chars"))


@query("select source, printf('%.1f', 100.0 * count(*) filter (where lang = 'en') / count(*)) as percent from documents group by 1")
def percentages(spark, sf_dir):
    share = F.count(F.when(F.col("lang") == "en", 1)) * F.lit(100.0) / F.count("*")
    return read(spark, sf_dir, "documents").groupBy("source").agg(F.format_string("%.1f", share.cast("double")).alias("percent"))


@query("select n_name from nation order by n_name")
def sorted_names(spark, sf_dir):
    return read(spark, sf_dir, "nation").select("n_name").orderBy("n_name")
