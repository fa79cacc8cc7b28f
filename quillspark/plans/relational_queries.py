"""Queries of filters, joins, roll-ups, windows, paging and hierarchy on the star schema, events and documents.

Mapping: documents are the catalogue (source = owner and folder), labels are tags, orders are jobs, events are the audit log,
region, nation and customer are a folder tree.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.operators import aggregates as A
from quillspark.operators import derivations as D
from quillspark.operators import hierarchy as H
from quillspark.operators import predicates as P
from quillspark.operators import relations as R
from quillspark.plans.registry import query, read

# --- scans and filters ---


@query("select doc_id, lang, n_chars from documents")
def scan_projection(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")


@query("select o_orderkey, o_orderstatus, o_totalprice from orders where o_orderkey = 7")
def point_lookup(spark, sf_dir):
    return read(spark, sf_dir, "orders").where("o_orderkey = 7").select("o_orderkey", "o_orderstatus", "o_totalprice")


_OWNED = "select doc_id, source, lang, case when n_chars % 7 = 0 then timestamp '2024-01-01' end as deleted_at, case when lang = 'en' then null else lang end as folder_id from documents"


def _catalogue(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    return docs.select("doc_id", "source", "lang", F.expr("case when n_chars % 7 = 0 then timestamp_ntz '2024-01-01 00:00:00' end").alias("deleted_at"), F.expr("case when lang = 'en' then null else lang end").alias("folder_id"))


@query(f"select doc_id from ({_OWNED}) where source = 'src1' and deleted_at is null")
def owner_live_docs(spark, sf_dir):
    return _catalogue(spark, sf_dir).where(P.owned("src1", "source")).select("doc_id")


@query(f"select doc_id, deleted_at from ({_OWNED}) where deleted_at is not null")
def trash_view(spark, sf_dir):
    return _catalogue(spark, sf_dir).where(P.trashed()).select("doc_id", "deleted_at")


@query(f"select 'root' as folder, count(*) as n from ({_OWNED}) where folder_id is null union all select 'de', count(*) from ({_OWNED}) where folder_id = 'de'")
def folder_scope(spark, sf_dir):
    docs = _catalogue(spark, sf_dir)
    one = lambda f: docs.where(P.in_folder(f)).agg(F.lit(f).alias("folder"), F.count("*").alias("n"))
    return one("root").union(one("de"))


@query("select doc_id from documents where text ilike '%the and%' or source ilike '%SRC1%'")
def contains_any(spark, sf_dir):
    return read(spark, sf_dir, "documents").where(P.contains_any("the and", ["text"]) | P.contains_any("SRC1", ["source"])).select("doc_id")


@query("select doc_id from documents where text ilike '%th_ing%'")
def contains_raw(spark, sf_dir):
    return read(spark, sf_dir, "documents").where(P.contains_any("th_ing", ["text"], raw=True)).select("doc_id")


@query("select c_custkey from customer where lower(c_mktsegment) = lower('building') and c_custkey <> 3 and c_nationkey in (1, 3, 5) and c_acctbal >= 0 and c_acctbal < 5000")
def value_filters(spark, sf_dir):
    c = read(spark, sf_dir, "customer").withColumn("wanted", F.lit("building"))
    return c.where(P.same_text("c_mktsegment", "wanted") & (F.col("c_custkey") != 3) & P.listed("c_nationkey", [1, 3, 5]) & P.within("c_acctbal", 0, 5000, high_inclusive=False)).select("c_custkey")


_SUBS = "select user_id, list_sort(list_distinct(list(event_type))) as events from events group by user_id"


@query(f"select user_id from ({_SUBS}) where list_contains(events, 'error')")
def subscribed(spark, sf_dir):
    subs = read(spark, sf_dir, "events").groupBy("user_id").agg(F.collect_set("event_type").alias("events"))
    return subs.where(F.array_contains("events", "error")).select("user_id")


_NOW = "(select max(ts) from events)"


def _jobs(spark, sf_dir):
    """Events as the rows of a queue."""
    e = read(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("id"),
        F.expr("element_at(array('ocr', 'export', 'clean'), cast(user_id % 3 + 1 as int))").alias("queue"),
        F.expr("element_at(array('pending', 'reserved', 'done', 'dead', 'delayed'), cast(event_id % 5 + 1 as int))").alias("status"),
        (F.col("event_id") % 4).alias("priority"),
        F.col("ts").alias("run_at"),
        (F.col("event_id") % 5).alias("attempts"),
        F.lit(3).alias("max_attempts"),
        F.col("ts").alias("locked_at"),
        F.expr("case when event_id % 2 = 0 then ts end").alias("heartbeat_at"),
        F.expr("case when event_id % 3 = 0 then null else ts end").alias("next_retry_at"),
        F.expr("case when event_id % 4 = 0 then ts end").alias("delivered_at"),
        F.expr("concat('k', cast(event_id % 50 as string))").alias("idempotency_key"),
        F.col("props").alias("payload"),
    )


_JOBS = """(select event_id as id, ['ocr', 'export', 'clean'][user_id % 3 + 1] as queue, ['pending', 'reserved', 'done', 'dead', 'delayed'][event_id % 5 + 1] as status,
  event_id % 4 as priority, ts as run_at, event_id % 5 as attempts, 3 as max_attempts, ts as locked_at, case when event_id % 2 = 0 then ts end as heartbeat_at,
  case when event_id % 3 = 0 then null else ts end as next_retry_at, case when event_id % 4 = 0 then ts end as delivered_at,
  'k' || (event_id % 50)::varchar as idempotency_key, props as payload from events)"""


def _now(df, ts="run_at"):
    """The newest time of a table, as a literal: queries never ask the clock."""
    return F.lit(df.agg(F.max(ts)).first()[0])


@query(f"select id from {_JOBS} where attempts < 3 and (next_retry_at is null or next_retry_at <= {_NOW} - interval 5 day)")
def due_deliveries(spark, sf_dir):
    jobs = _jobs(spark, sf_dir)
    return jobs.where(P.due(_now(jobs) - F.expr("interval 5 days"))).select("id")


_STATUS = "case event_id % 4 when 0 then 'OCR_PROCESSING' when 1 then 'CLEANING' when 2 then 'COMPLETED' else 'FAILED' end"


@query(f"select event_id from (select *, {_STATUS} as status from events) where status in ('OCR_PROCESSING', 'CLEANING') and ts < {_NOW} - interval 30 minute")
def stuck_documents(spark, sf_dir):
    e = read(spark, sf_dir, "events").withColumn("status", F.expr(_STATUS))
    return e.where(P.stuck_documents(_now(e, "ts"), updated="ts")).select("event_id")


@query(f"select event_id from (select *, {_STATUS} as status from events) where status = 'FAILED' and event_type = 'error' and ts >= {_NOW} - interval 86400 second")
def reenqueue_candidates(spark, sf_dir):
    e = read(spark, sf_dir, "events").withColumns({"status": F.expr(_STATUS), "error_code": F.col("event_type"), "updated_at": F.col("ts")})
    return e.where(P.reenqueue_candidates(_now(e, "ts"), "error", 86400)).select("event_id")


@query(f"select id, (epoch_us({_NOW}) - epoch_us(locked_at)) // 1000 as age_ms from {_JOBS} where status = 'reserved' and (epoch_us({_NOW}) - epoch_us(locked_at)) / 1000 > 2 * case queue when 'ocr' then 600000 else 120000 end")
def stuck_jobs(spark, sf_dir):
    jobs = _jobs(spark, sf_dir)
    timeouts = spark.sql("select * from values ('ocr', 600000L), ('export', 120000L), ('clean', 120000L) as t(queue, timeout_ms)")
    return P.stuck_jobs(jobs, timeouts, _now(jobs)).select("id", "age_ms")


@query(f"select count(*) as n from (select {_STATUS} as status from events) where status in ('FAILED', 'UPLOADED')")
def requeue_guard(spark, sf_dir):
    return read(spark, sf_dir, "events").select(F.expr(_STATUS).alias("status")).where(P.can_requeue()).agg(F.count("*").alias("n"))


@query(
    f"""select s.event_id, case when d.doc_id is null then 404 when d.n_chars % 7 = 0 then 404 when d.lang <> 'en' then 404 when s.event_id % 3 = 0 and s.ts < {_NOW} - interval 10 day then 410 else 200 end as outcome
    from events s left join documents d on s.event_id * 2 = d.doc_id"""
)
def share_access(spark, sf_dir):
    links = read(spark, sf_dir, "events").select("event_id", (F.col("event_id") * 2).alias("wanted"), F.expr("case when event_id % 3 = 0 then ts end").alias("expires_at"))
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), F.expr("case when n_chars % 7 = 0 then 1 end").alias("deleted_at"), F.expr("if(lang = 'en', 'COMPLETED', 'OCR')").alias("status"))
    now = _now(read(spark, sf_dir, "events"), "ts") - F.expr("interval 10 days")
    return links.join(docs, links.wanted == docs.document_id, "left").select("event_id", P.share_outcome(now).alias("outcome"))


@query("select doc_id from labels where doc_id not in (select doc_id from documents where lang = 'en')")
def missing_ids(spark, sf_dir):
    return P.missing(read(spark, sf_dir, "labels").select("doc_id"), read(spark, sf_dir, "documents").where("lang = 'en'"), "doc_id")


@query("select l.doc_id from labels l")
def required_ids(spark, sf_dir):
    return P.require_all(read(spark, sf_dir, "labels").select("doc_id"), read(spark, sf_dir, "documents"), "doc_id")


# --- joins ---


@query("select d.doc_id, l.quality from documents d left join labels l on d.doc_id = l.doc_id")
def docs_with_labels(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id").join(read(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")


@query("select d.doc_id from documents d join labels l on d.doc_id = l.doc_id and l.toxic = 1")
def docs_of_tag(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id").join(read(spark, sf_dir, "labels").where("toxic = 1").select("doc_id"), "doc_id")


@query("select n_name, count(c_custkey) as n from nation left join customer on n_nationkey = c_nationkey group by n_name")
def child_counts(spark, sf_dir):
    return R.child_counts(read(spark, sf_dir, "nation"), read(spark, sf_dir, "customer"), "n_nationkey", "c_nationkey").select("n_name", "n")


@query("select c_custkey from customer where exists (select 1 from orders where o_custkey = c_custkey)")
def customers_with_orders(spark, sf_dir):
    return R.having(read(spark, sf_dir, "customer"), read(spark, sf_dir, "orders"), "c_custkey", "o_custkey").select("c_custkey")


@query("select doc_id from documents where not exists (select 1 from labels where labels.doc_id = documents.doc_id)")
def unlabelled_docs(spark, sf_dir):
    return R.lacking(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), "doc_id", "doc_id").select("doc_id")


@query("select c_custkey, n_name as nation, n_regionkey as region from customer left join nation on c_nationkey = n_nationkey")
def with_parent(spark, sf_dir):
    out = R.with_parent(read(spark, sf_dir, "customer"), read(spark, sf_dir, "nation"), "c_nationkey", "n_nationkey", "n", ["n_name", "n_regionkey"])
    return out.select("c_custkey", F.col("n.n_name").alias("nation"), F.col("n.n_regionkey").alias("region"))


@query("select r_name, coalesce(string_agg(n_name, ',' order by n_name), '') as nations from region left join nation on r_regionkey = n_regionkey group by r_name")
def with_children(spark, sf_dir):
    out = R.with_children(read(spark, sf_dir, "region"), read(spark, sf_dir, "nation"), "r_regionkey", "n_regionkey", "ns", ["n_name"])
    return out.select("r_name", F.array_join(F.transform("ns", lambda x: x["n_name"]), ",").alias("nations"))


@query("select o_custkey, count(*) filter (where o_orderstatus = 'O') as open_orders from orders group by o_custkey having o_custkey in (select c_custkey from customer)")
def filtered_counts(spark, sf_dir):
    out = R.child_counts(read(spark, sf_dir, "customer"), read(spark, sf_dir, "orders"), "c_custkey", "o_custkey", "open_orders", F.col("o_orderstatus") == "O")
    return R.having(out, read(spark, sf_dir, "orders"), "c_custkey", "o_custkey").select(F.col("c_custkey").alias("o_custkey"), "open_orders")


@query("select event_id, k.n as place, k.ref as reference from events, (select unnest([0, 1, 2]) as n, unnest(['a', 'b', 'c']) as ref) k where event_id % 3 >= k.n")
def reference_lists(spark, sf_dir):
    e = read(spark, sf_dir, "events").select("event_id", F.expr("slice(array('a', 'b', 'c'), 1, cast(event_id % 3 + 1 as int))").alias("refs"))
    return R.expand_references(e, "event_id", "refs")


@query("select l_orderkey, l_linenumber, o_orderdate from lineitem join orders on l_orderkey = o_orderkey order by o_orderdate desc, l_orderkey, l_linenumber limit 20 offset 20")
def bookmark_page(spark, sf_dir):
    joined = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber").join(read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate"), "l_orderkey")
    return R.page(joined, [F.col("o_orderdate").desc(), F.col("l_orderkey"), F.col("l_linenumber")], 2, 20)


# --- roll-ups ---


@query(
    "select count(*) as n_docs, coalesce(sum(n_chars), 0)::bigint as bytes, coalesce(avg(n_chars), 0) as mean_bytes, count(*) filter (where lang = 'en') as n_en, count(distinct source) as n_sources from documents"
)
def summary_counts(spark, sf_dir):
    return read(spark, sf_dir, "documents").agg(
        F.count("*").alias("n_docs"), A.total("n_chars").alias("bytes"), A.mean("n_chars").alias("mean_bytes"), F.count(F.when(F.col("lang") == "en", 1)).alias("n_en"), F.count_distinct("source").alias("n_sources")
    )


@query("select o_orderstatus, count(*) as n from orders group by 1")
def status_counts(spark, sf_dir):
    return read(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(F.count("*").alias("n"))


@query("select lang, count(*) as n, sum(n_chars)::bigint as bytes from documents where n_chars >= 500 and n_chars < 20000 group by 1")
def bytes_by_type(spark, sf_dir):
    return read(spark, sf_dir, "documents").where(P.within("n_chars", 500, 20000, high_inclusive=False)).groupBy("lang").agg(F.count("*").alias("n"), F.sum("n_chars").alias("bytes"))


@query(
    f"select d::date as day, count(e.ts) as n from (select unnest(generate_series({_NOW}::date - interval 30 day, {_NOW}::date, interval 1 day)) as d) left join (select * from events where event_type = 'purchase') e on e.ts::date = d::date group by 1"
)
def daily_zero_filled(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    return A.daily_histogram(e.where("event_type = 'purchase'"), "ts", _now(e, "ts"), 30)


@query("""with g as (select event_type as action, ts as t, count(*) as c from events group by 1, 2 order by t desc, action limit 100)
    select action, t::date as day, sum(c)::bigint as n from g group by 1, 2 order by day desc, action limit 20""")
def recent_activity(spark, sf_dir):
    return A.recent_activity(read(spark, sf_dir, "events"), "event_type", "ts")


@query("select event_type as action, ts::date as day, count(*) as n from events group by 1, 2 order by day desc, action limit 20")
def recent_activity_exact(spark, sf_dir):
    return A.recent_activity(read(spark, sf_dir, "events"), "event_type", "ts", before=None)


@query(f"select queue, count(*) filter (where status = 'pending') as waiting, count(*) filter (where status = 'reserved') as active, count(*) filter (where status = 'done') as completed, count(*) filter (where status = 'dead') as failed, count(*) filter (where status = 'delayed') as \"delayed\" from {_JOBS} group by queue")
def queue_buckets(spark, sf_dir):
    return A.queue_buckets(_jobs(spark, sf_dir))


@query(f"select queue, status, count(*) as n from {_JOBS} group by 1, 2")
def queue_status_counts(spark, sf_dir):
    return _jobs(spark, sf_dir).groupBy("queue", "status").agg(F.count("*").alias("n"))


@query(f"select count(*) filter (where status = 'reserved') as reserved, count(*) filter (where status = 'pending' and run_at < {_NOW} - interval 5 minute) as stuck from {_JOBS}")
def queue_reserved_stuck(spark, sf_dir):
    jobs = _jobs(spark, sf_dir)
    late = (F.col("status") == "pending") & (F.col("run_at") < _now(jobs) - F.expr("interval 5 minutes"))
    return jobs.agg(F.count(F.when(F.col("status") == "reserved", 1)).alias("reserved"), F.count(F.when(late, 1)).alias("stuck"))


@query(f"select count(*) as total, count(delivered_at) as delivered, count(*) filter (where delivered_at is null and attempts >= 3) as failed from {_JOBS}")
def delivery_stats(spark, sf_dir):
    return A.delivery_stats(_jobs(spark, sf_dir))


@query("select user_id, floor(avg(greatest(0, (epoch_us(nxt) - epoch_us(ts)) / 1000000.0)) + 0.5)::bigint as seconds from (select *, lead(ts) over (partition by user_id order by ts, event_id) as nxt from events) where nxt is not null group by 1")
def mean_processing(spark, sf_dir):
    from pyspark.sql import Window

    e = read(spark, sf_dir, "events").withColumn("nxt", F.lead("ts").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))).where("nxt is not null")
    return e.groupBy("user_id").agg(A.mean_seconds(e, "ts", "nxt").alias("seconds"))


@query(" union all ".join(f"select '{t}' as entity, count(*) as n from {t}" for t in ("documents", "labels", "orders", "customer", "pages")))
def entity_counts(spark, sf_dir):
    out = None
    for t in ("documents", "labels", "orders", "customer", "pages"):
        one = read(spark, sf_dir, t).agg(F.lit(t).alias("entity"), F.count("*").alias("n"))
        out = one if out is None else out.union(one)
    return out


@query("select conv_id, string_agg(text, chr(10) || chr(10) order by turn) as text from conversations where coalesce(text, '') <> '' group by 1")
def text_of_turns(spark, sf_dir):
    return A.text_of_pages(read(spark, sf_dir, "conversations"), "conv_id", "turn", "text")


@query("select event_type as provider, count(*) as calls, avg((event_id % 3 <> 0)::int) as success_rate, floor(avg(value * 100) + 0.5)::bigint as mean_latency_ms from events group by 1")
def provider_health(spark, sf_dir):
    return A.provider_health(read(spark, sf_dir, "events"), "event_type", F.col("event_id") % 3 != 0, F.col("value") * 100)


@query("select event_type as provider, ts::date as day, greatest(500 - sum(event_id % 7), 0)::double as budget_left from events group by 1, 2")
def budget_left(spark, sf_dir):
    e = read(spark, sf_dir, "events").withColumn("used", F.col("event_id") % 7)
    return A.budget_left(e, "event_type", "ts", "used", 500.0)


@query("select source, sum(n_chars)::bigint as bytes from documents group by 1")
def storage_by_user(spark, sf_dir):
    return read(spark, sf_dir, "documents").groupBy("source").agg(F.sum("n_chars").alias("bytes"))


_THEMES = "select doc_id, n_chars, unnest(case when doc_id % 3 = 0 then ['overview'] when doc_id % 3 = 1 then [lang] else [lang, source] end) as theme from documents"


@query(f"select theme, count(*) as n, sum(n_chars)::bigint as reading from ({_THEMES}) group by 1")
def themes(spark, sf_dir):
    listed = F.expr("case when doc_id % 3 = 0 then cast(array() as array<string>) when doc_id % 3 = 1 then array(lang) else array(lang, source) end")
    docs = read(spark, sf_dir, "documents").select("n_chars", listed.alias("ts"))
    spread = docs.select("n_chars", F.explode(F.when(F.size("ts") == 0, F.array(F.lit("overview"))).otherwise(F.col("ts"))).alias("theme"))
    return spread.groupBy("theme").agg(F.count("*").alias("n"), F.sum("n_chars").alias("reading"))


@query("select source, count(*) as n_docs, sum(strlen(text))::bigint as bytes, string_agg(doc_id::varchar, ',' order by doc_id) as docs from documents group by 1")
def manifest_rollup(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    return docs.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum(F.octet_length("text")).alias("bytes"), F.array_join(F.transform(F.array_sort(F.collect_list("doc_id")), lambda x: x.cast("string")), ",").alias("docs"))


# --- windows, sorting, paging ---

_LATEST = "select o_custkey, o_orderkey, o_totalprice from (select *, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey) as r from orders) where r = 1"


@query(_LATEST)
def latest_per_key(spark, sf_dir):
    return R.latest_per(read(spark, sf_dir, "orders"), ["o_custkey"], [F.col("o_orderdate").desc(), F.col("o_orderkey")]).select("o_custkey", "o_orderkey", "o_totalprice")


@query("select doc_id, lag(doc_id) over w as previous, lead(doc_id) over w as next from documents window w as (partition by source order by doc_id)")
def prev_next(spark, sf_dir):
    return R.neighbours(read(spark, sf_dir, "documents").select("doc_id", "source"), [F.col("doc_id")], "doc_id", ["source"]).select("doc_id", "previous", "next")


@query("select n_regionkey, coalesce(max(n_nationkey), -1) + 1 as next_order from nation group by 1")
def next_order(spark, sf_dir):
    return R.next_order(read(spark, sf_dir, "nation"), "n_regionkey", "n_nationkey").select("n_regionkey", "next_order")


@query("""select event_id, sum(f) over (partition by user_id, g order by ts, event_id rows unbounded preceding)::bigint as streak from (
    select *, sum(1 - f) over (partition by user_id order by ts, event_id rows unbounded preceding) as g from (select *, (event_type = 'error')::int as f from events))""")
def failure_streaks(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    return R.streaks(e, ["user_id"], [F.col("ts"), F.col("event_id")], F.col("event_type") == "error").select("event_id", "streak")


@query(f"select id, queue, claim from (select *, row_number() over (partition by queue order by priority desc, run_at, id) as claim from {_JOBS} where status = 'pending') where claim <= 5")
def claim_order(spark, sf_dir):
    return R.claimable(_jobs(spark, sf_dir), 5).select("id", "queue", "claim")


@query("select doc_id, n_chars from documents order by n_chars desc, doc_id limit 5")
def top5_largest(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", "n_chars").orderBy(F.col("n_chars").desc(), "doc_id").limit(5)


@query("select source, count(*) as n from documents group by 1 order by n desc, source limit 10")
def top10_tags(spark, sf_dir):
    return read(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "source").limit(10)


@query("select count(*) as total, ceil(count(*) / 20.0)::bigint as total_pages from orders where o_orderstatus = 'F'")
def page_envelope(spark, sf_dir):
    return read(spark, sf_dir, "orders").where("o_orderstatus = 'F'").agg(F.count("*").alias("total"), F.ceil(F.count("*") / F.lit(20.0)).alias("total_pages"))


# --- sets ---


@query("select l_partkey as k from lineitem where l_quantity > 45 except select l_partkey from lineitem where l_quantity < 10")
def tag_diff(spark, sf_dir):
    items = read(spark, sf_dir, "lineitem")
    return items.where("l_quantity > 45").select(F.col("l_partkey").alias("k")).distinct().join(items.where("l_quantity < 10").select(F.col("l_partkey").alias("k")), "k", "left_anti")


@query("select doc_id, len(list_intersect(a, b)) as n_both, len(list_distinct(list_concat(a, b))) as n_any from (select doc_id, string_split(text, ' ') as a, string_split(nxt, ' ') as b from (select *, lead(text) over (partition by source order by doc_id) as nxt from documents) where nxt is not null)")
def set_sizes(spark, sf_dir):
    """Words in both and in any of two documents that follow each other in a source, whole texts."""
    from quillspark.plans.text_queries import followed_by

    words = followed_by(read(spark, sf_dir, "documents")).select("doc_id", F.split("text", " ").alias("a"), F.split("nxt", " ").alias("b"))
    return words.select("doc_id", F.size(F.array_intersect("a", "b")).cast("long").alias("n_both"), F.size(F.array_union("a", "b")).cast("long").alias("n_any"))


# --- hierarchy ---


def _tree(spark, sf_dir):
    """Regions, nations, and customers in a heap below them, which is the deeper the more there are."""
    r = read(spark, sf_dir, "region").select(F.expr("concat('r', r_regionkey)").alias("id"), F.lit(None).cast("string").alias("parent"), F.col("r_name").alias("name"), F.col("r_regionkey").cast("int").alias("order"))
    n = read(spark, sf_dir, "nation").select(F.expr("concat('n', n_nationkey)").alias("id"), F.expr("concat('r', n_regionkey)").alias("parent"), F.col("n_name").alias("name"), F.col("n_nationkey").cast("int").alias("order"))
    c = read(spark, sf_dir, "customer").select(F.expr("concat('c', c_custkey)").alias("id"), F.expr("if(c_custkey < 8, concat('n', c_nationkey), concat('c', c_custkey div 2))").alias("parent"), F.col("c_name").alias("name"), F.col("c_custkey").cast("int").alias("order"))
    return r.union(n).union(c)


_TREE = """t as (select 'r' || r_regionkey::varchar as id, null::varchar as parent, r_name as name, r_regionkey::int as ord from region union all select 'n' || n_nationkey::varchar, 'r' || n_regionkey::varchar, n_name, n_nationkey::int from nation
  union all select 'c' || c_custkey::varchar, case when c_custkey < 8 then 'n' || c_nationkey::varchar else 'c' || (c_custkey // 2)::varchar end, c_name, c_custkey::int from customer),
  a as (select id, id as ancestor, 0 as distance, parent from t union all select a.id, t.id, a.distance + 1, t.parent from a join t on a.parent = t.id)"""


@query(f"with recursive {_TREE} select ancestor as root, id from a where ancestor in ('r1', 'n3')")
def descendants(spark, sf_dir):
    return H.descendants(_tree(spark, sf_dir), spark.sql("select * from values ('r1'), ('n3') as t(root)"))


@query(f"with recursive {_TREE} select id, max(distance)::int as depth from a group by id")
def ancestor_depth(spark, sf_dir):
    return H.depths(_tree(spark, sf_dir))


@query(f"with recursive {_TREE} select ancestor as id, max(distance)::int as height from a group by 1")
def subtree_height(spark, sf_dir):
    return H.heights(_tree(spark, sf_dir))


@query(f"with recursive {_TREE} select a.id, string_agg(t.name, ' / ' order by a.distance desc) as path from a join t on a.ancestor = t.id group by 1")
def folder_paths(spark, sf_dir):
    return H.paths(_tree(spark, sf_dir))


@query(f"with recursive {_TREE} select a.id, max(distance)::int as depth, string_agg(printf('%08d:%s', t.ord, t.id), '/' order by a.distance desc) as sort_path from a join t on a.ancestor = t.id group by 1")
def folder_tree(spark, sf_dir):
    return H.tree(_tree(spark, sf_dir))


@query(
    f"""with recursive {_TREE}, m as (select n.id, x.id as target from t n, t x where n.id in ('r0', 'n1', 'n2') and x.id in ('r2', 'n1', 'n7', 'c5', 'c6')),
    d as (select id, max(distance) as depth from a group by 1), h as (select ancestor as id, max(distance) as height from a group by 1)
    select m.id, m.target, case when exists (select 1 from a where a.id = m.target and a.ancestor = m.id) then 'CIRCULAR' when coalesce(d.depth, 0) + 1 + coalesce(h.height, 0) >= 5 then 'MAX_DEPTH' else 'OK' end as verdict
    from m left join d on d.id = m.target left join h on h.id = m.id"""
)
def move_check(spark, sf_dir):
    moves = spark.sql("select a.id, b.target from values ('r0'), ('n1'), ('n2') as a(id) cross join values ('r2'), ('n1'), ('n7'), ('c5'), ('c6') as b(target)")
    return H.check_moves(_tree(spark, sf_dir), moves)


@query(f"with recursive {_TREE} select o_orderkey from orders join a on a.id = 'c' || o_custkey::varchar where ancestor = 'r1'")
def subtree_docs(spark, sf_dir):
    below = H.descendants(_tree(spark, sf_dir), spark.sql("select 'r1' as root"))
    return read(spark, sf_dir, "orders").select("o_orderkey", F.expr("concat('c', o_custkey)").alias("id")).join(below, "id", "left_semi").select("o_orderkey")


def _filed_orders(spark, sf_dir):
    return read(spark, sf_dir, "orders").select("o_orderkey", F.expr("concat('c', o_custkey)").alias("folder_id"))


@query(f"with recursive {_TREE} select t.id, exists (select 1 from a where a.id = t.id and a.ancestor = 'r1') as deleted from t")
def subtree_deletion(spark, sf_dir):
    folders = _tree(spark, sf_dir).withColumn("deleted_at", F.lit(None).cast("timestamp"))
    marked, _ = H.delete_subtree(folders, _filed_orders(spark, sf_dir), "r1", F.expr("timestamp '2024-01-01 00:00:00'"))
    return marked.select("id", F.col("deleted_at").isNotNull().alias("deleted"))


@query(f"with recursive {_TREE} select o_orderkey, case when not exists (select 1 from a where a.id = 'c' || o_custkey::varchar and a.ancestor = 'r1') then 'c' || o_custkey::varchar end as folder_id from orders")
def subtree_detachment(spark, sf_dir):
    folders = _tree(spark, sf_dir).withColumn("deleted_at", F.lit(None).cast("timestamp"))
    _, freed = H.delete_subtree(folders, _filed_orders(spark, sf_dir), "r1", F.expr("timestamp '2024-01-01 00:00:00'"))
    return freed.select("o_orderkey", "folder_id")


@query(f"with recursive {_TREE} select id, case when parent = 'n3' then (select parent from t where id = 'n3') else parent end as parent from t")
def folder_emptying(spark, sf_dir):
    moved, _ = H.empty_folder(_tree(spark, sf_dir), _filed_orders(spark, sf_dir), "n3")
    return moved.select("id", "parent")


@query("select o_orderkey, case when o_custkey % 4 <> 0 and o_custkey in (select c_custkey from customer) then 'c' || o_custkey::varchar end as folder_id from orders")
def document_restoring(spark, sf_dir):
    folders = _tree(spark, sf_dir).withColumn("deleted_at", F.expr("case when id like 'c%' and cast(substring(id, 2) as int) % 4 = 0 then timestamp '2024-01-01 00:00:00' end"))
    docs = _filed_orders(spark, sf_dir).withColumn("deleted_at", F.expr("timestamp '2024-01-01 00:00:00'"))
    return H.restore_documents(docs, folders).select("o_orderkey", "folder_id")


# --- derived tables ---


@query("select l_orderkey, k as l_partkey from (select distinct l_orderkey, case when l_partkey % 10 = 3 then 1 else l_partkey end as k from lineitem)")
def tag_merge(spark, sf_dir):
    bridge = read(spark, sf_dir, "lineitem").select("l_orderkey", F.expr("if(l_partkey % 10 = 3, -3, l_partkey)").alias("l_partkey"))
    return D.merge_tag(bridge, -3, 1, "l_partkey", "l_orderkey").select("l_orderkey", "l_partkey")


@query("select distinct l_orderkey from lineitem where l_partkey = 3 and l_orderkey not in (select l_orderkey from lineitem where l_partkey = 1)")
def tag_merge_affected(spark, sf_dir):
    return D.newly_tagged(read(spark, sf_dir, "lineitem"), 3, 1, "l_partkey", "l_orderkey")


@query("""select o_custkey, coalesce(n.o_orderkey, o.o_orderkey) as o_orderkey from (select o_custkey, min(o_orderkey) as o_orderkey from orders where o_orderstatus = 'F' group by 1) o
    full join (select o_custkey, max(o_orderkey) as o_orderkey from orders where o_orderstatus = 'O' group by 1) n using (o_custkey)""")
def share_upsert(spark, sf_dir):
    orders = read(spark, sf_dir, "orders")
    current = orders.where("o_orderstatus = 'F'").groupBy("o_custkey").agg(F.min("o_orderkey").alias("o_orderkey"))
    changes = orders.where("o_orderstatus = 'O'").groupBy("o_custkey").agg(F.max("o_orderkey").alias("o_orderkey"))
    return D.upsert(current, changes, ["o_custkey"])


_SIDES = "(select distinct user_id as u, event_id % 20 as d from events where event_type in ('view', 'click')) a", "(select distinct user_id as u, event_id % 20 as d from events where event_type not in ('view', 'click')) b"


@query(f"(select u, d from {_SIDES[0]} except select u, d from {_SIDES[1]}) union all (select u, d from {_SIDES[1]} except select u, d from {_SIDES[0]})")
def bookmark_toggle(spark, sf_dir):
    e = read(spark, sf_dir, "events").select(F.col("user_id").alias("u"), (F.col("event_id") % 20).alias("d"), "event_type")
    marked = F.col("event_type").isin("view", "click")
    return D.toggle(e.where(marked).select("u", "d").distinct(), e.where(~marked).select("u", "d").distinct(), ["u", "d"])


_BRIDGE = "select distinct l_orderkey as d, l_suppkey as t from lineitem"


@query(f"select d, t from ({_BRIDGE}) where d not in (select o_orderkey from orders where o_orderstatus = 'P') union all select distinct o_orderkey, 0 from orders where o_orderstatus = 'P'")
def set_tags(spark, sf_dir):
    bridge = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("d"), F.col("l_suppkey").alias("t")).distinct()
    wanted = read(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("d"), F.lit(0).cast("long").alias("t"))
    return D.replace_tags(bridge, wanted, "t", "d")


@query(f"select distinct o_orderkey as d, 1 as t from orders where o_orderstatus = 'O' and not exists (select 1 from ({_BRIDGE}) b where b.d = o_orderkey and b.t = 1)")
def bulk_tag(spark, sf_dir):
    bridge = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("d"), F.col("l_suppkey").alias("t"))
    wanted = read(spark, sf_dir, "orders").where("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("d"), F.lit(1).cast("long").alias("t"))
    return D.bulk_tag(bridge, wanted, ["d", "t"]).select("d", F.col("t").cast("int").alias("t"))


@query(f"{_BRIDGE} except select l_orderkey, l_suppkey from lineitem where l_returnflag = 'R'")
def bulk_untag(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("d"), F.col("l_suppkey").alias("t"), "l_returnflag")
    return D.bulk_untag(rows.select("d", "t").distinct(), rows.where("l_returnflag = 'R'").select("d", "t").distinct(), ["d", "t"])


@query(f"select doc_id, case when source = 'src2' and deleted_at is null then timestamp '2024-06-01' else deleted_at end as deleted_at from ({_OWNED})")
def soft_delete(spark, sf_dir):
    return D.soft_delete(_catalogue(spark, sf_dir), F.col("source") == "src2", F.expr("timestamp_ntz '2024-06-01 00:00:00'")).select("doc_id", "deleted_at")


@query(f"select doc_id, case when source = 'src2' then null else deleted_at end as deleted_at from ({_OWNED})")
def restore(spark, sf_dir):
    return D.restore(_catalogue(spark, sf_dir), F.col("source") == "src2").select("doc_id", "deleted_at")


@query("select 'unique:l_orderkey' as rule, (select count(*) from (select 1 from lineitem group by l_orderkey having count(*) > 1)) as n union all select 'check:quantity', count(*) from lineitem where l_quantity > 45")
def constraint_violations(spark, sf_dir):
    return D.violations(read(spark, sf_dir, "lineitem"), [["l_orderkey"]], {"quantity": F.col("l_quantity") <= 45})


@query(
    f"""select id, case when id % 2 = 0 and attempts < 3 then 'pending' else 'dead' end as status, case when id % 2 = 0 and attempts < 3 then run_at + to_microseconds((case queue when 'ocr' then 5000000 else 2000000 end * power(2, attempts))::bigint) end as run_at
    from {_JOBS}"""
)
def retry_or_dead(spark, sf_dir):
    jobs = _jobs(spark, sf_dir)
    return D.retry_or_dead(jobs, F.col("run_at"), F.col("id") % 2 == 0).select("id", "status", F.col("run_at").cast("timestamp_ntz").alias("run_at"))


@query(f"select id from {_JOBS} where status = 'reserved' and coalesce(heartbeat_at, locked_at) < {_NOW} - interval 30 second and locked_at < {_NOW} - interval 30 second")
def stale_jobs(spark, sf_dir):
    jobs = _jobs(spark, sf_dir)
    return jobs.where(D.stale(_now(jobs))).select("id")


@query(
    f"""with q as (select queue, idempotency_key, min(payload) as payload, min(status) as status, max(attempts) as attempts from {_JOBS} where hour(run_at) < 12 group by 1, 2),
    r as (select queue, idempotency_key, payload from (select *, row_number() over (partition by queue, idempotency_key order by run_at desc, payload) as n from {_JOBS} where hour(run_at) >= 12) where n = 1)
    select queue, idempotency_key, case when o then r.payload else q.payload end as payload, case when o then 'pending' else status end as status, case when o then 0 else attempts end as attempts from (
      select coalesce(q.queue, r.queue) as queue, coalesce(q.idempotency_key, r.idempotency_key) as idempotency_key, q, r, status, attempts, r.payload is not null and (status is null or status in ('done', 'dead')) as o
      from q full join r on q.queue = r.queue and q.idempotency_key = r.idempotency_key)"""
)
def idempotent_enqueue(spark, sf_dir):
    jobs = _jobs(spark, sf_dir)
    queue = jobs.where("hour(run_at) < 12").groupBy("queue", "idempotency_key").agg(F.min("payload").alias("payload"), F.min("status").alias("status"), F.max("attempts").alias("attempts"))
    requests = jobs.where("hour(run_at) >= 12").select("queue", "idempotency_key", "payload", F.col("run_at").alias("at"))
    return D.idempotent_enqueue(queue, requests)


# --- trailing windows ---


@query("select event_id, count(*) over (order by epoch_us(ts) range between 3600000000 preceding and current row) as trailing from events")
def trailing_hour(spark, sf_dir):
    """Events of the last hour at each event."""
    e = read(spark, sf_dir, "events").select("event_id", F.expr("unix_micros(cast(ts as timestamp))").alias("us"))
    return A.trailing_counts(e, "us", 3600_000_000, "trailing").select("event_id", "trailing")


@query(f"select count(distinct user_id) as active from events where ts > {_NOW} - interval 15 minute")
def active_15min(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    return e.where(F.col("ts") > _now(e, "ts") - F.expr("interval 15 minutes")).agg(F.count_distinct("user_id").alias("active"))
