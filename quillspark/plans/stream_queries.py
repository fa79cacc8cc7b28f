"""Queries of windows, state machines, sources and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.functions.dialect import DUCK, SPARK
from quillspark.operators import aggregates as A
from quillspark.plans.registry import pick, query, read
from quillspark.session import materialize
from quillspark.sources import exports as E
from quillspark.sources import files, office
from quillspark.streaming import scan, sinks, stateful, windows


def _events(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    return e.select("event_id", "user_id", "event_type", F.expr("unix_micros(cast(ts as timestamp))").alias("us"), (F.col("event_type") == "error").alias("failed"))


@query("select time_bucket(interval 1 hour, ts) as start, time_bucket(interval 1 hour, ts) + interval 1 hour as \"end\", event_type, count(*) as n from events group by 1, 2, 3")
def hourly_windows(spark, sf_dir):
    return windows.counts(read(spark, sf_dir, "events"), "ts", ["event_type"], "1 hour").select(F.col("start").cast("timestamp_ntz"), F.col("end").cast("timestamp_ntz"), "event_type", "n")


@query("select w as start, w + interval 15 minute as \"end\", count(distinct user_id) as users from (select user_id, unnest([time_bucket(interval 5 minute, ts), time_bucket(interval 5 minute, ts) - interval 5 minute, time_bucket(interval 5 minute, ts) - interval 10 minute]) as w from events) group by 1, 2")
def active_windows(spark, sf_dir):
    return windows.active_users(read(spark, sf_dir, "events"), "ts", "user_id").select(F.col("start").cast("timestamp_ntz"), F.col("end").cast("timestamp_ntz"), "users")


@query("select event_type, cast(floor(epoch_us(w) / 300000000) as bigint) as slice, count(distinct user_id) as users from (select event_type, user_id, unnest([ts, ts - interval 5 minute, ts - interval 10 minute]) as w from events) group by 1, 2")
def active_users_by_slices(spark, sf_dir):
    """Active users of a quarter of an hour by type of event, every five minutes, from stored slices."""
    slices = materialize(A.distinct_slices(read(spark, sf_dir, "events"), "ts", "user_id", 300, ["event_type"]), "slices")
    return A.sliding_distinct(slices, 3, ["event_type"], "users")


@query("""select user_id, min(ts) as start, max(ts) + interval 30 minute as "end", count(*) as n from (select *, sum(b) over (partition by user_id order by ts, event_id) as g from (
    select *, case when ts - lag(ts) over (partition by user_id order by ts, event_id) < interval 30 minute then 0 else 1 end as b from events)) group by user_id, g""")
def session_windows(spark, sf_dir):
    return windows.sessions(read(spark, sf_dir, "events"), "ts", ["user_id"], "30 minutes").select("user_id", F.col("start").cast("timestamp_ntz"), F.col("end").cast("timestamp_ntz"), "n")


def _replay_sql(state: dict[str, tuple], shown: dict[str, str]) -> str:
    """A state machine as a recursive query: {name} in an expression is a field of the state before the row ``o``."""
    start = {n: f"({v}::bigint)" for n, (v, _) in state.items()}
    held = {n: f"s.{n}" for n in state}
    step = lambda prior: ", ".join(f"({e.format(**prior)}) as {n}" for n, e in [*((n, e) for n, (_, e) in state.items()), *((f"shown_{n}", e) for n, e in shown.items())])
    return f"""with recursive e as (select event_id, user_id, epoch_us(ts) as us, event_type = 'error' as failed, ['claim', 'complete', 'fail', 'recover', 'requeue'][event_id % 5 + 1] as command, event_id // 3 as lease from events),
    o as (select *, row_number() over (partition by user_id order by us, event_id) as n from e),
    s as (select o.user_id, o.n, o.event_id, {step(start)} from o where n = 1 union all select o.user_id, o.n, o.event_id, {step(held)} from s join o on o.user_id = s.user_id and o.n = s.n + 1)
    select event_id, {', '.join(f'shown_{n} as {n}' for n in shown)} from s"""


_DAY, _LOCK, _COOL = 86_400_000_000, 900_000_000, 30_000_000
_FRESH = f"{{start}} < 0 or o.us >= {{start}} + {_DAY}"
_HITS = f"case when {_FRESH} then 1 else {{hits}} + 1 end"


@query(
    _replay_sql(
        {"start": (-1, f"case when {_FRESH} then o.us else {{start}} end"), "hits": (0, _HITS)},
        {"allowed": f"{_HITS} <= 3", "remaining": f"greatest(0, 3 - {_HITS})", "retry_after_us": f"case when {_HITS} <= 3 then 0 else {{start}} + {_DAY} - o.us end"},
    )
)
def rate_limit_replay(spark, sf_dir):
    """Three events of a user in a window of a day that opens with the first."""
    out = scan.replay(_events(spark, sf_dir), "user_id", scan.rate_limit(3, _DAY), stateful.RATE_RESULT, ["us", "event_id"])
    return out.select("event_id", "allowed", "remaining", "retry_after_us")


_SHARDS, _ENTRIES = 16, 8
_FOUND = "list_filter({entries}, lambda e: e.client = o.user_id)"
_NEW = f"(len({_FOUND}) = 0 or o.us > {_FOUND}[1].til)"
_EVICTS = f"({_NEW} and len({{entries}}) >= {_ENTRIES})"
_LEFT = f"case when {_EVICTS} then {{entries}}[2:] else {{entries}} end"
_FRESH_ENTRY = f"{{{{'client': o.user_id, 'hits': 1::bigint, 'til': o.us + {_DAY}}}}}"
_STORED = (
    f"case when not {_NEW} then list_transform({{entries}}, lambda e: case when e.client = o.user_id then {{{{'client': e.client, 'hits': e.hits + 1, 'til': e.til}}}} else e end)"
    f" when len(list_filter({_LEFT}, lambda e: e.client = o.user_id)) > 0 then list_transform({_LEFT}, lambda e: case when e.client = o.user_id then {_FRESH_ENTRY} else e end)"
    f" else list_append({_LEFT}, {_FRESH_ENTRY}) end"
)


def _bounded_sql() -> str:
    """The stores' entries as a list of structs, in the order in which they came, row by row."""
    none = "cast([] as struct(client bigint, hits bigint, til bigint)[])"
    hit = lambda prior: f"list_filter({_STORED.format(entries=prior)}, lambda e: e.client = o.user_id)[1].hits <= 3"
    shown = lambda prior: f"{_STORED.format(entries=prior)} as entries, {hit(prior)} as allowed, case when {_EVICTS.format(entries=prior)} then {prior}[1].client end::bigint as evicted"
    return f"""with recursive o as (select event_id, user_id::bigint as user_id, epoch_us(ts) as us, user_id % {_SHARDS} as shard, row_number() over (partition by user_id % {_SHARDS} order by ts, event_id) as n from events),
    s as (select o.shard, o.n, o.event_id, {shown(none)} from o where n = 1 union all select o.shard, o.n, o.event_id, {shown('s.entries')} from s join o on o.shard = s.shard and o.n = s.n + 1)
    select event_id, allowed, len(entries)::bigint as held, evicted from s"""


@query(_bounded_sql())
def bounded_store_replay(spark, sf_dir):
    """Stores by shard of users, of eight entries at most each: the oldest goes for a new one."""
    rows = _events(spark, sf_dir).withColumns({"client": F.col("user_id"), "shard": F.expr(f"user_id % {_SHARDS}")})
    out = stateful.replay_sorted(rows, "shard", stateful.bounded_store(3, _DAY, _ENTRIES), (None,), stateful.BOUNDED_RESULT, ["us", "event_id"])
    return out.select("event_id", "allowed", "held", "evicted")


_FAILED = "case when o.failed then case when {until} <> 0 then 1 else {failures} + 1 end else 0 end"
_UNTIL = f"case when o.us < {{until}} then {{until}} when ({_FAILED}) >= 2 then o.us + {_LOCK} else 0 end"
_LOCKED = f"case when o.us < {{until}} then {{failures}} else {_FAILED} end"


@query(_replay_sql({"failures": (0, _LOCKED), "until": (0, _UNTIL)}, {"locked": f"o.us < {{until}} or ({_UNTIL}) > 0", "failures": _LOCKED}))
def lockout_replay(spark, sf_dir):
    out = scan.replay(_events(spark, sf_dir), "user_id", scan.lockout(2, _LOCK), stateful.LOCKOUT_RESULT, ["us", "event_id"])
    return out.select("event_id", "locked", "failures")


_OPEN = f"{{failures}} >= 3 and o.us - {{last}} < {_COOL}"
_IN_A_ROW = f"case when {_OPEN} then {{failures}} when not o.failed then 0 when {{failures}} >= 3 then 1 else {{failures}} + 1 end"


@query(
    _replay_sql(
        {"failures": (0, _IN_A_ROW), "last": (0, f"case when not ({_OPEN}) and o.failed then o.us else {{last}} end")},
        {"state": f"case when {_OPEN} then 'open' when {{failures}} >= 2 then 'degraded' else 'healthy' end", "failures": _IN_A_ROW},
    )
)
def breaker_replay(spark, sf_dir):
    out = scan.replay(_events(spark, sf_dir), "user_id", scan.breaker(3, _COOL), stateful.BREAKER_RESULT, ["us", "event_id"])
    return out.select("event_id", "state", "failures")


_ENDS = "{status} = 1 and o.lease = {lease}"
_MOVED = f"case when o.command = 'claim' and {{status}} = 0 then 1 when o.command = 'complete' and {_ENDS} then 2 when o.command = 'fail' and {_ENDS} then case when {{attempts}} < 3 then 0 else 3 end when o.command = 'recover' and {{status}} = 1 then 0 when o.command = 'requeue' and {{status}} in (2, 3) then 0 end"
_TRIES = "case when o.command = 'claim' and {status} = 0 then {attempts} + 1 when o.command = 'requeue' and {status} in (2, 3) then 0 else {attempts} end"


@query(
    _replay_sql(
        {"status": (0, f"coalesce({_MOVED}, {{status}})"), "attempts": (0, _TRIES), "lease": (0, f"case when ({_MOVED}) is null then {{lease}} when ({_MOVED}) = 1 then o.lease else 0 end")},
        {"accepted": f"({_MOVED}) is not null", "status": f"['pending', 'reserved', 'done', 'dead'][coalesce({_MOVED}, {{status}}) + 1]", "attempts": _TRIES},
    )
)
def job_machine_replay(spark, sf_dir):
    """Commands of leased jobs: only the lease that claimed a job may end it."""
    jobs = _events(spark, sf_dir).withColumns({"command": F.expr("element_at(array('claim', 'complete', 'fail', 'recover', 'requeue'), cast(event_id % 5 + 1 as int))"), "lease": F.expr("event_id div 3")})
    out = scan.replay(jobs, "user_id", scan.jobs(3), stateful.JOB_RESULT, ["us", "event_id"])
    return out.select("event_id", "accepted", "status", "attempts")


@query("select user_id, (count(*) = 2 and bool_and(event_type in ('error', 'purchase'))) as settled from (select *, row_number() over (partition by user_id order by ts desc) as r from events) where r <= 2 group by 1")
def settled_progress(spark, sf_dir):
    return sinks.settled(read(spark, sf_dir, "events"), "user_id", "ts", "event_type in ('error', 'purchase')")


@query("select user_id, event_type, 1::bigint as n from events group by 1, 2")
def first_requests(spark, sf_dir):
    return windows.first_requests(read(spark, sf_dir, "events"), "ts", ["user_id", "event_type"]).select("user_id", "event_type", F.lit(1).cast("long").alias("n"))


@query("""select name, '# TYPE ' || name || ' gauge' || chr(10) || string_agg(l, chr(10) order by l) as exposition from (
    select 'docs_total' as name, 'docs_total{lang="' || lang || '"} ' || count(*)::varchar as l from documents group by lang) group by name""")
def prometheus_text(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("value"))
    return E.prometheus(docs.select(F.lit("docs_total").alias("name"), F.lit("lang").alias("label"), F.col("lang").alias("label_value"), "value"))


_PROFILE = lambda d: pick(d, ["research", "archive", "plain", "developer", "unknown"], "doc_id")


@query(
    f"""with v as (select * from (values ('research', ['md', 'json', 'pdf', 'docx']), ('archive', ['md', 'txt', 'json', 'pdf', 'docx', 'epub']), ('plain', ['txt']), ('developer', ['json'])) as v(profile, formats))
    select profile, format, count(*) as files, sum(n_chars)::bigint as chars from (select profile, n_chars, unnest(formats) as format from (select {_PROFILE(DUCK)} as profile, n_chars from documents) join v using (profile)) group by all"""
)
def export_profiles(spark, sf_dir):
    """The files that exports of the documents make, by profile and format."""
    docs = read(spark, sf_dir, "documents").select(F.expr(_PROFILE(SPARK)).alias("profile"), "n_chars")
    return E.planned_files(docs, "profile").groupBy("profile", "format").agg(F.count("*").alias("files"), F.sum("n_chars").alias("chars"))


@query("select doc_id, '---' || chr(10) || 'title: ' || source || chr(10) || 'lang: ' || lang || case when n_chars % 2 = 0 then chr(10) || 'size: ' || n_chars::varchar else '' end || chr(10) || '---' || chr(10) as header from documents")
def export_headers(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").withColumn("size", F.expr("if(n_chars % 2 = 0, n_chars, null)"))
    return docs.select("doc_id", E.header("source", {"lang": "lang", "size": "size"}).alias("header"))


@query("select source, string_agg(n::varchar || '. ' || doc_id::varchar, chr(10) order by n) as readme from (select source, doc_id, row_number() over (partition by source order by doc_id) as n from documents) group by 1")
def export_readme(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("source", "doc_id", F.col("doc_id").cast("string").alias("title"))
    return E.readme(docs, "source", "title", "doc_id")


_BATCH = 50


@query(f"select source, doc_id // {_BATCH} as batch, count(*) as n_files, sum(strlen(coalesce(text, '')))::bigint as total_size, count(*) + 1 + (count(*) > 1)::int as n_members, string_agg(doc_id::varchar || '.txt', ',' order by doc_id::varchar || '.txt') as listed from documents group by 1, 2")
def export_packages(spark, sf_dir):
    """A ZIP for each source and batch of documents; what its manifest and its directory list, so that results stay small."""
    docs = read(spark, sf_dir, "documents")
    name = F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))
    files_ = docs.select("source", F.expr(f"doc_id div {_BATCH}").alias("batch"), F.col("doc_id").alias("document"), name.alias("title"), name.alias("name"), F.col("text").alias("content"))
    made = E.packages(files_, ["source", "batch"])
    manifest = office.member("package", "manifest.json")
    listed = F.expr("array_join(transform(from_json(m, 'documents array<struct<files array<struct<path string>>>>').documents, d -> d.files[0].path), ',')")
    return made.select("source", "batch", "n_files", "total_size", office.member_count("package").alias("n_members"), manifest.alias("m")).withColumn("listed", listed).drop("m")


@query("select doc_id, lang, n_chars from documents")
def json_artefacts(spark, sf_dir):
    docs = files.to_artefact(read(spark, sf_dir, "documents"), ["doc_id"], ["lang", "n_chars"])
    return files.from_artefact(docs, "artefact", "lang string, n_chars bigint")


@query("select doc_id, 'uploads/' || doc_id::varchar || '/' || source || '.txt' as key from documents")
def storage_keys(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", files.storage_key("uploads", F.col("doc_id"), F.concat("source", F.lit(".txt"))).alias("key"))


@query("select doc_id, lang as language, text as body from documents")
def front_matter(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", F.expr("concat('---\nlang: ', lang, '\nurl: http://x:1\n---\n', text)").alias("t"))
    values, body = files.front_matter("t")
    return docs.select("doc_id", values["lang"].alias("language"), body.alias("body"))


@query("select event_id from events where ts < (select max(ts) from events) - interval 5 day and event_id not in (select o_orderkey from orders where o_orderstatus = 'F')")
def orphan_files(spark, sf_dir):
    e = read(spark, sf_dir, "events").select(F.col("event_id").cast("string").alias("path"), F.col("ts").alias("modificationTime"))
    newest = F.lit(e.agg(F.max("modificationTime")).first()[0]) - F.expr("interval 5 days")
    known = read(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").cast("string").alias("k"))
    return files.orphans(e, known, "k", newest).select(F.col("path").cast("long").alias("event_id"))


@query("select conv_id, turn, case when length(text) % 10 >= (length(text) * 7) % 10 then text else 'x' || text end as text, greatest(length(text) % 10, (length(text) * 7) % 10) / 10.0::double as confidence from conversations")
def better_pages(spark, sf_dir):
    turns = read(spark, sf_dir, "conversations")
    first = turns.select("conv_id", "turn", "text", ((F.length("text") % 10) / 10.0).alias("confidence"))
    second = turns.select("conv_id", "turn", F.concat(F.lit("x"), "text").alias("text"), ((F.length("text") * 7 % 10) / 10.0).alias("confidence"))
    return E.better_pages(first, second, ["conv_id", "turn"])
