"""Queries of full-text search and tagging on ``documents``."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.functions.dialect import DUCK, SPARK
from quillspark.functions.normalizers import fold_token, tokens
from quillspark.operators import search as S
from quillspark.operators import tagging as G
from quillspark.plans.registry import pick, query, read
from quillspark.session import table_path

FIELDS = {"A": "source", "B": "lang", "D": "text"}
QUERY = "the that"

_POSTINGS = (
    "with f as (" + " union all ".join(f"select doc_id, '{w}' as weight, {S.terms(DUCK, f'coalesce({c}, {chr(39)}{chr(39)})')} as ts from documents" for w, c in FIELDS.items()) + "),"
    " n as (select doc_id, sum(len(ts)) as doc_len from f group by 1), e as (select doc_id, weight, unnest(ts) as term from f),"
    " p as (select e.doc_id, cast(doc_len as int) as doc_len, term, weight, count(*) as tf from e join n on e.doc_id = n.doc_id group by all)"
)
_WEIGHT = "case weight when 'A' then 1.0 when 'B' then 0.4 when 'C' then 0.2 else 0.1 end"
_RANKED = f"{_POSTINGS}, m as (select doc_id, sum({_WEIGHT}::double * tf / (1 + ln(doc_len))) as rank from p where term in ('the', 'that') group by 1 having count(distinct term) = 2)"


def _index(spark, sf_dir):
    return S.postings(read(spark, sf_dir, "documents"), "doc_id", FIELDS)


_stored: dict[tuple, str] = {}


def _once(spark, sf_dir, name, write) -> str:
    """The path of an index of ``documents``: stored once for an application and a state of the table's files."""
    files = spark.read.format("binaryFile").load(f"{sf_dir}/documents.parquet")
    state = tuple(files.agg(F.count("*"), F.sum("length"), F.max("modificationTime"), F.sum(F.xxhash64("path", "length", "modificationTime").cast("decimal(38,0)"))).first())
    key = (spark.sparkContext.applicationId, sf_dir, state, name)
    if key not in _stored:
        path = table_path(spark, name)
        write(path)
        _stored[key] = path
    return _stored[key]


def _stored_index(spark, sf_dir):
    return _once(spark, sf_dir, "postings", lambda path: S.write_postings(_index(spark, sf_dir), path))


def _ranked_index(spark, sf_dir):
    """The path of the index by impact, made from the texts: a document's impacts need no other document."""
    return _once(spark, sf_dir, "ranked", lambda path: S.write_impacts(S.impacts(read(spark, sf_dir, "documents"), "doc_id", FIELDS), path))


def _found(spark, sf_dir):
    return S.read_postings(spark, _stored_index(spark, sf_dir), QUERY)


@query(f"{_POSTINGS} select doc_id, doc_len, term, weight, tf from p")
def postings(spark, sf_dir):
    return _index(spark, sf_dir)


@query(f"{_POSTINGS} select doc_id, doc_len, term, tf from p where weight = 'D'")
def postings_unweighted(spark, sf_dir):
    """One field, as a trigger would index it."""
    index = S.postings(read(spark, sf_dir, "documents"), "doc_id", FIELDS)
    return index.where("weight = 'D'").select("doc_id", "doc_len", "term", "tf")


@query(f"{_RANKED} select doc_id, floor(rank * 1e6 + 0.5)::bigint as rank_ppm from m")
def search_match(spark, sf_dir):
    return S.match(_found(spark, sf_dir), QUERY, "doc_id").select("doc_id", F.floor(F.col("rank") * 1e6 + 0.5).cast("long").alias("rank_ppm"))


@query(f"{_RANKED} select doc_id from m join documents using (doc_id) order by rank desc, doc_id limit 20")
def search_ranked(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id")
    return S.search(docs, _found(spark, sf_dir), QUERY, "doc_id").select("doc_id")


@query(f"{_RANKED} select doc_id from m join documents using (doc_id) order by round(rank, 9) desc, doc_id limit 20")
def search_by_impact(spark, sf_dir):
    """The same page from the index by impact, which is opened as far as the page needs."""
    docs = read(spark, sf_dir, "documents").select("doc_id")
    return S.search_tiers(docs, _ranked_index(spark, sf_dir), QUERY, "doc_id").select("doc_id")


@query(f"{_RANKED} select doc_id from m join documents using (doc_id) where source = 'src1' and n_chars > 300 order by rank desc, doc_id limit 10 offset 10")
def search_filtered(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    return S.search(docs, _found(spark, sf_dir), QUERY, "doc_id", (F.col("source") == "src1") & (F.col("n_chars") > 300), number=2, limit=10).select("doc_id")


@query("select case when weight in ('A', 'B') then weight else 'D' end as weight, count(*) as postings, count(distinct term) as terms, sum(tf)::bigint as words from (" + _POSTINGS + " select * from p) group by 1")
def stored_index(spark, sf_dir):
    """What the stored index holds, by field."""
    index = spark.read.parquet(_stored_index(spark, sf_dir))
    return index.groupBy("weight").agg(F.count("*").alias("postings"), F.count_distinct("term").alias("terms"), F.sum("tf").alias("words"))


def _asked(d) -> str:
    return pick(d, ["", " ", "a", " ab ", "ـ_", "كتاب", "a b"], "event_id")


@query(f"select event_id, {S.valid_query(DUCK, _asked(DUCK))} as valid from events")
def query_checks(spark, sf_dir):
    return read(spark, sf_dir, "events").select("event_id", F.expr(S.valid_query(SPARK, _asked(SPARK))).alias("valid"))


@query(f"select doc_id, {S.excerpt(DUCK, 'text', chr(39) + 'ation' + chr(39))} as excerpt from documents")
def excerpts(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.expr(S.excerpt(SPARK, "text", "'ation'")).alias("excerpt"))


@query("select doc_id, array_to_string(list_filter([case when contains(lower(source), 'src1') then 'source' end, case when contains(lower(text), 'src1') then 'text' end], lambda x: x is not null), ',') as matched from documents")
def matched_fields(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.array_join(S.matched_in("src1", {"source": "source", "text": "text"}), ",").alias("matched"))


@query("with t as (select 'title' as kind, w as text, count(*) as n, 0 as place from (select regexp_extract(text, '^[^ .,]+') as w from documents) where contains(lower(w), 'en') group by 2 order by n desc, 2 limit 5), g as (select 'tag' as kind, lang as text, count(*) as n, 1 as place from documents where contains(lower(lang), 'en') group by 2 order by n desc, 2 limit 3) select kind, text, n from (select * from t union all select * from g) order by n desc, place, text limit 8")
def suggest(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    return S.suggest({"title": docs.select(F.regexp_extract("text", "^[^ .,]+", 0).alias("text")), "tag": docs.select(F.col("lang").alias("text"))}, "en")


_WORDS = f"w as (select doc_id, token, count(*) as n from (select doc_id, unnest({tokens(DUCK, 'coalesce(text, ' + chr(39) + chr(39) + ')')}) as token from documents) group by 1, 2)"
_TAGS = "tags as (select * from (values ('that thing'), ('des'), ('und die'), ('los las'), ('no such words')) as v(name))"
_EXISTING = (
    f"s as (select name, len({tokens(DUCK, 'name')}) as size, unnest({tokens(DUCK, 'name')}) as token from tags), r as (select name, size, token, count(*) as times from s group by all),"
    " x as (select doc_id, name, floor(sum(times) / size * 100 + 0.5) / 100 as score from w join r using (token) group by doc_id, name, size)"
)
_NEW = (
    f"k as (select unnest({tokens(DUCK, 'name')}) as token from tags union select {fold_token(DUCK, 'name')} from tags), top as (select doc_id, max(n) as top from w group by 1),"
    " y as (select doc_id, token as name, floor(n / top * 100 + 0.5) / 100 as score from (select *, row_number() over (partition by doc_id order by n desc, token) as r from w where token not in (select token from k)) join top using (doc_id) where r <= 5)"
)


def _tagged(spark, sf_dir):
    words = G.document_tokens(read(spark, sf_dir, "documents"), "doc_id", "text")
    return words, spark.sql("select * from values ('that thing'), ('des'), ('und die'), ('los las'), ('no such words') as v(name)")


@query(f"with {_WORDS} select * from w")
def tag_tokens(spark, sf_dir):
    return _tagged(spark, sf_dir)[0].drop("top")


@query(f"with {_WORDS}, {_TAGS}, {_EXISTING} select * from x")
def auto_tags_existing(spark, sf_dir):
    words, tags = _tagged(spark, sf_dir)
    return G.existing_tags(words, tags, "doc_id")


@query(f"with {_WORDS}, {_TAGS}, {_NEW} select * from y")
def auto_tags_new(spark, sf_dir):
    words, tags = _tagged(spark, sf_dir)
    return G.new_tags(words, tags, "doc_id")


@query(
    f"with {_WORDS}, {_TAGS}, {_EXISTING}, {_NEW} select doc_id, name, score, kind from (select *, row_number() over (partition by doc_id order by score desc, kind, name) as r from (select *, 'existing' as kind from x union all select *, 'new' from y)) where r <= 15"
)
def auto_tags(spark, sf_dir):
    words, tags = _tagged(spark, sf_dir)
    return G.suggestions(G.existing_tags(words, tags, "doc_id"), G.new_tags(words, tags, "doc_id"), "doc_id")
