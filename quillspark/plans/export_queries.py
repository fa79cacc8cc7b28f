"""Queries of office formats, stored objects, functions by name, requests and dead letters."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.functions import analysis as A
from quillspark.functions import cleaning as C
from quillspark.functions import ir, sql
from quillspark.functions import normalizers as N
from quillspark.functions.dialect import DUCK
from quillspark.operators import derivations as D
from quillspark.operators import predicates as P
from quillspark.plans.relational_queries import _JOBS, _jobs
from quillspark.plans.registry import query, read
from quillspark.session import table_path
from quillspark.sources import files, office

# --- docx and epub ---


def _documents(spark, sf_dir):
    """Blocks of every kind from the columns of each document."""
    run = lambda x, bold="false": f"named_struct('content', {x}, 'bold', {bold}, 'italic', false, 'strikethrough', false)"
    block = lambda kind, **v: "named_struct(" + ", ".join(f"'{n}', {v.get(n, 'null')}" for n in ("type", "level", "ordered", "start_number", "alignment", "content", "items", "code")).replace("'type', null", f"'type', '{kind}'") + ")"
    blocks = (
        block("heading", level="2", content=f"array({run('source')})"),
        block("paragraph", alignment="if(lang = 'en', 'left', 'right')", content=f"array({run('lang', 'true')}, {run('coalesce(text, ' + chr(39) * 2 + ')')})"),
        block("list", ordered="true", start_number="3", items=f"array(array({run('lang')}), array({run('cast(n_chars as string)')}))"),
        block("code-block", code="concat('a < b & c\n', source)"),
    )
    rows = read(spark, sf_dir, "documents").selectExpr("doc_id", "source", *[f"cast({b} as {ir.BLOCK.simpleString()}) as b{i}" for i, b in enumerate(blocks)])
    return rows.select("doc_id", "source", F.array(*[f"b{i}" for i in range(len(blocks))]).alias("blocks"))


def _esc(x: str) -> str:
    return f"replace(replace(replace(regexp_replace({x}, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x{{FFFE}}\\x{{FFFF}}]', '', 'g'), '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"


_TEXT, _BREAK = '<w:t xml:space="preserve">', '</w:t><w:br/><w:t xml:space="preserve">'
_WORD_TEXT = f"replace({_esc('coalesce(text, ' + chr(39) * 2 + ')')}, chr(10), '{_BREAK}')"


@query(
    f"""select doc_id, md5('{office.HEAD.strip()}' || chr(10) || '<w:document xmlns:w="{office.WORD}"><w:body><w:p><w:pPr><w:pStyle w:val="Heading2"/></w:pPr><w:r>{_TEXT}' || {_esc('source')} || '</w:t></w:r></w:p><w:p>'
    || case when lang = 'en' then '' else '<w:pPr><w:bidi/></w:pPr>' end || '<w:r><w:rPr><w:b/></w:rPr>{_TEXT}' || {_esc('lang')} || '</w:t></w:r><w:r>{_TEXT}' || {_WORD_TEXT} || '</w:t></w:r></w:p>'
    || '<w:p><w:pPr><w:pStyle w:val="ListParagraph"/></w:pPr><w:r>{_TEXT}3. </w:t></w:r><w:r>{_TEXT}' || lang || '</w:t></w:r></w:p><w:p><w:pPr><w:pStyle w:val="ListParagraph"/></w:pPr><w:r>{_TEXT}4. </w:t></w:r><w:r>{_TEXT}' || n_chars::varchar
    || '</w:t></w:r></w:p><w:p><w:pPr><w:pStyle w:val="Code"/></w:pPr><w:r>{_TEXT}a &lt; b &amp; c{_BREAK}' || source || '</w:t></w:r></w:p><w:sectPr/></w:body></w:document>') as result from documents"""
)
def export_docx(spark, sf_dir):
    """Each document as a docx; the digest of its document part, read back from the package."""
    made = office.render_docx(_documents(spark, sf_dir))
    return made.select("doc_id", F.md5(office.member("docx", "word/document.xml")).alias("result"))


@query(
    f"""select doc_id, md5('{office.HEAD.strip()}' || chr(10) || '<html xmlns="http://www.w3.org/1999/xhtml" xmlns:epub="http://www.idpf.org/2007/ops" lang="ar"><head><title>' || {_esc('source')} || '</title></head><body><h2>' || {_esc('source')} || '</h2><p'
    || case when lang = 'en' then '' else ' dir="rtl"' end || '><b>' || {_esc('lang')} || '</b>' || replace({_esc('coalesce(text, ' + chr(39) * 2 + ')')}, chr(10), '<br/>') || '</p><p class="item">3. ' || lang || '</p><p class="item">4. ' || n_chars::varchar
    || '</p><pre>a &lt; b &amp; c' || chr(10) || source || '</pre></body></html>') as result from documents"""
)
def export_epub(spark, sf_dir):
    """Each document as an epub; the digest of its text, read back from the package."""
    made = office.render_epub(_documents(spark, sf_dir), "source")
    return made.select("doc_id", F.md5(office.member("epub", "OEBPS/text.xhtml")).alias("result"))


# --- objects ---


@query("select n_nationkey, case when strlen(n_name) <= 7 then n_name end as content, (strlen(n_name) + 1)::bigint as size from nation")
def stored_objects(spark, sf_dir):
    """A text object for each nation, put and listed; those over eight bytes are listed without content."""
    path = table_path(spark, "objects")
    read(spark, sf_dir, "nation").select("n_nationkey", "n_name").repartition("n_nationkey").write.partitionBy("n_nationkey").text(path)
    found = files.objects(spark, path, "part-*", most=8)
    key = F.regexp_extract("path", "n_nationkey=([0-9]+)/", 1).cast("long")
    return found.select(key.alias("n_nationkey"), F.rtrim(F.regexp_replace(F.decode("content", "UTF-8"), "\n", "")).alias("content"), F.col("length").alias("size"))


# --- functions by name ---


@query(
    f"select doc_id, {N.fold_index(DUCK, 'text')} as folded, {C.similarity(DUCK, 'text', 'source')} as similarity, cast({A.word_count(DUCK, 'text')} as bigint) as words,"
    f" cast({A.script_ratio(DUCK, 'text')} as double) as arabic_ratio, cast({A.page_estimate(DUCK, A.word_count(DUCK, 'text'))} as bigint) as pages from documents"
)
def sql_functions(spark, sf_dir):
    """Functions of the library, called by name in SQL. Fields are asked for where they are made: of a struct of a subquery with two costly fields Catalyst makes all."""
    sql.register(spark)
    read(spark, sf_dir, "documents").createOrReplaceTempView("__qs_documents")
    return spark.sql(
        "select doc_id, normalize_arabic(text) as folded, text_similarity(text, source) as similarity, text_word_count(text) as words, analyze_text(text).arabic_ratio as arabic_ratio, analyze_text(text).page_count as pages from __qs_documents"
    )


# --- requests and dead letters ---


@query("select user_id, event_type, count(distinct event_id)::bigint as n, case when count(distinct event_id) > 50 then 'TOO_MANY' end as error from events group by 1, 2")
def batch_limits(spark, sf_dir):
    """Requests as groups of ids: those of more than 50 are refused."""
    return P.batch_errors(read(spark, sf_dir, "events"), ["user_id", "event_type"], "event_id")


@query(f"select id, queue, json_extract_string(dead_letter, '$.attempts')::bigint as attempts, json_extract_string(dead_letter, '$.error') as error from (select *, to_json(struct_pack(attempts := attempts, error := 'E' || (attempts % 3)::varchar)) as dead_letter from {_JOBS} where status = 'dead')")
def dead_letters(spark, sf_dir):
    """Jobs that died, with what was noted about their end."""
    jobs = _jobs(spark, sf_dir).withColumn("last_error", F.concat(F.lit("E"), (F.col("attempts") % 3).cast("string")))
    noted = D.dead_letters(jobs, "last_error")
    return noted.select("id", "queue", F.get_json_object("dead_letter", "$.attempts").cast("long").alias("attempts"), F.get_json_object("dead_letter", "$.error").alias("error"))


@query(f"select id, case when status = 'dead' and queue = 'ocr' then 'pending' else status end as status, case when status = 'dead' and queue = 'ocr' then 0 else attempts end as attempts from {_JOBS}")
def requeued_letters(spark, sf_dir):
    """Dead jobs of one queue made pending again; others stay as they are."""
    return D.requeue(_jobs(spark, sf_dir), F.col("queue") == "ocr").select("id", "status", "attempts")
