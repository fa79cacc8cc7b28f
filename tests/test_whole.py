"""Queries that must see all of a text and all rows of a table, on small tables of their own."""

import hashlib

import pytest

import __spark_entry__ as entry
from quillspark.functions.analysis import edit_distance

FILL = "Plain words that fill more than a hundred characters, so that what follows stands far from the start of the text. "
MARKDOWN = f"{FILL}\n\n## Late\n\n- x\n- y\n\nLast words"
#: Form feeds and page breaks far from the start.
PAGES = f"{FILL}\fsecond===PAGE_BREAK=== third \f\f fourth===PAGE_BREAK===fifth"
#: Two turns that differ after character 200 alone, letters of several bytes, a turn of spaces.
TURNS = {(1, 0): "ab " * 80 + "one end", (1, 1): "ab " * 80 + "another", (2, 0): "é\t ü" * 90, (2, 1): "é ö" * 70, (2, 2): "  "}


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """A folder of small tables."""
    out = str(tmp_path_factory.mktemp("tables"))
    docs = [(1, MARKDOWN, "a"), (2, "short", "b"), (3, None, "c"), (4, "", "d"), (6, PAGES, "a")]
    spark.createDataFrame(docs, "doc_id bigint, text string, source string").write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame([(*k, t) for k, t in TURNS.items()], "conv_id bigint, turn int, text string").write.parquet(f"{out}/conversations.parquet")
    return out


def found(spark, tables, name):
    return entry.queries()[name](spark, tables).collect()


def test_ir_blocks(spark, tables):
    tail = [("list", None, "one / two"), ("list", None, "a / b"), ("paragraph", None, "x | y\n1 | 2"), ("code-block", None, "code")]
    want = {
        1: [("heading", 1, "t"), ("paragraph", None, FILL.strip()), ("heading", 2, "Late"), ("list", None, "x / y"), ("paragraph", None, "Last words b i"), *tail],
        2: [("heading", 1, "t"), ("paragraph", None, "short b i"), *tail],
        4: [("heading", 1, "t"), ("paragraph", None, "b i"), *tail],
        6: [("heading", 1, "t"), ("paragraph", None, "\n".join(x.strip() for x in PAGES.split("\n")) + " b i"), *tail],
    }
    assert sorted(map(tuple, found(spark, tables, "ir_blocks"))) == sorted((i, n, *b) for i, blocks in want.items() for n, b in enumerate(blocks))


def test_ir_outline(spark, tables):
    assert sorted(map(tuple, found(spark, tables, "ir_outline"))) == [(1, 0, 1, "t"), (1, 2, 2, "Late"), (2, 0, 1, "t"), (4, 0, 1, "t"), (6, 0, 1, "t")]


def test_ir_markdown(spark, tables):
    tail = "- one\n- two\n\n1. a\n2. b\n\nx | y\n1 | 2\n\n```\ncode\n```"
    md5 = lambda t: hashlib.md5(t.encode()).hexdigest()
    got = {r.doc_id: r.result for r in found(spark, tables, "ir_markdown")}
    assert got[1] == md5(f"# t\n\n{FILL.strip()}\n\n## Late\n\n- x\n- y\n\nLast words **b** *i*\n\n{tail}")
    assert got[2] == md5(f"# t\n\nshort **b** *i*\n\n{tail}") and got[3] is None


def test_cer_turns(spark, tables):
    text = {k: " ".join(t.split()) for k, t in TURNS.items()}
    want = {}
    for (c, n), t in text.items():
        p = text.get((c, n + 1), "")
        want[c, n] = 1.0 if not p else len(p) if not t else edit_distance(t, p) / len(t)
    got = {(r.conv_id, r.turn): r.cer for r in found(spark, tables, "cer_turns_whole")}
    assert got == pytest.approx(want) and 0 < got[1, 0] < 0.1


def test_page_splits(spark, tables):
    md5 = lambda pages: hashlib.md5("|".join(p.strip() for p in pages).encode()).hexdigest()
    got = {r.doc_id: r for r in found(spark, tables, "page_splits")}
    for i, text in ((1, MARKDOWN), (2, "short"), (3, ""), (4, ""), (6, PAGES)):
        text = f"p1 \f\f{text}===PAGE_BREAK=== b ===PAGE_BREAK===c"
        marked, fed = text.split("===PAGE_BREAK===") + [""] * (i % 5), [p for p in text.split("\f") if p]
        assert (got[i].n_marked, got[i].marked, got[i].n_fed, got[i].fed) == (len(marked), md5(marked), len(fed), md5(fed))
    assert (got[6].n_marked, got[6].n_fed) == (6, 4)


def test_set_sizes(spark, tables):
    a, b = set(MARKDOWN.split(" ")), set(PAGES.split(" "))
    assert list(map(tuple, found(spark, tables, "set_sizes"))) == [(1, len(a & b), len(a | b))]
    assert "third" in b and "words" in a and len(a | b) > len(set(MARKDOWN[:100].split(" ")) | set(PAGES[:100].split(" ")))


def test_journeys(spark, tmp_path):
    docs = [(i, "a", i * 7 % 50) for i in range(250)] + [(900 + i, "b", 5) for i in range(4)]
    spark.createDataFrame(docs, "doc_id bigint, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    want = []
    for source in "ab":
        rows = sorted((n, i) for i, s, n in docs if s == source)
        for k in range(0, len(rows), 100):
            part = rows[k : k + 100]
            want.append((source, k // 100, len(part), sum(n for n, _ in part), ",".join(str(i) for _, i in part)))
    assert sorted(map(tuple, found(spark, str(tmp_path), "journeys"))) == want
    assert sum(w[2] for w in want) == len(docs)


def test_python_gets_texts_in_small_batches(spark, tmp_path):
    """A worker holds a few hundred whole texts and what is made of them, not ten thousand."""
    import pandas as pd
    from pyspark.sql import functions as F

    from quillspark.session import read_table

    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.range(3000).selectExpr("id as doc_id", "'a' as text").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    rows = F.pandas_udf(lambda s: pd.Series([len(s)] * len(s)), "long")
    assert read_table(spark, str(tmp_path), "documents").coalesce(1).select(rows("text").alias("n")).agg(F.max("n")).first()[0] <= 250
