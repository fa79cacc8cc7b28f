"""Pinned vectors and laws of the text operators."""

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillspark.functions import analysis, cleaning, dialect, labels, normalizers
from quillspark.functions.dialect import SPARK
from quillspark.functions.ir import parse, protected_spans, render


def cleaned(spark, texts, **options):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    return [r.cleaned for r in cleaning.clean(df, options=cleaning.CleanOptions(**options)).orderBy("i").collect()]


def one(spark, sql, **columns):
    df = spark.createDataFrame([tuple(columns.values())], list(columns)) if columns else spark.range(1)
    return df.select(F.expr(sql).alias("x")).first().x


DEFAULT = [
    ("‫بسم الله‏", "بسم الله"),
    ("بسم​الله", "بسمالله"),
    ("بسم­الله", "بسمالله"),
    ("آمن أمن إيمان", "امن امن ايمان"),
    ("على", "علي"),
    ("ال كتاب", "الكتاب"),
    ("قال", "قال"),
    ("كتـــاب", "كتاب"),
    ("بسم   الله   الرحمن", "بسم الله الرحمن"),
    ("بسم بسم بسم بسم الله", "بسم الله"),
    ("الله الله الله", "الله"),
    ("بسم الله بسم الله بسم الله", "بسم الله"),
    ("", ""),
    ("   \n\n  ", ""),
    ("بسم", "بسم"),
]


def test_default_vectors(spark):
    assert cleaned(spark, [a for a, _ in DEFAULT]) == [b for _, b in DEFAULT]


def test_options(spark):
    assert cleaned(spark, ["كِتَاب", "كتابًا"], remove_tashkeel=True) == ["كتاب", "كتابا"]
    assert "finish" in cleaned(spark, ["ﬁnish"], remove_ascii_noise=False)[0]
    assert "ة" in cleaned(spark, ["مدرسة"])[0]


def test_null_stays_null(spark):
    assert cleaned(spark, [None]) == [None]


def test_idempotent_on_arabic(spark):
    texts = ["السطر الأول من النص\nالسطر الثاني.\n\n12\nالفصل الأول\nنص طويل يكفي ليكون سطرا كاملا في الصفحة المطبوعة هنا"]
    once = cleaned(spark, texts)
    assert cleaned(spark, once) == once


def test_exam_mode(spark):
    text = "س1: ما العاصمة؟\nج: القاهرة\n(أ) نعم\nس2: x\nس3: y"
    assert one(spark, cleaning.exam_score(SPARK, "t"), t=text) >= 4
    df = spark.createDataFrame([(text,)], "text string")
    assert "(ا) نعم" in cleaning.clean(df, mode="auto").first().cleaned


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet=st.characters(min_codepoint=0x600, max_codepoint=0x6FF), max_size=60))
def test_merging_lines_keeps_words(text):
    assert cleaning.merge_lines(text).split() == text.split()


@pytest.mark.parametrize(
    ("lines", "merged"),
    [
        ("هذا سطر طويل لا ينتهي بعلامة ترقيم ويتجاوز الحد\nوهذا تمامه.", "هذا سطر طويل لا ينتهي بعلامة ترقيم ويتجاوز الحد وهذا تمامه."),
        ("## عنوان\nنص", "## عنوان\nنص"),
        ("- بند\n- بند", "- بند\n- بند"),
        ("قصير\nقصير", "قصير\nقصير"),
        ("ذهب الولد الى المدرسة من\nالبيت", "ذهب الولد الى المدرسة من البيت"),
    ],
)
def test_merge_lines(lines, merged):
    assert cleaning.merge_lines(lines) == merged


def test_near_paragraphs():
    a = "one two three four five six seven"
    assert cleaning.drop_near_paragraphs(f"{a}\n\n{a} eight\n\nother words entirely here now") == f"{a}\n\nother words entirely here now"
    assert cleaning.drop_near_paragraphs("short\n\nshort") == "short\n\nshort"


def test_html(spark):
    assert one(spark, cleaning.remove_broken_html(SPARK, "t"), t="a<BR/>b<b>c</b><span x=1>d</span><x y>e < 5") == "a\nbcde < 5"


def test_repeated_tokens_need_ascii_edges(spark):
    sql = cleaning.remove_repeated_tokens(SPARK, "t")
    assert one(spark, sql, t="the the the the end") == "the end"
    assert one(spark, sql, t="قل قل قل قل قل") == "قل قل قل قل قل"


def test_page_noise(spark):
    text = "12\n- 3 -\n4 / 9\n[7]\nPage 4\n5 of 9\n•••\nABC\nنص\n\n1-2"
    assert one(spark, cleaning.remove_page_noise(SPARK, "t"), t=text) == "نص\n"


def test_headings(spark):
    text = "الفصل الأول\n(3) بند\n4. بند\nالخاتمة\n# x\nنص"
    assert one(spark, cleaning.detect_headings(SPARK, "t"), t=text) == "## الفصل الأول\n## (3) بند\n## 4. بند\n### الخاتمة\n# x\nنص"


def test_normalizers_differ(spark):
    text = "أإآةىؤئـَ_x  Y"
    assert one(spark, normalizers.fold_index(SPARK, "t"), t=text) == "اااهيؤئ_x  Y"
    assert one(spark, normalizers.fold_query(SPARK, "t"), t=text) == "اااهيءء x Y"
    assert one(spark, normalizers.fold_token(SPARK, "t"), t=text) == "اااهيويـ_x  y"


def test_analysis_of_empty_and_null(spark):
    df = spark.createDataFrame([("",), (None,)], "text string")
    for r in analysis.analyze(df).collect():
        assert (r.word_count, r.char_count, r.heading_count, r.paragraph_count, r.page_count) == (0, 0, 0, 0, 1)
        assert r.arabic_ratio == 0 and 0 <= r.quality_score <= 100


def test_analysis(spark):
    text = "# عنوان\n\n" + "كلمة " * 600 + "\n\n## آخر\n<b>x"
    r = analysis.analyze(spark.createDataFrame([(text,)], "text string")).first()
    assert (r.level1_heading_count, r.level2_heading_count, r.heading_count, r.html_fragment_count) == (1, 1, 2, 1)
    assert r.word_count == 605 and r.page_count == 3 and r.paragraph_count == 2


def test_error_rates(spark):
    cer = lambda t, p: one(spark, analysis.character_error_rate("t", "p"), t=t, p=p)
    assert cer("abc", "abc") == 0 and cer("abc", "") == 1 and cer("abcd", "abxd") == 0.25
    df = spark.createDataFrame([("a b c", "a b c"), ("a b c", ""), ("a b c", "a x c")], "t string, p string")
    assert [round(r.w, 3) for r in df.select(analysis.word_error_rate("t", "p").alias("w")).collect()] == [0, 1, 0.333]


def test_labels(spark):
    assert one(spark, labels.page_range(SPARK, "t", "4"), t="1,3-5") == [1, 3, 4]
    assert one(spark, labels.sanitize_title(SPARK, "t"), t='a/b: c"') == "ab_c"
    assert one(spark, labels.sanitize_title(SPARK, "t"), t="???") == "untitled"
    assert one(spark, labels.title_of_file(SPARK, "t"), t="x.y.PDF") == "x.y"
    assert one(spark, labels.failure_code(SPARK, "t"), t="boom PDF_MALFORMED") == "PDF_INVALID"
    assert one(spark, labels.failure_category(SPARK, "t"), t="JOB_ABORTED") == "fatal"
    assert one(spark, labels.final_code("'transient'", "'X'", "3", "3")) == "RETRY_EXHAUSTED"
    assert one(spark, labels.split_pages(SPARK, "t", "3"), t="a ===PAGE_BREAK=== b") == ["a", "b", ""]
    assert "secret" not in one(spark, labels.redact(SPARK, "t"), t="Bearer secret at https://secret.example/x")
    assert one(spark, labels.backoff_ms("3", "'ocr'")) == 40000
    for url, safe in (("https://a.org/x", True), ("http://127.0.0.1", False), ("ftp://a.org", False), ("x", False), ("https://172.16.0.1", False), ("https://172.32.0.1", True)):
        assert one(spark, labels.safe_url(SPARK, "t"), t=url) is safe, url


def test_blocks():
    kinds = [(b["type"], b["level"]) for b in parse("# A\n## B\ntext **b** *i*\n\n- x\n- y\n- z\n\n1. p\n2. q\n\n```\ncode\n```\n---\n|a|b|\n|-|-|\n|1|2|")]
    assert kinds == [("heading", 1), ("heading", 2), ("paragraph", None), ("list", None), ("list", None), ("code-block", None), ("paragraph", None)]
    bullets, ordered = parse("- a\n- b\n- c")[0], parse("1. a\n2. b")[0]
    assert (bullets["ordered"], len(bullets["items"])) == (False, 3)
    assert (ordered["ordered"], ordered["start_number"], len(ordered["items"])) == (True, 1, 2)
    assert parse("أ. اول\nب. ثان")[0]["ordered"] is True
    assert parse("") == []
    parse("### \n\n   \n- \n\nplain")
    runs = parse("هذا **نص عريض** و *مائل*")[0]["content"]
    assert [(r["bold"], r["italic"]) for r in runs] == [(False, False), (True, False), (False, False), (False, True)]


@settings(max_examples=80, deadline=None)
@given(st.text(alphabet="#-*|`1. \nabأ", max_size=60))
def test_parsing_never_fails_and_rendering_settles(text):
    once = render(parse(text))
    parse(once)


def test_protected_spans():
    text = "قال ﴿x﴾ المادة 15 قانون رقم 4"
    assert [text[s["start"] : s["end"]] for s in protected_spans(text)] == ["﴿x﴾", "المادة 15", "قانون رقم 4"]


PASSES = [
    cleaning.strip_controls, cleaning.normalize_letters, cleaning.remove_tashkeel, cleaning.normalize_whitespace, cleaning.remove_broken_html, cleaning.remove_ascii_noise,
    cleaning.remove_repeated_tokens, cleaning.remove_garbage_symbols, cleaning.normalize_punctuation, cleaning.remove_isolated_fragments, cleaning.collapse_repeated_words,
    cleaning.detect_headings, cleaning.detect_late_headings, cleaning.remove_page_noise, cleaning.final_cleanup,
]


@pytest.mark.parametrize("make", PASSES, ids=lambda f: f.__name__)
def test_passes_are_linear_in_white_space(spark, make):
    """A million inner spaces between Arabic letters, marks and a sign that a pattern waits for."""
    import time

    df = spark.sql("select concat('كتاب ©', repeat(' ', 1000000), 'كتاب , <b> ', repeat('~', 1000)) as text")
    df.select(F.expr(make(SPARK, "text"))).collect()
    began = time.time()
    df.select(F.expr(make(SPARK, "text"))).collect()
    assert time.time() - began < 2


def test_auto_mode_keeps_every_row(spark):
    df = spark.createDataFrame([(1, "س1: ما\nج: (أ) نعم ..."), (2, "كتاب"), (3, None), (4, "")], "id int, text string")
    got = {r.id: r.cleaned for r in cleaning.clean(df, mode="auto").collect()}
    one = {r.id: r.cleaned for r in cleaning.clean(df).where("id > 1").collect()}
    assert got == one | {1: cleaning.clean(df, mode="exam").where("id = 1").first().cleaned}


def test_spark_and_duckdb_agree_on_random_texts(spark):
    """Spark's patterns differ in form from DuckDB's (look-arounds, guards, possessive runs): not in what they do."""
    import random

    import duckdb
    import pandas as pd

    rng = random.Random(11)
    alphabet = list("اللكبةه،؛؟,,;?!!©()[]12 \n\t aZ-.…#~«»؛；？<b>") + ["  ", " \n ", "ال ", "© 12ه", " ه)"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(4000)]
    both = pd.DataFrame({"i": range(len(texts)), "text": texts})
    df, con = spark.createDataFrame(both), duckdb.connect()
    con.register("t", both)
    duckdb_dialect = dialect.DUCK
    makes = [p for p in PASSES if p not in (cleaning.remove_repeated_tokens, cleaning.collapse_repeated_words)]
    makes += [normalizers.fold_query, normalizers.fold_index, lambda d, x: d.trim(x), lambda d, x: d.solid(x), lambda d, x: f"cast({analysis.word_count(d, x)} as {'varchar' if d.duck else 'string'})"]
    got = df.select("i", *[F.expr(m(SPARK, "text")).alias(f"c{n}") for n, m in enumerate(makes)]).toPandas().set_index("i").sort_index()
    for n, make in enumerate(makes):
        want = [r[0] for r in con.sql(f"select {make(duckdb_dialect, 'text')} from t order by i").fetchall()]
        for a, b, t in zip(got[f"c{n}"], want, texts):
            assert a == b, (n, t, a, b)


def test_repeats_found_from_a_hint_are_those_of_the_pattern(spark):
    import random

    rng = random.Random(12)
    words = ["اب", "ب", "باب", "جد", "a", "،"]
    texts = ["".join(rng.choice(words) + rng.choice([" ", " ", "\n", "  ", ""]) for _ in range(rng.randint(0, 16))) for _ in range(4000)]
    letter = r"[\x{0600}-\x{06FF}]"
    from quillspark.functions.dialect import WS

    plain = SPARK.chain("text", ((rf"({letter}{{2,}}+)({WS}++\1){{2,}}", "$1"), (rf"((?:{letter}++{WS}++){{1,3}}{letter}++)({WS}++\1){{2,}}", "$1")))
    df = spark.createDataFrame([(t,) for t in texts], "text string").select("text", F.expr(plain).alias("a"), F.expr(cleaning.collapse_repeated_words(SPARK, "text")).alias("b"))
    assert df.where("a <> text").count() > 50 and df.where("a <> b").count() == 0


def test_repeats_are_replaced_only_where_three_stand_in_a_row(spark):
    """The signs that let the costly patterns run are necessary, whole words or parts of them, and two in a row no longer are enough."""
    import random

    rng = random.Random(5)
    texts = [" ".join(rng.choice(["اب", "ج", "اباب", "باب", "a", "ab", "b-ab"]) for _ in range(rng.randint(1, 25))).replace(" ", rng.choice([" ", "\n", "  "]), rng.randint(0, 4)) for _ in range(4000)]
    texts += ["زاب ج اب ج اب جد", "xab-ab ab ab abc", "زاب اب ابج", "اب ج د ه اب ج د ه اب ج د ه", "اب  ج اب ج اب ج"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").repartition(4)
    C, d, letter = cleaning, SPARK, r"[\x{0600}-\x{06FF}]"
    plain = d.replace("t", rf"{C.EDGE}({dialect.NOT_WS}++)({dialect.WS}++\1){{3,}}{C.EDGE}", "$1")
    for repeated in (rf"({letter}{{2,}}+)", rf"((?:{letter}++{dialect.WS}++){{1,3}}{letter}++)"):
        plain = d.replace(plain, rf"{repeated}({dialect.WS}++\1){{2,}}", "$1")
    made = C.collapse_repeated_words(d, C.remove_repeated_tokens(d, "t"))
    assert df.where(f"{made} <> {plain}").isEmpty() and df.where(f"t <> {plain}").count() > 100
    assert made.count("rlike") == 3


def test_fields_of_analyze_text(spark):
    """By name, only the fields that are asked for are made; their values are those of ``analyze``, nulls apart."""
    from quillspark.functions import analysis, sql

    sql.register(spark)
    rows = [(0, "# A\n\nfoo bar  baz\n\nكلمة <b>x</b> ؟؟؟"), (1, ""), (2, " 　\n"), (3, "## b\n" + "w " * 300)]
    df = spark.createDataFrame(rows, "id long, text string")
    df.createOrReplaceTempView("__qs_analyzed")
    got = {r.id: r.m.asDict() for r in spark.sql("select id, analyze_text(text) as m from __qs_analyzed").collect()}
    assert got == {r.id: {n: r[n] for n in analysis.METRICS} for r in analysis.analyze(df).collect()}
    plan = spark.sql("select analyze_text(text).arabic_ratio, analyze_text(text).page_count from __qs_analyzed")._jdf.queryExecution().optimizedPlan().toString()
    assert "named_struct" not in plan and "<[a-zA-Z]" not in plan


def test_similarity_splits_a_text_once(spark):
    from quillspark.functions import cleaning
    from quillspark.functions.dialect import SPARK

    rows = [("a b  b", "b c"), (" a", "a "), ("a", "a"), ("", "a"), (" ", "\t\n"), ("x　y z", "z y x")]
    got = spark.createDataFrame(rows, "a string, b string").selectExpr(f"{cleaning.similarity(SPARK, 'a', 'b')} as s").collect()
    parts = [[set(re.split(r"[\s　  ]+", t)) for t in r] for r in rows]
    want = [1.0 if r[0] == r[1] else 0.0 if "" in r else len(p & q) / len(p | q) for r, (p, q) in zip(rows, parts)]
    assert [r.s for r in got] == want
    assert cleaning.similarity(SPARK, "a", "b").count("split(") == 2


# --- the passes as functions of one text ---


def odd_texts(seed: int, n: int) -> list[str]:
    import random

    rng = random.Random(seed)
    signs = list("اللكبةه،؛؟,,;?!!©()[]12 \n\t aZ-.…#~«»؛；？：（—ー_/|*•–﴿>%@آىیکـٌّ٣ﷺﬁ‏­​ 　﻿é中") + ["\x1c", "\x85", "  ", " \n ", "\n\n", "\r\n", "\r", "ال ", "© 12ه", " ه)", "12 / 9\n", "- ", "## ", "> ", "المقدمة", "الفصل 3"]
    signs += ["ثانيا ", "(3) ", "4. ", "....", "<br/>", "</P>", "<span x>", "من\n", "PAGE", "Page 4", "صفحة 7", " اب اب اب", " ab ab ab ab", "xab ab ab abc", " جد اب جد اب جد اب", "ab"]
    words = ["اب", "ب", "باب", "جد", "a", "ab", "b-ab", "،", "ال", "كتاب", "the", "من", "x1", "؟", "٣", "."]
    made = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 60))) for _ in range(n)]
    made += ["".join(rng.choice(words) + rng.choice([" ", " ", " ", "\n", "  ", "\n\n", ""]) for _ in range(rng.randint(0, 50))) for _ in range(n)]
    return made + ["".join(rng.choice(words[:5]) + rng.choice([" ", " ", " ", "\n"]) for _ in range(rng.randint(0, 40))) for _ in range(n)]


def test_passes_of_one_text_equal_their_sql(spark):
    """Each pass as a Python function against its SQL, with no confidence, a null one and doubles."""
    texts = odd_texts(21, 3000)
    sure = [None if i % 7 == 0 else i % 11 / 10 for i in range(len(texts))]
    df = spark.createDataFrame(list(zip(range(len(texts)), texts, sure)), "i int, text string, sure double").repartition(4)
    passes = [p for p in cleaning.TEXT_PASSES if p[2]]
    assert {name for _, _, name in passes} == {p.__name__ for p in PASSES} | {"remove_tatweel", "normalize_digits"}
    sql = {name: getattr(cleaning, name)(SPARK, "text") for _, _, name in passes}
    sql |= {f"{name}?": getattr(cleaning, name)(SPARK, "text", "sure") for _, _, name in passes if name in cleaning.CONFIDENT}
    want = df.select("i", *[F.expr(e).alias(n) for n, e in sql.items()]).toPandas().sort_values("i")
    changed = 0
    for _, make, name in passes:
        got = [make(t) for t in texts]
        assert got == list(want[name]), name
        changed += got != texts
        if name in cleaning.CONFIDENT:
            assert [make(t, c) for t, c in zip(texts, sure)] == list(want[f"{name}?"]), name
    assert changed == len(passes)


def test_thousands_of_copies_in_a_row(spark):
    """a frame of Java's stack for each copy ended the executor."""
    rows = [("كتاب ", "كتاب"), ("كتاب جد ه ", "كتاب جد ه"), ("ab ", "ab"), ("،\nx ", "x")]
    texts = [word * 20000 for word, _ in rows]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    got = [r.cleaned for r in cleaning.clean(df, options=cleaning.CleanOptions(remove_ascii_noise=False)).orderBy("i").collect()]
    assert got[:3] == [word for _, word in rows[:3]] and got[3].count("x") == 20000
    repeats = cleaning.collapse_repeated_words(SPARK, cleaning.remove_repeated_tokens(SPARK, "text"))
    assert [r.x.strip() for r in df.where("i < 3").select("i", F.expr(repeats).alias("x")).orderBy("i").collect()] == [word for _, word in rows[:3]]


@pytest.mark.parametrize("text", ["كتاب ©" + " " * 300000 + "كتاب , <b> " + "~" * 1000, "كتاب" * 50000 + " قل قل قل", "a-" * 100000 + " ab ab ab ab", "- " * 200000 + "x", "ب!" * 100000, ". " * 200000, "اب, " * 50000, "اب\n\n" * 50000])
def test_one_text_is_cleaned_in_linear_time(text):
    import time

    began = time.time()
    cleaning.clean_text(text, cleaning.GENERAL)
    assert time.time() - began < 3


def test_a_confidence_may_have_any_name(spark):
    """The SQL of a line calls it by names of its own; a column of such a name is still the caller's."""
    df = spark.createDataFrame([("!!!", 0.9), ("!!!", 0.1), ("!!", 0.9), ("- = + = ~ = +", None)], "text string, c double")
    options = cleaning.CleanOptions(normalize_punctuation=False, remove_page_noise=False, final_cleanup=False)
    assert [r.cleaned for r in cleaning.clean(df, options=options, confidence="c").collect()] == ["!!!", "", "", "- = + = ~ = +"]


def test_auto_mode_is_one_pass(spark):
    """exams and others were two scans with a chain of steps each; copies by the thousand ended the executor in both."""
    exam = "س1: ما\nج: (أ) نعم ...\n"
    rows = [(1, exam + "كتاب " * 20000, 0.9), (2, "كتاب جد " * 20000, 0.1), (3, exam + "!!", 0.9), (4, "نص\n!!\nنص", 0.9), (5, None, None), (6, exam, None)]
    df = spark.createDataFrame(rows, "id int, text string, sure double")
    made = cleaning.clean(df, mode="auto", confidence="sure")
    assert made.columns == ["id", "text", "sure", "cleaned"]
    assert made._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    got = {r.id: r.cleaned for r in made.collect()}
    exams, others = ({r.id: r.cleaned for r in cleaning.clean(df, mode=m, confidence="sure").collect()} for m in ("exam", "general"))
    assert got == {i: (exams if i in (1, 3, 6) else others)[i] for i, _, _ in rows}
    assert len(got[1]) < 100 and len(got[2]) < 100 and exams[1] != others[1]


@pytest.mark.parametrize("text", ["كتاب" * 75000 + " اب جد اب جد اب جد", "اب جد ه " * 50000 + "كتاب" * 50000, "اب" + " " * 200000 + "جد اب جد اب جد اب"])
def test_phrases_are_found_in_linear_time(text):
    """Long words in a text that has a repeated phrase: each letter of them was tried as the first."""
    import time

    began = time.time()
    made = cleaning.clean_text(text, cleaning.GENERAL)
    assert time.time() - began < 3 and len(made) < len(text)
