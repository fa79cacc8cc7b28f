"""The corpus pipeline against brute force, stage by stage, on the smallest tables."""

import os
import sys
from collections import Counter

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

import corpus_pipeline
from quillspark.llm import bpe, quality_rules
from tests.llm.test_near_texts import brute_shingles
from tests.llm.test_ops import norm_words

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables aren't here")


def kept_by_rules(text):
    values = dict(zip(quality_rules.MEASURES, quality_rules.measure(text)))
    return not any(eval(c, {}, values) for _, _, c in quality_rules.RULES)  # the conditions are arithmetic that both languages share


def test_run(spark):
    docs = [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    docs = [(i, t) for i, t in docs if kept_by_rules(t)]

    sets = [brute_shingles(t) for _, t in docs]
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            if 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)), key=lambda k: docs[k][0])
                root[b] = a
    docs = [d for n, d in enumerate(docs) if find(n) == n]

    words = [t.encode().split() for _, t in docs]
    count = Counter(tuple(w[i : i + 35]) for w in words for i in range(len(w) - 34))
    cut = []
    for (i, t), w in zip(docs, words):
        gone = bytearray(len(w))
        for a in range(len(w) - 34):
            if count[tuple(w[a : a + 35])] > 1:
                gone[a : a + 35] = b"\x01" * 35
        cut.append((i, b" ".join(x for x, g in zip(w, gone) if not g).decode() if any(gone) else t))

    grams = {n: set() for n in range(1, 11)}
    for item in items:
        w = norm_words(item)
        n = min(10, len(w))
        if n:
            grams[n] |= {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}
    out, changed = [], 0
    for i, t in cut:
        w, hit = norm_words(t), set()
        for n, known in grams.items():
            for a in range(len(w) - n + 1) if known else ():
                if tuple(w[a : a + n]) in known:
                    hit |= set(range(a, a + n))
        changed += bool(hit)
        out.append((i, [x for k, x in enumerate(w) if k not in hit]))
    assert changed and len(out) < 200

    stages = dict(corpus_pipeline.STAGES)
    got = spark.read.parquet(f"{SF}/documents.parquet")
    for name in list(stages)[:-1]:
        got = stages[name](spark, got, SF)
        assert got.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        got = corpus_pipeline.materialize(got, name)
    rows = got.collect()
    assert sorted((r.doc_id, norm_words(r.text)) for r in rows) == sorted(out)
    assert all(r.n_chars == len(r.text) for r in rows)

    model = bpe.WordBpe(bpe.default_path())
    final = {r.doc_id: r for r in corpus_pipeline.run(spark, SF).collect()}
    assert set(final) == {r.doc_id for r in rows}
    for r in rows:
        ids = model.encode(r.text)
        assert bytes(final[r.doc_id].ids) == np.array(ids, dtype="<u4").tobytes() and final[r.doc_id].n_tokens == len(ids)


def test_run_on_odd_tables(spark, tmp_path):
    """Nulls in every column, repeated ids and rows, empty and very long texts, another column; then an empty table."""
    import random

    rng = random.Random(7)
    prose = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(n))
    passage, item = prose(50), prose(14)
    rows = [(i, prose(70), "en", "s", None, "x") for i in range(20)]
    rows += [(100 + i, f"{prose(60)} {passage}", None, None, 1, None) for i in range(3)] + [(200, f"{prose(80)} {item} {prose(9)}", "en", "s", 1, "x")]
    rows += [(5, rows[5][1], "en", "s", None, "x"), (5, prose(90), "en", "s", None, "x"), (None, prose(75), None, None, None, None), (None, rows[1][1], None, None, None, None)]
    rows += [(300, None, "en", "s", 0, "x"), (301, "", "en", "s", 0, "x"), (302, prose(60000), "en", "s", 0, "x"), (303, f"{prose(60)}{' ' * 300000}end", "en", "s", 0, "x")]
    schema = "doc_id long, text string, lang string, source string, n_chars long, kept string"
    spark.createDataFrame([(1, item), (2, None), (None, "")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    made = corpus_pipeline.run(spark, str(tmp_path)).collect()
    ids = Counter(r.doc_id for r in made)
    # rows of equal text stay once, under the least id; null ids last; short texts are rejected
    assert ids == Counter([*range(20), 100, 101, 102, 200, 5, None, 302, 303])
    model, decoded = bpe.WordBpe(bpe.default_path()), {}
    for r in made:
        assert r.n_tokens == len(bytes(r.ids)) // 4
        decoded.setdefault(r.doc_id, []).append(model.decode(np.frombuffer(bytes(r.ids), dtype="<u4").tolist()).replace("</w>", "").replace(" ", ""))
    assert not any(passage.replace(" ", "") in t or item.replace(" ", "") in t for ts in decoded.values() for t in ts)
    assert [rows[0][1].replace(" ", "")] == decoded[0]
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/none/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/none/benchmark.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0
