"""Operators 11 to 13 against brute force: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import math
import random
import re
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.llm import block_max, language_id, whitening
from tests.llm.test_ops import ROWS, docs, none, same  # noqa: F401

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
UPPER = {c: c + 32 for c in range(65, 91)}


def brute_terms(text):
    return TERM.findall((text or "").translate(UPPER))


def brute_rank(rows, items, k=20):
    counted = [(i, Counter(brute_terms(t))) for i, t in rows]
    counted = [(i, c) for i, c in counted if c]
    n, total = len(counted), sum(sum(c.values()) for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    out = []
    for item, text in items:
        asked, scored = Counter(brute_terms(text)), []
        for i, c in counted:
            m = 75 + (25 * sum(c.values()) * n) // total
            score = sum(times * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 12 * m)) for t, times in asked.items() if c[t])
            if score > 0:
                scored.append((-score, i is None, i or 0, i))
        out += [(item, rank + 1, s[3], -s[0]) for rank, s in enumerate(sorted(scored)[:k])]
    return out


def items():
    rng = random.Random(3)
    texts = [t for _, t in ROWS if t]
    cuts = [" ".join(rng.choice(texts).split()[: rng.randint(1, 60)]) for _ in range(30)]
    return [(n, t) for n, t in enumerate([*cuts, *cuts[:2]])] + [(90, None), (91, ""), (92, " ,;"), (93, "nowhere"), (94, "ab AB ab"), (95, "é"), (None, cuts[3]), (7, cuts[4])]


def test_ranks(spark, docs):  # noqa: F811
    asked = spark.createDataFrame([(i, t, 1, "x") for i, t in items()], "item_id long, text string, rank int, term string")
    want = brute_rank(ROWS, items())
    for parts in (1, 7):  # one shard, and many
        got = block_max.rank_documents(docs.repartition(parts), asked)
        assert got.columns == ["item_id", "rank", "doc_id", "score"]
        same([tuple(r) for r in got.collect()], want)


def test_ranks_of_nothing(spark, docs, none):  # noqa: F811
    asked = spark.createDataFrame([(1, "ab cd")], "item_id long, text string")
    assert block_max.rank_documents(none, asked).count() == 0
    assert block_max.rank_documents(docs, asked.limit(0)).count() == 0


def test_items_go_in_blocks(spark, docs, monkeypatch):  # noqa: F811
    monkeypatch.setattr(block_max, "TERMS_AT_ONCE", 200)
    monkeypatch.setattr(block_max, "TERMS_RESTRICTED", 3)  # and the index holds all terms
    asked = spark.createDataFrame(items(), "item_id long, text string")
    same([tuple(r) for r in block_max.rank_documents(docs, asked).collect()], brute_rank(ROWS, items()))


def searcher(rows, wanted=None):
    import pyarrow as pa

    shard = block_max.Shard()
    for i, t in rows:
        if found := block_max.words(t):
            shard.add(i, found, wanted)
    made = [(*b, None, None) for b in shard.blocks()]
    made.append((None, -1, 0, len(shard.ids) - 1, len(shard.ids), None, None, shard.ids, shard.lengths.astype("<i4").tobytes()))
    names = ["term", "block", "first", "last", "n", "impacts", "packed", "ids", "lengths"]
    group = pa.table({c: [r[i] for r in made] for i, c in enumerate(names)})
    n, total = len(shard.ids), int(shard.lengths.sum())
    lists, lengths, ids = block_max._lists(group, n, total)
    return block_max.Searcher(lists, lengths, n, total), lists, ids.as_py(), n


def test_long_lists_and_shut_blocks():
    """Lists of many blocks, scores that tie across blocks; blocks below the score that is reached stay shut."""
    rng = random.Random(11)
    common = ["the", "of", "and", "in"]
    rows = [(i, " ".join(rng.choices(common, k=rng.choice([6, 12, 40])) + [f"w{rng.randint(0, 3000)}", f"v{rng.randint(0, 40)}"])) for i in range(12000)]
    for i in range(4000, 4030):
        rows[i] = (i, rows[i][1] + " amber amber beryl coral")
    found, lists, ids, n = searcher(rows)
    asked = "the of and in amber beryl coral v3"
    df = {t: int(p.sizes.sum()) for t, p in lists.items()}
    weights = [(t, math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1)))) for t in asked.split()]
    assert len(lists["the"].lasts) > 80
    got = [(ids[d], s) for s, d in found.top(weights, 20, 0)]
    want = [(i, s) for _, _, i, s in brute_rank(rows, [(1, asked)])]
    assert got == want
    opened = {t: float(np.mean(~lists[t].shut)) for t in ("the", "of", "and", "in")}
    assert max(opened.values()) < 0.2, opened
    again, lists, ids, _ = searcher(rows)
    assert [(ids[d], s) for s, d in again.top(weights, 20, want[-1][1])] == want
    ties = [("v3", 1000)]
    lone = brute_rank([(i, " ".join(w for w in t.split())) for i, t in rows], [(1, "v3")])
    assert [ids[d] for _, d in again.top(ties, 20, 0)] == [i for _, _, i, _ in lone]


def test_blocks_round_trip():
    rng = np.random.default_rng(2)
    for n, gap, tf in ((1, 3, 1), (128, 2, 300), (77, 70_000, 70_000), (5, 1, 200)):
        docs_ = np.cumsum(rng.integers(1, gap + 1, n)) + 10
        tfs = rng.integers(1, tf + 1, n)
        got = block_max.unpack(block_max.pack(docs_, tfs, 10), n, 10)
        assert (got[0] == docs_).all() and (got[1] == tfs).all()
        lengths = rng.integers(1, 500, n)
        pairs = block_max.impacts(tfs, lengths)
        for t, le in zip(tfs, lengths):  # some kept pair is as good as each
            assert ((pairs[:, 0] >= t) & (pairs[:, 1] <= le)).any()


def vectors():
    rng = np.random.default_rng(4)
    rows = [(i, [float(v) for v in rng.normal(size=6).astype(np.float32)]) for i in range(60)]
    rows += [(100 + i, list(rows[i][1])) for i in range(5)] + [(0, rows[0][1]), (None, rows[1][1])]
    odd = [(200, None), (201, [1.0, None, 2.0, 3.0, 4.0, 5.0]), (202, [float("nan")] * 6), (203, [float("inf"), 0, 0, 0, 0, 0]), (204, [1.0, 2.0])]
    return rows + [(i, v if v is None else [x if x is None else float(x) for x in v]) for i, v in odd], ("vec_id long, embedding array<float>")


def brute_white(rows):
    usable = [(i, v) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    d = max((len(v) for _, v in usable), default=0)
    ints = [(i, tuple([math.floor(256 * x) for x in v] + [0] * (d - len(v)))) for i, v in usable]
    distinct = sorted({v for _, v in ints})
    n, sums = len(distinct), [sum(c) for c in zip(*distinct)]
    scatter = [[sum((n * v[p] - sums[p]) * (n * v[q] - sums[q]) for v in distinct) for q in range(d)] for p in range(d)]
    return ints, n, sums, scatter


def test_whitening(spark):
    rows, schema = vectors()
    df = spark.createDataFrame(rows, schema).withColumns({"n": F.lit(3), "component": F.lit("c")}).repartition(3)
    got = whitening.whiten(df).collect()
    ints, n, sums, scatter = brute_white(rows)
    v = np.array([[float(Fraction(x, n**3)) for x in line] for line in scatter])
    values, axes = np.linalg.eigh(v)
    values, axes = values[::-1][:4], axes[:, ::-1][:, :4]
    want, have = {}, {}
    for i, x in ints:
        z = (np.array(x) - np.array(sums) / n) @ axes / np.sqrt(values)
        want.setdefault(i, []).append((sum((n * a - s) ** 2 for a, s in zip(x, sums)), np.abs(z)))
    assert len(got) == 4 * len(ints)
    for r in got:
        have.setdefault(r.vec_id, Counter())[r.component] += 1
        assert r.n == n and r.identity_error < 1e-9 and abs(r.explained - values[r.component - 1] / np.trace(v)) < 1e-12
        assert any(r.deviation == dev and abs(abs(r.whitened) - z[r.component - 1]) < 1e-9 for dev, z in want[r.vec_id])
    assert all(c == Counter({k: len(want[i]) for k in range(1, 5)}) for i, c in have.items())
    assert {r.vec_id: r.whitened for r in got if r.component == 1}[100] == pytest.approx({r.vec_id: r.whitened for r in got if r.component == 1}[0])
    found = {(r.p, r.q): (r.n, int(r.sum_p), int(r.scatter)) for r in whitening.moments(df).collect()}
    assert found == {(p, q): (n, sums[p], scatter[p][q]) for p in range(6) for q in range(p, 6)}


def test_whitening_of_extremes(spark):
    """Entries at the ends of a long, where no int64 holds a product, are exact; and tables that leave nothing to whiten."""
    big = [(0, [1e30, 0.5]), (1, [-1e30, -0.5]), (2, [3e16, 7.0]), (3, [-3e16, 2.0])]
    df = spark.createDataFrame(big, "vec_id long, embedding array<double>").repartition(2)
    ints = [(min(max(math.floor(256 * a), -(2**63)), 2**63 - 1), math.floor(256 * b)) for _, (a, b) in big]
    sums = [sum(c) for c in zip(*ints)]
    want = {(p, q): str(sum((4 * v[p] - sums[p]) * (4 * v[q] - sums[q]) for v in ints)) for p in range(2) for q in range(p, 2)}
    assert {(r.p, r.q): r.scatter for r in whitening.moments(df).collect()} == want
    made = whitening.whiten(df).collect()
    assert len(made) == 8 and all(r.deviation is None for r in made)
    one = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<float>")
    assert sorted((r.vec_id, r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in whitening.whiten(one).collect()) == [(i, c, 1, 0, None, 0.0, 0.0) for i in (1, 2) for c in (1, 2)]
    for rows in ([], [(1, None)], [(1, [])]):
        assert whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).count() == 0


def test_digits():
    x = np.array([0, 1, -1, 40000, -40000, 2**31, -(2**47), 2**63 - 1, -(2**63)])
    parts = whitening.digits(x)
    assert [sum(int(p[i]) << (16 * k) for k, p in enumerate(parts)) for i in range(len(x))] == x.tolist()
    assert max(abs(p).max() for p in parts) <= 1 << 15 and len(whitening.digits(np.array([5, -7]))) == 1


def brute_counts(text):
    lower = language_id.letters()
    plain_ = "\0" + re.sub("\0+", "\0", "".join(chr(lower[ord(c)]) for c in text)).strip("\0") + "\0"
    out = np.zeros(language_id.BUCKETS, dtype=int)
    for n in range(1, 4):
        for i in range(len(plain_) - n + 1 if plain_ != "\0\0" else 0):
            gram, h = plain_[i : i + n], 0
            if gram != "\0":
                for c in gram:
                    h = ((h ^ ord(c)) * 2654435761) & 0xFFFFFFFF
                    h ^= h >> 15
                out[h % language_id.BUCKETS] += 1
    return out


def test_ngrams(monkeypatch):
    texts = ["", "1 2", "a", " a", "ab!c", "É", "\0x", "İstanbul ǅ", "日本 語", "ab  cd"] + [t[:700] for _, t in ROWS if t]
    want = [brute_counts(t) for t in texts]
    for block in (1 << 20, 1, 5):
        monkeypatch.setattr(language_id, "BLOCK", block)
        assert all((language_id.counts(t) == w).all() for t, w in zip(texts, want))


def languages(rng, n):
    """Prose of languages with syllables of their own, one of them of two scripts."""
    kinds = {"aa": ["ka", "ro", "mi"], "bb": ["sch", "ung", "ein"], "cc": ["é", "eau", "oi"], "dd": ["ñ", "ción", "lla"]}
    out = []
    for i in range(n):
        lang = rng.choice(sorted(kinds))
        syllables = ["дом", "лес", "ти"] if lang == "aa" and i % 3 == 0 else kinds[lang]
        out.append((i, " ".join("".join(rng.choices(syllables, k=rng.randint(1, 3))) for _ in range(rng.randint(3, 40))), lang))
    return out


def test_languages(spark):
    import zlib

    rows = languages(random.Random(8), 600)
    odd = [(1000, None, "aa"), (1001, "", "aa"), (1002, "12 -- 7", "bb"), (1003, "x" * 300_000, None), (None, "schungein ein", None), (3, rows[3][1], rows[3][2]), (1004, "zqxj wvyk", None)]
    df = spark.createDataFrame([(*r, 1.0, "k") for r in rows + odd], "doc_id long, text string, lang string, score double, held_out string").repartition(3)
    got = language_id.identify(df).collect()
    assert len(got) == len(rows) + len(odd)
    truth = {i: la for i, _, la in rows}
    fold = [r for r in got if r.doc_id in truth and r.held_out]
    assert len(fold) > 80 and sum(r.lang_pred == truth[r.doc_id] for r in fold) >= 0.99 * len(fold)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    by = {r.doc_id: r for r in got}
    assert all((by[i].lang_pred, by[i].score) == ("und", 0.0) for i in (1000, 1001, 1002))
    assert all(r.lang_pred in ("aa", "bb", "cc", "dd", "und") and 0 <= r.score <= 1 for r in got)
    assert by[1004].rejected and by[1003].rejected and sum(r.rejected for r in fold) < 0.1 * len(fold)
    model = language_id.fit(df.where(~language_id.held_out()))
    assert Counter(model.languages)["aa"] >= 2  # two scripts, centroids apart
    far = language_id.predict(df, model, keep=["doc_id"], reject=True).where("doc_id = 1004").first()
    assert far.lang_pred == "und" and far.rejected


def test_nothing_to_learn(spark, none):  # noqa: F811
    df = spark.createDataFrame([(1, "abc", None), (2, None, "en")], "doc_id long, text string, lang string")
    assert {(r.lang_pred, r.score) for r in language_id.identify(df).collect()} == {("und", 0.0)}
    assert language_id.identify(none).count() == 0
