"""The pipeline's near-duplicates against brute force: five-word shingles, similarity 0.8."""

import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from quillspark.llm import near_texts
from tests.llm.test_ops import ROWS, docs, none  # noqa: F401


def brute_shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_groups(rows):
    """Rows that stay, and the pairs of different texts that are similar."""
    sets = {t: brute_shingles(t) for _, t in rows}
    texts = sorted({t or "" for _, t in rows})
    sets[""] = set()
    root = {t: t for t in texts}

    def find(t):
        while root[t] != t:
            t = root[t]
        return t

    pairs = []
    for n, a in enumerate(texts):
        for b in texts[:n]:
            if 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b]):
                pairs.append((a, b))
                root[find(a)] = find(b)
    return find, pairs


def test_groups(spark, docs, none):  # noqa: F811
    find, pairs = brute_groups(ROWS)
    groups = {}
    for i, t in ROWS:
        groups.setdefault(find(t or ""), []).append(i)
    want = Counter(min((i for i in ids if i is not None), default=None) for ids in groups.values())
    assert len(pairs) >= 10
    got = near_texts.drop_near_texts(docs)
    assert got.columns == docs.columns and Counter(r.doc_id for r in got.collect()) == want
    assert near_texts.drop_near_texts(none).count() == 0


def planted(rng, n, edits):
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(3000)] + ["the", "of"] * 300
    rows = []
    for i in range(n):
        base = rng.choices(words, k=rng.randint(60, 400))
        rows.append((10 * i, " ".join(base)))
        for k, rate in enumerate(edits):
            copy = list(base)
            for at in rng.sample(range(len(copy)), max(1, int(rate * len(copy)))):
                copy[at] = rng.choice(words)
            rows.append((10 * i + 1 + k, " ".join(copy)))
    return rows


def test_recall_of_planted_copies(spark):
    """Copies at similarities from 0.8: nine in ten are found, at least; and nothing but what brute force links goes."""
    rows = planted(random.Random(21), 150, (0.005, 0.012, 0.02, 0.022))
    sets = {i: brute_shingles(t) for i, t in rows}
    like = {i: len(sets[i] & sets[i - i % 10]) / len(sets[i] | sets[i - i % 10]) for i in sets if i % 10}
    kept = {r.doc_id for r in near_texts.drop_near_texts(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    for low, high in ((0.8, 0.85), (0.85, 0.9), (0.9, 1)):
        meant = [i for i, s in like.items() if low <= s < high]
        assert len(meant) > 30 and sum(i not in kept for i in meant) >= 0.9 * len(meant), (low, len(meant))
    assert all(i in kept for i in sets if i % 10 == 0)
    find, _ = brute_groups(rows)
    firsts = {}
    for i, t in rows:
        firsts.setdefault(find(t), i)
    assert set(firsts.values()) <= kept


def test_a_group_of_thousands(spark):
    """Many copies of one text, each with edits of its own: less alike among themselves than to it, and one list holds them all."""
    rng = random.Random(6)
    base = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(300)]
    rows = [(0, " ".join(base))]
    for i in range(1, 1500):
        copy = list(base)
        for at in rng.sample(range(300), 5):
            copy[at] = f"w{rng.random()}"
        rows.append((i, " ".join(copy)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    texts = df.select(F.col("doc_id").alias("node"), F.md5("text").alias("md5"), F.udf(near_texts.fingerprint, "binary")("text").alias("fp"))
    found = near_texts.candidates(texts)
    assert found.count() < 60 * len(rows)  # not all pairs
    kept = {r.doc_id for r in near_texts.drop_near_texts(df).collect()}
    assert 0 in kept and len(kept) <= 0.01 * len(rows)


def test_long_lists_are_split(spark, monkeypatch):
    rows = planted(random.Random(2), 40, (0.01, 0.02))
    texts = spark.createDataFrame([(i, near_texts.fingerprint(t)) for i, t in rows], "node long, fp binary")
    whole = {tuple(r) for r in near_texts.candidates(texts).collect()}
    monkeypatch.setattr(near_texts, "LONG", 2)
    split = {tuple(r) for r in near_texts.candidates(texts).collect()}
    near = {p for p in whole if p[2] <= near_texts.SEEN}
    assert near and near <= split


def test_any_seven_bytes_share_a_triple():
    from itertools import combinations

    triples = [set(t) for t in near_texts.TRIPLES]
    assert len(triples) == 40 and all(any(t <= set(c) for t in triples) for c in combinations(range(16), 7))


def test_list_pairs_of_far_members():
    """A long list of members that have nothing but its triple in common ends, and gives none but pairs that reach the minimum."""
    rng = np.random.default_rng(3)
    f = rng.integers(0, 256, (400, 16), dtype=np.uint8)
    f[:, :3] = 7
    f[200:210] = f[5]
    u, v = near_texts.list_pairs(f)
    pairs = {(min(a, b), max(a, b)) for a, b in zip(u.tolist(), v.tolist())}
    assert all((f[a] == f[b]).sum() >= 5 for a, b in pairs)
    assert len({x for p in pairs for x in p} & {5, *range(200, 210)}) == 11


def test_no_similar_pair_is_left_out(spark):
    """Survivors are those of brute force: copies just beyond 0.8, and long lists of copies that are alike among themselves alone."""
    rng = random.Random(7)
    rows = planted(rng, 60, (0.012, 0.02, 0.022, 0.024))
    base = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(200)]
    for i in range(60):  # two of a family differ in four words at most from their parent, parents in nine from the base
        parent = list(base)
        for at in rng.sample(range(200), 9):
            parent[at] = f"p{rng.random()}"
        for k in range(3):
            copy = list(parent)
            for at in rng.sample(range(200), k):
                copy[at] = f"c{rng.random()}"
            rows.append((100_000 + 10 * i + k, " ".join(copy)))
    find, pairs = brute_groups(rows)
    firsts = {}
    for i, t in sorted(rows):
        firsts.setdefault(find(t), i)
    kept = {r.doc_id for r in near_texts.drop_near_texts(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert len(pairs) > 300 and kept == set(firsts.values())


def test_prefix_lists_hold_every_similar_pair():
    """Prefixes meet and parities pass for every pair of 0.8 or more, whatever the order says."""
    from quillspark.llm import prefix_lists

    rng = np.random.default_rng(4)
    often = np.unique(rng.integers(0, 1 << 63, 300, dtype=np.uint64)), rng.integers(2, 5, 300)
    met = 0
    for _ in range(400):
        base = np.concatenate([rng.choice(often[0], 40, replace=False), rng.integers(0, 1 << 63, int(rng.integers(1, 300)), dtype=np.uint64)])
        a, b = (np.unique(np.concatenate([rng.choice(base, int(len(base) * rng.uniform(0.85, 1)), replace=False), rng.integers(0, 1 << 63, 2, dtype=np.uint64)])) for _ in range(2))
        if near_texts.similarity(a, b) >= near_texts.SIMILAR:
            met += 1
            p = np.array([np.frombuffer(prefix_lists.parity(s), dtype=np.uint64) for s in (a, b)]).T
            assert set(prefix_lists.prefix(a, *often).tolist()) & set(prefix_lists.prefix(b, *often).tolist())
            assert prefix_lists._near(np.ascontiguousarray(p), np.array([len(a), len(b)]), np.array([0]), np.array([1]))[0].all()
    assert met > 50


def test_wide_parities():
    """They let every similar pair through, whatever the sizes, and tell large sets apart where 1024 bits can't."""
    from quillspark.llm import prefix_lists

    rng = np.random.default_rng(8)
    passed = 0
    for n in (3, 900, 1020, 1100, 2040, 5000, 20000) * 4:
        base = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        a, b = (np.unique(np.concatenate([base[rng.random(n) < rng.uniform(0.9, 1)], rng.integers(0, 1 << 63, 1 + n // 40, dtype=np.uint64)])) for _ in range(2))
        other = np.unique(rng.integers(0, 1 << 63, n + n // 50, dtype=np.uint64))
        p, q, r = (prefix_lists.wide_parity(s) or prefix_lists.parity(s) for s in (a, b, other))
        if near_texts.similarity(a, b) >= near_texts.SIMILAR:
            passed += 1
            assert prefix_lists.may_be_similar(len(a), len(b), p, q)
        assert n < 10 or not prefix_lists.may_be_similar(len(a), len(other), p, r)
    assert passed > 15


def test_sets_are_made_for_texts_that_may_be_similar_alone(spark, monkeypatch):
    """Long texts of the same words in another order have one fingerprint, and no shingle in common: none is fetched to be verified."""
    rng = random.Random(12)
    words = [f"w{i}" for i in range(2500)]
    rows = [(i, " ".join(rng.sample(words, len(words)))) for i in range(4)]
    made, materialize = {}, near_texts.materialize

    def watched(df, name, *more):
        made[name] = materialize(df, name, *more)
        return made[name]

    monkeypatch.setattr(near_texts, "materialize", watched)
    monkeypatch.setattr(near_texts, "discard", lambda table: None)
    assert near_texts.drop_near_texts(spark.createDataFrame(rows, "doc_id long, text string")).count() == 4
    assert made["shingles"].count() == 0


def test_pairs_that_the_last_look_alone_finds(spark, monkeypatch):
    """Texts without a candidate or a nearest one that may be similar get their sets when the lists are looked through at last."""
    rows = planted(random.Random(9), 12, (0.005, 0.012))
    apart = near_texts.prefix_lists.apart
    monkeypatch.setattr(near_texts.prefix_lists, "apart", lambda members, nearest: apart(members, nearest).where(F.lit(not nearest)))
    monkeypatch.setattr(near_texts, "candidates", lambda texts: texts.selectExpr("node u", "node v", "0 bits").where("false"))
    find, _ = brute_groups(rows)
    firsts = {}
    for i, t in sorted(rows):
        firsts.setdefault(find(t), i)
    kept = {r.doc_id for r in near_texts.drop_near_texts(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert len(firsts) < len(rows) and kept == set(firsts.values())
