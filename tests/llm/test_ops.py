"""The ten operators against brute force on a small corpus with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.llm import bpe, chat_format, decontamination, feistel, quality_rules, sharding, simhash, substring_dedup, suffix_dedup, token_counts, token_shards

SPACE = b" \t\n\r\x0b\x0c"
SCHEMA = "doc_id long, text string, lang string, n_words long, kept string, shard string, place string"


def corpus():
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abcdefgéñ") for _ in range(rng.randint(1, 9))) for _ in range(400)] + ["The", "THE", "x#y", "&&&", "12"]
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    passage, licence = prose(60), prose(45)
    rows = [(i, prose(rng.randint(3, 150))) for i in range(40)]
    rows += [(100 + i, f"{prose(10 + i)}\n{passage}  {prose(7)}") for i in range(6)]
    rows += [(120 + i, f"{licence} {prose(i)}") for i in range(5)]
    base = prose(200)
    rows += [(140 + i, base) for i in range(4)]  # exact copies
    rows += [(150 + i, base.replace(base.split()[50 + i], "zz", 1)) for i in range(4)]  # near copies
    rows += [(160, None), (161, None), (162, ""), (163, " \n\t "), (164, "one"), (165, "one"), (166, "é"), (167, "\x0b"), (None, prose(30)), (None, base)]
    rows += [(170, "ab " * 500), (171, "x" * 3000), (172, prose(40) + "\n" + passage), (172, prose(40) + "\n" + passage), (173, prose(9000)), (174, "日本 語 " * 60)]
    rows += [(5, prose(20)), (180, "a b\na b\n\nc\na b"), (181, "[]()<|endoftext|> it's I'LL 3½ ΣΣ é"), (182, base[: len(base) // 2])]
    return rows


ROWS = corpus()


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, None if n % 7 == 0 else "en", n, "k", "s", None) for n, (i, t) in enumerate(ROWS)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def sha(b):
    return hashlib.sha256(b).hexdigest()


def key(row):
    return tuple((x is not None, x) for x in row)


def same(got, want):
    assert sorted(map(key, got)) == sorted(map(key, want))


# 1


def norm_words(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


ITEMS = [(1, ROWS[3][1]), (2, "alone"), (3, None), (4, ""), (5, "X#y one"), (6, ROWS[9][1].upper() if ROWS[9][1].isascii() else ROWS[9][1]), (10, ROWS[3][1]), (7, "one"), (8, " ".join((ROWS[12][1] + " q w e r t y u i o p").split()[:7])), (None, ROWS[20][1])]


def brute_hits(text):
    words = norm_words(text)
    hit, items = set(), set()
    for item, content in ITEMS:
        w = norm_words(content)
        if not w:
            continue
        n = min(10, len(w))
        grams = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}
        for i in range(len(words) - n + 1):
            if tuple(words[i : i + n]) in grams:
                hit |= set(range(i, i + n))
                if item is not None:
                    items.add(str(item))
    return words, hit, sorted(items)


def test_decontamination_report(spark, docs):
    benchmark = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = [(r.doc_id, r.n_words, r.n_hit, r.n_items, tuple(r["items"]), r.contaminated) for r in decontamination.report(docs, benchmark).collect()]
    want = []
    for i, t in ROWS:
        words, hit, items = brute_hits(t)
        want.append((i, len(words), len(hit), len(items), tuple(items), bool(hit)))
    same(got, want)
    assert any(w[5] for w in want)


def test_decontamination_shuffles_beyond_the_bound(spark, docs, monkeypatch):
    benchmark = spark.createDataFrame(ITEMS, "item_id long, text string")
    before = decontamination.report(docs, benchmark).collect()
    monkeypatch.setattr(decontamination, "BROADCAST_BYTES", 0)
    same(before, decontamination.report(docs, benchmark).collect())


def test_decontaminate(spark, docs, none):
    benchmark = spark.createDataFrame(ITEMS, "item_id long, text string")
    out = decontamination.decontaminate(docs, benchmark)
    assert out.columns == docs.columns and out.count() == len(ROWS)
    got = Counter((r.doc_id, r.text) for r in out.collect())
    for i, t in ROWS:
        words, hit, _ = brute_hits(t)
        if not hit:
            assert got[(i, t)], (i, t)
    left = [norm_words(r.text) for r in out.collect()]
    assert sum(map(len, left)) == sum(len(brute_hits(t)[0]) - len(brute_hits(t)[1]) for _, t in ROWS)
    whole = decontamination.decontaminate(docs, benchmark, "documents")
    same([(r.doc_id, r.text) for r in whole.collect()], [(i, t) for i, t in ROWS if not brute_hits(t)[1]])
    assert decontamination.report(none, benchmark).count() == 0
    empty = spark.createDataFrame([], "item_id long, text string")
    assert decontamination.report(docs, empty).where("contaminated").count() == 0
    assert decontamination.decontaminate(docs, empty).count() == len(ROWS)


# 2


def test_token_shards(spark, docs, none):
    manifest, layout = token_shards.materialize_training_order(docs, length=16, rows=50)
    rows = manifest.collect()
    assert sorted(r.slot for r in rows) == list(range(layout.sequences))
    read = {r.slot: r.tokens for r in token_shards.read_sequences(spark, layout).collect()}
    for r in rows:
        assert zlib.crc32(np.array(read[r.slot], dtype="<u2").tobytes()) == r.crc32
        assert (r.shard, r.offset) == layout.find(r.slot)
    assert {r.slot for r in token_shards.read_sequences(spark, layout, 77).collect()} == set(range(77, layout.sequences))
    encode = token_counts.encoding(token_counts.default_path())[0].encode_ordinary
    tokens = defaultdict(list)
    for r in sorted(rows, key=lambda r: r.seq):
        tokens[r.doc_id].append(read[r.slot][: r.n_tokens])
    for i, t in ROWS:
        if i is not None and [x for x, _ in ROWS].count(i) == 1:
            assert sum(tokens[i], []) == [*encode(t or ""), layout.end]
    # the slot of a sequence is the permutation of its number in the order of (id, XXH64 of the text, place)
    hashed = {t: h for t, h in docs.select("text", F.xxhash64(F.coalesce("text", F.lit("")))).collect()}
    numbered = sorted((i is not None, i or 0, hashed[t], k) for i, t in ROWS for k in range(-(-(len(encode(t or "")) + 1) // 16)))
    want = feistel.permute_np(np.arange(len(numbered)), layout.sequences, layout.key)
    assert sorted(((r.doc_id is not None, r.doc_id or 0, r.seq), r.slot) for r in rows) == sorted(((a, b, k), int(s)) for (a, b, _, k), s in zip(numbered, want))
    again, _ = token_shards.materialize_training_order(docs.repartition(2), length=16, rows=50)
    same([tuple(r)[1:] for r in again.collect()], [tuple(r)[1:] for r in rows])
    nothing, layout = token_shards.materialize_training_order(none)
    assert nothing.count() == 0 and token_shards.read_sequences(spark, layout).count() == 0


def test_shards_written_twice_interrupted_and_refused(spark, docs, tmp_path, monkeypatch):
    path = f"{tmp_path}/shards"
    write = lambda df=docs: token_shards.materialize_training_order(df, path, length=16, rows=50)[1]
    calls = []

    def stop(spark):
        calls.append(1)
        if len(calls) == 3:  # after the tokens, and the first and second wave
            raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(token_shards, "release", stop)
        with pytest.raises(KeyboardInterrupt):
            write()
    files = {f: f.stat().st_mtime_ns for f in tmp_path.glob("shards/shard=*/part-*")}
    assert files
    layout = write()
    assert all(f.stat().st_mtime_ns == t for f, t in files.items())  # what was done stays
    first = sorted((r.slot, r.tokens) for r in token_shards.read_sequences(spark, layout).collect())
    assert [s for s, _ in first] == list(range(layout.sequences)) and len(list(tmp_path.glob("shards/shard=*"))) > len(files)
    assert write() == layout
    assert sorted((r.slot, r.tokens) for r in token_shards.read_sequences(spark, layout).collect()) == first
    with pytest.raises(ValueError):
        write(docs.where("doc_id < 100"))
    other = f"{tmp_path}/other"
    spark.range(3).write.parquet(other)
    with pytest.raises(ValueError):
        token_shards.materialize_training_order(docs, other, length=16, rows=50)


def test_texts_with_long_white_space(spark):
    """A run of a million spaces stops the tokenizer's splitter; shorter ones give what it gives."""
    rng, encoder = random.Random(9), token_counts.encoding(token_counts.default_path())[0]
    for run in (" " * 100_000, "\n\t" * 60_000, " \u3000\u00a0" * 40_000):
        for text in (run, f"{run}a", f"a{run}", f"one{run}two, three{run} 4", f"{run}!{run}", f"x {run}\ny"):
            assert token_counts.encode_whole(encoder, text) == encoder.encode_ordinary(text), (run[:3], len(text))
    text = f"before{' ' * 1_000_000}after"
    docs = spark.createDataFrame([(1, text), (2, " " * 1_200_000)], "doc_id long, text string")
    rows = token_counts.section_counts(docs, keep=["doc_id"]).collect()
    assert encoder.decode(token_counts.encode_whole(encoder, text)) == text and {r.doc_id for r in rows} == {1, 2}
    manifest, layout = token_shards.materialize_training_order(docs, length=256, rows=500)
    assert manifest.agg(F.sum("n_tokens")).first()[0] == sum(r.n_tokens for r in rows) + 2


# 3 and 5


def brute_repeats(rows, words, length):
    texts = [(t or "").encode() for _, t in rows]
    symbols = [t.split() if words else t for t in texts]
    count = Counter(tuple(s[i : i + length]) for s in symbols for i in range(len(s) - length + 1))
    out = []
    for (i, _), s in zip(rows, symbols):
        gone = bytearray(len(s))
        for a in range(len(s) - length + 1):
            if count[tuple(s[a : a + length])] > 1:
                gone[a : a + length] = b"\x01" * length
        spans = sum(1 for a in range(len(gone)) if gone[a] and not (a and gone[a - 1]))
        kept = b" ".join(w for w, g in zip(s, gone) if not g) if words else bytes(b for b, g in zip(s, gone) if not g)
        out.append((i, len(s), sum(gone), spans, sha(kept)))
    return out


@pytest.mark.parametrize(("module", "words", "length"), [(suffix_dedup, False, 200), (suffix_dedup, False, 40), (substring_dedup, True, 35), (substring_dedup, True, 8)])
def test_repeats(docs, module, words, length):
    out = module.remove_repeats(docs, length)
    assert {"doc_id", "text", "lang", "shard"} <= set(out.columns) and out.columns.count("kept") == 1
    got = [(r.doc_id, r.n_symbols, r.n_removed, r.n_spans, sha(bytes(r.kept))) for r in out.collect()]
    want = brute_repeats(ROWS, words, length)
    assert sum(w[2] for w in want) > 0
    same(got, want)


@pytest.mark.parametrize("module", [suffix_dedup, substring_dedup])
def test_repeats_in_blocks_and_by_windows(docs, module, monkeypatch):
    from quillspark.llm import _anchors, repeats

    want = [tuple(r) for r in module.remove_repeats(docs, 30, keep=["doc_id"]).collect()]
    monkeypatch.setattr(repeats, "BLOCK", 4)
    monkeypatch.setattr(repeats, "HOT", 2)
    monkeypatch.setattr(_anchors, "PIECE", 300)
    same([tuple(r) for r in module.remove_repeats(docs, 30, keep=["doc_id"]).collect()], want)


def test_a_hot_group_is_narrowed(spark, monkeypatch):
    """One passage in 600 texts between words of their own: the groups at its edges have 600 contexts, more than a task takes here."""
    from quillspark.llm import repeats

    monkeypatch.setattr(repeats, "HOT", 500)
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    passage = " ".join(word() for _ in range(60))
    rows = [(i, f"{' '.join(word() for _ in range(40))} {passage} {' '.join(word() for _ in range(40))}") for i in range(600)] + [(700, "a" * 1500), (701, "ab " * 300)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    for module, words, length in ((suffix_dedup, False, 200), (substring_dedup, True, 35)):
        got = [(r.doc_id, r.n_symbols, r.n_removed, r.n_spans, sha(bytes(r.kept))) for r in module.remove_repeats(df, length).collect()]
        same(got, brute_repeats(rows, words, length))


def test_fm_index_counts_by_runs():
    from quillspark.llm.fm_index import FmIndex

    rng = np.random.default_rng(4)
    strings = [rng.integers(1, 5, int(rng.integers(1, 30))).tolist() for _ in range(20)] + [[1, 2, 3] * 9] * 6
    index = FmIndex(np.array([x for s in strings for x in [*s, 0]], dtype=np.int32), np.ones(len(strings), dtype=np.int64))
    for _ in range(300):
        pattern = rng.integers(1, 5, int(rng.integers(1, 6))).tolist()
        sp, ep = np.array([0], dtype=np.int32), np.array([index.n], dtype=np.int32)
        for symbol in reversed(pattern):
            sp, ep = index.extend(np.array([symbol], dtype=np.int32), sp, ep)
        assert int(ep[0] - sp[0]) == sum(s[i : i + len(pattern)] == pattern for s in strings for i in range(len(s)))


def test_repeats_of_nothing(none):
    assert suffix_dedup.remove_repeats(none).count() == 0
    assert substring_dedup.drop_repeats(none).count() == 0


def test_drop_repeats_keeps_clean_texts(docs):
    out = substring_dedup.drop_repeats(docs)
    assert out.columns == docs.columns
    clean = {(i, t) for (i, t), w in zip(ROWS, brute_repeats(ROWS, True, 35)) if not w[2]}
    assert clean <= {(r.doc_id, r.text) for r in out.collect()}


# 4


def brute_quality(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = Counter(zip(words, words[1:], words[2:]))
    repeated = set()
    for i in range(len(words) - 2):
        if windows[tuple(words[i : i + 3])] > 1:
            repeated |= {i, i + 1, i + 2}
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), sum(x in lines[:i] for i, x in enumerate(lines)), len(repeated)


def test_quality(docs, none):
    rows = quality_rules.apply_policy(quality_rules.ledger(docs), "base").collect()
    got = [(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.kept) for r in rows]
    want = []
    for i, t in ROWS:
        m = brute_quality(t)
        want.append((i, *m, not (m[0] < 50 or 100 * m[4] > 50 * m[0])))
    same(got, want)
    ledger = quality_rules.ledger(docs)
    dropped = quality_rules.apply_policy(ledger).where("not kept").count()
    for r in quality_rules.ablations(ledger).collect():
        bit = quality_rules.BITS[r.rule]
        assert r.n_failed == ledger.where(F.col("failed").bitwiseAND(F.lit(bit)) != 0).count()
        without = ledger.where(F.col("failed").bitwiseAND(F.lit(quality_rules.POLICIES["v2"] & ~bit)) != 0).count()
        assert r.n_failed_alone == dropped - without and r.n_dropped == dropped
    assert quality_rules.ledger(none).count() == 0


def test_capitals_are_those_of_unicode():
    import unicodedata

    text = "ⅠªºʰǅΣ𝐀𝐚 É é ÀB"
    upper, lower = quality_rules.measure(text)[-2:]
    assert (upper, lower) == tuple(sum(unicodedata.category(c) == k for c in text) for k in ("Lu", "Ll"))


def test_clean_prose_passes(spark):
    prose = "\n".join("Ores the oredat the, anntly re thorreou ndernt for tionatth edes." for _ in range(1)) + " " + " ".join(f"word{i}" for i in range(80))
    assert quality_rules.apply_policy(quality_rules.ledger(spark.createDataFrame([(prose,)], "text string"))).first().kept


# 6


@pytest.mark.parametrize("n", [1, 2, 3, 10, 99, 100, 101, 1000, 4097])
def test_permutation_is_one(spark, n):
    want = feistel.permute_np(np.arange(n), n, 7)
    assert sorted(want) == list(range(n))
    got = {r.id: r.p for r in feistel.permute(spark.range(n), "id", "p", n, 7).collect()}
    assert [got[i] for i in range(n)] == want.tolist()


def test_sharding(docs, none):
    out = sharding.shard_rows(docs, shards=8)
    rows = out.collect()
    assert Counter((r.size, r.text_crc32) for r in rows) == Counter((len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for _, t in ROWS)
    counts = Counter(r.shard for r in rows)
    assert max(counts.values()) - min(counts.values()) <= 1 and set(counts) == set(range(8))
    for s in range(8):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(counts[s]))
    again = sharding.shard_rows(docs.repartition(5), shards=8)
    # the number of a row in the order of (id, CRC, size), permuted, gives shard and slot
    numbers = sorted((r.doc_id is not None, r.doc_id or 0, r.text_crc32, r.size) for r in rows)
    at = feistel.permute_np(np.arange(len(numbers)), len(numbers), 20240)
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.text_crc32, r.size, r.slot * 8 + r.shard) for r in rows) == sorted((*k, int(p)) for k, p in zip(numbers, at)) or len(set(numbers)) < len(numbers)
    place = lambda df: sorted(key((r.doc_id, r.text_crc32, r.shard, r.slot)) for r in df.collect())
    assert place(again) == place(out)
    assert sharding.shard_rows(none).count() == 0


# 7


def test_bpe(docs, none):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(bpe.default_path())
    out = bpe.encode_texts(docs, keep=["doc_id"])
    got = [(r.doc_id, r.n_tokens, bytes(r.ids), r.decoded) for r in out.collect()]
    want = []
    for i, t in ROWS:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), np.array(ids, dtype="<u4").tobytes(), library.decode(ids, skip_special_tokens=False)))
    same(got, want)
    both = bpe.decode_ids(out, name="again")
    assert both.where("again <> decoded").count() == 0
    assert bpe.encode_texts(none).count() == 0


def test_bpe_on_all_kinds_of_code_points():
    """Letters, marks, unassigned code points of three Unicode tables, alone and mixed."""
    from tokenizers import Tokenizer

    library, own, rng = Tokenizer.from_file(bpe.default_path()), bpe.WordBpe(bpe.default_path()), random.Random(3)
    points = [c for c in [*range(0x3100), *range(0xA000, 0xAC80), *range(0xF900, 0x11000), *range(0x1D000, 0x1D800), *range(0x1E600, 0x1E800), *range(0x2B700, 0x2B900), *range(0x323A0, 0x323C0)] if not 0xD800 <= c <= 0xDFFF]
    texts = ["".join(f"a{chr(c)}b {chr(c)}1{chr(c)}! " for c in points[i : i + 8]) for i in range(0, len(points), 8)]
    texts += ["".join(chr(rng.choice(points)) if rng.random() < 0.5 else rng.choice("ab 1'sΣ") for _ in range(12)) for _ in range(10000)]
    for text, found in zip(texts, library.encode_batch(texts, add_special_tokens=False)):
        assert own.encode(text) == found.ids, text


def test_bpe_refuses_other_files(tmp_path):
    import json

    import public_tokenizers

    with pytest.raises(ValueError):
        bpe.WordBpe(public_tokenizers.path("byte_bpe_50k.json"))
    with open(bpe.default_path(), encoding="utf-8") as f:
        spec = json.load(f)
    for change in ({"normalizer": None}, {"decoder": {"type": "ByteLevel"}}, {"model": spec["model"] | {"byte_fallback": True}}):
        (tmp_path / "other.json").write_text(json.dumps(spec | change), encoding="utf-8")
        with pytest.raises(ValueError):
            bpe.WordBpe(str(tmp_path / "other.json"))


# 8


def test_chat(spark):
    t = [(1, 0, "system", "s"), (1, 1, "user", "u"), (1, 2, "assistant", "good"), (2, 0, "system", "s"), (2, 1, "user", "u"), (2, 2, "assistant", "bad"), (2, 3, "user", "more"), (3, 0, "user", None), (3, 0, None, "x")]
    turns = spark.createDataFrame(t, "conv_id long, turn long, role string, text string").withColumn("prompt", F.lit("clash"))
    pairs = spark.createDataFrame([(0, 1, 2), (1, 1, 1), (2, 3, None), (3, None, None), (4, 9, 1)], "pair_id long, chosen_id long, rejected_id long")
    out = {r.pair_id: r for r in chat_format.format_pairs(pairs, turns).collect()}
    r = out[0]
    assert r.n_common == 2 and r.prompt == "<|system|>\ns<|end|>\n<|user|>\nu<|end|>\n"
    assert r.chosen == "<|assistant|>\ngood<|end|>\n"
    assert [r.chosen[m.start : m.end] for m in r.chosen_mask] == ["good<|end|>\n"]
    assert [r.rejected[m.start : m.end] for m in r.rejected_mask] == ["bad<|end|>\n"]
    assert (out[1].n_common, out[1].chosen, out[1].rejected, out[1].chosen_mask) == (3, "", "", [])
    assert (out[2].n_common, out[2].rejected) == (0, "") and out[2].chosen == "<||>\nx<|end|>\n<|user|>\n<|end|>\n"
    assert (out[3].n_common, out[3].prompt, out[3].chosen) == (0, "", "")
    assert out[4].chosen == "" and out[4].rejected.startswith("<|system|>")
    made = chat_format.neighbour_pairs(chat_format.gather_turns(turns)).collect()
    assert sorted(x for p in made for x in (p.chosen_id, p.rejected_id) if x is not None) == [1, 2, 3] and len(made) == 2
    assert any({p.chosen_id, p.rejected_id} == {1, 2} for p in made) or any(p.rejected_id is None for p in made)
    assert chat_format.neighbour_pairs(chat_format.gather_turns(turns.limit(0))).count() == 0


def test_chat_without_ids(spark):
    """Turns without a conversation id are one conversation, whose turns stay; a missing partner is not it."""
    t = [(None, 0, "user", "u"), (None, 1, "assistant", "a"), (1, 0, "user", "u"), (1, 1, "assistant", "b"), (2, 0, "user", "z")]
    turns = chat_format.gather_turns(spark.createDataFrame(t, "conv_id long, turn long, role string, text string"))
    pairs = chat_format.neighbour_pairs(turns)
    texts = sorted((r.chosen_id is None, r.prompt, r.chosen, r.rejected) for r in chat_format.format_gathered(pairs, turns).collect())
    u, a, b, z = (f"<|{r}|>\n{x}<|end|>\n" for r, x in (("user", "u"), ("assistant", "a"), ("assistant", "b"), ("user", "z")))
    assert sum(sum(map(len, x[1:])) for x in texts) in (len(u + a + b + z), len(u + u + a + b + z))
    assert sorted(x for r in pairs.collect() for x in ([r.chosen_id, r.rejected_id] if r.paired else [r.chosen_id]) if x is not None) == [1, 2]


def test_masks_of_a_long_conversation(spark):
    t = [(c, i, "assistant" if i % 2 else "user", f"t{i}" if i or not c else "other") for c in (0, 1) for i in range(3000)]
    turns = spark.createDataFrame(t, "conv_id long, turn long, role string, text string")
    pairs = spark.createDataFrame([(0, 0, 1)], "pair_id long, chosen_id long, rejected_id long")
    r = chat_format.format_pairs(pairs, turns).first()
    assert [r.chosen[m.start : m.end] for m in r.chosen_mask] == [f"t{i}<|end|>\n" for i in range(1, 3000, 2)]


# 9


def brute_fingerprint(text):
    import xxhash

    words = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode()).split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash(docs, none):
    fps = [brute_fingerprint(t) for _, t in ROWS]
    group = list(range(len(ROWS)))

    def find(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(ROWS)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                group[find(i)] = find(j)
    least = {}
    for n, (i, _) in enumerate(ROWS):
        if i is not None:
            least[find(n)] = min(i, least.get(find(n), i))
    want = [(i, f"{f:016x}", least.get(find(n))) for n, ((i, _), f) in enumerate(zip(ROWS, fps))]
    same([(r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect()], want)
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    best = {}
    for n, (i, t) in enumerate(ROWS):
        rank = (i is None, i or 0, hashlib.md5((t or "").encode()).hexdigest())
        if find(n) not in best or rank < best[find(n)][0]:
            best[find(n)] = rank, (i, t or "")
    same([(r.doc_id, r.text or "") for r in kept.collect()], [b for _, b in best.values()])
    assert simhash.near_duplicates(none).count() == 0 and simhash.drop_near_duplicates(none).count() == 0


def test_near_duplicates_keep_rows_not_ids(spark):
    a, b = " ".join(f"word{i}" for i in range(60)), " ".join(f"other{i}" for i in range(60))
    rows = [(3, a, 1), (5, a, 2), (5, b, 3), (None, a, 4), (None, b, 5), (None, "lone text", 6), (None, "lone text", 7)]
    kept = simhash.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, n int")).collect()
    same([(r.doc_id, r.text) for r in kept], [(3, a), (5, b), (None, "lone text")])


def test_long_lists_are_split_without_loss(spark, monkeypatch):
    rng = np.random.default_rng(6)
    x = {int(v) for v in rng.integers(0, 2**40, 300)}
    for v in list(x)[:150]:
        for _ in range(4):
            x.add(v ^ sum(1 << int(b) for b in rng.choice(64, int(rng.integers(1, 5)), replace=False)))
    signed = [v - (v >> 63 << 64) for v in sorted(x)]
    df = spark.createDataFrame([(v,) for v in signed], "fp long")

    def groups():
        parent = {v: v for v in signed}

        def find(a):
            while parent[a] != a:
                a = parent[a]
            return a

        for r in simhash.candidate_links(df).collect():
            parent[find(r.u)] = find(r.v)
        roots = defaultdict(set)
        for v in signed:
            roots[find(v)].add(v)
        return sorted(map(sorted, roots.values()))

    want = groups()
    monkeypatch.setattr(simhash, "LONG", 3)
    assert groups() == want and any(len(g) > 1 for g in want)


def test_long_chain_is_one_component(spark):
    from quillspark.llm.components import components

    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501), (7, 7)], "u long, v long")
    out = {r.node: r.root for r in components(edges).collect()}
    assert all(out[i] == 0 for i in range(201)) and out[501] == 500


def test_links_connect_what_brute_force_connects():
    rng = np.random.default_rng(2)
    for _ in range(8):
        x = []
        for b in rng.integers(0, 2**63, 4, dtype=np.uint64):
            for _ in range(int(rng.integers(1, 90))):
                v = int(b)
                for _ in range(int(rng.integers(0, 9))):
                    v ^= 1 << int(rng.integers(0, 64))
                x.append(v)
        x = np.unique(np.array(x, dtype=np.uint64))

        def roots(links):
            parent = {int(v): int(v) for v in x}

            def find(a):
                while parent[a] != a:
                    a = parent[a]
                return a

            for a, b in links:
                a, b = find(int(a)), find(int(b))
                parent[max(a, b)] = min(a, b)
            return {k: find(k) for k in parent}

        near = np.nonzero(np.bitwise_count(x[:, None] ^ x[None, :]) <= 4)
        want = roots(zip(x[near[0]], x[near[1]]))
        assert roots(simhash.link_list(x)) == want
        part = lambda p: (x >> np.uint64(8 * p)) & np.uint64(255)
        keys = np.concatenate([np.uint64(i << 24) | part(a) << np.uint64(16) | part(b) << np.uint64(8) | part(c) for i, (a, b, c) in enumerate(simhash.triples())])
        order = np.argsort(keys, kind="stable")
        assert roots(zip(*simhash.link_sorted(keys[order].astype(np.int64), np.tile(x, 20)[order]))) == want


# 10


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_token_counts(docs, none, rule):
    encode = token_counts.encoding(token_counts.default_path())[0]
    got = defaultdict(list)
    for r in token_counts.section_counts(docs, rule, keep=["doc_id", "text"]).collect():
        got[(r.doc_id, r.text)].append(r)
    for (i, t), copies in Counter(ROWS).items():
        rows = got.pop((i, t))
        lines = re.findall(r"[^\n]*\n|[^\n]+", t or "")
        assert len(rows) == max(1, len(lines)) * copies
        ids = encode.encode_ordinary(t or "")
        assert all(r.n_tokens == len(ids) for r in rows)
        if not lines:
            assert rows[0].section is None
            continue
        want, ends, at = [0.0] * len(lines), np.cumsum([len(x.encode()) for x in lines]), 0
        for token in ids:
            size = len(encode.decode_single_token_bytes(token))
            shares = [max(0, min(at + size, e) - max(at, e - len(x.encode()))) for e, x in zip(ends, lines)]
            if rule == "split":
                want = [w + s / size for w, s in zip(want, shares)]
            else:
                k = shares.index(max(shares)) if rule == "largest" else next(n for n, s in enumerate(shares) if s)
                want[k] += 1
            at += size
        for r in rows:
            assert abs(r.section_tokens - want[r.section]) < 1e-9 and t[r.char_start : r.char_end] == lines[r.section]
    assert not got and token_counts.section_counts(none).count() == 0
    rolled = token_counts.document_counts(token_counts.section_counts(docs, rule), ["lang"]).collect()
    assert sum(r.n_docs for r in rolled) == len(ROWS)


def test_token_counts_of_fields_and_paragraphs(spark):
    encode = token_counts.encoding(token_counts.default_path())[0]
    rows = [(1, "Title é", "a body\n\nof words; 1,2", None), (2, None, None, None), (3, "", "x", "tail")]
    df = spark.createDataFrame(rows, "doc_id long, title string, text string, note string")
    for rule in token_counts.RULES:
        got = defaultdict(dict)
        for r in token_counts.field_counts(df, ["title", "text", "note"], rule, keep=["doc_id"]).collect():
            got[r.doc_id][r.section] = r
        for i, *texts in rows:
            parts = [(t or "") + ("\n" if n < 2 else "") for n, t in enumerate(texts)]
            whole = "".join(parts)
            assert [whole[got[i][n].char_start : got[i][n].char_end] for n in range(3)] == parts
            assert all(r.n_tokens == len(encode.encode_ordinary(whole)) for r in got[i].values())
            assert sum(r.section_tokens for r in got[i].values()) == pytest.approx(len(encode.encode_ordinary(whole)))
            assert got[i][2].section_tokens > 0 or not parts[2]
    out = token_counts.section_counts(df, keep=["doc_id"], sections="paragraphs").where("doc_id = 1").orderBy("section").collect()
    assert [(r.char_start, r.char_end) for r in out] == [(0, 8), (8, 21)] and sum(r.section_tokens for r in out) == out[0].n_tokens
