"""Copies of one text over many tasks, marks that tables of Unicode disagree on, texts dense in benchmark passages."""

import random
import time
import unicodedata

from pyspark.sql import functions as F

from quillspark.llm import bpe, decontamination, substring_dedup
from tests.llm.test_ops import norm_words


def test_marks_as_the_library():
    """Every mark before and after marks of low and high combining class, and beside some at random."""
    from tokenizers import Tokenizer

    library, mine = Tokenizer.from_file(bpe.default_path()), bpe.WordBpe(bpe.default_path())
    marks = [chr(c) for c in range(0x80, 0x110000) if unicodedata.category(chr(c))[0] == "M"]
    rng = random.Random(1)
    assert {"఼", "഻", "഼"} <= bpe.odd_marks()
    for c in marks:
        for d in bpe.REFERENCE_MARKS + "".join(rng.choices(marks, k=3)):
            for s in (f"a{c}{d}", f"É{d}{c} क{c}"):
                assert mine.encode(s) == library.encode(s, add_special_tokens=False).ids, [hex(ord(x)) for x in s]


def test_copies_of_one_text_meet_in_no_task(spark):
    """4,000 copies of one text and 800 others, with something else in each row (Spark splits by bytes as written, and bare copies
    compress to nothing): no task has more than a third of the rows."""
    rng = random.Random(3)
    prose = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(n))
    hot = prose(90)
    rows = [(i, hot, f"{rng.getrandbits(4000):x}") for i in range(4000)] + [(5000 + i, prose(80), f"{rng.getrandbits(4000):x}") for i in range(800)]
    settings = {"spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20k", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20k", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "8", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        docs = spark.createDataFrame(rows, "doc_id long, text string, other string").repartition(8)
        made = substring_dedup.drop_repeats(docs)
        sizes = [r.n for r in made.withColumn("task", F.spark_partition_id()).groupBy("task").agg(F.count("*").alias("n")).collect()]
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert sum(sizes) == len(rows) and max(sizes) <= len(rows) / 3, sorted(sizes)


def test_texts_dense_in_passages(spark):
    """A text that is itself an item, and one whose every second stretch is: time grows with the text, the rest stays as it was."""
    rng = random.Random(4)
    prose = lambda n: [f"{rng.choice('abcdef')}{rng.randint(0, 10**6)}" for _ in range(n)]
    whole, item = prose(60_000), prose(12)
    mixed = [w for i in range(2000) for w in (item if i % 2 else prose(12))]
    docs = spark.createDataFrame([(1, " ".join(whole)), (2, ", ".join(mixed) + "."), (3, "clean, text")], "doc_id long, text string")
    items = spark.createDataFrame([(1, " ".join(whole)), (2, " ".join(item))], "item_id long, text string")
    began = time.time()
    got = {r.doc_id: r.text for r in decontamination.decontaminate(docs, items).collect()}
    assert time.time() - began < 40
    assert norm_words(got[1]) == [] and got[3] == "clean, text"
    hit, grams = set(), {tuple(item[i : i + 10]) for i in range(3)}
    for i in range(len(mixed) - 9):
        if tuple(mixed[i : i + 10]) in grams:
            hit |= set(range(i, i + 10))
    assert norm_words(got[2]) == [w for i, w in enumerate(mixed) if i not in hit] and got[2].endswith(".")
