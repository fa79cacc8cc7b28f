r"""Operator 1, benchmark decontamination: a broadcast hash set of normalised test n-grams, scanned against token windows.

Words: A-Z in lower case, then [^\x00-\x2F\x3A-\x60\x7B-\x7F]+. A window is 10
consecutive words of an item, or the whole item if it has fewer.

Any occurrence of a window of n words holds a whole block of b = (n + 1) div 2
words at a multiple of b. So a document is cut into blocks side by side, each
block is looked up once in the hash set of the b-grams of all windows, and only
where one is found the windows around it are verified word for word: a tenth
of the look-ups and of the rows that sliding windows would need, and nothing is
missed. All of it is DataFrame operations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm._common import materialize, table, text_or_empty, without

WINDOW = 10
#: Bytes of n-grams up to which the hash set is broadcast; beyond, the same join is shuffled.
BROADCAST_BYTES = 64 << 20

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case and nothing else; where all characters are ASCII, lower() does that and faster."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))


def normalised(text: Column) -> Column:
    """The words of a text with one space between them."""
    return F.trim(F.regexp_replace(lower_ascii(text), _GAP, " "))


def word_count(norm: Column) -> Column:
    return F.when(norm == "", F.lit(0)).otherwise(F.length(norm) - F.length(F.replace(norm, F.lit(" "), F.lit(""))) + 1).cast("long")


def block_length(n: int) -> int:
    return (n + 1) // 2


def windows_of(benchmark: DataFrame, window: int = WINDOW, id_column: str = "item_id", text_column: str = "text") -> DataFrame:
    """(gram, n, item): the distinct windows of all items, their numbers of words and items as strings; items without words have none."""
    words = F.split(normalised(text_or_empty(text_column)), " ")
    items = benchmark.select(F.col(f"`{id_column}`").cast("string").alias("item"), words.alias("w")).where("w[0] <> ''")
    n = f"least(size(w), {window})"
    grams = F.expr(f"transform(sequence(0, size(w) - {n}), i -> array_join(slice(w, i + 1, {n}), ' '))")
    return items.select("item", F.expr(n).alias("n"), F.explode(grams).alias("gram")).distinct()


def _sized(df: DataFrame, column: str) -> DataFrame:
    """``df`` with a broadcast hint if all its strings fit in BROADCAST_BYTES, measured, not guessed; else a hint for a shuffled join."""
    size = df.agg(F.coalesce(F.sum(F.octet_length(column) + 64), F.lit(0))).first()[0]
    return df.hint("broadcast") if size <= BROADCAST_BYTES else df.hint("shuffle_hash")


def _once(value: Column, use) -> Column:
    """flatten(use(value)) with ``value`` computed once: as the only element of an array, it is bound to a name."""
    return F.flatten(F.transform(F.array(value), use))


def _with_neighbours(cut: Column, b: int) -> Column:
    """The blocks that ``cut`` makes of a text, each with the one before and the one after."""

    def each(c: Column) -> Column:
        return F.transform(c, lambda x, i: F.struct(F.lit(b).alias("b"), i.alias("q"), F.get(c, i - 1).alias("before"), x.alias("block"), F.get(c, i + 1).alias("after")))

    return _once(cut, each)


def _grams(words: Column, n: int) -> Column:
    """All runs of n words, joined by spaces, with the word that each starts at; there must be n words."""
    return _once(words, lambda w: F.transform(F.sequence(F.lit(0), F.size(w) - n), lambda i: F.struct(i.alias("i"), F.array_join(F.slice(w, i + 1, n), " ").alias("gram"))))


def _placed(n: int):
    return lambda g: F.struct((F.col("first") + g["i"]).alias("start"), F.lit(n).alias("n"), g["gram"].alias("gram"))


def find_hits(docs: DataFrame, keys: list[str], norm: str, windows: DataFrame, every_row: bool) -> DataFrame:
    """``keys`` with hits (start, n: windows found, in words) and items (the ids that they belong to), a row for each value of ``keys``.

    ``norm`` names the column of normalised text. ``every_row``: also rows without hits; else only those that have some.
    """
    lengths = [r[0] for r in windows.select("n").distinct().collect()]  # WINDOW values at most
    sizes = sorted({block_length(n) for n in lengths})
    if not sizes:
        empty = docs.select(*keys, F.expr("cast(array() as array<struct<start: int, n: int>>)").alias("hits"), F.expr("cast(array() as array<string>)").alias("items"))
        return empty if every_row else empty.limit(0)
    blocks = []
    for b in sizes:
        cut = F.regexp_extract_all(F.col(norm), F.lit(rf"(?:[^ ]+ ){{0,{b - 1}}}[^ ]+"), F.lit(0))
        blocks.append(_with_neighbours(cut, b))
    # A row of every key goes through both joins. Where its join keys are null, a string of its own that no text holds (words have
    # no NUL) spreads such rows over all partitions of a shuffled join; nulls alone would all meet in one.
    own = F.concat(F.lit("\0"), F.hex(F.xxhash64(*keys)))
    marker = F.array(F.struct(F.lit(None).cast("int").alias("b"), F.lit(None).cast("int").alias("q"), F.lit(None).cast("string").alias("before"), own.alias("block"), F.lit(None).cast("string").alias("after")))
    cut = docs.select(*keys, F.explode(F.concat(marker, *blocks) if every_row else F.concat(*blocks)).alias("x")).select(*keys, "x.*")
    grams = []
    for n in lengths:
        b = block_length(n)
        each = F.explode(_grams(F.split("gram", " "), b))
        grams.append(windows.where(F.col("n") == n).select(each.alias("g")).select(F.lit(b).alias("b"), F.col("g.gram").alias("block")))
    known = grams[0]
    for g in grams[1:]:
        known = known.union(g)
    known = _sized(known.distinct().withColumn("known", F.lit(True)), "block")
    found = cut.join(known, ["b", "block"], "left").where("known or b is null") if every_row else cut.join(known, ["b", "block"])
    around = found.select(*keys, "b", (F.greatest(F.col("q") - 1, F.lit(0)) * F.col("b")).alias("first"), F.split(F.concat_ws(" ", "before", "block", "after"), " ").alias("w"))
    tried = []
    none = F.expr("cast(array() as array<struct<start: int, n: int, gram: string>>)")
    for n in lengths:
        usable = (F.col("b") == block_length(n)) & (F.size("w") >= n)
        at = F.transform(_grams(F.col("w"), n), _placed(n))
        tried.append(F.when(usable, at).otherwise(none))
    tried = F.concat(*tried)
    tried = F.when(F.col("b").isNotNull(), tried)
    candidates = around.select(*keys, (F.explode_outer if every_row else F.explode)(tried).alias("t")).select(*keys, "t.start", "t.n", F.coalesce("t.gram", own).alias("gram"))
    members = _sized(windows, "gram")
    kept = candidates.join(members.withColumnRenamed("n", "window_n"), "gram", "left" if every_row else "inner")
    hit = F.when(F.col("window_n").isNotNull(), F.struct("start", "n"))
    return kept.groupBy(*keys).agg(F.collect_set(hit).alias("hits"), F.collect_set("item").alias("items"))


def hit_words(hits: str = "hits") -> Column:
    """The numbers, from 0, of the words that lie in any of the windows found."""
    return F.array_distinct(F.flatten(F.transform(hits, lambda h: F.sequence(h["start"], h["start"] + h["n"] - 1))))


def report(docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """A row for every document: its id, n_words, n_hit, n_items, items (sorted as strings), contaminated.

    Every row of ``docs`` gets its own, so repeated rows and ids and null ids need no care. Null and empty texts have no words and
    no hits. Items of null or empty text have no windows; an item without id can hit but isn't counted in n_items. Repeated items
    count once. An empty table of either kind gives no rows, or no hits. Other columns are not read, so none can clash.
    """
    windows = materialize(windows_of(benchmark), "windows")
    rows = docs.select(F.col(f"`{id_column}`").alias("__qs_id"), F.monotonically_increasing_id().alias("__qs_row"), normalised(text_or_empty(text_column)).alias("norm"))
    rows = rows.withColumn("n_words", word_count(F.col("norm")))
    found = find_hits(rows, ["__qs_id", "__qs_row", "n_words"], "norm", windows, every_row=True)
    n_hit = F.size(hit_words()).cast("long")
    return found.select(
        F.col("__qs_id").alias(id_column),
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sort_array("items").alias("items"),
        (F.size("hits") > 0).alias("contaminated"),
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, mode: str = "spans", text_column: str = "text") -> DataFrame:
    """``docs`` without what is in the benchmark: mode "spans" removes the words that windows cover, with the gap before each, from
    the texts and leaves all else; mode "documents" removes whole documents that hold a window. Columns as in ``docs``.

    Hits are joined by the text's MD5, under which those of copies merge. What is done to a text takes linear time, however many of
    its words are hit. Texts without hits are not changed, null texts stay null.
    """
    if mode not in ("spans", "documents"):
        raise ValueError("mode must be 'spans' or 'documents'")
    windows = materialize(windows_of(benchmark), "windows")
    text = text_or_empty(text_column)
    digest = F.unhex(F.md5(F.encode(text, "UTF-8")))
    found = find_hits(docs.select(digest.alias("__qs_md5"), normalised(text).alias("norm")), ["__qs_md5"], "norm", windows, every_row=False)
    hits = found.select("__qs_md5", hit_words().alias("__qs_hit"))
    keyed = docs.withColumn("__qs_md5", digest)
    if mode == "documents":
        return keyed.join(hits.hint("shuffle_hash"), "__qs_md5", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
    joined = keyed.join(hits.hint("shuffle_hash"), "__qs_md5", "left")
    ink, gap = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]", r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
    pieces = F.regexp_extract_all(F.col(f"`{text_column}`"), F.lit(f"{gap}*{ink}+"), F.lit(0))
    tail = F.regexp_extract(F.col(f"`{text_column}`"), f"{gap}*\\z", 0)
    # as a lambda's variable the pieces are made once; a text with hits has words
    rest = F.transform(F.array(pieces), lambda p: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(p) - 1), "__qs_hit"), lambda i: p[i]), ""))
    kept = F.concat(rest[0], tail)
    return joined.select(*[F.when(F.col("__qs_hit").isNotNull(), kept).otherwise(F.col(f"`{c}`")).alias(c) if c == text_column else F.col(f"`{c}`") for c in docs.columns])


def op1_decontamination(spark, sf_dir):
    made = report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return made.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.encode(F.array_join("items", ","), "UTF-8"), 256).alias("items_sha256"), F.expr("n_hit > 0").alias("contaminated"))


_NORM = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP1_SQL = f"""
with b as (select item_id::varchar as item, {_NORM} as w from benchmark),
g as (select distinct item, least(len(w), {WINDOW}) as n, unnest(list_transform(range(0, len(w) - least(len(w), {WINDOW}) + 1), lambda i: array_to_string(w[i + 1:i + least(len(w), {WINDOW})], ' '))) as gram from b where len(w) > 0),
d as (select row_number() over () as r, doc_id, {_NORM} as w from documents),
k as (select distinct n from g),
c as (select r, n, unnest(range(0, len(w) - n + 1)) as s, unnest(list_transform(range(0, len(w) - n + 1), lambda i: array_to_string(w[i + 1:i + n], ' '))) as gram from d, k where len(w) >= n),
h as (select r, s, c.n, item from c join g on c.gram = g.gram and c.n = g.n),
x as (select r, count(distinct p)::bigint as n_hit from (select r, unnest(range(s, s + n)) as p from h) group by r),
i as (select r, count(distinct item)::bigint as n_items, string_agg(distinct item, ',' order by item) as items from h group by r)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
  sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join x on d.r = x.r left join i on d.r = i.r
"""
