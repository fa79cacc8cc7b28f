"""Operator 11, ranked lexical search: Block-Max WAND over a sharded, stored index.

A shard holds the postings of some thousand documents, numbered by id: for each term, blocks of 128 postings, packed in as few bytes as
their gaps and counts need. Beside a block stand its first and last document and its impacts, the pairs of count and document length that no
other pair of the block outdoes. From these the greatest score that the block can give follows for any statistics of the corpus, so
the index is built in one pass, before they are known.

A search goes through a shard by stretches of documents, those between the bounds of any two blocks of its lists, as within one all
pointers stand still. Moving the pointers over the bounds without opening blocks (shallow moves) gives each stretch the sum of its blocks'
maxima. The best stretches are pivots first, after a few documents of the greatest impacts; one that can't reach the score of the k-th best so far is passed, its blocks shut. In a
pivot's documents the lists are taken by what they can give at most: a document goes as soon as what is left can't lift it that far, and
blocks are opened only where documents remain. What a few shards return gives the others the score to reach. Documents are scored a
stretch at a time, by array, since an item of a whole passage has frequent words enough to make a third of all documents pivots.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.llm._common import configure, discard, field, materialize, table, text_or_empty, trim_memory

#: Postings of a block.
BLOCK = 128
#: A shard is closed when it holds so many postings or documents; a document's postings stay together.
SHARD_POSTINGS, SHARD_DOCS = 1 << 21, 1 << 16
#: Of so many shards one goes first, to give the others a score to reach.
SEEDS = 8
#: Documents of the stretches that a search looks at first; then four times as many, and so on.
FIRST = 1 << 10
#: Blocks of a list, those of greatest impact, whose documents are scored before all others.
BEST_BLOCKS = 2
#: Terms of items that are broadcast at once, and terms that an index is restricted to at most; more items go in blocks, more terms
#: into an index of all terms.
TERMS_AT_ONCE, TERMS_RESTRICTED = 1 << 19, 1 << 20
TOP = 20

#: A-Z become a-z; all of ASCII but digits and letters becomes a space. Bytes of other characters stay.
_FOLDED = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words(text: str) -> list[bytes]:
    """The terms of a text, in order, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").translate(_FOLDED).split()


def pack(slots: np.ndarray, tfs: np.ndarray, before: int) -> bytes:
    """Gaps between documents, less one, and counts, less one: in 1, 2 or 4 bytes each, as the largest needs. ``before``: the last
    document of the block before."""
    gaps = np.diff(slots, prepend=before) - 1
    out = [b""]
    kinds = 0
    for x in (gaps, tfs - 1):
        width = 0 if x.max() < 1 << 8 else 1 if x.max() < 1 << 16 else 2
        kinds = kinds * 4 + width
        out.append(x.astype(("u1", "<u2", "<u4")[width]).tobytes())
    out[0] = bytes([kinds])
    return b"".join(out)


def unpack(packed: bytes, n: int, before: int) -> tuple[np.ndarray, np.ndarray]:
    gap, tf = divmod(packed[0], 4)
    kinds = ("u1", "<u2", "<u4")
    gaps = np.frombuffer(packed, dtype=kinds[gap], count=n, offset=1).astype(np.int64)
    tfs = np.frombuffer(packed, dtype=kinds[tf], count=n, offset=1 + n * (1 << gap)).astype(np.int64)
    return np.cumsum(gaps + 1) + before, tfs + 1


def impacts(tfs: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The (count, length) pairs of a block that no other outdoes by a count as great and a length as small."""
    order = np.lexsort((lengths, -tfs))
    tfs, lengths = tfs[order], lengths[order]
    best = np.minimum.accumulate(lengths)
    keep = np.concatenate([[True], lengths[1:] < best[:-1]])
    return np.column_stack([tfs[keep], lengths[keep]]).astype("<i4")


class Shard:
    """Postings of documents until they are written as blocks."""

    def __init__(self):
        self.ids: list = []
        self.lengths: list[int] = []
        self.terms: dict[bytes, int] = {}
        self.docs: list[np.ndarray] = []
        self.term_of: list[np.ndarray] = []
        self.tfs: list[np.ndarray] = []
        self.postings = 0

    def add(self, id_, found: list[bytes], wanted) -> None:
        counted = Counter(found)
        kept = counted if wanted is None else {t: counted[t] for t in (counted.keys() & wanted)}
        known = self.terms
        self.term_of.append(np.fromiter((known.setdefault(t, len(known)) for t in kept), dtype=np.int32, count=len(kept)))
        self.tfs.append(np.fromiter(kept.values(), dtype=np.int32, count=len(kept)))
        self.docs.append(np.full(len(kept), len(self.ids), dtype=np.int32))
        self.ids.append(id_)
        self.lengths.append(len(found))
        self.postings += len(kept)

    def full(self) -> bool:
        return self.postings >= SHARD_POSTINGS or len(self.ids) >= SHARD_DOCS

    def blocks(self) -> Iterator[tuple]:
        """(term, block, first and last document, postings, impacts, packed postings); documents are numbered by id, null ids last."""
        order = sorted(range(len(self.ids)), key=lambda i: (self.ids[i] is None, self.ids[i] if self.ids[i] is not None else 0))
        place = np.empty(len(order), dtype=np.int64)
        place[order] = np.arange(len(order))
        self.ids = [self.ids[i] for i in order]
        self.lengths = np.array(self.lengths, dtype=np.int64)[order]
        if not self.postings:
            return
        term_of, slots, tfs = np.concatenate(self.term_of), place[np.concatenate(self.docs)], np.concatenate(self.tfs).astype(np.int64)
        by = np.lexsort((slots, term_of))
        term_of, slots, tfs = term_of[by], slots[by], tfs[by]
        ends = np.flatnonzero(np.diff(term_of, append=-1)) + 1
        at = 0
        for name, end in zip(self.terms, ends.tolist()):  # terms were numbered in the order of this dictionary
            before = -1
            for block, a in enumerate(range(at, end, BLOCK)):
                b = min(a + BLOCK, end)
                s, f = slots[a:b], tfs[a:b]
                yield name.decode("utf-8", "surrogatepass"), block, int(s[0]), int(s[-1]), b - a, impacts(f, self.lengths[s]).tobytes(), pack(s, f, before)
                before = int(s[-1])
            at = end


def build_index(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", terms: DataFrame | None = None) -> DataFrame:
    """The stored index of a table: a row for each block of each term and shard, and one without a term for each shard, with the ids
    and lengths of its documents. ``terms``: (term) to which postings are restricted, unless they are too many to broadcast.

    Tasks make shards of the documents that they read, so nothing is shuffled, and a hot id or source makes no difference. A null text
    has no terms, and documents without terms are in no shard. Repeated rows are documents of their own.
    """
    spark = docs.sparkSession
    configure(spark)
    wanted = None
    if terms is not None and terms.count() <= TERMS_RESTRICTED:
        wanted = spark.sparkContext.broadcast({t.encode("utf-8", "surrogatepass") for (t,) in terms.select("term").collect()})
    source = docs.select(F.col(f"`{id_column}`").alias("id"), text_or_empty(text_column).alias("text"))
    kinds = [("shard", T.LongType()), ("term", T.StringType()), ("block", T.IntegerType()), ("first", T.IntegerType()), ("last", T.IntegerType()), ("n", T.IntegerType()), ("impacts", T.BinaryType()), ("packed", T.BinaryType())]
    schema = T.StructType([*[field(n, k) for n, k in kinds], field("ids", T.ArrayType(source.schema["id"].dataType)), field("lengths", T.BinaryType())])

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        out, number = to_arrow_schema(schema), TaskContext.get().partitionId() << 20

        def closed(shard: Shard) -> Iterator:
            rows, size = [], 0
            for row in shard.blocks():
                rows.append((number, *row, None, None))
                size += 1
                if size % 4096 == 0:
                    yield rows
                    rows = []
            rows.append((number, None, -1, 0, len(shard.ids) - 1, len(shard.ids), None, None, shard.ids, shard.lengths.astype("<i4").tobytes()))
            yield rows

        shard = Shard()
        for batch in batches:
            for i, t in enumerate(batch.column(1)):
                found = words(t.as_py())
                if found:
                    shard.add(batch.column(0)[i].as_py(), found, wanted and wanted.value)
                if shard.full():
                    for rows in closed(shard):
                        yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows), out)], schema=out)
                    shard, number = Shard(), number + 1
        if shard.ids:
            for rows in closed(shard):
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows), out)], schema=out)
        trim_memory()

    return materialize(source.mapInArrow(run, schema), "blocks")


class Postings:
    """The blocks of one term in one shard. A block that is opened fills its part of ``docs`` and ``scores``, which then stay."""

    def __init__(self, firsts: np.ndarray, lasts: np.ndarray, sizes: np.ndarray, maxima: np.ndarray, packed: list[bytes]):
        self.firsts, self.lasts, self.sizes, self.maxima, self.packed = firsts, lasts, sizes, maxima, packed
        self.most = int(maxima.max())
        self.shut = np.ones(len(lasts), dtype=bool)
        self.docs = self.scores = None

    def at(self, blocks: np.ndarray, twelve_m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Documents and impacts of some blocks (ascending), opened where they weren't yet."""
        if self.docs is None:
            total = int(self.sizes.sum())
            self.docs, self.scores = np.empty(total, dtype=np.int32), np.empty(total, dtype=np.int32)
        for b in blocks[self.shut[blocks]].tolist():
            docs, tfs = unpack(self.packed[b], int(self.sizes[b]), int(self.lasts[b - 1]) if b else -1)
            a = b * BLOCK
            self.docs[a : a + len(docs)] = docs
            self.scores[a : a + len(docs)] = impact(tfs, twelve_m[docs])
            self.shut[b] = False
        if len(blocks) == len(self.lasts):
            return self.docs, self.scores
        if blocks[-1] - blocks[0] == len(blocks) - 1:
            part = slice(int(blocks[0]) * BLOCK, int(blocks[-1] + 1) * BLOCK)
            return self.docs[part], self.scores[part]
        places = (blocks[:, None] * BLOCK + np.arange(BLOCK)).ravel()
        places = places[places < len(self.docs)]
        return self.docs[places], self.scores[places]


class Searcher:
    """One shard's lists."""

    def __init__(self, lists: dict[str, Postings], lengths: np.ndarray, n: int, total: int):
        self.lists, self.end = lists, len(lengths)
        self.twelve_m = 12 * modulus(lengths.astype(np.int64), n, total)
        self.sums, self.seen = np.zeros(self.end, dtype=np.int64), np.zeros(self.end, dtype=bool)

    def stretches(self, live: list[tuple[int, Postings]]) -> tuple[np.ndarray, np.ndarray]:
        """First documents of the stretches between the bounds of blocks, and the sum of the maxima of the blocks over each."""
        ends = np.concatenate([p.lasts for _, p in live]).astype(np.int64) + 1
        begins = np.concatenate([p.firsts for _, p in live]).astype(np.int64)
        maxima = np.concatenate([w * p.maxima for w, p in live])
        at, where = np.unique(np.concatenate([begins, ends]), return_inverse=True)
        steps = np.zeros(len(at), dtype=np.int64)
        np.add.at(steps, where[: len(begins)], maxima)
        np.subtract.at(steps, where[len(begins) :], maxima)
        return at, np.cumsum(steps)

    def top(self, weights: list[tuple[str, int]], k: int, reach: int) -> list[tuple[int, int]]:
        """(score, document) of the ``k`` best that score ``reach`` at least, and more than zero; of equal scores those of lesser number."""
        live = sorted(((w, self.lists[t]) for t, w in weights if w > 0 and t in self.lists), key=lambda c: -c[0] * c[1].most)
        if not live:
            return []
        need = max(1, reach)
        for w, p in live:  # a block's maximum is some document's, so k blocks vouch for k documents
            if len(p.maxima) >= k:
                need = max(need, w * int(np.partition(p.maxima, -k)[-k]))
        best = np.zeros((0, 2), dtype=np.int64)
        ahead = [np.zeros(0, dtype=np.int32)]
        for _, p in live:  # documents of the greatest impacts, of rare terms first
            ahead.append(p.at(np.sort(np.argsort(-p.maxima)[:BEST_BLOCKS]), self.twelve_m)[0])
            if sum(map(len, ahead)) >= 2 * k:
                break
        ahead = np.unique(np.concatenate(ahead))
        best, need = self._take(best, self._score(live, ahead, need), k, need)
        begins, bounds = self.stretches(live)
        sizes = np.diff(begins, append=self.end)
        order = np.argsort(-bounds, kind="stable")
        self.seen[ahead] = True
        at, docs = 0, FIRST
        while at < len(order) and bounds[order[at]] >= need:
            upto = at + 1 + int(np.searchsorted(np.cumsum(sizes[order[at:]]), docs))
            some = order[at:upto]
            some = np.sort(some[bounds[some] >= need])  # those that fall short stay shut
            at, docs = upto, docs * 4
            first = np.cumsum(sizes[some]) - sizes[some]
            there = np.repeat(begins[some] - first, sizes[some]) + np.arange(int(sizes[some].sum()))
            best, need = self._take(best, self._score(live, there[~self.seen[there]], need), k, need)
        self.seen[ahead] = False
        return [(s, d) for s, d in best.tolist()]

    @staticmethod
    def _take(best: np.ndarray, found: np.ndarray, k: int, need: int) -> tuple[np.ndarray, int]:
        """The ``k`` best of what there was and what is new, and the score to reach from then on."""
        best = np.concatenate([best, found])
        best = best[np.lexsort((best[:, 1], -best[:, 0]))][:k]
        return best, max(need, int(best[-1, 0])) if len(best) == k else need

    def _score(self, live: list[tuple[int, Postings]], docs: np.ndarray, need: int) -> np.ndarray:
        """(score, document) of those among ``docs`` (ascending) that reach ``need``. Lists go by the most they can give; a document that
        can't reach it by what is left is dropped, and only blocks over what remains are opened."""
        sums, rest, touched = self.sums, sum(w * p.most for w, p in live), []
        for w, p in live:
            docs = docs[sums[docs] + rest >= need]
            if not len(docs):
                break
            rest -= w * p.most
            blocks = np.searchsorted(p.lasts, docs)
            blocks = blocks[np.flatnonzero(np.diff(blocks, prepend=-1))]
            blocks = blocks[: np.searchsorted(blocks, len(p.lasts))]
            if len(blocks):
                held, scores = p.at(blocks, self.twelve_m)
                sums[held] += w * scores.astype(np.int64)
                touched.append(held)
        scores = sums[docs]
        for held in touched:
            sums[held] = 0
        met = scores >= need
        return np.column_stack([scores[met], docs[met]])


def modulus(lengths: np.ndarray, n: int, total: int) -> np.ndarray:
    """A document's m: its length against the mean, in hundredths, by a quarter."""
    return 75 + (25 * lengths * n) // total


def impact(tfs: np.ndarray, twelve_m: np.ndarray) -> np.ndarray:
    """What one occurrence of weight 1 in an item gives a document."""
    return (1_000_000_000 * tfs) // (1000 * tfs + twelve_m)


def _lists(rows, n: int, total: int) -> tuple[dict[str, Postings], np.ndarray, list]:
    """A shard's lists, lengths and ids from its rows of the index (an Arrow table)."""
    rows = rows.sort_by([("term", "ascending"), ("block", "ascending")])
    terms, firsts, lasts, sizes = (rows[c].to_pylist() for c in ("term", "first", "last", "n"))
    held, packed = rows["impacts"].to_pylist(), rows["packed"].to_pylist()
    head = terms.index(None)
    lengths, ids = np.frombuffer(rows["lengths"][head].as_py(), dtype="<i4"), rows["ids"][head]
    lists: dict[str, Postings] = {}
    live = len(terms) - 1
    if live:
        order = [i for i in range(len(terms)) if i != head]
        pairs = np.frombuffer(b"".join(held[i] for i in order), dtype="<i4").reshape(-1, 2).astype(np.int64)
        starts = np.cumsum([0, *[len(held[i]) // 8 for i in order[:-1]]])
        maxima = np.maximum.reduceat(impact(pairs[:, 0], 12 * modulus(pairs[:, 1], n, total)), starts)
        firsts, lasts, sizes = np.array([firsts[i] for i in order], dtype=np.int32), np.array([lasts[i] for i in order], dtype=np.int32), np.array([sizes[i] for i in order], dtype=np.int64)
        a = 0
        for b in range(1, live + 1):
            if b == live or terms[order[b]] != terms[order[a]]:
                lists[terms[order[a]]] = Postings(firsts[a:b], lasts[a:b], sizes[a:b], maxima[a:b], [packed[i] for i in order[a:b]])
                a = b
    return lists, lengths, ids


def item_terms(items: DataFrame, item_column: str = "item_id", text_column: str = "text") -> DataFrame:
    """(number, item, term, times): the terms of each item, written; an item is a row, numbered apart from its id."""
    configure(items.sparkSession)
    source = items.select(F.monotonically_increasing_id().alias("number"), F.col(f"`{item_column}`").alias("item"), text_or_empty(text_column).alias("text"))
    schema = T.StructType([field("number", T.LongType()), source.schema["item"], field("term", T.StringType()), field("times", T.LongType())])

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        out = to_arrow_schema(schema)
        for batch in batches:
            rows = [(i, t.decode("utf-8", "surrogatepass"), n) for i, text in enumerate(batch.column(2)) for t, n in Counter(words(text.as_py())).items()]
            at = pa.array([r[0] for r in rows], type=pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array([r[1] for r in rows], type=pa.string()), pa.array([r[2] for r in rows], type=pa.int64())], schema=out)

    return materialize(source.mapInArrow(run, schema), "items")


def search(index: DataFrame, items: DataFrame, k: int = TOP) -> DataFrame:
    """(number, id, score, rank): the ``k`` best documents of an index for each item of :func:`item_terms`, by score, then id (null last).

    Weights are from the whole index: N documents, L terms, df documents of a term. A shard is one task's, and its size is bounded;
    what leaves it are ``k`` rows an item. Items are broadcast in blocks of bounded size, each of which takes its own pass over the lists
    of its terms. One shard in SEEDS goes first, and the k-th score found there is what the others must reach: so their blocks
    are passed unopened, and no result changes.
    """
    spark = index.sparkSession
    head = index.where("term is null")
    lengths = F.udf(lambda b: int(np.frombuffer(b, dtype="<i4").sum(dtype=np.int64)), "long")  # a row for each shard
    n, total, shards = head.agg(F.sum("n"), F.sum(lengths("lengths")), F.count("*")).first()
    id_kind = index.schema["ids"].dataType.elementType
    schema = T.StructType([field("number", T.LongType()), field("id", id_kind), field("score", T.LongType())])
    if not n:
        return spark.createDataFrame([], T.StructType([*schema.fields, field("rank", T.IntegerType())]))
    asked = items.select("term").distinct()
    df = index.where("term is not null").select("term", "n").join(asked.hint("shuffle_hash"), "term", "left_semi").groupBy("term").agg(F.sum("n").alias("df"))
    weighed = items.join(df, "term").select("number", "term", (F.col("times") * F.floor(F.lit(1000.0) * F.log(F.lit(2.0 * n + 2.0) / (2 * F.col("df") + 1)))).alias("weight")).where("weight > 0")
    weighed = materialize(weighed.groupBy("number").agg(F.collect_list(F.struct("term", "weight")).alias("terms")), "weighed")  # an item's distinct terms
    blocks = -(-(weighed.agg(F.sum(F.size("terms"))).first()[0] or 0) // TERMS_AT_ONCE)
    parts = []
    for block in range(blocks):
        mine = weighed.where(F.pmod(F.hash("number"), F.lit(blocks)) == block)
        held = sorted((r.number, [(t.term, t.weight) for t in r.terms]) for r in mine.collect())
        names = spark.createDataFrame([(t,) for t in sorted({t for _, terms in held for t, _ in terms})], "term string")
        rows = index.join(F.broadcast(names), "term", "left_semi").unionByName(head).select("shard", "term", "block", "first", "last", "n", "impacts", "packed", "ids", "lengths")
        rows = rows.repartition(min(shards, int(spark.conf.get("spark.sql.shuffle.partitions"))), "shard")  # small in bytes, but much work
        queries = spark.sparkContext.broadcast(held)

        def work(reach):
            def run(group):
                import pyarrow as pa
                from pyspark.sql.pandas.types import to_arrow_schema

                lists, sizes, ids = _lists(group, n, total)
                searcher = Searcher(lists, sizes, n, total)
                made = []
                for number, terms in queries.value:
                    made += [(number, ids[d].as_py(), s) for s, d in searcher.top(terms, k, reach.value.get(number, 0))]
                return pa.table([pa.array([m[i] for m in made], type=f.type) for i, f in enumerate(to_arrow_schema(schema))], schema=to_arrow_schema(schema))

            return run

        seed = F.pmod(F.xxhash64("shard"), F.lit(SEEDS)) == 0
        parts_first = materialize(rows.where(seed).groupBy("shard").applyInArrow(work(spark.sparkContext.broadcast({})), schema), "first")
        ranked = parts_first.withColumn("place", F.row_number().over(Window.partitionBy("number").orderBy(F.col("score").desc())))
        reach = {r.number: r.score for r in ranked.where(F.col("place") == k).select("number", "score").collect()}  # a number for each item of the block
        parts += [parts_first, rows.where(~seed).groupBy("shard").applyInArrow(work(spark.sparkContext.broadcast(reach)), schema)]
    if not parts:
        return spark.createDataFrame([], T.StructType([*schema.fields, field("rank", T.IntegerType())]))
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    order = Window.partitionBy("number").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def rank_documents(docs: DataFrame, items: DataFrame, id_column: str = "doc_id", item_column: str = "item_id", k: int = TOP) -> DataFrame:
    """(item, rank, id, score): the ``k`` best documents of each item, those of positive score.

    The index is built for the items' terms alone. Null texts have no terms. Repeated rows of documents are ranked each; of equal scores
    the lesser id goes first, null ids last. Each row of ``items`` is ranked for itself, so that ids that repeat give ranks that repeat.
    An empty table of either kind gives an empty result. Other columns are not read.
    """
    asked = item_terms(items, item_column)
    index = build_index(docs, id_column, terms=asked.select("term").distinct())
    found = search(index, asked, k)
    names = asked.select("number", F.col("item").alias("__qs_item")).distinct()
    return found.join(names, "number").select(F.col("__qs_item").alias(item_column), "rank", F.col("id").alias(id_column), "score")


def op11_block_max(spark, sf_dir):
    return rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
OP11_SQL = f"""with w as (select doc_id, unnest(regexp_extract_all({_LOWER}, '{_TERM}')) as term from documents),
    tf as (select doc_id, term, count(*) as tf from w group by all), len as (select doc_id, count(*) as n from w group by 1),
    s as (select count(*) as docs, sum(n)::bigint as total from len),
    df as (select term, cast(floor(1000 * ln((2.0::double * docs + 2) / (2 * count(*) + 1))) as bigint) as w from tf, s group by term, docs),
    m as (select doc_id, 75 + (25 * n * docs) // total as m from len, s),
    q as (select item_id, term, count(*) as times from (select item_id, unnest(regexp_extract_all({_LOWER}, '{_TERM}')) as term from benchmark) group by all),
    r as (select item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::bigint as score from q join tf using (term) join df using (term) join m using (doc_id) group by all)
    select item_id, rank, doc_id, score from (select *, (row_number() over (partition by item_id order by score desc, doc_id))::int as rank from r where score > 0) where rank <= {TOP}"""
