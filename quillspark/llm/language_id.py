"""Operator 13, language identification: the nearest of several centroids of each language, by cosine of TF-IDF n-gram vectors.

A text is its letters, lower case, with one space for all that stands between; its n-grams of one to three characters are counted in
buckets of a hash. The weights of buckets come from all texts to learn from; each language's centroids from spherical k-means on a
bounded sample of its texts, a task for each language. A text is far from a language when its angle to the nearest centroid is
wider than that of nearly all of the sample: it is then marked as rejected.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.llm._common import configure, field, table, text_or_empty, trim_memory, without

#: Buckets of n-grams.
BUCKETS = 1 << 12
#: Characters of the longest n-gram.
LONGEST = 3
#: Texts that a language's centroids are fitted on at most: those of least hash of id and text. The weights of n-grams come from all.
SAMPLE = 1500
#: Centroids of a language.
CENTROIDS = 4
ROUNDS = 12
#: The share of the sample that may be farther from its centroid than the limit of rejection.
OUTSIDE = 0.005
#: Code points that are looked at together: a text of any length takes bounded memory.
BLOCK = 1 << 20
#: Texts whose dense vectors are compared at once.
TOGETHER = 128
UNKNOWN = "und"
_FACTOR, _MASK = np.uint32(2654435761), np.uint32(BUCKETS - 1)


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """For each code point its lower case if it is a letter, else zero. A letter whose lower case is several characters keeps the first."""
    out = np.zeros(0x110000, dtype=np.uint32)
    for c in range(0x110000):
        if (s := chr(c)).isalpha():
            out[c] = ord(s.lower()[0])
    return out


def _codes(text: str) -> Iterator[np.ndarray]:
    """Blocks of the letters of a text, words parted by a zero, which also begins and ends the text; a block starts with the last
    LONGEST - 1 codes of the one before."""
    table_, carried = letters(), np.zeros(1, dtype=np.uint32)
    for at in range(0, len(text), BLOCK):
        codes = table_[np.frombuffer(text[at : at + BLOCK].encode("utf-32-le", "surrogatepass"), dtype="<u4")]
        codes = np.concatenate([carried, codes])
        live = codes != 0
        live[1:] |= live[:-1]
        live[: len(carried)] = True
        codes = codes[live]
        if len(codes) > len(carried):
            yield codes
            carried = codes[-(LONGEST - 1) :]
    if carried[-1]:
        yield np.concatenate([carried, np.zeros(1, dtype=np.uint32)])


def counts(text: str) -> np.ndarray:
    """How often n-grams of each bucket stand in a text; nothing but zeros for one without letters."""
    out = np.zeros(BUCKETS, dtype=np.int64)
    new = 1  # the first code that wasn't seen yet; n-grams that end before it were counted with the block before
    for codes in _codes(text):
        mixed = np.zeros(len(codes) + 1, dtype=np.uint32)
        for n in range(1, LONGEST + 1):  # an n-gram's hash goes on from that of its first n - 1 codes
            mixed = (mixed[:-1] ^ codes[n - 1 :]) * _FACTOR
            mixed ^= mixed >> np.uint32(15)
            fresh = mixed[max(0, new - n + 1) :]
            out += np.bincount((fresh if n > 1 else fresh[codes[new:] != 0]) & _MASK, minlength=BUCKETS)
        new = LONGEST - 1
    return out


def weigh(counted: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Unit vectors of (1 + ln(count)) * idf, by rows; a row without n-grams stays zero."""
    x = np.log(np.maximum(counted, 1).astype(np.float32))
    x += counted > 0
    x *= idf.astype(np.float32)
    norm = np.linalg.norm(x, axis=-1, keepdims=True)
    x /= np.where(norm > 0, norm, 1)
    return x


def inverse(df: np.ndarray, n: int) -> np.ndarray:
    return np.log((1 + n) / (1 + df)) + 1


def cluster(x: np.ndarray, k: int = CENTROIDS, rounds: int = ROUNDS) -> np.ndarray:
    """Spherical k-means on unit rows: unit centroids, at most ``k``. The first is nearest to the mean, each next one the row
    farthest from those before; a cluster that loses all rows goes."""
    centres = x[[int((x @ x.mean(axis=0)).argmax())]]
    while len(centres) < min(k, len(x)):
        nearest = (x @ centres.T).max(axis=1)
        far = int(nearest.argmin())
        if nearest[far] > 1 - 1e-9:
            break  # every row is some centroid's copy
        centres = np.vstack([centres, x[far]])
    for _ in range(rounds):
        own = (x @ centres.T).argmax(axis=1)
        after = np.array([x[own == i].sum(axis=0) for i in range(len(centres)) if (own == i).any()])
        after /= np.linalg.norm(after, axis=1, keepdims=True)
        if after.shape == centres.shape and np.abs(after - centres).max() < 1e-9:
            break
        centres = after
    return centres


class Model:
    """Weights of buckets, and centroids by row with their languages and least cosines; languages in the order of their names."""

    def __init__(self, idf: np.ndarray, languages: list[str], centroids: np.ndarray, limits: np.ndarray):
        self.idf, self.languages, self.centroids, self.limits = idf, languages, centroids, limits

    def predict(self, texts: list[str]) -> list[tuple[str, float, bool]]:
        """(language, cosine, rejected) of each text."""
        out = []
        for at in range(0, len(texts), TOGETHER):
            counted = np.stack([counts(t) for t in texts[at : at + TOGETHER]])
            empty = ~counted.any(axis=1)
            if not len(self.centroids):
                out += [(UNKNOWN, 0.0, True)] * len(counted)
                continue
            cosines = weigh(counted, self.idf) @ self.centroids.T
            best = cosines.argmax(axis=1)
            score = np.clip(cosines[np.arange(len(best)), best], 0, 1)
            out += [(UNKNOWN, 0.0, True) if e else (self.languages[b], float(s), bool(s < self.limits[b])) for e, b, s in zip(empty, best, score)]
        return out


def _each(df: DataFrame, schema: T.StructType, work) -> DataFrame:
    """``work`` (an iterator of batches -> record batches' columns) on every partition."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        kinds = to_arrow_schema(schema)
        for columns in work(batches):
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, kinds)], schema=kinds)
        trim_memory()

    return df.mapInArrow(run, schema)


def fit(docs: DataFrame, lang_column: str = "lang", text_column: str = "text", id_column: str = "doc_id", sample: int = SAMPLE, centroids: int = CENTROIDS) -> Model:
    """The model of labelled texts; rows with a null label or a text without letters teach nothing.

    Two passes over the texts: how many of them hold each n-gram, summed by task, and the vectors of the sample, which become
    centroids in a task for each language. ``sample`` bounds what that task holds. The driver gets BUCKETS counts and, for each language,
    ``centroids`` vectors: as much as there are languages, however many texts. Repeated rows of one id and text count as often as
    they stand in the weights and once in the sample.
    """
    configure(docs.sparkSession)
    lang = F.col(f"`{lang_column}`").cast("string")
    rows = docs.where(lang.isNotNull()).select(lang.alias("lang"), text_or_empty(text_column).alias("text"), F.xxhash64(F.col(f"`{id_column}`").cast("string"), text_or_empty(text_column)).alias("h"))

    def frequencies(batches: Iterator) -> Iterator:
        held, n = np.zeros(BUCKETS, dtype=np.int64), 0
        for batch in batches:
            for t in batch.column(0):
                counted = counts(t.as_py()) > 0
                held += counted
                n += bool(counted.any())
        at = np.flatnonzero(held)
        yield [[-1, *at.tolist()], [n, *held[at].tolist()]]

    summed = _each(rows.select("text"), T.StructType([field("b", T.IntegerType()), field("n", T.LongType())]), frequencies).groupBy("b").agg(F.sum("n").alias("n"))
    df, n = np.zeros(BUCKETS), 0
    for b, v in summed.collect():
        if b < 0:
            n = v
        else:
            df[b] = v
    if not n:
        return Model(np.ones(BUCKETS), [], np.zeros((0, BUCKETS)), np.zeros(0))
    idf = inverse(df, n)

    places = Window.partitionBy("lang").orderBy("h")  # Spark keeps the first of each task before it shuffles
    least = rows.select("lang", "h").distinct().withColumn("place", F.row_number().over(places)).where(F.col("place") <= sample)
    edges = least.groupBy("lang").agg(F.max("h").alias("edge"))
    chosen = rows.join(F.broadcast(edges), "lang").where(F.col("h") <= F.col("edge"))  # a row for each language is broadcast
    schema = T.StructType([field("lang", T.StringType()), field("h", T.LongType()), field("x", T.BinaryType())])

    def vectors(batches: Iterator) -> Iterator:
        for batch in batches:
            made = [counts(t.as_py()) for t in batch.column(1)]
            yield [batch.column(0).to_pylist(), batch.column(2).to_pylist(), [c.astype("<i4").tobytes() if c.any() else None for c in np.minimum(made, (1 << 31) - 1)] if made else []]

    sampled = _each(chosen.select("lang", "text", "h"), schema, vectors).where("x is not null").groupBy("lang", "h").agg(F.first("x").alias("x"))
    learned = T.StructType([field("lang", T.StringType()), field("x", T.BinaryType()), field("least", T.DoubleType())])

    def learn(group):
        import pandas as pd

        group = group.sort_values("h")
        x = weigh(np.stack([np.frombuffer(b, dtype="<i4") for b in group["x"]]).astype(np.int64), idf)
        centres = cluster(x, centroids)
        cosines = x @ centres.T
        own = cosines.argmax(axis=1)
        nearest = cosines[np.arange(len(own)), own]
        limits = [float(np.quantile(nearest[own == i], OUTSIDE)) if (own == i).any() else 1.0 for i in range(len(centres))]
        return pd.DataFrame({"lang": group["lang"].iloc[0], "x": [c.astype("<f4").tobytes() for c in centres], "least": limits})

    made = sorted((r.lang, bytes(r.x), r.least) for r in sampled.groupBy("lang").applyInPandas(learn, learned).collect())
    if not made:
        return Model(idf, [], np.zeros((0, BUCKETS)), np.zeros(0))
    return Model(idf, [m[0] for m in made], np.stack([np.frombuffer(m[1], dtype="<f4") for m in made]), np.array([m[2] for m in made]))


def predict(docs: DataFrame, model: Model, text_column: str = "text", keep: list[str] | None = None, reject: bool = False) -> DataFrame:
    """The columns of ``docs`` (or those in ``keep``) with lang_pred, score and rejected.

    ``score`` is the cosine to the nearest centroid, 0 to 1; ``lang_pred`` its language, the first by name among equally near ones.
    A null text, and one without a letter, is ``und`` with score 0, and rejected; so is every text if nothing was learned. A text
    farther from its centroid than nearly all that was learned from is rejected; with ``reject`` its ``lang_pred`` is ``und`` too.
    Each row by itself; columns of ``docs`` with the name of a result are replaced.
    """
    configure(docs.sparkSession)
    names = ["lang_pred", "score", "rejected"]
    kept = without(docs.select(*[F.col(f"`{c}`") for c in keep]) if keep is not None else docs, names)
    source = docs.select(*[F.col(f"`{c}`") for c in kept], text_or_empty(text_column).alias("__qs_text"))
    schema = T.StructType([source.schema[c] for c in kept] + [field(n, k) for n, k in zip(names, (T.StringType(), T.DoubleType(), T.BooleanType()))])
    shared = docs.sparkSession.sparkContext.broadcast(model)  # some vectors a language

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        kinds = to_arrow_schema(schema)
        for batch in batches:
            made = shared.value.predict(batch.column(len(kept)).to_pylist())
            if reject:
                made = [(UNKNOWN if m[2] else m[0], *m[1:]) for m in made]
            columns = [pa.array([m[i] for m in made], type=kinds.field(len(kept) + i).type) for i in range(3)]
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(len(kept))], *columns], schema=kinds)
        trim_memory()

    return source.mapInArrow(run, schema)


def held_out(id_column: str = "doc_id"):
    """Whether crc32 of the id as text is divisible by five; a null id is neither held out nor learned from."""
    return F.crc32(F.col(f"`{id_column}`").cast("string").cast("binary")) % 5 == 0


def identify(docs: DataFrame, id_column: str = "doc_id", lang_column: str = "lang", text_column: str = "text") -> DataFrame:
    """(id, held_out, lang_pred, score, rejected) of every row, learned from those not held out. See :func:`predict` and :func:`held_out`."""
    model = fit(docs.where(~held_out(id_column)), lang_column, text_column, id_column)
    marked = docs.select(F.col(f"`{id_column}`").alias("__qs_id"), F.coalesce(held_out(id_column), F.lit(False)).alias("held_out"), F.col(f"`{text_column}`").alias("__qs_source"))
    return predict(marked, model, "__qs_source", ["__qs_id", "held_out"]).withColumnRenamed("__qs_id", id_column)


def op13_language_id(spark, sf_dir):
    return identify(table(spark, sf_dir, "documents"))
