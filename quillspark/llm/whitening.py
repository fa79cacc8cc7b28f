"""Operator 12, embedding whitening: an exact covariance by digit slices, then principal components of unit variance.

A vector's entries become integers. Their covariance is a matter of integers too, too large for float64: so an entry, less the floor
of its dimension's mean, is split into digits of 16 bits, matrices of digits are multiplied by BLAS, whose sums stay below 2^53 and
so are exact, and the products are put together again as integers of any length. Tasks' integers are cut into digits for Spark to
sum, so that no merge overflows or rounds. The first rounding is that of the quotients which make the matrix to decompose.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.llm._common import configure, discard, field, materialize, table

#: An entry is stored in steps of 1 / SCALE.
SCALE = 256
COMPONENTS = 4
#: Bits of a digit of an entry; digits lie in [-2^15, 2^15), differences of two in (-2^16, 2^16).
BITS = 16
#: Rows of a product of digits: 2^12 products of 2^32 stay below 2^53 by far.
BLOCK = 1 << 12
#: Products that an int64 takes up before it is emptied into integers of any length: 2^18 sums of 2^44.
HELD = 1 << 18
#: Bits of the digits by which tasks' integers are merged.
MERGE_BITS = 48


@dataclass
class Model:
    """What whitening needs: the number of distinct vectors, sums by dimension, components by column, and their eigenvalues."""

    n: int
    sums: list[int]
    axes: np.ndarray
    values: np.ndarray
    trace: float
    scatter: list[list[int]]
    identity_error: float = 0.0


def digits(x: np.ndarray) -> list[np.ndarray]:
    """Digits of 16 bits, lowest first, in [-2^15, 2^15): the least number of them that all entries need, one at least."""
    half, mask, out = 1 << (BITS - 1), (1 << BITS) - 1, []
    while True:
        low = ((x & mask) ^ half) - half
        out.append(low)
        x = (x >> BITS) + (low < 0)  # no step can overflow, not even from the ends of int64
        if not x.any():
            return out


def slices(x: np.ndarray, centre: np.ndarray) -> list[np.ndarray]:
    """``x - centre`` as matrices of digits in float64."""
    a, b = digits(x), digits(centre)
    zero = np.zeros(1, dtype=np.int64)
    return [(p - q).astype(np.float64) for p, q in ((a[k] if k < len(a) else zero, b[k] if k < len(b) else zero) for k in range(max(len(a), len(b))))]


class Products:
    """The sum of x' x over rows of ``x - centre``, exact."""

    def __init__(self, centre: np.ndarray):
        self.centre = centre
        self.d = len(centre)
        self.held: dict[int, np.ndarray] = {}
        self.count = 0
        self.total = np.zeros((self.d, self.d), dtype=object)

    def add(self, x: np.ndarray) -> None:
        for at in range(0, len(x), BLOCK):
            parts = slices(x[at : at + BLOCK], self.centre)
            for i, a in enumerate(parts):
                for j, b in enumerate(parts):
                    made = np.rint(a.T @ b).astype(np.int64)
                    self.held[i + j] = self.held[i + j] + made if i + j in self.held else made
            self.count += len(parts)  # of products that share a place there are as many at most
            if self.count >= HELD:
                self.merge()

    def merge(self) -> np.ndarray:
        """Limbs are recombined as integers of any length."""
        for place, made in self.held.items():
            self.total = self.total + made.astype(object) * (1 << (BITS * place))
        self.held, self.count = {}, 0
        return self.total


def cut(value: int) -> list[int]:
    """Digits of MERGE_BITS bits, lowest first, all of the sign of the value."""
    sign, value, out = (-1 if value < 0 else 1), abs(value), []
    while value:
        out.append(sign * (value & ((1 << MERGE_BITS) - 1)))
        value >>= MERGE_BITS
    return out


def vectors(rows: DataFrame, column: str, keep: list[str]) -> tuple[DataFrame, int]:
    """The usable rows of a table with their integers in ``__qs_x``, and the number of dimensions."""
    entries = F.transform(F.col(f"`{column}`"), lambda c: c.cast("double"))
    usable = F.coalesce(F.forall(entries, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))), F.lit(False))
    source = rows.where(usable).select(*[F.col(f"`{c}`") for c in keep], F.transform(entries, lambda c: F.floor(c * SCALE)).alias("__qs_x"))
    d = source.agg(F.max(F.size("__qs_x"))).first()[0] or 0
    return source.withColumn("__qs_x", F.concat("__qs_x", F.array_repeat(F.lit(0).cast("long"), F.lit(d) - F.size("__qs_x")))), d


def _matrix(column, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False).reshape(-1, d)


def _merged(df: DataFrame, work, d: int) -> dict[tuple[int, int], int]:
    """Sums over all rows of the integers that ``work`` (an iterator of matrices -> a matrix of integers) makes in each task."""
    schema = T.StructType([field("p", T.IntegerType()), field("q", T.IntegerType()), field("k", T.IntegerType()), field("v", T.LongType())])

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        made = work(_matrix(batch.column(0), d) for batch in batches)
        rows = [(p, q, k, v) for p, line in enumerate(made) for q, value in enumerate(line) for k, v in enumerate(cut(int(value)))]
        yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows) if rows else [[]] * 4, to_arrow_schema(schema))], schema=to_arrow_schema(schema))

    # a row for each pair of dimensions and digit: as many as the matrix has entries, whatever the number of rows
    summed = df.select("__qs_x").mapInArrow(run, schema).groupBy("p", "q", "k").agg(F.sum(F.col("v").cast("decimal(20,0)")).alias("v"))
    out: dict[tuple[int, int], int] = {}
    for p, q, k, v in summed.collect():
        out[p, q] = out.get((p, q), 0) + (int(v) << (MERGE_BITS * k))
    return out


def _total(parts: Iterator[np.ndarray], d: int) -> list[list[int]]:
    n, sums = 0, [0] * d
    for x in parts:
        n += len(x)
        for k, part in enumerate(digits(x)):
            sums = [s + (int(v) << (BITS * k)) for s, v in zip(sums, part.sum(axis=0))]
    return [[n, *sums]]


def _project(x: np.ndarray, model: Model) -> np.ndarray:
    """Whitened rows; NaN in components without variance."""
    n = model.n
    centre = np.array([s // n for s in model.sums], dtype=np.int64)
    rest = np.array([(s - n * (s // n)) / n for s in model.sums])
    moved = sum(part * float(1 << (BITS * k)) for k, part in enumerate(slices(x, centre))) - rest
    scale = np.array([1 / np.sqrt(v) if v > 0 else np.nan for v in model.values])
    return (moved @ model.axes) * scale


def fit(distinct: DataFrame, d: int, components: int = COMPONENTS) -> Model | None:
    """The model of a table of distinct vectors (``__qs_x``, ``d`` integers each); None without any.

    Components are unit eigenvectors by falling eigenvalue, signed so that their largest entry is positive. Eigenvalues within
    rounding of zero count as zero.
    """
    if not d:
        return None
    head = _merged(distinct, lambda parts: _total(parts, d), d)
    n = head.get((0, 0), 0)
    if not n:
        return None
    sums = [head.get((0, 1 + i), 0) for i in range(d)]
    centre = np.array([s // n for s in sums], dtype=np.int64)

    def work(parts: Iterator[np.ndarray]) -> np.ndarray:
        products = Products(centre)
        for x in parts:
            products.add(x)
        return products.merge()

    found = _merged(distinct, work, d)
    left = [s - n * (s // n) for s in sums]
    # of rows n * x - S: n^2 times the products of what was multiplied, less n times those of its sums
    scatter = [[n * (n * found.get((p, q), 0) - left[p] * left[q]) for q in range(d)] for p in range(d)]
    v = np.array([[entry / n**3 for entry in line] for line in scatter])
    values, axes = np.linalg.eigh(v)
    order = np.argsort(-values, kind="stable")[: min(components, d)]
    values, axes, trace = values[order], axes[:, order], float(np.trace(v))
    values = np.where(values > d * np.finfo(float).eps * max(trace, 0), values, 0.0)
    axes = axes * np.where(axes[np.abs(axes).argmax(axis=0), range(axes.shape[1])] < 0, -1, 1)
    model = Model(n, sums, axes, values, trace, scatter)
    model.identity_error = _identity_error(distinct, d, model)
    return model


def _identity_error(distinct: DataFrame, d: int, model: Model) -> float:
    """The largest entry of the whitened vectors' covariance less the identity, measured on the rows themselves."""
    live = np.flatnonzero(model.values > 0)
    if not len(live):
        return 0.0
    schema = T.StructType([field("i", T.IntegerType()), field("j", T.IntegerType()), field("v", T.DoubleType())])

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        total = np.zeros((len(live) + 1, len(live) + 1))
        for batch in batches:
            z = _project(_matrix(batch.column(0), d), model)[:, live]
            z = np.column_stack([z, np.ones(len(z))])
            total += z.T @ z
        i, j = np.indices(total.shape)
        yield pa.RecordBatch.from_arrays([pa.array(i.ravel(), type=pa.int32()), pa.array(j.ravel(), type=pa.int32()), pa.array(total.ravel())], schema=to_arrow_schema(schema))

    total = np.zeros((len(live) + 1, len(live) + 1))
    for i, j, v in distinct.select("__qs_x").mapInArrow(run, schema).groupBy("i", "j").agg(F.sum("v")).collect():
        total[i, j] = v
    total /= model.n
    return float(np.abs(total[:-1, :-1] - np.outer(total[-1, :-1], total[-1, :-1]) - np.eye(len(live))).max())


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """The sum over dimensions of (n*x - S)^2 of each row, exact; None where no long can hold it."""
    if not x.size:
        return [0] * len(x)
    most = n * max(abs(int(x.min())), abs(int(x.max()))) + max(map(abs, sums))
    kind = np.int64 if most * most * x.shape[1] < 1 << 63 else object
    y = x.astype(kind) * n - np.array(sums, dtype=kind)
    return [v if v < 1 << 63 else None for v in (y * y).sum(axis=1).tolist()]


def fitted(rows: DataFrame, column: str = "embedding", keep: list[str] | None = None, components: int = COMPONENTS) -> tuple[DataFrame, int, Model | None]:
    """Usable rows (``keep``, __qs_x), the number of dimensions, and the model of their distinct vectors.

    The distinct vectors are written once: they are read three times, for sums, products and the check of the result. Copies of
    one vector meet as one row a task.
    """
    configure(rows.sparkSession)
    source, d = vectors(rows, column, keep or [])
    distinct = materialize(source.select("__qs_x").distinct(), "fit")
    model = fit(distinct, d, components)
    discard(distinct)
    return source, d, model


def whiten(rows: DataFrame, id_column: str = "vec_id", column: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error) for each usable row and component.

    Vectors that are null or hold null or non-finite entries are dropped; shorter ones count as padded with zeros, and an empty
    vector so as zeros. Entries beyond a long's range after scaling are held at its ends. Repeated rows, equal vectors, repeated and
    null ids each get their rows; a vector counts once in the fit. ``whitened`` is null in a component without variance (one
    distinct vector, or fewer than components), ``explained`` 0 there; ``identity_error`` is over the others. ``deviation`` is
    null where no long can hold it. Other columns are not read. No usable row, or no dimension: an empty result.
    """
    source, d, model = fitted(rows, column, [id_column], components)
    kind = source.schema[id_column].dataType
    names = [id_column, "component", "n", "deviation", "whitened", "explained", "identity_error"]
    kinds = [kind, T.IntegerType(), T.LongType(), T.LongType(), T.DoubleType(), T.DoubleType(), T.DoubleType()]
    schema = T.StructType([field(n, k) for n, k in zip(names, kinds)])
    if model is None:
        return rows.sparkSession.createDataFrame([], schema)
    many = len(model.values)
    explained = [float(v / model.trace) if model.trace > 0 else 0.0 for v in model.values]

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        out = to_arrow_schema(schema)
        for batch in batches:
            x = _matrix(batch.column(1), d)
            z = _project(x, model).ravel()
            whole = len(x) * many
            made = [
                batch.column(0).take(pa.array(np.repeat(np.arange(len(x)), many))),
                pa.array(np.tile(np.arange(1, many + 1, dtype=np.int32), len(x))),
                pa.array(np.full(whole, model.n)),
                pa.array([v for v in deviations(x, model.n, model.sums) for _ in range(many)], type=pa.int64()),
                pa.array(z, mask=np.isnan(z)),
                pa.array(np.tile(explained, len(x))),
                pa.array(np.full(whole, model.identity_error)),
            ]
            yield pa.RecordBatch.from_arrays(made, schema=out)

    return source.mapInArrow(run, schema)


def moments(rows: DataFrame, column: str = "embedding") -> DataFrame:
    """(p, q, n, sum_p, scatter) for each pair of dimensions, p <= q: the sum over distinct vectors of (n*x - S)[p] * (n*x - S)[q],
    exact, as text. The table has d (d + 1) / 2 rows, however many vectors there are."""
    _, d, model = fitted(rows, column)
    schema = "p int, q int, n long, sum_p string, scatter string"
    made = [] if model is None else [(p, q, model.n, str(model.sums[p]), str(model.scatter[p][q])) for p in range(d) for q in range(p, d)]
    return rows.sparkSession.createDataFrame(made, schema)


def op12_whitening(spark, sf_dir):
    return whiten(table(spark, sf_dir, "embeddings"))


def whitening_moments(spark, sf_dir):
    return moments(table(spark, sf_dir, "embeddings"))


#: The exact part of operator 12; eigenvectors are beyond SQL.
MOMENTS_SQL = f"""with x as (select distinct list_transform(embedding, lambda c: cast(floor({SCALE} * cast(c as double)) as bigint)) as x from embeddings
    where embedding is not null and len(list_filter(embedding, lambda c: c is null or not isfinite(c))) = 0),
    n as (select count(*) as n from x), v as (select row_number() over () as i, x from x),
    e as (select i, unnest(range(len(x)))::int as p, unnest(x) as x from v),
    s as (select p, sum(x) as s from e group by p),
    y as (select i, e.p, n * x::hugeint - s as y, s from e join s using (p), n)
    select a.p, b.p as q, any_value(n) as n, any_value(a.s)::varchar as sum_p, sum(a.y * b.y)::varchar as scatter from y a join y b on a.i = b.i and a.p <= b.p, n group by a.p, b.p"""
