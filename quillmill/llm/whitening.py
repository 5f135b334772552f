"""Whitening of embeddings from an exact integer scatter.

Every entry c, read as a double, becomes the integer floor(256 c). The fit list
holds each distinct integer vector once; it is made by one shuffle of packed
vectors, so copies meet before it and a very common vector is one row a task.
Every task subtracts the same shift from its vectors and adds up sums and
cross-products without rounding: entries are split into 20-bit limbs whose
matrix products are exact in doubles, and the totals are integers of any size.
Tasks' totals are added row by row of the matrix, each row in one stream. The
driver gets one matrix of the vectors' dimension, forms n·XᵀX - SSᵀ exactly,
and only then turns it to doubles for ``eigh``. A second pass over the fit list
measures how far the whitened vectors' covariance is from the identity; a third
over all rows projects them.

Defined cases: null vectors, empty ones and those with null or non-finite
entries are dropped; so are vectors of another length than most have (of
equally frequent lengths the longest counts), as they lie in another space;
integers beyond 64 bits stop at its limits; a direction in which the fit list
does not vary has no component, so one distinct vector alone gives no rows, nor
does an empty table; a deviation beyond 38 digits is null; repeated rows and
ids, and null ids, give rows each. Other columns are ignored unless kept.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmill.llm.common import stored

SCALE = 256
COMPONENTS = 4
#: Bits of a limb, and vectors multiplied at once: their products' sums stay below 2**53.
LIMB = 20
ROWS = 4096
#: Eigenvalues below this share of the largest, times the dimension, are rounding of zero.
ZERO = 2.0**-50
LEAST, MOST = -(2**63), 2**63 - 1


def sound_rows(column: pa.Array) -> tuple[np.ndarray, dict[int, np.ndarray]]:
    """Vectors without null or non-finite entries, by length: the positions of the rows of each, and their integers."""
    column = column.cast(pa.list_(pa.float64()))
    offsets = np.asarray(column.offsets)
    values = column.values
    flat = np.asarray(values.fill_null(float("nan")).to_numpy(zero_copy_only=False), np.float64)
    sizes = np.diff(offsets)
    sizes = np.where(np.asarray(column.is_valid()), sizes, 0)
    found = {}
    for d in np.unique(sizes[sizes > 0]):
        at = np.flatnonzero(sizes == d)
        rows = flat[offsets[at][:, None] + np.arange(d)]
        fine = np.isfinite(rows).all(axis=1)
        if fine.any():
            found[int(d)] = (at[fine], integers(rows[fine]))
    return found


def integers(rows: np.ndarray) -> np.ndarray:
    """floor(256 c), within 64 bits."""
    with np.errstate(over="ignore"):
        whole = np.floor(rows * SCALE)
    inside = np.abs(whole) < 2.0**63
    out = np.where(inside, whole, 0).astype(np.int64)
    return np.where(inside, out, np.where(whole > 0, MOST, LEAST))


def packed(rows: np.ndarray) -> list[bytes]:
    """The bytes of each vector, in as few a number as all its entries fit in, with that width before them."""
    widths = np.full(len(rows), 8)
    for bits in (4, 2, 1):
        fits = ((rows >= -(1 << (8 * bits - 1))) & (rows < 1 << (8 * bits - 1))).all(axis=1)
        widths[fits] = bits
    out: list[bytes] = [b""] * len(rows)
    for bits in np.unique(widths):
        at = np.flatnonzero(widths == bits)
        raw = rows[at].astype(f"<i{bits}").tobytes()
        step = int(bits) * rows.shape[1]
        for k, i in enumerate(at):
            out[i] = bytes([bits]) + raw[k * step : (k + 1) * step]
    return out


def unpacked(keys: Iterable[bytes], dim: int) -> np.ndarray:
    keys = list(keys)
    out = np.empty((len(keys), dim), np.int64)
    for bits in {k[0] for k in keys}:
        at = [i for i, k in enumerate(keys) if k[0] == bits]
        out[at] = np.frombuffer(b"".join(keys[i][1:] for i in at), f"<i{bits}").reshape(-1, dim)
    return out


def distinct_vectors(vectors: DataFrame, column: str) -> DataFrame:
    """(dim, key, copies): every distinct integer vector once, packed."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, (_, rows) in sound_rows(batch.column(0)).items():
                keys = pa.array(packed(rows), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array([dim] * len(keys), pa.int32()), keys], ["dim", "key"])

    keys = vectors.select(F.col(f"`{column}`").cast("array<double>").alias("v")).mapInArrow(pack, "dim int, key binary")
    return stored(keys.groupBy("dim", "key").agg(F.count(F.lit(1)).alias("copies")), "vectors")


def limbs(rows: np.ndarray) -> list[np.ndarray]:
    """Signed doubles of at most 2**19 whose sum, each moved up 20 bits more than the one before, gives the integers."""
    out, rest = [], rows
    while not out or rest.any():
        low = rest & ((1 << LIMB) - 1)
        low -= (low >> (LIMB - 1)) << LIMB
        out.append(low.astype(np.float64))
        rest = (rest >> LIMB) + (low < 0)
    return out


class Scatter:
    """Sums and cross-products of integer vectors, exact at any size."""

    def __init__(self, dim: int):
        self.n = 0
        self.sums = np.zeros(dim, object)
        self.products = np.zeros((dim, dim), object)

    def add(self, rows: np.ndarray) -> None:
        for at in range(0, len(rows), ROWS):
            parts = limbs(rows[at : at + ROWS])
            self.n += len(parts[0])
            for i, a in enumerate(parts):
                self.sums += a.sum(axis=0).astype(np.int64).astype(object) << LIMB * i
                for j, b in enumerate(parts):
                    self.products += (a.T @ b).astype(np.int64).astype(object) << LIMB * (i + j)


def scatter(fit: DataFrame, dim: int, shift: np.ndarray) -> Scatter:
    """Over all rows of ``key``: tasks add their own vectors, then each row of the matrix is added over the tasks."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Scatter(dim)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                own.add(unpacked(batch.column(0).slice(at, ROWS).to_pylist(), dim) - shift)
        if own.n:
            lines = [[str(own.n), str(own.sums[i]), *map(str, own.products[i])] for i in range(dim)]
            for i, line in enumerate(lines):
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([line], pa.list_(pa.string()))], ["i", "line"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, list[int]] = {}
        for batch in batches:
            for i, line in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                known = total.get(i)
                total[i] = [int(x) + (known[k] if known else 0) for k, x in enumerate(line)]
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([list(map(str, v)) for v in total.values()], pa.list_(pa.string()))], ["i", "line"])

    kind = "i int, line array<string>"
    lines = fit.select("key").mapInArrow(gather, kind).repartition(F.col("i")).mapInArrow(merge, kind)
    out = Scatter(dim)
    for r in lines.collect():  # a row for each dimension
        n, s, *products = map(int, r["line"])
        out.n, out.sums[r["i"]] = n, s
        out.products[r["i"]] = products
    return out


@dataclass
class Whitener:
    """``axes`` are the components' unit vectors as columns; ``error`` is that of their whitened covariance."""

    n: int
    sums: list[int]
    axes: np.ndarray
    values: np.ndarray
    trace: float
    error: float = 0.0

    @property
    def dim(self) -> int:
        return len(self.sums)

    def centred(self, rows: np.ndarray) -> np.ndarray:
        """n·x - S, exactly: in 64 bits where that fits, else in integers of any size."""
        reach = self.n * max(abs(int(rows.min(initial=0))), abs(int(rows.max(initial=0)))) + max(map(abs, self.sums), default=0)
        if reach < 2**62:
            return rows * self.n - np.array(self.sums, np.int64)
        return rows.astype(object) * self.n - np.array(self.sums, object)

    def project(self, centred: np.ndarray) -> np.ndarray:
        return (centred / self.n).astype(np.float64) @ self.axes / np.sqrt(self.values)

    def deviation(self, centred: np.ndarray) -> list[int]:
        if centred.dtype != object and self.dim * float(np.abs(centred).max(initial=0)) ** 2 >= 2.0**62:
            centred = centred.astype(object)
        return [int(x) for x in (centred * centred).sum(axis=1)]


def decomposed(found: Scatter, shift: np.ndarray, components: int) -> Whitener:
    """Eigenvectors of the covariance, by falling eigenvalue, the largest entry of each made positive."""
    n, dim = found.n, len(found.sums)
    exact = found.products * n - np.outer(found.sums, found.sums)
    square = n * n
    covariance = np.array([[int(x) / square for x in line] for line in exact], np.float64)
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = values[::-1], vectors[:, ::-1]
    some = min(components, int((values > max(values[0], 0) * dim * ZERO).sum()))
    axes = vectors[:, :some]
    axes = axes * np.sign(axes[np.abs(axes).argmax(axis=0), np.arange(some)]) if some else axes
    trace = int(sum(exact[i, i] for i in range(dim))) / square
    return Whitener(n, [int(s) + n * int(h) for s, h in zip(found.sums, shift, strict=True)], axes, values[:some], trace)


def identity_error(fit: DataFrame, model: Whitener) -> float:
    """Largest entry of the covariance of the whitened fit list less the identity; each task centres its own rows before they are multiplied."""
    some, dim = len(model.values), model.dim
    shared = fit.sparkSession.sparkContext.broadcast(model)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        white, n, mean, spread = shared.value, 0, np.zeros(some), np.zeros((some, some))
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                rows = white.project(white.centred(unpacked(batch.column(0).slice(at, ROWS).to_pylist(), dim)))
                n, mean, spread = joined(n, mean, spread, *moments(rows))
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([mean.tolist()], pa.list_(pa.float64())), pa.array([spread.ravel().tolist()], pa.list_(pa.float64()))], ["n", "mean", "spread"])

    total = (0, np.zeros(some), np.zeros((some, some)))
    for r in fit.select("key").mapInArrow(gather, "n long, mean array<double>, spread array<double>").collect():  # a few numbers for each task
        total = joined(*total, r["n"], np.array(r["mean"]), np.array(r["spread"]).reshape(some, some))
    return float(np.abs(total[2] / total[0] - np.eye(some)).max())


def moments(rows: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    mean = rows.mean(axis=0)
    return len(rows), mean, (rows - mean).T @ (rows - mean)


def joined(n: int, mean: np.ndarray, spread: np.ndarray, m: int, other: np.ndarray, added: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    """Count, mean and centred products of two parts taken together."""
    gap = other - mean
    return n + m, mean + gap * (m / (n + m)), spread + added + np.outer(gap, gap) * (n * m / (n + m))


def fit(vectors: DataFrame, column: str = "embedding", components: int = COMPONENTS) -> Whitener | None:
    """None if no vector is left, or none differs from another."""
    listed = distinct_vectors(vectors, column)
    sizes = listed.groupBy("dim").agg(F.sum("copies").alias("rows"), F.min("key").alias("first"), F.max(F.substring("key", 1, 1)).alias("width")).orderBy(F.desc("rows"), F.desc("dim")).first()
    if sizes is None:
        return None
    dim = sizes["dim"]
    listed = listed.where(F.col("dim") == dim)
    # a vector of the list takes the bulk of the size away, unless differences could pass 64 bits
    shift = np.zeros(dim, np.int64) if bytes(sizes["width"]) == b"\x08" else unpacked([bytes(sizes["first"])], dim)[0]
    model = decomposed(scatter(listed, dim, shift), shift, components)
    if not len(model.values):
        return None
    model.error = identity_error(listed, model)
    return model


RESULT = (
    T.StructType().add("component", "integer").add("n", "long").add("deviation", T.DecimalType(38, 0)).add("whitened", "double").add("explained", "double").add("identity_error", "double")
)


def whitened(vectors: DataFrame, model: Whitener | None, column: str = "embedding", keep: Sequence[str] = ("vec_id",)) -> DataFrame:
    """A row for each vector and component: kept columns, then ``RESULT``. A kept column named as one of those is replaced."""
    kept = [k for k in keep if k not in RESULT.fieldNames()]
    name = "__vector"
    while name in kept:
        name += "_"
    source = vectors.select(*[F.col(f"`{k}`") for k in kept], F.col(f"`{column}`").cast("array<double>").alias(name))
    schema = T.StructType([*source.schema.fields[:-1], *RESULT.fields])
    if model is None:
        return vectors.sparkSession.createDataFrame([], schema)
    shared = vectors.sparkSession.sparkContext.broadcast(model)
    names = schema.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        white = shared.value
        some = len(white.values)
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                part = batch.slice(start, ROWS)
                at, rows = sound_rows(part.column(part.num_columns - 1)).get(white.dim, (None, None))
                if at is None:
                    continue
                centred = white.centred(rows)
                each = lambda x: np.tile(x, len(at))
                deviation = [Decimal(x) if abs(x) < 10**38 else None for x in white.deviation(centred)]
                taken = part.take(pa.array(np.repeat(at, some)))
                made = [
                    pa.array(each(np.arange(1, some + 1, dtype=np.int32))),
                    pa.array(each(np.full(some, white.n, np.int64))),
                    pa.array([x for x in deviation for _ in range(some)], pa.decimal128(38, 0)),
                    pa.array(white.project(centred).ravel()),
                    pa.array(each(white.values / white.trace)),
                    pa.array(each(np.full(some, white.error))),
                ]
                yield pa.RecordBatch.from_arrays([*taken.columns[:-1], *made], names=names)

    return source.mapInArrow(run, schema)


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    found = whitened(vectors, fit(vectors))
    return found.withColumn("deviation", F.expr("try_cast(deviation AS bigint)"))
