"""Embedding whitening: covariance weighted by multiplicity, every distinct vector whitened once."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import slices, stage

#: An entry c becomes floor(SCALE * c) + SHIFT, held within 2^52 so that doubles hold it exactly.
SCALE, SHIFT = 64, 1_000_000
LARGEST = float(1 << 52)
COMPONENTS = 32
#: Vectors that one matrix product takes.
BLOCK = 2048
#: A vector of more than 1/HEAVY of all rows is joined by broadcast: fewer than HEAVY can be so common.
HEAVY = 1024
#: Sums are kept as high and low parts of this many bits, which hold for 2^36 rows.
LOW_BITS = 26


def whole_entries(vector: str | Column) -> Column:
    """The vector's entries as longs; null for a null vector, or null and non-finite entries."""
    vector = F.col(vector) if isinstance(vector, str) else vector
    odd = F.exists(vector, lambda v: v.isNull() | F.isnan(v.cast("double")) | (F.abs(v.cast("double")) == float("inf")))
    held = F.transform(
        vector, lambda v: F.floor(F.greatest(F.lit(-LARGEST), F.least(F.lit(LARGEST), v.cast("double") * SCALE))) + SHIFT
    )
    return F.when(vector.isNotNull() & ~odd, held)


@dataclass
class Fit:
    """What vectors of one length are whitened with; ``plain`` arrays travel, not this class."""

    rows: int
    whole: np.ndarray
    rest: np.ndarray
    projection: np.ndarray | None = None
    explained: np.ndarray | None = None

    def plain(self) -> tuple:
        return self.rows, self.whole, self.rest, self.projection


def _blocks(batches: Iterator[pa.RecordBatch], rows: int = BLOCK) -> Iterator[tuple[int, np.ndarray, np.ndarray, pa.RecordBatch]]:
    """Length, entries and weights of vectors of one length at a time."""
    for batch in slices(batches, rows):
        lengths = batch.column("length").to_numpy()
        for length in np.unique(lengths):
            part = batch.filter(pa.array(lengths == length))
            entries = part.column("x").flatten().to_numpy().reshape(part.num_rows, int(length))
            yield int(length), entries, part.column("weight").to_numpy(), part


def _sums(distinct: DataFrame) -> dict[int, Fit]:
    """Rows and exact per-dimension sums of the fit list, by length of the vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for length, x, weight, _ in _blocks(batches):
            parts = np.stack([weight @ (x >> LOW_BITS), weight @ (x & ((1 << LOW_BITS) - 1)), np.full(length, weight.sum())])
            total[length] = total.get(length, 0) + parts
        for length, (high, low, rows) in total.items():
            yield pa.record_batch(
                {
                    "length": pa.array(np.full(length, length), pa.int32()),
                    "i": pa.array(np.arange(length), pa.int32()),
                    "high": pa.array(high),
                    "low": pa.array(low),
                    "rows": pa.array(rows),
                }
            )

    parts = distinct.select("length", "x", "weight").mapInArrow(run, "length int, i int, high long, low long, rows long")
    found = parts.groupBy("length", "i").agg(*[F.sum(c).alias(c) for c in ("high", "low", "rows")]).orderBy("length", "i")
    fits: dict[int, tuple[int, list[int]]] = {}
    for row in found.toLocalIterator():
        fits.setdefault(row["length"], (row["rows"], []))[1].append((row["high"] << LOW_BITS) + row["low"])
    return {
        length: Fit(n, np.array([s // n for s in sums], np.int64), np.array([s % n / n for s in sums]))
        for length, (n, sums) in fits.items()
    }


def _products(frame: DataFrame, centred, lengths: list[int], width: dict[int, int]) -> dict[int, np.ndarray]:
    """Sum of weight * y y' over the rows, by length; ``centred`` turns a block's entries into y."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for length, x, weight, part in _blocks(batches):
            y = centred(length, x, part)
            total[length] = total.get(length, 0) + (y * weight[:, None]).T @ y
        for length, product in total.items():
            i, j = np.triu_indices(len(product))
            yield pa.record_batch(
                {
                    "length": pa.array(np.full(len(i), length), pa.int32()),
                    "i": pa.array(i, pa.int32()),
                    "j": pa.array(j, pa.int32()),
                    "v": pa.array(product[i, j]),
                }
            )

    parts = frame.mapInArrow(run, "length int, i int, j int, v double")
    found = parts.groupBy("length", "i", "j").agg(F.sum("v").alias("v")).toArrow()
    out = {length: np.zeros((width[length], width[length])) for length in lengths}
    columns = [found.column(c).to_numpy() for c in ("length", "i", "j", "v")]
    for length in lengths:
        _, i, j, v = (c[columns[0] == length] for c in columns)
        out[length][i, j] = out[length][j, i] = v
    return out


def axes(covariance: np.ndarray, components: int) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (columns, largest entry positive) of directions with variance."""
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = values[::-1], vectors[:, ::-1]
    real = values > max(values[0], 0) * len(values) * np.finfo(float).eps
    values, vectors = values[real][:components], vectors[:, real][:, :components]
    signs = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])]) if vectors.size else 1
    return values, vectors * signs


def _deviations(rows: int, x: np.ndarray, whole: np.ndarray, rest: np.ndarray) -> pa.Array:
    """Sum over dimensions of (rows * x - sums)^2, exact; null beyond 38 digits."""
    left = np.rint(rest * rows).astype(np.int64)
    apart = x - whole
    widest = (int(np.abs(apart).max(initial=0)) + 1) * rows
    if widest * widest * x.shape[1] < 1 << 63:
        return pa.array(((apart * rows - left) ** 2).sum(axis=1)).cast(pa.decimal128(38, 0))
    exact = ((apart.astype(object) * rows - left.astype(object)) ** 2).sum(axis=1)
    return pa.array([Decimal(v) if v < 10**38 else None for v in exact], pa.decimal128(38, 0))


def whiten(docs: DataFrame, vector: str = "embedding", key: str = "vec_id", components: int = COMPONENTS, multiplicity: bool = True) -> DataFrame:
    """``key``, component, n, deviation (decimal), whitened, explained and identity_error of every usable row.

    Rows whose vector is null, empty or holds null or non-finite entries are left out. Equal
    vectors of longs are grouped: they weigh in the fit as often as they occur, or once without
    ``multiplicity``, are whitened once, and the result is joined back to their rows. Covariances
    are sums of matrix products of centred blocks, one matrix a task; only matrices
    of the vectors' length squared reach the driver.

    Vectors of different lengths are fitted apart, each among its own; identity_error is the
    largest of all. Directions without variance (equal rows, fewer rows than components) cannot
    be scaled to one and give no component, so a table of equal vectors, or one vector, gives no
    row. Null and repeated keys are rows like others; extra columns play no part. Entries beyond
    2^46 count as 2^46. A deviation beyond 38 digits is null.
    """
    rows = docs.select(F.col(key).alias("key"), whole_entries(vector).alias("x")).where("x is not null and size(x) > 0")
    weight = F.count("*") if multiplicity else F.lit(1).cast("long")
    grouped = rows.groupBy("x").agg(weight.alias("weight"), F.count("*").alias("copies"))
    distinct = stage(grouped.select(F.size("x").alias("length"), "x", "weight", "copies"), "vectors")
    fits = _sums(distinct)
    lengths = sorted(fits)
    context = docs.sparkSession.sparkContext
    centre = context.broadcast({length: fit.plain() for length, fit in fits.items()})

    def centred(length: int, x: np.ndarray, _) -> np.ndarray:
        _, whole, rest, _ = centre.value[length]
        return (x - whole) - rest

    found = _products(distinct.select("length", "x", "weight"), centred, lengths, {n: n for n in lengths})
    for length, fit in fits.items():
        covariance = found[length] / fit.rows
        values, vectors = axes(covariance, components)
        fit.projection = vectors / np.sqrt(values)
        fit.explained = values / max(np.trace(covariance), np.finfo(float).tiny)
    shared = context.broadcast({length: fit.plain() for length, fit in fits.items()})

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for length, x, weight, part in _blocks(batches):
            n, whole, rest, projection = shared.value[length]
            y = ((x - whole) - rest) @ projection
            yield pa.record_batch(
                {
                    "length": part.column("length"),
                    "x": part.column("x"),
                    "weight": part.column("weight"),
                    "copies": part.column("copies"),
                    "n": pa.array(np.full(len(y), n)),
                    "deviation": _deviations(n, x, whole, rest),
                    "whitened": pa.ListArray.from_arrays(pa.array(np.arange(len(y) + 1) * y.shape[1], pa.int32()), pa.array(y.ravel())),
                }
            )

    schema = "length int, x array<long>, weight long, copies long, n long, deviation decimal(38,0), whitened array<double>"
    white = stage(distinct.mapInArrow(project, schema), "whitened")

    def again(_, x: np.ndarray, part: pa.RecordBatch) -> np.ndarray:
        y = part.column("whitened").flatten().to_numpy().reshape(len(x), -1)
        # A last entry of one carries the sums along.
        return np.concatenate([y, np.ones((len(x), 1))], axis=1)

    width = {length: len(fit.explained) + 1 for length, fit in fits.items()}
    moments = _products(white.select("length", "x", "weight", "whitened"), again, lengths, width)
    error = 0.0
    for length, fit in fits.items():
        m = moments[length] / fit.rows
        gap = m[:-1, :-1] - np.outer(m[-1, :-1], m[-1, :-1]) - np.eye(len(m) - 1)
        error = max(error, np.abs(gap).max(initial=0.0))

    shares = [(length, [float(v) for v in fit.explained]) for length, fit in fits.items()]
    shares = docs.sparkSession.createDataFrame(shares, "length int, shares array<double>")
    every = distinct.agg(F.sum("copies")).first()[0] or 0
    white = white.drop("weight").withColumn("heavy", F.col("copies") * HEAVY > every)
    common = F.broadcast(white.where("heavy"))
    near = rows.join(common, "x")
    far = rows.join(F.broadcast(white.where("heavy").select("x")), "x", "left_anti").join(white.where("not heavy"), "x")
    columns = ["key", "length", "n", "deviation", "whitened"]
    joined = near.select(*columns).unionByName(far.select(*columns)).join(F.broadcast(shares), "length")
    return joined.select("key", "n", "deviation", "shares", F.posexplode("whitened").alias("at", "whitened")).select(
        F.col("key").alias(key),
        (F.col("at") + 1).alias("component"),
        "n",
        "deviation",
        "whitened",
        F.col("shares")[F.col("at")].alias("explained"),
        F.lit(float(error)).alias("identity_error"),
    )

