"""Whitening of embeddings by principal components.

Rows are read four times and never shuffled: for the most common length, for exact integer sums, for the centred second
moments, and for the moments of the whitened values. What tasks send on are sums of d or d x d
numbers; the eigenpairs of the d x d covariance are found by contour integration (``contour``).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postwatch.llm import common, contour

COMPONENTS = 32
#: An entry c counts as the integer floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 64, 1_000_000
#: Numbers of a vector block that a task works on at once.
BLOCK_VALUES = 1_000_000
FITS = 2**62


@dataclass(frozen=True)
class Whitening:
    """What the fit list teaches. ``sums`` are exact and leave the shift out."""

    count: int
    sums: tuple[int, ...]
    trace: float
    values: np.ndarray
    vectors: np.ndarray

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.count for s in self.sums])

    @property
    def scaled(self) -> np.ndarray:
        """Components over the roots of their eigenvalues, as columns."""
        return self.vectors / np.sqrt(self.values)


def usable(rows: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``(vec_id, v array<double>)`` without null vectors and those with null or non-finite entries.

    Vectors must be of one length to have a covariance: those of another length than most rows have
    (of equally common ones the longest) take no part, nor do empty ones.
    """
    held = rows.select(F.col(key).cast("bigint").alias("vec_id"),
                       F.col(vector).cast("array<double>").alias("v"))
    infinite = float("inf")
    held = held.filter(F.col("v").isNotNull() & (F.size("v") > 0) & F.forall(
        "v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != infinite)))
    common_size = (held.groupBy(F.size("v").alias("d")).count()
                   .orderBy(F.desc("count"), F.desc("d")).first())
    return held.filter(F.size("v") == (common_size["d"] if common_size else 0))


def integers(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Blocks of rows with their vectors as integers, without the shift."""
    for batch in batches:
        start = 0
        while start < batch.num_rows:
            width = max(len(batch.column("v")[start]), 1)
            part = batch.slice(start, max(BLOCK_VALUES // width, 1))
            start += part.num_rows
            scaled = np.floor(SCALE * np.asarray(part.column("v").flatten(), np.float64))
            if not (np.abs(scaled) < FITS).all():
                raise OverflowError("an entry is too large for an integer of 64 bits")
            yield part, scaled.astype(np.int64).reshape(part.num_rows, -1)


def integer_sums(rows: DataFrame) -> tuple[int, tuple[int, ...]]:
    """Rows, and the exact sum of each dimension."""
    schema = pa.schema([("i", pa.int32()), ("s", pa.decimal128(38, 0)), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = None, 0
        for part, values in integers(batches):
            small = int(np.abs(values).max()) * len(values) < FITS
            sums = (values if small else values.astype(object)).sum(0).tolist()
            total = sums if total is None else [a + b for a, b in zip(total, sums, strict=True)]
            count += part.num_rows
        if total is not None:
            yield common.record_batch(schema, [range(len(total)), pa.array(total, pa.decimal128(38, 0)),
                                               [count] * len(total)])

    found = (rows.mapInArrow(run, "i int, s decimal(38,0), n long").groupBy("i")
             .agg(F.sum("s").alias("s"), F.sum("n").alias("n")).orderBy("i").collect())
    return (found[0]["n"], tuple(int(x["s"]) for x in found)) if found else (0, ())


def moments(rows: DataFrame, width: int, centred: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Sum of v and of v vT over all rows, v = centred(integers), as a matrix of width + 1 rows.

    Each task sends one row per matrix row; rows of one place are added where they meet.
    """
    schema = pa.schema([("i", pa.int32()), ("s", pa.list_(pa.float64()))])

    def send(sums: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
        for i, row in sums.items():
            yield common.record_batch(schema, [[i], pa.array([row], pa.list_(pa.float64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for _, values in integers(batches):
            held = centred(values)
            held = np.concatenate((held, np.ones((len(held), 1))), 1)
            total = held.T @ held if total is None else total + held.T @ held
        if total is not None:
            yield from send(dict(enumerate(total)))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, row in zip(batch.column("i").to_pylist(), batch.column("s"), strict=True):
                values = row.values.to_numpy()
                sums[i] = sums[i] + values if i in sums else values.copy()
        yield from send(sums)

    kind = "i int, s array<double>"
    out = np.zeros((width + 1, width + 1))
    for row in rows.mapInArrow(run, kind).repartition("i").mapInArrow(add, kind).collect():
        out[row["i"]] = row["s"]
    return out


def fit(rows: DataFrame, components: int = COMPONENTS) -> Whitening:
    """The mean and the leading components of all rows of :func:`usable`. Runs jobs.

    Directions without variance (under 1e-12 of the whole) are no components, so rows that are all
    equal, or none at all, give no component. An entry too large for 64 bits is an error.
    """
    count, sums = integer_sums(rows)
    if not count:
        return Whitening(0, (), 0.0, np.zeros(0), np.zeros((0, 0)))
    mean = np.array([s / count for s in sums])
    second = moments(rows, len(sums), lambda values: values - mean)[:-1, :-1] / count
    values, vectors = contour.largest(second, components)
    return Whitening(count, sums, float(np.trace(second)), values, vectors)


def transform(rows: DataFrame, model: Whitening) -> DataFrame:
    """``(vec_id, deviation long, whitened array<double>)`` of every row of :func:`usable`.

    ``deviation`` is the sum of (n x - S)^2 over the dimensions, exact; one beyond 64 bits is an
    error. Repeated rows and null ids pass through. Map-only.
    """
    schema = pa.schema([("vec_id", pa.int64()), ("deviation", pa.int64()),
                        ("whitened", pa.list_(pa.float64()))])
    count, sums, mean, scaled = model.count, model.sums, model.mean if model.count else None, model.scaled

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, values in integers(batches):
            most = count * int(np.abs(values).max()) + max(map(abs, sums))
            small = len(sums) * most**2 < FITS
            kind = np.int64 if small else object
            apart = values.astype(kind) * count - np.array(sums, kind)
            apart = (apart * apart).sum(1)
            white = (values - mean) @ scaled
            ends = np.arange(len(values) + 1, dtype=np.int32) * white.shape[1]
            yield common.record_batch(schema, [
                part.column("vec_id"), pa.array(apart.tolist(), pa.int64()),
                pa.ListArray.from_arrays(pa.array(ends), pa.array(white.ravel()))])

    return rows.mapInArrow(run, "vec_id long, deviation long, whitened array<double>")


def identity_error(rows: DataFrame, model: Whitening) -> float:
    """Largest entry of the covariance of all whitened values minus the identity. Runs a job."""
    width = len(model.values)
    if not width:
        return 0.0
    mean, scaled = model.mean, model.scaled
    found = moments(rows, width, lambda values: (values - mean) @ scaled) / model.count
    centre = found[-1, :-1]
    return float(np.abs(found[:-1, :-1] - np.outer(centre, centre) - np.eye(width)).max())


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """One row per remaining row of ``vectors`` and component; see :func:`usable` and :func:`fit`.

    No rows where nothing is left or all rows are equal. Columns besides ``vec_id`` and
    ``embedding`` are not read. Runs the jobs of the fit.
    """
    rows = usable(vectors)
    model = fit(rows, components)
    shares = [float(x) / model.trace for x in model.values]
    error = identity_error(rows, model)
    return transform(rows, model).select(
        "vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened")
    ).select(
        "vec_id", (F.col("at") + 1).cast("int").alias("component"), F.lit(model.count).cast("long").alias("n"),
        "deviation", "whitened",
        F.element_at(F.lit(shares).cast("array<double>"), F.col("at") + 1).alias("explained"),
        F.lit(error).alias("identity_error"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(common.table(spark, sf_dir, "embeddings"))
