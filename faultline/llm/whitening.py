"""Whitening of embeddings from a weighted covariance over distinct vectors.

Method.  Each vector becomes whole numbers x = floor(scale * c) + offset.  Identical x are grouped, in the map tasks first, and
their number (or one, ``weight="one"``) is the vector's weight in the fit.  The sums over the fit list are exact whole
numbers.  Vectors are centred, then multiplied: each task adds up its weighted products in one d x d matrix, and the
matrices are added row by row in a shuffle.  The driver takes the eigenvectors of the d x d sum, each distinct vector is
projected once, into a written table, and the rows are joined back to it by x.  The covariance of the projections,
computed in the same way from that table, gives the error against the identity.

Bounds.  The driver and each task hold matrices of d x d numbers, d being the length of a vector.  A vector that makes up more than
a ``HOT``-th of all rows is joined back by broadcast: there are fewer than ``HOT`` of these whatever the table's size, and
none of the others fills a task of the shuffled join.

Defined results.  Rows whose vector is null, empty, holds a null, NaN or infinite entry, or has another length than most
rows (ties: the longer length) take no part.  Entries beyond 2^52 / scale count as that bound.  Repeated rows and ids count and come out as
often as they occur.  A component without variance (eigenvalue not above d times the rounding error of the
largest) has null ``whitened`` and is left out of ``identity_error``, which is null if there is no other.  ``deviation`` is null where
it has more than 38 digits.  An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import decimal
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import settled

HOT = 1000
LARGEST = float(1 << 52)
LONG_SAFE = 1 << 62


@dataclass(frozen=True)
class Whitening:
    """Sums over the fit list of ``n`` vectors, and unit eigenvectors (as columns) by falling eigenvalue."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    @property
    def centre(self) -> tuple[np.ndarray, np.ndarray]:
        """The mean as a whole and the rest, so that x minus the whole part is exact; the rest's numerator is below n."""
        whole = [s // self.n for s in self.sums]
        rest = [s - w * self.n for s, w in zip(self.sums, whole, strict=True)]
        return np.array(whole, np.int64), np.array(rest, np.int64)


def usable(vector: Column) -> Column:
    fine = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & fine


def whole_numbers(vector: Column, scale: int, offset: int) -> Column:
    def whole(c: Column) -> Column:
        scaled = F.least(F.greatest(c.cast("double") * F.lit(float(scale)), F.lit(-LARGEST)), F.lit(LARGEST))
        return F.floor(scaled).cast("long") + F.lit(offset).cast("long")

    return F.transform(vector, whole)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _exact_sums(width: int):
    """Rows (place, total): the weighted sums of a task's whole numbers, in whole numbers of any size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [0] * width
        for batch in batches:
            if not batch.num_rows:
                continue
            x, w = _matrix(batch.column(0), width), batch.column(1).to_numpy()
            small = int(np.abs(x).max()) * int(w.sum()) < LONG_SAFE
            part = w @ x if small else w.astype(object) @ x.astype(object)
            total = [t + int(p) for t, p in zip(total, part, strict=True)]
        if any(total):
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(width), pa.int32()), pa.array(map(decimal.Decimal, total), pa.decimal128(38, 0))],
                names=["place", "total"])

    return run


def _products(width: int, whole: np.ndarray, rest: np.ndarray):
    """Rows (place, line): the d lines of a task's weighted matrix of centred products."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if not batch.num_rows:
                continue
            x, w = _matrix(batch.column(0), width), batch.column(1).to_numpy().astype(np.float64)
            centred = (x - whole).astype(np.float64) - rest
            part = (centred * w[:, None]).T @ centred
            total = part if total is None else total + part
        if total is not None:
            lines = pa.ListArray.from_arrays(np.arange(0, width * width + 1, width, dtype=np.int32), total.ravel())
            yield pa.RecordBatch.from_arrays([pa.array(range(width), pa.int32()), lines], names=["place", "line"])

    return run


def _add_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One line for each place among the rows of a task."""
    lines: dict[int, np.ndarray] = {}
    for batch in batches:
        for place, line in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            values = line.values.to_numpy()
            lines[place] = lines[place] + values if place in lines else values.copy()
    if lines:
        yield pa.RecordBatch.from_arrays(
            [pa.array(lines, pa.int32()), pa.array(list(lines.values()), pa.list_(pa.float64()))], names=["place", "line"])


def weighted_covariance(vectors: DataFrame, column: str, weight: str, width: int, n: int, whole: np.ndarray,
                        rest: np.ndarray) -> np.ndarray:
    """The covariance about the mean ``whole + rest``, divisor ``n``: centred first, then multiplied."""
    rows = vectors.select(column, weight).mapInArrow(_products(width, whole, rest), "place int, line array<double>")
    added = rows.repartition("place").mapInArrow(_add_lines, "place int, line array<double>").collect()
    out = np.zeros((width, width))
    for row in added:
        out[row.place] = row.line
    return out / n


def distinct_vectors(rows: DataFrame, weight: str = "count") -> DataFrame:
    """x, copies, weight: the distinct vectors of ``rows`` (_x), as a written table."""
    if weight not in ("count", "one"):
        raise ValueError(f"weight is count or one, not {weight}")
    grouped = rows.groupBy("_x").agg(F.count("*").alias("copies"))
    fit = F.col("copies") if weight == "count" else F.lit(1).cast("long")
    return settled(grouped.select(F.col("_x").alias("x"), "copies", fit.alias("weight")), "whitening-vectors")


def fit(vectors: DataFrame, width: int) -> Whitening:
    """Exact sums, covariance and its eigenvectors, of the distinct ``vectors`` (x, weight) of length ``width``."""
    n = vectors.agg(F.sum("weight")).first()[0]
    found = vectors.select("x", "weight").mapInArrow(_exact_sums(width), "place int, total decimal(38, 0)")
    sums = [0] * width
    for row in found.groupBy("place").agg(F.sum("total").alias("total")).collect():
        sums[row.place] = int(row.total)
    whole, rest = Whitening(n, sums, np.zeros(0), np.zeros((0, 0)), 0.0).centre
    covariance = weighted_covariance(vectors, "x", "weight", width, n, whole, rest / n)
    covariance = (covariance + covariance.T) / 2
    values, axes = np.linalg.eigh(covariance)
    return Whitening(n, sums, values[::-1].copy(), axes[:, ::-1].copy(), float(np.trace(covariance)))


def _deviations(x: np.ndarray, n: int, whole: np.ndarray, rest: np.ndarray) -> pa.Array:
    """Sum over the dimensions of (n * x - S)^2, exactly; n * x - S is n * (x - whole) - rest."""
    apart = x - whole
    most = n * (int(np.abs(apart).max()) + 1)
    if most * most * x.shape[1] < LONG_SAFE:
        scaled = n * apart - rest
        return pa.array((scaled * scaled).sum(axis=1)).cast(pa.decimal128(38, 0))
    scaled = n * apart.astype(object) - rest
    totals = [int(t) for t in (scaled * scaled).sum(axis=1)]
    return pa.array([decimal.Decimal(t) if t < 10 ** 38 else None for t in totals], pa.decimal128(38, 0))


def _projected(model: Whitening, width: int, used: int):
    whole, rest = model.centre
    axes = model.vectors[:, :used] / np.sqrt(model.values[:used])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column(0), width)
            z = ((x - whole).astype(np.float64) - rest / model.n) @ axes
            lists = pa.ListArray.from_arrays(np.arange(0, z.size + 1, max(used, 1), dtype=np.int32)[:len(x) + 1], z.ravel()) \
                if used else pa.array([[]] * len(x), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, _deviations(x, model.n, whole, rest), lists], names=["x", "copies", "weight", "deviation", "z"])

    return run


def _identity_error(projected: DataFrame, used: int, n: int) -> float | None:
    if not used:
        return None
    sums = projected.select(F.posexplode("z").alias("place", "v"), "weight").groupBy("place").agg(
        F.sum(F.col("v") * F.col("weight")).alias("total")).collect()
    means = np.zeros(used)
    for row in sums:
        means[row.place] = row.total / n
    covariance = weighted_covariance(projected, "z", "weight", used, n, means, np.zeros(used))
    return float(np.abs(covariance - np.eye(used)).max())


def whiten(rows: DataFrame, id_column: str = "vec_id", vector: str = "embedding", components: int = 32, weight: str = "count",
           scale: int = 64, offset: int = 1_000_000, hot: int = HOT) -> DataFrame:
    """One row per usable row and component: the id, component (from 1), n, deviation, whitened, explained, identity_error."""
    schema = rows.select(F.col(id_column)).schema
    taken = rows.select(F.col(id_column).alias("_id"), F.col(vector).alias("_v")).where(usable(F.col("_v"))).select(
        "_id", whole_numbers(F.col("_v"), scale, offset).alias("_x"))
    distinct = distinct_vectors(taken, weight)
    lengths = distinct.groupBy(F.size("x").alias("width")).agg(F.sum("copies").alias("rows"), F.sum("weight").alias("n"))
    common = lengths.orderBy(F.desc("rows"), F.desc("width")).first()
    if common is None:
        columns = "component int, n long, deviation decimal(38, 0), whitened double, explained double, identity_error double"
        return rows.sparkSession.createDataFrame([], f"{schema[0].name} {schema[0].dataType.simpleString()}, {columns}")
    width, n_rows = common.width, common.rows
    distinct = distinct.where(F.size("x") == width)
    model = fit(distinct, width)
    wanted = min(components, width)
    least = width * np.finfo(np.float64).eps * max(model.values[0], 0.0)
    used = int((model.values[:wanted] > least).sum())
    projected = settled(
        distinct.mapInArrow(
            _projected(model, width, used),
            "x array<long>, copies long, weight long, deviation decimal(38, 0), z array<double>"), "whitening-projected")
    error = _identity_error(projected, used, model.n)

    answer = projected.select(F.col("x").alias("_x"), "copies", "deviation", "z")
    many = F.col("copies") > n_rows / hot
    frequent = F.broadcast(answer.where(many).drop("copies"))
    joined = taken.join(frequent, "_x").select("_id", "deviation", "z").unionByName(
        taken.join(F.broadcast(answer.where(many).select("_x")), "_x", "left_anti").join(
            answer.where(~many).drop("copies"), "_x").select("_id", "deviation", "z"))
    explained = F.array(*(F.lit(float(v / model.trace) if model.trace else 0.0) for v in model.values[:wanted]))
    each = joined.select("_id", "deviation", "z", F.explode(F.sequence(F.lit(1), F.lit(wanted))).alias("component"))
    return each.select(
        F.col("_id").alias(schema[0].name), F.col("component").cast("int").alias("component"),
        F.lit(model.n).cast("long").alias("n"), "deviation", F.get("z", F.col("component") - 1).alias("whitened"),
        F.get(explained, F.col("component") - 1).alias("explained"), F.lit(error).cast("double").alias("identity_error"))
