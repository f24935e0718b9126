"""Whitening of embeddings by their principal components.

Entries become integers first, so sums are exact. The covariance is a sum of
centred outer products: entries centred on the exact mean are fixed-point
numbers of 60 bits, cut into three slices of 20, and the products of slices over
a block of rows are whole numbers that a double holds, so each matrix product is
an error-free transformation. These are added up in double-double, and tasks
hand on high and low parts, which are merged in two steps by matrix row. What
reaches the driver is one matrix, whatever the number of vectors.

The eigenvectors come from tridiagonal divide and conquer (LAPACK's syevd, which
numpy calls for symmetric matrices) on the high part, and one step of refinement
in extended precision against both parts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from namesmith.plans.storage import cut, remove

#: Entries become floor(SCALE * c) + SHIFT; rows with an entry outside of +-LIMIT are left out like those that aren't finite.
SCALE, SHIFT, LIMIT = 1024.0, 100_000, 2.0**30
#: Bits of a slice, slices' products stay whole over BLOCK rows, and the groups that tasks' parts are merged in first.
BITS, BLOCK, GROUPS = 20, 4096, 32
MOMENTS = "dim int, i int, n long, total decimal(38,0), least long, most long"
PARTS = "i int, part int, high array<double>, low array<double>"
SPREADS = "part int, n double, mean array<double>, spread array<double>"
OUT = "component int, n long, deviation long, whitened double, explained double, identity_error double"


@dataclass(frozen=True)
class Fit:
    """n vectors of dim entries with integer sums; eigenvalues (falling), their unit vectors as columns, and the trace."""

    dim: int
    n: int
    sums: tuple[int, ...]
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    @property
    def floors(self) -> np.ndarray:
        return np.array([s // self.n for s in self.sums], np.int64)

    @property
    def rests(self) -> np.ndarray:
        return np.array([s % self.n / self.n for s in self.sums])


def lists(column) -> tuple[np.ndarray, np.ndarray]:
    """All entries (null: NaN) and the number of entries of each row (null: none)."""
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    return column.flatten().to_numpy(zero_copy_only=False).astype(float), sizes


def integers(column, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows whose vector has dim entries, all of them usable, and their entries as integers."""
    flat, sizes = lists(column)
    rows = np.flatnonzero(sizes == dim)
    starts = (np.cumsum(sizes) - sizes)[rows]
    found = flat[starts[:, None] + np.arange(dim)]
    with np.errstate(invalid="ignore"):
        good = (np.abs(found) < LIMIT).all(axis=1)
    return rows[good], np.floor(found[good] * SCALE).astype(np.int64) + SHIFT


def moments(rows: DataFrame) -> tuple[int, int, list[tuple[int, int, int]]]:
    """(dim, n, exact sum, least and greatest integer of each dimension), of the vectors of the most frequent size."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = lists(batch.column("vector"))[1]
            for dim in np.unique(sizes[sizes > 0]).tolist():
                _, x = integers(batch.column("vector"), dim)
                if len(x):
                    columns = [np.full(dim, dim, np.int32), np.arange(dim, dtype=np.int32), np.full(dim, len(x), np.int64), x.sum(axis=0), x.min(axis=0), x.max(axis=0)]
                    arrays = [pa.array(c) for c in columns]
                    arrays[3] = arrays[3].cast(pa.decimal128(38, 0))
                    yield pa.RecordBatch.from_arrays(arrays, names=["dim", "i", "n", "total", "least", "most"])

    found = rows.select("vector").mapInArrow(emit, MOMENTS).groupBy("dim", "i").agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.min("least").alias("least"), F.max("most").alias("most"))
    found = cut(found, "moments")
    first = found.where("i = 0").orderBy(F.desc("n"), F.desc("dim")).first()
    each = found.where(F.col("dim") == first["dim"]).orderBy("i").collect() if first else []
    remove(found)
    return (first["dim"], first["n"], [(int(r["total"]), r["least"], r["most"]) for r in each]) if first else (0, 0, [])


def two_sum(high: np.ndarray, low: np.ndarray, x: np.ndarray, y: np.ndarray | float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """(high, low) + (x, y) in double-double."""
    s = high + x
    z = s - high
    rest = (high - (s - z)) + (x - z) + (low + y)
    top = s + rest
    return top, rest - (top - s)


def sliced(x: np.ndarray) -> list[np.ndarray]:
    """Integers as slices of 20 bits, low ones first, as doubles."""
    out = []
    for _ in range(2):
        low = ((x + (1 << BITS - 1)) & ((1 << BITS) - 1)) - (1 << BITS - 1)
        out.append(low.astype(float))
        x = (x - low) >> BITS
    return [*out, x.astype(float)]


def merged(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The sum of the high and low parts of a table's rows, in order of part."""
    table = table.sort_by("part")
    high, low = (np.stack([np.array(v) for v in table.column(c).to_pylist()]) for c in ("high", "low"))
    a, b = high[0], low[0]
    for x, y in zip(high[1:], low[1:], strict=True):
        a, b = two_sum(a, b, x, y)
    return a, b


def covariance(rows: DataFrame, dim: int, n: int, each: list[tuple[int, int, int]]) -> np.ndarray:
    """The covariance of the integer vectors (divisor n), in extended precision."""
    floors, rests = [s // n for s, _, _ in each], [s % n for s, _, _ in each]
    reach = max(max(hi - q, q - lo) + 1 for q, (_, lo, hi) in zip(floors, each, strict=True))
    point = 3 * BITS - 2 - reach.bit_length()  # binary places of the fixed-point numbers
    centre, rest = np.array(floors, np.int64), np.array([((r << max(point, 0)) + n // 2) // n if point >= 0 else 0 for r in rests], np.int64)
    point = max(point, 0)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        high = low = np.zeros((dim, dim))
        for batch in batches:
            _, x = integers(batch.column("vector"), dim)
            for at in range(0, len(x), BLOCK):
                parts = sliced(((x[at : at + BLOCK] - centre) << point) - rest)
                for i, a in enumerate(parts):
                    for j, b in enumerate(parts):
                        high, low = two_sum(high, low, np.ldexp(a.T @ b, BITS * (i + j)))
        part = TaskContext.get().partitionId()
        if high.any():
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim, dtype=np.int32)), pa.array(np.full(dim, part, np.int32)), pa.array(list(high)), pa.array(list(low))], names=["i", "part", "high", "low"])

    def merge(table: pa.Table) -> pa.Table:
        high, low = merged(table)
        first = table.slice(0, 1)
        return pa.table({"i": first["i"], "part": pa.array([pc.min(table["part"]).as_py()], pa.int32()), "high": pa.array([high]), "low": pa.array([low])})

    found = rows.select("vector").mapInArrow(emit, PARTS)
    found = found.groupBy("i", F.pmod("part", F.lit(GROUPS))).applyInArrow(merge, PARTS).groupBy("i").applyInArrow(merge, PARTS)
    out = np.zeros((dim, dim), np.longdouble)
    for r in found.collect():
        out[r["i"]] = np.array(r["high"], np.longdouble) + np.array(r["low"], np.longdouble)
    return (out + out.T) / 2 / (np.longdouble(n) * np.ldexp(np.longdouble(1), 2 * point))


def refined(matrix: np.ndarray, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One step of iterative refinement (Ogita and Aishima) of all eigenvectors, in the matrix's precision."""
    x = vectors.astype(matrix.dtype)
    r = np.eye(len(x), dtype=x.dtype) - x.T @ x
    s = x.T @ matrix @ x
    values = np.diag(s) / (1 - np.diag(r))
    gaps = values[None, :] - values[:, None]
    close = np.abs(gaps) <= 1e-12 * np.abs(values).max(initial=0)
    x = x + x @ np.where(close, r / 2, (s + values[None, :] * r) / np.where(close, 1, gaps))
    return values, x / np.sqrt((x * x).sum(axis=0))


def fit(rows: DataFrame, components: int = 8) -> Fit | None:
    """The components of a column ``vector``; none if no row is usable. Components without variance are left out."""
    dim, n, each = moments(rows)
    if not n:
        return None
    matrix = covariance(rows, dim, n, each)
    _, vectors = np.linalg.eigh(matrix.astype(float))
    values, vectors = refined(matrix, vectors)
    order = np.argsort(-values, kind="stable")[:components]
    trace = np.trace(matrix)
    order = order[values[order] > trace * 1e-14]
    vectors = vectors[:, order]
    vectors = vectors * np.where(vectors[np.abs(vectors).argmax(axis=0), np.arange(len(order))] < 0, -1, 1)
    return Fit(dim, n, tuple(s for s, _, _ in each), values[order].astype(float), vectors.astype(float), float(trace))


def projected(x: np.ndarray, model: Fit) -> np.ndarray:
    return ((x - model.floors) - model.rests) @ (model.vectors / np.sqrt(model.values))


def combined(parts: list[tuple[float, np.ndarray, np.ndarray]]) -> tuple[float, np.ndarray, np.ndarray]:
    """Counts, means and centred squares of several parts as those of all."""
    n, mean, spread = parts[0]
    for m, other, squares in parts[1:]:
        gap, both = other - mean, n + m
        mean, spread, n = mean + gap * (m / both), spread + squares + np.outer(gap, gap) * (n * m / both), both
    return n, mean, spread


def identity_error(rows: DataFrame, model: Fit) -> float:
    """How far the whitened vectors' covariance, measured over all of them, is from the identity."""
    k = len(model.values)

    def row(part: int, n: float, mean: np.ndarray, spread: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([float(n)]), pa.array([mean]), pa.array([spread.ravel()])], names=["part", "n", "mean", "spread"])

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = []
        for batch in batches:
            _, x = integers(batch.column("vector"), model.dim)
            for at in range(0, len(x), BLOCK):
                z = projected(x[at : at + BLOCK], model)
                mean = z.mean(axis=0)
                parts = [combined([*parts, (len(z), mean, (z - mean).T @ (z - mean))])]
        if parts:
            yield row(TaskContext.get().partitionId(), *parts[0])

    def merge(table: pa.Table) -> pa.Table:
        own = table.sort_by("part").to_pylist()
        return pa.Table.from_batches([row(own[0]["part"], *combined([(r["n"], np.array(r["mean"]), np.array(r["spread"]).reshape(k, k)) for r in own]))])

    groups = rows.select("vector").mapInArrow(emit, SPREADS).groupBy(F.pmod("part", F.lit(GROUPS))).applyInArrow(merge, SPREADS).orderBy("part").collect()
    n, _, spread = combined([(r["n"], np.array(r["mean"]), np.array(r["spread"]).reshape(k, k)) for r in groups])
    return float(np.abs(spread / n - np.eye(k)).max())


def deviations(x: np.ndarray, model: Fit) -> pa.Array:
    """Sums of (n x - S)^2, exact; null where 64 bits don't hold them."""
    sums = np.array(model.sums, object)
    reach = max((abs(model.n * int(v) - s) for lo, hi in [(x.min(axis=0), x.max(axis=0))] for v, s in [*zip(lo, model.sums, strict=True), *zip(hi, model.sums, strict=True)]), default=0)
    if model.dim * reach * reach < 1 << 63:
        d = model.n * (x - model.floors) - np.array([s % model.n for s in model.sums], np.int64)
        return pa.array((d * d).sum(axis=1))
    exact = ((model.n * x.astype(object) - sums) ** 2).sum(axis=1)
    return pa.array([int(v) if v < 1 << 63 else None for v in exact], pa.int64())


def whitened(embeddings: DataFrame, components: int = 8) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a row per usable vector and component.

    Rows whose vector is null or empty, holds null or non-finite entries or
    entries beyond 2^30, or isn't of the most frequent size (the larger of equally
    frequent ones) are dropped; repeated rows and ids count each. Fewer than
    ``components`` dimensions with variance give fewer components; no variance or
    no usable row: no rows. deviation is null where it passes 64 bits. The sign of
    a component is such that its largest entry is positive. Other columns are
    ignored, whatever their names.
    """
    rows = embeddings.select("vec_id", F.col("embedding").cast("array<double>").alias("vector"))
    schema = f"vec_id {rows.schema['vec_id'].dataType.simpleString()}, {OUT}"
    model = fit(rows, components)
    if model is None or not len(model.values):
        return rows.sparkSession.createDataFrame([], schema)
    error, k = identity_error(rows, model), len(model.values)
    names = ["vec_id", *(c.split()[0] for c in OUT.split(", "))]

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, x = integers(batch.column("vector"), model.dim)
            for at in range(0, len(x), BLOCK):
                some = x[at : at + BLOCK]
                m, rep = len(some), pa.array(np.repeat(np.arange(len(some)), k))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("vec_id").take(pa.array(own[at : at + BLOCK])).take(rep), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, model.n, np.int64)),
                     deviations(some, model).take(rep), pa.array(projected(some, model).ravel()), pa.array(np.tile(model.values / model.trace, m)), pa.array(np.full(m * k, error))],
                    names=names,
                )

    return rows.mapInArrow(emit, schema)
