"""Whitening of embeddings by an exact covariance, found by polarisation.

Entries are rounded down to whole levels, so that every sum is of whole numbers and exact,
however Spark deals the rows. A first pass sums the levels of each dimension. A second one,
centred on the nearest whole mean, sums the squares of every dimension and of every sum of
two dimensions; the rest of the mean is put in exactly on the driver:

    A(u) = sum of (n u - sum of u)^2,   covariance of x and y = (A(x + y) - A(x) - A(y)) / 2 n^3

so no product of two dimensions is ever taken, and every variance is rounded once, at the
end. What leaves a task is one number per pair of dimensions, and the driver gets that table
alone: it grows with the square of the dimension and not with the rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdictflow.llm.common import stored

SCALE = 1024
SHIFT = 100_000
COMPONENTS = 8
#: Rows in one numpy step, so that a step takes a few MB whatever the size of Arrow batches.
_PART = 4096
_WHOLE = pa.decimal128(38, 0)


@dataclass(frozen=True)
class Whitening:
    """What was fitted: whole sums of ``n`` vectors and the components kept, largest eigenvalue first."""

    n: int
    sums: tuple[int, ...]
    values: tuple[float, ...]
    vectors: np.ndarray  # a column per component
    trace: float
    scale: int = SCALE
    shift: int = SHIFT

    @property
    def explained(self) -> list[float]:
        return [value / self.trace for value in self.values]


def usable(vector: Column) -> Column:
    """Whether a vector is there, has entries, and none of them is null, NaN or infinite."""
    finite = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(math.inf)))
    return vector.isNotNull() & (F.size(vector) > 0) & finite


def levels(column: pa.ListArray, scale: int = SCALE, shift: int = SHIFT) -> np.ndarray:
    """Whole levels of a batch of vectors of one length: ``floor(scale * c) + shift``, a row per vector."""
    offsets = column.offsets.to_numpy()
    sizes = np.diff(offsets)
    if (sizes != sizes[0]).any():
        raise ValueError(f"vectors of {sizes.min()} and of {sizes.max()} entries cannot be whitened together")
    entries = column.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]].astype(np.float64)
    floors = np.floor(entries * scale)
    small = np.abs(floors).max(initial=0) < 2**53
    whole = floors.astype(np.int64) if small else np.array([int(x) for x in floors.tolist()], dtype=object)
    return (whole + shift).reshape(len(sizes), -1)


def centred(x: np.ndarray, middle: list[int]) -> np.ndarray:
    """Levels less whole numbers near their means; Python's integers where 64 bits might not hold the sums of squares."""
    wide = np.array(middle, dtype=object) if x.dtype == object else np.array(middle, dtype=np.int64)
    y = x - wide
    most = int(np.abs(y).max(initial=0))
    return y.astype(object) if 4 * most * most * max(len(y), 1) >= 2**63 else y


def pair_squares(y: np.ndarray) -> list[tuple[int, int, int]]:
    """(i, j, sum of squares of y_i + y_j) for all i < j, and (i, i, sum of squares of y_i)."""
    found = [(i, i, int(s)) for i, s in enumerate((y * y).sum(axis=0))]
    for i in range(y.shape[1] - 1):
        both = y[:, i : i + 1] + y[:, i + 1 :]
        found += [(i, i + 1 + k, int(s)) for k, s in enumerate((both * both).sum(axis=0))]
    return found


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for begin in range(0, batch.num_rows, _PART):
            yield batch.slice(begin, _PART)


def _summed(rows: DataFrame, sums, keys: list[str]) -> list:
    """``sums`` of each task's batches, (numbers.., whole total), added up by Spark."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[tuple[int, ...], int] = {}
        for part in _parts(batches):
            for *key, total in sums(part.column(0)):
                totals[tuple(key)] = totals.get(tuple(key), 0) + total
        if totals:
            numbers = [pa.array([key[i] for key in totals], pa.int64()) for i in range(len(keys))]
            whole = pa.array([Decimal(total) for total in totals.values()], _WHOLE)
            yield pa.RecordBatch.from_arrays([*numbers, whole], [*keys, "total"])

    partial = rows.mapInArrow(each, ", ".join([*[f"{k} long" for k in keys], "total decimal(38, 0)"]))
    return partial.groupBy(*keys).agg(F.sum("total").alias("total")).collect()


def fit(rows: DataFrame, components: int = COMPONENTS, scale: int = SCALE, shift: int = SHIFT) -> Whitening | None:
    """Fit on all rows of one column of usable vectors; None if there are none.

    Components whose eigenvalue is under 1e-12 of the trace have no variance to whiten and
    are left out; of equal eigenvalues the order and the vectors are the eigensolver's.
    """

    def level_sums(column: pa.ListArray) -> Iterator[tuple[int, int, int]]:
        x = levels(column, scale, shift)
        yield x.shape[1], -1, len(x)
        for i in range(x.shape[1]):
            yield x.shape[1], i, int(x[:, i].sum())

    found = {(r.size, r.i): int(r.total) for r in _summed(rows, level_sums, ["size", "i"])}
    sizes = {size for size, _ in found}
    if not sizes:
        return None
    if len(sizes) > 1:
        raise ValueError(f"vectors of {min(sizes)} and of {max(sizes)} entries cannot be whitened together")
    d = sizes.pop()
    n, sums = found[d, -1], [found[d, i] for i in range(d)]
    middle = [(2 * s + n) // (2 * n) for s in sums]
    rest = [s - n * m for s, m in zip(sums, middle, strict=True)]

    def squares(column: pa.ListArray) -> list[tuple[int, int, int]]:
        return pair_squares(centred(levels(column, scale, shift), middle))

    raw = {(r.i, r.j): int(r.total) for r in _summed(rows, squares, ["i", "j"])}
    spread = lambda i, j: n * n * raw[i, j] - n * (rest[i] if i == j else rest[i] + rest[j]) ** 2
    alone = [spread(i, i) for i in range(d)]
    covariance = np.zeros((d, d))
    for i in range(d):
        covariance[i, i] = alone[i] / n**3
        for j in range(i + 1, d):
            covariance[i, j] = covariance[j, i] = (spread(i, j) - alone[i] - alone[j]) / (2 * n**3)
    values, vectors = np.linalg.eigh(covariance)
    trace = sum(alone) / n**3
    kept = [k for k in np.argsort(-values, kind="stable")[:components] if trace > 0 and values[k] > 1e-12 * trace]
    # One sign for all runs: the largest entry of a component is positive.
    chosen = np.array([vectors[:, k] * (1 if vectors[np.argmax(np.abs(vectors[:, k])), k] > 0 else -1) for k in kept]).T
    return Whitening(n, tuple(sums), tuple(float(values[k]) for k in kept), chosen.reshape(d, len(kept)), trace, scale, shift)


def project(rows: DataFrame, model: Whitening) -> DataFrame:
    """Rows of (id, vector) -> id, ``deviation`` (decimal, exact) and ``z``, the whitened components.

    The deviation is the sum over dimensions of ``(n x - S)^2``.
    """
    n, sums = model.n, model.sums
    weights = model.vectors / np.sqrt(np.array(model.values))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _parts(batches):
            x = levels(part.column(1), model.scale, model.shift)
            far = max(abs(int(x.max()) * n), abs(int(x.min()) * n), *(abs(s) for s in sums))
            off = x.astype(object) * n - np.array(sums, dtype=object) if 2 * far >= 2**63 else x * n - np.array(sums, dtype=np.int64)
            most = int(np.abs(off).max(initial=0))
            if most * most * len(sums) >= 2**63:
                off = off.astype(object)
            deviation = [Decimal(int(s)) for s in (off * off).sum(axis=1)]
            z = np.array(off / n, dtype=np.float64) @ weights
            ends = pa.array(np.arange(len(z) + 1, dtype=np.int32) * z.shape[1])
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(deviation, _WHOLE), pa.ListArray.from_arrays(ends, pa.array(z.reshape(-1)))], ["id", "deviation", "z"]
            )

    return rows.mapInArrow(each, f"id {rows.schema[0].dataType.simpleString()}, deviation decimal(38, 0), z array<double>")


def identity_error(z: DataFrame, components: int) -> float:
    """Largest absolute entry of the covariance of the column ``z``, centred before it is multiplied, less the identity."""
    means = z.agg(*[F.avg(F.col("z")[k]).alias(f"m{k}") for k in range(components)]).first()
    pairs = [(k, m) for k in range(components) for m in range(k, components)]
    off = lambda k: F.col("z")[k] - F.lit(means[k])
    found = z.agg(*[F.avg(off(k) * off(m)).alias(f"c{k}_{m}") for k, m in pairs]).first()
    return max(abs(found[i] - (k == m)) for i, (k, m) in enumerate(pairs))


def whiten(embeddings: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """One row per usable vector and component: id, component, n, deviation, whitened, explained, identity_error.

    Vectors that are null, empty, or hold a null, NaN or infinite entry are dropped and fitted
    on by nobody; vectors of several lengths end the job with a ValueError that names them.
    Rows that repeat an id or a vector are rows of their own, null ids stay null. Components
    are numbered from 1; there are fewer than ``components`` where the vectors span fewer
    dimensions, and no rows at all where there is none (an empty table, one vector, vectors
    that are all equal). Other columns are not read, and may have any name.
    """
    spark = embeddings.sparkSession
    rows = embeddings.filter(usable(F.col(vector_column))).select(F.col(id_column).alias("id"), F.col(vector_column).alias("vector"))
    model = fit(rows.select("vector"), components)
    if model is None or not model.values:
        kind = rows.schema["id"].dataType.simpleString()
        return spark.createDataFrame([], f"{id_column} {kind}, component int, n long, deviation decimal(38, 0), whitened double, explained double, identity_error double")
    found = stored(project(rows, model), "whitened")
    error = identity_error(found, len(model.values))
    each = found.select("id", "deviation", F.posexplode("z").alias("place", "whitened"))
    return each.select(
        F.col("id").alias(id_column),
        (F.col("place") + 1).cast("int").alias("component"),
        F.lit(model.n).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.array(*map(F.lit, model.explained))[F.col("place")].alias("explained"),
        F.lit(error).alias("identity_error"),
    )
