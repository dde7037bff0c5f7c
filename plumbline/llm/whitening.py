"""Embedding whitening on the leading components of an exact covariance.

Tasks send integer sums, so the covariance does not depend on how the table is
split; the matrix of one dimension by another is all the driver ever holds.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from plumbline.functions.columns import col_
from plumbline.llm.common import read_table
from plumbline.llm.spectral import leading_pairs

COMPONENTS = 8
GRID = 1024
SHIFT = 100_000
# Grid values beyond this are refused: products of two would lose digits.
MOST = 1 << 52
# Products are added as doubles while every sum stays below this, and so exact.
EXACT = 1 << 53
# A component whose variance is at most this share of the largest, times the
# number of dimensions, is rounding and cannot be scaled to one.
RANK = 1e-15

_CELLS = pa.schema([("length", pa.int64()), ("i", pa.int64()), ("j", pa.int64()), ("n", pa.int64()), ("s", pa.decimal128(38, 0))])
_CELLS_DDL = "length long, i long, j long, n long, s decimal(38,0)"


@dataclass
class Whitening:
    """A fitted model: the projection of grid vectors on unit-variance components."""

    n: int
    sums: list[int]
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float

    @property
    def size(self) -> int:
        return len(self.sums)

    @property
    def middle(self) -> np.ndarray:
        """The mean, rounded to the grid."""
        return np.array([(2 * s + self.n) // (2 * self.n) for s in self.sums], np.int64)

    @property
    def residue(self) -> list[int]:
        """n times the mean less its rounding, exact."""
        return [s - self.n * int(m) for s, m in zip(self.sums, self.middle)]


def grid_vectors(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, grid values) of the usable vectors of a list column, by length.

    Vectors that are null or empty, or hold null or non-finite entries, are not usable.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    values = column.flatten()
    entries = values.cast(pa.float64()).to_numpy(zero_copy_only=False)
    fine = np.isfinite(entries) & values.is_valid().to_numpy(zero_copy_only=False)
    starts = np.concatenate([[0], np.cumsum(lengths)])
    faults = np.concatenate([[0], np.cumsum(~fine)])
    usable = (lengths > 0) & (faults[starts[1:]] == faults[starts[:-1]])
    for length in np.unique(lengths[usable]):
        rows = np.flatnonzero(usable & (lengths == length))
        grid = np.floor(GRID * entries[starts[rows][:, None] + np.arange(length)])
        if np.abs(grid).max() > MOST:
            raise ValueError("embedding entry too large for the integer grid")
        yield rows, grid.astype(np.int64) + SHIFT


def _cells(length: int, i: np.ndarray, j: np.ndarray, n: int, sums: list[int]) -> pa.RecordBatch:
    same = np.full(len(sums), 1, np.int64)
    columns = [pa.array(np.asarray(column, np.int64)) for column in (same * length, i, j, same * n)]
    return pa.RecordBatch.from_arrays([*columns, pa.array([Decimal(s) for s in sums], pa.decimal128(38, 0))], schema=_CELLS)


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Count and sum of each dimension, by vector length, once per task."""
    held: dict[int, list] = {}
    for batch in batches:
        for _, x in grid_vectors(batch.column("v")):
            n, sums = held.get(x.shape[1], (0, 0))
            # At most 2**53 each: a batch's sum fits for 512 rows at a time.
            parts = [x[at : at + 512].sum(axis=0).astype(object) for at in range(0, len(x), 512)]
            held[x.shape[1]] = (n + len(x), sums + sum(parts))
    for length, (n, sums) in held.items():
        yield _cells(length, np.arange(length), np.zeros(length), n, list(sums))


def gram(y: np.ndarray) -> np.ndarray:
    """The exact y.T @ y of integers, as Python integers."""
    most = int(np.abs(y).max()) if y.size else 0
    if most * most >= EXACT:
        whole = y.astype(object)
        return whole.T @ whole
    rows = max(1, (EXACT - 1) // max(1, most * most))
    total = 0
    for at in range(0, len(y), rows):
        part = y[at : at + rows].astype(np.float64)
        total = total + (part.T @ part).astype(np.int64).astype(object)
    return total


def _products(size: int, middle: np.ndarray):
    """Sums of products of centred entries, the upper triangle once per task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = None, 0
        for batch in batches:
            for _, x in grid_vectors(batch.column("v")):
                if x.shape[1] == size:
                    part = gram(x - middle)
                    total, n = part if total is None else total + part, n + len(x)
        if n:
            i, j = np.triu_indices(size)
            yield _cells(size, i, j, n, list(total[i, j]))

    return run


def _vectors(df: DataFrame, vector_col: str) -> DataFrame:
    return df.select(col_(vector_col).cast("array<double>").alias("v"))


def _covariance(model: Whitening, cells: list) -> np.ndarray:
    """The covariance, each cell rounded once from its exact fraction.

    Vectors were centred on the rounded mean, so sum(y y') - r r' / n is the sum
    about the mean itself, with r the residue of the rounding.
    """
    out, rest = np.zeros((model.size, model.size)), model.residue
    for row in cells:
        i, j, exact = row["i"], row["j"], int(row["s"])
        out[i, j] = out[j, i] = float(Fraction(exact * model.n - rest[i] * rest[j], model.n * model.n))
    return out


def fit_whitening(df: DataFrame, vector_col: str = "embedding", components: int = COMPONENTS) -> Whitening | None:
    """The model of all usable vectors of the most frequent length, or None without any.

    Of two lengths equally frequent the smaller is taken. Components without
    variance (up to rounding) are left out, so there may be fewer than asked for.
    """
    vectors = _vectors(df, vector_col)
    first = vectors.mapInArrow(_sums, _CELLS_DDL).groupBy("length", "i").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    by_length: dict[int, list] = {}
    for row in first.collect():
        by_length.setdefault(row["length"], []).append(row)
    if not by_length:
        return None
    size, rows = min(by_length.items(), key=lambda item: (-item[1][0]["n"], item[0]))
    sums = [int(row["s"]) for row in sorted(rows, key=lambda row: row["i"])]
    model = Whitening(rows[0]["n"], sums, np.zeros((0, size)), np.zeros(0), 0.0)
    cells = vectors.mapInArrow(_products(size, model.middle), _CELLS_DDL).groupBy("i", "j").agg(F.sum("s").alias("s"))
    matrix = _covariance(model, cells.collect())
    values, parts = leading_pairs(matrix, components)
    real = values > RANK * size * max(values[0], 0.0)
    model.components, model.eigenvalues, model.trace = parts[real], values[real], float(np.trace(matrix))
    return model


def project(model: Whitening, x: np.ndarray) -> np.ndarray:
    """Whitened coordinates of grid vectors."""
    y = (x - model.middle) - np.array([r / model.n for r in model.residue])
    return y @ (model.components / np.sqrt(model.eigenvalues)[:, None]).T


def deviations(model: Whitening, x: np.ndarray) -> pa.Array:
    """The sums of (n * x - S) ** 2, exact."""
    y, rest = x - model.middle, model.residue
    most = model.n * int(np.abs(y).max()) + max(map(abs, rest)) if y.size else 0
    if most * most * model.size < 1 << 63:
        z = model.n * y - np.array(rest, np.int64)
        return pa.array((z * z).sum(axis=1)).cast(pa.decimal128(38, 0))
    z = model.n * y.astype(object) - np.array(rest, object)
    return pa.array([Decimal(int(s)) for s in (z * z).sum(axis=1)], pa.decimal128(38, 0))


def _second_moments(model: Whitening):
    """Sums and products of whitened coordinates, once per task; j is -1 for the sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(model.components)
        first, second = np.zeros(k), np.zeros((k, k))
        for batch in batches:
            for _, x in grid_vectors(batch.column("v")):
                if x.shape[1] == model.size:
                    w = project(model, x)
                    first, second = first + w.sum(axis=0), second + w.T @ w
        i, j = np.triu_indices(k)
        at, to = np.concatenate([np.arange(k), i]), np.concatenate([np.full(k, -1), j])
        s = np.concatenate([first, second[i, j]])
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(to), pa.array(s)], names=["i", "j", "s"])

    return run


def identity_error(df: DataFrame, model: Whitening, vector_col: str = "embedding") -> float:
    """The largest entry of the whitened table's own covariance less the identity, in size."""
    parts = _vectors(df, vector_col).mapInArrow(_second_moments(model), "i long, j long, s double")
    cells = {(row["i"], row["j"]): row["s"] / model.n for row in parts.groupBy("i", "j").agg(F.sum("s").alias("s")).collect()}
    # The mean is zero up to rounding, so taking it off afterwards loses nothing.
    off = [s - cells[i, -1] * cells[j, -1] - (i == j) for (i, j), s in cells.items() if j >= 0]
    return max(map(abs, off), default=0.0)


_WIDE = pa.schema([("vec_id", pa.int64()), ("deviation", pa.decimal128(38, 0)), ("whitened", pa.list_(pa.float64()))])


def _wide(fitted):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = fitted.value
        for batch in batches:
            for rows, x in grid_vectors(batch.column("v")):
                if x.shape[1] != model.size:
                    continue
                w = project(model, x)
                offsets = pa.array(np.arange(len(x) + 1, dtype=np.int32) * w.shape[1])
                lists = pa.ListArray.from_arrays(offsets, pa.array(w.ravel()))
                ids = batch.column("vec_id").take(pa.array(rows))
                yield pa.RecordBatch.from_arrays([ids, deviations(model, x), lists], schema=_WIDE)

    return run


_RESULT = (
    "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
)


def whiten(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """One row per usable vector and component: its whitened coordinate.

    Entries become integers floor(1024 * c) + 100000 first. Null vectors and
    those with null or non-finite entries give no rows, nor do empty ones and
    those of another length than most; repeated rows and null ids stay as they
    are; other columns are ignored. An empty table, or one without variance,
    gives no rows; with fewer dimensions of variance than `components`, only
    those there are. `deviation` is exact; one of over 38 digits, or an entry
    beyond 2**42, ends with an error.
    """
    spark = df.sparkSession
    model = fit_whitening(df, vector_col, components)
    if model is None or not len(model.components):
        return spark.createDataFrame([], _RESULT)
    error = identity_error(df, model, vector_col)
    source = df.select(col_(id_col).cast("long").alias("vec_id"), col_(vector_col).cast("array<double>").alias("v"))
    wide = source.mapInArrow(_wide(spark.sparkContext.broadcast(model)), "vec_id long, deviation decimal(38,0), whitened array<double>")
    share = F.array(*[F.lit(float(e / model.trace)) for e in model.eigenvalues])
    return wide.select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened")).select(
        "vec_id",
        (F.col("at") + 1).cast("int").alias("component"),
        F.lit(model.n).cast("long").alias("n"),
        "deviation",
        "whitened",
        share[F.col("at")].alias("explained"),
        F.lit(error).alias("identity_error"),
    )


def op11_whitening(spark, sf_dir):
    """`deviation` as long; null where it has more digits than a long holds."""
    return whiten(read_table(spark, sf_dir, "embeddings")).withColumn("deviation", F.expr("try_cast(deviation AS bigint)"))
