"""One-dimensional isolation forests, one per numeric column.

On a single column an isolation tree is a set of cut points with a depth per
gap, so the mean depth over the trees is a step function of the value. Trees
grow from a bounded sample chosen by content; the step function is small and is shipped to
the tasks, which score every row of the table with a binary search.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from plumbline.dataset import Dataset, Field
from plumbline.functions.columns import col_, stack_columns
from plumbline.functions.heavy import heavy_keys

TREES = 100
TREE_ROWS = 256
SAMPLE_ROWS = TREES * TREE_ROWS
SEED = 42
CUTOFF = 0.5
# A row content is heavy from one row in this many on.
HEAVY = 1000


@dataclass(frozen=True)
class StepFunction:
    """Outlier or not between consecutive breaks of one column."""

    breaks: np.ndarray
    outlier: np.ndarray

    def flags(self, values: np.ndarray) -> np.ndarray:
        return self.outlier[np.searchsorted(self.breaks, values, side="left")]


def _expected_depth(m: int) -> float:
    """Mean depth of an unsuccessful search among m points."""
    if m <= 1:
        return 0.0
    if m == 2:
        return 1.0
    return 2.0 * (np.log(m - 1.0) + np.euler_gamma) - 2.0 * (m - 1.0) / m


def _grow(points: np.ndarray, rng: np.random.Generator, limit: int) -> tuple[list[float], list[float]]:
    """Cut points in ascending order and the depth of each gap between them."""
    cuts: list[float] = []
    depths: list[float] = []
    # An explicit stack visited left to right keeps both lists in value order.
    stack: list = [(0, len(points), 0)]
    while stack:
        top = stack.pop()
        if isinstance(top, float):
            cuts.append(top)
            continue
        start, stop, depth = top
        low, high = (points[start], points[stop - 1]) if stop > start else (0.0, 0.0)
        if depth >= limit or stop - start <= 1 or low == high:
            depths.append(depth + _expected_depth(stop - start))
            continue
        cut = float(rng.uniform(low, high))
        middle = start + int(np.searchsorted(points[start:stop], cut, side="right"))
        stack += [(middle, stop, depth + 1), cut, (start, middle, depth + 1)]
    return cuts, depths


def _fit_column(sample: np.ndarray, ordinal: int) -> StepFunction:
    rng = np.random.default_rng([SEED, ordinal])
    size = min(TREE_ROWS, len(sample))
    limit = int(np.ceil(np.log2(max(size, 2))))
    steps: dict[float, float] = {}
    base = 0.0
    for _ in range(TREES):
        points = np.sort(rng.choice(sample, size, replace=False))
        cuts, depths = _grow(points, rng, limit)
        base += depths[0]
        for cut, before, after in zip(cuts, depths, depths[1:]):
            steps[cut] = steps.get(cut, 0.0) + after - before
    breaks = np.array(sorted(steps))
    depth = base + np.concatenate([[0.0], np.cumsum([steps[b] for b in breaks])])
    scale = _expected_depth(size)
    if scale == 0:
        return StepFunction(np.array([]), np.array([False]))
    score = np.exp2(-depth / TREES / scale)
    return StepFunction(breaks, score > CUTOFF + 1e-12)


_MODEL = "ordinal int, breaks array<double>, outlier array<boolean>"


def _rows(ds: Dataset, fields: list[Field]) -> DataFrame:
    """The columns as doubles, with `start`, a hash of the row's content in [0, 1)."""
    coin = F.xxhash64(F.lit(SEED), *[col_(name) for name in ds.df.columns])
    start = F.shiftrightunsigned(coin, 11).cast("double") / F.lit(float(1 << 53))
    return ds.df.select(start.alias("start"), *[f.as_double.alias(f"v{f.ordinal}") for f in fields])


def _coins_below(bound: float) -> Column:
    """How many of a row's coins are under `bound`.

    The coins of a heavy row's copies are spread evenly from `start`, those of
    a light one all lie on it.
    """
    spread = F.ceil(F.lit(bound) * F.col("copies") - F.col("start")).cast("long")
    light = F.when(F.col("start") < bound, F.col("copies")).otherwise(0)
    return F.when(F.col("heavy"), F.least(F.greatest(spread, F.lit(0).cast("long")), F.col("copies"))).otherwise(light)


def _copies(drawn: DataFrame) -> DataFrame:
    """A row per copy of `drawn` whose coin counts, with the coin as u."""
    each = drawn.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("coins") - 1)))
    place = F.when(F.col("heavy"), (F.col("start") + F.col("k")) / F.col("copies")).otherwise(F.col("start"))
    return each.withColumn("u", place).drop("start", "copies", "coins", "k", "heavy")


def _sampled(ds: Dataset, fields: list[Field]) -> DataFrame:
    """At most SAMPLE_ROWS values (ordinal, v) per column.

    A coin decides on a row by the hash of its content, where it is read, so
    only rows that may be drawn are shuffled and no split of the table changes
    the choice. Rows that hold one content in HEAVY of the table or more are
    named by a heavy-hitter summary, counted, and drawn by their share: their
    copies' coins are spread evenly over [0, 1). A lighter content is drawn
    with all its copies or none. The window keeps the bounded top. Infinite
    values are never sampled.
    """
    rows = _rows(ds, fields)
    bounds = {f.ordinal: min(1.0, 3.0 * SAMPLE_ROWS / max(f.n, 1)) for f in fields}
    widest = max(bounds.values())
    found = heavy_keys(rows, F.col("start").cast("string"), max(2, -(-ds.n_rows // HEAVY))) if widest < 1 else []
    heavy = F.col("start").cast("string").isin([key for key, _ in found or []])
    groups = (
        rows.where((F.col("start") < widest) | heavy)
        .groupBy(*rows.columns)
        .agg(F.count(F.lit(1)).alias("copies"))
        # Where every row may be drawn all are grouped, and all can be spread.
        .withColumn("heavy", heavy if widest < 1 else F.lit(True))
    )
    drawn = stack_columns(
        groups,
        [
            F.struct(
                F.lit(f.ordinal).alias("ordinal"),
                F.col(f"v{f.ordinal}").alias("v"),
                "start",
                "copies",
                "heavy",
                _coins_below(bounds[f.ordinal]).alias("coins"),
            )
            for f in fields
        ],
    ).where("coins > 0 AND v IS NOT NULL AND abs(v) < double('Infinity')")
    drawn = _copies(drawn)
    first = Window.partitionBy("ordinal").orderBy("u", "v")
    sample = drawn.withColumn("at", F.row_number().over(first)).where(F.col("at") <= SAMPLE_ROWS)
    return sample.select("ordinal", "v")


def fit_forests(ds: Dataset, fields: list[Field]) -> dict[int, StepFunction]:
    """A step function per column, fitted on the cluster, one task per column.

    Infinite values are scored but never sampled.
    """
    if not fields:
        return {}
    sample = _sampled(ds, fields)

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        ordinal = int(pdf["ordinal"].iloc[0])
        model = _fit_column(np.sort(pdf["v"].to_numpy()), ordinal)
        return pd.DataFrame({"ordinal": [ordinal], "breaks": [model.breaks], "outlier": [model.outlier]})

    rows = sample.groupBy("ordinal").applyInPandas(fit, _MODEL).collect()
    found = {r["ordinal"]: StepFunction(np.array(r["breaks"]), np.array(r["outlier"])) for r in rows}
    for f in fields:
        if f.ordinal not in found:
            # Every finite value's coin missed: there are few among many infinite ones.
            v = F.col(f"v{f.ordinal}")
            finite = _rows(ds, [f]).where(v.isNotNull() & (F.abs(v) < float("inf")))
            top = finite.select("start", v.alias("v")).orderBy("start", "v").limit(SAMPLE_ROWS)
            sample = np.sort(np.array([r["v"] for r in top.collect()], float))
            found[f.ordinal] = _fit_column(sample, f.ordinal) if len(sample) else StepFunction(np.array([]), np.array([False]))
    return found


def count_flags(
    ds: Dataset,
    fields: list[Field],
    forests: dict[int, StepFunction],
    bounds: dict[int, tuple[float, float, float, float]],
) -> DataFrame:
    """ordinal, if_count, row_consensus in one pass.

    `bounds` holds (iqr low, iqr high, z low, z high) per column; a row counts
    for `row_consensus` when at least two of the three methods flag it. Tasks
    emit one partial row per column.
    """
    plan = [(f.ordinal, forests[f.ordinal], bounds[f.ordinal]) for f in fields]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        isolated = np.zeros(len(plan), dtype=np.int64)
        agreed = isolated.copy()
        for batch in batches:
            for i, (_, forest, (low, high, z_low, z_high)) in enumerate(plan):
                v = batch.column(i).drop_null().to_numpy(zero_copy_only=False)
                alone = forest.flags(v)
                votes = (
                    alone.astype(np.int8)
                    + ((v < low) | (v > high)).astype(np.int8)
                    + ((v < z_low) | (v > z_high)).astype(np.int8)
                )
                isolated[i] += int(alone.sum())
                agreed[i] += int((votes >= 2).sum())
        yield pa.RecordBatch.from_arrays(
            [pa.array([o for o, _, _ in plan], pa.int32()), pa.array(isolated), pa.array(agreed)],
            names=["ordinal", "if_count", "row_consensus"],
        )

    return (
        ds.df.select(*[f.as_double.alias(f"v{f.ordinal}") for f in fields])
        .mapInArrow(count, "ordinal int, if_count bigint, row_consensus bigint")
        .groupBy("ordinal")
        .agg(F.sum("if_count").alias("if_count"), F.sum("row_consensus").alias("row_consensus"))
    )
