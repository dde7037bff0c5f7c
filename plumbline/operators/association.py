"""Pearson, Cramer's V and point-biserial associations between columns."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations, product

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from plumbline.dataset import Dataset, Field, Request
from plumbline.functions.columns import column_level, local_frame, scan_columns, text_key, union_all
from plumbline.operators.contingency import contingency_cells
from plumbline.operators.profile import distinct_counts, exact_distinct

# Above this many columns, pairs are summed in NumPy inside tasks; the rule is
# the same on either side.
WIDE_COLUMNS = 24
PAIRS_PER_SCAN = 32
THRESHOLD = 0.8

_PAIR = "ord_a int, ord_b int, column_a string, column_b string"
_MOMENTS = ("n", "mx", "my", "cxy", "cxx", "cyy")
# Pairs of a wide table whose task results are merged in one group.
MERGED_PAIRS = 256
# Relative standard error of the sketches that look for identifiers.
SKETCH_ERROR = 0.05


def _centre(field: Field) -> float:
    return 0.0 if field.column_type == "binary" else field.mean


def _names(a: Field, b: Field) -> list[Column]:
    return [
        F.lit(a.ordinal).alias("ord_a"),
        F.lit(b.ordinal).alias("ord_b"),
        F.lit(a.name).alias("column_a"),
        F.lit(b.name).alias("column_b"),
    ]


def _pair_struct(a: Field, b: Field) -> Column:
    """Counts and r of one pair over the rows where both are present.

    Without missing values r comes from sums centred on the columns' means,
    which are the same expressions in every pair, so Spark evaluates them once.
    With gaps the shared rows may lie far from those means; there Spark's
    merging moments are taken, which centre on the shared rows themselves.
    """
    x, y = a.as_double, b.as_double
    if a.missing or b.missing:
        both = x.isNotNull() & y.isNotNull()
        x, y = F.when(both, x), F.when(both, y)
        n, ones = F.count(x).cast("double"), F.sum(x)
        flat = (F.min(x) == F.max(x)) | (F.min(y) == F.max(y))
        r = F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))
    else:
        n, ones = F.count(F.lit(1)).cast("double"), F.sum(x)
        flat = F.lit(a.low == a.high or b.low == b.high)
        dx, dy = x - F.lit(_centre(a)), y - F.lit(_centre(b))
        sx, sy = F.sum(dx), F.sum(dy)
        spread = F.sqrt(n * F.sum(dx * dx) - sx * sx) * F.sqrt(n * F.sum(dy * dy) - sy * sy)
        r = F.try_divide(n * F.sum(dx * dy) - sx * sy, spread)
    return F.struct(*_names(a, b), n.alias("n"), ones.alias("ones"), r.alias("r"), F.coalesce(flat, F.lit(True)).alias("flat"))


def _merged(p: list[np.ndarray], q: list[np.ndarray]) -> list[np.ndarray]:
    """The moments of two sets of rows together, each pair centred on its own rows.

    Each is [n, mean x, mean y, cxy, cxx, cyy, low x, high x, low y, high y].
    """
    n = p[0] + q[0]
    with np.errstate(all="ignore"):
        share, weight = np.where(n > 0, q[0] / n, 0.0), np.where(n > 0, p[0] * q[0] / n, 0.0)
        dx, dy = np.where(p[0] > 0, q[1] - p[1], q[1]), np.where(p[0] > 0, q[2] - p[2], q[2])
        dx, dy = np.where(q[0] > 0, dx, 0.0), np.where(q[0] > 0, dy, 0.0)
        out = [n, np.where(p[0] > 0, p[1], 0.0) + dx * share, np.where(p[0] > 0, p[2], 0.0) + dy * share]
        for at, product_ in ((3, dx * dy), (4, dx * dx), (5, dy * dy)):
            out.append(p[at] + q[at] + np.where(weight > 0, product_ * weight, 0.0))
    return out + [f(u, v) for f, u, v in zip((np.minimum, np.maximum) * 2, p[6:], q[6:])]


def _batch_moments(x: np.ndarray, pairs_of: list[tuple[int, np.ndarray, np.ndarray]], size: int) -> list[np.ndarray]:
    """The moments of all pairs over one batch, a first column at a time."""
    there = ~np.isnan(x)
    out = [np.zeros(size) for _ in range(6)] + [np.full(size, v) for v in (np.inf, -np.inf, np.inf, -np.inf)]
    with np.errstate(all="ignore"):
        for column, others, slots in pairs_of:
            rows = there[:, column]
            a, b, w = x[rows, column][:, None], x[rows][:, others], there[rows][:, others]
            n = w.sum(0).astype(float)
            first, second = np.where(w, a, 0.0), np.where(w, b, 0.0)
            mx, my = np.where(n > 0, first.sum(0) / n, 0.0), np.where(n > 0, second.sum(0) / n, 0.0)
            dx, dy = np.where(w, a - mx, 0.0), np.where(w, b - my, 0.0)
            found = [n, mx, my, (dx * dy).sum(0), (dx * dx).sum(0), (dy * dy).sum(0)]
            if len(a):
                found += [np.where(w, a, np.inf).min(0), np.where(w, a, -np.inf).max(0)]
                found += [np.where(w, b, np.inf).min(0), np.where(w, b, -np.inf).max(0)]
            for target, value in zip(out, found):
                target[slots] = value
    return out


def _block_sums(df: DataFrame, fields: list[Field], pairs: list[tuple[Field, Field]]) -> DataFrame:
    """The same for wide tables: moments per Arrow batch, merged by pair.

    Each task emits its merged moments once, so the shuffle carries one row per
    pair and task.
    """
    used = sorted({f for pair in pairs for f in pair}, key=lambda f: f.ordinal)
    slot = {f.ordinal: i for i, f in enumerate(used)}
    by_first: dict[int, list[int]] = {}
    for i, (a, _) in enumerate(pairs):
        by_first.setdefault(slot[a.ordinal], []).append(i)
    right = np.array([slot[b.ordinal] for _, b in pairs])
    pairs_of = [(column, right[slots], np.array(slots)) for column, slots in by_first.items()]
    size, names = len(pairs), [*_MOMENTS, "low_x", "high_x", "low_y", "high_y"]

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        total = None
        for batch in batches:
            for start in range(0, batch.num_rows, 2000):
                part = batch.slice(start, 2000)
                x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in part.columns]).astype(float)
                found = _batch_moments(x, pairs_of, size)
                total = found if total is None else _merged(total, found)
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(size), pa.int32()), *map(pa.array, total)], names=["pair", *names])

    def merged(frame: pd.DataFrame) -> pd.DataFrame:
        pair = frame["pair"].unique()
        total = None
        for _, part in frame.groupby(frame.groupby("pair").cumcount()):
            row = part.set_index("pair").reindex(pair)
            row["n"] = row["n"].fillna(0)
            found = [row[name].to_numpy() for name in names]
            total = found if total is None else _merged(total, found)
        return pd.DataFrame({"pair": pair} | dict(zip(names, total)))

    schema = "pair int, " + ", ".join(f"{s} double" for s in names)
    values = df.select(*[f.as_double.alias(f"x{i}") for i, f in enumerate(used)])
    group = F.floor(F.col("pair") / MERGED_PAIRS).alias("block")
    summed = values.mapInArrow(totals, schema).groupBy(group).applyInPandas(merged, schema)
    known = local_frame(df.sparkSession, [(i, a.ordinal, b.ordinal, a.name, b.name) for i, (a, b) in enumerate(pairs)], f"pair int, {_PAIR}"
    )
    r = F.try_divide(F.col("cxy"), F.sqrt("cxx") * F.sqrt("cyy"))
    flat = (F.col("n") == 0) | (F.col("low_x") == F.col("high_x")) | (F.col("low_y") == F.col("high_y"))
    return known.join(summed, "pair", "left").select(
        "ord_a", "ord_b", "column_a", "column_b", F.coalesce("n", F.lit(0.0)).alias("n"),
        (F.col("n") * F.col("mx")).alias("ones"), r.alias("r"), F.coalesce(flat, F.lit(True)).alias("flat"),
    )


def _pairs_request(pairs: list[tuple[Field, Field]]) -> Request:
    named = " ".join(f"{a.ordinal}x{b.ordinal}" for a, b in pairs)
    return Request(f"pairs {named}", [_pair_struct(a, b) for a, b in pairs], PAIRS_PER_SCAN)


def pair_requests(ds: Dataset) -> list[Request]:
    """What `pearson_pairs` and `point_biserial` ask of a scan, where they are not wide."""
    numbers, flags = ds.of_type("numeric"), ds.of_type("binary")
    out = []
    for pairs in (list(combinations(numbers, 2)), list(product(flags, numbers))):
        if len({f.ordinal for pair in pairs for f in pair}) <= WIDE_COLUMNS:
            out.append(_pairs_request(pairs))
    return out


def pair_sums(ds: Dataset, pairs: list[tuple[Field, Field]], wide: int = WIDE_COLUMNS) -> DataFrame:
    """One row per pair: rows, sum of the first column, and Pearson r.

    r is null where a column is constant on the shared rows or not finite.
    """
    used = {f.ordinal for pair in pairs for f in pair}
    if len(used) > wide:
        sums = _block_sums(ds.df, ds.fields, pairs)
    else:
        sums = ds.scan(_pairs_request(pairs))
    bounded = F.greatest(F.least("r", F.lit(1.0)), F.lit(-1.0))
    finite = ~F.col("flat") & F.col("r").isNotNull() & ~F.isnan("r")
    return sums.withColumn("r", F.when(finite, bounded))


def pearson_pairs(ds: Dataset, wide: int = WIDE_COLUMNS) -> DataFrame:
    """Unrounded r for each pair of numeric columns (a before b)."""
    pairs = list(combinations(ds.of_type("numeric"), 2))
    if not pairs:
        return local_frame(ds.spark, [], f"{_PAIR}, n bigint, r double")
    return pair_sums(ds, pairs, wide).select(
        "ord_a", "ord_b", "column_a", "column_b", F.col("n").cast("bigint").alias("n"), "r"
    )


@column_level
def pearson_matrix(ds: Dataset) -> DataFrame:
    """The full symmetric matrix, 4 decimals, null where undefined."""
    pairs = ds.small(pearson_pairs)
    fields = ds.of_type("numeric")
    cell = ["ord_a", "ord_b", "column_a", "column_b", "n", "r"]
    if len(fields) < 2:
        return pairs.select(*cell[:-1], F.col("r").alias("value"))
    mirrored = pairs.select(
        F.col("ord_b").alias("ord_a"),
        F.col("ord_a").alias("ord_b"),
        F.col("column_b").alias("column_a"),
        F.col("column_a").alias("column_b"),
        "n",
        "r",
    )
    diagonal = local_frame(ds.spark, [(f.ordinal, f.ordinal, f.name, f.name, f.n, None if f.low == f.high else 1.0) for f in fields],
        f"{_PAIR}, n bigint, r double",
    )
    return (
        union_all([pairs.select(*cell), mirrored, diagonal])
        .select(*cell[:-1], F.round("r", 4).alias("value"))
        .orderBy("ord_a", "ord_b")
    )


def correlation_view(ds: Dataset) -> DataFrame:
    """The matrix as a wide table, one column per numeric column."""
    names = [f.name for f in ds.of_type("numeric")]
    return (
        pearson_matrix(ds)
        .groupBy("ord_a", "column_a")
        .pivot("column_b", names)
        .agg(F.first("value"))
        .orderBy("ord_a")
        .drop("ord_a")
    )


def strength_band(value: Column) -> Column:
    """strong / moderate / weak / negligible by absolute value."""
    size = F.abs(value)
    return (
        F.when(value.isNull(), "undefined")
        .when(size >= 0.7, "strong")
        .when(size >= 0.4, "moderate")
        .when(size >= 0.2, "weak")
        .otherwise("negligible")
    )


def correlation_bands(ds: Dataset) -> DataFrame:
    """Each numeric pair with the band of its rounded r."""
    rounded = F.round("r", 4)
    return ds.small(pearson_pairs).select(
        "column_a", "column_b", rounded.alias("value"), strength_band(rounded).alias("band")
    )


# -- categorical x categorical ----------------------------------------------


def cramers_v(ds: Dataset) -> DataFrame:
    """Cramer's V for each pair of categorical columns, 4 decimals.

    Only cells that occur leave a task, so a pair never costs more than its
    distinct combinations. V comes from sum(n_ab^2 / (n_a n_b)) - 1. Pairs with
    an identifier column are not counted at all: with every value unique the sum
    is the number of the partner's values, which makes V exactly 1.
    """
    schema = f"{_PAIR}, n bigint, value double"
    fields = ds.of_type("categorical")
    pairs = list(combinations(fields, 2))
    if not pairs:
        return local_frame(ds.spark, [], schema)
    unique = _identifiers(ds, fields)
    varied = _varied(ds, fields) if unique else set()
    sure, counted = [], []
    for a, b in pairs:
        if a.ordinal not in unique and b.ordinal not in unique:
            counted.append((a, b))
            continue
        partner = b if a.ordinal in unique else a
        if partner.ordinal in varied:
            sure.append((a.ordinal, b.ordinal, a.name, b.name, partner.n, 1.0))
    frame = local_frame(ds.spark, sure, schema)
    if counted:
        frame = frame.unionByName(_counted_v(ds, counted))
    return frame.orderBy("ord_a", "ord_b")


def _identifiers(ds: Dataset, fields: list[Field]) -> set[int]:
    """Ordinals of the columns without a gap whose every value is unique.

    A sketch of each column's distinct values, taken in one scan, leaves few to
    count; it is far from the row number for any column it rules out.
    """
    full = [f for f in fields if f.n and not f.missing]
    if not ds.knows(distinct_counts, None):
        sketches = scan_columns(
            ds.df,
            [
                F.struct(F.lit(f.ordinal).alias("ordinal"), F.approx_count_distinct(text_key(f.col, f.longest), SKETCH_ERROR).alias("n"))
                for f in full
            ],
        ).collect() if full else []
        likely = {row["ordinal"] for row in sketches if row["n"] >= ds.n_rows * (1 - 6 * SKETCH_ERROR)}
        full = [f for f in full if f.ordinal in likely]
    return {o for o, n in exact_distinct(ds, full).items() if n == ds.n_rows}


def _varied(ds: Dataset, fields: list[Field]) -> set[int]:
    """Ordinals of the columns with two different values at least."""
    if ds.knows(distinct_counts, None):
        return {o for o, n in exact_distinct(ds, fields).items() if n > 1}
    keys = {f.ordinal: text_key(f.col, f.longest) for f in fields if f.n}
    rows = scan_columns(
        ds.df, [F.struct(F.lit(o).alias("ordinal"), (F.min(key) != F.max(key)).alias("varied")) for o, key in keys.items()]
    ).collect() if keys else []
    return {row["ordinal"] for row in rows if row["varied"]}


def _counted_v(ds: Dataset, pairs: list[tuple[Field, Field]]) -> DataFrame:
    """V from the cells that occur.

    Tasks count all pairs in place and send occurring cells. A cell count joined
    with its marginals may have a hot value; both joins are plain inner joins,
    so adaptive execution splits such partitions.
    """
    fields = sorted({f for pair in pairs for f in pair}, key=lambda f: f.ordinal)
    slot = {f.ordinal: i for i, f in enumerate(fields)}
    places = [(slot[a.ordinal], slot[b.ordinal]) for a, b in pairs]
    cells = contingency_cells(ds.df, [text_key(f.col, f.longest) for f in fields], places)
    by_a = cells.groupBy("pair", "a").agg(F.sum("cnt").alias("n_a"))
    by_b = cells.groupBy("pair", "b").agg(F.sum("cnt").alias("n_b"))
    spread = (
        cells.join(by_a, ["pair", "a"])
        .join(by_b, ["pair", "b"])
        .groupBy("pair")
        .agg(
            F.sum(F.col("cnt") * F.col("cnt") / (F.col("n_a") * F.col("n_b"))).alias("s"),
            F.sum("cnt").alias("n"),
            # Each marginal is met once by each of its cells.
            F.round(F.sum(F.col("cnt") / F.col("n_a"))).alias("r"),
            F.round(F.sum(F.col("cnt") / F.col("n_b"))).alias("c"),
        )
    )
    size = F.least("r", "c") - 1
    names = local_frame(ds.spark, [(i, a.ordinal, b.ordinal, a.name, b.name) for i, (a, b) in enumerate(pairs)], f"pair int, {_PAIR}")
    return (
        names.join(spread, "pair")
        .where(size > 0)
        .select(
            "ord_a",
            "ord_b",
            "column_a",
            "column_b",
            F.col("n").cast("bigint").alias("n"),
            F.round(F.sqrt(F.greatest(F.col("s") - 1, F.lit(0.0)) / size), 4).alias("value"),
        )
    )


# -- binary x numeric --------------------------------------------------------


def point_biserial(ds: Dataset, wide: int = WIDE_COLUMNS) -> DataFrame:
    """Correlation of each binary with each numeric column, 4 decimals.

    Needs four complete rows that hold both binary values.
    """
    schema = "ord_a int, ord_b int, binary_column string, numeric_column string, n bigint, value double"
    pairs = list(product(ds.of_type("binary"), ds.of_type("numeric")))
    if not pairs:
        return local_frame(ds.spark, [], schema)
    ones = F.col("ones")
    return (
        pair_sums(ds, pairs, wide)
        .where((F.col("n") >= 4) & (ones > 0) & (ones < F.col("n")) & F.col("r").isNotNull())
        .select(
            "ord_a",
            "ord_b",
            F.col("column_a").alias("binary_column"),
            F.col("column_b").alias("numeric_column"),
            F.col("n").cast("bigint").alias("n"),
            F.round("r", 4).alias("value"),
        )
        .orderBy("ord_a", "ord_b")
    )


# -- all methods -------------------------------------------------------------


@column_level
def associated_pairs(ds: Dataset, threshold: float = THRESHOLD) -> DataFrame:
    """Pairs at or above `threshold` by any method, in report order."""

    def tagged(frame: DataFrame, rank: int, method: str, a: str, b: str, value: Column) -> DataFrame:
        return frame.select(
            F.lit(rank).alias("method_rank"),
            "ord_a",
            "ord_b",
            F.col(a).alias("column_a"),
            F.col(b).alias("column_b"),
            value.alias("correlation"),
            F.lit(method).alias("method"),
        )

    pearson = ds.small(pearson_pairs).where(F.abs("r") >= threshold)
    cramer = ds.small(cramers_v).where(F.col("value") >= threshold)
    biserial = ds.small(point_biserial).where(F.abs("value") >= threshold)
    return union_all(
        [
            tagged(pearson, 0, "pearson", "column_a", "column_b", F.round("r", 4)),
            tagged(cramer, 1, "cramers_v", "column_a", "column_b", F.col("value")),
            tagged(biserial, 2, "point_biserial", "binary_column", "numeric_column", F.col("value")),
        ]
    ).orderBy("method_rank", "ord_a", "ord_b")
