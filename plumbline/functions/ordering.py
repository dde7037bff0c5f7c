"""Order statistics that stay exact without sorting a whole column.

Quantiles are found by distributed selection: a bounded random sample proposes
a narrow bracket around each wanted rank, and one scan counts every row, keeping
single values only inside the brackets. The counts prove whether the rank was
caught; a miss is tried again with a wider bracket. A value held by a large
share of the rows collapses its bracket to a single point.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from itertools import groupby

from pyspark.sql import Column, DataFrame, Window, functions as F

from plumbline.functions.columns import local_frame, null_of, scan_columns, stack_columns

# Up to this many cells the built-in percentile is the cheapest exact plan.
DIRECT_CELLS = 600_000
# Rows sampled to place brackets, and rows a bracket may hold when it is read.
SAMPLE_ROWS = 40_000
BRACKET_ROWS = 4_000_000
MAX_ROUNDS = 12
BRACKETS_PER_SCAN = 12
SLACK = 4.0


@dataclass
class _Bracket:
    """The range known to hold the wanted ranks, and a proposal inside it."""

    id: int
    name: str
    value: Column
    first: int  # rank of the lower neighbour, from 0
    last: int  # rank of the upper neighbour
    low: float = -math.inf
    high: float = math.inf
    below: int = 0
    inside: int = 0
    slack: float = SLACK
    try_low: float = -math.inf
    try_high: float = math.inf
    expected: float = 0.0
    settled: bool = False  # a few hot values fill it: reading combines them

    def keep(self) -> Column:
        if math.isinf(self.low) and math.isinf(self.high):
            return self.value.isNotNull()
        return self.value.between(F.lit(self.low), F.lit(self.high))


def _position(prob: float, n: int) -> float:
    return prob * (n - 1)


def _interpolate(low: float, high: float, position: float) -> float:
    return low + (high - low) * (position - math.floor(position))


def exact_quantiles(
    df: DataFrame,
    values: dict[str, tuple[Column, int]],
    probs: tuple[float, ...],
    direct_cells: int | None = None,
    bracket_rows: int | None = None,
    sample_rows: int | None = None,
) -> dict[str, list[float]]:
    """Linear-interpolation quantiles per entry of `values`.

    `values` maps a key to (numeric column, its number of non-null rows).
    """
    if is_direct(values, direct_cells):
        return _builtin_quantiles(df, values, probs)
    return _selected_quantiles(df, values, probs, bracket_rows or BRACKET_ROWS, sample_rows or SAMPLE_ROWS)


def is_direct(values: dict[str, tuple[Column, int]], direct_cells: int | None = None) -> bool:
    """Are there few enough cells for the built-in percentile?"""
    return sum(n for _, n in values.values()) <= (DIRECT_CELLS if direct_cells is None else direct_cells)


def builtin_structs(values: dict[str, tuple[Column, int]], probs: tuple[float, ...]) -> list[Column]:
    """key, q: the built-in percentiles of each entry."""
    wanted = F.array(*[F.lit(float(p)) for p in probs])
    return [F.struct(F.lit(key).alias("key"), F.percentile(value, wanted).alias("q")) for key, (value, _) in values.items()]


def _builtin_quantiles(df, values, probs):
    rows = scan_columns(df, builtin_structs(values, probs)).collect()
    return {row["key"]: list(row["q"]) for row in rows}


def _selected_quantiles(df, values, probs, bracket_rows, sample_rows):
    brackets = []
    for key, (value, n) in values.items():
        for prob in probs:
            at = _position(prob, n)
            brackets.append(_Bracket(len(brackets), key, value, math.floor(at), math.ceil(at), inside=n))
    found: dict[int, tuple[float, float]] = {}
    rest = brackets
    for turn in range(MAX_ROUNDS):
        _propose(df, rest, sample_rows, turn)
        wide = [b for b in rest if b.expected > bracket_rows and not b.settled]
        if wide:
            _shrink(df, wide)
            found.update({b.id: (b.low, b.high) for b in wide if b.low == b.high})
        narrow = [b for b in rest if b not in wide]
        if narrow:
            found.update(_read(df, narrow))
        rest = [b for b in rest if b.id not in found]
        if not rest:
            break
    if rest:
        for b in rest:
            b.try_low, b.try_high = b.low, b.high
        found.update(_read(df, rest))
    out: dict[str, list[float]] = {key: [] for key in values}
    ids = iter(brackets)
    for key, (_, n) in values.items():
        for prob in probs:
            out[key].append(_interpolate(*found[next(ids).id], _position(prob, n)))
    return out


def _any(conditions: list[Column]) -> Column:
    out = conditions[0]
    for condition in conditions[1:]:
        out = out | condition
    return out


def _propose(df: DataFrame, brackets: list[_Bracket], sample_rows: int, turn: int) -> None:
    """A range around each wanted rank, from the quantiles of a bounded sample."""
    share = min(1.0, sample_rows / max(b.inside for b in brackets))
    rows = df if all(math.isinf(b.low) and math.isinf(b.high) for b in brackets) else df.where(_any([b.keep() for b in brackets]))
    sampled = rows.where(F.rand(1000 + turn) < F.lit(share))
    shared: dict[tuple[str, float, float], list[_Bracket]] = {}
    for b in brackets:
        shared.setdefault((b.name, b.low, b.high), []).append(b)
    groups = list(shared.values())
    structs, positions = [], {}
    for i, group in enumerate(groups):
        ends = []
        for b in group:
            size, last = max(b.inside * share, 1.0), max(b.inside - 1, 1)
            for rank, side in ((b.first, -1), (b.last, 1)):
                q = (rank - b.below) / last
                ends.append(q + side * b.slack * (math.sqrt(max(q * (1 - q), 0.0) / size) + 1.0 / size))
            b.expected = b.inside * (min(ends[-1], 1.0) - max(ends[-2], 0.0))
        positions[i] = ends
        clipped = F.array(*[F.lit(min(1.0, max(0.0, q))) for q in ends])
        # One call serves all brackets that share a range.
        structs.append(
            F.struct(F.lit(i).alias("id"), F.percentile(F.when(group[0].keep(), group[0].value), clipped).alias("ends"))
        )
    for row in scan_columns(sampled, structs).collect():
        ends = row["ends"]
        for at, b in enumerate(groups[row["id"]]):
            low_q, high_q = positions[row["id"]][2 * at : 2 * at + 2]
            b.try_low = b.low if ends is None or low_q <= 0 else ends[2 * at]
            b.try_high = b.high if ends is None or high_q >= 1 else ends[2 * at + 1]
            if ends is None:
                b.expected = float(b.inside)


def _shrink(df: DataFrame, brackets: list[_Bracket]) -> None:
    """Adopt the proposals that one counting scan proves right."""
    counted = scan_columns(
        df,
        [
            F.struct(
                F.lit(b.id).alias("id"),
                F.count_if(b.value < F.lit(b.try_low)).alias("below"),
                F.count_if(b.value.between(F.lit(b.try_low), F.lit(b.try_high))).alias("inside"),
            )
            for b in brackets
        ],
        BRACKETS_PER_SCAN,
    ).collect()
    by_id = {b.id: b for b in brackets}
    for row in counted:
        b = by_id[row["id"]]
        if row["below"] <= b.first and b.last < row["below"] + row["inside"]:
            b.settled = row["inside"] > b.inside / 2
            b.low, b.high = b.try_low, b.try_high
            b.below, b.inside = row["below"], row["inside"]
        else:
            b.slack *= 4


def _regions(brackets: list[_Bracket]) -> list[tuple[float, float]]:
    """The brackets of one column as disjoint ranges in order."""
    out: list[tuple[float, float]] = []
    for low, high in sorted((b.try_low, b.try_high) for b in brackets):
        if out and low <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], high))
        else:
            out.append((low, high))
    return out


def _read(df: DataFrame, brackets: list[_Bracket]) -> dict[int, tuple[float, float]]:
    """Both neighbours of each rank the proposals caught, in one scan.

    Every value falls into a numbered zone: odd zones are the ranges and keep
    their values, even zones lie between them and only count rows. Misses widen
    their bracket.
    """
    ordered = sorted(brackets, key=lambda b: b.name)
    columns = [list(group) for _, group in groupby(ordered, key=lambda b: b.name)]
    cells, ranks = [], []
    for i, group in enumerate(columns):
        value = group[0].value
        zone, kept = F.when(value.isNull(), null_of("int")), F.when(value.isNull(), null_of("double"))
        for k, (low, high) in enumerate(_regions(group)):
            zone = zone.when(value < F.lit(low), 2 * k).when(value <= F.lit(high), 2 * k + 1)
            kept = kept.when(value < F.lit(low), null_of("double")).when(value <= F.lit(high), value)
            last = 2 * k + 2
        cells.append(F.struct(F.lit(i).alias("col"), zone.otherwise(last).alias("zone"), kept.alias("v")))
        ranks += [(i, b.id, rank) for b in group for rank in {b.first, b.last}]
    wanted = local_frame(df.sparkSession, ranks, "col int, id int, rank bigint")
    upto = Window.partitionBy("col").orderBy("zone", "v").rowsBetween(Window.unboundedPreceding, 0)
    runs = (
        stack_columns(df, cells)
        .where("zone IS NOT NULL")
        .groupBy("col", "zone", "v")
        .agg(F.count(F.lit(1)).alias("cnt"))
        .withColumn("stop", F.sum("cnt").over(upto))
    )
    hits = (
        runs.join(F.broadcast(wanted), "col")
        .where((F.col("rank") < F.col("stop")) & (F.col("rank") >= F.col("stop") - F.col("cnt")))
        .groupBy("id")
        .agg(F.min("v").alias("low"), F.max("v").alias("high"), F.count_if(F.col("v").isNull()).alias("missed"))
    )
    found = {row["id"]: (row["low"], row["high"]) for row in hits.collect() if not row["missed"]}
    for b in brackets:
        if b.id not in found:
            b.slack *= 4
    return found


def range_parts(df: DataFrame, *keys: str) -> DataFrame:
    """`df` range-partitioned on `keys`, each row labelled with its part.

    Parts follow the order of `keys`, so a prefix sum over all rows is the prefix
    sum inside the part plus the totals of the parts before it. Rows must be
    unique on `keys`. Use the label in a single plan, or checkpoint first.
    """
    return df.repartitionByRange(*keys).withColumn("part", F.spark_partition_id())
