"""The most frequent rows of a count table, under a proven bound."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

# Counts are told apart in steps of a quarter of a power of two.
STEPS = 4


def frequent(counts: DataFrame, column: str, most: int) -> DataFrame:
    """The rows of `counts` whose `column` reaches a bound that at most `most` rows reach.

    The bound is read off a histogram of the counts on a logarithmic scale (a
    few hundred rows), so no row is sorted and no task sees more than its own.
    Where rows at the top step alone outnumber `most`, there are none.
    """
    step = F.floor(F.log2(F.col(column).cast("double")) * STEPS).cast("int")
    histogram = sorted(counts.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("rows")).collect(), reverse=True)
    total, lowest = 0, None
    for row in histogram:
        total += row["rows"]
        if total > most:
            break
        lowest = row["step"]
    return counts.where(F.lit(False)) if lowest is None else counts.where(step >= lowest)
