"""Heavy values of a column by a mergeable summary, confirmed by one exact count.

Each task keeps a bounded set of counters over its rows (the most frequent keys
survive, the others share one error bound). Summaries of tasks add up: a key's
true count is at least its estimate and at most that plus the errors of all
tasks. So one small exchange names every key that can be heavy, and a second
scan counts just those. Light values are never shuffled.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from plumbline.functions.columns import local_frame

# Counters a task keeps; it gives up at most one row in this many of its own.
COUNTERS = 4096
# Candidates that are counted exactly at most; with more the caller counts all.
CANDIDATES = 8 * COUNTERS


class Counters:
    """The counters of one task: `size` keys at most, and by how much any may be short."""

    def __init__(self, size: int):
        self.size, self.error, self.kept = size, 0, Counter()

    def add(self, counts: dict[str, int]) -> None:
        self.kept.update(counts)
        if len(self.kept) > 4 * self.size:
            self.shrink()

    def shrink(self) -> None:
        """Take the largest count that is to go off every counter."""
        if len(self.kept) > self.size:
            off = sorted(self.kept.values(), reverse=True)[self.size]
            self.kept = Counter({key: n - off for key, n in self.kept.items() if n > off})
            self.error += off


def _summaries(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters = Counters(size)
        for batch in batches:
            found = batch.column("key").drop_null().value_counts()
            counters.add(dict(zip(found.field("values").to_pylist(), found.field("counts").to_pylist())))
        counters.shrink()
        # The task's error travels as a row without a key.
        keys, counts = [None, *counters.kept], [counters.error, *counters.kept.values()]
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(counts, pa.int64())], names=["key", "n"])

    return run


def _candidates(df: DataFrame, key: Column, size: int, least) -> tuple[list[str], int] | None:
    """Keys whose count may reach `least(estimates, error)`, and what any other key has at most.

    None where they are more than CANDIDATES.
    """
    summary = df.select(key.alias("key")).mapInArrow(_summaries(size), "key string, n bigint").groupBy("key").agg(F.sum("n").alias("n"))
    # A task's error is at most its rows over `size`, and so is the sum of all.
    top = summary.orderBy(F.col("key").isNotNull(), F.col("n").desc()).limit(CANDIDATES + 2).collect()
    error = next((row["n"] for row in top if row["key"] is None), 0)
    named = [(row["key"], row["n"]) for row in top if row["key"] is not None]
    bound = least([n for _, n in named], error)
    chosen = [name for name, n in named if n + error >= bound]
    if len(chosen) > CANDIDATES:
        return None
    missed = max((n + error for name, n in named if n + error < bound), default=error)
    if len(named) > CANDIDATES:
        missed = max(missed, named[-1][1] + error)
    return chosen, missed


def _counted(df: DataFrame, key: Column, chosen: list[str]) -> list[tuple[str, int]]:
    """The exact counts of a few keys, largest first; equal counts by key."""
    if not chosen:
        return []
    wanted = local_frame(df.sparkSession, [(name,) for name in chosen], "key string")
    counts = df.select(key.alias("key")).join(F.broadcast(wanted), "key").groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    return sorted(((row["key"], row["n"]) for row in counts.collect()), key=lambda pair: (-pair[1], pair[0]))


def heavy_keys(df: DataFrame, key: Column, least: int, size: int = COUNTERS) -> list[tuple[str, int]] | None:
    """All keys that `least` rows or more hold, with their exact counts.

    None where the summary cannot tell: the keys are too flat for its size.
    """
    found = _candidates(df, key, size, lambda counts, error: least)
    return None if found is None else [(name, n) for name, n in _counted(df, key, found[0]) if n >= least]


def top_keys(df: DataFrame, key: Column, n: int, size: int = COUNTERS) -> list[tuple[str, int]] | None:
    """Every key whose count is at or above the n-th largest, ties included, with exact counts.

    None where a key outside the summary could be among them.
    """

    def least(counts: list[int], error: int) -> int:
        return counts[n - 1] if len(counts) >= n else 1

    found = _candidates(df, key, size, least)
    if found is None:
        return None
    chosen, missed = found
    counted = _counted(df, key, chosen)
    bound = counted[n - 1][1] if len(counted) >= n else 1
    if missed >= bound:
        return None
    return [(name, count) for name, count in counted if count >= bound]
