"""Contingency tables of many column pairs, counted in one pass over the rows.

A task turns the labels of each column into codes of its own and counts every
pair in place: in a table where both columns have few labels, else as the
sorted cells that occur. Only occurring cells leave the task, once per task or
whenever it holds HELD_CELLS of them, so a row is never copied per pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

# Pairs with at most this many possible cells are counted in a table.
DENSE_CELLS = 1 << 14
# Occurring cells, and labels, a task holds before it hands them on.
HELD_CELLS = 1 << 21
HELD_LABELS = 1 << 20

_CELLS = pa.schema([("pair", pa.int32()), ("a", pa.string()), ("b", pa.string()), ("cnt", pa.int64())])


class _Labels:
    """The labels one task has met in a column, in order of their codes."""

    def __init__(self):
        self.codes: dict[str, int] = {}

    def coded(self, column: pa.Array) -> np.ndarray:
        """The codes of a column, -1 for null."""
        parts = column.dictionary_encode()
        known = self.codes
        own = [known.setdefault(label, len(known)) for label in parts.dictionary.to_pylist()]
        places = parts.indices.fill_null(-1).to_numpy(zero_copy_only=False)
        return np.append(np.array(own, np.int64), -1)[places]


class _Tables:
    """The counts of all pairs in one task."""

    def __init__(self, width: int, pairs: list[tuple[int, int]]):
        self.width, self.pairs = width, pairs
        self.clear()

    def clear(self) -> None:
        self.labels = [_Labels() for _ in range(self.width)]
        self.tables: list[np.ndarray | None] = [None] * len(self.pairs)
        self.sparse: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in self.pairs]
        self.held = 0

    def add(self, batch: pa.RecordBatch) -> None:
        codes = [labels.coded(column) for labels, column in zip(self.labels, batch.columns)]
        sizes = [len(labels.codes) for labels in self.labels]
        there = [bool((c >= 0).all()) for c in codes]
        for at, (i, j) in enumerate(self.pairs):
            a, b = codes[i], codes[j]
            if not (there[i] and there[j]):
                both = (a >= 0) & (b >= 0)
                a, b = a[both], b[both]
            if sizes[i] * sizes[j] <= DENSE_CELLS:
                count = np.bincount(a * sizes[j] + b, minlength=sizes[i] * sizes[j]).reshape(sizes[i], sizes[j])
                old = self.tables[at]
                if old is not None:
                    count[: old.shape[0], : old.shape[1]] += old
                self.tables[at] = count
            else:
                cells, counts = np.unique(a << 32 | b, return_counts=True)
                self.sparse[at].append((cells, counts))
                self.held += len(cells)
        if self.held > HELD_CELLS:
            self.merge()

    def merge(self) -> None:
        """Add up the sorted cells of each pair."""
        self.held = 0
        for at, parts in enumerate(self.sparse):
            if len(parts) > 1:
                cells, place = np.unique(np.concatenate([c for c, _ in parts]), return_inverse=True)
                counts = np.bincount(place, np.concatenate([n for _, n in parts]), len(cells)).astype(np.int64)
                self.sparse[at] = [(cells, counts)]
            self.held += sum(len(c) for c, _ in self.sparse[at])

    @property
    def full(self) -> bool:
        return self.held > HELD_CELLS // 2 or sum(len(labels.codes) for labels in self.labels) > HELD_LABELS

    def rows(self) -> Iterator[pa.RecordBatch]:
        """The occurring cells of all pairs, with their labels."""
        self.merge()
        names = [pa.array(list(labels.codes), pa.string()) for labels in self.labels]
        for at, (i, j) in enumerate(self.pairs):
            found = list(self.sparse[at])
            if self.tables[at] is not None:
                a, b = np.nonzero(self.tables[at])
                found.append((a.astype(np.int64) << 32 | b, self.tables[at][a, b]))
            for cells, counts in found:
                if len(cells):
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.full(len(cells), at, np.int32)),
                            names[i].take(pa.array(cells >> 32)),
                            names[j].take(pa.array(cells & 0xFFFFFFFF)),
                            pa.array(counts.astype(np.int64)),
                        ],
                        schema=_CELLS,
                    )
        self.clear()


def _large_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Few batches of many cells each: the fixed cost of a pair is paid once a batch."""
    held, rows = [], 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= 1 << 16:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, rows = [], 0
    if rows:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def contingency_cells(df: DataFrame, keys: list[Column], pairs: list[tuple[int, int]]) -> DataFrame:
    """pair, a, b, cnt: the cells of each pair of `keys` (text columns) that occur.

    `pairs` holds positions in `keys`; `pair` is a position in `pairs`. Rows
    where either side is null count for no cell of that pair.
    """
    width = len(keys)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = _Tables(width, pairs)
        for batch in _large_batches(batches):
            tables.add(batch)
            if tables.full:
                yield from tables.rows()
        yield from tables.rows()

    cells = df.select(*[key.cast("string").alias(f"k{i}") for i, key in enumerate(keys)])
    # Nothing of it is null. Said here, it holds for all readers of the cells, which then share
    # one shuffle; joins would infer another part of it for each, and count the cells again.
    there = "pair IS NOT NULL AND a IS NOT NULL AND b IS NOT NULL"
    counted = cells.mapInArrow(count, "pair int, a string, b string, cnt bigint").where(there)
    return counted.groupBy("pair", "a", "b").agg(F.sum("cnt").cast("double").alias("cnt"))
