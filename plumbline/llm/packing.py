"""Packing into fixed windows by Karmarkar-Karp multiway differencing.

Each task streams its documents into groups of GROUP windows' worth of tokens
and balances the pieces of a group over the windows. Nothing is shuffled.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from plumbline.functions.columns import col_
from plumbline.llm.common import read_table
from plumbline.llm.tokens import END, default_vocabulary, encoder

CAPACITY = 4096
GROUP = 64
# Room left per window, so that near-equal windows stay under the capacity.
SLACK = 4
RETRIES = 6

Piece = tuple  # (document number, start, length)


def differencing(sizes: list[int], ways: int) -> list[list[int]]:
    """Indices of `sizes` in `ways` sets with near-equal sums.

    Partial partitions are merged, the two most uneven first, the largest set
    of one with the smallest of the other.
    """
    heap = [(-size, i, [(size, [i])]) for i, size in enumerate(sizes)]
    heapq.heapify(heap)
    count = len(sizes)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        # Both hold their non-empty sets, largest first.
        overlap = max(0, len(a) + len(b) - ways)
        free = len(a) - overlap
        merged = a[:free] + b[: len(b) - overlap]
        for j in range(overlap):
            x, y = a[free + j], b[len(b) - 1 - j]
            merged.append((x[0] + y[0], x[1] + y[1]))
        merged.sort(key=lambda part: -part[0])
        low = merged[-1][0] if len(merged) == ways else 0
        heapq.heappush(heap, (low - merged[0][0], count, merged))
        count += 1
    return [members for _, members in heap[0][2]] if heap else []


def _carved(pieces: list[Piece], times: int) -> list[Piece]:
    """The longest pieces, each with a short end cut off: 1, 2, 4 ... 128 tokens.

    Short pieces are merged last and even out what the long ones leave.
    """
    ranked = sorted(pieces, key=lambda p: -p[2])
    out = ranked[times:]
    for i, (number, start, length) in enumerate(ranked[:times]):
        short = min(1 << (i % 8), length // 2)
        out += [(number, start, length - short), (number, start + length - short, short)] if short else [(number, start, length)]
    return out


def balanced(pieces: list[Piece], capacity: int = CAPACITY) -> list[list[Piece]]:
    """Windows of at most `capacity` tokens, near-equal, holding all pieces.

    Where a window would overflow, short ends are cut off the longest pieces
    and the differencing is run again; after RETRIES the window count rises.
    """
    total = sum(p[2] for p in pieces)
    ways, tries = max(1, -(-total // capacity)), 0
    most = max(1, capacity // 2)
    cut = [
        (number, start + at, min(most, length - at)) for number, start, length in pieces for at in range(0, length, most)
    ]
    while True:
        sets = differencing([p[2] for p in cut], ways)
        windows = [[cut[i] for i in members] for members in sets]
        if all(sum(p[2] for p in window) <= capacity for window in windows):
            return windows
        tries += 1
        if tries <= RETRIES:
            cut = _carved(cut, ways)
        else:
            ways, tries = ways + 1, 0


def _tail(pieces: list[Piece], capacity: int) -> tuple[list[Piece], list[list[Piece]]]:
    """What a task's last group leaves over, as windows of exact powers of two.

    Such windows need no padding. The rest fills whole windows but for SLACK.
    """
    total = sum(p[2] for p in pieces)
    whole = total // (capacity - SLACK)
    over = total - whole * (capacity - SLACK)
    least = 1 if whole * SLACK < 64 else 64
    pieces, windows = list(pieces), []
    for bit in range(capacity.bit_length() - 1, -1, -1):
        size = 1 << bit
        if not over & size or size < least:
            continue
        window, need = [], size
        while need:
            number, start, length = pieces.pop()
            taken = min(length, need)
            if taken < length:
                pieces.append((number, start, length - taken))
            window.append((number, start + length - taken, taken))
            need -= taken
        windows.append(window)
    return pieces, windows


_SCHEMA = pa.schema(
    [
        ("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()),
        ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()),
    ]
)


def _packer(vocabulary: str, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary)
        end = END.to_bytes(4, "little")
        sequence = TaskContext.get().partitionId() << 33
        limit = GROUP * (capacity - SLACK)
        pieces: list[Piece] = []
        texts: dict[int, tuple] = {}
        filled = number = 0

        def written(windows: list[list[Piece]]) -> pa.RecordBatch:
            nonlocal sequence
            columns = [[] for _ in _SCHEMA]
            for window in windows:
                offset = 0
                for doc, start, length in window:
                    doc_id, raw = texts[doc]
                    crc = zlib.crc32(memoryview(raw)[4 * start : 4 * (start + length)])
                    for column, value in zip(columns, (doc_id, start, length, crc, len(raw) // 4, sequence, offset)):
                        column.append(value)
                    offset += length
                sequence += 1
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], schema=_SCHEMA)

        for batch in batches:
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), encode.each(batch.column("body"))):
                raw = ids + end
                texts[number] = (doc_id, raw)
                start, left = 0, len(raw) // 4
                while filled + left >= limit:
                    taken = limit - filled
                    pieces.append((number, start, taken))
                    yield written(balanced(pieces, capacity))
                    start, left, filled, pieces = start + taken, left - taken, 0, []
                    texts = {number: texts[number]}
                if left:
                    pieces.append((number, start, left))
                    filled += left
                number += 1
        if pieces:
            rest, exact = _tail(pieces, capacity)
            yield written((balanced(rest, capacity) if rest else []) + exact)

    return run


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, vocabulary: str | None = None) -> DataFrame:
    """One row per piece: where it is in its document and in its sequence.

    Each id of each document, its end id included, lies in exactly one piece;
    the pieces of a sequence lie one after another from offset 0. Null and
    empty texts are the end id alone; repeated rows are packed each; other
    columns are ignored; an empty table gives no rows. Sequence ids are unique,
    not consecutive.
    """
    if capacity & (capacity - 1) or capacity < 64:
        raise ValueError("capacity must be a power of two, 64 at least")
    source = docs.select(col_(id_col).cast("long").alias("doc_id"), col_(text_col).cast("string").alias("body"))
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return source.mapInArrow(_packer(vocabulary or default_vocabulary(), capacity), schema)


def op8_packing(spark, sf_dir):
    return pack(read_table(spark, sf_dir, "documents"))
