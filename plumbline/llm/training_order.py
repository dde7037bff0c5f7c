"""Training-order shards: a keyed permutation gives every sequence its slot.

Documents become fixed-length sequences of token ids. A Feistel network with
cycle walking permutes the sequence numbers without a table; each shard holds
a run of slots as records of one size, so that a reader can start anywhere. A
task puts one shard together in memory (16 MB as the shards are).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from plumbline.functions.columns import col_
from plumbline.llm.common import Scratch, bytes_column, mixed, read_table
from plumbline.llm.files import Appender, place_of, read_ranges
from plumbline.llm.tokens import END, default_vocabulary, encoder
from plumbline.sources.shared import scratch_path

LENGTH = 256
PER_SHARD = 1 << 15
KEY = 20240229
ROUNDS = 6
PAD = 0


def permuted(index: np.ndarray, size: int, key: int = KEY) -> np.ndarray:
    """The slot of each index in a keyed permutation of range(size).

    Indices outside the range, which the network's power-of-four domain may
    give, are walked on until they fall into it.
    """
    half = max(1, ((max(size, 2) - 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    seeds = mixed(np.arange(1, ROUNDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(key))
    out = index.astype(np.uint64)
    walking = np.arange(len(out))
    while len(walking):
        left, right = out[walking] >> np.uint64(half), out[walking] & mask
        for seed in seeds:
            left, right = right, left ^ (mixed(right + seed) & mask)
        out[walking] = (left << np.uint64(half)) | right
        walking = walking[out[walking] >= np.uint64(size)]
    return out.astype(np.int64)


_ENCODED = "doc_id long, part int, at long, n int, ids binary"


def _encoded(vocabulary: str, length: int):
    """Documents with their ids; their sequences have the numbers at, at + 1 ... of a part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, at = encoder(vocabulary), TaskContext.get().partitionId(), 0
        end = END.to_bytes(4, "little")
        for batch in batches:
            ids = [np.frombuffer(raw + end, "<u4").astype("<u2").tobytes() for raw in encode.each(batch.column("body"))]
            n = -(-np.fromiter(map(len, ids), np.int64, len(ids)) // (2 * length))
            first = at + np.cumsum(n) - n
            at += int(n.sum())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(np.full(len(ids), part, np.int32)), pa.array(first), pa.array(n.astype(np.int32)), pa.array(ids, pa.binary())],
                [field.split()[0] for field in _ENCODED.split(", ")],
            )

    return run


_BLOCKS = "shard int, n int, size long, block binary"
_ROWS = 8192

# What a block holds of each of its sequences, before the ids of them all.
_ENTRY = np.dtype([("slot", "<i8"), ("doc_id", "<i8"), ("piece", "<i4"), ("n", "<i4"), ("known", "?")])


def _placed(size: int, key: int, length: int, per_shard: int):
    """Documents cut into sequences, each with its slot; one packed row for those of a batch in one shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec("zstd", 1)
        for batch in batches:
            if not batch.num_rows:
                continue
            data, at = bytes_column(batch, "ids")
            n = -(-np.diff(at) // (2 * length))
            doc = np.repeat(np.arange(len(n)), n)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
            slot = permuted(np.asarray(batch.column("number"))[doc] + piece, size, key)
            order = np.argsort(slot)
            # The ids stay where they are until they are put in order: a sequence is a range of them.
            cuts = np.append(at[doc] + piece * 2 * length, at[-1])
            ids = pa.Array.from_buffers(pa.large_binary(), len(doc), [None, pa.py_buffer(cuts), pa.py_buffer(data)])
            rows = pa.RecordBatch.from_arrays([ids.take(pa.array(order))], ["ids"])
            data, at = bytes_column(rows, "ids")
            entries = np.zeros(len(order), _ENTRY)
            doc, ids_of = doc[order], batch.column("doc_id")
            entries["slot"], entries["piece"], entries["n"] = slot[order], piece[order], np.diff(at) // 2
            entries["doc_id"] = np.asarray(ids_of.fill_null(0))[doc]
            entries["known"] = ids_of.is_valid().to_numpy(zero_copy_only=False)[doc]
            shards = entries["slot"] // per_shard
            starts = np.flatnonzero(np.diff(shards, prepend=-1))
            ends = np.append(starts[1:], len(shards))
            raw = [entries[x:y].tobytes() + data[at[x] : at[y]].tobytes() for x, y in zip(starts, ends)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(shards[starts].astype(np.int32)), pa.array((ends - starts).astype(np.int32)),
                    pa.array([len(part) for part in raw], pa.int64()),
                    pa.array([codec.compress(part, asbytes=True) for part in raw], pa.binary()),
                ],
                [field.split()[0] for field in _BLOCKS.split(", ")],
            )

    return run


_WRITTEN = "slot long, doc_id long, piece int, n_tokens int, ids_crc32 long"


def _write(folder: str, size: int, length: int, per_shard: int):
    """The blocks of one shard -> its file; one row per sequence, in the order of the slots."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, stride = pa.Codec("zstd", 1), 2 * length
        shard, found, crcs, records = None, [], [], None
        for batch in batches:
            for at, n, raw_size, block in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if shard is None:
                    shard, records = at, np.full((min(per_shard, size - at * per_shard), length), PAD, "<u2").view(np.uint8)
                if at != shard:
                    raise ValueError(f"shards {shard} and {at} in one task")
                raw = codec.decompress(block, raw_size, asbytes=True)
                entries = np.frombuffer(raw, _ENTRY, n)
                ids = np.frombuffer(raw, np.uint8, offset=n * _ENTRY.itemsize)
                sizes = 2 * entries["n"].astype(np.int64)
                ends = np.cumsum(sizes)
                padded = np.full((n, length), PAD, "<u2").view(np.uint8)
                padded[np.arange(stride) < sizes[:, None]] = ids
                records[entries["slot"] - shard * per_shard] = padded
                view = memoryview(ids)
                crcs += [zlib.crc32(view[x:y]) for x, y in zip((ends - sizes).tolist(), ends.tolist())]
                found.append(entries)
        if shard is None:
            return
        entries = np.concatenate(found)
        order = np.argsort(entries["slot"])
        entries, crc = entries[order], np.array(crcs, np.int64)[order]
        if len(entries) != len(records) or (entries["slot"] != shard * per_shard + np.arange(len(records))).any():
            raise ValueError(f"slots of shard {shard} are missing or twice there")
        out = Appender(folder, f"attempt-{shard:06d}")
        out.write(records.tobytes())
        out.close(f"shard-{shard:06d}.bin")
        for start in range(0, len(entries), _ROWS):
            part = entries[start : start + _ROWS]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(part["slot"]), pa.array(part["doc_id"], mask=~part["known"]), pa.array(part["piece"]),
                    pa.array(part["n"]), pa.array(crc[start : start + _ROWS]),
                ],
                [field.split()[0] for field in _WRITTEN.split(", ")],
            )

    return run


def materialise(
    docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH,
    per_shard: int = PER_SHARD, key: int = KEY, vocabulary: str | None = None,
) -> DataFrame:
    """Write `docs` in training order under `folder`; one row per sequence.

    A document's ids, with the end id, are cut every `length`; the last
    sequence is padded. Slots are a permutation of the sequence numbers, keyed
    by `key`; shard s holds slots from s * per_shard on, 2 * length bytes each.
    Null and empty texts are the end id alone; repeated rows are sequences of
    their own; other columns are ignored; no rows write nothing.
    """
    scratch = Scratch(docs.sparkSession, "training-order")
    source = docs.select(col_(id_col).cast("long").alias("doc_id"), col_(text_col).cast("string").alias("body"))
    encoded = source.mapInArrow(_encoded(vocabulary or default_vocabulary(), length), _ENCODED)
    encoded = scratch.stage(encoded, "encoded", dense=True)
    # A row per task of the encoding: where its numbers start.
    counts = encoded.groupBy("part").agg(F.max(F.col("at") + F.col("n")).alias("n")).orderBy("part").collect()
    size = sum(row["n"] for row in counts)
    starts, total = [], 0
    for row in counts:
        starts.append((row["part"], total))
        total += row["n"]
    offsets = docs.sparkSession.createDataFrame(starts, "part int, base long")
    numbered = encoded.join(F.broadcast(offsets), "part").select("doc_id", (F.col("base") + F.col("at")).alias("number"), "ids")
    # A row per shard of a batch, whose ids compress better than those of one sequence; a partition per shard.
    blocks = numbered.mapInArrow(_placed(size, key, length, per_shard), _BLOCKS)
    dealt = blocks.repartitionById(max(1, -(-size // per_shard)), F.col("shard"))
    written = scratch.stage(dealt.mapInArrow(_write(folder, size, length, per_shard), _WRITTEN), "written")
    scratch.drop("encoded")
    shard = F.floor(F.col("slot") / per_shard).cast("int")
    return written.select(
        "slot", "doc_id", "piece", "n_tokens", shard.alias("shard"),
        (F.pmod("slot", F.lit(per_shard)) * 2 * length).cast("long").alias("byte_offset"), "ids_crc32",
    )


def read_slots(folder: str, start: int, stop: int, length: int = LENGTH, per_shard: int = PER_SHARD) -> Iterator[np.ndarray]:
    """The sequences of slots [start, stop) in order: sequential, from any slot on."""
    stride, at = 2 * length, start
    _, base = place_of(folder)
    while at < stop:
        shard = at // per_shard
        last = min(stop, (shard + 1) * per_shard)
        places = [((slot - shard * per_shard) * stride, stride) for slot in range(at, last)]
        for raw in read_ranges(folder, f"{base}/shard-{shard:06d}.bin", places, 0, 1 << 23):
            yield np.frombuffer(raw, "<u2")
        at = last


def op5_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return materialise(read_table(spark, sf_dir, "documents"), scratch_path(spark, "training-shards"))
