"""Helpers the training-data operators share: staging, Arrow texts, word hashes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from plumbline.functions.columns import col_
from plumbline.sources.shared import scratch_path

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

# Texts are worked on in slices of about this many bytes, so that the numpy
# buffers of a task stay a small multiple of it. One longer text is one slice.
SLICE_BYTES = 1 << 20

_MIX_1 = np.uint64(0xBF58476D1CE4E5B9)
_MIX_2 = np.uint64(0x94D049BB133111EB)
_BASE = np.uint64(0x9E3779B97F4A7C15)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Scratch:
    """Tables that one operator writes to the shared folder on its way.

    Later steps reread them instead of running their lineage again, also after
    an executor is lost. Tables that nothing reads any more are deleted, so
    that an operator's disk does not add up.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.name, self.paths = spark, name, {}

    def stage(self, df: DataFrame, name: str, dense: bool = False) -> DataFrame:
        """`df` written and read back; `dense` takes more CPU and less disk."""
        path = scratch_path(self.spark, f"{self.name}-{name}")
        writer = df.write.option("compression", "zstd")
        if dense:
            writer = writer.option("parquet.compression.codec.zstd.level", 7).option("parquet.page.size", 4 << 20)
        writer.parquet(path)
        self.paths[name] = path
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            place = self.spark._jvm.org.apache.hadoop.fs.Path(self.paths.pop(name))
            place.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(place, True)

    def keep_only(self, *names: str) -> None:
        self.drop(*[name for name in self.paths if name not in names])


def stage(df: DataFrame, name: str) -> DataFrame:
    """`df` written once to the shared folder and read back."""
    return Scratch(df.sparkSession, "stage").stage(df, name)


# A filter of keys has this many bits, however many keys there are, in words of
# 64: at most 32,768 rows of two longs. Fuller, it lets more rows through to the
# join behind it, which decides.
_FILTER_BITS = 1 << 21


def _slot(key: Column) -> Column:
    """A key's bit in the filter, from 0."""
    return F.pmod(F.xxhash64(key), F.lit(_FILTER_BITS))


def marked_by(df: DataFrame, key: Column, keys: DataFrame, flag: str) -> DataFrame:
    """`df` with a boolean column: false only where `key` is not in `keys` (one column).

    The filter of the keys is broadcast; its size does not depend on the data.
    """
    word, bits = f"{flag}_word", f"{flag}_bits"
    slot = _slot(F.col(keys.columns[0]))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(slot, F.lit(64)).cast("int"))
    words = keys.select(F.shiftright(slot, 6).alias(word), bit.alias(bits)).groupBy(word).agg(F.bit_or(bits).alias(bits))
    names = [col_(name) for name in df.columns]
    slot = _slot(key)
    placed = df.select(*names, F.shiftright(slot, 6).alias(word), F.pmod(slot, F.lit(64)).cast("int").alias(f"{flag}_at"))
    is_set = F.coalesce(F.getbit(F.col(bits), F.col(f"{flag}_at")) == 1, F.lit(False))
    return placed.join(F.broadcast(words), word, "left").select(*names, is_set.alias(flag))


def free_name(df: DataFrame, name: str) -> str:
    """`name`, or a longer one that no column of `df` has in any case."""
    taken = {column.lower() for column in df.columns}
    while any(column.startswith(name) for column in taken):
        name += "_"
    return name


def without_rows(docs: DataFrame, keys: list[Column], verdicts: DataFrame) -> DataFrame:
    """`docs` without the rows that `verdicts` (one column per key, once) names.

    Rows of a key with `once` are copies of one another, and one of them stays;
    those of the other keys go. Null is a key like any other. Rows that the key
    filter clears go straight through; only the others, and so only about as
    many texts as go, are shuffled to be looked up.
    """
    names = [col_(name) for name in docs.columns]
    fields = verdicts.drop("once").schema.fields
    flag, tag = free_name(docs, "maybe_gone"), free_name(docs, "row_key")
    own = {f"{tag}_{i}": key.cast(field.dataType) for i, (key, field) in enumerate(zip(keys, fields))}
    named = verdicts.select(*[F.col(field.name).alias(f"v_{name}") for field, name in zip(fields, own)], "once")
    listed = named.select(F.xxhash64(*[f"v_{name}" for name in own]).alias("key"))
    flagged = marked_by(docs.withColumns(own), F.xxhash64(*own), listed, flag)

    def met(which: DataFrame, how: str) -> DataFrame:
        same = [F.col(name).eqNullSafe(F.col(f"v_{name}")) for name in own]
        return flagged.where(F.col(flag)).join(which, same, how)

    kept = flagged.where(~F.col(flag)).select(*names).union(met(named, "left_anti").select(*names))
    single = named.where("once")
    return kept if single.isEmpty() else kept.union(met(single, "left_semi").dropDuplicates(list(own)).select(*names))


def ascii_lower(text: Column) -> Column:
    """`text` with A-Z lower-cased and nothing else changed."""
    return F.translate(text, UPPER, UPPER.lower())


def text_bytes(text: Column) -> Column:
    """The UTF-8 bytes of a text; null counts as empty."""
    return F.coalesce(text.cast("string"), F.lit("")).cast("binary")


def only(df: DataFrame, *names: str) -> DataFrame:
    """The named columns alone, so that no other column can clash."""
    return df.select(*[col_(name) for name in names])


def bytes_column(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    """A binary column as (all bytes, n + 1 offsets), without copying rows."""
    column = batch.column(name)
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    everything = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return everything, at


def slices(at: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about `limit` bytes each, given the offsets."""
    start, n = 0, len(at) - 1
    while start < n:
        stop = int(np.searchsorted(at, at[start] + limit, "right")) - 1
        stop = min(max(stop, start + 1), n)
        yield start, stop
        start = stop


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * _MIX_1
    x = (x ^ (x >> np.uint64(27))) * _MIX_2
    return x ^ (x >> np.uint64(31))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.empty(max(n, 1), np.uint64)
    out[0] = 1
    out[1:] = base
    return np.multiply.accumulate(out)


def word_hashes(data: np.ndarray, at: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of consecutive texts, and each word's text.

    `keep` maps a byte to what it counts as, 0 for a separator. `data` holds
    the bytes from at[0] to at[-1].
    """
    body = keep[data]
    # One separator between texts, so that no word spans two of them.
    body = np.insert(body, (at[1:] - at[0]), 0) if len(body) else np.zeros(len(at) - 1, np.uint8)
    solid = body != 0
    edge = np.diff(solid.astype(np.int8), prepend=0, append=0)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    # Horner sums word by word, one position of every word at a time.
    lengths = ends - starts
    out = np.zeros(len(starts), np.uint64)
    order = np.argsort(-lengths, kind="stable")
    sorted_starts, sorted_lengths = starts[order], lengths[order]
    sums = out[order]
    longest = int(sorted_lengths[0])
    for i in range(min(longest, 48)):
        live = int(np.searchsorted(-sorted_lengths, -i, "left"))
        sums[:live] = sums[:live] * _BASE + body[sorted_starts[:live] + i]
    if longest > 48:
        for k in range(int(np.searchsorted(-sorted_lengths, -48, "left"))):
            rest = body[sorted_starts[k] + 48 : sorted_starts[k] + sorted_lengths[k]].astype(np.uint64)
            weight = _powers(_BASE, len(rest))
            sums[k] = sums[k] * _BASE * weight[-1] + (rest * weight[::-1]).sum(dtype=np.uint64)
    out[order] = mixed(sums + sorted_lengths.astype(np.uint64) * _MIX_2)
    text = np.searchsorted(at[1:] - at[0] + np.arange(len(at) - 1), starts, "left")
    return out, text


def batches(function: Callable[[pa.RecordBatch], pa.RecordBatch]) -> Callable:
    """`function` on every non-empty batch, for mapInArrow."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            if part.num_rows:
                yield function(part)

    return run
