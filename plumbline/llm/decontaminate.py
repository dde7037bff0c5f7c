"""Benchmark decontamination with an FM-index per training shard.

A shard is about a million words of documents. Its index holds the alphabet of
word hashes, the wavelet matrix of the Burrows-Wheeler transform and sampled
suffix positions. Test phrases are searched backwards through wavelet ranks,
all at once; occurrences are located by walking to a sampled position; the
spans they cover are merged per document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from plumbline.functions.columns import col_
from plumbline.llm.common import Scratch, bytes_column, read_table, slices, stage, text_bytes, without_rows, word_hashes

WINDOW = 10
SHARD_WORDS = 1 << 20
SAMPLE_STEP = 16
# Phrases are searched in blocks of this many, and about so many blocks are sent
# to the shards in one pass: 32 MB of hashes at a time, however many phrases there are.
BLOCK = 4096
BLOCKS_PER_PASS = 96
# Occurrences located at a time.
LOCATED = 1 << 18

_WORDS = np.zeros(256, np.uint8)
for _b in [*range(48, 58), *range(97, 123), *range(128, 256)]:
    _WORDS[_b] = _b
for _b in range(65, 91):
    _WORDS[_b] = _b + 32


# -- the index ----------------------------------------------------------------


def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """All suffixes in order, by doubling the ranked length; 0 marks text ends.

    Every 0 ranks by its place, so that no comparison runs past a text's end.
    """
    n = len(symbols)
    stops = np.flatnonzero(symbols == 0)
    ranked = symbols.astype(np.int64) + len(stops)
    ranked[stops] = np.arange(len(stops))
    width = int(ranked.max()).bit_length() + 1
    known = max(1, 62 // width)
    padded = np.concatenate((ranked + 1, np.zeros(known, np.int64)))
    key = np.zeros(n, np.int64)
    for j in range(known):
        key = (key << width) | padded[j : n + j]
    order = np.argsort(key, kind="stable")
    key = key[order]
    head = np.ones(n, bool)
    head[1:] = key[1:] != key[:-1]
    del key, padded, ranked
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    while True:
        single = head.copy()
        single[:-1] &= head[1:]
        open_at = np.flatnonzero(~single)
        if not len(open_at):
            return order
        rows = order[open_at]
        follow = rows + known
        after = np.where(follow < n, rank[np.minimum(follow, n - 1)] + 1, 0)
        key = (rank[rows] << 31) | after
        moved = np.argsort(key, kind="stable")
        rows, key = rows[moved], key[moved]
        order[open_at] = rows
        new = np.ones(len(rows), bool)
        new[1:] = key[1:] != key[:-1]
        head[open_at] = new
        rank[rows] = np.maximum.accumulate(np.where(new, open_at, 0))
        known *= 2


def wavelet_matrix(symbols: np.ndarray, levels: int) -> np.ndarray:
    """The levels' bits, packed into one row of 64-bit words each."""
    rows = np.zeros((levels, len(symbols) // 64 + 1), np.uint64)
    current = symbols
    for level in range(levels):
        bits = ((current >> (levels - 1 - level)) & 1).astype(bool)
        packed = np.packbits(bits, bitorder="little")
        rows[level].view(np.uint8)[: len(packed)] = packed
        current = np.concatenate((current[~bits], current[bits]))
    return rows


class Index:
    """An FM-index over word hashes of consecutive documents."""

    def __init__(self, alphabet, starts, bits, marked, samples, n):
        self.alphabet, self.starts, self.bits, self.n = alphabet, starts, bits, n
        self.marked, self.samples = marked, samples
        self.before = self._prefix(bits)
        self.marked_before = self._prefix(marked[None])[0]
        # Zeros of each level: from a row's padding nothing is counted.
        self.zeros = n - (self.before[:, -1] + np.bitwise_count(bits[:, -1]).astype(np.int64))

    @staticmethod
    def _prefix(bits: np.ndarray) -> np.ndarray:
        counts = np.cumsum(np.bitwise_count(bits), axis=1, dtype=np.int64)
        return np.concatenate((np.zeros((len(bits), 1), np.int64), counts[:, :-1]), axis=1)

    @classmethod
    def build(cls, hashes: np.ndarray, lengths: np.ndarray) -> "Index":
        """From the words of all documents in a row and each document's count."""
        alphabet, symbols = np.unique(hashes, return_inverse=True)
        ends = np.cumsum(lengths)
        text = np.insert(symbols.astype(np.int32) + 1, ends, 0)
        starts = np.concatenate(([0], ends[:-1])) + np.arange(len(lengths))
        order = suffix_order(text)
        n = len(text)
        levels = max(1, int(len(alphabet)).bit_length())
        sampled = np.zeros(n, bool)
        sampled[::SAMPLE_STEP] = True
        sampled[starts] = True
        # A row whose suffix starts a document is sampled: no walk leaves one.
        row_sampled = sampled[order]
        marked = np.zeros(n // 64 + 1, np.uint64)
        packed = np.packbits(row_sampled, bitorder="little")
        marked.view(np.uint8)[: len(packed)] = packed
        return cls(alphabet, starts, wavelet_matrix(text[order - 1], levels), marked, order[row_sampled].astype(np.int32), n)

    def _ones(self, level: int, at: np.ndarray) -> np.ndarray:
        word = at >> 6
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[level][word] + np.bitwise_count(self.bits[level][word] & mask)

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Rows before `at` whose preceding word is `symbol`, after all smaller symbols."""
        low, high = np.zeros(len(at), np.int64), at
        levels = len(self.bits)
        for level in range(levels):
            bit = ((symbol >> (levels - 1 - level)) & 1).astype(bool)
            ones_low, ones_high = self._ones(level, low), self._ones(level, high)
            low = np.where(bit, self.zeros[level] + ones_low, low - ones_low)
            high = np.where(bit, self.zeros[level] + ones_high, high - ones_high)
        return high - low

    def _counts(self) -> np.ndarray:
        """Rows whose suffix starts with a symbol smaller than each symbol."""
        symbols = np.arange(len(self.alphabet) + 1)
        every = self.rank(symbols, np.full(len(symbols), self.n, np.int64))
        return np.concatenate(([0], np.cumsum(every)))

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Backward search of all phrases; (phrase, first row, last row + 1) of those found.

        `phrases` is right-aligned: the last word is in the last column.
        """
        smaller = self._smaller
        symbol = np.searchsorted(self.alphabet, phrases)
        known = self.alphabet[np.minimum(symbol, len(self.alphabet) - 1)] == phrases if len(self.alphabet) else np.zeros(phrases.shape, bool)
        used = np.arange(phrases.shape[1])[None, :] >= phrases.shape[1] - lengths[:, None]
        alive = np.flatnonzero((known | ~used).all(1) & (lengths > 0))
        low, high = np.zeros(len(alive), np.int64), np.full(len(alive), self.n, np.int64)
        for back in range(phrases.shape[1]):
            step = np.flatnonzero(lengths[alive] > back)
            if not len(step):
                break
            s = symbol[alive[step], phrases.shape[1] - 1 - back] + 1
            low[step] = smaller[s] + self.rank(s, low[step])
            high[step] = smaller[s] + self.rank(s, high[step])
            live = low < high
            alive, low, high = alive[live], low[live], high[live]
        return alive, low, high

    @property
    def _smaller(self) -> np.ndarray:
        if not hasattr(self, "_smaller_memo"):
            self._smaller_memo = self._counts()
        return self._smaller_memo

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows: walk back until a sampled one, add the steps."""
        out = np.full(len(rows), -1, np.int64)
        pending, at, steps = np.arange(len(rows)), rows.astype(np.int64), 0
        levels = len(self.bits)
        while len(pending):
            word, mask = at >> 6, np.uint64(1) << (at & 63).astype(np.uint64)
            hit = (self.marked[word] & mask) != 0
            index = self.marked_before[word[hit]] + np.bitwise_count(self.marked[word[hit]] & (mask[hit] - np.uint64(1)))
            out[pending[hit]] = self.samples[index] + steps
            pending, at = pending[~hit], at[~hit]
            symbol, low, high = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64), at
            for level in range(levels):
                bit = (self.bits[level][high >> 6] >> (high & 63).astype(np.uint64)) & np.uint64(1) != 0
                symbol = (symbol << 1) | bit
                ones_low, ones_high = self._ones(level, low), self._ones(level, high)
                low = np.where(bit, self.zeros[level] + ones_low, low - ones_low)
                high = np.where(bit, self.zeros[level] + ones_high, high - ones_high)
            at = self._smaller[symbol] + high - low
            steps += 1
        return out


# -- as Spark jobs -------------------------------------------------------------

_INDEX = "shard string, n long, alphabet binary, lengths binary, bits binary, marked binary, samples binary, ids array<long>"


def index_shards(docs: DataFrame, id_col: str, text_col: str, shard_words: int = SHARD_WORDS) -> DataFrame:
    """One row per shard: its FM-index and the ids of its documents, in order."""
    source = docs.select(col_(id_col).cast("long").alias("doc_id"), text_bytes(col_(text_col)).alias("body"))
    schema = pa.schema(
        [
            ("shard", pa.string()), ("n", pa.int64()), ("alphabet", pa.binary()), ("lengths", pa.binary()),
            ("bits", pa.binary()), ("marked", pa.binary()), ("samples", pa.binary()), ("ids", pa.list_(pa.int64())),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made = TaskContext.get().partitionId(), 0
        words, lengths, ids, total = [], [], [], 0

        def flush():
            index = Index.build(np.concatenate(words), np.concatenate(lengths))
            row = {
                "shard": f"{part}-{made}", "n": index.n, "alphabet": index.alphabet.tobytes(),
                "lengths": np.concatenate(lengths).astype(np.int64).tobytes(), "bits": index.bits.tobytes(),
                "marked": index.marked.tobytes(), "samples": index.samples.tobytes(), "ids": ids,
            }
            return pa.RecordBatch.from_pylist([row], schema=schema)

        for batch in batches:
            data, at = bytes_column(batch, "body")
            keys = batch.column("doc_id").to_pylist()
            for start, stop in slices(at):
                h, owner = word_hashes(data[at[start] : at[stop]], at[start : stop + 1], _WORDS)
                words.append(h)
                lengths.append(np.bincount(owner, minlength=stop - start))
                ids += keys[start:stop]
                total += len(h) + stop - start
                if total >= shard_words:
                    yield flush()
                    made += 1
                    words, lengths, ids, total = [], [], [], 0
        if ids:
            yield flush()

    return source.mapInArrow(run, _INDEX)


def phrases(benchmark: DataFrame, item_col: str, text_col: str, window: int = WINDOW) -> DataFrame:
    """(phrase, item): the hashes of each window of each item, once.

    A window is `window` words; an item with fewer, but not none, is one. A
    null item id counts as the empty string.
    """
    source = benchmark.select(
        F.coalesce(col_(item_col).cast("string"), F.lit("")).alias("item"), text_bytes(col_(text_col)).alias("body")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = bytes_column(batch, "body")
            items = batch.column("item").to_pylist()
            for start, stop in slices(at):
                h, owner = word_hashes(data[at[start] : at[stop]], at[start : stop + 1], _WORDS)
                found, names = [], []
                for k in range(stop - start):
                    a, b = np.searchsorted(owner, [k, k + 1])
                    for i in range(a, max(a + 1, b - window + 1) if b > a else a):
                        found.append(h[i : min(i + window, b)].astype("<u8").tobytes())
                        names.append(items[start + k])
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary()), pa.array(names, pa.string())], ["phrase", "item"])

    return source.mapInArrow(run, "phrase binary, item string").distinct()


def _passes(listed: DataFrame, per_pass: int) -> DataFrame:
    """The distinct phrases in lists of about `per_pass`, dealt by their hash: (pass, phrases)."""
    table = listed.select("phrase").distinct()
    number = F.pmod(F.xxhash64("phrase"), F.lit(max(1, -(-table.count() // per_pass))))
    return table.groupBy(number.alias("pass")).agg(F.collect_list("phrase").alias("phrases"))


def _matrix(raw: list[bytes], window: int) -> tuple[np.ndarray, np.ndarray]:
    """Phrases as rows of word hashes, right-aligned, and their lengths."""
    rows = np.zeros((len(raw), window), np.uint64)
    for i, phrase in enumerate(raw):
        rows[i, window - len(phrase) // 8 :] = np.frombuffer(phrase, "<u8")
    return rows, np.array([len(phrase) // 8 for phrase in raw], np.int64)


_HITS = "shard string, ordinal int, doc_id long, n_words long, spans array<struct<start:int,stop:int>>, found array<binary>"


def _search(window: int, every: bool):
    """Rows (index, one pass's phrases) -> the documents of the shard with hits.

    With `every`, those without hits have a row too.
    """
    arrow = pa.schema(
        [
            ("shard", pa.string()), ("ordinal", pa.int32()), ("doc_id", pa.int64()), ("n_words", pa.int64()),
            ("spans", pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))), ("found", pa.list_(pa.binary())),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number in range(batch.num_rows):
                row = batch.slice(number, 1).to_pylist()[0]
                lengths = np.frombuffer(row["lengths"], np.int64)
                starts = np.concatenate(([0], np.cumsum(lengths)[:-1])) + np.arange(len(lengths))
                alphabet = np.frombuffer(row["alphabet"], np.uint64)
                bits = np.frombuffer(row["bits"], np.uint64).reshape(-1, row["n"] // 64 + 1)
                marked = np.frombuffer(row["marked"], np.uint64)
                index = Index(alphabet, starts, bits, marked, np.frombuffer(row["samples"], np.int32), row["n"])
                cover = np.zeros(index.n + 1, np.int32)
                found = {}
                for at in range(0, len(row["phrases"]), BLOCK):
                    some = row["phrases"][at : at + BLOCK]
                    which, low, high = index.search(*_matrix(some, window))
                    for a, b in _groups(high - low):
                        count = high[a:b] - low[a:b]
                        rows = np.repeat(low[a:b] - np.concatenate(([0], np.cumsum(count)[:-1])), count) + np.arange(count.sum())
                        phrase = np.repeat(which[a:b], count)
                        place = index.locate(rows)
                        size = np.array([len(some[p]) // 8 for p in which[a:b]], np.int64)
                        np.add.at(cover, place, 1)
                        np.add.at(cover, place + np.repeat(size, count), -1)
                        doc = np.searchsorted(starts, place, "right") - 1
                        for d, p in np.unique(np.stack((doc, phrase), axis=1), axis=0).tolist():
                            found.setdefault(d, []).append(some[p])
                hit = np.cumsum(cover)[: index.n] > 0
                edge = np.diff(hit.astype(np.int8), prepend=0, append=0)
                begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
                span_doc = np.searchsorted(starts, begin, "right") - 1
                spans = {}
                for d, x, y in zip(span_doc.tolist(), (begin - starts[span_doc]).tolist(), (end - starts[span_doc]).tolist()):
                    spans.setdefault(d, []).append({"start": x, "stop": y})
                listed = np.arange(len(lengths)) if every else np.array(sorted(spans), np.int64)
                columns = [
                    pa.array([row["shard"]] * len(listed), pa.string()), pa.array(listed.astype(np.int32)),
                    pa.array(row["ids"], pa.int64()).take(pa.array(listed)), pa.array(lengths[listed]),
                    pa.array([spans.get(d, []) for d in listed.tolist()], arrow.field("spans").type),
                    pa.array([found.get(d, []) for d in listed.tolist()], arrow.field("found").type),
                ]
                yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    return run


def _groups(counts: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of phrases with about LOCATED occurrences each."""
    ends, a = np.cumsum(counts), 0
    while a < len(counts):
        base = ends[a - 1] if a else 0
        b = max(a + 1, int(np.searchsorted(ends, base + LOCATED, "right")))
        yield a, b
        a = b


def _merged(spans: Column) -> Column:
    """The spans in order, those that overlap or touch made one."""

    def step(done: Column, span: Column) -> Column:
        last = F.get(done, F.size(done) - 1)
        joined = F.struct(last["start"].alias("start"), F.greatest(last["stop"], span["stop"]).alias("stop"))
        before = F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))
        apart = F.coalesce(span["start"] > last["stop"], F.lit(True))
        return F.when(apart, F.concat(done, F.array(span))).otherwise(F.concat(before, F.array(joined)))

    return F.aggregate(F.array_sort(spans), F.array().cast("array<struct<start:int,stop:int>>"), step)


def contamination(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW,
) -> DataFrame:
    """One row per row of `docs`: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans.

    Words are runs of 0-9, a-z (after lower-casing A-Z) and everything beyond
    ASCII. A word inside any occurrence of an item's window is hit; `spans` are
    the merged word ranges to remove. Null and empty texts have no words; an
    empty benchmark hits nothing; repeated items count once by id, repeated
    documents each for themselves; a null item id counts as ''. Other columns
    are ignored.
    """
    scratch = Scratch(docs.sparkSession, "decontaminate")
    listed = scratch.stage(phrases(benchmark, item_col, item_text_col, window), "phrases")
    index = scratch.stage(index_shards(docs, id_col, text_col), "index")
    passes = scratch.stage(_passes(listed, BLOCK * BLOCKS_PER_PASS), "passes")
    numbers = sorted(row["pass"] for row in passes.select("pass").collect())
    hits = None
    for number in numbers or [None]:
        if number is None:
            one = docs.sparkSession.createDataFrame([([],)], "phrases array<binary>")
        else:
            one = passes.where(F.col("pass") == number).select("phrases")
        beside = index.withColumn("every", F.lit(0)).join(F.broadcast(one.withColumn("every", F.lit(0))), "every").drop("every")
        part = beside.mapInArrow(_search(window, every=hits is None), _HITS)
        hits = part if hits is None else hits.union(part)
    hits = scratch.stage(hits, "hits")
    many = len(numbers) > 1
    scratch.drop("index", "passes")
    row = ["shard", "ordinal"]
    if hits.where("size(spans) > 0").isEmpty():
        marks = hits.select(*row).limit(0).withColumn("items", F.lit(None).cast("array<string>"))
    else:
        marks = (
            hits.select(*row, F.explode("found").alias("phrase"))
            .join(listed, "phrase")
            .groupBy(*row)
            .agg(F.array_sort(F.collect_set("item")).alias("items"))
        )
    # A document has a row per pass; together they are its hits.
    words = (
        hits.groupBy(*row, "doc_id", "n_words").agg(_merged(F.flatten(F.collect_list("spans"))).alias("spans"))
        if many
        else hits.select(*row, "doc_id", "n_words", "spans")
    )
    items = F.coalesce("items", F.array().cast("array<string>"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["start"])
    return (
        words.join(marks, row, "left")
        .withColumn("n_hit", n_hit)
        .select(
            "doc_id",
            "n_words",
            "n_hit",
            F.size(items).cast("long").alias("n_items"),
            F.sha2(F.array_join(items, ",").cast("binary"), 256).alias("items_sha256"),
            (F.col("n_hit") > 0).alias("contaminated"),
            F.to_json(F.array_sort("spans")).alias("spans"),
        )
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` that no test phrase hits, with their columns.

    The verdict is that of a row's own text, whatever its id: rows are known
    by a 64-bit hash of both.
    """
    key = F.xxhash64(col_(id_col), text_bytes(col_(text_col)))
    rows = docs.select(key.alias("doc_id"), col_(text_col).alias("text"))
    hit = contamination(rows, benchmark).where("contaminated").select("doc_id").distinct().withColumn("once", F.lit(False))
    return without_rows(docs, [key], stage(hit, "contaminated"))


def op4_benchmark_decontamination(spark, sf_dir):
    return contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
