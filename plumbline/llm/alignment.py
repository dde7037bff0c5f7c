"""Alignment of the tokens of two vocabularies over the same bytes.

Both vocabularies' token ends over a stretch of text are merged by merge path:
binary searches along diagonals divide the merge into pieces of equal work,
each piece emits its overlaps on its own, and overlaps are stitched into groups
where pieces meet. Documents are encoded once. Linked id pairs are counted by
document in a first pass over the ids; a second pass looks the counts up, the
frequent pairs (a bounded table) on the spot, all others in a shuffled join.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from plumbline.functions.columns import col_
from plumbline.functions.worker import kept
from plumbline.llm.common import Scratch, bytes_column, read_table, slices
from plumbline.llm.frequent import frequent
from plumbline.llm.token_counts import SPACE, pieces_of
from plumbline.llm.tokens import _byte_characters

VOCABULARY_A = "byte_bpe_50k.json"
VOCABULARY_B = "piece_bpe_32k.model"
# Characters of whole texts whose tokens a task holds at a time; a longer text is taken alone.
SLICE_CHARS = 1 << 20
# Distinct stretches of text whose ids a worker remembers, twice as many in all.
CACHED = 300_000
# Characters of new stretches that are encoded in one call.
LEARNED_CHARS = 1 << 16
CACHED_LENGTH = 64
# Merge steps of a piece.
PIECE = 1 << 15
# Groups with more links than this are linked by their distinct ids.
LARGE = 1 << 10
# Distinct pairs a task holds before it hands their counts on.
HELD_PAIRS = 1 << 21
# Rows of the broadcast pair table at most, 17 bytes each.
TABLE = 1 << 20

_CUT = re.compile(f"(?<=[^\\s{SPACE}])(?=[ \n])")
# White space before white space, or a mark that counts as a space.
_ODD = re.compile(f"\\s[ \n]| \r|{SPACE}")


def default_vocabularies() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY_A), public_tokenizers.path(VOCABULARY_B)


def stretches(text: str) -> list[str]:
    """A space and `text`, cut before every space or line end behind anything but white space.

    No token of either vocabulary crosses such a cut, nor does either look
    across it. A name stands for itself behind a space, but for one that begins
    with a line end (itself) or with a carriage return (what follows that).
    """
    if not _ODD.search(" " + text):
        return text.replace("\n", " \n").split(" ")
    parts = _CUT.split(" " + text)
    return [part if part[0] == "\n" else "\r" + part if part[1:2] in ("\n", "\r") else part[1:] for part in parts]


def _written(name: str) -> str:
    return name[1:] if name[:1] == "\r" else name if name[:1] == "\n" else " " + name


class Both:
    """Ids of a text by both vocabularies, cached by stretch, and the bytes of every token."""

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path_a, encoding="utf-8") as source:
            parts = json.load(source)
        cutter = parts["pre_tokenizer"] or {}
        if cutter.get("type") != "ByteLevel" or cutter.get("add_prefix_space") or parts["normalizer"]:
            raise ValueError(f"{path_a}: no plain byte-level vocabulary")
        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = pieces_of(path_b).processor
        back = {char: byte for byte, char in _byte_characters().items()}
        bytes_a = [b""] * self.a.get_vocab_size()
        for token, i in self.a.get_vocab().items():
            bytes_a[i] = bytes(back[c] for c in token) if all(c in back for c in token) else token.encode()
        bytes_b = [
            bytes([int(piece[3:-1], 16)]) if self.b.is_byte(i) else piece.replace(SPACE, " ").encode()
            for i, piece in enumerate(map(self.b.id_to_piece, range(self.b.vocab_size())))
        ]
        self.bytes = bytes_a, bytes_b
        self.lengths = tuple(np.array([len(x) for x in table], np.int64) for table in self.bytes)
        self.ways = len(bytes_b)
        # As narrow as the vocabulary allows.
        self.kinds = tuple(np.dtype(np.uint16 if len(table) <= 1 << 16 else np.uint32) for table in self.bytes)
        # How an id is written: in the midst of its group, and as the last of its vocabulary there.
        self.names = tuple(
            np.array([[f"{i}{mark}" for i in range(len(table))] for mark in marks], object)
            for table, marks in zip(self.bytes, (",|", ",;"))
        )
        # Ids by stretch in two generations: what was not met lately is forgotten.
        self.known: tuple[dict[str, bytes], dict[str, bytes]] = {}, {}
        self.older: tuple[dict[str, bytes], dict[str, bytes]] = {}, {}
        # Stretches whose bytes a vocabulary does not give back.
        self.odd: set[str] = set()

    def _ids(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        a = self.a.encode(text, add_special_tokens=False).ids
        return np.array(a, self.kinds[0]), np.array(self.b.encode(text), self.kinds[1])

    def _gives_back(self, side: int, ids: np.ndarray, raw: bytes) -> bool:
        return b"".join(map(self.bytes[side].__getitem__, ids.tolist())) == raw

    def learn(self, missing: list[str]) -> None:
        """Encode stretches laid end to end, in one call for many of them.

        Where both sides of a stretch's ends are solid the calls give what each
        stretch alone would; the others are encoded alone.
        """
        texts = [_written(name) for name in missing]
        solid = [i for i, text in enumerate(texts) if text[0] in " \n" and not text[-1].isspace() and SPACE not in text]
        block: list[int] = []
        chars = 0
        for i in solid:
            block.append(i)
            chars += len(texts[i])
            if chars >= LEARNED_CHARS:
                self._learn_block([missing[i] for i in block], [texts[i] for i in block])
                block, chars = [], 0
        if block:
            self._learn_block([missing[i] for i in block], [texts[i] for i in block])
        for i in sorted(set(range(len(texts))).difference(solid)):
            self._learn_alone(missing[i], texts[i])

    def _learn_alone(self, name: str, text: str) -> None:
        raw = text.encode()
        for side, ids in enumerate(self._ids(text)):
            self.known[side][name] = ids.tobytes()
            if not self._gives_back(side, ids, raw):
                self.odd.add(name)

    def _learn_block(self, names: list[str], texts: list[str]) -> None:
        parts = [text.encode() for text in texts]
        stops = np.cumsum([len(part) for part in parts])
        whole = b"".join(parts)
        for side, ids in enumerate(self._ids(whole.decode())):
            ends = self.lengths[side][ids].cumsum()
            at = np.searchsorted(ends, stops, "left")
            if not self._gives_back(side, ids, whole) or (ends[at] != stops).any():
                for name, text in zip(names, texts):
                    self._learn_alone(name, text)
                return
            raw, known = ids.tobytes(), self.known[side]
            edges = [0, *((at + 1) * ids.itemsize).tolist()]
            for name, start, stop in zip(names, edges, edges[1:]):
                known[name] = raw[start:stop]

    def __call__(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Per vocabulary: the ids of all texts in a row, and where each text's end.

        A text whose bytes a vocabulary does not give back has none.
        """
        cut = [stretches(text) if text else [] for text in texts]
        words = list(chain.from_iterable(cut))
        names = list(dict.fromkeys(words))
        place = dict(zip(names, range(len(names))))
        if len(self.known[0]) + len(names) > CACHED:
            self.older, self.known = self.known, ({}, {})
        missing = []
        for name in place.keys() - self.known[0].keys():
            if name in self.older[0]:
                for side in (0, 1):
                    self.known[side][name] = self.older[side][name]
            else:
                missing.append(name)
        self.learn(missing)
        codes = np.fromiter(map(place.__getitem__, words), np.int64, len(words))
        bounds = np.concatenate([[0], np.cumsum([len(part) for part in cut], dtype=np.int64)])
        odd = np.fromiter((name in self.odd for name in names), bool, len(names)) if self.odd else np.zeros(len(names), bool)
        faults = np.concatenate([[0], np.cumsum(odd[codes])])
        sound = np.repeat(faults[bounds[1:]] == faults[bounds[:-1]], np.diff(bounds))
        out = []
        for known, kind in zip(self.known, self.kinds):
            parts = list(map(known.__getitem__, names))
            sizes = np.fromiter(map(len, parts), np.int64, len(parts)) // kind.itemsize
            pool, starts = np.frombuffer(b"".join(parts), kind), np.cumsum(sizes) - sizes
            counts = np.where(sound, sizes[codes], 0)
            stops = np.concatenate([[0], np.cumsum(counts)])
            at = np.repeat(starts[codes] - stops[:-1], counts) + np.arange(stops[-1])
            out.append((pool[at], stops[bounds]))
        # Long stretches are not worth remembering.
        for name in missing:
            if len(name) > CACHED_LENGTH:
                del self.known[0][name], self.known[1][name]
                self.odd.discard(name)
        return out


def both_of(path_a: str, path_b: str) -> Both:
    """The worker's pair of vocabularies."""
    return kept(("both", path_a, path_b), lambda: Both(path_a, path_b))


def merge_path(a: np.ndarray, b: np.ndarray, work: int = PIECE) -> np.ndarray:
    """Where the merge of two rising arrays stands every `work` steps: rows (i, j), both ends included.

    All diagonals i + j = d are searched at once. Of equal values that of `a` comes first.
    """
    total = len(a) + len(b)
    d = np.append(np.arange(0, total, work), total)
    low, high = np.maximum(0, d - len(b)), np.minimum(d, len(a))
    while (low < high).any():
        middle = (low + high) // 2
        live = low < high
        # a[middle] belongs before b[d - 1 - middle]: the cut is further along a.
        further = np.zeros(len(d), bool)
        further[live] = a[middle[live]] <= b[d[live] - 1 - middle[live]]
        low, high = np.where(live & further, middle + 1, low), np.where(live & ~further, middle, high)
    return np.column_stack([low, d - low])


def overlaps(a: np.ndarray, b: np.ndarray, i0: int, i1: int, j0: int, j1: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The overlaps that end inside one piece: a's token, b's token, and whether both end there."""
    own_a, own_b = a[i0:i1], b[j0:j1]
    to_b = np.searchsorted(own_b, own_a, "left")
    shut = np.zeros(len(own_a), bool)
    inside = to_b < len(own_b)
    shut[inside] = own_b[to_b[inside]] == own_a[inside]
    to_a = np.searchsorted(own_a, own_b, "left")
    single = np.ones(len(own_b), bool)
    inside = to_a < len(own_a)
    single[inside] = own_a[to_a[inside]] != own_b[inside]
    ends = np.concatenate([own_a, own_b[single]])
    order = np.argsort(ends, kind="stable")
    left = np.concatenate([np.arange(i0, i1), i0 + to_a[single]])[order]
    right = np.concatenate([j0 + to_b, np.arange(j0, j1)[single]])[order]
    return left, right, np.concatenate([shut, np.zeros(int(single.sum()), bool)])[order]


def group_ends(a: np.ndarray, b: np.ndarray, work: int = PIECE) -> tuple[np.ndarray, np.ndarray]:
    """The groups of two token sequences over the same bytes: how many tokens of each end by each group's end.

    `a` and `b` are rising byte ends whose last values are equal. Where a piece
    ends between two equal ends, the first piece has the overlap open and the
    next one begins with b's end alone: the two are one overlap, which is shut.
    """
    cuts = merge_path(a, b, work)
    lefts, rights = [], []
    for (i0, j0), (i1, j1) in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        left, right, shut = overlaps(a, b, i0, i1, j0, j1)
        if i0 and j0 < j1 and b[j0] == a[i0 - 1]:
            # The piece's first overlap has no byte of its own: it shuts the one before.
            left, right, shut = left.copy(), right.copy(), shut.copy()
            left[0], right[0], shut[0] = i0 - 1, j0, True
        lefts.append(left[shut] + 1)
        rights.append(right[shut] + 1)
    if not lefts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(lefts), np.concatenate(rights)


class Aligned:
    """The groups and links of a slice of documents, laid end to end."""

    def __init__(self, both: Both, side_a: tuple[np.ndarray, np.ndarray], side_b: tuple[np.ndarray, np.ndarray]):
        (a, stops_a), (b, stops_b) = side_a, side_b
        self.n_a, self.n_b = np.diff(stops_a), np.diff(stops_b)
        self.a, self.b = a.astype(np.int64), b.astype(np.int64)
        ends_a, ends_b = both.lengths[0][self.a].cumsum(), both.lengths[1][self.b].cumsum()
        # Documents end at common ends, so no group reaches over two of them.
        self.stop_a, self.stop_b = group_ends(ends_a, ends_b)
        self.start_a, self.start_b = np.append(0, self.stop_a)[:-1], np.append(0, self.stop_b)[:-1]
        self.doc = np.searchsorted(self.n_a.cumsum(), self.start_a, "right")
        self.ways, self.names = both.ways, both.names
        self.pairs = len(both.bytes[0]) * both.ways
        self.docs = len(self.n_a)

    def links(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, id pair, links) once per document and pair, in that order."""
        wide_a, wide_b = self.stop_a - self.start_a, self.stop_b - self.start_b
        small = wide_a * wide_b <= LARGE
        sizes = (wide_a * wide_b)[small]
        first = np.repeat(sizes.cumsum() - sizes, sizes)
        within = np.arange(int(sizes.sum())) - first
        ways = np.repeat(wide_b[small], sizes)
        pair = self.a[np.repeat(self.start_a[small], sizes) + within // ways] * self.ways
        pair += self.b[np.repeat(self.start_b[small], sizes) + within % ways]
        # A document and a pair in one number; a slice has far fewer documents than that allows.
        key = np.repeat(self.doc[small], sizes) * self.pairs + pair
        keys, times = [], []
        for g in np.flatnonzero(~small):
            ids_a, times_a = np.unique(self.a[self.start_a[g] : self.stop_a[g]], return_counts=True)
            ids_b, times_b = np.unique(self.b[self.start_b[g] : self.stop_b[g]], return_counts=True)
            keys.append((ids_a[:, None] * self.ways + ids_b).ravel() + self.doc[g] * self.pairs)
            times.append((times_a[:, None] * times_b).ravel())
        key.sort()
        if not len(key) and not keys:
            return key, key, key
        starts = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
        key, n = key[starts], np.diff(np.append(starts, len(key)))
        if keys:
            key, place = np.unique(np.concatenate([key, *keys]), return_inverse=True)
            n = _added(place, np.concatenate([n, *times]), len(key))
        return key // self.pairs, key % self.pairs, n

    def written(self) -> list[str]:
        """Each document's groups as `a1,a2|b1;a3|b2,b3`."""
        last_a, last_b = np.zeros(len(self.a), np.int64), np.zeros(len(self.b), np.int64)
        last_a[self.stop_a - 1] = last_b[self.stop_b - 1] = 1
        # Every token's place: all tokens of earlier groups, then a's before b's.
        group_a = np.repeat(np.arange(len(self.stop_a)), self.stop_a - self.start_a)
        group_b = np.repeat(np.arange(len(self.stop_b)), self.stop_b - self.start_b)
        place_a = np.arange(len(self.a)) + self.start_b[group_a]
        place_b = np.arange(len(self.b)) + self.stop_a[group_b]
        tokens = np.empty(len(self.a) + len(self.b), object)
        tokens[place_a], tokens[place_b] = self.names[0][last_a, self.a], self.names[1][last_b, self.b]
        stops = (self.n_a + self.n_b).cumsum().tolist()
        return ["".join(tokens[start:stop])[:-1] for start, stop in zip([0, *stops], stops)]


_ENCODED = "row long, doc_id long, a binary, b binary"


def _encoded(vocabularies: tuple[str, str]):
    """Each document's ids by both vocabularies, side by side in bytes."""

    def rows(batch: pa.RecordBatch, both: Both, texts: list[str]) -> pa.RecordBatch:
        sides = []
        for ids, stops in both(texts):
            offsets = pa.py_buffer((stops * ids.itemsize).astype(np.int32))
            sides.append(pa.Array.from_buffers(pa.binary(), len(texts), [None, offsets, pa.py_buffer(ids)]))
        return pa.RecordBatch.from_arrays([batch.column("row"), batch.column("doc_id"), *sides], names=["row", "doc_id", "a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = both_of(*vocabularies)
        for batch in batches:
            start, chars, texts = 0, 0, []
            for at, text in enumerate(batch.column("body")):
                texts.append(text.as_py() or "")
                chars += len(texts[-1])
                if chars >= SLICE_CHARS or at == batch.num_rows - 1:
                    yield rows(batch.slice(start, at + 1 - start), both, texts)
                    start, chars, texts = at + 1, 0, []

    return run


def _slices(batches: Iterator[pa.RecordBatch], both: Both) -> Iterator[tuple[pa.RecordBatch, Aligned]]:
    """Encoded batches in slices of about SLICE_BYTES of ids, aligned."""
    for batch in batches:
        sides = [bytes_column(batch, name) for name in "ab"]
        for start, stop in slices(sides[0][1] + sides[1][1]):
            parts = []
            for (data, at), kind in zip(sides, both.kinds):
                own = data[at[start] : at[stop]].view(kind)
                parts.append((own, (at[start : stop + 1] - at[start]) // kind.itemsize))
            yield batch.slice(start, stop - start), Aligned(both, *parts)


def _added(place: np.ndarray, what: np.ndarray, size: int) -> np.ndarray:
    """Exact sums of `what` by place."""
    out = np.zeros(size, np.int64)
    np.add.at(out, place, what)
    return out


def _counted(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    pair, n = np.concatenate([p for p, _ in held]), np.concatenate([n for _, n in held])
    names, at = np.unique(pair, return_inverse=True)
    return names, _added(at, n, len(names))


def _pair_counts(vocabularies: tuple[str, str]):
    """(pair, documents that hold it), each pair once per load of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, held, size = both_of(*vocabularies), [], 0
        for _, aligned in _slices(batches, both):
            _, pair, _ = aligned.links()
            names, n = np.unique(pair, return_counts=True)
            held.append((names, n))
            size += len(names)
            if size > HELD_PAIRS:
                held = [_counted(held)]
                size = len(held[0][0])
                if size > HELD_PAIRS // 2:
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in held[0]], names=["pair", "n"])
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in _counted(held)], names=["pair", "n"])

    return run


def encoded(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabularies: tuple[str, str] | None = None
) -> DataFrame:
    """row, doc_id, a, b: the ids of every row by both vocabularies, in native byte order.

    Ids take two bytes where the vocabulary allows, else four; `row` numbers
    the rows once the result is written.
    """
    texts = docs.select(
        F.monotonically_increasing_id().alias("row"),
        col_(id_col).cast("long").alias("doc_id"),
        col_(text_col).cast("string").alias("body"),
    )
    return texts.mapInArrow(_encoded(vocabularies or default_vocabularies()), _ENCODED)


def linked_pairs(ids: DataFrame, vocabularies: tuple[str, str] | None = None) -> DataFrame:
    """(a_id, b_id, n, best) of all id pairs linked in `encoded` documents: n of them hold the pair.

    `best` marks the pairs whose count is the highest of their a_id, ties included.
    """
    chosen = vocabularies or default_vocabularies()
    ways = both_of(*chosen).ways
    seen = ids.select("a", "b").mapInArrow(_pair_counts(chosen), "pair long, n long")
    counts = seen.groupBy("pair").agg(F.sum("n").alias("n"))
    counts = counts.select(F.floor(F.col("pair") / ways).cast("long").alias("a_id"), (F.col("pair") % ways).alias("b_id"), "n")
    # One row per id of the first vocabulary: as bounded as the vocabulary.
    staged = Scratch(ids.sparkSession, "linked-pairs").stage(counts, "counts")
    highest = staged.groupBy("a_id").agg(F.max("n").alias("highest"))
    return staged.join(F.broadcast(highest), "a_id").select("a_id", "b_id", "n", (F.col("n") == F.col("highest")).alias("best"))


_PARTS = (
    "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, "
    "groups_sha256 string, pairs array<long>, times array<long>"
)


def _parted(vocabularies: tuple[str, str], table):
    """Per document: its groups, the counts of its frequent links, and its other pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = both_of(*vocabularies)
        names, counts, best = table.value
        for rows, slice_ in _slices(batches, both):
            doc, pair, times = slice_.links()
            at = np.minimum(np.searchsorted(names, pair), max(len(names) - 1, 0))
            known = names[at] == pair if len(names) else np.zeros(len(pair), bool)
            hit, at = doc[known], at[known]
            total = lambda who, what: _sums(who, what, slice_.docs)
            n_links = total(doc, times)
            count_sum = total(hit, times[known] * counts[at])
            n_best = total(hit, np.where(best[at], times[known], 0))
            rare = np.concatenate([[0], np.bincount(doc[~known], minlength=slice_.docs).cumsum()]).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(rare), pa.array(x[~known])) for x in (pair, times)]
            digests = [hashlib.sha256(text.encode()).hexdigest() if text else "" for text in slice_.written()]
            whole = [slice_.n_a, slice_.n_b, np.bincount(slice_.doc, minlength=slice_.docs), n_links, n_best, count_sum]
            yield pa.RecordBatch.from_arrays(
                [rows.column("row"), rows.column("doc_id"), *[pa.array(x.astype(np.int64)) for x in whole],
                 pa.array(digests, pa.string()), *lists],
                names=[part.split()[0] for part in _PARTS.split(", ")],
            )

    return run


def _sums(who: np.ndarray, what: np.ndarray, docs: int) -> np.ndarray:
    """Exact sums of `what` by rising `who`."""
    ends = np.concatenate([[0], what.cumsum()])
    edges = np.searchsorted(who, np.arange(docs + 1), "left")
    return ends[edges[1:]] - ends[edges[:-1]]


def aligned_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabularies: tuple[str, str] | None = None
) -> DataFrame:
    """One row per row of `docs`: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    Byte offsets where tokens of both vocabularies end cut a text (behind one
    space) into groups, and every token of the first is linked to every token
    of the second in its group. Null and empty texts, and those whose joined
    token bytes differ from the text's, have no tokens: zeros and ''. Rows that
    repeat an id or a text count each; a null id stays null; other columns are
    ignored; an empty table gives no rows. A very long text is one merge like
    any other, in pieces of equal work; its tokens are held by one task.
    """
    spark, chosen = docs.sparkSession, vocabularies or default_vocabularies()
    ways = both_of(*chosen).ways
    scratch = Scratch(spark, "alignment")
    # Written once: row numbers are fixed then, and no text is encoded again.
    ids = scratch.stage(encoded(docs, id_col, text_col, chosen), "ids")
    counted = linked_pairs(ids, chosen)
    table = scratch.stage(counted.select((F.col("a_id") * ways + F.col("b_id")).alias("pair"), "n", "best"), "pairs")
    common = frequent(table, "n", TABLE).toArrow().sort_by("pair")
    known = tuple(column.to_numpy() for column in common.columns)

    parts = scratch.stage(ids.mapInArrow(_parted(chosen, spark.sparkContext.broadcast(known)), _PARTS), "documents")
    scratch.drop("ids")
    rare = parts.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("e")).select(
        "row", F.col("e.pairs").alias("pair"), F.col("e.times").alias("times")
    )
    met = (
        rare.join(table, "pair")
        .groupBy("row")
        .agg(
            F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("more_best"),
            F.sum(F.col("times") * F.col("n")).alias("more_count"),
        )
    )
    return parts.drop("pairs", "times").join(met, "row", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links",
        (F.col("n_best") + F.coalesce("more_best", F.lit(0))).alias("n_best"),
        (F.col("count_sum") + F.coalesce("more_count", F.lit(0))).alias("count_sum"),
        "groups_sha256",
    )


def op12_token_alignment(spark, sf_dir):
    return aligned_documents(read_table(spark, sf_dir, "documents"))
