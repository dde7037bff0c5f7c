"""Token counts: pieces are counted once per distinct pre-token, then joined.

A pre-token is a stretch of text that no piece of the vocabulary reaches out
of, so a text's token count is the sum over its pre-tokens. Ids are never made
for a document: its pre-token frequencies meet the table of distinct
pre-tokens, the frequent ones (a bounded dictionary) on the spot, all others in
a shuffled join.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from plumbline.functions.columns import col_
from plumbline.functions.worker import kept
from plumbline.llm.common import Scratch, read_table
from plumbline.llm.frequent import frequent

VOCABULARY = "piece_bpe_32k.model"
LIMIT = 4096
# Distinct pre-tokens a task holds before it hands them on, and their characters.
HELD_TOKENS = 200_000
HELD_CHARS = 16_000_000
# Entries of the broadcast dictionary at most; an entry has LONG characters at most.
DICTIONARY = 200_000
LONG = 64
# Pre-tokens longer than this are cut wherever the vocabulary allows.
WHOLE = 32

SPACE = "▁"
# Marks of a pre-token that does not begin with a space of its own: the rest of
# a long one, and the digest of one over LONG characters.
REST, DIGEST = SPACE + "\n", SPACE + "\r"

_SEGMENT = re.compile(f"\n[^ {SPACE}\n]*|[ {SPACE}]+[^ {SPACE}\n]*|[^ {SPACE}\n]+")
_ODD = re.compile(f"[ \n]{{2}}|{SPACE}")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


class Pieces:
    """The piece vocabulary of a file: where texts may be cut, and counts of the cuts."""

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as protos

        model = protos.ModelProto()
        with open(path, "rb") as source:
            model.ParseFromString(source.read())
        spec, trainer = model.normalizer_spec, model.trainer_spec
        pieces = [p.piece for p in model.pieces if p.type == p.NORMAL]
        # Pairs of neighbours inside a piece: no merge joins any other two.
        self.pairs = {pair for piece in pieces for pair in zip(piece, piece[1:])}
        sound = (
            trainer.model_type == trainer.BPE
            and trainer.byte_fallback
            and not trainer.treat_whitespace_as_suffix
            and not spec.precompiled_charsmap
            and spec.add_dummy_prefix
            and spec.escape_whitespaces
            and not spec.remove_extra_whitespaces
            and not any(p.type in (p.USER_DEFINED, p.UNUSED) for p in model.pieces)
            and not any((b == SPACE and a != SPACE) or "\n" in (a, b) for a, b in self.pairs)
        )
        if not sound:
            raise ValueError(f"{path}: no byte-fallback BPE whose pieces end before spaces and at line ends")
        # The same pieces without the space that is put before every text.
        model.normalizer_spec.add_dummy_prefix = False
        self.processor = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())

    def cut(self, token: str) -> list[str]:
        """A long pre-token in the shortest pieces that no merge joins."""
        raw, start, out = literal(token), 0, []
        for at in range(1, len(raw)):
            if (raw[at - 1], raw[at]) not in self.pairs:
                out.append(raw[start:at])
                start = at
        out.append(raw[start:])
        return [REST + part for part in out]

    def tokens(self, text: str) -> list[str]:
        """The pre-tokens of a text, in order.

        A name without a mark stands for itself behind one space, the form of
        most words.
        """
        if not text:
            return []
        if text[0] in " \n" or _ODD.search(text):
            names = []
            for part in _SEGMENT.findall(" " + text):
                if part[0] in " ▁":
                    spaced = part.replace(" ", SPACE)
                    names.append(spaced[1:] if len(part) > 1 and spaced[1] != SPACE else spaced)
                else:
                    names.append(part if part[0] == "\n" else REST + part)
        else:
            names = text.replace("\n", " \n").split(" ")
            if not names[-1]:
                names[-1] = SPACE
        if len(text) > WHOLE * len(names) or max(map(len, names)) > WHOLE:
            names = [part for name in names for part in (self.cut(name) if len(name) > WHOLE else (name,))]
        return names

    def counts(self, texts: list[str]) -> list[int]:
        """The number of tokens of each literal text."""
        return [len(ids) for ids in self.processor.encode(texts, num_threads=1)]


def literal(token: str) -> str:
    """The characters a pre-token stands for."""
    if token.startswith(REST):
        return token[2:]
    return token if token[:1] in (SPACE, "\n") else SPACE + token


def key_of(token: str) -> str:
    """What a pre-token is joined by: itself, or the SHA-256 of a long one."""
    if len(token) <= LONG:
        return token
    return DIGEST + hashlib.sha256(token.encode()).hexdigest()


def pieces_of(path: str) -> Pieces:
    """The worker's vocabulary of a file."""
    return kept(("pieces", path), lambda: Pieces(path))


_DISTINCT = pa.schema([("key", pa.string()), ("long_text", pa.string()), ("n", pa.int64())])


def _distinct(path: str):
    """(key, text of a long pre-token, occurrences), each pre-token once per load of a task."""

    def rows(held: Counter) -> pa.RecordBatch:
        names = list(held)
        longs = [name if len(name) > LONG else None for name in names]
        return pa.RecordBatch.from_arrays(
            [pa.array(map(key_of, names), pa.string()), pa.array(longs, pa.string()), pa.array(held.values(), pa.int64())],
            schema=_DISTINCT,
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, held, chars = pieces_of(path), Counter(), 0
        for batch in batches:
            for text in batch.column("body"):
                body = text.as_py() or ""
                held.update(pieces.tokens(body))
                chars += len(body)
                # Characters held are bounded by those read.
                if len(held) > HELD_TOKENS or (chars > HELD_CHARS and sum(map(len, held)) > HELD_CHARS):
                    yield rows(held)
                    held, chars = Counter(), 0
        if held:
            yield rows(held)

    return run


def _counted(path: str):
    """(key, n, pieces) of distinct pre-tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = pieces_of(path)
        for batch in batches:
            pairs = zip(batch.column("key").to_pylist(), batch.column("long_text").to_pylist())
            counts = pieces.counts([literal(key if text is None else text) for key, text in pairs])
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), batch.column("n"), pa.array(counts, pa.int64())], names=["key", "n", "pieces"]
            )

    return run


_PARTS = "row long, doc_id long, n_bytes long, known long, keys array<string>, times array<long>"
_PARTS_ARROW = pa.schema(
    [("row", pa.int64()), ("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("known", pa.int64()),
     ("keys", pa.list_(pa.string())), ("times", pa.list_(pa.int64()))]
)


def _parted(path: str, dictionary):
    """Per document: tokens of its frequent pre-tokens, and the others with their frequencies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, known = pieces_of(path), dictionary.value
        for batch in batches:
            sums, keys, times = [], [], []
            for text in batch.column("body"):
                total, rare, often = 0, [], []
                for token, n in Counter(pieces.tokens(text.as_py() or "")).items():
                    key = token if len(token) <= LONG else key_of(token)
                    count = known.get(key)
                    if count is None:
                        rare.append(key)
                        often.append(n)
                    else:
                        total += count * n
                sums.append(total)
                keys.append(rare)
                times.append(often)
            own = [batch.column("row"), batch.column("doc_id"), batch.column("n_bytes"), pa.array(sums, pa.int64())]
            yield pa.RecordBatch.from_arrays(
                [*own, pa.array(keys, pa.list_(pa.string())), pa.array(times, pa.list_(pa.int64()))], schema=_PARTS_ARROW
            )

    return run


def token_counts(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, limit: int = LIMIT
) -> DataFrame:
    """One row per row of `docs`: doc_id, n_bytes, n_tokens, over_limit.

    n_tokens is the number of ids the vocabulary's own library gives for the
    whole text, without begin or end. Null and empty texts have none; rows that
    repeat an id or a text are counted each; a null id stays null; other
    columns are ignored; an empty table gives no rows. A very long text is cut
    into pre-tokens like any other, and a very long pre-token wherever no piece
    of the vocabulary holds the two neighbouring characters. The vocabulary is
    a .model file of byte-fallback BPE; any other kind raises ValueError.
    """
    path = vocabulary or default_vocabulary()
    spark = docs.sparkSession
    scratch = Scratch(spark, "token-counts")
    texts = docs.select(
        col_(id_col).cast("long").alias("doc_id"), F.coalesce(col_(text_col).cast("string"), F.lit("")).alias("body")
    )
    seen = texts.select("body").mapInArrow(_distinct(path), "key string, long_text string, n long")
    distinct = seen.groupBy("key", "long_text").agg(F.sum("n").alias("n"))
    table = scratch.stage(distinct.mapInArrow(_counted(path), "key string, n long, pieces long"), "pre-tokens")

    common = frequent(table, "n", DICTIONARY).select("key", "pieces").toArrow()
    dictionary = spark.sparkContext.broadcast(dict(zip(*(column.to_pylist() for column in common.columns))))
    # The written row numbers are fixed, whatever a repeated task would give.
    rows = texts.select(
        F.monotonically_increasing_id().alias("row"), "doc_id", F.octet_length("body").cast("long").alias("n_bytes"), "body"
    )
    parts = scratch.stage(rows.mapInArrow(_parted(path, dictionary), _PARTS), "documents")
    rare = parts.select("row", F.explode(F.arrays_zip("keys", "times")).alias("e")).select(
        "row", F.col("e.keys").alias("key"), F.col("e.times").alias("times")
    )
    met = rare.join(table.select("key", "pieces"), "key").groupBy("row").agg(F.sum(F.col("times") * F.col("pieces")).alias("more"))
    n_tokens = F.col("known") + F.coalesce("more", F.lit(0))
    return parts.select("row", "doc_id", "n_bytes", "known").join(met, "row", "left").select(
        "doc_id", "n_bytes", n_tokens.alias("n_tokens"), (n_tokens > limit).alias("over_limit")
    )


def op13_token_counts(spark, sf_dir):
    return token_counts(read_table(spark, sf_dir, "documents"))
