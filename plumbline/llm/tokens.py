"""Token ids of texts by a tokenizer file: distinct words are looked up, new ones encoded."""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from plumbline.llm.common import bytes_column, slices

VOCABULARY = "word_bpe_49k.json"
END = 2
# Texts are encoded in slices of about this many bytes (one longer text is one
# slice). Word parts an encoder remembers, besides those of the last slice, and
# the longest of them.
SLICE = 4 << 20
CACHED_PARTS = 200_000
CACHED_LENGTH = 64

# White space that counts as a space.
_SPACES = bytes(32 if byte in b"\n\t\r" else byte for byte in range(256))

# Words whose lower-casing and splitting need no Unicode tables: printable
# ASCII and the letters of Latin-1. Their parts are the fixed pattern of the
# vocabulary's own pre-tokenizer, which no other word is cut by here. A line end
# stands between words; its "id" is none of any vocabulary.
_PLAIN = re.compile("[!-~À-ÖØ-öø-ÿ\n]*")
_PARTS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ\n]+|\n")
_BREAK = 0xFFFFFFFF
# Put before a word that is no part but goes through the tokenizer whole.
_WHOLE = "\r"


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def _byte_characters() -> dict[int, str]:
    """The characters that byte-level vocabularies write bytes as.

    Printable ones stand for themselves; the others follow from 256 on.
    """
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(rest)}


def _is_plain(words: str) -> bool:
    return "<|" not in words and _PLAIN.fullmatch(words) is not None


def _distinct(texts: pa.Array) -> tuple[list[str], pa.Array]:
    """The distinct ones of texts without spaces, and the place of each text among them."""
    coded = texts.dictionary_encode()
    # Joined and split: much faster than a Python string made of each row.
    rows = pa.ListArray.from_arrays([0, len(coded.dictionary)], coded.dictionary)
    return pc.binary_join(rows, pa.scalar(" ", pa.large_string()))[0].as_py().split(" "), coded.indices


class Encoder:
    """Encodes whole texts. No token of this vocabulary spans white space, so a
    text's ids are those of its words in a row; each distinct word of a slice is
    cut once, each distinct part of them looked up once. A plain word's ids are
    those of its parts; any other word goes through the tokenizer whole. Ids are
    little-endian 32-bit numbers.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.characters = _byte_characters()
        self.fixed = {"": b"", "\n": _BREAK.to_bytes(4, "little")}
        self.parts = dict(self.fixed)

    def _part(self, part: str) -> bytes:
        if part[0] == _WHOLE:
            ids = self.tokenizer.encode(part[1:], add_special_tokens=False).ids
        else:
            # Printable ASCII is written as itself.
            written = part if part.isascii() else part.encode().decode("latin-1").translate(self.characters)
            ids = [token.id for token in self.model.tokenize(written)]
        return array("I", ids).tobytes()

    def _known(self, distinct: list[str]) -> pa.Array:
        """The ids of each part. Beyond CACHED_PARTS only these stay known, and long ones never."""
        parts = self.parts
        for part in distinct:
            if part not in parts:
                parts[part] = self._part(part)
        raws = list(map(parts.__getitem__, distinct))
        if len(parts) > CACHED_PARTS:
            self.parts = parts = dict(zip(distinct, raws)) | self.fixed
        for part in distinct:
            if len(part) > CACHED_LENGTH:
                del parts[part]
        return pa.array(raws, pa.large_binary())

    def _words(self, words: list[str]) -> pa.Array:
        """The ids of each word."""
        joined = "\n".join(words)
        order = None
        if _is_plain(joined):
            found = _PARTS.findall(joined.lower())
        else:
            plain = np.fromiter(map(_is_plain, words), bool, len(words))
            order = np.argsort(~plain, kind="stable")
            odd = [_WHOLE + words[i] for i in np.flatnonzero(~plain)]
            found = _PARTS.findall("".join([words[i] + "\n" for i in np.flatnonzero(plain)]).lower())
            found += "\n".join(odd).replace("\n", " \n ").split(" ")
        distinct, places = _distinct(pc.split_pattern(pa.array([" ".join(found)], pa.large_string()), " ").flatten())
        ids = np.frombuffer(self._known(distinct).take(places).buffers()[2], "<u4")
        breaks = np.flatnonzero(ids == _BREAK)
        ids = ids[ids != _BREAK]
        ends = 4 * np.concatenate([[0], breaks - np.arange(len(breaks)), [len(ids)]])
        out = pa.Array.from_buffers(pa.large_binary(), len(words), [None, pa.py_buffer(ends), pa.py_buffer(ids)])
        return out if order is None else out.take(pa.array(np.argsort(order)))

    def _slice(self, data: bytes, at: np.ndarray) -> tuple[memoryview, list[int]]:
        """The ids of consecutive texts, and where those of each begin and end."""
        buffers = [None, pa.py_buffer(at), pa.py_buffer(data.translate(_SPACES))]
        split = pc.split_pattern(pa.Array.from_buffers(pa.large_string(), len(at) - 1, buffers), " ")
        words, places = _distinct(split.flatten())
        ids = self._words(words).take(places)
        _, ends, raw = ids.buffers()
        ends = np.frombuffer(ends, np.int64, len(ids) + 1)
        return memoryview(raw), ends[split.offsets.to_numpy()].tolist()

    def each(self, texts: pa.Array) -> Iterator[bytes]:
        """The ids of each text in order; null counts as empty."""
        data, at = bytes_column(pa.RecordBatch.from_arrays([texts.fill_null("") if texts.null_count else texts], ["text"]), "text")
        raw = None
        for start, stop in slices(at, SLICE):
            bounds = at[start : stop + 1]
            raw, ends = self._slice(data[bounds[0] : bounds[-1]].tobytes(), bounds - bounds[0])
            for x, y in zip(ends, ends[1:]):
                yield raw[x:y].tobytes()
        # Else Arrow keeps what the slices took, and a worker grows from stage to stage.
        del raw
        pa.default_memory_pool().release_unused()

    def __call__(self, text: str) -> bytes:
        return next(self.each(pa.array([text], pa.string())))


def encoder(path: str) -> Encoder:
    """A task's encoder for a vocabulary file, which goes when the task ends.

    Loading takes a small part of a task's time; kept from task to task, its
    memory would add to that of every later stage.
    """
    return Encoder(path)
