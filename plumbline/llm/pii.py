"""Personal data: fixed patterns, and a character tagger for what they miss.

The tagger is trained on a bounded sample of windows whose spans the patterns
label, some rewritten the way people obscure addresses and numbers. It reads
overlapping windows around every digit and at-sign of the whole text; each
character takes its tag from the window it lies deepest in.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from plumbline.functions.columns import col_
from plumbline.llm.common import read_table
from plumbline.llm.tagger import PADDING, Tagger, classes

KINDS = ("email", "ip", "card", "phone")
# The training sample: at most so many documents and windows of each.
SAMPLE_DOCS = 3000
SAMPLE_WINDOWS = 3000
WINDOWS_PER_DOC = 4
WINDOW, OVERLAP, CONTEXT = 64, 24, 24
DECODED = 512

_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A number starts where no digit precedes it, so each run is tried once.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGITS = re.compile(r"[^0-9]+")
_TRIGGER = re.compile(r"[0-9@]|[\[(]at[\])]")

Span = tuple[int, int, int]  # start, kind, end


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = 2 * d - 9 if d > 4 else 2 * d
        total += d
    return total % 10 == 0


def _emails(text: str) -> list[Span]:
    """Leftmost addresses, found from their at-signs."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            out.append((start, 0, found.end()))
            done = found.end()
        at = text.find("@", max(at + 1, done))
    return out


def base_spans(text: str) -> list[Span]:
    """What the fixed patterns find, by start and then kind."""
    out = _emails(text)
    for found in _IP.finditer(text):
        if all(int(part) <= 255 if len(part) < 10 else not int(part.lstrip("0")[:10] or 0) > 255 for part in found[0].split(".")):
            out.append((found.start(), 1, found.end()))
    for found in _CARD.finditer(text):
        digits = _DIGITS.sub("", found[0])
        if 12 <= len(digits) <= 19 and _luhn(digits):
            out.append((found.start(), 2, found.end()))
    if "+" in text:
        for found in _PHONE.finditer(text):
            if 9 <= len(_DIGITS.sub("", found[0])) <= 15:
                out.append((found.start(), 3, found.end()))
    return sorted(out)


# -- the tagger's training data --------------------------------------------------


def _tags(length: int, spans: list[Span]) -> np.ndarray:
    """Begin and inside tags; where spans of two kinds overlap, the first stays."""
    tags = np.zeros(length, np.int64)
    for start, kind, end in spans:
        start, stop = max(start, 0), min(end, length)
        if start < stop and not tags[start:stop].any():
            tags[start:stop] = 2 + 2 * kind
            tags[start] = 1 + 2 * kind
    return tags


def _obscured(value: str, kind: int, rng: np.random.Generator) -> str:
    """A value written so that its pattern misses it."""
    if kind == 0:
        at, dot = (("[at]", "[dot]"), ("(at)", "(dot)"), (" [at] ", " [dot] "), (" @ ", "."))[rng.integers(4)]
        return value.replace("@", at).replace(".", dot)
    if kind == 1:
        return value.replace(".", (" . ", "[.]")[rng.integers(2)])
    if kind == 2:
        digits = _DIGITS.sub("", value)
        return (".", "/", "  ")[rng.integers(3)].join(digits[i : i + 4] for i in range(0, len(digits), 4))
    return ("00", "+ ", "tel:00")[rng.integers(3)] + value[1:].replace("-", ("/", " ", "-")[rng.integers(3)])


def _examples(text: str, seed: int) -> list[tuple[str, list[int]]]:
    """Some windows of a text with their tags."""
    rng = np.random.default_rng(seed % (1 << 32))
    spans, out = base_spans(text), []
    places = [spans[i] for i in rng.permutation(len(spans))[:WINDOWS_PER_DOC]] if spans else []
    triggers = [m.start() for m in _TRIGGER.finditer(text)]
    if triggers:
        at = triggers[rng.integers(len(triggers))]
        places.append((at, -1, at + 1))
    for start, kind, end in places:
        shift = int(rng.integers(0, WINDOW - 8))
        low = max(0, start - shift)
        piece = text[low : low + WINDOW]
        inside = [(s - low, k, e - low) for s, k, e in spans if s < low + WINDOW and e > low]
        if kind >= 0 and rng.random() < 0.4 and len(inside) == 1:
            value = _obscured(text[start:end], kind, rng)
            piece = (text[low:start] + value + text[end : end + WINDOW])[:WINDOW]
            inside = [(start - low, kind, start - low + len(value))]
        out.append((piece, _tags(len(piece), inside).tolist()))
    return out


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Tagger | None:
    """A tagger from at most SAMPLE_WINDOWS windows of SAMPLE_DOCS documents.

    The documents are those with the smallest hashes of id and text among all that
    hold a digit or an at-sign. None where the sample has no labelled span.
    """
    text = col_(text_col).cast("string")
    order = F.xxhash64(col_(id_col).cast("string"), F.substring(text, 1, 200))
    chosen = docs.where(text.rlike("[0-9][0-9]|@")).select(order.alias("h"), text.alias("body")).orderBy("h", F.length("body")).limit(SAMPLE_DOCS)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(h, piece, tags) for h, body in zip(frame["h"], frame["body"]) for piece, tags in _examples(body, int(h))]
            yield pd.DataFrame(rows, columns=["h", "piece", "tags"])

    found = chosen.mapInPandas(run, "h long, piece string, tags array<int>").orderBy("h", "piece", "tags").limit(SAMPLE_WINDOWS).collect()
    if not any(any(row["tags"]) for row in found):
        return None
    x, y = np.full((len(found), WINDOW), PADDING, np.int64), np.zeros((len(found), WINDOW), np.int64)
    for i, row in enumerate(found):
        coded = classes(row["piece"])
        x[i, : len(coded)] = coded
        y[i, : len(coded)] = row["tags"]
    return Tagger(len(KINDS)).fit(x, y).single()


# -- decoding --------------------------------------------------------------------


def _windows(text: str) -> list[tuple[int, int, int, int]]:
    """(start, stop, first owned, last owned + 1) of the windows of a text.

    Regions around triggers are covered by windows that overlap; each half of
    an overlap belongs to the window it is deeper in.
    """
    regions: list[list[int]] = []
    for found in _TRIGGER.finditer(text):
        low, high = max(0, found.start() - CONTEXT), min(len(text), found.end() + CONTEXT)
        if regions and low <= regions[-1][1]:
            regions[-1][1] = high
        else:
            regions.append([low, high])
    out = []
    for low, high in regions:
        at = low
        while True:
            stop = min(at + WINDOW, high)
            first = at if at == low else at + OVERLAP // 2
            last = stop if stop == high else stop - OVERLAP // 2
            out.append((at, stop, first, last))
            if stop == high:
                break
            at += WINDOW - OVERLAP
    return out


def _spans_of(tags: np.ndarray, low: int) -> list[Span]:
    out, i = [], 0
    while i < len(tags):
        if tags[i]:
            kind, j = (int(tags[i]) - 1) // 2, i + 1
            while j < len(tags) and tags[j] == 2 + 2 * kind:
                j += 1
            out.append((low + i, kind, low + j))
            i = j
        else:
            i += 1
    return out


def _believable(value: str, kind: int) -> bool:
    """What a found span must have to be reported."""
    digits = _DIGITS.sub("", value)
    if kind == 0:
        # White space only around an at-sign or a dot, however those are written.
        if re.search(r"\s", re.sub(r"\s*(?:@|[\[(]at[\])]|[\[(]dot[\])]|\.)\s*", "", value)):
            return False
        return len(value) >= 6 and ("@" in value or "[at]" in value or "(at)" in value) and ("." in value or "dot" in value)
    if kind == 1:
        parts = [p for p in re.split(r"[^0-9]+", value) if p]
        return len(parts) == 4 and all(len(p) <= 3 and int(p) <= 255 for p in parts) and value.count(".") == 3
    if kind == 2:
        return 12 <= len(digits) <= 19 and _luhn(digits) and not re.search("[A-Za-z]", value)
    return 9 <= len(digits) <= 17 and (value.startswith(("+", "00", "tel"))) and not re.search("[A-Zb-df-km-su-z]", value)


def found_spans(texts: list[str], base: list[list[Span]], tagger: Tagger | None) -> list[list[Span]]:
    """What the tagger adds to each text: spans that touch no base span."""
    out: list[list[Span]] = [[] for _ in texts]
    if tagger is None:
        return out
    jobs = [(i, *window) for i, text in enumerate(texts) for window in _windows(text)]
    tagged = []
    for at in range(0, len(jobs), DECODED):
        part = jobs[at : at + DECODED]
        x = np.full((len(part), WINDOW), PADDING, np.int64)
        for k, (i, low, high, _, _) in enumerate(part):
            coded = classes(texts[i][low:high])
            x[k, : len(coded)] = coded
        tagged += [(job, tags) for job, tags in zip(part, tagger.decode(x))]
    # The owned parts of a region's windows follow each other without a gap.
    k = 0
    while k < len(tagged):
        (i, low, _, first, last), tags = tagged[k]
        start, pieces = first, [tags[first - low : last - low]]
        k += 1
        while k < len(tagged) and tagged[k][0][0] == i and tagged[k][0][3] == last:
            (_, low, _, first, last), tags = tagged[k]
            pieces.append(tags[first - low : last - low])
            k += 1
        for s, kind, e in _spans_of(np.concatenate(pieces), start):
            value = texts[i][s:e]
            s, e = s + len(value) - len(value.lstrip()), e - (len(value) - len(value.rstrip()))
            free = not any(x < e and z > s for x, _, z in base[i])
            if s < e and free and _believable(texts[i][s:e], kind):
                out[i].append((s, kind, e))
    return out


def _listed(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in sorted(spans))


_FOUND = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: counts and digest of the base spans, and all spans.

    Offsets are code points, ends exclusive. Null and empty texts have no
    spans; repeated rows are read each; other columns are ignored; no rows give
    no rows. Without labelled spans in the sample there is no tagger, and the
    base spans are all.
    """
    tagger = train(docs, id_col, text_col)
    source = docs.select(col_(id_col).cast("long").alias("doc_id"), col_(text_col).cast("string").alias("body"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                texts = [value.as_py() or "" for value in part.column("body")]
                base = [base_spans(text) for text in texts]
                added = found_spans(texts, base, tagger)
                counts = np.array([[sum(k == kind for _, k, _ in spans) for kind in range(4)] for spans in base])
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        *[pa.array(counts[:, kind]) for kind in range(4)],
                        pa.array([hashlib.sha256(_listed(spans).encode()).hexdigest() for spans in base]),
                        pa.array([_listed(x + y) for x, y in zip(base, added)]),
                    ],
                    [field.split()[0] for field in _FOUND.split(", ")],
                )

    return source.mapInArrow(run, _FOUND)


def op3_pii(spark, sf_dir):
    return personal_data(read_table(spark, sf_dir, "documents"))
