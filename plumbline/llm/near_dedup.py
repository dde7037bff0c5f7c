"""Near duplicates: HyperMinHash registers, banding, estimate, exact confirmation.

A document's set is its distinct shingles of five words. Its signature keeps,
per bucket of the shingle hashes, the leading zeros and ten mantissa bits of
the smallest hash. Bands of registers give candidates, the estimate corrected
for chance collisions drops hopeless ones, and the rest is confirmed on the
full sets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from plumbline.functions.columns import col_
from plumbline.llm.common import (
    Scratch, bytes_column, marked_by, mixed, read_table, slices, stage, text_bytes, without_rows, word_hashes,
)
from plumbline.llm.components import components

SHINGLE = 5
PERCENT = 85
BANDS, ROWS = 32, 6
REGISTERS = BANDS * ROWS
MANTISSA = 10
EMPTY = np.uint16(0xFFFF)
# An estimate this many standard errors under the bound drops a candidate.
ERRORS = 5.0
# Buckets are compared in cells of at most about this many members.
CELL = 256

_WORDS = np.arange(256, dtype=np.uint8)
_WORDS[0] = 255  # no UTF-8 text has this byte; 0 marks separators here
_WORDS[65:91] += 32
_WORDS[[9, 10, 11, 12, 13, 32]] = 0

_STEP = np.uint64(0xD6E8FEB86659FD93)


def shingle_sets(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of consecutive texts, sorted by text and hash."""
    words, text = word_hashes(data, at, _WORDS)
    count = np.bincount(text, minlength=len(at) - 1)
    hashes, owners = [], []
    if len(words) >= SHINGLE:
        rolled = np.zeros(len(words) - SHINGLE + 1, np.uint64)
        for j in range(SHINGLE):
            rolled = rolled * _STEP + words[j : len(words) - SHINGLE + 1 + j]
        inside = text[: len(rolled)] == text[SHINGLE - 1 :]
        hashes.append(rolled[inside])
        owners.append(text[: len(rolled)][inside])
    for k in np.flatnonzero((count > 0) & (count < SHINGLE)):
        first = int(np.searchsorted(text, k))
        whole = np.full(1, count[k], np.uint64)
        for j in range(count[k]):
            whole = whole * _STEP + words[first + j : first + j + 1]
        hashes.append(whole)
        owners.append(np.array([k]))
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h, owner = mixed(np.concatenate(hashes)), np.concatenate(owners)
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    return h[new], owner[new]


def registers(h: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """The HyperMinHash registers of `n` sets: 6 bits of leading zeros, MANTISSA bits."""
    bucket = ((h >> np.uint64(48)) * np.uint64(REGISTERS)) >> np.uint64(16)
    low = np.full(n * REGISTERS, 1 << 48, np.uint64)
    np.minimum.at(low, owner * REGISTERS + bucket.astype(np.int64), h & np.uint64((1 << 48) - 1))
    empty = low == np.uint64(1 << 48)
    _, exponent = np.frexp(low.astype(np.float64))
    length = np.where(low > 0, exponent, 0).astype(np.uint64)
    zeros = np.uint64(48) - np.minimum(length, np.uint64(48))
    shifted = (low << zeros) & np.uint64((1 << 47) - 1)  # without the leading one
    packed = (zeros << np.uint64(MANTISSA)) | (shifted >> np.uint64(47 - MANTISSA))
    out = packed.astype(np.uint16)
    out[empty] = EMPTY
    return out.reshape(n, REGISTERS)


def band_keys(signature: np.ndarray) -> np.ndarray:
    """One 64-bit key per band; 0 for a band whose registers are all empty."""
    parts = signature.reshape(len(signature), BANDS, ROWS)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) * _STEP, parts.shape[:2]).copy()
    for j in range(ROWS):
        key = mixed(key * _STEP + parts[:, :, j].astype(np.uint64))
    key[(parts == EMPTY).all(2)] = 0
    return key


def estimate(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Jaccard estimates, corrected for registers equal by chance, and used registers.

    Two registers of unrelated sets agree with probability about
    0.68 * n m / (n + m)^2 / 2^MANTISSA, from the cells' widths.
    """
    filled = ((a != EMPTY) | (b != EMPTY)).sum(-1)
    same = ((a == b) & (a != EMPTY)).sum(-1)
    n, m = n_a.astype(np.float64), n_b.astype(np.float64)
    chance = 0.68 * n * m / np.maximum(n + m, 1) ** 2 / (1 << MANTISSA)
    share = same / np.maximum(filled, 1)
    return (share - chance) / (1 - chance), filled


def hopeful(a, b, n_a, n_b, percent: int) -> np.ndarray:
    """Pairs that the estimate and the set sizes leave possible."""
    guess, used = estimate(a, b, n_a, n_b)
    bound = percent / 100
    error = np.sqrt(bound * (1 - bound) / np.maximum(used, 1))
    sized = 100 * np.minimum(n_a, n_b) >= percent * np.maximum(n_a, n_b)
    return (guess >= bound - ERRORS * error) & sized


def _digest(body: Column) -> Column:
    return F.unhex(F.sha2(body, 256))


def signatures(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, digest of the text, n_shingles, set_key, registers, bands) of every row."""
    source = docs.select(col_(id_col).cast("long").alias("doc_id"), text_bytes(col_(text_col)).alias("body"))
    source = source.withColumn("digest", _digest(F.col("body")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = bytes_column(batch, "body")
            for start, stop in slices(at):
                n = stop - start
                h, owner = shingle_sets(data[at[start] : at[stop]], at[start : stop + 1])
                size = np.bincount(owner, minlength=n)
                cut = np.concatenate(([0], np.cumsum(size)))
                raw = h.astype("<u8").tobytes()
                keys = [hashlib.blake2b(raw[8 * a : 8 * b], digest_size=16).digest() if b > a else None for a, b in zip(cut[:-1], cut[1:])]
                signature = registers(h, owner, n)
                bands = band_keys(signature).view(np.int64)
                flat = pa.FixedSizeListArray.from_arrays(pa.array(bands.ravel()), BANDS).cast(pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(start, n),
                        batch.column("digest").slice(start, n),
                        pa.array(size.astype(np.int64)),
                        pa.array(keys, pa.binary()),
                        pa.array([row.tobytes() for row in signature], pa.binary()),
                        flat,
                    ],
                    ["doc_id", "digest", "n_shingles", "set_key", "registers", "bands"],
                )

    return source.mapInArrow(run, "doc_id long, digest binary, n_shingles long, set_key binary, registers binary, bands array<long>")


def _matrix(rows: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(rows.to_numpy()), np.uint16).reshape(len(rows), REGISTERS)


def _likely(percent: int):
    """(a, b, registers and sizes of both) -> (a, b) that the estimate admits."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for start in range(0, len(frame), 5000):
                part = frame.iloc[start : start + 5000]
                ok = hopeful(
                    _matrix(part["registers_a"]), _matrix(part["registers_b"]),
                    part["n_a"].to_numpy(), part["n_b"].to_numpy(), percent,
                )
                yield part.loc[ok, ["a", "b"]]

    return run


def _beside(pairs: DataFrame, facts: DataFrame) -> DataFrame:
    """`pairs` (a, b) with the columns of `facts`, by id, for either side."""
    for end in ("a", "b"):
        names = [F.col(name).alias(f"{name}_{end}") for name in facts.columns if name != "id"]
        pairs = pairs.join(facts.select(F.col("id").alias(end), *names), end)
    return pairs


_STAR = "a long, b long, n_a long, n_b long, linked boolean, minus binary, plus binary"


def _compare(percent: int):
    """(a, b, bodies of both) -> whether they are linked, and b's set as changes to a's.

    `minus` are the places, in a's sorted set, of what b lacks; `plus` are the
    hashes that b has beyond it.
    """
    schema = pa.schema(
        [
            ("a", pa.int64()), ("b", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()),
            ("linked", pa.bool_()), ("minus", pa.binary()), ("plus", pa.binary()),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = [bytes_column(batch, name) for name in ("body_a", "body_b")]
            for start, stop in slices(sides[0][1] + sides[1][1]):
                n = stop - start
                (h_a, o_a), (h_b, o_b) = [shingle_sets(data[at[start] : at[stop]], at[start : stop + 1]) for data, at in sides]
                n_a, n_b = np.bincount(o_a, minlength=n), np.bincount(o_b, minlength=n)
                in_b, in_a = _members(h_a, o_a, h_b, o_b), _members(h_b, o_b, h_a, o_a)
                shared = np.bincount(o_a[in_b], minlength=n)
                linked = (100 * shared >= percent * (n_a + n_b - shared)) & (shared > 0)
                place = (np.arange(len(o_a)) - np.concatenate(([0], np.cumsum(n_a)[:-1]))[o_a]).astype("<i4")
                minus, plus = place[~in_b], h_b[~in_a].astype("<u8")
                cut_minus = np.concatenate(([0], np.cumsum(n_a - shared)))
                cut_plus = np.concatenate(([0], np.cumsum(n_b - shared)))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("a").slice(start, n), batch.column("b").slice(start, n),
                        pa.array(n_a.astype(np.int64)), pa.array(n_b.astype(np.int64)), pa.array(linked),
                        pa.array([minus[x:y].tobytes() for x, y in zip(cut_minus[:-1], cut_minus[1:])], pa.binary()),
                        pa.array([plus[x:y].tobytes() for x, y in zip(cut_plus[:-1], cut_plus[1:])], pa.binary()),
                    ],
                    schema=schema,
                )

    return run


def _members(h: np.ndarray, owner: np.ndarray, other: np.ndarray, other_owner: np.ndarray) -> np.ndarray:
    """Which (owner, hash) are among the others; both sorted by owner and hash."""
    both, owners = np.concatenate((h, other)), np.concatenate((owner, other_owner))
    order = np.lexsort((both, owners))
    twice = (both[order][1:] == both[order][:-1]) & (owners[order][1:] == owners[order][:-1])
    found = np.zeros(len(both), bool)
    found[order[1:][twice]] = True
    found[order[:-1][twice]] = True
    return found[: len(h)]


def _links_of(percent: int):
    """Links between two parts of a star's members, from their changes to the centre.

    |x and y| = n - |x lacks or y lacks| + |x adds and y adds|, counted for all
    pairs at once by matrix products over places and over shared additions.
    One call holds several small stars, or one pair of parts of a large one.
    """

    def counted(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
        """|x_i and y_j| for all i, j, over values that occur on both sides."""
        flat_x, flat_y = np.concatenate(x), np.concatenate(y)
        out = np.zeros((len(x), len(y)), np.float32)
        shared = np.intersect1d(flat_x, flat_y)
        if not len(shared):
            return out
        row_x, row_y = np.repeat(np.arange(len(x)), [len(v) for v in x]), np.repeat(np.arange(len(y)), [len(v) for v in y])
        # No wider than what is shared: most stars are small.
        width = min(len(shared), max(1, (1 << 22) // (len(x) + len(y))))
        at_x, at_y = np.searchsorted(shared, flat_x), np.searchsorted(shared, flat_y)
        is_x = shared[np.minimum(at_x, len(shared) - 1)] == flat_x
        is_y = shared[np.minimum(at_y, len(shared) - 1)] == flat_y
        for low in range(0, len(shared), width):
            left, right = np.zeros((len(x), width), np.float32), np.zeros((len(y), width), np.float32)
            pick = is_x & (at_x >= low) & (at_x < low + width)
            left[row_x[pick], at_x[pick] - low] = 1
            pick = is_y & (at_y >= low) & (at_y < low + width)
            right[row_y[pick], at_y[pick] - low] = 1
            out += left @ right.T
        return out

    def between(rows: dict[str, np.ndarray], first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
        """(a, b) of links between the rows at two lists of places."""
        comp_x, comp_y = rows["comp"][first], rows["comp"][second]
        apart = comp_x[:, None] != comp_y[None, :]
        n_x, n_y = rows["n_b"][first][:, None], rows["n_b"][second][None, :]
        apart &= 100 * np.minimum(n_x, n_y) >= percent * np.maximum(n_x, n_y)
        if not apart.any():
            return None
        across, down = np.flatnonzero(apart.any(1)), np.flatnonzero(apart.any(0))
        minus_x = [np.frombuffer(v, "<i4") for v in rows["minus"][first[across]]]
        minus_y = [np.frombuffer(v, "<i4") for v in rows["minus"][second[down]]]
        plus_x = [np.frombuffer(v, "<u8") for v in rows["plus"][first[across]]]
        plus_y = [np.frombuffer(v, "<u8") for v in rows["plus"][second[down]]]
        lacks_x, lacks_y = np.array([len(v) for v in minus_x])[:, None], np.array([len(v) for v in minus_y])[None, :]
        lacking = lacks_x + lacks_y - counted(minus_x, minus_y)
        shared = rows["n_a"][first[0]] - lacking + counted(plus_x, plus_y)
        union = n_x[across] + n_y[:, down] - shared
        i, j = np.nonzero((100 * shared >= percent * union) & (shared > 0) & apart[np.ix_(across, down)])
        x, y, p, q = rows["b"][first[across[i]]], rows["b"][second[down[j]]], comp_x[across[i]], comp_y[down[j]]
        # One link joins two components; the others between them say nothing new.
        _, once = np.unique(np.stack((np.minimum(p, q), np.maximum(p, q))), axis=1, return_index=True)
        return np.minimum(x, y)[once], np.maximum(x, y)[once]

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        rows = {name: frame[name].to_numpy() for name in frame.columns}
        order = np.lexsort((rows["column"], rows["row"], rows["a"]))
        new = np.zeros(len(order), bool)
        for name in ("a", "row", "column"):
            new[1:] |= rows[name][order][1:] != rows[name][order][:-1]
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        for cell in np.split(order, np.flatnonzero(new)):
            row, column, part = rows["row"][cell[0]], rows["column"][cell[0]], rows["part"][cell]
            first = cell[part == row]
            links = between(rows, first, first if row == column else cell[part == column])
            if links is not None:
                found.append(links)
        return pd.DataFrame({"a": np.concatenate([a for a, _ in found]), "b": np.concatenate([b for _, b in found])}).astype("int64")

    return run


def _with_component(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """`pairs` (a, b) with the component of b so far."""
    known = found.select(F.col("id").alias("b"), F.col("component_id").alias("known"))
    return pairs.join(known, "b", "left").withColumn("comp", F.coalesce("known", "b")).drop("known")


def _open_pairs(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """The stars whose members, but for the centre, are in several components."""
    placed = _with_component(pairs, found)
    mixed_up = placed.groupBy("a").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low <> high")
    return pairs.join(mixed_up.select("a"), "a")


def _more_links(stars: DataFrame, found: DataFrame, percent: int) -> DataFrame:
    """Links between members of one star that are in different components so far.

    Any two documents that share a bucket are members of its smallest member's
    star, so nothing that banding proposes is left out. Large stars are cut
    into parts of about CELL members, and each pair of parts is a cell.
    """
    placed = _with_component(stars.drop("linked"), found)
    sizes = placed.groupBy("a").agg(F.count(F.lit(1)).alias("size"))
    sizes = sizes.select("a", F.ceil(F.col("size") / CELL).cast("int").alias("parts"))
    rows = placed.join(sizes, "a").withColumn("part", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int"))
    cells = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumns(
        {"row": F.least("part", "other"), "column": F.greatest("part", "other")}
    )
    # Small stars share a group, a large one's cells have one each.
    group = F.when(F.col("parts") == 1, F.pmod(F.xxhash64("a"), F.lit(4096))).otherwise(F.xxhash64("a", "row", "column"))
    return cells.withColumn("cell", group).groupBy("cell").applyInPandas(_links_of(percent), "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """One row per row of `docs`: doc_id, n_shingles, component_id, kept.

    Two documents are linked when 100 * |intersection| >= percent * |union| of
    their shingle sets; component_id is the smallest doc_id reachable over
    links, and kept says that it is the row's own. A document without words,
    empty or null, has an empty set and is linked with nothing. Equal sets are
    one class before banding. Rows that repeat an id are documents of their
    own, linked by their texts alone. A null id is linked with nothing, has a
    null component and is kept. Other columns are ignored; no rows give no rows.
    """
    out = _grouped(docs, id_col, text_col, percent)
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def _grouped(docs: DataFrame, id_col: str, text_col: str, percent: int) -> DataFrame:
    """doc_id, digest, n_shingles, component_id and root of every row.

    The root names the row's group, and is null where the group is the row alone.
    """
    scratch = Scratch(docs.sparkSession, "near-dedup")
    table = scratch.stage(signatures(docs, id_col, text_col), "signatures")
    ids = scratch.stage(table.select("doc_id", "digest", "n_shingles", "set_key"), "ids")
    usable = table.where(F.col("doc_id").isNotNull() & F.col("set_key").isNotNull())
    classes = usable.groupBy("set_key").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("copies"))
    classes = scratch.stage(classes.withColumn("id", F.col("first")), "classes")
    # A class goes by its smallest doc_id, or by a number where others have that id too.
    clash = not classes.groupBy("first").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty()
    if clash:
        classes = scratch.stage(classes.withColumn("id", F.monotonically_increasing_id()), "numbered")
    chosen = usable.join(classes.select("set_key", "id", "first"), "set_key").where("doc_id = first").dropDuplicates(["id"])
    bands = scratch.stage(chosen.select("id", F.explode("bands").alias("key")).where("key <> 0"), "bands")
    leaders = bands.groupBy("key").agg(F.min("id").alias("a"), F.count(F.lit(1)).alias("size")).where("size > 1")
    pairs = bands.join(leaders, "key").where("id <> a").select("a", F.col("id").alias("b")).distinct()
    pairs = scratch.stage(pairs, "pairs")
    ends = scratch.stage(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct(), "ends")
    sketches = scratch.stage(chosen.join(ends, "id").select("id", F.col("n_shingles").alias("n"), "registers", "digest"), "sketches")
    wanted = scratch.stage(sketches.select("id", "digest"), "wanted")
    sketches = sketches.drop("digest")
    scratch.drop("signatures", "bands")

    hoped = _beside(pairs, sketches).mapInPandas(_likely(percent), "a long, b long")
    hoped = scratch.stage(hoped, "hoped")
    bodies = docs.select(col_(id_col).cast("long").alias("doc_id"), text_bytes(col_(text_col)).alias("body"))
    bodies = bodies.where("doc_id IS NOT NULL").select(_digest(F.col("body")).alias("digest"), "body")
    maybe = marked_by(bodies, F.col("digest"), wanted.select("digest"), "maybe").where("maybe").drop("maybe")
    texts = scratch.stage(maybe.join(wanted, "digest").select("id", "body").dropDuplicates(["id"]), "texts")
    compared = _beside(hoped, texts).mapInArrow(_compare(percent), _STAR)
    links = scratch.stage(compared.where("linked").select("a", "b"), "links")
    found = scratch.stage(components(links), "first-components")
    stars = _beside(_open_pairs(pairs, found), texts).mapInArrow(_compare(percent), _STAR)
    stars = scratch.stage(stars, "stars")
    scratch.drop("texts", "ends", "wanted", "pairs", "sketches", "hoped", "links")
    more = scratch.stage(_more_links(stars, found, percent), "more-links")
    scratch.drop("stars")
    if not more.isEmpty():
        found = components(found.select(F.col("id").alias("a"), F.col("component_id").alias("b")).union(more))
        found = scratch.stage(found, "components")
    scratch.keep_only("ids", "classes", "numbered", "first-components", "components")
    found = found.withColumnRenamed("component_id", "root")
    groups = classes.join(found, "id", "left").where("copies > 1 OR root IS NOT NULL")
    groups = groups.select("set_key", F.coalesce("root", "id").alias("root"), "first")
    if clash:
        groups = groups.join(groups.groupBy("root").agg(F.min("first").alias("smallest")), "root")
    else:
        groups = groups.withColumn("smallest", F.col("root"))
    # Rows without an id have a set too, but are in no group.
    out = ids.join(groups.drop("first"), "set_key", "left")
    with_id = F.col("doc_id").isNotNull()
    component = F.when(with_id, F.coalesce("smallest", "doc_id")).alias("component_id")
    return out.select("doc_id", "digest", "n_shingles", component, F.when(with_id, F.col("root")).alias("root"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """The rows of `docs` that stay, one document of each group, with their columns.

    It is the one of the smallest id; of a repeated id, the first by digest.
    """
    members = _grouped(docs, id_col, text_col, percent).where("root IS NOT NULL")
    members = stage(members.groupBy("root", "doc_id", "digest").agg(F.count(F.lit(1)).alias("n")), "near-members")
    stay = members.groupBy("root").agg(F.min(F.struct("doc_id", "digest")).alias("row")).select("root", "row.*", F.lit(True).alias("once"))
    verdicts = members.join(stay, ["root", "doc_id", "digest"], "left").where("once IS NULL OR n > 1")
    verdicts = verdicts.select("doc_id", "digest", F.coalesce("once", F.lit(False)).alias("once"))
    key = [col_(id_col).cast("long"), _digest(text_bytes(col_(text_col)))]
    return without_rows(docs, key, stage(verdicts, "near-gone"))


def op2_minhash_near_dedup(spark, sf_dir):
    return near_duplicates(read_table(spark, sf_dir, "documents"))
