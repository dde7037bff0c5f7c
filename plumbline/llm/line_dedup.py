"""Line dedup: a deletion-neighbourhood join on hashed keys, in DataFrame functions.

Two lines of MIN_WORDS words or more are near when one word inserted, removed
or replaced turns one into the other. Each line emits a key for itself and one
for itself without each word; lines that meet on a key are verified, and the
earliest stays. Equal lines need no variants.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from plumbline.functions.columns import col_
from plumbline.llm.common import Scratch, marked_by, read_table

MIN_WORDS = 5
SPACES = " \t\r\x0b\f"


def _trimmed(line: Column) -> Column:
    """A line's words with one space between them."""
    odd = line.contains("  ")
    for space in SPACES[1:]:
        odd = odd | line.contains(space)
    return F.trim(F.when(odd, F.regexp_replace(line, r"[ \t\r\x0B\f]+", " ")).otherwise(line))


def _hash(*parts: Column) -> Column:
    """128 bits of a text or of several values."""
    return F.struct(F.xxhash64(*parts).alias("x"), F.xxhash64(F.lit(1), *parts).alias("y"))


def _n_words(line: Column) -> Column:
    return F.length(line) - F.length(F.replace(line, F.lit(" "), F.lit(""))) + 1


def _first(line: Column, n: Column) -> Column:
    """The first n words."""
    return F.call_function("substring_index", line, F.lit(" "), n)


def _last(line: Column, n: Column) -> Column:
    return F.when(n > 0, F.call_function("substring_index", line, F.lit(" "), -n)).otherwise("")


def occurrences(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc, text_key, line_no, line) of every line with a word in it."""
    text = F.coalesce(col_(text_col).cast("string"), F.lit(""))
    rows = docs.select(
        F.coalesce(col_(id_col).cast("long"), F.lit((1 << 63) - 1)).alias("doc"),
        F.xxhash64(text).alias("text_key"),
        F.posexplode(F.split(text, "\n")).alias("line_no", "raw"),
    )
    # Not asked of the trimmed line, which would then be cut twice.
    rows = rows.where(F.ltrim("raw", F.lit(SPACES)) != "")
    return rows.withColumn("line", _trimmed(F.col("raw"))).drop("raw")


def _half_keys() -> Column:
    """Keys of which two near lines share one: they agree before or after their middle.

    A line of n words answers for the pairs of length (n, n) and (n, n + 1),
    and as the longer one for (n - 1, n), with the shorter one's middle.
    """
    line, n = F.col("line"), F.col("n")
    middle, shorter = F.floor(n / 2).cast("int"), F.floor((n - 1) / 2).cast("int")
    own = [
        F.xxhash64(F.lit("head"), n, _first(line, middle)),
        F.xxhash64(F.lit("tail"), n, _last(line, n - middle)),
    ]
    longer = [
        F.xxhash64(F.lit("head"), n - 1, _first(line, shorter)),
        F.xxhash64(F.lit("tail"), n - 1, _last(line, n - 1 - shorter)),
    ]
    return F.when(n > MIN_WORDS, F.array(*own, *longer)).otherwise(F.array(*own))


def _variants(texts: DataFrame) -> DataFrame:
    """(id, at, key) of every whole line, at -1, and of it without each word.

    A key is the exclusive or of hashes of (word, position), twice 64 bits. To
    leave out word i + 1 instead of word i changes one position, i, so all keys
    of a line are one running scan and no variant is ever spelled out.
    """

    def xor(a: Column, b: Column) -> Column:
        return a.bitwiseXOR(b)

    def every(hashes: str) -> Column:
        return F.aggregate(hashes, F.lit(0).cast("long"), xor)

    def scan(start: Column, steps: Column) -> Column:
        return F.aggregate(steps, F.array(start), lambda keys, step: F.concat(keys, F.array(xor(F.element_at(keys, -1), step))))

    def hashed(words: Column, seed: int) -> Column:
        return F.transform(words, lambda word, i: F.xxhash64(F.lit(seed), word, i))

    rows = texts.select("id", F.split("line", " ").alias("words"))
    for seed, half in enumerate("xy"):
        # As they stand, and one place earlier: what follows a word left out.
        later = F.slice("words", F.lit(2), F.size("words"))
        rows = rows.withColumns({f"own_{half}": hashed(F.col("words"), seed), f"early_{half}": hashed(later, seed)})
    keys = []
    for half in "xy":
        own, early = f"own_{half}", f"early_{half}"
        steps = F.zip_with(F.slice(own, F.lit(1), F.size(early)), early, xor)
        keys.append(F.concat(F.array(every(own)), scan(every(early), steps)))
    pairs = F.zip_with(*keys, lambda x, y: F.struct(x.alias("x"), y.alias("y")))
    return rows.select("id", F.posexplode(pairs).alias("at", "key")).withColumn("at", F.col("at") - 1)


def _one_edit(a: Column, b: Column) -> Column:
    """Whether two lines are at most one word apart."""
    x, y = F.split(a, " "), F.split(b, " ")
    longest = F.greatest(F.size(x), F.size(y))

    def agreeing(p: Column, q: Column) -> Column:
        differs = F.array_position(F.zip_with(p, q, lambda u, v: ~u.eqNullSafe(v)), True)
        return F.when(differs == 0, longest).otherwise(differs - 1)

    return (F.abs(F.size(x) - F.size(y)) <= 1) & (agreeing(x, y) + agreeing(F.reverse(x), F.reverse(y)) >= longest - 1)


def _among(rows: DataFrame, key: Column, keys: DataFrame) -> DataFrame:
    """The rows whose key is in `keys` (one column only); those that the key filter clears are not shuffled."""
    maybe = marked_by(rows, key, keys, "maybe").where("maybe").drop("maybe")
    return maybe.join(keys.select(F.col(keys.columns[0]).alias("among")), key == F.col("among"), "left_semi")


def duplicate_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, Scratch]:
    """(doc, text_key, line_no) of the lines that go: an earlier line is equal or near.

    Earlier means a smaller (id, hash of the text, line number), so rows that
    share an id are told apart by their texts; null ids come last. Lines
    without words are never removed; lines of fewer than MIN_WORDS words only
    by equal ones.
    """
    scratch = Scratch(docs.sparkSession, "line-dedup")
    lines = occurrences(docs, id_col, text_col).withColumn("k", _hash(F.col("line")))
    n = _n_words(F.col("line")).cast("int")
    # The half keys are kept, not the lines: a line is read again only once it
    # has a possible partner.
    halves = F.when(F.col("n") >= MIN_WORDS, _half_keys())
    every = lines.withColumn("n", n).withColumn("halves", halves).drop("line")
    every = scratch.stage(every, "occurrences")
    place = F.struct("doc", "text_key", "line_no").alias("place")
    distinct = every.groupBy("k").agg(F.min(F.struct(place, "n", "halves")).alias("f"), F.count(F.lit(1)).alias("copies"))
    distinct = scratch.stage(distinct.select("k", "f.place", "f.n", "f.halves", "copies"), "distinct")

    # Halves, and keys of variants below, are counted alone and met with their lines
    # only where two share them, which few do: a line goes by 64 bits until then.
    halves = distinct.where("halves IS NOT NULL").select(F.col("k.x").alias("x"), F.explode("halves").alias("half"))
    shared = scratch.stage(halves.groupBy("half").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("half"), "shared")
    partnered = _among(halves, F.col("half"), shared).select("x").distinct()
    partnered = scratch.stage(partnered, "partnered")
    placed = scratch.stage(_among(distinct.select("k", "place"), F.col("k.x"), partnered), "placed")
    spots = placed.select("place.doc", "place.text_key", "place.line_no", "k", "place")
    maybe = marked_by(lines, F.col("k"), placed.select("k"), "maybe").where("maybe").drop("maybe")
    texts = maybe.select("doc", "text_key", "line_no", "k", "line").join(spots, ["doc", "text_key", "line_no", "k"])
    texts = texts.select("k", "place", "line").dropDuplicates(["k"]).withColumn("id", F.monotonically_increasing_id())
    texts = scratch.stage(texts, "texts")

    keyed = scratch.stage(_variants(texts), "variants")
    twice = keyed.groupBy(F.col("key.x").alias("x")).agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("x")
    twice = scratch.stage(twice, "twice")
    rows = _among(keyed, F.col("key.x"), twice).join(texts.select("id", "place"), "id").select("place", "at", "key")
    rows = scratch.stage(rows, "meeting")
    # On a key, lines without the same word position replace a word; a whole
    # line meets any line that is it with one word more.
    met = rows.groupBy("key").agg(F.min("place").alias("any"), F.min(F.when(F.col("at") == -1, F.col("place"))).alias("whole"))
    same = rows.where("at >= 0").groupBy("key", "at").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("c")).where("c > 1")
    partner = F.when(F.col("at") == -1, F.col("any")).otherwise(F.col("whole"))
    across = rows.join(met, "key").select("place", partner.alias("partner"))
    replaced = rows.join(same, ["key", "at"]).select("place", F.col("first").alias("partner"))
    pairs = across.union(replaced).where("partner IS NOT NULL AND partner < place")
    pairs = pairs.groupBy("place").agg(F.min("partner").alias("partner"))

    own = texts.select("place", "k", "line")
    other = texts.select(F.col("place").alias("partner"), F.col("line").alias("earlier"))
    near = pairs.join(own, "place").join(other, "partner").where(_one_edit(F.col("line"), F.col("earlier"))).select("k", F.lit(True).alias("near"))
    near = scratch.stage(near.distinct(), "near")
    scratch.drop("variants", "twice", "meeting", "texts", "placed", "partnered", "shared")

    likely = marked_by(distinct.select("k", "place", "copies"), F.col("k"), near.select("k"), "maybe").where("copies > 1 OR maybe")
    facts = likely.join(near, "k", "left").where("copies > 1 OR near").select("k", "place", F.coalesce("near", F.lit(False)).alias("near"))
    facts = scratch.stage(facts, "facts")
    again = marked_by(every.select("doc", "text_key", "line_no", "k"), F.col("k"), facts.select("k"), "maybe").where("maybe").join(facts, "k")
    gone = again.where(F.col("near") | (F.struct("doc", "text_key", "line_no") > F.col("place"))).select("doc", "text_key", "line_no")
    gone = scratch.stage(gone.distinct(), "gone")
    scratch.keep_only("gone")
    return gone, scratch


def _row_key(docs: DataFrame, id_col: str, text_col: str) -> tuple[Column, Column, Column]:
    """A row's id and text hash as in `duplicate_lines`, and its text."""
    text = F.coalesce(col_(text_col).cast("string"), F.lit(""))
    return F.coalesce(col_(id_col).cast("long"), F.lit((1 << 63) - 1)), F.xxhash64(text), text


def _removed_numbers(gone: DataFrame) -> DataFrame:
    return gone.groupBy("doc", "text_key").agg(F.array_sort(F.collect_list("line_no")).alias("removed"))


def drop_duplicate_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) of every row, without its duplicate lines.

    Null texts are empty; rows that repeat id and text lose the same lines; no
    rows give no rows. Only texts that may lose a line are shuffled.
    """
    gone, _ = duplicate_lines(docs, id_col, text_col)
    doc, text_key, text = _row_key(docs, id_col, text_col)
    rows = docs.select(col_(id_col).cast("long").alias("doc_id"), doc.alias("doc"), text_key.alias("text_key"), text.alias("text"))
    keys = gone.select(F.xxhash64("doc", "text_key").alias("key"))
    flagged = marked_by(rows, F.xxhash64("doc", "text_key"), keys, "loses")
    met = flagged.where("loses").join(_removed_numbers(gone), ["doc", "text_key"], "left")
    removed = F.coalesce("removed", F.array().cast("array<int>"))
    kept = F.filter(F.split("text", "\n"), lambda line, i: ~F.array_contains(removed, i))
    return flagged.where(~F.col("loses")).select("doc_id", "text").union(met.select("doc_id", F.array_join(kept, "\n")))


def line_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: doc_id, n_lines, n_removed and the removed line numbers.

    Lines are counted where the text is read; no text is shuffled for it.
    """
    gone, _ = duplicate_lines(docs, id_col, text_col)
    doc, text_key, text = _row_key(docs, id_col, text_col)
    n_lines = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1
    rows = docs.select(
        col_(id_col).cast("long").alias("doc_id"), doc.alias("doc"), text_key.alias("text_key"), n_lines.cast("long").alias("n_lines")
    )
    removed = F.coalesce("removed", F.array().cast("array<int>"))
    return rows.join(_removed_numbers(gone), ["doc", "text_key"], "left").select(
        "doc_id",
        "n_lines",
        F.size(removed).cast("long").alias("n_removed"),
        F.array_join(F.transform(removed, lambda i: i.cast("string")), ",").alias("removed_lines"),
    )


def op6_line_dedup(spark, sf_dir):
    return line_report(read_table(spark, sf_dir, "documents"))
