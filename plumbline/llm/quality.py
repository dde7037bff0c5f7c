"""Quality classifier: positive-unlabelled learning with the non-negative risk.

Trusted positives are labelled rows of quality 1; every document is unlabelled
text; the class prior is estimated from the labelled rows. The model is
logistic over hat functions of text statistics, fitted by Newton steps whose
sums run over all documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from plumbline.functions.columns import col_
from plumbline.llm.common import bytes_column, read_table, slices, stage, text_bytes, word_hashes

FEATURES = (
    "log_words", "upper", "symbols", "shouts", "digits", "bars", "stops", "foreign", "word_length",
    "variety", "echoes", "marked", "breaks", "short_words", "shouted_words",
)
QUANTILES = (0.02, 0.1, 0.25, 0.5, 0.75, 0.9, 0.98)
RIDGE = 1e-4
STEPS = 12
# Partial sums meet in this many groups before the driver adds them up.
GROUPS = 16


def _table(characters: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(characters)] = True
    return table


_CLASSES = {
    "upper": _table(bytes(range(65, 91))),
    "lower": _table(bytes(range(97, 123))),
    "symbols": _table(b"#$%&*@^_~<>={}[]\\/+`"),
    "shouts": _table(b"!?"),
    "digits": _table(bytes(range(48, 58))),
    "bars": _table(b"|;"),
    "stops": _table(b".,"),
    "foreign": _table(bytes(range(192, 255))),
    "breaks": _table(b"\n"),
}
_WORDS = np.arange(256, dtype=np.uint8)
_WORDS[[9, 10, 11, 12, 13, 32]] = 0
_MARKS = _CLASSES["symbols"] | _CLASSES["shouts"] | _CLASSES["bars"]


def text_statistics(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The FEATURES of consecutive texts; all zero for an empty one."""
    n, base = len(at) - 1, at[0]
    size = np.maximum(np.diff(at), 1).astype(np.float64)
    cuts = at - base

    def counted(mask: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate(([0], np.cumsum(mask, dtype=np.int64)))[cuts]).astype(np.float64)

    counts = {name: counted(table[data]) for name, table in _CLASSES.items()}
    hashes, text = word_hashes(data, at, _WORDS)
    words = np.bincount(text, minlength=n).astype(np.float64)
    per_word = np.maximum(words, 1)
    order = np.lexsort((hashes, text))
    first = np.ones(len(order), bool)
    first[1:] = (hashes[order][1:] != hashes[order][:-1]) | (text[order][1:] != text[order][:-1])
    distinct = np.bincount(text[order][first], minlength=n)
    echo = np.zeros(len(hashes), bool)
    echo[1:] = (hashes[1:] == hashes[:-1]) & (text[1:] == text[:-1])
    # Words by their last byte: it stands before a space or at a text's end.
    space = _WORDS[data] == 0
    last = np.zeros(len(data), bool)
    if len(data):
        last[:-1] = ~space[:-1] & space[1:]
        ends = cuts[1:][np.diff(at) > 0] - 1
        last[ends] = ~space[ends]
    start = np.zeros(len(data), bool)
    if len(data):
        start[1:] = ~space[1:] & space[:-1]
        begins = cuts[:-1][np.diff(at) > 0]
        start[begins] = ~space[begins]
    starts, ends = np.flatnonzero(start), np.flatnonzero(last)
    # A text boundary inside a run of letters splits the run, as above.
    if len(starts) == len(ends) == len(text):
        length = ends - starts + 1
        short = np.bincount(text[length <= 3], minlength=n)
        loud = _CLASSES["upper"][data[starts]] & _CLASSES["upper"][data[np.minimum(starts + 1, ends)]] & (length > 1)
        shouted = np.bincount(text[loud], minlength=n)
    else:
        short = shouted = np.zeros(n)
    letters = np.maximum(counts["upper"] + counts["lower"] + counts["foreign"], 1)
    out = np.stack(
        [
            np.log1p(words),
            counts["upper"] / letters,
            counts["symbols"] / size,
            counts["shouts"] / size,
            counts["digits"] / size,
            counts["bars"] / size,
            counts["stops"] / per_word,
            counts["foreign"] / size,
            np.minimum(size / per_word, 100.0),
            np.log(np.maximum(distinct, 1) / per_word),
            np.bincount(text[echo], minlength=n) / per_word,
            counted(last & _MARKS[data]) / per_word,
            np.minimum(counts["breaks"] / per_word, 5.0),
            short / per_word,
            shouted / per_word,
        ],
        axis=1,
    )
    out[words == 0] = 0
    return out.astype(np.float32)


def _statistics_of(batch: pa.RecordBatch, column: str) -> np.ndarray:
    data, at = bytes_column(batch, column)
    parts = [text_statistics(data[at[a] : at[b]], at[a : b + 1]) for a, b in slices(at)]
    return np.concatenate(parts) if parts else np.zeros((0, len(FEATURES)), np.float32)


def statistics_table(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, x): the text statistics of every row, as one float array."""
    source = docs.select(col_(id_col).cast("long").alias("doc_id"), text_bytes(col_(text_col)).alias("body"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = _statistics_of(batch, "body")
            flat = pa.FixedSizeListArray.from_arrays(pa.array(values.ravel()), len(FEATURES)).cast(pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), flat], ["doc_id", "x"])

    return source.mapInArrow(run, "doc_id long, x array<float>")


class Hats:
    """Piecewise linear functions of each statistic, with knots at quantiles."""

    def __init__(self, knots: list[list[float]]):
        self.knots = [np.unique(np.asarray(k, np.float64)) for k in knots]
        self.width = 1 + sum(len(k) for k in self.knots)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros((len(x), self.width))
        out[:, 0] = 1
        at = 1
        for j, knots in enumerate(self.knots):
            value = np.clip(x[:, j].astype(np.float64), knots[0], knots[-1])
            if len(knots) == 1:
                out[:, at] = x[:, j] > knots[0]
            else:
                k = np.clip(np.searchsorted(knots, value, "right") - 1, 0, len(knots) - 2)
                share = (value - knots[k]) / (knots[k + 1] - knots[k])
                rows = np.arange(len(x))
                out[rows, at + k] = 1 - share
                out[rows, at + k + 1] = share
            at += len(knots)
        return out


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * z))


def _sums(table: DataFrame, hats: Hats, weights: np.ndarray) -> np.ndarray:
    """Sums over all rows: [n, n_pos, loss_u, loss_p, grad_u, grad_p, x_p, hessian]."""
    width = hats.width

    def part(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, where = np.zeros(4 + 3 * width + width * width), 0
        for frame in frames:
            if not len(frame):
                continue
            where = int(frame["slot"].iloc[0])
            x = hats(np.stack(frame["x"].to_numpy()))
            trusted = frame["trusted"].to_numpy(bool)
            z = x @ weights
            loss, p = np.logaddexp(0, z), _sigmoid(z)
            total += np.concatenate(
                [
                    [len(x), trusted.sum(), loss.sum(), loss[trusted].sum()],
                    p @ x,
                    p[trusted] @ x[trusted],
                    x[trusted].sum(0),
                    ((x * (p * (1 - p))[:, None]).T @ x).ravel(),
                ]
            )
        yield pd.DataFrame({"slot": [where], "total": [total]})

    def added(frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"total": [np.sum(np.stack(frame["total"].to_numpy()), axis=0)]})

    schema = "slot int, total array<double>"
    marked = table.withColumn("slot", F.pmod(F.spark_partition_id(), F.lit(GROUPS)))
    parts = marked.mapInPandas(part, schema).groupBy("slot").applyInPandas(added, "total array<double>")
    rows = parts.collect()
    return np.sum([np.asarray(row["total"]) for row in rows], axis=0) if rows else np.zeros(4 + 3 * width + width * width)


class QualityModel:
    """Scores texts; made by `fit`."""

    def __init__(self, hats: Hats | None, weights: np.ndarray | None, prior: float):
        self.hats, self.weights, self.prior = hats, weights, prior

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.weights is None or not len(x):
            return np.full(len(x), 0.5)
        return _sigmoid(self.hats(x) @ self.weights)


def training_labels(labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality") -> DataFrame:
    """One row per document that may be learnt from: crc32(id) mod 3 is not 1.

    A document with several label rows is positive if one of them says so.
    Null ids and null labels are left out.
    """
    rows = labels.select(col_(id_col).cast("long").alias("doc_id"), col_(label_col).cast("int").alias("quality"))
    rows = rows.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out(F.col("doc_id")))
    return rows.groupBy("doc_id").agg(F.max("quality").alias("quality"))


def held_out(doc_id):
    """Rows whose labels are never learnt from; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(statistics: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", steps: int = STEPS) -> QualityModel:
    """The minimiser of the non-negative PU risk over all rows of `statistics`.

    prior * R+(trusted) + max(0, R-(unlabelled) - prior * R-(trusted)); while
    the second part is positive this is convex and Newton steps apply; where it
    turns negative, the step goes up its gradient instead. Without a trusted
    positive nothing can be learnt, and every score is 0.5.
    """
    known = training_labels(labels, id_col, label_col)
    counts = known.agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("quality") == 1).cast("int")).alias("positive")).first()
    if not counts["positive"]:
        return QualityModel(None, None, 0.5)
    prior = min(max(counts["positive"] / counts["n"], 0.01), 0.99)
    trusted = known.where("quality = 1").select("doc_id", F.lit(True).alias("trusted"))
    joined = statistics.join(trusted, "doc_id", "left").select("x", F.coalesce("trusted", F.lit(False)).alias("trusted"))
    table = stage(joined, "pu-table")
    cuts = table.select(
        [F.percentile_approx(F.col("x")[j].cast("double"), list(QUANTILES), 2000).alias(f"k{j}") for j in range(len(FEATURES))]
    ).first()
    if cuts["k0"] is None:
        return QualityModel(None, None, prior)
    hats = Hats([cuts[f"k{j}"] for j in range(len(FEATURES))])
    width = hats.width
    weights = np.zeros(width)
    best = np.inf
    ridge = RIDGE * np.eye(width)
    ridge[0, 0] = 1e-9
    for _ in range(steps):
        sums = _sums(table, hats, weights)
        n, n_pos, loss_u, loss_p = sums[:4]
        if not n_pos:
            return QualityModel(None, None, prior)
        grad_u, grad_p, x_p = sums[4:].reshape(-1)[: 3 * width].reshape(3, width)
        hessian = sums[4 + 3 * width :].reshape(width, width) / n + ridge
        negative = loss_u / n - prior * loss_p / n_pos
        if negative < 0:
            weights = weights + 0.5 * np.linalg.solve(hessian, grad_u / n - prior * grad_p / n_pos)
            continue
        gradient = grad_u / n - prior * x_p / n_pos + ridge @ weights
        step = np.linalg.solve(hessian, gradient)
        # Damped while far away, so that flat parts of the risk cannot throw it.
        size = float(np.sqrt(max(step @ hessian @ step, 0)))
        weights = weights - step / (1 + size)
        if abs(best - size) < 1e-7 or size < 1e-4:
            break
        best = size
    return QualityModel(hats, weights, prior)


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """One row per row of `docs`: doc_id, held_out, score, predicted.

    Only the text is an input of the score. Null and empty texts have the
    score of a text without words. Repeated rows score alike; other columns
    are ignored; an empty table gives no rows.
    """
    table = stage(statistics_table(docs, id_col, text_col), "quality-statistics")
    model = fit(table, labels, id_col, label_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.asarray(batch.column("x").flatten()).reshape(batch.num_rows, len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.score(x))], ["doc_id", "score"])

    scored = table.mapInArrow(run, "doc_id long, score double")
    return scored.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def keep_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """The rows of `docs` that the classifier accepts, with their columns.

    The texts are read twice, for the statistics and for the verdict, so that
    no shuffle moves them.
    """
    table = stage(statistics_table(docs, id_col, text_col), "quality-statistics")
    model = fit(table, labels, id_col, label_col)
    names = docs.columns
    taken = "verdict_text"
    while taken in names:
        taken += "_"
    source = docs.withColumn(taken, text_bytes(col_(text_col)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            accepted = model.score(_statistics_of(batch, taken)) >= 0.5
            yield batch.select(names).filter(pa.array(accepted))

    return source.mapInArrow(run, docs.schema)


def op7_quality_classifier(spark, sf_dir):
    return quality_scores(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
