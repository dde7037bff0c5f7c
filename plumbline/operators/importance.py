"""Feature encoding, target preparation, mutual information, forest importance."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import Column, DataFrame, Window, functions as F

from plumbline.dataset import Dataset, Field
from plumbline.functions.columns import local_frame, null_of, stack_columns, text_key, union_all
from plumbline.functions.ordering import exact_quantiles, range_parts
from plumbline.operators.profile import distinct_counts
from plumbline.sources.shared import use_checkpoints

MISSING_CLASS = "__missing__"
MIN_ROWS = 5
BINS = 10
SEED = 42
MAX_DEPTH = 10
# Label dictionaries up to this many characters are numbered per column and
# broadcast; larger ones are range-partitioned and shuffled.
BROADCAST_CHARS = 16_000_000
TARGET = "__target"
# Training sets of more rows are dealt over all cores, with up to so many rows per task.
DEALT_ROWS = 100_000
ROWS_PER_TASK = 2_000_000


# -- E1: label codes ---------------------------------------------------------


def _label(field: Field) -> Column:
    return field.col.cast("string")


def _is_small(ds: Dataset, field: Field, limit: int) -> bool:
    """Is the column's label dictionary known to stay within `limit` characters?"""
    return _distinct(ds)[field.ordinal] * max(field.longest or 0, 24) <= limit


def label_codes(ds: Dataset, fields: list[Field], limit: int = BROADCAST_CHARS) -> DataFrame:
    """ordinal, label, code: each column's labels numbered in sorted order."""
    cells = stack_columns(
        ds.df, [F.struct(F.lit(f.ordinal).alias("ordinal"), _label(f).alias("label")) for f in fields]
    )
    labels = cells.where("label IS NOT NULL").groupBy("ordinal", "label").agg(F.count(F.lit(1)).alias("count"))
    return _numbered(ds, labels, all(_is_small(ds, f, limit) for f in fields))


def _numbered(ds: Dataset, labels: DataFrame, small: bool) -> DataFrame:
    """ordinal, label, count plus the label's position within its ordinal.

    Small columns are numbered by a window per column. Larger ones are
    range-partitioned and checkpointed, so that the number of labels before each
    part can be added to the position inside it.
    """
    if small:
        place = Window.partitionBy("ordinal").orderBy("label")
        return labels.select("ordinal", "label", "count", (F.row_number().over(place) - 1).cast("bigint").alias("code"))
    use_checkpoints(ds.spark)
    parts = range_parts(labels, "ordinal", "label").checkpoint()
    local = Window.partitionBy("ordinal", "part").orderBy("label")
    totals = parts.groupBy("ordinal", "part").agg(F.count(F.lit(1)).alias("size"))
    earlier = Window.partitionBy("ordinal").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("ordinal", "part", F.coalesce(F.sum("size").over(earlier), F.lit(0)).alias("before"))
    # One offset per column and part: as many rows as shuffle partitions.
    return (
        parts.withColumn("at", F.row_number().over(local) - 1)
        .join(F.broadcast(offsets), ["ordinal", "part"])
        .select("ordinal", "label", "count", (F.col("before") + F.col("at")).cast("bigint").alias("code"))
    )


def _distinct(ds: Dataset) -> dict[int, int]:
    return {row["ordinal"]: row["unique_count"] for row in ds.small(distinct_counts, None).collect()}


def _key(field: Field) -> Column:
    """The label as a join key of bounded width."""
    return text_key(_label(field), field.longest)


def _small_labels(ds: Dataset, fields: list[Field]) -> list[Field]:
    """The columns whose dictionaries stay within BROADCAST_CHARS together, smallest first."""
    distinct, left, small = _distinct(ds), BROADCAST_CHARS, []
    sizes = {f.ordinal: distinct[f.ordinal] * max(f.longest or 0, 24) for f in fields}
    for f in sorted(fields, key=lambda f: sizes[f.ordinal]):
        left -= sizes[f.ordinal]
        if left < 0:
            break
        small.append(f)
    return small


def _dictionaries(ds: Dataset, fields: list[Field]) -> dict[int, list[str]]:
    """The sorted labels of small columns by ordinal."""

    def build() -> dict[int, list[str]]:
        found = {f.ordinal: [] for f in fields}
        if fields:
            cells = stack_columns(ds.df, [F.struct(F.lit(f.ordinal).alias("ordinal"), _label(f).alias("label")) for f in fields])
            for row in cells.where("label IS NOT NULL").distinct().collect():
                found[row["ordinal"]].append(row["label"])
        # UTF-8 sorts like its code points, so this is Spark's order.
        return {ordinal: sorted(labels) for ordinal, labels in found.items()}

    return ds.remember(("labels", *[f.ordinal for f in fields]), build)


def _code_of(labels: list[str]):
    """An Arrow function from labels to their places in the sorted list, null and unknown as -1."""
    known = pa.array(labels, pa.string())

    def code(column: pa.Array) -> pa.Array:
        return pc.cast(pc.fill_null(pc.index_in(column, value_set=known, skip_nulls=True), -1), pa.float64())

    return F.arrow_udf(code, "double")


def _with_codes(ds: Dataset, frame: DataFrame, fields: list[Field], small: list[Field]) -> DataFrame:
    """`frame` with each `key<ordinal>` turned into `code<ordinal>`, null as -1.

    The dictionaries of `small` travel with the tasks, which look a row's labels
    up where they are. Every other column is joined with its own dictionary.
    """
    labels = _dictionaries(ds, small)
    held = {f"code{f.ordinal}": _code_of(labels[f.ordinal])(F.col(f"key{f.ordinal}")) for f in small}
    frame = frame.withColumns(held).drop(*[f"key{f.ordinal}" for f in small])
    for f in fields:
        if f in small:
            continue
        key, code = f"key{f.ordinal}", f"code{f.ordinal}"
        mine = label_codes(ds, [f]).select(text_key(F.col("label"), f.longest).alias(key), F.col("code").alias(code))
        # Null labels match nothing; spreading them keeps the join balanced.
        spread = F.concat(F.lit("\0"), (F.rand(SEED) * 65536).cast("int").cast("string"))
        frame = frame.withColumn(key, F.coalesce(key, spread)).join(mine, key, "left").drop(key)
        frame = frame.withColumn(code, F.coalesce(code, F.lit(-1)).cast("double"))
    return frame


# -- E2, E3: encoded features and target -------------------------------------


def _measure_columns(ds: Dataset, target: str | None) -> list[Field]:
    """Feature columns that are filled rather than label-encoded."""
    return [f for f in ds.fields if f.name != target and f.column_type not in ("categorical", "binary")]


def _label_columns(ds: Dataset, target: str | None) -> list[Field]:
    return [f for f in ds.of_type("categorical", "binary") if f.name != target]


def _usable(field: Field) -> bool:
    return field.family in ("number", "time", "boolean")


def _medians(ds: Dataset, fields: list[Field]) -> dict[str, float]:
    known = ds.quantiles([f for f in fields if f.n and _usable(f)], (0.5,))
    return {f.name: known[f.name][0] if f.name in known else 0.0 for f in fields}


def median_imputation(ds: Dataset, target: str | None = None) -> DataFrame:
    """The measure columns as doubles with missing values set to the median.

    A projection with literal medians; all-null columns become 0.
    """
    fields = _measure_columns(ds, target)
    medians = _medians(ds, fields)
    return ds.df.select(*[_filled(f, medians[f.name]).alias(f.name) for f in fields])


def _filled(field: Field, median: float) -> Column:
    value = field.as_double if _usable(field) else null_of("double")
    return F.coalesce(value, F.lit(median))


def task_of_target(ds: Dataset, target: str) -> str:
    """classification for categorical and binary targets, regression otherwise."""
    return "classification" if ds.field(target).column_type in ("categorical", "binary") else "regression"


def encoded(ds: Dataset, target: str, task: str | None = None) -> DataFrame:
    """Every feature as a double (`code<ordinal>` / `x<ordinal>`) and the target.

    Label targets keep their text here; `label_target` numbers them. Rows whose
    target stays null are dropped.
    """
    field = ds.field(target)
    task = task or task_of_target(ds, target)
    measures = _measure_columns(ds, target)
    labels = _label_columns(ds, target)
    medians = _medians(ds, measures)
    if task == "classification" and field.column_type in ("categorical", "binary"):
        wanted = F.coalesce(_label(field), F.lit(MISSING_CLASS))
    else:
        median = _medians(ds, [field])[field.name] if field.n else None
        wanted = F.coalesce(field.as_double, F.lit(median).cast("double"))
        if task == "classification":
            wanted = wanted.cast("bigint")
    small = _small_labels(ds, labels)
    frame = ds.df.select(
        *[(_label(f) if f in small else _key(f)).alias(f"key{f.ordinal}") for f in labels],
        *[_filled(f, medians[f.name]).alias(f"x{f.ordinal}") for f in measures],
        wanted.alias(TARGET),
    ).where(F.col(TARGET).isNotNull())
    keep = [f"x{f.ordinal}" if f in measures else f"code{f.ordinal}" for f in ds.fields if f.name != target]
    return _with_codes(ds, frame, labels, small).select(*keep, TARGET)


def target_classes(
    ds: Dataset, target: str, task: str | None = None, limit: int = BROADCAST_CHARS
) -> DataFrame:
    """label, count, code of the prepared classification target."""
    labels = encoded_target(ds, target, task).groupBy(F.lit(0).alias("ordinal"), "label").count()
    return _numbered(ds, labels, _is_small(ds, ds.field(target), limit)).select("label", "count", "code")


def encoded_target(ds: Dataset, target: str, task: str | None = None) -> DataFrame:
    """The prepared target column alone, as `label` (classes) or `value`."""
    task = task or task_of_target(ds, target)
    field = ds.field(target)
    if task == "classification" and field.column_type in ("categorical", "binary"):
        return ds.df.select(F.coalesce(_label(field), F.lit(MISSING_CLASS)).alias("label"))
    median = _medians(ds, [field])[field.name] if field.n else None
    value = F.coalesce(field.as_double, F.lit(median).cast("double"))
    if task == "classification":
        return ds.df.select(value.cast("bigint").alias("label")).where("label IS NOT NULL")
    return ds.df.select(value.alias("value")).where("value IS NOT NULL")


def _features(ds: Dataset, target: str) -> list[tuple[int, str, str]]:
    """(ordinal, name, encoded column) of each feature, in column order."""
    labelled = {f.ordinal for f in _label_columns(ds, target)}
    return [
        (f.ordinal, f.name, f"code{f.ordinal}" if f.ordinal in labelled else f"x{f.ordinal}")
        for f in ds.fields
        if f.name != target
    ]


# -- status ------------------------------------------------------------------


def importance_status(ds: Dataset, target: str | None, task: str | None = None) -> DataFrame:
    """One row: status, task_type, target, feature_count, error."""
    return local_frame(
        ds.spark,
        [_status(ds, target, task)],
        "status string, task_type string, target string, feature_count int, error string",
    )


def _status(ds: Dataset, target: str | None, task: str | None) -> tuple:
    features = [f for f in ds.fields if f.name != target]
    field = ds.field(target)
    status, error = "available", None
    if not target:
        status, error = "unavailable", "No target column provided."
    elif field is None:
        status, error = "error", f"Target column '{target}' not found in dataset."
    elif not features:
        status, error = "error", "No feature columns found."
    else:
        task = task or task_of_target(ds, target)
        labelled = task == "classification" and field.column_type in ("categorical", "binary")
        rows = ds.n_rows if labelled or field.n else 0
        if rows < MIN_ROWS:
            status, error = "insufficient_data", "Not enough rows to compute feature importance."
    ready = status == "available"
    return status, task if ready else None, target if ready else None, len(features) if ready else None, error


def _ready(ds: Dataset, target: str, task: str | None) -> bool:
    return _status(ds, target, task)[0] == "available"


_IMPORTANCE = "method string, feature string, score double, normalized_score double, rank int"


# -- E6: mutual information --------------------------------------------------


def _binned(
    ds: Dataset, frame: DataFrame, columns: list[str], n: int, sizes: dict[str, int], labels: set[str]
) -> dict[str, Column]:
    """Bin of each column: its value when few are distinct or for a label, else its decile."""
    many = [c for c in columns if sizes[c] > BINS and c not in labels]
    probs = tuple(i / BINS for i in range(1, BINS))
    edges = exact_quantiles(frame, {c: (F.col(c).cast("double"), n) for c in many}, probs) if many else {}
    out = {}
    for c in columns:
        value = F.col(c).cast("double")
        if c in edges:
            value = sum((F.when(value > F.lit(e), 1).otherwise(0) for e in edges[c]), F.lit(0)).cast("double")
        out[c] = value
    return out


def mutual_information(ds: Dataset, target: str, task: str | None = None) -> DataFrame:
    """Plug-in mutual information (nats) between each feature and the target.

    Measures with many values are cut into exact deciles, and so is a numeric
    target; labels stay labels. Only cells that occur are counted.
    """
    task = task or task_of_target(ds, target)
    if not _ready(ds, target, task):
        return local_frame(ds.spark, [], _IMPORTANCE)
    features = _features(ds, target)
    frame = encoded(ds, target, task)
    distinct = _distinct(ds)
    sizes = {c: distinct[o] + 1 if ds.fields[o].missing else distinct[o] for o, _, c in features}
    columns = [c for _, _, c in features]
    field = ds.field(target)
    if task == "regression":
        sizes[TARGET] = distinct[field.ordinal] + (1 if field.missing else 0)
        columns = columns + [TARGET]
    # Codes of labels have no order worth cutting: each label is a bin.
    labels = {c for o, _, c in features if ds.fields[o].family not in ("number", "time")}
    bins = _binned(ds, frame, columns, ds.n_rows, sizes, labels)
    y = bins[TARGET].cast("string") if task == "regression" else F.col(TARGET).cast("string")
    cells = (
        stack_columns(
            frame,
            [F.struct(F.lit(o).alias("ordinal"), bins[c].alias("x"), y.alias("y")) for o, _, c in features],
        )
        .groupBy("ordinal", "x", "y")
        .agg(F.count(F.lit(1)).cast("double").alias("c"))
    )
    # I(x, y) = H(x) + H(y) - H(x, y), and each entropy is a sum over one grouping
    # of the same cells, so nothing is joined.
    by_x = cells.groupBy("ordinal", "x").agg(F.sum("c").alias("c"))
    by_y = cells.groupBy("ordinal", "y").agg(F.sum("c").alias("c"))
    parts = [(cells, 1.0), (by_x, -1.0), (by_y, -1.0)]
    sums = union_all(
        [
            frame.select("ordinal", (F.lit(sign) * F.col("c") * F.log("c")).alias("t"), (F.lit(max(sign, 0.0)) * F.col("c")).alias("n"))
            for frame, sign in parts
        ]
    ).groupBy("ordinal").agg(F.sum("t").alias("t"), F.sum("n").alias("n"))
    scores = sums.select("ordinal", F.greatest(F.col("t") / F.col("n") + F.log("n"), F.lit(0.0)).alias("mi"))
    names = local_frame(ds.spark, [(o, name) for o, name, _ in features], "ordinal int, feature string")
    return _ranked(names.join(scores, "ordinal"), "mutual_information", "mi")


def _ranked(frame: DataFrame, method: str, score: str) -> DataFrame:
    """Rounded scores, their share of the total, and ranks 1..k."""
    everything = Window.partitionBy(F.lit(0))
    share = F.coalesce(F.try_divide(F.col(score), F.sum(score).over(everything)), F.lit(0.0))
    rounded = F.round(score, 6)
    order = Window.partitionBy(F.lit(0)).orderBy(F.col("score").desc(), "ordinal")
    return (
        frame.select("ordinal", "feature", rounded.alias("score"), F.round(share, 6).alias("normalized_score"))
        .withColumn("rank", F.row_number().over(order))
        .select(F.lit(method).alias("method"), "feature", "score", "normalized_score", "rank")
        .orderBy("rank")
    )


# -- E5: random forest -------------------------------------------------------


def _dealt(rows: DataFrame, n: int) -> DataFrame:
    """Many rows spread evenly over the cluster's cores, however few files or row groups they come from.

    Every pass of the forest reads them again, and lasts as long as its largest
    task; each task sends a table of all nodes, so there are no more than needed.
    """
    if n <= DEALT_ROWS:
        return rows
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores * max(1, -(-n // (cores * ROWS_PER_TASK))))


def forest_importance(ds: Dataset, target: str, task: str | None = None, max_depth: int = MAX_DEPTH) -> DataFrame:
    """Impurity importance of each feature from a random forest (seed 42)."""
    task = task or task_of_target(ds, target)
    if not _ready(ds, target, task):
        return local_frame(ds.spark, [], _IMPORTANCE)
    features = _features(ds, target)
    frame = encoded(ds, target, task)
    trees = min(100, max(10, ds.n_rows // 5))
    label = F.col(TARGET).cast("double")
    if task == "classification":
        field = ds.field(target)
        count = _distinct(ds)[field.ordinal] + (1 if field.missing else 0)
        if field.column_type in ("categorical", "binary") and _small_labels(ds, [field]):
            labels = _dictionaries(ds, [field])[field.ordinal] + ([MISSING_CLASS] if field.missing else [])
            frame = frame.withColumn("code", _code_of(sorted(set(labels)))(F.col(TARGET)))
        else:
            classes = target_classes(ds, target, task).select(F.col("label").alias(TARGET), "code")
            frame = frame.join(classes, TARGET)
        nominal = {"ml_attr": {"type": "nominal", "name": "label", "num_vals": max(count, 2)}}
        label = F.col("code").cast("double").alias("label", metadata=nominal)
        forest = RandomForestClassifier(numTrees=trees, seed=SEED, maxDepth=max_depth, featureSubsetStrategy="sqrt")
    else:
        forest = RandomForestRegressor(numTrees=trees, seed=SEED, maxDepth=max_depth, featureSubsetStrategy="all")
    assembled = VectorAssembler(inputCols=[c for _, _, c in features], outputCol="features").transform(
        frame.withColumn("label", label)
    )
    model = forest.fit(_dealt(assembled.select("features", "label"), ds.n_rows))
    scores = model.featureImportances.toArray()
    rows = [(o, name, float(s)) for (o, name, _), s in zip(features, scores)]
    return _ranked(
        local_frame(ds.spark, rows, "ordinal int, feature string, importance double"), "random_forest", "importance"
    )


def feature_importance(ds: Dataset, target: str, task: str | None = None, max_depth: int = MAX_DEPTH) -> DataFrame:
    """Both rankings, one row per method and feature."""
    return forest_importance(ds, target, task, max_depth).unionByName(mutual_information(ds, target, task))


def top_importance(ds: Dataset, target: str, task: str | None = None, n: int = 10) -> DataFrame:
    """The first `n` features of each method."""
    return ds.small(feature_importance, target, task).where(F.col("rank") <= n)
