"""Target analysis and detection of the modelling task."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from plumbline.dataset import Dataset
from plumbline.functions.columns import column_level, local_frame, null_of, percent
from plumbline.operators.numeric import raw_stats
from plumbline.operators.profile import distinct_counts

HIGH_IMBALANCE = 0.90
SOME_IMBALANCE = 0.75

# Messages of the target analysis and the task detection.
WARN_HIGH = "Target variable is highly imbalanced."
WARN_SOME = "Target variable shows moderate class imbalance."
NO_VALUES = "Target column has no non-missing values."
REASON_TWO = "The target contains two distinct classes, indicating a binary classification problem."
REASON_MANY = "The categorical target contains %d classes, indicating multiclass classification."
REASON_FEW = (
    "The numeric target contains a small number of distinct values relative to the dataset size "
    "and may represent class labels."
)
REASON_REGRESSION = (
    "The target is numeric with sufficient continuous variation, indicating a regression problem."
)
REASON_NO_TARGET = "No target column was provided."
REASON_ALL_MISSING = "Target column contains no non-missing values."

_CLASS_SCHEMA = "label string, count bigint, percentage double, num_classes bigint"
_TASK_SCHEMA = (
    "target string, target_type string, unique_classes bigint, missing_count bigint, "
    "missing_percentage double, task string, task_type string, confidence double, "
    "reason string, status string"
)


def class_distribution(ds: Dataset, target: str) -> DataFrame:
    """label, count, percentage, num_classes for a class target.

    Stays distributed: a target may have as many classes as rows.
    """
    field = ds.field(target)
    if field is None or field.column_type not in ("categorical", "binary"):
        return local_frame(ds.spark, [], _CLASS_SCHEMA)
    counts = ds.df.where(field.col.isNotNull()).groupBy(field.col.cast("string").alias("label")).count()
    classes = ds.remember(("classes", target), counts.count)
    return counts.select(
        "label",
        "count",
        percent(F.col("count"), F.lit(field.n)).alias("percentage"),
        F.lit(classes).cast("bigint").alias("num_classes"),
    )


def target_analysis(ds: Dataset, target: str | None) -> DataFrame:
    """One row: type, numeric measures or class facts, warning, error."""
    field = ds.field(target)
    kind = field.column_type if field else None
    measures = ("mean", "median", "std", "min", "max", "skewness")
    empty = [null_of("double").alias(m) for m in measures]
    num_classes, majority, error = null_of("bigint"), null_of("double"), null_of("string")
    base = ds.spark.range(1)
    if field is None:
        error = F.lit(f"Target column '{target}' not found in dataset.")
    elif kind == "numeric":
        base = ds.small(raw_stats).where(F.col("column_name") == target)
        empty = [F.round(m, 4).alias(m) for m in measures]
    elif kind in ("categorical", "binary"):
        counts = ds.df.where(field.col.isNotNull()).groupBy(field.col).count()
        base = counts.agg(F.count(F.lit(1)).alias("classes"), F.max("count").alias("largest"))
        num_classes = F.col("classes")
        majority = F.try_divide(F.col("largest"), F.lit(field.n))
    else:
        error = F.lit(f"Target column type '{kind}' is not supported for target analysis.")
    warning = F.when(majority > HIGH_IMBALANCE, WARN_HIGH).when(majority > SOME_IMBALANCE, WARN_SOME)
    return base.select(
        F.lit(target).alias("column_name"),
        F.lit(kind).cast("string").alias("column_type"),
        *empty,
        num_classes.alias("num_classes"),
        warning.alias("warning"),
        error.alias("error"),
    )


@column_level
def task_of_columns(ds: Dataset) -> DataFrame:
    """The task each column would give as target, one row per column."""
    kind = F.col("column_type")
    present = F.col("n")
    missing = F.col("n_rows") - present
    distinct = F.col("unique_count")
    two = distinct == 2
    few = (distinct <= 10) & (F.try_divide(distinct, present) <= 0.5)
    # First matching rule wins: (test, target_type, task, task_type, confidence, reason, status)
    none = null_of("string")
    rules = [
        (present == 0, none, none, none, 0.0, F.lit(REASON_ALL_MISSING), "invalid_target"),
        (two | (kind == "binary"), F.lit("binary"), F.lit("classification"), F.lit("binary_classification"), 0.98, F.lit(REASON_TWO), "detected"),
        (kind == "categorical", kind, F.lit("classification"), F.lit("multiclass_classification"), 0.95, F.format_string(REASON_MANY, distinct), "detected"),
        ((kind == "numeric") & few, kind, F.lit("classification"), F.lit("multiclass_classification"), 0.75, F.lit(REASON_FEW), "detected"),
        (kind == "numeric", kind, F.lit("regression"), F.lit("regression"), 0.95, F.lit(REASON_REGRESSION), "detected"),
    ]
    # A categorical column with two values is binary; one with another count is not.
    other = F.concat(F.lit("Target type '"), kind, F.lit("' is not supported for automatic ML task detection."))
    choice = None
    for test, target_type, task, task_type, confidence, reason, status in rules:
        row = F.struct(
            target_type.cast("string").alias("target_type"),
            task.cast("string").alias("task"),
            task_type.cast("string").alias("task_type"),
            F.lit(confidence).alias("confidence"),
            reason.alias("reason"),
            F.lit(status).alias("status"),
        )
        choice = F.when(test, row) if choice is None else choice.when(test, row)
    choice = choice.otherwise(
        F.struct(
            kind.alias("target_type"),
            none.alias("task"),
            none.alias("task_type"),
            F.lit(0.0).alias("confidence"),
            other.alias("reason"),
            F.lit("unsupported").alias("status"),
        )
    )
    known = present > 0
    return (
        ds.small(Dataset.summary)
        .join(ds.small(distinct_counts, None), "ordinal")
        .withColumn("c", choice)
        .orderBy("ordinal")
        .select(
            F.col("column_name").alias("target"),
            "c.target_type",
            F.when(known, distinct).alias("unique_classes"),
            F.when(known, missing).alias("missing_count"),
            F.when(known, percent(missing, F.col("n_rows"))).alias("missing_percentage"),
            "c.task",
            "c.task_type",
            "c.confidence",
            "c.reason",
            "c.status",
        )
    )


@column_level
def detect_task(ds: Dataset, target: str | None = None) -> DataFrame:
    """One row: the task for `target`."""
    if target is None or not target.strip():
        row = (None, None, None, None, None, None, None, 0.0, REASON_NO_TARGET, "target_required")
    elif ds.field(target) is None:
        reason = f"Target column '{target}' was not found in the dataset."
        row = (target, None, None, None, None, None, None, 0.0, reason, "invalid_target")
    else:
        return ds.small(task_of_columns).where(F.col("target") == target)
    return local_frame(ds.spark, [row], _TASK_SCHEMA)
