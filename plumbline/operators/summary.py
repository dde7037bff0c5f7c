"""Feature summary, insights, preprocessing advice, model advice, report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

from plumbline.dataset import Dataset
from plumbline.functions.columns import beside, column_level, fixed, local_frame, null_of
from plumbline.operators.association import associated_pairs, pearson_pairs
from plumbline.operators.missingness import ordered_list
from plumbline.operators.numeric import numeric_stats
from plumbline.operators.outliers import outliers_iqr
from plumbline.operators.profile import column_profile
from plumbline.operators.quality import quality_score, table_facts
from plumbline.operators.target import detect_task


@column_level
def feature_summary(ds: Dataset, target: str | None = None) -> DataFrame:
    """One row per column: type, missing, distinct, statistics, outliers, r with target."""
    pairs = ds.small(pearson_pairs)
    to_target = pairs.where(F.col("column_b") == F.lit(target)).select(F.col("ord_a").alias("ordinal"), "r").unionByName(
        pairs.where(F.col("column_a") == F.lit(target)).select(F.col("ord_b").alias("ordinal"), "r")
    )
    with_target = F.when(F.col("column_name") == F.lit(target), F.lit(1.0)).otherwise(F.round("r", 4))
    return (
        ds.small(column_profile)
        .join(ds.small(numeric_stats).drop("column_name", "n"), "ordinal", "left")
        .join(ds.small(outliers_iqr).select("ordinal", "iqr_count", "iqr_pct"), "ordinal", "left")
        .join(to_target, "ordinal", "left")
        .select(
            "ordinal",
            "column_name",
            "column_type",
            "missing_count",
            "missing_percentage",
            "unique_count",
            "is_constant",
            "mean",
            "median",
            "std",
            "min",
            "max",
            "q1",
            "q3",
            "skewness",
            "kurtosis",
            F.coalesce("iqr_count", F.lit(0)).alias("outlier_count"),
            F.coalesce("iqr_pct", F.lit(0.0)).alias("outlier_percentage"),
            (with_target if target else null_of("double")).alias("target_correlation"),
        )
        .orderBy("ordinal")
    )


# -- insights ----------------------------------------------------------------


def _said(frame: DataFrame, rank: int, ord_: Column, text: Column) -> DataFrame:
    return frame.select(F.lit(rank).alias("section_rank"), ord_.cast("int").alias("ord"), text.alias("message"))


@column_level
def insights(ds: Dataset) -> DataFrame:
    """section_rank, ord, message: what stands out, in reading order."""
    facts = ds.small(table_facts)
    pairs = ds.small(associated_pairs)
    outliers = ds.small(outliers_iqr).where("iqr_count > 0")
    first = F.lit(0)
    shape = F.concat(F.lit("Dataset contains "), F.col("rows"), F.lit(" rows and "), F.col("columns"), F.lit(" columns."))
    missing = F.when(F.col("missing_cells") == 0, F.lit("No missing values were detected.")).otherwise(
        F.concat(
            F.col("missing_columns"),
            F.lit(" column(s) contain missing values ("),
            F.col("missing_cells"),
            F.lit(" cells affected)."),
        )
    )
    duplicates = F.when(F.col("duplicate_rows") == 0, F.lit("No duplicate rows were detected.")).otherwise(
        F.concat(F.col("duplicate_rows"), F.lit(" duplicate row(s) were detected."))
    )
    pair = F.concat(
        F.col("column_a"),
        F.lit(" and "),
        F.col("column_b"),
        F.lit(" have a very strong "),
        F.when(F.col("correlation") > 0, "positive").otherwise("negative"),
        F.lit(" correlation ("),
        fixed(F.col("correlation"), 4),
        F.lit(")."),
    )
    column = F.concat(F.col("iqr_count"), F.lit(" statistical outlier(s) were detected in "), F.col("column_name"), F.lit("."))
    total = F.concat(
        F.lit("A total of "), F.col("outlier_cells"), F.lit(" statistical outlier(s) were detected across the dataset.")
    )
    quality = F.concat(
        F.lit("Dataset quality score is "), F.col("score").cast("string"), F.lit("/100 ("), F.col("grade"), F.lit(").")
    )
    pair_order = F.col("method_rank") * 1_000_000 + F.row_number().over(in_order("method_rank", "ord_a", "ord_b"))
    parts = [
        _said(facts, 0, first, shape),
        _said(facts, 1, first, missing),
        _said(facts, 2, first, duplicates),
        _said(pairs, 3, pair_order, pair),
        _said(facts.where("pairs = 0"), 3, first, F.lit("No highly correlated feature pairs were detected.")),
        _said(outliers, 4, F.col("ordinal"), column),
        _said(facts.where("outlier_columns = 0"), 4, first, F.lit("No statistical outliers were detected.")),
        _said(facts.where("outlier_columns > 1"), 5, first, total),
        _said(ds.small(quality_score), 6, first, quality),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.orderBy("section_rank", "ord")


def in_order(*columns: str) -> WindowSpec:
    """Numbering over a column-level frame, small by construction."""
    return Window.partitionBy(F.lit(0)).orderBy(*columns)


def insight_severity(ds: Dataset) -> DataFrame:
    """Each insight with warning / success / info by its wording."""
    text = F.lower("message")

    def says(*words: str) -> Column:
        out = text.contains(words[0])
        for word in words[1:]:
            out = out | text.contains(word)
        return out

    severity = (
        F.when(says("missing", "outlier", "duplicate", "imbalanced"), "warning")
        .when(says("no ", "score is", "contains"), "success")
        .otherwise("info")
    )
    return ds.small(insights).select("section_rank", "ord", "message", severity.alias("severity"))


# -- preprocessing -----------------------------------------------------------


@column_level
def preprocessing(ds: Dataset, target: str | None = None) -> DataFrame:
    """ord, column_name, columns, type, priority, action, message, correlation."""
    name = F.col("column_name")
    is_target = name == F.lit(target) if target else F.lit(False)
    count = F.col("outlier_count")
    rules = [
        (
            F.col("missing_count") > 0,
            "missing_values",
            "high",
            "imputation",
            F.concat(name, F.lit(" contains "), F.col("missing_count"), F.lit(" missing value(s). Consider an appropriate imputation strategy before model training.")),
        ),
        (
            ~is_target & F.col("column_type").isin("categorical", "binary"),
            "categorical_encoding",
            "medium",
            "encoding",
            F.concat(name, F.lit(" is a categorical feature and should be encoded before model training.")),
        ),
        (
            (count > 0) & is_target,
            "target_outliers",
            "medium",
            "investigate",
            F.concat(name, F.lit(" contains "), count, F.lit(" statistical outlier(s). Investigate these observations before deciding whether any treatment is appropriate.")),
        ),
        (
            (count > 0) & ~is_target,
            "feature_outliers",
            "medium",
            "investigate_or_transform",
            F.concat(name, F.lit(" contains "), count, F.lit(" statistical outlier(s). Investigate whether they should be retained, transformed, or handled.")),
        ),
        (
            F.col("is_constant"),
            "constant_feature",
            "high",
            "remove",
            F.concat(name, F.lit(" contains a constant value and provides no useful variation for machine learning.")),
        ),
    ]
    found = F.array(
        *[
            F.when(
                test,
                F.struct(
                    F.lit(kind).alias("type"), F.lit(priority).alias("priority"), F.lit(action).alias("action"), text.alias("message")
                ),
            )
            for test, kind, priority, action, text in rules
        ]
    )
    per_column = (
        ds.small(feature_summary, target)
        .select("ordinal", name, F.posexplode(found).alias("rule", "r"))
        .where("r IS NOT NULL")
        .select(
            F.lit(0).alias("part"),
            (F.col("ordinal") * len(rules) + F.col("rule")).alias("place"),
            "column_name",
            null_of("array<string>").alias("columns"),
            "r.type",
            "r.priority",
            "r.action",
            "r.message",
            null_of("double").alias("correlation"),
        )
    )
    touches = (
        (F.col("column_a") == F.lit(target)) | (F.col("column_b") == F.lit(target)) if target else F.lit(False)
    )
    lead = F.concat(
        F.col("column_a"),
        F.lit(" and "),
        F.col("column_b"),
        F.lit(" have a very strong correlation ("),
        F.col("correlation").cast("string"),
        F.lit("). "),
    )
    per_pair = ds.small(associated_pairs).select(
        F.lit(1).alias("part"),
        F.row_number().over(in_order("method_rank", "ord_a", "ord_b")).alias("place"),
        null_of("string").alias("column_name"),
        F.array("column_a", "column_b").alias("columns"),
        F.when(touches, "target_correlation").otherwise("multicollinearity").alias("type"),
        F.lit("medium").alias("priority"),
        F.when(touches, "investigate").otherwise("investigate_feature_redundancy").alias("action"),
        F.concat(
            lead,
            F.when(touches, "Review this relationship for potential target leakage or redundancy.").otherwise(
                "Consider reviewing them for multicollinearity or redundant information."
            ),
        ).alias("message"),
        "correlation",
    )
    return (
        per_column.unionByName(per_pair)
        .withColumn("ord", F.row_number().over(in_order("part", "place")))
        .select("ord", "column_name", "columns", "type", "priority", "action", "message", "correlation")
        .orderBy("ord")
    )


def preprocessing_status(ds: Dataset, target: str | None = None) -> DataFrame:
    """One row: status, recommendation_count, dataset_status."""
    count = ds.small(preprocessing, target).agg(F.count(F.lit(1)).alias("recommendation_count"))
    text = F.when(F.col("missing_cells") == 0, F.lit("No missing values require imputation.")).otherwise(
        F.concat(F.col("missing_cells"), F.lit(" missing value(s) require investigation and appropriate imputation."))
    )
    return count.transform(beside, ds.small(table_facts)).select(
        F.lit("available").alias("status"), "recommendation_count", text.alias("dataset_status")
    )


def recommendations_by_priority(ds: Dataset, target: str | None = None) -> DataFrame:
    """priority, count, messages; unknown priorities count as medium."""
    known = F.when(F.col("priority").isin("high", "medium", "low"), F.col("priority")).otherwise("medium")
    pair = F.struct("ord", "message")
    return (
        ds.small(preprocessing, target)
        .groupBy(known.alias("priority"))
        .agg(
            F.count(F.lit(1)).alias("count"),
            F.transform(F.array_sort(F.collect_list(pair)), lambda p: p["message"]).alias("messages"),
        )
    )


# -- models ------------------------------------------------------------------

# Three models per task type with the reason to try them.
MODELS = (
    ("regression", 1, "Linear Regression", "Provides a simple and interpretable baseline for continuous target prediction."),
    ("regression", 2, "Random Forest Regressor", "Handles nonlinear relationships and mixed feature patterns with limited preprocessing."),
    ("regression", 3, "Gradient Boosting Regressor", "Can model complex nonlinear relationships and interactions between features."),
    ("binary_classification", 1, "Logistic Regression", "Provides a strong and interpretable baseline for binary classification."),
    ("binary_classification", 2, "Random Forest Classifier", "Handles nonlinear relationships and feature interactions effectively."),
    ("binary_classification", 3, "Gradient Boosting Classifier", "Often performs well on structured tabular classification datasets."),
    ("multiclass_classification", 1, "Logistic Regression", "Provides a simple baseline for multiclass classification."),
    ("multiclass_classification", 2, "Random Forest Classifier", "Handles nonlinear relationships and multiple feature interactions."),
    ("multiclass_classification", 3, "Gradient Boosting Classifier", "Can capture complex relationships in structured classification data."),
)
NO_TASK = "A valid machine-learning task could not be determined."


def recommended_models(ds: Dataset, target: str | None = None) -> DataFrame:
    """target, task_type, ord, model, reason for the detected task."""
    table = local_frame(ds.spark, list(MODELS), "task_type string, ord int, model string, reason string")
    return (
        ds.small(detect_task, target)
        .select("target", "task_type")
        .join(table, "task_type")
        .select("target", "task_type", "ord", "model", "reason")
        .orderBy("ord")
    )


@column_level
def model_recommendation(ds: Dataset, target: str | None = None) -> DataFrame:
    """One row: status, task, models, preprocessing, reasoning."""
    kinds = ds.small(column_profile).where(F.col("column_name") != F.lit(target) if target else F.lit(True)).agg(
        F.count(F.lit(1)).alias("inputs"),
        F.count_if(F.col("column_type") == "numeric").alias("numeric_inputs"),
        F.count_if(F.col("column_type").isin("categorical", "binary")).alias("class_inputs"),
    )
    outlying = ds.small(outliers_iqr).where("iqr_count > 0").agg(ordered_list(F.col("column_name")).alias("outlying"))
    models = recommended_models(ds, target).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("ord", "model"))), lambda m: m["model"]).alias("models")
    )
    facts = (
        ds.small(detect_task, target)
        .select("target", "task", "task_type")
        .transform(beside, kinds)
        .transform(beside, outlying)
        .transform(beside, models)
        .transform(beside, ds.small(table_facts).select("rows"))
        .transform(beside, ds.small(quality_score).select("score", "grade"))
    )
    has_outliers = F.size("outlying") > 0
    steps = F.array_compact(
        F.array(
            F.when(F.col("numeric_inputs") > 0, "Numeric features can be used directly by tree-based models."),
            F.when(F.col("class_inputs") > 0, "Categorical features should be encoded before model training."),
            F.when(has_outliers, "Review detected outliers before model training."),
        )
    )
    reasons = F.array_compact(
        F.array(
            F.concat(F.lit("Detected ML task: "), F.col("task_type"), F.lit(".")),
            F.concat(F.lit("Dataset contains "), F.col("rows"), F.lit(" rows and "), F.col("inputs"), F.lit(" input features.")),
            F.concat(F.col("numeric_inputs"), F.lit(" numeric feature(s) detected.")),
            F.concat(F.col("class_inputs"), F.lit(" categorical feature(s) detected.")),
            F.concat(F.lit("Data quality score is "), F.col("score").cast("string"), F.lit("/100 ("), F.col("grade"), F.lit(").")),
            F.when(has_outliers, F.concat(F.lit("Outliers were detected in: "), F.array_join("outlying", ", "), F.lit("."))),
        )
    )
    unsupported = F.array(F.concat(F.lit("ML task type '"), F.col("task_type"), F.lit("' is not currently supported.")))
    status = (
        F.when(F.col("task").isNull() | F.col("task_type").isNull(), "unavailable")
        .when(F.size("models") == 0, "unsupported")
        .otherwise("available")
    )
    nothing = F.array().cast("array<string>")
    ready = F.col("status") == "available"
    return facts.withColumn("status", status).select(
        "status",
        F.when(F.col("status") != "unavailable", F.col("task")).alias("task"),
        F.when(ready, F.col("task_type")).alias("task_type"),
        F.when(ready, F.col("target")).alias("target"),
        "models",
        F.when(ready, steps).otherwise(nothing).alias("preprocessing"),
        F.when(F.col("status") == "unavailable", F.array(F.lit(NO_TASK)))
        .when(F.col("status") == "unsupported", unsupported)
        .otherwise(reasons)
        .alias("reasoning"),
    )


# -- report ------------------------------------------------------------------


@column_level
def report(ds: Dataset, target: str | None = None) -> DataFrame:
    """One row that gathers shape, quality, task, findings, models and advice."""
    findings = ds.small(insights).agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("section_rank", "ord", "message"))), lambda i: i["message"]
        ).alias("key_findings")
    )
    advice = ds.small(preprocessing, target).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("ord", "message"))), lambda i: i["message"]).alias("preprocessing")
    )
    return (
        ds.small(table_facts)
        .select("rows", "columns", "duplicate_rows")
        .transform(beside, ds.small(quality_score).select("score", "grade", "status"))
        .transform(beside, ds.small(detect_task, target).select("target", "task", "task_type", "confidence"))
        .transform(beside, findings)
        .transform(beside, ds.small(model_recommendation, target).select(F.col("models").alias("recommended_models")))
        .transform(beside, advice)
    )
