"""The 0-100 quality score with its penalties, notes and display lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from plumbline.dataset import Dataset
from plumbline.functions.columns import beside, column_level, fixed
from plumbline.operators.association import associated_pairs
from plumbline.operators.missingness import missing_summary, ordered_list
from plumbline.operators.outliers import outliers_iqr
from plumbline.operators.profile import column_profile, duplicate_rows

# The largest penalty of each kind.
CAP_MISSING = 30.0
CAP_DUPLICATES = 15.0
CAP_OUTLIERS = 15.0
CAP_PAIRS = 10.0
PER_PAIR = 5.0
CONSTANT_PENALTY = 10.0

# Grades by lowest score, and their display status.
GRADES = (
    (90, "Excellent", "🟢 Excellent Quality"),
    (75, "Good", "🟢 Good Quality"),
    (60, "Fair", "🟡 Fair Quality"),
    (40, "Poor", "🟠 Poor Quality"),
    (0, "Critical", "🔴 Critical Quality"),
)

# Strengths and recommendations.
NO_MISSING = "No missing values detected."
NO_DUPLICATES = "No duplicate rows detected."
NO_OUTLIERS = "No statistical outliers detected."
NO_PAIRS = "No highly correlated feature pairs detected."
NO_CONSTANTS = "No constant columns detected."
SOME_STRENGTH = "Dataset contains usable structural information."
DO_MISSING = "Review missing values and choose an appropriate imputation strategy."
DO_DUPLICATES = "Review duplicate rows before model training."
DO_OUTLIERS = "Investigate detected outliers before deciding whether to remove or transform them."
DO_PAIRS = "Review highly correlated features for potential multicollinearity."
DO_CONSTANTS = "Consider removing constant columns because they provide no predictive variation."
DO_NOTHING = "Dataset quality is good. Continue with exploratory analysis and preprocessing as required."
EMPTY_ISSUE = "Dataset is empty."
EMPTY_ADVICE = "Provide a dataset containing rows and columns."


def _by_grade(score: Column, place: int) -> Column:
    out = None
    for grade in GRADES[:-1]:
        out = F.when(score >= grade[0], grade[place]) if out is None else out.when(score >= grade[0], grade[place])
    return out.otherwise(GRADES[-1][place])


def score_band(score: Column) -> Column:
    """The grade of any 0-100 score."""
    return _by_grade(score, 1)


@column_level
def table_facts(ds: Dataset) -> DataFrame:
    """One row with everything the table-level rules look at."""
    columns = ds.small(column_profile).agg(
        F.coalesce(F.sum("missing_count"), F.lit(0)).alias("missing_cells"),
        F.count_if(F.col("missing_count") > 0).alias("missing_columns"),
        F.count_if(F.col("unique_count_with_null") <= 1).alias("constant_columns"),
        F.count_if(F.col("column_type") == "numeric").alias("numeric_columns"),
        F.count_if(F.col("column_type").isin("categorical", "binary")).alias("class_columns"),
    )
    outliers = ds.small(outliers_iqr).agg(
        F.count(F.lit(1)).alias("checked_columns"),
        F.avg("iqr_pct").alias("outlier_rate"),
        F.count_if(F.col("iqr_count") > 0).alias("outlier_columns"),
        F.coalesce(F.sum("iqr_count"), F.lit(0)).alias("outlier_cells"),
    )
    pairs = ds.small(associated_pairs).agg(F.count(F.lit(1)).alias("pairs"))
    return (
        ds.small(duplicate_rows)
        .select("rows", F.lit(len(ds.fields)).alias("columns"), "duplicate_rows")
        .transform(beside, columns)
        .transform(beside, outliers)
        .transform(beside, pairs)
    )


@column_level
def quality_score(ds: Dataset) -> DataFrame:
    """One row: five penalties, score, grade, status, strengths, issues, advice."""
    empty = (F.col("rows") == 0) | (F.col("columns") == 0)
    missing_rate = F.try_divide(F.col("missing_cells") * F.lit(100.0), F.col("rows") * F.col("columns"))
    duplicate_rate = F.try_divide(F.col("duplicate_rows") * F.lit(100.0), F.col("rows"))
    outlier_rate = F.coalesce("outlier_rate", F.lit(0.0))
    facts = ds.small(table_facts).select(
        "*",
        empty.alias("empty"),
        F.coalesce(missing_rate, F.lit(0.0)).alias("missing_rate"),
        F.coalesce(duplicate_rate, F.lit(0.0)).alias("duplicate_rate"),
        outlier_rate.alias("mean_outlier_rate"),
    )
    penalties = facts.select(
        "*",
        F.least("missing_rate", F.lit(CAP_MISSING)).alias("missing_penalty"),
        F.least("duplicate_rate", F.lit(CAP_DUPLICATES)).alias("duplicate_penalty"),
        F.least("mean_outlier_rate", F.lit(CAP_OUTLIERS)).alias("outlier_penalty"),
        F.least(F.col("pairs") * PER_PAIR, F.lit(CAP_PAIRS)).alias("association_penalty"),
        F.when(F.col("constant_columns") > 0, CONSTANT_PENALTY).otherwise(0.0).alias("constant_penalty"),
    )
    total = (
        F.col("missing_penalty")
        + F.col("duplicate_penalty")
        + F.col("outlier_penalty")
        + F.col("association_penalty")
        + F.col("constant_penalty")
    )
    clipped = F.greatest(F.least(F.lit(100.0) - total, F.lit(100.0)), F.lit(0.0))
    score = F.when(F.col("empty"), 0.0).otherwise(F.round(clipped, 2))

    has_missing = F.col("missing_cells") > 0
    has_duplicates = F.col("duplicate_rows") > 0
    has_outliers = F.col("mean_outlier_rate") > 0
    has_pairs = F.col("pairs") > 0
    has_constants = F.col("constant_columns") > 0

    def chosen(rules: list[tuple[Column, Column | str]], fallback: str | None) -> Column:
        texts = F.array_compact(
            F.array(*[F.when(test, text if isinstance(text, Column) else F.lit(text)) for test, text in rules])
        )
        if fallback is None:
            return texts
        return F.when(F.size(texts) == 0, F.array(F.lit(fallback))).otherwise(texts)

    strengths = chosen(
        [
            (~has_missing, NO_MISSING),
            (~has_duplicates, NO_DUPLICATES),
            ((F.col("checked_columns") > 0) & ~has_outliers, NO_OUTLIERS),
            (~has_pairs, NO_PAIRS),
            (~has_constants, NO_CONSTANTS),
        ],
        SOME_STRENGTH,
    )
    issues = chosen(
        [
            (has_missing, F.concat(F.lit("Missing values detected ("), fixed(F.col("missing_rate"), 2), F.lit("% of cells)."))),
            (has_duplicates, F.concat(F.lit("Duplicate rows detected ("), fixed(F.col("duplicate_rate"), 2), F.lit("% of rows)."))),
            (has_outliers, F.concat(F.lit("Outliers detected across numeric columns (average rate: "), fixed(F.col("mean_outlier_rate"), 2), F.lit("%)."))),
            (has_pairs, F.concat(F.col("pairs"), F.lit(" highly correlated feature pair(s) detected."))),
            (has_constants, F.concat(F.col("constant_columns"), F.lit(" constant column(s) detected."))),
        ],
        None,
    )
    advice = chosen(
        [
            (has_missing, DO_MISSING),
            (has_duplicates, DO_DUPLICATES),
            (has_outliers, DO_OUTLIERS),
            (has_pairs, DO_PAIRS),
            (has_constants, DO_CONSTANTS),
        ],
        DO_NOTHING,
    )
    no_text = F.array().cast("array<string>")
    kinds = ("missing", "duplicate", "outlier", "association", "constant")
    return penalties.withColumn("score", score).select(
        "score",
        score_band(F.col("score")).alias("grade"),
        _by_grade(F.col("score"), 2).alias("status"),
        *[F.round(f"{kind}_penalty", 4).alias(f"{kind}_penalty") for kind in kinds],
        F.when(F.col("empty"), no_text).otherwise(strengths).alias("strengths"),
        F.when(F.col("empty"), F.array(F.lit(EMPTY_ISSUE))).otherwise(issues).alias("issues"),
        F.when(F.col("empty"), F.array(F.lit(EMPTY_ADVICE))).otherwise(advice).alias("recommendations"),
    )


def quality_notes(ds: Dataset) -> DataFrame:
    """The score's texts as rows: kind, ord, message."""

    def rows(kind: str, source: str) -> DataFrame:
        return ds.small(quality_score).select(
            F.lit(kind).alias("kind"), F.posexplode(source).alias("ord", "message")
        )

    return (
        rows("strength", "strengths")
        .unionByName(rows("issue", "issues"))
        .unionByName(rows("recommendation", "recommendations"))
    )


def constant_columns(ds: Dataset) -> DataFrame:
    """Columns with at most one distinct value."""
    return ds.small(column_profile).where("is_constant").select("ordinal", "column_name").orderBy("ordinal")


def quality_issues(ds: Dataset) -> DataFrame:
    """ord, severity, title, message: score issues plus constants and duplicates."""
    text = F.lower("message")
    severity = (
        F.when(text.contains("critical"), "critical")
        .when(text.contains("duplicate") | text.contains("outlier"), "warning")
        .otherwise("info")
    )
    issues = ds.small(quality_score).select(F.posexplode("issues").alias("ord", "message"))
    listed = issues.select("ord", severity.alias("severity"), F.lit("Data Quality Issue").alias("title"), "message")
    constants = (
        constant_columns(ds)
        .agg(F.count(F.lit(1)).alias("k"), ordered_list(F.col("column_name")).alias("names"))
        .where("k > 0")
        .select(
            F.lit(1000).alias("ord"),
            F.lit("warning").alias("severity"),
            F.lit("Constant Columns").alias("title"),
            F.concat(
                F.col("k"), F.lit(" column(s) have no variation: "), F.array_join("names", ", "), F.lit(".")
            ).alias("message"),
        )
    )
    share = F.try_divide(F.col("duplicate_rows") * F.lit(100.0), F.col("rows"))
    duplicates = (
        ds.small(duplicate_rows)
        .where("duplicate_rows > 0")
        .select(
            F.lit(1001).alias("ord"),
            F.lit("warning").alias("severity"),
            F.lit("Duplicate Records").alias("title"),
            F.concat(
                F.col("duplicate_rows"),
                F.lit(" duplicate row(s) detected ("),
                fixed(share, 1),
                F.lit("% of dataset)."),
            ).alias("message"),
        )
    )
    return listed.unionByName(constants).unionByName(duplicates).orderBy("ord")


def strength_list(ds: Dataset) -> DataFrame:
    """ord, message: strengths extended with table facts, at most eight."""
    extra = (
        ds.small(quality_score)
        .select("strengths")
        .transform(beside, ds.small(missing_summary).select("complete_columns"))
        .transform(beside, ds.small(table_facts).select("duplicate_rows", "outlier_columns"))
    )
    complete = F.concat(
        F.col("complete_columns"), F.lit(" column(s) have complete data with no missing values.")
    )
    texts = F.concat(
        F.col("strengths"),
        F.array_compact(
            F.array(
                F.when(F.col("complete_columns") > 0, complete),
                F.when(F.col("duplicate_rows") == 0, F.lit("No duplicate records found — dataset is unique.")),
                F.when(F.col("outlier_columns") == 0, F.lit("No extreme outliers detected across numeric features.")),
            )
        ),
    )
    return extra.select(F.posexplode(F.slice(texts, 1, 8)).alias("ord", "message"))


def ml_readiness(ds: Dataset, target: str | None = None) -> DataFrame:
    """One row: five category scores, their rounded mean, recommendations."""

    def clamp(value: Column) -> Column:
        return F.greatest(F.lit(0.0), F.least(F.lit(100.0), value.cast("double")))

    missing = F.col("overall_missing_percentage")
    base = (
        ds.small(quality_score)
        .select("score")
        .transform(beside, ds.small(missing_summary).select("overall_missing_percentage"))
        .transform(beside, ds.small(table_facts))
    )
    features = F.greatest(F.col("columns"), F.lit(1))
    diversity = F.when(features > 5, 80).otherwise(features * 16) + F.when(F.col("pairs") == 0, 20).otherwise(0)
    risk = 100 - F.try_divide(F.col("outlier_columns"), F.greatest("numeric_columns", F.lit(1))) * 100
    parts = base.select(
        "*",
        clamp(F.col("score")).alias("data_quality"),
        clamp(100 - missing * 2).alias("feature_completeness"),
        F.lit(75.0 if target else 60.0).alias("class_balance"),
        clamp(diversity).alias("feature_diversity"),
        clamp(risk).alias("outlier_risk"),
    )
    categories = ("data_quality", "feature_completeness", "class_balance", "feature_diversity", "outlier_risk")
    mean = sum((F.col(c) for c in categories), F.lit(0.0)) / len(categories)
    advice = F.array_compact(
        F.array(
            F.when(missing > 0, F.concat(F.lit("Handle missing values ("), fixed(missing, 1), F.lit("% overall missing)."))),
            F.when(F.col("outlier_columns") > 0, F.concat(F.lit("Review outliers in "), F.col("outlier_columns"), F.lit(" numeric feature(s)."))),
            F.when(F.col("pairs") > 0, F.concat(F.lit("Address "), F.col("pairs"), F.lit(" highly correlated feature pair(s)."))),
            F.lit("Standardize numerical features before training."),
            F.when(F.col("class_columns") > 0, F.concat(F.lit("Encode "), F.col("class_columns"), F.lit(" categorical variable(s)."))),
        )
    )
    return parts.select(
        F.round(mean).cast("int").alias("overall"),
        *[F.round(c, 4).alias(c) for c in categories],
        advice.alias("recommendations"),
    )
