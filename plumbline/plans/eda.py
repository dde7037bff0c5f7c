"""The whole analysis of a table, its evidence digest and its own narrative."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from plumbline.dataset import Dataset
from plumbline.functions.columns import beside, fixed, local_frame, union_all
from plumbline.operators import association, importance, missingness, numeric, outliers, profile, quality, summary, target as targets

TOP_EVIDENCE = 5
MAX_RISKS = 5
MAX_RECOMMENDATIONS = 6


def run_eda(
    table: DataFrame | Dataset, target: str | None = None, max_depth: int = importance.MAX_DEPTH
) -> dict[str, DataFrame]:
    """Every section of the analysis by name; `max_depth` is that of the forest behind the importance.

    Sections share the Dataset's column facts: each statistic is scanned once,
    and everything built from it afterwards works on column-level rows.
    """
    ds = table if isinstance(table, Dataset) else Dataset(table)
    gather_facts(ds)
    sections: dict[str, DataFrame] = {
        "profile": ds.small(profile.column_profile),
        "warnings": ds.small(profile.profile_warnings),
        "numeric_statistics": ds.small(numeric.numeric_stats),
        "pearson": ds.small(association.pearson_matrix),
        "cramers_v": ds.small(association.cramers_v),
        "point_biserial": ds.small(association.point_biserial),
        "associated_pairs": ds.small(association.associated_pairs),
        "outliers": ds.small(outliers.outlier_summary),
        "missingness": ds.small(missingness.missing_columns),
        "missingness_summary": ds.small(missingness.missing_summary),
        "quality_score": ds.small(quality.quality_score),
        "insights": ds.small(summary.insights),
        "feature_summary": ds.small(summary.feature_summary, target),
        "ml_task": ds.small(targets.detect_task, target),
        "ml_recommendation": ds.small(summary.model_recommendation, target),
        "preprocessing": ds.small(summary.preprocessing, target),
        "report": ds.small(summary.report, target),
        "importance_status": importance.importance_status(ds, target, _task(ds, target)),
    }
    if target:
        sections["target_analysis"] = ds.small(targets.target_analysis, target)
        sections["class_distribution"] = targets.class_distribution(ds, target)
        if ds.field(target) is not None:
            sections["feature_importance"] = ds.small(importance.feature_importance, target, _task(ds, target), max_depth)
    return sections


def gather_facts(ds: Dataset) -> None:
    """The aggregates of all sections in three shared scans.

    Each needs what the one before found: columns' types and ranges, then means
    and texts that could be dates, then quartiles and spreads.
    """
    ds.gather(ds.summary_request(), profile.gate_request(ds))
    numbers = ds.of_type("numeric")
    ds.gather(
        numeric.moments_request(ds),
        ds.quantiles_request(numbers, numeric.QUARTILES),
        profile.date_request(ds),
        *association.pair_requests(ds),
    )
    if numbers:
        ds.gather(outliers.iqr_request(ds), outliers.zscore_request(ds))


def _task(ds: Dataset, target: str | None) -> str | None:
    """The detected task, which overrides the one the target type suggests."""
    return ds.small(targets.detect_task, target).first()["task"]


def section_sizes(table: DataFrame | Dataset, target: str | None = None) -> DataFrame:
    """section, rows: the row count of every section of `run_eda`."""
    sections = run_eda(table, target)
    marked = [frame.select(F.lit(name).alias("section")) for name, frame in sections.items()]
    names = local_frame(next(iter(sections.values())).sparkSession, [(name,) for name in sections], "section string")
    # One row more for each section, so that empty ones are counted too.
    counted = union_all([names, *marked]).groupBy("section").agg((F.count(F.lit(1)) - 1).alias("rows"))
    return counted.select("section", "rows")


# -- evidence ----------------------------------------------------------------


def evidence(
    ds: Dataset,
    target: str | None = None,
    top: int = TOP_EVIDENCE,
    with_importance: bool = True,
    limits: dict[str, int] | None = None,
) -> DataFrame:
    """section, ord, item, detail: the compact facts a narrator needs.

    Columns without missing values or outliers are left out, pairs, importance
    and insights keep their first `top` rows; `limits` sets other limits by
    section.
    """
    limits = limits or {}

    def listed(section: str, frame: DataFrame, ord_: Column, item: Column, detail: Column, limit: int | None) -> DataFrame:
        rows = frame.select(F.lit(section).alias("section"), ord_.cast("int").alias("ord"), item.alias("item"), detail.alias("detail"))
        limit = limits.get(section, limit)
        return rows if limit is None else rows.orderBy("ord").limit(limit)

    def numbered(frame: DataFrame, *order: str) -> DataFrame:
        return frame.withColumn("place", F.row_number().over(summary.in_order(*order)))

    def json(*columns: str) -> Column:
        return F.to_json(F.struct(*columns))

    overview = (
        ds.small(quality.table_facts)
        .select("rows", "columns", "duplicate_rows")
        .transform(beside, ds.small(quality.quality_score).select("score", "grade"))
    )
    pairs = numbered(ds.small(association.associated_pairs), "method_rank", "ord_a", "ord_b")
    cramer = numbered(ds.small(association.cramers_v), "ord_a", "ord_b")
    said = numbered(ds.small(summary.insights), "section_rank", "ord")
    pair_name = F.concat_ws(" ~ ", "column_a", "column_b")
    parts = [
        listed("dataset", overview, F.lit(1), F.lit("table"), json("rows", "columns", "duplicate_rows", "score", "grade"), None),
        listed("ml_task", ds.small(targets.detect_task, target), F.lit(1), F.coalesce("target", F.lit("")), json("task", "confidence"), None),
        listed("missing", ds.small(missingness.missing_columns).where("missing_count > 0"), F.col("ordinal"), F.col("column_name"), json("missing_count", "missing_percentage", "indicator"), None),
        listed("missing_overall", ds.small(missingness.missing_summary), F.lit(1), F.lit(""), F.to_json(F.struct(F.col("overall_missing_percentage").alias("overall_missing_pct"))), None),
        listed(
            "outliers",
            ds.small(outliers.outlier_summary).where("iqr_count > 0"),
            F.col("ordinal"),
            F.col("column_name"),
            json("iqr_count", "iqr_pct", "lower_bound", "upper_bound", "z_count", "z_pct", "if_count", "if_pct", "consensus_count", "consensus_pct"),
            None,
        ),
        listed("pairs", pairs, F.col("place"), pair_name, json("correlation", "method"), top),
        listed("cramers_v", cramer, F.col("place"), pair_name, json("value"), top),
        listed("numeric", ds.small(numeric.numeric_stats), F.col("ordinal"), F.col("column_name"), json("mean", "std", "min", "max", "skewness"), None),
        listed("insights", said, F.col("place"), F.lit(""), F.col("message"), top),
    ]
    if target and with_importance and ds.field(target) is not None:
        ranked = ds.small(importance.feature_importance, target, _task(ds, target))
        for method in ("random_forest", "mutual_information"):
            rows = ranked.where(F.col("method") == method)
            parts.append(listed(method, rows, F.col("rank"), F.col("feature"), json("score", "rank"), top))
    return union_all(parts).orderBy("section", "ord")


# Sentences of the narrative built from the results alone.
NARRATIVE_TAIL = (
    "Deterministic profiling identified key data health characteristics across missingness patterns, "
    "numeric skewness, and feature relationships required for machine learning readiness."
)
NO_RISKS = "No critical missing values or severe outlier flags were detected."
ADVISE_IMPUTE = "Apply imputation strategy (e.g. median or iterative imputation) for columns with missing values."
ADVISE_PAIRS = "Address multicollinearity by applying dimensionality reduction (PCA) or dropping redundant collinear features."
ADVISE_ENCODE = "Encode categorical features using one-hot or target encoding before model training."
ADVISE_SCALE = "Scale and standardize numeric features using robust scaling to mitigate outlier influence."


def own_narrative(ds: Dataset, target: str | None = None) -> DataFrame:
    """One row: narrative, key_risks, recommendations, confidence from results."""
    missing = ds.small(missingness.missing_columns).where("missing_count > 0").agg(
        missingness.ordered_list(
            F.concat(F.lit("Missing values detected in '"), F.col("column_name"), F.lit("' ("), fixed(F.col("missing_percentage"), 1), F.lit("% missing)."))
        ).alias("missing_risks")
    )
    outlying = ds.small(outliers.outliers_iqr).where("iqr_count > 0").agg(
        missingness.ordered_list(
            F.concat(F.lit("Statistical outliers flagged in '"), F.col("column_name"), F.lit("' ("), F.col("iqr_count"), F.lit(" instances)."))
        ).alias("outlier_risks")
    )
    facts = (
        ds.small(quality.table_facts)
        .select("rows", "columns", "pairs")
        .transform(beside, ds.small(quality.quality_score).select("score", "grade"))
        .transform(beside, ds.small(targets.detect_task, target).select("target", "task"))
        .transform(beside, missing)
        .transform(beside, outlying)
    )
    risks = F.concat("missing_risks", "outlier_risks")
    all_risks = F.when(F.size(risks) == 0, F.array(F.lit(NO_RISKS))).otherwise(risks)
    advice = F.array_compact(
        F.array(
            # The sentence about no risks also names missing values.
            F.when(F.exists(all_risks, lambda r: F.lower(r).contains("missing")), ADVISE_IMPUTE),
            F.when(F.col("pairs") > 0, ADVISE_PAIRS),
            F.lit(ADVISE_ENCODE),
            F.lit(ADVISE_SCALE),
        )
    )
    with_target = F.coalesce(F.concat(F.lit(" with target variable '"), F.col("target"), F.lit("'")), F.lit(""))
    narrative = F.concat(
        F.lit("The dataset contains "),
        F.format_number("rows", 0),
        F.lit(" observations across "),
        F.col("columns"),
        F.lit(" features, identified for a "),
        F.coalesce("task", F.lit("None")),
        F.lit(" task"),
        with_target,
        F.lit(". The automated data quality assessment assigned an overall score of "),
        F.col("score").cast("string"),
        F.lit("/100 (Grade "),
        F.col("grade"),
        F.lit("). " + NARRATIVE_TAIL),
    )
    return facts.select(
        narrative.alias("narrative"),
        F.slice(all_risks, 1, MAX_RISKS).alias("key_risks"),
        F.slice(advice, 1, MAX_RECOMMENDATIONS).alias("recommendations"),
        F.round(F.col("score") / 100, 2).alias("confidence"),
    )


def report_document(ds: Dataset, target: str | None = None) -> DataFrame:
    """One row per table with the report and every column-level section nested."""

    def rows(frame: DataFrame, name: str) -> DataFrame:
        return frame.agg(F.sort_array(F.collect_list(F.struct("*"))).alias(name))

    return (
        ds.small(summary.report, target)
        .transform(beside, rows(ds.small(summary.feature_summary, target), "features"))
        .transform(beside, rows(ds.small(association.associated_pairs), "associated_pairs"))
        .transform(beside, rows(ds.small(missingness.missing_columns).drop("note", "warning"), "missingness"))
    )
