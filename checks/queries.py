"""The registered queries: each reads whole tables under `sf_dir`."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from checks.inputs import load
from plumbline.dataset import Dataset
from plumbline.operators import (
    association,
    evaluation,
    explore,
    importance,
    missingness,
    numeric,
    outliers,
    profile,
    quality,
    responses,
    summary,
    target,
)
from plumbline.plans import eda, experiment
from plumbline.sources import readers, shared, writers

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
_DATASETS: dict[tuple[str, str, str], Dataset] = {}


def dataset(spark: SparkSession, sf_dir: str, name: str) -> Dataset:
    """One Dataset per input and application, so queries share column facts."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _DATASETS:
        _DATASETS[key] = Dataset(load(spark, sf_dir, name))
    return _DATASETS[key]


def forget() -> None:
    """Drop shared facts, so that the next query starts cold."""
    _DATASETS.clear()


def query(name: str) -> Callable[[Query], Query]:
    def add(function: Query) -> Query:
        QUERIES[name] = function
        return function

    return add


def on(name: str, table: str, operator: Callable[..., DataFrame], *args, shape=lambda frame: frame, **kwargs) -> None:
    """Register `operator` applied to the Dataset of `table`."""
    QUERIES[name] = lambda spark, sf_dir: shape(operator(dataset(spark, sf_dir, table), *args, **kwargs))


def joined(*columns: str) -> Callable[[DataFrame], DataFrame]:
    """Array columns shown as one text, so that any client compares them."""
    return lambda frame: frame.withColumns({c: F.array_join(c, " | ", "-") for c in columns})


# -- sources -----------------------------------------------------------------


@query("csv_source")
def _csv_source(spark, sf_dir):
    path = shared.scratch_path(spark, "orders") + ".csv"
    load(spark, sf_dir, "orders").withColumn("o_orderdate", F.date_format("o_orderdate", "yyyy-MM-dd")).write.csv(path, header=True)
    back = readers.read_csv(spark, path)
    ds = Dataset(back)
    kinds = F.concat_ws(",", *[F.lit(f"{f.name}:{f.column_type}") for f in ds.fields])
    return back.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.sum("o_orderkey").alias("sum_key"),
        F.round(F.sum("o_totalprice"), 2).alias("sum_price"),
        F.countDistinct("o_orderdate").alias("dates"),
    ).withColumn("kinds", kinds)


@query("csv_missing_tokens")
def _csv_missing(spark, sf_dir):
    path = shared.scratch_path(spark, "events") + ".csv"
    load(spark, sf_dir, "events_dirty").select(
        "event_id", F.coalesce(F.col("value").cast("string"), F.lit("NA")).alias("value"), F.coalesce("event_type", F.lit("null")).alias("event_type")
    ).write.csv(path, header=True)
    return readers.read_csv(spark, path).agg(
        F.count("event_id").alias("event_ids"), F.count("value").alias("vals"), F.count("event_type").alias("types")
    )


@query("source_checks")
def _source_checks(spark, sf_dir):
    folder = shared.scratch_path(spark, "uploads")
    orders = load(spark, sf_dir, "orders")
    orders.write.csv(f"{folder}/orders.csv", header=True)
    orders.write.csv(f"{folder}/orders.txt", header=True)
    orders.limit(0).coalesce(1).write.csv(f"{folder}/header.csv", header=True)
    orders.limit(0).write.csv(f"{folder}/empty.csv", header=False)
    names = ["orders.csv", "orders.txt", "header.csv", "empty.csv"]
    found = readers.validate_sources(spark, [f"{folder}/{n}" for n in names] + [""])
    name = F.element_at(F.split("path", "/"), -1)
    return found.select(name.alias("file"), F.col("check").alias("failed_check"), "ok", "message")


@query("source_checks_malformed")
def _source_checks_malformed(spark, sf_dir):
    """Every thousandth line has fields beyond the header."""
    path = shared.scratch_path(spark, "uploads") + ".csv"
    line = F.concat_ws(",", "o_orderkey", "o_custkey", F.when(F.col("o_orderkey") % 1000 == 7, F.lit("7,8")))
    lines = load(spark, sf_dir, "orders").select(line.alias("a,b"))
    # Written with another separator and without quotes, so that lines stay as they are.
    lines.write.csv(path, header=True, sep="\t", quote="", escapeQuotes=False)
    found = readers.validate_sources(spark, [path])
    return found.select(F.col("check").alias("failed_check"), "ok", "message")


@query("table_fingerprint")
def _fingerprint(spark, sf_dir):
    return readers.table_fingerprint(load(spark, sf_dir, "orders"))


@query("table_fingerprint_gaps")
def _fingerprint_gaps(spark, sf_dir):
    return readers.table_fingerprint(load(spark, sf_dir, "doc_gaps"))


@query("file_fingerprint")
def _file_fingerprint(spark, sf_dir):
    found = readers.file_fingerprint(spark, f"{sf_dir}/orders.parquet", block=1 << 16)
    return found.select(F.element_at(F.split("path", "/"), -1).alias("file"), "dataset_hash")


@query("result_sink")
def _result_sink(spark, sf_dir):
    ds = dataset(spark, sf_dir, "events_dirty")
    path = shared.scratch_path(spark, "results")
    record = writers.result_record(
        "eda_only", readers.dataset_hash(ds), eda.report_document(ds, "event_type"), metadata={"target": "event_type"}, stamp="20260101T000000Z"
    )
    # The second save takes the place of the first.
    writers.save_result(record, path)
    writers.save_result(record, path)
    return writers.read_runs(spark, path).select("schema_version", "timestamp", "pipeline", F.col("metadata.target").alias("target"), F.get_json_object("eda", "$.rows").cast("bigint").alias("n_rows"))


# -- profile -----------------------------------------------------------------

on("column_types", "orders_mixed", profile.column_types)
on("table_shape", "events_dirty", profile.shape)
on("duplicate_rows", "events_dirty", profile.duplicate_rows)
on("duplicate_documents", "documents", lambda ds: profile.duplicate_rows(Dataset(ds.source.select("text", "lang", "source"))))
on("column_profile", "orders_mixed", profile.column_profile)
on("column_profile_events", "events_dirty", profile.column_profile)
on("column_profile_lineitem", "lineitem", profile.column_profile)
on("column_profile_documents", "documents", profile.column_profile)
on("mode_frequency", "part", profile.mode_frequency)
on("mode_long_text", "documents", profile.mode_frequency)
on("profile_warnings", "orders_mixed", profile.profile_warnings)
on("date_names", "order_dates", profile.date_like_columns)
on("profile_warnings_customer", "customer", profile.profile_warnings)
on("nested_profile", "embeddings", profile.column_profile, shape=lambda f: f.select("column_name", "column_type", "missing_count", "unique_count"))

# -- numeric -----------------------------------------------------------------

on("numeric_stats", "lineitem", numeric.numeric_stats)
on("numeric_stats_orders", "orders_mixed", numeric.numeric_stats)
on("numeric_stats_dirty", "events_dirty", numeric.numeric_stats)
on("box_plot", "lineitem", numeric.box_plot)
on("histogram", "orders", numeric.histogram)
on("histogram_dirty", "events_dirty", numeric.histogram)

# -- association -------------------------------------------------------------

on("pearson_matrix", "lineitem", association.pearson_matrix)
on("pearson_matrix_gaps", "events_dirty", association.pearson_matrix)
def _rounded_pairs(*names: str):
    return lambda f: f.select(*names, F.round("r", 4).alias("value"))


on("pearson_gaps_far", "far_apart", association.pearson_pairs, shape=_rounded_pairs("column_a", "column_b", "n"))
on("pearson_gaps_far_wide", "far_apart", association.pearson_pairs, 1, shape=_rounded_pairs("column_a", "column_b", "n"))
on("pearson_infinite", "infinite", association.pearson_pairs, shape=_rounded_pairs("column_a", "column_b"))
on("pearson_infinite_wide", "infinite", association.pearson_pairs, 1, shape=_rounded_pairs("column_a", "column_b"))
on("pearson_wide", "lineitem", lambda ds: association.pearson_pairs(ds, 2), shape=lambda f: f.select("column_a", "column_b", "n", F.round("r", 4).alias("value")))
on("correlation_view", "orders_mixed", association.correlation_view)
on("correlation_bands", "orders_mixed", association.correlation_bands)
on("cramers_v", "lineitem", association.cramers_v)
on("cramers_v_part", "part", association.cramers_v)
on("cramers_v_gaps", "doc_gaps", association.cramers_v)
on("point_biserial", "doc_labels", association.point_biserial)
on("point_biserial_orders", "orders_mixed", association.point_biserial)
on("associated_pairs", "orders_mixed", association.associated_pairs)
on("associated_pairs_low", "doc_labels", association.associated_pairs, 0.05)

# -- outliers ----------------------------------------------------------------

on("outliers_iqr", "events_dirty", outliers.outliers_iqr)
on("outliers_iqr_lineitem", "lineitem", outliers.outliers_iqr)
on("outliers_zscore", "events_dirty", outliers.outliers_zscore)
on("outliers_zscore_tight", "orders", outliers.outliers_zscore, 1.5)
on("isolation_forest", "events_dirty", outliers.isolation_forest)


@query("isolation_forest_splits")
def _isolation_forest_splits(spark, sf_dir):
    """The forest's answers over the table as it is and dealt anew."""
    table = load(spark, sf_dir, "events_dirty").select("value", "user_id")
    answers = [outliers.isolation_forest(Dataset(frame)) for frame in (table, table.repartition(3), table.repartition(7))]
    every = answers[0].unionByName(answers[1]).unionByName(answers[2])
    n = table.count()
    return every.groupBy("column_name").agg(
        F.countDistinct("if_count").alias("distinct_answers"), F.max(F.col("if_count").between(0, n)).alias("in_range")
    )
on("outlier_summary", "events", outliers.outlier_summary)


def _summary_rules(frame: DataFrame) -> DataFrame:
    """What holds for the forest's counts whatever its seed, beside the counts SQL knows."""
    counts = ("iqr_count", "z_count", "if_count")
    median = sum((F.col(c) for c in counts), F.lit(0)) - F.greatest(*counts) - F.least(*counts)
    votes = sum((F.col(c) for c in counts), F.lit(0))
    return frame.select(
        "ordinal", "column_name", "n", "iqr_count", "z_count",
        (F.col("consensus_count") == median).alias("is_median"),
        F.col("if_count").between(0, F.col("n")).alias("in_range"),
        (F.col("row_consensus") * 2 <= votes).alias("has_two_votes"),
        # Rows both bounds flag have two votes already.
        (F.col("row_consensus") >= F.col("iqr_count") + F.col("z_count") - F.col("n")).alias("holds_common"),
    )


on("outlier_summary_rules", "events_dirty", outliers.outlier_summary, shape=_summary_rules)


@query("outlier_rows")
def _outlier_rows(spark, sf_dir):
    flagged = outliers.flag_rows(dataset(spark, sf_dir, "events_dirty"))
    return flagged.where("value_iqr_outlier").select("event_id", "value", "value_iqr_outlier", "value_z_outlier")


# -- missingness -------------------------------------------------------------

on("missing_columns", "events_dirty", missingness.missing_columns)
on("missing_columns_docs", "doc_gaps", missingness.missing_columns)
on("indicator_correlations", "events_dirty", missingness.indicator_correlations, shape=lambda f: f.select("ordinal", "x", "n", F.round("r", 6).alias("r")))
on("missing_summary", "events_dirty", missingness.missing_summary, shape=joined("likely_mar_columns", "likely_mcar_columns"))

# -- target ------------------------------------------------------------------

on("class_distribution", "events_dirty", target.class_distribution, "event_type")
on("class_distribution_labels", "doc_labels", target.class_distribution, "quality")
on("target_numeric", "orders", target.target_analysis, "o_totalprice")
on("target_imbalance", "doc_labels", target.target_analysis, "quality")
on("target_unsupported", "orders", target.target_analysis, "o_orderdate")
on("target_absent", "orders", target.target_analysis, "no_such_column")
on("task_detection", "orders_mixed", target.task_of_columns)
on("task_detection_embeddings", "embeddings", target.detect_task, "label")

# -- quality -----------------------------------------------------------------

on("quality_score", "events_dirty", quality.quality_score, shape=joined("strengths", "issues", "recommendations"))
on("quality_score_mixed", "orders_mixed", quality.quality_score, shape=joined("strengths", "issues", "recommendations"))
on("quality_notes", "events_dirty", quality.quality_notes)
on("quality_issues", "orders_mixed", quality.quality_issues)
on("strength_list", "events_dirty", quality.strength_list)
on("constant_columns", "orders_mixed", quality.constant_columns)
on("ml_readiness", "events_dirty", quality.ml_readiness, "event_type", shape=joined("recommendations"))


@query("score_bands")
def _score_bands(spark, sf_dir):
    parts = load(spark, sf_dir, "part")
    score = F.col("p_size") * 2.0
    return parts.groupBy(quality.score_band(score).alias("band")).agg(F.count(F.lit(1)).alias("parts"))


# -- summaries ---------------------------------------------------------------

on("feature_summary", "events_dirty", summary.feature_summary, "value")
on("feature_summary_docs", "doc_labels", summary.feature_summary, "n_chars")
on("insights", "events_dirty", summary.insights, shape=lambda f: f.select("section_rank", "message"))
on("insights_mixed", "orders_mixed", summary.insights, shape=lambda f: f.select("section_rank", "message"))
on("insight_severity", "events_dirty", summary.insight_severity, shape=lambda f: f.select("message", "severity"))
on("preprocessing", "events_dirty", summary.preprocessing, "value", shape=joined("columns"))
on("preprocessing_mixed", "orders_mixed", summary.preprocessing, "o_totalprice", shape=joined("columns"))
on("preprocessing_status", "events_dirty", summary.preprocessing_status, "value")
on("recommendations_by_priority", "events_dirty", summary.recommendations_by_priority, "value", shape=joined("messages"))
on("recommended_models", "events_dirty", summary.recommended_models, "event_type")
on("model_recommendation", "events_dirty", summary.model_recommendation, "event_type", shape=joined("models", "preprocessing", "reasoning"))
on("report", "events_dirty", summary.report, "event_type", shape=joined("key_findings", "recommended_models", "preprocessing"))



def _compact(frame: DataFrame) -> DataFrame:
    """Evidence without the forest, whose scores SQL cannot repeat."""
    shown = F.col("section").isin("dataset", "ml_task", "missing", "missing_overall", "outliers", "insights")
    detail = F.regexp_replace("detail", ',"z_count".*$', "}")
    return frame.where("section <> 'random_forest'").withColumn("detail", F.when(shown, detail))


on("evidence", "events_dirty", eda.evidence, "event_type", shape=_compact)
on("evidence_specialists", "orders_mixed", eda.evidence, None, 10, False, {"pairs": 8, "cramers_v": 10}, shape=_compact)
on("own_narrative", "events_dirty", eda.own_narrative, "event_type", shape=joined("key_risks", "recommendations"))
on("eda_sections", "doc_labels", eda.section_sizes, "quality")

# -- importance --------------------------------------------------------------

on("label_codes", "doc_gaps", lambda ds: importance.label_codes(ds, ds.of_type("categorical")), shape=lambda f: f.select("ordinal", "label", "code"))
on("label_codes_parts", "part", lambda ds: importance.label_codes(ds, ds.of_type("categorical"), 0), shape=lambda f: f.select("ordinal", "label", "code"))
on("median_imputation", "doc_gaps", importance.median_imputation)


@query("encoded_features")
def _encoded(spark, sf_dir):
    ds = dataset(spark, sf_dir, "doc_gaps")
    return importance.encoded(ds, "leftover", "classification").withColumnRenamed(importance.TARGET, "y")


on("target_classes", "events_dirty", importance.target_classes, "event_type")
on("mutual_information", "doc_gaps", importance.mutual_information, "leftover", "classification")
on("mutual_information_regression", "doc_gaps", importance.mutual_information, "n_chars", "regression")
on("mutual_information_many_labels", "doc_labels", importance.mutual_information, "toxic")
on("mutual_information_labels", "doc_labels", importance.mutual_information, "quality")
on("forest_importance", "doc_labels", importance.forest_importance, "quality")
on("forest_importance_regression", "doc_labels", importance.forest_importance, "n_chars")
on("top_importance", "doc_labels", importance.top_importance, "quality", None, 3)


def _forest_rules(frame: DataFrame) -> DataFrame:
    """What holds for a forest's scores whatever its seed."""
    return frame.groupBy("method").agg(
        F.count(F.lit(1)).alias("features"),
        F.round(F.sum("normalized_score"), 3).alias("total"),
        F.array_join(F.array_sort(F.collect_list("feature")), ",").alias("names"),
        F.array_join(F.transform(F.array_sort(F.collect_list("rank")), lambda r: r.cast("string")), ",").alias("ranks"),
        F.bool_and(F.col("score").between(0, 1)).alias("in_range"),
    )


on("forest_importance_rules", "doc_labels", importance.forest_importance, "quality", shape=_forest_rules)
on("forest_importance_shallow", "doc_labels", importance.forest_importance, "n_chars", None, 2, shape=_forest_rules)
on("top_importance_rules", "doc_labels", importance.top_importance, "quality", None, 3, shape=lambda f: f.groupBy("method").agg(
    F.count(F.lit(1)).alias("features"), F.sum("rank").alias("ranks"), (F.max("score") == F.max_by("score", -F.col("rank"))).alias("falling")
))
on("importance_status", "doc_labels", importance.importance_status, "quality")

# -- exploration -------------------------------------------------------------

on("top_categories", "events", explore.top_categories, "event_type")
on("top_categories_sources", "documents", explore.top_categories, "source")
on("top_long_texts", "documents", explore.top_categories, "text", shape=lambda f: f.select(F.md5("value").alias("digest"), "count"))
on("scatter_sample", "lineitem", explore.scatter_sample, "l_quantity", "l_extendedprice")
on("feature_table", "lineitem", explore.feature_table, None, "numeric", "l_", "mean", True, shape=lambda f: f.select("place", "column_name", "mean", "skewness"))
on("top_missing", "events_dirty", explore.top_missing)
on("top_outliers", "events_dirty", explore.top_outliers)
on("schema_overview", "events_dirty", explore.schema_overview, "e", "missing", True)
on("schema_totals", "orders_mixed", explore.schema_totals)

# -- responses ---------------------------------------------------------------


def _raw(spark, sf_dir) -> DataFrame:
    return load(spark, sf_dir, "raw_responses")


def _normalised(spark, sf_dir) -> DataFrame:
    return responses.normalise_keys(responses.extract_json(_raw(spark, sf_dir)))


@query("json_extraction")
def _json_extraction(spark, sf_dir):
    return responses.extract_json(_raw(spark, sf_dir)).select("run_id", "pipeline", "strategy", F.md5("json").alias("json_digest"), "parse_error")


@query("key_normalisation")
def _key_normalisation(spark, sf_dir):
    return joined("key_risks", "recommendations")(
        _normalised(spark, sf_dir).select(
            "run_id", "pipeline", F.md5("narrative").alias("narrative_digest"), "key_risks", "recommendations", "confidence"
        )
    )


def _completed(spark, sf_dir) -> DataFrame:
    ds = dataset(spark, sf_dir, "events_dirty")
    return experiment.parse_responses(_raw(spark, sf_dir), eda.own_narrative(ds, "event_type"))


@query("completion_guard")
def _completion_guard(spark, sf_dir):
    done = _completed(spark, sf_dir)
    return done.groupBy("shape", "fallback_used", "status").agg(
        F.count(F.lit(1)).alias("answers"),
        F.count_if(F.col("narrative") != "").alias("narratives"),
        F.count_if(F.size("recommendations") > 0).alias("advised"),
        F.count("confidence").alias("confident"),
    )


@query("run_log_rollup")
def _run_log(spark, sf_dir):
    turns = load(spark, sf_dir, "conversations")
    log = turns.select(
        F.col("conv_id").alias("run_id"),
        F.col("turn").alias("step"),
        F.col("role").alias("node"),
        (F.length("text") / 100.0).alias("seconds"),
        F.md5("text").alias("output"),
        F.lit(1).alias("calls"),
    )
    rolled = responses.roll_up_runs(log)
    return rolled.select(
        "run_id",
        "llm_call_count",
        F.try_element_at("per_node_time", F.lit("user")).alias("user_seconds"),
        F.try_element_at("per_node_time", F.lit("assistant")).alias("assistant_seconds"),
        F.try_element_at("node_outputs", F.lit("assistant")).alias("assistant_output"),
    )


@query("narrative_paragraphs")
def _paragraphs(spark, sf_dir):
    docs = load(spark, sf_dir, "documents").select(F.col("doc_id").alias("run_id"), F.col("text").alias("narrative"))
    return responses.narrative_paragraphs(docs).select("run_id", "paragraph_no", F.md5("paragraph").alias("digest"))


# -- evaluation --------------------------------------------------------------


def _scored_input(spark, sf_dir) -> DataFrame:
    """Answers built by rule from the turns, without the extraction step."""
    raw = _raw(spark, sf_dir)
    return raw.select(
        "run_id",
        "pipeline",
        F.lit("success").alias("status"),
        F.when(F.col("shape") != 5, F.col("said")).alias("narrative"),
        F.when(F.col("shape") % 4 != 3, F.array("risk")).otherwise(F.array().cast("array<string>")).alias("key_risks"),
        F.when(F.col("shape") % 5 != 4, F.array("advice", F.lit("- Use one-hot for labels."))).alias("recommendations"),
        F.when(F.col("shape") != 6, F.col("shape") / 8.0).alias("confidence"),
        (F.col("size") / 7.0).alias("execution_time_seconds"),
        F.when(F.col("pipeline") == "multi_agent", F.create_map(F.lit("llm_call_count"), F.lit("7"))).otherwise(
            F.create_map().cast("map<string,string>")
        ).alias("extra"),
    )


def _conditions(spark, sf_dir) -> DataFrame:
    return evaluation.triggered_conditions(dataset(spark, sf_dir, "events_dirty"), "event_type")


def _checks(spark, sf_dir) -> DataFrame:
    return evaluation.rubric_checks(_scored_input(spark, sf_dir), _conditions(spark, sf_dir))


def _checked(spark, sf_dir) -> DataFrame:
    return evaluation.checked_responses(_scored_input(spark, sf_dir), _conditions(spark, sf_dir))


@query("sentence_split")
def _sentence_split(spark, sf_dir):
    said = evaluation.response_sentences(_scored_input(spark, sf_dir))
    return said.select("run_id", "pipeline", "sentence_no", "sentence")


@query("sentence_tokens")
def _sentence_tokens(spark, sf_dir):
    said = evaluation.response_sentences(_scored_input(spark, sf_dir))
    return said.select("run_id", "pipeline", "sentence_no", F.array_join("words", " ").alias("words"))


@query("action_object_match")
def _action_object(spark, sf_dir):
    said = evaluation.response_sentences(_scored_input(spark, sf_dir))
    rules = evaluation.rubric(spark)
    return evaluation.sentence_matches(said, rules).groupBy("condition_id").agg(
        F.count(F.lit(1)).alias("sentences"), F.count_if("matched").alias("matches")
    )


on("rubric_triggers", "events_dirty", evaluation.rubric_triggers, "event_type", shape=joined("extra_targets"))
on("rubric_triggers_strict", "orders_mixed", evaluation.rubric_triggers, "o_totalprice", True, shape=joined("extra_targets"))
on("triggered_conditions", "events_dirty", evaluation.triggered_conditions, "event_type", shape=joined("actions", "targets", "keywords"))


@query("rubric_checks")
def _rubric_checks(spark, sf_dir):
    return _checks(spark, sf_dir).select("run_id", "pipeline", "condition_id", "recommendation_matched", "weak_match")


@query("rubric_accuracy")
def _rubric_accuracy(spark, sf_dir):
    return evaluation.accuracy(_checks(spark, sf_dir))


@query("keyword_coverage")
def _keyword_coverage(spark, sf_dir):
    return evaluation.keyword_coverage(_checks(spark, sf_dir))


@query("response_metrics")
def _response_metrics(spark, sf_dir):
    return evaluation.response_metrics(_checked(spark, sf_dir))


@query("metric_comparison")
def _metric_comparison(spark, sf_dir):
    return evaluation.metric_comparison(evaluation.response_metrics(_checked(spark, sf_dir)))


@query("evaluation_sink")
def _evaluation_sink(spark, sf_dir):
    """The checks of each pipeline saved as a run, one of them twice."""
    path = shared.scratch_path(spark, "evaluations")
    checks = _checks(spark, sf_dir)
    for pipeline in ("single_agent", "multi_agent", "single_agent"):
        writers.save_evaluation(checks.where(F.col("pipeline") == pipeline), path, f"eval{pipeline}")
    return writers.read_runs(spark, path).groupBy("run_id", "condition_id").agg(
        F.count(F.lit(1)).alias("responses"), F.count_if("recommendation_matched").alias("matched")
    )


@query("comparison_report")
def _comparison_report(spark, sf_dir):
    return evaluation.comparison_report(_checks(spark, sf_dir))


@query("experiment_comparison")
def _experiment(spark, sf_dir):
    events, orders = dataset(spark, sf_dir, "events_dirty"), dataset(spark, sf_dir, "orders_mixed")
    sides = F.when(F.col("run_id") % 2 == 0, readers.dataset_hash(events)).otherwise(readers.dataset_hash(orders))
    raw = _raw(spark, sf_dir).withColumns(
        {
            "dataset_hash": sides,
            "execution_time_seconds": F.col("size") / 7.0,
            "extra": F.create_map().cast("map<string,string>"),
        }
    )
    done = experiment.run_experiment(raw, [(events, "event_type"), (orders, "o_totalprice")])
    return done.comparison.groupBy("metric", "category", "better").agg(F.count(F.lit(1)).alias("runs"))
