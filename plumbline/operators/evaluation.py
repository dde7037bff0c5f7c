"""Scores written analyses against what the data shows.

Responses are a table: run_id, pipeline, status, narrative, key_risks,
recommendations, confidence, execution_time_seconds, extra.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, functions as F

from plumbline.dataset import Dataset
from plumbline.functions.columns import beside, col_, local_frame, null_of, union_all
from plumbline.functions.rules import HITS, matcher, sentence_matcher
from plumbline.functions.text import sentences, strip, tokens
from plumbline.operators.association import associated_pairs
from plumbline.operators.missingness import missing_columns, missing_summary, ordered_list
from plumbline.operators.outliers import outliers_iqr
from plumbline.operators.profile import distinct_counts
from plumbline.operators.target import detect_task, target_analysis

# Words that negate an action close behind them.
NEGATORS = (
    "not", "no", "never", "avoid", "don't", "dont", "shouldn't", "shouldnt",
    "cannot", "cant", "can't", "without", "neither", "nor", "stop", "refrain",
    "prevent", "won't", "wont", "hardly", "scarcely", "rarely",
)
NEGATION_WINDOW = 4
MISSING_LIMIT = 20.0

# Per condition its description, action stems, target stems, keywords.
RUBRIC = (
    (
        "high_missingness",
        "Dataset has > 20 % overall missing values.",
        ["imput", "fill", "replac", "drop", "remov", "estimat", "handl", "interpolat", "delet", "clean"],
        ["miss", "null", "nan", "empt", "unobserved", "value", "row", "data"],
        ["impute", "imputation", "missing", "drop", "remove", "fill", "median", "mean", "mode", "knn", "interpolat"],
    ),
    (
        "high_correlation",
        "At least one highly correlated numeric feature pair detected.",
        ["drop", "remov", "select", "reduc", "combin", "regulariz", "penaliz", "pca", "vif", "handl", "address", "eliminat", "prun"],
        ["correlat", "multicollinear", "collinear", "redundant", "redundanc", "dimension", "pair", "feature", "variable"],
        ["correlat", "multicollinear", "vif", "redundan", "collinear", "feature select", "dimensionality", "pca", "drop feature"],
    ),
    (
        "outliers_present",
        "Outlier detection flagged at least one feature.",
        ["cap", "clip", "transform", "winsoriz", "scale", "remov", "drop", "filter", "handl", "treat", "robust", "mitigat"],
        ["outlier", "anomal", "extreme", "skew", "kurtosis", "leverage", "value", "tail", "point"],
        ["outlier", "anomal", "cap", "clip", "transform", "log", "winsoriz", "robust", "iqr", "z-score"],
    ),
    (
        "categorical_features",
        "Dataset contains categorical or object-dtype features.",
        ["encod", "convert", "transform", "dummy", "one-hot", "onehot", "represent", "map", "embed", "factoriz", "ordinal"],
        ["categor", "text", "string", "discrete", "factor", "label", "feature", "variable", "column"],
        ["encod", "one-hot", "label encod", "ordinal", "categor", "dummy", "target encod", "embed"],
    ),
    (
        "class_imbalance",
        "Classification target with suspected class imbalance.",
        ["resampl", "oversampl", "undersampl", "smote", "weight", "stratif", "balanc", "adjust", "handl", "evaluat", "optim", "tune"],
        ["imbalanc", "minority", "majority", "skew", "class", "distribution", "ratio", "f1", "auc", "pr-auc", "target"],
        ["imbalance", "imbalanced", "resample", "oversample", "undersample", "smote", "class weight", "stratif", "weighted"],
    ),
    (
        "regression_task",
        "Detected ML task is regression.",
        ["predict", "model", "train", "fit", "optimiz", "use", "appl", "recommend", "select", "tune", "evaluat"],
        ["regression", "linear regression", "ridge", "lasso", "elasticnet", "random forest", "gradient boost", "xgboost", "lightgbm", "svr", "rmse", "mae", "mse", "r2", "continuous", "target"],
        ["regression", "linear regression", "ridge", "lasso", "xgboost", "gradient boost", "random forest regress", "svr", "continuous target", "numeric target"],
    ),
)

RUBRIC_SCHEMA = (
    "condition_id string, description string, actions array<string>, targets array<string>, keywords array<string>"
)

# Metric, category, better direction (None: descriptive).
METRICS = (
    ("output_completeness", "STRUCTURAL", "higher"),
    ("narrative_length_chars", "DESCRIPTIVE", None),
    ("key_risk_count", "DESCRIPTIVE", None),
    ("recommendation_count", "DESCRIPTIVE", None),
    ("confidence_score", "SELF-REPORTED", None),
    ("execution_time_seconds", "EFFICIENCY", "lower"),
    ("llm_call_count", "EFFICIENCY", "lower"),
    ("recommendation_accuracy", "CORRECTNESS", "higher"),
)
NOTES = {
    "STRUCTURAL": "Share of the required fields that are filled.",
    "DESCRIPTIVE": "A size only; neither side is better for it.",
    "SELF-REPORTED": "Claimed by the model itself and not verified.",
    "EFFICIENCY": "The smaller value is better.",
    "CORRECTNESS": "Share of the triggered conditions that are answered; null where none is.",
}
SINGLE, MULTI = "single_agent", "multi_agent"


# -- rubric against the data -------------------------------------------------


def rubric(spark) -> DataFrame:
    """The rubric as a table; append rows to extend it."""
    return local_frame(spark, [list(row) for row in RUBRIC], RUBRIC_SCHEMA)


def rubric_triggers(ds: Dataset, target: str | None = None, strict: bool = False) -> DataFrame:
    """condition_id, triggered, extra_targets for the six conditions.

    By default a table with any checked numeric column counts as having
    outliers; `strict` asks for at least one actual outlier.
    """

    def names(frame: DataFrame, column: str = "column_name") -> DataFrame:
        return frame.agg(ordered_list(F.col(column)).alias("extra_targets"))

    if ds.field(target) is not None:
        # The task asks for them anyway; known first, they spare the associations scans of their own.
        ds.small(distinct_counts, None)
    missing = ds.small(missing_columns)
    checked = ds.small(outliers_iqr)
    if strict:
        checked = checked.where("iqr_count > 0")
    pairs = ds.small(associated_pairs).select(F.explode(F.array("column_a", "column_b")).alias("column_name")).distinct()
    pair_names = pairs.agg(F.array_sort(F.collect_list("column_name")).alias("extra_targets"))
    classes = ds.small(Dataset.summary).where(F.col("column_type").isin("categorical", "binary", "datetime"))
    task = ds.small(detect_task, target).select("target", "task")
    goal = F.array_compact(F.array("target"))
    warned = ds.small(target_analysis, target).select(F.lower("warning").contains("imbalance").alias("warned"))
    some = F.size("extra_targets") > 0
    rows = [
        (
            "high_missingness",
            names(missing.where("missing_count > 0")).transform(beside, ds.small(missing_summary)),
            F.col("overall_missing_percentage") > MISSING_LIMIT,
        ),
        ("high_correlation", pair_names, some),
        ("outliers_present", names(checked), some),
        ("categorical_features", names(classes), some),
        (
            "class_imbalance",
            task.transform(beside, warned).withColumn("extra_targets", goal),
            F.coalesce(F.col("task").contains("classif") & F.col("warned"), F.lit(False)),
        ),
        (
            "regression_task",
            task.withColumn("extra_targets", goal),
            F.coalesce(F.col("task").contains("regression"), F.lit(False)),
        ),
    ]
    return union_all(
        [
            frame.select(F.lit(name).alias("condition_id"), test.alias("triggered"), "extra_targets")
            for name, frame, test in rows
        ]
    )


def triggered_conditions(ds: Dataset, target: str | None = None, strict: bool = False) -> DataFrame:
    """The rubric rows the data triggers, with column names among the targets."""
    lowered = F.transform("extra_targets", lambda t: F.lower(F.trim(t)))
    merged = F.array_distinct(F.concat("targets", F.filter(lowered, lambda t: t != "")))
    return (
        rubric(ds.spark)
        .join(ds.small(rubric_triggers, target, strict).where("triggered"), "condition_id")
        .select("condition_id", "description", "actions", merged.alias("targets"), "keywords")
    )


# -- action-object grammar ---------------------------------------------------


def _is_phrase(stem: Column) -> Column:
    return stem.contains(" ") | stem.contains("-")


def _starts_or_holds(token: Column, stem: Column) -> Column:
    return token.startswith(stem) | ((F.length(stem) >= 4) & token.contains(stem))


def names_target(sentence: Column, words: Column, targets: Column) -> Column:
    """Does the sentence mention one of the target stems?

    A token that is a prefix of a stem also counts.
    """
    lowered = F.lower(sentence)
    return F.exists(
        targets,
        lambda t: (t != "")
        & F.when(_is_phrase(t), lowered.contains(t)).otherwise(
            F.exists(words, lambda w: _starts_or_holds(w, t) | t.startswith(w))
        ),
    )


def affirms_action(sentence: Column, words: Column, actions: Column, window: int = NEGATION_WINDOW) -> Column:
    """Does it hold an action stem with no negator in the `window` tokens before?

    A phrase action counts unless a negator ends 1 to 25 characters before it.
    """
    lowered = F.lower(sentence)
    negators = F.array(*[F.lit(n) for n in NEGATORS])
    negated = r"\b(" + "|".join(NEGATORS) + r")\b.{1,25}"
    phrase = F.exists(
        actions,
        lambda a: _is_phrase(a)
        & lowered.contains(a)
        & ~F.rlike(lowered, F.concat(F.lit(negated + r"\Q"), a, F.lit(r"\E"))),
    )

    def acts(word: Column, at: Column) -> Column:
        before = F.slice(words, F.greatest(at - F.lit(window), F.lit(0)) + 1, F.least(at, F.lit(window)))
        return F.exists(actions, lambda a: (a != "") & _starts_or_holds(word, a)) & ~F.arrays_overlap(before, negators)

    single = F.exists(F.transform(words, acts), lambda hit: hit)
    return phrase | single


def grammar_match(
    sentence: Column, words: Column, actions: Column, targets: Column, window: int = NEGATION_WINDOW
) -> Column:
    """An affirmative action on a target within one sentence."""
    return (
        (F.size(words) > 0)
        & names_target(sentence, words, targets)
        & affirms_action(sentence, words, actions, window)
    )


def _all_sentences() -> Column:
    """Sentences of the recommendations, then of the narrative."""
    advice = F.flatten(F.transform(F.coalesce("recommendations", F.array().cast("array<string>")), sentences))
    return F.concat(advice, sentences(F.coalesce("narrative", F.lit(""))))


def with_rules(frame: DataFrame, rules: DataFrame) -> DataFrame:
    """Each row of `frame` once per rule; the rules travel as one literal.

    Rules are a written table of a few rows.
    """
    packed = rules.agg(F.to_json(F.collect_list(F.struct("*"))).alias("rules")).first()["rules"]
    schema = rules.select(F.array(F.struct("*")).alias("r")).schema["r"].dataType
    return frame.select("*", F.inline(F.from_json(F.lit(packed), schema)))


def response_sentences(responses: DataFrame) -> DataFrame:
    """run_id, pipeline, sentence_no, sentence, words."""
    return responses.select(
        "run_id", "pipeline", F.posexplode(_all_sentences()).alias("sentence_no", "sentence")
    ).withColumn("words", tokens(F.col("sentence")))


def _packed_rules(conditions: DataFrame) -> Column:
    """All rules of a group as one JSON list, in order of their names."""
    return F.to_json(F.array_sort(F.collect_list(F.struct(*[F.col(f.split()[0]) for f in RUBRIC_SCHEMA.split(", ")]))))


def sentence_matches(said: DataFrame, rules: DataFrame, window: int = NEGATION_WINDOW) -> DataFrame:
    """`said` once per rule: its columns, condition_id and matched, as `grammar_match` finds it.

    One automaton over the stems of all rules meets each sentence once. Rules
    are a written table of a few rows.
    """
    packed = rules.agg(_packed_rules(rules).alias("rules_")).first()["rules_"]
    names = [rule["condition_id"] for rule in json.loads(packed)]
    if not names:
        return said.limit(0).withColumns({"condition_id": null_of("string"), "matched": null_of("boolean")})
    hits = F.arrow_udf(sentence_matcher(NEGATORS, window, packed), "array<boolean>").asNondeterministic()
    met = said.withColumn("hits_", hits(F.col("sentence")))
    pairs = F.arrays_zip(F.array(*map(F.lit, names)).alias("condition_id"), F.col("hits_").alias("matched"))
    return met.select(*[col_(c) for c in said.columns], F.inline(pairs).alias("condition_id", "matched"))


def checked_responses(responses: DataFrame, conditions: DataFrame, window: int = NEGATION_WINDOW) -> DataFrame:
    """`responses` with a column `checks`: one struct per condition of the response's evidence.

    A struct has condition_id, description, keywords, recommendation_matched and
    weak_match (followed only by words under three letters that begin a target,
    such as "a" for "age"). All rules of an evidence are matched together, by
    one automaton that meets each response once; nothing is shuffled. An entry
    without actions or targets falls back to its keywords. With a
    `dataset_hash` on both sides a response meets only the conditions of its own
    dataset, and responses of other datasets are left out.
    """
    shared = None
    if "dataset_hash" in responses.columns and "dataset_hash" in conditions.columns:
        packed = conditions.groupBy("dataset_hash").agg(_packed_rules(conditions).alias("rules_"))
        paired = responses.join(packed, "dataset_hash").select(*[col_(c) for c in responses.columns], "rules_")
    else:
        # Rules are a written table of a few rows: they travel as one literal.
        packed = conditions.agg(_packed_rules(conditions).alias("rules_")).first()["rules_"]
        paired, shared = responses.withColumn("rules_", F.lit(packed)), packed
    hits = F.arrow_udf(matcher(NEGATORS, window, shared), HITS)
    # Else the optimizer repeats the call in the filters it infers, each with workers of its own.
    hits = hits.asNondeterministic()
    rules = F.from_json("rules_", f"array<struct<{RUBRIC_SCHEMA.replace(' string', ':string').replace(' array', ':array')}>>")
    checks = F.zip_with(
        rules,
        F.col("hits_"),
        lambda rule, hit: F.struct(
            rule["condition_id"].alias("condition_id"),
            rule["description"].alias("description"),
            rule["keywords"].alias("keywords"),
            hit["matched"].alias("recommendation_matched"),
            hit["weak"].alias("weak_match"),
        ),
    )
    met = paired.withColumn("hits_", hits(*map(F.col, ("recommendations", "narrative") if shared is not None else ("recommendations", "narrative", "rules_"))))
    return met.select(*[col_(c) for c in responses.columns], checks.alias("checks"))


def _keys(frame: DataFrame) -> list[str]:
    """What names a response: the same run may meet several datasets."""
    return ["run_id", "pipeline"] + (["dataset_hash"] if "dataset_hash" in frame.columns else [])


def _run_keys(frame: DataFrame) -> list[str]:
    return [key for key in _keys(frame) if key != "pipeline"]


def rubric_checks(responses: DataFrame, conditions: DataFrame, window: int = NEGATION_WINDOW) -> DataFrame:
    """run_id, pipeline, condition_id, description, keywords, recommendation_matched, weak_match.

    One row per response and condition, as `checked_responses` finds them; with
    a `dataset_hash` on both sides it is among the columns.
    """
    keys = ["run_id", "pipeline"]
    if "dataset_hash" in responses.columns and "dataset_hash" in conditions.columns:
        keys.append("dataset_hash")
    return checked_responses(responses, conditions, window).select(*keys, F.inline("checks"))


def accuracy(checks: DataFrame) -> DataFrame:
    """run_id, pipeline (and dataset_hash), matched, triggered, recommendation_accuracy."""
    return (
        checks.groupBy(*_keys(checks))
        .agg(F.count_if("recommendation_matched").alias("matched"), F.count(F.lit(1)).alias("triggered"))
        .withColumn("recommendation_accuracy", F.round(F.try_divide("matched", "triggered"), 4))
    )


def keyword_coverage(checks: DataFrame) -> DataFrame:
    """run_id, pipeline (and dataset_hash), matched, total, pct: keywords of the matched conditions."""
    size = F.size("keywords")
    return (
        checks.groupBy(*_keys(checks))
        .agg(F.sum(F.when(F.col("recommendation_matched"), size).otherwise(0)).alias("matched"), F.sum(size).alias("total"))
        .withColumn("pct", F.round(F.coalesce(F.try_divide(F.col("matched") * F.lit(100.0), F.col("total")), F.lit(0.0)), 4))
    )


# -- metrics -----------------------------------------------------------------


def response_metrics(responses: DataFrame) -> DataFrame:
    """One row per response with the eight metrics and the status.

    Accuracy is read off the row's own `checks`, where `checked_responses` put
    them; without that column, or without a condition, it is null.
    """
    filled = [
        F.coalesce(strip(F.col("narrative")) != "", F.lit(False)),
        F.coalesce(F.size("key_risks") > 0, F.lit(False)),
        F.coalesce(F.size("recommendations") > 0, F.lit(False)),
        F.col("confidence").try_cast("double").isNotNull(),
    ]
    present = sum((f.cast("int") for f in filled), F.lit(0))
    confidence = F.col("confidence").cast("string").try_cast("double")
    seconds = F.col("execution_time_seconds").cast("string").try_cast("double")
    calls = F.try_element_at("extra", F.lit("llm_call_count")).try_cast("int")
    if "checks" in responses.columns:
        matched = F.size(F.filter("checks", lambda check: check["recommendation_matched"]))
        right = F.round(F.try_divide(matched, F.size("checks")), 4)
    else:
        right = null_of("double")
    return responses.select(
        *_keys(responses),
        F.col("status") if "status" in responses.columns else F.lit("unknown").alias("status"),
        F.round(present / 4, 4).alias("output_completeness"),
        F.length(F.coalesce("narrative", F.lit(""))).alias("narrative_length_chars"),
        F.greatest(F.coalesce(F.size("key_risks"), F.lit(0)), F.lit(0)).alias("key_risk_count"),
        F.greatest(F.coalesce(F.size("recommendations"), F.lit(0)), F.lit(0)).alias("recommendation_count"),
        F.when(confidence.isNotNull(), F.round(F.greatest(F.least(confidence, F.lit(1.0)), F.lit(0.0)), 4)).alias(
            "confidence_score"
        ),
        F.coalesce(F.round(seconds, 3), F.lit(0.0)).alias("execution_time_seconds"),
        F.coalesce(calls, F.when(F.col("pipeline") == SINGLE, 1).otherwise(0)).alias("llm_call_count"),
        right.alias("recommendation_accuracy"),
    )


def metric_comparison(metrics: DataFrame) -> DataFrame:
    """run_id (and dataset_hash), ord, metric, category, m4_value, m5_value, better, note.

    Descriptive and self-reported metrics have no better side; there is no
    overall winner.
    """
    keys = _run_keys(metrics)
    long = metrics.select(
        *keys,
        "pipeline",
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(i).alias("ord"), F.col(name).cast("double").alias("value"))
                    for i, (name, _, _) in enumerate(METRICS)
                ]
            )
        ),
    )
    sides = long.groupBy(*keys, "ord").agg(
        F.max(F.when(F.col("pipeline") == SINGLE, F.col("value"))).alias("m4_value"),
        F.max(F.when(F.col("pipeline") == MULTI, F.col("value"))).alias("m5_value"),
    )
    table = local_frame(metrics.sparkSession, [(i, *row, NOTES[row[1]]) for i, row in enumerate(METRICS)],
        "ord int, metric string, category string, direction string, note string",
    )
    a, b = F.col("m4_value"), F.col("m5_value")
    first = F.when(F.col("direction") == "higher", a > b).otherwise(a < b)
    better = F.when(
        F.col("direction").isNotNull() & a.isNotNull() & b.isNotNull(),
        F.when(a == b, "tie").when(first, "m4").otherwise("m5"),
    )
    return sides.join(F.broadcast(table), "ord").select(
        *keys, "ord", "metric", "category", "m4_value", "m5_value", better.alias("better"), "note"
    )


def comparison_report(checks: DataFrame) -> DataFrame:
    """run_id (and dataset_hash), condition_id, m4, m5 as OK / NO / - per condition."""

    def mark(pipeline: str) -> Column:
        hit = F.max(F.when(F.col("pipeline") == pipeline, F.col("recommendation_matched")))
        return F.when(hit, "OK").when(~hit, "NO").otherwise("-")

    return checks.groupBy(*_run_keys(checks), "condition_id").agg(mark(SINGLE).alias("m4"), mark(MULTI).alias("m5"))
