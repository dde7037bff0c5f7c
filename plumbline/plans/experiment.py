"""Score the answers of two pipelines against the same evidence."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from plumbline.dataset import Dataset
from plumbline.functions.columns import union_all
from plumbline.operators import evaluation, responses
from plumbline.plans.eda import own_narrative
from plumbline.sources.readers import dataset_hash

# Responses differ in what they cost, so a core gets several parts of them.
TASKS_PER_CORE = 4


@dataclass(frozen=True)
class Experiment:
    """The tables of one evaluation."""

    responses: DataFrame
    checks: DataFrame
    metrics: DataFrame
    comparison: DataFrame


def evidence_of(datasets: list[tuple[Dataset, str | None]]) -> DataFrame:
    """The triggered conditions of each dataset, keyed by dataset_hash."""
    return union_all(
        [
            evaluation.triggered_conditions(ds, target).select(F.lit(dataset_hash(ds)).alias("dataset_hash"), "*")
            for ds, target in datasets
        ]
    )


def parse_responses(raw: DataFrame, fallback: DataFrame) -> DataFrame:
    """Raw texts to scored fields: extract, normalise, complete.

    Parsing takes far longer than reading, and a file may have fewer splits
    than there are cores, so the rows are dealt over all of them first.
    """
    dealt = raw.repartition(raw.sparkSession.sparkContext.defaultParallelism * TASKS_PER_CORE)
    ready = responses.complete(responses.normalise_keys(responses.extract_json(dealt)), fallback)
    status = F.when(F.col("parse_error").isNotNull() & ~F.col("fallback_used"), "error").otherwise("success")
    return ready.withColumn("status", status)


def run_experiment(raw: DataFrame, datasets: list[tuple[Dataset, str | None]]) -> Experiment:
    """Both pipelines of every run meet the evidence of their own dataset.

    `raw` has run_id, pipeline, dataset_hash, text, execution_time_seconds and
    extra. Evidence is computed once per dataset and joined by its hash, so the
    two sides cannot see different facts.
    """
    fallback = union_all(
        [own_narrative(ds, target).withColumn("dataset_hash", F.lit(dataset_hash(ds))) for ds, target in datasets]
    )
    parsed = parse_responses(raw, fallback)
    checked = evaluation.checked_responses(parsed, evidence_of(datasets))
    metrics = evaluation.response_metrics(checked)
    checks = checked.select("run_id", "pipeline", "dataset_hash", F.inline("checks"))
    return Experiment(parsed, checks, metrics, evaluation.metric_comparison(metrics))
