"""JSON sinks for analysis results and evaluations: each run is there once or not at all."""

from __future__ import annotations

import uuid
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from plumbline.functions.columns import beside

SCHEMA_VERSION = "1.0"


def timestamp_label(moment: datetime | None = None) -> str:
    """A UTC label such as 20260131T235959Z."""
    moment = moment or datetime.now(tz=timezone.utc)
    return moment.astimezone(timezone.utc).strftime("%Y%m%dT%H%M%SZ")


def result_record(
    pipeline: str,
    dataset_hash: str,
    eda: DataFrame,
    agent: DataFrame | None = None,
    metadata: dict[str, str] | None = None,
    stamp: str | None = None,
) -> DataFrame:
    """One row: schema_version, timestamp, pipeline, dataset_hash, metadata, eda, agent.

    `eda` has one row (see `report_document`); `agent` one row or none.
    """
    stamp = stamp or timestamp_label()
    entries = [F.lit(x) for pair in (metadata or {}).items() for x in map(str, pair)]
    meta: Column = F.create_map(*entries) if entries else F.create_map().cast("map<string,string>")
    record = eda.select(F.to_json(F.struct("*")).alias("eda"))
    if agent is None:
        record = record.withColumn("agent", F.lit(None).cast("string"))
    else:
        record = beside(record, agent.select(F.to_json(F.struct("*")).alias("agent")))
    return record.select(
        F.lit(SCHEMA_VERSION).alias("schema_version"),
        F.lit(stamp).alias("timestamp"),
        F.lit(pipeline).alias("pipeline"),
        F.lit(dataset_hash).alias("dataset_hash"),
        F.concat_ws("_", F.lit(stamp), F.lit(pipeline), F.lit(dataset_hash)).alias("name"),
        meta.alias("metadata"),
        "eda",
        "agent",
    )


def save_result(record: DataFrame, path: str) -> None:
    """Save the record of one run under `path`; saving it again replaces it."""
    save_run(record, path, record.select("name").first()["name"])


def evaluation_run_id(dataset_hash: str, stamp: str | None = None) -> str:
    return f"{stamp or timestamp_label()}_eval_{dataset_hash}"


def save_evaluation(frame: DataFrame, path: str, run_id: str) -> None:
    """Save an evaluation table (metrics, checks or comparison) as the run `run_id`."""
    save_run(frame, path, run_id)


# -- runs --------------------------------------------------------------------
#
# A run is written first and committed after: rows go to data/run_id=../attempt=..,
# then one row that names the attempt goes to commits/. Readers take the latest
# committed attempt of each run, so a crash leaves nothing visible, and saving
# a run once more (after a crash, or by a retried driver) leaves one record.

_COMMIT = "run_id string, attempt string"


def save_run(frame: DataFrame, path: str, run_id: str) -> None:
    """Write the rows of a run under `path` and commit them."""
    moment = datetime.now(tz=timezone.utc).strftime("%Y%m%dT%H%M%S%f")
    attempt = f"{moment}-{uuid.uuid4().hex}"
    placed = frame.withColumns({"run_id": F.lit(run_id), "attempt": F.lit(attempt)})
    placed.write.partitionBy("run_id", "attempt").mode("append").json(f"{path}/data")
    commit = frame.sparkSession.createDataFrame([(run_id, attempt)], _COMMIT)
    commit.coalesce(1).write.mode("append").json(f"{path}/commits")


def committed_runs(spark: SparkSession, path: str) -> DataFrame:
    """run_id, attempt: the latest committed attempt of each run."""
    commits = spark.read.schema(_COMMIT).json(f"{path}/commits")
    return commits.groupBy("run_id").agg(F.max("attempt").alias("attempt"))


def read_runs(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """The rows of all committed runs under `path`, with their `run_id`.

    The attempt is a partition of the data, so attempts that are not the
    latest are not read. `schema` saves the scan that infers the types.
    """
    if schema is None:
        seen = spark.read.json(f"{path}/data").drop("run_id", "attempt").schema
    else:
        seen = T.StructType.fromDDL(schema)
    # Names of runs stay text, also those that look like numbers.
    named = T.StructType([*seen.fields, *T.StructType.fromDDL(_COMMIT).fields])
    rows = spark.read.schema(named).json(f"{path}/data")
    return rows.join(committed_runs(spark, path), ["run_id", "attempt"]).drop("attempt")
