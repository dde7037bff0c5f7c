"""The corpus pipeline: documents in, packed training sequences out.

Each stage takes (spark, docs, sf_dir) and works on all its predecessor kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from plumbline.llm.common import read_table, stage
from plumbline.llm.decontaminate import drop_contaminated
from plumbline.llm.exact_dedup import drop_exact_duplicates
from plumbline.llm.near_dedup import drop_near_duplicates
from plumbline.llm.packing import pack
from plumbline.llm.quality import keep_quality


# Documents this similar (in percent, on five-word shingles) or more are one group.
NEAR_PERCENT = 80


def _quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_quality(docs, read_table(spark, sf_dir, "labels"))


def _exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_exact_duplicates(docs, keep="largest")


def _near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_near_duplicates(docs, percent=NEAR_PERCENT)


def _clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def _packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs)


STAGES = [
    ("quality classifier", _quality),
    ("exact dedup", _exact),
    ("near dedup", _near),
    ("decontamination", _clean),
    ("packing", _packed),
]

# A fitted model and tokenised windows: SQL cannot express the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written to the shared folder and reread."""
    docs = read_table(spark, sf_dir, "documents")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
