"""Views for exploration: top values, samples, feature and schema tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from plumbline.dataset import Dataset
from plumbline.functions.columns import LONG_TEXT, local_frame, text_key
from plumbline.functions.heavy import top_keys
from plumbline.operators.missingness import missing_columns
from plumbline.operators.outliers import outliers_iqr
from plumbline.operators.profile import column_profile
from plumbline.operators.summary import feature_summary

TOP = 15
SCATTER_POINTS = 60


def top_categories(ds: Dataset, column: str, n: int = TOP) -> DataFrame:
    """value, count, rank: the `n` most frequent values; ties by value.

    A summary of the frequent values names the candidates, which one scan
    counts; long texts are known by digest there, and only texts of the winners
    are looked up. Where no value stands out, all values are counted.
    """
    field = ds.field(column)
    text = field.col.cast("string")
    key = text_key(text, field.longest)
    found = top_keys(ds.df, key, n)
    if found is None:
        counts = ds.df.where(field.col.isNotNull()).groupBy(key.alias("key")).count()
        # Ties are settled on the text, so every key at or above the n-th count stays.
        least = counts.orderBy(F.col("count").desc()).limit(n).agg(F.min("count")).first()[0]
        kept = counts.where(F.col("count") >= F.lit(least))
    else:
        kept = local_frame(ds.spark, found, "key string, count bigint")
    if (field.longest or 0) <= LONG_TEXT:
        top = kept.withColumnRenamed("key", "value")
    else:
        texts = ds.df.select(text.alias("value"), key.alias("key"))
        wanted = kept.select("key")
        texts = texts.join(wanted if found is None else F.broadcast(wanted), "key", "left_semi")
        top = texts.groupBy("key").agg(F.min("value").alias("value")).join(kept, "key")
    top = top.orderBy(F.col("count").desc(), "value").limit(n)
    order = Window.partitionBy(F.lit(0)).orderBy(F.col("count").desc(), "value")
    return top.select("value", "count").withColumn("rank", F.row_number().over(order))


def scatter_sample(ds: Dataset, x: str, y: str, points: int = SCATTER_POINTS) -> DataFrame:
    """A repeatable sample of complete (x, y) rows, ordered by a hash of the row.

    Top-k by hash: each task keeps `points` rows and only those move.
    """
    pair = ds.df.select(ds.field(x).as_double.alias("x"), ds.field(y).as_double.alias("y"), F.xxhash64("*").alias("h"))
    return pair.where("x IS NOT NULL AND y IS NOT NULL").orderBy("h", "x", "y").limit(points).select("x", "y")


def _sort_value(key: str) -> Column:
    """Sort value of a feature-table key; nulls: mean lowest, skew and corr 0."""
    return {
        "name": lambda: F.lower("column_name"),
        "type": lambda: F.col("column_type"),
        "missing": lambda: F.col("missing_count"),
        "unique": lambda: F.col("unique_count"),
        "mean": lambda: F.coalesce("mean", F.lit(float("-inf"))),
        "skew": lambda: F.coalesce("skewness", F.lit(0.0)),
        "outliers": lambda: F.col("outlier_count"),
        "corr": lambda: F.coalesce("target_correlation", F.lit(0.0)),
    }[key]()


def feature_table(
    ds: Dataset,
    target: str | None = None,
    column_type: str = "all",
    search: str = "",
    sort_by: str = "name",
    descending: bool = False,
) -> DataFrame:
    """The feature summary filtered by type and name, and sorted; with `place`."""
    value = _sort_value(sort_by)
    order = value.desc() if descending else value.asc()
    rows = ds.small(feature_summary, target).where(F.lower("column_name").contains(search.lower()))
    if column_type != "all":
        rows = rows.where(F.col("column_type") == column_type)
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(order, "ordinal"))).orderBy("place")


def top_missing(ds: Dataset, n: int = TOP) -> DataFrame:
    """The `n` columns with most missing values."""
    return (
        ds.small(missing_columns)
        .where("missing_count > 0")
        .orderBy(F.col("missing_count").desc(), "ordinal")
        .limit(n)
        .select("column_name", F.col("missing_count").alias("count"), F.col("missing_percentage").alias("percentage"))
    )


def top_outliers(ds: Dataset, n: int = TOP) -> DataFrame:
    """The `n` columns with most IQR outliers and the total over those shown."""
    shown = (
        ds.small(outliers_iqr).where("iqr_count > 0").orderBy(F.col("iqr_count").desc(), "ordinal").limit(n)
    )
    return shown.select(
        "column_name",
        F.col("iqr_count").alias("count"),
        F.col("iqr_pct").alias("percentage"),
        F.sum("iqr_count").over(Window.partitionBy(F.lit(0))).alias("total_shown"),
    )


def missing_severity(percentage: Column) -> Column:
    """good at 0, warning below 10 percent, else critical."""
    return F.when(percentage == 0, "good").when(percentage < 10, "warning").otherwise("critical")


def schema_overview(ds: Dataset, search: str = "", sort_by: str = "name", descending: bool = False) -> DataFrame:
    """One row per column for the overview table, filtered and sorted."""
    value = _sort_value(sort_by)
    order = value.desc() if descending else value.asc()
    rows = ds.small(column_profile).where(F.lower("column_name").contains(search.lower()))
    return (
        rows.select(
            "column_name",
            "dtype",
            "column_type",
            "missing_count",
            "missing_percentage",
            "unique_count",
            missing_severity(F.col("missing_percentage")).alias("quality"),
            F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(order, "ordinal")).alias("place"),
        )
        .orderBy("place")
    )


def schema_totals(ds: Dataset) -> DataFrame:
    """One row: columns per kind and the total of missing values."""
    return ds.small(column_profile).agg(
        F.count_if(F.col("column_type") == "numeric").alias("numeric_columns"),
        F.count_if(F.col("column_type").isin("categorical", "binary")).alias("categorical_columns"),
        F.coalesce(F.sum("missing_count"), F.lit(0)).alias("total_missing"),
    )
