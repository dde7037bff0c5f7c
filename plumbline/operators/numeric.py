"""Univariate numeric statistics, box-plot positions and histograms."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from plumbline.dataset import Dataset, Field, Request
from plumbline.functions.columns import column_level, local_frame, null_of, stack_columns

QUARTILES = (0.25, 0.5, 0.75)
BINS = 20

STATS_SCHEMA = (
    "ordinal int, column_name string, n bigint, mean double, median double, std double, "
    "min double, max double, q1 double, q3 double, skewness double, kurtosis double"
)


def _moments(field: Field) -> Column:
    """Known facts as literals plus the centred power sums of one column."""
    d = field.as_double - F.lit(field.mean)
    return F.struct(
        F.lit(field.ordinal).alias("ordinal"),
        F.lit(field.name).alias("column_name"),
        F.lit(field.n).cast("bigint").alias("n"),
        F.lit(field.mean).alias("mean"),
        F.lit(field.low).alias("min"),
        F.lit(field.high).alias("max"),
        F.sum(d * d).alias("s2"),
        F.sum(d * d * d).alias("s3"),
        F.sum(d * d * d * d).alias("s4"),
    )


def moments_request(ds: Dataset) -> Request:
    return Request("moments", [_moments(f) for f in ds.of_type("numeric")])


def raw_stats(ds: Dataset) -> DataFrame:
    """Unrounded statistics of every numeric column.

    The mean is known from the first scan, so the moments are exact two-pass
    sums: cheaper in code generation than running moments, and more accurate.
    """
    fields = ds.of_type("numeric")
    if not fields:
        return local_frame(ds.spark, [], STATS_SCHEMA)
    quartiles = ds.quantiles(fields, QUARTILES)
    found = local_frame(ds.spark, [(f.ordinal, *quartiles[f.name]) for f in fields], "ordinal int, q1 double, median double, q3 double"
    )
    sums = ds.scan(moments_request(ds)).join(found, "ordinal")
    n = F.col("n").cast("double")
    constant = F.col("min") == F.col("max")
    variance = F.try_divide(F.col("s2"), n)
    g1 = F.try_divide(F.try_divide(F.col("s3"), n), variance * F.sqrt(variance))
    g2 = F.try_divide(F.try_divide(F.col("s4"), n), variance * variance) - 3
    std = F.when(n > 1, F.sqrt(F.try_divide(F.col("s2"), n - 1))).otherwise(0.0)
    skewness = F.when(
        (n > 2) & ~constant, g1 * F.try_divide(F.sqrt(n * (n - 1)), n - 2)
    ).otherwise(0.0)
    kurtosis = F.when(
        (n > 3) & ~constant, F.try_divide(n - 1, (n - 2) * (n - 3)) * ((n + 1) * g2 + 6)
    ).otherwise(0.0)
    return sums.select(
        "ordinal",
        "column_name",
        "n",
        "mean",
        "median",
        F.when(constant, 0.0).otherwise(std).alias("std"),
        "min",
        "max",
        "q1",
        "q3",
        skewness.alias("skewness"),
        kurtosis.alias("kurtosis"),
    )


_MEASURES = ("mean", "median", "std", "min", "max", "q1", "q3", "skewness", "kurtosis")


@column_level
def numeric_stats(ds: Dataset) -> DataFrame:
    """Statistics of every numeric column, 4 decimals."""
    return ds.small(raw_stats).select(
        "ordinal", "column_name", "n", *[F.round(m, 4).alias(m) for m in _MEASURES]
    )


def box_plot(ds: Dataset) -> DataFrame:
    """Five numbers and the mean, each also as a position 0..100 on the range."""
    spread = F.col("max") - F.col("min")
    width = F.when(spread == 0, 1.0).otherwise(spread)

    def at(name: str) -> Column:
        return F.round((F.col(name) - F.col("min")) / width * 100, 4).alias(f"{name}_position")

    marks = ("min", "q1", "median", "q3", "max", "mean")
    return ds.small(numeric_stats).select("ordinal", "column_name", *marks, *[at(m) for m in marks])


def histogram(ds: Dataset, bins: int = BINS) -> DataFrame:
    """`bins` equal-width bins per numeric column, empty bins included.

    ordinal, column_name, bin, bin_start, bin_end, cnt, is_mean, is_median.
    Columns without spread have no bins.
    """
    schema = (
        "ordinal int, column_name string, bin int, bin_start double, bin_end double, "
        "cnt bigint, is_mean boolean, is_median boolean"
    )
    fields = [f for f in ds.of_type("numeric") if f.low < f.high]
    if not fields:
        return local_frame(ds.spark, [], schema)
    medians = ds.quantiles(fields, QUARTILES)
    def slot(f: Field) -> Column:
        if not (math.isfinite(f.low) and math.isfinite(f.high)):
            return null_of("int")
        # The share of the range times the bins, in this order: on a bin's edge
        # width_bucket, which divides last, may round to the other side of it.
        share = (f.as_double - F.lit(f.low)) / F.lit(f.high - f.low)
        # The maximum falls one past the last bin; least() alone would also
        # turn the null of a missing value into the last bin.
        return F.when(f.col.isNotNull(), F.least(F.floor(share * F.lit(float(bins))) + 1, F.lit(bins)))

    placed = [F.struct(F.lit(f.ordinal).alias("ordinal"), slot(f).cast("int").alias("bin")) for f in fields]
    counts = stack_columns(ds.df, placed).where("bin IS NOT NULL").groupBy("ordinal", "bin").agg(F.count(F.lit(1)).alias("cnt"))
    frame = local_frame(ds.spark, [(f.ordinal, f.name, f.low, f.high, f.mean, medians[f.name][1]) for f in fields],
        "ordinal int, column_name string, low double, high double, mean double, median double",
    )
    width = (F.col("high") - F.col("low")) / F.lit(bins)
    start = F.col("low") + (F.col("bin") - 1) * width
    middle = start + width / 2
    slots = frame.withColumn("bin", F.explode(F.sequence(F.lit(1), F.lit(bins))))
    return slots.join(F.broadcast(counts), ["ordinal", "bin"], "left").select(
        "ordinal",
        "column_name",
        "bin",
        F.round(start, 4).alias("bin_start"),
        F.round(start + width, 4).alias("bin_end"),
        F.coalesce("cnt", F.lit(0)).alias("cnt"),
        (F.abs(middle - F.col("mean")) < width / 2).alias("is_mean"),
        (F.abs(middle - F.col("median")) < width / 2).alias("is_median"),
    )
