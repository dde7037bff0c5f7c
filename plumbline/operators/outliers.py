"""Outliers of numeric columns by IQR fences, z-score and isolation forest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from plumbline.dataset import Dataset, Field, Request
from plumbline.functions.columns import column_level, local_frame, percent
from plumbline.operators.isolation import count_flags, fit_forests
from plumbline.operators.numeric import QUARTILES, raw_stats

FENCE = 1.5
Z_THRESHOLD = 3.0
MIN_VALUES = 4


def _checked(ds: Dataset) -> list[Field]:
    return [f for f in ds.of_type("numeric") if f.n >= MIN_VALUES]


def _fences(ds: Dataset, fields: list[Field]) -> dict[str, tuple[float, float]]:
    out = {}
    for name, (q1, _, q3) in ds.quantiles(fields, QUARTILES).items():
        reach = FENCE * (q3 - q1)
        out[name] = (q1 - reach, q3 + reach)
    return out


def _spreads(ds: Dataset) -> dict[str, float]:
    return {row["column_name"]: row["std"] for row in ds.small(raw_stats).collect()}


def _beyond(field: Field, fence: tuple[float, float]) -> Column:
    v = field.as_double
    return (v < F.lit(fence[0])) | (v > F.lit(fence[1]))


def _far(field: Field, std: float, threshold: float) -> Column:
    """|z| above the threshold; never for a column without spread."""
    if not std:
        return F.when(field.as_double.isNotNull(), F.lit(False))
    return F.abs(field.as_double - F.lit(field.mean)) / F.lit(std) > F.lit(threshold)


def _head(field: Field) -> list[Column]:
    return [
        F.lit(field.ordinal).alias("ordinal"),
        F.lit(field.name).alias("column_name"),
        F.lit(field.n).cast("bigint").alias("n"),
    ]


def iqr_request(ds: Dataset) -> Request:
    fields = _checked(ds)
    fences = _fences(ds, fields)
    return Request(
        "iqr",
        [
            F.struct(
                *_head(f),
                F.count_if(_beyond(f, fences[f.name])).alias("iqr_count"),
                F.lit(fences[f.name][0]).alias("low"),
                F.lit(fences[f.name][1]).alias("high"),
            )
            for f in fields
        ],
    )


def zscore_request(ds: Dataset, threshold: float = Z_THRESHOLD) -> Request:
    fields = _checked(ds)
    std = _spreads(ds) if fields else {}
    return Request(
        f"zscore {threshold}",
        [F.struct(*_head(f), F.count_if(_far(f, std[f.name], threshold)).alias("z_count")) for f in fields],
    )


def outliers_iqr(ds: Dataset) -> DataFrame:
    """ordinal, column_name, n, iqr_count, iqr_pct, lower_bound, upper_bound."""
    if not _checked(ds):
        return local_frame(ds.spark, [],
            "ordinal int, column_name string, n bigint, iqr_count bigint, iqr_pct double, "
            "lower_bound double, upper_bound double",
        )
    return ds.scan(iqr_request(ds)).select(
        "ordinal",
        "column_name",
        "n",
        "iqr_count",
        percent(F.col("iqr_count"), F.col("n")).alias("iqr_pct"),
        F.round("low", 4).alias("lower_bound"),
        F.round("high", 4).alias("upper_bound"),
    )


def outliers_zscore(ds: Dataset, threshold: float = Z_THRESHOLD) -> DataFrame:
    """ordinal, column_name, n, z_count, z_pct, threshold."""
    if not _checked(ds):
        return local_frame(ds.spark, [], "ordinal int, column_name string, n bigint, z_count bigint, z_pct double, threshold double"
        )
    return ds.scan(zscore_request(ds, threshold)).withColumns(
        {"z_pct": percent(F.col("z_count"), F.col("n")), "threshold": F.lit(float(threshold))}
    )


def isolation_forest(ds: Dataset) -> DataFrame:
    """ordinal, column_name, n, if_count, if_pct, row_consensus, row_consensus_pct."""
    fields = _checked(ds)
    if not fields:
        return local_frame(ds.spark, [],
            "ordinal int, column_name string, n bigint, if_count bigint, if_pct double, "
            "row_consensus bigint, row_consensus_pct double",
        )
    fences, std = _fences(ds, fields), _spreads(ds)
    bounds = {}
    for f in fields:
        reach = Z_THRESHOLD * std[f.name] if std[f.name] else float("inf")
        bounds[f.ordinal] = (*fences[f.name], f.mean - reach, f.mean + reach)
    flags = count_flags(ds, fields, fit_forests(ds, fields), bounds)
    names = local_frame(ds.spark, [(f.ordinal, f.name, f.n) for f in fields], "ordinal int, column_name string, n bigint")
    return names.join(F.broadcast(flags), "ordinal").select(
        "ordinal",
        "column_name",
        "n",
        "if_count",
        percent(F.col("if_count"), F.col("n")).alias("if_pct"),
        "row_consensus",
        percent(F.col("row_consensus"), F.lit(ds.n_rows)).alias("row_consensus_pct"),
    )


@column_level
def outlier_summary(ds: Dataset) -> DataFrame:
    """All three methods side by side; the IQR result is the primary count.

    `consensus_count` is the median of the three counts; `row_consensus` is the
    number of rows at least two methods flag.
    """
    consensus = F.sort_array(F.array("iqr_count", "z_count", "if_count"))[1]
    return (
        ds.small(outliers_iqr)
        .join(ds.small(outliers_zscore).drop("column_name", "n"), "ordinal")
        .join(ds.small(isolation_forest).drop("column_name", "n"), "ordinal")
        .withColumn("consensus_count", consensus)
        .withColumn("consensus_pct", percent(F.col("consensus_count"), F.lit(ds.n_rows)))
        .orderBy("ordinal")
    )


def flag_rows(ds: Dataset, threshold: float = Z_THRESHOLD) -> DataFrame:
    """The table with `<column>_iqr_outlier` and `<column>_z_outlier` flags.

    A projection: the bounds are literals, so nothing is joined or shuffled.
    """
    fields = _checked(ds)
    fences, std = _fences(ds, fields), _spreads(ds) if fields else {}
    flags = []
    for f in fields:
        flags.append(F.coalesce(_beyond(f, fences[f.name]), F.lit(False)).alias(f"{f.name}_iqr_outlier"))
        flags.append(F.coalesce(_far(f, std[f.name], threshold), F.lit(False)).alias(f"{f.name}_z_outlier"))
    # Positional names: the table's own may differ in case alone.
    return ds.df.select("*", *flags).toDF(*ds.source.columns, *[f"{f.name}_{kind}" for f in fields for kind in ("iqr_outlier", "z_outlier")])
