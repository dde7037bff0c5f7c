"""Missing values per column and whether their pattern follows other columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from plumbline.dataset import Dataset, Field
from plumbline.functions.columns import chunks, column_level, fixed, local_frame, percent, stack_columns, union_all
from plumbline.functions.ordering import range_parts

THRESHOLD = 0.2
MIN_ROWS = 10
FLAGS_PER_SCAN = 32

# The notes that explain each indicator.
NOTE_COMPLETE = "No missing values in this column."
NOTE_UNKNOWN = "Insufficient data or no numeric columns available to compute a missingness indicator."
NOTE_MAR = (
    "The missing-value indicator for '%s' shows a Spearman |r| of %s with at least one other "
    "numeric column, suggesting the missingness may not be fully random (MAR-like). This is a "
    "heuristic signal — verify with domain knowledge before choosing an imputation strategy."
)
NOTE_MCAR = (
    "The missing-value indicator for '%s' shows a low Spearman |r| of %s with other numeric "
    "columns, suggesting the missingness may be approximately random (MCAR-like). This is a "
    "heuristic signal, not a formal test."
)
WARNING_MAR = (
    "'%s' shows a MAR-like pattern (heuristic). Consider whether missingness is related to other "
    "observed variables before choosing an imputation strategy."
)


def _number_columns(ds: Dataset) -> list[Field]:
    """Columns of a number type, 0/1 columns included."""
    return [f for f in ds.fields if f.family == "number"]


def _rank_sums(ds: Dataset, numbers: list[Field], flagged: list[Field]) -> DataFrame:
    """Per (flag, number) pair: rows, missing rows, and sums over average ranks.

    Values are counted first, then range-partitioned by column and value. Ranks
    inside a part need only the part; the offset of the parts before it enters
    the sums algebraically, so no column is ever sorted by one task.
    """
    indicator = [F.col(f"m{f.ordinal}") for f in flagged]
    cells = stack_columns(
        ds.df.select(
            *[x.as_double.alias(f"v{x.ordinal}") for x in numbers],
            *[f.col.isNull().cast("int").alias(f"m{f.ordinal}") for f in flagged],
        ),
        [F.struct(F.lit(x.ordinal).alias("x"), F.col(f"v{x.ordinal}").alias("v"), *indicator) for x in numbers],
    ).where("v IS NOT NULL")
    counts = cells.groupBy("x", "v").agg(
        F.count(F.lit(1)).alias("cnt"), *[F.sum(m).alias(f"m{f.ordinal}") for m, f in zip(indicator, flagged)]
    )
    before = Window.partitionBy("x", "part").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    local = F.coalesce(F.sum("cnt").over(before), F.lit(0)) + (F.col("cnt") + 1) / 2.0
    parts = (
        range_parts(counts, "x", "v")
        .withColumn("r", local)
        .groupBy("x", "part")
        .agg(
            F.min("v").alias("start"),
            F.sum("cnt").cast("double").alias("n"),
            F.sum(F.col("cnt") * F.col("r")).alias("cr"),
            F.sum(F.col("cnt") * F.col("r") * F.col("r")).alias("crr"),
            *[F.sum(f"m{f.ordinal}").cast("double").alias(f"m{f.ordinal}") for f in flagged],
            *[F.sum(F.col(f"m{f.ordinal}") * F.col("r")).alias(f"mr{f.ordinal}") for f in flagged],
        )
    )
    earlier = Window.partitionBy("x").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum("n").over(earlier), F.lit(0.0))
    per_flag = F.explode(
        F.array(
            *[
                F.struct(
                    F.lit(f.ordinal).alias("ordinal"),
                    F.col(f"m{f.ordinal}").alias("m"),
                    F.col(f"mr{f.ordinal}").alias("mr"),
                )
                for f in flagged
            ]
        )
    )
    return (
        parts.withColumn("o", offset)
        .select("x", "n", "o", "cr", "crr", per_flag.alias("f"))
        .groupBy("x", F.col("f.ordinal").alias("ordinal"))
        .agg(
            F.sum("n").alias("n"),
            F.sum("f.m").alias("m"),
            F.sum(F.col("f.mr") + F.col("o") * F.col("f.m")).alias("mr"),
            F.sum(F.col("crr") + 2 * F.col("o") * F.col("cr") + F.col("o") * F.col("o") * F.col("n")).alias("rr"),
        )
        .where(F.col("x") != F.col("ordinal"))
    )


def indicator_correlations(ds: Dataset) -> DataFrame:
    """Spearman r of each missing-value flag with each other number column.

    ordinal (flag), x (number), n, r; undefined or short pairs have null r.
    A flag has two values, so its rank correlation is Pearson's r between the
    flag and the average ranks.
    """
    schema = "ordinal int, x int, n bigint, r double"
    numbers, flagged = _number_columns(ds), [f for f in ds.fields if f.missing]
    if not numbers or not flagged:
        return local_frame(ds.spark, [], schema)
    sums = union_all([_rank_sums(ds, numbers, part) for part in chunks(flagged, FLAGS_PER_SCAN)])
    n, m = F.col("n"), F.col("m")
    middle = (n + 1) / 2
    spread = F.sqrt(F.greatest(m * (n - m) / n, F.lit(0.0))) * F.sqrt(
        F.greatest(F.col("rr") - n * middle * middle, F.lit(0.0))
    )
    r = F.try_divide(F.col("mr") - m * middle, spread)
    return sums.select("ordinal", "x", n.cast("bigint").alias("n"), F.when(n >= MIN_ROWS, r).alias("r"))


@column_level
def missing_columns(ds: Dataset, threshold: float = THRESHOLD) -> DataFrame:
    """One row per column: count, percentage, indicator, r, note, warning."""
    numbers = {f.ordinal for f in _number_columns(ds)}
    usable = [(f.ordinal, bool(numbers - {f.ordinal}) and f.n_rows >= MIN_ROWS) for f in ds.fields]
    facts = local_frame(ds.spark, [(f.ordinal, f.name, f.missing, f.n_rows, ok) for f, (_, ok) in zip(ds.fields, usable)],
        "ordinal int, column_name string, missing_count bigint, n_rows bigint, usable boolean",
    )
    best = ds.small(indicator_correlations).groupBy("ordinal").agg(F.max(F.abs("r")).alias("best"))
    name, r = F.col("column_name"), F.coalesce("best", F.lit(0.0))
    indicator = (
        F.when(F.col("missing_count") == 0, "complete")
        .when(~F.col("usable"), "unknown")
        .when(r >= threshold, "likely_mar")
        .otherwise("likely_mcar")
    )
    shown = F.col("indicator").isin("likely_mar", "likely_mcar")
    note = (
        F.when(F.col("indicator") == "complete", NOTE_COMPLETE)
        .when(F.col("indicator") == "unknown", NOTE_UNKNOWN)
        .when(F.col("indicator") == "likely_mar", F.format_string(NOTE_MAR, name, fixed(r, 4)))
        .otherwise(F.format_string(NOTE_MCAR, name, fixed(r, 4)))
    )
    return (
        facts.join(best, "ordinal", "left")
        .withColumn("indicator", indicator)
        .select(
            "ordinal",
            "column_name",
            "missing_count",
            percent(F.col("missing_count"), F.col("n_rows")).alias("missing_percentage"),
            "indicator",
            F.when(shown, F.round(r, 4)).alias("max_spearman_correlation"),
            note.alias("note"),
            F.when(F.col("indicator") == "likely_mar", F.format_string(WARNING_MAR, name)).alias("warning"),
        )
        .orderBy("ordinal")
    )


def ordered_list(value: Column, when: Column | None = None) -> Column:
    """Values as an array in column order."""
    pair = F.struct("ordinal", value.alias("v"))
    kept = pair if when is None else F.when(when, pair)
    return F.transform(F.array_sort(F.collect_list(kept)), lambda p: p["v"])


@column_level
def missing_summary(ds: Dataset, threshold: float = THRESHOLD) -> DataFrame:
    """One row for the table: totals and the columns of each indicator."""
    columns = ds.small(missing_columns, *([] if threshold == THRESHOLD else [threshold]))
    cells = ds.n_rows * len(ds.fields)

    def named(indicator: str) -> Column:
        return ordered_list(F.col("column_name"), F.col("indicator") == indicator)

    total = F.coalesce(F.sum("missing_count"), F.lit(0))
    return columns.agg(
        total.alias("total_missing_cells"),
        F.lit(cells).cast("bigint").alias("total_cells"),
        percent(total, F.lit(cells)).alias("overall_missing_percentage"),
        F.count_if(F.col("missing_count") > 0).alias("columns_with_missing"),
        named("likely_mar").alias("likely_mar_columns"),
        named("likely_mcar").alias("likely_mcar_columns"),
        F.count_if(F.col("indicator") == "complete").alias("complete_columns"),
    )
