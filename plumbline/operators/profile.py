"""Column profile: types, shape, distinct counts, modes, duplicates, warnings."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, functions as F

from plumbline.dataset import Dataset, Field, Request
from plumbline.functions.columns import (
    LONG_TEXT,
    column_level,
    local_frame,
    null_of,
    percent,
    pin,
    scan_columns,
    sized_tasks,
    stack_columns,
    text_key,
    union_all,
)
from plumbline.functions.heavy import top_keys

# The date layouts a text column is tested against.
DATE_LAYOUTS = (
    "yyyy-MM-dd",
    "yyyy-MM-dd HH:mm:ss",
    "yyyy-MM-dd'T'HH:mm:ss",
    "yyyy-MM-dd HH:mm",
    "yyyy/MM/dd",
    "MM/dd/yyyy",
    "MM/dd/yyyy HH:mm:ss",
    "dd/MM/yyyy",
    "dd/MM/yyyy HH:mm:ss",
    "dd-MM-yyyy",
)
# The layouts with a month's name, tried on texts that hold one.
NAMED_LAYOUTS = (
    "d-MMM-yyyy",
    "d/MMM/yyyy",
    "d-MMM-yyyy HH:mm",
    "d-MMM-yyyy HH:mm:ss",
    "d MMM yyyy HH:mm",
    "d MMM yyyy HH:mm:ss",
    "MMM d yyyy HH:mm",
    "MMM d yyyy HH:mm:ss",
    "MMM-d-yyyy",
    "yyyy-MMM-d",
)
MONTHS = "jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec"
DATE_SHARE = 0.8
HIGH_CARDINALITY = 0.8
IMBALANCE = 0.90


def column_types(ds: Dataset) -> DataFrame:
    """ordinal, column_name, dtype, column_type."""
    return ds.summary().select("ordinal", "column_name", "dtype", "column_type")


def shape(ds: Dataset) -> DataFrame:
    """One row: rows, columns, duplicate_rows."""
    return duplicate_rows(ds).select(
        "rows", F.lit(len(ds.schema_fields)).alias("columns"), "duplicate_rows"
    )


def duplicate_rows(ds: Dataset) -> DataFrame:
    """rows, duplicate_rows, percentage: rows after the first of each equal set.

    Long texts are grouped by digest, so the shuffle carries bounded rows, and
    copies of a hot row are combined before it.
    """
    if not ds.schema_fields:
        return ds.df.agg(F.count(F.lit(1)).alias("rows")).select(
            "rows", F.lit(0).cast("bigint").alias("duplicate_rows"), F.lit(0.0).alias("percentage")
        )
    longest = {f.name: f.longest for f in ds.fields}
    keys = [
        (text_key(f.col, longest[f.name]) if f.family == "text" else f.col).alias(f"k{f.ordinal}")
        for f in ds.schema_fields
    ]
    groups = ds.df.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies"))
    found = groups.agg(
        F.coalesce(F.sum("copies"), F.lit(0)).alias("rows"),
        F.coalesce(F.sum(F.col("copies") - 1), F.lit(0)).alias("duplicate_rows"),
    )
    with sized_tasks(ds.spark, ds.n_rows * len(keys)):
        found = pin(found)
    return found.select("rows", "duplicate_rows", percent(F.col("duplicate_rows"), F.col("rows")).alias("percentage"))


# -- value counts ------------------------------------------------------------


def _value_struct(field: Field) -> Column:
    """A column's value as (long, double, text) with one side filled."""
    as_long, as_double, as_text = null_of("bigint"), null_of("double"), null_of("string")
    if field.integral or field.dtype == "date":
        as_long = field.col.cast("bigint") if field.integral else F.unix_date(field.col).cast("bigint")
    elif field.dtype in ("float", "double"):
        as_double = field.col.cast("double")
    elif field.dtype == "timestamp":
        as_long = F.unix_micros(field.col)
    elif field.family == "text":
        as_text = text_key(field.col, field.longest)
    else:
        as_text = field.col.cast("string")
    return F.struct(
        F.lit(field.ordinal).alias("ordinal"),
        as_long.alias("value_long"),
        as_double.alias("value_double"),
        as_text.alias("value_text"),
    )


def value_counts(ds: Dataset, fields: list[Field] | None = None) -> DataFrame:
    """ordinal, value_long, value_double, value_text, cnt over non-null values.

    One shuffle for all columns, keyed by column and value and combined on the
    map side, so neither a wide column nor a hot value lands in one task whole.
    """
    chosen = ds.fields if fields is None else fields
    cells = stack_columns(ds.df, [_value_struct(f) for f in chosen])
    return (
        cells.where("value_long IS NOT NULL OR value_double IS NOT NULL OR value_text IS NOT NULL")
        .groupBy("ordinal", "value_long", "value_double", "value_text")
        .agg(F.count(F.lit(1)).alias("cnt"))
    )


def _none(ds: Dataset, schema: str) -> DataFrame:
    return local_frame(ds.spark, [], schema)


def distinct_counts(ds: Dataset, approximate: float | None = None) -> DataFrame:
    """ordinal, unique_count, top_cnt, top_text: exact, or within `approximate`.

    `top_cnt` is the count of the most frequent value and `top_text` the smallest
    text value that has it. Both are null in approximate mode, which needs no
    shuffle of the values.
    """
    schema = "ordinal int, unique_count bigint, top_cnt bigint, top_text string"
    if not ds.schema_fields:
        return _none(ds, schema)
    if approximate is not None:
        return scan_columns(
            ds.df,
            [
                F.struct(
                    F.lit(f.ordinal).alias("ordinal"),
                    F.approx_count_distinct(f.col, approximate).alias("unique_count"),
                    null_of("bigint").alias("top_cnt"),
                    null_of("string").alias("top_text"),
                )
                for f in ds.fields
            ],
        )
    names = local_frame(ds.spark, [(f.ordinal,) for f in ds.fields], "ordinal int")
    # All-null columns have nothing to count and need no place in the shuffle.
    filled = [f for f in ds.fields if f.n]
    if not filled:
        return names.select(
            "ordinal", F.lit(0).cast("bigint").alias("unique_count"), null_of("bigint").alias("top_cnt"), null_of("string").alias("top_text")
        )
    # The least of (-count, text) is the most frequent value, and of equals the smallest text.
    top = F.min(F.struct((-F.col("cnt")).alias("c"), F.col("value_text").alias("t")))
    sizes = value_counts(ds, filled).groupBy("ordinal").agg(F.count(F.lit(1)).alias("unique_count"), top.alias("top"))
    with sized_tasks(ds.spark, sum(f.n for f in filled)):
        sizes = pin(sizes)
    return names.join(sizes, "ordinal", "left").select(
        "ordinal",
        F.coalesce("unique_count", F.lit(0)).alias("unique_count"),
        (-F.col("top.c")).alias("top_cnt"),
        F.col("top.t").alias("top_text"),
    )


def exact_distinct(ds: Dataset, fields: list[Field]) -> dict[int, int]:
    """Distinct values of a few columns by ordinal; nothing else is counted."""
    if ds.knows(distinct_counts, None):
        known = {row["ordinal"]: row["unique_count"] for row in ds.small(distinct_counts, None).collect()}
        return {f.ordinal: known[f.ordinal] for f in fields}
    out = {f.ordinal: 0 for f in fields}
    filled = [f for f in fields if f.n]
    if filled:
        sizes = value_counts(ds, filled).groupBy("ordinal").agg(F.count(F.lit(1)).alias("n"))
        out.update({row["ordinal"]: row["n"] for row in sizes.collect()})
    return out


def mode_frequency(ds: Dataset) -> DataFrame:
    """ordinal, column_name, most_frequent, frequency for categorical columns.

    Ties go to the smallest value.
    """
    schema = "ordinal int, column_name string, most_frequent string, frequency bigint"
    fields = ds.of_type("categorical")
    short = [f for f in fields if (f.longest or 0) <= LONG_TEXT]
    parts = []
    if short:
        names = local_frame(ds.spark, [(f.ordinal, f.name) for f in short], "ordinal int, column_name string")
        parts.append(
            names.join(ds.small(distinct_counts, None), "ordinal").select(
                "ordinal", "column_name", F.col("top_text").alias("most_frequent"), F.col("top_cnt").alias("frequency")
            )
        )
    if len(short) < len(fields):
        top = {row["ordinal"]: row["top_cnt"] for row in ds.small(distinct_counts, None).collect()}
        parts += [_long_text_mode(ds, f, top[f.ordinal]) for f in fields if f not in short]
    return union_all(parts) if parts else _none(ds, schema)


def _long_text_mode(ds: Dataset, field: Field, top: int) -> DataFrame:
    """The mode of a long text column; only digests are counted and joined.

    The winners come from a summary of the frequent digests, or, where none
    stands out, from the counts of all.
    """
    texts = ds.df.select(field.col.alias("value"))
    if top > 1:
        found = top_keys(ds.df, text_key(field.col), 1)
        if found is None:
            winners = value_counts(ds, [field]).where(F.col("cnt") == top).select(F.col("value_text").alias("key"))
        else:
            winners = F.broadcast(local_frame(ds.spark, [(key,) for key, _ in found], "key string"))
        texts = texts.withColumn("key", text_key(F.col("value"))).join(winners, "key", "left_semi")
    return texts.agg(F.min("value").alias("most_frequent")).select(
        F.lit(field.ordinal).alias("ordinal"),
        F.lit(field.name).alias("column_name"),
        "most_frequent",
        F.lit(top).cast("bigint").alias("frequency"),
    )


@column_level
def column_profile(ds: Dataset, approximate: float | None = None) -> DataFrame:
    """One row per column: type, missing, distinct, constant, mode.

    `approximate` trades the exact distinct counts and modes for a profile that
    shuffles nothing but one row per task.
    """
    if not ds.schema_fields:
        return _none(
            ds,
            "ordinal int, column_name string, dtype string, column_type string, n_rows bigint, "
            "missing_count bigint, missing_percentage double, unique_count bigint, "
            "unique_count_with_null bigint, is_constant boolean, top_cnt bigint, "
            "most_frequent string, frequency bigint",
        )
    missing = F.col("n_rows") - F.col("n")
    distinct = ds.small(distinct_counts, approximate).drop("top_text")
    if approximate is None:
        modes = ds.small(mode_frequency).drop("column_name")
    else:
        modes = _none(ds, "ordinal int, most_frequent string, frequency bigint")
    return (
        ds.small(Dataset.summary)
        .join(distinct, "ordinal")
        .join(modes, "ordinal", "left")
        .select(
            "ordinal",
            "column_name",
            "dtype",
            "column_type",
            "n_rows",
            missing.alias("missing_count"),
            percent(missing, F.col("n_rows")).alias("missing_percentage"),
            "unique_count",
            (F.col("unique_count") + (missing > 0).cast("bigint")).alias("unique_count_with_null"),
            (F.col("unique_count") <= 1).alias("is_constant"),
            "top_cnt",
            "most_frequent",
            F.when(F.col("column_type") == "categorical", F.col("frequency")).alias("frequency"),
        )
    )


# -- warnings ----------------------------------------------------------------


def gate_request(ds: Dataset) -> Request:
    texts = [f for f in ds.schema_fields if f.dtype == "string"]
    return Request("date gate", [F.struct(F.lit(f.ordinal).alias("ordinal"), F.max(f.col.rlike("[-/:]")).alias("gate")) for f in texts])


def date_like_columns(ds: Dataset) -> DataFrame:
    """ordinal, date_share: share of all rows a text column parses as a date.

    Only columns where some value has a date separator are parsed at all.
    """
    request = date_request(ds)
    return ds.scan(request) if request.structs else _none(ds, "ordinal int, date_share double")


def date_request(ds: Dataset) -> Request:
    texts = [f for f in ds.of_type("categorical") if f.dtype == "string"]
    gated = {row["ordinal"] for row in ds.scan(gate_request(ds)).collect() if row["gate"]} if texts else set()
    return Request(
        "dates",
        [
            F.struct(
                F.lit(f.ordinal).alias("ordinal"),
                F.try_divide(F.count(_parsed(f.col)), F.count(F.lit(1))).alias("date_share"),
            )
            for f in texts
            if f.ordinal in gated
        ],
    )


# What each letter run of a layout stands for, as the parser reads it: years of other than
# four digits carry a sign, a lone d takes any number of zeros.
_LETTERS = {
    "yyyy": r"(?:\d{4}|\+\d{5,19}|-\d{4,19})",
    "MM": "(?:0[1-9]|1[0-2])",
    "dd": r"(?:0[1-9]|[12]\d|3[01])",
    "d": r"0{0,18}(?:[1-9]|[12]\d|3[01])",
    "HH": r"(?:[01]\d|2[0-3])",
    "mm": r"[0-5]\d",
    "ss": r"[0-5]\d",
}


def _pattern(layout: str) -> str:
    """The texts of a layout: all it parses, and no others but days past the end of a month."""
    return "^" + re.sub("yyyy|MM|dd|d|HH|mm|ss", lambda run: _LETTERS[run[0]], layout.replace("'", "")) + "$"


def _first_parsed(text: Column, layouts: Iterable[str]) -> Column:
    """`text` by the first layout that parses it.

    A failed parse costs an exception, a hundred times a pattern: so a layout
    is tried only on texts of its shape.
    """
    return F.coalesce(*[F.when(text.rlike(_pattern(x)), F.try_to_timestamp(text, F.lit(x))) for x in layouts])


def _once(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once, however often `body` names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _spoken(bare: Column) -> Column:
    """A text with a month's name as a time.

    The name is cut to three letters, and weekdays and commas are left out;
    month-name layouts are then tried with the month as a number.
    """

    def numbered(plain: Column, named: Column) -> Column:
        place = (F.position(named, F.lit(MONTHS.replace("|", ""))) + 2) / 3
        return F.regexp_replace(plain, rf"({MONTHS})[a-z]*\.?", F.lpad(place.cast("int").cast("string"), 2, "0"))

    def tried(plain: Column, named: Column) -> Column:
        return F.when(named != "", _once(numbered(plain, named), lambda text: _first_parsed(text, [x.replace("MMM", "MM") for x in NAMED_LAYOUTS])))

    plain = F.regexp_replace(F.lower(bare), r"^(mon|tue|wed|thu|fri|sat|sun)[a-z]*,? +|,", "")
    return _once(
        plain,
        lambda text: _once(F.regexp_extract(text, rf"^(?:\d{{1,4}}[-/ ])?({MONTHS})[a-z]*\.?[-/ ]", 1), lambda named: tried(text, named)),
    )


def _parsed(value: Column) -> Column:
    """The value as a time; fractions of a second and zones are cut off first."""
    trimmed = F.trim(value)
    cut = F.regexp_replace(trimmed, r"(:\d{2})[.,]\d{1,9}", "$1")
    cut = F.regexp_replace(cut, r"(:\d{2}) ?(Z|UTC|[+-]\d{2}:?\d{2}|[+-]\d{2})$", "$1")
    # Parsing is tried only on texts that could be a date at all.
    numeric = r"^\d{1,4}[-/]\d{1,2}[-/]\d{1,4}([T ][0-9:]+)?$"
    return _once(cut, lambda bare: F.when(bare.rlike(numeric), _first_parsed(bare, DATE_LAYOUTS)).otherwise(_spoken(bare)))


@column_level
def profile_warnings(ds: Dataset) -> DataFrame:
    """section_rank, ord, code, column_name, message, in report order."""
    profile = ds.small(column_profile)
    duplicates = ds.small(duplicate_rows)
    dates = ds.small(date_like_columns)
    table = duplicates.where("duplicate_rows > 0").select(
        F.lit(0).alias("section_rank"),
        F.lit(-1).alias("ord"),
        F.lit("duplicates").alias("code"),
        null_of("string").alias("column_name"),
        F.concat(F.lit("Dataset contains "), F.col("duplicate_rows"), F.lit(" duplicate row(s).")).alias("message"),
    )
    name, kind = F.col("column_name"), F.col("column_type")
    categorical = kind == "categorical"
    present = F.col("n_rows") - F.col("missing_count")
    rules = [
        (1, "missing", F.col("missing_count") > 0, F.concat(name, F.lit(" contains "), F.col("missing_count"), F.lit(" missing value(s)."))),
        (2, "constant", F.col("unique_count") <= 1, F.concat(name, F.lit(" is a constant column."))),
        (3, "high_cardinality", categorical & (F.col("unique_count") > F.col("n_rows") * HIGH_CARDINALITY), F.concat(name, F.lit(" has very high cardinality."))),
        (4, "identifier", categorical & (F.col("unique_count") == F.col("n_rows")), F.concat(name, F.lit(" may be an identifier column."))),
        (5, "datetime", categorical & (F.col("date_share") >= DATE_SHARE), F.concat(name, F.lit(" may contain datetime values."))),
        (6, "imbalanced", (kind == "binary") & (F.col("unique_count") == 2) & (F.col("top_cnt") > present * IMBALANCE), F.concat(name, F.lit(" is highly imbalanced."))),
    ]
    found = F.array(
        *[
            F.when(
                F.coalesce(test, F.lit(False)),
                F.struct(F.lit(rank).alias("section_rank"), F.lit(code).alias("code"), text.alias("message")),
            )
            for rank, code, test, text in rules
        ]
    )
    columns = (
        profile.join(dates, "ordinal", "left")
        .select(F.col("ordinal").alias("ord"), name, F.explode(found).alias("w"))
        .where("w IS NOT NULL")
        .select("w.section_rank", "ord", "w.code", "column_name", "w.message")
    )
    return table.unionByName(columns).orderBy("ord", "section_rank")
