"""A table together with the column-level facts the operators share."""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F, types as T

from plumbline.functions.columns import (
    COLUMNS_PER_SCAN,
    chunks,
    col_,
    local_frame,
    null_of,
    pin,
    scan_columns,
    union_all,
)
from plumbline.functions.ordering import builtin_structs, exact_quantiles, is_direct

_FAMILIES = (
    (T.BooleanType, "boolean"),
    (T.NumericType, "number"),
    ((T.DateType, T.TimestampType, T.TimestampNTZType), "time"),
    (T.StringType, "text"),
)


@dataclass(frozen=True)
class Field:
    """What is known about a column from the schema and one scan."""

    ordinal: int
    name: str
    dtype: str
    family: str
    integral: bool
    n_rows: int = 0
    n: int = 0
    column_type: str = "unknown"
    mean: float | None = None
    low: float | None = None
    high: float | None = None
    longest: int | None = None
    # The column's name in Dataset.df, where the table has that name in several cases.
    inner: str | None = None

    @property
    def missing(self) -> int:
        return self.n_rows - self.n

    @property
    def col(self) -> Column:
        return col_(self.inner or self.name)

    @property
    def as_double(self) -> Column:
        """The column as a number: booleans become 0/1, times epoch seconds."""
        if self.family == "boolean":
            return self.col.cast("int").cast("double")
        if self.family == "time":
            return F.unix_micros(self.col.cast("timestamp")).cast("double") / F.lit(1e6)
        return self.col.cast("double")


@dataclass(frozen=True)
class Request:
    """Aggregates an operator needs, each a struct over all rows of the table.

    Requests of one name are the same aggregates.
    """

    name: str
    structs: list[Column]
    per_scan: int = COLUMNS_PER_SCAN


def _typed(struct: dict, schema: T.StructType) -> tuple:
    """A struct read from JSON, with doubles as doubles; a null is left out there."""
    return tuple(
        float(struct[f.name]) if isinstance(f.dataType, T.DoubleType) and f.name in struct
        else [float(x) for x in struct[f.name]] if isinstance(f.dataType, T.ArrayType) and f.name in struct
        else struct.get(f.name)
        for f in schema.fields
    )


def _family(dtype: T.DataType) -> str:
    return next((name for kinds, name in _FAMILIES if isinstance(dtype, kinds)), "text")


def _inner_names(names: list[str]) -> list[str]:
    """The names, with the position behind those that differ from another one in case alone, if at all."""
    count = Counter(name.lower() for name in names)
    out = [name if count[name.lower()] == 1 else f"{name}#{i}" for i, name in enumerate(names)]
    # A made name may be taken: then all are numbered.
    return out if len({name.lower() for name in out}) == len(out) else [f"#{i}" for i in range(len(names))]


def _normalise(df: DataFrame) -> DataFrame:
    """NaN becomes NULL; nested and binary values become canonical text."""
    out = []
    df = df.toDF(*_inner_names(df.columns))
    for field in df.schema.fields:
        column, kind = col_(field.name), field.dataType
        if isinstance(kind, (T.FloatType, T.DoubleType)):
            column = F.when(~F.isnan(column), column)
        elif isinstance(kind, T.MapType):
            column = F.to_json(F.array_sort(F.map_entries(column)))
        elif isinstance(kind, (T.ArrayType, T.StructType)):
            column = F.to_json(column)
        elif isinstance(kind, T.BinaryType):
            column = F.base64(column)
        elif _family(kind) == "text" and not isinstance(kind, T.StringType):
            column = column.cast("string")
        out.append(column.alias(field.name))
    return df.select(*out)


class Dataset:
    """A DataFrame plus memoised column facts.

    Facts with one row per column live on the driver; data rows never do.
    """

    def __init__(self, df: DataFrame):
        self.source = df
        self.df = _normalise(df)
        self.spark = df.sparkSession
        self._memo: dict = {}

    # -- memo ---------------------------------------------------------------
    def remember(self, key, build: Callable):
        if key not in self._memo:
            self._memo[key] = build()
        return self._memo[key]

    def small(self, operator: Callable[..., DataFrame], *args) -> DataFrame:
        """The pinned result of a column-level operator, computed once."""
        return self.remember(
            (operator.__module__, operator.__qualname__, args),
            lambda: pin(operator(self, *args), getattr(operator, "column_level", False)),
        )

    def knows(self, operator: Callable[..., DataFrame], *args) -> bool:
        """Has `small` computed this already?"""
        return (operator.__module__, operator.__qualname__, args) in self._memo

    # -- shared scans -------------------------------------------------------
    def scan(self, request: Request) -> DataFrame:
        """One row per struct of a request, from a shared scan that gathered it, or its own."""
        known = self._memo.get(("scan", request.name))
        return known if known is not None else scan_columns(self.df, request.structs, request.per_scan)

    def gather(self, *requests: Request) -> None:
        """Answer the requests of several operators with one job over the table.

        All their aggregates are partial sums of one plan, cut into parts of a
        few columns for the compiler's sake; each part reads its own columns.
        """
        wanted = [r for r in requests if r.structs and ("scan", r.name) not in self._memo]
        if not wanted:
            return
        parts = [
            self.df.agg(F.to_json(F.array(*part)).alias("found")).select(F.lit(i).alias("request"), F.lit(k).alias("part"), "found")
            for i, r in enumerate(wanted)
            for k, part in enumerate(chunks(r.structs, r.per_scan))
        ]
        rows = sorted(union_all(parts).collect())
        for i, r in enumerate(wanted):
            schema = self.df.agg(F.array(*r.structs).alias("s")).schema["s"].dataType.elementType
            found = [struct for row in rows if row["request"] == i for struct in json.loads(row["found"])]
            self._memo["scan", r.name] = local_frame(self.spark, [_typed(struct, schema) for struct in found], schema)

    # -- column facts -------------------------------------------------------
    @property
    def schema_fields(self) -> list[Field]:
        inner = _inner_names(self.source.columns)
        return [
            Field(
                i,
                field.name,
                field.dataType.simpleString(),
                _family(field.dataType),
                isinstance(field.dataType, T.IntegralType),
                inner=None if inner[i] == field.name else inner[i],
            )
            for i, field in enumerate(self.source.schema.fields)
        ]

    def summary_request(self) -> Request:
        return Request("summary", [_facts(field) for field in self.schema_fields])

    def summary(self) -> DataFrame:
        """One row per column from one scan: counts, range, sum, type."""
        facts = self.scan(self.summary_request())
        kind = (
            F.when(F.col("n") == 0, "unknown")
            .when(F.col("family") == "boolean", "binary")
            .when((F.col("family") == "number") & (F.col("n_not_binary") == 0), "binary")
            .when(F.col("family") == "number", "numeric")
            .when(F.col("family") == "time", "datetime")
            .otherwise("categorical")
        )
        return facts.select(
            "*",
            kind.alias("column_type"),
            F.try_divide("total", "n").alias("mean"),
        )

    @property
    def fields(self) -> list[Field]:
        return self.remember("fields", self._load_fields)

    def _load_fields(self) -> list[Field]:
        known = self.schema_fields
        if not known:
            return []
        rows = {row["ordinal"]: row for row in self.small(Dataset.summary).collect()}
        out = []
        for field in known:
            row = rows[field.ordinal]
            out.append(
                Field(
                    field.ordinal,
                    field.name,
                    field.dtype,
                    field.family,
                    field.integral,
                    row["n_rows"],
                    row["n"],
                    row["column_type"],
                    row["mean"],
                    row["low"],
                    row["high"],
                    row["longest"],
                    field.inner,
                )
            )
        return out

    @property
    def n_rows(self) -> int:
        if self.fields:
            return self.fields[0].n_rows
        return self.remember("n_rows", self.df.count)

    def of_type(self, *column_types: str) -> list[Field]:
        return [field for field in self.fields if field.column_type in column_types]

    def field(self, name: str | None) -> Field | None:
        return next((field for field in self.fields if field.name == name), None)

    def quantiles_request(self, fields: list[Field], probs: tuple[float, ...]) -> Request:
        """For a shared scan, where the table is small enough for the built-in percentile."""
        values = {f.name: (f.as_double, f.n) for f in fields if f.n}
        return Request(f"quantiles {probs}", builtin_structs(values, probs) if is_direct(values) else [])

    def quantiles(self, fields: list[Field], probs: tuple[float, ...]) -> dict[str, list[float]]:
        """Exact interpolated quantiles of numeric columns, by column name."""
        known = self.remember("quantiles", dict)
        for (name, others), values in list(known.items()):
            if set(probs) <= set(others):
                known.setdefault((name, probs), [values[others.index(p)] for p in probs])
        wanted = [f for f in fields if f.n and (f.name, probs) not in known]
        gathered = self._memo.get(("scan", f"quantiles {probs}"))
        if gathered is not None:
            rows = {row["key"]: list(row["q"]) for row in gathered.collect()}
            known.update({(f.name, probs): rows[f.name] for f in wanted if f.name in rows})
            wanted = [f for f in wanted if f.name not in rows]
        if wanted:
            found = exact_quantiles(self.df, {f.name: (f.as_double, f.n) for f in wanted}, probs)
            known.update({(name, probs): values for name, values in found.items()})
        return {f.name: known[f.name, probs] for f in fields if f.n}


def _facts(field: Field) -> Column:
    """The first-scan aggregates of one column."""
    column, numeric = field.col, field.family == "number"
    number = field.as_double
    return F.struct(
        F.lit(field.ordinal).alias("ordinal"),
        F.lit(field.name).alias("column_name"),
        F.lit(field.dtype).alias("dtype"),
        F.lit(field.family).alias("family"),
        F.count(F.lit(1)).alias("n_rows"),
        F.count(column).alias("n"),
        (F.count_if(~number.isin(0.0, 1.0)) if numeric else null_of("bigint")).alias("n_not_binary"),
        (F.min(number) if numeric else null_of("double")).alias("low"),
        (F.max(number) if numeric else null_of("double")).alias("high"),
        (F.sum(number) if numeric else null_of("double")).alias("total"),
        (F.max(F.length(column)) if field.family == "text" else null_of("int")).alias("longest"),
    )
