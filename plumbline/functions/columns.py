"""Small column helpers: quoting, safe ratios, value keys, per-column scans."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from contextlib import AbstractContextManager, contextmanager, nullcontext
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

# Text longer than this is counted and joined by its SHA-256 instead of by
# itself, so that no shuffle ever carries whole documents as keys.
LONG_TEXT = 64

# How many columns share one aggregation. Parquet columns are read separately,
# so more aggregations cost no extra I/O, and each stays small enough for the
# JIT compiler.
COLUMNS_PER_SCAN = 8


def col_(name: str) -> Column:
    """A column by its exact name, whatever characters the name has."""
    return F.col("`" + name.replace("`", "``") + "`")


def null_of(kind: str) -> Column:
    return F.lit(None).cast(kind)


def percent(part: Column, whole: Column) -> Column:
    """`part` of `whole` in percent, 2 decimals, 0 when `whole` is 0."""
    share = F.try_divide(F.lit(100.0) * part, whole)
    return F.coalesce(F.round(share, 2), F.lit(0.0))


def fixed(value: Column, digits: int) -> Column:
    """`value` printed with a fixed number of decimals, without grouping."""
    return F.format_string(f"%.{digits}f", value)


def text_key(value: Column, longest: int | None = None) -> Column:
    """A bounded-width key that is equal exactly when `value` is equal."""
    if longest is not None and longest <= LONG_TEXT:
        return value
    return F.when(F.length(value) > LONG_TEXT, F.sha2(value, 256)).otherwise(value)


def chunks(items: Sequence, size: int) -> list[Sequence]:
    return [items[i : i + size] for i in range(0, len(items), size)]


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def scan_columns(df: DataFrame, structs: Sequence[Column], per_scan: int = COLUMNS_PER_SCAN) -> DataFrame:
    """One output row per struct of aggregates, each taken over all of `df`.

    The aggregates are map-side partial sums, so only one row per task moves.
    """
    return union_all(
        [
            df.agg(F.array(*part).alias("stats")).select(F.inline("stats"))
            for part in chunks(structs, per_scan)
        ]
    )


def stack_columns(df: DataFrame, structs: Sequence[Column]) -> DataFrame:
    """Turn each row into one row per struct (a typed unpivot)."""
    return df.select(F.inline(F.array(*structs)))


def local_frame(spark: SparkSession, rows: Sequence[Sequence], schema: str | T.StructType) -> DataFrame:
    """A few rows the driver knows, as a local relation: plans over it alone need no job."""
    wanted = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    arrow = to_arrow_schema(wanted)
    columns = [pa.array([row[i] for row in rows], kind) for i, kind in enumerate(arrow.types)]
    return spark.createDataFrame(pa.Table.from_arrays(columns, schema=arrow), wanted)


# What one_job sets: no runtime re-planning, no broadcasts, one shuffle partition,
# and no compiled stages, which take longer to compile than a few rows to run.
_ONE_JOB = {
    "spark.sql.codegen.wholeStage": "false",
    "spark.sql.adaptive.enabled": "false",
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.shuffle.partitions": "1",
}


# What a task of a grouping over the whole table reads, in cells (a row's value in a column) and in
# bytes of a shuffle: else a table that grows on the same cores grows each task's hash table.
CELLS_PER_TASK = 4_000_000
SHUFFLE_PER_TASK = "8m"


@contextmanager
def _settings(spark: SparkSession, wanted: dict[str, str]) -> Iterator[None]:
    before = {name: spark.conf.get(name, None) for name in wanted}
    try:
        for name, value in wanted.items():
            spark.conf.set(name, value)
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def one_job(spark: SparkSession) -> AbstractContextManager[None]:
    """Actions inside run as one job each instead of one job per exchange and broadcast.

    Only for plans over column-level frames, which have nothing to gain from
    several tasks behind an exchange; plans that read a table stay as they are.
    """
    return _settings(spark, _ONE_JOB)


def sized_tasks(spark: SparkSession, cells: int) -> AbstractContextManager[None]:
    """Actions inside use as many tasks as `cells` need, so that a task's memory does not grow with the table.

    Small tables keep the session's settings.
    """
    tasks = -(-cells // CELLS_PER_TASK)
    if tasks <= spark.sparkContext.defaultParallelism:
        return nullcontext()
    parts = max(tasks, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return _settings(
        spark,
        {
            "spark.sql.files.minPartitionNum": str(tasks),
            # Else a file is cut no finer than this, 4 MB, which may be millions of rows.
            "spark.sql.files.openCostInBytes": "256k",
            "spark.sql.shuffle.partitions": str(parts),
            "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false",
            "spark.sql.adaptive.advisoryPartitionSizeInBytes": SHUFFLE_PER_TASK,
        },
    )


def column_level(operator: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """Marks an operator whose plan is made of pinned frames alone."""
    operator.column_level = True
    return operator


def pin(df: DataFrame, small_plan: bool = False) -> DataFrame:
    """A local copy of a small result, so that later plans do not rerun it.

    Used only for frames with a row per column or per pair of columns: their
    size depends on the schema, never on the number of data rows. `small_plan`
    says that their plan is column-level, too.
    """
    if not small_plan:
        return df.sparkSession.createDataFrame(df.toArrow())
    with one_job(df.sparkSession):
        rows = df.toArrow()
    return df.sparkSession.createDataFrame(rows)


def beside(frame: DataFrame, other: DataFrame) -> DataFrame:
    """`frame` plus the columns of `other`, a frame of one row, as literals.

    For facts about a whole table: nothing is joined. `other` is column-level.
    """
    with one_job(other.sparkSession):
        packed = other.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("row")).first()
    row = F.from_json(F.lit(packed["row"] if packed else None).cast("string"), other.schema)
    return frame.withColumns({name: row[name] for name in other.columns})
