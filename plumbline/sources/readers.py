"""CSV and Parquet sources, source checks, and dataset fingerprints."""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from plumbline.dataset import Dataset
from plumbline.functions.columns import col_

# Texts that mean "missing" in a CSV file.
MISSING_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

# Messages of the source checks.
NO_FILE = "No file provided."
NOT_CSV = "Only CSV files are supported."
EMPTY_FILE = "Uploaded CSV is empty."
NO_ROWS = "Dataset contains no rows."
UNREADABLE = "Unable to read CSV."

# Longer files are hashed in blocks of this many bytes.
BLOCK_BYTES = 1 << 26


def _surplus_name(names: list[str]) -> str:
    """A column name that the header does not have, in any case."""
    name, taken = "surplus", {n.lower() for n in names}
    while name in taken:
        name += "_"
    return name


def _with_surplus(spark: SparkSession, path: str, multi_line: bool) -> tuple[DataFrame, str]:
    """Every column as text, and one more that holds a row's first field too many.

    Without that column the reader would cut such a row to the header's width.
    """
    options = {"header": True, "multiLine": multi_line, "escape": '"'}
    names = spark.read.csv(path, inferSchema=False, **options).columns
    surplus = _surplus_name(names)
    fields = [T.StructField(name, T.StringType()) for name in [*names, surplus]]
    return spark.read.csv(path, schema=T.StructType(fields), **options), surplus


def _too_many(n: int) -> str:
    return f"{UNREADABLE} {n} rows have more fields than the header."


def malformed_rows(spark: SparkSession, path: str, multi_line: bool = False) -> int:
    """How many rows of a CSV have more fields than its header; all are read."""
    raw, surplus = _with_surplus(spark, path, multi_line)
    return raw.agg(F.count(col_(surplus)).alias("n")).first()["n"]


def _raw_csv(spark: SparkSession, path: str, multi_line: bool) -> DataFrame:
    """Every column as text, with the missing tokens nulled.

    A row with more fields than the header is an error, as soon as it is read.
    """
    raw, surplus = _with_surplus(spark, path, multi_line)
    bad = F.raise_error(F.lit(f"{UNREADABLE} A row has more fields than the header.")).cast("string")
    return raw.select(
        *[
            F.when(col_(surplus).isNotNull(), bad).when(~col_(c).isin(*MISSING_TOKENS), col_(c)).alias(c)
            for c in raw.columns
            if c != surplus
        ]
    )


def read_csv(
    spark: SparkSession, path: str, schema: str | T.StructType | None = None, multi_line: bool = False
) -> DataFrame:
    """A CSV with a header; types are inferred from the data unless given.

    One aggregation over the text columns decides the types: a column is whole
    numbers, decimals or booleans when all of its values are, else text. Dates
    stay text. Pass `schema` to skip that scan on large inputs. `multi_line`
    accepts line breaks inside quotes, at the price of one task per file. Rows
    with fewer fields than the header are filled with nulls; a row with more
    ends the read with an error, never with a shorter row.
    """
    raw = _raw_csv(spark, path, multi_line)
    if schema is None:
        kinds = _inferred(raw)
    else:
        wanted = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
        kinds = {f.name: f.dataType.simpleString() for f in wanted.fields}
    return raw.select(*[_cast(col_(c), kinds[c]).alias(c) for c in raw.columns])


def _cast(value: Column, kind: str) -> Column:
    return value if kind == "string" else F.trim(value).try_cast(kind)


def _inferred(raw: DataFrame) -> dict[str, str]:
    tests = []
    for i, name in enumerate(raw.columns):
        text = F.trim(col_(name))
        tests += [
            F.count(text).alias(f"n{i}"),
            F.count_if(text.rlike(r"^[+-]?\d+$") & text.try_cast("bigint").isNotNull()).alias(f"long{i}"),
            F.count_if(text.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$|^[+-]?inf(inity)?$")).alias(f"real{i}"),
            F.count_if(text.isin("True", "TRUE", "true", "False", "FALSE", "false")).alias(f"bool{i}"),
        ]
    if not tests:
        return {}
    found = raw.agg(*tests).first()
    out = {}
    for i, name in enumerate(raw.columns):
        n = found[f"n{i}"]
        if not n:
            out[name] = "double"
        elif found[f"long{i}"] == n:
            out[name] = "bigint"
        elif found[f"real{i}"] == n:
            out[name] = "double"
        elif found[f"bool{i}"] == n:
            out[name] = "boolean"
        else:
            out[name] = "string"
    return out


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def validate_sources(spark: SparkSession, paths: list[str]) -> DataFrame:
    """One row per path: path, check, ok, message; the first failing check wins.

    Sizes come from the file listing; a path that passes is read whole, and all
    rows with more fields than the header are counted.
    """
    rows = [(path, *_verdict(spark, path)) for path in paths]
    return spark.createDataFrame(rows, "path string, check string, ok boolean, message string")


def _verdict(spark: SparkSession, path: str) -> tuple[str, bool, str | None]:
    if not path or not path.strip():
        return "name", False, NO_FILE
    if not path.lower().endswith(".csv"):
        return "suffix", False, NOT_CSV
    try:
        size = spark.read.format("binaryFile").load(path).agg(F.sum("length")).first()[0]
        if not size:
            return "size", False, EMPTY_FILE
        rows, surplus = _with_surplus(spark, path, False)
        if len(rows.columns) == 1:
            return "size", False, EMPTY_FILE
        found = rows.agg(F.count(F.lit(1)).alias("n"), F.count(col_(surplus)).alias("bad")).first()
        if not found["n"]:
            return "rows", False, NO_ROWS
        if found["bad"]:
            return "parse", False, _too_many(found["bad"])
    except Exception as error:  # the reason varies by file system and reader
        return "parse", False, f"{UNREADABLE} {type(error).__name__}"
    return "all", True, None


# -- fingerprints ------------------------------------------------------------


def file_fingerprint(spark: SparkSession, path: str, block: int = BLOCK_BYTES) -> DataFrame:
    """path, dataset_hash: first 8 hex digits of a SHA-256 for each file under `path`.

    A file of one block is hashed whole. The blocks of a longer one are hashed
    apart, by as many tasks as there are blocks, each in steps of a megabyte;
    the file's hash is that of its block digests in order, so it depends on the
    content and the block size alone. Empty files are not listed. Files of several blocks need a file
    system that pyarrow opens (local, HDFS, S3, GCS).
    """
    files = spark.read.format("binaryFile").load(path)
    short = files.where(F.col("length") <= block).select("path", F.sha2("content", 256).alias("digest"))
    starts = F.sequence(F.lit(0).cast("bigint"), F.col("length") - 1, F.lit(block).cast("bigint"))
    long = files.where(F.col("length") > block).select("path", "length", F.explode(starts).alias("start"))
    # Listed without their content, then one block to a task.
    ranges = long.select("path", "start", F.least(F.lit(block).cast("bigint"), F.col("length") - F.col("start")).alias("size"))
    dealt = ranges.repartition(F.col("path"), F.col("start"))
    digests = dealt.mapInArrow(_block_digests, "path string, start bigint, digest string")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "digest"))), lambda b: b["digest"]), "")
    tree = digests.groupBy("path").agg(F.sha2(joined, 256).alias("digest"))
    return short.union(tree).select("path", F.substring("digest", 1, 8).alias("dataset_hash"))


def _block_digests(batches):
    """The SHA-256 of each byte range, read a megabyte at a time."""
    for batch in batches:
        paths, starts, sizes = (batch.column(i).to_pylist() for i in range(3))
        digests = []
        for path, start, size in zip(paths, starts, sizes):
            system, place = fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", path))
            digest = hashlib.sha256()
            with system.open_input_file(place) as source:
                source.seek(start)
                while size:
                    part = source.read(min(size, 1 << 20))
                    if not part:
                        raise OSError(f"{path} ends before its listed length")
                    digest.update(part)
                    size -= len(part)
            digests.append(digest.hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(digests, pa.string())], names=["path", "start", "digest"])


def table_fingerprint(df: DataFrame) -> DataFrame:
    """rows, row_sum, dataset_hash: the same for the same rows in any order.

    A cell is its length, a colon and its text, and a null is a dash, so no two
    different rows are written alike. Each row's SHA-256 is cut to 60 bits and
    summed as a decimal, so the result needs one partial sum per task and no sort.
    """
    cells = []
    df = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    for field in df.schema.fields:
        value = col_(field.name)
        if isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType)):
            value = F.to_json(value)
        elif isinstance(field.dataType, (T.TimestampType, T.TimestampNTZType)):
            value = F.date_format(value, "yyyy-MM-dd HH:mm:ss.SSSSSS")
        text = value.cast("string")
        cells.append(F.coalesce(F.concat(F.length(text), F.lit(":"), text), F.lit("-")))
    digest = F.sha2(F.concat(*cells) if cells else F.lit(""), 256)
    prefix = F.conv(F.substring(digest, 1, 15), 16, 10).cast("decimal(38,0)")
    return df.agg(
        F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(prefix), F.lit(0)).cast("decimal(38,0)").alias("row_sum")
    ).select(
        "rows",
        F.col("row_sum").cast("string").alias("row_sum"),
        F.substring(
            F.sha2(F.concat_ws(":", F.col("rows").cast("string"), F.col("row_sum").cast("string")), 256), 1, 8
        ).alias("dataset_hash"),
    )


def dataset_hash(ds: Dataset) -> str:
    """The table fingerprint's hash, computed once per Dataset."""
    return ds.remember("dataset_hash", lambda: table_fingerprint(ds.source).first()["dataset_hash"])
