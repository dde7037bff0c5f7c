"""Exact duplicates: equal texts by 128-bit content hash, confirmed byte by byte.

DataFrame functions only. Texts move only for groups of two or more.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from plumbline.functions.columns import col_
from plumbline.llm.common import Scratch, ascii_lower, marked_by, read_table, stage, without_rows

def normalised(text: Column) -> Column:
    """What is compared: A-Z lower-cased, null as empty."""
    return ascii_lower(F.coalesce(text.cast("string"), F.lit("")))


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest") -> DataFrame:
    """One row per row of `docs`: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; a null text is
    empty, so empty and null texts form one group. Of a group the row with the
    `smallest` (or `largest`) id stays; a null id stays only in a group where
    every id is null. Rows that repeat both id and text are counted one by one
    in group_size and share the verdict. Other columns are ignored, an empty
    table gives no rows.
    """
    pick = {"smallest": F.min, "largest": F.max}[keep]
    scratch = Scratch(docs.sparkSession, "exact-dedup")
    texts = docs.select(col_(id_col).alias("doc_id"), normalised(col_(text_col)).alias("body"))
    hashed = texts.select("doc_id", "body", F.md5("body").alias("digest"))
    keys = scratch.stage(hashed.select("doc_id", "digest", F.sha2("body", 256).alias("text_sha256")), "keys")
    groups = keys.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), pick("doc_id").alias("first_id"))
    repeated = scratch.stage(groups.where("n > 1").select("digest", "first_id"), "repeated")

    # Bytes are compared inside the groups: every member beside one of them.
    maybe = marked_by(hashed, F.col("digest"), repeated.select("digest"), "maybe").where("maybe")
    members = scratch.stage(maybe.drop("maybe").join(repeated, "digest"), "members")
    model = (
        members.where(F.col("doc_id").eqNullSafe(F.col("first_id")))
        .groupBy("digest")
        .agg(F.min("body").alias("model"))
    )
    odd = (
        members.join(model, "digest")
        .where(F.col("body") != F.col("model"))
        .select("digest", F.sha2("body", 256).alias("text_sha256"))
        .distinct()
        .withColumn("odd", F.lit(True))
    )
    # A text that shares the hash but not the bytes of its group's model is a
    # group of its own, named by its SHA-256.
    odd = scratch.stage(odd, "collisions")
    scratch.drop("members", "repeated")
    if odd.isEmpty():
        sure = keys.withColumn("part", F.lit(""))
    else:
        sure = keys.join(odd, ["digest", "text_sha256"], "left").withColumn(
            "part", F.when(F.col("odd"), F.col("text_sha256")).otherwise("")
        )
    final = sure.groupBy("digest", "part").agg(F.count(F.lit(1)).alias("group_size"), pick("doc_id").alias("keep_id"))
    final = final.where("group_size > 1")
    return sure.join(final, ["digest", "part"], "left").select(
        "doc_id",
        F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.when(F.col("group_size").isNull(), True).otherwise(F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"),
        "text_sha256",
    )


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "largest") -> DataFrame:
    """The rows of `docs` that stay, one of each group, with their columns.

    Of rows that repeat both id and text one stays.
    """
    groups = exact_duplicates(docs, id_col, text_col, keep).where("group_size > 1").groupBy("doc_id", "text_sha256")
    verdicts = groups.agg(F.max("kept").alias("once"), F.count(F.lit(1)).alias("n")).where("NOT once OR n > 1").drop("n")
    return without_rows(docs, [col_(id_col), F.sha2(normalised(col_(text_col)), 256)], stage(verdicts, "exact-gone"))


def op10_exact_dedup(spark, sf_dir):
    return exact_duplicates(read_table(spark, sf_dir, "documents"), keep="largest")


OP10_SQL = """
WITH t AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS body
  FROM documents),
g AS (SELECT body, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY body)
SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id AS kept, sha256(t.body) AS text_sha256
FROM t JOIN g ON t.body = g.body
"""
