"""Exact de-duplication by a content sort, in DataFrame operations only.

The normalised text (without the six ASCII white-space characters) is range-partitioned by
splitters that Spark samples, and each partition is sorted, on disk where it must. Equal texts are
then adjacent; a window over neighbours with fully equal text counts them and finds the row that
stays. Splitters are short: a prefix of the text, a hash of all of it and a salt of the document
id, so that a text with very many copies is dealt to many partitions. One row per text and salt,
with the text's digest in place of the text, is then merged over the salts.

Of equal texts the row with the most characters stays, then the smallest ``doc_id``. Null text
counts as empty. A null ``doc_id`` comes after all others. Repeated rows are copies of each other:
one of them is kept. An empty table gives an empty table; further columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowspark.session import cut_lineage

SPACE = " \t\n\x0b\x0c\r"
SPLITTER_CHARS = 32
SALTS = 256


def normalised(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), SPACE, "")


def copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256."""
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(
        F.col(doc_id).alias("doc_id"),
        F.length(body).cast("long").alias("chars"),
        normalised(body).alias("norm"),
    ).select(
        "*",
        F.substring("norm", 1, SPLITTER_CHARS).alias("head"),
        F.xxhash64("norm").alias("hash"),
        F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int").alias("salt"),
    )
    place = ["head", "hash", "salt"]
    best = [F.col("chars").desc(), F.col("doc_id").asc_nulls_last()]
    equal = Window.partitionBy(*place, "norm")
    local = rows.repartitionByRange(*place).select(
        "doc_id",
        "chars",
        "salt",
        F.sha2("norm", 256).alias("text_sha256"),
        F.count("*").over(equal.orderBy(*best).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("n"),
        F.row_number().over(equal.orderBy(*best)).alias("rank"),
    )
    local = cut_lineage(local)
    same = Window.partitionBy("text_sha256")
    merged = local.where("rank = 1").select(
        "text_sha256",
        "salt",
        F.first("doc_id").over(same.orderBy(*best)).alias("keep_id"),
        F.sum("n").over(same).alias("group_size"),
        (F.row_number().over(same.orderBy(*best)) == 1).alias("best"),
    )
    return local.join(merged, ["text_sha256", "salt"]).select(
        "doc_id", "keep_id", "group_size", (F.col("best") & (F.col("rank") == 1)).alias("kept"), "text_sha256"
    )


def deduplicate(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows that stay, with all their columns, whatever their names."""
    stay = copies(docs, doc_id, text).where("kept").select(F.col("doc_id").alias("keep"), F.col("text_sha256").alias("sha"))
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    rows = docs.select(row, F.col(f"`{doc_id}`").alias("id"), F.sha2(normalised(body), 256).alias("own"), F.length(body).alias("chars"))
    met = rows.join(stay, F.col("own").eqNullSafe(F.col("sha")) & F.col("id").eqNullSafe(F.col("keep")))
    # rows of one id and one normalised text: the longest stays, one of equals
    first = F.row_number().over(Window.partitionBy("own", "id").orderBy(F.desc("chars")))
    return met.withColumn("first", first).where("first = 1").select("row.*")
