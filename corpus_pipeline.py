"""Clean a corpus in stages and pack what stays into training sequences.

Each stage takes all documents that the one before kept, written as Parquet and read again. The
filters keep rows with all their columns; a row goes only for the reason its stage names.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowspark.llm import dedup, langid, packing, quality, sigtree
from flowspark.session import cut_lineage, prepare

ROW = "row"  # a whole document in one column, so that no name of its columns can clash with one added to it
LEAST_LANGUAGE_SCORE = 0.4
LEAST_QUALITY_SCORE = 0.3


def whole(docs: DataFrame, **added: Column) -> DataFrame:
    """Each document as one struct, with further columns beside it."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(ROW), *[c.alias(n) for n, c in added.items()])


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that is told with some certainty; those without a letter go.

    Where no document can be learned from, all with a letter stay.
    """
    prepare(spark)
    net = langid.fit(docs.where(F.col("doc_id").isNotNull() & ~langid.held_out(F.col("doc_id"), 4, 2)))
    if net is None:
        return docs.where(langid.lettered(F.col("text")).isNotNull())
    told = langid.predictor(net)(F.col("text"))
    kept = whole(docs, told=told).where((F.col("told.lang_pred") != langid.UNKNOWN) & (F.col("told.score") >= LEAST_LANGUAGE_SCORE))
    return kept.select(f"{ROW}.*")


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a sufficient quality score; learned from labelled documents not held out.

    Where these do not have both labels there is nothing to tell them apart by, and all stay.
    """
    prepare(spark)
    learned = docs.where(~langid.held_out(F.col("doc_id"), 5, 0))
    model = quality.fit(quality.features(learned), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    if model.only is not None:
        return docs
    kept = whole(docs, score=quality.scorer(model)(F.col("text"))).where(F.col("score") >= LEAST_QUALITY_SCORE)
    return kept.select(f"{ROW}.*")


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group with equal text but for white space."""
    prepare(spark)
    return dedup.deduplicate(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row with the smallest id of each group linked by five-word shingles at 0.8 or more.

    Each row is judged by its own text: rows without id come after those with one, and of rows with
    one id, or without, one stays by an order of their texts. Rows equal in id and text are left to
    the stage before. Texts without words are linked with nothing and stay.
    """
    prepare(spark)
    stay = sigtree.representatives(docs, words=5, num=80, den=100).select(F.col("doc_id").alias("stay_id"), F.col("hash").alias("stay_hash"))
    rows = whole(docs, id=F.col("doc_id"), hash=F.xxhash64("text"))
    met = rows.join(stay, F.col("id").eqNullSafe(F.col("stay_id")) & (F.col("hash") == F.col("stay_hash")), "left_semi")
    return met.select(f"{ROW}.*")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the sequences that the documents are packed into."""
    prepare(spark)
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"))


STAGES = [
    ("language", language),
    ("quality", good_quality),
    ("exact copies", exact_copies),
    ("near copies", near_copies),
    ("packing", packed),
]

# Two stages apply trained models and one a tokenizer, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
