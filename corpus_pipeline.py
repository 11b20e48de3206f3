"""A training-data pipeline: language ID, near duplicates, source mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again as the
next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm import jaccard, language, mixing, packing, store


def by_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one known language; those without letters, or of which no language has two fifths of the letters, go."""
    store.small_batches(spark)
    return language.kept(docs)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by shingle Jaccard of 0.8 or more, the one with the smallest doc_id stays. Rows without
    words have no group and stay. Rows that repeat a doc_id, or have none, are documents of their own: of a group
    the first of the smallest doc_id stays, or the first if none has one."""
    store.small_batches(spark)
    unnamed = docs.groupBy("doc_id").count().where("doc_id is null or count > 1")
    if unnamed.isEmpty():
        found = jaccard.classes(docs)
        gone = store.saved(found.where("doc_id <> component_id").select("doc_id").distinct(), "near-duplicates")
        return docs.join(gone, "doc_id", "left_anti").select(docs.columns)
    # rows get numbers of their own, and are written with them so that these hold
    rows = store.saved(docs.select(F.monotonically_increasing_id().alias("number"), F.struct("*").alias("row")), "numbered")
    found = jaccard.classes(rows.select(F.col("number").alias("doc_id"), "row.text")).select(F.col("doc_id").alias("number"), "component_id")
    rank = F.struct(F.col("row.doc_id").isNull(), "row.doc_id", "number")
    first = rows.join(found, "number").groupBy("component_id").agg(F.min(rank).alias("first")).select(F.col("first.number").alias("number"))
    return rows.join(store.saved(first, "firsts"), "number", "left_semi").select("row.*")


def to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.emitted(docs)


def into_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their ids, sequence and place."""
    store.small_batches(spark)
    return packing.packed(docs)


STAGES = [
    ("language", by_language),
    ("near_duplicates", one_of_each_group),
    ("mixing", to_weights),
    ("packing", into_sequences),
]
#: Components of near duplicates and the tokenizer are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = store.table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = store.saved(docs, name)
    return docs
