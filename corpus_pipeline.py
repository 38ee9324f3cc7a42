"""From raw documents to shards of a training mix. Each stage is written as Parquet and read again as the next one's documents.

All stages take null ids, rows that repeat, further columns (which go along) and empty tables, which stay empty; what each makes of them stands with it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from duolex.llm.decontamination import keep_clean
from duolex.llm.jaccard_join import keep_one
from duolex.llm.language_id import keep_identified, learn
from duolex.llm.mixing import mixed_documents
from duolex.llm.shared import Tables, load
from duolex.llm.sharding import shard_documents


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told; those without letters (null and empty texts too) and those between languages go. Rows that repeat are
    judged each by itself. Where no row has a language nothing can be learned, and nothing stays."""
    return keep_identified(docs, learn(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by 5-word shingles at a Jaccard similarity of 0.8 the one with the least id. Documents without words are linked
    with nothing and stay; of rows that repeat with their id and text one stays."""
    return keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't contaminated by `benchmark`. One without words is clean; an empty benchmark keeps all."""
    return keep_clean(docs, load(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix draws it, 3 times at most. One without words is drawn with what its source is drawn; null sources are one source."""
    return mixed_documents(docs)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows with their shard and slot, repeated draws as rows of their own; columns of these names are replaced."""
    return shard_documents(docs, 8)


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("sharding", sharding),
]

#: Learned scores, similarity components and the walk of a permutation have no SQL form here; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = Tables(spark)
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = tables.put(stage(spark, docs, sf_dir), name)
        tables.sweep()
    return docs
