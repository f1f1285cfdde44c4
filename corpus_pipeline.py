"""A corpus pipeline of five stages; each takes (spark, docs, sf_dir) and is written before the next one reads it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from viaduct.llm.decontamination import clean_of_benchmark
from viaduct.llm.exact_dedup import drop_copies
from viaduct.llm.near_dedup import drop_near_duplicates
from viaduct.llm.packing import pack_documents
from viaduct.llm.quality import keep_good, quality_model
from viaduct.session import clear, made, remove, scratch


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; it is trained on the labels of ``documents``, as in its query.

    A null or empty text is one empty line and scored like any other. Here as in all stages but the last, null and
    repeated ids are rows like any other, an empty table stays empty, and other columns are only carried.
    """
    return keep_good(docs, quality_model(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts equal but for white space: the longest, then the least ``doc_id``, nulls last.

    Null and empty texts are equal; of rows alike in all columns one stays.
    """
    return drop_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates: the least ``doc_id``, nulls last.

    Texts without words are near duplicates of their equals only.
    """
    return drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any passage of the benchmark; null texts have no words, and items without any are not looked for."""
    return clean_of_benchmark(docs, _table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents that are left, in sequences of 1024 ids; a null text is packed as an empty one."""
    return pack_documents(docs)


STAGES = [
    ("quality", quality),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("packing", packing),
]
#: Similarity classes, tokenizers and classifiers have no SQL; tests hold each stage and the whole against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's result is written as Parquet and read again, and what it wrote on the
    way, like the result before, is deleted then."""
    docs, before = _table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path, mark = scratch(spark, f"stage-{name}"), made(spark)
        stage(spark, docs, sf_dir).write.parquet(path)
        clear(spark, mark)
        if before:
            remove(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs
