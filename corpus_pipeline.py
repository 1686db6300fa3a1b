"""A training corpus from documents: quality, near-duplicates, recurring passages, mixture and packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from polyhop.llm import mixing, neardup, packing, passages, quality
from polyhop.llm._tables import cut, labels, release, scope


def reject_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return quality.keep(docs, labels(spark, sf_dir))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    return neardup.keep(docs)


def remove_recurring_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of passages that an earlier document holds go."""
    return passages.cleaned(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources by their target weights; a document taken several times is as many rows."""
    return mixing.mixture(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents and their places in sequences."""
    return packing.op5(docs)


STAGES = [
    ("quality classifier", reject_low_quality),
    ("near-dedup", drop_near_duplicates),
    ("substring dedup", remove_recurring_passages),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Models, hashes and tokens are beyond SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stage's result is written as Parquet in the shared folder and read again as the next one's docs; tables that
    nothing reads any more go."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        with scope() as keep:
            before, docs = docs, keep(cut(stage(spark, docs, sf_dir), name.replace(" ", "-")))
        if hasattr(before, "_polyhop_table"):
            release(before)
    return docs


__all__ = ["ORACLE_SQL", "STAGES", "run"]
