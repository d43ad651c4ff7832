"""A corpus pipeline of five stages over documents: filter by quality, deduplicate, decontaminate, mix.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept; its result is
written as Parquet and read again as the next one's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from graphloom.llm import _dist
from graphloom.llm.decontaminate import decontaminate
from graphloom.llm.exact_dedup import drop_exact_duplicates
from graphloom.llm.jaccard_join import drop_near_duplicates
from graphloom.llm.quality_fm import keep_quality
from graphloom.llm.source_mix import mixed_texts


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on labels of documents here, doesn't reject."""
    return keep_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first of documents whose texts are equal but for white space."""
    return drop_exact_duplicates(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies: five-word shingles, Jaccard similarity 0.8 or more."""
    return drop_near_duplicates(docs, k=5, num=4, den=5)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without ten consecutive words of a benchmark item."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixed corpus: what each slot of each shard takes of which document, with its words, repeats written out."""
    return mixed_texts(docs)


STAGES = [("quality_classifier", quality), ("exact_dedup", exact), ("ngram_jaccard_join", near), ("benchmark_decontamination", clean), ("source_mixing", mixed)]

#: The first stage is a trained classifier, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = _dist.materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
