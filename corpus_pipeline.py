"""Stages that turn the documents table into packed, clean training text.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read again before the next.
All but the last return the columns of `docs`. Nulls, empty texts, repeated rows, empty tables and extra columns
are treated as each stage's operator says. No stage can be written in SQL as a whole (trained scores, XXH64
fingerprints, edit distance, trained spans, tokenizers), so `ORACLE_SQL` is None; tests hold each stage against
plain versions instead.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from trackloom.llm import decontaminate, packing, pii, simhash, toxicity
from trackloom.llm.common import materialize, whole


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifiers hold toxic go."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(docs.select(whole(docs), "text"), model).filter("score < 0.5").select("_doc.*")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates, one row of its smallest id stays; without any id, one row."""
    return simhash.one_of_each(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind."""
    return pii.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces with their ids and places in sequences of 2048 tokens."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=0, capacity=2048, with_ids=True)


STAGES = [("toxicity", drop_toxic), ("simhash", drop_near_copies), ("decontamination", drop_leaks), ("pii", redact),
          ("packing", pack)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn, each over what the one before wrote."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs, name)
    return docs
