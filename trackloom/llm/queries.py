"""The operators of this subpackage applied to whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (collocations, cross_polytope, decontaminate, licenses, packing, perspectives, pii, prefix_trie, resample, simhash,
               token_store, top_k, toxicity)
from .common import new_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(function):
        QUERIES[function.__name__] = function
        if sql is not None:
            SQL[function.__name__] = sql
        return function

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query()
def op1_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write all documents' ids, then look every key up in the index and read it back."""
    docs = table(spark, sf_dir, "documents")
    path = new_path(spark, "token-store")
    token_store.write(docs, path, public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return token_store.read(spark, path, docs)


@query()
def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), words=4, radius=4)
    return found.select("doc_id", simhash.as_hex(F.col("fp")).alias("fingerprint"), "component_id")


@query()
def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place of every piece of every document in sequences of 2048 tokens."""
    packed = packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=0, capacity=2048)
    return packed.select("doc_id", "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "sequence_id", "offset")


FILES_SQL = """SELECT doc_id, text, source || '/' || doc_id // 1000 || CASE WHEN doc_id % 1000 = 0 THEN '/LICENSE'
  WHEN doc_id % 100 = 0 THEN '/' || doc_id // 100 % 10 || '/LICENSE' ELSE '/' || doc_id // 100 % 10 || '/' || doc_id || '.txt' END AS path
  FROM documents"""


@query(licenses.sql(FILES_SQL))
def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence of every document, seen as files of one tree per source with a licence file per hundred and thousand."""
    name = F.expr("""source || '/' || (doc_id div 1000) || CASE WHEN doc_id % 1000 = 0 THEN '/LICENSE'
      WHEN doc_id % 100 = 0 THEN '/' || (doc_id div 100 % 10) || '/LICENSE' ELSE '/' || (doc_id div 100 % 10) || '/' || doc_id || '.txt' END""")
    return licenses.licenses(table(spark, sf_dir, "documents").select("doc_id", "text", name.alias("path")))


@query()
def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, with the item, its edits and its place."""
    return decontaminate.pairs(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), short_exact=True)


@query()
def op6_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Importance weight of every document towards the texts of good quality, and whether it is drawn."""
    good = table(spark, sf_dir, "labels").filter("quality = 1").select("doc_id")
    return resample.resample(table(spark, sf_dir, "documents"), good)


@query()
def op7_cross_polytope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty nearest others of each vector whose id is divisible by 20."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return cross_polytope.neighbours(vectors, vectors.filter("vec_id % 20 = 0"), k=20)


@query(perspectives.SQL)
def op8_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation from each speaker's side, with the marks of its own turns."""
    return perspectives.render(table(spark, sf_dir, "conversations"))


@query()
def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of personal data in every document: counts, a digest of the base kinds, and all spans."""
    found = pii.find(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["base"])
    counts = [pii.number(F.col("spans"), k).cast("long").alias(f"n_{k}") for k in pii.BASE]
    return found.select("doc_id", *counts, F.sha2(pii.written(base), 256).alias("base_sha256"), pii.written(F.col("spans")).alias("spans"))


@query()
def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document by classifiers that saw no held-out label."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query(collocations.SQL)
def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two thousand strongest phrases of each language."""
    return collocations.collocations(table(spark, sf_dir, "documents"), least=100, best=2000)


@query(prefix_trie.SQL)
def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the prefix trie of all rebuilt conversations."""
    return prefix_trie.trie(table(spark, sf_dir, "conversations"))


@query(top_k.SQL)
def op13_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five highest integer inner products of each vector whose id is divisible by 50."""
    return top_k.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)
