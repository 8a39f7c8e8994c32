"""Importance resampling: which raw texts look as if drawn from a target corpus.

Two multinomial models over hashed unigrams and bigrams of words, one of the target texts and one of all raw
texts, are plain counts added up over every document. A text's log weight is the sum over its n-grams of the
log ratio of the two smoothed models. Adding standard Gumbel noise to the log weights and keeping the k
largest draws k texts without replacement in proportion to their weights (Gumbel top-k). The noise is a hash of
the id, so a draw can be repeated.

Null and empty texts have no n-grams and log weight 0. Rows of one id share their noise; null ids have the
noise of the empty id. Ties of the key at the k-th place are all kept. Without target texts all weights are 0.
An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.plans.selection import order_statistics

from .common import materialize, ship

BUCKETS = 1 << 16
SHARE = 0.8
BROADCAST_IDS = 1_000_000     # of some 16 bytes; more are joined by a shuffle


def ngrams(text: bytes | None, buckets: int) -> np.ndarray:
    """Buckets of all words and word pairs of a lower-cased text, repeats included."""
    from xxhash import xxh32_intdigest as xxh

    words = (text or b"").lower().split()
    if not words:
        return np.zeros(0, np.int64)
    one = np.array([xxh(w) for w in words], np.uint64)
    two = (one[:-1] * np.uint64(0x9E3779B1) + one[1:] * np.uint64(0x85EBCA77) + np.uint64(1)) & np.uint64(0xFFFFFFFF)
    two ^= two >> np.uint64(15)
    return (np.concatenate([one, two]) % np.uint64(buckets)).astype(np.int64)


def _counts(buckets: int):
    def run(batches):
        seen = np.zeros((2, buckets), np.int64)      # what this task has counted, a fixed size
        for batch in batches:
            wanted = batch.column(1).to_pylist()
            found = [ngrams(t.as_py(), buckets) for t in batch.column(0).cast(pa.binary())]
            for i, mine in enumerate((found, [f for f, w in zip(found, wanted) if w])):
                if mine:
                    seen[i] += np.bincount(np.concatenate(mine), minlength=buckets)
        at = np.flatnonzero(seen[0])
        for i in range(0, len(at), 10_000):
            part = at[i:i + 10_000]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(seen[0][part]), pa.array(seen[1][part])], names=["bucket", "raw", "target"])

    return run


def models(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Log ratio of target to raw probability per bucket, from all texts of `docs`; the target is the ids in
    `target` (doc_id)."""
    ship(docs.sparkSession)
    chosen = target.select("doc_id").filter("doc_id is not null").distinct().withColumn("t", F.lit(True))
    if chosen.count() <= BROADCAST_IDS:
        chosen = F.broadcast(chosen)
    texts = docs.select("doc_id", "text").join(chosen, "doc_id", "left").select("text", F.coalesce("t", F.lit(False)).alias("t"))
    counted = (texts.mapInArrow(_counts(buckets), "bucket long, raw long, target long")
                    .groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")))
    raw, wanted = np.zeros(buckets), np.zeros(buckets)
    for r in counted.toLocalIterator():              # at most `buckets` rows
        raw[r.bucket], wanted[r.bucket] = r.raw, r.target
    if not wanted.sum():
        return np.zeros(buckets)
    return np.log((wanted + 1) / (wanted.sum() + buckets)) - np.log((raw + 1) / (raw.sum() + buckets))


def _weights(sent, buckets: int):
    def run(batches):
        ratio = sent.value
        for batch in batches:
            found = [float(ratio[ngrams(t.as_py(), buckets)].sum()) for t in batch.column(1).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.float64())], names=["doc_id", "log_weight"])

    return run


def resample(docs: DataFrame, target: DataFrame, share: float = SHARE, buckets: int = BUCKETS, seed: int = 11) -> DataFrame:
    """`doc_id, log_weight, key, selected` of every row: drawn are the rows with the `share` largest keys."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(models(docs, target, buckets))
    uniform = (F.pmod(F.xxhash64(F.coalesce(F.col("doc_id"), F.lit(-1)), F.lit(seed)), F.lit(1 << 52)) + 0.5) / F.lit(float(1 << 52))
    keyed = materialize(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_weights(sent, buckets), "doc_id long, log_weight double")
                        .withColumn("key", F.col("log_weight") - F.log(-F.log(uniform))), "keys")
    n = keyed.count()
    kept = round(share * n)
    least = order_statistics(keyed, [("key", n - kept)])[0] if kept else None
    return keyed.withColumn("selected", F.lit(False) if least is None else F.col("key") >= least)
