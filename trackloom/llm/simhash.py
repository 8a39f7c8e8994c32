"""SimHash near-duplicates by covering locality-sensitive hashing.

A fingerprint has a bit set where over half of a text's word shingles have it set. Fingerprints within
``radius`` bits are linked. Covering masks: each bit position gets a vector of radius+1 bits, and for each
non-zero vector v there is a mask of the positions whose product with v is odd. At most ``radius`` differing
positions always leave some v orthogonal to all of them, so every such pair agrees on that whole mask and
meets in that table: none is missed, by construction.

Equal fingerprints are one node. A bucket of up to ``bucket`` nodes gives a spanning forest of its verified
links, never all pairs. A fuller bucket is dealt out again by covering masks over the positions that its
mask leaves free; each level fixes at least a third of them. With twelve or fewer left free a bucket cannot hold
more than 4096 nodes and is done as it is. No bucket is cut or sampled.

Null text counts as empty; without words the fingerprint is zero and linked like any other. Null ids are
kept and take part in links; a component's id is its smallest non-null id. Repeated rows all come out.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ROW, materialize, ship, whole
from .components import components

BUCKET = 4096
HASHES = 1 << 16
STRIDE = 9         # spreads the vectors of few positions over all their bits
LAST_FREE = 12     # a bucket with so few free positions is bounded by itself


def fingerprint(text: bytes | None, words: int, seed: int = 42) -> int:
    from xxhash import xxh64_intdigest as xxh

    found = (text or b"").lower().split()   # on bytes: only A-Z and ASCII white space
    n = len(found)
    if not n:
        return 0
    joined = b" ".join(found)
    if n <= words:
        return xxh(joined, seed)
    sizes = np.fromiter(map(len, found), np.int64, n)
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    total = n - words + 1
    ones = np.zeros(64, np.int64)
    for at in range(0, total, HASHES):
        to = min(at + HASHES, total)
        hashes = [xxh(joined[a:b], seed) for a, b in zip(starts[at:to].tolist(), ends[at + words - 1:to + words - 1].tolist())]
        bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > total, bitorder="little").view("<u8")[0])


def _fingerprints(words: int):
    def run(batches):
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            found = np.array([fingerprint(t.as_py(), words) for t in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(found, pa.int64())], names=["doc_id", ROW, "fp"])

    return run


def fingerprints(docs: DataFrame, words: int = 4) -> DataFrame:
    """`doc_id, _row, fp` (the 64 bits as a signed long) of every row; _row is 0 unless `docs` numbers its rows."""
    ship(docs.sparkSession)
    row = F.col(ROW) if ROW in docs.columns else F.lit(0).cast("long").alias(ROW)
    return docs.select(F.col("doc_id").cast("long"), "text", row).mapInArrow(_fingerprints(words), f"doc_id long, {ROW} long, fp long")


@lru_cache(maxsize=4096)
def covering(radius: int, fixed: int = 0) -> tuple[int, ...]:
    """Masks that contain `fixed`, one of which any two numbers share that agree on `fixed` and differ in at
    most `radius` of the other positions."""
    free = [b for b in range(64) if not fixed >> b & 1]
    vectors = (1 << (radius + 1)) - 1
    masks = {fixed | sum(1 << b for i, b in enumerate(free) if (i * STRIDE % vectors + 1 & v).bit_count() & 1) for v in range(1, vectors + 1)}
    return tuple(sorted(masks))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _deal(radius: int):
    def run(batches):
        schema = pa.schema([("mask", pa.int64()), ("key", pa.int64()), ("fp", pa.int64())])
        for batch in batches:
            mask, fp = (batch.column(i).to_numpy() for i in (0, 1))
            for one in np.unique(mask):
                mine = fp[mask == one]
                for finer in covering(radius, int(one) & (2**64 - 1)):
                    m = np.int64(_signed(finer))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(mine), m)), pa.array(mine & m), pa.array(mine)], schema=schema)

    return run


def differing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count((a ^ b).view(np.uint64))   # of signed numbers it would count the magnitude's


def forest(nodes: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links that connect the nodes of a bucket just as all links within the radius would."""
    links, left = [], nodes
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            one = queue.pop()
            near = differing(left, one) <= radius
            if near.any():
                queue.extend(left[near])
                links.extend((int(one), int(x)) for x in left[near])
                left = left[~near]
    return links


def _bucket_links(radius: int):
    """Runs of equal (mask, key) in sorted rows; a run may go over several batches."""
    def run(batches):
        kept = np.zeros((3, 0), np.int64)
        for batch in _with_end(batches):
            rows = kept if batch is None else np.concatenate([kept, [batch.column(i).to_numpy() for i in range(3)]], axis=1)
            if not rows.shape[1]:
                continue
            change = np.flatnonzero((rows[:2, 1:] != rows[:2, :-1]).any(axis=0)) + 1
            starts = np.concatenate(([0], change))
            ends = np.concatenate((change, [rows.shape[1]]))
            if batch is not None:   # the last run may go on
                kept, starts, ends = rows[:, starts[-1]:], starts[:-1], ends[:-1]
            fp = rows[2]
            pairs = starts[ends - starts == 2]
            a, b = fp[pairs], fp[pairs + 1]
            near = differing(a, b) <= radius
            links = list(zip(a[near].tolist(), b[near].tolist()))
            more = ends - starts > 2
            for start, end in zip(starts[more], ends[more]):
                links += forest(fp[start:end], radius)
            links = np.array(list(set(links)), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(links[:, 0]), pa.array(links[:, 1])], names=["u", "v"])

    return run


def _with_end(batches):
    yield from batches
    yield None


def links(nodes: DataFrame, radius: int = 4, bucket: int = BUCKET) -> DataFrame:
    """Links `u, v` between distinct fingerprints `fp` that connect all pairs within the radius."""
    spark = nodes.sparkSession
    ship(spark)
    masks = F.array(*[F.lit(_signed(m)) for m in covering(radius)])
    dealt = nodes.select("fp", F.explode(masks).alias("mask")).select("mask", F.col("mask").bitwiseAND(F.col("fp")).alias("key"), "fp")
    found = None
    while True:
        full = materialize(dealt.groupBy("mask", "key").count()
                           .filter((F.col("count") > bucket) & (F.bit_count("mask") < 64 - LAST_FREE)).select("mask", "key"), "full-buckets")
        some = not full.isEmpty()
        light = dealt.join(full, ["mask", "key"], "left_anti") if some else dealt
        here = (light.repartition("mask", "key").sortWithinPartitions("mask", "key").select("mask", "key", "fp")
                     .mapInArrow(_bucket_links(radius), "u long, v long"))
        found = here if found is None else found.union(here)
        if not some:
            return found.distinct()
        heavy = dealt.join(full, ["mask", "key"], "left_semi").select("mask", "fp")
        dealt = materialize(heavy.mapInArrow(_deal(radius), "mask long, key long, fp long"), "finer-buckets")


def _classes(prints: DataFrame, radius: int, bucket: int) -> DataFrame:
    """`fp, component` (its smallest fingerprint) of every distinct fingerprint."""
    nodes = prints.select("fp").distinct()
    joined = components(links(nodes, radius, bucket)).withColumnRenamed("node", "fp")
    return nodes.join(joined, "fp", "left").select("fp", F.coalesce("component", "fp").alias("component"))


def near_duplicates(docs: DataFrame, words: int = 4, radius: int = 4, bucket: int = BUCKET) -> DataFrame:
    """`doc_id, fp, component_id` of every row of `docs` (doc_id, text)."""
    prints = materialize(fingerprints(docs, words).drop(ROW), "fingerprints")
    ids = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    nodes = _classes(prints, radius, bucket).join(ids, "fp")
    least = nodes.groupBy("component").agg(F.min("least").alias("component_id"))
    return prints.join(nodes.join(least, "component").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def one_of_each(docs: DataFrame, words: int = 4, radius: int = 4, bucket: int = BUCKET) -> DataFrame:
    """The row of the smallest non-null id of each component, the first read if several have it; all columns
    stay. `docs` must be a plain read of files, whose rows keep their numbers from one pass to the next."""
    rows = docs.select(whole(docs), "doc_id", "text", F.monotonically_increasing_id().alias(ROW))
    prints = materialize(fingerprints(rows, words), "fingerprints")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", ROW)).alias("first")
    ids = prints.groupBy("fp").agg(first)
    kept = _classes(prints, radius, bucket).join(ids, "fp").groupBy("component").agg(F.min("first").alias("first"))
    return rows.join(kept.select(F.col(f"first.{ROW}").alias(ROW)), ROW, "left_semi").select("_doc.*")


def as_hex(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
