"""Token ids as raw binary blocks with a minimal perfect hash index from document key to place.

Layout under one folder, all written and read by Spark:

* ``payload``: a row per block: ``shard``, ``block``, ``entry`` (documents before it in the shard),
  ``token`` (ids before it in the shard), ``keys``, ``starts`` and ``lengths`` of its documents, and ``ids``,
  the raw little-endian unsigned 32-bit ids of whole documents, one after another. Shards follow ascending keys.
* ``shards``: a row per shard with the documents and ids of all earlier shards.
* ``index``: a row per bucket of keys: a minimal perfect hash function (levels of bit arrays) and, by
  slot, a 32-bit fingerprint of the key and its first entry, first id, length and number of rows.

A lookup costs one bucket, a few bits and one slot; a foreign key fails on the fingerprint but for
2**-32. Documents of one key lie next to each other, ordered by the hash of their text.

Null keys come first and have a bucket of their own; null text counts as empty, so only the end id is
stored; repeated rows are all kept; an empty table gives empty files; other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import ROW, keyed, partition_id, ship

BLOCK_BYTES = 1 << 20
BUCKET_KEYS = 20_000
COPIES = 4096
BROADCAST_SHARDS = 1_000_000

PAYLOAD = ("shard int, block int, entry long, token long, keys array<long>, starts array<long>, lengths array<int>, ids binary")
INDEX = "bucket long, n int, levels array<int>, bits binary, slots binary"
SLOT = np.dtype([("print", "<u4"), ("entry", "<i8"), ("token", "<i8"), ("length", "<i4"), ("copies", "<i8")])


def mixed(keys: np.ndarray, seed: int) -> np.ndarray:
    """A one-to-one scrambling of 64-bit keys, another one for each seed."""
    with np.errstate(over="ignore"):
        x = keys.astype(np.uint64) + np.uint64((seed + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class PerfectHash:
    """Maps n distinct 64-bit keys to 0..n-1: each level sets the bits that exactly one key hits, the other
    keys go down a level, and a key's slot is the number of bits set before its own."""

    def __init__(self, levels: list[int], bits: np.ndarray):
        self.levels, self.bits = levels, bits
        self.before = np.concatenate(([0], np.cumsum(bits, dtype=np.int64)))
        self.starts = np.concatenate(([0], np.cumsum(levels)))

    @classmethod
    def of(cls, keys: np.ndarray) -> PerfectHash:
        levels, parts, rest = [], [], keys
        while len(rest):
            size = 2 * len(rest)
            at = (mixed(rest, len(levels)) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            levels.append(size)
            parts.append(alone)
            rest = rest[~alone[at]]
        return cls(levels, np.concatenate(parts) if parts else np.zeros(0, bool))

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """-1 where no level has the key, so it was not among those built from."""
        found = np.full(len(keys), -1, dtype=np.int64)
        left = np.arange(len(keys))
        for level, size in enumerate(self.levels):
            at = self.starts[level] + (mixed(keys[left], level) % np.uint64(size)).astype(np.int64)
            hit = self.bits[at]
            found[left[hit]] = self.before[at[hit]]
            left = left[~hit]
        return found


def fingerprints(keys: np.ndarray) -> np.ndarray:
    return (mixed(keys, 1000) >> np.uint64(32)).astype(np.uint32)


def _blocks(tokenizer: str, end_id: int, block_bytes: int):
    schema = pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("entry", pa.int64()), ("token", pa.int64()),
                        ("keys", pa.list_(pa.int64())), ("starts", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int32())), ("ids", pa.binary())])

    def run(batches):
        from .tokenizer import encoder

        encode, end = encoder(tokenizer).encode_one, np.asarray([end_id], "<u4").tobytes()
        shard, block, entry, token = partition_id(), 0, 0, 0
        keys, starts, lengths, ids, size = [], [], [], [], 0

        def full():
            return pa.RecordBatch.from_arrays(
                [pa.array([v], t.type) for v, t in zip((shard, block, entry, token, keys, starts, lengths, b"".join(ids)), schema)],
                schema=schema)

        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                one = encode(text.as_py()) + end
                keys.append(key)
                starts.append(size // 4)
                lengths.append(len(one) // 4)
                ids.append(one)
                size += len(one)
                if size >= block_bytes:
                    yield full()
                    block, entry, token = block + 1, entry + len(keys), token + size // 4
                    keys, starts, lengths, ids, size = [], [], [], [], 0
        if keys:
            yield full()

    return run


def _build(table: pa.Table) -> pa.Table:
    keys = table["key"].to_numpy()
    perfect = PerfectHash.of(keys)
    slots = np.zeros(len(keys), SLOT)
    at = perfect.slots(keys)
    slots["print"][at] = fingerprints(keys)
    for name in ("entry", "token", "length", "copies"):
        slots[name][at] = table[name].to_numpy()
    return pa.table({"bucket": pa.array([table["bucket"][0].as_py()], pa.int64()), "n": pa.array([len(keys)], pa.int32()),
                     "levels": pa.array([perfect.levels], pa.list_(pa.int32())),
                     "bits": pa.array([np.packbits(perfect.bits).tobytes()], pa.binary()),
                     "slots": pa.array([slots.tobytes()], pa.binary())})


def _find(wanted: pa.Table, index: pa.Table) -> pa.Table:
    keys = wanted["key"].to_numpy()
    if index.num_rows and len(keys):
        levels = index["levels"][0].as_py()
        bits = np.unpackbits(np.frombuffer(index["bits"][0].as_py(), np.uint8), count=sum(levels)).astype(bool)
        at = PerfectHash(levels, bits).slots(keys)
        slots = np.frombuffer(index["slots"][0].as_py(), SLOT)[at]
        ok = (at >= 0) & (slots["print"] == fingerprints(keys))
        wanted, slots = wanted.filter(pa.array(ok)), slots[ok]
    else:
        wanted, slots = wanted.slice(0, 0), np.zeros(0, SLOT)
    return pa.table({"key": wanted["doc_id"]} | {n: pa.array(slots[n]) for n in ("entry", "token", "length", "copies")})


def _bucket(keys: DataFrame, buckets: int) -> DataFrame:
    """Adds the bucket; the null key has bucket -1 to itself."""
    return keys.withColumn("bucket", F.when(F.col("doc_id").isNull(), F.lit(-1).cast("long"))
                           .otherwise(F.pmod(F.xxhash64("doc_id"), F.lit(buckets)))) \
               .withColumn("key", F.coalesce("doc_id", F.lit(0)).cast("long"))


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int, shards: int | None = None,
          block_bytes: int = BLOCK_BYTES) -> None:
    """Encode `text` of every row, append `end_id`, and write payload, shard table and index under `path`."""
    spark = docs.sparkSession
    ship(spark)
    rows = keyed(docs, "doc_id", "text").withColumn("_hash", F.xxhash64("text"))
    order = ["doc_id", "_hash", ROW]
    dealt = rows.repartitionByRange(shards, *order) if shards else rows.repartitionByRange(*order)
    (dealt.sortWithinPartitions(*order).select(F.col("doc_id").cast("long"), "text")
          .mapInArrow(_blocks(tokenizer, end_id, block_bytes), PAYLOAD)
          .write.parquet(f"{path}/payload"))

    payload = spark.read.schema(PAYLOAD).parquet(f"{path}/payload")
    counted = payload.groupBy("shard").agg(F.sum(F.size("keys")).alias("docs"), F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x)).alias("ids"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)   # one row per shard
    counted.select("shard", "docs", "ids", F.coalesce(F.sum("docs").over(before), F.lit(0)).alias("docs_before"),
                   F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("ids_before")).write.parquet(f"{path}/shards")

    entries = (_entries(spark, path).groupBy("doc_id").agg(F.min_by(F.struct("at", "start", "length"), "at").alias("first"), F.count("*").alias("copies"))
               .select("doc_id", F.col("first.at").alias("entry"), F.col("first.start").alias("token"), F.col("first.length").alias("length"), "copies"))
    n = spark.read.parquet(f"{path}/shards").agg(F.coalesce(F.sum("docs"), F.lit(0))).first()[0]
    buckets = max(1, -(-n // BUCKET_KEYS))
    (_bucket(entries, buckets).groupBy("bucket").applyInArrow(_build, INDEX)
        .withColumn("buckets", F.lit(buckets)).write.parquet(f"{path}/index"))


def _shards(spark: SparkSession, path: str) -> DataFrame:
    """What lies before each shard; broadcast up to a counted number of rows of about 24 bytes."""
    shards = spark.read.parquet(f"{path}/shards").select("shard", "docs_before", "ids_before")
    return F.broadcast(shards) if shards.count() <= BROADCAST_SHARDS else shards


def _entries(spark: SparkSession, path: str) -> DataFrame:
    """A row per stored document: its key, its global entry number `at`, first id `start` and `length`."""
    blocks = spark.read.schema(PAYLOAD).parquet(f"{path}/payload").drop("ids").join(_shards(spark, path), "shard")
    one = blocks.select((F.col("docs_before") + F.col("entry")).alias("docs"), (F.col("ids_before") + F.col("token")).alias("before"),
                        F.posexplode(F.arrays_zip("keys", "starts", "lengths")).alias("i", "doc"))
    return one.select(F.col("doc.keys").alias("doc_id"), (F.col("docs") + F.col("i")).alias("at"),
                      (F.col("before") + F.col("doc.starts")).alias("start"), F.col("doc.lengths").alias("length"))


def lookup(spark: SparkSession, path: str, keys: DataFrame) -> DataFrame:
    """Places of the distinct `doc_id` in `keys`: entry, token, length of the first row and copies. Keys that
    are not stored are left out."""
    ship(spark)
    index = spark.read.parquet(f"{path}/index")
    first = index.select("buckets").first()
    buckets = first[0] if first else 1
    wanted = _bucket(keys.select(F.col("doc_id").cast("long")).distinct(), buckets)
    return (wanted.groupBy("bucket").cogroup(index.select("bucket", "n", "levels", "bits", "slots").groupBy("bucket"))
            .applyInArrow(_find, "key long, entry long, token long, length int, copies long")
            .withColumnRenamed("key", "doc_id"))


def _digests(with_ids: bool):
    def run(batches):
        for batch in batches:
            at, start, n, crc, ids = [], [], [], [], []
            for entry, token, starts, lengths, raw in zip(*(batch.column(i) for i in range(5))):
                block, entry, token = memoryview(raw.as_buffer()), entry.as_py(), token.as_py()
                for i, (ahead, length) in enumerate(zip(starts.as_py(), lengths.as_py())):
                    piece = block[4 * ahead:4 * (ahead + length)]
                    at.append(entry + i)
                    start.append(token + ahead)
                    n.append(length)
                    crc.append(zlib.crc32(piece))
                    if with_ids:
                        ids.append(piece.tobytes())
            columns = [pa.array(x, pa.int64()) for x in (at, start, n, crc)]
            names = ["at", "start", "n_tokens", "ids_crc32"]
            if with_ids:
                columns, names = [*columns, pa.array(ids, pa.binary())], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def read(spark: SparkSession, path: str, keys: DataFrame, with_ids: bool = False) -> DataFrame:
    """Stored rows of the given keys: doc_id, start, n_tokens, ids_crc32 and, on request, ids.

    The index tells where each key's rows are; one pass over the payload, which is not shuffled, cuts the
    documents out; both meet on the entry number.
    """
    chunk = F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(copies - 1) div {COPIES}"))).alias("chunk")
    spread = lookup(spark, path, keys).select("doc_id", "entry", "copies", chunk).select("doc_id", F.explode(F.sequence(
        F.col("entry") + F.col("chunk") * COPIES,
        F.col("entry") + F.least(F.col("copies"), (F.col("chunk") + 1) * COPIES) - 1)).alias("at"))
    cut = (spark.read.schema(PAYLOAD).parquet(f"{path}/payload").join(_shards(spark, path), "shard")
           .select((F.col("docs_before") + F.col("entry")).alias("entry"), (F.col("ids_before") + F.col("token")).alias("token"),
                   "starts", "lengths", "ids")
           .mapInArrow(_digests(with_ids), "at long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids))
    return spread.join(cut, "at").drop("at")
