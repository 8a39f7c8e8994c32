"""Nearest neighbours by largest inner product through cross-polytope hashing.

Each table turns unit vectors by a fast pseudo-rotation (three rounds of random signs and a Hadamard
transform) and hashes them to the nearest signed axis. A query probes its nearest axes in every table, and all
vectors found there are ranked by the inner product of the original vectors in double precision. Vectors are
hashed by direction alone, so that no length turns another away, and fall into ranges of length (factors of two),
each of which every query searches for ``k`` of its own. Ranges of at most ``few`` vectors are compared whole.

Buckets are dealt out in blocks of vectors times blocks of queries, by counts per bucket, so that a common
vector or a popular query fills many small tasks; nothing is capped. A pair that meets in several tables is
reported by the first. Of each block, a query keeps its ``k`` best, which loses none of the overall best.

Vectors that are null, zero, of another than the most frequent dimension, or hold null or non-finite
components take no part, and neither do rows without id. Of rows with one id the least vector counts. Ties go
to the smaller id; with fewer candidates all of them come out; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize, ship

TABLES = 10
PROBES = 16
FEW = 256          # a range of length with so few vectors is not hashed
BLOCK = 4096
QUERIES = 1024
FOUND = "query_id long, part int, vec_id long, score double"
WHOLE = -1         # stands for the table and axis of ranges that are compared whole


def signs(tables: int, width: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).choice([-1.0, 1.0], (tables, 3, width))


def hadamard(x: np.ndarray) -> np.ndarray:
    n, half = x.shape[1], 1
    while half < n:
        x = x.reshape(len(x), -1, 2, half)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2).reshape(len(x), n)
        half *= 2
    return x / np.sqrt(n)


def rotate(x: np.ndarray, rounds: np.ndarray) -> np.ndarray:
    for sign in rounds:
        x = hadamard(x * sign)
    return x


def matrix(column: pa.ListArray, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


def _directions(x: np.ndarray, width: int) -> np.ndarray:
    out = np.zeros((len(x), width))
    out[:, :x.shape[1]] = x / np.abs(x).max(axis=1, keepdims=True)     # squares neither overflow nor vanish
    return out / np.linalg.norm(out, axis=1, keepdims=True)


def best(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest scores, ties to the smaller id."""
    if len(score) > k:
        least = np.partition(score, len(score) - k)[len(score) - k]
        near = np.flatnonzero(score >= least)
    else:
        near = np.arange(len(score))
    return near[np.lexsort((ids[near], -score[near]))][:k]


def _hashes(dim, width, turn):
    def run(batches):
        for batch in batches:
            x = _directions(matrix(batch.column(1), dim), width)
            out = np.empty((len(x), len(turn)), np.int32)
            for t, rounds in enumerate(turn):
                y = rotate(x, rounds)
                axis = np.abs(y).argmax(axis=1)
                out[:, t] = 2 * axis + (y[np.arange(len(y)), axis] < 0)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, out.size + 1, len(turn)), pa.int32()), pa.array(out.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), lists], names=["vec_id", "vector", "part", "hashes"])

    return run


def _probes(dim, width, turn, probes):
    def run(batches):
        for batch in batches:
            x = _directions(matrix(batch.column(1), dim), width)
            out = np.empty((len(x), len(turn), probes), np.int32)
            for t, rounds in enumerate(turn):
                y = rotate(x, rounds)
                both = np.stack([y, -y], axis=2).reshape(len(y), -1)
                out[:, t] = np.argsort(-both, axis=1, kind="stable")[:, :probes]
            size = len(turn) * probes
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, out.size + 1, size), pa.int32()), pa.array(out.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists], names=["query_id", "query", "probes"])

    return run


def _meet(dim, axes, tables, probes, k):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        if left.num_rows and right.num_rows:
            table, part = left["tab"][0].as_py(), left["part"][0].as_py()
            ids, h = left["vec_id"].to_numpy(), matrix(left["hashes"].combine_chunks(), tables).astype(np.int64)
            v = matrix(left["vector"].combine_chunks(), dim)
            probe = matrix(right["probes"].combine_chunks(), tables * probes).astype(np.int64).reshape(-1, tables, probes)
            q, own = matrix(right["query"].combine_chunks(), dim), right["query_id"].to_numpy()
            close = q @ v.T
            for i in range(len(q)):
                fresh = ids != own[i]
                for t in range(table):      # met there already; none if the range is compared whole
                    reach = np.zeros(axes, bool)
                    reach[probe[i, t]] = True
                    fresh &= ~reach[h[:, t]]
                at = np.flatnonzero(fresh)
                if not len(at):
                    continue
                row = close[i, at]
                if len(at) > k:             # the product of matrices may differ in the last digits
                    at = at[row >= np.partition(row, len(row) - k)[len(row) - k] - 1e-9 * (1 + np.abs(row).max())]
                score = (v[at] * q[i]).sum(axis=1)
                first = best(score, ids[at], k)
                out.append((np.full(len(first), own[i]), ids[at][first], score[first]))
        query, vec, score = (np.concatenate(c) for c in zip(*out))
        parts = pa.array(np.full(len(query), part if len(query) else 0), pa.int32())
        return pa.table({"query_id": query, "part": parts, "vec_id": vec, "score": score})

    return run


def neighbours(vectors: DataFrame, queries: DataFrame, k: int = 20, tables: int = TABLES, probes: int = PROBES,
               block: int = BLOCK, query_block: int = QUERIES, seed: int = 5, few: int = FEW) -> DataFrame:
    """`query_id, rank, vec_id, score` of each row of `queries`, searched among `vectors` without the row of the
    query's own id; both have vec_id and embedding."""
    spark = vectors.sparkSession
    ship(spark)

    def usable(df):
        whole = F.col("embedding").cast("array<double>")
        good = (F.size("vector") > 0) & F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vector", lambda x: x != 0)
        one = df.select(F.col("vec_id").cast("long").alias("vec_id"), whole.alias("vector")).filter(F.col("vec_id").isNotNull() & good)
        return one.groupBy("vec_id").agg(F.min("vector").alias("vector"))

    base = materialize(usable(vectors), "vectors")
    sizes = base.groupBy(F.size("vector").alias("dim")).agg(F.count("*").alias("n"))
    most = sizes.orderBy(F.desc("n"), F.desc("dim")).first()
    if most is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim = most.dim
    width = 1 << (dim - 1).bit_length()
    probes = min(probes, 2 * width)
    turn = signs(tables, width, seed)
    high = F.array_max(F.transform("vector", F.abs))
    length = F.log2(high) + F.log2(F.aggregate("vector", F.lit(0.0), lambda a, x: a + (x / high) * (x / high))) / 2
    base = base.filter(F.size("vector") == dim).withColumn("part", F.round(length).cast("int"))
    hashed = materialize(base.mapInArrow(_hashes(dim, width, turn), "vec_id long, vector array<double>, part int, hashes array<int>"), "hashes")
    asked = materialize(usable(queries).filter(F.size("vector") == dim)
                        .mapInArrow(_probes(dim, width, turn, probes), "query_id long, query array<double>, probes array<int>"), "probes")

    # Ranges and rows per bucket on both sides: at most as many ranges as doubles have exponents, times tables x 2 x width.
    # A hashed range holds at least k vectors besides the query's own.
    ranges = F.broadcast(materialize(hashed.groupBy("part").agg((F.count("*") <= max(few, k)).alias("small")), "length-ranges"))
    sides = hashed.join(ranges, "part")
    whole_range = sides.filter("small").select("vec_id", "vector", "hashes", "part", F.lit(WHOLE).alias("tab"), F.lit(WHOLE).alias("axis"))
    buckets = sides.filter("NOT small").select("vec_id", "vector", "hashes", "part", F.posexplode("hashes").alias("tab", "axis"))
    probed = asked.select("query_id", "query", "probes", F.posexplode("probes").alias("at", "axis")).withColumn("tab", F.expr(f"cast(at div {probes} as int)")).drop("at")

    def every(asks, which):
        return asks.crossJoin(F.broadcast(ranges.filter(which).select("part")))

    def all_axes(asks):
        return asks.select("query_id", "query", "probes", "part", F.lit(WHOLE).alias("tab"), F.lit(WHOLE).alias("axis"))

    def firsts(met, *by):
        order = Window.partitionBy("query_id", *by).orderBy(F.desc("score"), "vec_id")
        return met.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)

    def meet(spots, goals):
        return firsts(_dealt(spots, goals, block, query_block).applyInArrow(_meet(dim, 2 * width, tables, probes, k), FOUND), "part").drop("rank")

    met = materialize(meet(whole_range.union(buckets), all_axes(every(asked, "small")).union(
        every(probed, "NOT small").select("query_id", "query", "probes", "part", "tab", "axis"))), "met")

    # Queries whose buckets held fewer than k of a hashed range go through the whole range.
    enough = met.groupBy("query_id", "part").count().filter(F.col("count") >= k).select("query_id", "part")
    short = materialize(every(asked.select("query_id"), "NOT small").join(enough, ["query_id", "part"], "left_anti"), "short-queries")
    if not short.isEmpty():
        again = meet(sides.filter("NOT small").select("vec_id", "vector", "hashes", "part", F.lit(WHOLE).alias("tab"), F.lit(WHOLE).alias("axis")),
                     all_axes(asked.join(short, "query_id")))
        met = met.join(short, ["query_id", "part"], "left_anti").select("query_id", "part", "vec_id", "score").union(again)
    return firsts(met).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _dealt(spots: DataFrame, goals: DataFrame, block: int, query_block: int):
    """Vectors and queries of each bucket (part, tab, axis), cogrouped by blocks of both."""
    bucket = ["part", "tab", "axis"]
    counts = spots.groupBy(*bucket).agg(F.ceil(F.count("*") / block).cast("int").alias("v_blocks")).join(
        goals.groupBy(*bucket).agg(F.ceil(F.count("*") / query_block).cast("int").alias("q_blocks")), bucket)
    counts = F.broadcast(materialize(counts, "bucket-counts"))

    def deal(n):
        return F.explode(F.sequence(F.lit(0), n - 1))

    left = spots.join(counts, bucket).select(
        *bucket, F.pmod(F.xxhash64("vec_id"), F.col("v_blocks")).cast("int").alias("vb"), deal(F.col("q_blocks")).alias("qb"), "vec_id", "vector", "hashes")
    right = goals.join(counts, bucket).select(
        *bucket, deal(F.col("v_blocks")).alias("vb"), F.pmod(F.xxhash64("query_id"), F.col("q_blocks")).cast("int").alias("qb"), "query_id", "query", "probes")
    key = [*bucket, "vb", "qb"]
    return left.groupBy(*key).cogroup(right.groupBy(*key))
