"""Exact top-k by integer inner product: columnar branch and bound.

Vectors lie in blocks stored vertically: of each block one buffer a group of dimensions, components of one dimension
side by side, heaviest dimensions first over the whole table. A block of queries meets a block of vectors and adds
up scores group by group. What the remaining dimensions can still add or take away is at most the product of the
lengths of both remainders (Cauchy-Schwarz); a candidate whose score plus that falls short of what ``k`` others
are sure to reach, or of the query's floor, leaves, and the columns of the survivors are compacted.

A query's floor comes from its first ``k`` candidates in a seed block; it is a true score of the query, so no
pair above or at it is lost. Blocks hold vectors of neighbouring lengths, and a pair of blocks whose lengths
cannot reach any floor is not built at all. Every other pair of blocks is one row of a join on both block numbers.

Components become floor(256 * x), which is a double without loss. Sums are exact: in doubles where they stay
below 2^53, else in integers of any size; a score beyond a long is given as the nearest long. Rows are candidates
one by one: a repeated id is several candidates and, among the queries, several queries; a null id is a
candidate that loses ties, and no query unless `queries` holds it. Vectors that are null or empty, or hold null or
non-finite components, take no part; vectors meet only those of their own dimension. With fewer candidates than `k`
all come out; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trackloom.plans.numbering import numbered

from .common import materialize, ship

BLOCK = 4096        # vectors of a block
QUERIES = 512       # queries of a block
GROUP = 16          # dimensions of a group
SALTS = 64          # tasks that list the pairs of blocks of one dimension
EXACT = 2.0**53     # doubles add up integers below this without loss
SLACK = 1 + 1e-9    # on lengths, which are rounded
HIT = "query long, query_id long, vec_id long, score long"


def quantised(column: Column) -> Column:
    """floor(256 * x) of every component, as doubles; null where a vector takes no part."""
    x = F.transform(column.cast("array<double>"), lambda v: F.lit(256.0) * v)
    fine = (F.size(x) > 0) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    whole = F.transform(x, lambda v: F.when(F.abs(v) < 2.0**52, F.floor(v).cast("double")).otherwise(v))
    return F.when(fine, whole)


def _vertical(order: dict[int, list[int]], group: int):
    """Rows of one block become one row: ids, lengths of the remainders, and a buffer a group of dimensions."""

    def run(table: pa.Table) -> pa.Table:
        dim = table["dim"][0].as_py()
        x = table["x"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)[:, order[dim]]
        starts = range(0, dim, group)
        rest = np.stack([np.sqrt(np.square(x[:, s:]).sum(axis=1)) for s in (*starts[1:], dim)], axis=0)
        columns = [np.ascontiguousarray(x[:, s:s + group].T).tobytes() for s in starts]
        return pa.table({
            "dim": pa.array([dim], pa.int32()), "block": pa.array([table["block"][0].as_py()], pa.int64()),
            "row": pa.array([table["row"].to_pylist()], pa.list_(pa.int64())),
            "id": pa.array([table["vec_id"].to_pylist()], pa.list_(pa.int64())),
            "longest": pa.array([float(np.sqrt(np.square(x).sum(axis=1)).max())]),
            "largest": pa.array([float(np.abs(x).max())]),
            "rest": pa.array([rest.tobytes()], pa.binary()), "columns": pa.array([columns], pa.list_(pa.binary()))})

    return run


class Block:
    """The numpy side of a vertical block."""

    def __init__(self, row: dict):
        self.dim, self.rows = row["dim"], np.array(row["row"], np.int64)
        self.ids, self.largest = row["id"], row["largest"]
        n = len(self.rows)
        self.rest = np.frombuffer(row["rest"]).reshape(-1, n)
        self.columns = [np.frombuffer(c).reshape(-1, n) for c in row["columns"]]
        self.place = np.array([np.iinfo(np.int64).max if i is None else i for i in self.ids], np.int64)
        self.null = np.array([i is None for i in self.ids])


def best(score, null, place, k: int) -> np.ndarray:
    """Places of the `k` highest scores, ties to the smaller id, null ids last."""
    at = np.arange(len(score))
    if len(at) > k and score.dtype != object:
        at = np.flatnonzero(score >= np.partition(score, len(score) - k)[len(score) - k])
    if score.dtype == object:
        return np.array(sorted(at, key=lambda i: (-score[i], null[i], place[i]))[:k], np.int64)
    return at[np.lexsort((place[at], null[at], -score[at]))][:k]


def search(vectors: Block, queries: Block, floors: np.ndarray, k: int):
    """(query place, vector places, scores) of each query's `k` best of the block that reach its floor."""
    exact = vectors.largest * queries.largest * vectors.dim < EXACT
    for q in range(len(queries.rows)):
        at = np.flatnonzero(vectors.rows != queries.rows[q])
        if not exact:
            whole = [[int(v) for c in vectors.columns for v in c[:, i]] for i in at]
            own = [int(v) for c in queries.columns for v in c[:, q]]
            score = np.array([sum(map(int.__mul__, w, own)) for w in whole], object)
        else:
            score = np.zeros(len(at))
            for g, column in enumerate(vectors.columns):
                mine = queries.columns[g][:, q]
                score = score + mine @ (column if len(at) == column.shape[1] else column[:, at])
                if g + 1 < len(vectors.columns) and len(at):
                    reach = vectors.rest[g][at] * (queries.rest[g][q] * SLACK)
                    least = floors[q]
                    if len(at) >= k:
                        sure = score - reach
                        least = max(least, np.partition(sure, len(sure) - k)[len(sure) - k])
                    stay = score + reach >= least
                    at, score = at[stay], score[stay]
        if exact:
            stay = score >= floors[q]
            at, score = at[stay], score[stay]
        if len(at):
            first = best(score, vectors.null[at], vectors.place[at], k)
            yield q, at[first], score[first]


def _hits(k: int):
    edge = 2**63 - 1

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                vectors, queries = Block(row["v"]), Block(row["q"])
                floors = np.array(row["floors"] or [-np.inf] * len(queries.rows), float)
                out = ([], [], [], [])
                for q, at, score in search(vectors, queries, floors, k):
                    out[0].extend([int(queries.rows[q])] * len(at))
                    out[1].extend([queries.ids[q]] * len(at))
                    out[2].extend(vectors.ids[i] for i in at)
                    out[3].extend(max(-edge - 1, min(edge, int(s))) for s in score)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=["query", "query_id", "vec_id", "score"])

    return run


def _first(hits: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, block: int = BLOCK, query_block: int = QUERIES, group: int = GROUP) -> DataFrame:
    """`query_id, rank, vec_id, score` of each row of `vectors` (vec_id, embedding) that `is_query` marks, searched
    among all other rows."""
    spark = vectors.sparkSession
    ship(spark)
    usable = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), quantised(F.col("embedding")).alias("x"),
                            F.coalesce(is_query, F.lit(False)).alias("asks")).filter("x is not null")
    long = usable.withColumns({"dim": F.size("x"), "length": F.sqrt(F.aggregate("x", F.lit(0.0), lambda a, v: a + v * v))})
    # By dimension and length, so that a block's longest vector says much about all of it.
    rows = materialize(numbered(long, ["dim", "length", "vec_id", "x"], "row"), "vectors")
    widest = rows.agg(F.max("dim")).first()[0]
    if widest is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    mass = rows.select("dim", F.posexplode("x").alias("at", "v")).groupBy("dim", "at").agg(F.sum(F.col("v") * F.col("v")).alias("m"))
    order: dict[int, list[float]] = {}
    for r in mass.orderBy("dim", "at").collect():        # one number per dimension
        order.setdefault(r["dim"], []).append(r["m"])
    order = {dim: np.argsort(-np.asarray(m), kind="stable").tolist() for dim, m in order.items()}

    form = "dim int, block long, row array<long>, id array<long>, longest double, largest double, rest binary, columns array<binary>"

    def blocks(df, size, label):
        own = numbered(df.select("dim", "row", "vec_id", "x"), ["dim", "row"], "n")
        cut = own.withColumn("block", F.floor(F.col("n") / size)).drop("n")
        return materialize(cut.groupBy("dim", "block").applyInArrow(_vertical(order, group), form), label)

    stored = blocks(rows, block, "vector-blocks")
    asked = blocks(rows.filter("asks"), query_block, "query-blocks")
    heads = lambda df, name: df.select("dim", F.col("block").alias(name), F.col("longest").alias(f"{name}_longest"))
    packed = lambda df: F.struct(*[c for c in df.columns if c not in ("longest", "floors", "lowest")])

    def meet(pairs, asks):
        """The blocks of each pair (dim, q_block, v_block), by joins on the block numbers."""
        v = stored.select("dim", F.col("block").alias("v_block"), packed(stored).alias("v"))
        q = asks.select("dim", F.col("block").alias("q_block"), packed(asks).alias("q"), "floors")
        return pairs.join(q, ["dim", "q_block"]).join(v, ["dim", "v_block"]).select("v", "q", "floors").mapInArrow(_hits(k), HIT)

    # The seed: each query block meets the block of the longest vectors of its dimension.
    seeds = heads(stored, "v_block").groupBy("dim").agg(F.max_by("v_block", F.struct("v_block_longest", "v_block")).alias("v_block"))
    first = materialize(_first(meet(heads(asked, "q_block").join(seeds, "dim"), asked.withColumn("floors", F.lit(None).cast("array<double>"))), k), "seed-hits")
    floor = first.groupBy("query").agg(F.when(F.count("*") >= k, F.min("score")).alias("floor"))
    each = asked.select("dim", "block", F.posexplode("row").alias("at", "query")).join(floor, "query", "left").select(
        "dim", "block", "at", F.coalesce(F.col("floor").cast("double"), F.lit(float("-inf"))).alias("f"))
    floors = each.groupBy("dim", "block").agg(F.min("f").alias("lowest"), F.sort_array(F.collect_list(F.struct("at", "f")))["f"].alias("floors"))
    asked = materialize(asked.join(floors, ["dim", "block"]), "query-floors")

    # All pairs of block numbers that can matter, dealt out by a salt as one dimension may hold every block.
    salt = lambda c: F.pmod(F.col(c), F.lit(SALTS)).alias("salt")
    left = asked.select("dim", F.col("block").alias("q_block"), "longest", "lowest", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt"))
    right = heads(stored, "v_block").select("*", salt("v_block"))
    pairs = (left.join(right, ["dim", "salt"]).join(seeds.withColumn("seed", F.lit(True)), ["dim", "v_block"], "left")
             .filter(F.col("seed").isNull() & (F.col("longest") * F.col("v_block_longest") * SLACK >= F.col("lowest"))))
    found = meet(pairs.select("dim", "q_block", "v_block"), asked).unionByName(first.drop("rank"))
    return _first(found, k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


SQL = """WITH whole AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: floor(256 * x)) AS x FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.r, q.vec_id AS query_id, v.vec_id, CAST(list_dot_product(q.x, v.x) AS BIGINT) AS score
  FROM whole q JOIN whole v ON q.r <> v.r AND len(q.x) = len(v.x) WHERE q.vec_id % 50 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id NULLS LAST) AS rank FROM scored)
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score FROM ranked WHERE rank <= 5"""
