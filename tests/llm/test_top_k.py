import math
import random

import numpy as np
from pyspark.sql import functions as F

from trackloom.llm import top_k as T


def plain(rows, k, every=50):
    whole = []
    for i, x in rows:
        if x and all(v is not None and math.isfinite(v) for v in x):
            whole.append((i, [math.floor(256 * v) for v in x]))
    out = []
    for q, (i, x) in enumerate(whole):
        if i is None or i % every:
            continue
        scores = [(-sum(a * b for a, b in zip(x, y)), j is None, j or 0) for p, (j, y) in enumerate(whole) if p != q and len(x) == len(y)]
        out += [(i, r, None if null else j, -s) for r, (s, null, j) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


def found(spark, rows, k, **how):
    df = spark.createDataFrame([(i, x, 1, 2.0) for i, x in rows], "vec_id long, embedding array<double>, rank int, score double")
    got = T.top_k(df, F.col("vec_id") % 50 == 0, k, **how).select("query_id", "rank", "vec_id", "score").collect()
    return sorted((tuple(r) for r in got), key=str)


def test_odd_vectors_ties_and_repeats(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (50, [0.5, 0.5]), (1, [0.5, 0.5]), (2, [0.5, 0.5]), (3, [0.9, 0.1]), (None, [0.9, 0.1]), (4, [-0.001, 0.0]),
            (5, None), (6, []), (7, [nan, 1.0]), (8, [inf, 1.0]), (9, [None, 1.0]), (100, [1.0, 2.0, 3.0]), (11, [3.0, 2.0, 1.0]), (150, [0.0, 0.0])]
    for k in (1, 3, 20):
        assert found(spark, rows, k) == plain(rows, k)
    assert found(spark, [], 3) == [] and found(spark, [(5, None)], 3) == []


def test_blocks_bounds_and_lengths(spark):
    """Small blocks and groups, lengths that differ by thousands, one vector that many rows repeat."""
    rng = np.random.default_rng(7)
    rows = [(i, (rng.normal(size=12) * rng.choice([0.01, 1, 30])).tolist()) for i in range(300)]
    rows += [(1000 + i, rows[5][1]) for i in range(120)]
    random.Random(1).shuffle(rows)
    assert found(spark, rows, 5, block=32, query_block=3, group=3) == plain(rows, 5)


def test_sums_beyond_doubles(spark):
    rows = [(i, [3e5 + i / 256, 2e6 + 1 / 256, -1e5 * i]) for i in range(60)] + [(100, [2.0**20 + 1 / 256] * 3), (101, [2.0**20 + 3 / 256] * 3)]
    assert found(spark, rows, 4) == plain(rows, 4)


def test_bounds_remove_candidates(spark):
    """With one heavy group of dimensions, most candidates go before the last group."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=(500, 8)) * ([100.0] * 4 + [0.01] * 4)
    block = lambda rows, ids: T.Block({"dim": 8, "row": rows, "id": ids, "largest": 1.0,
        "rest": np.stack([np.linalg.norm(x[ids][:, s:], axis=1) for s in (4, 8)]).tobytes(), "columns": [x[ids][:, s:s + 4].T.copy().tobytes() for s in (0, 4)]})
    seen = []
    vectors, queries = block(list(range(500)), list(range(500))), block([0], [0])

    class Watched(np.ndarray):
        def __getitem__(self, at):
            if isinstance(at, tuple) and len(at) == 2 and isinstance(at[1], np.ndarray):
                seen.append(len(at[1]))
            return np.ndarray.__getitem__(self, at)

    vectors.columns = [c.view(Watched) for c in vectors.columns]
    (q, at, score), = T.search(vectors, queries, np.array([-np.inf]), 5)
    assert sorted(at.tolist()) == sorted(np.argsort(-np.r_[-np.inf, (x[1:] @ x[0])])[:5].tolist())
    assert seen and seen[-1] < 50
