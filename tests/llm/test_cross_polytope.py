import numpy as np

from trackloom.llm import cross_polytope as C
from trackloom.llm import queries


def brute(rows, k, asked):
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows], dtype=np.float64)
    out = {}
    for i, v in rows:
        if not asked(i):
            continue
        score = (x * np.array(v, np.float64)).sum(axis=1)
        order = [j for j in np.lexsort((ids, -score)) if ids[j] != i][:k]
        out[i] = [(int(ids[j]), float(score[j])) for j in order]
    return out


def taken(frame):
    out = {}
    for r in sorted(frame.collect(), key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(out[r.query_id])
    return out


def test_query_recall(spark):
    sf = "/root/testdata/sf0.01"
    got = taken(queries.op7_cross_polytope(spark, sf))
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    want = brute(rows, 20, lambda i: i % 20 == 0)
    assert got.keys() == want.keys()
    hits = [len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / len(want[q]) for q in want]
    assert np.mean(hits) >= 0.9
    vectors = {i: np.array(v, np.float64) for i, v in rows}
    for q, found in got.items():
        assert all(abs(s - vectors[q] @ vectors[i]) < 1e-12 for i, s in found)
        assert found == sorted(found, key=lambda f: (-f[1], f[0]))


def test_all_probes_and_small_blocks_are_exact(spark):
    rng = np.random.default_rng(1)
    rows = [(int(i), (rng.standard_normal(5) * rng.uniform(0.5, 3)).tolist()) for i in range(80)]
    rows += [(i, rows[3][1]) for i in range(100, 140)]          # one common vector
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    rows = [(r.vec_id, r.embedding) for r in frame.collect()]
    got = taken(C.neighbours(frame, frame.filter("vec_id % 4 = 0"), k=7, tables=3, probes=99, block=8, query_block=3))
    want = brute(rows, 7, lambda i: i % 4 == 0)
    assert {q: [i for i, _ in f] for q, f in got.items()} == {q: [i for i, _ in f] for q, f in want.items()}


def test_odd_vectors(spark):
    rows = [(1, [1.0, 0.0], 1), (2, [0.5, 0.5], 1), (2, [0.5, 0.5], 1), (3, None, 1), (4, [0.0, 0.0], 1), (5, [None, 1.0], 1), (6, [float("nan"), 1.0], 1),
            (7, [float("inf"), 1.0], 1), (8, [1.0], 1), (None, [1.0, 1.0], 1), (9, [], 1)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score int")
    got = taken(C.neighbours(frame, frame, k=5, probes=99))
    assert {q: [i for i, _ in f] for q, f in got.items()} == {1: [2], 2: [1]}
    assert C.neighbours(frame.limit(0), frame.limit(0)).count() == 0


def recall(spark, rows, few=C.FEW):
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = taken(C.neighbours(frame, frame.filter("vec_id % 20 = 0"), k=20, few=few))
    want = brute(rows, 20, lambda i: i % 20 == 0)
    assert got.keys() == want.keys() and all(len(got[q]) == len(want[q]) for q in want)
    return np.mean([len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / len(want[q]) for q in want])


def embeddings(spark):
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").orderBy("vec_id").collect()
    return [r.vec_id for r in rows], np.array([r.embedding for r in rows], np.float64)


def test_recall_with_one_long_vector_and_mixed_lengths(spark):
    ids, x = embeddings(spark)
    mixed = np.random.default_rng(3).lognormal(0, 0.5, len(x))
    one = {f: np.where(np.arange(len(x)) == 7, f, 1.0) for f in (3, 1000)}
    for size in (one[3], one[1000], mixed):
        found = recall(spark, list(zip(ids, (x * size[:, None]).tolist())))
        print("recall", found)
        assert found >= 0.9


def test_small_tables_and_few_probes_give_all_rows(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((60, 64))
    for n in (15, 21, 41):
        assert recall(spark, [(i, x[i].tolist()) for i in range(n)]) == 1
    frame = spark.createDataFrame([(i, (v * (1 if i % 3 else 9)).tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    rows = [(r.vec_id, r.embedding) for r in frame.collect()]
    got = taken(C.neighbours(frame, frame, k=15, tables=1, probes=1, few=0))     # hashed ranges, hardly probed
    want = brute(rows, 15, lambda i: True)
    assert {q: [i for i, _ in f] for q, f in got.items()} == {q: [i for i, _ in f] for q, f in want.items()}
