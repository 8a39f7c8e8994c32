"""Forests: sampling, determinism, scores against a plain walk, persistence, importance."""

import dataclasses
import datetime as dt
import math

import numpy as np
import pytest
from helpers import rows_of, same
from pyspark.sql import functions as F

from catalog.adapter import devices, fixes
from trackloom.config import DEFAULT
from trackloom.models import forest as Fr
from trackloom.models.scaler import fit_scaler
from trackloom.models.trees import mean_path
from trackloom.operators import labels as L
from trackloom.operators.features import build_features
from trackloom.plans import jobs
from trackloom.plans.permutation import permuted
from trackloom.plans.scratch import materialize, new_path
from trackloom.schema import FEATURES

WHEN = dt.datetime(2024, 2, 1, tzinfo=dt.timezone.utc)


@pytest.fixture(scope="module")
def rows(spark, sf_dir):
    wide = build_features(fixes(spark, sf_dir))
    return materialize(wide.select("id", "device_id", "ts", "lat", "lon", "alt", *FEATURES), "features")


@pytest.fixture(scope="module")
def model(rows):
    return Fr.fit_forest(rows, fit_scaler(rows, FEATURES), "a", n_trees=30, trained_at=WHEN)


def walk(nodes, row, psi):
    """Score of one scaled row by following every tree."""
    total, trees = 0.0, nodes["tree_id"].unique()
    for tree in trees:
        table = nodes[nodes.tree_id == tree].set_index("node_id")
        at = table.loc[0]
        while at.feature >= 0:
            at = table.loc[at.left if row[int(at.feature)] <= at.threshold else at.right]
        total += at.depth + float(mean_path(int(at.n)))
    return -2.0 ** (-total / len(trees) / float(mean_path(psi)))


def test_scores_equal_a_plain_walk(rows, model):
    some = Fr.score(rows.orderBy("id").limit(40), model).toPandas()
    nodes = model.nodes.toPandas()
    scaled = (some[FEATURES].to_numpy() - np.array(model.scaler.median)) / np.array(model.scaler.iqr)
    for x, found in zip(scaled, some["anomaly_score"]):
        assert found == pytest.approx(walk(nodes, x, model.psi), rel=1e-12)


def test_mean_path():
    assert [float(mean_path(n)) for n in (0, 1, 2)] == [0, 0, 1]
    assert float(mean_path(256)) == pytest.approx(2 * (math.log(255) + 0.5772156649) - 2 * 255 / 256, rel=1e-9)


def test_same_forest_for_any_layout(rows, model):
    again = Fr.fit_forest(rows.repartition(5, "lat"), model.scaler, "a", n_trees=30, trained_at=WHEN)
    same(model.nodes, again.nodes)


def test_trees_are_a_prefix_of_larger_forests(rows, model):
    larger = Fr.fit_forest(rows, model.scaler, "a", n_trees=45, trained_at=WHEN)
    same(model.nodes, larger.nodes.filter("tree_id < 30"))


@pytest.mark.parametrize("psi, trees", [(256, 20), (64, 3), (8, 2)])
def test_samples_are_distinct_and_full(rows, psi, trees):
    n = rows.count()
    drawn = Fr.draw_samples(rows.select("id"), n, psi, trees, 42).groupBy("tree_id").agg(
        F.count("id").alias("n"), F.count_distinct("id").alias("d")).collect()
    assert len(drawn) == trees and all(r["n"] == r["d"] == psi for r in drawn)


def test_score_range_and_rank(rows, model):
    low, high = Fr.score(rows, model).agg(F.min("anomaly_score"), F.max("anomaly_score")).first()
    assert -1 < low < high < 0


def test_planted_outlier_scores_lowest(spark):
    rng = np.random.default_rng(5)
    data = [(i, *map(float, rng.normal(size=2))) for i in range(400)] + [(999, 9.0, -9.0)]
    df = spark.createDataFrame(data, "id long, x double, y double")
    model = Fr.fit_forest(df, fit_scaler(df, ("x", "y")), n_trees=60)
    assert Fr.score(df, model).orderBy("anomaly_score").first()["id"] == 999


def test_save_load_delete(spark, rows, model):
    folder = new_path(spark, "models")
    other = dataclasses.replace(model, name="b/c", nodes=model.nodes.withColumn("model_name", F.lit("b/c")))
    Fr.save_model(model, folder)
    Fr.save_model(other, folder)
    Fr.save_model(Fr.with_threshold(model, -0.5), folder)  # replaces only itself
    loaded = Fr.load_models(spark, folder, ["a", "b/c", "missing"])
    assert set(loaded) == {"a", "b/c"} and loaded["a"].threshold == -0.5 and loaded["b/c"].threshold is None
    same(Fr.score(rows, model).select("id", "anomaly_score"),
         Fr.score(rows, loaded["a"]).select("id", "anomaly_score"))
    with pytest.raises(ValueError):
        Fr.load_model(spark, folder, "missing")
    Fr.delete_models(spark, folder, ["a"])
    assert [r[0] for r in Fr.stored_meta(spark, folder).select("model_name").collect()] == ["b/c"]


def test_many_models_way_equals_broadcast_way(spark, rows, model):
    folder = new_path(spark, "models")
    for name in ("a", "b"):
        trees = Fr.fit_forest(rows, model.scaler, name, n_trees=10, seed=len(name) + ord(name), trained_at=WHEN)
        Fr.save_model(trees, folder)
    named = rows.withColumn("model_name", F.when(F.col("device_id") < 5, "a").when(F.col("device_id") < 9, "b")
                            .when(F.col("device_id") < 11, "gone"))
    few = dataclasses.replace(DEFAULT, scoring_group_rows=37)
    by_join = Fr.score_by_stored_model(named, Fr.stored_nodes(spark, folder), Fr.stored_meta(spark, folder), cfg=few)
    by_broadcast = Fr.score_by_model(named, Fr.load_models(spark, folder, ["a", "b"]))
    columns = ["id", "model_name", "anomaly_score"]
    same(by_broadcast.select(*columns), by_join.select(*columns))


def test_score_batch_both_ways(spark, sf_dir, rows, model):
    folder = new_path(spark, "models")
    for name in ("model_3", "model_7"):
        trees = Fr.fit_forest(rows, model.scaler, name, n_trees=10, trained_at=WHEN)
        Fr.save_model(Fr.with_threshold(trees, -0.5), folder)
    known = devices(spark, sf_dir).withColumn("if_model", F.when(F.col("device_id") % 2 == 0, "model_3").otherwise("model_7"))
    track = fixes(spark, sf_dir)
    columns = ["id", "model_name", "anomaly_score", "anomaly"]
    many = dataclasses.replace(DEFAULT, broadcast_models=1)
    same(jobs.score_batch(track, known, folder).select(*columns),
         jobs.score_batch(track, known, folder, cfg=many).select(*columns))
    assert jobs.anomaly_count(jobs.score_batch(track, known, folder)).count() == track.select("device_id").distinct().count()


def test_importance(rows, model):
    found = {r["feature"]: r for r in Fr.feature_importance(rows, model, repeats=2).collect()}
    assert set(found) == set(FEATURES)
    constant = [c for c in FEATURES if rows.select(c).distinct().count() == 1]
    assert constant and all(found[c]["importance_mean"] == 0.0 for c in constant)
    assert max(r["importance_mean"] for r in found.values()) > 0


def test_permuted_scores_equal_plain_scoring(rows, model):
    values = rows.orderBy("id").select(*FEATURES).toPandas().to_numpy()
    own, donor, forest = values[:200], values[300:500], model.packed()
    plain, permuted = forest.permuted_scores(own, donor)
    assert plain == pytest.approx(forest.scores(own)[:, 0], rel=1e-12)
    for i in range(len(FEATURES)):
        mixed = own.copy()
        mixed[:, i] = donor[:, i]
        assert permuted[:, i] == pytest.approx(forest.scores(mixed)[:, 0], rel=1e-12)


def test_permutation_keeps_every_value(spark, rows, model):
    """With one feature deciding the score, the permuted scores are the same multiset: equal sums."""
    nodes = spark.createDataFrame([("k", 0, 0, 0, 0.5, 1, 2, 9, 0), ("k", 0, 1, -1, 0.0, -1, -1, 5, 1),
                                   ("k", 0, 2, -1, 0.0, -1, -1, 4, 1)], Fr.NODES)
    one = dataclasses.replace(model, nodes=nodes, n_trees=1)
    small = dataclasses.replace(DEFAULT, shuffle_block_rows=100)
    for r in Fr.permuted_scores(rows, one, 2, rows.count(), small).collect():
        assert r["permuted"] == pytest.approx(r["baseline"], rel=1e-9)


@pytest.mark.parametrize("n", [1, 2, 3, 7, 20, 97, 1000, 4099])
def test_permutation_is_one(spark, n):
    """Every place is taken once, and the numbers follow a plain loop."""
    def plain(row, repeat):
        a = math.isqrt(n - 1) + 1
        b = -(-n // a)
        while True:
            left, right = row % a, row // a
            for turn in range(6):
                key = (42 * 1299709 + repeat * 104729 + turn * 7919 + 1) % 2147483647
                shift = lambda v: (((v % 2147483647 * 48271 + key) % 2147483647) ** 2 + key) % 2147483647  # noqa: B023, E731
                left, right = ((left + shift(right)) % a, right) if turn % 2 == 0 else (left, (right + shift(left)) % b)
            row = right * a + left
            if row < n:
                return row

    found = spark.range(n).select("id", *[permuted(F.col("id"), n, 42, k).alias(f"p{k}") for k in (0, 1)]).collect()
    for r in found:
        assert [r["p0"], r["p1"]] == [plain(r["id"], 0), plain(r["id"], 1)]
    assert {r["p0"] for r in found} == {r["p1"] for r in found} == set(range(n))


def test_importance_does_not_depend_on_blocks_or_layout(rows, model):
    few = materialize(rows.orderBy("id").limit(120), "few")
    values = few.orderBy("id").select(*FEATURES).toPandas().to_numpy(dtype=float)
    to = [r[0] for r in few.sparkSession.range(120).orderBy("id").select(permuted(F.col("id"), 120, model.seed, 0)).collect()]
    donors = np.empty_like(values)
    donors[to] = values
    want = model.packed().permuted_scores(values, donors)[1].mean(axis=0)
    for size in (1, 7, 50_000):
        cfg = dataclasses.replace(DEFAULT, shuffle_block_rows=size)
        found = {r["feature"]: r["permuted"] for r in Fr.permuted_scores(few.repartition(3, "lat"), model, 1, 120, cfg).collect()}
        assert [found[c] for c in FEATURES] == pytest.approx(want.tolist(), rel=1e-12)


def test_candidates_are_independent_and_do_not_depend_on_the_number_of_trees(spark):
    """Hits per tree and pairs of hits, against their expectation; one block's trees and several blocks'."""
    n, rate = 20_000, 0.05
    rows = spark.range(n)
    few, many = (materialize(rows.withColumn("t", F.explode(Fr._candidate_trees(F.col("id"), k, rate, 3))), "c") for k in (10, 150))
    assert rows_of(few) == rows_of(many.filter("t < 10"))
    assert many.count() == many.distinct().count()
    per_tree = [r["count"] for r in many.groupBy("t").count().collect()]
    assert len(per_tree) == 150 and all(abs(c - n * rate) < 6 * math.sqrt(n * rate) for c in per_tree)
    pairs = few.alias("a").join(few.alias("b"), "id").filter("a.t < b.t").groupBy("a.t", "b.t").count().collect()
    assert len(pairs) == 45 and all(abs(r["count"] - n * rate ** 2) < 6 * math.sqrt(n * rate ** 2) for r in pairs)


def test_training_and_inference(spark, sf_dir):
    small = dataclasses.replace(DEFAULT, n_trees=20, importance_repeats=1)
    result = jobs.train(fixes(spark, sf_dir), "m", trained_at=WHEN, cfg=small)
    total = result.full.count()
    assert result.test.count() == total - int(total * 0.8)
    flagged = result.test_metrics.first()["n_anomalies"]
    assert 0 < flagged <= math.ceil(0.05 * result.test.count())
    assert result.test_metrics_filtered.first()["n_anomalies"] <= flagged
    assert result.importance.count() == 35
    kept = result.test.filter(L.is_anomaly()).count()
    assert (result.events.agg(F.sum("n_points")).first()[0] or 0) == kept
    again, _, metrics = jobs.infer(fixes(spark, sf_dir), result.model)
    assert metrics.first()["total_samples"] == total
    same(result.full.select("id", "anomaly_score", "anomaly"), again.select("id", "anomaly_score", "anomaly"))
    folder, out = new_path(spark, "models"), new_path(spark, "results")
    updated = jobs.save_training(result, folder, out, fixes(spark, sf_dir).withColumn("anomaly", F.lit(1)))
    assert updated.filter("anomaly = -1").count() == result.full.filter("anomaly = -1").count()
    assert spark.read.option("header", True).csv(out).columns == [
        "ts", "device_id", "lat", "lon", "alt", "speed_m_s", "anomaly_score", "anomaly"]


def test_too_little_data(spark, sf_dir):
    with pytest.raises(ValueError, match="100"):
        jobs.train(fixes(spark, sf_dir).filter("device_id = 1"))


def test_search_prefers_first_of_equals(spark, rows):
    from trackloom.plans.search import best_combination, hyperparameter_search

    few = dataclasses.replace(DEFAULT, search_trees=(5, 10), search_samples=("auto", 64))
    scores = hyperparameter_search(rows, fit_scaler(rows, FEATURES), cfg=few)
    assert scores.count() == 2 * 2 * 3
    best = best_combination(scores).first()
    top = scores.agg(F.max("score")).first()[0]
    assert best["score"] == top and best["contamination"] == 0.01
    assert rows_of(scores.groupBy("n_estimators", "max_samples").agg(F.count_distinct("score").alias("n")).select("n").distinct()) == [("1",)]
