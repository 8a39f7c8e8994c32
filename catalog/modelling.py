"""Isolation forests over the driver's tables. Growing trees is random, so most are rows-only;
the scorer itself is checked against SQL on a forest derived from the data."""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalog.adapter import FIXES_SQL, devices, fixes, ntz, rounded, with_sql
from catalog.motion_sql import r
from catalog.registry import query
from trackloom.config import DEFAULT
from trackloom.models import forest as Fr
from trackloom.models.scaler import Scaler, fit_scaler
from trackloom.operators import devices as D
from trackloom.operators import metrics as M
from trackloom.operators.features import build_features, clean_features
from trackloom.plans import jobs
from trackloom.plans.permutation import FACTOR, PRIME, ROUNDS
from trackloom.plans.scratch import materialize, new_path
from trackloom.plans.search import hyperparameter_search
from trackloom.plans.selection import quantiles
from trackloom.schema import FEATURES

WHEN = dt.datetime(2024, 2, 1, tzinfo=dt.timezone.utc)


def _features(spark, sf_dir):
    return materialize(clean_features(fixes(spark, sf_dir)).select("id", "device_id", "ts", "lat", "lon", "alt",
                                                                    *FEATURES), "features")


def _model(spark, sf_dir, name="model_a", rows=None):
    rows = _features(spark, sf_dir) if rows is None else rows
    return Fr.fit_forest(rows, fit_scaler(rows, FEATURES), name, trained_at=WHEN)


@query()
def grow_isolation_forest(spark, sf_dir):
    """Node table of a forest over all cleaned rows."""
    return _model(spark, sf_dir).nodes


@query()
def score_isolation_forest(spark, sf_dir):
    rows = _features(spark, sf_dir)
    return Fr.score(rows, _model(spark, sf_dir, rows=rows)).select("id", "anomaly_score")


# One split on value, a second on alt below it: a forest whose cut points are averages of the
# data, so that SQL can place every row in its leaf by comparison.
_DEPTH_TWO = """
, cut AS (SELECT avg(value) AS v, avg(alt) AS a FROM fixes),
leaf AS (
  SELECT id, CASE WHEN value <= v AND alt <= a THEN 2 WHEN value <= v THEN 3 ELSE 1 END AS leaf FROM fixes, cut),
sizes AS (SELECT leaf, count(*) AS n FROM leaf GROUP BY leaf),
paths AS (
  SELECT leaf, CASE WHEN leaf = 1 THEN 1 ELSE 2 END
         + CASE WHEN n <= 1 THEN 0 WHEN n = 2 THEN 1
                ELSE 2 * (ln(n - 1) + 0.5772156649015329::DOUBLE) - 2 * (n - 1) / n::DOUBLE END AS path FROM sizes)"""


@query(with_sql(FIXES_SQL, body=_DEPTH_TWO + f"""
SELECT id, {r('-pow(2, -path / (2 * (ln(255) + 0.5772156649015329::DOUBLE) - 2 * 255 / 256::DOUBLE))', 9)} AS anomaly_score
FROM leaf JOIN paths USING (leaf)"""))
def score_known_tree(spark, sf_dir):
    rows = fixes(spark, sf_dir).select("id", "value", "alt")
    return Fr.score(rows, _known_tree(rows)).select("id", rounded(F.col("anomaly_score"), 9).alias("anomaly_score"))


def _known_tree(rows):
    v, a = rows.agg(F.avg("value"), F.avg("alt")).first()
    low = F.col("value") <= v
    n = rows.agg(F.count(F.lit(1)), F.count_if(~low), F.count_if(low & (F.col("alt") <= a)),
                 F.count_if(low & (F.col("alt") > a))).first()
    nodes = [("known", 0, 0, 0, v, 1, 2, n[0], 0), ("known", 0, 1, 1, a, 3, 4, n[0] - n[1], 1),
             ("known", 0, 2, -1, 0.0, -1, -1, n[1], 1), ("known", 0, 3, -1, 0.0, -1, -1, n[2], 2),
             ("known", 0, 4, -1, 0.0, -1, -1, n[3], 2)]
    table = rows.sparkSession.createDataFrame(nodes, Fr.NODES)
    return Fr.Model("known", Scaler(("value", "alt"), (0.0, 0.0), (1.0, 1.0)), 256, 1, 0, WHEN, table)


def _network_sql(source: str) -> str:
    """One pass of the permutation's network over (repeat, row, v, n, a, b); the model's seed is 0."""
    text = f"SELECT repeat, row, n, a, b, v % a AS l, v // a AS r FROM ({source})"
    for turn in range(ROUNDS):
        key = f"((repeat * 104729 + {turn * 7919 + 1}) % {PRIME})"
        once = f"((@ % {PRIME} * {FACTOR} + {key}) % {PRIME})"
        mix = f"(({once} * {once} + {key}) % {PRIME})"
        moved = (f"(l + {mix.replace('@', 'r')}) % a AS l, r" if turn % 2 == 0
                 else f"l, (r + {mix.replace('@', 'l')}) % b AS r")
        text = f"SELECT repeat, row, n, a, b, {moved} FROM ({text})"
    return f"SELECT repeat, row, n, a, b, r * a + l AS v FROM ({text})"


@query("WITH RECURSIVE" + with_sql(FIXES_SQL, body=_DEPTH_TWO + f"""
, scores AS (
  SELECT leaf, -pow(2, -path / (2 * (ln(255) + 0.5772156649015329::DOUBLE) - 2 * 255 / 256::DOUBLE)) AS score FROM paths),
placed AS (SELECT row_number() OVER (ORDER BY id, value, alt) - 1 AS row, value, alt FROM fixes),
size AS (SELECT count(*) AS n, CAST(ceil(sqrt(count(*))) AS BIGINT) AS a FROM fixes),
grid AS (SELECT n, a, (n + a - 1) // a AS b FROM size),
walk AS (
  {_network_sql("SELECT t.repeat, row, row AS v, n, a, b FROM placed, grid, range(5) t(repeat)")}
  UNION ALL
  {_network_sql("SELECT * FROM walk WHERE v >= n")}),
met AS (
  SELECT w.repeat, o.value, o.alt, d.value AS new_value, d.alt AS new_alt
  FROM walk w JOIN placed o ON o.row = w.v JOIN placed d ON d.row = w.row WHERE w.v < w.n),
leaves AS (
  SELECT repeat, unnest(['value', 'alt']) AS feature,
         CASE WHEN value <= v AND alt <= a THEN 2 WHEN value <= v THEN 3 ELSE 1 END AS leaf,
         unnest([CASE WHEN new_value <= v AND alt <= a THEN 2 WHEN new_value <= v THEN 3 ELSE 1 END,
                 CASE WHEN value <= v AND new_alt <= a THEN 2 WHEN value <= v THEN 3 ELSE 1 END]) AS new_leaf
  FROM met, cut),
drops AS (
  SELECT feature, repeat, avg(p.score) - avg(q.score) AS importance
  FROM leaves JOIN scores p ON p.leaf = leaves.leaf JOIN scores q ON q.leaf = new_leaf GROUP BY feature, repeat)
SELECT feature, {r('avg(importance)', 9)} AS importance_mean, {r('stddev_pop(importance)', 9)} AS importance_std
FROM drops GROUP BY feature""").removeprefix("WITH"))
def importance_known_tree(spark, sf_dir):
    """Permutation importance under a forest derived from the data; SQL repeats the permutations."""
    rows = fixes(spark, sf_dir).select("id", "value", "alt")
    found = Fr.feature_importance(rows, _known_tree(rows))
    return found.select("feature", *[rounded(F.col(c), 9).alias(c) for c in ("importance_mean", "importance_std")])


@query()
def save_and_load_model(spark, sf_dir):
    folder = new_path(spark, "models")
    Fr.save_model(_model(spark, sf_dir), folder)
    loaded = Fr.load_model(spark, folder, "model_a")
    return loaded.nodes.groupBy("tree_id").agg(F.count(F.lit(1)).alias("n_nodes"), F.max("depth").alias("depth"))


@query()
def score_and_label(spark, sf_dir):
    rows = _features(spark, sf_dir)
    return jobs.label(materialize(Fr.score(rows, _model(spark, sf_dir, rows=rows)), "scores")).select(
        "id", "anomaly_score", "anomaly")


@query()
def feature_importance(spark, sf_dir):
    rows = _features(spark, sf_dir)
    return Fr.feature_importance(rows, _model(spark, sf_dir, rows=rows))


@query()
def top_features(spark, sf_dir):
    rows = _features(spark, sf_dir)
    ranked = Fr.feature_importance(rows, _model(spark, sf_dir, rows=rows))
    return M.top_features(ranked, 15)


@query()
def hyperparameter_grid(spark, sf_dir):
    rows = _features(spark, sf_dir)
    return hyperparameter_search(rows, fit_scaler(rows, FEATURES)).select(
        "combo_ord", "n_estimators", "max_samples", "contamination", "score")


@query()
def training_job(spark, sf_dir):
    """Labelled rows of a whole training run, after isolated anomalies went."""
    result = jobs.train(fixes(spark, sf_dir), "model_a", trained_at=WHEN)
    return result.full.select("id", "device_id", ntz(F.col("ts")).alias("ts"), "anomaly_score", "anomaly")


@query()
def training_metrics(spark, sf_dir):
    result = jobs.train(fixes(spark, sf_dir), "model_a", trained_at=WHEN)
    parts = [m.withColumn("rows", F.lit(name)) for name, m in (
        ("test", result.test_metrics), ("test_filtered", result.test_metrics_filtered),
        ("full", result.full_metrics))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query()
def inference_job(spark, sf_dir):
    """Events found in new data by a stored model."""
    folder = new_path(spark, "models")
    Fr.save_model(_model(spark, sf_dir), folder)
    _, events, _ = jobs.infer(fixes(spark, sf_dir), Fr.load_model(spark, folder, "model_a"))
    return events


def _model_folder(spark, sf_dir):
    """Every model that devices use, thresholds included; three forests are shared out by name."""
    folder, rows = new_path(spark, "models"), _features(spark, sf_dir)
    scaler = fit_scaler(rows, FEATURES)
    names = D.model_catalogue(devices(spark, sf_dir)).withColumn(
        "kind", F.pmod(F.xxhash64("model_name"), F.lit(3)).cast("int"))
    nodes, meta = [], []
    for kind in range(3):
        model = Fr.fit_forest(rows, scaler, f"kind_{kind}", seed=kind, trained_at=WHEN)
        scores = materialize(Fr.score(rows, model).select("anomaly_score"), "scores")
        model = Fr.with_threshold(model, quantiles(scores, {"anomaly_score": [DEFAULT.threshold_quantile]})["anomaly_score"][0])
        nodes.append(model.nodes.drop("model_name").withColumn("kind", F.lit(kind)))
        meta.append(model.meta().drop("model_name").withColumn("kind", F.lit(kind)))
    named = [reduce(DataFrame.unionByName, parts).join(names, "kind").drop("kind") for parts in (nodes, meta)]
    Fr.save_tables(named[0], named[1], folder)
    return folder


@query()
def score_devices_by_model(spark, sf_dir):
    """All devices in one pass, each with the model assigned to it."""
    done = jobs.score_batch(fixes(spark, sf_dir), devices(spark, sf_dir), _model_folder(spark, sf_dir))
    return done.select("id", "device_id", "model_name", "anomaly_score", "anomaly")


@query()
def train_and_assign(spark, sf_dir):
    """Device table after training on every active device and assigning the new model."""
    chosen = spark.createDataFrame([("All",)], "device_name string")
    _, updated, _ = jobs.train_and_assign(fixes(spark, sf_dir), devices(spark, sf_dir), chosen,
                                          "model_fresh", new_path(spark, "models"), DEFAULT)
    return updated


@query()
def retrain_on_recent(spark, sf_dir):
    """Forest refitted on the last 30 days of old and new rows together."""
    rows = materialize(build_features(fixes(spark, sf_dir, compressed=False)), "features")
    old = F.col("event_type") != "view"
    model = jobs.retrain(rows.filter(old), rows.filter(~old), "model_a")
    return model.nodes


