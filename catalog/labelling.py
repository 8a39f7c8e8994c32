"""Labels, events, alerts, devices and summaries, on a score that SQL can reproduce."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from catalog.adapter import (DEVICES_SQL, FIXES_SQL, MODELS_SQL, SCORED_SQL, devices, fixes, models, ntz,
                             read, rounded, scored_fixes, with_sql)
from catalog.motion_sql import EVENTS, features, r, stepped
from catalog.registry import query
from trackloom.config import DEFAULT
from trackloom.operators import devices as D
from trackloom.operators import labels as L
from trackloom.operators import metrics as M
from trackloom.operators import split as Sp
from trackloom.operators.clean import steps
from trackloom.operators.features import build_features
from trackloom.models.scaler import fit_scaler, scale_statistics
from trackloom.plans.ordered import forget_pieces
from trackloom.plans.scratch import materialize, new_path
from trackloom.plans.search import best_combination
from trackloom.plans.selection import quantile
from trackloom.sources import writers as Wr
from trackloom.schema import FEATURES

LABELLED_SQL = SCORED_SQL + """,
labelled AS (
  SELECT *, CASE WHEN anomaly_score < (SELECT quantile_cont(anomaly_score, 0.05) FROM scored)
            THEN -1 ELSE 1 END AS anomaly FROM scored)"""

STEPPED_LABELLED_SQL = SCORED_SQL + "," + stepped("scored").strip("\n") + """,
labelled AS (
  SELECT *, CASE WHEN anomaly_score < (SELECT quantile_cont(anomaly_score, 0.05) FROM scored)
            THEN -1 ELSE 1 END AS anomaly FROM stepped)"""


def labelled(spark, sf_dir):
    return L.label(scored_fixes(spark, sf_dir))


def labelled_steps(spark, sf_dir):
    return L.label(steps(scored_fixes(spark, sf_dir)))


# ---- thresholds and labels -----------------------------------------------------------------

@query(with_sql(SCORED_SQL, body=f"""
SELECT {r('quantile_cont(anomaly_score, 0.05)', 9)} AS threshold FROM scored"""))
def score_threshold(spark, sf_dir):
    scores = scored_fixes(spark, sf_dir)
    return scores.agg(F.count("*")).select(rounded(quantile(scores, "anomaly_score", 0.05), 9).alias("threshold"))


@query(with_sql(LABELLED_SQL, body="SELECT id, anomaly FROM labelled"))
def label_batch_quantile(spark, sf_dir):
    return labelled(spark, sf_dir).select("id", "anomaly")


@query(with_sql(SCORED_SQL, body="""
SELECT id, CASE WHEN anomaly_score < -0.25 THEN -1 ELSE 1 END AS anomaly FROM scored"""))
def label_fixed_threshold(spark, sf_dir):
    return L.label(scored_fixes(spark, sf_dir), "fixed", -0.25).select("id", "anomaly")


@query(with_sql(SCORED_SQL, body="""
, cuts AS (SELECT device_id, quantile_cont(anomaly_score, 0.05) AS cut FROM scored GROUP BY device_id)
SELECT id, CASE WHEN anomaly_score < cut THEN -1 ELSE 1 END AS anomaly FROM scored JOIN cuts USING (device_id)"""))
def label_per_device_quantile(spark, sf_dir):
    return L.label(scored_fixes(spark, sf_dir), "per_device_quantile").select("id", "anomaly")


@query(with_sql(LABELLED_SQL, body="SELECT anomaly, count(*) AS n_rows FROM labelled GROUP BY anomaly"))
def label_split(spark, sf_dir):
    rows = labelled(spark, sf_dir)
    normal, bad = rows.filter(F.col("anomaly") == 1), rows.filter(L.is_anomaly())
    return normal.unionByName(bad).groupBy("anomaly").agg(F.count(F.lit(1)).alias("n_rows"))


@query(with_sql(LABELLED_SQL, EVENTS, body=f"""
SELECT id, device_id, CAST(event_id AS BIGINT) AS event_id,
       {r('(epoch_us(ts) - epoch_us(previous)) / 1e6')} AS time_gap FROM numbered"""))
def event_numbers(spark, sf_dir):
    rows = L.with_event_ids(labelled(spark, sf_dir)).filter(L.is_anomaly())
    return rows.select("id", "device_id", "event_id", rounded(F.col("time_gap")).alias("time_gap"))


@query(with_sql(LABELLED_SQL, EVENTS, body="""
SELECT l.id, CASE WHEN l.anomaly = -1 AND s.event_size < 2 THEN 1 ELSE l.anomaly END AS anomaly
FROM labelled l LEFT JOIN sized s ON l.id = s.id"""))
def filter_isolated(spark, sf_dir):
    return L.filter_isolated(labelled(spark, sf_dir)).select("id", "anomaly")


@query(with_sql(LABELLED_SQL, EVENTS, body="SELECT id, device_id, event_size FROM sized WHERE event_size < 2"))
def small_event_anomalies(spark, sf_dir):
    return L.small_event_members(labelled(spark, sf_dir)).select("id", "device_id", "event_size")


@query(with_sql(LABELLED_SQL, EVENTS, body="""
SELECT DISTINCT device_id, CAST(event_id AS BIGINT) AS event_id, event_size FROM sized"""))
def event_sizes(spark, sf_dir):
    rows = L.with_event_sizes(L.with_event_ids(labelled(spark, sf_dir)).filter(L.is_anomaly()))
    return forget_pieces(rows).select("device_id", "event_id", "event_size").distinct()


def _events_sql(least: int) -> str:
    return with_sql(STEPPED_LABELLED_SQL, EVENTS, body=f"""
SELECT device_id, CAST(event_id AS BIGINT) AS event_id, min(ts) AS start_time, max(ts) AS end_time,
       count(*) AS n_points, {r('avg(lat)', 10)} AS mean_lat, {r('avg(lon)', 10)} AS mean_lon,
       {r('avg(speed_m_s)')} AS mean_speed, {r('avg(anomaly_score)', 10)} AS mean_score,
       {r('(epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6')} AS duration_seconds
FROM numbered GROUP BY device_id, event_id HAVING count(*) >= {least}""")


def _events(df):
    return df.select("device_id", "event_id", ntz(F.col("start_time")).alias("start_time"),
                     ntz(F.col("end_time")).alias("end_time"), "n_points",
                     rounded(F.col("mean_lat"), 10).alias("mean_lat"),
                     rounded(F.col("mean_lon"), 10).alias("mean_lon"),
                     rounded(F.col("mean_speed")).alias("mean_speed"),
                     rounded(F.col("mean_score"), 10).alias("mean_score"),
                     rounded(F.col("duration_seconds")).alias("duration_seconds"))


@query(_events_sql(2))
def anomaly_events(spark, sf_dir):
    return _events(L.anomaly_events(labelled_steps(spark, sf_dir)))


@query(_events_sql(1))
def anomaly_events_of_any_size(spark, sf_dir):
    return _events(L.anomaly_events(labelled_steps(spark, sf_dir), min_size=1))


_TEN = "(PARTITION BY device_id ORDER BY ts, id ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING)"


def _alerts(df):
    return df.select("device_id", "id", ntz(F.col("timestamp")).alias("timestamp"),
                     ntz(F.col("window_start")).alias("window_start"), "n_anomalies",
                     rounded(F.col("mean_score"), 10).alias("mean_score"), "min_score")


@query(with_sql(SCORED_SQL, body=f"""
, framed AS (
  SELECT *, count(*) OVER {_TEN} AS filled, first_value(ts) OVER {_TEN} AS window_start,
         count(*) FILTER (WHERE anomaly_score < -0.15) OVER {_TEN} AS n_anomalies,
         avg(anomaly_score) OVER {_TEN} AS mean_score, min(anomaly_score) OVER {_TEN} AS min_score FROM scored)
SELECT device_id, id, ts AS timestamp, window_start, n_anomalies, {r('mean_score', 10)} AS mean_score, min_score
FROM framed WHERE filled = 10 AND n_anomalies >= 3"""))
def sliding_window_alerts(spark, sf_dir):
    return _alerts(L.sliding_alerts(L.label(scored_fixes(spark, sf_dir), threshold=-0.15)))


@query(with_sql(SCORED_SQL, body=f"""
, framed AS (
  SELECT *, count(*) OVER {_TEN} AS filled, first_value(ts) OVER {_TEN} AS window_start,
         list(anomaly_score) OVER {_TEN} AS scores,
         avg(anomaly_score) OVER {_TEN} AS mean_score, min(anomaly_score) OVER {_TEN} AS min_score FROM scored),
cut AS (SELECT *, list_sort(scores) AS s FROM framed WHERE filled = 10),
counted AS (
  SELECT *, CAST(len(list_filter(s, lambda x: x < s[4] + (s[5] - s[4]) * (0.35::DOUBLE * 9 - 3))) AS BIGINT) AS n_anomalies
  FROM cut)
SELECT device_id, id, ts AS timestamp, window_start, n_anomalies, {r('mean_score', 10)} AS mean_score, min_score
FROM counted WHERE n_anomalies >= 3"""))
def sliding_window_alerts_local(spark, sf_dir):
    return _alerts(L.sliding_alerts(labelled(spark, sf_dir), mode="window_local", q=0.35))


# ---- metrics and summaries -----------------------------------------------------------------

_METRICS = f"""
SELECT count(*) AS total_samples, count(*) FILTER (WHERE anomaly = -1) AS n_anomalies,
       {r('count(*) FILTER (WHERE anomaly = -1) / count(*)', 8)} AS anomaly_rate,
       {r('avg(anomaly_score)', 9)} AS score_mean, {r('stddev_pop(anomaly_score)', 9)} AS score_std,
       min(anomaly_score) AS score_min, max(anomaly_score) AS score_max,
       {r('avg(anomaly_score) FILTER (WHERE anomaly = -1)', 9)} AS anomaly_score_mean,
       {r('avg(anomaly_score) FILTER (WHERE anomaly = 1)', 9)} AS normal_score_mean FROM labelled"""


@query(with_sql(LABELLED_SQL, body=_METRICS))
def evaluation_metrics(spark, sf_dir):
    df = M.evaluate(labelled(spark, sf_dir))
    exact = ("total_samples", "n_anomalies", "score_min", "score_max")
    places = {"anomaly_rate": 8}
    return df.select(*[F.col(c) if c in exact else rounded(F.col(c), places.get(c, 9)).alias(c)
                       for c in df.columns])


@query(with_sql(LABELLED_SQL, body="SELECT max(anomaly_score) FILTER (WHERE anomaly = -1) AS cut_line FROM labelled"))
def score_cut_line(spark, sf_dir):
    return M.score_cut_line(labelled(spark, sf_dir))


@query(with_sql(FIXES_SQL, body="SELECT device_id, count(*) AS n_rows FROM fixes GROUP BY device_id"))
def rows_per_device(spark, sf_dir):
    return M.rows_per_device(fixes(spark, sf_dir))


@query(with_sql(FIXES_SQL, body="SELECT count(DISTINCT device_id) AS n_devices FROM fixes"))
def distinct_devices(spark, sf_dir):
    return M.distinct_devices(fixes(spark, sf_dir))


@query(with_sql(LABELLED_SQL, body="""
SELECT device_id, anomaly, count(*) AS n_rows FROM labelled GROUP BY device_id, anomaly"""))
def labels_per_device(spark, sf_dir):
    return M.labels_per_device(labelled(spark, sf_dir))


@query(with_sql(FIXES_SQL, body=f"SELECT {r('avg(lat)', 8)} AS centre_lat, {r('avg(lon)', 8)} AS centre_lon FROM fixes"))
def map_centre(spark, sf_dir):
    df = M.map_centre(fixes(spark, sf_dir))
    return df.select(*[rounded(F.col(c), 8).alias(c) for c in df.columns])


@query(with_sql(FIXES_SQL, body="SELECT device_id, max(id) AS last_id FROM fixes GROUP BY device_id"))
def high_water_marks(spark, sf_dir):
    return M.high_water_marks(fixes(spark, sf_dir))


@query(with_sql(LABELLED_SQL, body="""
SELECT CAST(floor(lat / 0.001::DOUBLE) AS BIGINT) AS lat_cell, CAST(floor(lon / 0.001::DOUBLE) AS BIGINT) AS lon_cell,
       count(*) AS n_points FROM labelled WHERE anomaly = -1 GROUP BY 1, 2"""))
def anomaly_heat(spark, sf_dir):
    return M.anomaly_heat(labelled(spark, sf_dir))


HISTOGRAM = tuple(M.HISTOGRAM_FEATURES)


@query(with_sql(SCORED_SQL, stepped("scored"), features("stepped"), body=f"""
, labelled AS (SELECT *, CASE WHEN anomaly_score < (SELECT quantile_cont(anomaly_score, 0.05) FROM scored)
                         THEN -1 ELSE 1 END AS anomaly FROM featured),
long AS ({' UNION ALL '.join(f"SELECT anomaly, '{c}' AS feature, CAST({c} AS DOUBLE) AS value FROM labelled" for c in HISTOGRAM)}),
ranges AS (SELECT feature, anomaly, min(value) AS lo, max(value) AS hi, count(*) AS total,
                  CASE WHEN anomaly = -1 THEN 30 ELSE 50 END AS bins FROM long GROUP BY feature, anomaly),
counted AS (SELECT l.feature, l.anomaly, least(floor((value - lo) / (hi - lo) * bins), bins - 1) AS bin, count(*) AS n
            FROM long l JOIN ranges g ON l.feature = g.feature AND l.anomaly = g.anomaly GROUP BY 1, 2, 3),
every AS (SELECT *, unnest(range(0, bins)) AS bin FROM ranges)
SELECT e.feature, e.anomaly, CAST(e.bin AS INT) AS bin, {r('lo + e.bin * ((hi - lo) / bins)')} AS bin_start,
       {r('coalesce(n, 0) / (total * ((hi - lo) / bins))')} AS density
FROM every e LEFT JOIN counted c ON e.feature = c.feature AND e.anomaly = c.anomaly AND e.bin = c.bin"""))
def density_histogram(spark, sf_dir):
    rows = L.label(build_features(scored_fixes(spark, sf_dir)))
    df = M.density_histogram(rows)
    return df.select("feature", "anomaly", "bin", rounded(F.col("bin_start")).alias("bin_start"),
                     rounded(F.col("density")).alias("density"))


@query("""
SELECT CAST(sum(n) AS BIGINT) AS total_processed, CAST(sum(bad) AS BIGINT) AS anomalies_detected, max(last) AS last_check
FROM (SELECT event_type, count(*) AS n, count(*) FILTER (WHERE value > 150) AS bad, max(ts) AS last
      FROM events GROUP BY event_type)""")
def monitoring_totals(spark, sf_dir):
    batches = fixes(spark, sf_dir, compressed=False).groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("value") > 150).alias("n_anomalies"),
        F.max("ts").alias("checked_at"))
    return M.monitoring_totals(batches).withColumn("last_check", ntz(F.col("last_check")))


@query(with_sql(FIXES_SQL, body=f"""
SELECT event_type AS feature, {r('avg(value)', 8)} AS importance_mean, {r('stddev_pop(value)', 8)} AS importance_std
FROM fixes GROUP BY event_type"""))
def repeat_statistics(spark, sf_dir):
    repeats = fixes(spark, sf_dir).select(F.col("event_type").alias("feature"), F.col("value").alias("importance"))
    df = M.repeat_statistics(repeats)
    return df.select("feature", *[rounded(F.col(c), 8).alias(c) for c in df.columns if c != "feature"])


@query(with_sql(FIXES_SQL, body=f"""
SELECT CAST(device_id AS VARCHAR) AS feature, {r('avg(value)', 8)} AS importance_mean FROM fixes
GROUP BY device_id ORDER BY avg(value) DESC, feature LIMIT 10"""))
def top_ten(spark, sf_dir):
    ranked = fixes(spark, sf_dir).groupBy(F.col("device_id").cast("string").alias("feature")).agg(
        F.avg("value").alias("importance_mean"))
    return M.top_features(ranked, 10).select(
        "feature", rounded(F.col("importance_mean"), 8).alias("importance_mean"))


# ---- retraining ----------------------------------------------------------------------------

NOW = dt.datetime(2024, 1, 20, 12, 0, 0, tzinfo=dt.timezone.utc)


@query(with_sql(DEVICES_SQL, body="""
, trained AS (SELECT 'model_' || n_nationkey AS model_name,
                     TIMESTAMP '2024-01-10 00:00:00' + INTERVAL 1 DAY * n_nationkey AS trained_at FROM nation),
used AS (SELECT d.if_model AS model_name, e.ts FROM events e JOIN devices d ON e.user_id = d.device_id
         WHERE d.if_model LIKE 'model_%'),
fresh AS (SELECT t.model_name, count(*) FILTER (WHERE ts > trained_at) AS n_new
          FROM used JOIN trained t ON used.model_name = t.model_name GROUP BY t.model_name),
signals AS (SELECT t.model_name,
       CAST(floor((epoch_us(TIMESTAMP '2024-01-20 12:00:00') - epoch_us(trained_at)) / 86400000000) AS BIGINT) AS age_days,
       coalesce(n_new, 0) AS n_new FROM trained t LEFT JOIN fresh f ON t.model_name = f.model_name)
SELECT *, (age_days >= 7 OR n_new >= 500) AS retrain FROM signals"""))
def should_retrain(spark, sf_dir):
    trained = read(spark, sf_dir, "nation").select(
        F.format_string("model_%d", F.col("n_nationkey")).alias("model_name"),
        (F.timestamp_micros(F.lit(1_704_844_800_000_000) + F.col("n_nationkey").cast("long")
                            * F.lit(86_400_000_000))).alias("trained_at"))
    used = D.with_model(fixes(spark, sf_dir, compressed=False), devices(spark, sf_dir))
    return M.should_retrain(trained, used.filter(F.col("model_name").isNotNull()).select("model_name", "ts"), NOW)


# ---- split, folds, scaling -----------------------------------------------------------------

_RANKED = "row_number() OVER (ORDER BY {o}) - 1 AS rn, count(*) OVER () AS n"


def _split_sql(order: str) -> str:
    return with_sql(FIXES_SQL, body=f"""
SELECT id, CASE WHEN rn < floor(n * (1 - 0.2::DOUBLE)) THEN 'train' ELSE 'test' END AS split
FROM (SELECT id, {_RANKED.format(o=order)} FROM fixes)""")


@query(_split_sql("ts, id"))
def time_split(spark, sf_dir):
    return Sp.add_split(fixes(spark, sf_dir)).select("id", "split")


@query(_split_sql("device_id, ts, id"))
def device_time_split(spark, sf_dir):
    return Sp.add_split(fixes(spark, sf_dir), order="device_time").select("id", "split")


@query(with_sql(FIXES_SQL, body=f"""
SELECT split, count(*) AS n_rows, min(ts) AS first_ts, max(ts) AS last_ts FROM (
  SELECT ts, CASE WHEN rn < floor(n * (1 - 0.2::DOUBLE)) THEN 'train' ELSE 'test' END AS split
  FROM (SELECT ts, {_RANKED.format(o='ts, id')} FROM fixes)) GROUP BY split"""))
def split_ranges(spark, sf_dir):
    df = Sp.split_ranges(Sp.add_split(fixes(spark, sf_dir)))
    return df.select("split", "n_rows", ntz(F.col("first_ts")).alias("first_ts"), ntz(F.col("last_ts")).alias("last_ts"))


@query(with_sql(FIXES_SQL, body=f"""
, blocks AS (
  SELECT id, greatest(0, 3 - CAST(floor((n - 1 - rn) / (n // 4)) AS BIGINT)) AS block
  FROM (SELECT id, {_RANKED.format(o='ts, id')} FROM fixes))
SELECT f.fold, id, CASE WHEN block = f.fold THEN 'validate' ELSE 'train' END AS role
FROM blocks JOIN (VALUES (1), (2), (3)) AS f(fold) ON block <= f.fold"""))
def time_series_folds(spark, sf_dir):
    members = Sp.fold_members(Sp.add_fold_block(fixes(spark, sf_dir).select("id", "ts")))
    return members.select("fold", "id", "role")


_SCALE_FEATURES = tuple(FEATURES)


@query(with_sql(FIXES_SQL, stepped("fixes"), features("stepped"), body=" UNION ALL ".join(f"""
SELECT '{c}' AS feature, {r(f'median({c})')} AS median,
       {r(f'CASE WHEN quantile_cont({c}, 0.75) > quantile_cont({c}, 0.25) THEN quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) ELSE 1 END')} AS iqr
FROM (SELECT CAST({c} AS DOUBLE) AS {c} FROM featured)""" for c in _SCALE_FEATURES)))
def scale_statistics_by_feature(spark, sf_dir):
    rows = materialize(build_features(fixes(spark, sf_dir)).select(*_SCALE_FEATURES), "features")
    df = scale_statistics(rows, _SCALE_FEATURES)
    return df.select("feature", rounded(F.col("median")).alias("median"), rounded(F.col("iqr")).alias("iqr"))


_SCALED = tuple(FEATURES)


@query(with_sql(FIXES_SQL, stepped("fixes"), features("stepped"), body="""
, s AS (SELECT """ + ", ".join(f"""median(CAST({c} AS DOUBLE)) AS m{i},
               quantile_cont(CAST({c} AS DOUBLE), 0.75) - quantile_cont(CAST({c} AS DOUBLE), 0.25) AS q{i}"""
                               for i, c in enumerate(_SCALED)) + """ FROM featured)
SELECT id, """ + ", ".join(r(f"(CAST({c} AS DOUBLE) - m{i}) / CASE WHEN q{i} > 0 THEN q{i} ELSE 1 END") + f" AS {c}"
                           for i, c in enumerate(_SCALED)) + " FROM featured, s"))
def robust_scaling(spark, sf_dir):
    rows = materialize(build_features(fixes(spark, sf_dir)).select("id", *_SCALED), "features")
    scaled = fit_scaler(rows, _SCALED).transform(rows)
    return scaled.select("id", *[rounded(F.col(c)).alias(c) for c in _SCALED])


@query(with_sql(FIXES_SQL, body=f"""
SELECT CAST(device_id AS BIGINT) AS combo_ord, {r('max(value)', 8)} AS score FROM fixes
GROUP BY device_id ORDER BY score DESC, combo_ord LIMIT 1"""))
def best_grid_entry(spark, sf_dir):
    scores = fixes(spark, sf_dir).groupBy(F.col("device_id").alias("combo_ord")).agg(
        rounded(F.max("value"), 8).alias("score"))
    return best_combination(scores)


# ---- devices -------------------------------------------------------------------------------

@query(with_sql(DEVICES_SQL, body="SELECT * FROM devices WHERE status = 'Active'"))
def active_devices(spark, sf_dir):
    return D.active(devices(spark, sf_dir))


@query(with_sql(FIXES_SQL, DEVICES_SQL, body="""
SELECT f.id, f.device_id, device_name, status, color_1, color_2, if_model
FROM fixes f JOIN devices d ON f.device_id = d.device_id"""))
def fixes_with_device_settings(spark, sf_dir):
    return D.with_device(fixes(spark, sf_dir).select("id", "device_id"), devices(spark, sf_dir)).select(
        "id", "device_id", "device_name", "status", "color_1", "color_2", "if_model")


@query(with_sql(FIXES_SQL, DEVICES_SQL, body="""
SELECT f.id, f.device_id, CASE WHEN if_model <> '' THEN if_model END AS model_name
FROM fixes f LEFT JOIN devices d ON f.device_id = d.device_id"""))
def fixes_with_model(spark, sf_dir):
    return D.with_model(fixes(spark, sf_dir).select("id", "device_id"), devices(spark, sf_dir)).select(
        "id", "device_id", "model_name")


@query(with_sql(DEVICES_SQL, MODELS_SQL, body="""
SELECT device_id, device_name, if_model FROM devices
WHERE if_model IS NULL OR if_model NOT IN (SELECT model_name FROM models)"""))
def devices_without_model(spark, sf_dir):
    return D.devices_without_model(devices(spark, sf_dir), models(spark, sf_dir)).select(
        "device_id", "device_name", "if_model")


@query(with_sql(DEVICES_SQL, MODELS_SQL, body="""
SELECT model_name FROM models WHERE model_name NOT IN (SELECT if_model FROM devices WHERE if_model <> '')"""))
def orphan_models(spark, sf_dir):
    return D.orphan_models(models(spark, sf_dir), devices(spark, sf_dir))


@query(with_sql(DEVICES_SQL, body="""
SELECT device_name, CASE WHEN if_model <> '' THEN if_model ELSE 'none' END AS model FROM devices"""))
def model_assignments(spark, sf_dir):
    return D.assignments(devices(spark, sf_dir))


@query(with_sql(DEVICES_SQL, body="SELECT DISTINCT if_model AS model_name FROM devices WHERE if_model <> ''"))
def model_catalogue(spark, sf_dir):
    return D.model_catalogue(devices(spark, sf_dir))


def _selection(spark, sf_dir, with_all: bool):
    """Names picked by a user: one per nation's first customer, twice, perhaps with 'All'."""
    names = read(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.min("c_name").alias("device_name"))
    picked = names.select("device_name").unionByName(names.select("device_name"))
    if not with_all:
        return picked
    every = read(spark, sf_dir, "region").select(F.lit(D.ALL).alias("device_name"))
    return picked.unionByName(every)


_PICKED = "picked AS (SELECT min(c_name) AS device_name FROM customer GROUP BY c_nationkey)"


@query(with_sql(DEVICES_SQL, _PICKED, body="""
SELECT device_name FROM picked UNION SELECT device_name FROM devices WHERE status = 'Active'"""))
def device_selection_with_all(spark, sf_dir):
    return D.add_all_devices(_selection(spark, sf_dir, True), devices(spark, sf_dir))


@query(with_sql(DEVICES_SQL, _PICKED, body="SELECT device_name FROM picked"))
def device_selection_named_wins(spark, sf_dir):
    return D.expand_selection(_selection(spark, sf_dir, True), devices(spark, sf_dir))


@query(with_sql(FIXES_SQL, DEVICES_SQL, _PICKED, body="""
SELECT count(*) AS n_rows FROM fixes WHERE device_id IN (
  SELECT device_id FROM devices WHERE device_name IN (SELECT device_name FROM picked))"""))
def selected_row_count(spark, sf_dir):
    return D.row_count(fixes(spark, sf_dir), devices(spark, sf_dir), _selection(spark, sf_dir, False))


@query(with_sql(DEVICES_SQL, body="""
, new AS (SELECT c_name AS device_name, 'model_new' AS if_model FROM customer WHERE c_mktsegment = 'FURNITURE'
          UNION ALL SELECT s_name, 'model_new' FROM supplier)
SELECT device_id, coalesce(d.device_name, n.device_name) AS device_name, status, color_1, color_2,
       coalesce(n.if_model, d.if_model) AS if_model
FROM devices d FULL OUTER JOIN new n ON d.device_name = n.device_name"""))
def upsert_device_models(spark, sf_dir):
    known = read(spark, sf_dir, "customer").filter(F.col("c_mktsegment") == "FURNITURE").select(
        F.col("c_name").alias("device_name"))
    fresh = read(spark, sf_dir, "supplier").select(F.col("s_name").alias("device_name"))
    new = known.unionByName(fresh).withColumn("if_model", F.lit("model_new"))
    return D.assign_model(devices(spark, sf_dir), new)


@query(with_sql(DEVICES_SQL, _PICKED, body="""
SELECT device_id, device_name, status, color_1, color_2,
       CASE WHEN status = 'Active' OR device_name IN (SELECT device_name FROM picked)
            THEN 'model_bulk' ELSE if_model END AS if_model FROM devices"""))
def bulk_model_assignment(spark, sf_dir):
    return D.assign_to_selection(devices(spark, sf_dir), _selection(spark, sf_dir, True), "model_bulk")


@query(with_sql(FIXES_SQL, body="""
SELECT id, device_id, CASE WHEN event_type = 'error' THEN -1 WHEN event_type = 'view' THEN 1 ELSE 1 END AS anomaly
FROM fixes"""))
def upsert_labels(spark, sf_dir):
    df = fixes(spark, sf_dir)
    table = df.select("id", "device_id", F.when(F.col("event_type") == "view", -1).otherwise(1).alias("anomaly"))
    new = df.filter(F.col("event_type").isin("error", "view")).select(
        "id", F.when(F.col("event_type") == "error", -1).otherwise(1).alias("anomaly"))
    return Wr.apply_labels(table, new)


@query(with_sql(FIXES_SQL, body="""
SELECT -1 - id AS id, -1 AS anomaly FROM fixes WHERE event_type = 'error'"""))
def unknown_label_ids(spark, sf_dir):
    df = fixes(spark, sf_dir).filter(F.col("event_type") == "error")
    known = df.select("id", F.lit(-1).alias("anomaly"))
    strange = df.select((F.lit(-1) - F.col("id")).alias("id"), F.lit(-1).alias("anomaly"))
    return Wr.unknown_labels(fixes(spark, sf_dir), known.unionByName(strange))


@query("""
SELECT event_id AS id, CAST(ts AS DATE) AS day, CASE WHEN event_type = 'error' THEN -1 ELSE 1 END AS anomaly FROM events""")
def rewrite_labelled_days(spark, sf_dir):
    path = new_path(spark, "labelled-table")
    df = fixes(spark, sf_dir, compressed=False).withColumn("day", F.to_date("ts"))
    df.select("id", "day", F.lit(1).alias("anomaly")).write.partitionBy("day").parquet(path)
    new = df.filter(F.col("event_type") == "error").select("day", "id", F.lit(-1).alias("anomaly"))
    Wr.rewrite_labelled_days(path, new)
    return spark.read.parquet(path).select("id", "day", "anomaly")


@query(with_sql(STEPPED_LABELLED_SQL, body=f"""
SELECT device_id, ts, {r('lat', 9)} AS lat, {r('lon', 9)} AS lon, {r('alt', 9)} AS alt, {r('speed_m_s')} AS speed_m_s,
       anomaly_score, anomaly FROM labelled"""))
def result_projection(spark, sf_dir):
    path = new_path(spark, "results")
    Wr.write_results(labelled_steps(spark, sf_dir), path, "parquet")
    return spark.read.parquet(path).select(
        "device_id", ntz(F.col("ts")).alias("ts"), *[rounded(F.col(c), 9).alias(c) for c in ("lat", "lon", "alt")],
        rounded(F.col("speed_m_s")).alias("speed_m_s"), "anomaly_score", "anomaly")


# ---- displays ------------------------------------------------------------------------------

@query(with_sql(LABELLED_SQL, body=f"""
SELECT device_id, CAST(row_number() OVER (PARTITION BY device_id ORDER BY ts, id) AS BIGINT) AS place,
       ts, {r('lat', 9)} AS lat, {r('lon', 9)} AS lon, anomaly FROM labelled"""))
def polyline_points(spark, sf_dir):
    lines = D.polylines(labelled(spark, sf_dir))
    points = lines.select("device_id", "segment", F.posexplode("points").alias("at", "p"))
    place = F.col("segment") * F.lit(DEFAULT.polyline_points) + F.col("at") + 1
    return points.select("device_id", place.cast("long").alias("place"), ntz(F.col("p.ts")).alias("ts"),
                         rounded(F.col("p.lat"), 9).alias("lat"), rounded(F.col("p.lon"), 9).alias("lon"),
                         F.col("p.anomaly").alias("anomaly"))


@query(with_sql(FIXES_SQL, body=f"""
SELECT device_id, ts, {r('lat', 9)} AS lat, {r('lon', 9)} AS lon FROM (
  SELECT *, row_number() OVER (PARTITION BY device_id ORDER BY ts DESC, id DESC) AS k FROM fixes) WHERE k = 1"""))
def last_seen(spark, sf_dir):
    df = D.last_seen(fixes(spark, sf_dir))
    return df.select("device_id", ntz(F.col("ts")).alias("ts"), rounded(F.col("lat"), 9).alias("lat"),
                     rounded(F.col("lon"), 9).alias("lon"))


@query(with_sql(FIXES_SQL, DEVICES_SQL, body=f"""
SELECT f.device_id, 'Device ' || device_name || ' Last seen Latitude: ' || CAST(alt AS VARCHAR)
       || ', Longitude: ' || CAST(value AS VARCHAR) AS message FROM (
  SELECT *, row_number() OVER (PARTITION BY device_id ORDER BY ts DESC, id DESC) AS k FROM fixes) f
JOIN devices d ON f.device_id = d.device_id WHERE k = 1"""))
def last_seen_messages(spark, sf_dir):
    # Altitude and value stand in for the position: both engines print them alike.
    shown = fixes(spark, sf_dir).select("id", "device_id", "ts", F.col("alt").alias("lat"), F.col("value").alias("lon"))
    return D.last_seen_messages(shown, devices(spark, sf_dir))


@query(with_sql(LABELLED_SQL, DEVICES_SQL, body="""
SELECT l.id, l.device_id, CASE WHEN anomaly = -1 THEN 'red' ELSE color_1 END AS color,
       CASE WHEN anomaly = -1 THEN 'red' ELSE color_2 END AS fill_color,
       CASE WHEN anomaly = -1 THEN 160 ELSE 5 END AS radius,
       'Latitude: ' || CAST(alt AS VARCHAR) || ' longitude: ' || CAST(value AS VARCHAR) AS message
FROM labelled l JOIN devices d ON l.device_id = d.device_id"""))
def plot_markers(spark, sf_dir):
    shown = labelled(spark, sf_dir).select("id", "device_id", "anomaly", F.col("alt").alias("lat"),
                                           F.col("value").alias("lon"))
    return D.markers(shown, devices(spark, sf_dir)).drop("lat", "lon")


@query(with_sql(LABELLED_SQL, body="""
SELECT id, device_id, printf('Anomaly<br>Time: %s<br>Speed: %.2f m/s<br>Score: %.4f',
       strftime(ts, '%Y-%m-%d %H:%M:%S') || '+00:00', value / 7, -ln(1 + value)) AS message
FROM labelled WHERE anomaly = -1"""))
def anomaly_messages(spark, sf_dir):
    # A logarithm is shown as the score: decimals that end on a tie are printed differently.
    rows = labelled(spark, sf_dir).withColumns({"speed_m_s": F.col("value") / 7,
                                                "anomaly_score": -F.log1p("value")})
    return D.anomaly_messages(rows)


