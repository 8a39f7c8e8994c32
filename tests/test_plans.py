"""The physical plans we rely on."""

import re

from catalog.adapter import fixes, scored_fixes
from trackloom.operators import labels as L
from trackloom.operators.features import build_features, clean_features
from trackloom.operators.motion import derive_motion
from trackloom.plans.scratch import new_path, scratch_dir
from trackloom.schema import FEATURES
from trackloom.sources.readers import device_fixes, pick_devices


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def exchanges(df) -> int:
    return len(re.findall(r"Exchange (hash|range|single)", plan(df)))


def test_features_need_one_exchange(spark, sf_dir):
    for job in (build_features, clean_features, derive_motion):
        text = plan(job(fixes(spark, sf_dir)))
        assert len(re.findall(r"Exchange hashpartitioning\(device_id", text)) == 1
        assert len(re.findall(r"\bExchange\b", text)) == 1
        assert len(re.findall(r"\bSort \[", text)) == 1


def test_labels_and_events_need_one_exchange(spark, sf_dir):
    rows = L.label(scored_fixes(spark, sf_dir), "fixed", -0.2)
    from pyspark.sql import functions as F

    rows = rows.withColumn("speed_m_s", F.lit(1.0))
    for job in (L.filter_isolated, L.anomaly_events, L.sliding_alerts):
        assert exchanges(job(rows)) == 1


def test_scan_is_pruned_and_filtered(spark, sf_dir):
    path = new_path(spark, "stored")
    build_features(fixes(spark, sf_dir)).write.parquet(path)
    text = plan(pick_devices(spark.read.parquet(path), device_ids=[1, 2]).select("id", "speed_m_s"))
    assert re.search(r"ReadSchema: struct<id:bigint,device_id:bigint,speed_m_s:double>", text)
    assert "PushedFilters: [In(device_id, [1,2])" in text


def test_mark_filter_is_pushed_down(spark, sf_dir):
    path = new_path(spark, "stored")
    fixes(spark, sf_dir).write.parquet(path)
    names = spark.createDataFrame([(3, "x")], "device_id long, device_name string")
    text = plan(device_fixes(spark.read.parquet(path), names, "x", after_id=100))
    assert "GreaterThan(id,100)" in text


def test_unused_features_cost_nothing(spark, sf_dir):
    text = plan(build_features(fixes(spark, sf_dir)).select("id", "dt"))
    assert "stddev_samp" not in text


def test_scratch_folder_is_the_sessions(spark):
    named = spark.conf.get("spark.checkpoint.dir", None)
    assert named is None or scratch_dir(spark) == named


def test_all_features_are_doubles(spark, sf_dir):
    kinds = dict(build_features(fixes(spark, sf_dir)).dtypes)
    assert {kinds[c] for c in FEATURES} == {"double"}
