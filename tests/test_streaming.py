"""A stream must say what the batch says."""

import time

import pytest
from helpers import same
from pyspark.sql import Window
from pyspark.sql import functions as F

from catalog.adapter import devices, fixes
from trackloom.models import forest as Fr
from trackloom.models.scaler import fit_scaler
from trackloom.operators.features import build_features
from trackloom.operators.labels import anomaly_events
from trackloom.plans import jobs
from trackloom.plans.scratch import new_path
from trackloom.schema import FEATURES
from trackloom.streaming.monitor import current_events, current_labels, fix_stream, start_monitor
from trackloom.streaming.segments import TrackStore, current_features, start_features


def feed(df, number, parts):
    """Folder with one file per value of ``number``, in order."""
    spark, folder = df.sparkSession, new_path(df.sparkSession, "feed")
    marked = df.withColumn("_part", number).cache()
    for i in range(parts):
        marked.filter(F.col("_part") == i).drop("_part").coalesce(1).write.mode("append").parquet(folder)
        time.sleep(1.1)
    return fix_stream(spark, folder, df.schema, files_per_trigger=1)


@pytest.fixture(scope="module")
def track(spark, sf_dir):
    return fixes(spark, sf_dir).select("id", "device_id", "ts", "lat", "lon", "alt").cache()


def streamed_features(feed, spark):
    out = new_path(spark, "features")
    start_features(feed, out, new_path(spark, "mark")).awaitTermination(600)
    return current_features(spark, out)


@pytest.mark.parametrize("parts", [1, 4])
def test_features_equal_batch_for_any_cut(spark, track, parts):
    number = F.ntile(parts).over(Window.partitionBy("device_id").orderBy("ts", "id")) - 1
    streamed = streamed_features(feed(track, number, parts), spark)
    assert streamed.filter("late").count() == 0
    columns = ["id", "hover_run", *FEATURES]
    same(build_features(track).select(*columns), streamed.select(*columns))


def test_disorder_is_repaired(spark, track):
    """Fixes are dealt over the files by chance, whatever their time."""
    streamed = streamed_features(feed(track, F.pmod(F.hash("id"), F.lit(3)), 3), spark)
    assert streamed.filter("late").count() > 100
    columns = ["id", "hover_run", *FEATURES]
    same(build_features(track).select(*columns), streamed.select(*columns))


@pytest.fixture(scope="module")
def models(spark, track):
    """Two models of which one has no threshold, and one name that is not stored."""
    rows = build_features(track).select("id", *FEATURES)
    folder = new_path(spark, "models")
    model = Fr.fit_forest(rows, fit_scaler(rows, FEATURES), "m", n_trees=10)
    Fr.save_model(Fr.with_threshold(model, -0.5), folder)
    Fr.save_model(Fr.with_threshold(Fr.fit_forest(rows, model.scaler, "bare", n_trees=2), None), folder)
    return folder


def watch(spark, known, folder, source, out, mark):
    start_monitor(source, lambda: known, folder, out, mark, once=True, store=TrackStore(out, segment_seconds=3600, compact_every=2)).awaitTermination(900)


def test_monitor_over_batches_late_devices_and_bad_models(spark, sf_dir, track, models):
    """Fixes in any order over several batches, one device wholly late, models that cannot be used: labels and events
    are the batch job's, and the rest is listed. A second start goes on where the first stopped."""
    ids = track.select("device_id").distinct().orderBy("device_id").limit(12).select("device_id")
    mine = track.join(ids, "device_id", "left_semi").withColumn("alt", F.when(F.col("id") % 23 != 0, F.col("alt"))).cache()
    low, high = (r["device_id"] for r in (ids.orderBy("device_id").first(), ids.orderBy(F.desc("device_id")).first()))
    name = F.when(F.col("device_id") == low, "bare").when(F.col("device_id") == high, "gone").otherwise("m")
    known = devices(spark, sf_dir).withColumn("if_model", name)
    number = F.when(F.col("device_id") % 5 == 0, 2).otherwise(F.pmod(F.hash("id"), F.lit(2)))
    out, mark, folder = new_path(spark, "monitor"), new_path(spark, "mark"), new_path(spark, "feed")
    marked = mine.withColumn("_part", number).cache()
    for part in (0, 1, 2):                     # a new start of the query for each file
        marked.filter(F.col("_part") == part).drop("_part").coalesce(1).write.mode("append").parquet(folder)
        watch(spark, known, models, fix_stream(spark, folder, mine.schema), out, mark)
    good = known.filter("if_model = 'm'")
    batch = jobs.score_batch(mine, good, models)
    same(batch.select("id", "anomaly"), current_labels(spark, out))
    assert batch.filter("anomaly = -1").count() > 5
    want = anomaly_events(batch).select("device_id", "start_time", "end_time", "n_points", "mean_lat", "mean_speed", "mean_score", "duration_seconds")
    same(want, current_events(spark, out).select(*want.columns))
    skipped = {(r.device_id, r.reason): r["count"] for r in spark.read.parquet(f"{out}/skipped").groupBy("device_id", "reason").count().collect()}
    sizes = {r.device_id: r["count"] for r in mine.groupBy("device_id").count().collect()}
    assert skipped == {(low, "model without threshold"): sizes[low], (high, "model not stored"): sizes[high]}
    counters = spark.read.parquet(f"{out}/counters")
    assert counters.count() == 3 and counters.agg(F.sum("n_rows")).first()[0] == batch.count()


def test_monitor_equals_batch(spark, sf_dir, track, models):
    known = devices(spark, sf_dir).withColumn("if_model", F.when(F.col("device_id") < 12, "m"))
    out = new_path(spark, "monitor")
    start_monitor(feed(track, F.lit(0), 1), lambda: known, models, out, new_path(spark, "mark"),
                  once=True).awaitTermination(300)
    batch = jobs.score_batch(track, known.filter("if_model = 'm'"), models)
    columns = ["id", "anomaly_score", "anomaly"]
    labels = spark.read.parquet(f"{out}/labels")
    same(batch.select(*columns), labels.select(*columns))
    counters = spark.read.parquet(f"{out}/counters")
    assert counters.agg(F.sum("n_rows")).first()[0] == labels.count()
    assert spark.read.parquet(f"{out}/late").count() == 0
