"""Labels over micro-batches equal the batch job's, and other faults that once slipped through."""

import dataclasses
import datetime as dt

import numpy as np
import pytest
from helpers import START, fixes, rows_of, scored
from pyspark.sql import functions as F

from trackloom.config import DEFAULT
from trackloom.functions.scalars import monday_zero_weekday, parse_utc, utc_hour
from trackloom.models import forest as Fr
from trackloom.models.scaler import Scaler
from trackloom.operators import labels as L
from trackloom.operators.metrics import density_histogram
from trackloom.plans import jobs
from trackloom.plans.scratch import exists, materialize, new_path, scope
from trackloom.sources.writers import apply_labels, latest_labels
from trackloom.streaming.intervals import IntervalStore, add_points, events, judged
from trackloom.streaming.segments import TrackStore


@pytest.mark.parametrize("slices, size", [(1, 2), (4, 2), (4, 4)])
def test_context_over_slices_equals_batch(spark, slices, size):
    """Slices in turned order: what a slice judges is corrected by the next."""
    cfg = dataclasses.replace(DEFAULT, min_event_size=size)
    rng = np.random.default_rng(7)
    rows = [(i, int(rng.integers(1, 5)), 60 * i, -1.0, int(rng.choice([-1, 1], p=[0.12, 0.88]))) for i in range(400)]
    store = TrackStore(new_path(spark, "context"), segment_seconds=3600)
    intervals, out, seen = IntervalStore(store, cfg), [], []
    for k in range(slices):
        part = [r for r in rows if r[0] * slices // 400 == (k * 3 + 1) % slices]
        seen += part
        segments = materialize(scored(spark, part).select("device_id", store.segment(F.col("ts")).alias("segment")).distinct(), "touched")
        raw = scored(spark, seen).withColumn("segment", store.segment(F.col("ts"))).join(segments, ["device_id", "segment"], "left_semi")
        isolated, turned = judged(intervals, raw.filter("anomaly = -1"), segments, k)
        labels = raw.join(isolated, "id", "left").select("id", F.when(F.col("_alone"), 1).otherwise(F.col("anomaly")).alias("anomaly"))
        out.append(materialize(labels.unionByName(turned.select("id", "anomaly")).withColumn("batch_id", F.lit(k)), "labels"))
    history = out[0]
    for df in out[1:]:
        history = history.unionByName(df)
    frame = scored(spark, rows)
    want = L.filter_isolated(frame, cfg=cfg).select("id", "anomaly")
    assert rows_of(latest_labels(history)) == rows_of(want)
    found = L.anomaly_events(frame.filter("anomaly = -1"), cfg=cfg).select("device_id", "event_id", "start_time", "end_time", "n_points")
    assert rows_of(found) == rows_of(events(intervals.current(spark), cfg=cfg).select(*found.columns))


def test_a_new_anomaly_joins_bridges_or_opens_intervals(spark):
    """Only touched segments are read and written, whatever the order."""
    rows = [(i, 1, t, -1.0, -1) for i, t in enumerate([0, 1500, 90_000, 750, 200_000, 90_500, 86_300, 86_500])]
    store = TrackStore(new_path(spark, "events"), segment_seconds=86_400)
    intervals = IntervalStore(store)
    for k, row in enumerate(rows):
        add_points(intervals, scored(spark, [row]), k)
    want = L.anomaly_events(scored(spark, rows), min_size=1)
    got = events(intervals.current(spark), min_size=1).select(*want.columns)
    assert rows_of(want) == rows_of(got) and got.count() == 5 - 1
    last = spark.read.parquet(store.path("intervals", len(rows) - 1))
    assert last.select("segment").distinct().count() == 1


def test_every_tree_has_its_rows(spark):
    rows = spark.range(3000).select("id")
    for psi in (2, 4, 256, 100_000):
        counts = Fr.draw_samples(rows, 3000, psi, 50, 1).groupBy("tree_id").agg(F.count_distinct("id").alias("n"), F.count("*").alias("m")).collect()
        assert len(counts) == 50 and all(r.n == r.m == min(psi, 3000) for r in counts)


def test_retrained_models_have_a_threshold_and_bare_ones_are_refused(spark):
    rng = np.random.default_rng(0)
    rows = spark.createDataFrame([(i, START + dt.timedelta(seconds=i), float(x), float(y)) for i, (x, y) in enumerate(rng.normal(size=(300, 2)))],
                                 "id long, ts timestamp, a double, b double")
    model = jobs.retrain(rows.filter("id < 200"), rows.filter("id >= 200"), "m", ["a", "b"])
    hits = Fr.score(rows, model).filter(F.col("anomaly_score") < model.threshold).count()
    assert hits == 15
    folder = new_path(spark, "models")
    Fr.save_model(Fr.with_threshold(model, None), folder)
    devices = spark.createDataFrame([(1, "m")], "device_id long, if_model string")
    with pytest.raises(ValueError, match="threshold"):
        jobs.label_batch(fixes(spark, [(1, 1, 0, 0.0, 0.0, 0.0)]), devices, folder)


def test_nulls_fill_no_bin(spark):
    rows = [(1, float(v)) for v in range(10)] + [(1, None), (1, float("nan")), (-1, None)]
    out = density_histogram(spark.createDataFrame(rows, "anomaly int, x double"), ["x"]).collect()
    assert {r.anomaly for r in out} == {1}
    width = 9 / len(out)
    assert abs(sum(r.density for r in out) * width - 1) < 1e-9 and max(r.density for r in out) < 0.2 / width


def test_the_last_of_several_labels_counts(spark):
    facts = spark.createDataFrame([(1, 1), (2, 1), (3, -1)], "id long, anomaly int")
    labels = spark.createDataFrame([(1, 1, 0), (1, -1, 2), (1, 1, 1), (None, -1, 1)], "id long, anomaly int, batch_id int")
    assert sorted(map(tuple, apply_labels(facts, labels).collect())) == [(1, -1), (2, 1), (3, -1)]


def test_null_scores_do_not_move_a_device_quantile(spark):
    rows = [(i, 1, i, -float(i), 1) for i in range(21)] + [(100 + i, 1, i, None, 1) for i in range(30)]
    cut = L.device_quantiles(scored(spark, rows), 0.05).first()["threshold"]
    assert cut == pytest.approx(-19.0)


def test_times_are_utc_in_any_session(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    try:
        texts = ["2024-03-03 23:59:00", "2024-03-03T23:59:00Z", "2024-03-04 01:59:00+02:00", "2024-03-03 23:59:00+0000", "2024-03-04", "junk"]
        frame = spark.createDataFrame([(t,) for t in texts], "t string").select(parse_utc(F.col("t")).alias("ts"))
        got = [(r[0], r[1], r[2]) for r in frame.select(F.unix_seconds("ts"), utc_hour(F.col("ts")), monday_zero_weekday(F.col("ts"))).collect()]
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    at = int(START.timestamp())
    assert got == [(at, 23, 6)] * 4 + [(at + 60, 0, 0), (None, None, None)]


def test_a_scope_deletes_its_tables(spark):
    with scope(spark):
        path = new_path(spark, "gone")
        spark.range(3).write.parquet(path)
        assert exists(spark, path)
    assert not exists(spark, path)
