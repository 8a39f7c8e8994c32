"""One device with most of the rows: cut pieces must give exactly the uncut result."""

import pytest
from helpers import CUT, crowd, same
from pyspark.sql import functions as F

from catalog.adapter import fixes, scored_fixes
from trackloom.operators import devices as D
from trackloom.operators import labels as L
from trackloom.operators import split as Sp
from trackloom.operators.clean import clean, quality_report
from trackloom.operators.features import build_features, clean_features
from trackloom.operators.motion import derive_motion
from trackloom.plans.ordered import cut_hot_devices, is_cut
from trackloom.schema import FEATURES


@pytest.fixture(scope="module")
def track(spark, sf_dir):
    return crowd(scored_fixes(spark, sf_dir)).cache()


@pytest.fixture(scope="module")
def labelled(track):
    return L.label(track.withColumn("speed_m_s", F.col("value")), "fixed", -0.15).cache()


def test_only_hot_devices_are_cut(track):
    cut = cut_hot_devices(track, CUT)
    assert is_cut(cut) and not is_cut(cut_hot_devices(track))
    sizes = cut.groupBy("_piece").count().collect()
    assert len(sizes) > 3
    assert cut.count() == track.count()


@pytest.mark.parametrize("job", [clean, clean_features, build_features, derive_motion])
def test_windows(job, track):
    columns = [c for c in job(track).columns if c in {"id", "hover_run", "cumulative_distance", "bearing", "dt", *FEATURES}]
    same(job(track).select(*columns), job(track, CUT).select(*columns))


def test_quality_report(track):
    same(quality_report(track), quality_report(track, CUT))


@pytest.mark.parametrize("size", [2, 4])
def test_isolated(labelled, size):
    same(L.filter_isolated(labelled, min_size=size), L.filter_isolated(labelled, min_size=size, cfg=CUT))
    same(L.small_event_members(labelled, min_size=size), L.small_event_members(labelled, min_size=size, cfg=CUT))
    same(L.anomaly_events(labelled, min_size=size), L.anomaly_events(labelled, min_size=size, cfg=CUT))


@pytest.mark.parametrize("mode", ["fixed", "window_local"])
def test_alerts(labelled, mode):
    same(L.sliding_alerts(labelled, mode, q=0.35), L.sliding_alerts(labelled, mode, q=0.35, cfg=CUT))


@pytest.mark.parametrize("mode", ["batch_quantile", "per_device_quantile"])
def test_labels(track, mode):
    same(L.label(track, mode), L.label(track, mode, cfg=CUT))


@pytest.mark.parametrize("order", list(Sp.ORDERS))
def test_split_and_folds(track, order):
    same(Sp.add_split(track, order=order), Sp.add_split(track, order=order, cfg=CUT))
    same(Sp.add_fold_block(track, order=order), Sp.add_fold_block(track, order=order, cfg=CUT))


def test_polylines_continue_over_segments(labelled):
    def points(lines):
        at = F.posexplode("points").alias("i", "p")
        return (lines.select("device_id", "segment", at)
                .select("device_id", "p.*"))
    short, long = D.polylines(labelled, cfg=CUT), D.polylines(labelled)
    same(points(long), points(short))
    assert short.agg(F.max(F.size("points"))).first()[0] <= CUT.polyline_points
    assert short.agg(F.max("segment")).first()[0] > 10
    assert long.agg(F.max("segment")).first()[0] == 0


def test_one_event_over_many_pieces(spark, sf_dir):
    rows = crowd(fixes(spark, sf_dir)).withColumns({
        "anomaly": F.lit(-1), "anomaly_score": F.col("value"), "speed_m_s": F.col("value")})
    same(L.anomaly_events(rows, gap_seconds=1e9), L.anomaly_events(rows, gap_seconds=1e9, cfg=CUT))
    same(L.filter_isolated(rows, gap_seconds=1e9), L.filter_isolated(rows, gap_seconds=1e9, cfg=CUT))
