"""Edge cases of cleaning, features, labels and events."""

import math

import pytest
from helpers import fixes, rows_of, scored
from pyspark.sql import functions as F

from trackloom.functions.geo import bearing_deg, haversine_m
from trackloom.functions.scalars import monday_zero_weekday, parse_utc
from trackloom.operators import labels as L
from trackloom.operators.clean import clean, require_columns, require_rows
from trackloom.operators.features import build_features
from trackloom.operators.metrics import evaluate
from trackloom.models.scaler import fit_scaler
from trackloom.schema import FEATURES


def test_feature_order():
    assert len(FEATURES) == 35
    assert FEATURES[:7] == ["dt", "distance_m", "speed_m_s", "vertical_speed", "acceleration_abs",
                            "speed_change_abs", "alt_change_abs"]
    assert FEATURES[7:14] == ["acc_mean_3", "acc_std_3", "speed_mean_3", "speed_std_3", "vert_speed_mean_3",
                              "vert_speed_std_3", "distance_sum_3"]
    assert FEATURES[-7:] == ["speed_zscore", "hover_flag", "burst_flag", "hour_norm", "day_of_week_norm",
                             "log_speed", "log_distance"]


def test_single_fix_has_zero_motion(spark):
    row = build_features(fixes(spark, [(1, 1, 0, 10.0, 20.0, 5.0)])).first()
    timed = {"hour_norm", "day_of_week_norm"}
    assert all(row[c] == 0.0 for c in FEATURES if c not in timed)


def test_equal_times_do_not_divide(spark):
    df = build_features(fixes(spark, [(1, 1, 0, 0.0, 0.0, 0.0), (2, 1, 0, 0.1, 0.0, 9.0)]))
    second = df.filter("id = 2").first()
    assert second["distance_m"] > 11_000 and second["speed_m_s"] == second["vertical_speed"] == 0.0


def test_devices_do_not_leak(spark):
    df = build_features(fixes(spark, [(1, 1, 0, 0.0, 0.0, 0.0), (2, 2, 60, 50.0, 50.0, 0.0),
                                      (3, 1, 120, 0.0, 0.0, 0.0)]))
    assert {r["id"]: r["distance_m"] for r in df.collect()} == {1: 0.0, 2: 0.0, 3: 0.0}


def test_hover_counts_position_times_interval(spark):
    rows = [(i, 1, 100 * i, 0.0, 0.0, 0.0) for i in range(9)]
    df = build_features(fixes(spark, rows)).orderBy("id").collect()
    assert [r["hover_run"] for r in df] == list(range(1, 10))
    assert [r["hover_flag"] for r in df] == [0.0] * 6 + [1.0] * 3  # 7 * 100 s is the first over 600


def test_clean_order_and_bounds(spark):
    rows = [(1, 1, 0, 0.0, 0.0, 1.0), (2, 1, 10, None, 0.0, 1.0), (3, 1, 20, 90.0001, 0.0, 1.0),
            (4, 1, 30, 0.0001, 0.0, 1.0), (5, 1, 30.5, 0.0001, 0.0, 1.0), (6, 1, 40, 9.0, 0.0, 1.0),
            (7, 1, 50, 9.0001, 0.0, 1.0)]
    kept = {r["id"]: r["dt"] for r in clean(fixes(spark, rows)).collect()}
    # 1 is the first fix, 2 lacks a latitude, 3 is out of bounds, 5 came too soon, 6 is too fast.
    assert kept == {4: 30.0, 7: 10.0}


def test_required(spark):
    with pytest.raises(ValueError, match="alt"):
        require_columns(fixes(spark, []).drop("alt"))
    with pytest.raises(ValueError):
        require_rows(fixes(spark, []), 1)


def test_geometry(spark):
    df = spark.createDataFrame([(0.0, 0.0, 0.0, 180.0), (12.3, 45.6, 12.3, 45.6), (0.0, 0.0, 1.0, -1.0),
                                (0.0, 0.0, None, 1.0)], "a double, b double, c double, d double")
    args = [F.col(c) for c in "abcd"]
    rows = df.select(haversine_m(*args).alias("m"), bearing_deg(*args).alias("w"),
                     bearing_deg(*args, signed=True).alias("s")).collect()
    assert rows[0]["m"] == pytest.approx(math.pi * 6_371_000)
    assert rows[1]["m"] == 0.0
    assert rows[2]["s"] == pytest.approx(-45, abs=0.01) and rows[2]["w"] == pytest.approx(315, abs=0.01)
    assert rows[3]["m"] is None


def test_offsets_and_weekdays(spark):
    df = spark.createDataFrame([("2025-11-20 08:00:00+0300",), ("2025-11-20 05:00:00",),
                                ("2025-11-20 05:00:00+00:00",), ("no time",)], "t string")
    times = [r[0] for r in df.select(parse_utc(F.col("t")).cast("string")).collect()]
    assert times == ["2025-11-20 05:00:00"] * 3 + [None]
    days = spark.sql("select timestamp'2024-03-03 23:59:59' a, timestamp'2024-03-04 00:00:00' b").select(
        monday_zero_weekday(F.col("a")), monday_zero_weekday(F.col("b"))).first()
    assert tuple(days) == (6, 0)


@pytest.mark.parametrize("gap, events", [(899, 1), (900, 1), (901, 2)])
def test_gap(spark, gap, events):
    df = scored(spark, [(1, 1, 0, -1.0, -1), (2, 1, gap, -1.0, -1)])
    assert L.anomaly_events(df, min_size=1).count() == events


def test_interleaved_devices_stay_apart(spark):
    df = scored(spark, [(1, 1, 0, -1.0, -1), (2, 2, 10, -1.0, -1), (3, 1, 2000, -1.0, -1), (4, 2, 2010, -1.0, -1)])
    assert L.anomaly_events(df, min_size=1).count() == 4
    assert L.filter_isolated(df).filter("anomaly = -1").count() == 0


def test_equal_scores_flag_nothing(spark):
    df = scored(spark, [(i, 1, i, -0.5, 1) for i in range(50)])
    assert L.label(df).filter("anomaly = -1").count() == 0


@pytest.mark.parametrize("n, flagged", [(21, 1), (22, 2)])
def test_small_batches(spark, n, flagged):
    df = scored(spark, [(i, 1, i, -i / 100, 1) for i in range(n)])
    assert L.label(df).filter("anomaly = -1").count() == flagged


def test_filter_never_adds_and_keeps_rows(spark):
    df = scored(spark, [(i, i % 3, i * 400, -i / 100, -1 if i % 4 else 1) for i in range(60)])
    out = L.filter_isolated(df)
    assert out.count() == 60
    assert out.filter("anomaly = -1").join(df.filter("anomaly = 1"), "id").count() == 0
    total = L.anomaly_events(df).agg(F.sum("n_points")).first()[0]
    assert (total or 0) == out.filter("anomaly = -1").count()


def test_metrics_of_nothing(spark):
    row = evaluate(scored(spark, [(1, 1, 0, -0.4, 1)])).first()
    assert row["anomaly_score_mean"] is None and row["normal_score_mean"] == -0.4
    assert evaluate(scored(spark, [])).first()["total_samples"] == 0


def test_window_local_alerts_cannot_fire_by_default(spark):
    df = scored(spark, [(i, 1, i, -(i * 37 % 101) / 100, 1) for i in range(100)])
    assert L.sliding_alerts(df, "window_local").count() == 0
    assert L.sliding_alerts(df, "window_local", q=0.35).count() == 90


def test_constant_column_scales_by_one(spark):
    df = spark.createDataFrame([(float(i), 3.0) for i in range(10)], "x double, k double")
    scaler = fit_scaler(df, ("x", "k"))
    assert scaler.median == (4.5, 3.0) and scaler.iqr == (4.5, 1.0)
    assert rows_of(scaler.transform(df).select("k").distinct()) == [("0",)]
