import dataclasses
import datetime as dt

from trackloom.config import DEFAULT

# Every device is "hot" and every input "large": the scale-out ways on tiny data.
CUT = dataclasses.replace(DEFAULT, hot_device_rows=150, small_sort_rows=0,
                          bracket_rows=20, sketch_accuracy=100, polyline_points=7)

START = dt.datetime(2024, 3, 3, 23, 59, 0, tzinfo=dt.timezone.utc)  # a Sunday, just before midnight


def fixes(spark, rows):
    """rows: (id, device_id, seconds after START, lat, lon, alt)."""
    data = [(i, d, START + dt.timedelta(seconds=t), lat, lon, alt) for i, d, t, lat, lon, alt in rows]
    return spark.createDataFrame(data, "id long, device_id long, ts timestamp, lat double, lon double, alt double")


def scored(spark, rows):
    """rows: (id, device_id, seconds after START, score, anomaly)."""
    data = [(i, d, START + dt.timedelta(seconds=t), 0.0, 0.0, 1.0, s, a) for i, d, t, s, a in rows]
    return spark.createDataFrame(data, "id long, device_id long, ts timestamp, lat double, lon double, "
                                       "speed_m_s double, anomaly_score double, anomaly int")


def rows_of(df, *keys):
    """Comparable rows; doubles at ten significant places."""
    def flat(value):
        return f"{value:.10g}" if isinstance(value, float) else str(value)
    order = sorted(df.columns)
    return sorted([tuple(flat(r[c]) for c in order) for r in df.collect()])


def same(a, b):
    left, right = rows_of(a), rows_of(b.select(*a.columns))
    assert len(left) == len(right)
    assert left == right


def crowd(df, share=0.5):
    """Move half of the devices' rows to one device, so that it holds most of the data."""
    from pyspark.sql import functions as F

    top = df.agg(F.max("device_id")).first()[0]
    return df.withColumn("device_id", F.when(F.col("device_id") < top * share, -7).otherwise(F.col("device_id")))
