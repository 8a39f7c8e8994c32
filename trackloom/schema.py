"""Explicit schemas and the model's column order."""

from __future__ import annotations

from pyspark.sql import types as T

from trackloom.config import DEFAULT


def feature_names(windows: tuple[int, ...] = DEFAULT.rolling_windows) -> list[str]:
    names = ["dt", "distance_m", "speed_m_s", "vertical_speed",
             "acceleration_abs", "speed_change_abs", "alt_change_abs"]
    for k in windows:
        names += [f"acc_mean_{k}", f"acc_std_{k}",
                  f"speed_mean_{k}", f"speed_std_{k}",
                  f"vert_speed_mean_{k}", f"vert_speed_std_{k}",
                  f"distance_sum_{k}"]
    return names + ["speed_zscore", "hover_flag", "burst_flag",
                    "hour_norm", "day_of_week_norm", "log_speed", "log_distance"]


FEATURES = feature_names()

# External column names of the fact and device tables, and ours.
FACT_NAMES = {"Id": "id", "Device_id": "device_id", "Timestamp": "ts",
              "Latitude": "lat", "Longitude": "lon", "Altitude": "alt", "Anomaly": "anomaly"}
DEVICE_NAMES = {"Device_id": "device_id", "Device_name": "device_name", "Status": "status",
                "Color_1": "color_1", "Color_2": "color_2", "IF_model": "if_model"}
RAW_NAMES = {"date_time": "ts", "latitude": "lat", "longitude": "lon", "altitude": "alt"}

REQUIRED = ("device_id", "lat", "lon", "alt", "ts")
OPTIONAL = ("dt", "distance_m", "speed_m_s", "delta_alt", "bearing", "acceleration")
RESULT_COLUMNS = ("ts", "device_id", "lat", "lon", "alt", "speed_m_s", "anomaly_score", "anomaly")
INFERENCE_COLUMNS = ("id", "ts", "device_id", "lat", "lon", "alt", "speed_m_s", "delta_alt",
                     "dt", "distance_m", "bearing", "acceleration")

_D, _S, _L, _I = T.DoubleType(), T.StringType(), T.LongType(), T.IntegerType()

FIXES = T.StructType([
    T.StructField("id", _L, False),
    T.StructField("device_id", _L, False),
    T.StructField("ts", T.TimestampType(), False),
    T.StructField("lat", _D),
    T.StructField("lon", _D),
    T.StructField("alt", _D),
    *[T.StructField(c, _D) for c in OPTIONAL],
    T.StructField("anomaly", _I),
])

DEVICES = T.StructType([
    T.StructField("device_id", _L, False),
    T.StructField("device_name", _S, False),
    T.StructField("status", _S),
    T.StructField("color_1", _S),
    T.StructField("color_2", _S),
    T.StructField("if_model", _S),
])

RAW_CSV = T.StructType([
    T.StructField("date_time", _S),
    T.StructField("latitude", _D),
    T.StructField("longitude", _D),
    T.StructField("altitude", _D),
])

NODES = T.StructType([
    T.StructField("model_name", _S, False),
    T.StructField("tree_id", _I, False),
    T.StructField("node_id", _I, False),
    T.StructField("feature", _I, False),
    T.StructField("threshold", _D, False),
    T.StructField("left", _I, False),
    T.StructField("right", _I, False),
    T.StructField("n", _I, False),
    T.StructField("depth", _I, False),
])

MODEL_META = T.StructType([
    T.StructField("model_name", _S, False),
    T.StructField("features", T.ArrayType(_S), False),
    T.StructField("median", T.ArrayType(_D), False),
    T.StructField("iqr", T.ArrayType(_D), False),
    T.StructField("psi", _I, False),
    T.StructField("n_trees", _I, False),
    T.StructField("seed", _L, False),
    T.StructField("threshold", _D),
    T.StructField("trained_at", T.TimestampType(), False),
])
