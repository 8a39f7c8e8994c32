"""The device dimension: lookups, model assignment, selection and per-device displays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackloom.config import DEFAULT, TrackConfig
from trackloom.functions.scalars import (anomaly_text, last_seen_text, marker_style, point_text)
from trackloom.operators.labels import is_anomaly
from trackloom.plans.ordered import cut_hot_devices, device_rank

ALL = "All"  # fixed value: the selection entry that stands for every active device


def active(devices: DataFrame) -> DataFrame:
    return devices.filter(F.col("status") == "Active")


def has_model() -> Column:
    return F.col("if_model").isNotNull() & (F.col("if_model") != "")


def with_device(tracks: DataFrame, devices: DataFrame) -> DataFrame:
    """Rows of known devices with their settings."""
    return tracks.join(devices, "device_id", "inner")


def with_model(tracks: DataFrame, devices: DataFrame) -> DataFrame:
    """Every row with the model assigned to its device; null without one."""
    assigned = devices.filter(has_model()).select("device_id", F.col("if_model").alias("model_name"))
    return tracks.join(assigned, "device_id", "left")


def assignments(devices: DataFrame) -> DataFrame:
    return devices.select("device_name", F.when(has_model(), F.col("if_model"))
                          .otherwise("none").alias("model"))


def model_catalogue(devices: DataFrame) -> DataFrame:
    return devices.filter(has_model()).select(F.col("if_model").alias("model_name")).distinct()


def devices_without_model(devices: DataFrame, models: DataFrame) -> DataFrame:
    """Devices with no assignment, or assigned to a model that is not saved."""
    return devices.join(models.withColumnRenamed("model_name", "if_model"), "if_model", "left_anti")


def orphan_models(models: DataFrame, devices: DataFrame) -> DataFrame:
    """Saved models that no device references."""
    return models.join(model_catalogue(devices), "model_name", "left_anti")


def expand_selection(selection: DataFrame, devices: DataFrame) -> DataFrame:
    """Selected device names once each; ``All`` stands for every active device.

    ``All`` counts only while it is alone: any named pick replaces it.
    """
    named = selection.filter(F.col("device_name") != ALL).select("device_name").distinct()
    picks = selection.agg(F.count_if(F.col("device_name") == ALL).alias("all_picks"),
                          F.count_if(F.col("device_name") != ALL).alias("named_picks"))
    whole = picks.select(((F.col("all_picks") > 0) & (F.col("named_picks") == 0)).alias("x")).scalar()
    return named.unionByName(active(devices).filter(whole).select("device_name")).distinct()


def add_all_devices(selection: DataFrame, devices: DataFrame) -> DataFrame:
    """Selected names plus, if ``All`` is among them, every active device; no duplicates."""
    asked = selection.agg((F.count_if(F.col("device_name") == ALL) > 0).alias("x")).scalar()
    named = selection.filter(F.col("device_name") != ALL).select("device_name")
    return named.unionByName(active(devices).filter(asked).select("device_name")).dropDuplicates()


def of_selected(tracks: DataFrame, devices: DataFrame, selection: DataFrame) -> DataFrame:
    ids = devices.join(selection, "device_name", "left_semi").select("device_id")
    return tracks.join(ids, "device_id", "left_semi")


def row_count(tracks: DataFrame, devices: DataFrame, selection: DataFrame) -> DataFrame:
    """Number of rows over the selected devices; unknown names add nothing."""
    return of_selected(tracks, devices, selection).agg(F.count(F.lit(1)).alias("n_rows"))


def assign_model(devices: DataFrame, assigned: DataFrame) -> DataFrame:
    """Upsert (device_name, if_model): known names get the model, unknown names a new row."""
    placed = assigned.select("device_name", "if_model", F.monotonically_increasing_id().alias("_row"))
    new = placed.groupBy("device_name").agg(F.max_by("if_model", "_row").alias("_model"))  # the last of equal names
    return (devices.join(new, "device_name", "full_outer")
            .withColumn("if_model", F.coalesce("_model", "if_model")).drop("_model")
            .select(*devices.columns))


def assign_to_selection(devices: DataFrame, selection: DataFrame, model_name: str) -> DataFrame:
    """Bulk assignment of one model to the selected (or all active) devices."""
    names = add_all_devices(selection, devices)
    return assign_model(devices, names.withColumn("if_model", F.lit(model_name)))


def polylines(df: DataFrame, order: str = "ts", cfg: TrackConfig = DEFAULT) -> DataFrame:
    """Ordered positions per device, always in rows of at most ``polyline_points`` points.

    The points of a device are those of its segments 0, 1, 2, ... in turn; ``polyline_points`` decides the shape.
    """
    by = ("ts", "id") if order == "ts" else ("id",)
    ranked = device_rank(cut_hot_devices(df, cfg, by), "_rank", by)
    segment = F.floor((F.col("_rank") - 1) / F.lit(cfg.polyline_points))
    point = F.struct("_rank", "ts", "lat", "lon", "anomaly")
    return (ranked.withColumn("segment", segment)
            .groupBy("device_id", "segment")
            .agg(F.sort_array(F.collect_list(point)).alias("_points"))
            .select("device_id", "segment", F.transform("_points", lambda p: F.struct(
                p["ts"].alias("ts"), p["lat"].alias("lat"), p["lon"].alias("lon"),
                p["anomaly"].alias("anomaly"))).alias("points")))


def last_seen(df: DataFrame, order: str = "ts") -> DataFrame:
    by = F.struct("ts", "id") if order == "ts" else F.col("id")
    return (df.groupBy("device_id").agg(F.max_by(F.struct("ts", "lat", "lon"), by).alias("at"))
              .select("device_id", "at.ts", "at.lat", "at.lon"))


def last_seen_messages(df: DataFrame, devices: DataFrame, order: str = "ts") -> DataFrame:
    seen = last_seen(df, order).join(devices.select("device_id", "device_name"), "device_id")
    return seen.select("device_id", last_seen_text(F.col("device_name"), F.col("lat"),
                                                   F.col("lon")).alias("message"))


def markers(df: DataFrame, devices: DataFrame) -> DataFrame:
    """Every plotted fix with colours, radius and text."""
    line, fill, radius = marker_style(F.col("anomaly"), F.col("color_1"), F.col("color_2"))
    return with_device(df, devices.select("device_id", "color_1", "color_2")).select(
        "id", "device_id", "lat", "lon", line.alias("color"), fill.alias("fill_color"),
        radius.alias("radius"), point_text(F.col("lat"), F.col("lon")).alias("message"))


def anomaly_messages(df: DataFrame) -> DataFrame:
    return df.filter(is_anomaly()).select("id", "device_id", anomaly_text(
        F.col("ts"), F.col("speed_m_s"), F.col("anomaly_score")).alias("message"))
