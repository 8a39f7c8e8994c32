"""Scalar building blocks; every one stays inside JVM code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from trackloom.config import DEFAULT, TrackConfig


def ratio_or_zero(value: Column, dt: Column) -> Column:
    """``value / dt`` where dt is positive, otherwise 0; never divides by zero."""
    return F.when(dt > 0, value / dt).otherwise(F.lit(0.0))


def or_zero(value: Column) -> Column:
    return F.coalesce(value, F.lit(0.0))


def finite_or_zero(value: Column) -> Column:
    """Null, NaN and both infinities become 0."""
    x = value.cast("double")
    bad = F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    return F.when(bad, F.lit(0.0)).otherwise(or_zero(x))


def seconds_between(start: Column, end: Column) -> Column:
    return (F.unix_micros(end) - F.unix_micros(start)) / F.lit(1_000_000.0)


def burst_flag(acceleration_abs: Column, speed_change_abs: Column,
               cfg: TrackConfig = DEFAULT) -> Column:
    hit = ((acceleration_abs > cfg.burst_acceleration)
           | (speed_change_abs > cfg.burst_speed_change))
    return F.coalesce(hit, F.lit(False)).cast("int")


def utc_hour(ts: Column) -> Column:
    return F.pmod(F.floor(F.unix_micros(ts.cast("timestamp")) / F.lit(3_600_000_000)), F.lit(24)).cast("int")


def monday_zero_weekday(ts: Column) -> Column:
    days = F.floor(F.unix_micros(ts.cast("timestamp")) / F.lit(86_400_000_000))
    return F.pmod(days + 3, F.lit(7)).cast("int")   # day 0 was a Thursday


def parse_utc(text: Column) -> Column:
    """Timestamps as text, with or without offset; zoneless text counts as UTC in any session."""
    said = F.trim(text)
    zoned = said.rlike(r"(?i):.*(?:z|utc|gmt|[+-][0-9]{1,2}(?::?[0-9]{2})?)$")
    return F.coalesce(
        F.try_to_timestamp(said, F.lit("yyyy-MM-dd HH:mm:ssZ")),
        F.when(zoned, F.try_to_timestamp(said)),
        F.when(~zoned, F.try_to_timestamp(F.concat(said, F.lit("Z")))),
        F.when(~zoned, F.try_to_timestamp(F.concat(said, F.lit(" 00:00:00Z")))),
    )


# Display formats.
ANOMALY_TEXT = "Anomaly<br>Time: %s<br>Speed: %.2f m/s<br>Score: %.4f"
POINT_TEXT = "Latitude: %s longitude: %s"
LAST_SEEN_TEXT = "Device %s Last seen Latitude: %s, Longitude: %s"
TIME_PATTERN = "yyyy-MM-dd HH:mm:ssxxx"


def anomaly_text(ts: Column, speed: Column, score: Column) -> Column:
    return F.format_string(ANOMALY_TEXT, F.date_format(ts, TIME_PATTERN), speed, score)


def point_text(lat: Column, lon: Column) -> Column:
    return F.format_string(POINT_TEXT, lat.cast("string"), lon.cast("string"))


def last_seen_text(name: Column, lat: Column, lon: Column) -> Column:
    return F.format_string(LAST_SEEN_TEXT, name, lat.cast("string"), lon.cast("string"))


def marker_style(anomaly: Column, color_1: Column, color_2: Column) -> tuple[Column, Column, Column]:
    """(line colour, fill colour, radius) of a plotted fix; fixed values: red and 160 / 5."""
    bad = anomaly == -1
    return (F.when(bad, "red").otherwise(color_1),
            F.when(bad, "red").otherwise(color_2),
            F.when(bad, 160).otherwise(5))
