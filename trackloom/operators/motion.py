"""Base motion columns of a track."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.config import DEFAULT, TrackConfig
from trackloom.functions.geo import bearing_deg, haversine_m
from trackloom.functions.scalars import or_zero, ratio_or_zero, seconds_between
from trackloom.plans.ordered import (cut_hot_devices, drop_lookback, forget_pieces, running_sum,
                                     track, with_lookback)


def add_motion(df: DataFrame, given: frozenset[str] = frozenset(),
               signed_bearing: bool = False) -> DataFrame:
    """First- and second-order differences; needs two rows of look-back.

    Columns named in ``given`` are taken from the input instead of being derived.
    """
    w = track(df)
    p = lambda name: F.col(f"_p.{name}")
    first_order = {
        "dt": or_zero(seconds_between(p("ts"), F.col("ts"))),
        "delta_lat": or_zero(F.col("lat") - p("lat")),
        "delta_lon": or_zero(F.col("lon") - p("lon")),
        "delta_alt": or_zero(F.col("alt") - p("alt")),
        "distance_m": or_zero(haversine_m(p("lat"), p("lon"), F.col("lat"), F.col("lon"))),
        "bearing": or_zero(bearing_deg(p("lat"), p("lon"), F.col("lat"), F.col("lon"),
                                       signed=signed_bearing)),
    }
    df = df.withColumn("_p", F.lag(F.struct("ts", "lat", "lon", "alt")).over(w))
    df = df.withColumns({c: e for c, e in first_order.items() if c not in given}).drop("_p")
    if "speed_m_s" not in given:
        df = df.withColumn("speed_m_s", ratio_or_zero(F.col("distance_m"), F.col("dt")))
    df = df.withColumn("speed_change", F.col("speed_m_s") - F.lag("speed_m_s").over(w))
    rate = or_zero(ratio_or_zero(F.col("speed_change"), F.col("dt")))
    df = df.withColumn("speed_change_rate", rate)
    if "acceleration" not in given:
        df = df.withColumn("acceleration", F.col("speed_change_rate"))
    return df.withColumn("vertical_speed", ratio_or_zero(F.col("delta_alt"), F.col("dt")))


def differences(df: DataFrame) -> DataFrame:
    """``add_motion`` with hot devices cut into pieces, whose numbers stay on the rows."""
    return drop_lookback(add_motion(with_lookback(cut_hot_devices(df), 2)))


def derive_motion(df: DataFrame, cfg: TrackConfig = DEFAULT) -> DataFrame:
    """The derived track table: differences, speed, signed bearing, acceleration, odometer."""
    cut = cut_hot_devices(df, cfg)
    moved = drop_lookback(add_motion(with_lookback(cut, 2), signed_bearing=True))
    total = running_sum(moved, "distance_m", "cumulative_distance")
    return forget_pieces(total).drop("speed_change", "speed_change_rate", "vertical_speed")
