"""Row validation: nulls, coordinate bounds, minimum interval, maximum speed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackloom.config import DEFAULT, TrackConfig
from trackloom.functions.geo import haversine_m
from trackloom.functions.scalars import or_zero, ratio_or_zero, seconds_between
from trackloom.plans.ordered import (cut_hot_devices, drop_lookback, forget_pieces, track,
                                     with_lookback)
from trackloom.schema import REQUIRED


def require_columns(df: DataFrame, names=REQUIRED) -> DataFrame:
    missing = [c for c in names if c not in df.columns]
    if missing:
        raise ValueError(f"missing required column(s): {', '.join(missing)}")
    return df


def require_rows(df: DataFrame, at_least: int, what: str = "input") -> DataFrame:
    """Raise unless the frame has enough rows; reads no more than it must."""
    found = df.limit(at_least).count()
    if found < at_least:
        raise ValueError(f"{what}: {found} rows, at least {at_least} required")
    return df


def drop_null_positions(df: DataFrame) -> DataFrame:
    return df.dropna(subset=["lat", "lon", "alt"])


def in_bounds(cfg: TrackConfig = DEFAULT) -> Column:
    return (F.col("lat").between(cfg.min_latitude, cfg.max_latitude)
            & F.col("lon").between(cfg.min_longitude, cfg.max_longitude))


def positions_usable(cfg: TrackConfig = DEFAULT) -> Column:
    known = F.col("lat").isNotNull() & F.col("lon").isNotNull() & F.col("alt").isNotNull()
    return known & in_bounds(cfg)


def long_enough(cfg: TrackConfig = DEFAULT) -> Column:
    return F.col("dt") >= cfg.min_dt


def slow_enough(cfg: TrackConfig = DEFAULT) -> Column:
    return F.col("speed_m_s") <= cfg.max_speed


def add_step(df: DataFrame) -> DataFrame:
    """dt, distance_m and speed_m_s from the device's previous row; zeros on its first."""
    w = track(df)
    step = F.struct("ts", "lat", "lon")
    return (df.withColumn("_p", F.lag(step).over(w))
              .withColumn("dt", or_zero(seconds_between(F.col("_p.ts"), F.col("ts"))))
              .withColumn("distance_m", or_zero(haversine_m(
                  F.col("_p.lat"), F.col("_p.lon"), F.col("lat"), F.col("lon"))))
              .withColumn("speed_m_s", ratio_or_zero(F.col("distance_m"), F.col("dt")))
              .drop("_p"))


def steps(df: DataFrame, cfg: TrackConfig = DEFAULT) -> DataFrame:
    """``add_step`` with hot devices cut into pieces, whose numbers stay on the rows."""
    return drop_lookback(add_step(with_lookback(cut_hot_devices(df, cfg), 1)))


def _stepped(df: DataFrame, cfg: TrackConfig) -> DataFrame:
    return steps(df.filter(positions_usable(cfg)), cfg)


def clean_pieces(df: DataFrame, cfg: TrackConfig = DEFAULT) -> DataFrame:
    """``clean`` with the piece numbers of hot devices kept for the next ordered step."""
    return _stepped(df, cfg).filter(long_enough(cfg)).filter(slow_enough(cfg))


def clean(df: DataFrame, cfg: TrackConfig = DEFAULT) -> DataFrame:
    """Null drop, bounds, dt, minimum dt, speed, maximum speed, in that order.

    A device's first fix has dt 0 and therefore goes. Adds dt, distance_m and speed_m_s.
    """
    return forget_pieces(clean_pieces(df, cfg))


def quality_report(df: DataFrame, cfg: TrackConfig = DEFAULT) -> DataFrame:
    """How many rows each rule removes, and how many stay; one row."""
    null = F.col("lat").isNull() | F.col("lon").isNull() | F.col("alt").isNull()
    head = df.agg(F.count(F.lit(1)).alias("input_rows"),
                  F.count_if(null).alias("null_position"),
                  F.count_if(~null & ~in_bounds(cfg)).alias("out_of_bounds"))
    tail = _stepped(df, cfg).agg(
        F.count_if(~long_enough(cfg)).alias("short_interval"),
        F.count_if(long_enough(cfg) & ~slow_enough(cfg)).alias("too_fast"),
        F.count_if(long_enough(cfg) & slow_enough(cfg)).alias("kept_rows"))
    both = head.unionByName(tail, allowMissingColumns=True)
    return both.agg(*[F.max(c).alias(c) for c in both.columns])
