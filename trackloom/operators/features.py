"""The 35 model features."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.config import DEFAULT, TrackConfig
from trackloom.functions.scalars import (burst_flag, finite_or_zero, monday_zero_weekday, or_zero,
                                         utc_hour)
from trackloom.operators.clean import clean_pieces
from trackloom.operators.motion import add_motion
from trackloom.plans.ordered import (cut_hot_devices, drop_lookback, forget_pieces, run_position,
                                     track, with_lookback)
from trackloom.schema import OPTIONAL, feature_names


def complete_columns(df: DataFrame, names=OPTIONAL) -> frozenset[str]:
    """Optional columns that are present without a single null (one aggregate over them)."""
    present = [c for c in names if c in df.columns]
    if not present:
        return frozenset()
    nulls = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in present]).first()
    return frozenset(c for c in present if nulls[c] == 0)


def add_rolling(df: DataFrame, cfg: TrackConfig = DEFAULT) -> DataFrame:
    """Trailing means, sample deviations and distance sums; short histories are allowed."""
    w = track(df)
    sources = {"acc": "acceleration", "speed": "speed_m_s", "vert_speed": "vertical_speed"}
    out = {}
    for k in cfg.rolling_windows:
        frame = w.rowsBetween(1 - k, 0)
        for prefix, source in sources.items():
            out[f"{prefix}_mean_{k}"] = F.avg(source).over(frame)
            out[f"{prefix}_std_{k}"] = or_zero(F.stddev_samp(source).over(frame))
        out[f"distance_sum_{k}"] = F.sum("distance_m").over(frame)
    recent = w.rowsBetween(1 - cfg.zscore_window, 0)
    spread = F.stddev_samp("speed_m_s").over(recent) + F.lit(1e-6)
    out["speed_zscore"] = or_zero(
        (F.col("speed_m_s") - F.avg("speed_m_s").over(recent)) / spread)
    return df.withColumns(out)


def add_hover(df: DataFrame, cfg: TrackConfig = DEFAULT, carry: DataFrame | None = None) -> DataFrame:
    """Hover flag: position in the run of slow fixes times the current interval."""
    slow = F.col("speed_m_s") < cfg.hover_speed
    df = run_position(df, slow, "hover_run", carry)
    return (df.withColumn("is_hovering", slow.cast("int"))
              .withColumn("hover_duration", F.col("hover_run") * F.col("dt"))
              .withColumn("hover_flag", (F.col("hover_duration") > cfg.hover_seconds).cast("int")))


def add_row_features(df: DataFrame, cfg: TrackConfig = DEFAULT) -> DataFrame:
    """Features that need no neighbour."""
    df = df.withColumns({
        "acceleration_abs": F.abs("acceleration"),
        "speed_change_abs": F.abs("speed_change_rate"),
        "alt_change_abs": F.abs("delta_alt"),
        "hour": utc_hour(F.col("ts")),
        "day_of_week": monday_zero_weekday(F.col("ts")),
        "log_speed": F.log1p("speed_m_s"),
        "log_distance": F.log1p("distance_m"),
    })
    return df.withColumns({
        "burst_flag": burst_flag(F.col("acceleration_abs"), F.col("speed_change_abs"), cfg),
        "hour_norm": F.col("hour") / F.lit(24.0),
        "day_of_week_norm": F.col("day_of_week") / F.lit(7.0),
    })


def build_features(df: DataFrame, cfg: TrackConfig = DEFAULT, derive: str = "always",
                   given: frozenset[str] | None = None) -> DataFrame:
    """All model features, as doubles free of null and infinity.

    ``derive="always"`` recomputes every motion column; ``"if_any_null"`` keeps an optional
    column that arrives complete. ``given`` names columns to keep without checking (those that
    cleaning has just computed).
    """
    if derive not in ("always", "if_any_null"):
        raise ValueError(f"derive: {derive!r}")
    keep = frozenset(given or ())
    if derive == "if_any_null":
        keep |= complete_columns(df)
    lookback = cfg.state_lookback
    df = with_lookback(cut_hot_devices(df, cfg), lookback)
    df = drop_lookback(add_rolling(add_motion(df, keep), cfg))
    df = add_row_features(add_hover(df, cfg), cfg)
    names = feature_names(cfg.rolling_windows)
    return forget_pieces(df.withColumns({c: finite_or_zero(F.col(c)) for c in names}))


def clean_features(df: DataFrame, cfg: TrackConfig = DEFAULT) -> DataFrame:
    """Cleaning followed by features; the interval, distance and speed of cleaning are kept."""
    return build_features(clean_pieces(df, cfg), cfg, given=frozenset({"dt", "distance_m", "speed_m_s"}))
