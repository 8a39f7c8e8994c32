"""Thresholds, labels, isolated anomalies, events and sliding-window alerts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackloom.config import DEFAULT, TrackConfig
from trackloom.functions.scalars import seconds_between
from trackloom.plans.ordered import (PIECE, cut_hot_devices, device_rank, device_size,
                                     drop_lookback, forget_pieces, is_cut, last_before, running_sum, track,
                                     with_lookback)
from trackloom.plans.selection import quantile


def is_anomaly() -> Column:
    return F.col("anomaly") == -1


def label_below(df: DataFrame, threshold: Column) -> DataFrame:
    """-1 strictly below the threshold, 1 otherwise."""
    return df.withColumn("anomaly", F.when(F.col("anomaly_score") < threshold, -1).otherwise(1))


def device_quantiles(df: DataFrame, q: float, cfg: TrackConfig = DEFAULT) -> DataFrame:
    """Exact interpolated score quantile of every device, by rank within the device."""
    order = ("anomaly_score", "id")
    df = df.filter(F.col("anomaly_score").isNotNull())
    cut = cut_hot_devices(df.select("device_id", *order), cfg, order)
    ranked = device_size(device_rank(cut, "_rank", order), "_size")
    at = F.lit(q) * (F.col("_size") - 1)
    zero_based = F.col("_rank") - 1
    share = at - F.floor(at)
    weight = F.when(zero_based == F.floor(at), 1.0 - share).otherwise(share)
    return (ranked.filter(zero_based.between(F.floor(at), F.floor(at) + 1))
            .groupBy("device_id").agg(F.sum(F.col("anomaly_score") * weight).alias("threshold")))


def label(df: DataFrame, mode: str = "batch_quantile", threshold: float | None = None,
          q: float | None = None, cfg: TrackConfig = DEFAULT) -> DataFrame:
    """Label scored rows.

    ``fixed`` compares with a given value, ``batch_quantile`` with a quantile of these rows,
    ``per_device_quantile`` with a quantile of the row's own device.
    """
    q = cfg.threshold_quantile if q is None else q
    if mode == "fixed" or threshold is not None:
        if threshold is None:
            raise ValueError("mode 'fixed' needs a threshold")
        return label_below(df, F.lit(float(threshold)))
    if mode == "batch_quantile":
        return label_below(df, quantile(df, "anomaly_score", q, cfg))
    if mode == "per_device_quantile":
        joined = df.join(device_quantiles(df, q, cfg), "device_id", "left")
        return label_below(joined, F.col("threshold")).drop("threshold")
    raise ValueError(f"mode: {mode!r}")


def with_event_ids(df: DataFrame, gap_seconds: float | None = None,
                   cfg: TrackConfig = DEFAULT) -> DataFrame:
    """Number the anomalies' events per device from 1; null on normal rows. Keeps piece numbers."""
    gap = cfg.event_gap_seconds if gap_seconds is None else gap_seconds
    df = last_before(cut_hot_devices(df, cfg), F.when(is_anomaly(), F.col("ts")), "_previous")
    apart = F.col("_previous").isNull() | (seconds_between(F.col("_previous"), F.col("ts")) > gap)
    df = running_sum(df.withColumn("_starts", (is_anomaly() & apart).cast("long")),
                     "_starts", "event_id")
    return (df.withColumn("time_gap", F.when(is_anomaly(),
                                             seconds_between(F.col("_previous"), F.col("ts"))))
              .withColumn("event_id", F.when(is_anomaly(), F.col("event_id")))
              .drop("_previous", "_starts"))


def with_event_sizes(df: DataFrame) -> DataFrame:
    """Rows per event on every anomaly, from frames that carry ``event_id``."""
    if not is_cut(df):
        whole = Window.partitionBy("device_id", "event_id")
        return df.withColumn("event_size", F.when(is_anomaly(), F.count(F.lit(1)).over(whole)))
    key = ["device_id", "event_id", PIECE]
    parts = df.filter(is_anomaly()).groupBy(*key).agg(F.count(F.lit(1)).alias("_part"))
    sizes = parts.withColumn(
        "event_size", F.sum("_part").over(Window.partitionBy("device_id", "event_id"))).drop("_part")
    return df.join(sizes, key, "left")


def filter_isolated(df: DataFrame, gap_seconds: float | None = None, min_size: int | None = None,
                    cfg: TrackConfig = DEFAULT) -> DataFrame:
    """Relabel anomalies of events below ``min_size`` as normal; every row stays."""
    smallest = cfg.min_event_size if min_size is None else min_size
    marked = with_event_sizes(with_event_ids(df, gap_seconds, cfg))
    alone = is_anomaly() & (F.col("event_size") < smallest)
    return forget_pieces(marked.withColumn("anomaly", F.when(alone, 1).otherwise(F.col("anomaly")))
                               .drop("event_id", "event_size", "time_gap"))


def small_event_members(df: DataFrame, gap_seconds: float | None = None,
                        min_size: int | None = None, cfg: TrackConfig = DEFAULT) -> DataFrame:
    """The anomalies that ``filter_isolated`` would relabel."""
    smallest = cfg.min_event_size if min_size is None else min_size
    marked = with_event_sizes(with_event_ids(df.filter(is_anomaly()), gap_seconds, cfg))
    return forget_pieces(marked.filter(F.col("event_size") < smallest))


def anomaly_events(df: DataFrame, gap_seconds: float | None = None, min_size: int | None = None,
                   cfg: TrackConfig = DEFAULT) -> DataFrame:
    """One row per event of at least ``min_size`` anomalies; ids keep their gaps."""
    smallest = cfg.min_event_size if min_size is None else min_size
    marked = with_event_ids(df.filter(is_anomaly()), gap_seconds, cfg)
    return (marked.groupBy("device_id", "event_id")
            .agg(F.min("ts").alias("start_time"), F.max("ts").alias("end_time"),
                 F.count(F.lit(1)).alias("n_points"),
                 F.avg("lat").alias("mean_lat"), F.avg("lon").alias("mean_lon"),
                 F.avg("speed_m_s").alias("mean_speed"), F.avg("anomaly_score").alias("mean_score"))
            .withColumn("duration_seconds", seconds_between(F.col("start_time"), F.col("end_time")))
            .filter(F.col("n_points") >= smallest))


def sliding_alerts(df: DataFrame, mode: str = "fixed", q: float | None = None,
                   cfg: TrackConfig = DEFAULT) -> DataFrame:
    """Alert on a fix when enough of the ``alert_window`` fixes before it are anomalous.

    ``fixed`` counts the labels already on the rows; ``window_local`` takes the threshold from
    the scores of each window itself.
    """
    size = cfg.alert_window
    df = with_lookback(cut_hot_devices(df, cfg), size)
    frame = track(df).rowsBetween(-size, -1)
    score = F.col("anomaly_score")
    df = df.withColumns({
        "_filled": F.count(F.lit(1)).over(frame),
        "window_start": F.first("ts").over(frame),
        "mean_score": F.avg(score).over(frame),
        "min_score": F.min(score).over(frame),
    })
    if mode == "fixed":
        df = df.withColumn("n_anomalies", F.count_if(is_anomaly()).over(frame))
    elif mode == "window_local":
        at = (cfg.threshold_quantile if q is None else q) * (size - 1)
        low = int(at)
        ordered = F.sort_array(F.collect_list(score).over(frame))
        df = df.withColumn("_scores", ordered)
        first, second = F.get("_scores", F.lit(low)), F.get("_scores", F.lit(min(low + 1, size - 1)))
        df = df.withColumn("_cut", first + (second - first) * F.lit(at - low))
        df = df.withColumn("n_anomalies", F.size(F.filter("_scores", lambda x: x < F.col("_cut")))
                           .cast("long")).drop("_scores", "_cut")
    else:
        raise ValueError(f"mode: {mode!r}")
    hits = drop_lookback(df).filter((F.col("_filled") == size)
                                    & (F.col("n_anomalies") >= cfg.alert_threshold))
    return hits.select("device_id", "id", F.col("ts").alias("timestamp"), "window_start",
                       "n_anomalies", "mean_score", "min_score")
