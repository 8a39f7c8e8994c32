"""Summaries: evaluation metrics, counts, histograms, heat cells, retraining signals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.config import DEFAULT, TrackConfig
from trackloom.operators.labels import is_anomaly
from trackloom.plans.scratch import materialize

# The features whose distributions are reported, and the bins per label.
HISTOGRAM_FEATURES = ("speed_m_s", "vertical_speed", "acceleration_abs",
                      "speed_change_abs", "speed_std_5", "log_speed")
NORMAL_BINS, ANOMALY_BINS = 50, 30


def evaluate(df: DataFrame) -> DataFrame:
    """Totals, rate and score statistics in one row; a mean over no rows is null."""
    score = F.col("anomaly_score")
    bad = F.count_if(is_anomaly())
    rows = F.count(F.lit(1))
    return df.agg(
        rows.alias("total_samples"), bad.alias("n_anomalies"),
        F.when(rows > 0, bad / rows).alias("anomaly_rate"),
        F.avg(score).alias("score_mean"), F.stddev_pop(score).alias("score_std"),
        F.min(score).alias("score_min"), F.max(score).alias("score_max"),
        F.avg(F.when(is_anomaly(), score)).alias("anomaly_score_mean"),
        F.avg(F.when(F.col("anomaly") == 1, score)).alias("normal_score_mean"))


def score_cut_line(df: DataFrame) -> DataFrame:
    return df.agg(F.max(F.when(is_anomaly(), F.col("anomaly_score"))).alias("cut_line"))


def rows_per_device(df: DataFrame) -> DataFrame:
    return df.groupBy("device_id").agg(F.count(F.lit(1)).alias("n_rows"))


def distinct_devices(df: DataFrame, approximate: bool = False) -> DataFrame:
    """Number of devices; exact by two-stage distinct, or a sketch."""
    counter = F.approx_count_distinct if approximate else F.count_distinct
    return df.agg(counter("device_id").alias("n_devices"))


def labels_per_device(df: DataFrame) -> DataFrame:
    return df.groupBy("device_id", "anomaly").agg(F.count(F.lit(1)).alias("n_rows"))


def map_centre(df: DataFrame) -> DataFrame:
    return df.agg(F.avg("lat").alias("centre_lat"), F.avg("lon").alias("centre_lon"))


def high_water_marks(df: DataFrame) -> DataFrame:
    return df.groupBy("device_id").agg(F.max("id").alias("last_id"))


def anomaly_heat(df: DataFrame, cell_degrees: float = 0.001) -> DataFrame:
    """Anomalies per grid cell."""
    cell = lambda c: F.floor(F.col(c) / F.lit(cell_degrees)).alias(f"{c}_cell")
    return (df.filter(is_anomaly()).groupBy(cell("lat"), cell("lon"))
              .agg(F.count(F.lit(1)).alias("n_points")))


def density_histogram(df: DataFrame, features: Sequence[str] = HISTOGRAM_FEATURES) -> DataFrame:
    """Equal-width density per feature and label; empty bins are listed with density 0. Nulls and NaN count nowhere."""
    rows = materialize(df.select("anomaly", *features), "histogram")  # read twice: for the ranges and for the bins
    long = rows.select("anomaly", F.explode(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value"))
        for c in features])).alias("e")).select("anomaly", "e.feature", "e.value")
    long = long.filter(F.col("value").isNotNull() & ~F.isnan("value"))
    flat = F.col("low") == F.col("high")
    ranges = (long.groupBy("feature", "anomaly")
              .agg(F.min("value").alias("low"), F.max("value").alias("high"),
                   F.count("value").alias("total"))
              .filter(F.col("total") > 0)
              .withColumn("bins", F.when(F.col("anomaly") == -1, ANOMALY_BINS).otherwise(NORMAL_BINS))
              .withColumns({"low": F.when(flat, F.col("low") - 0.5).otherwise(F.col("low")),
                            "high": F.when(flat, F.col("high") + 0.5).otherwise(F.col("high"))})
              .withColumn("width", (F.col("high") - F.col("low")) / F.col("bins")))
    ranges = F.broadcast(ranges)  # at most two rows per feature
    at = F.floor((F.col("value") - F.col("low")) / (F.col("high") - F.col("low")) * F.col("bins"))
    counted = (long.join(ranges, ["feature", "anomaly"])
               .withColumn("bin", F.least(at, F.col("bins") - 1).cast("int"))
               .groupBy("feature", "anomaly", "bin").agg(F.count(F.lit(1)).alias("n")))
    every_bin = ranges.withColumn("bin", F.explode(F.sequence(F.lit(0), F.col("bins") - 1)))
    return (every_bin.join(counted, ["feature", "anomaly", "bin"], "left")
            .select("feature", "anomaly", "bin",
                    (F.col("low") + F.col("bin") * F.col("width")).alias("bin_start"),
                    (F.coalesce("n", F.lit(0)) / (F.col("total") * F.col("width"))).alias("density")))


def monitoring_totals(batches: DataFrame) -> DataFrame:
    """Counters over the append-only table of per-batch rows."""
    return batches.agg(F.coalesce(F.sum("n_rows"), F.lit(0)).alias("total_processed"),
                       F.coalesce(F.sum("n_anomalies"), F.lit(0)).alias("anomalies_detected"),
                       F.max("checked_at").alias("last_check"))


def repeat_statistics(repeats: DataFrame) -> DataFrame:
    """Mean and population deviation of the importance over its repeats."""
    return repeats.groupBy("feature").agg(F.avg("importance").alias("importance_mean"),
                                          F.stddev_pop("importance").alias("importance_std"))


def top_features(importance: DataFrame, k: int) -> DataFrame:
    return importance.orderBy(F.desc("importance_mean"), "feature").limit(k)


def should_retrain(models: DataFrame, fixes: DataFrame, now, cfg: TrackConfig = DEFAULT) -> DataFrame:
    """Per model: whole days since training, rows newer than it on its devices, and the decision.

    ``models``: model_name, trained_at. ``fixes``: model_name, ts.
    """
    fresh = (fixes.join(models.select("model_name", "trained_at"), "model_name")
             .groupBy("model_name")
             .agg(F.count_if(F.col("ts") > F.col("trained_at")).alias("n_new")))
    age = F.floor((F.unix_micros(F.lit(now).cast("timestamp")) - F.unix_micros("trained_at"))
                  / F.lit(86_400_000_000))
    return (models.select("model_name", "trained_at").join(fresh, "model_name", "left")
            .select("model_name", age.alias("age_days"),
                    F.coalesce("n_new", F.lit(0)).alias("n_new"))
            .withColumn("retrain", (F.col("age_days") >= cfg.retrain_days)
                        | (F.col("n_new") >= cfg.retrain_rows)))


def recent(df: DataFrame, days: int) -> DataFrame:
    """Rows at most ``days`` days older than the newest."""
    newest = df.agg(F.max("ts").alias("newest")).scalar()
    return df.filter(F.col("ts") >= newest - F.make_dt_interval(F.lit(days)))
