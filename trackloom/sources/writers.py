"""Writing derived tracks, results and labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.operators.motion import derive_motion
from trackloom.plans.scratch import materialize
from trackloom.schema import RESULT_COLUMNS


def _write(df: DataFrame, path: str, fmt: str, mode: str = "overwrite") -> None:
    writer = df.write.mode(mode).format(fmt)
    (writer.option("header", True) if fmt == "csv" else writer).save(path)


def write_derived(fixes: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Scan, derive, write."""
    _write(derive_motion(fixes), path, fmt)


def result_columns(df: DataFrame) -> DataFrame:
    return df.select(*RESULT_COLUMNS)


def write_results(df: DataFrame, path: str, fmt: str = "csv") -> None:
    _write(result_columns(df), path, fmt)


def append_fixes(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    _write(df, path, fmt, mode="append")


def apply_labels(fixes: DataFrame, labels: DataFrame) -> DataFrame:
    """New snapshot of ``fixes`` with the given (id, anomaly) labels; other columns untouched.

    Of several labels for an id the last counts: by ``batch_id`` if there is one, else by row order.
    """
    new = last_of_each(labels.filter(F.col("id").isNotNull()), "id", "anomaly").withColumnRenamed("anomaly", "_label")
    return (fixes.join(new, "id", "left")
            .withColumn("anomaly", F.coalesce("_label", "anomaly")).drop("_label")
            .select(*fixes.columns))


def last_of_each(rows: DataFrame, key: str, value: str) -> DataFrame:
    """One row per key: its value of the highest ``batch_id``, and among equals of the last row."""
    batch = F.col("batch_id") if "batch_id" in rows.columns else F.lit(0)
    placed = rows.select(key, value, batch.alias("_batch"), F.monotonically_increasing_id().alias("_row"))
    return placed.groupBy(key).agg(F.max_by(value, F.struct("_batch", "_row")).alias(value))


def unknown_labels(fixes: DataFrame, labels: DataFrame) -> DataFrame:
    """Labels whose id the fact table does not have; an upsert could not insert them."""
    return labels.join(fixes.select("id"), "id", "left_anti")


def latest_labels(history: DataFrame) -> DataFrame:
    """Last label per id of an append-only (batch_id, id, anomaly) history."""
    return history.groupBy("id").agg(F.max_by("anomaly", "batch_id").alias("anomaly"))


def rewrite_labelled_days(table_path: str, labels: DataFrame, day: str = "day") -> DataFrame:
    """Upsert (day, id, anomaly) into a table partitioned by ``day``; only those days are rewritten.

    The new files are staged in the scratch folder first, so a failure leaves the table as it
    was. Returns the labels that matched nothing.
    """
    spark = labels.sparkSession
    labels = materialize(labels.select(day, "id", "anomaly"), "labels")
    table = spark.read.parquet(table_path)
    days = [r[0] for r in labels.select(day).distinct().collect()]  # one value per day
    touched = table.filter(F.col(day).isin(days))
    staged = materialize(apply_labels(touched, labels), "labelled-days")
    unknown = materialize(unknown_labels(touched, labels), "unknown-labels")
    (staged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
           .partitionBy(day).parquet(table_path))
    return unknown
