"""The driver's tables seen as tracks, devices and models; the SQL twins read the same rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def ntz(ts: Column) -> Column:
    return ts.cast("timestamp_ntz")


def rounded(value: Column, places: int = 6) -> Column:
    """Rounded double without negative zero."""
    return F.round(value.cast("double"), places) + F.lit(0.0)


def fixes(spark: SparkSession, sf_dir: str, compressed: bool = True) -> DataFrame:
    """`events` as GPS fixes; time is divided by 200 so that intervals look like a real tracker's."""
    instant = F.col("ts").cast("timestamp")
    ts = F.timestamp_micros(F.expr("unix_micros(cast(ts as timestamp)) div 200")) if compressed else instant
    key = F.get_json_object("props", "$.k").cast("int")
    return read(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"),
        F.col("user_id").alias("device_id"),
        ts.alias("ts"),
        (F.lit(-1.2921) + F.col("value") * F.lit(5e-5)).alias("lat"),
        (F.lit(36.8219) + key * F.lit(5e-5)).alias("lon"),
        (F.lit(1800.0) + F.col("event_id") % 101).alias("alt"),
        "event_type",
        "value",
    )


FIXES_SQL = """
fixes AS (
  SELECT event_id AS id, user_id AS device_id, make_timestamp(epoch_us(ts) // 200) AS ts,
         -1.2921::DOUBLE + value * 5e-5::DOUBLE AS lat,
         36.8219::DOUBLE + CAST(json_extract_string(props, '$.k') AS INT) * 5e-5::DOUBLE AS lon,
         1800::DOUBLE + event_id % 101 AS alt, event_type, value
  FROM events)"""


def dirty_fixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixes with missing and impossible positions."""
    bad_lat = (F.when((F.col("event_type") == "error") & (F.col("id") % 10 == 0), F.lit(None))
                .when(F.col("id") % 97 == 0, F.lit(95.0)).otherwise(F.col("lat")))
    return fixes(spark, sf_dir).withColumn("lat", bad_lat)


DIRTY_SQL = FIXES_SQL + """,
dirty AS (
  SELECT id, device_id, ts,
         CASE WHEN event_type = 'error' AND id % 10 = 0 THEN NULL
              WHEN id % 97 = 0 THEN 95.0::DOUBLE ELSE lat END AS lat,
         lon, alt, event_type, value
  FROM fixes)"""


def scored_fixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixes with a score that SQL can reproduce, standing in for the forest's."""
    return fixes(spark, sf_dir).withColumn(
        "anomaly_score", F.round(-F.col("value") / F.lit(600.0), 6))


SCORED_SQL = FIXES_SQL + """,
scored AS (
  SELECT *, round(-value / 600::DOUBLE, 6) AS anomaly_score FROM fixes)"""


def devices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`customer` as the device table."""
    segment = F.col("c_mktsegment")
    return read(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("device_id"),
        F.col("c_name").alias("device_name"),
        F.when(F.col("c_acctbal") >= 0, "Active").otherwise("Inactive").alias("status"),
        F.lower(segment).alias("color_1"),
        F.format_string("shade_%d", F.col("c_nationkey")).alias("color_2"),
        F.when(segment == "HOUSEHOLD", "")
         .when(segment == "FURNITURE", F.lit(None).cast("string"))
         .otherwise(F.format_string("model_%d", F.col("c_nationkey"))).alias("if_model"),
    )


DEVICES_SQL = """
devices AS (
  SELECT c_custkey AS device_id, c_name AS device_name,
         CASE WHEN c_acctbal >= 0 THEN 'Active' ELSE 'Inactive' END AS status,
         lower(c_mktsegment) AS color_1, 'shade_' || c_nationkey AS color_2,
         CASE WHEN c_mktsegment = 'HOUSEHOLD' THEN '' WHEN c_mktsegment = 'FURNITURE' THEN NULL
              ELSE 'model_' || c_nationkey END AS if_model
  FROM customer)"""


def models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Saved models: one per nation outside region 0, and one per region that no device uses."""
    nation = read(spark, sf_dir, "nation").filter(F.col("n_regionkey") > 0)
    region = read(spark, sf_dir, "region")
    return (nation.select(F.format_string("model_%d", F.col("n_nationkey")).alias("model_name"))
                  .unionByName(region.select(F.lower("r_name").alias("model_name"))))


MODELS_SQL = """
models AS (
  SELECT 'model_' || n_nationkey AS model_name FROM nation WHERE n_regionkey > 0
  UNION ALL SELECT lower(r_name) FROM region)"""


def with_sql(*ctes: str, body: str) -> str:
    return "WITH " + ",".join(c.strip("\n") for c in ctes) + "\n" + body.strip()
