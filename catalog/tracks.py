"""Sources, sinks, cleaning, motion and features over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.adapter import (DEVICES_SQL, DIRTY_SQL, FIXES_SQL, devices, dirty_fixes, fixes, ntz, read,
                             rounded, with_sql)
from catalog.motion_sql import (bearing, cleaned, feature_list, features, haversine, r,
                                rest_of_motion, stepped)
from catalog.registry import query
from trackloom.functions import scalars as S
from trackloom.functions.geo import bearing_deg, haversine_m
from trackloom.operators import clean as C
from trackloom.operators.features import build_features, clean_features
from trackloom.operators.motion import derive_motion, differences
from trackloom.operators.metrics import recent
from trackloom.plans.ordered import running_sum
from trackloom.plans.scratch import new_path
from trackloom.schema import FEATURES
from trackloom.sources import readers as R
from trackloom.sources import writers as Wr

POSITION = ("lat", "lon", "alt")


def _plain(df, *extra):
    """id, device, time and position, in comparable form."""
    return df.select("id", "device_id", ntz(F.col("ts")).alias("ts"),
                     *[rounded(F.col(c), 9).alias(c) for c in POSITION], *extra)


PLAIN_SQL = f"id, device_id, ts, {r('lat', 9)} AS lat, {r('lon', 9)} AS lon, {r('alt', 9)} AS alt"


# ---- sources and sinks ---------------------------------------------------------------------

def _external(df):
    """Column names of an exported fact table."""
    return df.select(F.col("id").alias("Id"), F.col("device_id").alias("Device_id"),
                     F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSSxxx").alias("Timestamp"),
                     F.col("lat").alias("Latitude"), F.col("lon").alias("Longitude"),
                     F.col("alt").alias("Altitude"))


@query(with_sql(DIRTY_SQL, cleaned("dirty"), body=f"SELECT {PLAIN_SQL} FROM cleaned"))
def load_track_csv(spark, sf_dir):
    path = new_path(spark, "track-csv")
    _external(dirty_fixes(spark, sf_dir)).write.option("header", True).csv(path)
    return _plain(R.load_track(spark, path, validate=True))


@query(with_sql(FIXES_SQL, body=f"""
SELECT ts, CAST(2 AS BIGINT) AS device_id, {r('lat', 9)} AS lat, {r('lon', 9)} AS lon,
       {r('alt', 9)} AS alt FROM fixes"""))
def ingest_raw_csv(spark, sf_dir):
    path = new_path(spark, "raw-csv")
    (fixes(spark, sf_dir).select(
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("date_time"),
        F.col("lat").alias("latitude"), F.col("lon").alias("longitude"), F.col("alt").alias("altitude"))
     .write.option("header", True).csv(path))
    return R.read_raw_csv(spark, path, 2).select(
        ntz(F.col("ts")).alias("ts"), "device_id", *[rounded(F.col(c), 9).alias(c) for c in POSITION])


@query(with_sql(FIXES_SQL, body=f"SELECT {PLAIN_SQL} FROM fixes ORDER BY id"))
def scan_fixes(spark, sf_dir):
    path = new_path(spark, "fact")
    fixes(spark, sf_dir).select("id", "device_id", "ts", *POSITION).write.parquet(path)
    return _plain(R.read_fixes(spark, path)).orderBy("id")


@query(with_sql(DEVICES_SQL, body="SELECT * FROM devices ORDER BY device_id"))
def scan_devices(spark, sf_dir):
    path = new_path(spark, "devices")
    devices(spark, sf_dir).write.parquet(path)
    return R.read_devices(spark, path).orderBy("device_id")


_HISTORY = """
SELECT id, device_id, ts, {p}, CAST(NULL AS DOUBLE) AS speed_m_s FROM fixes
WHERE device_id IN (SELECT device_id FROM devices WHERE device_name = 'Customer#000000007') {more}"""
_P9 = f"{r('lat', 9)} AS lat, {r('lon', 9)} AS lon, {r('alt', 9)} AS alt"


@query(with_sql(FIXES_SQL, DEVICES_SQL, body=_HISTORY.format(p=_P9, more="ORDER BY ts, id")))
def device_history(spark, sf_dir):
    df = R.device_fixes(fixes(spark, sf_dir), devices(spark, sf_dir), "Customer#000000007")
    return _plain(df, "speed_m_s")


@query(with_sql(FIXES_SQL, DEVICES_SQL, body=_HISTORY.format(p=_P9, more="AND id > 500 ORDER BY ts, id")))
def device_history_after_mark(spark, sf_dir):
    df = R.device_fixes(fixes(spark, sf_dir), devices(spark, sf_dir), "Customer#000000007", after_id=500)
    return _plain(df, "speed_m_s")


@query(with_sql(FIXES_SQL, DEVICES_SQL, body=_HISTORY.format(p=_P9, more="ORDER BY ts, id")))
def device_history_cached(spark, sf_dir):
    cached = fixes(spark, sf_dir).cache()
    return _plain(R.device_fixes(cached, devices(spark, sf_dir), "Customer#000000007"), "speed_m_s")


@query(with_sql(FIXES_SQL, body=f"""
SELECT device_id, ts, {r('lat')} AS lat, {r('lon')} AS lon, {r('alt')} AS alt,
       CASE WHEN event_type = 'error' THEN -1 ELSE 1 END AS anomaly FROM (
  SELECT device_id, date_trunc('second', ts) AS ts, round(lat, 7) AS lat, round(lon, 7) AS lon, alt, event_type
  FROM fixes)"""))
def insert_file_rows(spark, sf_dir):
    path = new_path(spark, "insert-text")
    rows = fixes(spark, sf_dir).select(F.format_string(
        "('%s', %.7f, %.7f, %.2f, %d, %d),",
        F.date_format(F.col("ts") + F.expr("INTERVAL 3 HOURS"), "yyyy-MM-dd HH:mm:ss'+0300'"),
        "lat", "lon", "alt", "device_id",
        F.when(F.col("event_type") == "error", -1).otherwise(1)).alias("value"))
    rows.write.text(path)
    df = R.read_insert_file(spark, path)
    return df.select("device_id", ntz(F.col("ts")).alias("ts"),
                     *[rounded(F.col(c)).alias(c) for c in POSITION], "anomaly")


# Every tenth line of each kind has a fault; the last kind has a short zone.
FAULTS_SQL = """CASE id % 10 WHEN 1 THEN 'not a tuple' WHEN 2 THEN 'bad time' WHEN 3 THEN 'bad position' WHEN 4 THEN 'bad altitude'
  WHEN 5 THEN 'bad device' WHEN 6 THEN 'bad label' ELSE 'ok' END"""


def _faulty_inserts(spark, sf_dir):
    path, kind = new_path(spark, "insert-text"), F.col("id") % 10
    or_else = lambda at, wrong, right: F.when(kind == at, wrong).otherwise(right)
    when = F.when(kind == 7, F.date_format("ts", "yyyy-MM-dd HH:mm:ss'+00'")).otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    parts = ["('", or_else(2, "yesterday", when), "', ", F.format_string("%.7f", "lat"), ", ", or_else(3, "NULL", F.format_string("%.7f", "lon")), ", ",
             or_else(4, "high", F.when(kind == 8, "NULL").otherwise(F.format_string("%.2f", "alt"))), ", ", or_else(5, "", F.col("device_id").cast("string")),
             or_else(1, "", ", "), or_else(6, "1.5", "1"), "),"]
    line = F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    head = spark.createDataFrame([("INSERT INTO facts VALUES",), ("",)], "value string")
    head.unionByName(fixes(spark, sf_dir).select(line.alias("value"))).write.text(path)
    return R.parse_insert_lines(spark.read.text(path))


@query(with_sql(FIXES_SQL, body=f"SELECT {FAULTS_SQL} AS reason, count(*) AS n_rows FROM fixes GROUP BY ALL"))
def insert_file_rejects(spark, sf_dir):
    return R.reject_counts(_faulty_inserts(spark, sf_dir))


@query(with_sql(FIXES_SQL, body=f"""
SELECT device_id, date_trunc('second', ts) AS ts, {r('lat')} AS lat, {r('lon')} AS lon,
       CASE WHEN id % 10 = 8 THEN NULL ELSE {r('alt')} END AS alt FROM fixes WHERE {FAULTS_SQL} = 'ok'"""))
def insert_file_good_rows(spark, sf_dir):
    good, _ = R.split_rejects(_faulty_inserts(spark, sf_dir))
    return good.select("device_id", ntz(F.col("ts")).alias("ts"), *[rounded(F.col(c)).alias(c) for c in POSITION])


@query(with_sql(FIXES_SQL, body="""
SELECT CASE id % 10 WHEN 1 THEN 'bad time' WHEN 2 THEN 'no time' WHEN 3 THEN 'bad device' WHEN 4 THEN 'no device' WHEN 5 THEN 'bad lat' ELSE 'ok' END AS reason,
       count(*) AS n_rows FROM fixes GROUP BY ALL"""))
def track_csv_rejects(spark, sf_dir):
    path, kind = new_path(spark, "track-csv"), F.col("id") % 10
    time = F.when(kind == 1, "31/12/24 noon").when(kind == 2, F.lit(None)).otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss'+00'"))
    device = F.when(kind == 3, "seven").when(kind == 4, F.lit(None)).otherwise(F.col("device_id").cast("string"))
    lat = F.when(kind == 5, "north").otherwise(F.col("lat").cast("string"))
    (fixes(spark, sf_dir).select(F.col("id").alias("Id"), device.alias("Device_id"), time.alias("Timestamp"), lat.alias("Latitude"),
                                 F.col("lon").alias("Longitude"), F.col("alt").alias("Altitude")).write.option("header", True).csv(path))
    return R.reject_counts(R.check_track(R.read_csv_by_name(spark, path)))


@query(with_sql(FIXES_SQL, """
rows AS (SELECT device_id, round(lat, 2) AS lat, round(lon, 2) AS lon, 0.0::DOUBLE AS alt, make_timestamp(epoch_us(ts) // 86400000000 * 86400000000) AS ts
         FROM fixes UNION ALL SELECT 1, 0.5, 0.5, 0.0, TIMESTAMP '2024-01-01 00:00:00' FROM fixes WHERE id % 7 = 0)""", body="""
SELECT CAST(row_number() OVER (ORDER BY device_id, lat, lon, alt, ts) AS BIGINT) AS id, device_id, lat, lon, ts FROM rows"""))
def keyed_track(spark, sf_dir):
    """A file without ids in which many rows are equal: each gets a number of its own."""
    day = F.timestamp_micros(F.expr("unix_micros(ts) div 86400000000 * 86400000000"))
    rows = fixes(spark, sf_dir).select("id", "device_id", F.round("lat", 2).alias("lat"), F.round("lon", 2).alias("lon"), F.lit(0.0).alias("alt"), day.alias("ts"))
    same = rows.filter("id % 7 = 0").select(F.lit(1).cast("long").alias("device_id"), F.lit(0.5).alias("lat"), F.lit(0.5).alias("lon"), "alt",
                                            F.expr("timestamp '2024-01-01 00:00:00Z'").alias("ts"))
    path = new_path(spark, "idless")
    rows.drop("id").unionByName(same).write.parquet(path)
    keyed = R.load_track(spark, path, validate=False, fmt="parquet")
    return keyed.select("id", "device_id", rounded(F.col("lat")).alias("lat"), rounded(F.col("lon")).alias("lon"), ntz(F.col("ts")).alias("ts"))


DERIVED = ("dt", "distance_m", "speed_m_s", "bearing", "acceleration")
_DERIVED_SQL = with_sql(FIXES_SQL, stepped("fixes"), rest_of_motion("stepped"), body=f"""
SELECT id, {r('dt')} AS dt, {r('delta_lat', 9)} AS delta_lat, {r('delta_lon', 9)} AS delta_lon,
       {r('delta_alt')} AS delta_alt, {r('distance_m')} AS distance_m, {r('speed_m_s')} AS speed_m_s,
       {r('bearing_signed')} AS bearing, {r('acceleration')} AS acceleration,
       {r('sum(distance_m) OVER (PARTITION BY device_id ORDER BY ts, id ROWS UNBOUNDED PRECEDING)', 4)}
         AS cumulative_distance
FROM motion""")


def _derived(df):
    return df.select("id", *[rounded(F.col(c)).alias(c) for c in (*DERIVED, "delta_alt")],
                     *[rounded(F.col(c), 9).alias(c) for c in ("delta_lat", "delta_lon")],
                     rounded(F.col("cumulative_distance"), 4).alias("cumulative_distance"))


@query(_DERIVED_SQL)
def derived_motion(spark, sf_dir):
    return _derived(derive_motion(fixes(spark, sf_dir)))


@query(_DERIVED_SQL)
def derived_table_write(spark, sf_dir):
    path = new_path(spark, "derived")
    Wr.write_derived(fixes(spark, sf_dir), path)
    return _derived(spark.read.parquet(path))


@query(with_sql(FIXES_SQL, body=f"SELECT {PLAIN_SQL} FROM fixes"))
def append_fixes(spark, sf_dir):
    path, df = new_path(spark, "appended"), fixes(spark, sf_dir)
    half = F.col("event_type").isin("error", "view")
    Wr.append_fixes(df.filter(half), path)
    Wr.append_fixes(df.filter(~half), path)
    return _plain(R.read_fixes(spark, path))


# ---- projections, filters, cleaning --------------------------------------------------------

@query(with_sql(FIXES_SQL, body="SELECT id, ts FROM fixes"))
def parse_timestamps(spark, sf_dir):
    shifted = F.date_format(F.col("ts") + F.expr("INTERVAL 3 HOURS"), "yyyy-MM-dd HH:mm:ss.SSSSSS'+03:00'")
    plain = F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS")
    text = F.when(F.col("event_type") == "view", plain).otherwise(shifted)
    return fixes(spark, sf_dir).select("id", ntz(S.parse_utc(text)).alias("ts"))


@query(with_sql(FIXES_SQL, body="""
SELECT CAST(CAST(id AS VARCHAR) AS BIGINT) AS id, CAST(CAST(device_id AS VARCHAR) AS BIGINT) AS device_id,
       CASE WHEN event_type = 'error' THEN -1 ELSE 1 END AS anomaly FROM fixes"""))
def typed_columns(spark, sf_dir):
    text = fixes(spark, sf_dir).select(
        F.col("id").cast("string").alias("Id"), F.col("device_id").cast("string").alias("Device_id"),
        F.when(F.col("event_type") == "error", "-1").otherwise("1").alias("Anomaly"))
    return R.canonical(text)


@query(with_sql(FIXES_SQL, body=f"SELECT {PLAIN_SQL} FROM fixes WHERE device_id IN (3, 5, 8)"))
def pick_device_list(spark, sf_dir):
    return _plain(R.pick_devices(fixes(spark, sf_dir), device_id=1, device_ids=[3, 5, 8]))


@query(with_sql(FIXES_SQL, body=f"SELECT {PLAIN_SQL} FROM fixes WHERE device_id = 3"))
def pick_single_device(spark, sf_dir):
    return _plain(R.pick_devices(fixes(spark, sf_dir), device_id=3))


@query(with_sql(DIRTY_SQL, body=f"""SELECT {PLAIN_SQL} FROM dirty
WHERE lat IS NOT NULL AND lon IS NOT NULL AND alt IS NOT NULL"""))
def drop_null_positions(spark, sf_dir):
    return _plain(C.drop_null_positions(dirty_fixes(spark, sf_dir)))


@query(with_sql(DIRTY_SQL, body=f"""SELECT {PLAIN_SQL} FROM dirty
WHERE lat BETWEEN -90 AND 90 AND lon BETWEEN -180 AND 180"""))
def coordinate_bounds(spark, sf_dir):
    return _plain(dirty_fixes(spark, sf_dir).filter(C.in_bounds()))


@query(with_sql(FIXES_SQL, stepped("fixes"), body=f"SELECT {PLAIN_SQL}, {r('dt')} AS dt FROM stepped WHERE dt >= 1"))
def minimum_interval(spark, sf_dir):
    return _plain(C.steps(fixes(spark, sf_dir)).filter(C.long_enough()), rounded(F.col("dt")).alias("dt"))


@query(with_sql(FIXES_SQL, stepped("fixes"), body=f"""
SELECT {PLAIN_SQL}, {r('speed_m_s')} AS speed_m_s FROM stepped WHERE speed_m_s <= 40"""))
def maximum_speed(spark, sf_dir):
    return _plain(C.steps(fixes(spark, sf_dir)).filter(C.slow_enough()),
                  rounded(F.col("speed_m_s")).alias("speed_m_s"))


@query(with_sql(DIRTY_SQL, cleaned("dirty"), body=f"""
SELECT {PLAIN_SQL}, {r('dt')} AS dt, {r('distance_m')} AS distance_m, {r('speed_m_s')} AS speed_m_s FROM cleaned"""))
def clean_track(spark, sf_dir):
    return _plain(C.clean(dirty_fixes(spark, sf_dir)),
                  *[rounded(F.col(c)).alias(c) for c in ("dt", "distance_m", "speed_m_s")])


@query(with_sql(DIRTY_SQL, cleaned("dirty"), body="""
SELECT (SELECT count(*) FROM dirty) AS input_rows,
       (SELECT count(*) FROM dirty WHERE lat IS NULL OR lon IS NULL OR alt IS NULL) AS null_position,
       (SELECT count(*) FROM dirty WHERE lat IS NOT NULL AND lon IS NOT NULL AND alt IS NOT NULL
          AND NOT (lat BETWEEN -90 AND 90 AND lon BETWEEN -180 AND 180)) AS out_of_bounds,
       (SELECT count(*) FROM moved WHERE dt < 1) AS short_interval,
       (SELECT count(*) FROM moved WHERE dt >= 1 AND speed_m_s > 40) AS too_fast,
       (SELECT count(*) FROM cleaned) AS kept_rows"""))
def quality_report(spark, sf_dir):
    return C.quality_report(dirty_fixes(spark, sf_dir))


@query(with_sql(FIXES_SQL, body="""
SELECT id, CASE WHEN event_type IN ('error', 'view', 'click') THEN 0 ELSE value END AS scrubbed FROM fixes"""))
def scrub_features(spark, sf_dir):
    kind = F.col("event_type")
    noisy = (F.when(kind == "error", F.lit(None)).when(kind == "view", F.lit(float("inf")))
              .when(kind == "click", F.lit(float("nan"))).otherwise(F.col("value")))
    return fixes(spark, sf_dir).select("id", S.finite_or_zero(noisy).alias("scrubbed"))


@query("""
SELECT event_id AS id, user_id AS device_id, ts FROM events
WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 30 DAY""")
def recent_fixes(spark, sf_dir):
    df = recent(fixes(spark, sf_dir, compressed=False), 30)
    return df.select("id", "device_id", ntz(F.col("ts")).alias("ts"))


@query(with_sql(FIXES_SQL, body=f"SELECT {PLAIN_SQL} FROM fixes ORDER BY ts, id"))
def inference_input(spark, sf_dir):
    return _plain(R.prepare_for_inference(fixes(spark, sf_dir)))


@query(with_sql(FIXES_SQL, body=f"SELECT {PLAIN_SQL} FROM fixes ORDER BY id LIMIT 1000 OFFSET 1000"))
def ordered_page(spark, sf_dir):
    return _plain(R.page(fixes(spark, sf_dir), 1, 1000, "id"))


@query(with_sql(FIXES_SQL, body=f"SELECT {PLAIN_SQL} FROM fixes ORDER BY device_id DESC, ts DESC, id DESC LIMIT 7 OFFSET (SELECT 3 * count(*) // 4 // 7 * 7 FROM fixes)"))
def deep_page(spark, sf_dir):
    """A page three quarters down, by an index that is built once."""
    back = fixes(spark, sf_dir).withColumns({"_d": -F.col("device_id"), "_t": -F.unix_micros("ts"), "_i": -F.col("id")})
    index = R.PageIndex(back, "_d", "_t", "_i")
    return _plain(index.page(3 * index.size // 4 // 7, 7))


@query(with_sql(FIXES_SQL, body=f"SELECT {PLAIN_SQL} FROM fixes ORDER BY device_id, ts, id"))
def sort_by_device_time(spark, sf_dir):
    return _plain(fixes(spark, sf_dir).orderBy("device_id", "ts", "id"))


@query(with_sql(DIRTY_SQL, body="""
SELECT id, device_id, ts, value FROM fixes UNION ALL
SELECT id, device_id, ts, CAST(NULL AS DOUBLE) FROM dirty WHERE lat IS NULL"""))
def union_history(spark, sf_dir):
    new = dirty_fixes(spark, sf_dir).filter(F.col("lat").isNull()).drop("value")
    both = fixes(spark, sf_dir).unionByName(new, allowMissingColumns=True)
    return both.select("id", "device_id", ntz(F.col("ts")).alias("ts"), "value")


# ---- scalar functions ----------------------------------------------------------------------

@query(with_sql(FIXES_SQL, body=f"""
SELECT id, {r(haversine('-1.2921::DOUBLE', '36.8219::DOUBLE', 'lat', 'lon'))} AS distance_m,
       {r(haversine('lat', 'lon', 'lat', 'lon'))} AS zero_m FROM fixes"""))
def haversine_distance(spark, sf_dir):
    lat, lon = F.lit(-1.2921), F.lit(36.8219)
    return fixes(spark, sf_dir).select("id", rounded(haversine_m(lat, lon, F.col("lat"), F.col("lon"))).alias("distance_m"),
                     rounded(haversine_m(F.col("lat"), F.col("lon"), F.col("lat"), F.col("lon"))).alias("zero_m"))


@query(with_sql(FIXES_SQL, body=f"""
SELECT id, {r('(' + bearing('-1.29::DOUBLE', '36.8243::DOUBLE', 'lat', 'lon') + ' + 360) % 360')} AS bearing,
       {r(bearing('-1.29::DOUBLE', '36.8243::DOUBLE', 'lat', 'lon'))} AS bearing_signed FROM fixes"""))
def bearing_from_point(spark, sf_dir):
    lat, lon = F.lit(-1.29), F.lit(36.8243)
    to = F.col("lat"), F.col("lon")
    return fixes(spark, sf_dir).select("id", rounded(bearing_deg(lat, lon, *to)).alias("bearing"),
                                       rounded(bearing_deg(lat, lon, *to, signed=True)).alias("bearing_signed"))


@query("""
SELECT event_id AS id, CAST(hour(ts) AS BIGINT) AS hour, CAST(isodow(ts) - 1 AS BIGINT) AS day_of_week,
       round(hour(ts) / 24::DOUBLE, 6) AS hour_norm, round((isodow(ts) - 1) / 7::DOUBLE, 6) AS day_of_week_norm
FROM events""")
def time_features(spark, sf_dir):
    ts = F.col("ts")
    hour, day = S.utc_hour(ts).cast("long"), S.monday_zero_weekday(ts).cast("long")
    return fixes(spark, sf_dir, compressed=False).select(
        "id", hour.alias("hour"), day.alias("day_of_week"), F.round(hour / F.lit(24.0), 6).alias("hour_norm"),
        F.round(day / F.lit(7.0), 6).alias("day_of_week_norm"))


@query(with_sql(FIXES_SQL, body=f"""
SELECT id, {r('CASE WHEN id % 101 > 50 THEN value / (id % 101 - 50) ELSE 0 END', 9)} AS guarded,
       {r('abs(value - 300)')} AS magnitude, {r('ln(1 + value)')} AS logged,
       CAST(CASE WHEN value / 100 > 2.0 OR value / 200 > 1.5 THEN 1 ELSE 0 END AS INT) AS burst FROM fixes"""))
def scalar_functions(spark, sf_dir):
    value, dt = F.col("value"), F.col("alt") - F.lit(1850.0)
    return fixes(spark, sf_dir).select(
        "id", rounded(S.ratio_or_zero(value, dt), 9).alias("guarded"),
        rounded(F.abs(value - 300)).alias("magnitude"), rounded(F.log1p(value)).alias("logged"),
        S.burst_flag(value / 100, value / 200).alias("burst"))


# ---- windows and features ------------------------------------------------------------------

@query(with_sql(FIXES_SQL, stepped("fixes"), body=f"""
SELECT id, {r('dt')} AS dt, {r('distance_m')} AS distance_m, {r('speed_m_s')} AS speed_m_s FROM stepped"""))
def track_steps(spark, sf_dir):
    df = C.steps(fixes(spark, sf_dir))
    return df.select("id", *[rounded(F.col(c)).alias(c) for c in ("dt", "distance_m", "speed_m_s")])


@query(with_sql(FIXES_SQL, stepped("fixes"), rest_of_motion("stepped"), body=f"""
SELECT id, {r('delta_lat', 9)} AS delta_lat, {r('delta_lon', 9)} AS delta_lon, {r('delta_alt')} AS delta_alt,
       {r('(bearing_signed + 360) % 360')} AS bearing, {r('speed_change')} AS speed_change,
       {r('acceleration')} AS acceleration, {r('vertical_speed')} AS vertical_speed FROM motion"""))
def track_differences(spark, sf_dir):
    df = differences(fixes(spark, sf_dir))
    return df.select("id", *[rounded(F.col(c), 9).alias(c) for c in ("delta_lat", "delta_lon")],
                     *[rounded(F.col(c)).alias(c) for c in (
                         "delta_alt", "bearing", "speed_change", "acceleration", "vertical_speed")])


@query(with_sql(FIXES_SQL, stepped("fixes"), body=f"""
SELECT id, {r('sum(distance_m) OVER (PARTITION BY device_id ORDER BY ts, id ROWS UNBOUNDED PRECEDING)', 4)}
  AS cumulative_distance FROM stepped"""))
def cumulative_distance(spark, sf_dir):
    df = running_sum(C.steps(fixes(spark, sf_dir)), "distance_m", "cumulative_distance")
    return df.select("id", rounded(F.col("cumulative_distance"), 4).alias("cumulative_distance"))


def _feature_rows(df, *extra):
    return df.select("id", *[rounded(F.col(c), 4 if c == "speed_zscore" else 6).alias(c) for c in FEATURES], *extra)


@query(with_sql(FIXES_SQL, stepped("fixes"), features("stepped"), body=f"SELECT id, {feature_list()} FROM featured"))
def model_features(spark, sf_dir):
    return _feature_rows(build_features(fixes(spark, sf_dir)))


@query(with_sql(DIRTY_SQL, cleaned("dirty"), features("cleaned"), body=f"SELECT id, {feature_list()} FROM featured"))
def cleaned_model_features(spark, sf_dir):
    return _feature_rows(clean_features(dirty_fixes(spark, sf_dir)))


@query(with_sql(FIXES_SQL, stepped("fixes"), features("stepped"), body=f"SELECT id, {feature_list()} FROM featured"))
def model_features_from_stored(spark, sf_dir):
    """Stored motion columns are kept when complete, recomputed when any value is missing."""
    stored = derive_motion(fixes(spark, sf_dir))
    gappy = stored.withColumn("speed_m_s", F.when(F.col("event_type") != "error", F.col("speed_m_s")))
    return _feature_rows(build_features(gappy, derive="if_any_null"))


@query(with_sql(FIXES_SQL, stepped("fixes"), features("stepped"), body=f"""
SELECT id, CAST(hover_run AS BIGINT) AS hover_run, {r('hover_run * dt')} AS hover_duration,
       CAST(hover_flag AS INT) AS hover_flag FROM featured"""))
def hover_runs(spark, sf_dir):
    df = build_features(fixes(spark, sf_dir))
    return df.select("id", "hover_run", rounded(F.col("hover_duration")).alias("hover_duration"),
                     F.col("hover_flag").cast("int").alias("hover_flag"))
