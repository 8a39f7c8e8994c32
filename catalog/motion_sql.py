"""SQL twins of the motion columns, written from their definitions."""

from __future__ import annotations

from trackloom.config import DEFAULT
from trackloom.schema import feature_names


def haversine(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    return (f"2 * 6371000::DOUBLE * asin(sqrt(pow(sin(radians({lat2} - {lat1}) / 2), 2) + "
            f"cos(radians({lat1})) * cos(radians({lat2})) * pow(sin(radians({lon2} - {lon1}) / 2), 2)))")


def bearing(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    return (f"degrees(atan2(sin(radians({lon2} - {lon1})) * cos(radians({lat2})), "
            f"cos(radians({lat1})) * sin(radians({lat2})) - "
            f"sin(radians({lat1})) * cos(radians({lat2})) * cos(radians({lon2} - {lon1}))))")


def r(expression: str, places: int = 6) -> str:
    """Rounded double without negative zero, like the adapter's ``rounded``."""
    return f"round(CAST({expression} AS DOUBLE), {places}) + 0.0::DOUBLE"


W = "(PARTITION BY device_id ORDER BY ts, id)"


def stepped(source: str, name: str = "stepped") -> str:
    """dt, distance and speed from the device's previous row."""
    return f"""
{name}_lag AS (
  SELECT *, lag(ts) OVER {W} AS p_ts, lag(lat) OVER {W} AS p_lat, lag(lon) OVER {W} AS p_lon,
         lag(alt) OVER {W} AS p_alt FROM {source}),
{name}_diff AS (
  SELECT *, coalesce((epoch_us(ts) - epoch_us(p_ts)) / 1e6::DOUBLE, 0) AS dt,
         coalesce({haversine('p_lat', 'p_lon', 'lat', 'lon')}, 0) AS distance_m FROM {name}_lag),
{name} AS (
  SELECT *, CASE WHEN dt > 0 THEN distance_m / dt ELSE 0 END AS speed_m_s FROM {name}_diff)"""


def cleaned(source: str) -> str:
    return f"""
usable AS (
  SELECT * FROM {source} WHERE lat IS NOT NULL AND lon IS NOT NULL AND alt IS NOT NULL
     AND lat BETWEEN -90 AND 90 AND lon BETWEEN -180 AND 180),{stepped('usable', 'moved')},
cleaned AS (
  SELECT * EXCLUDE (p_ts, p_lat, p_lon, p_alt) FROM moved WHERE dt >= 1 AND speed_m_s <= 40)"""


def rest_of_motion(source: str) -> str:
    """Second-order columns of rows that already have dt, distance_m and speed_m_s."""
    return f"""
base AS (
  SELECT *, coalesce(lat - lag(lat) OVER {W}, 0) AS delta_lat,
         coalesce(lon - lag(lon) OVER {W}, 0) AS delta_lon,
         coalesce(alt - lag(alt) OVER {W}, 0) AS delta_alt,
         speed_m_s - lag(speed_m_s) OVER {W} AS speed_change,
         coalesce({bearing(f'lag(lat) OVER {W}', f'lag(lon) OVER {W}', 'lat', 'lon')}, 0) AS bearing_signed
  FROM {source}),
motion AS (
  SELECT *, coalesce(CASE WHEN dt > 0 THEN speed_change / dt ELSE 0 END, 0) AS acceleration,
         CASE WHEN dt > 0 THEN delta_alt / dt ELSE 0 END AS vertical_speed FROM base)"""


def features(source: str) -> str:
    """All 35 features as CTE ``featured``; ``source`` has dt, distance_m and speed_m_s."""
    rolling = []
    for k in DEFAULT.rolling_windows:
        frame = f"(PARTITION BY device_id ORDER BY ts, id ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW)"
        for prefix, col in (("acc", "acceleration"), ("speed", "speed_m_s"), ("vert_speed", "vertical_speed")):
            rolling.append(f"avg({col}) OVER {frame} AS {prefix}_mean_{k}")
            rolling.append(f"coalesce(stddev_samp({col}) OVER {frame}, 0) AS {prefix}_std_{k}")
        rolling.append(f"sum(distance_m) OVER {frame} AS distance_sum_{k}")
    ten = "(PARTITION BY device_id ORDER BY ts, id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)"
    return rest_of_motion(source) + f""",
rolled AS (
  SELECT *, {", ".join(rolling)},
         coalesce((speed_m_s - avg(speed_m_s) OVER {ten})
                  / (stddev_samp(speed_m_s) OVER {ten} + 1e-6::DOUBLE), 0) AS speed_zscore,
         CASE WHEN speed_m_s < 0.5 THEN 0 ELSE 1 END AS moving FROM motion),
islands AS (
  SELECT *, sum(moving) OVER (PARTITION BY device_id ORDER BY ts, id
                              ROWS UNBOUNDED PRECEDING) AS island FROM rolled),
runs AS (
  SELECT *, CASE WHEN moving = 1 THEN 0 ELSE
         sum(1 - moving) OVER (PARTITION BY device_id, island ORDER BY ts, id
                               ROWS UNBOUNDED PRECEDING) END AS hover_run FROM islands),
featured AS (
  SELECT *, abs(acceleration) AS acceleration_abs, abs(acceleration) AS speed_change_abs,
         abs(delta_alt) AS alt_change_abs,
         CASE WHEN hover_run * dt > 600 THEN 1 ELSE 0 END AS hover_flag,
         CASE WHEN abs(acceleration) > 2.0 OR abs(acceleration) > 1.5 THEN 1 ELSE 0 END AS burst_flag,
         hour(ts) / 24::DOUBLE AS hour_norm, (isodow(ts) - 1) / 7::DOUBLE AS day_of_week_norm,
         ln(1 + speed_m_s) AS log_speed, ln(1 + distance_m) AS log_distance FROM runs)"""


def feature_list(places: int = 6) -> str:
    return ", ".join(f"{r(c, 4 if c == 'speed_zscore' else places)} AS {c}" for c in feature_names())


EVENTS = """
bad AS (SELECT *, lag(ts) OVER (PARTITION BY device_id ORDER BY ts, id) AS previous
        FROM labelled WHERE anomaly = -1),
numbered AS (
  SELECT *, sum(CASE WHEN previous IS NULL OR epoch_us(ts) - epoch_us(previous) > 900000000
                THEN 1 ELSE 0 END) OVER (PARTITION BY device_id ORDER BY ts, id
                                         ROWS UNBOUNDED PRECEDING) AS event_id FROM bad),
sized AS (SELECT *, count(*) OVER (PARTITION BY device_id, event_id) AS event_size FROM numbered)"""
