"""Reading tracks and devices."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trackloom.config import DEFAULT, TrackConfig
from trackloom.functions.scalars import parse_utc
from trackloom.operators.clean import clean, require_columns, require_rows
from trackloom.plans.numbering import LOCAL, PART, numbered, sorted_parts
from trackloom.schema import (DEVICE_NAMES, DEVICES, FACT_NAMES, FIXES, INFERENCE_COLUMNS, OPTIONAL,
                              RAW_CSV, RAW_NAMES, REQUIRED)


def canonical(df: DataFrame) -> DataFrame:
    """Our names and types for a fact table, whatever subset of its columns is present."""
    df = df.withColumnsRenamed({k: v for k, v in FACT_NAMES.items() if k in df.columns})
    kinds = {f.name: f.dataType for f in FIXES}
    casts = {}
    for name in df.columns:
        if name not in kinds:
            continue
        if name == "ts" and isinstance(df.schema["ts"].dataType, T.StringType):
            casts[name] = parse_utc(F.col("ts"))
        else:
            casts[name] = F.col(name).cast(kinds[name])
    return df.withColumns(casts)


def with_defaults(df: DataFrame) -> DataFrame:
    """A missing label means normal."""
    if "anomaly" not in df.columns:
        return df.withColumn("anomaly", F.lit(1))
    return df.withColumn("anomaly", F.coalesce("anomaly", F.lit(1)))


def with_id(df: DataFrame) -> DataFrame:
    """A row key where the file has none: dense numbers from 1 in the order of all columns, the required ones first.
    Equal rows get numbers of their own, and reading the file again gives every row the same one."""
    if "id" in df.columns:
        return df
    first = [c for c in REQUIRED if c in df.columns]
    return numbered(df, [*first, *sorted(c for c in df.columns if c not in first)], "id", start=1)


def pick_devices(df: DataFrame, device_id: int | None = None,
                 device_ids: Iterable[int] | None = None) -> DataFrame:
    """A list of devices wins over a single one; neither means all."""
    if device_ids is not None:
        return df.filter(F.col("device_id").isin(list(device_ids)))
    return df if device_id is None else df.filter(F.col("device_id") == device_id)


def read_csv_by_name(spark: SparkSession, path: str) -> DataFrame:
    """Header CSV as text columns in file order; types are applied by name afterwards."""
    return spark.read.option("header", True).csv(path)


def load_track(spark: SparkSession, path: str, device_id: int | None = None,
               device_ids: Iterable[int] | None = None, validate: bool = True,
               fmt: str = "csv", cfg: TrackConfig = DEFAULT) -> DataFrame:
    """Track file(s): UTC times, device filter, a non-empty check and optional cleaning."""
    raw = read_csv_by_name(spark, path) if fmt == "csv" else spark.read.format(fmt).load(path)
    df = with_id(require_columns(canonical(raw)))
    df = require_rows(pick_devices(df, device_id, device_ids), 1, f"no fixes in {path}")
    return clean(df, cfg) if validate else df


def read_raw_csv(spark: SparkSession, path: str, device_id: int) -> DataFrame:
    """Raw logger file ``date_time, latitude, longitude, altitude`` of one device."""
    raw = spark.read.schema(RAW_CSV).option("header", True).csv(path)
    return ingest_raw(raw, device_id)


def ingest_raw(raw: DataFrame, device_id: int | Column) -> DataFrame:
    named = raw.withColumnsRenamed(RAW_NAMES)
    key = device_id if isinstance(device_id, Column) else F.lit(device_id)
    return named.select(parse_utc(F.col("ts")).alias("ts"), key.cast("long").alias("device_id"),
                        "lat", "lon", "alt")


def read_fixes(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Whole fact table; the scan is pruned and filtered by whatever follows."""
    return canonical(spark.read.format(fmt).load(path))


def read_devices(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    df = spark.read.format(fmt).load(path)
    df = df.withColumnsRenamed({k: v for k, v in DEVICE_NAMES.items() if k in df.columns})
    return df.select(*[F.col(f.name).cast(f.dataType) for f in DEVICES])


def read_jdbc(spark: SparkSession, url: str, table: str, key: str, lower: int, upper: int,
              partitions: int, **options: str) -> DataFrame:
    """Database table read in parallel ranges of its numeric key."""
    return (spark.read.format("jdbc")
            .options(url=url, dbtable=table, partitionColumn=key, lowerBound=lower,
                     upperBound=upper, numPartitions=partitions, **options).load())


def device_fixes(fixes: DataFrame, devices: DataFrame, device_name: str,
                 after_id: int | None = None) -> DataFrame:
    """One device's fixes in time order, optionally only those with a larger id.

    Columns the table lacks come back as null doubles; an unknown name gives no rows.
    """
    wanted = devices.filter(F.col("device_name") == device_name).select("device_id")
    rows = fixes if after_id is None else fixes.filter(F.col("id") > after_id)
    rows = rows.join(wanted, "device_id", "left_semi")
    absent = {c: F.lit(None).cast("double") for c in OPTIONAL if c not in rows.columns}
    return rows.withColumns(absent).select(*INFERENCE_COLUMNS).orderBy("ts", "id")


def prepare_for_inference(df: DataFrame) -> DataFrame:
    """Types and required columns checked, in time order, nothing removed."""
    return require_columns(canonical(df)).orderBy("ts", "id")


class PageIndex:
    """Ordered pages of a table for a viewer, however deep. The rows are written once in ranges of their order; rows
    per range, one number each, lead to the ranges that hold a page, and nothing else is read."""

    def __init__(self, df: DataFrame, *order: str):
        self.rows = sorted_parts(df, order, "pages")
        counts = {r[0]: r[1] for r in self.rows.groupBy(PART).count().collect()}     # one row per range
        self.starts, self.size = {}, 0
        for part in sorted(counts):
            self.starts[part] = self.size
            self.size += counts[part]

    def page(self, number: int, size: int) -> DataFrame:
        first, columns = number * size, [c for c in self.rows.columns if c not in (PART, LOCAL)]
        parts = sorted(self.starts)
        ends = [*(self.starts[p] for p in parts[1:]), self.size]
        held = [(p, self.starts[p]) for p, end in zip(parts, ends) if self.starts[p] < first + size and end > first]
        place, within = F.lit(None).cast("long"), F.lit(False)
        for part, start in held:
            here = (F.col(PART) == part) & F.col(LOCAL).between(first - start, first + size - 1 - start)
            place, within = F.when(F.col(PART) == part, F.col(LOCAL) + start).otherwise(place), within | here
        return self.rows.filter(within).withColumn("_place", place).orderBy("_place").select(*columns)


def page(df: DataFrame, number: int, size: int, *order: str) -> DataFrame:
    """One ordered page for a viewer; scans themselves never page. Keep a `PageIndex` to turn pages."""
    return PageIndex(df, *order).page(number, size)


# Fixed value: one line of a literal INSERT file, ('time', lat, lon, alt, device, label).
INSERT_LINE = r"^\s*\('([^']*)',\s*([^,()]*?)\s*,\s*([^,()]*?)\s*,\s*([^,()]*?)\s*,\s*([^,()]*?)\s*,\s*([^,()]*?)\s*\)\s*[,;]?\s*$"
NUMBER = r"^[-+]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][-+]?[0-9]+)?$"
WHOLE = r"^-?[0-9]+$"

REASON = "reject_reason"


def _reasons(*tests: tuple[Column, str]) -> Column:
    """The first reason whose test holds; null if none does."""
    out = F.lit(None).cast("string")
    for test, reason in reversed(tests):
        out = F.when(test, reason).otherwise(out)
    return out


def parse_insert_lines(lines: DataFrame) -> DataFrame:
    """Every line that may be a tuple, parsed, with the reason why it is none; statements and blank lines have none
    and no row either. A NULL altitude is a value."""
    part = lambda i: F.regexp_extract("value", INSERT_LINE, i)
    said = lines.filter(F.trim("value").startswith("(") | F.col("value").rlike(INSERT_LINE))
    number = lambda i: F.when(part(i).rlike(NUMBER), part(i)).try_cast("double")
    whole = lambda i, kind: F.when(part(i).rlike(WHOLE), part(i)).try_cast(kind)
    no_altitude = F.upper(part(4)) == "NULL"
    parsed = said.select("value", parse_utc(part(1)).alias("ts"), number(2).alias("lat"), number(3).alias("lon"), number(4).alias("alt"),
                         whole(5, "long").alias("device_id"), whole(6, "int").alias("anomaly"), no_altitude.alias("_none"))
    is_null = lambda c: F.col(c).isNull()
    return parsed.withColumn(REASON, _reasons(
        (~F.col("value").rlike(INSERT_LINE), "not a tuple"), (is_null("ts"), "bad time"), (is_null("lat") | is_null("lon"), "bad position"),
        (is_null("alt") & ~F.col("_none"), "bad altitude"), (is_null("device_id"), "bad device"), (is_null("anomaly"), "bad label"))).drop("_none")


def check_track(raw: DataFrame) -> DataFrame:
    """A track as text, parsed, each row with the reason why it cannot be used, or null; nothing raises or vanishes.
    A value that is missing is a null; one that is there and cannot be read is a reason."""
    named = require_columns(raw.withColumnsRenamed({k: v for k, v in FACT_NAMES.items() if k in raw.columns}))
    kinds = {f.name: f.dataType for f in FIXES}
    read, bad = {}, {}
    for name in [c for c in named.columns if c in kinds]:
        text = F.nullif(F.trim(F.col(name).cast("string")), F.lit(""))
        read[name] = parse_utc(text) if name == "ts" else text.try_cast(kinds[name])
        bad[name] = text.isNotNull() & read[name].isNull()
    others = [n for n in bad if n not in ("ts", "device_id")]
    reason = _reasons((bad["ts"], "bad time"), (read["ts"].isNull(), "no time"), (bad["device_id"], "bad device"), (read["device_id"].isNull(), "no device"),
                      *[(bad[n], f"bad {n}") for n in others])
    return named.select(*[read.get(c, F.col(c)).alias(c) for c in named.columns], reason.alias(REASON))


def split_rejects(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good rows, rejects) of a checked read; write it first if both are used."""
    return checked.filter(F.col(REASON).isNull()).drop(REASON), checked.filter(F.col(REASON).isNotNull())


def reject_counts(checked: DataFrame) -> DataFrame:
    """Rows by reason; those that are good count as ``ok``."""
    return checked.groupBy(F.coalesce(REASON, F.lit("ok")).alias("reason")).agg(F.count("*").alias("n_rows"))


def read_insert_file(spark: SparkSession, path: str) -> DataFrame:
    """Good rows of ``INSERT ... VALUES`` text, one tuple per line; `parse_insert_lines` tells what was rejected."""
    good, _ = split_rejects(parse_insert_lines(spark.read.text(path)))
    return good.drop("value")
