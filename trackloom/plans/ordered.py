"""Per-device ordered computations that survive one device holding most of the rows.

Usually every device fits one task, and all windows share ``(device_id | ts, id)``: one
exchange, one sort. A device above ``hot_device_rows`` is cut by range partitioning on
``(device_id, order...)`` into balanced pieces; windows then run per ``(device_id, piece)``:

* bounded look-back (lag, rolling frames): each piece receives copies of the few rows before it;
* unbounded look-back (running sums, run lengths, last value): each piece is summarised in
  one row, the summaries are accumulated per device and joined back on the piece key.

Both ways are exact, whatever the cut points are.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from trackloom.config import DEFAULT, TrackConfig
from trackloom.plans.scratch import materialize

PIECE = "_piece"
COPY = "_copy"
TIME_ORDER = ("ts", "id")
_WHOLE_DEVICE = -1


def is_cut(df: DataFrame) -> bool:
    return PIECE in df.columns


def keys(df: DataFrame) -> list[str]:
    return ["device_id", PIECE] if is_cut(df) else ["device_id"]


def track(df: DataFrame, order: Sequence[str] = TIME_ORDER) -> WindowSpec:
    """The one window specification of a frame."""
    return Window.partitionBy(*keys(df)).orderBy(*order)


def cut_hot_devices(df: DataFrame, cfg: TrackConfig = DEFAULT,
                    order: Sequence[str] = TIME_ORDER) -> DataFrame:
    """Add a piece number if some device is too large for one task; otherwise return df as is."""
    if is_cut(df) or df.count() <= cfg.hot_device_rows:   # fewer rows in all than make one device hot
        return df
    hot = materialize(
        df.groupBy("device_id").agg(F.count(F.lit(1)).alias("rows"))
          .filter(F.col("rows") > cfg.hot_device_rows), "hot-devices")
    found = hot.agg(F.count(F.lit(1)).alias("devices"), F.sum("rows").alias("rows")).first()
    if not found["devices"]:
        return df
    names = hot.select("device_id")
    if found["devices"] <= cfg.broadcast_rows:  # at most rows / hot_device_rows names
        names = F.broadcast(names)
    pieces = math.ceil(found["rows"] / cfg.hot_device_rows)
    cut = (df.join(names, "device_id", "left_semi")
             .repartitionByRange(pieces, "device_id", *order)
             .withColumn(PIECE, F.spark_partition_id()))
    whole = df.join(names, "device_id", "left_anti").withColumn(PIECE, F.lit(_WHOLE_DEVICE))
    return whole.unionByName(materialize(cut, "pieces"))


def forget_pieces(df: DataFrame) -> DataFrame:
    return df.drop(PIECE)


def with_lookback(df: DataFrame, rows: int, order: Sequence[str] = TIME_ORDER) -> DataFrame:
    """Give every piece copies of the ``rows`` rows that precede it in its device."""
    if not is_cut(df):
        return df
    by_piece = Window.partitionBy("device_id", PIECE)
    newest = by_piece.orderBy(*[F.desc(c) for c in order])
    tails = (df.filter(F.col(PIECE) != _WHOLE_DEVICE)
               .withColumn("_n", F.row_number().over(newest))
               .filter(F.col("_n") <= rows).drop("_n"))
    before = Window.partitionBy("device_id").orderBy(*order).rowsBetween(-rows, -1)
    payload = [c for c in df.columns if c not in ("device_id", PIECE)]
    copies = (tails
              .withColumn("_before", F.collect_list(F.struct(*payload)).over(before))
              .withColumn("_n", F.row_number().over(by_piece.orderBy(*order)))
              .filter(F.col("_n") == 1)
              .select("device_id", PIECE, F.explode("_before").alias("_row"))
              .select("device_id", PIECE, "_row.*"))
    return (df.withColumn(COPY, F.lit(False))
              .unionByName(copies.withColumn(COPY, F.lit(True))))


def drop_lookback(df: DataFrame) -> DataFrame:
    return df.filter(~F.col(COPY)).drop(COPY) if COPY in df.columns else df


def _join_carry(df: DataFrame, summary: DataFrame) -> DataFrame:
    return df.join(summary, ["device_id", PIECE], "left")


def _pieces() -> WindowSpec:
    return Window.partitionBy("device_id").orderBy(PIECE)


def running_sum(df: DataFrame, value: str, out: str,
                order: Sequence[str] = TIME_ORDER) -> DataFrame:
    """Inclusive running sum of ``value`` per device."""
    upto = track(df, order).rowsBetween(Window.unboundedPreceding, 0)
    local = df.withColumn(out, F.sum(value).over(upto))
    if not is_cut(df):
        return local
    prior = _pieces().rowsBetween(Window.unboundedPreceding, -1)
    carry = (df.groupBy("device_id", PIECE).agg(F.sum(value).alias("_total"))
               .withColumn("_carry", F.sum("_total").over(prior)).drop("_total"))
    joined = _join_carry(local, carry)
    zero = F.lit(0).cast(local.schema[out].dataType)
    return joined.withColumn(out, F.col(out) + F.coalesce("_carry", zero)).drop("_carry")


def device_rank(df: DataFrame, out: str, order: Sequence[str] = TIME_ORDER) -> DataFrame:
    """1-based position of each row within its device."""
    return running_sum(df.withColumn("_one", F.lit(1).cast("long")), "_one", out, order).drop("_one")


def device_size(df: DataFrame, out: str) -> DataFrame:
    """Number of rows of the row's device, without bringing a hot device together."""
    if not is_cut(df):
        return df.withColumn(out, F.count(F.lit(1)).over(Window.partitionBy("device_id")))
    parts = df.groupBy("device_id", PIECE).agg(F.count(F.lit(1)).alias("_part"))
    whole = Window.partitionBy("device_id")  # one row per piece
    return _join_carry(df, parts.withColumn(out, F.sum("_part").over(whole)).drop("_part"))


def local_runs(df: DataFrame, flag: Column) -> DataFrame:
    """`_flag`, the place `_rn` in the piece and the place `_break` of the last row without the flag."""
    w = track(df)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    return (df.withColumn("_flag", flag)
              .withColumn("_rn", F.row_number().over(w).cast("long"))
              .withColumn("_break", F.max(F.when(~F.col("_flag"), F.col("_rn"))).over(upto)))


def run_ends(local: DataFrame, lead: str | None = None) -> DataFrame:
    """One row per piece: its size and last break, and on request the length of the run it begins with."""
    more = [] if lead is None else [F.coalesce(F.min("_break") - 1, F.max("_rn")).alias(lead)]
    return local.groupBy("device_id", PIECE).agg(F.max("_rn").alias("_size"), F.max("_break").alias("_last_break"), *more)


def open_runs(ends: DataFrame) -> DataFrame:
    """`_carry`, the length of the run that each piece inherits. A piece without a break extends the run it
    inherits; any other restarts it."""
    counted = (ends.withColumn("_tail", F.col("_size") - F.coalesce("_last_break", F.lit(0)))
                   .withColumn("_breaks", F.count("_last_break").over(_pieces().rowsBetween(Window.unboundedPreceding, 0))))
    since = (Window.partitionBy("device_id", "_breaks").orderBy(PIECE)
             .rowsBetween(Window.unboundedPreceding, 0))
    return (counted.withColumn("_open", F.sum("_tail").over(since))
                   .withColumn("_carry", F.lag("_open").over(_pieces()))
                   .select("device_id", PIECE, "_carry"))


def run_position(df: DataFrame, flag: Column, out: str, carry: DataFrame | None = None) -> DataFrame:
    """1-based position inside the current run of rows with ``flag``; 0 outside a run. ``carry`` gives the runs
    that pieces inherit where ``df`` does not hold all pieces of its devices."""
    local = local_runs(df, flag)
    position = F.col("_rn") - F.coalesce("_break", F.lit(0).cast("long"))
    scratch = ["_flag", "_rn", "_break"]
    if is_cut(df):
        local = _join_carry(local, open_runs(run_ends(local)) if carry is None else carry)
        inherited = F.when(F.col("_break").isNull(), F.coalesce("_carry", F.lit(0))).otherwise(0)
        position = position + inherited
        scratch.append("_carry")
    return (local.withColumn(out, F.when(F.col("_flag"), position).otherwise(0).cast("long"))
                 .drop(*scratch))


def last_before(df: DataFrame, value: Column, out: str) -> DataFrame:
    """Latest non-null ``value`` strictly before the current row of the device.

    ``value`` must not decrease along the track (a timestamp), so a maximum is the latest.
    """
    earlier = track(df).rowsBetween(Window.unboundedPreceding, -1)
    local = df.withColumn("_value", value)
    result = local.withColumn(out, F.max("_value").over(earlier))
    if is_cut(df):
        prior = _pieces().rowsBetween(Window.unboundedPreceding, -1)
        carry = (local.groupBy("device_id", PIECE).agg(F.max("_value").alias("_latest"))
                      .withColumn("_carry", F.max("_latest").over(prior)).drop("_latest"))
        result = (_join_carry(result, carry)
                  .withColumn(out, F.coalesce(out, "_carry")).drop("_carry"))
    return result.drop("_value")
