"""A store of anomaly intervals that merge: the events of a stream, without its anomalies.

An interval is a stretch of one device's anomalies inside one segment of time, none further than the event gap from
the next: start, end, how many, and sums of what events average. Two that meet become one by adding up, in any order;
an anomaly is an interval of one, and opens, joins or bridges intervals. Intervals below the least size of an event
also keep their members, of which there are fewer than that, so that labels can be corrected later.

A batch reads and writes only the segments it touches. Events are chains of intervals over segments; they are put
together when asked for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trackloom.config import DEFAULT, TrackConfig
from trackloom.functions.scalars import seconds_between
from trackloom.plans.scratch import materialize
from trackloom.streaming.segments import KEY, TrackStore, in_segments

MEANS = {"lat": "mean_lat", "lon": "mean_lon", "speed_m_s": "mean_speed", "anomaly_score": "mean_score"}
MEMBER = ["id", "device_id", "ts", "lat", "lon", "speed_m_s", "anomaly_score"]
SUMS = [f"{kind}_{c}" for c in MEANS for kind in ("sum", "n")]
SCHEMA = ("device_id bigint, start_time timestamp, end_time timestamp, n_points bigint, "
          + ", ".join(f"sum_{c} double, n_{c} bigint" for c in MEANS)
          + ", members array<struct<id:bigint,device_id:bigint,ts:timestamp,lat:double,lon:double,speed_m_s:double,anomaly_score:double>>"
          + ", kept boolean, segment bigint")
INTERVAL = ["start_time", "end_time", "n_points", *SUMS, "members"]


def points(anomalies: DataFrame, segment: Column) -> DataFrame:
    """Every anomaly as an interval of one."""
    one = {"start_time": F.col("ts"), "end_time": F.col("ts"), "n_points": F.lit(1).cast("long"),
           "members": F.array(F.struct(*MEMBER))}
    for c in MEANS:
        one |= {f"sum_{c}": F.coalesce(F.col(c).cast("double"), F.lit(0.0)), f"n_{c}": F.col(c).isNotNull().cast("long")}
    return anomalies.select("device_id", segment.alias("segment"), *[one[c].alias(c) for c in INTERVAL])


def chained(intervals: DataFrame, by: list[str], cfg: TrackConfig = DEFAULT) -> DataFrame:
    """`_chain`, from 1: which intervals of a key follow each other within the event gap."""
    along = Window.partitionBy(*by).orderBy("start_time", "end_time")
    reached = F.max("end_time").over(along.rowsBetween(Window.unboundedPreceding, -1))
    apart = reached.isNull() | (seconds_between(reached, F.col("start_time")) > cfg.event_gap_seconds)
    begun = intervals.withColumn("_apart", apart.cast("long"))
    return begun.withColumn("_chain", F.sum("_apart").over(along.rowsBetween(Window.unboundedPreceding, 0))).drop("_apart")


def merged(intervals: DataFrame, by: list[str], cfg: TrackConfig = DEFAULT) -> DataFrame:
    """One interval per chain."""
    each = chained(intervals, by, cfg)
    size = F.sum("n_points").over(Window.partitionBy(*by, "_chain"))
    each = each.withColumn("members", F.when(size < cfg.min_event_size, F.col("members")))     # only short ones are gathered
    sums = [F.sum(c).alias(c) for c in SUMS]
    return each.groupBy(*by, "_chain").agg(
        F.min("start_time").alias("start_time"), F.max("end_time").alias("end_time"), F.sum("n_points").alias("n_points"),
        *sums, F.flatten(F.collect_list("members")).alias("members"))


class IntervalStore:
    """Intervals by segment; a batch replaces all intervals of the segments that it names."""

    def __init__(self, store: TrackStore, cfg: TrackConfig = DEFAULT):
        if store.segment_seconds < cfg.event_gap_seconds:
            raise ValueError("segments must be at least as long as the event gap")
        self.store, self.cfg = store, cfg

    def current(self, spark: SparkSession, before: int | None = None, wanted: DataFrame | None = None) -> DataFrame | None:
        """The valid intervals, as of the batches before one, and of the segments whose numbers `wanted` holds."""
        limit = (1 << 62) if before is None else before
        named = self.store.earlier(spark, "rewritten", limit)
        if named is None:
            return None
        rows = self.store.earlier(spark, "intervals", limit, SCHEMA)
        if wanted is not None:
            pick = in_segments(wanted)
            rows, named = pick(rows), pick(named)
        last = named.groupBy(*KEY).agg(F.max("batch_id").alias("batch_id"))
        return rows.join(last, [*KEY, "batch_id"]).drop("batch_id")

    def replace(self, intervals: DataFrame, segments: DataFrame, batch_id: int) -> None:
        self.store.write(intervals.select(*KEY, *INTERVAL, "kept"), "intervals", batch_id, "segment")
        self.store.write(segments.select(*KEY), "rewritten", batch_id)


def add_points(intervals: IntervalStore, anomalies: DataFrame, batch_id: int) -> None:
    """New anomalies open, join or bridge intervals of their segments."""
    spark, cfg = anomalies.sparkSession, intervals.cfg
    new = points(anomalies, intervals.store.segment(F.col("ts")))
    touched = new.select(*KEY).distinct()
    old = intervals.current(spark, batch_id, touched)
    if old is not None:
        new = new.unionByName(old.drop("kept").join(touched, KEY, "left_semi"))
    whole = merged(new, KEY, cfg).withColumn("kept", F.col("n_points") >= cfg.min_event_size)
    intervals.replace(whole, touched, batch_id)


def judged(intervals: IntervalStore, anomalies: DataFrame, segments: DataFrame, batch_id: int) -> tuple[DataFrame, DataFrame]:
    """(isolated, turned): ids among `anomalies`, which are all of the given segments, that no event of the least
    size holds; and members of other segments whose label turns, with their new `anomaly`."""
    spark, cfg = anomalies.sparkSession, intervals.cfg
    reach = cfg.min_event_size - 1                     # an event is large enough after so many more anomalies
    own = merged(points(anomalies, F.col("segment")), KEY, cfg).withColumns({"kept": F.lit(None).cast("boolean"), "_own": F.lit(True)})
    around = segments.select("segment").distinct().select(F.explode(F.sequence(F.col("segment") - 2 * reach, F.col("segment") + 2 * reach)).alias("segment"))
    old = intervals.current(spark, batch_id, around)
    every = own
    if old is not None:
        every = own.unionByName(old.join(segments, KEY, "left_anti").join(segments.select("device_id").distinct(), "device_id", "left_semi").withColumn("_own", F.lit(False)), allowMissingColumns=True)
    chains = chained(every, ["device_id"], cfg)
    size = F.sum("n_points").over(Window.partitionBy("device_id", "_chain"))
    near = segments.select("device_id", F.explode(F.sequence(F.col("segment") - reach, F.col("segment") + reach)).alias("segment")).distinct()
    now = chains.withColumn("_now", size >= cfg.min_event_size)
    now = materialize(now.drop("_chain").join(near.withColumn("_near", F.lit(True)), KEY, "left"), "judged")
    # An interval at the edge of what was read may go on further out; only those near enough are judged anew.
    now = now.withColumn("_now", F.when(F.col("_own") | F.coalesce("_near", F.lit(False)), F.col("_now")).otherwise(F.col("kept")))
    isolated = now.filter("_own AND NOT _now").select(F.explode("members").alias("m")).select(F.col("m.id").alias("id"), F.lit(True).alias("_alone"))
    flips = now.filter("NOT _own AND _now <> kept")
    turned = flips.select(F.explode("members").alias("m"), F.when(F.col("_now"), -1).otherwise(1).alias("anomaly")).select("m.*", "anomaly")
    again = materialize(flips.select(*KEY).distinct(), "turned-segments")
    rewritten = segments.select(*KEY).unionByName(again)
    intervals.replace(now.join(rewritten, KEY, "left_semi").withColumn("kept", F.col("_now")), rewritten, batch_id)
    return isolated, turned


def events(intervals: DataFrame, min_size: int | None = None, cfg: TrackConfig = DEFAULT) -> DataFrame:
    """One row per event of at least ``min_size`` anomalies, numbered per device over all events."""
    smallest = cfg.min_event_size if min_size is None else min_size
    whole = chained(intervals, ["device_id"], cfg).groupBy("device_id", F.col("_chain").alias("event_id")).agg(
        F.min("start_time").alias("start_time"), F.max("end_time").alias("end_time"), F.sum("n_points").alias("n_points"), *[F.sum(c).alias(c) for c in SUMS])
    means = [(F.col(f"sum_{c}") / F.nullif(F.col(f"n_{c}"), F.lit(0))).alias(name) for c, name in MEANS.items()]
    return (whole.select("device_id", "event_id", "start_time", "end_time", "n_points", *means)
                 .withColumn("duration_seconds", seconds_between(F.col("start_time"), F.col("end_time")))
                 .filter(F.col("n_points") >= smallest))
