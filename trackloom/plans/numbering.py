"""Exact row numbers over any number of rows, without bringing a table or a hot key into one task.

Rows are dealt out by ranges of their order, so that a key with many rows spreads over several parts. A part
numbers its own rows as it sorts them; one row per part (or per key and part) carries the counts of the parts
before it. Rows that are equal in the whole order are told apart by an occurrence number, so that their number
depends on nothing but how many there are.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trackloom.plans.scratch import materialize

PART, LOCAL, TIE = "_part", "_local", "_tie"


def sorted_parts(df: DataFrame, order: Sequence[str], label: str) -> DataFrame:
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = (df.withColumn(TIE, F.monotonically_increasing_id())
               .repartitionByRange(parts, *order, TIE).sortWithinPartitions(*order, TIE))
    # The lower 33 bits of this function count the rows of the task that it runs in.
    local = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    return materialize(dealt.drop(TIE).withColumns({PART: F.spark_partition_id(), LOCAL: local}), label)


def numbered(df: DataFrame, order: Sequence[str], out: str, start: int = 0) -> DataFrame:
    """Dense numbers from `start` over all rows in `order`, nulls first. Where the order names every column, the
    same rows get the same numbers however the table is laid out."""
    rows = sorted_parts(df, order, "numbered")
    before = Window.orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)      # one row per part
    base = (rows.groupBy(PART).agg(F.count("*").alias("_n"))
                .select(PART, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base")))
    return (rows.join(F.broadcast(base), PART)
                .withColumn(out, F.col("_base") + F.col(LOCAL) + F.lit(start)).drop(PART, LOCAL, "_base"))


def positions(df: DataFrame, key: str, order: Sequence[str], out: str, start: int = 0) -> DataFrame:
    """Dense numbers from `start` inside each `key`, in `order`, nulls first; rows of a null key are one key."""
    rows = sorted_parts(df, [key, *order], "positions")
    before = Window.partitionBy(key).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    base = (rows.groupBy(key, PART).agg(F.min(LOCAL).alias("_first"), F.count("*").alias("_n"))
                .select(F.col(key).alias("_key"), F.col(PART).alias("_in"),
                        (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_base")))
    same = (F.col(PART) == F.col("_in")) & F.col(key).eqNullSafe(F.col("_key"))
    return (rows.join(base, same).withColumn(out, F.col("_base") + F.col(LOCAL) + F.lit(start))
                .drop(PART, LOCAL, "_base", "_key", "_in"))
