"""Dialogues turned so that each speaker in turn is the assistant.

For every participant of a conversation, its turns are rendered in order with that speaker as the assistant
and all others as named users; only the assistant's own text is marked for the loss. System turns stay system
turns, are no participants, and are never marked.

A rendering is cut between turns into parts of about ``part_chars`` characters, so a conversation of any length
fills bounded groups; `start` says where in the whole rendering a part begins. Places come from two sums: inside
one range of sorted turns, and over the ranges of a conversation, so no task needs a whole conversation.

A null role is the speaker "unknown", a null text is empty. Turns are ordered by turn (null first), role and
text; equal turns are all kept. Null conversation ids form one conversation. A conversation of system turns
alone, or an empty table, gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import ROW, keyed, materialize

PART_CHARS = 16_384


def segments(turns: DataFrame) -> DataFrame:
    """A row per turn and perspective: head and text, `start` of the head in the whole rendering, `mask`."""
    base = keyed(turns.select(F.col("conv_id"), F.col("turn"), F.coalesce("role", F.lit("unknown")).alias("speaker"), F.coalesce("text", F.lit("")).alias("text")),
                 "conv_id", "turn", "speaker", "text")
    order = ["conv_id", "turn", "speaker", "text", ROW]
    dealt = materialize(base.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "turns")
    speakers = dealt.filter("speaker <> 'system'").select("conv_id", F.col("speaker").alias("perspective")).distinct()
    both = dealt.alias("t").join(speakers.alias("s"), F.expr("t.conv_id <=> s.conv_id")).select("t.*", "perspective")
    own = F.col("speaker") == F.col("perspective")
    head = (F.when(F.col("speaker") == "system", "<|system|>\n").when(own, "<|assistant|>\n")
             .otherwise(F.concat(F.lit("<|user:"), F.col("speaker"), F.lit("|>\n"))))
    sized = both.select("*", head.alias("head"), own.alias("mask")).withColumn("size", (F.length("head") + F.length("text") + 1).cast("long"))
    key = ["conv_id", "perspective"]
    ranges = sized.groupBy(*key, "_range").agg(F.sum("size").alias("total"))
    earlier = Window.partitionBy(*key).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)   # a row per range
    ranges = ranges.select(*key, "_range", F.coalesce(F.sum("total").over(earlier), F.lit(0)).alias("before"))
    within = Window.partitionBy("_range", *key).orderBy("turn", "speaker", "text", ROW).rowsBetween(Window.unboundedPreceding, -1)
    local = sized.withColumn("ahead", F.coalesce(F.sum("size").over(within), F.lit(0)))
    on = F.expr("l._range = r._range AND l.perspective = r.perspective AND l.conv_id <=> r.conv_id")
    return local.alias("l").join(ranges.alias("r"), on).select(
        "l.conv_id", "l.perspective", "l.turn", "l.speaker", "l.head", "l.text", "l.mask", "l.size", (F.col("before") + F.col("ahead")).alias("start"))


def render(turns: DataFrame, part_chars: int = PART_CHARS) -> DataFrame:
    """`conv_id, perspective, part, start, n_turns, text, mask`: mask lists the marked places of `text` as
    from:to, end exclusive."""
    part = F.floor(F.col("start") / part_chars)
    cut = segments(turns).groupBy("conv_id", "perspective", part.alias("part")).agg(
        F.sort_array(F.collect_list(F.struct("start", "size", "head", "text", "mask"))).alias("p"))   # about part_chars
    first = F.get("p", F.lit(0))["start"]
    marked = F.transform(F.filter("p", lambda s: s["mask"]), lambda s: F.concat_ws(
        ":", s["start"] - first + F.length(s["head"]), s["start"] - first + s["size"] - 1))
    text = F.array_join(F.transform("p", lambda s: F.concat(s["head"], s["text"], F.lit("\n"))), "")
    return cut.select("conv_id", "perspective", "part", first.alias("start"), F.size("p").cast("long").alias("n_turns"), text.alias("text"), F.concat_ws(",", marked).alias("mask"))


#: The same rows for DuckDB.
SQL = f"""
WITH base AS (
  SELECT conv_id, turn, coalesce(role, 'unknown') AS speaker, coalesce(text, '') AS text, row_number() OVER () AS r FROM conversations),
speakers AS (SELECT DISTINCT conv_id, speaker AS perspective FROM base WHERE speaker <> 'system'),
both_ AS (
  SELECT b.*, perspective, speaker = perspective AS mask,
         CASE WHEN speaker = 'system' THEN '<|system|>' || chr(10) WHEN speaker = perspective THEN '<|assistant|>' || chr(10)
              ELSE '<|user:' || speaker || '|>' || chr(10) END AS head
  FROM base b JOIN speakers s ON b.conv_id IS NOT DISTINCT FROM s.conv_id),
placed AS (
  SELECT *, length(head) + length(text) + 1 AS size,
         coalesce(sum(length(head) + length(text) + 1) OVER (PARTITION BY conv_id, perspective
           ORDER BY turn NULLS FIRST, speaker, text, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM both_),
parts AS (
  SELECT *, CAST(start // {PART_CHARS} AS BIGINT) AS part,
         min(start) OVER (PARTITION BY conv_id, perspective, start // {PART_CHARS}) AS first FROM placed)
SELECT conv_id, perspective, part, CAST(min(start) AS BIGINT) AS start, count(*) AS n_turns,
       string_agg(head || text || chr(10), '' ORDER BY start) AS text,
       coalesce(string_agg(CAST(start - first + length(head) AS BIGINT) || ':' || CAST(start - first + size - 1 AS BIGINT), ',' ORDER BY start)
                FILTER (WHERE mask), '') AS mask
FROM parts GROUP BY conv_id, perspective, part
"""
