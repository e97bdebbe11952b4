"""Position statistics as a stream: counts that only add up, kept per group and position."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pilewright.operators.pileup import cells_of, position_stats


def streamed_position_stats(rows: DataFrame, groups: DataFrame, delay: str = "1 hour") -> DataFrame:
    """``group_id, pos, depth, matches, deletions`` over a stream of pileup rows (with ``loaded_at``) and a static table of groups.

    Redelivered rows within ``delay`` count once: the watermark bounds the row ids that are kept. Run in update or complete mode.
    """
    once = rows.filter(F.col("spec").isNotNull()).withWatermark("loaded_at", delay).dropDuplicatesWithinWatermark(["row_id"])
    named = groups.select(F.col("group_id").alias("g"), F.upper("ref_seq").alias("ref_seq"))
    joined = once.select("row_id", "group_id", "read_ord", "spec").join(named, F.col("group_id") == F.col("g")).drop("g").withColumn("spec", F.substring(F.col("spec"), F.lit(1), F.length("ref_seq")))
    left, right = F.ltrim("spec", F.lit("-")), F.rtrim("spec", F.lit("-"))
    placed = joined.withColumn("first", F.length("spec") - F.length(left)).withColumn("last", F.length(right) - 1).filter(F.length(left) > 0)
    return position_stats(cells_of(placed))
