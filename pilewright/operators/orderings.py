"""Orders in which rows are drawn. Each adds ``place``, from 1, within a group; ties keep arrival order."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pilewright.functions.scales import window_bounds
from pilewright.operators.clustering import cluster_order
from pilewright.operators.pileup import GAP


def extents(placed: DataFrame) -> DataFrame:
    """row_id, group_id, read_ord, called (bases), first (covered position; the reference's length for an empty row)."""
    gaps = F.length("spec") - F.length(F.replace(F.col("spec"), F.lit(GAP), F.lit("")))
    return placed.select("row_id", "group_id", "read_ord", (F.length("spec") - gaps).alias("called"), F.coalesce("first", F.length("spec")).alias("first"))


def _placed(df: DataFrame, *order) -> DataFrame:
    return df.select("row_id", "group_id", F.row_number().over(Window.partitionBy("group_id").orderBy(*order, "read_ord", "row_id")).alias("place"))


def by_length(placed: DataFrame) -> DataFrame:
    """Most called bases first, then leftmost."""
    return _placed(extents(placed), F.desc("called"), "first")


def by_position(placed: DataFrame) -> DataFrame:
    """Leftmost first, then most called bases."""
    return _placed(extents(placed), "first", F.desc("called"))


def by_mismatch(placed: DataFrame) -> DataFrame:
    """By the row's text with ``.`` for matches and gaps, so that equal patterns stand together."""
    pattern = F.translate(F.upper("spec"), GAP, ".")
    return _placed(placed.withColumn("pattern", pattern), "pattern")


def by_cluster(placed: DataFrame) -> DataFrame:
    """By hierarchical clustering of shared differences."""
    return cluster_order(placed)


ORDERINGS: dict[str, Callable[[DataFrame], DataFrame]] = {"length": by_length, "position": by_position, "mismatch": by_mismatch, "cluster": by_cluster}


def variant_windows(top: DataFrame, groups: DataFrame, most: int, columns: int) -> DataFrame:
    """group_id, window_no, start, end: ``columns`` around each of a group's foremost variants (``rank_no`` up to ``most``)."""
    length = groups.select(F.col("group_id").alias("g"), F.length("ref_seq").alias("n"))
    start, end = window_bounds(F.col("pos"), F.col("n"), columns)
    return top.filter(F.col("rank_no") <= most).join(length, F.col("group_id") == F.col("g")).select("group_id", F.col("rank_no").alias("window_no"), start.alias("start"), end.alias("end"))


def interesting_first(placed: DataFrame, windows: DataFrame, limit: int | None = None) -> DataFrame:
    """Rows of windows (group_id, window_no, start, end): most disagreements first, then most covered, then arrival.

    Adds ``place`` and the numbers; with ``limit`` only the first rows of a window stay. What a row has in a window is read off its
    text: cells are neither exploded nor shuffled.
    """
    w = windows.select(F.col("group_id").alias("wg"), "window_no", F.col("start").alias("ws"), F.col("end").alias("we"))
    inside = placed.join(w, F.col("group_id") == F.col("wg"))
    letters = lambda c: F.split(F.upper(F.substring(F.col(c), F.col("ws") + 1, F.col("we") - F.col("ws"))), "")
    differ = F.zip_with(letters("spec"), letters("ref_seq"), lambda x, y: (x != ".") & (x != GAP) & (x != y))
    called = F.length(F.replace(F.substring(F.col("spec"), F.col("ws") + 1, F.col("we") - F.col("ws")), F.lit(GAP), F.lit("")))
    rated = inside.select("group_id", "window_no", "row_id", "read_ord", F.size(F.filter(differ, lambda x: x)).cast("bigint").alias("disagreements"), called.cast("bigint").alias("covered"))
    order = Window.partitionBy("group_id", "window_no").orderBy(F.desc("disagreements"), F.desc("covered"), "read_ord", "row_id")
    out = rated.withColumn("place", F.row_number().over(order))
    return (out if limit is None else out.filter(F.col("place") <= limit)).drop("read_ord")
