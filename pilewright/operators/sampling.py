"""Draws of at most k reads, the same for every partitioning."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def lot(seed: int) -> F.Column:
    """The MD5 by which reads are drawn: uniform over (file, ord), fixed by ``seed``."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), "file", F.col("ord").cast("string")))


def draw_pooled(reads: DataFrame, k: int | None, seed: int = 0) -> DataFrame:
    """At most ``k`` reads of all files, in their order of (file, ord); all of them if ``k`` is 0 or None, none if negative."""
    if not k:
        return reads
    if k < 0:
        return reads.limit(0)
    return reads.withColumn("lot", lot(seed)).orderBy("lot", "file", "ord").limit(k).drop("lot")


def draw_per_file(reads: DataFrame, k: int | None, seed: int = 0) -> DataFrame:
    """At most ``k`` reads of each file, with ``seen``, the number that the file has."""
    seen = reads.groupBy(F.col("file").alias("f")).agg(F.count(F.lit(1)).alias("seen"))
    kept = reads
    if k and k > 0:
        order = Window.partitionBy("file").orderBy(lot(seed), "ord")
        kept = reads.withColumn("drawn", F.row_number().over(order)).filter(F.col("drawn") <= k).drop("drawn")
    elif k:
        kept = reads.limit(0)
    return kept.join(seen, F.col("file") == F.col("f")).drop("f")
