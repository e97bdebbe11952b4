"""Top N items within every group, by SQL windows that the optimiser limits per group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pilewright.tables import free_name


def top_n_per_group(df: DataFrame, groups: Sequence[str], order: Sequence[Column], identity: Sequence[str], n: int, rank: str = "rank_no") -> DataFrame:
    """The first ``n`` distinct items of each group by ``order``, then by ``identity``, ranked from 1.

    Two windows over one shuffle. The rank over (order, identity) is dense, so that redelivered copies of
    an item share it and ``n`` distinct items stay whatever the number of copies; the optimiser turns its
    filter into group limits before and after the shuffle, and a group of any size leaves a map task with
    its n best items only. ``row_number`` with a second filter, in the same partitioning, then keeps one
    copy of each item: the one whose columns as a whole have the least hash, whatever the partitioning.

    Null group keys form one group; nulls in ``order`` stand as that column says (Spark: first when
    ascending); ties are broken by ``identity``, ascending, nulls first. Rows that agree in groups, order
    and identity are copies: one is kept. Empty input gives no rows. ``rank`` gets underscores before
    it if ``df`` has such a column.
    """
    rank, copy = free_name(df, rank), free_name(df, "copy_no")
    keys = [df[g] for g in groups]
    best = df.withColumn(rank, F.dense_rank().over(Window.partitionBy(*keys).orderBy(*order, *[df[c].asc() for c in identity]))).filter(F.col(rank) <= n)
    copies = Window.partitionBy(*[best[g] for g in groups], F.col(rank)).orderBy(*[best[c].asc() for c in identity], F.xxhash64(*[best[c] for c, kind in df.dtypes if "map<" not in kind]))
    return best.withColumn(copy, F.row_number().over(copies)).filter(F.col(copy) <= 1).drop(copy)
