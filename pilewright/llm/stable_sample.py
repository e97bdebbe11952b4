"""A reproducible sample that stays stable as data grows: frozen batch bottom-k."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pilewright.tables import free_name

#: Hex digits of the hash by which rows are counted before the cut is placed: 16^4 counters a batch.
PREFIX_DIGITS = 4


def salted_hash(salt: str, columns: Sequence[Column]) -> Column:
    """MD5 (hex) of the salt and the values; null and the empty string differ."""
    parts: list[Column] = [F.lit(salt)]
    for c in columns:
        parts += [F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), c.cast("string")))]
    return F.md5(F.concat_ws("\x1f", *parts))


def frozen_sample(df: DataFrame, identity: Sequence[str], batch: str, rate: float, salt: str, tie: Sequence[str] = ()) -> DataFrame:
    """Of every batch the ceil(rate * size) distinct records with the least salted hashes.

    A record is what agrees in ``identity`` (null equals null); it belongs to the first batch in which
    it arrives, and comes out once, with ``identity``, ``batch``, the ``tie`` columns of its least row in
    that batch, and ``sample_hash``. A batch's choice depends on the records of that batch alone that no
    earlier one has, so later batches add records and remove none, and neither partitioning nor row order
    matters. Equal hashes are ordered by ``identity``. Rows without a batch take no part until they come with one: whatever
    place they had, a later batch would claim some of their records or lose some to them. Empty input gives no rows; other columns are not read; a column of ``df`` named
    ``sample_hash`` is no matter unless it is one of those named here, then ours gets an underscore.

    No batch is sorted as a whole: rows are counted by batch and hash prefix, the prefix at which a batch
    reaches its size is found on the counters (at most 16^4 a batch), prefixes below it are taken whole,
    and only rows of that one prefix, 1/65,536 of a batch, are ranked.
    """
    named = df.select(*[c for c in dict.fromkeys([*identity, batch, *tie])])
    hashed = free_name(named, "sample_hash")
    keys = [F.col(f"`{c}`") for c in identity]
    named = named.filter(F.col(f"`{batch}`").isNotNull())
    first = F.struct(F.col(f"`{batch}`").alias("batch"), *[F.col(f"`{t}`").alias(f"t{i}") for i, t in enumerate(tie)])
    records = (
        named.groupBy(*[k.alias(f"i{n}") for n, k in enumerate(keys)])
        .agg(F.min(first).alias("at"))
        .withColumn("hash", salted_hash(salt, [F.col(f"i{n}") for n in range(len(keys))]))
        .withColumn("prefix", F.substring("hash", 1, PREFIX_DIGITS))
        .withColumn("batch", F.col("at.batch"))
    )
    counts = records.groupBy("batch", "prefix").agg(F.count(F.lit(1)).alias("n"))
    by_batch = Window.partitionBy("batch")
    cuts = (
        counts.withColumn("upto", F.sum("n").over(by_batch.orderBy("prefix").rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("wanted", F.ceil(F.sum("n").over(by_batch) * F.lit(rate).cast("decimal(12,10)")))
        .withColumn("missing", F.col("wanted") - (F.col("upto") - F.col("n")))
        .filter(F.col("missing") > 0)
        .select(F.col("batch").alias("c_batch"), F.col("prefix").alias("c_prefix"), F.when(F.col("missing") < F.col("n"), F.col("missing")).alias("missing"))
    )
    kept = records.join(cuts, records["batch"].eqNullSafe(cuts["c_batch"]) & (records["prefix"] == cuts["c_prefix"]))
    whole = kept.filter(F.col("missing").isNull())
    order = Window.partitionBy("batch").orderBy("hash", *[f"i{n}" for n in range(len(keys))])
    part = kept.filter(F.col("missing").isNotNull()).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= F.col("missing")).drop("rank")
    out = whole.unionByName(part)
    picked = [F.col(f"i{n}").alias(c) for n, c in enumerate(identity)]
    picked += [] if batch in identity else [F.col("batch").alias(batch)]
    picked += [F.col(f"at.t{i}").alias(t) for i, t in enumerate(tie) if t not in identity and t != batch]
    return out.select(*picked, F.col("hash").alias(hashed))
