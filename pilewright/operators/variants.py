"""Variants called from position statistics, and what they mean in a reading frame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pilewright.functions.codon import translate_codon
from pilewright.operators.pileup import GAP

#: Consequences from worst to mildest.
SEVERITY = ("frameshift", "nonsense", "inframe_indel", "missense", "silent", "noncoding")


def call_snvs(counted: DataFrame, min_fraction: float = 0.25, min_count: int = 2, min_depth: int = 3) -> DataFrame:
    """group_id, pos, kind, ref, alt, count, depth of every alternative base of ``counted_positions`` that passes the three floors."""
    alts = counted.filter(F.col("depth") >= min_depth).select("group_id", "pos", "depth", "ref_base", F.explode("alts").alias("alt"))
    passing = alts.filter((F.col("alt.n") >= min_count) & (F.col("alt.n") / F.col("depth") >= min_fraction))
    return passing.select("group_id", "pos", F.lit("snv").alias("kind"), F.col("ref_base").alias("ref"), F.col("alt.base").alias("alt"), F.col("alt.n").alias("count"), "depth")


def call_deletions(stats: DataFrame, runs: DataFrame, groups: DataFrame, min_fraction: float = 0.25, min_count: int = 2, min_depth: int = 3) -> DataFrame:
    """Adjacent deleted positions as one variant. Its count is of the rows whose own run covers all of it, or, where no row
    does, the least count of its positions."""
    passing = stats.filter((F.col("depth") >= min_depth) & (F.col("deletions") / F.col("depth") >= min_fraction))
    order = Window.partitionBy("group_id").orderBy("pos")
    islands = (
        passing.withColumn("island", F.col("pos") - F.row_number().over(order))
        .groupBy("group_id", "island")
        .agg(F.min("pos").alias("pos"), (F.max("pos") + 1).alias("to"), F.min("deletions").alias("least"), F.min_by("depth", "pos").alias("depth"))
        .drop("island")
    )
    # Runs are counted by their ends first: what is joined is bounded by the width of the reference, not by its depth.
    ends = runs.groupBy(F.col("group_id").alias("rg"), "start", "end").agg(F.count(F.lit(1)).alias("n"))
    whole = islands.join(ends, (F.col("group_id") == F.col("rg")) & (F.col("start") <= F.col("pos")) & (F.col("end") >= F.col("to")), "left")
    counted = whole.groupBy("group_id", "pos", "to", "least", "depth").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("whole"))
    count = F.when(F.col("whole") > 0, F.col("whole")).otherwise(F.col("least"))
    named = groups.select(F.col("group_id").alias("g"), F.upper("ref_seq").alias("ref_seq"))
    called = counted.withColumn("count", count).filter(F.col("count") >= min_count).join(named, F.col("group_id") == F.col("g"))
    return called.select("group_id", "pos", F.lit("del").alias("kind"), F.substring(F.col("ref_seq"), F.col("pos") + 1, F.col("to") - F.col("pos")).alias("ref"), F.lit("").alias("alt"), "count", "depth")


def call_insertions(evidence: DataFrame, stats: DataFrame, groups: DataFrame, min_fraction: float = 0.25, min_count: int = 2, min_depth: int = 3) -> DataFrame:
    """Insertions of the sidecar ``group_id, pos, seq, count`` that pass the floors; positions outside a reference do not count."""
    inside = groups.select(F.col("group_id").alias("g"), F.length("ref_seq").alias("ref_len"))
    kept = evidence.join(inside, F.col("group_id") == F.col("g")).filter((F.col("pos") >= 0) & (F.col("pos") < F.col("ref_len")) & (F.col("count") >= min_count)).drop("g", "ref_len")
    joined = kept.join(stats.filter(F.col("depth") >= min_depth).select("group_id", "pos", "depth"), ["group_id", "pos"]).filter(F.col("count") / F.col("depth") >= min_fraction)
    return joined.select("group_id", "pos", F.lit("ins").alias("kind"), F.lit("").alias("ref"), F.upper("seq").alias("alt"), "count", "depth")


def classify(variants: DataFrame, frames: DataFrame) -> DataFrame:
    """Adds ``consequence`` and ``effect``. ``frames``: group_id, ref_seq, focus_start, focus_end (null: no frame, '' for both).

    Only the position of a deletion is looked at, so one that goes beyond the frame is still classified.
    """
    named = frames.select(F.col("group_id").alias("g"), F.upper("ref_seq").alias("frame_seq"), F.col("focus_start").alias("fs"), F.col("focus_end").alias("fe"))
    v = variants.join(named, F.col("group_id") == F.col("g"), "left")
    offset = F.col("pos") - F.col("fs")
    residue = (F.floor(offset / 3) + 1).cast("string")
    size = F.when(F.col("kind") == "del", F.length("ref")).otherwise(F.length("alt"))
    codon_at = F.col("fs") + F.floor(offset / 3).cast("int") * 3
    within = (offset % 3).cast("int")
    was_codon = F.substring(F.col("frame_seq"), codon_at + 1, F.lit(3))
    now_codon = F.concat(F.substring(was_codon, F.lit(1), within), F.col("alt"), F.substring(was_codon, within + 2, F.lit(2)))
    v = v.withColumn("was", translate_codon(was_codon)).withColumn("now", translate_codon(now_codon))
    none, outside = F.col("fs").isNull(), (F.col("pos") < F.col("fs")) | (F.col("pos") >= F.col("fe"))
    indel, shift, cut = F.col("kind") != "snv", (size % 3) != 0, codon_at + 3 > F.col("fe")
    same, stop = F.col("was") == F.col("now"), F.col("now") == "*"
    consequence = (
        F.when(none, "").when(outside, "noncoding").when(indel & shift, "frameshift").when(indel, "inframe_indel").when(cut, "noncoding").when(same, "silent").when(stop, "nonsense").otherwise("missense")
    )
    effect = (
        F.when(none | outside, "")
        .when(indel & shift, F.concat(F.lit("frameshift at "), residue))
        .when(indel, F.concat(F.when(F.col("kind") == "del", "Δ").otherwise("+"), F.floor(size / 3).cast("string"), F.lit(" aa at "), residue))
        .when(cut, "")
        .when(same, F.concat(F.lit("silent ("), "was", residue, F.lit(")")))
        .when(stop, F.concat("was", residue, F.lit("*")))
        .otherwise(F.concat("was", residue, "now"))
    )
    return v.withColumn("consequence", consequence).withColumn("effect", effect).select(*variants.columns, "consequence", "effect")


def severity(consequence: Column) -> Column:
    """0 for the worst; what is not classified comes last."""
    return F.coalesce(*[F.when(consequence == c, F.lit(i)) for i, c in enumerate(SEVERITY)], F.lit(len(SEVERITY)))


def describe(variants: DataFrame) -> DataFrame:
    """Adds ``fraction``, ``length`` and ``label`` (A→T, Δn bp, +n bp)."""
    length = F.when(F.col("kind") == "del", F.length("ref")).when(F.col("kind") == "ins", F.length("alt")).otherwise(F.lit(1))
    label = F.when(F.col("kind") == "snv", F.concat("ref", F.lit("→"), "alt")).when(F.col("kind") == "del", F.concat(F.lit("Δ"), length.cast("string"), F.lit(" bp"))).otherwise(F.concat(F.lit("+"), length.cast("string"), F.lit(" bp")))
    return variants.withColumn("fraction", F.when(F.col("depth") > 0, F.col("count") / F.col("depth")).otherwise(F.lit(0.0))).withColumn("length", length).withColumn("label", label)


def verdicts(variants: DataFrame, groups: DataFrame) -> DataFrame:
    """group_id, verdict: the worst consequence; ``clean`` without variants, ``variant`` where none is classified."""
    worst = variants.groupBy("group_id").agg(F.min_by("consequence", severity(F.col("consequence"))).alias("worst"))
    verdict = F.when(F.col("worst").isNull(), "clean").when(F.col("worst") == "", "variant").otherwise(F.col("worst"))
    return groups.select("group_id").join(worst, "group_id", "left").select("group_id", verdict.alias("verdict"))


def variant_table(variants: DataFrame, limit: int = 50, ties: tuple[str, ...] = ("kind", "alt")) -> DataFrame:
    """The first ``limit`` variants of each group by (severity, fraction descending, pos, ``ties``), with ``rank_no`` and ``of``, how many there are."""
    order = Window.partitionBy("group_id").orderBy(severity(F.col("consequence")), F.desc("fraction"), "pos", *ties)
    counts = variants.groupBy(F.col("group_id").alias("g")).agg(F.count(F.lit(1)).alias("of"))
    top = variants.withColumn("rank_no", F.row_number().over(order)).filter(F.col("rank_no") <= limit)
    return top.join(counts, F.col("group_id").eqNullSafe(F.col("g"))).drop("g")


def lollipop_tiers(variants: DataFrame, apart: float = 11.0, tiers: int = 3, cell: float = 4.0) -> DataFrame:
    """Adds ``tier``: the lowest on which a variant's head is ``apart`` units from the one before it, else the highest.

    Variants of a group follow each other by (pos, kind, alt), at the middles of cells of ``cell`` units; a group's variants
    are bounded by its reference, not by its depth.
    """
    entry = F.struct("pos", "kind", "alt", F.struct(*variants.columns).alias("row"))
    ordered = variants.groupBy("group_id").agg(F.array_sort(F.collect_list(entry)).alias("entries")).select("entries")
    state = F.struct(F.array_repeat(F.lit(-1e9), tiers).alias("last"), F.array().cast("array<int>").alias("out"))

    def step(acc: Column, v: Column) -> Column:
        x = (v["pos"] + 0.5) * cell
        free = F.filter(F.sequence(F.lit(0), F.lit(tiers - 1)), lambda t: x - F.get(acc["last"], t) >= apart)
        tier = F.get(free, F.lit(0))
        last = F.when(tier.isNull(), acc["last"]).otherwise(F.transform(acc["last"], lambda y, t: F.when(t == tier, x).otherwise(y)))
        return F.struct(last.alias("last"), F.concat(acc["out"], F.array(F.coalesce(tier, F.lit(tiers - 1)))).alias("out"))

    found = F.aggregate("entries", state, step, lambda acc: acc["out"])
    return ordered.select(F.explode(F.arrays_zip("entries", found.alias("tiers"))).alias("e")).select("e.entries.row.*", F.col("e.tiers").alias("tier"))


def status_tier(status: Column, highlighted: Column) -> Column:
    """ok, warn, bad or neutral for a status text; null for a blank one."""
    text = F.lower(F.trim(status))
    # Words that decide, in this order.
    words = (("perfect", "ok"), ("silent", "warn"), ("missense", "bad"), ("nonsense", "bad"), ("frameshift", "bad"), ("stop", "bad"), ("mismatch", "bad"), ("match", "ok"))
    tier = F.when(status.isNull() | (text == ""), F.lit(None).cast("string"))
    for word, name in words:
        tier = tier.when(F.contains(text, F.lit(word)), name)
    return tier.otherwise(F.when(highlighted, "ok").otherwise("neutral"))
