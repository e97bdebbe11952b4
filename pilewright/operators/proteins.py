"""Proteins of a group's reading frame, and how their residues differ."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pilewright.functions.codon import translate


def group_proteins(frames: DataFrame, consensus: DataFrame, groups: DataFrame) -> DataFrame:
    """group_id, ref_protein, consensus_protein, parent_protein of the groups with a reading frame.

    ``frames`` and ``consensus`` are ``reading_frames`` and the page consensus; a position at which nothing is called reads as N.
    ``parent_protein`` is null without a parent.
    """
    kept = frames.filter(F.col("focus_start").isNotNull())
    letters = consensus.filter(F.col("base").isNotNull()).groupBy(F.col("group_id").alias("g")).agg(F.map_from_entries(F.collect_list(F.struct("pos", "base"))).alias("at"))
    parents = groups.select(F.col("group_id").alias("p"), F.when(F.length("parent") > 0, F.upper("parent")).alias("parent"))
    joined = kept.join(letters, F.col("group_id") == F.col("g"), "left").join(parents, F.col("group_id") == F.col("p"))
    size = F.col("focus_end") - F.col("focus_start")
    coding = lambda c: F.substring(c, F.col("focus_start") + 1, size)
    called = F.transform(F.sequence(F.col("focus_start"), F.col("focus_end") - 1), lambda p: F.coalesce(F.try_element_at("at", p), F.lit("N")))
    return joined.select("group_id", translate(coding(F.upper("ref_seq"))).alias("ref_protein"), translate(F.array_join(called, "")).alias("consensus_protein"), translate(coding(F.col("parent"))).alias("parent_protein"))


def residue_changes(proteins: DataFrame) -> DataFrame:
    """group_id, residue (from 1), name, kind of every residue worth a tab.

    A change is named against the parent, or the reference where there is none: ``plain`` without a parent, ``expected`` if
    it is what the reference has, else ``unexpected``; ``missing`` where the reference differs from the parent and
    the consensus does not.
    """
    based = proteins.withColumn("has", F.col("parent_protein").isNotNull()).withColumn("named", F.coalesce("parent_protein", "ref_protein"))
    n = F.least(F.length("ref_protein"), F.length("consensus_protein"), F.length("named"))
    each = based.filter(n > 0).select("group_id", "has", "ref_protein", "consensus_protein", "named", F.explode(F.sequence(F.lit(1), n)).alias("residue"))
    at = lambda c: F.substring(F.col(c), F.col("residue"), F.lit(1))
    each = each.select("group_id", "residue", "has", at("named").alias("base"), at("consensus_protein").alias("seen"), at("ref_protein").alias("wanted"))
    changed, absent = F.col("base") != F.col("seen"), F.col("has") & (F.col("wanted") != F.col("base"))
    kind = F.when(~changed, "missing").when(~F.col("has"), "plain").when(F.col("seen") == F.col("wanted"), "expected").otherwise("unexpected")
    name = F.concat("base", F.col("residue").cast("string"), F.when(changed, F.col("seen")).otherwise(F.col("wanted")))
    return each.filter(changed | absent).select("group_id", "residue", name.alias("name"), kind.alias("kind"))
