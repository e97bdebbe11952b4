"""Annotations of a reference: which are kept, where they lie, and how they are laid out."""

from __future__ import annotations

import bisect
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Feature types that are left out unless asked for.
SKIPPED_TYPES = ("source", "primer_bind")
#: Types that are kept first, second and third when lanes run out; all others come last.
TYPE_TIERS = (("cds", "orf", "gene", "mat_peptide", "sig_peptide", "insert"), ("promoter", "regulatory", "enhancer", "terminator", "polya_signal", "rep_origin", "oric"), ("rbs", "5'utr", "3'utr"))


def once(features: DataFrame) -> DataFrame:
    """Features without redelivered rows."""
    return features.drop("loaded_at").dropDuplicates(["feature_id"])


def kept_features(features: DataFrame, skip: Sequence[str] = SKIPPED_TYPES) -> DataFrame:
    """Features without the skipped types, and without genes whose exact span a CDS of the construct has."""
    kept = features.filter(~F.coalesce(F.col("type").isin(*skip), F.lit(False))) if skip else features
    coding = kept.filter(F.col("type") == "CDS").select(F.col("construct_id").alias("c"), F.col("span_start").alias("s"), F.col("span_end").alias("e")).distinct()
    same = (F.col("type") == "gene") & (F.col("construct_id") == F.col("c")) & (F.col("span_start") == F.col("s")) & (F.col("span_end") == F.col("e"))
    return kept.join(coding, same, "left_anti")


def wraps(start: Column, end: Column, flagged: Column) -> Column:
    return F.coalesce(flagged, F.lit(False)) | (start > end)


def feature_spans(features: DataFrame, constructs: DataFrame) -> DataFrame:
    """feature_id, construct_id, piece, start, end: one clipped span, or two for a feature across the origin; none outside."""
    lengths = constructs.select(F.col("construct_id").alias("c"), F.length("seq").alias("ref_len"))
    f = features.join(lengths, F.col("construct_id") == F.col("c"))
    whole = F.array(F.struct(F.col("span_start").alias("s"), F.col("span_end").alias("e")))
    halves = F.array(F.struct(F.col("span_start").alias("s"), F.col("ref_len").alias("e")), F.struct(F.lit(0).alias("s"), F.col("span_end").alias("e")))
    parts = f.select("feature_id", "construct_id", "ref_len", F.posexplode(F.when(wraps(F.col("span_start"), F.col("span_end"), F.col("wraps_origin")), halves).otherwise(whole)).alias("piece", "span"))
    start, end = F.greatest(F.lit(0), "span.s"), F.least(F.col("ref_len"), "span.e")
    return parts.select("feature_id", "construct_id", "piece", start.alias("start"), end.alias("end")).filter(F.col("end") > F.col("start"))


def features_at(spans: DataFrame, positions: DataFrame, bin_size: int = 64) -> DataFrame:
    """construct_id, pos, feature_id of every feature over a position: a range join by equality of bins."""
    binned = spans.withColumn("bin", F.explode(F.sequence(F.floor(F.col("start") / bin_size), F.floor((F.col("end") - 1) / bin_size))))
    at = positions.select(F.col("construct_id").alias("c"), "pos", F.floor(F.col("pos") / bin_size).alias("b"))
    over = (F.col("construct_id") == F.col("c")) & (F.col("bin") == F.col("b")) & (F.col("start") <= F.col("pos")) & (F.col("pos") < F.col("end"))
    return binned.join(at, over).select("construct_id", "pos", "feature_id").distinct()


def first_of_type(features: DataFrame, kind: str) -> DataFrame:
    """The first feature of a type of each construct."""
    order = Window.partitionBy("construct_id").orderBy("feature_ord", "feature_id")
    return features.filter(F.col("type") == kind).withColumn("n", F.row_number().over(order)).filter(F.col("n") == 1).drop("n")


def flank_lengths(features: DataFrame, constructs: DataFrame, insert_type: str = "insert") -> DataFrame:
    """construct_id, five, three: bases before and after the first feature of a type; none for one across the origin."""
    lengths = constructs.select(F.col("construct_id").alias("c"), F.length("seq").alias("ref_len"))
    f = first_of_type(features, insert_type).filter(~wraps(F.col("span_start"), F.col("span_end"), F.col("wraps_origin"))).join(lengths, F.col("construct_id") == F.col("c"))
    return f.select("construct_id", F.greatest(F.lit(0), "span_start").alias("five"), F.greatest(F.lit(0), F.col("ref_len") - F.col("span_end")).alias("three"))


def focus_flanks(features: DataFrame, constructs: DataFrame, label: str) -> DataFrame:
    """construct_id, five, three around the first feature whose label contains ``label`` or whose type is it (any case).

    None where that feature crosses the origin or spans the whole construct.
    """
    lengths = constructs.select(F.col("construct_id").alias("c"), F.length("seq").alias("ref_len"))
    wanted = F.contains(F.lower(F.coalesce("label", F.lit(""))), F.lit(label.lower())) | (F.lower("type") == label.lower())
    order = Window.partitionBy("construct_id").orderBy("feature_ord", "feature_id")
    first = features.filter(wanted).withColumn("n", F.row_number().over(order)).filter(F.col("n") == 1)
    f = first.join(lengths, F.col("construct_id") == F.col("c")).filter(~wraps(F.col("span_start"), F.col("span_end"), F.col("wraps_origin")))
    out = f.select("construct_id", F.greatest(F.lit(0), "span_start").alias("five"), F.greatest(F.lit(0), F.col("ref_len") - F.col("span_end")).alias("three"))
    return out.filter((F.col("five") > 0) | (F.col("three") > 0))


def region_spans(flanks: DataFrame, constructs: DataFrame) -> DataFrame:
    """construct_id, region, start, end of the blocks before, in and after the insert; empty ones are left out."""
    lengths = constructs.select(F.col("construct_id").alias("c"), F.length("seq").alias("ref_len"))
    f = flanks.join(lengths, F.col("construct_id") == F.col("c")).filter((F.col("five") > 0) | (F.col("three") > 0))
    right = F.col("ref_len") - F.col("three")
    blocks = F.array(*[F.struct(F.lit(n).alias("region"), a.alias("start"), z.alias("end")) for n, a, z in (("five", F.lit(0), F.col("five")), ("insert", F.col("five"), right), ("three", right, F.col("ref_len")))])
    return f.select("construct_id", F.explode(blocks).alias("b")).select("construct_id", "b.*").filter(F.col("end") > F.col("start"))


def reading_frames(features: DataFrame, groups: DataFrame) -> DataFrame:
    """group_id, ref_seq, focus_start, focus_end: the part of the construct's first CDS that the group covers, if three or longer."""
    coding = first_of_type(features, "CDS").filter(~wraps(F.col("span_start"), F.col("span_end"), F.col("wraps_origin"))).select(F.col("construct_id").alias("c"), "span_start", "span_end")
    g = groups.select("group_id", "construct_id", "ref_seq", "ref_start").join(coding, F.col("construct_id") == F.col("c"), "left")
    start = F.greatest(F.lit(0), F.col("span_start") - F.col("ref_start"))
    end = F.least(F.length("ref_seq"), F.col("span_end") - F.col("ref_start"))
    inside = F.col("c").isNotNull() & (end - start >= 3)
    return g.select("group_id", "ref_seq", F.when(inside, start).alias("focus_start"), F.when(inside, end).alias("focus_end"))


def _priority(kind: str | None) -> int:
    name = (kind or "").strip().lower()
    return next((i for i, tier in enumerate(TYPE_TIERS) if name in tier), len(TYPE_TIERS))


def plan_lanes(pieces: pd.DataFrame, max_lanes: int = 3, gap: float = 0.75) -> pd.DataFrame:
    """Lanes (from 0) of one construct's features, -1 for those that have no room.

    ``pieces``: feature_id, type, start, end. Features are offered by type, then width, then place, and kept while a
    first-fit packing of the kept ones needs no more than ``max_lanes``; ``gap`` bases stay free between neighbours.
    """
    by_feature = {k: (g["type"].iloc[0], sorted(zip(g["start"], g["end"]))) for k, g in pieces.groupby("feature_id", sort=True)}

    def pack(ids: list[int]) -> dict[int, int]:
        lanes: list[list[tuple[float, float]]] = []  # of each lane the spans, apart from each other, in order
        out = {}
        for i in sorted(ids, key=lambda i: (by_feature[i][1][0][0], -sum(e - s for s, e in by_feature[i][1]), i)):
            spans = by_feature[i][1]
            lane = next((k for k, used in enumerate(lanes) if all(is_free(used, s, e) for s, e in spans)), len(lanes))
            if lane == len(lanes):
                lanes.append([])
            for span in spans:
                bisect.insort(lanes[lane], span)
            out[i] = lane
        return out

    def is_free(used: list[tuple[float, float]], start: float, end: float) -> bool:
        at = bisect.bisect(used, (start, end))
        return (at == 0 or used[at - 1][1] + gap <= start) and (at == len(used) or end + gap <= used[at][0])

    kept = list(by_feature)
    if len(set(pack(kept).values())) > max_lanes:
        kept = []
        for i in sorted(by_feature, key=lambda i: (_priority(by_feature[i][0]), -sum(e - s for s, e in by_feature[i][1]), by_feature[i][1][0][0], i)):
            if max(pack([*kept, i]).values()) < max_lanes:
                kept.append(i)
    lanes = pack(kept)
    return pd.DataFrame({"feature_id": list(by_feature), "lane": [lanes.get(i, -1) for i in by_feature]})


def track_plan(features: DataFrame, constructs: DataFrame, max_lanes: int = 3) -> DataFrame:
    """construct_id, feature_id, lane of the drawn track of every construct; -1: left out for want of room."""
    spans = feature_spans(features, constructs).join(features.select(F.col("feature_id").alias("f"), "type"), F.col("feature_id") == F.col("f")).select("construct_id", "feature_id", "type", "start", "end")

    def lay(group: pd.DataFrame) -> pd.DataFrame:
        out = plan_lanes(group, max_lanes)
        out.insert(0, "construct_id", group["construct_id"].iloc[0])
        return out

    return spans.groupBy("construct_id").applyInPandas(lay, "construct_id bigint, feature_id bigint, lane bigint")


def widest_piece(spans: DataFrame) -> DataFrame:
    """feature_id, piece: the widest piece of each feature, which has its label."""
    order = Window.partitionBy("feature_id").orderBy(F.desc(F.col("end") - F.col("start")), "piece")
    return spans.withColumn("n", F.row_number().over(order)).filter(F.col("n") == 1).select("feature_id", "piece")


def place_labels(drawn: DataFrame, ref_len: Column, advance: float = 5.2, cell: float = 4.0, inset: float = 4.0, outset: float = 5.0) -> DataFrame:
    """Adds ``label_place`` to the drawn pieces (construct_id, feature_id, piece, lane, start, end, label): ``in``, ``after`` or ``none``.

    A label stands on its feature's widest piece, inside if there is room, else after it if the next piece of the lane, or the
    end of the reference, is far enough. A character is ``advance`` wide, a base ``cell``.
    """
    lane = Window.partitionBy("construct_id", "lane").orderBy("start", "end", "feature_id", "piece")
    feature = Window.partitionBy("construct_id", "feature_id").orderBy(F.desc(F.col("end") - F.col("start")), "piece")
    text = F.length("label") * advance
    room = (F.coalesce(F.lead("start").over(lane), ref_len) - F.col("end")) * cell - outset
    place = F.when(F.row_number().over(feature) > 1, "none").when(text + 2 * inset <= (F.col("end") - F.col("start")) * cell, "in").when(room >= text, "after").otherwise("none")
    return drawn.withColumn("label_place", place)


def dropped_names(lanes: DataFrame, features: DataFrame) -> DataFrame:
    """construct_id, dropped, names: how many features had no room, and their distinct labels (or types), sorted."""
    named = features.select(F.col("feature_id").alias("f"), F.coalesce(F.when(F.col("label") != "", F.col("label")), "type").alias("label"))
    left_out = lanes.filter(F.col("lane") < 0).join(named, F.col("feature_id") == F.col("f"))
    return left_out.groupBy("construct_id").agg(F.count(F.lit(1)).alias("dropped"), F.array_join(F.array_sort(F.collect_set("label")), ", ").alias("names"))
