"""Pileup rows in long form and the statistics of positions.

A row's spec is as wide as its group's reference: ``.`` is the reference base, a letter a called base, ``-``
between the first and last called base a deletion, outside them no coverage. Cells exist for covered
positions only, so the number of rows that cross a shuffle after partial aggregation is groups x
positions x alphabet, whatever the depth.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pilewright.functions.scales import mismatch_level

GAP = "-"


def placed_rows(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """One row per distinct row_id with a non-null spec, with its reference and the covered span ``[first, last]``.

    ``first`` is null for a row that called nothing. Columns: row_id, group_id, construct_id, read_ord, spec, ref_seq
    (upper case), ref_len, first, last.
    """
    once = rows.select("row_id", "group_id", "read_ord", "spec").filter(F.col("spec").isNotNull()).dropDuplicates(["row_id"])
    named = groups.select(F.col("group_id").alias("g"), "construct_id", F.upper("ref_seq").alias("ref_seq"), F.length("ref_seq").alias("ref_len"))
    joined = once.join(named, F.col("group_id") == F.col("g")).drop("g")
    clipped = F.substring(F.col("spec"), F.lit(1), F.col("ref_len"))
    left, right = F.ltrim(clipped, F.lit(GAP)), F.rtrim(clipped, F.lit(GAP))
    called = F.length(left) > 0
    first = F.when(called, F.length(clipped) - F.length(left))
    return joined.withColumn("spec", clipped).withColumn("first", first).withColumn("last", F.when(called, F.length(right) - 1))


def cells(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """Covered cells: row_id, group_id, read_ord, pos, base, ref_base, is_match (``.`` in the spec)."""
    placed = placed_rows(rows, groups).filter(F.col("first").isNotNull())
    return cells_of(placed)


def covered_letters() -> Column:
    """Of a placed row: the array of (code, ref) over its covered span; null for a row that called nothing."""
    n = F.col("last") - F.col("first") + 1
    letters = lambda c: F.split(F.upper(F.substring(F.col(c), F.col("first") + 1, n)), "")
    return F.arrays_zip(letters("spec").alias("code"), letters("ref_seq").alias("ref"))


def cells_of(placed: DataFrame) -> DataFrame:
    # Codes and reference bases are exploded together: a cell carries two letters, not the whole reference.
    long = placed.select("row_id", "group_id", "read_ord", "first", F.posexplode(covered_letters()).alias("i", "c"))
    return long.select(
        "row_id",
        "group_id",
        "read_ord",
        (F.col("first") + F.col("i")).alias("pos"),
        F.when(F.col("c.code") == ".", F.col("c.ref")).otherwise(F.col("c.code")).alias("base"),
        F.col("c.ref").alias("ref_base"),
        (F.col("c.code") == ".").alias("is_match"),
    )


def differing_cells(placed: DataFrame) -> DataFrame:
    """The covered cells that do not have the reference base; equal ones are dropped before anything is aggregated or shuffled.

    Exploding runs in generated code, which higher-order functions over a row's letters would not.
    """
    return cells_of(placed.filter(F.col("first").isNotNull())).filter(F.col("base") != F.col("ref_base")).select("group_id", "pos", "base", "ref_base")


def depths(placed: DataFrame) -> DataFrame:
    """group_id, pos, depth of every covered position, from where rows begin and end: two numbers a row, not one a cell."""
    ends = placed.filter(F.col("first").isNotNull()).select("group_id", F.inline(F.array(F.struct(F.col("first").alias("pos"), F.lit(1).alias("d")), F.struct((F.col("last") + 1).alias("pos"), F.lit(-1).alias("d")))))
    changes = ends.groupBy("group_id", "pos").agg(F.sum("d").alias("d"))
    order = Window.partitionBy("group_id").orderBy("pos")
    steps = changes.select("group_id", "pos", F.sum("d").over(order).alias("depth"), F.lead("pos").over(order).alias("to")).filter(F.col("depth") > 0)
    return steps.select("group_id", F.explode(F.sequence(F.col("pos"), F.col("to") - 1)).alias("pos"), "depth")


def counted_positions(placed: DataFrame) -> DataFrame:
    """``position_stats`` of placed rows, with ``ref_base`` and ``alts``: the other called bases (base, n) of each position that has some."""
    counts = differing_cells(placed).groupBy("group_id", "pos", "ref_base", "base").agg(F.count(F.lit(1)).alias("n"))
    off = counts.groupBy("group_id", "pos").agg(
        F.sum("n").alias("off"), F.sum(F.when(F.col("base") == GAP, F.col("n"))).alias("deletions"), F.first("ref_base").alias("ref_base"), F.collect_list(F.when(F.col("base") != GAP, F.struct("base", "n"))).alias("alts")
    )
    zero = F.lit(0).cast("bigint")
    joined = depths(placed).join(off, ["group_id", "pos"], "left")
    return joined.select("group_id", "pos", "depth", (F.col("depth") - F.coalesce("off", zero)).alias("matches"), F.coalesce("deletions", zero).alias("deletions"), "ref_base", "alts")


def position_stats(cells: DataFrame) -> DataFrame:
    """group_id, pos, depth (called + deleted), matches, deletions of every covered position."""
    return cells.groupBy("group_id", "pos").agg(
        F.count(F.lit(1)).alias("depth"),
        F.count_if(F.col("base") == F.col("ref_base")).alias("matches"),
        F.count_if(F.col("base") == GAP).alias("deletions"),
    )


def mismatch_counts(stats: DataFrame, groups: DataFrame) -> DataFrame:
    """group_id, pos, disagree, covering, fraction for every position of every group; 0 where nothing covers it."""
    every = groups.select("group_id", F.posexplode(F.split("ref_seq", "")).alias("pos", "c")).drop("c")
    full = every.join(stats, ["group_id", "pos"], "left")
    covering = F.coalesce("depth", F.lit(0).cast("bigint"))
    disagree = covering - F.coalesce("matches", F.lit(0).cast("bigint"))
    return full.select("group_id", "pos", disagree.alias("disagree"), covering.alias("covering"), F.when(covering > 0, disagree / covering).otherwise(F.lit(0.0)).alias("fraction"))


def flagged_columns(stats: DataFrame, threshold: float = 0.10) -> DataFrame:
    """group_id, pos of positions at which more than ``threshold`` of the covering rows disagree."""
    return stats.filter((F.col("depth") - F.col("matches")) / F.col("depth") > threshold).select("group_id", "pos")


def mismatch_runs(mismatches: DataFrame) -> DataFrame:
    """Run-length encoding of (disagree, covering): group_id, run_no, first_pos, run, disagree, covering."""
    order = Window.partitionBy("group_id").orderBy("pos")
    changed = F.coalesce(((F.col("disagree") != F.lag("disagree").over(order)) | (F.col("covering") != F.lag("covering").over(order))).cast("bigint"), F.lit(1).cast("bigint"))
    return (
        mismatches.withColumn("changed", changed)
        .withColumn("run_no", F.sum("changed").over(order))
        .groupBy("group_id", "run_no")
        .agg(F.min("pos").alias("first_pos"), F.count(F.lit(1)).alias("run"), F.min("disagree").alias("disagree"), F.min("covering").alias("covering"))
    )


def track_segments(mismatches: DataFrame) -> DataFrame:
    """group_id, start, end (half-open), level: adjacent positions of the same fraction as one segment of the mismatch track."""
    order = Window.partitionBy("group_id").orderBy("pos")
    opens = F.coalesce((F.col("fraction") != F.lag("fraction").over(order)).cast("bigint"), F.lit(1).cast("bigint"))
    numbered = mismatches.withColumn("opens", opens).withColumn("segment", F.sum("opens").over(order))
    segments = numbered.groupBy("group_id", "segment").agg(F.min("pos").alias("start"), (F.max("pos") + 1).alias("end"), F.min("fraction").alias("fraction"))
    return segments.select("group_id", "start", "end", F.round(mismatch_level(F.col("fraction")), 6).alias("level"))


def group_summary(stats: DataFrame, groups: DataFrame) -> DataFrame:
    """Per group: covered positions, mean depth over them, max depth, identity of called bases (null if none)."""
    per_group = stats.groupBy("group_id").agg(
        F.count(F.lit(1)).alias("covered"),
        F.avg("depth").alias("mean_depth"),
        F.max("depth").alias("max_depth"),
        F.try_divide(F.sum("matches"), F.sum("depth") - F.sum("deletions")).alias("identity"),
    )
    out = groups.select("group_id", F.length("ref_seq").alias("ref_len")).join(per_group, "group_id", "left")
    zero = F.lit(0).cast("bigint")
    return out.select("group_id", "ref_len", F.coalesce("covered", zero).alias("covered"), F.coalesce("mean_depth", F.lit(0.0)).alias("mean_depth"), F.coalesce("max_depth", zero).alias("max_depth"), "identity")


def flag_identity(cells: DataFrame) -> DataFrame:
    """Per group: the share of called cells that are flagged as matches."""
    called = F.col("base") != GAP
    return cells.groupBy("group_id").agg(F.try_divide(F.count_if(called & F.col("is_match")), F.count_if(called)).alias("identity"))


def consensus(cells: DataFrame) -> DataFrame:
    """group_id, pos, base, symbol: the majority of called bases; of equals the one the first row has.

    ``symbol`` is ``.`` where the majority is the reference, ``-`` where nothing is called.
    """
    called = F.when(F.col("base") != GAP, F.col("base"))
    votes = cells.groupBy("group_id", "pos", "ref_base", called.alias("base")).agg(F.count(F.lit(1)).alias("n"), F.min("read_ord").alias("first_ord"))
    best = votes.groupBy("group_id", "pos", "ref_base").agg(F.max_by("base", F.when(F.col("base").isNotNull(), F.struct("n", (-F.col("first_ord")).alias("o")))).alias("base"))
    symbol = F.when(F.col("base").isNull(), F.lit(GAP)).when(F.col("base") == F.col("ref_base"), F.lit(".")).otherwise(F.col("base"))
    return best.select("group_id", "pos", "base", symbol.alias("symbol"))


def window_consensus(cells: DataFrame, placed: DataFrame) -> DataFrame:
    """group_id, pos, symbol: as a base-resolution window shows it. Deleted and uncovered both vote for a gap,
    which wins if it has more votes than the best base; positions no row covers are gaps."""
    votes = cells.filter(F.col("base") != GAP).groupBy("group_id", "pos", "base").agg(F.count(F.lit(1)).alias("n"), F.min("read_ord").alias("first_ord"))
    best = votes.groupBy("group_id", "pos").agg(F.max_by("base", F.struct("n", (-F.col("first_ord")).alias("o"))).alias("base"), F.max("n").alias("most"), F.sum("n").alias("called"))
    sizes = placed.groupBy("group_id").agg(F.count(F.lit(1)).alias("rows"), F.max("ref_len").alias("ref_len"))
    every = sizes.filter(F.col("ref_len") > 0).select("group_id", "rows", F.explode(F.sequence(F.lit(0), F.col("ref_len") - 1)).alias("pos"))
    joined = every.join(best, ["group_id", "pos"], "left")
    gap = F.col("most").isNull() | (F.col("rows") - F.col("called") > F.col("most"))
    return joined.select("group_id", "pos", F.when(gap, F.lit(GAP)).otherwise(F.col("base")).alias("symbol"))


def depth_profile(stats: DataFrame, groups: DataFrame, columns: int = 1000) -> DataFrame:
    """group_id, bucket, depth: the least depth of each of at most ``columns`` buckets, so that holes stay visible."""
    every = groups.select("group_id", F.length("ref_seq").alias("ref_len"), F.posexplode(F.split("ref_seq", "")).alias("pos", "c")).drop("c")
    full = every.join(stats.select("group_id", "pos", "depth"), ["group_id", "pos"], "left").withColumn("depth", F.coalesce("depth", F.lit(0).cast("bigint")))
    width = F.least(F.lit(columns), F.col("ref_len"))
    bucket = F.floor(((F.col("pos") + 1) * width - 1) / F.col("ref_len"))
    return full.groupBy("group_id", bucket.cast("int").alias("bucket")).agg(F.min("depth").alias("depth"))


def deletion_runs(placed: DataFrame) -> DataFrame:
    """row_id, group_id, start, end (half-open) of each run of deleted positions inside a row; rows are not shuffled."""
    core = F.substring(F.col("spec"), F.col("first") + 1, F.col("last") - F.col("first") + 1)
    # Within the covered span, gaps and called letters take turns, beginning and ending with letters.
    gaps, called = F.filter(F.split(core, "[^-]+"), lambda g: g != ""), F.filter(F.split(core, "-+"), lambda g: g != "")
    runs = placed.filter(F.col("first").isNotNull()).select("row_id", "group_id", "first", F.transform(gaps, F.length).alias("gaps"), F.transform(called, F.length).alias("called"))
    before = lambda array, k: F.aggregate(F.slice(array, 1, k), F.lit(0), lambda acc, x: acc + x)
    start = lambda g, k: F.col("first") + before("called", k + 1) + before("gaps", k)
    spans = F.transform("gaps", lambda g, k: F.struct(start(g, k).alias("start"), (start(g, k) + g).alias("end")))
    return runs.select("row_id", "group_id", F.inline(spans))


def variable_columns(cells: DataFrame) -> DataFrame:
    """group_id, pos at which some row calls another base than the reference."""
    return cells.filter((F.col("base") != GAP) & (F.col("base") != F.col("ref_base"))).select("group_id", "pos").distinct()


def signatures(placed: DataFrame) -> DataFrame:
    """``placed`` with ``signature``: the sorted positions at which the row calls another base; deletions are none."""
    other = lambda c: (c["code"] != ".") & (c["code"] != GAP) & (c["code"] != c["ref"])
    at = F.transform(covered_letters(), lambda c, i: F.when(other(c), F.col("first") + i))
    return placed.withColumn("signature", F.coalesce(F.filter(at, lambda p: p.isNotNull()), F.array().cast("array<int>")))


def packed_rows(placed: DataFrame) -> DataFrame:
    """row_id, group_id, packed: the page's row text: ``.`` match, ``-`` gap or uncovered, else the base."""
    core = F.array_join(F.transform(covered_letters(), lambda c: F.when(c["code"] == c["ref"], F.lit(".")).otherwise(c["code"])), "")
    gaps = lambda n: F.repeat(F.lit(GAP), n)
    packed = F.when(F.col("first").isNull(), gaps(F.col("ref_len"))).otherwise(F.concat(gaps(F.col("first")), core, gaps(F.col("ref_len") - F.col("last") - 1)))
    return placed.select("row_id", "group_id", packed.alias("packed"))


def parent_rows(groups: DataFrame) -> DataFrame:
    """group_id, packed: the parent against the reference, ``.`` where equal; none for an empty parent."""
    kept = groups.filter(F.coalesce(F.length("parent"), F.lit(0)) > 0)
    pairs = F.arrays_zip(F.split(F.upper("parent"), "").alias("p"), F.split(F.upper("ref_seq"), "").alias("r"))
    return kept.select("group_id", F.array_join(F.transform(pairs, lambda s: F.when(s["p"] == s["r"], F.lit(".")).otherwise(s["p"])), "").alias("packed"))


def width_errors(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """kind, id, width, ref_len of every spec and parent that is not as wide as its reference."""
    named = groups.select(F.col("group_id").alias("g"), F.length("ref_seq").alias("ref_len"), F.length("parent").alias("parent_len"))
    spec = rows.select("row_id", "group_id", F.length("spec").alias("width")).distinct().join(named, F.col("group_id") == F.col("g")).filter(F.col("width") != F.col("ref_len"))
    parent = named.filter((F.col("parent_len") > 0) & (F.col("parent_len") != F.col("ref_len")))
    return spec.select(F.lit("row").alias("kind"), F.col("row_id").alias("id"), "width", "ref_len").unionByName(parent.select(F.lit("parent").alias("kind"), F.col("g").alias("id"), F.col("parent_len").alias("width"), "ref_len"))


def check_widths(rows: DataFrame, groups: DataFrame) -> None:
    """Raises ValueError if a spec or a parent is not as wide as its reference, naming up to three of them."""
    wrong = width_errors(rows, groups).limit(3).collect()
    if wrong:
        raise ValueError("not as wide as the reference: " + ", ".join(f"{r['kind']} {r['id']} ({r['width']} of {r['ref_len']})" for r in wrong))


def fold_doubled(left: DataFrame, key: str = "row_id") -> DataFrame:
    """Cells aligned to a doubled reference (key, pos, base, ref_base, ref_len of one copy) folded onto one copy.

    A gap yields to a called base; of two called bases the mismatch stays.
    """
    pos = (F.col("pos") % F.col("ref_len")).cast("int")
    worth = F.struct(F.when(F.col("base") == GAP, 0).when(F.col("base") == F.col("ref_base"), 1).otherwise(2).alias("w"), (-F.col("pos")).alias("o"))
    return left.groupBy(key, pos.alias("pos")).agg(F.max_by("base", worth).alias("base"), F.first("ref_base").alias("ref_base"))
