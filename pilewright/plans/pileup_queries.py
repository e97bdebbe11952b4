"""Queries over pileup rows, groups, variants, and their DuckDB equivalents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pilewright.functions.codon import translate
from pilewright.functions.scales import mismatch_level, window_bounds
from pilewright.operators import clustering, features, orderings, pileup, proteins, variants
from pilewright.tables import checkpointed, table


class Pileup:
    """The DataFrames that the queries share; nothing is computed before a query reads it."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.rows, self.groups = table(spark, sf_dir, "pileup_rows"), table(spark, sf_dir, "pileup_groups")
        self.features, self.constructs = features.once(table(spark, sf_dir, "features")), table(spark, sf_dir, "constructs")

    @property
    def placed(self) -> DataFrame:
        return pileup.placed_rows(self.rows, self.groups)

    @property
    def cells(self) -> DataFrame:
        return pileup.cells(self.rows, self.groups)

    @property
    def stats(self) -> DataFrame:
        return pileup.position_stats(self.cells)

    @property
    def counted(self) -> DataFrame:
        return pileup.counted_positions(self.placed)

    @property
    def called(self) -> DataFrame:
        # A row a group and position: kept, so that the cells are counted once for both kinds of variants.
        counted = checkpointed(self.counted)
        return variants.call_snvs(counted).unionByName(variants.call_deletions(counted, pileup.deletion_runs(self.placed), self.groups))

    @property
    def classified(self) -> DataFrame:
        return variants.describe(variants.classify(self.called, features.reading_frames(self.features, self.groups)))


def position_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Pileup(spark, sf_dir).stats


def mismatch_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = Pileup(spark, sf_dir)
    return pileup.mismatch_counts(p.stats, p.groups)


def flagged_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pileup.flagged_columns(Pileup(spark, sf_dir).stats)


def mismatch_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = Pileup(spark, sf_dir)
    return pileup.mismatch_runs(pileup.mismatch_counts(p.stats, p.groups))


def mismatch_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = Pileup(spark, sf_dir)
    return pileup.mismatch_counts(p.stats, p.groups).select("group_id", "pos", F.round(mismatch_level(F.col("fraction")), 6).alias("level"))


def group_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = Pileup(spark, sf_dir)
    s = pileup.group_summary(p.stats, p.groups)
    return s.withColumn("mean_depth", F.round("mean_depth", 6)).withColumn("identity", F.round("identity", 6))


def flag_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pileup.flag_identity(Pileup(spark, sf_dir).cells).withColumn("identity", F.round("identity", 6))


def consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pileup.consensus(Pileup(spark, sf_dir).cells)


def window_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = Pileup(spark, sf_dir)
    return pileup.window_consensus(p.cells, p.placed)


def depth_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = Pileup(spark, sf_dir)
    return pileup.depth_profile(p.stats, p.groups, 50)


def deletion_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pileup.deletion_runs(Pileup(spark, sf_dir).placed)


def variable_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pileup.variable_columns(Pileup(spark, sf_dir).cells)


def signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pileup.signatures(Pileup(spark, sf_dir).placed).select("row_id", "group_id", F.array_join(F.transform("signature", lambda x: x.cast("string")), ",").alias("signature"))


def packed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pileup.packed_rows(Pileup(spark, sf_dir).placed)


def parent_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pileup.parent_rows(table(spark, sf_dir, "pileup_groups"))


def width_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = Pileup(spark, sf_dir)
    return pileup.width_errors(p.rows, p.groups)


def called_snvs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.call_snvs(Pileup(spark, sf_dir).counted)


def called_deletions(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = Pileup(spark, sf_dir)
    return variants.call_deletions(p.counted, pileup.deletion_runs(p.placed), p.groups)


def called_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Pileup(spark, sf_dir).classified.withColumn("fraction", F.round("fraction", 6))


def called_insertions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Insertions the sidecar reports (here the variants table's rows of kind ins) that the depth of the rows supports."""
    p = Pileup(spark, sf_dir)
    evidence = table(spark, sf_dir, "variants").filter((F.col("kind") == "ins") & F.col("count").isNotNull()).drop("loaded_at").dropDuplicates(["variant_id"])
    evidence = evidence.groupBy("group_id", "pos", F.col("alt").alias("seq")).agg(F.sum("count").alias("count"))
    return variants.call_insertions(evidence, p.stats, p.groups)


def group_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = Pileup(spark, sf_dir)
    return variants.verdicts(p.classified, p.groups)


def verdict_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = Pileup(spark, sf_dir)
    return variants.verdicts(p.classified, p.groups).groupBy("verdict").agg(F.count(F.lit(1)).alias("groups"))


def status_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = table(spark, sf_dir, "pileup_groups")
    return g.select(variants.status_tier(F.col("status"), F.col("highlighted")).alias("tier")).groupBy("tier").agg(F.count(F.lit(1)).alias("groups"))


def variant_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page's variant table over the stored variants."""
    once = table(spark, sf_dir, "variants").drop("loaded_at").dropDuplicates(["variant_id"])
    v = once.select("variant_id", "group_id", "pos", "kind", "ref", "alt", "count", "depth", F.lower(F.trim("consequence")).alias("consequence"))
    v = v.withColumn("fraction", F.when(F.col("depth") > 0, F.coalesce("count", F.lit(0)) / F.col("depth")).otherwise(F.lit(0.0)))
    return variants.variant_table(v, 50, ("variant_id",)).select("group_id", "rank_no", "variant_id", "of")


def ordering(name: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return orderings.ORDERINGS[name](Pileup(spark, sf_dir).placed)

    return run


def interesting_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first rows of the window around each group's middle."""
    p = Pileup(spark, sf_dir)
    length = F.length("ref_seq")
    start, end = window_bounds(F.floor(length / 2).cast("int"), length, 60)
    windows = p.groups.select("group_id", F.lit(1).alias("window_no"), start.alias("start"), end.alias("end"))
    return orderings.interesting_first(p.placed, windows, limit=16)


def variant_window_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first rows of the windows around the foremost variants of each group, up to six a group, as the summary page has them."""
    p = Pileup(spark, sf_dir)
    windows = orderings.variant_windows(variants.variant_table(p.classified, 6), p.groups, 6, 60)
    return orderings.interesting_first(p.placed, windows, limit=16)


def nearest_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances within all groups, whatever their size: one row a signature instead of one a pair."""
    return clustering.nearest_signatures(Pileup(spark, sf_dir).placed)


def translated_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The protein of each group's frame."""
    p = Pileup(spark, sf_dir)
    frames = features.reading_frames(p.features, p.groups).filter(F.col("focus_start").isNotNull())
    coding = F.substring(F.upper("ref_seq"), F.col("focus_start") + 1, F.col("focus_end") - F.col("focus_start"))
    return frames.select("group_id", translate(coding).alias("protein"))


def group_proteins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reference, consensus and parent of each group's frame as proteins."""
    p = Pileup(spark, sf_dir)
    return proteins.group_proteins(features.reading_frames(p.features, p.groups), pileup.consensus(p.cells), p.groups)


def residue_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return proteins.residue_changes(group_proteins(spark, sf_dir))


def track_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mismatch track's segments of equal height."""
    p = Pileup(spark, sf_dir)
    return pileup.track_segments(pileup.mismatch_counts(p.stats, p.groups))


def lollipop_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.lollipop_tiers(Pileup(spark, sf_dir).classified).select("group_id", "pos", "kind", "alt", "tier")


def covered_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = Pileup(spark, sf_dir).cells
    return cells.filter(F.col("base") != pileup.GAP).groupBy("group_id").agg(F.count_distinct("pos").alias("covered"))


def construct_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals and shares of the groups of each construct, and its widest group (the first of equals)."""
    from pyspark.sql import Window

    g = table(spark, sf_dir, "pileup_groups")
    total = F.sum("n_reads").over(Window.partitionBy("construct_id"))
    share = g.withColumn("total", total)
    return share.groupBy("construct_id").agg(
        F.max("total").alias("total_reads"), F.count(F.lit(1)).alias("groups"), F.count_distinct(F.length("ref_seq")).alias("ref_lens"), F.max_by("group_id", F.struct(F.length("ref_seq").alias("l"), (-F.col("group_ord")).alias("o"))).alias("widest_group")
    )


QUERIES = {
    "position_stats": position_stats,
    "mismatch_counts": mismatch_counts,
    "flagged_columns": flagged_columns,
    "mismatch_runs": mismatch_runs,
    "mismatch_levels": mismatch_levels,
    "group_summary": group_summary,
    "flag_identity": flag_identity,
    "consensus": consensus,
    "window_consensus": window_consensus,
    "depth_profile": depth_profile,
    "deletion_runs": deletion_runs,
    "variable_columns": variable_columns,
    "signatures": signatures,
    "packed_rows": packed_rows,
    "parent_rows": parent_rows,
    "width_errors": width_errors,
    "called_snvs": called_snvs,
    "called_deletions": called_deletions,
    "called_insertions": called_insertions,
    "called_variants": called_variants,
    "group_verdicts": group_verdicts,
    "verdict_tally": verdict_tally,
    "status_tiers": status_tiers,
    "variant_table": variant_table,
    "order_by_length": ordering("length"),
    "order_by_position": ordering("position"),
    "order_by_mismatch": ordering("mismatch"),
    "order_by_cluster": ordering("cluster"),
    "interesting_rows": interesting_rows,
    "variant_window_rows": variant_window_rows,
    "nearest_signatures": nearest_signatures,
    "translated_frames": translated_frames,
    "group_proteins": group_proteins,
    "residue_changes": residue_changes,
    "track_segments": track_segments,
    "lollipop_tiers": lollipop_tiers,
    "covered_positions": covered_positions,
    "construct_reads": construct_reads,
}

_CELLS = """
once AS (SELECT DISTINCT row_id, group_id, read_ord, spec FROM pileup_rows WHERE spec IS NOT NULL),
placed AS (
  SELECT o.*, construct_id, upper(ref_seq) AS ref_seq, length(ref_seq) AS ref_len, length(spec) - length(ltrim(spec, '-')) AS a, length(rtrim(spec, '-')) AS z
  FROM once o JOIN pileup_groups USING (group_id)),
spread AS (SELECT row_id, group_id, read_ord, spec, ref_seq, CAST(unnest(range(a, z)) AS INTEGER) AS pos FROM placed),
cells AS (
  SELECT row_id, group_id, read_ord, pos, CASE WHEN spec[pos + 1] = '.' THEN ref_seq[pos + 1] ELSE upper(spec[pos + 1]) END AS base, ref_seq[pos + 1] AS ref_base, spec[pos + 1] = '.' AS is_match
  FROM spread),
stats AS (
  SELECT group_id, pos, count(*) AS depth, count(*) FILTER (base = ref_base) AS matches, count(*) FILTER (base = '-') AS deletions FROM cells GROUP BY ALL)
"""

_MISMATCH = f"""{_CELLS},
positions AS (SELECT group_id, CAST(unnest(range(length(ref_seq))) AS INTEGER) AS pos FROM pileup_groups),
mismatches AS (
  SELECT group_id, pos, coalesce(depth - matches, 0) AS disagree, coalesce(depth, 0) AS covering, coalesce((depth - matches) / depth, 0.0) AS fraction
  FROM positions LEFT JOIN stats USING (group_id, pos))
"""

_SNVS = """
snvs AS (
  SELECT group_id, pos, 'snv' AS kind, ref_base AS ref, base AS alt, n AS "count", depth
  FROM (SELECT group_id, pos, ref_base, base, count(*) AS n FROM cells WHERE base <> '-' AND base <> ref_base GROUP BY ALL) JOIN stats USING (group_id, pos)
  WHERE n >= 2 AND depth >= 3 AND n / depth >= 0.25)
"""

_DELETIONS = """
gaps AS (SELECT row_id, group_id, pos, pos - row_number() OVER (PARTITION BY row_id ORDER BY pos) AS island FROM cells WHERE base = '-'),
gap_runs AS (SELECT row_id, group_id, min(pos) AS "start", max(pos) + 1 AS "end" FROM gaps GROUP BY row_id, group_id, island),
thick AS (SELECT *, pos - row_number() OVER (PARTITION BY group_id ORDER BY pos) AS island FROM stats WHERE depth >= 3 AND deletions / depth >= 0.25),
islands AS (SELECT group_id, min(pos) AS pos, max(pos) + 1 AS upto, min(deletions) AS least, arg_min(depth, pos) AS depth FROM thick GROUP BY group_id, island),
support AS (
  SELECT i.*, (SELECT count(*) FROM gap_runs r WHERE r.group_id = i.group_id AND r."start" <= i.pos AND r."end" >= i.upto) AS whole FROM islands i),
dels AS (
  SELECT s.group_id, s.pos, 'del' AS kind, upper(ref_seq)[s.pos + 1:upto] AS ref, '' AS alt, CASE WHEN whole > 0 THEN whole ELSE least END AS "count", depth
  FROM support s JOIN pileup_groups g ON g.group_id = s.group_id WHERE CASE WHEN whole > 0 THEN whole ELSE least END >= 2)
"""

_FRAMES = """
feature_once AS (SELECT DISTINCT ON (feature_id) * EXCLUDE (loaded_at) FROM features),
coding AS (
  SELECT construct_id, span_start, span_end FROM (
    SELECT *, row_number() OVER (PARTITION BY construct_id ORDER BY feature_ord, feature_id) AS n FROM feature_once WHERE type = 'CDS')
  WHERE n = 1 AND NOT (coalesce(wraps_origin, FALSE) OR span_start > span_end)),
raw_frames AS (
  SELECT group_id, upper(ref_seq) AS ref_seq, greatest(0, span_start - ref_start) AS fs, least(length(ref_seq), span_end - ref_start) AS fe, c.construct_id IS NOT NULL AS has
  FROM pileup_groups g LEFT JOIN coding c ON c.construct_id = g.construct_id),
frames AS (SELECT group_id, ref_seq, CASE WHEN has AND fe - fs >= 3 THEN fs END AS fs, CASE WHEN has AND fe - fs >= 3 THEN fe END AS fe FROM raw_frames)
"""

_CODONS = """
letters AS (SELECT * FROM (VALUES ('A','A'),('C','C'),('G','G'),('T','T'),('R','AG'),('Y','CT'),('S','CG'),('W','AT'),('K','GT'),('M','AC'),('B','CGT'),('D','AGT'),('H','ACT'),('V','ACG'),('N','ACGT')) t(l, means)),
plain AS (
  SELECT 'TCAG'[a + 1] || 'TCAG'[b + 1] || 'TCAG'[c + 1] AS codon, 'FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG'[16 * a + 4 * b + c + 1] AS aa
  FROM range(4) x(a), range(4) y(b), range(4) w(c)),
codons AS (
  SELECT codon, CASE aas WHEN 'DN' THEN 'B' WHEN 'EQ' THEN 'Z' WHEN 'IL' THEN 'J' ELSE CASE WHEN length(aas) = 1 THEN aas ELSE 'X' END END AS aa
  FROM (
    SELECT l1.l || l2.l || l3.l AS codon, string_agg(DISTINCT p.aa, '' ORDER BY p.aa) AS aas
    FROM letters l1, letters l2, letters l3, plain p
    WHERE contains(l1.means, p.codon[1]) AND contains(l2.means, p.codon[2]) AND contains(l3.means, p.codon[3]) GROUP BY 1))
"""

_CLASSIFIED = f"""{_CELLS}, {_SNVS}, {_DELETIONS}, {_FRAMES}, {_CODONS},
calls AS (SELECT * FROM snvs UNION ALL SELECT * FROM dels),
framed AS (
  SELECT v.*, fs, fe, f.ref_seq, v.pos - fs AS o, (v.pos - fs) // 3 + 1 AS r, CASE WHEN kind = 'del' THEN length(v.ref) ELSE length(v.alt) END AS size, fs + (v.pos - fs) // 3 * 3 AS cs FROM calls v JOIN frames f USING (group_id)),
spelled AS (SELECT *, ref_seq[cs + 1:cs + 3] AS c1, ref_seq[cs + 1:pos] || alt || ref_seq[pos + 2:cs + 3] AS c2 FROM framed),
named AS (SELECT s.*, coalesce(a.aa, 'X') AS was, coalesce(b.aa, 'X') AS now FROM spelled s LEFT JOIN codons a ON a.codon = s.c1 LEFT JOIN codons b ON b.codon = s.c2),
judged AS (
  SELECT group_id, pos, kind, ref, alt, "count", depth,
    CASE WHEN fs IS NULL THEN '' WHEN pos < fs OR pos >= fe THEN 'noncoding' WHEN kind <> 'snv' AND size % 3 <> 0 THEN 'frameshift' WHEN kind <> 'snv' THEN 'inframe_indel'
      WHEN cs + 3 > fe THEN 'noncoding' WHEN was = now THEN 'silent' WHEN now = '*' THEN 'nonsense' ELSE 'missense' END AS consequence,
    CASE WHEN fs IS NULL OR pos < fs OR pos >= fe THEN '' WHEN kind <> 'snv' AND size % 3 <> 0 THEN 'frameshift at ' || r WHEN kind = 'del' THEN 'Δ' || (size // 3) || ' aa at ' || r
      WHEN cs + 3 > fe THEN '' WHEN was = now THEN 'silent (' || was || r || ')' WHEN now = '*' THEN was || r || '*' ELSE was || r || now END AS effect,
    round("count" / depth, 6) AS fraction, CAST(CASE WHEN kind = 'del' THEN length(ref) ELSE 1 END AS INTEGER) AS length,
    CASE WHEN kind = 'snv' THEN ref || '→' || alt ELSE 'Δ' || length(ref) || ' bp' END AS label
  FROM named),
verdicts AS (
  SELECT group_id, coalesce(CASE WHEN worst = '' THEN 'variant' ELSE worst END, 'clean') AS verdict
  FROM pileup_groups LEFT JOIN (
    SELECT group_id, arg_min(consequence, CASE consequence WHEN 'frameshift' THEN 0 WHEN 'nonsense' THEN 1 WHEN 'inframe_indel' THEN 2 WHEN 'missense' THEN 3 WHEN 'silent' THEN 4 WHEN 'noncoding' THEN 5 ELSE 6 END) AS worst
    FROM judged GROUP BY group_id) USING (group_id))
"""

_EXTENTS = f"""{_CELLS},
extents AS (SELECT row_id, group_id, read_ord, length(replace(spec, '-', '')) AS called, CASE WHEN z > 0 THEN a ELSE length(spec) END AS first, replace(upper(spec), '-', '.') AS pattern FROM placed)
"""


_PROTEINS = f"""{_CELLS}, {_FRAMES}, {_CODONS},
votes AS (SELECT group_id, pos, base, count(*) AS n, min(read_ord) AS o FROM cells WHERE base <> '-' GROUP BY ALL),
best AS (SELECT * FROM votes QUALIFY row_number() OVER (PARTITION BY group_id, pos ORDER BY n DESC, o) = 1),
in_frame AS (SELECT f.group_id, f.ref_seq, fs, upper(parent) AS parent, unnest(range((fe - fs) // 3)) AS k FROM frames f JOIN pileup_groups g ON g.group_id = f.group_id WHERE fs IS NOT NULL),
spelled_out AS (
  SELECT i.group_id, k, ref_seq[fs + 3 * k + 1:fs + 3 * k + 3] AS r, parent[fs + 3 * k + 1:fs + 3 * k + 3] AS p, coalesce(a.base, 'N') || coalesce(b.base, 'N') || coalesce(c.base, 'N') AS c, length(parent) > 0 AS has
  FROM in_frame i LEFT JOIN best a ON a.group_id = i.group_id AND a.pos = fs + 3 * k LEFT JOIN best b ON b.group_id = i.group_id AND b.pos = fs + 3 * k + 1 LEFT JOIN best c ON c.group_id = i.group_id AND c.pos = fs + 3 * k + 2),
residues AS (
  SELECT s.group_id, k, has, coalesce(x.aa, 'X') AS r, coalesce(y.aa, 'X') AS c, coalesce(z.aa, 'X') AS p
  FROM spelled_out s LEFT JOIN codons x ON x.codon = s.r LEFT JOIN codons y ON y.codon = s.c LEFT JOIN codons z ON z.codon = s.p)
"""


def _ordered(order: str) -> str:
    return f"WITH {_EXTENTS} SELECT row_id, group_id, CAST(row_number() OVER (PARTITION BY group_id ORDER BY {order}, read_ord, row_id) AS INTEGER) AS place FROM extents"


ORACLES = {
    "position_stats": f"WITH {_CELLS} SELECT * FROM stats",
    "mismatch_counts": f"WITH {_MISMATCH} SELECT * FROM mismatches",
    "flagged_columns": f"WITH {_CELLS} SELECT group_id, pos FROM stats WHERE (depth - matches) / depth > 0.10",
    "mismatch_runs": f"""WITH {_MISMATCH},
      marked AS (SELECT *, CASE WHEN lag(disagree) OVER q = disagree AND lag(covering) OVER q = covering THEN 0 ELSE 1 END AS opens FROM mismatches WINDOW q AS (PARTITION BY group_id ORDER BY pos)),
      numbered AS (SELECT *, CAST(sum(opens) OVER (PARTITION BY group_id ORDER BY pos) AS BIGINT) AS run_no FROM marked)
      SELECT group_id, run_no, min(pos) AS first_pos, count(*) AS run, min(disagree) AS disagree, min(covering) AS covering FROM numbered GROUP BY group_id, run_no""",
    "mismatch_levels": f"WITH {_MISMATCH} SELECT group_id, pos, round(CASE WHEN fraction <= 0.001 THEN 0.0 WHEN fraction >= 1 THEN 1.0 ELSE (log10(fraction) + 3) / 3 END, 6) AS level FROM mismatches",
    "group_summary": f"""WITH {_CELLS} SELECT g.group_id, CAST(length(g.ref_seq) AS INTEGER) AS ref_len, count(s.pos) AS covered, round(coalesce(avg(depth), 0.0), 6) AS mean_depth, coalesce(max(depth), 0) AS max_depth,
      round(CASE WHEN sum(depth) - sum(deletions) > 0 THEN sum(matches) / (sum(depth) - sum(deletions)) END, 6) AS identity FROM pileup_groups g LEFT JOIN stats s USING (group_id) GROUP BY g.group_id, g.ref_seq""",
    "flag_identity": f"WITH {_CELLS} SELECT group_id, round(count(*) FILTER (is_match) / nullif(count(*) FILTER (base <> '-'), 0), 6) AS identity FROM cells GROUP BY group_id",
    "consensus": f"""WITH {_CELLS},
      votes AS (SELECT group_id, pos, ref_base, base, count(*) AS n, min(read_ord) AS o FROM cells WHERE base <> '-' GROUP BY ALL),
      best AS (SELECT * FROM votes QUALIFY row_number() OVER (PARTITION BY group_id, pos ORDER BY n DESC, o) = 1)
      SELECT s.group_id, s.pos, b.base, CASE WHEN b.base IS NULL THEN '-' WHEN b.base = b.ref_base THEN '.' ELSE b.base END AS symbol FROM stats s LEFT JOIN best b USING (group_id, pos)""",
    "window_consensus": f"""WITH {_CELLS},
      sizes AS (SELECT group_id, count(*) AS n_rows, max(ref_len) AS ref_len FROM placed GROUP BY group_id),
      grid AS (SELECT group_id, n_rows, CAST(unnest(range(ref_len)) AS INTEGER) AS pos FROM sizes),
      votes AS (SELECT group_id, pos, base, count(*) AS n, min(read_ord) AS o FROM cells WHERE base <> '-' GROUP BY ALL),
      best AS (SELECT *, sum(n) OVER (PARTITION BY group_id, pos) AS called FROM votes QUALIFY row_number() OVER (PARTITION BY group_id, pos ORDER BY n DESC, o) = 1)
      SELECT g.group_id, g.pos, CASE WHEN b.n IS NULL OR g.n_rows - b.called > b.n THEN '-' ELSE b.base END AS symbol FROM grid g LEFT JOIN best b USING (group_id, pos)""",
    "depth_profile": f"""WITH {_MISMATCH},
      sized AS (SELECT m.*, length(ref_seq) AS n, least(50, length(ref_seq)) AS c FROM mismatches m JOIN pileup_groups USING (group_id)),
      buckets AS (SELECT group_id, n, CAST(unnest(range(c)) AS INTEGER) AS bucket, c FROM (SELECT DISTINCT group_id, n, c FROM sized))
      SELECT b.group_id, b.bucket, min(s.covering) AS depth FROM buckets b JOIN sized s ON s.group_id = b.group_id AND s.pos >= b.n * b.bucket // b.c AND s.pos < b.n * (b.bucket + 1) // b.c GROUP BY ALL""",
    "deletion_runs": f"WITH {_CELLS}, {_DELETIONS} SELECT * FROM gap_runs",
    "variable_columns": f"WITH {_CELLS} SELECT DISTINCT group_id, pos FROM cells WHERE base <> '-' AND base <> ref_base",
    "signatures": f"WITH {_CELLS} SELECT p.row_id, p.group_id, coalesce(string_agg(CAST(c.pos AS VARCHAR), ',' ORDER BY c.pos), '') AS signature FROM placed p LEFT JOIN cells c ON c.row_id = p.row_id AND c.base <> '-' AND c.base <> c.ref_base GROUP BY ALL",
    "packed_rows": f"""WITH {_CELLS} SELECT row_id, group_id,
      array_to_string(list_transform(range(1, ref_len + 1), lambda i: CASE WHEN upper(spec[i]) = ref_seq[i] THEN '.' ELSE upper(spec[i]) END), '') AS packed FROM placed""",
    "parent_rows": "SELECT group_id, array_to_string(list_transform(range(1, length(parent) + 1), lambda i: CASE WHEN upper(parent[i]) = upper(ref_seq[i]) THEN '.' ELSE upper(parent[i]) END), '') AS packed FROM pileup_groups WHERE length(parent) > 0",
    "width_errors": """SELECT DISTINCT 'row' AS kind, row_id AS id, CAST(length(spec) AS INTEGER) AS width, CAST(length(ref_seq) AS INTEGER) AS ref_len FROM pileup_rows JOIN pileup_groups USING (group_id) WHERE length(spec) <> length(ref_seq)
      UNION ALL SELECT 'parent', group_id, CAST(length(parent) AS INTEGER), CAST(length(ref_seq) AS INTEGER) FROM pileup_groups WHERE length(parent) > 0 AND length(parent) <> length(ref_seq)""",
    "called_snvs": f"WITH {_CELLS}, {_SNVS} SELECT * FROM snvs",
    "called_deletions": f"WITH {_CELLS}, {_DELETIONS} SELECT * FROM dels",
    "called_insertions": f"""WITH {_CELLS},
      v AS (SELECT DISTINCT variant_id, group_id, pos, alt, "count" AS n FROM variants WHERE kind = 'ins' AND "count" IS NOT NULL),
      e AS (SELECT group_id, pos, alt, CAST(sum(n) AS BIGINT) AS n FROM v GROUP BY ALL)
      SELECT group_id, pos, 'ins' AS kind, '' AS ref, upper(alt) AS alt, n AS "count", depth FROM e JOIN stats USING (group_id, pos) WHERE n >= 2 AND depth >= 3 AND n / depth >= 0.25""",
    "called_variants": f"WITH {_CLASSIFIED} SELECT * FROM judged",
    "group_verdicts": f"WITH {_CLASSIFIED} SELECT * FROM verdicts",
    "verdict_tally": f"WITH {_CLASSIFIED} SELECT verdict, count(*) AS groups FROM verdicts GROUP BY verdict",
    "status_tiers": """SELECT CASE WHEN status IS NULL OR trim(status) = '' THEN NULL WHEN status ILIKE '%perfect%' THEN 'ok' WHEN status ILIKE '%silent%' THEN 'warn'
      WHEN regexp_matches(lower(status), 'missense|nonsense|frameshift|stop|mismatch') THEN 'bad' WHEN status ILIKE '%match%' THEN 'ok' WHEN highlighted THEN 'ok' ELSE 'neutral' END AS tier, count(*) AS groups FROM pileup_groups GROUP BY 1""",
    "variant_table": """WITH v AS (SELECT DISTINCT variant_id, group_id, pos, lower(trim(consequence)) AS c, CASE WHEN depth > 0 THEN coalesce("count", 0) / depth ELSE 0.0 END AS f FROM variants),
      r AS (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY CASE c WHEN 'frameshift' THEN 0 WHEN 'nonsense' THEN 1 WHEN 'inframe_indel' THEN 2 WHEN 'missense' THEN 3 WHEN 'silent' THEN 4 WHEN 'noncoding' THEN 5 ELSE 6 END, f DESC, pos NULLS FIRST, variant_id) AS n, count(*) OVER (PARTITION BY group_id) AS of FROM v)
      SELECT group_id, CAST(n AS INTEGER) AS rank_no, variant_id, of FROM r WHERE n <= 50""",
    "order_by_length": _ordered("called DESC, first"),
    "order_by_position": _ordered("first, called DESC"),
    "order_by_mismatch": _ordered("pattern"),
    "interesting_rows": f"""WITH {_CELLS},
      w AS (SELECT group_id, greatest(0, least(length(ref_seq) // 2 - 30, length(ref_seq) - 60)) AS ws, length(ref_seq) AS n FROM pileup_groups),
      scored AS (
        SELECT p.group_id, p.row_id, p.read_ord, count(c.pos) FILTER (c.base <> c.ref_base) AS disagreements, count(c.pos) AS covered
        FROM placed p JOIN w USING (group_id) LEFT JOIN cells c ON c.row_id = p.row_id AND c.base <> '-' AND c.pos >= ws AND c.pos < least(n, ws + 60) GROUP BY ALL),
      ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY group_id ORDER BY disagreements DESC, covered DESC, read_ord, row_id) AS INTEGER) AS place FROM scored)
      SELECT group_id, CAST(1 AS INTEGER) AS window_no, row_id, disagreements, covered, place FROM ranked WHERE place <= 16""",
    "nearest_signatures": f"""WITH {_CELLS},
      marks AS (SELECT p.row_id, p.group_id, coalesce(list(c.pos ORDER BY c.pos) FILTER (c.pos IS NOT NULL), []) AS s FROM placed p LEFT JOIN cells c ON c.row_id = p.row_id AND c.base <> '-' AND c.base <> c.ref_base GROUP BY ALL),
      d AS (SELECT group_id, s, min(row_id) AS r, count(*) AS n FROM marks GROUP BY ALL),
      near AS (
        SELECT x.group_id, x.r, y.r AS o, CAST(len(x.s) + len(y.s) - 2 * len(list_intersect(x.s, y.s)) AS INTEGER) AS away FROM d x JOIN d y ON x.group_id = y.group_id AND x.r <> y.r),
      best AS (SELECT * FROM near QUALIFY row_number() OVER (PARTITION BY group_id, r ORDER BY away, o) = 1)
      SELECT d.group_id, d.r AS "row", n AS n_rows, o AS nearest, away AS distance FROM d LEFT JOIN best b ON b.group_id = d.group_id AND b.r = d.r""",
    "translated_frames": f"""WITH {_FRAMES}, {_CODONS},
      parts AS (SELECT group_id, k, ref_seq[fs + 3 * k + 1:fs + 3 * k + 3] AS codon FROM (SELECT *, unnest(range((fe - fs) // 3)) AS k FROM frames WHERE fs IS NOT NULL))
      SELECT group_id, string_agg(coalesce(aa, 'X'), '' ORDER BY k) AS protein FROM parts LEFT JOIN codons USING (codon) GROUP BY group_id""",
    "group_proteins": f"WITH {_PROTEINS} SELECT group_id, string_agg(r, '' ORDER BY k) AS ref_protein, string_agg(c, '' ORDER BY k) AS consensus_protein, CASE WHEN bool_or(has) THEN string_agg(p, '' ORDER BY k) END AS parent_protein FROM residues GROUP BY group_id",
    "residue_changes": f"""WITH {_PROTEINS},
      named AS (SELECT group_id, CAST(k + 1 AS INTEGER) AS residue, has, r, c, CASE WHEN has THEN p ELSE r END AS b FROM residues)
      SELECT group_id, residue, b || residue || CASE WHEN b <> c THEN c ELSE r END AS name, CASE WHEN b = c THEN 'missing' WHEN NOT has THEN 'plain' WHEN c = r THEN 'expected' ELSE 'unexpected' END AS kind
      FROM named WHERE b <> c OR (has AND r <> b)""",
    "track_segments": f"""WITH {_MISMATCH},
      marked AS (SELECT *, CASE WHEN lag(fraction) OVER q = fraction THEN 0 ELSE 1 END AS opens FROM mismatches WINDOW q AS (PARTITION BY group_id ORDER BY pos)),
      numbered AS (SELECT *, sum(opens) OVER (PARTITION BY group_id ORDER BY pos) AS segment FROM marked),
      segments AS (SELECT group_id, min(pos) AS "start", max(pos) + 1 AS "end", min(fraction) AS f FROM numbered GROUP BY group_id, segment)
      SELECT group_id, "start", "end", round(CASE WHEN f <= 0.001 THEN 0.0 WHEN f >= 1 THEN 1.0 ELSE (log10(f) + 3) / 3 END, 6) AS level FROM segments""",
    "covered_positions": f"WITH {_CELLS} SELECT group_id, count(DISTINCT pos) AS covered FROM cells WHERE base <> '-' GROUP BY group_id",
    "construct_reads": """SELECT construct_id, CAST(sum(n_reads) AS BIGINT) AS total_reads, count(*) AS groups, count(DISTINCT length(ref_seq)) AS ref_lens,
      first(group_id ORDER BY length(ref_seq) DESC, group_ord) AS widest_group FROM pileup_groups GROUP BY construct_id""",
}
