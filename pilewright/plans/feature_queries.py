"""Queries over reads, constructs and features, and their DuckDB equivalents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pilewright.functions.codon import translate
from pilewright.operators import features, pileup, sampling
from pilewright.sources import fastq, sam
from pilewright.tables import table


def _features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.once(table(spark, sf_dir, "features"))


def _reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "reads").select("file", "ord", "name", "seq", "qual").dropDuplicates(["file", "ord"])


def kept_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.kept_features(_features(spark, sf_dir)).select("feature_id", "construct_id", "type")


def feature_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.feature_spans(_features(spark, sf_dir), table(spark, sf_dir, "constructs"))


def features_at_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The features over the position of each stored variant."""
    groups = table(spark, sf_dir, "pileup_groups").select(F.col("group_id").alias("g"), "construct_id", "ref_start")
    variants = table(spark, sf_dir, "variants").select("group_id", "pos").distinct()
    positions = variants.join(groups, F.col("group_id") == F.col("g")).select("construct_id", (F.col("ref_start") + F.col("pos")).alias("pos")).distinct()
    return features.features_at(feature_spans(spark, sf_dir), positions)


def flank_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.flank_lengths(_features(spark, sf_dir), table(spark, sf_dir, "constructs"))


def focus_flanks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.focus_flanks(_features(spark, sf_dir), table(spark, sf_dir, "constructs"), "promoter")


def region_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.region_spans(flank_lengths(spark, sf_dir), table(spark, sf_dir, "constructs"))


def track_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.track_plan(features.kept_features(_features(spark, sf_dir)), table(spark, sf_dir, "constructs"))


def widest_piece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.widest_piece(feature_spans(spark, sf_dir))


def translated_constructs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "constructs").select("construct_id", translate(F.upper("seq")).alias("protein"))


def kept_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fastq.keep_reads(_reads(spark, sf_dir), ":2:", 100).select("file", "ord")


def pooled_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.draw_pooled(_reads(spark, sf_dir), 500).select("file", "ord", "name")


def sample_per_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.draw_per_file(_reads(spark, sf_dir), 20).select("file", "ord", "seen")


def reads_per_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _reads(spark, sf_dir).groupBy("file").agg(F.count(F.lit(1)).alias("reads"), F.sum(F.length("seq")).alias("bases"))


def dropped_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The features of each construct that its track has no room for."""
    return features.dropped_names(track_plan(spark, sf_dir), _features(spark, sf_dir))


def label_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the labels of all pieces stand if features are dealt to three lanes in order."""
    named = _features(spark, sf_dir).select(F.col("feature_id").alias("f"), (F.col("feature_ord") % 3).alias("lane"), F.coalesce("label", "type", F.lit("")).alias("label"))
    sizes = table(spark, sf_dir, "constructs").select(F.col("construct_id").alias("c"), F.length("seq").alias("n"))
    drawn = feature_spans(spark, sf_dir).join(named, F.col("feature_id") == F.col("f")).join(sizes, F.col("construct_id") == F.col("c"))
    return features.place_labels(drawn, F.col("n")).select("feature_id", "piece", "label_place")


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows written as alignments: row_id, flag, start, cigar, seq, ref_len.

    Every operation occurs: clips of both kinds at the ends, two inserted bases after the first run, gaps as D or N, and
    the rest as M, or as = where the row says so and X where it has a letter.
    """
    placed = pileup.placed_rows(table(spark, sf_dir, "pileup_rows"), table(spark, sf_dir, "pileup_groups")).filter(F.col("first").isNotNull())
    core = F.upper(F.substring(F.col("spec"), F.col("first") + 1, F.col("last") - F.col("first") + 1))
    called = F.translate(F.regexp_replace(core, "[A-Z]", "X"), ".", "=")
    called = F.when(F.col("row_id") % 3 == 0, F.translate(called, "X=", "MM")).otherwise(called)
    kinds = F.when(F.col("row_id") % 2 == 0, F.translate(called, pileup.GAP, "D")).otherwise(F.translate(called, pileup.GAP, "N"))
    bases = F.array_join(F.transform(pileup.covered_letters(), lambda c: F.when(c["code"] == ".", c["ref"]).otherwise(c["code"])), "")
    runs = F.regexp_extract_all(F.col("kinds"), F.lit("(M+|=+|X+|D+|N+)"), F.lit(1))
    told = placed.select("row_id", "ref_len", F.col("first").alias("start"), kinds.alias("kinds"), F.replace(bases, F.lit(pileup.GAP), F.lit("")).alias("bases")).withColumn("runs", runs)
    operations = F.transform("runs", lambda r, i: F.concat(F.length(r).cast("string"), F.substring(r, 1, 1), F.when(i == 0, "2I").otherwise("")))
    first = F.length(F.get("runs", F.lit(0)))
    seq = F.concat(F.lit("NN"), F.substring(F.col("bases"), F.lit(1), first), F.lit("GG"), F.substring(F.col("bases"), first + 1, F.length("bases")), F.lit("T"))
    return told.select("row_id", ((F.col("row_id") * 37) % 4096).cast("int").alias("flag"), "start", F.concat(F.lit("1H2S"), F.array_join(operations, ""), F.lit("1S3H")).alias("cigar"), seq.alias("seq"), "ref_len")


def cigar_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows written as alignments and projected back onto reference coordinates."""
    return sam.project(_records(spark, sf_dir), F.col("ref_len"), ("row_id",))


def spanning_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alignments that are primary, named in a table, and cross position 75 from both sides."""
    records = _records(spark, sf_dir).withColumn("name", F.concat(F.lit("g"), (F.col("row_id") % 7).cast("string")))
    names = table(spark, sf_dir, "pileup_groups").filter(F.col("group_id") % 7 < 5).select(F.concat(F.lit("g"), (F.col("group_id") % 7).cast("string")).alias("name"))
    return sam.spanning(sam.restricted(sam.primary(records), names), sam.midpoint_of(150, -1)).select("row_id")


def folded_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells seen in either half of a doubled reference, folded: the first half has even positions, the second every third."""
    placed = pileup.placed_rows(table(spark, sf_dir, "pileup_rows"), table(spark, sf_dir, "pileup_groups")).filter(F.col("first").isNotNull())
    cells = pileup.cells_of(placed).join(placed.select(F.col("row_id").alias("r"), "ref_len"), F.col("row_id") == F.col("r"))
    seen = lambda every: F.when(F.col("pos") % every == 0, F.col("base")).otherwise(pileup.GAP).alias("base")
    halves = cells.select("row_id", "pos", seen(2), "ref_base", "ref_len").unionByName(cells.select("row_id", (F.col("pos") + F.col("ref_len")).alias("pos"), seen(3), "ref_base", "ref_len"))
    return pileup.fold_doubled(halves).select("row_id", "pos", "base")


QUERIES = {
    "kept_features": kept_features,
    "feature_spans": feature_spans,
    "features_at_variants": features_at_variants,
    "flank_lengths": flank_lengths,
    "focus_flanks": focus_flanks,
    "region_spans": region_spans,
    "track_plan": track_plan,
    "widest_piece": widest_piece,
    "translated_constructs": translated_constructs,
    "kept_reads": kept_reads,
    "pooled_sample": pooled_sample,
    "sample_per_file": sample_per_file,
    "reads_per_file": reads_per_file,
    "cigar_projection": cigar_projection,
    "spanning_records": spanning_records,
    "folded_cells": folded_cells,
    "dropped_features": dropped_features,
    "label_places": label_places,
}

from pilewright.plans.pileup_queries import _CELLS, _CODONS  # noqa: E402

_ONCE = "f AS (SELECT DISTINCT ON (feature_id) * EXCLUDE (loaded_at) FROM features), fl AS (SELECT f.*, length(seq) AS n, coalesce(wraps_origin, FALSE) OR span_start > span_end AS wraps FROM f JOIN constructs USING (construct_id))"
_SPANS = f"""{_ONCE},
pieces AS (
  SELECT feature_id, construct_id, 0 AS piece, greatest(0, span_start) AS "start", CASE WHEN wraps THEN n ELSE least(n, span_end) END AS "end" FROM fl
  UNION ALL SELECT feature_id, construct_id, 1, 0, least(n, span_end) FROM fl WHERE wraps),
spans AS (SELECT feature_id, construct_id, CAST(piece AS INTEGER) AS piece, CAST("start" AS INTEGER) AS "start", CAST("end" AS INTEGER) AS "end" FROM pieces WHERE "end" > "start")
"""
_FLANKS = f"""{_ONCE},
inserts AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY construct_id ORDER BY feature_ord, feature_id) AS r FROM fl WHERE type = 'insert') WHERE r = 1 AND NOT wraps),
flanks AS (SELECT construct_id, n, CAST(greatest(0, span_start) AS INTEGER) AS five, CAST(greatest(0, n - span_end) AS INTEGER) AS three FROM inserts)
"""
_READS = "r AS (SELECT DISTINCT file, ord, name, seq, qual FROM reads)"

ORACLES = {
    "kept_features": f"WITH {_ONCE} SELECT feature_id, construct_id, type FROM f x WHERE coalesce(type NOT IN ('source', 'primer_bind'), TRUE) AND NOT (coalesce(type, '') = 'gene' AND EXISTS (SELECT 1 FROM f y WHERE y.type = 'CDS' AND y.construct_id = x.construct_id AND y.span_start = x.span_start AND y.span_end = x.span_end))",
    "feature_spans": f"WITH {_SPANS} SELECT * FROM spans",
    "features_at_variants": f"""WITH {_SPANS}, p AS (SELECT DISTINCT construct_id, ref_start + pos AS pos FROM variants JOIN pileup_groups USING (group_id))
      SELECT DISTINCT construct_id, pos, feature_id FROM spans JOIN p USING (construct_id) WHERE pos >= "start" AND pos < "end" """,
    "flank_lengths": f"WITH {_FLANKS} SELECT construct_id, five, three FROM flanks",
    "focus_flanks": f"""WITH {_ONCE}, hits AS (SELECT *, row_number() OVER (PARTITION BY construct_id ORDER BY feature_ord, feature_id) AS r FROM fl WHERE contains(lower(coalesce(label, '')), 'promoter') OR lower(type) = 'promoter')
      SELECT construct_id, CAST(greatest(0, span_start) AS INTEGER) AS five, CAST(greatest(0, n - span_end) AS INTEGER) AS three FROM hits WHERE r = 1 AND NOT wraps AND (span_start > 0 OR n - span_end > 0)""",
    "region_spans": f"""WITH {_FLANKS}, b AS (
        SELECT construct_id, 'five' AS region, 0 AS "start", five AS "end" FROM flanks WHERE five + three > 0 UNION ALL SELECT construct_id, 'insert', five, n - three FROM flanks WHERE five + three > 0 UNION ALL SELECT construct_id, 'three', n - three, n FROM flanks WHERE five + three > 0)
      SELECT construct_id, region, CAST("start" AS INTEGER) AS "start", CAST("end" AS INTEGER) AS "end" FROM b WHERE "end" > "start" """,
    "widest_piece": f"""WITH {_SPANS} SELECT feature_id, piece FROM spans QUALIFY row_number() OVER (PARTITION BY feature_id ORDER BY "end" - "start" DESC, piece) = 1""",
    "translated_constructs": f"""WITH {_CODONS}, parts AS (SELECT construct_id, k, upper(seq)[3 * k + 1:3 * k + 3] AS codon FROM (SELECT *, unnest(range(length(seq) // 3)) AS k FROM constructs))
      SELECT construct_id, string_agg(coalesce(aa, 'X'), '' ORDER BY k) AS protein FROM parts LEFT JOIN codons USING (codon) GROUP BY construct_id""",
    "kept_reads": f"WITH {_READS} SELECT file, ord FROM r WHERE contains(name, ':2:') AND length(seq) >= 100",
    "pooled_sample": f"WITH {_READS} SELECT file, ord, name FROM r ORDER BY md5('0|' || file || '|' || ord), file, ord LIMIT 500",
    "sample_per_file": f"WITH {_READS} SELECT file, ord, seen FROM (SELECT *, count(*) OVER (PARTITION BY file) AS seen, row_number() OVER (PARTITION BY file ORDER BY md5('0|' || file || '|' || ord), ord) AS k FROM r) WHERE k <= 20",
    "reads_per_file": f"WITH {_READS} SELECT file, count(*) AS reads, CAST(sum(length(seq)) AS BIGINT) AS bases FROM r GROUP BY file",
    "spanning_records": f"WITH {_CELLS} SELECT row_id FROM placed WHERE z > 0 AND ((row_id * 37) % 4096) & 2308 = 0 AND a < 75 AND z > 75 AND row_id % 7 IN (SELECT group_id % 7 FROM pileup_groups WHERE group_id % 7 < 5)",
    "folded_cells": f"WITH {_CELLS} SELECT row_id, pos, CASE WHEN pos % 2 = 0 OR pos % 3 = 0 THEN base ELSE '-' END AS base FROM cells",
    "label_places": f"""WITH {_SPANS},
      drawn AS (SELECT s.*, feature_ord % 3 AS lane, length(coalesce(label, type, '')) * 5.2 AS w, n FROM spans s JOIN fl USING (feature_id)),
      laid AS (
        SELECT *, lead("start") OVER (PARTITION BY construct_id, lane ORDER BY "start", "end", feature_id, piece) AS next, row_number() OVER (PARTITION BY feature_id ORDER BY "end" - "start" DESC, piece) AS k FROM drawn)
      SELECT feature_id, piece, CASE WHEN k > 1 THEN 'none' WHEN w + 8 <= 4 * ("end" - "start") THEN 'in' WHEN 4 * (coalesce(next, n) - "end") - 5 >= w THEN 'after' ELSE 'none' END AS label_place FROM laid""",
    "cigar_projection": f"WITH {_CELLS} SELECT row_id, pos, base FROM cells",
}
