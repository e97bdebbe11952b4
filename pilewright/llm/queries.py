"""The pN_ queries of the llm operators, each over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pilewright.llm.canonical import map_to_list
from pilewright.llm.garbled import find_garbled, restore
from pilewright.llm.packing import pack_documents
from pilewright.llm.runs import collapse_runs
from pilewright.llm.stable_sample import frozen_sample
from pilewright.llm.subpopulations import describe_subpopulations, find_subpopulations, similar_pairs
from pilewright.llm.tokenizer import encode_corpus
from pilewright.llm.top_n import top_n_per_group
from pilewright.tables import table

SAMPLE_RATE, SAMPLE_SALT = 0.1, "pileup-page"

#: The order of consequences.
CONSEQUENCES = ("frameshift", "nonsense", "inframe_indel", "missense", "silent", "noncoding")


def p1_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = frozen_sample(table(spark, sf_dir, "reads"), ["name", "seq"], "batch_no", SAMPLE_RATE, SAMPLE_SALT)
    return out.select("batch_no", "name", "seq", "sample_hash")


def _subpopulations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_subpopulations(table(spark, sf_dir, "pileup_rows"), table(spark, sf_dir, "pileup_groups"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_pairs(_subpopulations(spark, sf_dir))


def p2_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row's subpopulation; null for a row with null spec."""
    rows = table(spark, sf_dir, "pileup_rows").select("row_id").distinct()
    return rows.join(_subpopulations(spark, sf_dir).select("row_id", "construct_id", "subpopulation"), "row_id", "left")


def p2_subpopulations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return describe_subpopulations(_subpopulations(spark, sf_dir))


def p3_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collapse_runs(table(spark, sf_dir, "pileup_rows"), table(spark, sf_dir, "pileup_groups")).select("group_id", "first_ord", "last_ord", "n_rows", "duration_us")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p3_runs(spark, sf_dir).select("group_id", "first_ord", "last_ord")


#: Fields and the lists that they are mapped to: table, key, colour code.
LISTS = {"type": ("feature_types", "type_id", None), "color": ("color_names", "color_id", "hex")}


def mapped_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``feature_id, field, value, ref_id`` of both fields."""
    features = table(spark, sf_dir, "features")
    out = []
    for field, (name, key, code) in LISTS.items():
        entries = table(spark, sf_dir, name).select(F.col(key).alias("id"), "name", "also_called", (F.col(code) if code else F.lit(None).cast("string")).alias("code"))
        out.append(map_to_list(features, "feature_id", field, entries).select(F.col("key").alias("feature_id"), F.lit(field).alias("field"), "value", "ref_id"))
    return out[0].unionByName(out[1])


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mapped_features(spark, sf_dir).select("feature_id", "field", "ref_id")


def p4_unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reported values without an entry, with the number of features that have them."""
    return mapped_features(spark, sf_dir).filter(F.col("ref_id") == 0).groupBy("field", "value").agg(F.count(F.lit(1)).alias("n_features"))


def foremost_variants(variants: DataFrame, n: int = 5) -> DataFrame:
    """The foremost ``n`` variants of each group with their ``rank_no``."""
    named = F.lower(F.trim(F.col("consequence")))
    tier = F.coalesce(*[F.when(named == c, F.lit(i)) for i, c in enumerate(CONSEQUENCES)], F.lit(len(CONSEQUENCES)))
    share = F.when(F.col("count").isNull() | F.col("depth").isNull() | (F.col("depth") == 0), F.lit(0.0)).otherwise(F.col("count") / F.col("depth"))
    return top_n_per_group(variants, ["group_id"], [tier.asc(), share.desc(), F.col("pos").asc()], ["variant_id"], n)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    needed = table(spark, sf_dir, "variants").select("variant_id", "group_id", "pos", "count", "depth", "consequence")
    return foremost_variants(needed).select("group_id", F.col("rank_no").cast("int").alias("rank_no"), "variant_id")


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_corpus(table(spark, sf_dir, "documents"))


def p8_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_garbled(table(spark, sf_dir, "documents"))[0].select("doc_id").distinct()


def p9_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return restore(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_sample": p1_sample,
    "p2_found": p2_found,
    "p2_members": p2_members,
    "p2_subpopulations": p2_subpopulations,
    "p3_runs": p3_runs,
    "p3_found": p3_found,
    "p4_found": p4_found,
    "p4_unmatched": p4_unmatched,
    "p5_found": p5_found,
    "p7_ids": p7_ids,
    "p8_containers": p8_containers,
    "p9_found": p9_found,
    "p9_restored": p9_restored,
}
