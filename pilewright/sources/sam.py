"""SAM text: records, which of them count, and their projection onto reference coordinates by CIGAR."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Flag bits of unmapped, secondary and supplementary records.
LEFT_OUT = 0x4 | 0x100 | 0x800


def read_sam(spark: SparkSession, path: str) -> DataFrame:
    """name, flag, rname, start (0-based), cigar, seq, qual of the records of SAM files."""
    lines = spark.read.text(path).filter(~F.col("value").startswith("@") & (F.length("value") > 0))
    f = lambda k: F.get(F.split("value", "\t"), F.lit(k))
    return lines.select(
        f(0).alias("name"), f(1).cast("int").alias("flag"), f(2).alias("rname"), (f(3).cast("int") - 1).alias("start"), f(5).alias("cigar"), f(9).alias("seq"), f(10).alias("qual")
    )


def primary(records: DataFrame) -> DataFrame:
    """Without unmapped, secondary and supplementary records."""
    return records.filter((F.col("flag").bitwiseAND(LEFT_OUT)) == 0)


def restricted(records: DataFrame, names: DataFrame | None) -> DataFrame:
    """Records whose name is in ``names`` (column name): all for None, none for an empty table."""
    return records if names is None else records.join(names.select("name").distinct(), "name", "left_semi")


def _operations() -> Column:
    """The CIGAR as structs (op, n)."""
    parts = F.regexp_extract_all(F.col("cigar"), F.lit(r"(\d+[MIDNSHP=X])"), F.lit(1))
    return F.transform(parts, lambda p: F.struct(F.substring(p, -1, 1).alias("op"), F.regexp_extract(p, r"^(\d+)", 1).cast("int").alias("n")))


def _consumes(op: Column, which: str) -> Column:
    return op.isin(*(["M", "=", "X", "I", "S"] if which == "read" else ["M", "=", "X", "D", "N"]))


def reference_end(start: Column) -> Column:
    """The position after the last reference base that an alignment covers."""
    return start + F.aggregate(_operations(), F.lit(0), lambda acc, s: acc + F.when(_consumes(s["op"], "reference"), s["n"]).otherwise(0))


def spanning(records: DataFrame, midpoint: int) -> DataFrame:
    """Records that cross ``midpoint`` from both sides; 0 keeps all."""
    return records.filter((reference_end(F.col("start")) > midpoint) & (F.col("start") < midpoint)) if midpoint else records


def midpoint_of(ref_len: int, min_overlap_pos: int = -1) -> int:
    return ref_len // 2 if min_overlap_pos < 0 else min_overlap_pos


def project(records: DataFrame, ref_len: Column, keys: tuple[str, ...] = ("name",)) -> DataFrame:
    """keys, pos, base of each reference position an alignment covers: a base, or ``-`` where it has a deletion or a skip.

    Inserted and clipped bases have no position; positions from ``ref_len`` on are dropped.
    """
    zero = F.struct(F.array().cast("array<struct<op:string,n:int,q:int,r:int>>").alias("out"), F.lit(0).alias("q"), F.lit(0).alias("r"))

    def step(acc: Column, s: Column) -> Column:
        at = F.struct(s["op"].alias("op"), s["n"].alias("n"), acc["q"].alias("q"), acc["r"].alias("r"))
        q = acc["q"] + F.when(_consumes(s["op"], "read"), s["n"]).otherwise(0)
        r = acc["r"] + F.when(_consumes(s["op"], "reference"), s["n"]).otherwise(0)
        return F.struct(F.concat(acc["out"], F.array(at)).alias("out"), q.alias("q"), r.alias("r"))

    blocks = F.filter(F.aggregate(_operations(), zero, step, lambda acc: acc["out"]), lambda b: _consumes(b["op"], "reference") & (b["n"] > 0))
    placed = records.select(*keys, "start", "seq", ref_len.alias("ref_len"), F.explode(blocks).alias("b"))
    # A block's letters are cut out at once: cells carry one letter, not the read.
    letters = F.when(F.col("b.op").isin("D", "N"), F.array_repeat(F.lit("-"), F.col("b.n"))).otherwise(F.split(F.upper(F.substring(F.col("seq"), F.col("b.q") + 1, F.col("b.n"))), ""))
    long = placed.select(*keys, (F.col("start") + F.col("b.r")).alias("at"), "ref_len", F.posexplode(letters).alias("k", "base"))
    pos = F.col("at") + F.col("k")
    return long.filter((pos < F.col("ref_len")) & (F.col("base") != "")).select(*keys, pos.alias("pos"), "base")


def grid(records: DataFrame, ref_seq: str, min_overlap_pos: int = -1, names: DataFrame | None = None) -> DataFrame:
    """name, spec: each record as a row as wide as the reference (``.`` match, base, ``-``), patterns together."""
    kept = spanning(restricted(primary(records), names), midpoint_of(len(ref_seq), min_overlap_pos)).withColumn("rec", F.monotonically_increasing_id())
    ref = F.lit(ref_seq.upper())
    cells = project(kept, F.lit(len(ref_seq)), ("rec", "name"))
    code = F.when(F.col("base") == F.substring(ref, F.col("pos") + 1, F.lit(1)), F.lit(".")).otherwise(F.col("base"))
    by_pos = cells.groupBy("rec", "name").agg(F.map_from_entries(F.collect_list(F.struct("pos", code.alias("c")))).alias("at"))
    every = F.sequence(F.lit(0), F.lit(len(ref_seq) - 1))
    spec = F.array_join(F.transform(every, lambda p: F.coalesce(F.try_element_at("at", p), F.lit("-"))), "")
    return by_pos.select("name", spec.alias("spec")).orderBy(F.translate("spec", "-", "."), "name")


def to_reads(records: DataFrame) -> DataFrame:
    """name, seq, qual of primary records; without those that have no sequence; a missing quality is all ``I``."""
    kept = primary(records).filter((F.col("seq") != "*") & (F.col("seq") != ""))
    return kept.select("name", "seq", F.coalesce(F.when(F.col("qual") != "*", F.col("qual")), F.expr("repeat('I', length(seq))")).alias("qual"))
