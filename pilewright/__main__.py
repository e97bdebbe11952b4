"""``python -m pilewright ALIGNMENT.sam REFERENCE OUT.html``: the pages of one alignment. See ``--help``."""

from __future__ import annotations

import argparse
import os
import sys
from datetime import UTC, datetime

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from pilewright.operators.orderings import ORDERINGS
from pilewright.sources import annotated, pages, sam
from pilewright.tables import free_name


def summary_path(out: str) -> str:
    """``x.summary.html`` beside ``x.html``."""
    return f"{os.path.splitext(out)[0]}.summary.html"


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="pilewright", description="Pileup and summary pages of aligned reads.")
    p.add_argument("reads", help="SAM file, aligned to the reference (to the sequence twice if it is circular)")
    p.add_argument("reference", help="FASTA or GenBank")
    p.add_argument("out", help="page to write; .html is added")
    p.add_argument("--skip-types", help="feature types to leave out, parted by commas")
    p.add_argument("--name", help="keep reads whose name contains this")
    p.add_argument("--max", type=int, default=500, help="rows drawn per group")
    p.add_argument("--min-read-len", type=int, default=0)
    p.add_argument("--min-overlap-pos", type=int, default=0, help="position that reads must span; negative: the middle; 0: any")
    p.add_argument("--order", choices=sorted(ORDERINGS), default="length")
    p.add_argument("--no-circular", action="store_true", help="read a circular reference as linear")
    p.add_argument("--ref-name")
    p.add_argument("--summary", action="store_true", help="write the summary page too")
    p.add_argument("--variant-freq", type=float, default=0.25)
    p.add_argument("--variant-reads", type=int, default=2)
    p.add_argument("--title")
    return p


def view_of(spark: SparkSession, args: argparse.Namespace) -> pages.View | None:
    """The view of the command's one group; None where no read is left."""
    ref = annotated.load_reference(args.reference, tuple(filter(None, args.skip_types.split(","))) if args.skip_types is not None else None)
    name = args.ref_name or ref.name
    records = sam.read_sam(spark, args.reads)
    if args.name:
        records = records.filter(F.contains("name", F.lit(args.name)))
    records = records.filter(F.length("seq") >= args.min_read_len)
    circular = ref.is_circular and not args.no_circular
    grid = sam.grid(records, ref.seq * 2 if circular else ref.seq, args.min_overlap_pos)
    if circular:
        n = len(ref.seq)
        letters = F.split("spec", "")
        # A gap yields to a called base, a match to a mismatch.
        both = F.zip_with(F.slice(letters, 1, n), F.slice(letters, n + 1, n), lambda a, b: F.when(a == "-", b).when(b == "-", a).when(a == ".", b).otherwise(a))
        grid = grid.withColumn("spec", F.array_join(both, ""))
    rid = free_name(grid, "row_id")
    rows = grid.withColumn(rid, F.monotonically_increasing_id()).select(rid, F.lit(1).cast("bigint").alias("group_id"), F.col(rid).alias("read_ord"), "spec").cache()
    n = rows.count()
    if not n:
        return None
    groups = spark.createDataFrame([(1, 0, 0, name, ref.seq, 0, n, 1.0, "", False, "")], "group_id bigint, construct_id bigint, group_ord int, name string, ref_seq string, ref_start int, n_reads bigint, fraction double, status string, highlighted boolean, parent string")
    constructs = spark.createDataFrame([(0, ref.seq)], "construct_id bigint, seq string")
    return pages.View(args.title or name, rows, groups, ref.features_df(spark), constructs, args.order, args.max, args.variant_freq, args.variant_reads)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    out = args.out if args.out.endswith(".html") else f"{args.out}.html"
    if not os.path.exists(args.reads):
        print(f"no reads at {args.reads}", file=sys.stderr)
        return 1
    spark = spark or SparkSession.builder.appName("pilewright").getOrCreate()
    view = view_of(spark, args)
    if view is None:
        print("no aligned reads are left", file=sys.stderr)
        return 1
    with open(out, "w", encoding="utf-8") as f:
        f.write(pages.render_pileup(view))
    if args.summary:
        with open(summary_path(out), "w", encoding="utf-8") as f:
            f.write(pages.render_summary(view))
    with open(f"{os.path.splitext(out)[0]}.log.txt", "w", encoding="utf-8") as f:
        f.write(f"{datetime.now(UTC):%Y-%m-%d %H:%M:%S}\n" + "".join(f"{k}: {v}\n" for k, v in sorted(vars(args).items())))
    return 0


if __name__ == "__main__":
    sys.exit(main())
