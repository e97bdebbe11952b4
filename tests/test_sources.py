import gzip

from pyspark.sql import functions as F

from pilewright.operators.parse_records import parse_records, valid_and_rejected
from pilewright.sources import annotated, fastq, sam


def test_fastq(spark, tmp_path):
    (tmp_path / "a.fastq").write_text("@r1 x\nACGT\n+\nIIII\n@r2\nAC\n+\n\n")
    with gzip.open(tmp_path / "b.fq.gz", "wt") as f:
        f.write("@r3\nACGTA\n+\nIIIII\n")
    (tmp_path / ".c.fastq").write_text("@no\nA\n+\nI\n")
    got = sorted(map(tuple, fastq.read_fastq(spark, str(tmp_path)).collect()))
    assert got == [("a.fastq", 0, "r1", "ACGT", "IIII"), ("a.fastq", 1, "r2", "AC", None), ("b.fq.gz", 0, "r3", "ACGTA", "IIIII")]
    assert [r["name"] for r in fastq.read_fastq(spark, str(tmp_path), "r", 5).collect()] == ["r3"]
    assert fastq.read_fastq(spark, str(tmp_path / "none")).count() == 0


    assert [r["name"] for r in fastq.read_fastq(spark, str(tmp_path), limit=2).collect()] == ["r1", "r2"]


def test_styling_notes():
    pairs = lambda *p: annotated.Qualifiers(list(p))
    assert pairs(("note", "color: #AABBCC; direction: RIGHT"), ("note", "a  site")).label("misc") == "a site"
    assert pairs(("note", "This forward feature has 2 segments: 1: 5..9")).label("misc") == "misc"
    assert pairs(("note", "x" * 50), ("gene", " ")).label("misc") == "x" * 39 + "…"
    assert pairs(("product", "p"), ("gene", "g")).label("misc") == "g"
    assert pairs(("note", "kept; my color: Red")).color(False) == "#ff0000"
    assert pairs(("ApEinfo_revcolor", "#00f"), ("ApEinfo_fwdcolor", "#0F0")).color(True) == "#00f"
    assert pairs(("ApEinfo_revcolor", "#00f"), ("ApEinfo_fwdcolor", "#0F0")).color(False) == "#0f0"
    assert pairs(("color", "12 34 56"), ("note", "colour of money")).color(False) is None


REF = "ACGT" * 5


def record(name, pos, cigar, seq, flag=0):
    return "\t".join([name, str(flag), "ref", str(pos), "60", cigar, "*", "0", "0", seq, "*"])


def test_sam(spark, tmp_path):
    lines = ["@SQ\tSN:ref\tLN:20", record("d", 1, "5M1D14M", REF[:5] + REF[6:]), record("i", 1, "2S6M2I4M1S", "TT" + REF[:6] + "GG" + REF[6:10] + "A"), record("u", 1, "*", "ACGT", 4), record("s", 1, "4M", "ACGT", 0x800)]
    path = tmp_path / "x.sam"
    path.write_text("\n".join(lines) + "\n")
    records = sam.read_sam(spark, str(path))
    assert {r["name"]: r["spec"] for r in sam.grid(records, REF, 0).collect()} == {"d": ".....-..............", "i": "." * 10 + "-" * 10}
    assert [r["name"] for r in sam.grid(records, REF, -1).collect()] == ["d"]
    names = spark.createDataFrame([], "name string")
    assert sam.restricted(records, names).count() == 0 and sam.restricted(records, None).count() == 4
    assert {r["name"]: r["qual"] for r in sam.to_reads(records).collect()}["d"] == "I" * 19


GENBANK = """LOCUS       pTest  100 bp DNA circular UNA
FEATURES             Location/Qualifiers
     source          1..100
     CDS             complement(join(5..10,20..30))
                     /label="my  gene"
                     /ApEinfo_revcolor="#FF0000"
     gene            complement(join(5..10,20..30))
     misc_feature    join(91..100,1..9)
                     /note="color: blue; direction: BOTH"
                     /note="crossing"
ORIGIN
        1 acgtacgtac acgtacgtac acgtacgtac acgtacgtac acgtacgtac acgtacgtac
       61 acgtacgtac acgtacgtac acgtacgtac acgtacgtac
//
"""


def test_genbank_and_fasta(spark, tmp_path):
    (tmp_path / "x.gb").write_text(GENBANK)
    ref = annotated.load_reference(str(tmp_path / "x.gb"))
    assert (ref.name, len(ref.seq), ref.is_circular) == ("pTest", 100, True)
    assert [f[3:] for f in ref.features] == [("CDS", 4, 30, -1, "my gene", False, "#ff0000"), ("misc_feature", 90, 9, 1, "crossing", True, "#0000ff")]
    assert ref.features_df(spark).count() == 2
    annotated.write_fasta(ref, str(tmp_path / "x.fa"), doubled=True)
    assert annotated.load_reference(str(tmp_path / "x.fa")).seq == ref.seq * 2


GOOD = "r1,ACGT,IIII,4,bc01,2025-01-02T03:04:05"
CASES = [
    (GOOD, None),
    (GOOD + "\r", None),
    ('"r1","acgt","I""II",4,"bc01","2024-02-29T00:00:00"', None),
    ("r1,ACGT,,4,bc01,2025-01-02T03:04:05", None),
    ('r1,ACGT,"",4,bc01,2025-01-02T03:04:05', None),
    (None, "columns"),
    ("", "columns"),
    ("\r", "columns"),
    (GOOD + "\r\r", "value"),
    (GOOD + ",", "columns"),
    ("r1,ACGT,IIII,4,bc01", "columns"),
    ('"r1,ACGT,IIII,4,bc01,2025-01-02T03:04:05', "quoting"),
    ('r1,AC"GT,IIII,4,bc01,2025-01-02T03:04:05', "quoting"),
    ('"r1"x,ACGT,IIII,4,bc01,2025-01-02T03:04:05', "quoting"),
    ('"r1" ,ACGT', "quoting"),
    ('""",ACGT,IIII,4,bc01,2025-01-02T03:04:05', "quoting"),
    ("r 1,ACGT,IIII,4,bc01,2025-01-02T03:04:05", "value"),
    ("r 1,ACGT,IIII,4,bc01,2025-01-02T03:04:05", "value"),
    (",ACGT,IIII,4,bc01,2025-01-02T03:04:05", "value"),
    ("r1,ACGX,IIII,4,bc01,2025-01-02T03:04:05", "value"),
    ("r1,ACGT,III,4,bc01,2025-01-02T03:04:05", "value"),
    ("r1,ACGT,IIII,5,bc01,2025-01-02T03:04:05", "value"),
    ("r1,ACGT,IIII,99999999999999999999999,bc01,2025-01-02T03:04:05", "value"),
    ("r1,ACGT,IIII," + "0" * 100_000 + "4,bc01,2025-01-02T03:04:05", None),
    ("r1,ACGT,IIII," + "9" * 100_000 + ",bc01,2025-01-02T03:04:05", "value"),
    ("r1,ACGT,IIII,4,bc1,2025-01-02T03:04:05", "value"),
    ("r1,ACGT,IIII,4,bc01,2025-02-29T03:04:05", "value"),
    ("r1,ACGT,IIII,4,bc01,2025-01-02T24:00:00", "value"),
    ("r1," + "A" * 5000 + ",," + "5000,bc01,2025-01-02T03:04:05", None),
]


def test_reasons(spark):
    # "name" and "reason" clash with results; they are keys here
    df = spark.createDataFrame([(i, f"k{i}", "x", line) for i, (line, _) in enumerate(CASES)], "raw_id bigint, name string, reason string, line string")
    parsed = parse_records(df, keys=("raw_id", "name", "reason"))
    assert {r["raw_id"]: r["reason"] for r in parsed.collect()} == {i: why for i, (_, why) in enumerate(CASES)}
    assert parsed.columns == ["raw_id", "name_key", "reason_key", "name", "seq", "qual", "n_bases", "barcode", "read_at", "reason"]
    valid, rejected = valid_and_rejected(parsed)
    assert valid.count() + rejected.count() == len(CASES)
    assert valid.filter("raw_id = 2").select("qual").collect()[0][0] == 'I"II'
    assert parse_records(df.limit(0)).count() == 0


def test_parsing_equals_a_walk_over_characters(spark):
    """Random lines of few characters against a plain state machine."""
    import random

    rng = random.Random(11)
    lines = ["".join(rng.choice('",a\r') for _ in range(rng.randrange(0, 14))) for _ in range(3000)]

    def walk(line):
        if line.endswith("\r"):
            line = line[:-1]
        if not line:
            return "columns"
        i, fields = 0, 0
        while True:
            fields += 1
            if line[i : i + 1] == '"':
                i += 1
                while True:
                    j = line.find('"', i)
                    if j < 0:
                        return "quoting"
                    if line[j + 1 : j + 2] == '"':
                        i = j + 2
                        continue
                    i = j + 1
                    break
                if i < len(line) and line[i] != ",":
                    return "quoting"
            else:
                j = line.find(",", i)
                j = len(line) if j < 0 else j
                if '"' in line[i:j]:
                    return "quoting"
                i = j
            if i >= len(line):
                break
            i += 1
        return "columns" if fields != 6 else "value"

    df = spark.createDataFrame(list(enumerate(lines)), "raw_id bigint, line string")
    assert {r["raw_id"]: r["reason"] for r in parse_records(df).collect()} == {i: walk(x) for i, x in enumerate(lines)}
