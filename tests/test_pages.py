from pilewright.__main__ import main, summary_path
from pilewright.functions import scales
from pilewright.sources import pages
from tests.test_sources import GENBANK

SEQ = "ACGTACGTAC" * 10


def test_command_writes_both_pages(spark, tmp_path):
    (tmp_path / "r.gb").write_text(GENBANK.replace("my  gene", "x</script>y"))
    record = lambda i, seq, cigar: f"r{i}\t0\tref\t1\t60\t{cigar}\t*\t0\t0\t{seq}\t*"
    lines = [record(i, SEQ[:49] + "A" + SEQ[50:] if i < 4 else SEQ[:60] + SEQ[63:], "100M" if i < 4 else "60M3D37M") for i in range(8)]
    (tmp_path / "x.sam").write_text("\n".join(lines) + "\n")
    out = str(tmp_path / "page")
    assert main([str(tmp_path / "x.sam"), str(tmp_path / "r.gb"), out, "--summary", "--title", "A & <b>"], spark) == 0
    page, summary = (tmp_path / "page.html").read_text(), (tmp_path / "page.summary.html").read_text()
    assert "A &amp; &lt;b&gt;" in page and page.count("</script>") == 2
    assert "C→A" in summary and "Δ3 bp" in summary and "4/8" in summary
    assert "order: length" in (tmp_path / "page.log.txt").read_text()
    assert main([str(tmp_path / "none.sam"), str(tmp_path / "r.gb"), out], spark) == 1


def test_helpers():
    assert summary_path("a/b.html") == "a/b.summary.html"
    assert pages.script_json(["</script>"]) == '["<\\/script>"]'
    assert [scales.cell_width(n) for n in (199, 200, 499, 500)] == [4, 3, 3, 2]
    assert [scales.nice_step(n) for n in (100, 120, 1000, 3000)] == [10, 20, 100, 500]
    assert scales.label_color("#ffffff") == "#000000" and scales.label_color("#000") == "#ffffff"
    assert scales.mix("#000000", "#ffffff", 0.5) == "#808080"


def test_bounds_and_levels(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(50, 100), (0, 1000), (995, 1000), (5, 10)], "c int, n int")
    start, end = scales.window_bounds(F.col("c"), F.col("n"), 20)
    assert [tuple(r) for r in df.select(start, end).collect()] == [(40, 60), (0, 20), (980, 1000), (0, 10)]
    level = spark.createDataFrame([(0.0,), (0.001,), (0.01,), (1.0,)], "f double").select(scales.mismatch_level(F.col("f")))
    assert [round(r[0], 4) for r in level.collect()] == [0.0, 0.0, 0.3333, 1.0]
