import itertools
import random
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from pilewright.functions.codon import BASES, IUPAC, RESIDUES, SHARED, codon_residues, translate, translate_codon
from pilewright.operators import clustering, features, orderings, pileup, proteins, sampling, variants
from tests.pileups import ROWS, groups, rows


def column(df, name, key="pos"):
    return [r[name] for r in df.orderBy(key).collect()]


def test_depth_counts_called_and_deleted_positions(spark):
    stats = pileup.position_stats(pileup.cells(rows(spark, ["....", "..--", "----"]), groups(spark, "ACGT")))
    assert column(stats, "depth") == [2, 2, 1, 1]


def test_matches_and_interior_deletions(spark):
    assert column(pileup.position_stats(pileup.cells(rows(spark, ["....", "T..."]), groups(spark, "ACGT"))), "matches") == [1, 2, 2, 2]
    assert column(pileup.position_stats(pileup.cells(rows(spark, [".-...", "....-"]), groups(spark, "ACGTA"))), "deletions") == [0, 1, 0, 0, 0]


def test_redelivered_rows_and_null_specs_count_once_or_not_at_all(spark):
    r = rows(spark, ["....", None])
    assert column(pileup.position_stats(pileup.cells(r.unionByName(r), groups(spark, "acgt"))), "depth") == [1, 1, 1, 1]


def test_empty_tables_give_no_rows(spark):
    none = spark.createDataFrame([], ROWS)
    assert pileup.position_stats(pileup.cells(none, groups(spark, "ACGT"))).count() == 0


def test_whole_run_support_and_its_stand_in(spark):
    g = groups(spark, "ACGTACGTAC")

    def call(specs):
        cells = pileup.cells(rows(spark, specs), g)
        return [(v["pos"], v["ref"], v["count"], v["depth"]) for v in variants.call_deletions(pileup.position_stats(cells), pileup.deletion_runs(pileup.placed_rows(rows(spark, specs), g)), g).collect()]

    assert call(["..---.....", "..---.....", ".........."]) == [(2, "GTA", 2, 3)]
    # staggered deletions support no whole run: the thinnest position stands in
    assert call(["..---.....", "..---.....", "....---...", "....---..."]) == [(2, "GTACG", 2, 4)]


def test_floors_of_snvs(spark):
    g = groups(spark, "ACGT")
    cells = pileup.cells(rows(spark, ["T...", "T...", "....", "...."]), g)
    counted = pileup.counted_positions(pileup.placed_rows(rows(spark, ["T...", "T...", "....", "...."]), g))
    assert [(v["pos"], v["alt"], v["count"]) for v in variants.call_snvs(counted).collect()] == [(0, "T", 2)]
    assert variants.call_snvs(counted, min_count=3).count() == 0
    assert variants.call_snvs(counted, min_fraction=0.6).count() == 0
    assert variants.call_snvs(counted, min_depth=5).count() == 0


def test_insertions_need_depth_and_a_position(spark):
    g = groups(spark, "ACGT")
    stats = pileup.position_stats(pileup.cells(rows(spark, ["...."] * 4), g))
    seen = spark.createDataFrame([(1, 2, "gg", 3), (1, 9, "A", 3), (1, -1, "A", 3), (1, 1, "A", 1)], "group_id bigint, pos int, seq string, count bigint")
    assert [(v["pos"], v["alt"], v["count"], v["depth"]) for v in variants.call_insertions(seen, stats, g).collect()] == [(2, "GG", 3, 4)]


@pytest.mark.parametrize(
    ("kind", "pos", "ref", "alt", "expected"),
    [
        ("snv", 8, "G", "A", ("silent", "silent (V2)")),
        ("snv", 3, "A", "G", ("missense", "M1V")),
        ("snv", 9, "A", "T", ("nonsense", "K3*")),
        ("del", 5, "GG", "", ("frameshift", "frameshift at 1")),
        ("del", 6, "GTG", "", ("inframe_indel", "Δ1 aa at 2")),
        ("ins", 6, "", "CCC", ("inframe_indel", "+1 aa at 2")),
        ("snv", 0, "G", "A", ("noncoding", "")),
    ],
)
def test_consequences(spark, kind, pos, ref, alt, expected):
    seq = "GGGATGGTGAAACCC"
    seq = seq if (kind, pos) != ("snv", 8) else "GGGATGGTAAAACCC"
    v = spark.createDataFrame([(1, pos, kind, ref, alt, 5, 10)], "group_id bigint, pos int, kind string, ref string, alt string, count bigint, depth bigint")
    frame = spark.createDataFrame([(1, seq, 3, 12)], "group_id bigint, ref_seq string, focus_start int, focus_end int")
    got = variants.classify(v, frame).collect()[0]
    assert (got["consequence"], got["effect"]) == expected
    none = spark.createDataFrame([(1, seq, None, None)], frame.schema)
    assert variants.classify(v, none).collect()[0]["consequence"] == ""


def test_all_codons(spark):
    plain = dict(zip(map("".join, itertools.product(BASES, repeat=3)), RESIDUES))

    def slow(codon):
        found = "".join(sorted({plain["".join(c)] for c in itertools.product(*(IUPAC[b] for b in codon))}))
        return found if len(found) == 1 else SHARED.get(found, "X")

    words = ["".join(c) for c in itertools.product(IUPAC, repeat=3)]
    got = {r["c"]: r["r"] for r in spark.createDataFrame([(w,) for w in words], "c string").select("c", translate_codon(F.col("c")).alias("r")).collect()}
    assert got == {w: slow(w) for w in words}
    assert len(codon_residues()) < 400
    odd = spark.createDataFrame([("AUGgug",), ("ATGA",), ("",), (None,), ("AT?",)], "s string")
    assert [r[0] for r in odd.select(translate(F.col("s"))).collect()] == ["MV", "M", "", None, "X"]


def test_consensus_ties_go_to_the_first_row(spark):
    cells = pileup.cells(rows(spark, ["T---", "G---", "-..."]), groups(spark, "ACGT"))
    assert column(pileup.consensus(cells), "symbol") == ["T", ".", ".", "."]


def test_window_consensus_lets_gaps_vote(spark):
    r, g = rows(spark, ["..--", "..--", "...."]), groups(spark, "ACGT")
    assert column(pileup.window_consensus(pileup.cells(r, g), pileup.placed_rows(r, g)), "symbol") == ["A", "C", "-", "-"]


def test_folding_keeps_the_mismatch(spark):
    doubled = spark.createDataFrame([(1, 0, "A", "A", 2), (1, 2, "G", "A", 2), (1, 1, "-", "C", 2), (1, 3, "C", "C", 2)], "row_id bigint, pos int, base string, ref_base string, ref_len int")
    assert column(pileup.fold_doubled(doubled), "base") == ["G", "C"]


def test_orderings(spark):
    placed = pileup.placed_rows(rows(spark, [".--.", "-...", "....", "T..."]), groups(spark, "ACGT"))
    order = lambda name: [r["row_id"] for r in orderings.ORDERINGS[name](placed).orderBy("place").collect()]
    assert order("length") == [2, 3, 1, 0]
    assert order("position") == [2, 3, 0, 1]
    assert order("mismatch") == [0, 1, 2, 3]


def test_rows_of_overlapping_windows_at_the_foremost_variants(spark, tmp_path):
    from pilewright.plans import catalog

    def spec(*at, width=200):
        return "".join("T" if c in at else "." for c in range(width))

    specs = [spec(50, 70), spec(50, 70, 150), spec(50, 150), spec(150, 199), spec(), spec()]
    ref = "ACG" * 66 + "AC"
    rows(spark, specs).write.parquet(str(tmp_path / "pileup_rows.parquet"))
    groups(spark, ref).write.parquet(str(tmp_path / "pileup_groups.parquet"))
    spark.createDataFrame([], FEATURES + ", loaded_at timestamp_ntz").write.parquet(str(tmp_path / "features.parquet"))
    spark.createDataFrame([], "construct_id bigint, seq string").write.parquet(str(tmp_path / "constructs.parquet"))
    got = catalog.QUERIES["variant_window_rows"](spark, str(tmp_path)).collect()
    want = set()
    for number, at in enumerate((50, 150, 70), 1):  # by share, then position; one row is too few for 199
        start = max(0, min(at - 30, 140))
        marks = [sum(c == "T" for c in s[start : start + 60]) for s in specs]
        for place, i in enumerate(sorted(range(6), key=lambda i: (-marks[i], i)), 1):
            want.add((1, number, i, marks[i], 60, place))
    assert {tuple(x[c] for c in ("group_id", "window_no", "row_id", "disagreements", "covered", "place")) for x in got} == want


def naive(d):
    """Average linkage by searching all pairs of clusters."""
    clusters, heights = [[i] for i in range(len(d))], []
    while len(clusters) > 1:
        h, i, j = min((np.mean([d[a][b] for a in x for b in y]), i, j) for i, x in enumerate(clusters) for j, y in enumerate(clusters) if i < j)
        heights.append(h)
        clusters[i] += clusters.pop(j)
    return sorted(heights)


def test_linkage_has_the_heights_of_the_naive_one():
    rng = random.Random(5)
    for _ in range(60):
        n = rng.randrange(2, 12)
        d = np.zeros((n, n))
        for i in range(n):
            for j in range(i):
                d[i, j] = d[j, i] = rng.random() * 10
        merges = clustering.average_linkage(d)
        assert np.allclose(sorted(h for *_, h in merges), naive(d))
        assert sorted(clustering.leaves(merges, n)) == list(range(n))


def test_cluster_order_puts_subpopulations_together(spark):
    placed = pileup.placed_rows(rows(spark, ["TT....", "....AA", "TT...C", "G...AA", "......"]), groups(spark, "ACGTCG"))
    got = [r["row_id"] for r in clustering.cluster_order(placed).orderBy("place").collect()]
    assert abs(got.index(0) - got.index(2)) == 1 and abs(got.index(1) - got.index(3)) == 1


def exact_chain(sets):
    """The chain over a full matrix of fractions."""
    d = {(i, j): Fraction(len(x ^ y)) for i, x in enumerate(sets) for j, y in enumerate(sets) if i != j}
    weight, merges, path = dict.fromkeys(range(len(sets)), 1), [], []
    while len(weight) > 1:
        path = path or [min(weight)]
        near = min((i for i in weight if i != path[-1]), key=lambda i: (d[path[-1], i], i))
        if len(path) < 2 or near != path[-2]:
            path.append(near)
            continue
        keep, drop = sorted(path[-2:])
        merges.append((keep, drop, float(d[keep, drop])))
        for i in weight.keys() - {keep, drop}:
            d[keep, i] = d[i, keep] = (weight[keep] * d[keep, i] + weight[drop] * d[drop, i]) / (weight[keep] + weight[drop])
        weight[keep] += weight.pop(drop)
        del path[-2:]
    return merges


def test_linkage_of_marks_is_the_exact_chain_with_ties():
    rng = random.Random(6)
    for _ in range(40):
        sets = list(dict.fromkeys(frozenset(c for c in range(12) if rng.random() < 0.3) for _ in range(rng.randrange(2, 60))))
        if len(sets) > 1:
            assert clustering.linkage_of_marks(clustering.marks([sorted(s) for s in sets])) == exact_chain(sets)


def test_cluster_order_of_groups_above_the_matrix_bound(spark, monkeypatch):
    # by text the row with an early error of its own stands apart from its subpopulation
    placed = pileup.placed_rows(rows(spark, ["..TT....", ".....AA.", "..TT...C", "G....AA.", ".T......"]), groups(spark, "ACGTCGTA"))
    order = lambda: [r["row_id"] for r in clustering.cluster_order(placed).orderBy("place").collect()]
    want = order()
    monkeypatch.setattr(clustering, "MAX_SIGNATURES", 2)
    assert order() == want and abs(want.index(1) - want.index(3)) == 1 and abs(want.index(0) - want.index(2)) == 1


@pytest.mark.parametrize("block", [2_048, 5])
def test_nearest_signatures_of_groups_of_more_than_twenty_rows(spark, monkeypatch, block):
    monkeypatch.setattr(clustering, "BLOCK_SIGNATURES", block)
    rng = random.Random(7)
    specs = ["".join("T" if rng.random() < 0.3 else "." for _ in range(10)) for _ in range(60)]
    r = rows(spark, specs).unionByName(rows(spark, ["....A.....", "....A....."], group=2, start=100)).unionByName(rows(spark, ["T........-"], group=2, start=102))
    r = r.unionByName(rows(spark, [".........."] * 2, group=3, start=200))
    placed = pileup.placed_rows(r, groups(spark, "ACGACGACGA", "ACGACGACGA", "ACGACGACGA"))
    first = {}
    for i, s in enumerate(specs):
        first.setdefault(frozenset(c for c, x in enumerate(s) if x == "T"), i)
    want = {(2, 100, 2, 102, 2), (2, 102, 1, 100, 2), (3, 200, 2, None, None)}
    for s, i in first.items():
        away, near = min((len(s ^ o), j) for o, j in first.items() if j != i)
        want.add((1, i, sum(frozenset(c for c, x in enumerate(t) if x == "T") == s for t in specs), near, away))
    assert len(first) > 20 and {tuple(x) for x in clustering.nearest_signatures(placed).collect()} == want


def test_sampling_is_exact_and_fixed(spark):
    reads = spark.range(1000).select(F.lit("a").alias("file"), F.col("id").alias("ord"))
    draw = lambda df: sorted(r["ord"] for r in sampling.draw_pooled(df, 20, 3).collect())
    assert len(draw(reads)) == 20 and draw(reads) == draw(reads.repartition(7))
    assert sampling.draw_pooled(reads, 0).count() == 1000 and sampling.draw_pooled(reads, -1).count() == 0
    assert sampling.draw_per_file(reads, 5).select("seen").distinct().collect()[0][0] == 1000


FEATURES = "feature_id bigint, construct_id bigint, feature_ord bigint, type string, span_start int, span_end int, strand int, label string, wraps_origin boolean, color string"


def test_features(spark):
    f = spark.createDataFrame(
        [(1, 1, 0, "CDS", 10, 40, 1, "cat", False, None), (2, 1, 1, "gene", 10, 40, 1, "cat", False, None), (3, 1, 2, "gene", 50, 60, 1, "x", False, None), (4, 1, 3, "source", 0, 100, None, None, False, None), (5, 1, 4, "insert", 90, 10, 1, "w", True, None), (6, 1, 5, None, 200, 210, 1, None, None, None)], FEATURES
    )
    c = spark.createDataFrame([(1, "A" * 100)], "construct_id bigint, seq string")
    assert {r[0] for r in features.kept_features(f).select("feature_id").collect()} == {1, 3, 5, 6}
    spans = features.feature_spans(f, c)
    assert {(r["feature_id"], r["start"], r["end"]) for r in spans.filter("feature_id in (5, 6)").collect()} == {(5, 90, 100), (5, 0, 10)}
    assert features.flank_lengths(f, c).count() == 0
    assert features.focus_flanks(f, c, "CAT").collect()[0][1:] == (10, 60)
    at = spark.createDataFrame([(1, 39), (1, 40), (1, 95)], "construct_id bigint, pos int")
    assert {(r["pos"], r["feature_id"]) for r in features.features_at(spans.filter("feature_id != 4"), at).collect()} == {(39, 1), (39, 2), (95, 5)}


def test_lanes_drop_the_least_informative():
    import pandas as pd

    p = pd.DataFrame({"feature_id": [1, 2, 3, 4], "type": ["misc", "CDS", "promoter", "misc"], "start": [0, 0, 0, 50], "end": [40, 40, 40, 60]})
    lanes = dict(features.plan_lanes(p, 2).itertuples(index=False))
    assert lanes[1] == -1 and sorted([lanes[2], lanes[3]]) == [0, 1] and lanes[4] == 0


def test_streamed_counts_equal_batch(spark, tmp_path):
    from pilewright.streaming.counts import streamed_position_stats

    r, g = rows(spark, ["....", "..--", ".T.."]), groups(spark, "ACGT")
    r.unionByName(r).select("row_id", "group_id", "read_ord", "spec", F.col("loaded_at").cast("timestamp").alias("loaded_at")).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(spark.read.parquet(str(tmp_path / "in")).schema).parquet(str(tmp_path / "in"))
    q = streamed_position_stats(stream, g).writeStream.outputMode("complete").format("memory").queryName("counts").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    want = pileup.position_stats(pileup.cells(r, g))
    assert sorted(map(tuple, spark.table("counts").collect())) == sorted(map(tuple, want.collect()))


def test_widths_are_checked(spark):
    g = groups(spark, "ACGT", parents=("ACG",))
    pileup.check_widths(rows(spark, ["....", None]), groups(spark, "ACGT"))
    with pytest.raises(ValueError, match=r"parent 1 \(3 of 4\)"):
        pileup.check_widths(rows(spark, ["...."]), g)
    with pytest.raises(ValueError, match=r"row 1 \(5 of 4\)"):
        pileup.check_widths(rows(spark, ["....", "....."]), groups(spark, "ACGT"))


def test_lollipops_are_staggered(spark):
    positions = [0, 1, 2, 3, 4, 30, 31]
    called = spark.createDataFrame([(1, p, "snv", "A", "T") for p in reversed(positions)], "group_id bigint, pos int, kind string, ref string, alt string")
    got = [r["tier"] for r in variants.lollipop_tiers(called).orderBy("pos").collect()]
    last, want = [-1e9] * 3, []
    for p in positions:
        x = 4 * (p + 0.5)
        tier = next((t for t in range(3) if x - last[t] >= 11), None)
        if tier is not None:
            last[tier] = x
        want.append(2 if tier is None else tier)
    assert got == want and set(got) == {0, 1, 2}
    assert variants.lollipop_tiers(called.limit(0)).count() == 0


def test_residues_are_named_against_the_parent(spark):
    told = spark.createDataFrame([(1, "MVKF", "MLKP", None), (2, "MVKF", "MVRF", "MAKF"), (3, "MV", "MA", "MA")], "group_id bigint, ref_protein string, consensus_protein string, parent_protein string")
    got = {(r["group_id"], r["name"], r["kind"]) for r in proteins.residue_changes(told).collect()}
    assert got == {(1, "V2L", "plain"), (1, "F4P", "plain"), (2, "A2V", "expected"), (2, "K3R", "unexpected"), (3, "A2V", "missing")}


def test_signatures_restricted_to_columns(spark):
    placed = pileup.placed_rows(rows(spark, ["CCCC", "..CC", "....", "..CC"]), groups(spark, "AAAA"))
    columns = spark.createDataFrame([(1, 3)], "group_id bigint, pos int")
    assert [r["row_id"] for r in clustering.cluster_order(placed, columns).orderBy("place").collect()] == [0, 1, 3, 2]


def test_lanes_equal_a_search(spark):
    import pandas as pd

    rng = random.Random(4)
    for _ in range(20):
        pieces = pd.DataFrame([(i, rng.choice(["CDS", "promoter", "x"]), s, s + rng.randrange(1, 40)) for i in range(12) for s in [rng.randrange(0, 150)]], columns=["feature_id", "type", "start", "end"])
        lanes = features.plan_lanes(pieces)
        drawn = pieces.merge(lanes, on="feature_id")
        drawn = drawn[drawn["lane"] >= 0].sort_values("start")
        assert drawn["lane"].max() < 3
        for _, lane in drawn.groupby("lane"):
            assert all(e + 0.75 <= s for e, s in zip(lane["end"], lane["start"].iloc[1:]))


def test_counts_of_positions_equal_those_of_cells(spark):
    rng = random.Random(3)
    specs = ["".join(rng.choice("ACGTN.--..acg") for _ in range(12)) for _ in range(60)] + ["-" * 12, "", None, "--" + "." * 20]
    r, g = rows(spark, specs), groups(spark, "acgtNACGTACG")
    want = {tuple(x) for x in pileup.position_stats(pileup.cells(r, g)).collect()}
    counted = pileup.counted_positions(pileup.placed_rows(r, g))
    assert {tuple(x) for x in counted.select("group_id", "pos", "depth", "matches", "deletions").collect()} == want
    assert pileup.counted_positions(pileup.placed_rows(spark.createDataFrame([], ROWS), g)).count() == 0


@pytest.mark.parametrize("listed", [1, 5, 128])
def test_linkage_looks_for_the_nearest_in_lists_first(monkeypatch, listed):
    """No row that is not listed falls below the bound, and the lists, short or long, give the merges of the full distances."""
    monkeypatch.setattr(clustering, "LISTED", listed)
    rng = np.random.default_rng(5)
    base = rng.random((9, 70)) < 0.3
    bits = np.unique(np.concatenate([b ^ (rng.random((10, 70)) < 0.04) for b in base]), axis=0)
    bits = bits[rng.permutation(len(bits))].astype(float)
    distance = (bits[:, None] != bits[None]).sum(2)
    near, away, lists, bound = clustering.nearest_rows(bits)
    np.fill_diagonal(distance, 999)
    assert near.tolist() == distance.argmin(1).tolist() and away.tolist() == distance.min(1).tolist()
    for i, row in enumerate(distance):
        assert len(lists[i]) <= listed and np.delete(row, lists[i]).min() >= bound[i]
    assert clustering.linkage_of_marks(bits) == exact_chain([frozenset(np.flatnonzero(b).tolist()) for b in bits])
