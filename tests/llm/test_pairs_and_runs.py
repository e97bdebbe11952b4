import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pilewright.llm import subpopulations as S
from pilewright.llm.queries import foremost_variants
from pilewright.llm.rows import contents, differences, overlaps
from pilewright.llm.runs import Consensus, Segmenter, Steps, collapse_runs
from pilewright.llm.stable_sample import frozen_sample
from tests.pileups import ROWS, groups, rows


def least_cost(n, within, penalty):
    """The plain recursion over all starts: (least sum, starts of the runs)."""
    best, back = [0.0], []
    for j in range(n):
        value, i = min((best[i] + within(i, j) + penalty, i) for i in range(j + 1))
        best.append(value)
        back.append(i)
    starts, j = [], n
    while j:
        j = back[j - 1]
        starts.append(j)
    return best[-1], starts[::-1]


def pruned(events, steps, penalty, cost):
    segmenter = Segmenter(penalty, cost)
    runs = [r for k, row in enumerate(events) for r in segmenter.push((k,), steps[k], row)] + segmenter.finish()
    return [first[0] for first, _, _ in runs], [k for first, last, n in runs for k in range(first[0], first[0] + n) if k <= last[0]]


@pytest.mark.parametrize("cost", [Steps, Consensus])
def test_segmentation_is_the_optimum_of_the_recursion(cost):
    rng = np.random.default_rng(1)
    for _ in range(60):
        n = int(rng.integers(1, 40))
        events = np.where(rng.random((n, 12)) < 0.15, rng.integers(65, 69, (n, 12)), 65)
        for k in range(1, n):
            if rng.random() < 0.7:
                events[k] = np.where(rng.random(12) < 0.1, events[k], events[k - 1])
        steps = [None, *map(float, (events[1:] != events[:-1]).sum(1))]

        def within(i, j):
            if cost is Steps:
                return sum(steps[i + 1 : j + 1])
            part = events[i : j + 1]
            return sum(len(part) - max(np.unique(c, return_counts=True)[1]) for c in part.T)

        starts, seen = pruned(events, steps, 2.5, cost)
        assert seen == list(range(n))
        value = sum(within(a, z - 1) + 2.5 for a, z in zip(starts, [*starts[1:], n]))
        assert value == least_cost(n, within, 2.5)[0]
        if cost is Steps:
            assert starts == [0, *(k for k in range(1, n) if steps[k] > 2)]


def test_consensus_ends_a_drift_that_no_step_would(spark):
    """Each row differs from the one before it at one position, and the last from the first at all."""
    specs = ["C" * k + "." * (20 - k) for k in range(21)]
    r, g = rows(spark, specs), groups(spark, "A" * 20)
    assert [x["n_rows"] for x in collapse_runs(r, g).collect()] == [21]
    drift = collapse_runs(r, g, cost=Consensus).orderBy("first_ord").collect()
    assert len(drift) > 1 and sum(x["n_rows"] for x in drift) <= 21
    same = ["....", "...C", "....", "CCCC", "CCCC"]
    assert [(x["first_ord"], x["last_ord"]) for x in collapse_runs(rows(spark, same), groups(spark, "AAAA"), cost=Consensus).orderBy("first_ord").collect()] == [(0, 2), (3, 4)]


def brute_runs(specs, ref, most=2):
    grid = contents([s or "" for s in specs], [ref] * len(specs))
    out, first = [], 0
    for i in range(1, len(specs) + 1):
        if i == len(specs) or specs[i] is None or specs[i - 1] is None or differences(grid[i], grid[i - 1])[1] > most:
            if i - first > 1:
                out.append((first, i - 1, i - first))
            first = i
    return out


@pytest.mark.parametrize("parts", [1, 5])
def test_runs_over_any_partitioning(spark, parts):
    rng = random.Random(4)
    ref = "".join(rng.choice("ACGT") for _ in range(30))
    specs, now = [], "." * 30
    for _ in range(160):
        if rng.random() < 0.2:
            now = "".join(rng.choice("ACGT.") for _ in range(30))
        specs.append(None if rng.random() < 0.05 else now[:5] + rng.choice("ACGT.a") + now[6:])
    r = rows(spark, specs).unionByName(rows(spark, specs[:50])).withColumn("read_ord", F.col("read_ord") * 3).withColumn("first_ord", F.lit("clash"))
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = sorted((x["first_ord"] // 3, x["last_ord"] // 3, x["n_rows"], x["duration_us"]) for x in collapse_runs(r, groups(spark, ref)).collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert got == [(a, z, n, (z - a) * 1_000_000) for a, z, n in brute_runs(specs, ref)]


def test_runs_of_nothing(spark):
    assert collapse_runs(spark.createDataFrame([], ROWS), groups(spark, "ACGT")).count() == 0
    assert collapse_runs(rows(spark, [None, "....", None]), groups(spark, "ACGT")).count() == 0
    # rows that cover no common position differ nowhere; empty specs cover nothing
    assert collapse_runs(rows(spark, ["..--", "--..", ""]), groups(spark, "ACGT")).select("n_rows").collect()[0][0] == 3


def planted(rng, width=120, populations=12, size=9):
    ref = "".join(rng.choice("ACGT") for _ in range(width))
    specs, truth = [], []
    for p in range(populations):
        base = "".join(rng.choice("ACGT") if rng.random() < 0.25 else "." for _ in range(width))
        for _ in range(rng.randrange(1, size)):
            row = "".join(rng.choice("ACGT") if rng.random() < 0.01 else c for c in base)
            a, z = rng.randrange(0, 8), width - rng.randrange(0, 8)
            specs.append("-" * a + row[a:z] + "-" * (width - z))
            truth.append(p)
    return ref, specs, truth


def test_subpopulations(spark):
    ref, specs, truth = planted(random.Random(8))
    specs += [specs[0], None]
    r = rows(spark, specs)
    members = S.checkpointed(S.find_subpopulations(r.unionByName(r).withColumn("content", F.lit("clash")), groups(spark, ref)))
    got = {x["row_id"]: x["subpopulation"] for x in members.collect()}
    assert len(got) == len(specs) - 1
    by = {}
    for i, p in enumerate([*truth, truth[0]]):
        by.setdefault(p, set()).add(got[i])
    assert all(len(v) == 1 for v in by.values()) and len({min(v) for v in by.values()}) == len(by)
    grid = contents(specs[:-1], [ref] * (len(specs) - 1))
    want = {(i, j) for i in range(len(grid)) for j in range(i + 1, len(grid)) if (d := differences(grid[i], grid[j]))[1] <= 0.06 * d[0]}
    assert {tuple(x) for x in S.similar_pairs(members).collect()} == want
    told = S.describe_subpopulations(members).collect()
    assert sum(x["n_rows"] for x in told) == len(specs) - 1
    assert all(got[t] == x["subpopulation"] for x in told for t in x["typical_rows"])


def test_rounds_in_tasks_and_as_jobs_give_the_same(spark):
    """Two constructs of cliques with weak links between them; average linkage keeps them apart."""
    rng = random.Random(3)
    links = []
    for construct in (1, 2):
        for clique in range(3):
            ids = [100 * construct + 10 * clique + k for k in range(4)]
            links += [(construct, a, b, 0.96 + rng.random() / 30) for a in ids for b in ids if a < b]
        links += [(construct, 100 * construct + 10 * c, 100 * construct + 10 * c + 10, 0.9) for c in range(2)]
    df = spark.createDataFrame(links, "construct_id bigint, a bigint, b bigint, total double").coalesce(1).withColumn("links", F.lit(1).cast("bigint"))
    want = {100 * c + 10 * q + k: 100 * c + 10 * q for c in (1, 2) for q in range(3) for k in range(1, 4)}
    assert dict(map(tuple, S.merge_nearest(df, 0.94, 1_000).collect())) == want
    assert dict(map(tuple, S.merge_nearest(df, 0.94, 0).collect())) == want


def recall(spark, specs, ref, fewest=1, **how):
    """The share of the pairs that share ``fewest`` positions and differ at no more than 6 % of them, and wrong ones."""
    members = S.checkpointed(S.find_subpopulations(rows(spark, specs), groups(spark, ref), **how))
    grid = contents(specs, [ref] * len(specs))
    both, differ = overlaps(grid, grid)
    near = np.triu(differ <= 0.06 * both + 1e-9, 1)
    want = set(zip(*(x.tolist() for x in np.nonzero(near & (both >= fewest)))))
    got = {tuple(x) for x in S.similar_pairs(members).collect()}
    return len(got & want) / len(want), {(i, j) for i, j in got if not near[i, j]}


def test_rows_that_cover_a_half(spark):
    rng = random.Random(6)
    ref = "".join(rng.choice("ACGT") for _ in range(150))
    left, right = "A" + "." * 74 + "-" * 75, "-" * 70 + "." * 80
    specs = [left, left[:9] + "C" + left[10:], left, right, right[:99] + "-" + right[100:]]
    assert recall(spark, specs, ref) == (1.0, set())


def partly_covered(rng, populations, size, width=160):
    ref = "".join(rng.choice("ACGT") for _ in range(width))
    specs = []
    for _ in range(populations):
        base = "".join(rng.choice("ACGT") if rng.random() < 0.5 else "." for _ in range(width))
        for _ in range(size):
            row = "".join(rng.choice("ACGT") if rng.random() < 0.012 else c for c in base)
            a = rng.choice([0, 0, rng.randrange(0, width * 5 // 8)])
            z = min(width, a + rng.choice([width, rng.randrange(width * 3 // 8, width)]))
            specs.append("-" * a + row[a:z] + "-" * (width - z))
    return ref, specs


@pytest.mark.parametrize("task_rows", [None, 20])
def test_rows_of_partial_coverage(spark, task_rows):
    ref, specs = partly_covered(random.Random(10), 12, 12)
    # Fewer than 8 positions agree by chance across populations.
    share, wrong = recall(spark, specs, ref, 8, task_rows=task_rows)
    assert share >= 0.99 and not wrong


def test_components_keep_all_that_can_merge():
    rng = np.random.default_rng(3)
    grid = rng.integers(65, 69, (1, 100)).repeat(30, 0).astype(np.uint8)
    for i in range(1, 30):
        grid[i] = grid[i - 1]
        grid[i, rng.integers(0, 100, 4)] = 84
    a, b, total, links = S.component_links(grid, 0.94)
    assert len(a) == 30 * 29 // 2 and (total / links).min() < 0.94
    old, new = S.merge_in_memory(a, b, total, links, 0.94)
    cluster = dict(zip(range(30), range(30))) | dict(zip(old.tolist(), new.tolist()))
    members = {}
    for i, c in cluster.items():
        members.setdefault(c, []).append(i)
    between = lambda x, y: np.mean([1 - (grid[i] != grid[j]).mean() for i in x for j in y])
    assert len(members) > 1 and all(between(x, y) < 0.94 for c, x in members.items() for d, y in members.items() if c < d)


def test_a_subpopulation_of_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(S, "BLOCK_ROWS", 4)
    members = spark.createDataFrame([(i, 1, 0, 30, "ACGT" * 5) for i in range(30)], S.MEMBERS)
    assert S.similar_pairs(members).distinct().count() == 30 * 29 // 2 == S.similar_pairs(members).count()


def test_typical_rows_of_a_subpopulation_of_many_blocks(spark, monkeypatch):
    """Positions near 50/50, so that blocks have other consensuses than the whole."""
    monkeypatch.setattr(S, "BLOCK_ROWS", 8)
    rng = random.Random(12)
    texts = ["".join(rng.choices("AC", (0.52, 0.48))[0] for _ in range(6)) + "G" * 34 for _ in range(300)]
    texts = [" " * rng.randrange(3) + t[2:] if rng.random() < 0.2 else t for t in texts]
    texts = [t.rjust(40) for t in texts]
    members = spark.createDataFrame([(i, 1, 0, 300, t) for i, t in enumerate(texts)], S.MEMBERS)
    centre = [max(sorted(set(c) - {" "}), key=c.count) for c in zip(*texts)]
    away = lambda t: sum(x not in (" ", y) for x, y in zip(t, centre)) / len(t.strip())
    want = sorted(range(300), key=lambda i: (away(texts[i]), i))[:3]
    assert [tuple(x) for x in S.describe_subpopulations(members).collect()] == [(1, 0, 300, want)]
    monkeypatch.setattr(S, "BLOCK_ROWS", 300)
    assert [tuple(x) for x in S.describe_subpopulations(members).collect()] == [(1, 0, 300, want)]


def test_no_subpopulations(spark):
    members = S.find_subpopulations(spark.createDataFrame([], ROWS), groups(spark, "ACGT"))
    assert members.count() == 0 and S.similar_pairs(members).count() == 0


READS = "file string, ord bigint, name string, seq string, batch_no int, sample_hash string"


def test_sample_is_append_only_and_exact(spark):
    data = [("f", i, f"n{i % 900}" if i % 50 else None, "ACGT" * (i % 900 % 7), 1 + i // 400, "clash") for i in range(1600)]
    reads = spark.createDataFrame(data, READS)
    draw = lambda df: {(x["name"], x["seq"], x["batch_no"]) for x in frozen_sample(df, ["name", "seq"], "batch_no", 0.1, "s").collect()}
    whole = draw(reads)
    for upto in (1, 2, 3):
        assert draw(reads.filter(F.col("batch_no") <= upto).repartition(5)) == {x for x in whole if x[2] <= upto}
    first = {}
    for _, _, n, s, b, _ in data:
        first.setdefault((n, s), b)
    for b in (1, 2, 3):
        size = sum(v == b for v in first.values())
        assert sum(x[2] == b for x in whole) == -(-size // 10)
    assert draw(reads.limit(0)) == set()


def test_rows_without_a_batch_displace_nothing(spark):
    schema = "name string, seq string, batch_no int"
    draw = lambda rows: {tuple(x)[:2] for x in frozen_sample(spark.createDataFrame(rows, schema), ["name", "seq"], "batch_no", 0.25, "s").select("name", "seq").collect()}
    first = [(f"a{i}", "A", 1) for i in range(100)]
    late = [(f"b{i}", "A", None) for i in range(100)]
    second = [(f"b{i}", "A", 2) for i in range(100)]
    assert draw(first + late) == draw(first) and draw(first + late + second) > draw(first + late)


VARIANTS = "variant_id bigint, group_id bigint, pos int, kind string, count bigint, depth bigint, consequence string, rank_no string, loaded_at int"


def test_top_n_with_ties_copies_and_nulls(spark):
    v = [(1, 1, 5, "snv", 5, 10, " Missense ", "x", 0), (2, 1, 5, "snv", 5, 10, "missense", "x", 0), (3, 1, 4, "snv", 0, 0, "FRAMESHIFT", "x", 0), (4, 1, 4, "snv", None, 5, None, "x", 0), (5, 1, 9, "snv", 9, 9, "?", "x", 0), (6, 1, 1, "snv", 9, None, "silent", "x", 0), (7, None, 1, "snv", 1, 1, "silent", "x", 0)]
    df = spark.createDataFrame([*v, *[(*x[:-1], 1) for x in v] * 3], VARIANTS)
    got = foremost_variants(df).select("group_id", "_rank_no", "variant_id").orderBy("group_id", "_rank_no").collect()
    assert [tuple(x) for x in got] == [(None, 1, 7), (1, 1, 3), (1, 2, 1), (1, 3, 2), (1, 4, 6), (1, 5, 5)]
    assert foremost_variants(df.limit(0)).count() == 0
    plan = foremost_variants(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 2


def test_estimates_of_a_plan_do_not_grow_with_the_rounds(spark):
    """A long row of links takes many rounds; each joins the links of the round before it with what merged, twice."""
    links = spark.createDataFrame([(1, k, k + 1, 95, 100) for k in range(40)], "construct_id bigint, a bigint, b bigint, total bigint, links bigint")
    merged = spark.createDataFrame([(k, k - 1) for k in range(1, 40, 2)], "node bigint, cluster bigint")
    for _ in range(6):
        links = S.checkpointed(S.renamed_links(links, merged))
        assert links._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().bit_length() <= 64
        merged = S.checkpointed(links.join(merged, F.col("a") == F.col("cluster"), "left").select(F.col("b").alias("node"), F.coalesce("cluster", "a").alias("cluster")).distinct())
    assert links.columns == ["construct_id", "a", "b", "total", "links"]


@pytest.mark.parametrize("one_part", [1 << 18, 0])
def test_the_size_of_a_construct_does_not_change_its_subpopulations(spark, monkeypatch, one_part):
    """Rows that cover all, a part or little of the width, at distances about the limit; in one task and by buckets."""
    monkeypatch.setattr(S, "ONE_PART", one_part)
    monkeypatch.setattr(S, "BUCKET_ROWS", 16)
    monkeypatch.setattr(S, "FEW_ROWS", 6)
    rng = random.Random(21)
    ref, specs = partly_covered(rng, 14, 8)
    for _ in range(14):
        row = rng.choice(specs)
        specs += [row := "".join(rng.choice("ACGT") if c != "-" and rng.random() < 0.05 else c for c in row) for _ in range(6)]
    specs += ["-" * 160, "-" * 70 + "." * 5 + "-" * 85, "-" * 72 + "..A" + "-" * 85, "." * 160]
    tell = lambda task_rows: sorted(map(tuple, S.find_subpopulations(rows(spark, specs), groups(spark, ref), task_rows=task_rows).collect()))
    want = tell(None)
    assert tell(20) == want and 1 < len({x[2] for x in want}) < len(want) == len(specs)
