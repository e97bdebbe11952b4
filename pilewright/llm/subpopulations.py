"""Rows into clusters of mutually similar rows: reciprocal-nearest-neighbour average linkage on a sparse graph.

1. Equal contents become one node, so copies cost nothing further on.
2. Sparse graph: all pairs of nodes within connected components of similar nodes, in constructs of any size; no average over
   links that leave a component reaches the threshold, so that nothing is lost. A construct of up to ``TASK_ROWS`` rows
   meets in one task, which compares all of its nodes. In larger ones the core, which most rows cover, is dealt into more
   parts than similar rows have differences, so that they agree in a part at least and meet in its bucket; rows that
   do not cover the core are compared with all. One bit a position tells most of those apart that are not similar; none that are.
3. Rounds: all pairs of clusters that are each other's nearest are merged at once; the similarity of two clusters is the
   average over all positions that their rows share, a quotient of whole numbers. Rounds end when no average reaches
   the threshold. Components of larger constructs take their rounds by themselves, and one of more than ``TASK_LINKS`` as Spark jobs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pilewright.llm.rows import UNCOVERED, as_strings, contents, differences, from_strings, overlaps, rows_with_reference
from pilewright.tables import checkpointed

#: Rows of a construct that one task compares with each other: their similarities are 32 MB at most.
TASK_ROWS = 2_048
#: Nodes of a construct up to which rows meet that agree in one part of the core; in larger ones they must agree in two, of one part more.
ONE_PART = 1 << 18
#: Rows of a bucket that are compared as a block; those up to which blocks are compared many at a time.
BUCKET_ROWS, FEW_ROWS = 1_024, 48
#: Of clusters that reach the threshold, those are nearest that agree at most positions of those shared and these many more: few
#: shared positions that agree by chance come last.
DOUBT = 16
#: Links whose rounds one task takes on: about 32 bytes each.
TASK_LINKS = 2_000_000
#: Rows that are compared as a block; pairs within blocks that are compared at once.
BLOCK_ROWS, PAIRS = 256, 1 << 15

MEMBERS = "row_id bigint, construct_id bigint, subpopulation bigint, n_rows bigint, content string"


def row_contents(joined: DataFrame) -> DataFrame:
    """``row_id, construct_id, content`` of rows with their reference; a space stands for no coverage."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                text = as_strings(contents(b.column(2), b.column(3)), pc.utf8_length(b.column(3)).to_numpy())
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), text], names=["row_id", "construct_id", "content"])

    return joined.select("row_id", "construct_id", "spec", "ref_seq").mapInArrow(read, "row_id bigint, construct_id bigint, content string")


def cores(nodes: DataFrame) -> DataFrame:
    """``construct_id, width, n, low, high``: the number of nodes, and the part of the width that rows cover which miss little of it."""
    first, last = F.length("content") - F.length(F.ltrim("content")), F.length(F.rtrim("content"))
    ends = nodes.select("construct_id", F.length("content").alias("w"), first.alias("first"), last.alias("last"))
    widths = ends.groupBy("construct_id").agg(F.max("w").alias("width"), F.count(F.lit(1)).alias("n"))
    inside = ends.join(widths, "construct_id").groupBy("construct_id", "width", "n")
    found = inside.agg(F.max(F.when(F.col("first") <= 0.15 * F.col("width"), F.col("first"))).alias("low"), F.min(F.when(F.col("last") >= 0.85 * F.col("width"), F.col("last"))).alias("high"))
    return found.select("construct_id", "width", "n", F.coalesce("low", F.lit(0)).alias("low"), F.coalesce("high", "width").alias("high"))


def sketches(nodes: DataFrame, most: float) -> DataFrame:
    """``node, construct_id, sketch, buckets`` of the nodes that cover anything; no buckets where a row does not cover the core.

    Rows of ``width`` positions differ at no more than a fixed number if they are similar. ``sketch`` has words of 64
    positions in turn: a bit of each content, and what is covered.
    """

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            construct, frames = b.column(1).to_numpy(), np.stack([b.column(i).to_numpy() for i in range(3, 7)], 1)
            all_rows = from_strings(b.column(2))
            for c in np.unique(construct):
                here = np.flatnonzero(construct == c)
                width, n, low, high = frames[here[0]].tolist()
                grid = all_rows[here, :width]
                grid = np.pad(grid, ((0, 0), (0, -(-width // 64) * 64 - grid.shape[1])))
                cover = grid != UNCOVERED
                words = np.stack([np.packbits(x, axis=1).view(np.uint64) for x in (cover & ((grid >> 1) & 1 == 1), cover)], 2)
                agree = 1 if n <= ONE_PART else 2
                parts = int(most * width + 1e-9) + agree
                rng = np.random.default_rng([width, parts])
                factor, turn = (rng.integers(1, 1 << 63, k, dtype=np.uint64) | np.uint64(1) for k in (width, parts))
                core = (grid[:, low:high].astype(np.uint64) + np.uint64(7)) * factor[low:high]
                part = np.stack([core[:, k::parts].sum(1, dtype=np.uint64) for k in range(parts)], 1) * turn
                part = (part ^ (part >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
                buckets = np.stack([part[:, list(k)].sum(1, dtype=np.uint64) + np.uint64(i) for i, k in enumerate(combinations(range(parts), agree))], 1)
                inside, covers = cover[:, low:high].all(1), cover.any(1)
                lists = pa.ListArray.from_arrays(np.concatenate(([0], np.cumsum(inside[covers] * buckets.shape[1]))).astype(np.int32), pa.array(buckets[inside & covers].view(np.int64).ravel()))
                flat = np.ascontiguousarray(words[covers]).view(np.uint8).ravel()
                offsets = (np.arange(covers.sum() + 1) * words.shape[1] * 16).astype(np.int32)
                text = pa.Array.from_buffers(pa.binary(), int(covers.sum()), [None, pa.py_buffer(offsets), pa.py_buffer(flat)])
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(here[covers])), pa.array(construct[here[covers]]), text, lists], names=["node", "construct_id", "sketch", "buckets"])

    framed = nodes.join(cores(nodes), "construct_id").select("node", "construct_id", "content", *(F.col(c).cast("bigint").alias(c) for c in ("width", "n", "low", "high")))
    return framed.mapInArrow(sketch, "node bigint, construct_id bigint, sketch binary, buckets array<bigint>")


def words_of(sketch: pa.Array) -> np.ndarray:
    """Sketches as rows of words, those of narrower constructs with nothing covered at their ends."""
    n = len(sketch)
    offsets = np.frombuffer(sketch.buffers()[1], np.int32)[sketch.offset : sketch.offset + n + 1]
    length, data = np.diff(offsets), np.frombuffer(sketch.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    out = np.zeros((n, int(length.max(initial=0))), np.uint8)
    out[np.arange(out.shape[1]) < length[:, None]] = data
    return out.view(np.uint64)


def may_be_similar(x: np.ndarray, y: np.ndarray, most: float) -> np.ndarray:
    """Whether sketches (words last, broadcast) differ at no more positions than similar rows do."""
    shape = np.broadcast_shapes(x.shape[:-1], y.shape[:-1])
    both, differ = np.zeros(shape, np.int32), np.zeros(shape, np.int32)
    for k in range(0, x.shape[-1], 2):
        shared = x[..., k + 1] & y[..., k + 1]
        both += np.bitwise_count(shared)
        differ += np.bitwise_count((x[..., k] ^ y[..., k]) & shared)
    return (both > 0) & (differ <= most * both + 1e-9)


def pairs_in_lists(size: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Each row of lists of these sizes with those after it in its list, ``PAIRS`` at a time."""
    after = np.repeat(np.cumsum(size), size) - np.arange(int(size.sum())) - 1
    upto = np.cumsum(after)
    for begin in range(0, int(upto[-1]) if len(upto) else 0, PAIRS):
        pair = np.arange(begin, min(begin + PAIRS, int(upto[-1])))
        i = np.searchsorted(upto, pair, "right")
        yield i, i + 1 + pair - (upto[i] - after[i])


def candidates(nodes: DataFrame, most: float) -> DataFrame:
    """``a, b`` (a < b) of all similar nodes of the constructs, and of a few besides."""
    sketched = checkpointed(sketches(nodes, most))
    entries = sketched.select("construct_id", F.explode("buckets").alias("bucket"), "node", "sketch")
    sizes = sketched.select("construct_id", F.explode("buckets").alias("bucket")).groupBy("construct_id", "bucket").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)
    spread = entries.join(sizes, ["construct_id", "bucket"]).withColumn("blocks", F.ceil(F.col("n") / BUCKET_ROWS)).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")))
    blocks = spread.groupBy("construct_id", "bucket", "blocks", "block").agg(F.collect_list(F.struct("node", "sketch")).alias("rows"))

    def pairs(x: np.ndarray, y: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], names=["a", "b"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Blocks with blocks; ``same`` where it is one and the same."""
        for batch in batches:
            for rows_a, rows_b, same in zip(*(batch.column(i) for i in range(3))):
                (id_a, x), (id_b, y) = ((r.values.field("node").to_numpy(), words_of(r.values.field("sketch"))) for r in (rows_a, rows_b))
                for k in range(0, len(x), BLOCK_ROWS):
                    i, j = np.nonzero(may_be_similar(x[k : k + BLOCK_ROWS, None], y[None], most))
                    if same.as_py():
                        i, j = i[i + k < j], j[i + k < j]
                    yield pairs(id_a[i + k], id_b[j])

    def compare_few(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, size = batch.column(0).flatten(), pc.list_value_length(batch.column(0)).to_numpy()
            ids, words = flat.field("node").to_numpy(), words_of(flat.field("sketch"))
            for i, j in pairs_in_lists(size):
                near = may_be_similar(words[i], words[j], most)
                yield pairs(ids[i[near]], ids[j[near]])

    schema = "a bigint, b bigint"
    blocks = checkpointed(blocks)
    few = (F.col("blocks") == 1) & (F.size("rows") <= FEW_ROWS)
    found = blocks.filter(few).select("rows").mapInArrow(compare_few, schema)
    many = blocks.filter(~few)
    left = many.select("construct_id", "bucket", F.col("rows").alias("rows_a"), F.col("block").alias("own"), F.explode(F.sequence("block", F.col("blocks") - 1)).alias("block"))
    met = left.join(many.select("construct_id", "bucket", "block", F.col("rows").alias("rows_b")), ["construct_id", "bucket", "block"])
    found = found.unionByName(met.select("rows_a", "rows_b", (F.col("own") == F.col("block")).alias("same")).mapInArrow(compare, schema))
    narrow = sketched.filter(F.size("buckets") == 0)
    if not narrow.isEmpty():
        # A row that does not cover the core is compared with every row of its construct.
        constructs = narrow.groupBy("construct_id").agg(F.count(F.lit(1)).alias("k"))
        dealt = sketched.join(constructs, "construct_id").withColumn("narrow", F.size("buckets") == 0).withColumn("part", F.xxhash64("node") % F.ceil(F.col("k") / BUCKET_ROWS))
        dealt = dealt.groupBy("construct_id", "narrow", "part").agg(F.collect_list(F.struct("node", "sketch")).alias("rows"))
        x = dealt.filter("narrow").select("construct_id", F.col("part").alias("own"), F.col("rows").alias("rows_a"))
        beside = x.join(dealt.withColumnRenamed("rows", "rows_b"), "construct_id").filter(~F.col("narrow") | (F.col("own") <= F.col("part")))
        found = found.unionByName(beside.select("rows_a", "rows_b", (F.col("narrow") & (F.col("own") == F.col("part"))).alias("same")).mapInArrow(compare, schema))
    return found.distinct()


def components(pairs: DataFrame) -> DataFrame:
    """``node, component`` of the nodes of ``pairs`` (``a, b``): the least node that each is connected with."""
    edges = checkpointed(pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    labels = checkpointed(edges.groupBy(F.col("a").alias("node")).agg(F.least("node", F.min("b")).alias("component")))
    while True:
        near = edges.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("component").alias("least"))
        least = labels.join(near, F.col("node") == F.col("a")).select("node", F.col("component").alias("old"), F.least("component", "least").alias("to"))
        # On to the label of the label.
        moved = least.join(labels.select(F.col("node").alias("to"), "component"), "to").select("node", "old", "component")
        moved = checkpointed(moved)
        labels = moved.select("node", "component")
        if moved.filter(F.col("old") != F.col("component")).isEmpty():
            return labels


def lots(a: np.ndarray, b: np.ndarray, turn: int) -> np.ndarray:
    """The order of equal averages, another in each turn, so that hubs and long rows of ties merge in parallel."""
    return ((a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ (b.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(turn))) * np.uint64(0xBF58476D1CE4E5B9)


def merge_in_memory(a: np.ndarray, b: np.ndarray, total: np.ndarray, links: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, their clusters) after all rounds over links a[i] - b[i]; only nodes that changed come out."""
    nodes, place = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = place[: len(a)], place[len(a) :]
    x, y = np.minimum(x, y), np.maximum(x, y)
    total, links = total.astype(float), links.astype(float)
    label = np.arange(len(nodes))
    turn = 0
    while len(x):
        turn += 1
        near = np.flatnonzero(total / links >= threshold - 1e-9)
        nearness = total[near] / (links[near] + DOUBT)
        rank = np.zeros(len(x), np.int64)
        rank[near[np.lexsort((lots(nodes[x[near]], nodes[y[near]], turn), nearness))]] = np.arange(1, len(near) + 1)
        best = np.zeros(len(nodes), np.int64)
        np.maximum.at(best, x, rank)
        np.maximum.at(best, y, rank)
        mutual = (rank > 0) & (best[x] == rank) & (best[y] == rank)
        if not mutual.any():
            break
        to = np.arange(len(nodes))
        to[y[mutual]] = x[mutual]
        label = to[label]
        x, y = to[x], to[y]
        x, y = np.minimum(x, y), np.maximum(x, y)
        apart = x != y
        keys, which = np.unique(x[apart] * len(nodes) + y[apart], return_inverse=True)
        total, links = np.bincount(which, total[apart], len(keys)), np.bincount(which, links[apart], len(keys))
        x, y = keys // len(nodes), keys % len(nodes)
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def component_links(grid: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, agreeing, shared positions) of all pairs of rows of ``grid`` within the connected components of similar rows."""
    both, differ = overlaps(grid, grid)
    near = (both > 0) & (differ <= (1 - threshold) * both + 1e-9)
    np.fill_diagonal(near, True)
    label = near.argmax(1)
    while True:
        # Every row takes the least label of the rows that are near to it, until none changes.
        least = np.where(near, label[None, :], len(grid)).min(1)
        least = least[least]
        if (least == label).all():
            break
        label = least
    a, b = np.nonzero(np.triu((label[:, None] == label[None, :]) & (both > 0), 1))
    return a, b, (both - differ)[a, b], both[a, b]


def cluster_whole_constructs(found: DataFrame, threshold: float) -> DataFrame:
    """``row_id, construct_id, subpopulation, n_rows, content`` of constructs of up to ``TASK_ROWS`` rows, many at a time in a task."""
    line = found.repartition("construct_id").sortWithinPartitions("construct_id", "row_id")

    def cluster(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.drop_duplicates(["construct_id", "row_id"], ignore_index=True)
        node = frame.groupby(["construct_id", "content"], sort=False)["row_id"].transform("min").to_numpy()
        row, construct = frame["row_id"].to_numpy(), frame["construct_id"].to_numpy()
        first = np.flatnonzero(row == node)
        grid = from_strings(frame["content"].iloc[first].tolist())
        parts = []
        ends = np.append(np.flatnonzero(np.diff(construct[first])) + 1, len(first))
        for begin, end in zip(np.append(0, ends[:-1]), ends):
            if end - begin > 1:
                a, b, total, links = component_links(grid[begin:end], threshold)
                parts.append((row[first[a + begin]], row[first[b + begin]], total, links))
        if parts:
            a, b, total, links = (np.concatenate(p) for p in zip(*parts))
            old, new = merge_in_memory(np.minimum(a, b), np.maximum(a, b), total, links, threshold)
            if len(old):
                at = np.minimum(np.searchsorted(old, node), len(old) - 1)
                node = np.where(old[at] == node, new[at], node)
        _, which, sizes = np.unique(node, return_inverse=True, return_counts=True)
        return pd.DataFrame({"row_id": row, "construct_id": construct, "subpopulation": node, "n_rows": sizes[which], "content": frame["content"]})

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        n = 0
        for batch in batches:
            if not len(batch):
                continue
            if n >= TASK_ROWS:
                # Up to the end of the last construct: it goes on in this batch, or ended before it.
                ends = batch["construct_id"].to_numpy() != held[-1]["construct_id"].iloc[-1]
                if ends.any():
                    cut = int(ends.argmax())
                    yield cluster(pd.concat([*held, batch.iloc[:cut]], ignore_index=True))
                    held, n, batch = [], 0, batch.iloc[cut:]
            held.append(batch)
            n += len(batch)
        if held:
            yield cluster(pd.concat(held, ignore_index=True))

    return line.mapInPandas(work, MEMBERS)


def merge_on_workers(links: DataFrame, threshold: float) -> DataFrame:
    """``node, cluster`` of the nodes that merged: the rounds for whole constructs, many at a time in a task."""
    line = links.repartition("construct_id").sortWithinPartitions("construct_id")

    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        n = 0

        def done(frames: list[pd.DataFrame]) -> pd.DataFrame:
            all_links = pd.concat(frames)
            node, cluster = merge_in_memory(all_links["a"].to_numpy(), all_links["b"].to_numpy(), all_links["total"].to_numpy(), all_links["links"].to_numpy(), threshold)
            return pd.DataFrame({"node": node, "cluster": cluster})

        for batch in batches:
            if not len(batch):
                continue
            if n >= TASK_LINKS:
                # Up to the end of the last construct: it goes on in this batch, or ended before it.
                ends = batch["construct_id"].to_numpy() != held[-1]["construct_id"].iloc[-1]
                if ends.any():
                    cut = int(ends.argmax())
                    yield done([*held, batch.iloc[:cut]])
                    held, n, batch = [], 0, batch.iloc[cut:]
            held.append(batch)
            n += len(batch)
        if held:
            yield done(held)

    return line.select("construct_id", "a", "b", "total", "links").mapInPandas(merge, "node bigint, cluster bigint")


def merge_rounds(links: DataFrame, threshold: float) -> DataFrame:
    """``node, cluster`` of the nodes that merged: the rounds as Spark jobs, for constructs of any size."""
    graph = checkpointed(links.select("a", "b", "total", "links"))
    merged: DataFrame | None = None
    turn = 0
    while True:
        turn += 1

        def with_lots(batches: Iterator[pd.DataFrame], turn: int = turn) -> Iterator[pd.DataFrame]:
            for batch in batches:
                # The order of the unsigned numbers, as signed ones.
                lot = (lots(batch["a"].to_numpy(), batch["b"].to_numpy(), turn) ^ np.uint64(1 << 63)).view(np.int64)
                yield batch.assign(lot=lot)

        near = graph.filter(F.col("total") / F.col("links") >= threshold - 1e-9).select("a", "b", (F.col("total") / (F.col("links") + DOUBT)).alias("nearness"))
        near = near.mapInPandas(with_lots, "a bigint, b bigint, nearness double, lot bigint").select("a", "b", F.struct("nearness", "lot", "a", "b").alias("edge"))
        best = near.select(F.explode(F.array("a", "b")).alias("node"), "edge").groupBy("node").agg(F.max("edge").alias("edge"))
        mutual = best.groupBy("edge").agg(F.count(F.lit(1)).alias("sides")).filter(F.col("sides") == 2)
        pairs = checkpointed(mutual.select(F.col("edge.b").alias("from"), F.col("edge.a").alias("to")))
        if pairs.isEmpty():
            break
        new = pairs.select(F.col("from").alias("node"), F.col("to").alias("cluster"))
        if merged is None:
            merged = new
        else:
            moved = merged.join(pairs, merged["cluster"] == pairs["from"], "left").select("node", F.coalesce("to", "cluster").alias("cluster"))
            merged = checkpointed(moved.unionByName(new))
        graph = checkpointed(renamed_links(graph, new))
    return merged if merged is not None else graph.select(F.col("a").alias("node"), F.col("b").alias("cluster")).limit(0)


def renamed_links(links: DataFrame, merged: DataFrame) -> DataFrame:
    """``links`` between the clusters that their ends now belong to, summed; those within a cluster are gone."""
    x, y = merged.select(F.col("node").alias("fa"), F.col("cluster").alias("ta")), merged.select(F.col("node").alias("fb"), F.col("cluster").alias("tb"))
    keys = [c for c in links.columns if c == "construct_id"]
    renamed = links.join(x, F.col("a") == F.col("fa"), "left").join(y, F.col("b") == F.col("fb"), "left")
    renamed = renamed.select(*keys, F.coalesce("ta", "a").alias("x"), F.coalesce("tb", "b").alias("y"), "total", "links").filter(F.col("x") != F.col("y"))
    return renamed.groupBy(*keys, F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(F.sum("total").alias("total"), F.sum("links").alias("links"))


def merge_nearest(links: DataFrame, threshold: float, task_links: int) -> DataFrame:
    """``node, cluster`` of the nodes that merge by ``construct_id, a, b, total, links``; the same rounds in either place.

    Links of a construct fit into a task up to ``task_links``; the rounds of larger ones run as Spark jobs.
    """
    large = links.groupBy("construct_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > task_links).select("construct_id")
    if large.isEmpty():
        return merge_on_workers(links, threshold)
    inside = merge_on_workers(links.join(large, "construct_id", "left_anti"), threshold)
    return inside.unionByName(merge_rounds(links.join(large, "construct_id", "left_semi"), threshold))


def cluster_large_constructs(nodes: DataFrame, threshold: float, task_links: int | None = None) -> DataFrame:
    """``node, cluster`` of every node of ``nodes`` (``node, construct_id, content``); a cluster is named by its least node."""
    labels = components(candidates(nodes, 1 - threshold))
    sizes = labels.groupBy("component").agg(F.count(F.lit(1)).alias("n_rows"))
    members = nodes.join(labels.join(sizes, "component"), "node").select(F.col("node").alias("row_id"), "construct_id", F.col("component").alias("subpopulation"), "n_rows", "content")

    def links_of(component: np.ndarray, id_a: np.ndarray, id_b: np.ndarray, both: np.ndarray, differ: np.ndarray) -> pa.RecordBatch:
        component, id_a, id_b, both, differ = (x[both > 0] for x in (component, id_a, id_b, both, differ))
        columns = (component, np.minimum(id_a, id_b), np.maximum(id_a, id_b), (both - differ).astype(np.int64), both.astype(np.int64))
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["construct_id", "a", "b", "total", "links"])

    links = checkpointed(pairs_within(members, links_of, "construct_id bigint, a bigint, b bigint, total bigint, links bigint"))
    merged = merge_nearest(links, threshold, TASK_LINKS if task_links is None else task_links)
    to = merged.select(F.col("node").alias("old"), "cluster")
    return nodes.join(to, F.col("node") == F.col("old"), "left").select("node", F.coalesce("cluster", "node").alias("cluster"))


def find_subpopulations(rows: DataFrame, groups: DataFrame, most: float = 0.06, task_rows: int | None = None) -> DataFrame:
    """``row_id, construct_id, subpopulation, n_rows, content`` of every row with non-null spec; ``n_rows`` is its subpopulation's size.

    Rows of a construct's groups are similar if they differ at no more than ``most`` of the positions that both
    cover; rows without a common position are not linked with each other, but may come together through others. A
    subpopulation is named by its least row_id. Redelivered rows count once; rows with null ``spec`` or no row_id, and
    rows of no known group or construct, do not come out; a row that is like no other forms a subpopulation of its own.
    Empty tables give no rows; other columns are not read.

    Constructs of up to ``task_rows`` rows (``TASK_ROWS``) are compared in one task, larger ones by buckets; the result is
    the same.
    """
    task_rows = TASK_ROWS if task_rows is None else task_rows
    threshold = 1 - most
    known = rows.filter(F.col("spec").isNotNull() & F.col("row_id").isNotNull())
    groups = groups.filter(F.col("construct_id").isNotNull())
    sizes = known.groupBy(F.col("group_id").alias("g")).agg(F.count(F.lit(1)).alias("n")).join(groups.select("group_id", F.col("construct_id").alias("c")), F.col("g") == F.col("group_id"))
    large = checkpointed(sizes.groupBy("c").agg(F.sum("n").alias("n")).filter(F.col("n") > task_rows).select("c"))
    joined = rows_with_reference(known, groups, "row_id")
    if large.isEmpty():
        return cluster_whole_constructs(row_contents(joined), threshold)
    small = groups.join(large, F.col("construct_id") == F.col("c"), "left_anti")
    whole = cluster_whole_constructs(row_contents(rows_with_reference(known, small, "row_id")), threshold)
    found = checkpointed(row_contents(rows_with_reference(known, groups.join(large, F.col("construct_id") == F.col("c"), "left_semi"), "row_id")))
    nodes = checkpointed(found.groupBy("construct_id", "content").agg(F.min("row_id").alias("node")))
    labels = cluster_large_constructs(nodes, threshold)
    named = nodes.join(labels, "node").select(F.col("construct_id").alias("c"), F.col("content").alias("t"), F.col("cluster").alias("subpopulation"))
    members = found.join(named, (F.col("construct_id") == F.col("c")) & (F.col("content") == F.col("t")))
    members = checkpointed(members.select("row_id", "construct_id", "subpopulation", "content").dropDuplicates(["row_id"]))
    sizes = members.groupBy("subpopulation").agg(F.count(F.lit(1)).alias("n_rows"))
    return whole.unionByName(members.join(sizes, "subpopulation").select(whole.columns))


def blocks_of(members: DataFrame) -> DataFrame:
    """The members of each subpopulation in blocks of about ``BLOCK_ROWS``: ``construct_id, subpopulation, n_rows, blocks, block, rows``."""
    spread = members.withColumn("blocks", F.ceil(F.col("n_rows") / BLOCK_ROWS)).withColumn("block", F.pmod(F.xxhash64("row_id"), F.col("blocks")))
    return spread.groupBy("construct_id", "subpopulation", "n_rows", "blocks", "block").agg(F.collect_list(F.struct("row_id", "content")).alias("rows"))


def pairs_within(members: DataFrame, report: Callable[..., pa.RecordBatch], schema: str) -> DataFrame:
    """What ``report`` makes of (subpopulation, row, row, positions that both cover, differences) of all pairs within subpopulations.

    Blocks of a subpopulation are compared with its blocks.
    """
    blocks = checkpointed(blocks_of(members.filter(F.col("n_rows") > 1)))
    several = blocks.filter(F.col("blocks") > 1)
    left = several.select("subpopulation", F.col("block").alias("own"), F.col("rows").alias("rows_a"), F.explode(F.sequence("block", F.col("blocks") - 1)).alias("block"))
    right = several.select("subpopulation", "block", F.col("rows").alias("rows_b"))
    compared = left.join(right, ["subpopulation", "block"]).select("own", "block", "rows_a", "rows_b", "subpopulation")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own, other, rows_a, rows_b, name in zip(*(batch.column(i) for i in range(5))):
                a, b = rows_a.values, rows_b.values
                both, differ = overlaps(from_strings(a.field("content")), from_strings(b.field("content")))
                i, j = np.nonzero(np.tri(len(a), len(b), -1, bool).T if own.as_py() == other.as_py() else np.ones((len(a), len(b)), bool))
                yield report(np.full(len(i), name.as_py()), a.field("row_id").to_numpy()[i], b.field("row_id").to_numpy()[j], both[i, j], differ[i, j])

    def compare_within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """All pairs within each of many small blocks at once."""
        for batch in batches:
            flat, size = batch.column(0).flatten(), pc.list_value_length(batch.column(0)).to_numpy()
            ids, grid = flat.field("row_id").to_numpy(), from_strings(flat.field("content"))
            name = np.repeat(batch.column(1).to_numpy(), size)
            for i, j in pairs_in_lists(size):
                yield report(name[i], ids[i], ids[j], *differences(grid[i], grid[j]))

    within = blocks.filter(F.col("blocks") == 1).select("rows", "subpopulation").mapInArrow(compare_within, schema)
    return within.unionByName(compared.mapInArrow(compare, schema))


def similar_pairs(members: DataFrame, most: float = 0.06) -> DataFrame:
    """``row_a, row_b`` (row_a < row_b) of the rows of a subpopulation that differ at no more than ``most``.

    As many pairs come out as there are.
    """

    def near_ones(_: np.ndarray, id_a: np.ndarray, id_b: np.ndarray, both: np.ndarray, differ: np.ndarray) -> pa.RecordBatch:
        x, y = (ids[differ <= most * both + 1e-9] for ids in (id_a, id_b))
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], names=["row_a", "row_b"])

    return pairs_within(members, near_ones, "row_a bigint, row_b bigint")


def describe_subpopulations(members: DataFrame, typical: int = 3) -> DataFrame:
    """``construct_id, subpopulation, n_rows, typical_rows``: the size, and the rows nearest to the consensus.

    The consensus is taken over the whole subpopulation (of equally frequent symbols the least); of equally near rows
    the one with the least row_id comes first. A block that is its subpopulation has the consensus in it; those of
    several blocks are counted first, one number a block, position and symbol.
    """

    schema = "construct_id bigint, subpopulation bigint, n_rows bigint, typical_rows array<bigint>"

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Many subpopulations of one block each at once."""
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = batch.column(3)
            flat, size = rows.flatten(), pc.list_value_length(rows).to_numpy()
            ids, grid = flat.field("row_id").to_numpy(), from_strings(flat.field("content"))
            starts, own = np.cumsum(size) - size, np.repeat(np.arange(len(size)), size)
            centre, most = np.full((len(size), grid.shape[1]), UNCOVERED, grid.dtype), np.zeros((len(size), grid.shape[1]), np.int64)
            for symbol in np.unique(grid):
                if symbol != UNCOVERED:
                    n = np.add.reduceat((grid == symbol).astype(np.int32), starts, axis=0)
                    centre[n > most], most = symbol, np.maximum(n, most)
            both, differ = differences(grid, centre[own])
            order = np.lexsort((ids, differ / np.maximum(both, 1), own))
            kept = order[np.arange(len(order)) - np.repeat(starts, size) < typical]
            offsets = np.concatenate(([0], np.cumsum(np.minimum(size, typical)))).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids[kept]))], names=["construct_id", "subpopulation", "n_rows", "typical_rows"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, rows in zip(batch.column(0), batch.column(1)):
                grid = from_strings(rows.values.field("content"))
                row, pos = np.nonzero(grid != UNCOVERED)
                at, n = np.unique(pos * np.int64(1 << 32) + grid[row, pos], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.repeat(name, len(at)), pa.array((at >> 32).astype(np.int32)), pa.array((at & 0xFFFFFFFF).astype(np.int32)), pa.array(n)], names=["subpopulation", "pos", "symbol", "n"])

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, rows, whole in zip(*(batch.column(i) for i in range(3))):
                grid = from_strings(rows.values.field("content"))
                pos, symbol = (whole.values.field(f).to_numpy() for f in ("pos", "symbol"))
                centre = np.full(max(grid.shape[1], int(pos.max(initial=0)) + 1), UNCOVERED, np.uint32)
                centre[pos] = symbol
                both, differ = differences(grid, centre[None, : grid.shape[1]])
                yield pa.RecordBatch.from_arrays([pa.repeat(name, len(grid)), rows.values.field("row_id"), pa.array(differ / np.maximum(both, 1))], names=["subpopulation", "row_id", "distance"])

    blocks = checkpointed(blocks_of(members))
    several = blocks.filter(F.col("blocks") > 1)
    counts = several.select("subpopulation", "rows").mapInArrow(count, "subpopulation bigint, pos int, symbol int, n bigint")
    counts = counts.groupBy("subpopulation", "pos", "symbol").agg(F.sum("n").alias("n"))
    most = counts.groupBy("subpopulation", "pos").agg(F.max_by("symbol", F.struct("n", -F.col("symbol"))).alias("symbol"))
    # Subpopulations none of whose rows covers a position have an empty consensus.
    centres = several.select("subpopulation").distinct().join(most, "subpopulation", "left").groupBy("subpopulation").agg(F.collect_list(F.when(F.col("pos").isNotNull(), F.struct("pos", "symbol"))).alias("centre"))
    distances = several.join(centres, "subpopulation").select("subpopulation", "rows", "centre").mapInArrow(measure, "subpopulation bigint, row_id bigint, distance double")
    nearest = Window.partitionBy("subpopulation").orderBy("distance", "row_id")
    best = distances.withColumn("place", F.row_number().over(nearest)).filter(F.col("place") <= typical)
    best = best.groupBy("subpopulation").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "row_id"))), lambda s: s["row_id"]).alias("typical_rows"))
    named = several.select("construct_id", "subpopulation", "n_rows").distinct().join(best, "subpopulation").select("construct_id", "subpopulation", "n_rows", "typical_rows")
    return blocks.filter(F.col("blocks") == 1).select("construct_id", "subpopulation", "n_rows", "rows").mapInArrow(describe, schema).unionByName(named)
