"""Repeated consecutive events in ordered sequences, collapsed by optimal segmentation.

A sequence is cut into runs so that the sum of the dissimilarities within runs plus a penalty for every
boundary is least: ``best[j] = min over i of best[i] + within(i, j) + penalty``. The dynamic programme keeps the starts ``i``
that can still be optimal and drops one for good as soon as ``best[i] + within(i, j) >= best[j]`` (pruned exact linear time,
Killick et al. 2012): splitting a run never makes its parts more dissimilar. A run comes out as soon as all starts that are
left lie behind it, so that the state is what is still open, whatever the length of a sequence.

Two dissimilarities within a run: ``Steps``, the sum of the differences of neighbours, whose optimum with a penalty between
two whole numbers is unique; and ``Consensus``, the differences of the rows to the run's most frequent symbols, for
which a slow drift ends a run that no single step would.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pilewright.llm.rows import UNCOVERED, contents, differences, rows_with_reference
from pilewright.tables import checkpointed

RUN_SCHEMA = "group_id bigint, first_ord bigint, last_ord bigint, n_rows bigint, first_seen timestamp_ntz, last_seen timestamp_ntz, head boolean, tail boolean, head_spec string, tail_spec string, ref_seq string"


class Steps:
    """Dissimilarity of a run that grows by events: the sum of its steps.

    All starts grow alike, so that none that is behind can be optimal again: one start stays.
    """

    alike = True

    def __init__(self, row: np.ndarray) -> None:
        self.value = 0.0

    def grow(self, row: np.ndarray, step: float) -> None:
        self.value += step


class Consensus:
    """Dissimilarity of a run that grows by events: at each position, the events that do not have its most frequent symbol.

    The starts that stay are as many as the events of the open run that are not like its consensus, at most.
    """

    alike = False

    def __init__(self, row: np.ndarray) -> None:
        self.counts = np.zeros((len(row), 256), np.int32)
        self.grow(row, 0)

    def grow(self, row: np.ndarray, step: float) -> None:
        if len(row) > len(self.counts):
            self.counts = np.pad(self.counts, ((0, len(row) - len(self.counts)), (0, 0)))
        at = np.flatnonzero(row != UNCOVERED)
        self.counts[at, np.minimum(row[at], 255)] += 1
        self.value = float(self.counts.sum() - self.counts.max(1).sum())


class Segmenter:
    """The pruned dynamic programme over events that come one after the other."""

    def __init__(self, penalty: float, cost: type) -> None:
        self.penalty, self.cost = penalty, cost
        self.clear()

    def clear(self) -> None:
        self.events: list[tuple] = []  # those not yet in a run that came out, in pieces: (first, last, how many)
        self.best: list[float] = [0.0]  # best[k]: the least sum for the first k of them
        self.back: list[int] = []  # where the last run begins if the k-th is the last of all
        self.starts: list[tuple[int, object]] = []

    def push(self, event: tuple, step: float | None, row: np.ndarray) -> list[tuple]:
        """Adds an event, ``step`` away from the one before it (None: it begins another sequence); the runs that are certain now."""
        done = self.finish() if step is None and self.events else []
        at = len(self.events)
        for _, run in self.starts:
            run.grow(row, step)
        self.starts.append((at, self.cost(row)))
        self.events.append((event, event, 1))
        least, begin = min((self.best[i] + run.value, i) for i, run in self.starts)
        self.best.append(least + self.penalty)
        self.back.append(begin)
        if len(self.starts) > 1:
            self.starts = [(i, run) for i, run in self.starts if i == begin or not self.cost.alike and self.best[i] + run.value < least + self.penalty]
        first = self.starts[0][0]
        if first and len(self.starts) == 1:
            # The one start that is left begins a run whatever comes.
            done += self.upto(first)
            self.events, self.back, self.best = self.events[first:], [b - first for b in self.back[first:]], self.best[first:]
            self.starts = [(0, self.starts[0][1])]
        if len(self.starts) == 1 and len(self.events) > 1:
            # Nothing within the open run can be a boundary any more: it becomes one piece.
            self.events, self.back, self.best = [(self.events[0][0], event, sum(n for _, _, n in self.events))], [0], [self.best[0], self.best[-1]]
        return done

    def upto(self, end: int) -> list[tuple]:
        """The runs (first event, last event, how many) of the first ``end`` pieces."""
        runs = []
        while end > 0:
            begin = self.back[end - 1]
            runs.append((self.events[begin][0], self.events[end - 1][1], sum(n for _, _, n in self.events[begin:end])))
            end = begin
        return runs[::-1]

    def finish(self) -> list[tuple]:
        runs = self.upto(len(self.events))
        self.clear()
        return runs


def collapse_runs(rows: DataFrame, groups: DataFrame, most_different: int = 2, cost: type = Steps) -> DataFrame:
    """Runs of two or more rows: ``group_id, first_ord, last_ord, n_rows, first_seen, last_seen, duration_us``.

    Rows of a group are in the order of ``read_ord``; neighbours differ at the positions that both cover and
    at which they have another content. The boundary penalty is ``most_different`` + 1/2. Redelivered rows
    (same group and read_ord) count once, the first delivery holds. A row with null ``spec`` belongs to no
    run and ends the one before it; so does none that is missing, as gaps in the numbers do not matter. Rows
    that cover no common position differ nowhere. ``seen_at`` may be null: the duration is from the first
    to the last row's ``seen_at`` and null if one of them is. Empty input gives no rows; other columns are
    not read.

    With ``Steps``, rows are range-partitioned by (group, read_ord), so that a group of any size is spread over tasks.
    Each task segments its part of the line; as the steps of a run add up, the optimum at an edge of parts depends on the
    step across it alone, and runs at edges are joined afterwards, over at most two runs a task. With ``Consensus`` a group
    passes through one task, event by event, with no more state than what is open.
    """
    line = rows_with_reference(rows, groups, "read_ord", F.col("seen_at").cast("timestamp_ntz").alias("seen_at"), F.col("loaded_at").cast("timestamp_ntz").alias("loaded_at"))
    line = line.select("group_id", "read_ord", "seen_at", "loaded_at", "spec", "ref_seq")
    line = line.repartitionByRange("group_id", "read_ord") if cost is Steps else line.repartition("group_id")
    line = line.sortWithinPartitions("group_id", "read_ord", F.col("loaded_at").asc_nulls_last())
    penalty = most_different + 0.5

    def runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        segmenter = Segmenter(penalty, cost)
        before: pd.DataFrame | None = None  # the last row so far
        head = True

        def told(found: list[tuple], tail: bool = False) -> pd.DataFrame:
            nonlocal head
            out = []
            for k, (first, last, n) in enumerate(found):
                edge = (head and not out, tail and k + 1 == len(found))
                # Of inner runs only those of two or more rows matter; edges are needed whatever their length.
                if n > 1 or any(edge):
                    out.append((first[0], first[1], last[1], n, first[2], last[2], *edge, *((first[3], last[3], first[4]) if any(edge) else (None, None, None))))
                head = False
            return pd.DataFrame(out, columns=["group_id", "first_ord", "last_ord", "n_rows", "first_seen", "last_seen", "head", "tail", "head_spec", "tail_spec", "ref_seq"])

        for batch in batches:
            if not len(batch):
                continue
            known = 0 if before is None else 1
            batch = (batch if before is None else pd.concat([before, batch])).drop_duplicates(["group_id", "read_ord"])
            before = batch.tail(1)
            group, specs, refs = batch["group_id"].to_numpy(), batch["spec"].tolist(), batch["ref_seq"].tolist()
            void = np.array([s is None for s in specs])
            grid = contents([s or "" for s in specs], refs)
            steps = differences(grid[1:], grid[:-1])[1].astype(float)
            steps = [None, *np.where((group[1:] != group[:-1]) | void[1:] | void[:-1], None, steps).tolist()]
            found = []
            for k, event in enumerate(zip(group.tolist(), batch["read_ord"].tolist(), batch["seen_at"], specs, refs)):
                if k >= known:
                    found += segmenter.push(event, steps[k], grid[k])
            if found:
                yield told(found)
        if segmenter.events:
            yield told(segmenter.finish(), True)

    # Each part of the line is segmented once; its runs are read twice.
    found = checkpointed(line.mapInPandas(runs, RUN_SCHEMA))
    names = ["group_id", "first_ord", "last_ord", "n_rows", "first_seen", "last_seen"]
    inner = found.filter(~F.col("head") & ~F.col("tail")).select(names)
    edges = found.filter(F.col("head") | F.col("tail"))
    by_group = Window.partitionBy("group_id").orderBy("first_ord")
    before = ["tail", "tail_spec", "ref_seq"]
    linked = edges.withColumns({f"before_{c}": F.lag(c).over(by_group) for c in before})

    def joined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            maybe = (b["head"] & b["before_tail"].eq(True) & b["head_spec"].notna() & b["before_tail_spec"].notna()).to_numpy(bool)
            near = np.zeros(len(b), bool)
            if maybe.any():
                x = b[maybe]
                refs = x["ref_seq"].tolist()
                near[maybe] = differences(contents(x["head_spec"].tolist(), refs), contents(x["before_tail_spec"].tolist(), refs))[1] <= penalty
            yield b[names].assign(opens=(~near).astype(np.int64))

    stitched = (
        linked.mapInPandas(joined, "group_id bigint, first_ord bigint, last_ord bigint, n_rows bigint, first_seen timestamp_ntz, last_seen timestamp_ntz, opens bigint")
        .withColumn("run", F.sum("opens").over(by_group))
        .groupBy("group_id", "run")
        .agg(F.min("first_ord").alias("first_ord"), F.max("last_ord").alias("last_ord"), F.sum("n_rows").alias("n_rows"), F.min_by("first_seen", "first_ord").alias("first_seen"), F.max_by("last_seen", "last_ord").alias("last_seen"))
        .select(names)
    )
    span = F.unix_micros(F.col("last_seen").cast("timestamp")) - F.unix_micros(F.col("first_seen").cast("timestamp"))
    return inner.unionByName(stitched).filter(F.col("n_rows") > 1).withColumn("duration_us", span)
