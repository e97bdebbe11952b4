"""Average-linkage order of the distinct signatures of a group, by nearest-neighbour chain (Müllner 2011; Murtagh 1983).

Signatures are collapsed in Spark first; one task then holds the distinct signatures of one group. Up to
``MAX_SIGNATURES`` it holds their distances too, n x n doubles; a larger group is linked in the same way from the
column sums of its clusters, n x columns floats, and from lists of what is near to each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pilewright.operators.pileup import signatures

#: 8 bytes x 6,000 x 6,000 are 288 MB.
MAX_SIGNATURES = 6_000


#: Rows whose distances to all others are held at a time.
SCAN_ROWS = 256
#: Rows and columns of distances that are counted at a time.
TILE_ROWS, TILE_COLUMNS = 32, 1_024
#: What is near to a cluster: so many others are listed, and of signatures those so much farther than the nearest.
LISTED, FARTHER = 128, 8
#: Signatures that are compared as a block.
BLOCK_SIGNATURES = 2_048


def marks(sets: list[list[int]]) -> np.ndarray:
    """One 0/1 row a set, one column a position that any set has."""
    columns = sorted(set().union(*map(set, sets))) if sets else []
    index = {c: k for k, c in enumerate(columns)}
    bits = np.zeros((len(sets), len(columns)))
    for i, s in enumerate(sets):
        bits[i, [index[c] for c in s]] = 1
    return bits


def hamming(sets: list[list[int]]) -> np.ndarray:
    """Sizes of the symmetric differences of all pairs, from one product of 0/1 rows."""
    bits = marks(sets)
    size = bits.sum(1)
    return size[:, None] + size[None, :] - 2 * bits @ bits.T


def average_linkage(distance: np.ndarray) -> list[tuple[int, int, float]]:
    """Merges (kept slot, absorbed slot, height) in the order in which chains close; least index wins ties."""
    d = distance.astype(float).copy()
    n = len(d)
    np.fill_diagonal(d, np.inf)
    weight = np.ones(n)
    gone = np.zeros(n, bool)
    merges: list[tuple[int, int, float]] = []
    path: list[int] = []
    while len(merges) < n - 1:
        if not path:
            path.append(int(np.argmin(gone)))
        tip = path[-1]
        near = int(np.argmin(d[tip]))
        if len(path) < 2 or near != path[-2]:
            path.append(near)
            continue
        del path[-2:]
        keep, drop = sorted((tip, near))
        merges.append((keep, drop, float(d[keep, drop])))
        joint = (weight[keep] * d[keep] + weight[drop] * d[drop]) / (weight[keep] + weight[drop])
        weight[keep] += weight[drop]
        gone[drop] = True
        d[keep], d[:, keep] = joint, joint
        d[drop], d[:, drop] = np.inf, np.inf
        d[keep, keep] = np.inf
    return merges


def nearest_rows(bits: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], np.ndarray]:
    """Each 0/1 row's nearest other row (the least index of equals) and its distance; the rows that are near to it, and
    a distance that no other row falls below."""
    n = len(bits)
    packed = np.packbits(bits.astype(bool), axis=1)
    packed = np.ascontiguousarray(np.pad(packed, ((0, 0), (0, -packed.shape[1] % 8)))).view(np.uint64).T.copy()
    kind = np.uint8 if bits.shape[1] < 255 else np.uint32
    none = np.iinfo(kind).max
    near, away, bound = np.zeros(n, np.int64), np.zeros(n), np.full(n, np.inf)
    lists: list[np.ndarray] = []
    # Small tiles, so that what is counted stays in the processor's cache.
    unlike, count = np.empty((TILE_ROWS, TILE_COLUMNS), np.uint64), np.empty((TILE_ROWS, TILE_COLUMNS), np.uint8)
    for i in range(0, n, TILE_ROWS):
        d = np.zeros((min(TILE_ROWS, n - i), n), kind)
        for j in range(0, n, TILE_COLUMNS):
            tile = d[:, j : j + TILE_COLUMNS]
            x, c = (a[: tile.shape[0], : tile.shape[1]] for a in (unlike, count))
            for word in packed:
                np.bitwise_xor(word[i : i + len(d), None], word[j : j + TILE_COLUMNS], out=x)
                tile += np.bitwise_count(x, out=c)
        own = np.arange(len(d))
        d[own, i + own] = none
        near[i : i + len(d)] = d.argmin(1)
        away[i : i + len(d)] = d[own, near[i : i + len(d)]]
        for k in range(len(d)):
            far = int(away[i + k]) + FARTHER
            close = np.flatnonzero(d[k] < min(far, none))
            if len(close) > LISTED:
                # As far as no more than are listed stand.
                upto = np.cumsum(np.bincount(d[k, close] - int(away[i + k]), minlength=FARTHER))
                far = int(away[i + k]) + int((upto <= LISTED).sum())
                close = close[d[k, close] < far]
            lists.append(close.astype(np.int32))
            bound[i + k] = far
    return near, away, lists, bound


def linkage_of_marks(bits: np.ndarray) -> list[tuple[int, int, float]]:
    """The merges of ``average_linkage`` over the Hamming distances of 0/1 rows, without the distances.

    The mean distance of clusters A and B of a and b rows is (b |A| + a |B| - 2 A.B) / ab, A and B being their column
    sums: whole numbers and one division, so that equal means are equal. Single precision finds the rows that may be
    nearest, double precision decides. A cluster's nearest stays the nearest until that one merges itself (the
    linkage is reducible), hence it is kept.

    Each cluster has a list, outside of which nothing is nearer than its bound; what merges outside stays as far, as its
    distance is a mean. Two that merge have both lists and the mean of the bounds. While the nearest in the list is below the
    bound it is the nearest of all; only otherwise are all clusters scanned.
    """
    n, m = bits.shape
    sums = bits.astype(np.float32)
    total, weight = bits.sum(1).astype(float), np.ones(n)
    share, part = total.astype(np.float32), np.ones(n, np.float32)  # share is inf where a row is gone
    slot, row = np.arange(n), np.arange(n)
    near, away, lists, bound = nearest_rows(bits)
    within = np.arange(n)  # the slot that a slot was absorbed by
    seen, changed = np.zeros(n, np.int64), np.zeros(n, np.int64)  # number of merges when near was found, when a slot last merged
    merges: list[tuple[int, int, float]] = []
    path: list[int] = []

    def distances(r: int, others: np.ndarray) -> np.ndarray:
        shared = sums[others].astype(float) @ sums[r].astype(float)
        return (total[others] * weight[r] + total[r] * weight[others] - 2 * shared) / (weight[others] * weight[r])

    def found_in_list(tip: int) -> bool:
        listed = lists[tip]
        now = within[listed]
        while (within[now] != now).any():
            now = within[now]
        within[listed] = now
        now = np.unique(now)
        now = now[now != tip]
        if not len(now):
            return False
        r, others = row[tip], row[now]
        d = share[others] - part[others] * (sums[others] @ (sums[r] * (2 * part[r])))
        error = (m + 8) * 2.0**-21 * (1 + share[r])
        close = np.flatnonzero(d <= d.min() + error)
        exact = distances(r, others[close])
        k = int(exact.argmin())
        if exact[k] >= bound[tip]:
            return False
        near[tip], away[tip], seen[tip] = now[close[k]], exact[k], len(merges)
        if len(now) > LISTED:
            order = d.argpartition(LISTED)
            bound[tip] = min(bound[tip], d[order[LISTED]] + share[r] - error)
            now = now[order[:LISTED]]
        lists[tip] = now
        return True

    def scan(tip: int) -> None:
        r = row[tip]
        d = sums @ (sums[r] * (-2 * part[r]))
        d *= part
        d += share
        d[r] = np.inf
        error = (m + 8) * 2.0**-21 * (1 + share[r])
        close = np.flatnonzero(d <= d.min() + error)
        exact = distances(r, close)
        k = int(exact.argmin())
        near[tip], away[tip], seen[tip] = slot[close[k]], exact[k], len(merges)
        if len(d) > LISTED:
            order = d.argpartition(LISTED)
            lists[tip], bound[tip] = slot[order[:LISTED]], d[order[LISTED]] + share[r] - error
        else:
            lists[tip], bound[tip] = slot[np.isfinite(d)], np.inf

    while len(merges) < n - 1:
        if not path:
            path.append(0)  # the lower slot is kept, so that the first is never gone
        tip = path[-1]
        if max(changed[tip], changed[near[tip]]) > seen[tip] and not found_in_list(tip):
            scan(tip)
        if len(path) < 2 or near[tip] != path[-2]:
            path.append(int(near[tip]))
            continue
        del path[-2:]
        keep, drop = sorted((tip, int(near[tip])))
        merges.append((keep, drop, float(away[tip])))
        changed[keep] = changed[drop] = len(merges)
        k, g = row[keep], row[drop]
        within[drop] = keep
        lists[keep], lists[drop] = np.concatenate((lists[keep], lists[drop])), lists[drop][:0]
        bound[keep] = (bound[keep] * weight[k] + bound[drop] * weight[g]) / (weight[k] + weight[g]) * (1 - 1e-12)
        sums[k] += sums[g]
        total[k] += total[g]
        weight[k] += weight[g]
        share[k], part[k] = total[k] / weight[k], 1 / weight[k]
        share[g] = np.inf
        if n - len(merges) < 0.9 * len(slot):
            left = np.isfinite(share)
            sums, total, weight, share, part, slot = (x[left] for x in (sums, total, weight, share, part, slot))
            row[slot] = np.arange(len(slot))
    return merges


def leaves(merges: list[tuple[int, int, float]], n: int) -> list[int]:
    """Slots in dendrogram order: what is absorbed follows what is kept."""
    following = list(range(n))  # the last leaf of each block, and the leaf after each leaf
    after = [-1] * n
    for keep, drop, _ in merges:
        after[following[keep]] = drop
        following[keep] = following[drop]
    absorbed = {drop for _, drop, _ in merges}
    out, at = [], next((i for i in range(n) if i not in absorbed), -1)
    while at >= 0:
        out.append(at)
        at = after[at]
    return out


def cluster_order(placed: DataFrame, columns: DataFrame | None = None) -> DataFrame:
    """row_id, group_id, place: rows of equal signatures together, in arrival order; arrival order for groups of fewer
    than 3 rows or 2 signatures. ``columns`` (group_id, pos) restricts the positions that count."""
    signed = signatures(placed).select("row_id", "group_id", "read_ord", "signature")
    if columns is not None:
        counting = columns.groupBy(F.col("group_id").alias("g")).agg(F.collect_set("pos").alias("counting"))
        kept = F.coalesce(F.array_sort(F.array_intersect("signature", "counting")), F.array().cast("array<int>"))
        signed = signed.join(counting, F.col("group_id") == F.col("g"), "left").select("row_id", "group_id", "read_ord", kept.alias("signature"))
    distinct = signed.groupBy("group_id", "signature").agg(F.min(F.struct("read_ord", "row_id")).alias("seen"), F.count(F.lit(1)).alias("n"))
    line = distinct.select("group_id", "signature", "n", "seen").repartition("group_id").sortWithinPartitions("group_id", "seen").select("group_id", "signature", "n")

    def slots_of(sets: list[list[int]], rows: int) -> list[int]:
        n = len(sets)
        if rows < 3 or n < 2:
            return [0] * n  # arrival order
        way = leaves(average_linkage(hamming(sets)) if n <= MAX_SIGNATURES else linkage_of_marks(marks(sets)), n)
        slot = np.empty(n, int)
        slot[way] = np.arange(n)
        return slot.tolist()

    def order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Group after group in a sorted partition: what is held is one group's signatures."""
        group, sets, rows = None, [], 0
        schema = pa.schema([("group_id", pa.int64()), ("signature", pa.list_(pa.int32())), ("slot", pa.int64())])
        for batch in batches:
            out: tuple[list, list, list] = ([], [], [])
            for g, signature, n in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if g != group and sets:
                    for column, values in zip(out, ([group] * len(sets), sets, slots_of(sets, rows))):
                        column += values
                    sets, rows = [], 0
                group = g
                sets.append(signature)
                rows += n
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, schema.types)], schema=schema)
        if sets:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(([group] * len(sets), sets, slots_of(sets, rows)), schema.types)], schema=schema)

    slots = line.mapInArrow(order, "group_id bigint, signature array<int>, slot bigint")
    joined = signed.join(slots, ["group_id", "signature"])
    return joined.select("row_id", "group_id", F.row_number().over(Window.partitionBy("group_id").orderBy("slot", "read_ord", "row_id")).alias("place"))


def nearest_signatures(placed: DataFrame) -> DataFrame:
    """group_id, row, n_rows, nearest, distance: every distinct signature of every group, named by its least row_id, with
    the nearest other one of its group (the least name of equals); null where the group has no other.

    Blocks of a group are compared with its blocks, so that a hot group is spread over tasks; one row a signature and
    block is shuffled, and no pair comes out.
    """
    signed = signatures(placed)
    distinct = signed.groupBy("group_id", "signature").agg(F.min("row_id").alias("row"), F.count(F.lit(1)).alias("n_rows"))
    sizes = distinct.groupBy("group_id").agg(F.ceil(F.count(F.lit(1)) / BLOCK_SIGNATURES).alias("blocks"))
    spread = distinct.join(sizes, "group_id").withColumn("block", F.pmod(F.xxhash64("row"), F.col("blocks")))
    blocks = spread.groupBy("group_id", "blocks", "block").agg(F.collect_list(F.struct("row", "n_rows", "signature")).alias("rows"))
    left = blocks.select("group_id", F.col("rows").alias("rows_a"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)).alias("block"))
    pairs = left.join(blocks.select("group_id", "block", F.col("rows").alias("rows_b")), ["group_id", "block"]).select("group_id", "rows_a", "rows_b")

    def grid(rows: pa.StructArray, width: int) -> np.ndarray:
        sets = rows.field("signature")
        bits = np.zeros((len(rows), width), np.float32)
        bits[np.repeat(np.arange(len(rows)), pc.list_value_length(sets).to_numpy()), sets.flatten().to_numpy()] = 1
        return bits

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for group, rows_a, rows_b in zip(*(batch.column(i) for i in range(3))):
                a, b = rows_a.values, rows_b.values
                b = b.take(pa.array(np.argsort(b.field("row").to_numpy())))
                width = 1 + max(pc.max(x.field("signature").flatten()).as_py() or 0 for x in (a, b))
                bits_a, bits_b = grid(a, width), grid(b, width)
                names_a, names_b, size_b = a.field("row").to_numpy(), b.field("row").to_numpy(), bits_b.sum(1)
                near, away = np.zeros(len(a), np.int64), np.zeros(len(a))
                for i in range(0, len(a), SCAN_ROWS):
                    part = bits_a[i : i + SCAN_ROWS]
                    d = part.sum(1)[:, None] + size_b - 2 * part @ bits_b.T
                    d[names_a[i : i + SCAN_ROWS, None] == names_b] = np.inf
                    near[i : i + len(d)], away[i : i + len(d)] = names_b[d.argmin(1)], d.min(1)
                alone = np.isinf(away)
                yield pa.RecordBatch.from_arrays(
                    [pa.repeat(group, len(a)), a.field("row"), a.field("n_rows"), pa.array(np.where(alone, 0, away).astype(np.int32), mask=alone), pa.array(near, mask=alone)], names=["group_id", "row", "n_rows", "distance", "nearest"]
                )

    found = pairs.mapInArrow(compare, "group_id bigint, row bigint, n_rows bigint, distance int, nearest bigint")
    best = found.groupBy("group_id", "row", "n_rows").agg(F.min(F.when(F.col("distance").isNotNull(), F.struct("distance", "nearest"))).alias("best"))
    return best.select("group_id", "row", "n_rows", F.col("best.nearest").alias("nearest"), F.col("best.distance").alias("distance"))
