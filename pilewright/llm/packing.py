"""Items of varying size into containers of fixed capacity: best-fit decreasing over a segment tree."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pilewright.llm.tokenizer import count_tokens

#: Items that are packed together. Each such part leaves about one container unfilled, in some thousands.
PART_ITEMS = 20_000


class OpenContainers:
    """Open containers by remaining capacity: a segment tree of how many there are of each."""

    def __init__(self, capacity: int) -> None:
        self.leaves = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.stacks: list[list[int]] = [[] for _ in range(capacity + 1)]

    def add(self, left: int, container: int) -> None:
        self.stacks[left].append(container)
        node = self.leaves + left
        while node:
            self.count[node] += 1
            node >>= 1

    def tightest(self, size: int) -> tuple[int, int] | None:
        """Take out the container with the least remaining capacity that holds ``size``."""
        count, node = self.count, self.leaves + size
        if not count[node]:
            # Up to the first ancestor with a filled right neighbour, then down to its leftmost leaf.
            while True:
                if node == 1:
                    return None
                if not node & 1 and count[node + 1]:
                    node += 1
                    break
                node >>= 1
            while node < self.leaves:
                node = 2 * node if count[2 * node] else 2 * node + 1
        left = node - self.leaves
        container = self.stacks[left].pop()
        while node:
            count[node] -= 1
            node >>= 1
        return left, container


def best_fit_decreasing(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The container of each item (sizes 1 to capacity), numbered from 0."""
    place = np.zeros(len(sizes), np.int64)
    open_ones, opened = OpenContainers(capacity), 0
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        found = open_ones.tightest(size)
        if found is None:
            left, container = capacity, opened
            opened += 1
        else:
            left, container = found
        place[i] = container
        if left > size:
            open_ones.add(left - size, container)
    return place


def pack(items: DataFrame, n_items: int, capacity: int = 2048) -> DataFrame:
    """``container_id, doc_id, piece_no, first_token, n_tokens`` for items ``doc_id, n_tokens``.

    An item of more than ``capacity`` tokens is split into full containers and a rest; no other item is
    split. Items of no tokens, or of a null number, take no space and have no row. Repeated items are
    packed as often as they stand there. An empty table gives no rows.

    Items are spread evenly over parts of about ``PART_ITEMS`` by a hash of their id (``n_items`` says how
    many there are), and each part is packed by itself: no task holds more than a part.
    """
    parts = max(1, -(-n_items // PART_ITEMS))
    whole = items.filter(F.col("n_tokens") > 0).withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(parts)))

    def place(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["doc_id", "n_tokens"], kind="stable")
        ids, sizes = part["doc_id"].to_numpy(), part["n_tokens"].to_numpy()
        pieces = -(-sizes // capacity)
        number = np.arange(pieces.sum()) - np.repeat(np.concatenate(([0], np.cumsum(pieces)))[:-1], pieces)
        doc, size = np.repeat(ids, pieces), np.repeat(sizes, pieces)
        first = number * capacity
        length = np.minimum(capacity, size - first)
        container = best_fit_decreasing(length, capacity)
        return pd.DataFrame({"container_id": (np.int64(part["part"].iloc[0]) << 32) + container, "doc_id": doc, "piece_no": number, "first_token": first, "n_tokens": length})

    return whole.groupBy("part").applyInPandas(place, "container_id bigint, doc_id bigint, piece_no bigint, first_token bigint, n_tokens bigint")


def pack_documents(documents: DataFrame, capacity: int = 2048, path: str | None = None) -> DataFrame:
    """``documents`` packed by the number of their tokens; null and empty texts have no row."""
    return pack(count_tokens(documents, path), documents.count(), capacity)
