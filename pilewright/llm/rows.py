"""Pileup rows as numpy matrices: the content of every row at every position it covers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UNCOVERED, GAP, MATCH = 0, ord("-"), ord(".")
#: Cells that are compared one by one rather than by products.
DIRECT_CELLS = 1 << 18


def _matrix(strings: list[str] | pa.Array, width: int | None = None) -> np.ndarray:
    """Code points, one row a string, cut at ``width`` and padded with 0; bytes where all are ASCII. Null is empty."""
    if not isinstance(strings, pa.Array):
        strings = pa.array(strings, pa.string())
    n = len(strings)
    offsets = np.frombuffer(strings.buffers()[1], np.int32)[strings.offset : strings.offset + n + 1] if n else np.zeros(1, np.int32)
    length = np.diff(offsets)
    width = max(1, int(length.max(initial=0)) if width is None else width)
    data = np.frombuffer(strings.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    if len(data) and data.max() > 127:
        return np.array([(t or "")[:width] for t in strings.to_pylist()], dtype=f"U{width}").view(np.uint32).reshape(n, width)
    out = np.zeros((n, width), np.uint8)
    if len(data) and (length > width).any():
        data = data[np.arange(len(data)) - np.repeat(offsets[:-1] - offsets[0], length) < width]
    out[np.arange(width) < length[:, None]] = data
    return out


def _upper(codes: np.ndarray) -> np.ndarray:
    return np.where((codes >= 97) & (codes <= 122), codes - 32, codes)


def contents(specs: list[str] | pa.Array, refs: list[str] | pa.Array) -> np.ndarray:
    """``UNCOVERED`` outside a row's first to last called base; inside, its base (upper case) or a gap.

    A spec that is longer than its reference is read as far as the reference goes; one that is shorter
    covers nothing beyond its end.
    """
    ref = _matrix(refs)
    spec = np.where(ref == 0, 0, _matrix(specs, ref.shape[1]))
    called = (spec != GAP) & (spec != 0)
    out = _upper(np.where(spec == MATCH, ref, spec))
    at = np.arange(out.shape[1])
    first = called.argmax(1)
    last = np.where(called.any(1), out.shape[1] - 1 - called[:, ::-1].argmax(1), -1)
    return np.where((at >= first[:, None]) & (at <= last[:, None]), out, UNCOVERED)


def as_strings(matrix: np.ndarray, length: np.ndarray) -> pa.Array:
    """Contents as strings of the given lengths, a space where a row covers nothing."""
    codes = np.where(matrix == UNCOVERED, 32, matrix)
    if codes.dtype != np.uint8:
        text = np.ascontiguousarray(codes.astype(np.uint32)).view(f"U{codes.shape[1]}").ravel().tolist()
        return pa.array([t[:n] for t, n in zip(text, length)], pa.string())
    offsets = np.concatenate(([0], np.cumsum(length))).astype(np.int32)
    data = codes[np.arange(codes.shape[1]) < length[:, None]]
    return pa.Array.from_buffers(pa.string(), len(length), [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def from_strings(strings: list[str] | pa.Array) -> np.ndarray:
    matrix = _matrix(strings)
    return np.where(matrix == 32, UNCOVERED, matrix)


def differences(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions that both cover and those of them that differ, row by row (broadcast)."""
    both = (a != UNCOVERED) & (b != UNCOVERED)
    return both.sum(-1), (both & (a != b)).sum(-1)


def overlaps(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``differences`` of every row of ``a`` with every row of ``b``; large ones by products of 0/1 matrices, one a symbol."""
    if (width := max(a.shape[1], b.shape[1])) != min(a.shape[1], b.shape[1]):
        a, b = (np.pad(m, ((0, 0), (0, width - m.shape[1]))) for m in (a, b))
    if len(a) * len(b) * width < DIRECT_CELLS:
        return differences(a[:, None, :], b[None, :, :])
    both = (a != UNCOVERED).astype(np.float32) @ (b != UNCOVERED).astype(np.float32).T
    agree = np.zeros_like(both)
    for symbol in np.intersect1d(a, b):
        if symbol != UNCOVERED:
            agree += (a == symbol).astype(np.float32) @ (b == symbol).astype(np.float32).T
    return both.astype(np.int32), (both - agree).astype(np.int32)


def rows_with_reference(rows: DataFrame, groups: DataFrame, *columns: str) -> DataFrame:
    """``group_id``, ``columns`` and ``spec`` of the rows, with ``ref_seq`` and ``construct_id`` of their group.

    Rows without a group in ``groups`` have no content and drop out. The join is on ``group_id``; a
    group with a large part of all rows is split by the adaptive skew join.
    """
    named = groups.select(F.col("group_id").alias("g_group_id"), "construct_id", F.coalesce("ref_seq", F.lit("")).alias("ref_seq"))
    return rows.select("group_id", *columns, "spec").join(named, F.col("group_id") == F.col("g_group_id")).drop("g_group_id")
