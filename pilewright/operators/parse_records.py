"""Delimited text records into typed fields or a reason for failure.

Structural indexing: per Arrow batch, numpy finds every quote and comma of the batch's byte
buffer at once. A comma parts fields where an even number of the line's quotes stands before
it (prefix parity). Quoting, the number of fields, and the fields' own checks are then plain
array comparisons; no line is walked byte by byte in Python and nothing is shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUOTE, COMMA, CR = 34, 44, 13
#: Digits that a 64-bit number surely holds.
LONG_NUMBER = 18

COLUMNS, QUOTING, VALUE = "columns", "quoting", "value"


@dataclass
class Fields:
    """The unquoted fields of ``n`` records: ``data[start[i, k]:start[i, k] + length[i, k]]``."""

    data: np.ndarray
    start: np.ndarray
    length: np.ndarray

    def count(self, k: int, wanted: np.ndarray) -> np.ndarray:
        """How many bytes of field ``k`` have ``wanted[byte]``."""
        total = np.concatenate(([0], np.cumsum(wanted[self.data], dtype=np.int64)))
        return total[self.start[:, k] + self.length[:, k]] - total[self.start[:, k]]

    def byte(self, k: int, i: int) -> np.ndarray:
        """Byte ``i`` of field ``k``, 0 where it is shorter."""
        at = self.start[:, k] + i
        inside = i < self.length[:, k]
        out = np.zeros(len(at), np.uint8)
        out[inside] = self.data[at[inside]]
        return out

    def strings(self, k: int) -> pa.Array:
        """Field ``k`` as an Arrow string array."""
        n = len(self.start)
        lens = self.length[:, k]
        offsets = np.concatenate(([0], np.cumsum(lens))).astype(np.int32)
        index = np.repeat(self.start[:, k] - offsets[:-1], lens) + np.arange(offsets[-1])
        return pa.StringArray.from_buffers(n, pa.py_buffer(offsets.tobytes()), pa.py_buffer(self.data[index].tobytes()))


def _bytes_of(chars: str | bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars.encode() if isinstance(chars, str) else chars)] = True
    return out


_DIGIT = _bytes_of("0123456789")
_BLANK = _bytes_of(b"\t\n\x0b\x0c\r ")
_IUPAC = _bytes_of("ACGTUNRYSWKMBDHVacgtunryswkmbdhv")
_PRINTED = _bytes_of(bytes(range(0x21, 0x7F)))
_HIGH = _bytes_of(bytes(range(128, 256)))


def no_blanks(f: Fields, k: int) -> np.ndarray:
    """Not empty and without white space (of any script)."""
    ok = (f.length[:, k] > 0) & (f.count(k, _BLANK) == 0)
    for i in np.flatnonzero(ok & (f.count(k, _HIGH) > 0)):
        s = f.start[i, k]
        ok[i] = re.search(r"\s", f.data[s : s + f.length[i, k]].tobytes().decode("utf-8", "replace")) is None
    return ok


def iupac(f: Fields, k: int) -> np.ndarray:
    return (f.length[:, k] > 0) & (f.count(k, _IUPAC) == f.length[:, k])


def quality_for(seq: int) -> Callable[[Fields, int], np.ndarray]:
    """Empty, or printable and as long as field ``seq``."""

    def check(f: Fields, k: int) -> np.ndarray:
        n = f.length[:, k]
        return (n == 0) | ((n == f.length[:, seq]) & (f.count(k, _PRINTED) == n))

    return check


def length_of(seq: int) -> Callable[[Fields, int], np.ndarray]:
    """Digits only, and as a number the length of field ``seq`` (leading zeros are allowed)."""

    def check(f: Fields, k: int) -> np.ndarray:
        n = f.length[:, k]
        ok = (n > 0) & (f.count(k, _DIGIT) == n)
        value = np.zeros(len(n), np.int64)
        plain = ok & (n <= LONG_NUMBER)
        for i in range(int(n[plain].max(initial=0))):
            more = plain & (i < n)
            value[more] = value[more] * 10 + (f.byte(k, i)[more].astype(np.int64) - 48)
        for i in np.flatnonzero(ok & ~plain):
            # Longer ones are such a length only if all but their last digits are zeros.
            s = f.start[i, k]
            digits = f.data[s : s + n[i]].tobytes().lstrip(b"0")
            value[i] = int(digits or b"0") if len(digits) <= LONG_NUMBER else -1
        return ok & (value == f.length[:, seq])

    return check


def barcode(f: Fields, k: int) -> np.ndarray:
    """``bc`` and two digits."""
    return (f.length[:, k] == 4) & (f.byte(k, 0) == 98) & (f.byte(k, 1) == 99) & _DIGIT[f.byte(k, 2)] & _DIGIT[f.byte(k, 3)]


def iso_time(f: Fields, k: int) -> np.ndarray:
    """``YYYY-MM-DDTHH:MM:SS``, a date of the proleptic calendar from year 1 and a time of the day."""
    ok = f.length[:, k] == 19
    b = [f.byte(k, i) for i in range(19)]
    for i, c in ((4, "-"), (7, "-"), (10, "T"), (13, ":"), (16, ":")):
        ok &= b[i] == ord(c)

    def number(a: int, z: int) -> np.ndarray:
        nonlocal ok
        v = np.zeros(len(ok), np.int64)
        for i in range(a, z):
            ok &= _DIGIT[b[i]]
            v = v * 10 + b[i] - 48
        return v

    year, month, day, hour, minute, second = (number(a, z) for a, z in ((0, 4), (5, 7), (8, 10), (11, 13), (14, 16), (17, 19)))
    leap = (year % 4 == 0) & ((year % 100 != 0) | (year % 400 == 0))
    days = np.array([0, 31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31])[np.clip(month, 0, 12)] + ((month == 2) & leap)
    return ok & (year >= 1) & (month >= 1) & (month <= 12) & (day >= 1) & (day <= days) & (hour < 24) & (minute < 60) & (second < 60)


@dataclass(frozen=True)
class Field:
    """A field of a record: its name, its SQL type, and a check over all records at once."""

    name: str
    sql_type: str
    check: Callable[[Fields, int], np.ndarray]


#: The fields of a read record.
READ_FIELDS = (
    Field("name", "string", no_blanks),
    Field("seq", "string", iupac),
    Field("qual", "string", quality_for(1)),
    Field("n_bases", "int", length_of(1)),
    Field("barcode", "string", barcode),
    Field("read_at", "timestamp_ntz", iso_time),
)


def index_lines(lines: pa.Array, fields: Sequence[Field]) -> tuple[np.ndarray, Fields]:
    """The reason of each line ('' where it parses) and the fields of those that parse, in order."""
    n, width = len(lines), len(fields)
    missing = np.asarray(lines.is_null())
    lines = lines.fill_null("")
    raw = lines.buffers()
    offsets = np.frombuffer(raw[1], np.int32)[lines.offset : lines.offset + n + 1].astype(np.int64) if n else np.zeros(1, np.int64)
    buf = np.frombuffer(raw[2], np.uint8)[offsets[0] : offsets[-1]] if raw[2] is not None else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    start, end = offsets[:-1], offsets[1:].copy()
    full = end > start
    end[full] -= buf[end[full] - 1] == CR

    quotes = np.flatnonzero(buf == QUOTE)
    of = np.searchsorted(offsets[1:], quotes, "right")
    first = np.searchsorted(quotes, start)
    rank = np.arange(len(quotes)) - first[of]
    opening = (rank & 1) == 0
    padded = np.concatenate((buf, [0])).astype(np.uint8)
    before, after = padded[quotes - 1], padded[quotes + 1]
    at_start, at_end = quotes == start[of], quotes + 1 == end[of]
    legal = np.where(opening, at_start | (before == QUOTE) | (before == COMMA), at_end | (after == QUOTE) | (after == COMMA))
    broken = np.zeros(n, bool)
    broken[of[~legal]] = True
    broken |= (np.bincount(of, minlength=n) & 1).astype(bool)

    commas = np.flatnonzero(buf == COMMA)
    line = np.searchsorted(offsets[1:], commas, "right")
    parting = ((np.searchsorted(quotes, commas) - first[line]) & 1) == 0
    commas, line = commas[parting], line[parting]
    count = np.bincount(line, minlength=n) + 1

    reason = np.full(n, "", object)
    reason[count != width] = COLUMNS
    reason[broken] = QUOTING
    reason[missing | (end == start)] = COLUMNS
    good = reason == ""
    rows = np.flatnonzero(good)
    cut = commas[good[line]].reshape(len(rows), width - 1)
    left = np.column_stack((start[rows], cut + 1)) if len(rows) else np.zeros((0, width), np.int64)
    right = np.column_stack((cut, end[rows])) if len(rows) else np.zeros((0, width), np.int64)
    quoted = (right > left) & (padded[left] == QUOTE)
    left, right = left + quoted, right - quoted
    edge = np.zeros(len(buf) + 1, np.int8)
    np.add.at(edge, left.ravel(), 1)
    np.add.at(edge, right.ravel(), -1)
    keep = np.cumsum(edge[:-1], dtype=np.int8).astype(bool)
    keep[quotes[opening & ~at_start & (before == QUOTE)]] = False  # the second of a doubled quote
    kept = np.concatenate(([0], np.cumsum(keep, dtype=np.int64)))
    cells = Fields(buf[keep], kept[left], kept[right] - kept[left])
    valid = np.ones(len(rows), bool)
    for k, field in enumerate(fields):
        valid &= field.check(cells, k)
    reason[rows[~valid]] = VALUE
    return reason, Fields(cells.data, cells.start[valid], cells.length[valid])


def parse_records(df: DataFrame, line: str = "line", keys: Sequence[str] = ("raw_id",), fields: Sequence[Field] = READ_FIELDS, reason: str = "reason") -> DataFrame:
    """One row per row of ``df``: ``keys``, the typed ``fields`` and ``reason``.

    ``reason`` is null for a line that parses. Otherwise the fields are null and it is the first of:
    ``columns`` (null or empty line), ``quoting`` (an unclosed or misplaced double quote), ``columns``
    (another number of fields), ``value`` (a field's check fails). One carriage return at the end of a
    line is not part of it. Empty input gives no rows; repeated rows come out as often as they stand
    in ``df``; columns of ``df`` other than ``keys`` are not read, and a key whose name a field or
    ``reason`` has comes out with ``_key`` after it.
    """
    fields = tuple(fields)
    clash = {f.name.lower() for f in fields} | {reason.lower()}
    out_keys = [f"{k}_key" if k.lower() in clash else k for k in keys]
    source = df.select(*[df[k].alias(f"k{i}") for i, k in enumerate(keys)], df[line].cast("string").alias("line"))
    schema = T.StructType([*[T.StructField(f"k{i}", source.schema[i].dataType) for i in range(len(keys))], *[T.StructField(f"f{i}", T.StringType()) for i in range(len(fields))], T.StructField("reason", T.StringType())])

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines = batch.column(len(keys))
            why, cells = index_lines(lines, fields)
            ok = why == ""
            place = pa.array(np.where(ok, np.cumsum(ok) - 1, 0), mask=~ok)
            columns = [batch.column(i) for i in range(len(keys))]
            columns += [cells.strings(k).take(place) for k in range(len(fields))]
            columns.append(pa.array(np.where(ok, None, why), pa.string()))
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    parsed = source.mapInArrow(parse, schema)
    return parsed.select(
        *[F.col(f"k{i}").alias(k) for i, k in enumerate(out_keys)],
        *[F.col(f"f{i}").cast(f.sql_type).alias(f.name) for i, f in enumerate(fields)],
        F.col("reason").alias(reason),
    )


def valid_and_rejected(parsed: DataFrame, reason: str = "reason") -> tuple[DataFrame, DataFrame]:
    """The valid rows without ``reason``, and the rejected ones with it."""
    return parsed.filter(F.col(reason).isNull()).drop(reason), parsed.filter(F.col(reason).isNotNull())
