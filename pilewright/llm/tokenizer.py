"""Encoding of a whole corpus with a public byte-level BPE, by prefix dynamic programming.

Of every prefix of a piece exactly one vocabulary entry can be the last token of its encoding: the one that
is a suffix of the prefix and may stand after the last token of what is before it. Storing that token
for each prefix (``PrefixTable``) gives the encoding by walking back from the end; appending bytes only
adds entries, and cutting bytes off only drops some, so edits need no new start.

Two tokens may stand side by side exactly if undoing their merges along the boundary, the later first,
never meets a pair that the merges would have joined across it before.

Text is split into pieces by the vocabulary's pattern, evaluated for a whole batch at once on arrays of
character classes; each distinct piece of a batch is encoded once.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

#: Characters of a batch that are split at once (a longer text is a batch of its own).
CHUNK_CHARS = 1 << 20
#: Distinct pieces that a worker keeps; beyond it they are encoded again.
KEPT_PIECES = 300_000

SPACE_CHAR, APOSTROPHE = 32, 39
LETTER, NUMBER, BLANK, OTHER = 0, 1, 2, 3


def vocabulary_path(name: str = "byte_bpe_50k.json", folder: str | None = None) -> str:
    """A file of the installed public tokenizers, or of ``folder``."""
    if folder is None:
        import public_tokenizers

        return public_tokenizers.path(name)
    return os.path.join(folder, name)


def _byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in the vocabulary file, and that byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Vocabulary:
    """Tokens by bytes, and the merge that makes each one."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        alphabet = _byte_alphabet()
        as_bytes = lambda s: bytes(alphabet[c] for c in s)
        self.id_of: dict[bytes, int] = {as_bytes(t): i for t, i in model["vocab"].items() if all(c in alphabet for c in t)}
        #: The longest token that ends with some three bytes; all others have two at most.
        self.longest: dict[bytes, int] = {}
        for t in self.id_of:
            if len(t) > self.longest.get(t[-3:], 2):
                self.longest[t[-3:]] = len(t)
        ids = model["vocab"]
        self.order: dict[tuple[int, int], int] = {}
        self.made_by: dict[int, tuple[int, int, int]] = {}
        for rank, merge in enumerate(model["merges"]):
            left, right = merge if isinstance(merge, list) else merge.split(" ")
            pair = ids[left], ids[right]
            self.order[pair] = rank
            self.made_by.setdefault(ids[left + right], (rank, *pair))
        self.beside: dict[int, bool] = {}
        self.pieces: dict[str, list[int]] = {}

    def may_follow(self, left: int, right: int) -> bool:
        """Whether the encoding of the bytes of both is the two of them."""
        key = left << 32 | right
        known = self.beside.get(key)
        if known is None:
            if len(self.beside) > 4 * KEPT_PIECES:
                self.beside.clear()
            known = self.beside[key] = self._boundary_stays(left, right)
        return known

    def _boundary_stays(self, left: int, right: int) -> bool:
        # Rank of the earliest merge that has been undone so far on either side, with its place: a merge across
        # the boundary wins against what is left of it if it comes first, on a tie if it stands further left.
        undone, undone_left = 1 << 60, False
        while True:
            across = self.order.get((left, right))
            if across is not None and (across < undone or (across == undone and not undone_left)):
                return False
            a, b = self.made_by.get(left), self.made_by.get(right)
            if a is None and b is None:
                return True
            # Of equal ranks the merge on the right came last.
            if b is None or (a is not None and a[0] > b[0]):
                undone, undone_left, left = a[0], True, a[2]
            else:
                undone, undone_left, right = b[0], False, b[1]

    def encode_piece(self, piece: str) -> list[int]:
        found = self.pieces.get(piece)
        if found is None:
            raw = piece.encode()
            whole = self.id_of.get(raw)
            if whole is not None:
                found = [whole]
            else:
                table = PrefixTable(self)
                table.append(raw)
                found = table.tokens()
            if len(self.pieces) >= KEPT_PIECES:
                self.pieces.clear()
            self.pieces[piece] = found
        return found


class PrefixTable:
    """The unique last token of every byte prefix of one piece; exact under appends and edits."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.vocabulary = vocabulary
        self.raw = b""
        self.last: list[int] = []
        self.size: list[int] = []

    def append(self, raw: bytes) -> None:
        """Add bytes at the end: one more entry each, none changes."""
        start = len(self.raw)
        self.raw += raw
        text, id_of, longest = self.raw, self.vocabulary.id_of, self.vocabulary.longest
        last, size, may_follow = self.last, self.size, self.vocabulary.may_follow
        for end in range(start + 1, len(text) + 1):
            least = end - longest.get(text[end - 3 : end], 2) if end > 3 else 0
            for begin in range(least if least > 0 else 0, end):
                token = id_of.get(text[begin:end])
                if token is not None and (begin == 0 or may_follow(last[begin - 1], token)):
                    last.append(token)
                    size.append(end - begin)
                    break

    def cut(self, length: int) -> None:
        """Keep the first ``length`` bytes."""
        self.raw, self.last, self.size = self.raw[:length], self.last[:length], self.size[:length]

    def edit(self, start: int, end: int, raw: bytes) -> None:
        """Replace bytes [start, end): prefixes before ``start`` stay."""
        rest = self.raw[end:]
        self.cut(start)
        self.append(raw + rest)

    def tokens(self) -> list[int]:
        out, at = [], len(self.raw)
        while at:
            out.append(self.last[at - 1])
            at -= self.size[at - 1]
        return out[::-1]


@lru_cache
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


@lru_cache
def character_classes() -> np.ndarray:
    """Class of each code point: letter, number, white space, other."""
    out = np.full(0x110000, OTHER, np.uint8)
    codes = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    every, place = "".join(map(chr, codes)), np.array(codes)
    for pattern, kind in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER), (r"\s+", BLANK)):
        for m in regex.finditer(pattern, every):
            out[place[m.start() : m.end()]] = kind
    return out


def piece_starts(codes: np.ndarray, text_starts: np.ndarray) -> np.ndarray:
    """Where pieces begin in texts that stand one after the other; ``text_starts`` has one entry a text.

    The same pieces as the pattern of the vocabulary finds from left to right.
    """
    n = len(codes)
    kind = character_classes()[codes]
    begins = np.zeros(n + 1, bool)  # of texts; n is the end of the last
    begins[text_starts] = True
    begins[n] = True
    start = begins[:-1].copy()
    start[1:] |= kind[1:] != kind[:-1]
    # The last blank before other characters stands alone; a space joins what follows.
    blank = kind == BLANK
    last = blank.copy()
    last[:-1] &= ~blank[1:]
    last &= ~begins[1:]
    start |= last
    joins = np.flatnonzero(last & (codes == SPACE_CHAR)) + 1
    start[joins] = False
    # An apostrophe that begins a piece takes s, t, m, d, re, ve or ll with it.
    quote = np.flatnonzero((codes == APOSTROPHE) & start)
    quote = quote[quote + 1 < n]
    quote = quote[~begins[quote + 1]]
    first = codes[quote + 1]
    two = quote + 2 < n
    second = np.where(two & ~begins[np.minimum(quote + 2, n)], codes[np.minimum(quote + 2, n - 1)], 0)
    one_letter = np.isin(first, [ord(c) for c in "stmd"])
    two_letters = ((second == ord("e")) & ((first == ord("r")) | (first == ord("v")))) | ((first == ord("l")) & (second == ord("l")))
    taken = np.where(one_letter, 1, np.where(two_letters, 2, 0))
    quote, taken = quote[taken > 0], taken[taken > 0]
    start[quote + 1] = False
    after = quote + 1 + taken
    start[after[after < n]] = True
    return np.flatnonzero(start)


_FACTOR = 0x9E3779B97F4A7C15
_INVERSE = pow(_FACTOR, -1, 1 << 64)


@lru_cache
def _powers(base: int, bits: int) -> np.ndarray:
    out = np.full(1 << bits, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def distinct_pieces(codes: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One place of each distinct piece, and for each piece the number of its distinct one. Exact."""
    bits = max(20, int(len(codes)).bit_length())
    power, inverse = _powers(_FACTOR, bits), _powers(_INVERSE, bits)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * power[: len(codes)], dtype=np.uint64)))
    key = (total[end] - total[start]) * inverse[start]
    _, first, which = np.unique(key, return_index=True, return_inverse=True)
    # Keys may collide: compare every piece with the one that stands for it, character by character.
    length, chosen = end - start, first[which]
    same = length == length[chosen]
    size = np.where(same, length, 0)
    offset = np.concatenate(([0], np.cumsum(size)))
    step = np.arange(offset[-1]) - np.repeat(offset[:-1], size)
    differs = codes[np.repeat(start, size) + step] != codes[np.repeat(start[chosen], size) + step]
    if differs.any():
        same[np.searchsorted(offset[1:], np.flatnonzero(differs), "right")] = False
    odd = np.flatnonzero(~same)
    which = which.copy()
    which[odd] = len(first) + np.arange(len(odd))
    return np.concatenate((first, odd)), which


class BatchEncoder:
    """Token ids or their number for batches of texts."""

    def __init__(self, path: str) -> None:
        self.vocabulary = vocabulary(path)

    def chunks(self, texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(texts, flat ids, tokens of each piece, first piece of each text) for runs of texts."""
        n = len(texts)
        raw = texts.fill_null("").buffers() if texts.null_count else texts.buffers()
        shift = 0 if texts.null_count else texts.offset
        offsets = np.frombuffer(raw[1], np.int32)[shift : shift + n + 1].astype(np.int64)
        data = np.frombuffer(raw[2], np.uint8) if raw[2] is not None else np.zeros(0, np.uint8)
        at = 0
        while at < n:
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + CHUNK_CHARS, "right")) - 1)
            part = data[offsets[at] : offsets[to]]
            chars = np.concatenate(([0], np.cumsum((part & 0xC0) != 0x80)))[offsets[at : to + 1] - offsets[at]]
            text = part.tobytes().decode("utf-8")
            yield to - at, *self.encode(text, chars)
            at = to

    def encode(self, text: str, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        if not len(codes):
            return np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(len(bounds), np.int64)
        begins = bounds[:-1]
        start = piece_starts(codes, begins[begins < len(codes)])
        end = np.append(start[1:], len(codes))
        place, which = distinct_pieces(codes, start, end)
        encode = self.vocabulary.encode_piece
        found = [encode(text[a:z]) for a, z in zip(start[place].tolist(), end[place].tolist())]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        flat = np.fromiter((t for f in found for t in f), np.int32, int(sizes.sum()))
        begin_of = np.concatenate(([0], np.cumsum(sizes)))[:-1]
        lengths = sizes[which]
        offset = np.concatenate(([0], np.cumsum(lengths)))
        ids = flat[np.repeat(begin_of[which] - offset[:-1], lengths) + np.arange(offset[-1])]
        return ids, lengths, np.searchsorted(start, bounds)

    def counts(self, texts: pa.Array) -> np.ndarray:
        out = []
        for _, _, lengths, first in self.chunks(texts):
            total = np.concatenate(([0], np.cumsum(lengths)))
            out.append(np.diff(total[first]))
        return np.concatenate(out) if out else np.zeros(0, np.int64)

    def lists(self, texts: pa.Array) -> pa.Array:
        flats, sizes = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
        for _, ids, lengths, first in self.chunks(texts):
            total = np.concatenate(([0], np.cumsum(lengths)))
            flats.append(ids)
            sizes.append(np.diff(total[first]))
        offsets = np.concatenate(([0], np.cumsum(np.concatenate(sizes)))).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(flats)))

    def encode_text(self, text: str) -> list[int]:
        return self.encode(text, np.array([0, len(text)]))[0].tolist()

    def reencode(self, text: str, ids: Sequence[int], start: int, end: int, new: str) -> tuple[str, list[int]]:
        """``text`` with characters [start, end) replaced by ``new``, and its ids, given the ids of ``text``.

        Only pieces near the edit are encoded again: from the last piece that begins a blank or more before it
        to the first old boundary behind it from which both texts have the same pieces.
        """
        edited = text[:start] + new + text[end:]
        old, fresh = self._pieces(text), self._pieces(edited)
        head = 0
        while head < min(len(old), len(fresh)) and old[head] == fresh[head]:
            head += 1
        tail = 0
        while tail < min(len(old), len(fresh)) - head and old[-1 - tail] == fresh[-1 - tail]:
            tail += 1
        encode = self.vocabulary.encode_piece
        kept = sum(len(encode(p)) for p in old[:head])
        dropped = sum(len(encode(p)) for p in old[len(old) - tail :])
        middle = [t for p in fresh[head : len(fresh) - tail] for t in encode(p)]
        return edited, [*ids[:kept], *middle, *ids[len(ids) - dropped :]]

    def _pieces(self, text: str) -> list[str]:
        if not text:
            return []
        starts = piece_starts(np.frombuffer(text.encode("utf-32-le"), np.uint32), np.array([0])).tolist()
        return [text[a:z] for a, z in zip(starts, [*starts[1:], len(text)])]


def encode_corpus(documents: DataFrame, path: str | None = None) -> DataFrame:
    """``doc_id, ids`` of every document: token ids without special tokens.

    Null and empty texts give an empty list; strings that look like special tokens are ordinary text; texts
    of any length are encoded whole. Repeated rows come out as often as they stand in ``documents``; an
    empty table gives no rows; other columns are not read. No shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Where the vocabulary lies is the worker's own matter.
        encoder = BatchEncoder(path or vocabulary_path())
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), encoder.lists(batch.column(1))], names=["doc_id", "ids"])

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id bigint, ids array<int>")


def count_tokens(documents: DataFrame, path: str | None = None) -> DataFrame:
    """``doc_id, n_tokens`` of every document; 0 for null and empty texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Where the vocabulary lies is the worker's own matter.
        encoder = BatchEncoder(path or vocabulary_path())
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(encoder.counts(batch.column(1)), pa.int64())], names=["doc_id", "n_tokens"])

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id bigint, n_tokens bigint")
