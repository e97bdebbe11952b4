"""Text that was decoded with the wrong encoding: found and, where nothing was lost, restored.

1. Words. Every word with a non-ASCII character is counted by the documents it stands in, under keys that
   garbling leaves alone: the word stripped of non-ASCII characters; where too little is left of it, what is left
   with the ASCII token before or after it; for words without any ASCII, the order in which its units repeat.
2. Twins. Words of equal keys are joined; the one that stands in many more documents is taken as the clean
   twin. A key has at most 1 / ``SHARE`` twins, so the pairs are linear in the words, however hot a key is.
3. Alignment. The stripped characters of a word are aligned with those of its twin, run by run. A run that a
   pair of encodings explains votes for that pair; all others vote unit by unit for a mapping of
   characters. Runs and units that enough different words agree on are learned, nothing else is used.
4. Application. Learned mappings are applied to all words, also those without a twin, several times in a row. A word is
   garbled if what it was has neighbouring characters that are far more usual than its own. Counts of neighbours are
   exact and joined by Spark.

No list of encodings is kept: what Python can encode is only asked which pair explains a run that twins have aligned,
so that a learned mapping covers characters no twin has shown. Encodings that Python does not know are learned
character by character.
"""

from __future__ import annotations

import codecs
import encodings.aliases
import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pilewright.tables import checkpointed

#: A twin stands in this share of the documents of its key at least, and in ``VOTES`` times as many as the word.
SHARE = 0.01
#: Words, and different aligned runs, that must agree before a mapping is learned.
VOTES = 3
#: Bytes of an encoding of several bytes, over all aligned runs, that are proof without so many words.
PROOF = 4
#: Pairs of encodings that explain nearly as many runs as the best are kept beside it.
NEARLY = 0.9
#: Of the votes of a unit, the share that its character must have.
AGREED = 0.8
#: What the word was must have neighbours in this many times more documents, and in this many at least; the strict
#: form of UTF-8 is proof enough to need no more than better evidence.
RATIO, LEAST = 8, 4
#: Text may have been decoded wrongly this many times in a row.
DEPTH = 3
#: ASCII letters that a stripped word must keep to be a key by itself; units that a word needs for a key of repeats.
LETTERS, UNITS = 2, 4
#: Characters of a unit: one character may have become so many.
UNIT_SIZES = (1, 2, 3)

WORD = re.compile(r"[A-Za-z\x80-\U0010ffff]+")
TOKEN = re.compile(r"[A-Za-z\x80-\U0010ffff]+|[0-9]+")
STRIPPED = re.compile(r"[\x80-\U0010ffff]+")
LOST = "�"


@lru_cache
def known_encodings() -> tuple[str, ...]:
    """What Python encodes text with such that ASCII stays as it is and all else has a byte above it."""
    out = []
    for name in sorted(set(encodings.aliases.aliases.values())):
        try:
            if codecs.lookup(name)._is_text_encoding and bytes(range(128)).decode(name) == "".join(map(chr, range(128))):
                samples = [c for c in "éжωשعก中ひ가" if c == c.encode(name, "ignore").decode(name)]
                if samples and all(max(c.encode(name)) > 127 for c in samples):
                    out.append(name)
        except (LookupError, UnicodeError):
            pass
    return tuple(out)


@lru_cache
def byte_table(name: str) -> dict[int, str] | None:
    """Characters above ASCII to bytes (as Latin-1 characters) of a single-byte encoding; None for all others.

    C1 controls stand for bytes that the encoding leaves free or that were read as Latin-1.
    """
    table: dict[int, str] = {}
    for b in range(0x80, 0x100):
        try:
            c = bytes([b]).decode(name)
        except UnicodeDecodeError:
            continue
        if len(c) == 1:
            table[ord(c)] = chr(b)
    if len(table) < 32 or any(len(c.encode(name, "ignore")) > 1 for c in "é中ひ가"):
        return None
    for b in range(0x80, 0xA0):
        table.setdefault(b, chr(b))
    return table


def to_bytes(text: str, name: str) -> bytes | None:
    """The bytes that ``text`` was read from with encoding ``name``; None where it cannot be."""
    table = byte_table(name)
    try:
        return text.encode(name) if table is None else text.translate(table).encode("latin-1") if all(ord(c) in table for c in text if c > "\x7f") else None
    except UnicodeError:
        return None


def explained_by(garbled: str, clean: str) -> list[str]:
    """``read>written`` of all encodings such that ``clean``, written in one and read with the other, is ``garbled``."""
    by_bytes: dict[bytes, list[str]] = {}
    for name in known_encodings():
        try:
            by_bytes.setdefault(clean.encode(name), []).append(name)
        except UnicodeError:
            pass
    return [f"{read}>{written}" for read in known_encodings() if (b := to_bytes(garbled, read)) is not None for written in by_bytes.get(b, ()) if written != read]


class Mapping:
    """A learned mapping from garbled text to what it was."""

    def __init__(self, name: str, units: dict[str, str] | None = None, size: int = 1) -> None:
        self.name, self.units, self.size = name, units, size
        if units is None:
            self.read, self.written = name.split(">")
        self.strict = units is None and self.written.startswith("utf_8")
        self.direct: dict[int, str] | None = None
        #: The characters that it applies to, where they are few.
        self.covers: frozenset[str] | None = None
        self.table = byte_table(self.read) if units is None else None
        if units is None and self.table is not None and byte_table(self.written) is not None:
            self.direct = {}
            for c, b in self.table.items():
                try:
                    self.direct[c] = b.encode("latin-1").decode(self.written)
                except UnicodeDecodeError:
                    pass
        if self.table is not None:
            self.covers = frozenset(map(chr, self.direct if self.direct is not None else self.table))

    def undo(self, text: str, above: set[str]) -> str | None:
        """What ``text`` was; ``above`` are its characters above ASCII. None where the mapping does not apply."""
        if self.covers is not None and not above <= self.covers:
            return None
        if self.direct is not None:
            return text.translate(self.direct)
        if self.units is None:
            try:
                raw = text.encode(self.read) if self.table is None else text.translate(self.table).encode("latin-1")
                return raw.decode(self.written)
            except UnicodeError:
                return None
        out, at, n = [], 0, self.size
        while at < len(text):
            if text[at] <= "\x7f":
                out.append(text[at])
                at += 1
            elif (c := self.units.get(text[at : at + n])) is not None:
                out.append(c)
                at += n
            else:
                return None
        return "".join(out)


def repeats(word: str, size: int) -> str | None:
    """The order in which the units of a word repeat; None for words of too few units."""
    if len(word) % size or len(word) < UNITS * size:
        return None
    seen: dict[str, int] = {}
    return f"{len(word) // size}:" + ",".join(str(seen.setdefault(word[i : i + size], len(seen))) for i in range(0, len(word), size))


def words_of(documents: DataFrame) -> DataFrame:
    """``doc_id, word, keys``: the distinct words with a non-ASCII character of each document, and what they are joined by."""
    dirty = documents.select("doc_id", "text").filter(F.col("text").rlike(r"[^\x00-\x7F]"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, words, keys = [], [], []
            for row, text in enumerate(batch.column(1).to_pylist()):
                found: dict[str, set[str]] = {}
                for line in re.split(r"[\r\n]+", text):
                    if line.isascii():
                        continue
                    tokens = TOKEN.findall(line)
                    for at, token in enumerate(tokens):
                        if token.isascii():
                            continue
                        left = STRIPPED.sub("", token)
                        under = found.setdefault(token, set())
                        if len(left) >= LETTERS:
                            under.add(f"w {left}")
                        else:
                            if at and tokens[at - 1].isascii():
                                under.add(f"l {tokens[at - 1]} {left}")
                            if at + 1 < len(tokens) and tokens[at + 1].isascii():
                                under.add(f"r {left} {tokens[at + 1]}")
                rows += [row] * len(found)
                words += found
                keys += map(list, found.values())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(words, pa.string()), pa.array(keys, pa.list_(pa.string()))], names=["doc_id", "word", "keys"])

    return dirty.mapInArrow(cut, "doc_id bigint, word string, keys array<string>")


def find_twins(words: DataFrame, counted: DataFrame) -> DataFrame:
    """``word, twin, whole``: pairs of equal keys of which the second stands in many more documents.

    ``whole`` is true for pairs joined by the order of repeats: their whole words are aligned, not what was stripped.
    """

    def by_repeats(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for word, n in zip(batch["word"], batch["n"]):
                # A word that keeps its ASCII letters is joined by them; the trail bytes of some encodings are letters.
                above = sum(c > "\x7f" for c in word)
                if 2 * above < len(word) or LOST in word:
                    continue
                for size in UNIT_SIZES:
                    key = repeats(word, size)
                    if key is not None and (size > 1 or above == len(word)):
                        out.append((f"p {key}", word, n, size == 1))
            yield pd.DataFrame(out, columns=["key", "word", "n", "plain"])

    stripped = words.select("word", F.explode("keys").alias("key")).groupBy("key", "word").agg(F.count(F.lit(1)).alias("n")).select("key", "word", "n", F.lit(True).alias("plain"))
    keyed = checkpointed(stripped.unionByName(counted.select("word", "n").mapInPandas(by_repeats, "key string, word string, n bigint, plain boolean")))
    totals = keyed.filter("plain").groupBy("key").agg(F.sum("n").alias("total")).filter(F.col("total") > VOTES)
    twins = keyed.filter(F.col("plain") & (F.col("n") >= VOTES)).join(totals, "key").filter(F.col("n") >= F.col("total") * SHARE)
    twins = twins.select(F.col("key").alias("k"), F.col("word").alias("twin"), F.col("n").alias("twin_n"))
    pairs = keyed.join(twins, (F.col("key") == F.col("k")) & (F.col("word") != F.col("twin")) & (F.col("twin_n") >= VOTES * F.col("n")))
    return pairs.select("word", "twin", F.col("key").startswith("p ").alias("whole")).distinct()


def learn(pairs: DataFrame) -> list[Mapping]:
    """The mappings that enough twins agree on.

    To the driver come votes per pair of encodings, of which there are as many as Python knows, and the units of
    unexplained runs that enough words agree on, at most one a garbled unit.
    """
    letters = F.lit("[A-Za-z]+")
    cut = lambda c: F.when(F.col("whole"), F.col(c)).otherwise(F.regexp_replace(c, letters, F.lit(" ")))
    aligned = pairs.select(cut("word").alias("garbled"), cut("twin").alias("clean"), "word").filter(F.col("garbled") != F.col("clean"))
    aligned = aligned.groupBy("garbled", "clean").agg(F.countDistinct("word").alias("words"))

    def explain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ways = [explained_by(g, c) for g, c in zip(batch["garbled"], batch["clean"])]
            yield batch.assign(ways=ways)

    explained = checkpointed(aligned.repartition("garbled", "clean").mapInPandas(explain, "garbled string, clean string, words bigint, ways array<string>"))
    # What reads as UTF-8 itself is no clean twin.
    unclean = explained.filter(F.exists("ways", lambda w: w.endswith(">utf_8"))).select(F.col("garbled").alias("unclean")).distinct()
    explained = checkpointed(explained.join(unclean, F.col("clean") == F.col("unclean"), "left_anti"))
    named = explained.filter(F.size("ways") > 0)
    runs = {r["way"]: r["runs"] for r in named.select(F.explode("ways").alias("way")).groupBy("way").agg(F.count(F.lit(1)).alias("runs")).collect()}

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ways = [[x for x in w if runs[x] >= NEARLY * max(runs[y] for y in w)] for w in batch["ways"]]
            written = [max((x.split(">")[1] for x in w if byte_table(x.split(">")[1]) is None), default=None) for w in ways]
            proof = [sum(b > 127 for b in c.encode(w)) if w else 0 for w, c in zip(written, batch["clean"])]
            yield pd.DataFrame({"garbled": batch["garbled"], "clean": batch["clean"], "way": ways, "words": batch["words"], "proof": proof})

    # Each run votes for the pairs that explain most runs, or nearly as many, as long as its twin is not itself garbled by a
    # way with more votes.
    chosen = checkpointed(named.mapInPandas(best, "garbled string, clean string, way array<string>, words bigint, proof bigint").withColumn("way", F.explode("way")))
    weights = chosen.groupBy("way").agg(F.sum("words").alias("weight"))
    weighed = chosen.join(weights, "way")
    rivals = weighed.groupBy(F.col("garbled").alias("rival")).agg(F.max("weight").alias("rival_weight"))
    votes = weighed.join(rivals, F.col("clean") == F.col("rival"), "left").filter(F.coalesce("rival_weight", F.lit(0)) <= F.col("weight"))
    votes = votes.groupBy("way").agg(F.sum("words").alias("words"), F.count(F.lit(1)).alias("runs"), F.sum("proof").alias("proof"))
    ways = sorted(r["way"] for r in votes.filter((F.col("proof") >= PROOF) | ((F.col("words") >= VOTES) & (F.col("runs") >= VOTES))).collect())

    def unit_votes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for garbled, clean, words in zip(batch["garbled"], batch["clean"], batch["words"]):
                g, c = STRIPPED.findall(garbled), STRIPPED.findall(clean)
                size = len(g[0]) // len(c[0]) if g and c else 0
                if size in UNIT_SIZES and len(g) == len(c) and all(len(x) == size * len(y) for x, y in zip(g, c)):
                    out += {(size, ord(y[i]) >> 7, x[i * size : (i + 1) * size], y[i], words) for x, y in zip(g, c) for i in range(len(y))}
            yield pd.DataFrame(out, columns=["size", "script", "unit", "char", "words"])

    units = explained.filter(F.size("ways") == 0).mapInPandas(unit_votes, "size int, script int, unit string, char string, words bigint")
    units = units.groupBy("size", "script", "unit", "char").agg(F.sum("words").alias("words"), F.count(F.lit(1)).alias("runs"))
    # Chance gives a unit many characters, and a character many units: both must agree.
    units = checkpointed(units)
    of_unit = units.groupBy("size", "script", "unit").agg(F.sum("words").alias("by_unit"))
    of_char = units.groupBy("size", "script", "char").agg(F.sum("words").alias("by_char"))
    agreed = units.filter((F.col("words") >= VOTES) & (F.col("runs") >= 2) & (F.col("unit") != F.col("char"))).join(of_unit, ["size", "script", "unit"]).join(of_char, ["size", "script", "char"])
    tables: dict[tuple[int, int], dict[str, str]] = {}
    for r in agreed.filter(F.col("words") >= AGREED * F.greatest("by_unit", "by_char")).collect():
        tables.setdefault((r["size"], r["script"]), {})[r["unit"]] = r["char"]
    return [Mapping(w) for w in ways] + [Mapping(f"{size} of block {script}", table, size) for (size, script), table in sorted(tables.items()) if len(table) >= VOTES]


def neighbours(word: str) -> set[str]:
    """Pairs of neighbouring characters, one of them at least not ASCII; ``^`` and ``$`` are the edges."""
    edged = f"^{word}$"
    return {edged[i : i + 2] for i in range(len(edged) - 1) if edged[i] > "\x7f" or edged[i + 1] > "\x7f"}


def readings(word: str, mappings: list[Mapping]) -> Iterator[tuple[str, str, bool]]:
    """(ways one after the other, what the word was, whether its form is strict), several mappings deep."""
    level, seen = [(word, "")], set()
    for _ in range(DEPTH):
        following = []
        for text, way in level:
            above = {c for c in text if c > "\x7f"}
            for m in mappings:
                was = m.undo(text, above)
                if was is None or was == word or LOST in was or was in seen:
                    continue
                seen.add(was)
                name = f"{way} {m.name}".strip()
                if m.strict:
                    following.append((was, name))
                if not was.isascii() and (m.strict or not word.isspace()):
                    yield name, was, m.strict
        level = following


def find_garbled(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(``doc_id, word, restored``: the garbled words of each garbled document; ``word, restored``: all garbled words).

    A word with U+FFFD is garbled, and lost: its ``restored`` is null. Null, empty and plain ASCII texts have no words; a
    document is listed once for each of its garbled words, also when it is repeated. Texts and words of any length are
    read whole. An empty table gives no rows.
    """
    # Words are cut once and read several times.
    words = checkpointed(words_of(documents))
    counted = checkpointed(words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).select(F.md5("word").alias("id"), "word", "n"))
    mappings = learn(find_twins(words, counted))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for key, word in zip(batch["id"], batch["word"]):
                if LOST in word:
                    out.append((key, LOST, word, None, False, None))
                    continue
                ways = list(readings(word, mappings))
                if ways:
                    out.append((key, "", word, word, False, list(neighbours(word))))
                    out += [(key, way, word, was, strict, list(neighbours(was))) for way, was, strict in ways]
            yield pd.DataFrame(out, columns=["id", "way", "word", "was", "strict", "pairs"])

    def beside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total: dict[str, int] = {}
            for word, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for p in neighbours(word):
                    total[p] = total.get(p, 0) + n
            yield pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.string()), pa.array(total.values(), pa.int64())], names=["pair", "n"])

    # The work of a word is not in proportion to its bytes: a fixed number of tasks, not one a size.
    parts = max(documents.sparkSession.sparkContext.defaultParallelism, int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    candidates = checkpointed(counted.select("id", "word").repartition(parts, "id").mapInPandas(read, "id string, way string, word string, was string, strict boolean, pairs array<string>"))
    usual = counted.select("word", "n").mapInArrow(beside, "pair string, n bigint").groupBy("pair").agg(F.sum("n").alias("n"))
    asked = candidates.select("id", "way", "strict", F.explode("pairs").alias("pair"))
    evidence = asked.join(usual, "pair", "left").groupBy("id", "way", "strict").agg(F.min(F.coalesce("n", F.lit(0))).alias("found"))
    # A word that is known as a whole is preferred.
    known = candidates.filter(F.col("was").isNotNull() & (F.col("way") != "")).select("id", "way", F.md5("was").alias("was_id")).join(counted.select(F.col("id").alias("was_id"), F.col("n").alias("listed")), "was_id").drop("was_id")
    evidence = evidence.join(known, ["id", "way"], "left").withColumn("listed", F.coalesce("listed", F.lit(0)))
    own = F.min(F.when(F.col("way") == "", F.col("found")))
    by_word = evidence.groupBy("id").agg(own.alias("own"), F.collect_list(F.when(F.col("way") != "", F.struct("strict", "listed", "found", "way"))).alias("ways"))
    enough = lambda w: F.when(w["strict"], w["found"] > F.col("own") + 1).otherwise((w["found"] >= LEAST) & (w["found"] >= RATIO * F.col("own")))
    chosen = by_word.select("id", F.array_max(F.filter("ways", enough)).alias("best")).filter(F.col("best").isNotNull()).select("id", F.col("best.way").alias("way"))
    restored = candidates.join(chosen, ["id", "way"]).select("word", F.col("was").alias("restored"))
    garbled = checkpointed(restored.unionByName(candidates.filter(F.col("way") == LOST).select("word", F.col("was").alias("restored"))))
    return words.join(garbled, "word").select("doc_id", "word", "restored").distinct(), garbled


def restore(documents: DataFrame) -> DataFrame:
    """``doc_id, restored_text, complete`` of the garbled documents: every garbled word replaced by what it was.

    ``complete`` is false where a word that was found to be garbled could not be restored and stands as it was. Repeated rows of
    a document come out once.
    """
    found, _ = find_garbled(documents)
    per_document = found.groupBy("doc_id").agg(F.map_from_entries(F.collect_set(F.struct("word", F.coalesce("restored", F.lit(""))))).alias("words"))
    texts = documents.select("doc_id", "text").dropDuplicates(["doc_id"]).join(per_document, "doc_id")

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, complete = [], []
            for text, words in zip(batch.column("text").to_pylist(), batch.column("words").to_pylist()):
                was = dict(words)
                texts.append(WORD.sub(lambda m: was.get(m.group()) or m.group(), text))
                complete.append(all(was.values()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string()), pa.array(complete)], names=["doc_id", "restored_text", "complete"])

    return texts.select("doc_id", "text", "words").mapInArrow(rewrite, "doc_id bigint, restored_text string, complete boolean")
