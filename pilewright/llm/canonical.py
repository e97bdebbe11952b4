"""Freely typed values to the entries of a reference list, by token-level repair and soft TF-IDF.

Values and list are DataFrames; nothing of either is collected or bounded.

1. Distinct values are cleaned (compatibility forms, look-alike letters, accents, remarks and marks around them) and cut into
   tokens; the whole of a value without separators is a token too, for separators that are lost or misplaced.
2. Each distinct token is joined once with the vocabulary of the list by edit distance, over the strings that one or two
   deletions make of either (an equi-join).
3. Entries are ranked by soft TF-IDF between the corrected tokens and each of their spellings. A spelling is scored for a
   value only if they share one of its heavy terms: those without which no score reaches ``SCORE``, so that none is missed
   and a term that many entries have leads to none of them by itself.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator
from itertools import combinations, product

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pilewright.tables import checkpointed

#: Letters of other scripts that look like Latin ones (fixed values).
LOOK_ALIKE = str.maketrans("абвеёкмнорстухіјѕԁһгѵαβεικνορτυχɡıøłđ", "abbeekmhopctyxijsdhrvabeiknoptuxgiold")
#: Digits that stand for letters (fixed values); 1 is l or i.
DIGITS = str.maketrans("034567890", "oeasgtbgo")

WORD = re.compile(r"[a-z0-9']+")
#: A score from which an entry counts as meant.
SCORE = 0.7


def fold(text: str) -> str:
    """Lower case without accents, compatibility forms and look-alikes."""
    text = unicodedata.normalize("NFKC", text).casefold().translate(LOOK_ALIKE)
    text = "".join(c for c in unicodedata.normalize("NFD", text) if not unicodedata.combining(c))
    return re.sub("[’‘′`´]", "'", text.translate(LOOK_ALIKE))


def clean(text: str) -> tuple[str, bool]:
    """The folded value without remarks around it, and whether it is cut short (by a dot at its end)."""
    text = re.sub(r"\s+", " ", fold(text)).strip(" ~?!*\"")
    text = re.sub(r"^[a-z]+\s*:\s*(?=.)", "", text)
    text = re.sub(r"(?<=.)\s*(\([^()]*\)|#\s*\d+)\s*$", "", text).strip(" ~?!*\"")
    if m := re.fullmatch(r"[\[({<]\s*(.+?)\s*[\])}>]", text):
        text = m.group(1)
    short = len(text) > 4 and text.endswith((".", "…"))
    return text.rstrip(".… "), short


def squash(text: str) -> str:
    return "".join(WORD.findall(text)).replace("'", "")


def tokens_of(text: str) -> list[str]:
    return [t.strip("'") or t for t in WORD.findall(text)]


def readings(token: str) -> list[str]:
    """The token as typed and, if it mixes letters and digits, with letters for the digits."""
    if token.isdigit() or not any(c.isdigit() for c in token):
        return [token]
    lettered = token.translate(DIGITS)
    return list(dict.fromkeys([token, lettered.replace("1", "l"), lettered.replace("1", "i")]))


def allowed(length: int) -> int:
    """Edits that a token of so many characters may need."""
    return 0 if length < 3 else 1 if length < 5 else 2


def deletions(token: str, most: int) -> set[str]:
    out = {token}
    for k in range(1, min(most, len(token) - 1) + 1):
        out.update("".join(token[i] for i in range(len(token)) if i not in gone) for gone in map(set, combinations(range(len(token)), k)))
    return out


def edits(a: str, b: str, most: int) -> int:
    """Insertions, deletions, replacements and swaps of neighbours (each place once); most + 1 where it is more."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, row = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        older, before, row = before, row, [i]
        for j, y in enumerate(b, 1):
            d = min(before[j] + 1, row[j - 1] + 1, before[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, older[j - 2] + 1)
            row.append(d)
        if min(row) > most:
            return most + 1
    return row[-1]


def colour_of(text: str) -> tuple[int, int, int] | None:
    """Red, green and blue of #rgb, #rrggbb, #rrggbbaa, 0xrrggbb, rrggbb and rgb(r, g, b)."""
    text = re.sub(r"\s+", " ", unicodedata.normalize("NFKC", text)).strip().lower()
    if m := re.fullmatch(r"(?:#|0x)?([0-9a-f]{6})(?:[0-9a-f]{2})?", text):
        return tuple(int(m.group(1)[i : i + 2], 16) for i in (0, 2, 4))
    if m := re.fullmatch(r"#([0-9a-f]{3})[0-9a-f]?", text):
        return tuple(17 * int(c, 16) for c in m.group(1))
    if m := re.fullmatch(r"rgba?\s*\(?\s*(\d{1,3})[\s,;]+(\d{1,3})[\s,;]+(\d{1,3})(?:[\s,;/]+[\d.%]+)?\s*\)?", text):
        return tuple(map(int, m.groups()))
    return None


def spellings_of(entries: DataFrame) -> DataFrame:
    """``ref_id, spelling, terms``: the spellings of the entries as lists of terms, and without separators as one term."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for ref_id, name, also in zip(batch["id"], batch["name"], batch["also_called"]):
                kinds = set()
                for spelling in [name or "", *(also or "").split("|")]:
                    folded = fold(spelling)
                    if squash(folded):
                        kinds.update({tuple(tokens_of(folded)), (squash(folded),)})
                out += [(ref_id, " ".join(k), list(k)) for k in sorted(kinds)]
            yield pd.DataFrame(out, columns=["ref_id", "spelling", "terms"])

    return entries.select("id", "name", "also_called").mapInPandas(cut, "ref_id int, spelling string, terms array<string>")


def weighed_spellings(spellings: DataFrame) -> tuple[DataFrame, float, int]:
    """(``ref_id, spelling, terms, weights, heavy``; the weight of an unknown token; the length of the longest term).

    ``heavy`` are the terms, from the heaviest on, after which the others together are too light for ``SCORE``: the score
    is the root, at most, of the share of squared weight that is matched.
    """
    n, longest = spellings.agg(F.count(F.lit(1)), F.max(F.array_max(F.transform("terms", F.length)))).first()
    terms = spellings.select("ref_id", "spelling", F.explode(F.array_distinct("terms")).alias("term"))
    weights = terms.groupBy("term").agg(F.log(1 + F.lit(n) / F.count(F.lit(1))).alias("weight"))
    listed = spellings.select("ref_id", "spelling", F.posexplode("terms").alias("at", "term")).join(weights, "term")
    by_weight = F.array_sort(F.collect_list(F.struct((-F.col("weight")).alias("w"), "term")))
    whole = listed.groupBy("ref_id", "spelling").agg(F.array_sort(F.collect_list(F.struct("at", "term", "weight"))).alias("parts"), by_weight.alias("sorted"), F.sum(F.col("weight") * F.col("weight")).alias("all"))
    # A term is heavy unless it and all lighter ones fall short of what SCORE needs.
    rest = F.transform("sorted", lambda s, i: F.struct(s["term"].alias("term"), F.aggregate(F.slice("sorted", i + 1, F.size("sorted")), F.lit(0.0), lambda acc, x: acc + x["w"] * x["w"]).alias("left")))
    heavy = F.array_distinct(F.transform(F.filter(rest, lambda s: s["left"] >= (SCORE * SCORE - 1e-9) * F.col("all")), lambda s: s["term"]))
    return whole.select("ref_id", "spelling", F.transform("parts", lambda s: s["term"]).alias("terms"), F.transform("parts", lambda s: s["weight"]).alias("weights"), heavy.alias("heavy")), math.log(1 + n), longest or 0


def vocabulary_variants(spellings: DataFrame) -> DataFrame:
    """``variant, term, goal, start``: the deletion variants of all terms, and of the beginnings of compounds from half on."""

    def vary(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for term, whole in zip(batch["term"], batch["whole"]):
                out += [(v, term, term, False) for v in deletions(term, allowed(len(term)))]
                if whole:
                    starts = [term[:k] for k in range(max(4, (len(term) + 1) // 2), len(term))]
                    out += [(v, term, b, True) for b in starts for v in deletions(b, 1)]
            yield pd.DataFrame(out, columns=["variant", "term", "goal", "start"])

    terms = spellings.select(F.explode("terms").alias("term"), (F.size("terms") == 1).alias("whole")).groupBy("term").agg(F.bool_or("whole").alias("whole"))
    return terms.mapInPandas(vary, "variant string, term string, goal string, start boolean")


def repaired_tokens(tokens: DataFrame, variants: DataFrame, longest: int) -> DataFrame:
    """``typed, term, start, near`` of distinct ``typed`` and the terms that few edits lead to."""

    def vary(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            # What is longer than every term and its edits is like none of them.
            out = [(t, v) for t in batch["typed"] if len(t) <= longest + 2 for v in deletions(t, allowed(len(t)) if len(t) > 3 else 1)]
            yield pd.DataFrame(out, columns=["typed", "variant"])

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for typed, term, goal, start in zip(batch["typed"], batch["term"], batch["goal"], batch["start"]):
                most = 1 if start else min(allowed(len(goal)), max(1, allowed(len(typed))))
                d = edits(typed, goal, most)
                if d <= most:
                    out.append((typed, term, start, 1 - d / (len(goal) + 2)))
            yield pd.DataFrame(out, columns=["typed", "term", "start", "near"])

    pairs = tokens.mapInPandas(vary, "typed string, variant string").join(variants, "variant").select("typed", "term", "goal", "start").distinct()
    near = pairs.mapInPandas(measure, "typed string, term string, start boolean, near double")
    return near.groupBy("typed", "term", "start").agg(F.max("near").alias("near"))


def soft_tf_idf(places: list[int], repaired: dict[int, dict[str, tuple[float, float]]], terms: list[str], weights: list[float], unknown: float) -> float:
    """The score of a spelling for tokens; ``repaired`` has the nearness and weight of the terms of each place."""
    used: set[int] = set()
    product_, size = 0.0, sum(w * w for w in weights)
    for term, weight in zip(terms, weights):
        options = [(repaired[p][term][0], -p) for p in places if p not in used and term in repaired.get(p, {})]
        if options:
            near, p = max(options)
            used.add(-p)
            product_ += near * weight * weight
    if not used:
        return 0.0
    closest = lambda p: max((near * w, near, t, w) for t, (near, w) in repaired[p].items())[3] if repaired.get(p) else unknown
    rest = sum(closest(p) ** 2 for p in places if p not in used)
    matched = sum(max(w for t, (_, w) in repaired[p].items() if t in terms) ** 2 for p in used)
    return product_ / math.sqrt(size * (matched + rest))


def nearest_colours(values: DataFrame, entries: DataFrame, within: int) -> DataFrame:
    """``value, ref_id`` of ``value, rgb``: the entry whose colour is nearest, within ``within`` a channel, and of the least id.

    Colours are joined by cells of ``within`` + 1 a channel; each entry stands in the 27 cells around it.
    """
    cell = within + 1

    def cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for ref_id, code in zip(batch["id"], batch["code"]):
                if code and (rgb := colour_of(code)):
                    out += [(ref_id, list(rgb), ".".join(str(c // cell + s) for c, s in zip(rgb, shift))) for shift in product((-1, 0, 1), repeat=3)]
            yield pd.DataFrame(out, columns=["ref_id", "entry", "cell"])

    listed = entries.select("id", "code").mapInPandas(cells, "ref_id int, entry array<int>, cell string")
    typed = values.withColumn("cell", F.concat_ws(".", F.transform("rgb", lambda c: F.floor(c / cell).cast("string"))))
    away = F.array_max(F.zip_with("rgb", "entry", lambda x, y: F.abs(x - y)))
    near = typed.join(listed, "cell").withColumn("away", away).filter(F.col("away") <= within)
    return near.groupBy("value").agg(F.min(F.struct("away", "ref_id")).alias("best")).select("value", F.col("best.ref_id").alias("ref_id"))


VALUE = "value string, rgb array<int>, short boolean, places array<struct<place: int, token: string, typed: array<string>>>"


def map_values(values: DataFrame, entries: DataFrame, within: int = 8) -> DataFrame:
    """``value, ref_id`` of the distinct ``value`` that are not null, blank or exactly a name; 0: without entry."""
    entries = entries.select(F.col("id").cast("int").alias("id"), "name", "also_called", "code")
    names = entries.select(F.col("name").alias("value")).distinct()
    distinct = values.filter(F.col("value").isNotNull()).distinct().join(names, "value", "left_anti")

    def prepare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for value in batch["value"]:
                if not value.strip():
                    continue
                text, short = clean(value)
                whole, words = squash(text), tokens_of(text)
                # Token 0 is the whole without separators, the others are the words.
                parts = [(0, whole), *((i, w) for i, w in enumerate(words, 1) if len(words) > 1 or w != whole)] if whole else []
                rgb = colour_of(value)
                out.append((value, None if rgb is None else list(rgb), short, [(i, t, readings(t)) for i, t in parts]))
            yield pd.DataFrame(out, columns=["value", "rgb", "short", "places"])

    prepared = checkpointed(distinct.mapInPandas(prepare, VALUE))
    coloured = entries.filter(F.col("code").isNotNull()).select(F.lit(True).alias("any")).limit(1)
    by_colour = nearest_colours(prepared.filter(F.col("rgb").isNotNull()).select("value", "rgb"), entries, within)
    # Codes are colours only if the list has colours.
    worded = prepared.join(coloured, F.col("rgb").isNotNull(), "left").filter(F.col("any").isNull()).select("value", "short", F.explode("places").alias("p")).select("value", "short", "p.*")
    spellings = checkpointed(spellings_of(entries))
    weighed, unknown, longest = weighed_spellings(spellings)
    weighed = checkpointed(weighed)
    tokens = worded.select("value", "short", "place", "token", F.explode("typed").alias("typed"))
    near = checkpointed(repaired_tokens(tokens.select("typed").distinct(), vocabulary_variants(spellings), longest))
    weights = weighed.select(F.explode(F.arrays_zip("terms", "weights")).alias("t")).select(F.col("t.terms").alias("term"), F.col("t.weights").alias("weight")).distinct()
    # A letter for a digit, and the missing end of a cut word, are little against an edit.
    slight = F.when(F.col("typed") != F.col("token"), 0.02).otherwise(0.0) + F.when(F.col("start"), 0.05).otherwise(0.0)
    found = tokens.join(near, "typed").filter(~F.col("start") | (F.col("short") & (F.col("place") == 0)))
    found = found.groupBy("value", "place", "term").agg(F.max(F.col("near") - slight).alias("near")).join(weights, "term")
    found = checkpointed(found.select("value", "place", "term", "near", "weight"))
    heavy = weighed.select("ref_id", "spelling", F.explode("heavy").alias("term"))
    candidates = found.join(heavy, "term").select("value", (F.col("place") == 0).alias("whole"), "ref_id", "spelling").distinct()
    repairs = found.groupBy("value").agg(F.collect_list(F.struct("place", "term", "near", "weight")).alias("repairs"))
    places = worded.groupBy("value").agg(F.array_sort(F.collect_list("place")).alias("places"))
    scored = candidates.join(repairs.join(places, "value"), "value").join(weighed.drop("heavy"), ["ref_id", "spelling"])

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            scores = []
            for whole, repairs, places, terms, weights in zip(batch["whole"], batch["repairs"], batch["places"], batch["terms"], batch["weights"]):
                repaired: dict[int, dict[str, tuple[float, float]]] = {}
                for r in repairs:
                    repaired.setdefault(r["place"], {})[r["term"]] = (r["near"], r["weight"])
                scores.append(soft_tf_idf([0] if whole else [p for p in places if p > 0], repaired, list(terms), list(weights), unknown))
            yield pd.DataFrame({"value": batch["value"], "ref_id": batch["ref_id"], "score": scores})

    best = scored.select("value", "whole", "ref_id", "repairs", "places", "terms", "weights").mapInPandas(score, "value string, ref_id int, score double")
    best = best.filter(F.col("score") >= SCORE).groupBy("value").agg(F.max_by("ref_id", F.struct("score", -F.col("ref_id"))).alias("ref_id"))
    meant = best.unionByName(by_colour)
    return prepared.select("value").join(meant, "value", "left").select("value", F.coalesce("ref_id", F.lit(0)).cast("int").alias("ref_id"))


def map_to_list(rows: DataFrame, key: str, column: str, entries: DataFrame, within: int = 8) -> DataFrame:
    """``key, value, ref_id`` of every row whose ``column`` is neither null nor blank nor exactly a listed name.

    ``entries`` are ``id, name, also_called`` (spellings parted by a bar, or null), ``code`` (a colour code, or null), of any
    number. ``ref_id`` is the entry that the value is a form of, or whose colour it gives within ``within`` a channel; 0 where
    there is none. Of equally good entries the one with the least id is taken. Repeated rows come out once for each distinct
    key and value; an empty table or an empty list gives no rows or zeros. Only ``key`` and ``column`` are read.
    """
    typed = rows.select(F.col(key).alias("key"), F.col(column).cast("string").alias("value")).distinct()
    mapped = map_values(typed.select("value"), entries, within)
    return typed.join(mapped, "value").select("key", "value", "ref_id")
