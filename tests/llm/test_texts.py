import random

import pytest
from pyspark.sql import functions as F

from pilewright.llm.canonical import map_to_list
from pilewright.llm.garbled import find_garbled, restore
from pilewright.llm.packing import best_fit_decreasing, pack, pack_documents
from pilewright.llm.tokenizer import BatchEncoder, PrefixTable, count_tokens, encode_corpus, vocabulary, vocabulary_path

tokenizers = pytest.importorskip("tokenizers")
pytest.importorskip("public_tokenizers")

DOCS = "doc_id bigint, text string, ids string, n_tokens string"


@pytest.fixture(scope="module")
def public():
    t = tokenizers.Tokenizer.from_file(vocabulary_path())
    t.encode_special_tokens = True
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def test_corpus_equals_the_public_tokenizer(spark, public):
    rng = random.Random(2)
    letters = "'stmdrevl LN19 \n\t\r  é日本-_.’٣👩‍🔬aaab<|endoftext|>"
    texts = [None, "", " ", "\n", "<|endoftext|>", "it's we'll they're 'S I'd've", "x" * 50_000, "  \n\n  a  "] + ["".join(rng.choice(letters) for _ in range(rng.randrange(60))) for _ in range(400)]
    df = spark.createDataFrame([(i, t, "clash", "clash") for i, t in enumerate(texts)], DOCS)
    got = {r["doc_id"]: r["ids"] for r in encode_corpus(df).collect()}
    assert got == {i: public(t) for i, t in enumerate(texts)}
    counts = {r["doc_id"]: r["n_tokens"] for r in count_tokens(df).collect()}
    assert counts == {i: len(x) for i, x in got.items()}
    assert encode_corpus(df.limit(0)).count() == 0


def test_appends_and_edits_are_exact(public):
    v = vocabulary(vocabulary_path())
    rng = random.Random(7)
    whole = PrefixTable(v)
    text = b""
    for _ in range(30):
        more = bytes(rng.choice(b"etaoinsh") for _ in range(rng.randrange(1, 6)))
        text += more
        whole.append(more)
        fresh = PrefixTable(v)
        fresh.append(text)
        assert whole.tokens() == fresh.tokens() == public(text.decode())
    at = len(text) // 2
    whole.edit(at, at + 3, b"ing")
    assert whole.tokens() == public((text[:at] + b"ing" + text[at + 3 :]).decode())
    encoder = BatchEncoder(vocabulary_path())
    line = "def  pack(items):\n    return items  # don't  "
    for _ in range(60):
        a = rng.randrange(len(line) + 1)
        z = rng.randrange(a, len(line) + 1)
        edited, ids = encoder.reencode(line, encoder.encode_text(line), a, z, rng.choice(["", " ", "x'll ", "\n\n", "é"]))
        assert ids == public(edited)


def test_best_fit_equals_a_search():
    import numpy as np

    rng = np.random.default_rng(0)
    for _ in range(40):
        sizes = rng.integers(1, 65, 80)
        left, place = [], {}
        for i in np.argsort(-sizes, kind="stable"):
            fits = [(l, -k) for k, l in enumerate(left) if l >= sizes[i]]
            k = -min(fits)[1] if fits else len(left)
            if not fits:
                left.append(64)
            left[k] -= sizes[i]
            place[i] = k
        got = best_fit_decreasing(sizes, 64)
        fill = lambda p: sorted(np.bincount(p, sizes))
        assert fill(got) == fill(np.array([place[i] for i in range(len(sizes))]))


def test_packing(spark):
    items = spark.createDataFrame([(1, 5000), (2, 0), (3, None), (4, 2048), (5, 1000), (6, 48)], "doc_id bigint, n_tokens bigint")
    got = pack(items, 6).collect()
    by = {}
    for r in got:
        by.setdefault(r["container_id"], []).append(r["n_tokens"])
    assert max(map(sum, by.values())) <= 2048 and sorted(map(sum, by.values())) == [1000 + 904 + 48, 2048, 2048, 2048]
    assert {r["doc_id"] for r in got} == {1, 4, 5, 6}
    assert sorted((r["piece_no"], r["first_token"], r["n_tokens"]) for r in got if r["doc_id"] == 1) == [(0, 0, 2048), (1, 2048, 2048), (2, 4096, 904)]
    assert pack(items.limit(0), 0).count() == 0
    docs = spark.createDataFrame([(1, None, "", ""), (2, "", "", ""), (3, "word " * 3000, "", "")], DOCS)
    assert {r["doc_id"] for r in pack_documents(docs).collect()} == {3}


CLEAN = {
    "fr": "corrige périmée fenêtre après réglage déplace répétée requête",
    "ru": "исправить пустую сборку через окно проверить",
    "pl": "wyłącz pustą próbkę według pamięć źródło",
    "zh": "修复空的读取模块",
    "en": "it’s Zoë’s “quick” naïve pass",
}


def test_garbled_text_is_found_and_restored(spark):
    texts = [t for t in CLEAN.values() for _ in range(30)]
    texts += ["// Ðóra ÞÓR", "Author: Pelщав Jor", "café – ½ of 37 °C", "ascii only", "", None] * 5
    n = len(texts)
    broken = {
        "utf8 as cp1252": (CLEAN["fr"].encode().decode("latin-1"), CLEAN["fr"]),
        "utf8 as cp437": (CLEAN["ru"].encode().decode("cp437"), CLEAN["ru"]),
        "twice": (CLEAN["fr"].encode().decode("latin-1").encode().decode("latin-1"), CLEAN["fr"]),
        "mac": (CLEAN["fr"].encode("latin-1").decode("mac_roman"), CLEAN["fr"]),
        "koi8": (CLEAN["ru"].encode("cp1251").decode("koi8-r"), CLEAN["ru"]),
        "latin2": (CLEAN["pl"].encode("iso8859-2").decode("latin-1"), CLEAN["pl"]),
        "gbk": (CLEAN["zh"].encode("gbk").decode("latin-1"), CLEAN["zh"]),
        "lost": (CLEAN["fr"].encode("latin-1").decode("utf-8", "replace"), None),
    }
    rows = [(i, t, "x", "x") for i, t in enumerate(texts)] + [(n + k, "head\n" + bad + "\r\ntail " * 2000, "x", "x") for k, (bad, _) in enumerate(broken.values())]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, word string, restored string")
    found = {r["doc_id"] for r in find_garbled(df.unionByName(df))[0].select("doc_id").collect()}
    assert found == {n + k for k in range(len(broken))}
    told = {r["doc_id"]: r for r in restore(df).collect()}
    for k, (_, good) in enumerate(broken.values()):
        r = told[n + k]
        assert r["complete"] == (good is not None)
        if good is not None:
            assert r["restored_text"].split("\n")[1] == good + "\r"
    assert find_garbled(df.limit(0))[0].count() == 0


def documents(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")


def test_encodings_on_no_list_are_learned(spark):
    line = CLEAN["ru"]
    rare = [line.encode("iso8859_5").decode("cp1252"), line.encode("iso8859_5").decode("cp1251"), line.upper().encode("cp1251").decode("mac_cyrillic")]
    got = {r["doc_id"]: r for r in restore(documents(spark, [line] * 200 + rare + [line.upper()] * 200)).collect()}
    assert set(got) == {200, 201, 202} and all(r["restored_text"].lower() == line and r["complete"] for r in got.values())


def test_a_mapping_that_no_encoding_has_is_learned_by_characters(spark):
    rng = random.Random(5)
    letters = "áéíóúàèìòùâêîôûäëïöü"
    other = dict(zip(letters, rng.sample("╔╗╝╚═║╠╣╦╩╬░▒▓█▄▌▐▀■", len(letters))))
    words = ["".join(rng.choice("bcdfglmnprst") + rng.choice(letters) for _ in range(3)) for _ in range(60)]
    texts = [" ".join(words)] * 40 + [" ".join(rng.sample(words, 30)).translate(str.maketrans(other)) for _ in range(3)]
    got = {r["doc_id"]: r for r in restore(documents(spark, texts)).collect()}
    back = str.maketrans({v: k for k, v in other.items()})
    assert set(got) == {40, 41, 42}
    # A letter that too few words show stays as it was found.
    right = [x == y for i, r in got.items() for x, y in zip(r["restored_text"].split(), texts[i].translate(back).split())]
    assert sum(right) >= 0.9 * len(right)


def test_words_of_any_length(spark):
    texts = ["éa" * 200_000, "中" * 100_000, "a" * 300_000 + " é", "x" * 100_000 + "é"]
    assert find_garbled(documents(spark, texts * 2))[0].count() == 0


TYPES = [(1, "CDS", "coding sequence|coding region", None), (2, "promoter", "promoter region", None), (3, "5'UTR", "five prime utr", None), (4, "3'UTR", None, None), (5, "repeat_region", None, None), (6, "stem_loop", "hairpin", None)]
COLORS = [(1, "black", "ink", "#181818"), (2, "sky blue", "azure", "#60a8ec"), (3, "crimson", "deep red", "#a81818")]


def listed(spark, entries):
    return spark.createDataFrame(entries, "id int, name string, also_called string, code string")


def test_a_list_of_any_length(spark):
    """3,000 entries and values; a term that all entries share leads to none of them by itself."""
    rng = random.Random(9)
    names = list({"".join(rng.choice("bcdfghklmnprstvz") + rng.choice("aeiou") for _ in range(4)) for _ in range(3_000)})
    entries = [(i + 1, f"{n} region", None, None) for i, n in enumerate(names)]
    typed = [(i + 1, f"{n[:3]}{n[4:]} Region" if i % 2 else f"{n}-region") for i, n in enumerate(names)]
    df = spark.createDataFrame(typed, "feature_id bigint, type string")
    got = map_to_list(df, "feature_id", "type", listed(spark, entries))
    right, rows = got.agg(F.count_if(F.col("key") == F.col("ref_id")), F.count(F.lit(1))).first()
    assert rows == len(names) and right > 0.75 * rows
    assert got.filter(F.col("key") % 2 == 1).filter(F.col("key") != F.col("ref_id")).count() == 0


def test_values_to_lists(spark):
    cases = {
        "CDS": None, None: None, " ": None, "\t\xa0": None,
        "cds": 1, " CDS ": 1, "Cdds": 1, "coding-region": 1, "~Codig Rgion": 1, "type: Coding Sequence": 1, "coding_regions #2": 1,
        "prom0ter": 2, "pomоter": 2, "promote.": 2, "[PROMOTER]": 2, "promoter (putative)": 2, "promotér región": 2,
        "5'utr": 3, "3'Utr": 4, "fibe prim3 utr": 3, "repeatregion": 5, "HAIRPIN": 6, "srem_looip": 6,
        "western blot": 0, "42": 0, "???": 0, "xx": 0, "y" * 20_000: 0,
    }
    rows = [(i, v, "clash") for i, v in enumerate(cases)]
    df = spark.createDataFrame(rows, "feature_id bigint, type string, value string")
    got = {r["value"]: r["ref_id"] for r in map_to_list(df.unionByName(df), "feature_id", "type", listed(spark, TYPES)).collect()}
    assert got == {k: v for k, v in cases.items() if v is not None}
    assert map_to_list(df.limit(0), "feature_id", "type", listed(spark, TYPES)).count() == 0
    assert {r["ref_id"] for r in map_to_list(df.limit(6), "feature_id", "type", listed(spark, [])).collect()} == {0}


def test_colours(spark):
    cases = {"#181818": 1, "#111": 1, "0x1f1110": 1, "#202020": 1, "#212121": 0, "RGB(96, 168,236)": 2, "60a8ecff": 2, " Azure ": 2, "dep red": 3, "skyblue": 2, "none": 0, "rgb(1 2 3)": 0, "black": None}
    df = spark.createDataFrame(list(enumerate(cases)), "feature_id bigint, color string")
    got = {r["value"]: r["ref_id"] for r in map_to_list(df, "feature_id", "color", listed(spark, COLORS)).collect()}
    assert got == {k: v for k, v in cases.items() if v is not None}


def test_nothing_else_imports_the_subpackage():
    import pathlib
    import re

    root = pathlib.Path(__file__).resolve().parents[2] / "pilewright"
    for p in root.rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert not re.search(r"pilewright\.llm|from \.+llm", p.read_text()), p


def test_every_key_has_a_query():
    from pilewright.llm.oracles import ORACLES
    from pilewright.llm.queries import QUERIES

    assert set(ORACLES) <= set(QUERIES)
    assert F is not None
