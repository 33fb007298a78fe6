"""The phrase index against substring search, on small and on large catalogs."""

import random
import re

import pytest
from pyspark.sql import functions as F

from rulespan.operators import phrase_index as P


def by_hand(text, phrases, alone):
    out = set()
    for p in phrases:
        if text and p and (re.search(rf"(?<![a-z0-9_]){p}(?![a-z0-9_])", text) if alone and re.fullmatch("[a-z]", p) else p in text):
            out.add(p)
    return out


def texts_of(rng, n):
    letters = "abcde ß🙂\n_1"
    return ["".join(rng.choice(letters) for _ in range(rng.choice([0, 1, 3, 40, 300]))) for _ in range(n)]


@pytest.mark.parametrize(("most", "direct"), [(10**6, 10**6), (10**6, 0), (0, 0)])
@pytest.mark.parametrize("alone", [True, False])
def test_found_as_substrings(spark, most, direct, alone):
    rng = random.Random(3)
    texts = [*texts_of(rng, 60), None, "", "a", "xa a_ ab", "the same", "the same"]
    phrases = [t[i : i + rng.choice([1, 2, 3, 4, 5, 9])] for t in texts[:60] for i in range(0, len(t), 17)] + ["a", "b", "z", "zzzz", "", None, "the ", "same", "a.b", "🙂"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, hay string")
    catalog = spark.createDataFrame([(p,) for p in phrases + phrases[:9]], "phrase string")
    got = {r["id"]: r["found"] for r in P.found_sets(df, catalog, alone, most, direct).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        assert sorted(got[i]) == sorted(by_hand(t, phrases, alone))


@pytest.mark.parametrize(("most", "direct"), [(10**6, 10**6), (10**6, -1), (0, -1)])
def test_nothing_to_find(spark, most, direct):
    df = spark.createDataFrame([(1, "abc"), (2, None)], "id int, hay string")
    for catalog in ([], [("",), (None,)]):
        found = P.found_sets(df, spark.createDataFrame(catalog, "phrase string"), most=most, direct=direct)
        assert {r["id"]: r["found"] for r in found.collect()} == {1: [], 2: []}
    assert P.found_sets(df.limit(0), spark.createDataFrame([("abc",)], "phrase string"), most=most, direct=direct).isEmpty()


def test_catalog_of_200_000_phrases(spark):
    """Beyond what is broadcast: the bitmap lets few grams through, and every phrase is found where it stands."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.choice([4, 6, 9])))
    phrases = list({f"{word()} {word()}" for _ in range(205_000)})[:200_000]
    texts = [" ".join(rng.choice(phrases) for _ in range(6)) + " of the the of" for _ in range(80)]
    catalog = spark.createDataFrame([(p,) for p in phrases], "phrase string")
    df = spark.createDataFrame(list(enumerate(texts)), "id int, hay string")
    got = {r["id"]: set(r["found"]) for r in P.found_sets(df, catalog).collect()}
    assert got == {i: {p for p in phrases if p in t} for i, t in enumerate(texts)}
    filed = P.index(catalog)
    assert filed.count() == len(phrases) and P.bitmap(filed, F.col("gram")).selectExpr("size(bits)").first()[0] == P.BITS // 64


def test_rarest_gram(spark):
    catalog = spark.createDataFrame([("the cat",), ("the dog",), ("the",), ("the cats",)], "phrase string")
    filed = {r["phrase"]: r["gram"] for r in P.index(catalog).collect()}
    assert filed == {"the cat": " cat", "the dog": " dog", "the": "the", "the cats": "cats"}


@pytest.mark.parametrize("alone", [True, False])
def test_bits_are_places(spark, alone):
    rng = random.Random(8)
    texts = [*texts_of(rng, 30), None, "", "the same-old day", "thesame-old", "a-b " + "z" * 300]
    phrases = {t[i : i + 5] for t in texts[:30] for i in range(0, len(t), 17)} | {"a", "b", "same-old", "-", "z" * 200, "z" * 301, "day"}
    own = P.listed(spark.createDataFrame([(p,) for p in phrases], "phrase string"))
    assert own == sorted(p.encode() for p in phrases if p)
    bits = P.found_bits(spark.createDataFrame(list(enumerate(texts)), "id int, hay string"), own, alone)
    numbers = F.filter(F.sequence(F.lit(0), F.lit(len(own) - 1)), lambda n: P.has_bit(F.col("found"), n))
    got = {r["id"]: {own[n].decode() for n in r["n"]} for r in bits.select("id", numbers.alias("n")).collect()}
    assert got == {i: by_hand(t, phrases, alone) for i, t in enumerate(texts)}


def test_words_are_looked_up_once(monkeypatch):
    """A text costs its new words and not the catalog: none of 20,000 phrases is compared with the text."""

    class Text(bytes):
        def __contains__(self, other):
            raise AssertionError("looked for one by one")

    find = P._finder([b"word%d" % i for i in range(20_000)], True)
    assert find(Text(b"xword77x word5, none")) == {5, 7, 77}
    monkeypatch.setattr(P, "REMEMBERED", 2)
    assert [find(t) for t in (b"word1 word2 word3", b"word1", b"word4 word1")] == [{1, 2, 3}, {1}, {1, 4}]


def test_words_of_a_run_are_looked_up_at_once(monkeypatch):
    calls, found = [], P._Keys.found
    monkeypatch.setattr(P._Keys, "found", lambda self, text: calls.append(len(text)) or found(self, text))
    (got,) = P._finders([b"word%d" % i for i in range(200)], True)([b"word%d xword%dx" % (i, i + 1) for i in range(100)])
    assert len(calls) == 1
    assert all({i, i + 1} <= set(got[i].nonzero()[0].tolist()) for i in range(100))


@pytest.mark.parametrize("chunk", [16, 64, 1 << 20])
def test_long_words_are_searched_in_pieces(monkeypatch, chunk):
    rng = random.Random(9)
    monkeypatch.setattr(P, "CHUNK", chunk)
    texts = ["".join(rng.choice("abc é") if rng.random() < 0.02 else rng.choice("ab") for _ in range(rng.choice([1, 15, 16, 17, 33, 400]))) for _ in range(80)]
    phrases = sorted({t[i : i + rng.choice([1, 2, 7, 8, 9, 15, 16, 17, 40])].encode() for t in texts for i in range(0, len(t), 9)} - {b""})
    find = P._finder(phrases, True)
    for t in texts:
        assert {phrases[n].decode() for n in find(t.encode())} == by_hand(t, [p.decode() for p in phrases], True)


def test_words_of_a_run_are_told_apart():
    inner = bytes(chr(c).isalnum() and c < 128 for c in range(256))
    text_of, words, code = P._words([b"", b"ab, ab-c", b"-", b"c", b"ab"], inner)
    assert [(t, words[c]) for t, c in zip(text_of.tolist(), code.tolist())] == [(1, b"ab"), (1, b"ab"), (1, b"c"), (3, b"c"), (4, b"ab")]
    assert len(words) == 2 and P._words([b"", b"-"], inner)[1] == []


@pytest.mark.parametrize("cells", [1 << 22, 1])
def test_letters_are_found_in_words(monkeypatch, cells):
    monkeypatch.setattr(P, "MOST_CELLS", cells)
    phrases, texts = [b"a", b"ab", b"b", b"b,", b"x"], ["a b, ab ab éa", "ab aB", "xaé b", "", "ß"]
    got = [{phrases[n].decode() for n in P._finder(phrases, True)(t.encode())} for t in texts]
    assert got == [by_hand(t, [p.decode() for p in phrases], True) for t in texts]
