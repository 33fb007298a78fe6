"""Which phrases of a catalog stand in a text, for catalogs and tables of any size.

Catalogs that may be broadcast are looked for by words: every phrase is filed under a stretch of its longest word, and in
each word of a text the stretches that begin as one of these do are looked up, so that the work grows with the text and
with what it meets. Words that come again in a task are looked up once.

In larger catalogs every phrase is filed under one of its own stretches of ``GRAM`` characters, the one that the fewest phrases share; a shorter
phrase is filed under itself. A text is probed with its distinct stretches, so that it meets a phrase only if it
holds the phrase's rarest one, and what it meets is then looked for in full. The work grows with the text and with what
it meets, and not with the catalog.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

GRAM = 4
#: So few phrases are looked for by the words of a text.
MOST_DIRECT = 50_000
#: Phrases whose index by grams may be broadcast; a larger one is joined with a shuffle, behind a bitmap of fixed size.
MOST_BROADCAST = 50_000
#: Bytes of the stretch of a word under which a phrase is filed.
STRETCH = 16
#: Words that a task remembers, none longer than the second number in bytes.
REMEMBERED, MOST_REMEMBERED = 200_000, 40
#: Bytes of texts and of words that are searched at once, and cells of the matrix of what is found in them.
CHUNK, MOST_CELLS = 1 << 20, 1 << 22
#: Bits of that bitmap: half a megabyte, whatever the catalog.
BITS = 1 << 22
_WORD = 64


def grams(text: Column, n: int = GRAM) -> Column:
    """The distinct stretches of ``n`` characters of a text."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1)))


def index(phrases: DataFrame) -> DataFrame:
    """(gram, phrase): each distinct ``phrase`` under the rarest of its grams, ties by the gram."""
    p = phrases.select("phrase").where("phrase <> ''").distinct()
    own = p.select("phrase", F.explode(F.when(F.length("phrase") <= GRAM, F.array("phrase")).otherwise(grams(F.col("phrase")))).alias("gram"))
    counted = own.join(own.groupBy("gram").agg(F.count("*").alias("n")), "gram")
    return counted.groupBy("phrase").agg(F.min_by("gram", F.struct("n", "gram")).alias("gram")).select("gram", "phrase")


def _bit(key: Column, size: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(size))


def bitmap(rows: DataFrame, key: Column, size: int = BITS) -> DataFrame:
    """One row with ``bits``: an array of ``size`` / 64 longs in which the bits of all keys are set. Its size does not depend
    on the rows, so that it may be broadcast; where there are too many keys it only lets more pass."""
    one = F.lit(1).cast("long")
    own = rows.select(_bit(key, size).alias("b")).groupBy(F.floor(F.col("b") / _WORD).alias("w")).agg(F.bit_or(F.call_function("shiftleft", one, (F.col("b") % _WORD).cast("int"))).alias("v"))
    every = rows.sparkSession.range(size // _WORD).select(F.col("id").alias("w")).join(own, "w", "left")
    return every.agg(F.transform(F.sort_array(F.collect_list(F.struct("w", F.coalesce("v", F.lit(0).cast("long")).alias("v")))), lambda x: x["v"]).alias("bits"))


def may_hold(bits: Column, key: Column, size: int = BITS) -> Column:
    """Whether a key's bit is set: true for every key of the bitmap, and for few others."""
    b = _bit(key, size)
    return F.getbit(F.get(bits, F.floor(b / _WORD).cast("int")), (b % _WORD).cast("int")) == 1


def _lengths(phrases: DataFrame) -> dict[int, int]:
    """How many distinct phrases there are of each length up to ``GRAM``, longer ones counted with these."""
    n = F.least(F.length("phrase"), F.lit(GRAM))
    return {r["n"]: r["k"] for r in phrases.where("phrase <> ''").select(n.alias("n"), "phrase").groupBy("n").agg(F.count_distinct("phrase").alias("k")).collect()}


def candidates(texts: DataFrame, phrases: DataFrame, lengths: dict[int, int], most: int = MOST_BROADCAST) -> DataFrame:
    """(id, met): for each text (id, hay) the phrases filed under one of its grams; texts that meet none have no row.

    Where ``texts`` are dealt by id and the index is broadcast, nothing of them is shuffled again. A larger index is
    joined by gram: only the grams whose bit is set go there, and AQE splits the partition of a gram that many texts hold.
    """
    filed = index(phrases)
    if not lengths:
        return texts.select("id", F.array().cast("array<string>").alias("met")).limit(0)
    own = F.concat(*(grams(F.col("hay"), n) for n in sorted(lengths)))
    if sum(lengths.values()) <= most:
        met = texts.select("id", F.explode(own).alias("gram")).join(F.broadcast(filed), "gram")
    else:
        held = texts.join(F.broadcast(bitmap(filed, F.col("gram")))).select("id", F.explode(F.filter(own, lambda g: may_hold(F.col("bits"), g))).alias("gram"))
        met = held.join(filed, "gram")
    return met.groupBy("id").agg(F.collect_set("phrase").alias("met"))


class _Keys:
    """The keys of phrases by which words are looked up, as numbers: a key is told by its first and last eight bytes, so that
    all places of many words are compared at once and exactly. ``held``: key, at most ``STRETCH`` bytes, to its numbers."""

    def __init__(self, held: dict[bytes, list[int]]):
        by: dict[int, list[bytes]] = {}
        for key in held:
            by.setdefault(len(key), []).append(key)
        self.sizes = [(k, *self._size(k, by[k], held)) for k in sorted(by)]

    @staticmethod
    def _ends(buffer: np.ndarray, n: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The first and last eight bytes (all, if they are fewer) of the ``k`` bytes at each of ``n`` places of 8-byte windows."""
        if k >= 8:
            return buffer[:n], buffer[k - 8 : k - 8 + n]
        first = buffer[:n] & np.uint64((1 << 8 * k) - 1)
        return first, first

    @staticmethod
    def _mixed(first: np.ndarray, last: np.ndarray, odd: int) -> np.ndarray:
        return (first ^ (last * np.uint64(odd))) * np.uint64(0x9E3779B97F4A7C15)

    def _size(self, k: int, keys: list[bytes], held: dict[bytes, list[int]]) -> tuple:
        rows = [_windows(x + b" " * STRETCH) for x in keys]
        first, last = (np.array([self._ends(r, 1, k)[i][0] for r in rows], np.uint64) for i in (0, 1))
        odd = 0xD6E8FEB86659FD93
        while len(set((mixed := self._mixed(first, last, odd)).tolist())) < len(keys):  # no two keys may look alike
            odd = (odd * 5 + 2) % (1 << 64) | 1
        order = np.argsort(mixed)
        numbers = [held[keys[i]] for i in order]
        table = np.zeros(1 << 16, bool)
        table[(mixed >> np.uint64(48)).astype(np.int64)] = True
        counts = np.array([len(x) for x in numbers])
        return odd, table, mixed[order], first[order], last[order], np.cumsum(counts) - counts, counts, np.array([n for x in numbers for n in x], np.int64)

    def found(self, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        """(place, number) wherever a key stands in ``text``."""
        n, windows = len(text), _windows(text + b" " * STRETCH)
        places, numbers = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for k, odd, table, keys, firsts, lasts, starts, counts, values in self.sizes:
            first, last = self._ends(windows, n, k)
            mixed = self._mixed(first, last, odd)
            at = np.flatnonzero(table[(mixed >> np.uint64(48)).astype(np.int64)])
            key = np.minimum(np.searchsorted(keys, mixed[at]), len(keys) - 1)
            same = (firsts[key] == first[at]) & (lasts[key] == last[at])
            at, key = at[same], key[same]
            places.append(np.repeat(at, counts[key]))
            numbers.append(values[_ranges(starts[key], counts[key])])
        return np.concatenate(places), np.concatenate(numbers)


def _windows(text: bytes) -> np.ndarray:
    """The eight bytes at each place of ``text`` as a number."""
    return np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(np.frombuffer(text, np.uint8), 8)).view("<u8").reshape(-1)


def _ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The numbers of all ranges of ``counts`` numbers from ``starts``, one after another."""
    return np.repeat(starts - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())


def _words(texts: list[bytes], inner: bytes) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """(text, words, code): of each word in ``texts``, one after another, the number of its text and its place among the distinct
    ``words``; ``inner`` has 1 for the bytes that belong to words, 0 for others."""
    joined = b" ".join(texts) + b" "
    inside = np.frombuffer(joined.translate(inner), bool)
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    own, ends = np.frombuffer(joined, np.uint8)[inside], np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
    offsets = np.append(np.flatnonzero(first[inside]), len(own))
    coded = pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(own)]).dictionary_encode()
    _, at, held = coded.dictionary.buffers()
    at, held = np.frombuffer(at, np.int64)[: len(coded.dictionary) + 1].tolist(), held.to_pybytes() if held else b""
    per = np.diff(np.searchsorted(np.flatnonzero(first), ends), prepend=0)
    code = np.frombuffer(coded.indices.buffers()[1], np.int32)[: len(coded)]
    return np.repeat(np.arange(len(texts)), per), [held[i:j] for i, j in itertools.pairwise(at)], code


def _pieces(words: list[bytes]) -> Iterator[tuple[list[bytes], Sequence[int]]]:
    """Words and their numbers in blocks of about ``CHUNK`` bytes; a longer word in pieces that overlap by less than a key."""
    block, owner, held = [], [], 0
    if sum(map(len, words)) <= CHUNK:
        yield words, range(len(words))
        return
    for j, w in enumerate(words):
        for i in range(0, max(1, len(w) - STRETCH + 1), CHUNK):
            piece = w[i : i + CHUNK + STRETCH - 1] if len(w) > CHUNK else w
            block.append(piece)
            owner.append(j)
            held += len(piece) + 1
            if held >= CHUNK:
                yield block, owner
                block, owner, held = [], [], 0
    if block:
        yield block, owner


def _finders(phrases: list[bytes], alone: bool) -> Callable[[list[bytes | None]], Iterator[np.ndarray]]:
    """A function that gives, for texts in runs, a matrix of which ``phrases`` stand in which text; its rows are whole longs of bits.
    All bytes beyond ASCII belong to words."""
    word, letter = re.compile(rb"[0-9A-Za-z_\x80-\xff]+"), re.compile(rb"(?<![a-z0-9_])[a-z](?![a-z0-9_])")
    inner = bytes(bool(word.match(bytes([c]))) for c in range(256))
    held, rest, letters, around = {}, [], {}, False
    for n, p in enumerate(phrases):
        key = max(word.findall(p), key=len, default=b"")[:STRETCH]
        if alone and re.fullmatch(rb"[a-z]", p):
            letters[p] = n
        elif key:  # ~n: what stands around the key is looked at in the text
            held.setdefault(key, []).append(n if key == p else ~n)
            around |= key != p
        else:
            rest.append(n)
    keys, width = _Keys(held), (len(phrases) // _WORD + 1) * _WORD
    known: dict[bytes, int] = {}
    starts, counts, values = [np.empty(0, np.int64)] * 3

    def learn(new: list[bytes]) -> None:
        """The numbers of the phrases that each of ``new`` words holds, behind those of the words before."""
        nonlocal starts, counts, values
        word_of, numbers = [], []
        for block, owner in _pieces(new):
            at, n = keys.found(b" ".join(block))
            ends = np.cumsum(np.fromiter(map(len, block), np.int64, len(block)) + 1)
            word_of.append(np.asarray(owner)[np.searchsorted(ends, at, "right")])
            numbers.append(n)
        if letters:  # what stands next to a letter and is no blank belongs to its word
            single = [(m.start(), letters[m[0]]) for m in letter.finditer(b" ".join(new)) if m[0] in letters]
            ends = np.cumsum(np.fromiter(map(len, new), np.int64, len(new)) + 1)
            word_of.append(np.searchsorted(ends, [at for at, _ in single], "right"))
            numbers.append(np.array([n for _, n in single], np.int64))
        word_of, numbers = np.concatenate(word_of), np.concatenate(numbers)
        own = np.bincount(word_of, minlength=len(new))
        known.update(zip(new, range(len(starts), len(starts) + len(new))))
        starts = np.concatenate([starts, len(values) + np.cumsum(own) - own])
        counts, values = np.concatenate([counts, own]), np.concatenate([values, numbers[np.argsort(word_of, kind="stable")]])

    def run(texts: list[bytes]) -> np.ndarray:
        nonlocal starts, counts, values
        if len(starts) >= REMEMBERED or len(values) >= 20 * REMEMBERED:
            known.clear()
            starts, counts, values = [np.empty(0, np.int64)] * 3
        text_of, words, code = _words(texts, inner)
        if new := [w for w in words if w not in known]:
            learn(new)
        slots = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
        for w in new:
            if len(w) > MOST_REMEMBERED:
                del known[w]
        some = counts[slots][code] > 0
        text_of, code = text_of[some], code[some]
        if counts[slots[code]].sum() > MOST_CELLS:  # words that hold much and come again in a text: once is enough
            text_of, code = np.divmod(np.unique(text_of * len(words) + code), len(words))
        own = counts[slots[code]]
        n, first = values[_ranges(starts[slots[code]], own)], np.repeat(text_of * width, own)
        out = np.zeros((len(texts), width), np.uint8)
        if around:
            out.reshape(-1)[first[n < 0] + ~n[n < 0]] = 1
            for at in np.flatnonzero(out).tolist():
                i, p = divmod(at, width)
                out[i, p] = phrases[p] in texts[i]
            first, n = first[n >= 0], n[n >= 0]
        out.reshape(-1)[first + n] = 1
        for i, t in enumerate(texts if rest else ()):
            out[i, [p for p in rest if phrases[p] in t]] = 1
        return out

    def find(texts: list[bytes | None]) -> Iterator[np.ndarray]:
        most, own, held = max(1, MOST_CELLS // width), [], 0
        for t in texts:
            own.append(t or b"")
            held += len(own[-1])
            if held >= CHUNK or len(own) >= most:
                yield run(own)
                own, held = [], 0
        if own or not texts:
            yield run(own)

    return find


def _finder(phrases: list[bytes], alone: bool) -> Callable[[bytes], set[int]]:
    """A function that gives the numbers of the ``phrases`` that stand in one text."""
    find = _finders(phrases, alone)
    return lambda text: {int(n) for found in find([text]) for n in np.flatnonzero(found[0])}


def listed(phrases: DataFrame, most: int = MOST_DIRECT) -> list[bytes] | None:
    """The distinct ``phrase``s in order, or None if they are more than ``most``: no more are ever taken."""
    own = phrases.select(F.col("phrase").cast("binary").alias("p")).where("length(p) > 0").distinct().limit(most + 1).collect()
    return sorted(bytes(r["p"]) for r in own) if len(own) <= most else None


def _searched(texts: DataFrame, phrases: list[bytes], alone: bool, kind: str, gather: Callable[[np.ndarray, pa.Array], pa.Array]) -> DataFrame:
    """(id, found): what ``gather`` makes of the matrix of what stands in a run of texts, and of the phrases. Spark forgets here how rows are dealt."""
    shared = texts.sparkSession.sparkContext.broadcast(phrases)

    def search(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        find, names = _finders(shared.value, alone), pa.array([p.decode("utf-8", "replace") for p in shared.value], pa.string())
        for texts in batches:
            yield pa.concat_arrays([gather(found, names) for found in find(texts.to_pylist())])

    # As a function that may not be repeated it is not put into filters that the optimizer infers.
    found = F.arrow_udf(search, kind).asNondeterministic()
    return texts.select("id", found(F.col("hay").cast("binary")).alias("found"))


def found_bits(texts: DataFrame, phrases: list[bytes], alone: bool = True) -> DataFrame:
    """(id, found): as :func:`found_sets`, with the places of the found in ``phrases`` as bits of an array of longs."""
    longs = len(phrases) // _WORD + 1

    def gather(found: np.ndarray, _: pa.Array) -> pa.Array:
        values = np.packbits(found, axis=1, bitorder="little").view("<i8").reshape(-1)
        return pa.ListArray.from_arrays(np.arange(len(found) + 1, dtype=np.int32) * longs, values)

    return _searched(texts, phrases, alone, "array<bigint>", gather)


def numbered(spark: SparkSession, phrases: list[bytes]) -> Callable[..., Column]:
    """A function that puts the places in ``phrases`` for the phrases of an array of lists; others are left out."""
    shared = spark.sparkContext.broadcast({p.decode("utf-8", "replace"): n for n, p in enumerate(phrases)})
    return F.udf(lambda lists: None if lists is None else [[shared.value[w] for w in words if w in shared.value] for words in lists], "array<array<int>>")


def has_bit(bits: Column, n: Column) -> Column:
    """Whether the bit ``n`` of :func:`found_bits` is set."""
    return F.getbit(F.get(bits, F.shiftright(n, 6)), n.bitwiseAND(_WORD - 1)) == 1


def found_sets(texts: DataFrame, phrases: DataFrame, alone: bool = True, most: int = MOST_BROADCAST, direct: int = MOST_DIRECT) -> DataFrame:
    """(id, found): for every text (id, hay; ids not null and distinct) the distinct phrases that stand in it as they are.

    ``alone``: a phrase that is one letter a-z counts only where no letter, digit or underscore stands next to it. Null
    and empty phrases are found nowhere, a null text holds nothing. Up to ``direct`` phrases are looked for by words, more by
    their grams: the result is the same.
    """
    if (own := listed(phrases, direct) if direct >= 0 else None) is not None:

        def gather(found: np.ndarray, names: pa.Array) -> pa.Array:
            ends = np.cumsum([0, *np.count_nonzero(found, axis=1)], dtype=np.int32)
            return pa.ListArray.from_arrays(ends, names.take(pa.array(np.nonzero(found)[1], pa.int32())))

        return _searched(texts, own, alone, "array<string>", gather)
    letter = (F.length("phrase") == 1) & F.col("phrase").rlike("[a-z]")
    long = phrases.select("phrase").where(~letter if alone else F.lit(True))
    both = texts.join(candidates(texts, long, _lengths(long), most), "id", "left")
    found = F.filter(F.coalesce("met", F.array().cast("array<string>")), lambda s: F.contains(F.col("hay"), s))
    found = F.when(F.col("hay").isNotNull(), found).otherwise(F.array().cast("array<string>"))
    if alone:
        letters = phrases.where(letter).agg(F.collect_set("phrase").alias("letters"))  # 26 at most
        single = F.regexp_extract_all("hay", F.lit("(?<![a-z0-9_])([a-z])(?![a-z0-9_])"), F.lit(1))
        both, found = both.join(F.broadcast(letters)), F.concat(found, F.coalesce(F.array_intersect(single, "letters"), F.array().cast("array<string>")))
    return both.select("id", found.alias("found"))
