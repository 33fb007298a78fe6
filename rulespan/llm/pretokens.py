"""Vectorised splitting of texts into pre-tokens inside a task, as the pattern of byte-level BPE vocabularies does.

The pattern is ``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+``. Instead of matching
it character by character, code points are mapped to four classes and token starts follow from where classes change.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Callable
from functools import lru_cache

import numpy as np

from .hashing import mix, powers

_SPACE, _LETTER, _NUMBER, _OTHER = 0, 1, 2, 3
#: Texts are cut into groups of about so many characters, which bounds memory; a longer text is a group of its own.
GROUP = 500_000


@lru_cache(1)
def _classes() -> np.ndarray:
    """The class of every code point."""
    import regex

    every = "".join(map(chr, (c if not 0xD800 <= c < 0xE000 else 0x21 for c in range(0x110000))))
    out = np.full(0x110000, _OTHER, np.uint8)
    for kind, pattern in ((_LETTER, r"\p{L}+"), (_NUMBER, r"\p{N}+"), (_SPACE, r"\p{White_Space}+")):
        for m in regex.finditer(pattern, every):
            out[m.start() : m.end()] = kind
    return out


@lru_cache(1)
def _values() -> np.ndarray:
    return mix(np.arange(1, 0x110001, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def split(points: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(token starts, token ends) in concatenated texts of code points; a token never crosses one of ``starts``."""
    n = len(points)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    kind = _classes()[points]
    edge = np.ones(n + 1, bool)  # a token starts here
    np.not_equal(kind[1:], kind[:-1], out=edge[1:n])
    first = np.zeros(n + 1, bool)  # a text starts here
    first[starts[starts < n]] = True
    first[n] = True
    edge |= first
    # The last white space of a run before something else stands alone; a blank joins what follows.
    ends_run = np.flatnonzero((kind[:-1] == _SPACE) & (kind[1:] != _SPACE) & ~first[1:n])
    edge[ends_run] = True
    blank = ends_run[points[ends_run] == 32]
    edge[blank + 1] = False
    # Contractions: a lone apostrophe that starts a token, before these letters.
    quote = np.flatnonzero((points == 39) & edge[:n])
    quote = quote[quote + 1 < n]
    quote = quote[(kind[quote + 1] == _LETTER) & ~first[quote + 1]]
    if len(quote):
        a = points[quote + 1]
        after = np.minimum(quote + 2, n - 1)
        b = np.where((quote + 2 < n) & ~first[after], points[after], 0)
        two = ((a == 114) & (b == 101)) | ((a == 118) & (b == 101)) | ((a == 108) & (b == 108))
        one = (a == 115) | (a == 116) | (a == 109) | (a == 100)
        hit = one | two
        q, length = quote[hit], np.where(one[hit], 2, 3)
        edge[q + 1] = False
        edge[q + length] = True
    at = np.flatnonzero(edge)
    return at[:-1], at[1:]


def hashes(points: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each token."""
    up, down = powers(len(points))
    prefix = np.zeros(len(points) + 1, np.uint64)
    np.cumsum(_values()[points] * up, out=prefix[1:])
    return mix((prefix[end] - prefix[start]) * down[start] + (end - start).astype(np.uint64))


def groups(lengths: list[int]) -> list[tuple[int, int]]:
    """(from, to) of runs of texts with about GROUP characters in all, by the texts' lengths."""
    out, begin, size = [], 0, 0
    for i, n in enumerate(lengths):
        if size and size + n > GROUP:
            out.append((begin, i))
            begin, size = i, 0
        size += n
    if begin < len(lengths):
        out.append((begin, len(lengths)))
    return out


def tokenised(texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """(distinct pre-tokens, their hashes, for every token in order which it is, tokens of each text)."""
    whole = "".join(texts)
    points = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
    starts = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    start, end = split(points, starts[:-1])
    h, at, which = np.unique(hashes(points, start, end), return_index=True, return_inverse=True)
    words = [whole[i:j] for i, j in zip(start[at].tolist(), end[at].tolist(), strict=True)]
    return words, h, which.astype(np.int32), np.diff(np.searchsorted(start, starts))


#: The only pattern that :func:`split` knows.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def check_pattern(pattern: str) -> None:
    """Raise for any pattern but the one that the vectorised splitting follows."""
    if pattern != PATTERN:
        raise ValueError(f"texts are split by {PATTERN!r} only, not by {pattern!r}")


@lru_cache(2)
def encoder(path: str, pattern: str):
    """The tiktoken encoding of a file of ranks."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding(path, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def rank_words(path: str, pattern: str) -> Callable[[str], list[int]]:
    """Ids of one pre-token by a file of ranks."""
    check_pattern(pattern)
    return encoder(path, pattern).encode_ordinary


@lru_cache(2)
def _tokenizer(path: str):
    """(the tokenizer of a file, a pattern of its added tokens or None, their ids by content)."""
    import json
    import re

    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    pre = spec.get("pre_tokenizer") or {}
    if spec.get("normalizer") or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) or spec["model"]["type"] != "BPE":
        raise ValueError("only byte-level tokenizers without a normaliser or a prefix blank are split by words")
    added = {a["content"]: a["id"] for a in spec.get("added_tokens", [])}
    if any(a["single_word"] or a["lstrip"] or a["rstrip"] or a["normalized"] for a in spec.get("added_tokens", [])):
        raise ValueError("added tokens that look at their surroundings are not supported")
    parts = re.compile("(" + "|".join(re.escape(c) for c in sorted(added, key=len, reverse=True)) + ")") if added else None
    return Tokenizer.from_file(path), parts, added


def _shown_bytes() -> str:
    """The sign by which byte-level vocabularies show each byte: printable ones as they are, others from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    other = iter(range(256, 512))
    return "".join(chr(b if b in plain else next(other)) for b in range(256))


class Tokens:
    """Ids of texts as a ``tokenizers`` file gives them, without special tokens around a text; added tokens that stand in
    a text are one id each. Words go through the model of the library, each once as long as it is remembered."""

    def __init__(self, path: str, most: int = 300_000):
        tokenizer, self.parts, self.added = _tokenizer(path)
        model, shown = tokenizer.model, _shown_bytes()
        self.words = Words(lambda w: [t.id for t in model.tokenize(w.encode().decode("latin-1").translate(shown))], most)

    def ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in order, how many each text has)."""
        if self.parts is None or not any(c in t for c in self.added for t in texts):
            return self.words.ids(texts)
        pieces = [self.parts.split(t) for t in texts]  # plain texts at even places, added tokens between them
        flat, counts = self.words.ids([p for own in pieces for p in own[::2]])
        out, n, at, k = [], [], 0, 0
        for own in pieces:
            size = 0
            for j, p in enumerate(own):
                if j % 2:
                    out.append(np.array([self.added[p]], np.uint32))
                else:
                    out.append(flat[at : at + counts[k]])
                    at, k = at + int(counts[k]), k + 1
                size += len(out[-1])
            n.append(size)
        return np.concatenate(out), np.array(n, np.int64)


class Words:
    """Ids of texts by a function of one pre-token, each asked once as long as it is remembered; at most ``most`` are,
    to bound memory."""

    def __init__(self, encode: Callable[[str], list[int]], most: int = 300_000):
        self.encode, self.most = encode, most
        self.known: dict[int, int] = {}
        self.start, self.flat = array("q", [0]), array("I")

    def ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in order, how many each text has)."""
        words, h, which, tokens = tokenised(texts)
        if len(self.known) + len(words) > self.most:
            self.known, self.start, self.flat = {}, array("q", [0]), array("I")
        slot = np.empty(len(words), np.int64)
        for i, (key, word) in enumerate(zip(h.tolist(), words, strict=True)):
            k = self.known.get(key)
            if k is None:
                k = self.known[key] = len(self.known)
                self.flat.extend(self.encode(word))
                self.start.append(len(self.flat))
            slot[i] = k
        begin, flat = np.frombuffer(self.start, np.int64), np.frombuffer(self.flat, np.uint32)
        return gather(flat, begin, slot[which], tokens)


def gather(flat: np.ndarray, begin: np.ndarray, which: np.ndarray, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(concatenated pieces flat[begin[w]:begin[w + 1]] for w in which, their total length for each run of ``tokens``)."""
    size = begin[which + 1] - begin[which]
    to = np.concatenate([[0], np.cumsum(size)])
    out = flat[np.arange(to[-1]) + np.repeat(begin[which] - to[:-1], size)] if len(which) else flat[:0].copy()
    return out, np.diff(to[np.concatenate([[0], np.cumsum(tokens)])])
