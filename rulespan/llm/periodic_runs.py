"""Runs of repeated words in texts, by divide and conquer over word numbers.

A run is a stretch of consecutive words that repeats with a smallest period q, is not extended with that period by its
neighbours and is long enough. The words of a text are interned as numbers. At each midpoint of the recursive halving,
Z-functions of the right half and of the reversed left half give all squares that begin or end there; since a run of
exponent four that crosses the midpoint has two periods on one of its sides, every such run shows as a square. Squares
grow to maximal runs, and intervals known already are left alone. The work of a text is n log n of its words whatever they are;
no text meets another one, so nothing is shuffled and a lost task is only run again.
"""

from __future__ import annotations

from bisect import bisect_right, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MIN_WORDS, MIN_EXPONENT = 6, 4
#: An exponent below this could cross a midpoint without two periods on either side.
LEAST_EXPONENT = 4


def squares(x: list[int], at: list[int], rank: int, start: int, step: int, size: int) -> list[int]:
    """Periods p of the primitive squares that begin at ``start`` and go in direction ``step`` within ``size`` words.

    ``at`` has all places of the word at ``start``, which is number ``rank`` of them. The Z-function is computed where the
    first word stands again, as it is zero elsewhere: its box spares every word a second comparison, so that the time is
    linear in ``size``.
    """
    out: list[int] = []
    z: dict[int, int] = {}
    low = high = 0  # the box: words low to high equal the first high - low words
    covered = 0  # words from the start on that the last square's period spans
    i, end = rank + step, len(at)
    while 0 <= i < end:
        p = (at[i] - start) * step
        if 2 * p > size:
            break
        n = min(high - p, z.get(p - low, 0)) if p < high else 0
        if p + n >= high:
            n = max(n, 0)
            a, b = start + step * n, start + step * (p + n)
            while p + n < size and x[a] == x[b]:
                n, a, b = n + 1, a + step, b + step
            low, high = p, p + n
        z[p] = n
        if n >= p and 2 * p > covered:
            out.append(p)
            covered = p + n
        i += step
    return out


def find_runs(words: list, min_words: int = MIN_WORDS, min_exponent: int = MIN_EXPONENT) -> list[tuple[int, int, int]]:
    """All runs (start, length, period) of at least ``max(min_words, min_exponent * period)`` words, by start, then period."""
    n = len(words)
    if n < max(min_words, min_exponent):
        return []
    number: dict = {}
    x = [number.setdefault(w, len(number)) for w in words]
    if len(number) == n:
        return []
    places: list[list[int]] = [[] for _ in number]
    rank = [0] * n
    for i, w in enumerate(x):
        rank[i] = len(places[w])
        places[w].append(i)
    known: dict[int, list[tuple[int, int]]] = {}

    def grow(left: int, p: int) -> None:
        """Add the maximal run around the square of period p at ``left``, unless it is there already."""
        spans = known.setdefault(p, [])
        k = bisect_right(spans, (left, n))
        if k and spans[k - 1][1] >= left + 2 * p:
            return
        start, end = left, left + 2 * p
        while start > 0 and x[start - 1] == x[start - 1 + p]:
            start -= 1
        while end < n and x[end] == x[end - p]:
            end += 1
        insort(spans, (start, end))

    halves = [(0, n)]
    while halves:
        lo, hi = halves.pop()
        mid = (lo + hi) // 2
        w = x[mid]
        at, k = places[w], rank[mid]
        if k + 1 < len(at) and 2 * (at[k + 1] - mid) <= hi - mid:
            for p in squares(x, at, k, mid, 1, hi - mid):
                grow(mid, p)
        w = x[mid - 1]
        at, k = places[w], rank[mid - 1]
        if k and 2 * (mid - 1 - at[k - 1]) <= mid - lo:
            for p in squares(x, at, k, mid - 1, -1, mid - lo):
                grow(mid - 2 * p, p)
        if mid - lo >= min_words:
            halves.append((lo, mid))
        if hi - mid >= min_words:
            halves.append((mid, hi))
    return sorted((s, e - s, p) for p, spans in known.items() for s, e in spans if e - s >= max(min_words, min_exponent * p))


def densest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run of greatest length / period, compared as whole numbers; of equal ones the first by start, then period."""
    best = None
    for run in runs:
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


def collapse(words: list, runs: list[tuple[int, int, int]]) -> list:
    """The words that no run repeats: those of a run after its first period go."""
    gone = bytearray(len(words))
    for start, length, period in runs:
        gone[start + period : start + length] = b"\x01" * (length - period)
    return [w for w, g in zip(words, gone, strict=True) if not g]


_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
_SQL_RUN = "struct<start:bigint,length:bigint,period:bigint>"


def periodic_runs(docs: DataFrame, text_col: str = "text", min_words: int = MIN_WORDS, min_exponent: int = MIN_EXPONENT) -> DataFrame:
    """``docs`` without ``text_col`` and with runs (array of start, length and period in words, by start, then period),
    densest (the run of greatest length / period, else null) and collapsed (the words that no run repeats, joined by one
    space).

    Words are maximal stretches without the characters x20 and x09 to x0D; whole texts are read, of any length. A null, empty
    or blank text has no runs and collapses to ''. Repeated rows are kept and judged alike, an empty table gives an empty
    result; columns named runs, densest or collapsed are replaced, all others pass through. ``min_exponent`` is four or more.
    """
    if min_exponent < LEAST_EXPONENT or min_words < 1:
        raise ValueError(f"runs need an exponent of {LEAST_EXPONENT} or more and a word at least")
    own = [c for c in docs.columns if c not in (text_col, "runs", "densest", "collapsed")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, best, rest = [], [], []
            for text in batch.column(1):
                words = (text.as_py() or b"").split()  # of bytes: exactly the six characters of the contract
                runs = find_runs(words, min_words, min_exponent)
                top = densest(runs)
                as_dict = lambda r: {"start": r[0], "length": r[1], "period": r[2]}
                found.append([as_dict(r) for r in runs])
                best.append(top and as_dict(top))
                rest.append(b" ".join(collapse(words, runs) if runs else words).decode())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(_RUN)), pa.array(best, _RUN), pa.array(rest, pa.string())], ["__own", "runs", "densest", "collapsed"])

    packed = docs.select(F.struct(*own, F.lit(0).alias("__0")).alias("__own"), F.col(text_col).cast("string").cast("binary").alias("__text"))
    out = packed.mapInArrow(run, f"__own {packed.schema['__own'].dataType.simpleString()}, runs array<{_SQL_RUN}>, densest {_SQL_RUN}, collapsed string")
    return out.select(*(F.col("__own")[c].alias(c) for c in own), "runs", "densest", "collapsed")
