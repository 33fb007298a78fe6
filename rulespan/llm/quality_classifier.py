"""Quality scores by a factorisation machine over hashed words, word shapes and structure statistics.

Every text becomes a sparse vector: logarithmic counts of its hashed words and of its hashed word shapes, each block of
unit length, and standardised statistics of its structure and its size. The machine has a weight for each place and a
vector of ``RANK`` numbers for each place, whose inner products weigh all pairs of places. Spark ML fits it on a bounded sample of
the labelled rows; scoring uses the identity of the sum over pairs with the squared sum less the sum of squares, so that
its time is linear in the places that a text has.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import pairwise
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import FMClassifier
from pyspark.ml.linalg import SparseVector, VectorUDT
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut

WORDS, SHAPES, RANK = 4096, 512, 8
STATISTICS = ["words", "chars", "lines", "mean_word", "mean_line", "capitals", "digits", "exclaimed", "symbols", "pipes", "stops", "distinct", "distinct_pairs", "stuttered", "top_word", "repeated_lines", "wide"]
SIZE = WORDS + SHAPES + len(STATISTICS)
#: Standardised statistics lie within this many deviations.
CLIP = 4.0
#: What stands for a byte in a word's shape; small letters and bytes of other alphabets are left out of it.
_SHAPE = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ123456789", b"A" * 26 + b"0" * 9)
_SMALL = bytes(b for b in range(256) if 97 <= b <= 122 or b >= 128)
_NO_WORD = bytes(b for b in range(33, 127) if not chr(b).isalnum())
_CAPITALS, _DIGITS, _SYMBOLS, _STOPS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"#$%&*<>^~_=", b".,;:?"


def statistics(text: bytes, words: list[bytes], counts: Counter) -> list[float]:
    """The numbers of STATISTICS for a whole text; all zero for one without words."""
    n = len(words)
    if not n:
        return [0.0] * len(STATISTICS)
    share = lambda chars: (len(text) - len(text.translate(None, chars))) / n
    lines = [x for x in text.split(b"\n") if x.strip()]
    size = sum(map(len, words))
    pairs = set(pairwise(words))
    stuttered = sum(a == b for a, b in pairwise(words))
    wide = len(text) - len(text.decode(errors="replace"))
    return [
        np.log1p(n), np.log1p(len(text)), np.log1p(len(lines)), size / n, np.log1p(n / max(1, len(lines))), share(_CAPITALS), share(_DIGITS), share(b"!"), share(_SYMBOLS), share(b"|"), share(_STOPS),
        len(counts) / n, len(pairs) / n, stuttered / n, max(counts.values()) / n, 1 - len(set(lines)) / max(1, len(lines)), wide / n,
    ]


def encoded(text: bytes) -> tuple[np.ndarray, np.ndarray, list[float]]:
    """Places and values of the hashed words and shapes of a text, and its statistics.

    A word is hashed without its ASCII punctuation and in small ASCII letters; its shape is the first and the last two of
    its characters that are no small letters, capitals as A and digits as 0.
    """
    words = text.split()
    counts = Counter(words)
    distinct, times = b"\n".join(counts), np.fromiter(counts.values(), float, len(counts))
    places, values = [], []
    if counts:
        shapes: Counter = Counter()
        for shape, count in zip(distinct.translate(_SHAPE, _SMALL).split(b"\n"), counts.values(), strict=True):
            shapes[shape[:1] + shape[-2:]] += count
        cores = [crc32(w) for w in distinct.translate(None, _NO_WORD).lower().split(b"\n")]
        blocks = (cores, times, 0, WORDS), ([crc32(x) for x in shapes], list(shapes.values()), WORDS, SHAPES)
        for hashes, weights, first, size in blocks:
            tally = np.bincount(np.array(hashes, np.int64) % size, weights, size)
            at = np.flatnonzero(tally)
            x = np.log1p(tally[at])
            places.append(at + first)
            values.append(x / np.sqrt((x * x).sum()))
    return np.concatenate([[], *places]).astype(int), np.concatenate([[], *values]), statistics(text, words, counts)


def sparse(texts: pa.Array, mean: np.ndarray, scale: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places, values and the start of every row for a column of binary texts (null: empty), statistics standardised."""
    at, values, starts = [], [], []
    tail = np.arange(WORDS + SHAPES, SIZE)
    total = 0
    for text in texts:
        p, v, s = encoded(text.as_py() or b"")
        at.append(np.concatenate([p, tail]))
        values.append(np.concatenate([v, np.clip((np.array(s) - mean) / scale, -CLIP, CLIP)]))
        starts.append(total)
        total += len(at[-1])
    return np.concatenate(at), np.concatenate(values), np.array(starts)


def pair_sums(places: np.ndarray, values: np.ndarray, starts: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """For every row the sum over all pairs of its places of <v_i, v_j> x_i x_j, in time linear in its places: half of the
    squared sums of v x less the sums of their squares."""
    vx = factors[places] * values[:, None]
    return 0.5 * (np.add.reduceat(vx, starts) ** 2 - np.add.reduceat(vx * vx, starts)).sum(1)


class QualityModel:
    """A fitted machine and the standardisation of its statistics; or a constant score if all labels were alike."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, bias: float, weights: np.ndarray | None = None, factors: np.ndarray | None = None):
        self.mean, self.scale, self.bias, self.weights, self.factors = mean, scale, bias, weights, factors

    def score(self, docs: DataFrame, text_col: str = "text", threshold: float = 0.3) -> DataFrame:
        """``docs`` without ``text_col`` and with score (0 to 1) and predicted (1 if score >= threshold).

        A null text is scored as an empty one, a text of any length as a whole; repeated rows are kept and scored alike, and
        an empty table gives an empty result. Columns named score or predicted are replaced; all others, whatever their
        names, pass through and are no inputs of the score. Nothing is shuffled.
        """
        own = [c for c in docs.columns if c not in (text_col, "score", "predicted")]
        mean, scale, bias, weights, factors = self.mean, self.scale, self.bias, self.weights, self.factors

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                if weights is None:
                    score = np.full(batch.num_rows, bias)
                else:
                    p, x, starts = sparse(batch.column(1), mean, scale)
                    margin = bias + np.add.reduceat(weights[p] * x, starts) + pair_sums(p, x, starts, factors)
                    score = 1 / (1 + np.exp(-np.clip(margin, -500, 500)))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score, pa.float64())], ["__own", "score"])

        packed = docs.select(F.struct(*own, F.lit(0).alias("__0")).alias("__own"), F.col(text_col).cast("string").cast("binary").alias("__text"))
        out = packed.mapInArrow(run, f"__own {packed.schema['__own'].dataType.simpleString()}, score double")
        return out.select(*(F.col("__own")[c].alias(c) for c in own), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def vectors(rows: DataFrame, mean: np.ndarray, scale: np.ndarray) -> DataFrame:
    """(text, label) ``rows`` as (label, features), for a bounded sample only. Zeros are left out: Spark's machine refuses
    vectors that store them."""

    @F.udf(VectorUDT())
    def vector(text):
        p, x, _ = sparse(pa.array([bytes(text)], pa.binary()), mean, scale)
        return SparseVector(SIZE, p[x != 0], x[x != 0])

    return rows.select(F.col("label").cast("double").alias("label"), vector(F.col("text").cast("binary")).alias("features"))


def fit(labelled: DataFrame, text_col: str = "text", label_col: str = "quality", bound: int = 24_000, rounds: int = 80) -> QualityModel:
    """Fit on a sample of about ``bound`` of the ``labelled`` rows, chosen by a hash of the text, in ``rounds`` passes.

    Rows without a label are left out, a null text is empty, a label above 0 is 1. Rows of one label only, or none, give a
    constant score. Equal rows are evidence as often as they stand there. Every pass adds up gradients of fixed size.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = labelled.where(F.col(label_col).isNotNull()).select(text.alias("text"), (F.col(label_col) > 0).cast("int").alias("label"))
    n = rows.count()
    part = F.pmod(F.xxhash64("text"), F.lit(1_000_003))
    rows = cut(rows.where(part < F.lit(int(1_000_003 * min(1.0, bound / max(n, 1))) + 1)), "quality-sample")
    zero, one = np.zeros(len(STATISTICS)), np.ones(len(STATISTICS))
    counts = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    if len(counts) < 2:
        return QualityModel(zero, one, float(next(iter(counts), 0)))

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [statistics(t, t.split(), Counter(t.split())) for t in (x.as_py() or b"" for x in batch.column(0))]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.float64()))], ["s"])

    each = [F.struct(F.avg(F.get("s", F.lit(i))).alias("m"), F.stddev_pop(F.get("s", F.lit(i))).alias("d")).alias(name) for i, name in enumerate(STATISTICS)]
    spread = rows.select(F.col("text").cast("binary")).mapInArrow(measured, "s array<double>").agg(*each).first()
    mean, scale = np.array([spread[s]["m"] for s in STATISTICS]), np.array([spread[s]["d"] or 1.0 for s in STATISTICS])
    train = cut(vectors(rows.repartition(6, F.xxhash64("text")).sortWithinPartitions(F.xxhash64("text"), "label"), mean, scale), "quality-vectors")
    machine = FMClassifier(factorSize=RANK, maxIter=rounds, stepSize=0.05, regParam=0.01, initStd=0.05, seed=7, solver="adamW").fit(train)
    return QualityModel(mean, scale, float(machine.intercept), machine.linear.toArray(), machine.factors.toArray())
