"""Toxicity scores by gradient-boosted trees over dense features, with isotonic calibration.

The features of a text are densities of lexicon hits, hits near words of the second person, shares of capitals,
punctuation and obfuscated words, and lengths. The lexicon has a fixed part and a learned part: beginnings of words
that stand in many independent toxic training texts and in hardly any other. Lexicon, trees and calibration are fitted
on three disjoint parts of the training rows, so that none sees its own evidence again.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml import Model
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut

#: Insults, and words of the second person.
INSULTS = ["idiot", "idiots", "stupid", "moron", "morons", "loser", "losers", "pathetic", "worthless", "scum", "trash", "clown", "disgusting", "dumb", "garbage", "filthy", "vermin", "imbecile", "retard", "bastard"]
SECOND_PERSON = ["you", "your", "yours", "yourself", "u", "ur", "du", "dich", "dir", "dein", "deine", "ihr", "euch", "tu", "te", "toi", "ton", "ta", "tes", "vous", "votre", "vos", "ti", "tus", "usted", "ustedes", "vosotros"]
LEET = str.maketrans("013457@$!|", "oieastasil")
FEATURES = ["fixed", "fixed_share", "learned", "learned_share", "weight", "near_you", "you_share", "capitals", "shouted", "exclaimed", "punctuated", "obfuscated", "repeated", "words", "mean_word"]
LONGEST, SHORTEST = 7, 4
_WORD = re.compile(r"[^\W_]+(?:[@$!|*.'’-][^\W_]+)*")
_SPLIT_UP = re.compile(r"[^\W\d_]+[013457@$!|*.-]+[^\W\d_]+")
_LONG_RUN = re.compile(r"([^\W\d_])\1\1")


def features(text: str, lexicon: dict[str, float]) -> list[float]:
    """The features of a text in the order of FEATURES; all zero for an empty text."""
    words = _WORD.findall(text)
    if not words:
        return [0.0] * len(FEATURES)
    you, insults = _YOU, _INSULTS
    fixed, learned, weight, at, second, obfuscated = 0, 0, 0.0, [], [], 0
    for i, word in enumerate(words):
        w = word.lower()
        if not w.isalpha():
            plain = w.translate(LEET)
            plain = "".join(c for c in plain if c.isalpha())
            obfuscated += bool(_SPLIT_UP.search(w))
            if plain in insults:
                w = plain
        if w in you:
            second.append(i)
        hit = w in insults
        fixed += hit
        known = 0.0
        for n in range(SHORTEST, min(LONGEST, len(w)) + 1):
            known = max(known, lexicon.get(w[:n], 0.0))
        known = max(known, lexicon.get(w + "$", 0.0))
        learned += known > 0
        weight += known
        if hit or known > 0:
            at.append(i)
    n = len(words)
    near = 0
    if second and at:
        s = np.array(second)
        k = np.searchsorted(s, at)
        left, right = s[np.maximum(k - 1, 0)], s[np.minimum(k, len(s) - 1)]
        near = int((np.minimum(np.abs(left - at), np.abs(right - at)) <= 5).sum())
    chars = max(1, len(text))
    upper = sum(map(str.isupper, words)) if text != text.lower() else 0
    letters = sum(len(w) for w in words)
    capitals = sum(1 for a, b in zip(text, text.lower(), strict=False) if a != b) if upper else 0
    punctuation = sum(text.count(c) for c in "!?.,;:*#$%&")
    return [float(x) for x in (fixed, 100 * fixed / n, learned, 100 * learned / n, weight, near, 100 * len(second) / n, capitals / chars, upper / n, 100 * text.count("!") / chars, 100 * punctuation / chars, 100 * obfuscated / n, 100 * len(_LONG_RUN.findall(text)) / n, np.log1p(n), letters / n)]


_YOU, _INSULTS = frozenset(SECOND_PERSON), frozenset(INSULTS)


def _stems(text: str) -> set[str]:
    out = set()
    for w in {x.lower() for x in _WORD.findall(text)}:
        if len(w) >= SHORTEST:
            out.update(w[:n] for n in range(SHORTEST, min(LONGEST, len(w)) + 1))
            out.add(w + "$")
    return out


def learn_lexicon(rows: DataFrame, most: int = 2_000) -> dict[str, float]:
    """Log-odds of word beginnings in (text, label) ``rows``: at most ``most``, in at least four toxic texts and 0.5 %
    of them, at odds of eight or more. Texts with the same longest word count once: copies are no evidence. What is
    counted does not depend on how rows fall into partitions."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        toxic, clean = Counter(), Counter()
        for batch in batches:
            for text, label in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                (toxic if label else clean).update(_stems(text.as_py()))
        stems = list(toxic.keys() | clean.keys())
        yield pa.RecordBatch.from_arrays([pa.array(stems, pa.string()), pa.array([toxic[s] for s in stems], pa.int64()), pa.array([clean[s] for s in stems], pa.int64())], ["stem", "t", "c"])

    longest = F.max_by(F.col("w"), F.struct(F.length("w"), F.col("w")))
    keyed = cut(rows.groupBy(F.xxhash64("text").alias("__i"), "label").agg(F.min("text").alias("text")), "toxicity-lexicon")
    one = keyed.select("__i", "label", F.explode(F.split(F.lower("text"), r"\W+")).alias("w")).groupBy("__i", "label").agg(longest.alias("w")).groupBy("w", "label").agg(F.min("__i").alias("__i"))
    rows = keyed.join(one.select("__i", "label"), ["__i", "label"], "left_semi").select("text", "label")
    size = rows.groupBy("label").count().collect()
    n = {r["label"]: r["count"] for r in size}
    t_all, c_all = n.get(1, 0), n.get(0, 0)
    odds = ((F.col("t") + 0.5) / (t_all + 1)) / ((F.col("c") + 0.5) / (c_all + 1))
    stems = rows.mapInArrow(count, "stem string, t long, c long").groupBy("stem").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))
    found = stems.where((F.col("t") >= max(4, 0.005 * t_all)) & (odds >= 8)).select("stem", F.log(odds).alias("w")).orderBy(F.desc("w"), "stem").limit(most).collect()
    return {r["stem"]: float(r["w"]) for r in found}


def featurised(docs: DataFrame, text_col: str, lexicon: dict[str, float]) -> DataFrame:
    """``docs`` without ``text_col`` and with __x, the features of the whole text (null: empty)."""
    names = [c for c in docs.columns if c != text_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [features(t.as_py() or "", lexicon) for t in batch.column(text_col)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(x, pa.list_(pa.float64()))], [*names, "__x"])

    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.schema if f.name in names)
    return docs.mapInArrow(run, fields + "__x array<double>")


class ToxicityModel:
    """A fitted lexicon, trees and calibration; or a constant score if the training rows had one label only."""

    def __init__(self, lexicon: dict[str, float], trees: Model | None, isotonic: Model | None, constant: float):
        self.lexicon, self.trees, self.isotonic, self.constant = lexicon, trees, isotonic, constant

    def raw(self, x: DataFrame) -> DataFrame:
        """``x`` with __prob, the uncalibrated probability by the trees."""
        made = self.trees.setFeaturesCol("__v").setPredictionCol("__y").setProbabilityCol("__p").setRawPredictionCol("__r").transform(x.withColumn("__v", array_to_vector("__x")))
        return made.withColumn("__prob", vector_to_array("__p")[1]).drop("__v", "__y", "__p", "__r")

    def score(self, docs: DataFrame, text_col: str = "text", threshold: float = 0.7) -> DataFrame:
        """``docs`` without ``text_col`` and with score (0 to 1) and predicted (1 if score >= threshold).

        A null text is scored as an empty one, a text of any length as a whole; repeated rows are kept and scored alike,
        and an empty table gives an empty result. Columns named score or predicted are replaced; all others, whatever
        their names, pass through and are no inputs of the score.
        """
        own = [c for c in docs.columns if c not in (text_col, "score", "predicted")]
        if self.trees is None:
            kept, score = docs.select(F.struct(*own, F.lit(0).alias("__0")).alias("__own")), F.lit(self.constant)
        else:
            x = featurised(docs.select(F.struct(*own, F.lit(0).alias("__0")).alias("__own"), F.col(text_col).cast("string").alias("__text")), "__text", self.lexicon)
            kept, score = self.isotonic.setPredictionCol("__score").transform(self.raw(x)), F.greatest(F.least("__score", F.lit(1.0)), F.lit(0.0))
        out = kept.select("__own", score.alias("score"))
        return out.select(*(F.col("__own")[c].alias(c) for c in own), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def fit(labelled: DataFrame, text_col: str = "text", label_col: str = "toxic", bound: int = 24_000, most: int = 2_000) -> ToxicityModel:
    """Fit on a sample of about ``bound`` of the ``labelled`` rows, chosen by a hash of the text; rows without a label are
    left out and a null text is empty. 40 % of the sample make the lexicon of up to ``most`` beginnings of words, 40 % the
    trees, 20 % the calibration. The same rows give the same model, however they are partitioned. Rows of one label
    only, or none, give a constant score."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = labelled.where(F.col(label_col).isNotNull()).select(text.alias("text"), (F.col(label_col) > 0).cast("int").alias("label"))
    n = rows.count()
    h = F.pmod(F.xxhash64("text"), F.lit(1_000_003))
    rows = rows.withColumn("h", h).where(F.col("h") < F.lit(int(1_000_003 * min(1.0, bound / max(n, 1))) + 1))
    rows = cut(rows.withColumn("part", F.pmod(F.xxhash64(F.lit(1), "text"), F.lit(5))), "toxicity-sample")
    lexicon = learn_lexicon(rows.where("part < 2").select("text", "label"), most)
    x = cut(featurised(rows.where("part >= 2").select("label", "part", "h", "text"), "text", lexicon), "toxicity-features")
    counts = {(r["fit"], r["label"]): r["count"] for r in x.groupBy((F.col("part") < 4).alias("fit"), "label").count().collect()}
    if not all(counts.get((part, label)) for part in (True, False) for label in (0, 1)):
        total = sum(counts.values())
        return ToxicityModel(lexicon, None, None, sum(v for k, v in counts.items() if k[1]) / total if total else 0.0)
    trees = GBTClassifier(featuresCol="__v", labelCol="label", maxIter=20, maxDepth=3, stepSize=0.3, seed=7, maxBins=64)
    train = x.where("part < 4").repartition(6, "h").sortWithinPartitions("h", "label", "__x").select("label", array_to_vector("__x").alias("__v"))
    model = ToxicityModel(lexicon, trees.fit(train), None, 0.0)
    held = model.raw(x.where("part = 4")).select("__prob", F.col("label").cast("double").alias("__label"))
    model.isotonic = IsotonicRegression(featuresCol="__prob", labelCol="__label").fit(held)
    return model
