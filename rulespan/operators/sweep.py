"""A grid of thresholds and penalties judged in one pass over the scored rules.

Whether a rule or a sample counts at a threshold depends on one number, so that a histogram of these numbers and its running
sums give every threshold at once: rows are read once and never repeated for thresholds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lineage import cut

#: Weights of the objective, and the margin up to which a sample's topics are close.
WEIGHTS = {"outside": 1.0, "low_margin": 0.5, "generic": 0.25}
LOW_MARGIN = 0.5


def merged(base: Column, override: Column) -> Column:
    """Two maps of settings, of which ``override`` wins; null maps are empty."""
    a, b = (F.coalesce(F.map_entries(c), F.array().cast("array<struct<key:string,value:double>>")) for c in (base, override))
    return F.map_from_entries(F.concat(F.filter(a, lambda e: ~F.exists(b, lambda o: o["key"] == e["key"])), b))


def sweep(scored: DataFrame, thresholds: list[float], penalties: list[float]) -> DataFrame:
    """(threshold, penalty, n_published, n_samples, n_outside, n_low_margin, n_generic, objective, place) of every setting.

    ``scored`` (id, topic_rank, score, margin, generic_only): a rule is published if its score, less the penalty if its topic is
    not the sample's first, reaches the threshold. Samples count if a rule of theirs is published, one of another topic
    (outside), such a one while the margin is low, or one with generic hits only. The objective is the weighted sum of the last
    three as shares of all samples; place 1 is the least one, the first of the grid among equals. A sample without rows
    is unknown here; null scores count nowhere; without rows every share is null.
    """
    scored = cut(scored.select("id", "topic_rank", "score", "margin", "generic_only"), "scored")  # counted by sample and by row
    side, score, generic = F.col("topic_rank") > 1, F.col("score"), F.coalesce(F.col("generic_only"), F.lit(False))
    best = lambda c: F.max(F.when(c, score))
    low = F.coalesce(F.min("margin") <= LOW_MARGIN, F.lit(False))
    per = scored.groupBy("id").agg(best(~side).alias("main"), best(side).alias("side"), best(generic & ~side).alias("g_main"), best(generic & side).alias("g_side"), low.alias("low"))
    each = F.array(*(F.lit(float(p)) for p in penalties))

    def values(p: Column) -> Column:
        behind = F.col("side") - p
        one = lambda metric, value: F.struct(F.lit(metric).alias("metric"), value.alias("value"), p.alias("penalty"))
        return F.array(one("samples", F.greatest("main", behind)), one("outside", behind), one("low_margin", F.when(F.col("low"), behind)), one("generic", F.greatest(F.col("g_main"), F.col("g_side") - p)))

    of_samples = per.select(F.explode(F.flatten(F.transform(each, values))).alias("v")).select("v.*", F.lit(1).cast("long").alias("n"))
    rows = scored.groupBy(side.alias("side"), "score").agg(F.count("*").alias("n")).select(F.lit("published").alias("metric"), F.explode(each).alias("penalty"), "side", "score", "n")
    of_rows = rows.select("metric", (F.col("score") - F.when(F.col("side"), F.col("penalty")).otherwise(0.0)).alias("value"), "penalty", "n")
    histogram = of_samples.unionByName(of_rows).where("value IS NOT NULL").groupBy("metric", "penalty", "value").agg(F.sum("n").alias("n"))
    ordered = sorted(set(map(float, thresholds)))
    reached = F.size(F.filter(F.array(*map(F.lit, ordered)), lambda t: t <= F.col("value")))
    steps = histogram.groupBy("metric", "penalty", reached.alias("k")).agg(F.sum("n").alias("n")).where("k > 0")
    at = steps.select("metric", "penalty", "n", F.explode(F.slice(F.array(*map(F.lit, ordered)), F.lit(1), F.col("k"))).alias("threshold"))
    metric = lambda name: F.coalesce(F.sum(F.when(F.col("metric") == name, F.col("n"))), F.lit(0)).alias(f"n_{name}")
    found = at.groupBy("penalty", "threshold").agg(*map(metric, ("published", "samples", "outside", "low_margin", "generic")))
    grid = F.array(*(F.struct(F.lit(float(t)).alias("threshold"), F.lit(float(p)).alias("penalty"), F.lit(i).alias("i")) for i, (t, p) in enumerate((t, p) for t in thresholds for p in penalties)))
    every = per.agg(F.count("*").alias("total")).select("total", F.explode(grid).alias("g")).select("total", "g.*")
    both = every.join(found, ["threshold", "penalty"], "left").fillna(0)
    objective = sum(w * F.try_divide(F.col(f"n_{m}"), F.col("total")) for m, w in WEIGHTS.items())
    ranked = both.withColumn("objective", F.round(objective, 9))
    place = F.row_number().over(Window.orderBy("objective", "i"))  # of the grid's settings only
    return ranked.select("threshold", "penalty", "n_published", "n_samples", "n_outside", "n_low_margin", "n_generic", "objective", place.alias("place"))
