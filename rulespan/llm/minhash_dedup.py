"""Near-duplicate documents by bottom-k sketches.

Every document is a set of hashed word shingles. One hash function orders all shingles; a sketch keeps the k smallest.

1. Documents with equal sets form a class (digest of the whole set); only one member of each goes on.
2. Inverted lists: a class is filed under every run of consecutive retained values of its sketch. Two sets of
   Jaccard t agree in each value of their union with probability t, so that at 48 retained values some run is shared
   with a probability above 1 - 1e-6 (for small sets always, by pigeonhole), while documents that share only a
   passage rarely agree in a run.
3. Every list is first reduced to a star: each member against the member that stands in most lists. Full sets confirm.
4. Members which the stars left apart: short lists give their pairs, long lists compare what is left over with all
   members in bounded blocks. The estimate on the union of two sketches filters, and full sets confirm again.
5. Components over the confirmed links.

No list is ever expanded into all its pairs unless it is short, and nothing is capped: what the stars leave over in
a long list meets every member of the list.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .hashing import common, runs, shingle_set
from .shared import components, cut, small

#: Values of a sketch that are filed in inverted lists, the largest short list, and rows of a block of a long one.
RETAINED, SHORT, BLOCK = 48, 32, 256


def run_length(percent: int) -> int:
    """How many consecutive retained values make a key at this similarity."""
    return 4 if percent >= 85 else 3 if percent >= 80 else 2 if percent >= 60 else 1


def sketches(docs: DataFrame, id_col: str, text_col: str, words: int, k: int) -> DataFrame:
    """(id, n, digest, sketch): size and digest of each document's set, and its k smallest values as bytes."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, digest, low = [], [], []
            for text in batch.column(1):
                s = shingle_set(text.as_py(), words)
                n.append(len(s))
                digest.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                low.append(s[:k].tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(low, pa.binary())], ["id", "n", "digest", "sketch"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(sketch, "id long, n long, digest binary, sketch binary")


def filed(classes: DataFrame, length: int) -> DataFrame:
    """(key, x): the inverted lists."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, x = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
            for i, n, low in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                values = np.frombuffer(low.as_py(), np.uint64)[:RETAINED]
                found = [runs(values, length)] + ([runs(values, length - 1)] if n <= 8 and length > 1 else [])
                for f in found:
                    key.append(f)
                    x.append(np.full(len(f), i, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(key).view(np.int64)), pa.array(np.concatenate(x))], ["key", "x"])

    return classes.select("id", "n", "sketch").mapInArrow(keys, "key long, x long")


def estimate_ok(a: np.ndarray, b: np.ndarray, na: int, nb: int, k: int, least: float) -> bool:
    """Whether the Jaccard of two sets, estimated on the union of their sketches, can reach ``least``; exact for
    sets that the sketches hold whole."""
    if min(na, nb) < least * max(na, nb):
        return False
    if na > k or nb > k:
        top = min(x[-1] for x, n in ((a, na), (b, nb)) if n > k)
        a, b = a[: np.searchsorted(a, top, "right")], b[: np.searchsorted(b, top, "right")]
    both = common(a, b)
    size = len(a) + len(b) - both
    return both >= (least - slack(na, nb, size, k, least)) * size - 1e-9


def slack(na: int, nb: int, size: int, k: int, least: float) -> float:
    """4.75 standard errors of the estimate at ``least`` from ``size`` values of the union, drawn without replacement."""
    if na <= k and nb <= k:
        return 0.0
    union = max((na + nb) / (1 + least), size)
    return 4.75 * (least * (1 - least) / size * (1 - size / (union + 1))) ** 0.5


def estimated(pairs: DataFrame, sketch: DataFrame, k: int, percent: int) -> DataFrame:
    """Of the pairs (x, y), those that the union sketches leave possible."""

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nx, ny = batch.column("nx").to_numpy(), batch.column("ny").to_numpy()
            sx, sy = batch.column("sx"), batch.column("sy")
            ok = [estimate_ok(np.frombuffer(sx[i].as_py(), np.uint64), np.frombuffer(sy[i].as_py(), np.uint64), nx[i], ny[i], k, percent / 100) for i in range(batch.num_rows)]
            yield batch.select(["x", "y"]).filter(pa.array(ok, pa.bool_()))

    side = lambda c: sketch.select(F.col("id").alias(c), F.col("n").alias(f"n{c}"), F.col("sketch").alias(f"s{c}"))
    return pairs.join(side("x"), "x").join(side("y"), "y").select("x", "y", "nx", "ny", "sx", "sy").mapInArrow(test, "x long, y long")


def confirmed(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """Of the pairs (x, y), those with 100 * intersection >= percent * union on the full sets."""

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        y_now, ys = None, None
        for batch in batches:
            ok = []
            for x_text, y, y_text in zip(batch.column("tx"), batch.column("y").to_pylist(), batch.column("ty"), strict=True):
                if y != y_now:
                    y_now, ys = y, shingle_set(y_text.as_py(), words)
                xs = shingle_set(x_text.as_py(), words)
                both = common(xs, ys)
                ok.append(100 * both >= percent * (len(xs) + len(ys) - both))
            yield batch.select(["x", "y"]).filter(pa.array(ok, pa.bool_()))

    side = lambda c: texts.select(F.col("id").alias(c), F.col("text").alias(f"t{c}"))
    return pairs.join(side("x"), "x").join(side("y"), "y").select("x", "y", "tx", "ty").mapInArrow(test, "x long, y long")


def left_over(stars: DataFrame, sketch: DataFrame, label: DataFrame, k: int, percent: int) -> DataFrame:
    """Candidate pairs (x, y) in the long lists of one hub: x is not yet joined to the hub, y is any member of another
    component. Blocks of members meet blocks of those left over; a pair leaves its block only if the sketches agree."""
    m = stars.join(label.select(F.col("node").alias("x"), F.col("component").alias("cx")), "x", "left").join(label.select(F.col("node").alias("y"), F.col("component").alias("cy")), "y", "left")
    m = m.select(F.col("y").alias("hub"), F.col("x").alias("id"), F.coalesce("cx", "x").alias("c"), (F.coalesce("cx", "x") != F.coalesce("cy", "y")).alias("apart"))
    size = m.groupBy("hub").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"), F.sum(F.col("apart").cast("long")).alias("n_apart")).where("n_apart > 0").withColumn("apart_blocks", F.ceil(F.col("n_apart") / BLOCK).cast("int"))
    m = m.join(size, "hub").join(sketch, "id")
    block = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    cols = ["id", "n", "c", "sketch"]
    left = m.where("apart").select("hub", block("apart_blocks").alias("i"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("j"), F.lit(True).alias("own"), *cols)
    right = m.select("hub", F.explode(F.sequence(F.lit(0), F.col("apart_blocks") - 1)).alias("i"), block("blocks").alias("j"), F.lit(False).alias("own"), *cols)
    cells = left.unionByName(right).groupBy("hub", "i", "j").agg(F.collect_list(F.struct("own", *cols)).alias("rows"))
    least = percent / 100

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cell in batch.column("rows"):
                rows = cell.as_py()
                xs, ys = [r for r in rows if r["own"]], [r for r in rows if not r["own"]]
                if not xs or not ys:
                    continue
                sx, sy = ([np.frombuffer(r["sketch"], np.uint64) for r in side] for side in (xs, ys))
                values, at = np.unique(np.concatenate(sx + sy), return_inverse=True)
                have = np.zeros((len(xs) + len(ys), len(values)), np.float32)
                have[np.repeat(np.arange(len(xs) + len(ys)), [len(s) for s in sx + sy]), at] = 1
                both = have[: len(xs)] @ have[len(xs) :].T
                nx, ny = (np.array([r["n"] for r in side]) for side in (xs, ys))
                tx, ty = (np.array([v[-1] if n > k else 2**64 - 1 for v, n in zip(s, m, strict=True)], np.uint64) for s, m in ((sx, nx), (sy, ny)))
                # values of each sketch up to the lower top of the pair: the union sketch
                below = np.stack([np.searchsorted(v, np.minimum(t, ty), "right") for v, t in zip(sx, tx, strict=True)])
                below = below + np.stack([np.searchsorted(v, np.minimum(t, tx), "right") for v, t in zip(sy, ty, strict=True)]).T
                size = below - both
                union = np.maximum((nx[:, None] + ny[None, :]) / (1 + least), size)
                error = 4.75 * np.sqrt(least * (1 - least) / size * (1 - size / (union + 1)))
                error[(nx[:, None] <= k) & (ny[None, :] <= k)] = 0
                near = np.minimum(nx[:, None], ny[None, :]) >= least * np.maximum(nx[:, None], ny[None, :])
                other = np.array([r["c"] for r in xs])[:, None] != np.array([r["c"] for r in ys])[None, :]
                out = [(xs[i]["id"], ys[j]["id"]) for i, j in np.argwhere((both >= (least - error) * size - 1e-9) & near & other)]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array([min(p) for p in out], pa.int64()), pa.array([max(p) for p in out], pa.int64())], ["x", "y"])

    return cells.select("rows").mapInArrow(compare, "x long, y long")


def star_labels(links: DataFrame) -> DataFrame:
    """(node, component): a node of the same component for each node of ``links``, mostly the same one for all. Two
    hops towards smaller ids; nodes with equal labels are joined, others may be as well."""
    both = links.select(F.col("x").alias("node"), F.col("y").alias("to")).unionByName(links.select(F.col("y").alias("node"), F.col("x").alias("to")))
    one = both.groupBy("node").agg(F.min("to").alias("to")).select("node", F.least("node", "to").alias("to"))
    two = one.select(F.col("node").alias("to"), F.col("to").alias("component"))
    return one.join(two, "to").select("node", "component")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80, k: int = 128) -> DataFrame:
    """One row per row of ``docs``: ``id_col``, n_shingles (size of its set), component_id (smallest id reachable over
    links, itself included) and kept (its id is component_id).

    Two documents are linked if ``100 * intersection >= percent * union`` of their distinct ``words``-word shingles;
    words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased, and a text of fewer words is one shingle. A text that is
    null or without words has the empty set and is linked with nothing. Rows that repeat an id are one document and
    rows without an id are returned with their own (null) component and kept. Other columns are ignored; an empty
    table gives an empty result.
    """
    length = run_length(percent)
    s = cut(sketches(docs, id_col, text_col, words, k), "sketches")
    members = s.where("n > 0 and id is not null")
    classes = cut(members.groupBy("digest").agg(F.min("id").alias("id"), F.count("*").alias("copies")), "classes")
    sketch = members.join(classes.select("digest", "id"), ["digest", "id"], "left_semi").select("id", "n", "sketch").dropDuplicates(["id", "n"])
    sketch = cut(sketch, "class-sketches")

    lists = filed(sketch, length)
    long = lists.groupBy("key").agg(F.count("*").alias("m")).where("m > 1")
    lists = cut(lists.join(long, "key"), "lists")
    degree = lists.groupBy("x").agg(F.count("*").alias("d"))
    ranked = lists.join(degree, "x")
    hubs = ranked.groupBy("key").agg(F.max(F.struct("d", -F.col("x"))).alias("top")).select("key", (-F.col("top.col2")).alias("y"))
    stars = cut(lists.join(hubs, "key").where("x <> y").groupBy("x", "y").agg(F.max(F.col("m") > SHORT).alias("long")), "stars")

    involved = cut(lists.select("x").distinct(), "involved")
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    texts = texts.join(small(involved.select(F.col("x").alias("id")), involved.count(), 500_000), "id", "left_semi")
    texts = cut(texts.dropDuplicates(["id"]), "texts")

    first = cut(confirmed(estimated(stars.select("x", "y"), sketch, k, percent), texts, words, percent), "links")
    label = cut(star_labels(first), "labels")
    short = lists.where(F.col("m") <= SHORT).groupBy("key").agg(F.array_sort(F.collect_set("x")).alias("xs")).select("xs").distinct()
    short = short.select(F.explode("xs").alias("x"), "xs").select("x", F.explode(F.expr("filter(xs, v -> v > x)")).alias("y"))
    rest = left_over(stars.where("long").select("x", "y"), sketch, label, k, percent)
    of = lambda c: label.select(F.col("node").alias(c), F.col("component").alias(f"c{c}"))
    apart = short.distinct().join(of("x"), "x", "left").join(of("y"), "y", "left").where(F.coalesce("cx", "x") != F.coalesce("cy", "y")).select("x", "y")
    apart = estimated(apart.join(stars, ["x", "y"], "left_anti").join(stars.select(F.col("y").alias("x"), F.col("x").alias("y")), ["x", "y"], "left_anti"), sketch, k, percent)
    second = cut(confirmed(apart.unionByName(rest).distinct(), texts, words, percent), "links")
    label = components(first.unionByName(second), "x", "y")

    to = classes.join(label, classes["id"] == label["node"], "left").select("digest", F.coalesce("component", "id").alias("component_id"))
    out = s.join(to, "digest", "left")
    own = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id"))
    own = F.when(F.col("id").isNotNull(), own)
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), own.alias("component_id"), F.coalesce(F.col("id") == own, F.lit(True)).alias("kept"))
