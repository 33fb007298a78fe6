"""Packing of documents into token sequences by a grouping genetic algorithm on islands.

Documents become pieces of at most the sequence length. Pieces are dealt by hash into shards of bounded size; a shard is
packed by several islands. An individual is a grouping of the shard's pieces into bins; an island starts from individuals
packed in random and in blurred orders. Crossover injects whole well-filled bins of one parent into another, removes the
bins that then hold a piece twice and puts the displaced pieces back by best fit; a child that is better than the worst
individual takes its place. After each epoch the best individual of an island migrates to the next island. An island
stops early only where its best individual has as few bins as the sum of lengths allows, which is proof of an optimum.
Only lengths and groupings travel between islands; shards grow in number, not in size, with the input.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .pretokens import Tokens, groups
from .shared import cut

#: Pieces of a shard, islands of a shard, epochs, and generations of an epoch.
SHARD, ISLANDS, EPOCHS, GENERATIONS = 50_000, 2, 3, 24
#: How far the order of each first individual departs from falling length; None is a random order.
BLUR = (0.5, 1.0, None, None)


def pieces(docs: DataFrame, path: str, end_id: int, size: int, id_col: str, text_col: str) -> DataFrame:
    """(``id_col``, piece, start, length, ids_crc32) of the ids of every document, ``end_id`` after them. A document of
    more than ``size`` ids is cut so that only its first piece may be shorter."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = Tokens(path)
        for batch in batches:
            at, piece, start, length, crc = [], [], [], [], []
            texts = batch.column(1)
            for lo, hi in groups([len(t.as_py() or "") for t in texts]):
                ids, counts = e.ids([t.as_py() or "" for t in texts.slice(lo, hi - lo)])
                to = np.concatenate([[0], np.cumsum(counts)])
                for k in range(hi - lo):
                    own = np.append(ids[to[k] : to[k + 1]], np.uint32(end_id)).astype("<u4")
                    first = len(own) % size or size
                    begin = 0
                    for j, stop in enumerate(range(first, len(own) + 1, size)):
                        at.append(lo + k)
                        piece.append(j)
                        start.append(begin)
                        length.append(stop - begin)
                        crc.append(zlib.crc32(own[begin:stop].tobytes()))
                        begin = stop
            columns = [batch.column(0).take(pa.array(at, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, [id_col, "piece", "start", "length", "ids_crc32"])

    fields = f"`{id_col}` {kind}, piece int, start long, length long, ids_crc32 long"
    return docs.select(F.col(id_col), F.col(text_col).cast("string").alias("__text")).mapInArrow(run, fields)


class Bins:
    """Open bins by their room, for best fit in constant time."""

    def __init__(self, size: int):
        self.size, self.at, self.rooms, self.count = size, [[] for _ in range(size + 1)], 0, 0

    def add(self, number: int, room: int) -> None:
        if room:
            if not self.at[room]:
                self.rooms |= 1 << room
            self.at[room].append(number)

    def fit(self, length: int) -> int:
        """The fullest bin that takes ``length``, or a new one."""
        wide = self.rooms >> length
        if wide:
            room = length + (wide & -wide).bit_length() - 1
            stack = self.at[room]
            number = stack.pop()
            if not stack:
                self.rooms ^= 1 << room
        else:
            number, room = self.count, self.size
            self.count += 1
        self.add(number, room - length)
        return number


def best_fit(lengths: np.ndarray, order: np.ndarray, size: int) -> np.ndarray:
    """The bin of every piece, taken in ``order``."""
    bins, out = Bins(size), np.empty(len(lengths), np.int32)
    fit = bins.fit
    out[order] = [fit(n) for n in lengths[order].tolist()]
    return out


def fitness(lengths: np.ndarray, own: np.ndarray, size: int) -> tuple[int, float]:
    """(fewer bins are better: minus their number, how unevenly they are filled)."""
    fill = np.bincount(own, weights=lengths) / size
    return -len(fill), float((fill * fill).sum())


def crossover(lengths: np.ndarray, a: np.ndarray, b: np.ndarray, size: int, rng: np.random.Generator) -> np.ndarray:
    """``a`` with half of the well-filled bins of ``b``, those filled no less than the median; displaced pieces go back by
    best fit, largest first. Mutation dissolves some bins of ``a`` as well, above all loose ones and the two emptiest."""
    fill_a, fill_b = np.bincount(a, weights=lengths), np.bincount(b, weights=lengths)
    chosen = (fill_b >= np.median(fill_b)) & (rng.random(len(fill_b)) < 0.5)
    injected = chosen[b]
    hit = np.zeros(len(fill_a), bool)
    hit[a[injected]] = True
    hit |= rng.random(len(fill_a)) < np.where(fill_a < size, 0.3, 0.02)
    hit[np.argsort(fill_a)[:2]] = True
    stay = ~injected & ~hit[a]
    out = np.empty(len(a), np.int64)
    out[injected] = b[injected]
    out[stay] = a[stay] + len(fill_b)
    kept = injected | stay
    _, out[kept] = np.unique(out[kept], return_inverse=True)
    bins = Bins(size)
    room = size - np.bincount(out[kept], weights=lengths[kept]).astype(np.int64) if kept.any() else np.zeros(0, np.int64)
    bins.count = len(room)
    for number in np.flatnonzero(room).tolist():
        bins.add(number, int(room[number]))
    displaced = np.flatnonzero(~kept)
    displaced = displaced[np.argsort(-lengths[displaced], kind="stable")]
    fit = bins.fit
    out[displaced] = [fit(n) for n in lengths[displaced].tolist()]
    return out.astype(np.int32)


def evolve(lengths: np.ndarray, population: list[np.ndarray], size: int, seed: int, generations: int = GENERATIONS) -> tuple[list[np.ndarray], int]:
    """(the individuals after ``generations`` of crossover, best first; how many children took a place)."""
    rng = np.random.default_rng(seed)
    ranked = sorted(((fitness(lengths, x, size), i, x) for i, x in enumerate(population)), reverse=True)
    least, taken = -(-int(lengths.sum()) // size), 0
    for g in range(generations):
        if -ranked[0][0][0] <= least or len(ranked) < 2:
            break
        pair = [0, 1 + int(rng.integers(len(ranked) - 1))]
        i, j = pair if rng.random() < 0.5 else pair[::-1]
        child = crossover(lengths, ranked[i][2], ranked[j][2], size, rng)
        entry = (fitness(lengths, child, size), -1 - g, child)
        if entry[0] > ranked[-1][0]:
            ranked, taken = sorted([*ranked[:-1], entry], key=lambda x: x[:2], reverse=True), taken + 1
    return [x for *_, x in ranked], taken


def first_population(lengths: np.ndarray, size: int, seed: int) -> list[np.ndarray]:
    """Individuals by best fit in random orders and in blurred orders of falling length."""
    rng = np.random.default_rng(seed)
    orders = (rng.random(len(lengths)) if s is None else -lengths * (1 + s * rng.random(len(lengths))) for s in BLUR)
    return [best_fit(lengths, np.argsort(o, kind="stable"), size) for o in orders]


def grouped(shards: DataFrame, size: int) -> DataFrame:
    """(shard, own, taken): the bins of each shard's pieces after all epochs, for ``shards`` of (shard, lengths as bytes),
    and how many children took a place in its islands."""
    shape = "shard long, island int, taken long, lengths binary, population array<binary>"
    fields = pa.schema([("shard", pa.int64()), ("island", pa.int32()), ("taken", pa.int64()), ("lengths", pa.binary()), ("population", pa.list_(pa.binary()))])

    def rows(batch: pa.RecordBatch) -> Iterator[tuple[dict, np.ndarray, list[np.ndarray]]]:
        for r in batch.to_pylist():
            yield r, np.frombuffer(r["lengths"], "<i4").astype(np.int64), [np.frombuffer(x, "<i4") for x in r.get("population") or []]

    def epoch(number: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for r, lengths, population in rows(batch):
                    seed = (r["shard"] * 64 + r["island"]) * 64 + number
                    done, taken = evolve(lengths, population or first_population(lengths, size, seed), size, seed)
                    row = {"shard": r["shard"], "island": r["island"], "taken": taken + r.get("taken", 0), "lengths": r["lengths"], "population": [x.astype("<i4").tobytes() for x in done[: len(BLUR)]]}
                    yield pa.RecordBatch.from_pylist([row], fields)

        return run

    state = shards.select("shard", F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1))).alias("island"), "lengths").repartition("shard", "island")
    state = cut(state.mapInArrow(epoch(0), shape), "islands")
    for number in range(1, EPOCHS):
        elite = state.select("shard", ((F.col("island") + 1) % ISLANDS).cast("int").alias("island"), F.get("population", F.lit(0)).alias("elite"))
        state = state.join(elite, ["shard", "island"]).select("shard", "island", "taken", "lengths", F.array_append("population", F.col("elite")).alias("population"))
        state = cut(state.repartition("shard", "island").mapInArrow(epoch(number), shape), "islands")

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r, lengths, population in rows(batch):
                bins, fill = fitness(lengths, population[0], size)
                yield pa.RecordBatch.from_pylist([{"shard": r["shard"], "taken": r["taken"], "bins": bins, "fill": fill, "own": population[0].tobytes()}], pa.schema([("shard", pa.int64()), ("taken", pa.int64()), ("bins", pa.int64()), ("fill", pa.float64()), ("own", pa.binary())]))

    ranked = state.mapInArrow(best, "shard long, taken long, bins long, fill double, own binary")
    return ranked.groupBy("shard").agg(F.max_by("own", F.struct("bins", "fill")).alias("own"), F.sum("taken").alias("taken"))


def pack(docs: DataFrame, path: str, end_id: int = 0, size: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(``id_col``, piece, start, length, ids_crc32, sequence_id, offset): a row for each piece of each document.

    Ids are those of the byte-level ``tokenizers`` file at ``path`` without special tokens around a text; added tokens
    that a text holds are one id each, as the library has it.
    A null or empty text is the one id ``end_id``. Ids of documents may be null or repeated; each row is packed. An
    empty table gives an empty result. sequence_id is any number, offset the piece's place in its sequence.
    """
    all_pieces = cut(pieces(docs, path, end_id, size, id_col, text_col), "pieces")
    short = all_pieces.where(F.col("length") < size)
    n = short.count()
    shards = max(1, round(n / SHARD))
    meta = [id_col, "piece", "start", "length", "ids_crc32"]
    dealt = short.select(F.pmod(F.xxhash64(*meta, F.monotonically_increasing_id()), F.lit(shards)).alias("shard"), F.struct(*meta).alias("p"))
    held = cut(dealt.groupBy("shard").agg(F.sort_array(F.collect_list("p")).alias("ps")), "shards")

    def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [batch.column(1).slice(i, 1).flatten().to_numpy(zero_copy_only=False).astype("<i4").tobytes() for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own, pa.binary())], ["shard", "lengths"])

    bins = grouped(held.select("shard", F.col("ps.length").alias("l")).mapInArrow(lengths, "shard long, lengths binary"), size)
    kind = docs.schema[id_col].dataType.simpleString()

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                p, own = batch.column("ps").slice(i, 1).flatten(), np.frombuffer(batch.column("own")[i].as_py(), "<i4")
                length = p.field("length").to_numpy(zero_copy_only=False)
                order = np.argsort(own, kind="stable")
                before = np.cumsum(length[order]) - length[order]
                new = np.flatnonzero(np.diff(own[order], prepend=-1))
                offset = np.empty(len(own), np.int64)
                offset[order] = before - np.repeat(before[new], np.diff(np.append(new, len(own))))
                shard = batch.column("shard")[i].as_py()
                columns = [*(p.field(c) for c in meta), pa.array((np.int64(shard) << 32) + own, pa.int64()), pa.array(offset)]
                for lo in range(0, len(own), 10_000):
                    yield pa.RecordBatch.from_arrays([c.slice(lo, 10_000) for c in columns], [*meta, "sequence_id", "offset"])

    shape = f"`{id_col}` {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    packed = held.join(bins, "shard").select("shard", "ps", "own").mapInArrow(place, shape)
    full = all_pieces.where(F.col("length") == size).select(*meta, (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return packed.unionByName(full)
