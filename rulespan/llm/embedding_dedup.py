"""Near-duplicate vectors by NN-descent.

1. Equal vectors form a class; one of each goes on, with the number of its copies.
2. A neighbour graph starts from a few sets of buckets of random hyperplane signs, cut into blocks of bounded size.
3. NN-descent: every vector shows its neighbours, in both directions, to each other; better ones replace worse ones. A
   list has 12 places and grows to 48 while all its entries are links. Rounds go on while they still find links; pairs
   that met before are not compared again.
4. Lists that are full at 48 may hide further links to full lists of other components: these are searched exactly, and
   components that meet are joined.
5. The members of each component of threshold edges are compared with each other in blocks, exactly and in double
   precision. Blocks return counts and a spanning forest, never all pairs.
6. Audit: all link ends of a sample of vectors are counted by brute force against all rows in blocks. While too many
   of them are missing, more buckets and another descent follow; if that does not help, the job fails.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import components, cut

#: Places of a list of neighbours, places of one whose entries are all links, rows of a block, vectors of the audit.
NEIGHBOURS, MOST, BLOCK, AUDIT = 12, 48, 256, 1_024
#: Bucket sets of each seeding, rounds of a descent at most, and the share of new links at which it stops.
TABLES, DESCENTS, STILL = 6, 10, 0.01
#: Bytes of result rows that may be broadcast.
MOST_BYTES = 64_000_000
#: Below the threshold by so much an edge found in single precision is still looked at in double precision.
SLACK = 1e-4


def unit_vectors(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, dim, v): vectors as bytes of doubles; those that are null, empty, zero or not wholly finite have a null v."""
    x = F.col(vector_col).cast("array<double>")
    good = F.forall(x, lambda y: y.isNotNull() & ~F.isnan(y) & (F.abs(y) < float("inf"))) & F.exists(x, lambda y: y != 0)
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.when(good, x).alias("x"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v, dim = [], []
            for y in batch.column(1):
                a = np.array(y.as_py(), np.float64) if y.is_valid else None
                if a is not None:
                    a = a / np.abs(a).max()
                    a = a / np.linalg.norm(a)
                v.append(None if a is None else a.tobytes())
                dim.append(None if a is None else len(a))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(dim, pa.int32()), pa.array(v, pa.binary())], ["id", "dim", "v"])

    return rows.mapInArrow(pack, "id long, dim int, v binary")


def _matrix(values: list[bytes], kind=np.float64) -> np.ndarray:
    return np.frombuffer(b"".join(values), np.float64).reshape(len(values), -1).astype(kind, copy=False)


def _best(ids: np.ndarray, sims: np.ndarray, floor: np.ndarray, most: int, known: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(v, u, sim) of the ``most`` best others of each row above its floor; pairs of ``known`` rows have met before."""
    sims = sims.copy()
    np.fill_diagonal(sims, -2)
    if known is not None:
        sims[known[:, None] & known[None, :]] = -2
    k = min(most, len(ids) - 1)
    if k <= 0:
        return ids[:0], ids[:0], sims.ravel()[:0]
    at = np.argpartition(-sims, k - 1, axis=1)[:, :k]
    s = np.take_along_axis(sims, at, 1)
    r, c = np.nonzero(s > floor[:, None])
    return ids[r], ids[at[r, c]], s[r, c]


def seeded(vectors: DataFrame, n: int, tables: range, most: int = 4) -> DataFrame:
    """(v, u, sim) from buckets of equal signs, one set of hyperplanes for each of ``tables``."""
    bits = int(np.clip(np.log2(max(n, 2) / 16), 1, 24))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {"t": [], "key": [], "id": [], "v": []}
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims):
                part = batch.filter(pa.array(dims == dim))
                x = np.frombuffer(b"".join(part.column("w").to_pylist()), np.float32).reshape(part.num_rows, -1)
                for t in tables:
                    planes = np.random.default_rng(1000 * t + 1).standard_normal((int(dim), bits))
                    key = (x @ planes > 0) @ (1 << np.arange(bits)) + (int(dim) << 32)
                    out["t"].append(np.full(len(key), t))
                    out["key"].append(key)
                    out["id"].append(part.column("id").to_numpy())
                    out["v"] += part.column("w").to_pylist()
            if out["v"]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out["t"]), pa.int32()), pa.array(np.concatenate(out["key"]), pa.int64()), pa.array(np.concatenate(out["id"]), pa.int64()), pa.array(out["v"], pa.binary())], ["t", "key", "id", "v"])

    keyed = vectors.select("id", "dim", "w").mapInArrow(sign, "t int, key long, id long, v binary")
    size = keyed.groupBy("t", "key").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    blocked = keyed.join(size, ["t", "key"]).withColumn("block", F.pmod(F.xxhash64("t", "id"), F.col("blocks")))
    cells = blocked.groupBy("t", "key", "block").agg(F.collect_list(F.struct("id", "v")).alias("rows")).where(F.size("rows") > 1).select("rows")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for cell in batch.column("rows"):
                own = cell.values
                ids = own.field("id").to_numpy()
                x = np.frombuffer(b"".join(own.field("v").to_pylist()), np.float32).reshape(len(ids), -1)
                found.append(_best(ids, x @ x.T, np.full(len(ids), -2.0), most))
            yield _edges(found)

    return cells.mapInArrow(compare, "v long, u long, sim float")


def _edges(found: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    v, u, s = (np.concatenate([f[i] for f in found]) if found else np.zeros(0) for i in range(3))
    return pa.RecordBatch.from_arrays([pa.array(v.astype(np.int64)), pa.array(u.astype(np.int64)), pa.array(s.astype(np.float32))], ["v", "u", "sim"])


def nearest(edges: DataFrame, least: float) -> DataFrame:
    """(v, u, sim, new): the NEIGHBOURS most similar distinct edges of each v, up to MOST while they are links; new if
    none of an edge's rows is old. Surplus rows are dropped before the shuffle as well."""
    one = edges.groupBy("v", "u").agg(F.max("sim").alias("sim"), F.min("new").alias("new"))
    rank = F.row_number().over(Window.partitionBy("v").orderBy(F.desc("sim"), "u"))
    keep = (F.col("__r") <= NEIGHBOURS) | (F.col("sim") >= least - SLACK)
    return one.withColumn("__r", rank).where(F.col("__r") <= MOST).where(keep).drop("__r")


def descended(graph: DataFrame, vectors: DataFrame, least: float, most: int = 6) -> DataFrame:
    """One round: the neighbours of each vector, in both directions, are compared with each other unless both are old;
    better ones join."""
    at = F.min("sim")
    floor = F.when(F.count("*") >= MOST, at).when((F.count("*") >= NEIGHBOURS) & (at < least - SLACK), at).when(F.count("*") >= NEIGHBOURS, least - SLACK).otherwise(-2.0)
    known = vectors.select("id", "w").join(graph.groupBy(F.col("v").alias("id")).agg(floor.cast("float").alias("floor")), "id", "left").select("id", F.coalesce("floor", F.lit(-2.0).cast("float")).alias("floor"), "w")
    forward = graph.select(F.col("v").alias("mid"), F.col("u").alias("id"), "new")
    back = F.row_number().over(Window.partitionBy("u").orderBy(F.desc("new"), F.desc("sim"), "v"))
    backward = graph.withColumn("__r", back).where(F.col("__r") <= NEIGHBOURS).select(F.col("u").alias("mid"), F.col("v").alias("id"), "new")
    shown = forward.unionByName(backward).groupBy("mid", "id").agg(F.min("new").alias("new"))
    cells = shown.join(known, "id").groupBy("mid").agg(F.collect_list(F.struct("id", "floor", "new", "w")).alias("rows")).where(F.exists("rows", lambda r: r["new"]) & (F.size("rows") > 1)).select("rows")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for cell in batch.column("rows"):
                own = cell.values
                ids = own.field("id").to_numpy()
                x = np.frombuffer(b"".join(own.field("w").to_pylist()), np.float32).reshape(len(ids), -1)
                found.append(_best(ids, x @ x.T, own.field("floor").to_numpy(), most, ~own.field("new").to_numpy(zero_copy_only=False)))
            yield _edges(found)

    better = cells.mapInArrow(compare, "v long, u long, sim float").withColumn("new", F.lit(True))
    return nearest(graph.withColumn("new", F.lit(False)).unionByName(better), least)


def converged(graph: DataFrame, vectors: DataFrame, least: float) -> DataFrame:
    """The graph after rounds of descent, until fewer than STILL of its links are new."""
    links = F.count_if(F.col("sim") >= least - SLACK)
    for _ in range(DESCENTS):
        graph = cut(descended(graph, vectors, least), "neighbours")
        r = graph.agg(links.alias("n"), F.count_if((F.col("sim") >= least - SLACK) & F.col("new")).alias("new")).first()
        if r["new"] <= STILL * r["n"]:
            break
    return graph


def audited(links: DataFrame, vectors: DataFrame, least: float) -> float:
    """The smaller of two shares, by brute force over the audited vectors: of their link ends, those in ``links``, and of
    the vectors with a link, those with no link end missing; 1 if none of them has a link."""
    sample = vectors.orderBy(F.xxhash64("id")).limit(AUDIT).collect()
    by_dim: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for dim in {r["dim"] for r in sample}:
        rows = [r for r in sample if r["dim"] == dim]
        by_dim[dim] = np.array([r["id"] for r in rows]), _matrix([bytes(r["v"]) for r in rows])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim, (ids, q) in by_dim.items():
                part = batch.filter(pa.array(dims == dim))
                if part.num_rows:
                    near = q @ _matrix(part.column("v").to_pylist()).T >= least
                    near[ids[:, None] == part.column("id").to_numpy()[None, :]] = False
                    count = near @ part.column("copies").to_numpy()
                    ok = count > 0
                    yield pa.RecordBatch.from_arrays([pa.array(ids[ok]), pa.array(count[ok])], ["v", "true"])

    true = vectors.mapInArrow(search, "v long, true long").groupBy("v").agg(F.sum("true").alias("true"))
    have = F.least(F.coalesce("links", F.lit(0)), "true")
    r = true.join(links, "v", "left").agg(F.count("*").alias("n"), F.sum((have == F.col("true")).cast("long")).alias("whole"), F.sum("true").alias("ends"), F.sum(have).alias("found")).first()
    return min(r["whole"] / r["n"], r["found"] / r["ends"]) if r["n"] else 1.0


def bridged(graph: DataFrame, label: DataFrame, vectors: DataFrame, least: float) -> DataFrame:
    """(a, b): pairs of components that links between saturated vectors may join.

    A vector is saturated if all places of its list are links. Any other has all its links in its list, so a link that
    neither list has lies between two saturated vectors. These are cut, component by component, into balls of bounded
    size. Balls whose centres are further apart than their radii and the threshold allow hold no link; the members of
    all others are compared exactly.
    """
    full = graph.groupBy("v").agg(F.count("*").alias("k"), F.min("sim").alias("floor")).where((F.col("k") >= MOST) & (F.col("floor") >= least - SLACK))
    m = full.select(F.col("v").alias("id")).join(label.withColumnRenamed("node", "id"), "id").join(vectors.select("id", "dim", "v"), "id")
    size = m.groupBy("component").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    m = m.join(size, "component").withColumn("part", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    m = m.groupBy("component", "part", "dim").agg(F.collect_list("v").alias("rows"))

    def enclose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            center, radius, members = [], [], []
            for rows in batch.column("rows"):
                x = _matrix(rows.values.to_pylist())
                c = x.mean(0)
                c = c / norm if (norm := np.linalg.norm(c)) > 0 else x[0]
                center.append(c.tobytes())
                radius.append(float(np.arccos(np.clip(x @ c, -1, 1)).max()))
                members.append(x.tobytes())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("component", "part", "dim")), pa.array(center, pa.binary()), pa.array(radius, pa.float64()), pa.array(members, pa.binary())], ["component", "part", "dim", "center", "radius", "x"])

    balls = cut(m.mapInArrow(enclose, "component long, part int, dim int, center binary, radius double, x binary"), "balls")
    blocks = -(-balls.count() // BLOCK)
    own = F.pmod(F.xxhash64("component", "part"), F.lit(max(blocks, 1))).cast("int").alias("own")
    dealt = balls.select("component", "part", "dim", "center", "radius", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(max(blocks, 1) - 1))))
    cells = dealt.groupBy("dim", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j")).agg(F.collect_list(F.struct("component", "part", "own", "center", "radius")).alias("rows")).select("i", "j", "rows")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, cell in zip(batch.column("i").to_pylist(), batch.column("j").to_pylist(), batch.column("rows"), strict=True):
                rows = cell.values
                component, part, own, radius = (rows.field(c).to_numpy() for c in ("component", "part", "own", "radius"))
                x = _matrix(rows.field("center").to_pylist())
                reach = np.arccos(np.clip(least - SLACK, -1, 1)) + radius[:, None] + radius[None, :]
                ok = np.triu((np.arccos(np.clip(x @ x.T, -1, 1)) <= reach + 1e-6) & (component[:, None] != component[None, :]))
                if i != j:  # pairs inside one block belong to its own cell
                    ok &= own[:, None] != own[None, :]
                p, q = np.nonzero(ok)
                yield pa.RecordBatch.from_arrays([pa.array(y) for y in (component[p], part[p], component[q], part[q])], ["a", "pa", "b", "pb"])

    pairs = cut(cells.mapInArrow(meet, "a long, pa int, b long, pb int"), "ball-pairs")
    left = balls.select(F.col("component").alias("a"), F.col("part").alias("pa"), "dim", F.col("x").alias("xa"))
    right = balls.select(F.col("component").alias("b"), F.col("part").alias("pb"), F.col("x").alias("xb"))
    both = pairs.join(left, ["a", "pa"]).join(right, ["b", "pb"]).select("a", "b", "dim", "xa", "xb")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for dim, x, y in zip(batch.column("dim").to_pylist(), batch.column("xa"), batch.column("xb"), strict=True):
                x, y = (np.frombuffer(z.as_py(), np.float64).reshape(-1, dim) for z in (x, y))
                ok.append(bool((x @ y.T).max() >= least - SLACK))
            keep = batch.filter(pa.array(ok, pa.bool_()))
            yield pa.RecordBatch.from_arrays([keep.column("a"), keep.column("b")], ["a", "b"])

    return cut(both.mapInArrow(compare, "a long, b long").distinct(), "bridges")


def linked_within(label: DataFrame, vectors: DataFrame, least: float) -> tuple[DataFrame, DataFrame]:
    """(v, links) and (a, b): for each member of a component its links inside it, counted with copies, and edges that
    span what is linked."""
    m = label.join(vectors, label["node"] == vectors["id"]).select("component", "id", "copies", "v")
    size = m.groupBy("component").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    m = m.join(size, "component").withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    m = m.select("component", "id", "copies", "v", "own", other)
    pair: Column = F.struct(F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    cells = m.groupBy("component", pair.alias("cell")).agg(F.collect_list(F.struct("id", "copies", "v", "own")).alias("rows")).select(F.col("cell.i").alias("i"), F.col("cell.j").alias("j"), "rows")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, cell in zip(batch.column("i").to_pylist(), batch.column("j").to_pylist(), batch.column("rows"), strict=True):
                rows = cell.values
                ids, copies, own = (rows.field(c).to_numpy() for c in ("id", "copies", "own"))
                x = _matrix(rows.field("v").to_pylist())
                near = x @ x.T >= least
                np.fill_diagonal(near, False)
                if i != j:  # pairs inside one block belong to its own cell
                    near &= own[:, None] != own[None, :]
                count = near @ copies
                parent = list(range(len(ids)))

                def root(k: int, parent: list[int] = parent) -> int:
                    while parent[k] != k:
                        parent[k] = parent[parent[k]]
                        k = parent[k]
                    return k

                a, b = [], []
                for p in range(len(ids)):
                    for q in np.flatnonzero(near[p, :p]).tolist():
                        rp, rq = root(p), root(q)
                        if rp != rq:
                            parent[rp] = rq
                            a.append(ids[p])
                            b.append(ids[q])
                n = len(ids)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([ids, np.array(a, np.int64)])), pa.array([*[None] * n, *b], pa.int64()), pa.array([*count.tolist(), *[None] * len(a)], pa.int64())], ["v", "u", "links"])

    out = cut(cells.mapInArrow(compare, "v long, u long, links long"), "links")
    return out.where("u is null").groupBy("v").agg(F.sum("links").alias("links")), out.where("u is not null").select(F.col("v").alias("a"), F.col("u").alias("b"))


def _single(vectors: DataFrame) -> DataFrame:
    """``vectors`` with w, v in single precision: half the bytes for the steps that only search."""

    def halve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            w = [np.frombuffer(v, np.float64).astype(np.float32).tobytes() for v in batch.column("v").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(w, pa.binary())], [*batch.schema.names, "w"])

    return vectors.mapInArrow(halve, "id long, dim int, copies long, v binary, w binary")


def near_duplicate_vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", least: float = 0.9, target: float = 0.99, floor: float = 0.9, rounds: int = 4) -> DataFrame:
    """One row per row of ``df``: ``id_col``, n_links (other rows linked directly), component_id (smallest id reachable)
    and kept (its id is component_id).

    Rows are linked if the cosine of their vectors in double precision is at least ``least``. Vectors that are null,
    empty, zero or hold null or non-finite components are linked with nothing, and so are vectors of different lengths.
    Ids should be unique: rows that repeat one are links of each other if their vectors are; a row without an id is
    kept, without links. Other columns are not looked at, and an empty table gives an empty result. Links are searched
    until a brute-force audit of 1024 vectors finds ``target`` of their link ends, and of the linked ones as many with
    none missing. After ``rounds`` rounds that do not reach it, less than ``floor`` is an error.
    """
    rows = cut(unit_vectors(df, id_col, vector_col), "vectors")
    good = rows.where("v is not null and id is not null")
    classes = good.groupBy("dim", "v").agg(F.min("id").alias("class"), F.count("*").alias("copies"))
    vectors = cut(_single(classes.select(F.col("class").alias("id"), "dim", "copies", "v")), "vector-classes")
    n = vectors.count()
    graph = None
    for r in range(rounds):
        found = seeded(vectors, n, range(TABLES * r, TABLES * (r + 1))).withColumn("new", F.lit(True))
        graph = cut(nearest(found if graph is None else graph.withColumn("new", F.lit(False)).unionByName(found), least), "neighbours")
        graph = converged(graph, vectors, least)
        close = graph.where(F.col("sim") >= least - SLACK).select(F.col("v").alias("a"), F.col("u").alias("b"))
        label = components(close)
        bridges = bridged(graph, label, vectors, least)
        if not bridges.isEmpty():
            joined = components(bridges).select(F.col("node").alias("component"), F.col("component").alias("__joined"))
            label = label.join(joined, "component", "left").select("node", F.coalesce("__joined", "component").alias("component"))
        links, forest = linked_within(label, vectors, least)
        recall = audited(links, vectors, least)
        if recall >= target:
            break
    else:
        if recall < floor:
            raise RuntimeError(f"the audit finds {recall:.3f} of the links after {rounds} rounds")
    label = components(forest)
    of_class = vectors.select("id", "copies", "v", "dim").join(links.select(F.col("v").alias("id"), "links"), "id", "left").join(label.select(F.col("node").alias("id"), "component"), "id", "left")
    of_class = of_class.select("dim", "v", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    size = vectors.agg(F.sum(F.length("v") + 64)).first()[0] or 0
    out = rows.withColumn("__ok", F.col("v").isNotNull() & F.col("id").isNotNull()).join(F.broadcast(of_class) if size <= MOST_BYTES else of_class, ["dim", "v"], "left")
    component = F.when(F.col("__ok"), F.col("component_id")).otherwise(F.col("id"))
    return out.select(F.col("id").alias(id_col), F.when(F.col("__ok"), F.col("n_links")).otherwise(0).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))
