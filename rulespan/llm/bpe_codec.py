"""Byte-level BPE encoding and decoding through one global shuffle of distinct words.

1. Documents are cut into chunks. A chunk explodes into its distinct pre-tokens with their positions in the chunk;
   the positions stay with the chunk (as codes), only the distinct words go to the shuffle.
2. Every distinct word of the whole table is encoded exactly once. Hot words are a single row per chunk before the
   shuffle and one row after a partial aggregation, whatever their frequency.
3. The ids go back to the chunks and every chunk is reassembled by position.
4. Decoding joins the distinct ids of a chunk with the table of token bytes; that table is broadcast, its size is that of
   the vocabulary, which is checked. A broadcast join keeps rows in order, so that the tokens of a chunk go ahead of its
   documents, whose bytes are put together by position without a shuffle; a document whose tokens are not there fails.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .pretokens import gather, groups, rank_words, tokenised
from .shared import cut

#: Largest vocabulary whose table of bytes is broadcast.
MOST_TOKENS = 2_000_000
#: A chunk ends when it has so many pre-tokens; words that a task remembers; most buckets of words.
CHUNK, KNOWN, BUCKETS = 2_000_000, 1_000_000, 4_096


def token_table(spark: SparkSession, path: str) -> DataFrame:
    """(token, bytes) of every rank of the file at ``path``."""
    with open(path, "rb") as f:
        ranks = sorted((int(rank), base64.b64decode(token)) for token, rank in (line.split() for line in f if line.strip()))
    if len(ranks) > MOST_TOKENS:
        raise ValueError(f"a vocabulary of {len(ranks)} tokens is more than {MOST_TOKENS}")
    return spark.createDataFrame(pa.table({"token": pa.array([r for r, _ in ranks], pa.int32()), "bytes": pa.array([b for _, b in ranks], pa.binary())}))


def _shut(values: np.ndarray) -> bytes:
    """Unsigned 32-bit values, compressed with the bytes of one weight together."""
    return zstandard.compress(values.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), 3)


def _opened(data: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(data), np.uint8).reshape(4, -1).T.copy().view("<u4").ravel()


def _packed(words: list[str]) -> bytes:
    """Byte lengths of the words and the words, as one value."""
    data = [w.encode("utf-8", "surrogatepass") for w in words]
    return zstandard.compress(np.array([len(words), *map(len, data)], "<u4").tobytes() + b"".join(data), 3)


def _unpacked(data: bytes) -> list[str]:
    value = zstandard.decompress(data)
    n = int.from_bytes(value[:4], "little")
    at = 4 + 4 * n + np.concatenate([[0], np.cumsum(np.frombuffer(value, "<u4", n, 4), dtype=np.int64)])
    return [value[i:j].decode("utf-8", "surrogatepass") for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


def exploded(docs: DataFrame, id_col: str, text_col: str, buckets: int, words_only: bool) -> DataFrame:
    """(chunk, bucket, words, place, ids, lengths, codes): a chunk's rows.

    Bucket -1 has the chunk's documents: ids, how many pre-tokens each has, and for every pre-token in order which
    of the chunk's words it is. Each other bucket has those distinct words of the chunk whose hash falls into it, and
    their numbers. ``words_only``: the rows of these buckets, else that of the documents. Either pass makes the same
    chunks, named by partition and place; the table must be read, not shuffled, for the names to agree and to survive
    the retry of a task. The second pass costs less than keeping the codes of all documents on disk twice.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, place = None, 0
        names, lengths, codes, seen, where, size = [], [], [], {}, [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            chunk = (part << 32) + place
            if words_only:
                by, words = np.array(where, np.int64), list(seen)
                order = np.argsort(by, kind="stable")
                cuts = np.flatnonzero(np.diff(by[order], prepend=-1))
                own = [order[i:j] for i, j in zip(cuts, [*cuts[1:], len(order)], strict=True)]
                columns = [pa.array([int(by[g[0]]) for g in own], pa.int32()), pa.array([_packed([words[i] for i in g.tolist()]) for g in own], pa.binary()), pa.array([_shut(np.diff(g, prepend=0)) for g in own], pa.binary())]
                yield pa.RecordBatch.from_arrays([pa.array([chunk] * len(own), pa.int64()), *columns], ["chunk", "bucket", "words", "place"])
            else:
                ids = pa.concat_arrays([x.cast(names[0].type) for x in names])
                columns = [pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), pa.array([_shut(np.array(lengths, np.uint32))], pa.binary()), pa.array([_shut(np.concatenate(codes))], pa.binary())]
                yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), pa.array([-1], pa.int32()), *columns], ["chunk", "bucket", "ids", "lengths", "codes"])

        for batch in batches:
            if part is None and batch.num_rows:
                part = batch.column(2)[0].as_py()
            texts = batch.column(1)
            for lo, hi in groups([len(t.as_py() or "") for t in texts]):
                words, h, which, tokens = tokenised([t.as_py() or "" for t in texts.slice(lo, hi - lo)])
                own = np.empty(len(words), np.uint32)
                for i, (w, b) in enumerate(zip(words, (h % np.uint64(buckets)).tolist(), strict=True)):
                    k = seen.get(w)
                    if k is None:
                        k = seen[w] = len(seen)
                        where.append(b)
                    own[i] = k
                if not words_only:
                    codes.append(own[which])
                names.append(batch.column(0).slice(lo, hi - lo))
                lengths += tokens.tolist()
                size += len(which)
                if size >= CHUNK:
                    yield from flush()
                    place += 1
                    names, lengths, codes, seen, where, size = [], [], [], {}, [], 0
        if names:
            yield from flush()

    # the partition as the scan numbers it: a task of a union has another number
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.spark_partition_id().alias("part"))
    return own.mapInArrow(explode, "chunk long, bucket int, words binary, place binary" if words_only else f"chunk long, bucket int, ids array<{kind}>, lengths binary, codes binary")


def encode_words(words: DataFrame, path: str, pattern: str, buckets: int) -> DataFrame:
    """(chunk, bucket, place, sizes, flat): the ids of every word. All chunks' words of a bucket are in one task, which
    encodes each distinct word once, as long as it remembers it: past KNOWN words it starts anew, to bound memory."""

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = rank_words(path, pattern)
        known: dict[str, list[int]] = {}
        for batch in batches:
            sizes, flat = [], []
            for packed in batch.column("words"):
                size, ids = [], []
                if len(known) > KNOWN:
                    known = {}
                for w in _unpacked(packed.as_py()):
                    x = known.get(w)
                    if x is None:
                        x = known[w] = encode(w)
                    size.append(len(x))
                    ids += x
                sizes.append(_shut(np.array(size, np.uint32)))
                flat.append(_shut(np.array(ids, np.uint32)))
            yield pa.RecordBatch.from_arrays([batch.column("chunk"), batch.column("bucket"), batch.column("place"), pa.array(sizes, pa.binary()), pa.array(flat, pa.binary())], ["chunk", "bucket", "place", "sizes", "flat"])

    few = buckets <= int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (words.repartition("bucket") if few else words.repartition(buckets, "bucket")).mapInArrow(look_up, "chunk long, bucket int, place binary, sizes binary, flat binary")


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", from_files: bool = False, tokens: bool = False) -> DataFrame:
    """(``id_col``, n_tokens, ids) of every document by the ranks at ``path``.

    Each match of the pattern is encoded by itself and special tokens are ordinary text, as in the library; another
    pattern than that of the vocabularies is an error. A null or empty text has no ids, a text of any length is one row,
    and an empty table gives an empty result. Ids of documents may be null or repeated; each row gives one row. Other
    columns are not looked at. The rows are read twice and must come in the same order both times: they are written as a
    table first, unless ``from_files`` says that ``docs`` is nothing but a scan of files with narrow steps. With ``tokens`` the
    rows of each chunk come after rows of __token, its distinct ids, as :func:`decode` wants them.
    """
    rank_words(path, pattern)
    docs = docs.select(id_col, text_col)
    if not from_files:
        docs = cut(docs, "codec-input")
    buckets = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(BUCKETS, docs.rdd.getNumPartitions()))
    encoded = encode_words(exploded(docs, id_col, text_col, buckets, True), path, pattern, buckets)
    texts = exploded(docs, id_col, text_col, buckets, False).withColumn("bucket", F.lit(1 << 30))
    both = encoded.unionByName(texts, allowMissingColumns=True)
    kind = docs.schema[id_col].dataType.simpleString()

    def reassemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, sizes, flat = [], [], []
        for batch in batches:
            for i in range(batch.num_rows):
                codes = batch.column("codes")[i].as_py()
                if codes is None:
                    place.append(np.cumsum(_opened(batch.column("place")[i].as_py()), dtype=np.int64))
                    sizes.append(_opened(batch.column("sizes")[i].as_py()))
                    flat.append(_opened(batch.column("flat")[i].as_py()))
                    continue
                at, n, every = (np.concatenate(x) if x else np.zeros(0, np.uint32) for x in (place, sizes, flat))
                place, sizes, flat = [], [], []
                begin = np.concatenate([[0], np.cumsum(n, dtype=np.int64)])
                slot = np.empty(len(at), np.int64)
                slot[at] = np.arange(len(at))
                which = _opened(codes)
                lengths = _opened(batch.column("lengths")[i].as_py()).astype(np.int64)
                to = np.concatenate([[0], np.cumsum(lengths)])
                ids = batch.column("ids").slice(i, 1).flatten()
                if tokens:
                    yield _token_rows(np.unique(every), ids.type, "id")
                for lo in range(0, len(lengths), 256):
                    hi = min(len(lengths), lo + 256)
                    out, each = gather(every, begin, slot[which[to[lo] : to[hi]]], lengths[lo:hi])
                    ends = np.concatenate([[0], np.cumsum(each)])
                    lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(out.view(np.int32)))
                    columns = [ids.slice(lo, hi - lo), pa.array(each, pa.int64()), lists, pa.nulls(hi - lo, pa.int32())]
                    yield pa.RecordBatch.from_arrays(columns[: 3 + tokens], ["id", "n_tokens", "ids", "__token"][: 3 + tokens])

    together = both.repartition("chunk").sortWithinPartitions("chunk", "bucket")
    shape = f"id {kind}, n_tokens long, ids array<int>" + ", __token int" * tokens
    return together.select("bucket", "place", "sizes", "flat", "ids", "lengths", "codes").mapInArrow(reassemble, shape).withColumnRenamed("id", id_col)


def _token_rows(token: np.ndarray, kind: pa.DataType, id_col: str) -> pa.RecordBatch:
    n = len(token)
    return pa.RecordBatch.from_arrays([pa.nulls(n, kind), pa.nulls(n, pa.int64()), pa.nulls(n, pa.list_(pa.int32())), pa.array(token.astype(np.int32))], [id_col, "n_tokens", "ids", "__token"])


def with_tokens(encoded: DataFrame, ids_col: str = "ids") -> DataFrame:
    """``encoded`` in chunks of CHUNK ids or more, and ahead of each chunk its distinct ids, as rows of __token."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            flat = [b.column(ids_col).flatten().to_numpy(zero_copy_only=False) for b in held]
            token = np.unique(np.concatenate(flat))
            yield pa.RecordBatch.from_arrays([*(pa.nulls(len(token), f.type) for f in held[0].schema), pa.array(token.astype(np.int32))], [*held[0].schema.names, "__token"])
            for b in held:
                yield pa.RecordBatch.from_arrays([*b.columns, pa.nulls(b.num_rows, pa.int32())], [*b.schema.names, "__token"])

        for batch in batches:
            held.append(batch)
            size += len(batch.column(ids_col).flatten())
            if size >= CHUNK:
                yield from flush()
                held, size = [], 0
        if held:
            yield from flush()

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema)
    return encoded.mapInArrow(run, f"{fields}, __token int")


def _decoded(rows: DataFrame, path: str, own: list[str], ids_col: str, made: list[tuple[str, pa.DataType]], finish: Callable[[np.ndarray, np.ndarray], tuple]) -> DataFrame:
    """``own`` columns of the rows of :func:`with_tokens` and ``made`` ones, ``finish(ids, bytes)`` of each row."""
    table = F.broadcast(token_table(rows.sparkSession, path))
    joined = rows.join(table, rows["__token"] == table["token"], "left").select(*dict.fromkeys([*own, ids_col]), "__token", "bytes")

    def glue(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat, begin, slot, fresh = np.zeros(0, np.uint8), np.zeros(1, np.int64), np.zeros(0, np.int64), False
        for batch in batches:
            is_token = np.asarray(batch.column("__token").is_valid())
            cuts = [0, *(np.flatnonzero(np.diff(is_token)) + 1).tolist(), batch.num_rows] if batch.num_rows else []
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                part = batch.slice(lo, hi - lo)
                if is_token[lo]:
                    if part.column("bytes").null_count:
                        raise ValueError("an id is not in the vocabulary")
                    if not fresh:  # a new chunk
                        flat, begin, slot = np.zeros(0, np.uint8), np.zeros(1, np.int64), np.zeros(0, np.int64)
                    token, data = part.column("__token").to_numpy(), part.column("bytes").to_pylist()
                    if token.max() >= len(slot):
                        slot = np.concatenate([slot, np.full(int(token.max()) + 1 - len(slot), -1, np.int64)])
                    slot[token] = len(begin) - 1 + np.arange(len(token))
                    begin = np.concatenate([begin, begin[-1] + np.cumsum([len(x) for x in data], dtype=np.int64)])
                    flat = np.concatenate([flat, np.frombuffer(b"".join(data), np.uint8)])
                    fresh = True
                    continue
                fresh, values = False, []
                for x in part.column(ids_col):
                    if not x.is_valid:
                        values.append((None,) * len(made))
                        continue
                    ids = x.values.to_numpy()
                    if len(ids) and (ids.min() < 0 or ids.max() >= len(slot) or slot[ids].min() < 0):
                        raise ValueError("an id has no token row in its chunk")
                    values.append(finish(ids, gather(flat, begin, slot[ids], np.array([len(ids)]))[0]))
                columns = [pa.array([v[i] for v in values], kind) for i, (_, kind) in enumerate(made)]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in own), *columns], [*own, *(n for n, _ in made)])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*own).schema]
    return joined.mapInArrow(glue, ", ".join([*fields, *(f"`{n}` {k}" for n, k in made)]))


def decode(encoded: DataFrame, path: str, ids_col: str = "ids") -> DataFrame:
    """``encoded`` with data: the bytes that the ids in ``ids_col`` stand for. A null gives a null, no ids no bytes; an
    id outside the vocabulary is an error. A column of that name is replaced; repeated rows are kept, and an empty table
    gives an empty result."""
    own = [c for c in encoded.columns if c != "data"]
    return _decoded(with_tokens(encoded.select(*own), ids_col), path, own, ids_col, [("data", pa.binary())], lambda ids, data: (data.tobytes(),))


@lru_cache(2)
def _decimals(n: int) -> tuple[np.ndarray, np.ndarray]:
    each = [b"%d," % i for i in range(n)]
    return np.frombuffer(b"".join(each), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in each])])


def digests(encoded: DataFrame, path: str, id_col: str = "doc_id") -> DataFrame:
    """(``id_col``, n_tokens, ids_sha256, decoded_sha256): digests of the decimal ids joined by commas, and of the bytes
    that decoding the ids gives, for what :func:`encode` gives with tokens or without. Decoded bytes never leave the task.
    """

    def digest(ids: np.ndarray, data: np.ndarray) -> tuple[str, str]:
        flat, begin = _decimals(max(1 << 16, 1 << int(ids.max() + 1).bit_length()) if len(ids) else 1 << 16)
        shown = gather(flat, begin, ids.astype(np.int64), np.array([len(ids)]))[0].tobytes()[:-1]
        return hashlib.sha256(shown).hexdigest(), hashlib.sha256(data.tobytes()).hexdigest()

    rows = encoded if "__token" in encoded.columns else with_tokens(encoded.select(id_col, "n_tokens", "ids"))
    return _decoded(rows, path, [id_col, "n_tokens"], "ids", [("ids_sha256", pa.string()), ("decoded_sha256", pa.string())], digest)
