"""Removal of every byte that lies in a repeated string of a given length, by a difference-cover sort of suffixes.

Only prefixes of `length` bytes matter, so the suffix order is built to that depth. The sample is a perfect difference
set of a large period instead of the classic triples: for any two places there is a shift below the period that
takes both into the sample. Blocks of length - period + 1 bytes at the sampled places are sorted and named; if two
strings of `length` bytes are equal, some sampled block of the one has the name of a block at the same shift in the
other. The remaining suffixes that can be repeated are those around a block whose name occurs twice; they are placed by
their whole prefix, and equal prefixes end up adjacent. Both sorts run in hash buckets of bounded size, fed by chunks of
about a megabyte of text; a chunk sends each name once, however often it holds it, so a passage that a third of all
documents share costs a bucket one entry a chunk. Equal documents go through the second sort as one.

Names are 64-bit hashes (48 of them in the first sort, which only narrows the search), so bytes are never compared themselves: among n
places that the second sort names, n * n / 2^65 pairs are taken for equal by chance. Lineage is cut with tables in the shared folder.

Defined results: null and empty texts, and texts shorter than `length`, lose nothing; repeated rows are separate
documents, so each loses what the other has too; an empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridimpact.llm.common import discard, release_shuffles, text_or_empty, written

_U = np.uint64
CHUNK_BYTES = 1 << 20
#: A text that more documents have than MANY, and than one in MOST of all, meets its copies by a broadcast of bounded size.
MANY, MOST = 64, 100_000
#: Names that one bucket sorts.
BUCKET_NAMES = 2_000_000


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def difference_set(q: int) -> tuple[int, list[int]]:
    """Period q*q+q+1 and q+1 residues whose differences are all residues, for a prime q: a line in the powers of a cubic's root."""
    v = q * q + q + 1
    for a in range(q):
        for b in range(q):
            for c in range(1, q):
                x, line = (1, 0, 0), []
                for i in range(v):
                    if x[2] == 0:
                        line.append(i)
                    x = (x[2] * c % q, (x[0] + x[2] * b) % q, (x[1] + x[2] * a) % q)
                if len(line) == q + 1 and len({(i - j) % v for i in line for j in line}) == v:
                    return v, line
    raise ValueError(f"no difference set found for {q}")


def cover_for(length: int) -> tuple[int, list[int]]:
    """The widest cover that leaves blocks of a third of the length."""
    best = (1, [0])
    for q in (2, 3, 5, 7, 11, 13, 17, 19, 23):
        if q * q + q + 1 <= 2 * length // 3:
            best = difference_set(q)
    return best


def names_at(raw: np.ndarray, places: np.ndarray, size: int) -> np.ndarray:
    """A hash of the `size` bytes at each place."""
    out = np.full(len(places), size, np.uint64)
    words = np.ndarray((max(0, len(raw) - 7),), np.dtype("<u8"), raw, strides=(1,)) if size >= 8 and len(places) else raw
    for k in range(size) if size < 8 else [*range(0, size - 7, 8), *([size - 8] if size % 8 else [])]:
        out = mixed(out ^ words[places + k].astype(np.uint64))
    return out


def sampled_places(n: int, length: int, cover: tuple[int, list[int]]) -> np.ndarray:
    """Sampled places of a text of n bytes whose block fits in, in order."""
    period, residues = cover
    last = n - (length - period + 1)
    if n < length or last < 0:
        return np.zeros(0, np.int64)
    places = (np.arange(0, last + 1, period)[:, None] + np.array(residues)[None, :]).ravel()
    return places[places <= last]


def covered_starts(n: int, hits: np.ndarray, length: int, period: int) -> np.ndarray:
    """Starts of strings of `length` bytes that hold the block at a hit."""
    if n < length or not len(hits):
        return np.zeros(0, np.int64)
    step = np.zeros(n + 2, np.int32)
    np.add.at(step, np.maximum(hits - (period - 1), 0), 1)
    np.add.at(step, hits + 1, -1)
    starts = np.flatnonzero(np.cumsum(step[:n]) > 0)
    return starts[starts <= n - length]


def _blobs(values: list[bytes]) -> pa.Array:
    return pa.array(values, pa.binary())


def _lists(parts: list, kind: pa.DataType) -> pa.Array:
    return pa.array(parts, pa.list_(kind))


def chunked(docs: DataFrame, id_col: str) -> DataFrame:
    """chunk, ids, keys (16 bytes of each text's digest), sizes, body: rows of about CHUNK_BYTES, a longer text by itself."""
    rows = docs.select(F.col(id_col).alias("id"), F.encode(text_or_empty(), "UTF-8").alias("body"))
    id_type = rows.schema[0].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        context, count = TaskContext.get(), 0
        ids: list = []
        bodies: list[bytes] = []
        held = 0

        def row() -> pa.RecordBatch:
            keys = [hashlib.sha256(b).digest()[:16] for b in bodies]
            at = pa.array([(context.partitionId() << 33) + count], pa.int64())
            columns = [at, pa.array([ids], pa.list_(kind)), _lists([keys], pa.binary()), _lists([[len(b) for b in bodies]], pa.int64()), _blobs([b"".join(bodies)])]
            return pa.RecordBatch.from_arrays(columns, ["chunk", "ids", "keys", "sizes", "body"])

        for batch in batches:
            kind = batch.schema.field(0).type
            for i, body in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                body = body.as_py()
                if bodies and held + len(body) > CHUNK_BYTES:
                    yield row()
                    count, held = count + 1, 0
                    ids, bodies = [], []
                ids.append(i)
                bodies.append(body)
                held += len(body)
        if bodies:
            yield row()

    schema = T.StructType(
        [
            T.StructField("chunk", T.LongType()),
            T.StructField("ids", T.ArrayType(id_type)),
            T.StructField("keys", T.ArrayType(T.BinaryType())),
            T.StructField("sizes", T.ArrayType(T.LongType())),
            T.StructField("body", T.BinaryType()),
        ]
    )
    return rows.mapInArrow(run, schema)


def _packed(names: np.ndarray, width: int) -> bytes:
    return names.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def _unpacked(data: bytes, width: int) -> np.ndarray:
    out = np.zeros((len(data) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(data, np.uint8).reshape(-1, width)
    return out.view("<u8").ravel()


def _bucket(names: np.ndarray, n: int) -> np.ndarray:
    """The bucket of each name by its high bits, so it rises with the name."""
    return (((names >> _U(32)) * _U(n)) >> _U(32)).astype(np.int64)


def _in_buckets(chunk: int, names: np.ndarray, n: int, width: int) -> pa.RecordBatch:
    """A chunk's distinct names dealt into those buckets that get one: the work is that of the names, however many buckets there are."""
    bucket = _bucket(names, n)
    edges = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]])) if len(names) else np.zeros(1, np.int64)
    packed, full = _packed(names, width), bucket[edges[:-1]]
    rows = [packed[i * width : j * width] for i, j in zip(edges[:-1], edges[1:], strict=True)]
    return pa.RecordBatch.from_arrays(
        [pa.array(full, pa.int32()), pa.array([chunk] * len(full), pa.int64()), _blobs(rows)], ["bucket", "chunk", "names"]
    )


def repeated_names(dealt: DataFrame, width: int) -> DataFrame:
    """chunk, found: for each chunk the buckets with a bit for each of its names there, set if another chunk has it too."""

    def run(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        parts = [_unpacked(x, width) for x in group.column("names").to_pylist()]
        names = np.concatenate(parts)
        order = np.argsort(names, kind="stable")
        same = names[order[1:]] == names[order[:-1]]  # neighbours in order
        twice = np.zeros(len(names), bool)
        twice[order[1:]] |= same
        twice[order[:-1]] |= same
        ends = np.cumsum([0, *map(len, parts)])
        rows = [(b, c, np.packbits(twice[i:j]).tobytes()) for b, c, i, j in zip(group.column("bucket").to_pylist(), group.column("chunk").to_pylist(), ends[:-1], ends[1:], strict=True) if twice[i:j].any()]
        return pa.table({"chunk": pa.array([r[1] for r in rows], pa.int64()), "bucket": pa.array([r[0] for r in rows], pa.int32()), "bits": _blobs([r[2] for r in rows])})

    found = dealt.groupBy("bucket").applyInArrow(run, "chunk long, bucket int, bits binary")
    return found.groupBy("chunk").agg(F.collect_list(F.struct("bucket", "bits")).alias("found"))  # a row a bucket for each megabyte


def _marks(names: np.ndarray, twice_here: np.ndarray, found: list | None, n: int) -> np.ndarray:
    """Of a chunk's distinct names, those that occur twice here or elsewhere too."""
    marks = twice_here.copy()
    found, bucket = found or [], _bucket(names, n)
    wanted = np.array([f["bucket"] for f in found], np.int64)
    for f, i, j in zip(found, np.searchsorted(bucket, wanted), np.searchsorted(bucket, wanted, "right"), strict=True):
        marks[i:j] |= np.unpackbits(np.frombuffer(f["bits"], np.uint8), count=j - i).astype(bool)
    return marks


def _distinct(names: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct names, which of them occur twice, and each name's place among them."""
    own, place, count = np.unique(names, return_inverse=True, return_counts=True)
    return own, count > 1, place


def _block_names(sizes: list[int], body: bytes, length: int, cover: tuple[int, list[int]]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Names of the sampled blocks, and each document's sampled places."""
    raw, at, names, places = np.frombuffer(body, np.uint8), 0, [], []
    for n in sizes:
        own = sampled_places(n, length, cover)
        places.append(own)
        names.append(names_at(raw, own + at, length - cover[0] + 1))
        at += n
    return (np.concatenate(names) if names else np.zeros(0, np.uint64)), places


def _runs(n: int, starts: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Maximal runs of bytes covered by strings of `length` bytes at the sorted starts."""
    if not len(starts):
        return []
    cut = np.flatnonzero(np.diff(starts) > length)
    begin = starts[np.concatenate([[0], cut + 1])]
    end = starts[np.concatenate([cut, [len(starts) - 1]])] + length
    return list(zip(begin.tolist(), end.tolist(), strict=True))


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", length: int = 200) -> DataFrame:
    """id, n_bytes, spans (maximal repeated runs as array<struct<begin, end>>, in bytes) and kept (the remaining bytes) of every document."""
    spark, cover = docs.sparkSession, cover_for(length)
    period = cover[0]
    chunks = written(chunked(docs, id_col), "chunks")
    total = chunks.agg(F.sum(F.length("body"))).first()[0] or 0
    # The first sort only narrows the search, so 48 bits of a name will do there.
    n1 = max(1, total * len(cover[1]) // period // BUCKET_NAMES + 1)

    def deal_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, sizes, body in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                names, _ = _block_names(sizes, body, length, cover)
                yield _in_buckets(chunk, np.unique(names), n1, 6)

    blocks = chunks.select("chunk", "sizes", "body").mapInArrow(deal_blocks, "bucket int, chunk long, names binary")
    found = written(repeated_names(blocks, 6), "blocks")
    release_shuffles(spark)

    # Equal documents: the first of each group stands for all in the second sort; all of them are repeated as a whole.
    slots = chunks.select("chunk", F.posexplode("keys").alias("slot", "key"))
    groups = slots.groupBy("key").agg(F.count(F.lit(1)).alias("c"), F.min(F.struct("chunk", "slot")).alias("first")).where("c > 1")
    groups = written(groups, "copies")
    limit = max(MANY, slots.count() // MOST)
    often = groups.where(F.col("c") > limit).drop("c")  # at most MOST of these, or texts / MANY where there are few
    hot = slots.join(F.broadcast(often), "key", "left")
    cold = hot.where("first IS NULL").drop("first").join(groups.where(F.col("c") <= limit).drop("c"), "key")
    twins = hot.where("first IS NOT NULL").unionByName(cold).select("chunk", F.struct("slot", ((F.col("first.chunk") == F.col("chunk")) & (F.col("first.slot") == F.col("slot"))).alias("first")).alias("twin"))
    twins = twins.groupBy("chunk").agg(F.collect_list("twin").alias("twins"))  # at most the documents of a chunk

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each chunk: what is known of every document, and the texts and starts that the second sort needs."""
        for batch in batches:
            for k in range(batch.num_rows):
                one = batch.slice(k, 1)
                chunk, ids, sizes, body, hits, twin = (one.column(i) for i in range(6))
                sizes, body, twin = sizes[0].as_py(), body[0].as_py(), {t["slot"]: t["first"] for t in twin[0].as_py() or []}
                names, places = _block_names(sizes, body, length, cover)
                own, twice, place = _distinct(names)
                marked = _marks(own, twice, hits[0].as_py(), n1)[place]
                at = used = 0
                bodies, starts = [], []
                for slot, n in enumerate(sizes):
                    mine = marked[used : used + len(places[slot])]
                    used += len(places[slot])
                    if twin.get(slot) is False and n >= length:
                        starts.append(None)  # a copy goes as a whole
                    else:
                        starts.append(places[slot][mine].tolist() if mine.any() else [])
                    bodies.append(body[at : at + n])
                    at += n
                whole = [slot in twin and n >= length for slot, n in enumerate(sizes)]
                yield pa.RecordBatch.from_arrays(
                    [chunk, ids, _lists([sizes], pa.int64()), _lists([whole], pa.bool_()), pa.array([starts], pa.list_(pa.list_(pa.int32()))), _blobs([b"".join(bodies)])],
                    ["chunk", "ids", "sizes", "whole", "hits", "body"],
                )

    joined = chunks.select("chunk", "ids", "sizes", "body").join(found, "chunk", "left").join(twins, "chunk", "left")
    schema = T.StructType([*joined.schema[:3], T.StructField("whole", T.ArrayType(T.BooleanType())), T.StructField("hits", T.ArrayType(T.ArrayType(T.IntegerType()))), T.StructField("body", T.BinaryType())])
    picked = written(joined.mapInArrow(pick, schema), "picked")
    discard(chunks)
    release_shuffles(spark)

    def windows(sizes: list[int], hits: list, body: bytes) -> tuple[np.ndarray, list[np.ndarray]]:
        raw, at, names, starts = np.frombuffer(body, np.uint8), 0, [np.zeros(0, np.uint64)], []
        for n, h in zip(sizes, hits, strict=True):
            own = covered_starts(n, np.array(h or [], np.int64), length, period)
            starts.append(own)
            names.append(names_at(raw, own + at, length))
            at += n
        return np.concatenate(names), starts

    def deal_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                chunk, sizes, hits, body = (batch.column(i)[k].as_py() for i in range(4))
                if any(hits):
                    yield _in_buckets(chunk, np.unique(windows(sizes, hits, body)[0]), n2, 8)

    n_hits = picked.select(F.explode("hits").alias("h")).agg(F.sum(F.size("h"))).first()[0] or 0
    n2 = max(1, 20 * n_hits // BUCKET_NAMES + 1)  # about 20 starts for a block, if neighbours are found too
    dealt = picked.select("chunk", "sizes", "hits", "body").mapInArrow(deal_windows, "bucket int, chunk long, names binary")
    second = written(repeated_names(dealt, 8), "windows")
    release_shuffles(spark)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                ids = batch.column(0)[k].values
                sizes, whole, hits, body, marks = (batch.column(i)[k].as_py() for i in range(1, 6))
                names, starts = windows(sizes, hits, body)
                own, twice, place = _distinct(names)
                marked = _marks(own, twice, marks, n2)[place]
                at = used = 0
                spans, kept = [], []
                for slot, n in enumerate(sizes):
                    mine = starts[slot]
                    runs = [(0, n)] if whole[slot] else _runs(n, mine[marked[used : used + len(mine)]], length)
                    used += len(mine)
                    text, last, rest = body[at : at + n], 0, []
                    for i, j in runs:
                        rest.append(text[last:i])
                        last = j
                    rest.append(text[last:])
                    kept.append(b"".join(rest))
                    spans.append([{"begin": i, "end": j} for i, j in runs])
                    at += n
                kind = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))
                yield pa.RecordBatch.from_arrays([ids, pa.array(sizes, pa.int64()), pa.array(spans, kind), _blobs(kept)], ["id", "n_bytes", "spans", "kept"])

    out = picked.join(second, "chunk", "left").select("ids", "sizes", "whole", "hits", "body", "found")
    id_type = out.schema["ids"].dataType.elementType.simpleString()
    done = out.mapInArrow(finish, f"id {id_type}, n_bytes long, spans array<struct<begin:long,end:long>>, kept binary")
    return done.withColumnRenamed("id", id_col)


def repeated_digest(docs: DataFrame, id_col: str = "doc_id", length: int = 200) -> DataFrame:
    spans = repeated_spans(docs, id_col, length)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda t, s: t + s["end"] - s["begin"])
    return spans.select(id_col, "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
