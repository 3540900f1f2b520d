"""Document fingerprints from which two versions tell what differs between them.

A text is cut into paragraphs (lines, and their sentences), whose 64-bit digests, each once, go into an invertible Bloom lookup table: three groups of
cells, one cell of each group for a digest, holding the number, the sum and the sum of check values of the digests that fell into it. The
fingerprint is the table of 24 cells. The tables of two versions subtract cell by cell; what both have vanishes, and cells with one
digest left are peeled off, one after the other, until nothing is left: those are the paragraphs of only one version. If
something is left that cannot be peeled, more differs than the table can tell, and both texts get tables four times as large, again and again.
The likeness of two versions is the share of common paragraphs among all of theirs.

`with_successors` sets each document beside the next one in descending order of identifiers: Spark deals rows by ranges of identifiers, tasks go through
them in order, and the last row of a range gets the first of the next one by a join of one row for each range. Equal identifiers are in
the order of a hash of their texts. The hash and the row's number also deal them out, so many rows of one identifier fill many ranges.

Defined results: null counts as empty; two empty texts are alike (1), an empty one and another are not (0); repeated rows are separate
rows; a null identifier comes after all others; a single document is its own successor; an empty table gives an empty table;
extra columns are ignored. White space alone makes no paragraph, so two texts of white space are alike.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridimpact.llm.common import text_or_empty, written

#: Cells in each of the three groups of a fingerprint; how much larger the next table is; the largest.
CELLS, GROWTH, MOST_CELLS = 8, 4, 1 << 20
CUTS = regex.compile(r"\n+|(?<=[.!?。！？])[\x20\t]+")
#: A sentence longer than this is cut further, behind words chosen by their hash.
LONG = 600
#: Texts that a task compares at once.
TEXTS = 256
_U = np.uint64


def paragraphs(text: str) -> list[str]:
    """Pieces of a text; the same passage gives the same pieces wherever it stands."""
    out = []
    for piece in CUTS.split(text):
        if len(piece) <= LONG:
            out.append(piece.strip())
            continue
        words: list[str] = []
        for word in piece.split():
            words.append(word)
            if xxhash.xxh3_64_intdigest(word) % 8 == 0:
                out.append(" ".join(words))
                words = []
        out.append(" ".join(words))
    return [p for p in out if p]


def digests(text: str) -> np.ndarray:
    """The distinct digests of a text's paragraphs, in order."""
    own = {xxhash.xxh3_64_intdigest(p) for p in paragraphs(text)}
    return np.sort(np.fromiter(own, np.uint64, len(own)))


def check_of(keys: np.ndarray) -> np.ndarray:
    h = (keys ^ (keys >> _U(33))) * _U(0xFF51AFD7ED558CCD)
    return (h ^ (h >> _U(33))) * _U(0xC4CEB9FE1A85EC53) >> _U(32)


def cells_of(keys: np.ndarray, table: np.ndarray, cells: int) -> np.ndarray:
    """The three cells of each key, in the table (by number) that it goes to. A smaller table is the larger one folded."""
    return np.stack([(table * 3 + g) * cells + ((keys >> _U(20 * g)) & _U(cells - 1)).astype(np.int64) for g in range(3)])


class Tables:
    """Several tables of the same size side by side."""

    def __init__(self, count: int, cells: int):
        self.cells = cells
        self.number = np.zeros(count * 3 * cells, np.int64)
        self.keys, self.checks = np.zeros(count * 3 * cells, np.uint64), np.zeros(count * 3 * cells, np.uint64)

    def add(self, keys: np.ndarray, table: np.ndarray, sign: int | np.ndarray = 1) -> np.ndarray:
        """Adds keys (or takes them away) and gives the cells touched."""
        at = cells_of(keys, table, self.cells)
        signs = np.broadcast_to(np.asarray(sign, np.int64), keys.shape)
        turned = signs.astype(np.uint64)  # -1 as 2^64 - 1: sums are modulo 2^64
        values, checks = keys * turned, check_of(keys) * turned
        for own in at:
            np.add.at(self.number, own, signs)
            np.add.at(self.keys, own, values)
            np.add.at(self.checks, own, checks)
        return at.ravel()

    def blob(self, table: int) -> str:
        """One table as text."""
        own = slice(table * 3 * self.cells, (table + 1) * 3 * self.cells)
        parts = self.number[own].astype("<i4"), self.keys[own].astype("<u8"), (self.checks[own] & _U(0xFFFFFFFF)).astype("<u4")
        return base64.b64encode(b"".join(p.tobytes() for p in parts)).decode()

    @classmethod
    def difference(cls, one: str, other: str) -> Tables:
        """What is left of two fingerprints of the same size."""
        a, b = (base64.b64decode(x) for x in (one, other))
        n = len(a) // 16
        out = cls(1, n // 3)
        part = lambda kind, i, j: np.frombuffer(a[i:j], kind).astype(out.number.dtype if kind == "<i4" else np.uint64) - np.frombuffer(b[i:j], kind).astype(out.number.dtype if kind == "<i4" else np.uint64)
        out.number, out.keys, out.checks = part("<i4", 0, 4 * n), part("<u8", 4 * n, 12 * n), part("<u4", 12 * n, 16 * n)
        return out

    def peeled(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Table, key and sign of everything that can be peeled off, and whether each table is empty then."""
        out: list[tuple[np.ndarray, ...]] = []
        look = np.arange(len(self.number))
        low = _U(0xFFFFFFFF)
        while len(look):
            look = look[np.abs(self.number[look]) == 1]
            sign = self.number[look].astype(np.uint64)
            keys = self.keys[look] * sign
            pure = (check_of(keys) & low) == ((self.checks[look] * sign) & low)
            look, keys = look[pure], keys[pure]
            if not len(look):
                break
            table, signs = look // (3 * self.cells), self.number[look]
            order = np.lexsort([keys, table])  # a key can be alone in several of its cells
            table, keys, signs = table[order], keys[order], signs[order]
            once = np.concatenate([[True], (np.diff(table) != 0) | (keys[1:] != keys[:-1])])
            table, keys, signs = table[once], keys[once], signs[once]
            out.append((table, keys, signs))
            look = np.unique(self.add(keys, table, -signs))
        rest = ((self.number != 0) | (self.keys != 0) | ((self.checks & low) != 0)).reshape(-1, 3 * self.cells).any(1)
        none = (np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64))
        return *(np.concatenate(x) for x in zip(none, *out, strict=True)), ~rest


def differing(one: str, other: str) -> tuple[list[int], list[int]] | None:
    """Paragraph digests that only the one and only the other of two fingerprints has; None if more differs than they can tell."""
    _, keys, signs, empty = Tables.difference(one, other).peeled()
    return (keys[signs > 0].tolist(), keys[signs < 0].tolist()) if empty[0] else None


def likeness(pairs: list[tuple[np.ndarray, np.ndarray]], cells: int = CELLS) -> np.ndarray:
    """Likeness of each pair of texts, given by their digests: tables are subtracted and peeled, and where that fails larger ones."""
    only = np.zeros((len(pairs), 2), np.int64)  # digests that only the one, only the other has
    sizes = np.array([[len(a), len(b)] for a, b in pairs], np.int64).reshape(-1, 2)
    left = np.flatnonzero(sizes.any(1))
    while len(left):
        if cells > MOST_CELLS:  # only for digests that share all their cells
            for p in left:
                only[p] = len(np.setdiff1d(*pairs[p])), len(np.setdiff1d(*pairs[p][::-1]))
            break
        again = []
        for part in np.split(left, np.flatnonzero(np.diff((3 * cells * np.arange(len(left))) // 1_000_000)) + 1):  # about a million cells at once
            tables = Tables(len(part), cells)
            for side, sign in ((0, 1), (1, -1)):
                tables.add(np.concatenate([pairs[p][side] for p in part]), np.repeat(np.arange(len(part)), sizes[part, side]), sign)
            table, _, signs, empty = tables.peeled()
            for side, sign in ((0, 1), (1, -1)):
                only[part, side] = np.bincount(table[signs == sign], minlength=len(part))
            again.append(part[~empty])
        left, cells = np.concatenate(again), cells * GROWTH
    whole = sizes[:, 0] + only[:, 1]
    return np.where(whole > 0, (sizes[:, 0] - only[:, 0]) / np.maximum(whole, 1), 1.0)


def fingerprints_of(keys: list[np.ndarray]) -> list[str]:
    tables = Tables(len(keys), CELLS)
    tables.add(np.concatenate([*keys, np.zeros(0, np.uint64)]), np.repeat(np.arange(len(keys)), [len(k) for k in keys]))
    return [tables.blob(i) for i in range(len(keys))]


def fingerprints(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """id, n_paragraphs (different ones) and fingerprint of every document."""
    rows = docs.select(F.col(id_col), text_or_empty().alias("text"))
    schema = T.StructType([rows.schema[0], T.StructField("n_paragraphs", T.LongType()), T.StructField("fingerprint", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, TEXTS):
                batch = whole.slice(k, TEXTS)
                keys = [digests(t) for t in batch.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) for x in keys], pa.int64()), pa.array(fingerprints_of(keys))], schema.names)

    return rows.mapInArrow(run, schema)


def edited(text: str, following: str) -> str:
    """The text with its second half (the smaller, if its length is odd) replaced by as much of the beginning of another."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


OUTPUT = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _compared(texts: list[str]) -> list[pa.Array]:
    """The columns of OUTPUT for all texts but the last, each with the one behind it."""
    own = [digests(t) for t in texts]
    changed = [edited(t, u) for t, u in zip(texts, texts[1:], strict=False)]
    keys = [digests(t) for t in changed]
    return [
        pa.array([len(t) for t in texts[:-1]], pa.int64()),
        pa.array([hashlib.sha256(t.encode()).hexdigest() for t in changed], pa.string()),
        pa.array(fingerprints_of(own[:-1]), pa.string()),
        pa.array(fingerprints_of(keys), pa.string()),
        pa.array(likeness(list(zip(own, keys, strict=False))), pa.float64()),
        pa.array(likeness(list(zip(own, own[1:], strict=False))), pa.float64()),
    ]


def with_successors(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """id and the columns of OUTPUT of every document: its fingerprint against that of its edited text and that of its successor."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), text_or_empty().alias("text"))
    order = [F.col("id").desc_nulls_last(), F.col("hash"), F.col("row")]
    ordered = rows.select("id", "text", F.xxhash64("text").alias("hash"), F.monotonically_increasing_id().alias("row"))
    ordered = ordered.repartitionByRange(*order).sortWithinPartitions(*order).select("id", "text")
    id_type = rows.schema["id"].dataType.simpleString()
    columns = [x.split()[0] for x in OUTPUT.split(", ")]

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of a range; its last one waits with its text (tail), and that row also has the range's first text (head)."""
        from pyspark import TaskContext

        part, head, ids, texts = TaskContext.get().partitionId(), None, [], []
        for whole in batches:
            kind = whole.schema.field(0).type
            for k in range(0, whole.num_rows, TEXTS):
                batch = whole.slice(k, TEXTS)
                ids.extend(batch.column(0).to_pylist())
                texts.extend(batch.column(1).to_pylist())
                head = texts[0] if head is None else head
                n = len(ids) - 1
                none = pa.nulls(n, pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(ids[:-1], kind), *_compared(texts), pa.array([part] * n, pa.int32()), none, none], [*names, "part", "head", "tail"])
                del ids[:-1], texts[:-1]
        if ids:
            empty = [pa.nulls(1, kinds[c]) for c in columns]
            yield pa.RecordBatch.from_arrays([pa.array(ids, kind), *empty, pa.array([part], pa.int32()), pa.array([head]), pa.array(texts)], [*names, "part", "head", "tail"])

    kinds = {x.split()[0]: {"long": pa.int64(), "string": pa.string(), "double": pa.float64()}[x.split()[1]] for x in OUTPUT.split(", ")}
    names = ["id", *columns]
    done = written(ordered.mapInArrow(within, f"id {id_type}, {OUTPUT}, part int, head string, tail string"), "fingerprints")

    # One row for each range: the last of one and the first of the next.
    last = done.where("tail IS NOT NULL")
    parts = sorted(r.part for r in last.select("part").collect())  # as many numbers as there are ranges
    following = dict(zip(parts, parts[1:] + parts[:1], strict=True))
    if not following:
        return done.select(F.col("id").alias(id_col), *columns)
    after = F.create_map(*chain.from_iterable((F.lit(a), F.lit(b)) for a, b in following.items()))
    heads = last.select(F.col("part").alias("next"), F.col("head").alias("following"))
    pairs = last.select("id", "tail", after[F.col("part")].alias("next")).join(heads, "next").select("id", "tail", "following")

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                one = batch.slice(k, 1)
                yield pa.RecordBatch.from_arrays([one.column(0), *_compared([one.column(1)[0].as_py(), one.column(2)[0].as_py()])], names)

    bridged = pairs.mapInArrow(across, f"id {id_type}, {OUTPUT}")
    return done.where("tail IS NULL").select(*names).unionByName(bridged).withColumnRenamed("id", id_col)
