"""Byte-pair encoding and decoding with a public word-end vocabulary.

A piece is encoded in one pass: an Aho-Corasick automaton over the reversed tokens lists, for each place, the tokens
that begin there; the longest is tried first, and kept only if the pair it makes with the token before it is one that
the merges would leave standing. A place from which nothing fits is marked and never tried again, so the work is linear
in the piece. That gives the same tokens as applying the merges in order. Decoding gathers token texts through a table
of offsets. Each task keeps a bounded memory of pieces it has met.

The vocabulary file is read on the driver and sent to the tasks once; it has a fixed size.

Defined results: null and empty texts have no tokens and decode to an empty text; repeated rows are separate rows; an
empty table gives an empty table; extra columns pass through `bpe_encode` and are ignored by `bpe_digest`.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridimpact.llm.common import text_or_empty

SPECIAL = regex.compile(r"(<\|startoftext\|>|<\|endoftext\|>)")
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
#: Unicode white space; str.split() also takes the four separators U+001C to U+001F.
SPACE = regex.compile(r"[\t-\r\x20\x85\xa0  -     　]+")
SEPARATORS = regex.compile(r"[\x1c-\x1f]")
WORD_END = "</w>"


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters = {b: chr(b) for b in own}
    for b in range(256):
        if b not in letters:
            letters[b] = chr(256 + len(letters) - len(own))
    return [letters[b] for b in range(256)]


class WordBpe:
    def __init__(self, spec: str, remember: int = 600_000):
        content = json.loads(spec)
        vocab: dict[str, int] = content["model"]["vocab"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in content["model"]["merges"]]
        self.special: dict[str, int] = {x["content"]: x["id"] for x in content["added_tokens"]}
        self.remember, self.known = remember, {}
        letters = byte_letters()
        self.inner, self.last = [vocab[c] for c in letters], [vocab[c + WORD_END] for c in letters]

        n = max([*vocab.values(), *self.special.values()]) + 1
        self.halves: list[tuple[int, int]] = [(i, i) for i in range(n)]
        self.joined: dict[tuple[int, int], int] = {}
        spelt: dict[int, str] = {i: chr(256 + i) for i in [*self.inner, *self.last]}
        newest = max(spelt)
        for a, b in merges:
            left, right, whole = vocab[a], vocab[b], vocab[a + b]
            if whole <= newest:
                raise ValueError("token ids must follow the order of the merges")
            newest = whole
            self.halves[whole], self.joined[left, right] = (left, right), whole
            spelt[whole] = spelt[left] + spelt[right]
        self.automaton = ahocorasick.Automaton()
        for i, symbols in spelt.items():
            self.automaton.add_word(symbols[::-1], (len(symbols), i))
        self.automaton.make_automaton()
        self.stands: dict[tuple[int, int], bool] = {}

        names = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        blobs = [(names.get(i, "") + " ").encode() for i in range(n)]
        self.blob = np.frombuffer(b"".join(blobs), np.uint8)
        self.offsets = np.concatenate([[0], np.cumsum([len(b) for b in blobs])]).astype(np.int64)

    def compatible(self, left: int, right: int) -> bool:
        """Whether the merges would leave this pair side by side: no merge across the border comes before those that built both."""
        known = self.stands.get((left, right))
        if known is not None:
            return known
        a, b, limit, fits = left, right, len(self.halves), True
        while True:
            across = self.joined.get((a, b))
            if across is not None and across < limit:
                fits = False
                break
            inner_a, inner_b = self.halves[a], self.halves[b]
            whole_a, whole_b = inner_a[0] == a, inner_b[0] == b
            if whole_a and whole_b:
                break
            if not whole_a and (whole_b or a > b):  # undo the later merge, so that `limit` is the next merge on that side
                limit, a = a, inner_a[1]
            else:
                limit, b = b + 1, inner_b[0]
        if len(self.stands) >= 4 * self.remember:
            self.stands.clear()
        self.stands[left, right] = fits
        return fits

    def piece(self, text: str) -> list[int]:
        """Token ids of one piece."""
        raw = text.encode()
        symbols = [self.inner[b] for b in raw[:-1]]
        symbols.append(self.last[raw[-1]])
        n = len(symbols)
        starts: list[list[tuple[int, int]]] = [[] for _ in range(n)]
        for end, found in self.automaton.iter("".join([chr(256 + i) for i in reversed(symbols)])):
            starts[n - 1 - end].append(found)
        for options in starts:
            options.sort()  # the longest last
        if n == 1 or starts[0][-1][0] == n:
            return [starts[0][-1][1]]
        dead = bytearray(n + 1)
        tokens: list[int] = []
        places: list[tuple[int, int]] = []  # where each token begins, and how many options are left there
        at, left = 0, len(starts[0])
        while at < n:
            options = starts[at]
            while left:
                left -= 1
                size, token = options[left]
                if not dead[at + size] and (not tokens or self.compatible(tokens[-1], token)):
                    tokens.append(token)
                    places.append((at, left))
                    at += size
                    left = len(starts[at]) if at < n else 0
                    break
            else:
                dead[at] = 1
                tokens.pop()
                at, left = places.pop()
        return tokens

    def encode(self, text: str) -> np.ndarray:
        out: list[bytes] = []
        for part in SPECIAL.split(text) if "<|" in text else (text,):
            if part in self.special:
                out.append(self.special[part].to_bytes(4, "little"))
                continue
            plain = unicodedata.normalize("NFC", part).replace("Σ", "σ").lower()  # each letter by itself, word ends too
            chunks = [c for c in SPACE.split(plain) if c] if SEPARATORS.search(plain) else plain.split()
            known = self.known
            for chunk in chunks:
                ids = known.get(chunk)
                if ids is None:
                    ids = np.array([i for p in PIECES.findall(chunk) for i in self.piece(p)], "<u4").tobytes()
                    if len(chunk) <= 64:
                        if len(known) >= self.remember:
                            known.clear()
                        known[chunk] = ids
                out.append(ids)
        return np.frombuffer(b"".join(out), "<u4")

    def decode(self, ids: np.ndarray) -> bytes:
        """UTF-8 of the tokens with a space between each two."""
        if not len(ids):
            return b""
        begin = self.offsets[ids]
        sizes = self.offsets[ids.astype(np.int64) + 1] - begin
        ends = np.cumsum(sizes)
        at = np.arange(ends[-1]) + np.repeat(begin - (ends - sizes), sizes)
        return self.blob[at].tobytes()[:-1]


_LOADED: dict[int, WordBpe] = {}


def _coder(spec) -> WordBpe:
    """One coder for each Python worker and vocabulary."""
    key = spec.id if hasattr(spec, "id") else id(spec)
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = WordBpe(spec.value)
    return _LOADED[key]


def _vocabulary(spark: SparkSession, path: str):
    with open(path, encoding="utf-8") as f:  # on the driver; tasks get the content
        return spark.sparkContext.broadcast(f.read())


def bpe_encode(docs: DataFrame, path: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """docs with the token ids of each text in a new column array<int>."""
    spec = _vocabulary(docs.sparkSession, path)
    schema = T.StructType([*(f for f in docs.schema if f.name != ids_col), T.StructField(ids_col, T.ArrayType(T.IntegerType()))])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(spec)
        for batch in batches:
            coded = [coder.encode(t or "") for t in batch.column(text_col).to_pylist()]
            ends = np.cumsum([0, *map(len, coded)]).astype(np.int32)
            flat = np.concatenate(coded) if coded else np.zeros(0, "<u4")
            ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.astype(np.int32)))
            kept = [(n, c) for n, c in zip(batch.schema.names, batch.columns, strict=True) if n != ids_col]
            yield pa.RecordBatch.from_arrays([*(c for _, c in kept), ids], [*(n for n, _ in kept), ids_col])

    return docs.mapInArrow(encode, schema)


def bpe_decode(coded: DataFrame, path: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """coded with the text of the ids in a new column."""
    spec = _vocabulary(coded.sparkSession, path)
    schema = T.StructType([*(f for f in coded.schema if f.name != text_col), T.StructField(text_col, T.StringType())])

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(spec)
        for batch in batches:
            texts = pa.array([coder.decode(np.array(x or [], np.int64)).decode() for x in batch.column(ids_col).to_pylist()], pa.string())
            kept = [(n, c) for n, c in zip(batch.schema.names, batch.columns, strict=True) if n != text_col]
            yield pa.RecordBatch.from_arrays([*(c for _, c in kept), texts], [*(n for n, _ in kept), text_col])

    return coded.mapInArrow(decode, schema)


def bpe_digest(docs: DataFrame, path: str, id_col: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """id, n_tokens, digests of the ids and of the text decoded from them; with_ids: the ids too, as array<int>."""
    spec = _vocabulary(docs.sparkSession, path)
    rows = docs.select(F.col(id_col), text_or_empty().alias("text"))
    schema = T.StructType(
        [rows.schema[0], T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
        + [T.StructField("ids", T.ArrayType(T.IntegerType()))] * with_ids
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(spec)
        for whole in batches:
            for k in range(0, whole.num_rows, 256):
                batch = whole.slice(k, 256)
                coded = [coder.encode(t) for t in batch.column(1).to_pylist()]
                columns = [
                    batch.column(0),
                    pa.array([len(x) for x in coded], pa.int64()),
                    pa.array([hashlib.sha256(x.tobytes()).hexdigest() for x in coded], pa.string()),
                    pa.array([hashlib.sha256(coder.decode(x)).hexdigest() for x in coded], pa.string()),
                ]
                if with_ids:
                    ends = np.cumsum([0, *map(len, coded)]).astype(np.int32)
                    columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(coded).astype(np.int32))))
                yield pa.RecordBatch.from_arrays(columns, schema.names)

    return rows.mapInArrow(run, schema)
