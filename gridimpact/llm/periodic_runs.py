"""Maximal periodic runs of words, by the linear tandem-repeat method.

A run is a stretch of words with smallest period q, of at least `times` periods and `least` words, that no neighbouring word extends.
For each text a suffix tree over its words is built. Its Lempel-Ziv blocks come from the first leaf below each node; around each
border of a block longest common extensions give squares (a word sequence twice in a row) that cover the leftmost ones of every kind. From the place of
each such square in the tree, walks over suffix links turn it word by word and complete the vocabulary of squares. The leaves below
a square are all its occurrences, and occurrences of one period at neighbouring places merge into runs. Only squares whose half is no
power itself count, so a run is found under its smallest period alone.

What cannot lie in a run is cut out first: every three words in a row of a run of four periods occur three times or more in the text. Stretches of
such words, with a word of its own after each, hold all runs whole, and the tree is built over them alone.

Spark deals the texts; a task works on one at a time, in memory proportional to it.

Defined results: null and empty texts have no words and no runs; repeated rows are separate rows; a null identifier stays null; ties for the
strongest run go to the smallest start, then the smallest period; an empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridimpact.llm.common import text_or_empty

Run = tuple[int, int, int]  # start, length, period
#: Texts that a task prepares at once.
TEXTS = 256


def words_of(text: str) -> list[bytes]:
    """Words between ASCII white space."""
    return text.encode("utf-8", "surrogatepass").split()


class SuffixTree:
    """The suffix tree of a sequence whose last symbol occurs nowhere else, built from left to right; node 0 is the root."""

    def __init__(self, s: list[int]):
        self.s, n = s, len(s)
        begin, end, link, kids = [0], [0], [0], [{}]
        node = edge = length = waiting = 0  # the active point, and the suffixes not yet in the tree
        for i, c in enumerate(s):
            waiting, before = waiting + 1, 0
            while waiting:
                if not length:
                    edge = i
                child = kids[node].get(s[edge])
                if child is None:
                    kids[node][s[edge]] = len(begin)
                    begin.append(i), end.append(n), link.append(0), kids.append({})
                    at = node
                else:
                    size = min(end[child], i + 1) - begin[child]
                    if length >= size:
                        edge, length, node = edge + size, length - size, child
                        continue
                    middle = begin[child] + length
                    if s[middle] == c:
                        length += 1
                        if before:
                            link[before] = node
                        break
                    at, leaf = len(begin), len(begin) + 1
                    begin += [begin[child], i]
                    end += [middle, n]
                    link += [0, 0]
                    kids += [{s[middle]: child, c: leaf}, {}]
                    begin[child] = middle
                    kids[node][s[edge]] = at
                if before:
                    link[before] = at
                before = at
                waiting -= 1
                if not node and length:
                    length, edge = length - 1, i - waiting + 1
                elif node:
                    node = link[node]
        self.begin, self.end, self.link, self.kids = begin, end, link, kids
        self._measured()

    def _measured(self) -> None:
        """Depth, parent, first leaf, and the range of leaves (in the order of a walk) of each node."""
        count, n = len(self.begin), len(self.s)
        self.depth, self.parent, self.first = [0] * count, [0] * count, [n] * count
        self.low, self.high, self.leaves = [0] * count, [0] * count, []
        order, stack = [], [0]
        while stack:
            u = stack.pop()
            if u < 0:
                self.high[~u] = len(self.leaves)
                continue
            order.append(u)
            self.low[u] = len(self.leaves)
            if self.kids[u]:
                stack.append(~u)
                d = self.depth[u]
                for v in self.kids[u].values():
                    self.parent[v], self.depth[v] = u, d + self.end[v] - self.begin[v]
                    stack.append(v)
            else:
                self.first[u] = n - self.depth[u]
                self.leaves.append(self.first[u])
                self.high[u] = len(self.leaves)
        for u in reversed(order):
            p = self.parent[u]
            if self.first[u] < self.first[p]:
                self.first[p] = self.first[u]

    def blocks(self) -> list[tuple[int, int]]:
        """Lempel-Ziv blocks (begin, end): each is the longest beginning of the rest that occurs earlier, or one new symbol."""
        longest = [0] * len(self.s)
        for u in range(1, len(self.begin)):
            p = self.parent[u]
            if self.first[u] != self.first[p]:
                longest[self.first[u]] = self.depth[p]
        out, i = [], 0
        while i < len(self.s):
            j = i + max(1, longest[i])
            out.append((i, j))
            i = j
        return out

    def descend(self, node: int, at: int, size: int) -> int:
        """The node at or below the place that s[at : at + size] leads to, from a node on its way."""
        while self.depth[node] < size:
            node = self.kids[node][self.s[at + self.depth[node]]]
        return node


class Extensions:
    """Longest common extensions by names of stretches of 1, 2, 4, ... symbols: equal stretches have equal names."""

    def __init__(self, s: np.ndarray):
        self.levels, size = [s], 1
        while 2 * size <= len(s):
            a, b = self.levels[-1][:-size], self.levels[-1][size:]
            self.levels.append(np.unique(a * (b.max() + 1) + b, return_inverse=True)[1].astype(np.int64))
            size *= 2

    def forward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How far the symbols from i and from j on are the same."""
        i, j, out = i.copy(), j.copy(), np.zeros(len(i), np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            names = self.levels[k]
            fits = np.flatnonzero((np.maximum(i, j) < len(names)) & (np.minimum(i, j) >= 0))
            same = fits[names[i[fits]] == names[j[fits]]]
            for x in (i, j, out):
                x[same] += 1 << k
        return out

    def backward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How far the symbols up to i and up to j, read backwards, are the same."""
        i, j, out = i + 1, j + 1, np.zeros(len(i), np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            names, size = self.levels[k], 1 << k
            fits = np.flatnonzero((np.minimum(i, j) >= size) & (np.maximum(i, j) - size < len(names)))
            same = fits[names[i[fits] - size] == names[j[fits] - size]]
            for x, step in ((i, -size), (j, -size), (out, size)):
                x[same] += step
        return out


def covering_squares(blocks: list[tuple[int, int]], s: np.ndarray, same: Extensions, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and half lengths (up to the longest) of squares that cover the leftmost square of each kind, found around the borders of blocks."""
    b, e = np.array(blocks).T
    n, size = len(s), e - b
    spread = lambda counts: (np.repeat(np.arange(len(counts)), counts), np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + 1)
    # Squares whose middle lies in a block and whose end lies behind it: compare from the block's end.
    at, k = spread(np.where(e < n, np.minimum(size, longest), 0))
    right, left = e[at], e[at] - k
    on = s[right] == s[left]
    right, left, k = right[on], left[on], k[on]
    ahead, back = same.forward(right, left), same.backward(right - 1, left - 1)
    start, good = np.maximum(left - back, left - k + 1), ahead + back >= k
    found = [(start[good], k[good])]
    # Squares that begin before a block and whose middle lies in it: compare from the block's begin.
    at, k = spread(np.minimum(np.minimum(size + np.append(size[1:], 0), n - 1 - b), longest))
    left, right, end = b[at], b[at] + k, e[at]
    on = (left > 0) & (s[right] == s[left]) & (s[left - 1] == s[right - 1])
    left, right, k, end = left[on], right[on], k[on], end[on]
    ahead, back = same.forward(left, right), same.backward(left - 1, right - 1)
    start = np.maximum(left - back, left - k + 1)
    good = (ahead + back >= k) & (start + k <= end)
    found.append((start[good], k[good]))
    starts, halves = (np.concatenate(x) for x in zip(*found, strict=True))
    if not len(starts):
        return starts, halves
    starts, halves = np.unique(np.stack([starts, halves]), axis=1)
    # A half that is a power itself is left out: it is one of a shorter stretch, by one of the primes in its length.
    factor, rest, tried = _least_factors(int(halves.max())), halves.copy(), []
    while (rest > 1).any():
        own = np.flatnonzero(rest > 1)
        prime = factor[rest[own]]
        tried.append((own, halves[own] // prime))
        while (divides := rest[own] % prime == 0).any():
            rest[own] = np.where(divides, rest[own] // prime, rest[own])
    power = np.zeros(len(starts), bool)
    if tried:
        own, d = (np.concatenate(x) for x in zip(*tried, strict=True))
        power[own[same.forward(starts[own], starts[own] + d) >= halves[own] - d]] = True
    return starts[~power], halves[~power]


def _least_factors(n: int) -> np.ndarray:
    """The least prime factor of each number up to n."""
    out = np.arange(n + 1)
    for p in range(2, int(n**0.5) + 1):
        if out[p] == p:
            out[p * p :: p] = np.minimum(out[p * p :: p], p)
    return out


def vocabulary(tree: SuffixTree, starts: list[int], halves: list[int]) -> set[tuple[int, int]]:
    """(node at or below its place, half length) of each kind of square: those given, and what they become when turned by a symbol."""
    s, depth, kids, known = tree.s, tree.depth, tree.kids, set()
    for at, k in zip(starts, halves, strict=True):
        node = tree.descend(0, at, 2 * k)
        while (node, k) not in known:
            known.add((node, k))
            # Over the suffix link to the place without the first symbol; the square turned is in the text if that symbol can follow.
            above, first, size = tree.parent[node], s[at], 2 * k - 1
            node = tree.descend(tree.link[above], at + 1, size)
            if depth[node] == size:
                node = kids[node].get(first, 0)
                if not node:
                    break
            elif s[tree.begin[node] + size - depth[tree.parent[node]]] != first:
                break
            at = tree.first[node]
    return known


def runs_in(s: list[int], least: int, times: int) -> list[Run]:
    """Runs of a sequence of numbers whose last occurs nowhere else."""
    tree, numbers = SuffixTree(s), np.unique(np.array(s), return_inverse=True)[1].astype(np.int64)
    starts, halves = covering_squares(tree.blocks(), numbers, Extensions(numbers), len(s) // times)
    known = vocabulary(tree, starts.tolist(), halves.tolist())
    if not known:
        return []
    leaves = np.array(tree.leaves)
    places = np.concatenate([leaves[tree.low[u] : tree.high[u]] for u, _ in known])
    periods = np.repeat([k for _, k in known], [tree.high[u] - tree.low[u] for u, _ in known])
    order = np.lexsort([places, periods])
    places, periods = places[order], periods[order]
    cut = np.flatnonzero((np.diff(places) != 1) | (np.diff(periods) != 0))
    begin, last = places[np.concatenate([[0], cut + 1])], places[np.concatenate([cut, [len(places) - 1]])]
    period = periods[np.concatenate([[0], cut + 1])]
    length = last - begin + 2 * period
    good = (length >= least) & (length >= times * period)
    return list(zip(begin[good].tolist(), length[good].tolist(), period[good].tolist(), strict=True))


def stretches(texts: list[list[bytes]], times: int) -> list[list[tuple[int, int]]]:
    """For each text the stretches of words (begin, end) that may hold runs: all three in a row occur `times` - 1 times or more in it."""
    sizes = np.array([len(w) for w in texts], np.int64)
    h = np.fromiter((hash(x) for w in texts for x in w), np.int64, int(sizes.sum())).astype(np.uint64)
    own = np.repeat(np.arange(len(texts)), sizes)
    out: list[list[tuple[int, int]]] = [[] for _ in texts]
    if len(h) < 4:
        return out
    mix, turn = np.uint64(0x9E3779B97F4A7C15), np.uint64(31)
    g = ((h[:-2] * mix ^ h[1:-1]) * mix ^ h[2:]) * mix
    g = (g ^ (g >> turn)) + own[:-2].astype(np.uint64) * mix  # the same three words in another text are others
    order = np.argsort(g)
    edge = np.flatnonzero(np.concatenate([[True], np.diff(g[order]) != 0, [True]]))
    often = np.zeros(len(g), bool)
    often[order] = np.repeat(np.diff(edge) >= times - 1, np.diff(edge))
    often &= own[:-2] == own[2:]
    begins = np.cumsum(sizes) - sizes
    change = np.diff(np.concatenate([[False], often, [False]]).astype(np.int8))
    for i, j in zip(np.flatnonzero(change == 1), np.flatnonzero(change == -1), strict=True):  # the last two places of a text are never set
        t = own[i]
        out[t].append((int(i - begins[t]), int(j + 2 - begins[t])))
    return out


def runs_of(words: list[bytes], parts: list[tuple[int, int]], least: int = 6, times: int = 4) -> list[Run]:
    """Runs of a text by start, then period; parts: its stretches that may hold runs."""
    codes: dict[bytes, int] = {}
    s: list[int] = []
    shift: list[tuple[int, int]] = []  # where a stretch begins here, and there
    for i, j in parts:
        if j - i >= least:
            shift.append((len(s), i))
            s.extend([codes.setdefault(w, len(codes)) for w in words[i:j]])
            s.append(-len(shift))
    if not s:
        return []
    here = np.array([a for a, _ in shift])
    out = []
    for start, length, period in runs_in(s, least, times):
        a, i = shift[int(np.searchsorted(here, start, "right")) - 1]
        out.append((start - a + i, length, period))
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed(words: list[bytes], runs: list[Run]) -> list[bytes]:
    """The words without what runs repeat: all but the first period of each."""
    if not runs:
        return words
    gone = np.zeros(len(words) + 1, np.int32)
    for start, length, period in runs:
        gone[start + period] += 1
        gone[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(gone[:-1]) == 0)]


def _each(docs: DataFrame, id_col: str, fields: list[T.StructField], edit, row: Callable, least: int, times: int) -> DataFrame:
    """id and what row(words, runs) gives, for every text."""
    if times < 4 or least < 6:
        raise ValueError("at least four periods and six words: what is cut out beforehand rests on it")
    rows = docs.select(F.col(id_col).alias("id"), text_or_empty().alias("text"))
    schema = T.StructType([T.StructField(id_col, rows.schema[0].dataType), *fields])
    kinds = T.StructType(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(kinds)
        for whole in batches:
            for k in range(0, whole.num_rows, TEXTS):
                batch = whole.slice(k, TEXTS)
                texts = [words_of(t) for t in batch.column(1).to_pylist()]
                if edit:
                    texts = [edit(i, w) for i, w in zip(batch.column(0).to_pylist(), texts, strict=True)]
                found = [row(w, runs_of(w, parts, least, times)) for w, parts in zip(texts, stretches(texts, times), strict=True)]
                columns = [pa.array(c, f.type) for c, f in zip(zip(*found, strict=True), arrow, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0), *columns], schema.names)

    return rows.mapInArrow(run, schema)


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", edit: Callable | None = None, least: int = 6, times: int = 4) -> DataFrame:
    """id, n_words, runs (array<struct<start, length, period>>, in words) and collapsed (the words that stay, one space between) of every document.

    edit(id, words), if given, changes the words beforehand, in tasks.
    """
    run = T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")])
    fields = [T.StructField("n_words", T.LongType()), T.StructField("runs", T.ArrayType(run)), T.StructField("collapsed", T.StringType())]

    def row(words: list[bytes], runs: list[Run]) -> tuple:
        named = [dict(zip(("start", "length", "period"), r, strict=True)) for r in runs]
        return len(words), named, b" ".join(collapsed(words, runs)).decode("utf-8", "surrogatepass")

    return _each(docs, id_col, fields, edit, row, least, times)


def runs_digest(docs: DataFrame, id_col: str = "doc_id", edit: Callable | None = None, least: int = 6, times: int = 4) -> DataFrame:
    """id, n_runs, the run of the greatest length for its period, and digests of all runs and of the collapsed text."""
    numbers = [T.StructField(c, T.LongType()) for c in ("n_runs", "start", "length", "period", "exponent_milli")]
    fields = [*numbers, T.StructField("runs_sha256", T.StringType()), T.StructField("collapsed_sha256", T.StringType())]

    def row(words: list[bytes], runs: list[Run]) -> tuple:
        best: tuple = (None, None, None)
        for r in runs:  # in the order that decides ties; fractions are compared exactly
            if best[0] is None or r[1] * best[2] > best[1] * r[2]:
                best = r
        listed = "".join(f"{i},{n},{q}\n" for i, n, q in runs).encode()
        milli = None if best[0] is None else 1000 * best[1] // best[2]
        return len(runs), *best, milli, hashlib.sha256(listed).hexdigest(), hashlib.sha256(b" ".join(collapsed(words, runs))).hexdigest()

    return _each(docs, id_col, fields, edit, row, least, times)


def planted(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words of a document in the query: in one of ten documents they repeat from some place on, all chosen by the identifier's crc32."""
    h, n = zlib.crc32(b"" if doc_id is None else str(doc_id).encode()), len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * ((n - a) // p + 1))[: n - a]
