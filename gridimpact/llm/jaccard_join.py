"""Links between documents whose word-shingle sets have a Jaccard similarity of at least a limit, and their components.

Every set is folded into blocks by the high bits of its shingles' hashes, and each block into the XOR of its hashes: a
parity sketch. One different shingle changes one block, so two sets whose symmetric difference is at most d agree on at
least one of d + 1 blocks, and with some blocks more on as many more. Sets are put into bands by size; d is the largest difference that the limit allows in a band,
and a set that can be linked with a larger one of the next band is sketched for that band too. Empty
blocks agree without telling anything: a set counts its own as lost, and only the few sets with more empty blocks than
there are to spare also announce those. A set that shares fewer blocks than a linked one must is out. Candidates are checked by size, by the Hamming distance of a wider sketch (a lower bound of the
difference), and at last by the sets themselves. No link between different texts is lost.

Equal sets are one node of the graph. Nodes that agree on a block are first compared with one pivot of the block, not with
each other, and what this links counts as one component: the pivot that agrees with most others, which in a group of near
copies is the least altered one, and then others at random as long as they link many. Nodes whose blocks still touch several components are left.
Linked sets also share one of their rarest shingles (a prefix in order of rarity), and those differ inside a group of near
copies, so the nodes that are left meet on these; sizes and sketches are compared in the join itself.
Rows without shingles take no part in any join, and rows of a set that very many share get their answer by a broadcast of bounded size.
Hot blocks are pre-aggregated before they are shuffled, and the joins on them are left to adaptive skew splitting.

Shingles, sets and nodes are 64-bit hashes. Defined results: null and empty texts, and texts of white space, have no
shingles and are linked with nothing, so component_id is their own identifier; fewer words than a shingle make one
shingle of the whole text; repeated rows share a node; an empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridimpact.llm.common import checkpointed, discard, release_shuffles, text_or_empty, written

#: A set that more rows have than MANY, and than one in MOST of all, is answered where its rows are: those sets are few enough to broadcast.
MANY, MOST = 64, 100_000
#: Columns of the wide sketch, 64 bits each.
SKETCH = [f"s{k}" for k in range(8)]
_U = np.uint64


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


@functools.lru_cache(4)
def _powers(n: int) -> np.ndarray:
    return np.concatenate([[_U(1)], np.cumprod(np.full(n - 1, 0x9E3779B97F4A7C15, np.uint64))])


def word_hashes(text: str) -> np.ndarray:
    """A hash for each word, ASCII letters in lower case."""
    raw = _LOWER[np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)]
    inside = ~_SPACE[raw]
    if not inside.any():
        return np.zeros(0, np.uint64)
    edge = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).view(np.int8)))
    begin, size = edge[::2], edge[1::2] - edge[::2]
    first = np.cumsum(size) - size
    place = np.arange(int(size.sum())) - np.repeat(first, size)
    powers = _powers(max(64, 1 << int(size.max() - 1).bit_length()))
    values = (raw[inside].astype(np.uint64) + _U(1)) * powers[place]
    return mixed(np.add.reduceat(values, first) + size.astype(np.uint64))


def shingle_set(text: str, width: int) -> np.ndarray:
    """Sorted hashes of the distinct shingles."""
    words = word_hashes(text)
    if not len(words):
        return words
    n, width = len(words), min(width, len(words))
    h = np.full(n - width + 1, width, np.uint64)
    for k in range(width):
        h = mixed(h * _U(0xD6E8FEB86659FD93) + words[k : n - width + 1 + k])
    return np.unique(h)


class Bands:
    """Bands of set sizes, with the blocks of each."""

    def __init__(self, percent: int, growth: float = 1.5):
        self.percent = percent
        top = 1
        while self.difference(top, top) == 0:
            top += 1
        self.tops = [top - 1]  # sets up to here are linked only if equal
        while self.tops[-1] < 1 << 40:
            self.tops.append(max(self.tops[-1] + 1, int(self.tops[-1] * growth)))

    def difference(self, a: int, b: int) -> int:
        """The largest symmetric difference of linked sets of these sizes."""
        return (a + b) * (100 - self.percent) // (100 + self.percent)

    def of(self, n: int) -> list[int]:
        band = int(np.searchsorted(self.tops, n))
        if band == 0:
            # sets this small have no unequal partner of their band; a larger one of the next band may be in reach
            return [1] if 100 * n >= self.percent * (self.tops[0] + 1) else []
        return [band, band + 1] if 100 * n >= self.percent * (self.tops[band] + 1) else [band]

    def blocks(self, band: int) -> tuple[int, int]:
        """The number of blocks, and how many of them may be empty without announcing it."""
        d = self.difference(self.tops[band], self.tops[band])
        spare = 3 + d // 8
        return d + 1 + spare, spare

    def signatures(self, hashes: np.ndarray) -> tuple[np.ndarray, list[int]]:
        """Signatures, the last bit that of the band's number; and for even and odd bands how many of them a linked set shares at least."""
        out, least = [], [1, 1]
        for band in self.of(len(hashes)):
            n, spare = self.blocks(band)
            block = ((hashes >> _U(32)) * _U(n)) >> _U(32)  # rises with the hash, so a block's hashes are neighbours
            first = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))
            parity = np.bitwise_xor.reduceat(hashes, first)
            least[band & 1] = max(1, 1 + spare - (n - len(first)))
            found = [mixed(parity ^ mixed(block[first] + _U(band << 40)))]
            if n - len(first) > spare:
                empty = np.setdiff1d(np.arange(n, dtype=np.uint64), block[first])
                found.append(mixed(mixed(empty + _U(band << 40)) ^ _U(0x5851F42D4C957F2D)))
            out += [(f & ~_U(1)) | _U(band & 1) for f in found]
        return (np.concatenate(out) if out else np.zeros(0, np.uint64)), least


def _sketch(hashes: np.ndarray) -> np.ndarray:
    bits = 64 * len(SKETCH)
    return np.packbits(np.bincount((hashes & _U(bits - 1)).astype(np.int64), minlength=bits) & 1).view(np.int64)


def _node(hashes: np.ndarray) -> int:
    return int(mixed(np.array([len(hashes)], np.uint64) + np.add.reduce(mixed(hashes), dtype=np.uint64)).view(np.int64)[0])


def _lists(parts: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, parts)]).astype(np.int32)
    flat = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.view(np.int64)))


def sketched(docs: DataFrame, id_col: str, width: int, bands: Bands) -> DataFrame:
    """id, n (set size), node, the wide sketch as longs s0, s1, ..., least0, least1, signatures."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 512):
                batch = whole.slice(k, 512)
                sets = [shingle_set(t, width) for t in batch.column(1).to_pylist()]
                signed = [bands.signatures(s) for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([_node(s) for s in sets], pa.int64()),
                        *(pa.array(np.ascontiguousarray(x)) for x in np.array([_sketch(s) for s in sets]).T),
                        *(pa.array([least[k] for _, least in signed], pa.int64()) for k in (0, 1)),
                        _lists([found for found, _ in signed]),
                    ],
                    names,
                )

    rows = docs.select(F.col(id_col).alias("id"), text_or_empty().alias("text"))
    kind, names = rows.schema[0].dataType.simpleString(), ["id", "n", "node", *SKETCH, "least0", "least1", "sigs"]
    return rows.mapInArrow(run, f"id {kind}, n long, node long, {', '.join(f'{c} long' for c in SKETCH)}, least0 long, least1 long, sigs array<long>")


def shingle_sets(docs: DataFrame, width: int) -> DataFrame:
    """node and its shingles, a row for each row of docs (text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 256):
                sets = [shingle_set(t, width) for t in whole.slice(k, 256).column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array([_node(s) for s in sets], pa.int64()), _lists(sets)], ["node", "shingles"])

    return docs.mapInArrow(run, "node long, shingles array<long>")


def components(links: DataFrame) -> DataFrame:
    """node, label (the smallest node that links reach) of every node of links (a, b): smallest label of the neighbours, with jumps."""
    both = checkpointed(links.select("a", "b").union(links.select("b", "a")).distinct())
    labels = checkpointed(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label")))
    while True:
        reached = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("label").alias("m"))
        better = labels.join(reached, labels.node == reached.a).select("node", F.col("label").alias("was"), F.least("label", "m").alias("label"))
        roots = labels.select(F.col("node").alias("root"), F.col("label").alias("further"))
        better = better.join(roots, better.label == roots.root, "left").select("node", "was", F.least("label", F.coalesce("further", "label")).alias("label"))
        better = checkpointed(better)
        changed = better.where("label != was").limit(1).count()
        labels = better.select("node", "label")
        if not changed:
            return labels


class _Links:
    def __init__(self, sets: DataFrame, percent: int):
        """sets: node, n, the sketch and the shingles of each node that has a candidate."""
        self.sets, self.percent = sets, percent

    def may_link(self, a: str, b: str) -> Column:
        """Whether sizes and sketches allow it; a, b: suffixes of the columns."""
        x, y = F.col(f"n{a}"), F.col(f"n{b}")
        apart = reduce(lambda p, q: p + q, [F.bit_count(F.col(c + a).bitwiseXOR(F.col(c + b))) for c in SKETCH])
        return (100 * F.least(x, y) >= self.percent * F.greatest(x, y)) & (apart * (100 + self.percent) <= (x + y) * (100 - self.percent))

    def verified(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) whose similarity reaches the limit."""
        one, other = (self.sets.select(F.col("node").alias(k), F.col("shingles").alias(f"h_{k}")) for k in "ab")
        both = pairs.join(one, "a").join(other, "b").withColumn("same", F.size(F.array_intersect("h_a", "h_b")))
        total = F.size("h_a") + F.size("h_b") - F.col("same")
        return both.where(100 * F.col("same") >= self.percent * total).select("a", "b")

    def with_pivots(self, pairs: DataFrame) -> DataFrame:
        """Those of the pairs (a, b) that may link."""
        one, other = (self.sets.select("node", "n", *SKETCH).toDF(k, *(c + k for c in ["n", *SKETCH])) for k in "ab")
        return pairs.join(one, "a").join(other, "b").where(self.may_link("a", "b")).select("a", "b")

    def that_meet(self, nodes: DataFrame) -> DataFrame:
        """Pairs (a, b) of different labels that share a shingle of both prefixes and may link; nodes: node, label."""
        sets = self.sets.join(nodes, "node")
        tokens = sets.select("node", F.explode("shingles").alias("token"))
        often = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
        shared = tokens.join(often, "token").groupBy("node").agg(F.array_sort(F.collect_list(F.struct("c", "token"))).alias("shared"))  # at most a set
        prefix = F.expr(f"n - (n * {self.percent} + 99) div 100 + 1 - (n - size(shared))")  # shingles that nobody shares come first
        keys = shared.join(sets.drop("shingles"), "node").where(prefix > 0).withColumn("key", F.explode(F.slice("shared", F.lit(1), prefix.cast("int"))))
        keys = keys.select(F.col("key.token").alias("token"), "node", "label", "n", *SKETCH)
        one, other = (keys.toDF("token", *(c + k for c in ["node", "label", "n", *SKETCH])) for k in "ab")
        met = one.join(other, "token").where((F.col("nodea") < F.col("nodeb")) & (F.col("labela") != F.col("labelb")) & self.may_link("a", "b"))
        return met.select(F.col("nodea").alias("a"), F.col("nodeb").alias("b")).distinct()


def _met(members: DataFrame, of: str) -> DataFrame:
    """Blocks (sig) that hold two different values of a column."""
    return members.groupBy("sig").agg(F.min(of).alias("l"), F.max(of).alias("h")).where("l != h").select("sig")


def _open(members: DataFrame, labels: DataFrame | None) -> DataFrame:
    """Members (sig, node) of the blocks in which more than one component meets, with their labels."""
    if labels is None:
        return members.withColumn("label", F.col("node"))
    with_label = members.join(labels, "node", "left").select("sig", "node", "o", F.coalesce("label", "node").alias("label"))
    return with_label.join(_met(with_label, "label"), "sig")


def _looked_up(rows: DataFrame, table: DataFrame, key: str, count: str, limit: int) -> DataFrame:
    """rows with the `lowest` of their key from a table of all keys; keys with more rows than the limit, which are at most MOST (or rows / MANY, where rows are few), by a broadcast."""
    often = F.col(count) > limit
    hot = rows.join(F.broadcast(table.where(often).select(key, "lowest")), key, "left")
    cold = hot.where("lowest IS NULL").drop("lowest").join(table.where(~often).select(key, "lowest"), key)
    return hot.where("lowest IS NOT NULL").unionByName(cold)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", width: int = 5, percent: int = 80, growth: float = 1.5) -> DataFrame:
    """id, n_shingles, node (equal for equal sets, null for empty ones) and component_id of every document."""
    bands = Bands(percent, growth)
    docs = docs.select(id_col, "text")
    signed = written(sketched(docs, id_col, width, bands), "sketches")
    rows = written(signed.drop("sigs"), "nodes")
    full = rows.where("n > 0")
    classes = full.groupBy("node").agg(F.min("id").alias("low"), F.count(F.lit(1)).alias("copies"))

    blocks = signed.where("n > 0").select("node", F.explode("sigs").alias("sig"))
    shared = written(blocks.groupBy("sig").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("sig"), "shared")
    release_shuffles(docs.sparkSession)
    members = written(blocks.join(shared, "sig").distinct(), "blocks")
    discard(signed, shared)
    release_shuffles(docs.sparkSession)
    least = full.groupBy("node").agg(F.first("least0").alias("least0"), F.first("least1").alias("least1"))
    for _ in range(2):  # a block must join two nodes, and a node enough blocks of a band
        wide = members
        members = members.join(_met(members, "node"), "sig").withColumn("odd", F.col("sig").bitwiseAND(F.lit(1)))
        enough = members.groupBy("node", "odd").agg(F.count(F.lit(1)).alias("k")).join(least, "node")
        enough = enough.where(F.col("k") >= F.when(F.col("odd") == 1, F.col("least1")).otherwise(F.col("least0"))).select("node", "odd")
        members = written(members.join(enough, ["node", "odd"]).select("sig", "node"), "members")
        discard(wide)
    members = members.join(_met(members, "node"), "sig").join(members.groupBy("sig").agg(F.count(F.lit(1)).alias("c")), "sig")
    popular = members.groupBy("node").agg(F.sum("c").alias("o"))
    members = written(members.join(popular, "node").select("sig", "node", "o"), "members")
    release_shuffles(docs.sparkSession)

    involved = members.select("node").distinct()
    wanted = classes.join(involved, "node").select(F.col("low").alias("_low")).distinct()
    texts = docs.join(wanted, docs[id_col].eqNullSafe(wanted["_low"]), "left_semi").select(text_or_empty().alias("text"))
    about = full.groupBy("node").agg(*(F.first(c).alias(c) for c in ["n", *SKETCH])).join(involved, "node")
    sets = shingle_sets(texts, width).dropDuplicates(["node"]).join(about, "node")
    check = _Links(written(sets.select("node", "n", *SKETCH, "shingles"), "sets"), percent)
    release_shuffles(docs.sparkSession)

    links, labels, turn, worth = None, None, 0, True
    while True:
        open_ = written(_open(members, labels), f"open-{turn}")
        if open_.isEmpty():
            break
        if worth:
            order = -F.col("o") if turn == 0 else F.xxhash64("node", F.lit(turn))
            pivots = open_.groupBy("sig").agg(F.min(F.struct(order.alias("o"), "node", "label")).alias("p"))
            to = open_.join(pivots, "sig").where("label != p.label").groupBy("node").agg(F.min("p").alias("p"))
            pairs = check.with_pivots(to.select(F.col("node").alias("a"), F.col("p.node").alias("b")))
        else:
            pairs = check.that_meet(open_.select("node", "label").distinct())
        found = written(check.verified(pairs), "links")
        links = found if links is None else links.union(found)
        labels = components(links)
        last = not worth
        worth = 20 * found.count() >= open_.select("node").distinct().count()  # pivots go on while they link one node in twenty
        discard(open_)
        release_shuffles(docs.sparkSession)
        if last:
            break
        turn += 1

    limit = max(MANY, rows.count() // MOST)
    answers = classes.withColumn("lowest", F.col("low"))
    if labels is not None:
        lowest = written(labels.join(classes, "node").groupBy("label").agg(F.min("low").alias("lowest"), F.count(F.lit(1)).alias("members")), "lowest")
        linked = _looked_up(labels, lowest, "label", "members", limit).select(F.col("node").alias("_node"), F.col("lowest").alias("_lowest"))
        answers = classes.join(linked, classes.node == linked._node, "left").select("node", "copies", F.coalesce("_lowest", "low").alias("lowest"))
    answers = written(answers.select("node", "copies", "lowest"), "answers")
    out = _looked_up(full.select("id", "n", "node"), answers, "node", "copies", limit)
    alone = rows.where("n = 0").select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.lit(None).cast("long").alias("node"), F.col("id").alias("component_id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "node", F.col("lowest").alias("component_id")).unionByName(alone)
