"""Toxicity by compression: how much shorter a window of text gets with a dictionary of toxic text at hand.

Two dictionaries are trained by zstandard: one on ordinary texts, and one on what stands out in toxic texts, the runs of byte
sequences that stand in many different contexts of toxic texts and in few of ordinary ones (contexts are counted instead of texts, so
copies count once). Windows are compressed with the ordinary dictionary, and with the toxic one behind it, so a window of
toxic text gets shorter and any other stays the same. Counts of windows by gain, and the largest gain, go through a logistic scale that is
fitted on the same rows, so 0.5 is the calibrated threshold.

The fit reads at most `max_rows` labelled rows and `max_bytes` of text, chosen by a hash of the identifier, and no text above a 64th of that:
dictionaries are trained in one
task, the windows of the rows are measured in many, and only the dictionaries and a few numbers for each row reach the driver. Everything
else is whole texts in tasks, with both dictionaries sent to them (36 kilobytes).

Defined results: null and empty texts have one empty window; if the rows to learn from lack a class, every score is the
share of toxic rows; repeated rows are separate rows, but an identifier is learned from once, by its smallest text; an empty table gives an
empty table; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridimpact.llm.common import bounded_sample, fold_of, text_or_empty, written

GRAMS, CONTEXT = (4, 5, 6), 12
WINDOW, STEP = 36, 26
_U = np.uint64


def _lower(text: str) -> bytes:
    return text.lower().encode("utf-8", "surrogatepass")


def _grams(raw: bytes, size: int) -> np.ndarray:
    a = np.frombuffer(raw, np.uint8)
    n = max(0, len(a) - size + 1)
    out = np.zeros(n, np.uint64)
    for k in range(size):
        out = (out << _U(8)) | a[k : k + n].astype(np.uint64)
    return out


def context_counts(texts: list[str], size: int, turns: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """Byte sequences of a size, and in how many contexts (the CONTEXT bytes before) each stands; in turns, to hold less at once."""
    parts = [_context_counts(texts, size, turns, t) for t in range(turns)]
    grams, counts = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(grams)
    return grams[order], counts[order]


def _context_counts(texts: list[str], size: int, turns: int, turn: int) -> tuple[np.ndarray, np.ndarray]:
    grams, contexts = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
    for text in texts:
        raw = b" " * CONTEXT + _lower(text)
        g = _grams(raw, size)[CONTEXT:]
        mine = np.flatnonzero(g % _U(turns) == turn)
        if not len(mine):
            continue
        a, h = np.frombuffer(raw, np.uint8), np.zeros(len(mine), np.uint64)
        for k in range(CONTEXT):
            h = h * _U(0x9E3779B97F4A7C15) + a[mine + k].astype(np.uint64) + _U(1)
        g = g[mine]
        h = (h ^ (h >> _U(29))) * _U(0xBF58476D1CE4E5B9) + g * _U(0x94D049BB133111EB)
        h, first = np.unique(h, return_index=True)
        grams.append(g[first])
        contexts.append(h)
    _, first = np.unique(np.concatenate(contexts), return_index=True)
    return np.unique(np.concatenate(grams)[first], return_counts=True)


def telling_runs(toxic: list[str], ordinary: list[str], least: int, ratio: float) -> dict[bytes, int]:
    """Runs of sequences that are `ratio` times as frequent in toxic texts, with their counts."""
    telling = {}
    for size in GRAMS:
        (gt, nt), (go, no) = context_counts(toxic, size), context_counts(ordinary, size)
        if len(gt) and len(go):
            at = np.minimum(np.searchsorted(go, gt), len(go) - 1)
            other = np.where(go[at] == gt, no[at], 0)
            telling[size] = gt[(nt >= least) & ((nt + 0.5) / nt.sum() >= ratio * (other + 0.5) / no.sum())]
    runs: dict[bytes, int] = {}
    for text in toxic:
        raw = _lower(text)
        inside = np.zeros(len(raw) + 2, np.int8)
        for size, found in telling.items():
            hit = np.flatnonzero(np.isin(_grams(raw, size), found))
            for k in range(size):
                inside[hit + k + 1] = 1
        edge = np.flatnonzero(np.diff(inside))
        for i, j in zip(edge[::2], edge[1::2], strict=True):
            runs[raw[i:j]] = runs.get(raw[i:j], 0) + 1
    return runs


@dataclass
class ToxicityModel:
    ordinary: bytes = b""
    toxic: bytes = b""
    mean: list[float] = field(default_factory=list)
    scale: list[float] = field(default_factory=list)
    weights: list[float] = field(default_factory=list)
    base: float = 0.0

    def compressors(self) -> list[zstandard.ZstdCompressor]:
        """For windows of ordinary and of toxic text."""
        options = {"level": 3, "write_content_size": False, "write_checksum": False, "write_dict_id": False}
        raw = zstandard.DICT_TYPE_RAWCONTENT
        return [zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(d, dict_type=raw), **options) for d in (self.ordinary, self.ordinary + self.toxic)]


def gains(text: str, compressors: list[zstandard.ZstdCompressor]) -> np.ndarray:
    """Bytes that the toxic dictionary saves in each window."""
    plain, toxic = (c.compress for c in compressors)
    raw = _lower(text)
    windows = (raw[k : k + WINDOW] for k in range(0, max(1, len(raw) - (WINDOW - STEP)), STEP))
    return np.array([len(plain(w)) - len(toxic(w)) for w in windows])


def measures(gain: np.ndarray) -> list[float]:
    n = len(gain)
    counts = [int((gain >= k).sum()) for k in (1, 2, 3, 4)]
    return [np.log(n), *(c / n for c in counts), *(np.log1p(c) for c in counts[1:]), gain.clip(0).sum() / n, min(int(gain.max()), 12)]


def _trained(size: int, samples: list[bytes]) -> bytes:
    try:
        return zstandard.train_dictionary(size, samples, level=3).as_bytes()
    except zstandard.ZstdError:  # too little text to train on: all of it is the dictionary
        return b" ".join(samples)[-size:]


def trained(rows: list[tuple[str, int]], least: float = 0.012, ratio: float = 20.0, ordinary_bytes: int = 32768, toxic_bytes: int = 4096) -> ToxicityModel:
    """Both dictionaries. rows: text and whether it is toxic; least: contexts that a sequence needs, as a share of the toxic rows; ratio: see telling_runs."""
    toxic, ordinary = [t for t, y in rows if y], [t for t, y in rows if not y]
    if not toxic or not ordinary:
        return ToxicityModel(base=len(toxic) / len(rows) if rows else 0.0)
    runs = telling_runs(toxic, ordinary, max(4, round(least * len(toxic))), ratio)
    samples = [raw[k : k + 400] for raw in map(_lower, ordinary) for k in range(0, len(raw), 400)]  # pieces of about the size that the trainer looks for
    return ToxicityModel(ordinary=_trained(ordinary_bytes, samples), toxic=_trained(toxic_bytes, [r for r in sorted(runs) for _ in range(runs[r])]))


def calibrated(model: ToxicityModel, x: np.ndarray, y: np.ndarray) -> ToxicityModel:
    """The model with a logistic scale fitted to measures and labels."""
    mean, scale = x.mean(0), x.std(0) + 1e-9
    z = np.c_[np.ones(len(x)), (x - mean) / scale]
    w = np.zeros(z.shape[1])
    for _ in range(60):  # Newton's steps with a ridge of one
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.eye(len(w)), z.T @ (y - p) - w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    model.mean, model.scale, model.weights = mean.tolist(), scale.tolist(), w.tolist()
    return model


def fit(rows: list[tuple[str, int]], **options) -> ToxicityModel:
    """The model of a few rows at hand (text and whether it is toxic)."""
    model = trained(rows, **options)
    if not model.ordinary:
        return model
    compressors = model.compressors()
    return calibrated(model, np.array([measures(gains(t, compressors)) for t, _ in rows]), np.array([v for _, v in rows], float))


def fit_distributed(sample: DataFrame) -> ToxicityModel:
    """The model of a bounded sample (id, text, label): one task trains, all tasks measure."""

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for batch in batches for r in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
        model = trained(rows)
        yield pa.RecordBatch.from_arrays([pa.array([model.ordinary]), pa.array([model.toxic]), pa.array([model.base])], ["ordinary", "toxic", "base"])

    one = sample.select("text", "label").repartition(1).sortWithinPartitions("text", "label")
    row = one.mapInArrow(train, "ordinary binary, toxic binary, base double").collect()
    model = ToxicityModel(bytes(row[0].ordinary), bytes(row[0].toxic), base=row[0].base) if row else ToxicityModel()
    if not model.ordinary:
        return model
    shared = sample.sparkSession.sparkContext.broadcast(model)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressors = shared.value.compressors()
        for batch in batches:
            x = [measures(gains(t, compressors)) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), batch.column(1)], ["x", "label"])

    found = sample.select("text", "label").mapInArrow(measure, "x array<double>, label int").collect()  # at most max_rows rows of a few numbers
    found.sort()  # the order of the rows is not to show
    return calibrated(model, np.array([r.x for r in found]), np.array([r.label for r in found], float))


def score(text: str, model: ToxicityModel, compressors: list[zstandard.ZstdCompressor]) -> float:
    if not model.weights:
        return model.base
    z = (np.array(measures(gains(text, compressors))) - model.mean) / model.scale
    return float(1 / (1 + np.exp(-np.clip(model.weights[0] + z @ np.array(model.weights[1:]), -30, 30))))


def labelled_sample(
    docs: DataFrame, labels: DataFrame, label: str, folds: int, held_out: int, max_rows: int, max_bytes: int, id_col: str = "doc_id"
) -> DataFrame:
    """id, text and label of at most max_rows identifiers outside the held-out fold, in the order of a hash, with at most max_bytes of whole texts.

    A text that alone takes more than a 64th of max_bytes is not learned from, so no single one can take the place of many.
    """
    known = labels.where(F.col(label).isNotNull() & (fold_of(F.col(id_col), folds) != held_out))
    known = known.groupBy(F.col(id_col).alias("id")).agg(F.max(F.col(label).cast("int")).alias("label"))
    chosen = bounded_sample(known, "id", max_rows)
    rows = docs.select(F.col(id_col).alias("id"), text_or_empty().alias("text")).join(F.broadcast(chosen), "id").groupBy("id").agg(F.min("text").alias("text"), F.first("label").alias("label"))
    rows = written(rows.where(F.octet_length("text") <= max_bytes // 64), "labelled")
    sizes = rows.select("id", F.sum(F.octet_length("text")).over(Window.orderBy(F.xxhash64("id"), "id")).alias("so_far"))  # numbers of at most max_rows rows
    return rows.join(F.broadcast(sizes.where(F.col("so_far") <= max_bytes).select("id")), "id", "left_semi")


def toxicity(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", folds: int = 5, held_out: int = 0, max_rows: int = 6000, max_bytes: int = 16_000_000, threshold: float = 0.5
) -> DataFrame:
    """id, held_out, score and predicted of every document; labels of the held-out fold are never read."""
    model = fit_distributed(labelled_sample(docs, labels, "toxic", folds, held_out, max_rows, max_bytes, id_col))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        compressors = own.compressors()
        for batch in batches:
            scores = [score(t, own, compressors) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names)

    rows = docs.select(F.col(id_col), text_or_empty().alias("text"))
    names = [id_col, "score"]
    scored = rows.mapInArrow(run, f"`{id_col}` {rows.schema[0].dataType.simpleString()}, score double")
    return scored.select(
        id_col,
        (fold_of(F.col(id_col), folds) == held_out).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )
