"""Quality classifier: random-indexing word vectors pooled per document under a two-layer network.

Random indexing: every term has a fixed sparse random index vector, and the vector of a term is the
sum of the index vectors of the terms near it, over all documents. The counts are whole numbers,
each task adds up its own and one aggregation by term row adds up the tasks, so the vectors cover
the whole corpus and do not depend on its partitions. Terms are hashed into a fixed number of rows.

A document is the average of the vectors of its terms. A two-layer network in numpy, fitted on a
bounded sample of labelled documents, turns that into a probability, and a temperature fitted on
labelled documents kept aside calibrates it.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadline.llm.common import WordTable, bounded_sample, filter_batches, fold, held_out, map_batches, prepare, row_sums, split_words, stage

ROWS = 1 << 13
DIMENSIONS = 32
#: Places of an index vector that are 1 or -1.
NONZERO = 4
#: Terms on either side that count as near.
WINDOW = 2
PER_LABEL = 2000
HIDDEN = 24
THRESHOLD = 0.7

# A word stands for up to three terms: its letters, its other characters, and how it is written.
_SIGNS = bytes(b for b in range(128) if not chr(b).isalnum())
_NOT_SIGNS = bytes(b for b in range(256) if b not in _SIGNS)


def word_terms(words: list[bytes], rows: int = ROWS) -> tuple[np.ndarray, np.ndarray]:
    """Row of the letters and row of the shape of every word.

    The shape tells the kind of signs in the word, whether it is all capitals, and its length class.
    """
    core = np.empty(len(words), np.uint64)
    shape = np.empty(len(words), np.uint64)
    for i, word in enumerate(words):
        text = word.decode(errors="replace")
        signs = word.translate(None, _NOT_SIGNS)
        upper = text.isupper() and len(text) > 1
        core[i] = xxhash.xxh3_64_intdigest(word.translate(None, _SIGNS).lower(), 5)
        shape[i] = xxhash.xxh3_64_intdigest(b"%s|%d|%d" % (bytes(sorted(set(signs)))[:3], upper, min(len(text) // 4, 3)))
    half = np.uint64(rows // 2)
    return (core % half).astype(np.int64), (half + shape % np.uint64(rows // 2 - 2)).astype(np.int64)


def index_vectors(rows: int = ROWS, dimensions: int = DIMENSIONS) -> np.ndarray:
    out = np.zeros((rows, dimensions), np.int64)
    for row in range(rows):
        rng = np.random.default_rng([row, 17])
        out[row, rng.choice(dimensions, NONZERO, replace=False)] = rng.choice([-1, 1], NONZERO)
    return out


def term_stream(words: list[bytes], counts: np.ndarray, table: WordTable, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Two terms for every word (letters, shape). A word equal to the one before has the last row as its shape."""
    ids = table.ids(words)
    if not len(ids):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    core, shape = table.values[0][ids], table.values[1][ids].copy()
    again = np.zeros(len(ids), bool)
    again[1:] = ids[1:] == ids[:-1]
    starts = (np.cumsum(counts) - counts)[counts > 0]
    again[starts] = False
    shape[again] = rows - 1
    return core, shape


def term_vectors(docs: DataFrame, text_column: str = "text", rows: int = ROWS, dimensions: int = DIMENSIONS, window: int = WINDOW) -> np.ndarray:
    """Unit vectors of all term rows, from the contexts in all documents."""
    names = [f"d{k}" for k in range(dimensions)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = index_vectors(rows, dimensions).astype(np.int32)
        table = WordTable(lambda words: word_terms(words, rows))
        total = np.zeros((rows, dimensions), np.int64)
        for batch in batches:
            words, counts = split_words(batch, text_column)
            core, shape = term_stream(words, counts, table, rows)
            starts = np.cumsum(counts) - counts
            for first, last in _spans(counts):
                a, b = starts[first], starts[last - 1] + counts[last - 1]
                if a < b:
                    _add_contexts(total, index, core[a:b], shape[a:b], np.repeat(np.arange(last - first), counts[first:last]), window)
        seen = np.flatnonzero(total.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), *(pa.array(total[seen, k]) for k in range(dimensions))], names=["row", *names])

    prepare(docs.sparkSession)
    parts = docs.select(text_column).mapInArrow(run, "row long, " + ", ".join(f"{n} long" for n in names))
    sums = parts.groupBy("row").agg(*(F.sum(n).alias(n) for n in names)).collect()  # one short row for each term row
    out = np.zeros((rows, dimensions))
    for r in sums:
        out[r[0]] = r[1:]
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    own = index_vectors(rows, dimensions) / np.sqrt(NONZERO)
    return ((out / np.maximum(norm, 1) + own) / 2).astype(np.float32)


def _spans(counts: np.ndarray, words: int = 1 << 15) -> list[tuple[int, int]]:
    """Consecutive texts with about so many words together."""
    ends = np.cumsum(counts)
    cuts = np.searchsorted(ends, np.arange(0, int(ends[-1]) if len(ends) else 0, words), side="right")
    cuts = np.unique(np.concatenate([cuts, [0, len(counts)]]))
    return list(itertools.pairwise(cuts.tolist()))


def _add_contexts(total, index, core, shape, owner, window) -> None:
    own = index[core] + index[shape]
    near = np.zeros_like(own)
    for d in range(1, window + 1):
        same = (owner[d:] == owner[:-d])[:, None]
        near[d:] += own[:-d] * same
        near[:-d] += own[d:] * same
    for terms in (core, shape):
        order = np.argsort(terms, kind="stable")
        sorted_terms = terms[order]
        firsts = np.flatnonzero(np.concatenate([[True], sorted_terms[1:] != sorted_terms[:-1]]))
        total[sorted_terms[firsts]] += np.add.reduceat(near[order], firsts, axis=0)


def _pooler(vectors: np.ndarray, text_column: str):
    """A function from batches to pooled vectors (letters and shapes apart), one row for each text."""
    rows = len(vectors)
    table = WordTable(lambda words: word_terms(words, rows))

    def pool(batch: pa.RecordBatch) -> np.ndarray:
        words, counts = split_words(batch, text_column)
        core, shape = term_stream(words, counts, table, rows)
        out = np.zeros((len(counts), 2 * vectors.shape[1]))
        starts = np.cumsum(counts) - counts
        for first, last in _spans(counts):
            a, b = (starts[first], starts[last - 1] + counts[last - 1]) if last > first else (0, 0)
            if a < b:
                own = counts[first:last]
                out[first:last] = np.hstack([row_sums(vectors[core[a:b]], own), row_sums(vectors[shape[a:b]], own)])
        return out / np.maximum(counts, 1)[:, None]

    return pool


@dataclass
class QualityModel:
    vectors: np.ndarray
    center: np.ndarray
    scale: np.ndarray
    first: tuple[np.ndarray, np.ndarray]
    second: tuple[np.ndarray, float]
    temperature: float = 1.0

    def logits(self, pooled: np.ndarray) -> np.ndarray:
        hidden = np.tanh((pooled - self.center) / self.scale @ self.first[0] + self.first[1])
        return hidden @ self.second[0] + self.second[1]

    def scores(self, pooled: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(pooled) / self.temperature, -50, 50)))


def train(vectors: np.ndarray, pooled: np.ndarray, labels: np.ndarray, hidden: int = HIDDEN, epochs: int = 60) -> QualityModel:
    """Adam on the log loss; every fifth row is kept aside for the temperature.

    Without both labels the score is the smoothed share of label 1.
    """
    width = pooled.shape[1] if pooled.size else 2 * vectors.shape[1]
    base = float(np.log((labels.sum() + 1) / (len(labels) - labels.sum() + 1)))
    rng = np.random.default_rng(11)
    if len(set(labels.tolist())) < 2 or len(labels) < 10:
        return QualityModel(vectors, np.zeros(width), np.ones(width), (np.zeros((width, hidden)), np.zeros(hidden)), (np.zeros(hidden), base))
    order = rng.permutation(len(labels))
    aside, learn = order[::5], np.array([i for k, i in enumerate(order) if k % 5])
    center, scale = pooled[learn].mean(axis=0), pooled[learn].std(axis=0) + 1e-3
    x, y = (pooled - center) / scale, labels.astype(float)
    params = [rng.normal(0, 1 / np.sqrt(width), (width, hidden)), np.zeros(hidden), rng.normal(0, 0.1, hidden), np.array(base)]
    m, v, t = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for _ in range(epochs):
        for part in np.array_split(rng.permutation(learn), max(1, len(learn) // 64)):
            h = np.tanh(x[part] @ params[0] + params[1])
            d = (1 / (1 + np.exp(-np.clip(h @ params[2] + params[3], -50, 50))) - y[part]) / len(part)
            back = np.outer(d, params[2]) * (1 - h * h)
            t += 1
            for k, g in enumerate((x[part].T @ back + 1e-3 * params[0], back.sum(axis=0), h.T @ d + 1e-3 * params[2], d.sum())):
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                params[k] = params[k] - 0.005 * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
    model = QualityModel(vectors, center, scale, (params[0], params[1]), (params[2], float(params[3])))
    logits, truth = model.logits(pooled[aside]), y[aside]
    grid = np.geomspace(0.25, 8, 61)
    loss = [np.logaddexp(0, np.where(truth > 0, -1, 1) * logits / s).mean() for s in grid]
    model.temperature = float(grid[int(np.argmin(loss))])
    return model


def fit(
    docs: DataFrame,
    labels: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    label_column: str = "quality",
    per_label: int = PER_LABEL,
) -> QualityModel:
    """Word vectors from all documents; the network from about ``per_label`` documents of each label.

    Labels of held-out rows (crc32 of the id, modulo 4, is 2) are never read. An id with different
    labels is left out, repeated labels count once, null labels are ignored. Both labels are learned
    in the proportion of the sample, then the bias is moved to the proportion of all labels.
    """
    vectors = term_vectors(docs, text_column)
    known = (
        labels.where((fold(id_column) != 2) & F.col(label_column).isin(0, 1))
        .groupBy(F.col(id_column).alias("id"))
        .agg(F.min(label_column).cast("int").alias("label"), F.max(label_column).cast("int").alias("most"))
        .where(F.col("label") == F.col("most"))
        .select("id", "label")
    )
    known = stage(known, "labels")
    totals = {r[0]: r[1] for r in known.groupBy("label").count().collect()}
    sample = bounded_sample(known, "label", per_label, "id")
    bound = docs.sparkSession.sparkContext.broadcast(vectors)
    rows = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text")).join(F.broadcast(sample), "id")

    def start():
        pool = _pooler(bound.value, "text")

        def each(batch):
            pooled = pool(batch)
            return {"label": batch.column("label"), "pooled": pa.array(list(pooled), pa.list_(pa.float64())), "id": batch.column("id").cast(pa.int64())}

        return each

    found = sorted(map_batches(rows, start, "label int, pooled array<double>, id long").collect(), key=lambda r: (r[2], r[0], r[1]))
    pooled = np.array([r[1] for r in found]) if found else np.zeros((0, 2 * vectors.shape[1]))
    target = np.array([r[0] for r in found], int)
    model = train(vectors, pooled, target)
    if len(totals) == 2 and len(set(target.tolist())) == 2:
        prior = np.log(totals[1] / totals[0]) - np.log(target.sum() / (len(target) - target.sum()))
        model.second = (model.second[0], model.second[1] + float(prior) * model.temperature)
    return model


def score(docs: DataFrame, model: QualityModel, id_column: str = "doc_id", text_column: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``id_column, held_out, score, predicted`` for every row; an empty or null text is scored as it is."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def start():
        own = shared.value
        pool = _pooler(own.vectors, text_column)

        def each(batch):
            chance = own.scores(pool(batch))
            return {
                id_column: batch.column(id_column),
                "score": pa.array(chance, pa.float64()),
                "predicted": pa.array((chance >= threshold).astype(np.int32), pa.int32()),
            }

        return each

    kind = docs.schema[id_column].dataType.simpleString()
    scored = map_batches(docs.select(id_column, text_column), start, f"`{id_column}` {kind}, score double, predicted int")
    return scored.select(id_column, held_out(id_column).alias("held_out"), "score", "predicted")


def good(docs: DataFrame, model: QualityModel, text_column: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows, with all their columns, that score at least the threshold."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def start():
        own = shared.value
        pool = _pooler(own.vectors, text_column)
        return lambda batch: own.scores(pool(batch)) >= threshold

    return filter_batches(docs, start)
