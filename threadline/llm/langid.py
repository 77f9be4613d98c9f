"""Language identification: averaged hashed subword embeddings under a linear softmax.

A text is the average of the embeddings of the byte n-grams of its words, hashed into a fixed
number of rows; a linear softmax gives the languages. Both are trained together by stochastic
gradient descent in numpy on a bounded sample. A temperature fitted on texts kept aside calibrates
the probabilities, and the same texts set the score under which a text is rejected.

Applied to a word, embeddings and softmax weights are one table of n-gram logits, so a task works
out every distinct word once and a text costs one look-up per word.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadline.llm.common import WordTable, bounded_sample, filter_batches, fold, map_batches, mix64, row_sums, split_words, texts

BUCKETS = 1 << 16
DIMENSIONS = 16
NGRAMS = (1, 2, 3, 4)
#: Texts learned from: about so many of each language, none longer than so many characters.
PER_LANGUAGE = 500
LONGEST = 200_000
#: Share of the texts kept aside that may be rejected.
FALSE_REJECTIONS = 0.001
#: A text with at least this calibrated score is never rejected.
SURE = 0.5
UNDETERMINED = "und"

_LETTER = regex.compile(r"\p{L}")


def ngram_rows(words: list[bytes], buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the n-grams of all words (with a mark before and after), and their number for each.

    Words are lower-cased, digits are one sign, and bytes that are neither letters nor part of a
    character are left out, so that numbers and marks say nothing.
    """
    cleaned = [_clean(w) for w in words]
    data = np.frombuffer(b"".join(cleaned), np.uint8).astype(np.uint64)
    lengths = np.array([len(c) for c in cleaned], np.int64)
    owner = np.repeat(np.arange(len(words)), lengths)
    found, of = [], []
    for n in NGRAMS:
        if len(data) < n:
            continue
        total = len(data) - n + 1
        value = np.full(total, n, np.uint64)
        for k in range(n):
            value = value * np.uint64(257) + data[k : k + total]
        inside = owner[:total] == owner[n - 1 :]
        found.append((mix64(value[inside]) % np.uint64(buckets)).astype(np.int64))
        of.append(owner[:total][inside])
    if not found:
        return np.zeros(0, np.int64), np.zeros(len(words), np.int64)
    rows, of = np.concatenate(found), np.concatenate(of)
    order = np.argsort(of, kind="stable")
    return rows[order], np.bincount(of, minlength=len(words))


_DROP = bytes(b for b in range(128) if not (chr(b).isalpha() or chr(b) == "'"))


def _clean(word: bytes) -> bytes:
    kept = word.decode(errors="replace").lower().encode().translate(None, _DROP)
    return b"<" + kept + b">" if kept else b""


@dataclass
class LanguageModel:
    languages: list[str]
    embeddings: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    threshold: float = 0.0

    def table(self) -> np.ndarray:
        """Logits of every n-gram row."""
        return (self.embeddings @ self.weights).astype(np.float32)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(sample: list[tuple[str, str]], buckets: int = BUCKETS, dimensions: int = DIMENSIONS, epochs: int = 12, rate: float = 2.0) -> LanguageModel:
    """A model from (text, language) pairs; every fifth text is kept aside for the calibration.

    Fewer than two languages give a model that always answers the one there is.
    """
    languages = sorted({lang for _, lang in sample})
    rng = np.random.default_rng(7)
    embeddings = rng.normal(0, 0.1, (buckets, dimensions))
    weights = np.zeros((dimensions, len(languages)))
    bias = np.zeros(len(languages))
    rows, shares, target = [], [], []
    for text, lang in sample:
        own, _ = ngram_rows(text.encode().split(), buckets)
        if len(own):
            kinds, counts = np.unique(own, return_counts=True)
            rows.append(kinds)
            shares.append(counts / counts.sum())
            target.append(languages.index(lang))
    order = rng.permutation(len(rows))
    aside, learn = order[::5], np.array([i for k, i in enumerate(order) if k % 5], int)
    if len(languages) > 1:
        balance = 1 / np.maximum(np.bincount([target[i] for i in learn], minlength=len(languages)), 1)
        balance *= len(learn) / len(languages)
        for epoch in range(epochs):
            step = rate * (1 - epoch / epochs)
            for i in rng.permutation(learn):
                mean = shares[i] @ embeddings[rows[i]]
                error = softmax((mean @ weights + bias)[None])[0]
                error[target[i]] -= 1
                error *= min(balance[target[i]], 4.0)
                back = weights @ error
                weights -= step * np.outer(mean, error)
                bias -= step * 0.1 * error
                embeddings[rows[i]] -= step * shares[i][:, None] * back[None] * 4
    model = LanguageModel(languages, embeddings.astype(np.float32), weights.astype(np.float32), bias.astype(np.float32))
    if len(aside) and len(languages) > 1:
        logits = np.array([shares[i] @ model.embeddings[rows[i]] @ model.weights + model.bias for i in aside])
        truth = np.array([target[i] for i in aside])
        grid = np.geomspace(0.05, 20, 121)
        loss = [-np.log(softmax(logits / t)[np.arange(len(truth)), truth] + 1e-12).mean() for t in grid]
        model.temperature = float(grid[int(np.argmin(loss))])
        best = softmax(logits / model.temperature).max(axis=1)
        model.threshold = float(min(np.quantile(best, FALSE_REJECTIONS), SURE))
    return model


def fit(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang", per_language: int = PER_LANGUAGE
) -> LanguageModel:
    """Learn from a bounded sample of the rows that are not held out (crc32 of the id, modulo 4, is not 2).

    The sample holds about ``per_language`` texts of each language, chosen by a hash of the id.
    """
    usable = docs.where((fold(id_column) != 2) & F.col(lang_column).isNotNull() & (F.length(text_column) <= LONGEST)).select(
        F.col(id_column).alias("id"), F.col(text_column).alias("text"), F.col(lang_column).alias("lang")
    )
    sample = bounded_sample(usable, "lang", per_language, "id").select("text", "lang").collect()
    return train([(r[0], r[1]) for r in sample])


def _predictor(docs: DataFrame, model: LanguageModel, text_column: str):
    """For each task, a function from batches to languages, scores and whether they are accepted."""
    shared = docs.sparkSession.sparkContext.broadcast((model.languages, model.table(), model.bias, model.temperature, model.threshold))

    def start():
        languages, logits_of, bias, temperature, threshold = shared.value

        def describe(words):
            rows, counts = ngram_rows(words, len(logits_of))
            return row_sums(logits_of[rows], counts).astype(np.float32), counts.astype(np.float32)

        words_of = WordTable(describe)

        def predict(batch):
            words, counts = split_words(batch, text_column)
            ids = words_of.ids(words)
            known = np.array([bool(_LETTER.search(t)) for t in texts(batch, text_column)]) & bool(languages)
            if not languages:
                return [UNDETERMINED] * len(counts), np.zeros(len(counts)), known
            if len(ids):
                total, grams = row_sums(words_of.values[0][ids], counts), row_sums(words_of.values[1][ids], counts)
            else:
                total, grams = np.zeros((len(counts), len(languages))), np.zeros(len(counts))
            chance = softmax((total / np.maximum(grams, 1)[:, None] + bias) / temperature)
            score = np.where(known, chance.max(axis=1), 0.0)
            names = [languages[b] if k else UNDETERMINED for b, k in zip(chance.argmax(axis=1), known, strict=True)]
            return names, score, known & (score >= threshold)

        return predict

    return start


def identify(docs: DataFrame, model: LanguageModel, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``id_column, lang_pred, score, accepted`` for every row.

    A null text or one without a letter is ``und`` with score 0 and not accepted. So is any text
    if the model knows no language. The score is the calibrated probability of the language.
    """
    task = _predictor(docs, model, text_column)

    def start():
        predict = task()

        def each(batch):
            names, score, accepted = predict(batch)
            return {
                id_column: batch.column(id_column),
                "lang_pred": pa.array(names, pa.string()),
                "score": pa.array(score, pa.float64()),
                "accepted": pa.array(accepted, pa.bool_()),
            }

        return each

    kind = docs.schema[id_column].dataType.simpleString()
    return map_batches(
        docs.select(id_column, text_column), start, f"`{id_column}` {kind}, lang_pred string, score double, accepted boolean"
    )


def accepted(docs: DataFrame, model: LanguageModel, text_column: str = "text") -> DataFrame:
    """The rows, with all their columns, whose language is accepted."""
    task = _predictor(docs, model, text_column)

    def start():
        predict = task()
        return lambda batch: predict(batch)[2]

    return filter_batches(docs, start)
