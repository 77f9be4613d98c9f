"""Toxicity by cumulative-link ordinal regression over sparse text features.

The grades are 0 (clean) and 1 to 3 (mild to severe). A score w.x is shared by all grades, and
ordered thresholds cut it: P(grade > k) = sigmoid(w.x - threshold_k). The expected severity is the
sum of these probabilities.

The features of a text are hashed words and word beginnings, each with the logarithm of one plus the
number of times the word occurs. All labelled texts that are not held out are counted to tell which
features toxic texts use and clean ones do not, and how strongly; these odds are where the weights
start, so that features too rare for the sample count as well. The labels say only whether a text is
toxic; the grade of a toxic text is the third that it falls into by how often it uses such features.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadline.llm.common import WordTable, bounded_sample, fold, held_out, long_array, map_batches, mix64, prepare, release, row_sums, split_words, stage

BUCKETS = 1 << 22
BEGINNINGS = (4, 5, 6, 7)
GRADES = 3
#: Labelled texts learned from, about, of each label; longer texts are not learned from.
PER_LABEL = 1500
LONGEST = 100_000
#: A feature tells toxic texts from clean ones if it is so many times as frequent there and the log
#: likelihood ratio against equal frequencies is at least this (chance: one in ten thousand). Counted
#: over all labelled texts, four toxic texts are enough if one text in nine is toxic.
TIMES = 10
EVIDENCE = 15.0
#: Share of its log odds that the weight of a feature starts with.
START = 0.25
#: One of so many clean texts of the sample is kept aside and neither counted nor learned from.
ASIDE = 5
#: Share of the clean texts kept aside that may pass for toxic.
FALSE_ALARMS = 0.005

_DROP = bytes(b for b in range(128) if not chr(b).isalnum())


def word_features(words: list[bytes], buckets: int = BUCKETS) -> tuple[np.ndarray]:
    """Features of every word: the word and its beginnings, without signs and in lower case; -1 for none."""
    out = np.full((len(words), 1 + len(BEGINNINGS)), -1, np.int64)
    for i, word in enumerate(words):
        text = word.translate(None, _DROP).decode(errors="replace").lower()
        if text:
            out[i, 0] = xxhash.xxh3_64_intdigest(text, 1) % buckets
            for k, n in enumerate(BEGINNINGS):
                if len(text) > n:
                    out[i, 1 + k] = xxhash.xxh3_64_intdigest(text[:n], 100 + n) % buckets
    return (out,)


def word_features_of(buckets: int) -> Callable[[list[bytes]], tuple[np.ndarray]]:
    return lambda words: word_features(words, buckets)


def _word_counts(ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct words of each text, how often they occur, and how many there are in each text."""
    kinds, times, sizes, at = [], [], np.zeros(len(counts), np.int64), 0
    for i, n in enumerate(counts):
        k, t = np.unique(ids[at : at + n], return_counts=True)
        kinds.append(k)
        times.append(t)
        sizes[i] = len(k)
        at += n
    return np.concatenate(kinds), np.concatenate(times), sizes


@dataclass
class SeverityModel:
    weights: np.ndarray  # for all buckets, zero for most
    thresholds: np.ndarray
    cut: float = 0.5  # a text is toxic if P(grade > 0) is above this

    def exceed(self, score: np.ndarray) -> np.ndarray:
        """P(grade > k) for k = 0, 1, 2 in columns."""
        return 1 / (1 + np.exp(-np.clip(score[:, None] - self.thresholds[None, :], -50, 50)))


@dataclass
class Telling:
    """The features that tell toxic texts from clean ones, ascending, and the log of their odds."""

    features: np.ndarray
    odds: np.ndarray


def telling_features(rows: DataFrame, buckets: int = BUCKETS) -> Telling:
    """Features counted over all ``rows`` (label, text): the number of texts of each label with each.

    Tasks give the counts of their texts, so no text has to fit the driver; what reaches it are
    features that tell, at most one for each bucket.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, seen, total = WordTable(word_features_of(buckets)), np.zeros((2, buckets), np.int32), [0, 0]
        for batch in batches:
            words, counts = split_words(batch, "text")
            ids, at = table.ids(words), 0
            for n, label in zip(counts, batch.column("label").to_pylist(), strict=True):
                if n:
                    own = np.unique(table.values[0][np.unique(ids[at : at + n])])
                    seen[label, own[own >= 0]] += 1
                total[label] += 1
                at += n
        found = np.flatnonzero(seen[1] | seen[0])
        for first in range(0, len(found) + 1, 1 << 16):
            part = found[first : first + (1 << 16)]
            rest = ([-1], *([n] for n in total)) if first == 0 else ((), (), ())
            columns = [np.concatenate([x, y]) for x, y in zip(rest, (part, seen[0, part], seen[1, part]), strict=True)]
            yield pa.RecordBatch.from_arrays([long_array(c) for c in columns], ["feature", "clean", "toxic"])
        del table, seen
        release()

    prepare(rows.sparkSession)
    tally = stage(
        rows.select("label", "text")
        .mapInArrow(count, "feature long, clean long, toxic long")
        .groupBy("feature")
        .agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
        .where("toxic > 0 OR feature < 0"),
        "evidence",
    )
    whole = tally.where("feature < 0").first()
    if not whole or not whole["clean"] or not whole["toxic"]:
        return Telling(np.zeros(0, np.int64), np.zeros(0))
    clean, toxic = float(whole["clean"]), float(whole["toxic"])
    both = (F.col("clean") + F.col("toxic")) / (clean + toxic)
    ratio = 2 * (
        F.when(F.col("clean") > 0, F.col("clean") * F.log(F.col("clean") / (both * clean))).otherwise(0.0)
        + F.col("toxic") * F.log(F.col("toxic") / (both * toxic))
    )
    found = (
        tally.where((F.col("feature") >= 0) & (F.col("toxic") / toxic >= TIMES * F.col("clean") / clean) & (ratio >= EVIDENCE))
        .toPandas()
        .sort_values("feature")
    )
    odds = np.log((found.toxic.to_numpy() + 0.5) / (toxic + 1)) - np.log((found.clean.to_numpy() + 0.5) / (clean + 1))
    return Telling(found.feature.to_numpy(np.int64), odds.astype(float))


def grades(docs: list[tuple[np.ndarray, np.ndarray]], toxic: np.ndarray) -> np.ndarray:
    """0 for clean texts; toxic texts by thirds of the sum of their telling features."""
    use = np.array([values.sum() for _, values in docs])
    cuts = np.quantile(use[toxic == 1], [1 / 3, 2 / 3])
    return np.where(toxic == 1, 1 + (use > cuts[0]).astype(int) + (use > cuts[1]), 0)


def train(
    docs: list[tuple[np.ndarray, np.ndarray]], toxic: np.ndarray, aside: np.ndarray, telling: Telling, buckets: int = BUCKETS,
    epochs: int = 40, rate: float = 0.3, l1: float = 5e-5,
) -> SeverityModel:
    """Adagrad on the likelihood of the grades, weights drawn towards zero, from the odds of ``telling``.

    ``docs`` hold telling features only. The texts ``aside`` set the probability above which a text
    counts as toxic. Without toxic or without clean texts every text gets the same low or high score.
    """
    weights, thresholds = np.zeros(buckets), np.array([0.5, 1.5, 2.5])
    if len(set(toxic.tolist())) < 2:
        return SeverityModel(weights, thresholds + (3 if not toxic.any() else -6))
    weights[telling.features] = START * telling.odds
    size, size_t = np.full(buckets, 1e-6), np.full(GRADES, 1e-6)
    rng = np.random.default_rng(3)
    kept, learn = docs, np.flatnonzero(~aside)
    grade = grades(kept, toxic)
    for _ in range(epochs):
        for i in rng.permutation(learn):
            features, values = kept[i]
            x = float(weights[features] @ values)
            above = 1 / (1 + np.exp(-np.clip(x - thresholds, -50, 50)))
            # d log P(grade) / d x and / d threshold
            g = grade[i]
            upper, lower = above[g - 1] if g else 1.0, above[g] if g < GRADES else 0.0
            chance = max(upper - lower, 1e-9)
            du, dl = upper * (1 - upper) if g else 0.0, lower * (1 - lower) if g < GRADES else 0.0
            dx = np.clip((du - dl) / chance, -2, 2)
            dt = np.zeros(GRADES)
            if g:
                dt[g - 1] = -du / chance
            if g < GRADES:
                dt[g] = dl / chance
            dt = np.clip(dt, -2, 2)
            size_t += dt * dt
            thresholds = thresholds + rate * dt / np.sqrt(size_t)
            for k in range(1, GRADES):
                thresholds[k] = max(thresholds[k], thresholds[k - 1] + 0.05)
            if len(features):
                step = dx * values
                np.add.at(size, features, step * step)
                np.add.at(weights, features, rate * step / np.sqrt(size[features]))
                weights[features] = np.sign(weights[features]) * np.maximum(np.abs(weights[features]) - l1, 0)
    model = SeverityModel(weights, thresholds)
    clean = np.array([weights[docs[i][0]] @ docs[i][1] for i in np.flatnonzero(aside)])
    if len(clean):
        model.cut = float(min(0.5, 1.1 * np.quantile(model.exceed(clean)[:, 0], 1 - FALSE_ALARMS)))
    return model


def fit(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", label_column: str = "toxic", per_label: int = PER_LABEL) -> SeverityModel:
    """Count features in all labelled texts, learn from about ``per_label`` of each label.

    Labels of held-out rows are never read.

    An id with different labels is left out, repeated labels count once, null labels are ignored.
    """
    known = stage(
        labels.where((fold(id_column) != 2) & F.col(label_column).isin(0, 1))
        .groupBy(F.col(id_column).alias("id"))
        .agg(F.min(label_column).cast("int").alias("label"), F.max(label_column).cast("int").alias("most"))
        .where(F.col("label") == F.col("most"))
        .select("id", "label"),
        "labels",
    )
    aside = (F.col("label") == 0) & (F.pmod(F.xxhash64(F.lit("aside"), F.col("id")), F.lit(ASIDE)) == 0)
    sample = stage(bounded_sample(known, "label", per_label, "id").withColumn("aside", aside), "sample")
    usable = docs.where((F.length(text_column) <= LONGEST) & (fold(id_column) != 2)).select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    counted = known.join(F.broadcast(sample.where("aside").select("id")), "id", "left_anti")
    # Labels grow with the texts: a merge at every size, so that the work stays in proportion.
    telling = telling_features(usable.join(counted.hint("merge"), "id"))
    rows = usable.join(F.broadcast(sample), "id")
    shared = docs.sparkSession.sparkContext.broadcast(telling.features)

    def start():
        table = WordTable(word_features)

        def each(batch):
            words, counts = split_words(batch, "text")
            ids = table.ids(words)
            features, values, at = [], [], 0
            for n in counts:
                kinds, times = np.unique(ids[at : at + n], return_counts=True)
                at += n
                own = table.values[0][kinds] if len(kinds) else np.zeros((0, 1 + len(BEGINNINGS)), np.int64)
                there = np.isin(own, shared.value)
                features.append(own[there].astype("<i4").tobytes())
                values.append(np.broadcast_to(np.log1p(times)[:, None], own.shape)[there].astype("<f4").tobytes())
            return {
                "id": batch.column("id").cast(pa.int64()),
                "label": batch.column("label"),
                "aside": batch.column("aside"),
                "features": pa.array(features, pa.binary()),
                "counts": pa.array(values, pa.binary()),
            }

        return each

    found = map_batches(rows, start, "id long, label int, aside boolean, features binary, counts binary").collect()
    found = sorted(found, key=lambda r: (r[0], bytes(r[3])))
    own = [(np.frombuffer(r[3], "<i4").astype(np.int64), np.frombuffer(r[4], "<f4").astype(float)) for r in found]
    return train(own, np.array([r[1] for r in found], int), np.array([r[2] for r in found], bool), telling)


def severity(docs: DataFrame, model: SeverityModel, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``id_column, held_out, severity, grade, toxic`` for every row.

    ``severity`` is the expected grade (0 to 3); ``toxic`` tells whether the probability of a grade
    above 0 is over the model's cut; ``grade`` is 0 for the others and for toxic texts at least 1,
    more by each further grade that is exceeded more likely than not. Null and empty texts have no
    features and get the severity of the thresholds alone.
    """
    used = np.flatnonzero(model.weights)
    shared = docs.sparkSession.sparkContext.broadcast((used, model.weights[used], model.thresholds, model.cut, len(model.weights)))

    def start():
        at, values, thresholds, cut, buckets = shared.value
        weights = np.zeros(buckets + 1)  # the last, for -1, stays zero
        weights[at] = values
        table = WordTable(lambda words: (weights[word_features(words, buckets)[0]].sum(axis=1),))
        own = SeverityModel(weights, thresholds)

        def each(batch):
            words, counts = split_words(batch, text_column)
            ids = table.ids(words)
            score = np.zeros(len(counts))
            if len(ids):
                telling = table.values[0][ids] != 0
                owner = np.repeat(np.arange(len(counts)), counts)[telling]
                kinds, sizes = ids[telling], np.bincount(owner, minlength=len(counts))
                words_of, times, distinct = _word_counts(kinds, sizes)
                score = row_sums(table.values[0][words_of] * np.log1p(times), distinct)
            above = own.exceed(score)
            toxic = above[:, 0] > cut
            grade = np.where(toxic, 1 + (above[:, 1:] >= 0.5).sum(axis=1), 0)
            return {
                id_column: batch.column(id_column),
                "severity": pa.array(above.sum(axis=1), pa.float64()),
                "grade": pa.array(grade, pa.int32()),
                "toxic": pa.array(toxic, pa.bool_()),
            }

        return each

    kind = docs.schema[id_column].dataType.simpleString()
    scored = map_batches(docs.select(id_column, text_column), start, f"`{id_column}` {kind}, severity double, grade int, toxic boolean")
    return scored.select(id_column, held_out(id_column).alias("held_out"), "severity", "grade", "toxic")
