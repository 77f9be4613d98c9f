"""Quality rules: text statistics, fixed base rules and a learned decision list.

Sequential covering on labelled statistics: a rule is a conjunction of thresholds, grown on two
thirds of the rows until it covers no good text (or nothing helps), pruned on the other third to
the prefix that is right there most often, and taken if it is right often enough. What it covers is
removed and the next rule is grown. The list becomes one ordered Spark conditional.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadline.llm.common import WordTable, bounded_sample, fold, long_array, map_batches, row_sums, split_words, stage, texts

SYMBOLS = b"#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
PER_LABEL = 4000
#: Share of the rows kept for pruning that a rule must be right about, and how many it must cover.
PRECISION = 0.98
COVER = 5
MAX_RULES = 12
MAX_CONDITIONS = 4

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct", "n_again", "n_upper", "n_marks")
#: What the rules are learned on: shares of the counts, null where there is nothing to share.
RATIOS = {
    "symbol_share": ("n_symbols", "word_chars"),
    "mark_share": ("n_marks", "word_chars"),
    "word_length": ("word_chars", "n_words"),
    "upper_share": ("n_upper", "n_words"),
    "repeat_share": ("n_repeat_words", "n_words"),
    "distinct_share": ("n_distinct", "n_words"),
    "again_share": ("n_again", "n_words"),
    "dup_line_share": ("n_dup_lines", "n_lines"),
}


def _describe(words: list[bytes]) -> tuple[np.ndarray, ...]:
    rows = np.zeros((len(words), 4), np.int64)
    others = bytes(b for b in range(256) if b not in SYMBOLS)
    letters = bytes(b for b in range(256) if b >= 128 or chr(b).isalnum())
    for i, word in enumerate(words):
        text = word.decode(errors="replace")
        rows[i] = len(text), len(word.translate(None, others)), len(text) > 1 and text.isupper(), len(word.translate(None, letters))
    return (rows,)


def repeat_words(ids: np.ndarray) -> int:
    """Words that lie in a window of three words found more than once, the first find included."""
    if len(ids) < 4:
        return 0
    if int(ids.max()) < 1 << 21:
        windows = (ids[:-2] << 42) | (ids[1:-1] << 21) | ids[2:]
    else:
        _, local = np.unique(ids, return_inverse=True)
        _, pairs = np.unique(local[:-1] * len(ids) + local[1:], return_inverse=True)
        windows = pairs[:-1] * len(ids) + local[2:]
    _, inverse, counts = np.unique(windows, return_inverse=True, return_counts=True)
    repeated = counts[inverse] > 1
    covered = np.zeros(len(ids), bool)
    for k in range(3):
        covered[k : k + len(repeated)] |= repeated
    return int(covered.sum())


def _line_counts(text: str) -> tuple[int, int]:
    """Lines with a word, and those of them that are equal to an earlier line."""
    lines = [x for x in text.split("\n") if x.strip(" \t\n\r\x0b\x0c")]
    return len(lines), len(lines) - len(set(lines))


def statistics(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``id_column`` and the counts of every whole text; a null text has none of anything."""

    def start():
        table = WordTable(_describe)

        def each(batch):
            words, counts = split_words(batch, text_column)
            ids = table.ids(words)
            own = row_sums(table.values[0][ids], counts) if len(ids) else np.zeros((len(counts), 4), np.int64)
            more = np.zeros((len(counts), 5), np.int64)
            at = 0
            for i, (text, n) in enumerate(zip(texts(batch, text_column), counts, strict=True)):
                part = ids[at : at + n]
                at += n
                lines, dup = _line_counts(text)
                more[i] = dup, repeat_words(part), lines, len(np.unique(part)), (part[1:] == part[:-1]).sum()
            columns = [counts, own[:, 0], own[:, 1], *more.T, own[:, 2], own[:, 3]]
            return {id_column: batch.column(id_column)} | {c: long_array(v) for c, v in zip(COUNTS, columns, strict=True)}

        return each

    kind = docs.schema[id_column].dataType.simpleString()
    return map_batches(docs.select(id_column, text_column), start, f"`{id_column}` {kind}, " + ", ".join(f"{c} long" for c in COUNTS))


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def ratios() -> list[Column]:
    return [(F.col(a) / F.nullif(F.col(b), F.lit(0))).alias(name) for name, (a, b) in RATIOS.items()]


@dataclass(frozen=True)
class Condition:
    name: str
    above: bool
    bound: float

    def holds(self, values: dict[str, np.ndarray]) -> np.ndarray:
        with np.errstate(invalid="ignore"):
            return values[self.name] >= self.bound if self.above else values[self.name] <= self.bound

    def expression(self) -> Column:
        a, b = RATIOS[self.name]
        share = F.col(a) / F.nullif(F.col(b), F.lit(0))
        return F.coalesce(share >= F.lit(self.bound) if self.above else share <= F.lit(self.bound), F.lit(False))

    def __str__(self) -> str:
        return f"{self.name} {'>=' if self.above else '<='} {self.bound:.6g}"


Rule = tuple[Condition, ...]


def covers(rule: Iterable[Condition], values: dict[str, np.ndarray]) -> np.ndarray:
    out = np.ones(len(next(iter(values.values()))), bool)
    for condition in rule:
        out &= condition.holds(values)
    return out


def _grow(values: dict[str, np.ndarray], bad: np.ndarray) -> Rule:
    """Conditions by the gain in information about the bad rows, cuts halfway between values."""
    inside, rule = np.ones(len(bad), bool), []
    while len(rule) < MAX_CONDITIONS and (inside & ~bad).any():
        p0, n0 = (inside & bad).sum(), (inside & ~bad).sum()
        best = None
        for name, column in values.items():
            rows = np.flatnonzero(inside & ~np.isnan(column))
            rows = rows[np.argsort(column[rows], kind="stable")]
            if len(rows) < 2:
                continue
            v, p = column[rows], np.cumsum(bad[rows])
            n = np.arange(1, len(rows) + 1) - p
            cuts = np.flatnonzero(v[1:] > v[:-1])
            for above in (False, True):
                tp = p[-1] - p[cuts] if above else p[cuts]
                fp = n[-1] - n[cuts] if above else n[cuts]
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = np.where(tp > 0, tp * (np.log2(tp / (tp + fp)) - np.log2(p0 / (p0 + n0))), -np.inf)
                if len(gain) and (best is None or gain.max() > best[0] + 1e-9):
                    k = cuts[int(gain.argmax())]
                    best = (gain.max(), Condition(name, above, float((v[k] + v[k + 1]) / 2)))
        if best is None or best[0] <= 1e-9:
            break
        rule.append(best[1])
        inside &= best[1].holds(values)
    return tuple(rule)


def _prune(rule: Rule, values: dict[str, np.ndarray], bad: np.ndarray) -> tuple[Rule, float, int]:
    """The prefix with the best (p - n) / (p + n), its share of right answers and how many it covers."""
    best = ((), -1.0, 0.0, 0)
    for k in range(1, len(rule) + 1):
        inside = covers(rule[:k], values)
        p, n = (inside & bad).sum(), (inside & ~bad).sum()
        worth = (p - n) / (p + n) if p + n else -1.0
        if worth > best[1]:
            best = (rule[:k], worth, p / (p + n), int(p + n))
    return best[0], best[2], best[3]


def learn(values: dict[str, np.ndarray], bad: np.ndarray) -> list[Rule]:
    """An ordered list of rules for bad texts; empty if there is nothing to learn from."""
    rules: list[Rule] = []
    left = np.ones(len(bad), bool)
    rng = np.random.default_rng(5)
    failures = 0
    while len(rules) < MAX_RULES and failures < 3 and (left & bad).sum() >= COVER and (left & ~bad).any():
        rows = rng.permutation(np.flatnonzero(left))
        grow, hold = rows[len(rows) // 3 :], rows[: len(rows) // 3]
        part = lambda at: ({k: v[at] for k, v in values.items()}, bad[at])
        rule, right, cover = _prune(_grow(*part(grow)), *part(hold))
        hit = covers(rule, values) & left if rule else np.zeros(len(bad), bool)
        if right < PRECISION or cover < COVER or (hit & bad).sum() < PRECISION * hit.sum():
            failures += 1
            continue
        rules.append(rule)
        left &= ~hit
    return rules


def fit(stats: DataFrame, labels: DataFrame, id_column: str = "doc_id", label_column: str = "quality", per_label: int = PER_LABEL) -> list[Rule]:
    """Rules from the statistics of about ``per_label`` labelled rows of each label, held-out rows left out."""
    known = stage(
        labels.where((fold(id_column) != 2) & F.col(label_column).isin(0, 1))
        .groupBy(F.col(id_column).alias("id"))
        .agg(F.min(label_column).cast("int").alias("label"), F.max(label_column).cast("int").alias("most"))
        .where(F.col("label") == F.col("most"))
        .select("id", "label"),
        "labels",
    )
    sample = bounded_sample(known, "label", per_label, "id")
    rows = (
        stats.where(~base_failed())
        .join(F.broadcast(sample), stats[id_column] == sample["id"])
        .select("id", "label", *ratios())
        .collect()
    )
    rows = sorted(rows, key=lambda r: r["id"])
    values = {name: np.array([np.nan if r[name] is None else r[name] for r in rows], float) for name in RATIOS}
    return learn(values, np.array([r["label"] == 0 for r in rows], bool)) if rows else []


def verdict(rules: list[Rule]) -> Column:
    """True for a text that passes the base rules and that no rule of the list catches."""
    out = F.when(base_failed(), F.lit(False))
    for rule in rules:
        caught = rule[0].expression()
        for condition in rule[1:]:
            caught = caught & condition.expression()
        out = out.when(caught, F.lit(False))
    return out.otherwise(F.lit(True))


def judge(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", label_column: str = "quality") -> tuple[DataFrame, list[Rule]]:
    """Statistics with ``base_failed`` and ``kept`` for every row, and the rules that were learned.

    Null, empty and short texts fail the base rules. Without labels the base rules decide alone.
    """
    stats = stage(statistics(docs, id_column, text_column), "statistics")
    rules = fit(stats, labels, id_column, label_column)
    return stats.select(id_column, *COUNTS, base_failed().alias("base_failed"), verdict(rules).alias("kept")), rules
