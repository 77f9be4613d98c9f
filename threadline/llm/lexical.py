"""Ranked lexical search: dense blocked matrix products of item vocabulary and document impacts.

Items (queries) are dealt into blocks of bounded size. For one block the documents are scanned once
and kept as sparse rows over the vocabulary of the block: impact tiles. Tasks turn a batch of these
rows into dense tiles of documents times terms, multiply them with tiles of terms times items in
float64, and keep the best documents of every item. Every partial sum of a tile is an integer below
2^53, so the products are exact; tiles are added up as 64-bit integers.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threadline.llm.common import list_array, long_array, map_batches, prepare, release, stage, texts

# A-Z in lower case, every other ASCII character that is no digit or letter a blank.
TERM_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)

#: Items, and distinct terms over all items, of one block: what is sent to tasks is never larger.
BLOCK_ITEMS = 2048
BLOCK_TERMS = 1 << 18
#: Terms of one dense tile at most, and the largest integers that float64 holds without gaps.
TILE_TERMS = 512
EXACT = 1 << 53
#: An impact is below this, whatever the frequency.
LARGEST_IMPACT = 1_000_000
#: First-level groups of the merge of an item's answers.
SPREAD = 64


def terms_of(text: str) -> list[bytes]:
    """The terms of a whole text: maximal runs of digits, letters a-z and characters beyond ASCII."""
    return text.encode().translate(TERM_BYTES).split()


@dataclass(frozen=True)
class Block:
    """Items of one block: ids, vocabulary, and which items hold which term (grouped by term)."""

    items: list
    vocabulary: list[bytes]
    starts: np.ndarray
    holders: np.ndarray


@dataclass(frozen=True)
class Statistics:
    documents: int
    occurrences: int
    weights: np.ndarray


def item_terms(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """Distinct (id, term) of the items; a null id is no item, rows of one id are one item."""
    kind = items.schema[id_col].dataType

    def start():
        def each(batch: pa.RecordBatch) -> dict:
            own = [sorted(set(terms_of(t))) for t in texts(batch, text_col)]
            at = np.repeat(np.arange(batch.num_rows), [len(o) for o in own])
            words = pa.array([w for o in own for w in o], pa.binary()).cast(pa.string())
            return {id_col: batch.column(id_col).take(pa.array(at)), "term": words}

        return each

    rows = items.where(F.col(id_col).isNotNull()).select(id_col, text_col)
    return map_batches(rows, start, f"`{id_col}` {kind.simpleString()}, term string").distinct()


def item_blocks(pairs: DataFrame, id_col: str) -> tuple[DataFrame, int]:
    """Pairs with the number of their block, and how many blocks there are.

    Sizes are checked: blocks are made smaller until none is above its bounds, or each holds one item.
    """
    total = pairs.agg(F.count_distinct(id_col), F.count(F.lit(1))).first()
    if not total[0]:
        return pairs.withColumn("block", F.lit(0)), 0
    count = max(1, -(-total[0] // BLOCK_ITEMS), -(-total[1] // BLOCK_TERMS))
    while True:
        dealt = pairs.withColumn("block", F.pmod(F.xxhash64(id_col), F.lit(count)).cast("int"))
        sizes = dealt.groupBy("block").agg(F.count_distinct(id_col).alias("items"), F.count(F.lit(1)).alias("terms"))
        largest = sizes.agg(F.max("items"), F.max(F.when(F.col("items") > 1, F.col("terms")))).first()
        if largest[0] <= BLOCK_ITEMS and (largest[1] or 0) <= BLOCK_TERMS:
            return dealt, count
        count *= 2


def _collect_block(rows: DataFrame, id_col: str) -> Block:
    found = rows.select(id_col, "term").orderBy("term", id_col).collect()
    items = sorted({r[0] for r in found})
    place = {item: i for i, item in enumerate(items)}
    vocabulary, starts = [], []
    for at, (_, term) in enumerate(found):
        if not vocabulary or vocabulary[-1] != term:
            vocabulary.append(term)
            starts.append(at)
    return Block(
        items,
        [t.encode() for t in vocabulary],
        np.array([*starts, len(found)], np.int64),
        np.array([place[r[0]] for r in found], np.int64),
    )


def impact_rows(docs: DataFrame, vocabulary: list[bytes], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n, terms, tfs) per document: all its terms counted, and those of the vocabulary by number."""
    numbers = {term: i for i, term in enumerate(vocabulary)}
    width = len(vocabulary)

    def start():
        def each(batch: pa.RecordBatch) -> dict:
            n = np.zeros(batch.num_rows, np.int64)
            known = []
            for i, text in enumerate(texts(batch, text_col)):
                words = terms_of(text)
                n[i] = len(words)
                hits = [numbers[w] for w in words if w in numbers]
                known.append(np.array(hits, np.int64) + i * width)
            keys, tf = np.unique(np.concatenate(known), return_counts=True)
            lengths = np.bincount(keys // width, minlength=batch.num_rows)
            return {
                id_col: batch.column(id_col),
                "n": long_array(n),
                "terms": list_array(lengths, (keys % width).astype(np.int32), pa.int32()),
                "tfs": list_array(lengths, tf.astype(np.int32), pa.int32()),
            }

        return each

    return map_batches(docs.select(F.col(id_col).cast("long").alias(id_col), text_col), start, f"`{id_col}` long, n long, terms array<int>, tfs array<int>")


def statistics(rows: DataFrame, width: int) -> Statistics:
    """N, L and the weights of the terms, counted over all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(width, np.int64)
        for batch in batches:
            held += np.bincount(batch.column("terms").flatten().to_numpy(zero_copy_only=False), minlength=width)
        term = np.flatnonzero(held)
        yield pa.RecordBatch.from_pydict({"term": pa.array(term.astype(np.int32)), "df": pa.array(held[term])})

    prepare(rows.sparkSession)
    documents, occurrences = rows.agg(F.count_if(F.col("n") > 0), F.sum("n")).first()
    held = rows.select("terms").mapInArrow(run, "term int, df long").groupBy("term").agg(F.sum("df").alias("df")).collect()
    weights = np.zeros(width, np.int64)
    for term, df in held:  # at most BLOCK_TERMS rows
        weights[term] = math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))
    return Statistics(documents, occurrences or 0, weights)


def tile_width(weights: np.ndarray) -> int:
    """Terms of a tile such that no partial sum reaches 2^53."""
    heaviest = int(weights.max(initial=1)) * LARGEST_IMPACT
    return max(1, min(TILE_TERMS, (EXACT - 1) // max(heaviest, 1)))


def tile_scores(
    n: np.ndarray, lengths: np.ndarray, terms: np.ndarray, tfs: np.ndarray, block: Block, known: Statistics
) -> np.ndarray:
    """Scores of documents times items as 64-bit integers, by products of compact tiles."""
    rows = np.repeat(np.arange(len(n)), lengths)
    m = 10 + (90 * n * known.documents) // known.occurrences
    tfs = tfs.astype(np.int64)
    impact = (1_000_000_000 * tfs) // (1000 * tfs + 8 * m[rows])
    order = np.argsort(terms, kind="stable")
    rows, terms, impact = rows[order], terms[order], impact[order]
    scores = np.zeros((len(n), len(block.items)), np.int64)
    used, first = np.unique(terms, return_index=True)  # only terms that occur in the batch
    bounds = np.append(first, len(terms))
    width = tile_width(known.weights)
    for at in range(0, len(used), width):
        some = used[at : at + width]
        lo, hi = bounds[at], bounds[at + len(some)]
        left = np.zeros((len(n), len(some)))
        left[rows[lo:hi], np.searchsorted(some, terms[lo:hi])] = impact[lo:hi]
        counts = block.starts[some + 1] - block.starts[some]
        column = np.repeat(np.arange(len(some)), counts)
        held = block.holders[np.repeat(block.starts[some] - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())]
        right = np.zeros((len(some), len(block.items)))
        right[column, held] = known.weights[some][column]
        scores += (left @ right).astype(np.int64)
    return scores


class Best:
    """The k best documents of every item seen so far; equal scores go to the smaller id."""

    def __init__(self, items: int, k: int):
        self.k = k
        self.item = self.doc = self.score = np.empty(0, np.int64)
        self.floor = np.zeros(items, np.int64)  # the k-th score of an item, 0 while it has fewer

    def add(self, scores: np.ndarray, doc: np.ndarray) -> None:
        row, item = np.nonzero((scores > 0) & (scores >= self.floor))  # ties with the k-th stay in
        if not len(row):
            return
        items = np.concatenate([self.item, item])
        docs = np.concatenate([self.doc, doc[row]])
        found = np.concatenate([self.score, scores[row, item]])
        order = np.lexsort((docs, -found, items))
        items, docs, found = items[order], docs[order], found[order]
        starts = np.flatnonzero(np.r_[True, items[1:] != items[:-1]])
        rank = np.arange(len(items)) - np.repeat(starts, np.diff(np.append(starts, len(items))))
        kept = rank < self.k
        self.item, self.doc, self.score = items[kept], docs[kept], found[kept]
        full = rank == self.k - 1
        self.floor[items[full]] = found[full]


def _answers(rows: DataFrame, block: Block, known: Statistics, k: int, item_type: str, id_col: str, doc_col: str) -> DataFrame:
    """The best documents of every item within each task."""
    ids = pa.array(block.items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(len(block.items), k)
        for batch in batches:
            lists = batch.column("terms")
            lengths = np.diff(lists.offsets.to_numpy())
            scores = tile_scores(
                batch.column("n").to_numpy(),
                lengths,
                lists.flatten().to_numpy(zero_copy_only=False),
                batch.column("tfs").flatten().to_numpy(zero_copy_only=False),
                block,
                known,
            )
            best.add(scores, batch.column(doc_col).to_numpy(zero_copy_only=False))
        yield pa.RecordBatch.from_pydict(
            {id_col: ids.take(pa.array(best.item)), "doc": long_array(best.doc), "score": long_array(best.score)}
        )
        release()

    prepare(rows.sparkSession)
    # A document without id counts in the statistics but cannot be an answer.
    scored = rows.where(F.col(doc_col).isNotNull() & (F.size("terms") > 0))
    return scored.mapInArrow(run, f"`{id_col}` {item_type}, doc long, score long")


def search(
    docs: DataFrame,
    items: DataFrame,
    k: int = 10,
    item_id: str = "item_id",
    doc_id: str = "doc_id",
    item_text: str = "text",
    doc_text: str = "text",
) -> DataFrame:
    """The k best documents of every item: item id, rank (from 1), doc_id, score; only scores above 0.

    Null and empty texts have no terms: such documents count for nothing, such items get no rows, and
    so do items none of whose terms occurs. Rows that repeat a document id are documents of their own;
    rows that repeat an item id are one item with the terms of all. A null document id counts in the
    statistics but is never an answer; a null item id is ignored. Equal scores are ranked by id. Empty
    tables give no rows. Other columns of both tables are not read.
    """
    item_type = items.schema[item_id].dataType.simpleString()
    pairs = stage(item_terms(items, item_id, item_text), "item-terms")
    dealt, count = item_blocks(pairs, item_id)
    found = []
    for number in range(count):
        block = _collect_block(dealt.where(F.col("block") == number), item_id)
        if not block.items:
            continue
        rows = stage(impact_rows(docs, block.vocabulary, doc_id, doc_text), "impacts")
        known = statistics(rows, len(block.vocabulary))
        found.append(_answers(rows, block, known, k, item_type, item_id, doc_id))
    if not found:
        return docs.sparkSession.createDataFrame([], f"`{item_id}` {item_type}, rank int, `{doc_id}` long, score long")
    every = found[0]
    for more in found[1:]:
        every = every.union(more)
    order = [F.desc("score"), F.asc("doc")]
    # Every task sends k rows for an item: they are merged in two steps, so no item is one task's work.
    spread = every.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(SPREAD)))
    some = spread.withColumn("place", F.row_number().over(Window.partitionBy(item_id, "salt").orderBy(*order))).where(F.col("place") <= k)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy(item_id).orderBy(*order))).where(F.col("rank") <= k)
    return ranked.select(item_id, "rank", F.col("doc").alias(doc_id), "score")
