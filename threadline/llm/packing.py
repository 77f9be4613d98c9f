"""Token sequences of fixed length filled by sum-of-squares packing.

Documents become token ids, are cut into pieces only where they are longer than a sequence, and the
pieces are packed: each goes where the sum of the squared counts of open bins per residual gap
becomes smallest. Pieces are dealt evenly to shards by a hash, so that a shard is a bounded piece of
work whatever the size of the table; only lengths travel, never token ids. A shard leaves few bins
open, so the waste does not grow with the number of rows in it.
"""

from __future__ import annotations

import functools
import re
import zlib
from collections.abc import Iterator
from unicodedata import normalize

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from threadline.llm.common import list_array, long_array, map_batches, stage, texts

VOCABULARY = "word_bpe_49k.json"
END = 1
LENGTH = 4096
#: Pieces in a shard, about: the waste of a shard is a few sequences.
SHARD_PIECES = 1 << 16
#: Words whose ids a process remembers in each of two generations, one of them between tasks.
CACHE_WORDS = 250_000
#: Signs that no contraction of the tokenizer's pattern begins with.
SIGNS = ".,;:!?#$%&*|-()"
#: White space of ``str.split`` that is none to the tokenizer: U+001C to U+001F are tokens.
SEPARATORS = "\x1c\x1d\x1e\x1f"
_WORD = re.compile(rf"[\S{SEPARATORS}]+")


def split(text: str) -> list[str]:
    """The words between the tokenizer's white space."""
    return _WORD.findall(text) if any(c in text for c in SEPARATORS) else text.split()


class Encoder(dict):
    """Ids of white-space separated words as bytes; no match of the tokenizer's pattern crosses white space.

    The tokenizer composes characters and lower-cases them one by one before it matches, and neither
    step reaches across white space, so the ids of a text are those of its words in order. Letters
    before trailing signs are a match of their own, so both parts are looked up. New words of letters
    are encoded together: each is one match, and the last id of a match is one with a word end.

    Words are kept in two generations: when the younger is full it becomes the elder, whose words come
    back as they are met again, so that frequent words are never learned twice.
    """

    def __init__(self, path: str, limit: int = CACHE_WORDS):
        super().__init__()
        self._tokenizer = Tokenizer.from_file(path)
        self._limit = limit
        self._elder: dict[str, bytes] = {}
        vocabulary = self._tokenizer.get_vocab()
        self._final = np.zeros(max(vocabulary.values()) + 1, bool)
        self._final[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True

    def __missing__(self, word: str) -> bytes:
        self[word] = found = self._elder[word]
        return found

    def rest(self) -> None:
        """Keep one generation only: Python processes outlive their tasks."""
        self._elder = {}

    def _one(self, word: str) -> bytes:
        return np.array(self._tokenizer.encode(word, add_special_tokens=False).ids, "<u4").tobytes()

    def _learn(self, words: set[str]) -> None:
        parts = {w: w.rstrip(SIGNS) for w in words}
        # what is left without signs may have become known as a word of its own, with signs inside
        letters = {c for c in parts.values() if c.isalpha() and (c.isascii() or normalize("NFC", c).lower().isalpha())}
        plain = [c for c in letters if c not in self]
        for first in range(0, len(plain), 2000):
            some = plain[first : first + 2000]
            ids = np.array(self._tokenizer.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, "<u4")
            ends = np.flatnonzero(self._final[ids]) + 1
            if len(ends) == len(some):
                data, at = ids.tobytes(), [0, *(4 * ends).tolist()]
                self.update((w, data[a:b]) for w, a, b in zip(some, at, at[1:], strict=False))
            else:
                self.update((w, self._one(w)) for w in some)
        for word, core in parts.items():
            if word not in self:
                tail = word[len(core) :]
                if tail and core in letters:
                    if tail not in self:
                        self[tail] = self._one(tail)
                    self[word] = self[core] + self[tail]
                else:
                    self[word] = self._one(word)

    def ids(self, batch: list[str]) -> list[bytes]:
        """Ids of every text."""
        if len(self) > self._limit:
            self._elder = dict(self)
            self.clear()
        words = [split(text) for text in batch]
        self._learn(set().union(*words).difference(self).difference(self._elder))
        return [b"".join(map(self.__getitem__, own)) for own in words]


@functools.cache
def encoder(path: str) -> Encoder:
    """One for each Python process, so that what it has learned serves all tasks that it runs."""
    return Encoder(path)


def pieces(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    path: str | None = None,
    end: int = END,
    length: int = LENGTH,
    checksum: bool = False,
) -> DataFrame:
    """``id_column, piece, start, length, ids``: the pieces of every document, ``end`` included.

    With ``checksum`` the last column is ``ids_crc32``, the unsigned CRC-32 of the ids as bytes, and
    no ids leave the task. A null or empty text is the end token alone, so every row gives at least one piece. Rows with
    equal or null ids are documents of their own.
    """
    path = path or public_tokenizers.path(VOCABULARY)
    ending = np.array([end], "<u4").tobytes()
    width = 4 * length

    def start():
        coder = encoder(path)

        def each(batch):
            row, number, at, parts = [], [], [], []
            for i, own in enumerate(coder.ids(texts(batch, text_column))):
                ids = own + ending
                for k, a in enumerate(range(0, len(ids), width)):
                    row.append(i)
                    number.append(k)
                    at.append(a // 4)
                    parts.append(ids[a : a + width])
            return {
                id_column: batch.column(id_column).take(pa.array(row, pa.int64())),
                "piece": pa.array(number, pa.int32()),
                "start": long_array(np.array(at)),
                "length": long_array(np.array([len(p) // 4 for p in parts])),
            } | ({"ids_crc32": pa.array(map(zlib.crc32, parts), pa.int64())} if checksum else {"ids": pa.array(parts, pa.binary())})

        return each

    kind = docs.schema[id_column].dataType.simpleString()
    last = "ids_crc32 long" if checksum else "ids binary"
    return map_batches(
        docs.select(id_column, text_column),
        start,
        f"`{id_column}` {kind}, piece int, start long, length long, {last}",
        finish=lambda: encoder(path).rest(),
    )


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of every item, longest items first.

    ``open_bins[g]`` counts the bins with gap g. Putting an item of length s into a bin of gap g
    changes the sum of squares by 2 * (N[g - s] - N[g]) + 2; a bin filled up (g = s) leaves by
    1 - 2 * N[s], a new bin enters by 2 * N[capacity - s] + 1. The smallest change wins, ties go to
    the smallest gap, and a new bin is the last choice. Items must be 1 to ``capacity`` long.
    """
    count = np.zeros(capacity + 1, np.int64)
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    used = 0
    for i in np.argsort(-lengths, kind="stable"):
        s = int(lengths[i])
        gap = 0
        if s < capacity:
            own = count[s:capacity]
            change = 2 * (count[: capacity - s] - own) + 2
            change[0] = 1 - 2 * own[0]
            change[own == 0] = np.iinfo(np.int64).max
            best = int(change.argmin())
            if own[best] and change[best] <= 2 * count[capacity - s] + 1:
                gap = best + s
        if gap:
            b = stacks[gap].pop()
            count[gap] -= 1
        else:
            b, gap = used, capacity
            used += 1
        bins[i], offsets[i] = b, capacity - gap
        if gap > s:
            stacks[gap - s].append(b)
            count[gap - s] += 1
    return bins, offsets


def pack(cut: DataFrame, key: str = "doc_id", length: int = LENGTH, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """The pieces (columns ``key``, piece, length, and any others) with ``sequence_id, offset``.

    Sequence ids are unique, offsets gapless from 0. An empty table gives an empty table. Pieces
    that are equal in everything are packed each.
    """
    kept = [c for c in cut.columns if c not in ("sequence_id", "offset", "__shard")]
    total = cut.count()
    shards = max(1, -(-total // shard_pieces))
    place = F.pmod(F.xxhash64(F.lit("shard"), F.col(key), F.col("piece")), F.lit(shards)).alias("__shard")

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(list(batches)).sort_by([("length", "descending"), (key, "ascending"), ("piece", "ascending")])
        bins, offsets = sum_of_squares(rows.column("length").to_numpy(), length)
        shard = rows.column("__shard")[0].as_py()
        out = rows.select(kept).append_column("sequence_id", pa.array(bins * shards + shard)).append_column("offset", pa.array(offsets))
        yield from out.combine_chunks().to_batches()

    schema = ", ".join(f"`{c}` {cut.schema[c].dataType.simpleString()}" for c in kept)
    return cut.select(*kept, place).groupBy("__shard").applyInArrow(fill, f"{schema}, sequence_id long, offset long")


def pack_documents(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", path: str | None = None, length: int = LENGTH
) -> DataFrame:
    """``id_column, piece, start, length, ids_crc32, sequence_id, offset`` of every piece."""
    cut = stage(pieces(docs, id_column, text_column, path, END, length, checksum=True), "pieces")
    return pack(cut, id_column, length)


def sequences(cut: DataFrame, packed: DataFrame, key: str = "doc_id") -> DataFrame:
    """``sequence_id, input_ids, lengths``: the filled sequences, pieces in the order of their offsets.

    ``cut``: the pieces with their ids; ``packed``: their places. Keys must be unique and not null.
    """
    placed = cut.select(key, "piece", "ids").join(packed.select(key, "piece", "sequence_id", "offset", "length"), [key, "piece"])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(list(batches)).sort_by("offset")
        data = np.frombuffer(b"".join(rows.column("ids").to_pylist()), "<u4")
        yield pa.RecordBatch.from_pydict(
            {
                "sequence_id": rows.column("sequence_id").slice(0, 1).combine_chunks(),
                "input_ids": list_array(np.array([len(data)]), data.astype(np.int64), pa.int64()),
                "lengths": list_array(np.array([rows.num_rows]), rows.column("length").to_numpy(), pa.int64()),
            }
        )

    return placed.groupBy("sequence_id").applyInArrow(join, "sequence_id long, input_ids array<long>, lengths array<long>")
