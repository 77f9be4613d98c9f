"""Sets of word shingles as 64-bit numbers, and min-max signatures of them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash

from threadline.llm.common import WordTable, mix64, split_words

SHINGLE = 5
#: Shingles worked on at a time; keeps the arrays of one permutation in the processor's cache.
CHUNK = 1 << 16
_WORD_SEED = 0x5EED


def _odd(seed: int, count: int) -> np.ndarray:
    state = np.uint64(seed) + np.arange(1, count + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return mix64(state) | np.uint64(1)


_PLACE = _odd(11, SHINGLE)


def word_hashes(words: list[bytes]) -> tuple[np.ndarray]:
    return (np.fromiter((xxhash.xxh3_64_intdigest(w, _WORD_SEED) for w in words), np.uint64, len(words)),)


def sequence_hash(hashes: np.ndarray) -> np.uint64:
    """Hash of a text of fewer words than a shingle; differs from every full shingle's by its length."""
    with np.errstate(over="ignore"):
        return mix64((hashes * _PLACE[: len(hashes)]).sum(dtype=np.uint64) + np.uint64(len(hashes)) * np.uint64(0xD6E8FEB86659FD93))


def shingle_sets(batch: pa.RecordBatch, column: str, table: WordTable) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingles of all texts, one text after another, and their number in each."""
    words, counts = split_words(batch, column, lower=True)
    ids = table.ids(words)
    hashes = table.values[0][ids] if len(ids) else np.zeros(0, np.uint64)
    full = len(hashes) - SHINGLE + 1
    with np.errstate(over="ignore"):
        runs = np.zeros(max(full, 0), np.uint64)
        for k in range(SHINGLE):
            runs += hashes[k : k + max(full, 0)] * _PLACE[k]
    runs = mix64(runs)
    sets, sizes, start = [], np.zeros(len(counts), np.int64), 0
    for i, n in enumerate(counts):
        if n >= SHINGLE:
            own = np.unique(runs[start : start + n - SHINGLE + 1])
        elif n:
            own = np.array([sequence_hash(hashes[start : start + n])], np.uint64)
        else:
            own = np.zeros(0, np.uint64)
        sets.append(own)
        sizes[i] = len(own)
        start += n
    return (np.concatenate(sets) if sets else np.zeros(0, np.uint64)), sizes


def set_keys(values: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits that tell sets apart, as two columns of signed numbers."""
    keys, start = np.zeros((len(sizes), 2), np.uint64), 0
    for i, n in enumerate(sizes):
        digest = xxhash.xxh3_128_intdigest(values[start : start + n].tobytes())
        keys[i] = digest >> 64, digest & 0xFFFFFFFFFFFFFFFF
        start += n
    return keys[:, 0].view(np.int64), keys[:, 1].view(np.int64)


def min_max_signatures(values: np.ndarray, sizes: np.ndarray, permutations: int) -> np.ndarray:
    """Smallest and largest value of every set under each permutation: two columns for one hash.

    The permutations are linear maps of the (already mixed) 64-bit numbers. Empty sets get zeros.
    """
    factors, shifts = _odd(101, permutations), _odd(202, permutations)
    out = np.zeros((len(sizes), 2 * permutations), np.uint64)
    rows = np.flatnonzero(sizes)
    ends = np.cumsum(sizes[rows])
    done = 0
    while done < len(rows):
        base = ends[done] - sizes[rows[done]]
        last = max(done + 1, int(np.searchsorted(ends, base + CHUNK)))
        own = rows[done:last]
        part = values[base : ends[last - 1]]
        starts = ends[done:last] - sizes[own] - base
        for p in range(permutations):
            with np.errstate(over="ignore"):
                turned = part * factors[p] + shifts[p]
            out[own, 2 * p] = np.minimum.reduceat(turned, starts)
            out[own, 2 * p + 1] = np.maximum.reduceat(turned, starts)
        done = last
    return out


def band_hashes(signatures: np.ndarray, rows: int) -> np.ndarray:
    """One number for every band of ``rows`` signature columns."""
    bands = signatures.shape[1] // rows
    out = np.zeros((len(signatures), bands), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(rows):
            out = mix64(out + signatures[:, k : bands * rows : rows] + np.uint64(k + 1))
    return out.view(np.int64)
