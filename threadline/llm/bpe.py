"""Byte-level BPE with a local rank file: encoding of whole texts and decoding to raw bytes."""

from __future__ import annotations

import base64
import functools

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame

from threadline.llm.common import long_array, map_batches, texts

RANKS = "byte_bpe_50k.tiktoken"
#: Longer texts are cut before they meet the regex of the encoder.
SEGMENT = 1 << 16

# Places that no match of the pattern crosses: before white space that follows something else, and
# between a letter and a number.
_SAFE = regex.compile(r"(?<=\S)(?=\s)|(?<=\p{L})(?=\p{N})|(?<=\p{N})(?=\p{L})")
_MATCH = regex.compile(public_tokenizers.PATTERN)


@functools.cache
def encoding(path: str) -> tiktoken.Encoding:
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def segments(text: str, size: int = SEGMENT) -> list[str]:
    """The text cut at safe places, each at the first one at least ``size`` characters after the last."""
    out, start = [], 0
    while len(text) - start > size:
        found = _SAFE.search(text, start + size)
        if not found:
            break
        out.append(text[start : found.start()])
        start = found.start()
    out.append(text[start:])
    return out


def _encode(text: str, coder: tiktoken.Encoding) -> np.ndarray:
    if len(text) <= SEGMENT:
        return np.array(coder.encode_ordinary(text), np.uint32)
    ids: list[int] = []
    for part in segments(text):
        if len(part) <= 2 * SEGMENT:
            ids += coder.encode_ordinary(part)
        else:  # hardly a safe place: find the matches one by one, as the encoder's own regex may give up
            for match in _MATCH.finditer(part):
                ids += coder.encode_ordinary(match.group()) if len(match.group()) <= SEGMENT else _piece(match.group(), coder)
    return np.array(ids, np.uint32)


def _piece(text: str, coder: tiktoken.Encoding) -> list[int]:
    """A single match of any length."""
    return coder._encode_single_piece(text.encode())


def encode(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", path: str | None = None) -> DataFrame:
    """``id_column, n_tokens, ids``: ids as little-endian unsigned 32-bit numbers in one binary value.

    A null text counts as empty and gives no ids. No special tokens are known: their strings are
    ordinary text. Every row gives one row, also repeated ones and those with a null id.
    """
    path = path or public_tokenizers.path(RANKS)

    def start():
        coder = encoding(path)

        def each(batch):
            ids = [_encode(t, coder) for t in texts(batch, text_column)]
            return {
                id_column: batch.column(id_column),
                "n_tokens": long_array(np.array([len(x) for x in ids])),
                "ids": pa.array([x.astype("<u4").tobytes() for x in ids], pa.binary()),
            }

        return each

    kind = docs.schema[id_column].dataType.simpleString()
    return map_batches(docs.select(id_column, text_column), start, f"`{id_column}` {kind}, n_tokens long, ids binary")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """The table with a column ``decoded``: the bytes that the ids of column ``ids`` stand for.

    Null ids give null. The bytes need not be valid UTF-8 if ids were cut out of a text. A column
    named ``decoded`` that is there already is replaced.
    """
    path = path or public_tokenizers.path(RANKS)
    kept = [c for c in encoded.columns if c != "decoded"]

    def start():
        coder = encoding(path)

        def each(batch):
            ids = batch.column("ids").to_pylist()
            data = [None if x is None else coder.decode_bytes(np.frombuffer(x, "<u4").tolist()) for x in ids]
            return {c: batch.column(c) for c in kept} | {"decoded": pa.array(data, pa.binary())}

        return each

    schema = ", ".join(f"`{c}` {encoded.schema[c].dataType.simpleString()}" for c in kept)
    return map_batches(encoded.select(*kept), start, f"{schema}, decoded binary")
