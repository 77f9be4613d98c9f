"""Byte-level BPE and packing."""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from threadline.llm import bpe, packing

TEXTS = [
    "", None, "a", "It's they'll we'd  two  spaces\n\n\ttab ", "<|endoftext|> déjà vu 日本語 🙂 12345 x9y8", "  wide　 blanks", "é İstanbul ΣΑΣ",
    "x" * 300_000, "ab " * 60_000, "1a" * 100_000, "!?" * 90_000, " " * 200_000, "word, word. (word) don't 'tis rock'n'roll 'S", "same", "same",
]


def test_ids_and_bytes_are_those_of_the_library(spark, docs):
    rows = list(enumerate(TEXTS))
    found = {r["doc_id"]: r for r in bpe.decode(bpe.encode(docs(*rows))).collect()}
    coder = bpe.encoding(public_tokenizers.path(bpe.RANKS))
    assert len(found) == len(rows)
    for i, text in rows:
        ids = np.frombuffer(found[i]["ids"], "<u4")
        assert bytes(found[i]["decoded"]) == (text or "").encode()
        assert found[i]["n_tokens"] == len(ids)
        if len(text or "") < 1000 or " " in text.strip():
            assert ids.tolist() == coder.encode_ordinary(text or "")


def test_segments_never_change_ids():
    coder = bpe.encoding(public_tokenizers.path(bpe.RANKS))

    @settings(max_examples=150, deadline=None)
    @given(st.text(alphabet="ab 1\n\t'sLé.! ", max_size=60), st.integers(1, 12))
    def run(text, size):
        parts = bpe.segments(text, size)
        assert "".join(parts) == text
        assert [i for p in parts for i in coder.encode_ordinary(p)] == coder.encode_ordinary(text)

    run()


def test_cut_ids_decode_to_raw_bytes(spark):
    coder = bpe.encoding(public_tokenizers.path(bpe.RANKS))
    ids = coder.encode_ordinary("🙂")
    half = spark.createDataFrame([(1, np.array(ids[:1], "<u4").tobytes()), (2, None)], "doc_id long, ids binary")
    found = {r["doc_id"]: r["decoded"] for r in bpe.decode(half).collect()}
    assert bytes(found[1]) == coder.decode_bytes(ids[:1]) and found[2] is None


def test_word_ids_are_those_of_the_library():
    plain = Tokenizer.from_file(public_tokenizers.path(packing.VOCABULARY))
    coder = packing.Encoder(public_tokenizers.path(packing.VOCABULARY), limit=50)

    @settings(max_examples=200, deadline=None)
    @given(st.lists(st.text(alphabet="abcXYZé İΣ́ß1,.'()\n  日-!한하", max_size=40), max_size=4))
    def run(texts):
        for text, ids in zip(texts, coder.ids(texts), strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids

    run()


def test_separators_are_tokens(docs):
    plain = Tokenizer.from_file(public_tokenizers.path(packing.VOCABULARY))
    coder = packing.Encoder(public_tokenizers.path(packing.VOCABULARY))
    own = [f"{a}{chr(c)}{b}" for c in [*range(0x1A, 0x22), 0x85, 0xA0, 0x2028] for a, b in (("a", "b"), ("", ""), ("x. ", " É"), ("don", "'t,"))]
    texts = [*own, " ".join(own), "\x1c" * 5000]
    for text, ids in zip(texts, coder.ids(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids
    (row,) = packing.pieces(docs((1, "a\x1cb"))).collect()
    assert np.frombuffer(row["ids"], "<u4").tolist() == [320, 472, 321, 1] and row["length"] == 4


def test_known_words_change_no_ids():
    plain = Tokenizer.from_file(public_tokenizers.path(packing.VOCABULARY))
    coder = packing.Encoder(public_tokenizers.path(packing.VOCABULARY))
    for text in ("d' İ", "d'. İ.", "word", "word, word!"):
        assert np.frombuffer(coder.ids([text])[0], "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids


def test_packing_is_whole_and_tight(spark, docs):
    plain = Tokenizer.from_file(public_tokenizers.path(packing.VOCABULARY))
    rows = [(i, t) for i, t in enumerate(TEXTS) if t is None or len(t) < 200_000] + [(100 + i, "some words here " * (37 * i % 900)) for i in range(60)]
    found = packing.pack_documents(docs(*rows)).collect()
    pieces, places = {}, {}
    for r in found:
        pieces.setdefault(r["doc_id"], {})[r["piece"]] = r
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    total = 0
    for i, text in rows:
        ids = np.array([*plain.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        total += len(ids)
        assert len(pieces[i]) == -(-len(ids) // 4096)
        for k, r in pieces[i].items():
            part = ids[4096 * k : 4096 * (k + 1)]
            assert (r["start"], r["length"], r["ids_crc32"]) == (4096 * k, len(part), zlib.crc32(part.tobytes()))
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(places) <= -(-total // 4096) + 1


def test_each_item_goes_where_the_sum_of_squares_is_smallest():
    rng = np.random.default_rng(1)
    lengths = rng.integers(1, 21, 200)
    bins, offsets = packing.sum_of_squares(lengths, 20)
    fill = {}
    for i in np.argsort(-lengths, kind="stable"):
        s, gaps = int(lengths[i]), {b: 20 - f for b, f in fill.items()}

        def squares(after):
            count = {}
            for g in after.values():
                if 0 < g < 20:
                    count[g] = count.get(g, 0) + 1
            return sum(n * n for n in count.values())

        options = {b: squares(gaps | {b: g - s}) for b, g in gaps.items() if g >= s}
        options[len(fill)] = squares(gaps | {len(fill): 20 - s})
        assert options[int(bins[i])] == min(options.values())
        assert offsets[i] == fill.get(int(bins[i]), 0)
        fill[int(bins[i])] = fill.get(int(bins[i]), 0) + s


def test_sequences_hold_the_ids(spark, docs):
    table = docs((1, "a b c"), (2, "d e"), (3, None))
    cut = packing.pieces(table)
    rows = packing.sequences(cut, packing.pack(packing.pieces(table, checksum=True))).collect()
    plain = Tokenizer.from_file(public_tokenizers.path(packing.VOCABULARY))
    want = sorted([*plain.encode(t, add_special_tokens=False).ids, 1] for t in ("a b c", "d e", ""))
    got = []
    for r in rows:
        at = 0
        for n in r["lengths"]:
            got.append(r["input_ids"][at : at + n])
            at += n
    assert sorted(got) == want


def test_empty_tables_and_clashing_columns(spark, docs):
    assert bpe.decode(bpe.encode(docs())).count() == 0
    assert packing.pack_documents(docs()).count() == 0
    clash = docs((None, "a"), (1, None), (1, None)).selectExpr("*", "1 AS ids", "2 AS piece", "3 AS length", "4 AS sequence_id", "5 AS n_tokens")
    assert bpe.encode(clash).columns == ["doc_id", "n_tokens", "ids"] and bpe.encode(clash).count() == 3
    assert packing.pack_documents(clash).count() == 3


def test_digests(spark, docs):
    row = bpe.encode(docs((1, "hello"))).selectExpr("sha2(ids, 256) AS h").first()
    assert row["h"] == hashlib.sha256(bytes(bpe.encode(docs((1, "hello"))).first()["ids"])).hexdigest()
