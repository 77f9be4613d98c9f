"""Lexical search, collocations and license scans against plain versions."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import plain
import pytest
from pyspark.sql import functions as F

from threadline.llm import collocations, lexical, licenses

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def _ranked(docs, items, k=10):
    terms = [(i, TERM.findall(plain.lower(t or ""))) for i, t in docs]
    n_docs, total = sum(bool(w) for _, w in terms), sum(len(w) for _, w in terms)
    df = Counter(w for _, ws in terms for w in set(ws))
    asked: dict = {}
    for i, t in items:
        if i is not None:
            asked.setdefault(i, set()).update(TERM.findall(plain.lower(t or "")))
    out = set()
    for item, own in asked.items():
        found = []
        for i, ws in terms:
            counts = Counter(ws)
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1)))
                * ((1_000_000_000 * counts[w]) // (1000 * counts[w] + 8 * (10 + (90 * len(ws) * n_docs) // total)))
                for w in own
                if counts[w]
            )
            if score > 0 and i is not None:
                found.append((-score, i))
        out |= {(item, rank, i, -s) for rank, (s, i) in enumerate(sorted(found)[:k], 1)}
    return out


DOCS = [
    (7, "the Cat sat, the cat ran"), (3, "the cat sat the cat ran"), (5, None), (1, ""), (2, "...!"), (None, "cat cat"),
    (9, "Ünder ünder der 12ab"), (4, "dog"), (4, "dog dog"), (8, "cat\x00dog_dog"), (6, "the " * 3000 + "end"),
]
ITEMS = [(1, "The CAT"), (2, None), (3, "dog dog"), (4, "unknown"), (None, "cat"), (5, "cat"), (5, "ünder, 12ab"), (6, "")]


def _tables(spark):
    docs = spark.createDataFrame([(*d, 1, 2) for d in DOCS], "doc_id long, text string, score int, n int")
    return docs, spark.createDataFrame([(*i, 3) for i in ITEMS], "item_id long, text string, rank int")


def test_search_agrees_with_brute_force(spark, monkeypatch):
    docs, items = _tables(spark)
    rows = {tuple(r) for r in lexical.search(docs, items).collect()}
    assert rows == _ranked(DOCS, ITEMS)
    assert {r[2] for r in rows if r[0] == 1 and r[1] <= 2} == {3, 7}  # equal texts: the smaller id first
    monkeypatch.setattr(lexical, "BLOCK_ITEMS", 1)  # one block for every item
    monkeypatch.setattr(lexical, "TILE_TERMS", 1)
    assert {tuple(r) for r in lexical.search(docs, items).collect()} == rows
    assert lexical.search(docs.limit(0), items).count() == lexical.search(docs, items.limit(0)).count() == 0


def test_many_equal_scores_keep_the_smallest_ids(spark):
    texts = [(i, "same words here") for i in range(5000, 0, -1)] + [(i, "others") for i in range(5001, 12_000)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(7)
    found = lexical.search(docs, spark.createDataFrame([(1, "words")], "item_id long, text string"))
    assert [r["doc_id"] for r in found.orderBy("rank").collect()] == list(range(1, 11))


def test_tiles_stay_exact():
    import numpy as np

    assert lexical.tile_width(np.array([44_000])) * 44_000 * lexical.LARGEST_IMPACT < lexical.EXACT
    assert lexical.tile_width(np.array([1 << 40])) == 1


def _collocations(docs, least, top):
    by_lang: dict = {}
    for lang, text in docs:
        counts = by_lang.setdefault("und" if lang is None else lang, Counter())
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", plain.lower(text or "")):
            words = re.findall(r"[^\x20\x09]+", piece)
            for size in (1, 2, 3):
                counts.update(tuple(words[i : i + size]) for i in range(len(words) - size + 1))
    out = set()
    for lang, f in by_lang.items():
        n = sum(a for p, a in f.items() if len(p) == 1)
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        rows = []
        for p, a in candidates.items():
            longer = [q for q in candidates if len(q) > len(p) and p in (q[: len(p)], q[1:])]
            if any(100 * f[q] >= 50 * a for q in longer):
                continue
            score, k = min((1_000_000 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(rows)[:top], 1):
            out.add((lang, rank, phrase.decode(), -a, left, right, n, -score))
    return out


def _phrases(seed, texts=120):
    rng = random.Random(seed)
    words = ["a", "B", "c", "dé", "the", "the", "x y", "\x1c", "日本"]
    ends = [" ", " ", " ", "\t", ". ", ",", "\n", "\r\n"]
    return [(rng.choice(["en", "de", None]), "".join(rng.choice(words) + rng.choice(ends) for _ in range(rng.randrange(60)))) for _ in range(texts)]


@pytest.mark.parametrize("least, top", [(2, 2000), (10, 7)])
def test_collocations_agree_with_brute_force(spark, monkeypatch, least, top):
    rows = [*_phrases(least), ("en", None), ("fr", ""), ("und", "a b. a b"), ("en", "the end " * 400), ('a\tb\\t"\n', 'say "no" now ' * 20)]
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "lang string, text string, n int, rank int").repartition(3)
    want = _collocations(rows, least, top)
    assert len(want) > 10
    assert {tuple(r) for r in collocations.collocations(docs, least=least, top=top).collect()} == want
    monkeypatch.setattr(collocations, "HOT_ROWS", 3)  # every word is hot, chunks are small
    monkeypatch.setattr(collocations, "CHUNK_WORDS", 50)
    monkeypatch.setattr(collocations, "BUCKET_BYTES", 500)
    monkeypatch.setattr(collocations, "HOT_WORDS", 1000)
    assert {tuple(r) for r in collocations.collocations(docs, least=least, top=top).collect()} == want
    assert collocations.collocations(docs.limit(0), least=least).count() == 0


def test_runs_of_huge_vocabularies_are_counted_by_pair_numbers():
    import numpy as np

    ids = np.array([5, 1, 5, 1, 9, 5, 1, 9])
    small, large = ([[p.tolist() for p in parts] + [c.tolist()] for parts, c in collocations._distinct(ids, ids != 9, w)] for w in (10, 3_000_000))
    assert small == large and small[2] == [[1, 5], [5, 1], [1, 5], [1, 1]]


def _labels(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", plain.lower(text or ""))
    padded, present, spans = f" {' '.join(words)} ", set(words), []
    for number, s in enumerate(licenses.SIGNATURES):
        if present & set(s.keywords):
            tail = "" if s.extra else "(?= )"
            for m in re.finditer(f"(?<= )(?:{s.pattern}){tail}", padded):
                start = padded[: m.start()].count(" ") - 1
                spans.append((start, start + m.group().count(" ") + s.extra + 1, s.tier, number, s.label))
    kept = []
    for a in spans:
        inside = [b for b in spans if b[0] <= a[0] and a[1] <= b[1] and b[2] <= a[2] and b[3] != a[3]]
        stronger = [b for b in inside if (b[0], b[1]) != (a[0], a[1]) or (b[2], b[3]) < (a[2], a[3])]
        if a[2] == 0 or not stronger:
            kept.append(a)
    base = [s for s in spans if s[2] == 0]
    return (
        len(words), len(base), min((s[0] for s in base), default=None), max((s[0] for s in base), default=None),
        ",".join(sorted({s[4] for s in base})), ",".join(sorted({s[4] for s in kept})),
        max((licenses.CONFIDENCE[s[2]] for s in kept), default=0.0),
    )


TEXTS = [
    None, "", "  \n", "Released under the MIT license. Under the MIT License!", "under the mit licenses", "mit dem Hund",
    "Apache License, Version 2.0 and CC-BY-NC-SA 4.0; cc by nc", "Licensed under the Apache License, Version 2.0 (the License)",
    "SPDX-License-Identifier: GPL-2.0-or-later", "GNU General Public License version 2 or later", "GPL v3, LGPL 2.1 and the AGPL",
    "GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "cc by nc cc by nc cc by nc nd", "Dual licensed under the MIT or GPL license", "word " * 5000 + "under the mit license",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software", "ünder the mit license",
    "Neither the name of the Big Company nor the names of its contributors may be used to endorse", "under the mit license " * 300,
    "Mozilla Public License 2.0; Eclipse Public License - v 1.0; Boost Software License 1.0; The Unlicense; WTFPL; zlib license",
]


def test_license_labels_agree_with_brute_force(spark):
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(TEXTS)], "doc_id long, text string, labels string, n_words int")
    found = {r["doc_id"]: tuple(r)[1:] for r in licenses.labels(docs).collect()}
    assert found == {i: _labels(t) for i, t in enumerate(TEXTS)}
    assert found[8][5] == "gpl-2-or-later" and found[9][5] == "gpl-2-or-later"  # the shorter names are silenced
    assert found[6][4] == "apache-2,cc-by-nc" and "cc-by-nc-sa-4" in found[6][5]
    assert licenses.labels(docs.limit(0)).count() == 0
    assert licenses.labels(docs.union(docs)).count() == 2 * len(TEXTS)


def test_license_rules_agree_on_given_texts(spark, data_dir):
    docs = spark.read.parquet(f"{data_dir}/documents.parquet").select("doc_id", "text")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert {r["doc_id"]: tuple(r)[1:] for r in licenses.labels(docs).collect()} == {i: _labels(t) for i, t in texts.items()}


def test_license_scan_stays_in_the_jvm(spark):
    plan = licenses.labels(spark.createDataFrame([(1, "x")], "doc_id long, text string").select("doc_id", F.lower("text").alias("text")))
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in text and "Arrow" not in text and "Pandas" not in text
    assert len(licenses.SIGNATURES) > 250
    assert all(any(k in s.pattern or s.tier for k in s.keywords) for s in licenses.SIGNATURES)


def test_phrases_that_overlap_themselves_are_all_found(spark):
    own = (*licenses.base_signatures((("a b a", "aba"),)),)
    row = licenses.labels(spark.createDataFrame([(1, "a b a b a, b")], "doc_id long, text string"), own).first()
    assert (row["n_base"], row["first_word"], row["last_word"], row["labels"]) == (2, 0, 2, "aba")
