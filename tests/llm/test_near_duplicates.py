"""Shingle sets, components, min-max signatures and near duplicates against plain versions."""

from __future__ import annotations

import random

import numpy as np
import plain
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from threadline.llm import minhash, shingles
from threadline.llm.components import components


def _corpus(seed: int = 3) -> list[tuple[int, str | None]]:
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    rows, at = [], 0
    for group in range(12):
        base = rng.choices(words, k=rng.choice([6, 40, 120, 300]))
        for copy in range(rng.choice([1, 2, 5, 30])):
            text = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 6])):
                text[rng.randrange(len(text))] = rng.choice(words)
            rows.append((at, " ".join(text).upper() if copy % 4 == 1 else "  ".join(text)))
            at += 7
    return [*rows, (at + 1, None), (at + 2, ""), (at + 3, " \n\t"), (at + 4, "two words"), (at + 5, "Two WORDS"), (at + 6, "two words more")]


def _check(found, rows):
    sets = {i: plain.shingles(t) for i, t in rows}
    want = plain.components(sets)
    got = {r["doc_id"]: r for r in found.collect()}
    assert {i: r["n_shingles"] for i, r in got.items()} == {i: len(s) for i, s in sets.items()}
    assert {i: r["component_id"] for i, r in got.items()} == want
    assert all(r["kept"] == (want[i] == i) for i, r in got.items())


def test_same_groups_as_all_pairs(docs):
    rows = _corpus()
    _check(minhash.near_duplicates(docs(*rows)), rows)


def test_clusters_of_many_blocks(docs):
    """Blocks of four documents: the first block, the largest component and the rest all take part."""
    rows = _corpus(8)
    _check(minhash.near_duplicates(docs(*rows), block=4, block_shingles=1500), rows)


def test_chain_of_links_is_one_group(docs):
    words = [f"v{i}" for i in range(300)]
    rows = [(i, " ".join(words[4 * i : 4 * i + 150])) for i in range(12)]
    _check(minhash.near_duplicates(docs(*rows)), rows)


def test_repeated_rows_null_ids_and_no_rows(docs):
    text = " ".join(f"u{i}" for i in range(30))
    table = docs((5, text), (5, text), (None, text), (9, text), (None, None)).selectExpr("*", "1 AS id", "2 AS class", "3 AS component")
    got = sorted(((r["doc_id"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(table).collect()), key=str)
    assert got == sorted([(5, 5, True), (5, 5, True), (9, 5, False), (None, None, True), (None, None, True)], key=str)
    assert minhash.near_duplicates(docs()).count() == 0


def test_signatures_are_unbiased():
    rng = np.random.default_rng(0)
    errors = []
    for shift in range(0, 200, 2):
        pool = shingles.mix64(rng.integers(0, 1 << 62, 600).astype(np.uint64))
        a, b = np.unique(pool[:400]), np.unique(pool[shift : 400 + shift])
        both = shingles.min_max_signatures(np.concatenate([a, b]), np.array([len(a), len(b)]), 64)
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        errors.append((both[0] == both[1]).mean() - true)
    assert abs(np.mean(errors)) < 0.015 and np.std(errors) < 0.06


def test_components_of_random_graphs(spark):
    @settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
    @given(st.lists(st.tuples(st.integers(-9, 30), st.integers(-9, 30)), max_size=40))
    def run(pairs):
        parent = {i: i for p in pairs for i in p}
        for _ in pairs:
            for a, b in pairs:
                parent[a] = parent[b] = min(parent[a], parent[b])
        found = {r["node"]: r["component"] for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
        assert found == {i: c for i, c in parent.items() if any(i in p and p[0] != p[1] for p in pairs)}

    run()
