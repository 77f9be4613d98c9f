"""Nearest neighbours against brute force."""

from __future__ import annotations

import math

import numpy as np
import pytest

from threadline.llm import ann


def _frame(spark, ids, vectors):
    return spark.createDataFrame([(i, v) for i, v in zip(ids, vectors, strict=True)], "vec_id long, embedding array<float>")


def _brute(ids, vectors, queries, k=10):
    vectors = np.array(vectors, np.float32).astype(float)
    out = {}
    for q in queries:
        own = np.sqrt(((vectors - vectors[ids.index(q)]) ** 2).sum(axis=1))
        out[q] = sorted((float(d), i) for d, i in zip(own, ids, strict=True) if i != q)[:k]
    return out


def _check(found, want, recall=0.9):
    got = {}
    for r in found.collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["score"], r["vec_id"]))
    assert set(got) == set(want)
    hits = 0
    for q, rows in got.items():
        rows.sort()
        assert [r[0] for r in rows] == list(range(1, len(want[q]) + 1))
        assert [r[1:] for r in rows] == sorted(r[1:] for r in rows)
        hits += len({r[2] for r in rows} & {i for _, i in want[q]})
    assert hits >= recall * sum(map(len, want.values()))
    return got


def test_recall_and_scores(spark):
    rng = np.random.default_rng(5)
    ids, vectors = list(range(0, 12_000, 3)), rng.normal(size=(4000, 24)).tolist()
    rows = _frame(spark, ids, vectors)
    queries = [i for i in ids if i % 100 == 0]
    want = _brute(ids, vectors, queries)
    got = _check(ann.nearest(rows, rows.where("vec_id % 100 = 0"), shard_rows=1500), want)
    for q, found in got.items():
        exact = dict((i, d) for d, i in _brute(ids, vectors, [q], k=4000)[q])
        assert all(math.isclose(s, exact[i], rel_tol=1e-12) for _, s, i in found)


def test_copies_and_ties_go_to_smaller_ids(spark):
    rng = np.random.default_rng(6)
    base = rng.normal(size=(40, 8)).tolist()
    ids = list(range(600))
    vectors = [base[0] if i % 2 else base[i % 40] for i in ids]
    rows = _frame(spark, ids, vectors)
    want = _brute(ids, vectors, [0, 100, 200, 300, 400, 500])
    got = _check(ann.nearest(rows, rows.where("vec_id % 100 = 0"), shard_rows=150), want, recall=1.0)
    assert {q: [i for _, _, i in r] for q, r in got.items()} == {q: [i for _, i in r] for q, r in want.items()}


def test_unusable_vectors_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    bad = [None, [0.0, -0.0], [nan, 1.0], [inf, 1.0], [None, 1.0], [], [1.0, 2.0, 3.0]]
    good = [[1.0, 0.0], [0.0, 1.0], [3.0, 4.0]]
    rows = _frame(spark, [0, 100, 200, 300, 400, 500, 600, 700, 1, 2, None, 700], [*bad, *good, [1.0, 0.5], good[0]])
    rows = rows.selectExpr("*", "1 AS score", "2 AS dims", "3 AS vector")
    found = [(r["query_id"], r["rank"], r["vec_id"], round(r["score"], 6)) for r in ann.nearest(rows, rows.where("vec_id % 100 = 0")).collect()]
    assert sorted(found) == [(700, 1, 1, round(math.sqrt(2), 6)), (700, 2, 2, round(math.sqrt(20), 6))]
    assert ann.nearest(rows.limit(0), rows).count() == 0 and ann.nearest(rows, rows.limit(0)).count() == 0


def test_a_stored_graph_is_the_same_graph():
    vectors = np.random.default_rng(7).normal(size=(700, 12)).astype(np.float32)
    graph = ann.Graph.build(vectors)
    again = ann.Graph.load(graph.save())
    assert [len(layer.links) for layer in graph.layers] == [len(layer.links) for layer in again.layers]
    assert (graph.search(vectors[:50], 5) == again.search(vectors[:50], 5)).all()
    assert (graph.search(vectors, 1)[:, 0] == np.arange(700)).mean() > 0.99


def _double(spark, ids, vectors):
    return spark.createDataFrame([(i, v) for i, v in zip(ids, vectors, strict=True)], "vec_id long, embedding array<double>")


def _nearest(vectors, ids, q, k=10):
    own = np.array(vectors)
    scale = np.abs(own).max()
    apart = scale * np.sqrt(((own / scale - own[ids.index(q)] / scale) ** 2).sum(axis=1))
    return [i for _, i in sorted((float(d), i) for d, i in zip(apart, ids, strict=True) if i != q)[:k]]


@pytest.mark.parametrize("shift, factor", [(10_000.0, 1.0), (-1e9, 1.0), (0.0, 1e200), (0.0, 1e-200), (1e30, 1e25), (0.0, 1e307)])
def test_recall_off_the_origin_and_for_large_values(spark, shift, factor):
    rng = np.random.default_rng(8)
    ids = list(range(0, 3000, 2))
    base = rng.uniform(-1, 1, size=(1500, 16))
    vectors = (base * factor + shift).tolist()
    rows = _double(spark, ids, vectors)
    queries = [i for i in ids if i % 100 == 0]
    got = {}
    for r in ann.nearest(rows, rows.where("vec_id % 100 = 0"), shard_rows=600).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    hits = sum(len(got.get(q, set()) & set(_nearest(vectors, ids, q))) for q in queries)
    assert hits >= 0.9 * 10 * len(queries)


def test_different_vectors_at_one_distance_are_ranked_by_id(spark):
    corners = [[float(2 * (n >> b & 1) - 1) for b in range(6)] for n in range(64)]
    ids = [100, *range(101, 165)]
    vectors = [[0.0] * 5 + [5e-324], *corners[::-1]]
    found = ann.nearest(_double(spark, ids, vectors), _double(spark, ids, vectors).where("vec_id = 100"))
    assert [r["vec_id"] for r in found.orderBy("rank").collect()] == list(range(101, 111))
