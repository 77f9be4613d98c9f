"""Operators that learn: held-out accuracy on the given tables, brute-force versions, odd rows."""

from __future__ import annotations

import os
import zlib

import numpy as np
import plain
import pytest

from threadline.llm import langid, quality, rules, toxicity
from threadline.llm.common import bounded_sample

DATA = os.environ.get("TEST_LLM_DIR", "/root/testdata/sf0.01")
ODD = [(None, "a text with a null id"), (1, None), (1, ""), (2, " \n"), (3, "12345 !!! ???"), (4, "word " * 30_000), (5, "é"), (5, "é")]


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")


def _held_out(doc_id: int) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 4 == 2


@pytest.fixture(scope="module")
def languages(tables):
    return langid.fit(tables[0])


def test_languages_of_held_out_documents(tables, languages):
    found = langid.identify(tables[0], languages).toPandas().merge(tables[0].select("doc_id", "lang").toPandas())
    own = found[found.doc_id.map(_held_out)]
    assert (own.lang_pred == own.lang).mean() > 0.97
    assert found.accepted.mean() > 0.99
    assert found.score.between(0, 1).all()


def test_language_scores_follow_from_the_model(tables, languages):
    rows = langid.identify(tables[0].limit(40), languages).toPandas().set_index("doc_id")
    for doc_id, text in [(r["doc_id"], r["text"]) for r in tables[0].limit(40).collect()]:
        at, _ = langid.ngram_rows(text.encode().split())
        logits = languages.embeddings[at].mean(axis=0) @ languages.weights + languages.bias
        assert rows.score[doc_id] == pytest.approx(langid.softmax(logits[None] / languages.temperature).max(), abs=1e-4)


def test_odd_texts_have_no_language(docs, languages):
    found = langid.identify(docs(*ODD).selectExpr("*", "1 AS score", "2 AS lang_pred"), languages).collect()
    assert len(found) == len(ODD)
    none = [r for r in found if r["doc_id"] in (1, 2, 3)]
    assert all(r["lang_pred"] == "und" and r["score"] == 0 and not r["accepted"] for r in none)
    assert all(r["lang_pred"] != "und" for r in found if r["doc_id"] in (None, 4, 5))
    assert langid.accepted(docs(*ODD), languages).columns == ["doc_id", "text"]


def test_no_language_to_learn(docs):
    model = langid.train([])
    assert {r["lang_pred"] for r in langid.identify(docs((1, "abc"), (2, None)), model).collect()} == {"und"}
    assert langid.identify(docs(), model).count() == 0
    assert langid.train([("abc def", "xx")]).languages == ["xx"]


def test_held_out_languages_are_not_learned(spark):
    own = [(i, f"text {'ab' if i % 2 else 'cd'}", "aa" if i % 2 else "bb") for i in range(200)]
    changed = [(i, t, "zz" if _held_out(i) else lang) for i, t, lang in own]
    schema = "doc_id long, text string, lang string"
    assert langid.fit(spark.createDataFrame(changed, schema)).languages == ["aa", "bb"]


@pytest.fixture(scope="module")
def good(tables):
    return quality.fit(*tables)


def test_quality_of_held_out_documents(tables, good):
    found = quality.score(tables[0], good).toPandas().merge(tables[1].toPandas())
    own = found[found.held_out]
    assert (own.predicted == own.quality).mean() > 0.95
    assert (found.held_out == found.doc_id.map(_held_out)).all()
    assert found.score.between(0, 1).all() and ((found.score >= 0.7) == (found.predicted == 1)).all()


def test_term_vectors_are_summed_contexts(docs):
    texts = ["aa bb cc dd aa", "bb aa", None, "x"]
    found = quality.term_vectors(docs(*enumerate(texts)), rows=64, dimensions=16)
    index, total = quality.index_vectors(64, 16), np.zeros((64, 16))
    for text in texts:
        words = (text or "").encode().split()
        core, shape = quality.word_terms(words, 64)
        for i in range(len(words)):
            for j in range(max(0, i - 2), min(len(words), i + 3)):
                if i != j:
                    for at in (core[i], shape[i]):
                        total[at] += index[core[j]] + index[shape[j]]
    norm = np.maximum(np.linalg.norm(total, axis=1, keepdims=True), 1)
    assert np.allclose(found, (total / norm + index / 2) / 2, atol=1e-6)


def test_odd_texts_have_a_quality(docs, good):
    found = quality.score(docs(*ODD).selectExpr("*", "1 AS score", "true AS held_out"), good).collect()
    assert len(found) == len(ODD) and all(0 <= r["score"] <= 1 for r in found)
    assert quality.score(docs(), good).count() == 0


def test_labels_of_one_kind_or_none(spark, docs):
    one = spark.createDataFrame([(i, 1) for i in range(40)], "doc_id long, quality int")
    table = docs(*[(i, f"text {i}") for i in range(40)])
    for labels in (one, one.limit(0)):
        scores = {round(r["score"], 9) for r in quality.score(table, quality.fit(table, labels)).collect()}
        assert len(scores) == 1


def test_counts_match_the_plain_version(tables, docs):
    rows = [(r["doc_id"], r["text"]) for r in tables[0].collect()] + [(10**6 + i, t) for i, t in enumerate(t for _, t in ODD)]
    rows += [(10**7, "a b c a b c a b c"), (10**7 + 1, "l\nl\n\n \nl\n m\nm"), (10**7 + 2, "a a a a"), (10**7 + 3, "#a *b$ <c>|d"), (10**7 + 4, "a b c d e")]
    found = {r["doc_id"]: r for r in rules.statistics(docs(*rows)).collect()}
    for i, text in rows:
        want = plain.counts(text)
        assert {k: found[i][k] for k in want} == want


def test_windows_of_many_distinct_words():
    ids = np.array([1 << 22, 5, 7, 1 << 22, 5, 7, 9])
    assert rules.repeat_words(ids) == rules.repeat_words(np.array([1, 5, 7, 1, 5, 7, 9])) == 6


def test_rules_keep_clean_and_drop_junk(tables):
    judged, found = rules.judge(*tables)
    rows = judged.toPandas().merge(tables[1].toPandas())
    own = rows[rows.doc_id.map(_held_out) & ~rows.base_failed]
    assert found and own.kept[own.quality == 1].mean() > 0.98
    assert own.kept[own.quality == 0].mean() < 0.2
    values = {name: rows[a].to_numpy() / np.where(rows[b] == 0, np.nan, rows[b]) for name, (a, b) in rules.RATIOS.items()}
    caught = np.any([rules.covers(r, values) for r in found], axis=0)
    assert (rows.kept == (~rows.base_failed & ~caught)).all()
    failed = (rows.n_words < 50) | (100 * rows.n_repeat_words > 50 * rows.n_words)
    assert (rows.base_failed == failed).all()


def test_rules_are_grown_and_pruned():
    rng = np.random.default_rng(2)
    x, y = rng.random(900), rng.random(900)
    bad = (x > 0.7) & (y < 0.4)
    found = rules.learn({"upper_share": x, "mark_share": y}, bad)
    caught = np.any([rules.covers(r, {"upper_share": x, "mark_share": y}) for r in found], axis=0)
    assert (caught & ~bad).mean() < 0.01 and (caught & bad).sum() > 0.8 * bad.sum()
    assert rules.learn({"upper_share": x}, np.zeros(900, bool)) == []


def test_odd_texts_fail_the_base_rules(spark, docs):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    judged, found = rules.judge(docs(*ODD).selectExpr("*", "1 AS n_words", "true AS kept"), labels)
    assert found == [] and judged.count() == len(ODD)
    assert all(r["base_failed"] and not r["kept"] for r in judged.collect())
    assert rules.judge(docs(), labels)[0].count() == 0


def test_toxicity_of_held_out_documents(tables):
    docs_, labels = tables
    found = toxicity.severity(docs_, toxicity.fit(docs_, labels)).withColumnRenamed("toxic", "flag").toPandas().merge(labels.toPandas())
    own = found[found.held_out]
    assert own.flag[own.toxic == 0].mean() < 0.03
    assert own.flag[own.toxic == 1].mean() > 0.3  # few of the sample's languages have enough toxic texts at this size
    assert found.severity[found.toxic == 1].mean() > 5 * found.severity[found.toxic == 0].mean()
    assert found.severity.between(0, 3).all() and ((found.grade > 0) == found.flag).all()


def test_severity_rises_with_the_number_of_insults(spark, docs):
    rng = np.random.default_rng(4)
    words = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(600):
        text = list(rng.choice(words, 60))
        for _ in range(0 if i % 2 else 1 + i % 3 * 6):
            text.insert(int(rng.integers(len(text))), "vile" if i % 4 else "Vile,")
        rows.append((i, " ".join(text)))
    labels = spark.createDataFrame([(i, int(i % 2 == 0)) for i in range(600)], "doc_id long, toxic int")
    model = toxicity.fit(docs(*rows), labels)
    found = {r["doc_id"]: r["severity"] for r in toxicity.severity(docs((1, "w1 w2"), (2, "vile w1"), (3, "vile " * 9), (4, None)), model).collect()}
    assert found[1] == found[4] < found[2] < found[3]
    assert list(model.thresholds) == sorted(model.thresholds)
    assert toxicity.severity(docs(*ODD), model).count() == len(ODD) and toxicity.severity(docs(), model).count() == 0
    assert toxicity.fit(docs(*rows), labels.limit(0)).weights.any() == False  # noqa: E712


def test_words_of_few_toxic_texts_count(spark, docs):
    """Ten insults of eight texts each, some of them in no text of the sample that is learned from."""
    rng = np.random.default_rng(6)
    words, insults = [f"w{i}" for i in range(200)], [f"{c}{c}{c}" for c in "bcdfghjklm"]
    rows = [(i, " ".join([*rng.choice(words, 60), *([insults[i // 8]] * 2 if i < 80 else [])])) for i in range(640)]
    labels = spark.createDataFrame([(i, int(i < 80)) for i in range(640)], "doc_id long, toxic int")
    found = {r["doc_id"]: r for r in toxicity.severity(docs(*rows), toxicity.fit(docs(*rows), labels, per_label=40)).collect()}
    own = [found[i]["toxic"] for i in range(80) if found[i]["held_out"]]
    assert len(own) > 10 and np.mean(own) > 0.9
    assert np.mean([found[i]["toxic"] for i in range(80, 640)]) < 0.02


def test_toxicity_recall_on_more_rows(spark):
    docs_, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    found = toxicity.severity(docs_, toxicity.fit(docs_, labels)).withColumnRenamed("toxic", "flag").toPandas()
    own = found[found.held_out].merge(labels.toPandas()).merge(docs_.select("doc_id", "lang").toPandas())
    assert own.flag[own.toxic == 0].mean() < 0.02
    assert own.flag[own.toxic == 1].mean() > 0.9 and own[own.toxic == 1].groupby("lang").flag.mean().min() > 0.7


def test_samples_are_bounded_and_fixed(spark):
    rows = spark.range(5000).selectExpr("id", "CASE WHEN id < 4900 THEN 'a' ELSE 'b' END AS kind")
    one = sorted(r["id"] for r in bounded_sample(rows, "kind", 300, "id").collect())
    two = sorted(r["id"] for r in bounded_sample(rows.repartition(7), "kind", 300, "id").collect())
    assert one == two and 200 < sum(i < 4900 for i in one) < 400 and sum(i >= 4900 for i in one) == 100
    assert bounded_sample(rows.limit(0), "kind", 3, "id").count() == 0
