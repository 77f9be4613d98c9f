"""The registered queries against their SQL, and the pipeline against its stages done plainly."""

from __future__ import annotations

import plain
import pytest
from compare import difference, duck_rows, spark_rows

import corpus_pipeline
from threadline.llm import langid, packing, quality
from threadline.llm.queries import ORACLE, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_agrees_with_its_sql(name, spark, duck, data_dir):
    assert difference(spark_rows(QUERIES[name](spark, data_dir)), duck_rows(duck, ORACLE[name])) == ""


COLUMNS = {
    "op1_bpe": "doc_id n_tokens ids_sha256 decoded_sha256",
    "op2_langid": "doc_id held_out lang_pred score",
    "op3_minhash": "doc_id n_shingles component_id kept",
    "op4_warc": "page_id payload_bytes payload_digest record_type refers_to",
    "op5_toxicity": "doc_id held_out severity",
    "op6_html": "page_id url text n_chars",
    "op7_packing": "doc_id piece start length ids_crc32 sequence_id offset",
    "op8_rules": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
    "op9_ann": "query_id rank vec_id score",
    "op10_quality": "doc_id held_out score predicted",
    "op13_licenses": "doc_id n_words n_base first_word last_word base_labels labels score",
}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_query_returns_every_row(name, spark, duck, data_dir):
    found = QUERIES[name](spark, data_dir)
    assert found.columns[: len(COLUMNS[name].split())] == COLUMNS[name].split()
    if name == "op9_ann":
        assert found.count() == 10 * duck.execute("SELECT count(*) FROM embeddings WHERE vec_id % 100 = 0").fetchone()[0]
        return
    table, key = ("pages", "page_id") if name == "op6_html" else ("documents", "doc_id")
    assert found.select(key).distinct().count() == duck.execute(f"SELECT count(DISTINCT {key}) FROM {table}").fetchone()[0]


def test_each_stage_does_what_its_operator_says(spark, data_dir):
    docs = spark.read.parquet(f"{data_dir}/documents.parquet")
    labels = spark.read.parquet(f"{data_dir}/labels.parquet")
    kept = langid.identify(docs, langid.fit(docs)).where("accepted")
    one = corpus_pipeline.keep_known_languages(spark, docs, data_dir).cache()
    assert one.columns == docs.columns
    assert {r["doc_id"] for r in one.collect()} == {r["doc_id"] for r in kept.collect()}
    two = corpus_pipeline.keep_good_quality(spark, one, data_dir).cache()
    good = quality.score(one, quality.fit(one, labels)).where("predicted = 1")
    assert two.columns == docs.columns
    assert {r["doc_id"] for r in two.collect()} == {r["doc_id"] for r in good.collect()}
    sets = {r["doc_id"]: plain.shingles(r["text"]) for r in two.collect()}
    three = corpus_pipeline.drop_near_duplicates(spark, two, data_dir).cache()
    assert {r["doc_id"] for r in three.collect()} == {i for i, c in plain.components(sets, percent=80).items() if i == c}
    three = corpus_pipeline.drop_near_duplicates(spark, two, data_dir, percent=85).cache()
    assert three.columns == docs.columns
    assert {r["doc_id"] for r in three.collect()} == {i for i, c in plain.components(sets).items() if i == c}
    four = corpus_pipeline.pack(spark, three, data_dir)
    assert {r["doc_id"] for r in four.select("doc_id").collect()} == {r["doc_id"] for r in three.collect()}
    assert four.count() == packing.pieces(three).count()


def test_run_applies_all_stages(spark, data_dir):
    found = corpus_pipeline.run(spark, data_dir)
    assert found.columns == "doc_id piece start length ids_crc32 sequence_id offset".split()
    assert 0 < found.select("doc_id").distinct().count() < spark.read.parquet(f"{data_dir}/documents.parquet").count()


def test_odd_rows_pass_the_filters(spark, tmp_path):
    """Nulls, empty texts, repeated rows, extra columns with the names of results, and no rows at all."""
    rows = [(1, None, None, 1), (2, "", "en", 2), (None, "the text", None, 3), (4, "the text of it " * 20, "en", 4), (4, "the text of it " * 20, "en", 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score int").selectExpr("*", "5 AS kept", "6 AS component_id", "7 AS piece")
    spark.createDataFrame([(None, 1), (4, None), (4, 1), (5, 0)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    for table in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            found = stage(spark, table, str(tmp_path))
            assert found.columns == docs.columns, name
            assert found.count() <= table.count()
        assert corpus_pipeline.pack(spark, table, str(tmp_path)).count() == table.count()
