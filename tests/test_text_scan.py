"""Texts are scanned by enough tasks, and patterns of cleaning run only where something is left for them."""

from __future__ import annotations

from pyspark.sql import functions as F

from threadline.functions import text
from threadline.operators import extract

TASKS = "spark.sql.files.minPartitionNum"


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_files_of_texts_are_not_packed_into_one_task_for_each_core(spark, make, tmp_path):
    """Files of little more than nothing were packed by the bytes that opening them counts for."""
    files = 4 * spark.sparkContext.defaultParallelism
    rows = spark.range(files).select(F.col("id").alias("object_id"), F.lit("SELECT a FROM dbo.T").alias("definition"))
    rows.repartitionByRange(files, "object_id").write.parquet(str(tmp_path / "t"))
    before = spark.conf.get(TASKS, None)
    spark.conf.unset(TASKS)
    try:
        found = extract.read_references(spark.read.parquet(str(tmp_path / "t")))
        assert found.rdd.getNumPartitions() >= files // 2
        spark.conf.set(TASKS, "1")  # what the session says stays
        extract.extract_refs(spark.read.parquet(str(tmp_path / "t")))
        assert spark.conf.get(TASKS) == "1"
    finally:
        spark.conf.unset(TASKS) if before is None else spark.conf.set(TASKS, before)


PIECES = ("", " ", "  ", "\n", "\t", " \n", "\r\n", "\x0b", "\x0c", " ", " ", "a", "a b", "é", "END", "\x1f")


def test_white_space_is_squeezed_as_by_one_pattern(make):
    df = make("t string", *[(a + b + c + d,) for a in PIECES for b in PIECES[1:8] for c in ("x", "") for d in PIECES], (None,))
    then = F.trim(F.regexp_replace("t", r"(?=\s)(?:\s{2,}+|[^\S ])", " "))
    now = text.squeeze_ws(F.col("t"))
    assert r"[^\S ]" not in _plan(df.select(now))
    assert df.where(~F.equal_null(now, then)).count() == 0


def test_commas_are_told_apart_only_in_texts_that_have_one(make):
    df = make("t string", ("SELECT a FROM b, c d, e WHERE f IN (1, 2)",), ("SELECT a FROM b",), (",",), ("",), (None,))
    found = df.select(text.from_lists(F.col("t")).alias("t"))
    assert "Contains(" in _plan(found) or "contains(" in _plan(found).lower()
    assert [r["t"] for r in found.collect()] == ["SELECT a FROM b JOIN  c d JOIN  e WHERE f IN ()", "SELECT a FROM b", ",", "", None]
