"""Texts are searched once, and quickened searches find what the plain ones did."""

from __future__ import annotations

import checks
from pyspark.sql import functions as F

from threadline.functions import text
from threadline.operators import extract, gram_index, resolve


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_diagnostics_read_the_texts_once(spark, data_dir):
    plan = _plan(checks.QUERIES["C32_parse_diagnostics"](spark, data_dir))
    assert "regexp_extract_all" not in plan  # both sides read what one scan wrote


def test_given_references_are_those_read(make):
    texts = make(
        "object_id long, definition string",
        (1, "SELECT a FROM dbo.T x -- @LINEAGE_INPUTS: dbo.U\nUPDATE x SET v = 1"),
        (2, "SELECT a INTO dbo.N FROM [my t].[select]; CREATE TABLE dbo.C AS SELECT 1"),
        (3, None),
    )
    objects = make("object_id long, schema_name string, object_name string, object_type string", (9, "dbo", "T", "Table"))
    read = extract.read_references(texts)
    rows = lambda df: sorted(map(str, df.collect()))
    assert rows(extract.extract_refs(texts, read=read)) == rows(extract.extract_refs(texts))
    assert rows(resolve.resolve_definitions(texts, objects, read=read)) == rows(resolve.resolve_definitions(texts, objects))


def test_rules_alike_search_once(make):
    refs = extract.extract_refs(make("object_id long, definition string", (1, "SELECT a FROM t CROSS APPLY dbo.f(t.a) x")))
    assert _plan(refs).count(r"OUTER\s+APPLY") == 1
    assert {("source", "dbo.f"), ("function", "dbo.f")} <= {(r["role"], r["name"]) for r in refs.collect()}


def test_body_as_with_the_lazy_pattern(make):
    lazy = r"(?is)^.*?CREATE\s+PROC(?:EDURE)?\s+\[[^\]]+\]\.\[[^\]]+\].*?AS\s+BEGIN(.*?)(?:(?=[\sE])\s*END\s*)?$"
    head = "x CREATE PROC [a].[b] AS BEGIN"
    tails = ("", " ", "END", " end \n", " SELECT 1 END", " SELECT 1 END\n", " SELECT 1\n", "\nEND\nEND", " ENDED", " WEEKEND", " a END b", "\r\nEND ")
    df = make("definition string", *[(head + t,) for t in tails], ("CREATE VIEW v AS SELECT 1 END",), (None,))
    assert "(.*?)(?:" not in _plan(df.select(text.proc_body(F.col("definition"))))
    got = df.select(text.proc_body(F.col("definition")).alias("now"), F.regexp_replace("definition", lazy, "$1").alias("then")).collect()
    assert [r["now"] for r in got] == [r["then"] for r in got]


def test_runs_of_characters(make):
    texts = ["", "ab", "abc", "abcabc", "A\nb\U0001F600c\U0001F600d", "Étés", None]
    runs = gram_index.grams_of(F.col("t"))
    df = make("t string", *[(t,) for t in texts]).select("t", runs.alias("runs"))
    assert "slice" not in _plan(df)  # no run is put together from single characters
    for row in df.collect():
        low = (row["t"] or "").lower()
        assert row["runs"] == list(dict.fromkeys(low[i : i + 3] for i in range(len(low) - 2)))


def test_statements_split_as_before(make):
    then = r"(?i)(?=\s)(?<!;)\s+(?=[DIUMT])\b(DECLARE|INSERT|UPDATE|DELETE|MERGE|TRUNCATE)\b"
    cases = ("a INSERT b", "a;  INSERT b", "a; INSERT b", "a\n\t UPDATE b", "a INSERTED", "DELETE a DELETE b", " merge x")
    df = make("t string", *[(c,) for c in cases])
    got = df.select(text.split_statements(F.col("t")).alias("now"), text.split_queries(F.regexp_replace("t", then, ";$1")).alias("then"))
    assert all(r["now"] == r["then"] for r in got.collect())
