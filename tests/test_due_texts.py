"""Only due texts are read, and searched only for reasons whose words they have."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from threadline.operators import resolve
from threadline.plans import layers, refresh


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def _snapshot(make, version: int):
    date = F.make_timestamp_ntz(F.lit(2020), F.lit(1), F.lit(1) + F.when(F.col("object_id") == 2, version).otherwise(0), F.lit(0), F.lit(0), F.lit(0))
    objects = make("object_id long, schema_name string, object_name string, object_type string", (1, "dbo", "p1", "Stored Procedure"), (2, "dbo", "p2", "Stored Procedure"), (7, "dbo", "T", "Table"), (8, "dbo", "U", "Table"))
    return {
        "objects": objects.withColumn("modify_date", date),
        "definitions": make("object_id long, definition string", (1, "SELECT a FROM dbo.T"), (2, "SELECT a FROM dbo.U" if version else "SELECT a FROM dbo.T")),
        "dependencies": make("referencing_object_id long, referenced_object_id long, referenced_schema_name string, referenced_entity_name string"),
    }


@pytest.mark.parametrize("most", [0, 5])
def test_only_due_texts_are_read(spark, make, tmp_path, monkeypatch, most):
    """with many objects due, all texts were read, or the due ones exchanged for each reader."""
    read = []
    resolved = resolve.resolve_definitions
    monkeypatch.setattr(resolve, "resolve_definitions", lambda texts, *a, **k: read.append(texts) or resolved(texts, *a, **k))
    monkeypatch.setattr(layers, "BROADCAST_IDS", most)
    monkeypatch.setattr(refresh, "BROADCAST_IDS", most)
    first, second = _snapshot(make, 0), _snapshot(make, 1)
    edges = lambda s: sorted(map(tuple, s.edges.select("source_id", "target_id").collect()))
    layers.advance(first, str(tmp_path / "l"))
    layered = layers.read_layers(spark, layers.advance(second, str(tmp_path / "l")))
    assert edges(layered) == [(7, 1), (8, 2)]
    refresh.write_state(refresh.refresh(first), str(tmp_path / "s"))
    assert edges(refresh.refresh(second, refresh.read_state(spark, str(tmp_path / "s")))) == [(7, 1), (8, 2)]
    for texts in (read[1], read[3]):
        assert [r[0] for r in texts.select("object_id").collect()] == [2]
        assert ("Join" in _plan(texts)) == (most > 0)  # many are joined once and read where they were written


def test_reasons_are_sought_only_where_their_words_are(make):
    """the reasons are those of the patterns alone."""
    texts = (
        "BEGIN " * 5, "begin\n" * 4 + "beginning", "BEGINBEGIN" * 4, "case " * 10, "CASE " * 9 + "lowercase", "WITH a AS (" * 10, "with a as (" * 9,
        "EXEC ( @q )", "exec(@q)", "sp_executesql @q", "DECLARE @q NVARCHAR(9) = 'x' + SELECT", "declare @q nvarchar", "DECLARE @q int INSERT", "WHILE 1 = 1",
        "meanwhile", "CURSOR", "cursors", "WHİLE", "ſp_executesql @q", "", None,
    )
    df = make("i int, t string", *enumerate(texts))
    t = F.col("t")
    count = lambda p: F.regexp_count(t, F.lit(p))
    begins, cases, ctes = count(r"(?i)\bBEGIN\b"), count(r"(?i)\bCASE\b"), count(r"(?i)\bWITH\s+\w+\s+AS\s*\(")
    run, sql = t.rlike(r"(?i)EXEC\s*\(\s*@\w+\s*\)"), t.rlike(r"(?i)sp_executesql\s+@\w+")
    concat = t.rlike(r"(?is)DECLARE\s+@\w+.*?NVARCHAR.*?(?:INSERT|SELECT|UPDATE|DELETE|FROM)")
    plain = F.array_compact(F.array(
        F.when(run, resolve.REASON_EXEC_VARIABLE), F.when(sql, resolve.REASON_EXECUTESQL), F.when(concat & ~run & ~sql, resolve.REASON_CONCAT),
        F.when(begins >= 5, F.format_string("Deep nesting: %d BEGIN/END blocks (limit: 4)", begins)), F.when(t.rlike(r"(?i)\bWHILE\b"), resolve.REASON_WHILE),
        F.when(t.rlike(r"(?i)\bCURSOR\b"), resolve.REASON_CURSOR), F.when(cases >= 10, F.format_string("Complex CASE logic: %d CASE statements (limit: 9)", cases)),
        F.when(ctes >= 10, F.format_string("Multiple CTEs: %d WITH clauses (limit: 9)", ctes)),
    ))
    rows = df.select("t", resolve.failure_patterns(t).alias("now"), plain.alias("then")).collect()
    assert [r["now"] for r in rows] == [r["then"] for r in rows]
    assert sum(bool(r["now"]) for r in rows) == 9
    assert _plan(df.select(resolve.failure_patterns(t))).lower().count("contains(") >= 7
