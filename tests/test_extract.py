"""Golden texts: what each statement reads and writes."""

from __future__ import annotations

import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from threadline.functions import text
from threadline.operators import extract, resolve, rules

TABLES = [
    "dbo.SourceTable", "dbo.TargetTable", "dbo.Customers", "CONSUMPTION_FINANCE.Orders", "dbo.Orders", "dbo.Products",
    "dbo.StagingTable", "dbo.ExistingTable", "dbo.GL_Staging", "CONSUMPTION_FINANCE.DimCurrency",
    "CONSUMPTION_FINANCE.FactGL", "dbo.My Table", "dbo.t1", "dbo.t2", "dbo.t3",
]

CASES = {
    "simple select": ("SELECT a FROM dbo.SourceTable", {"dbo.SourceTable"}, set()),
    "three joins": (
        "SELECT * FROM dbo.Customers c INNER JOIN CONSUMPTION_FINANCE.Orders o ON o.i = c.i LEFT JOIN dbo.Products p ON p.i = o.i",
        {"dbo.Customers", "CONSUMPTION_FINANCE.Orders", "dbo.Products"},
        set(),
    ),
    "insert select": ("INSERT INTO dbo.TargetTable (a, b) SELECT a, b FROM dbo.SourceTable", {"dbo.SourceTable"}, {"dbo.TargetTable"}),
    "insert without into": ("INSERT dbo.TargetTable SELECT a FROM dbo.SourceTable", {"dbo.SourceTable"}, {"dbo.TargetTable"}),
    "update from alias": (
        "UPDATE t SET t.a = s.a FROM dbo.TargetTable t INNER JOIN dbo.SourceTable s ON s.i = t.i",
        {"dbo.SourceTable", "dbo.TargetTable"},
        {"dbo.TargetTable"},
    ),
    "merge": (
        "MERGE INTO dbo.TargetTable AS t USING dbo.SourceTable AS s ON t.i = s.i WHEN MATCHED THEN UPDATE SET t.a = s.a "
        "WHEN NOT MATCHED THEN INSERT (a) VALUES (s.a);",
        {"dbo.SourceTable"},
        {"dbo.TargetTable"},
    ),
    "delete": ("DELETE FROM dbo.TargetTable WHERE a < 1", set(), {"dbo.TargetTable"}),
    "truncate": ("TRUNCATE TABLE dbo.StagingTable", set(), {"dbo.StagingTable"}),
    "derived table": (
        "SELECT * FROM (SELECT i FROM dbo.Customers) c JOIN (SELECT i FROM dbo.Orders) o ON o.i = c.i",
        {"dbo.Customers", "dbo.Orders"},
        set(),
    ),
    "two ctes": (
        "WITH a AS (SELECT * FROM dbo.Customers), b AS (SELECT * FROM dbo.Orders) SELECT * FROM a JOIN b ON a.i = b.i",
        {"dbo.Customers", "dbo.Orders"},
        set(),
    ),
    "unqualified": ("SELECT * FROM Customers", {"dbo.Customers"}, set()),
    "brackets": ("SELECT * FROM [dbo].[Customers] JOIN [dbo].[My Table] m ON 1 = 1", {"dbo.Customers", "dbo.My Table"}, set()),
    "three parts": ("SELECT * FROM db1.dbo.Customers", {"dbo.Customers"}, set()),
    "unknown dropped": ("SELECT * FROM dbo.ExistingTable JOIN dbo.Missing m ON 1 = 1", {"dbo.ExistingTable"}, set()),
    "load procedure": (
        "CREATE PROCEDURE [dbo].[spLoad] @d DATE AS BEGIN SET NOCOUNT ON; TRUNCATE TABLE CONSUMPTION_FINANCE.FactGL\n"
        "INSERT INTO CONSUMPTION_FINANCE.FactGL (a) SELECT g.a FROM dbo.GL_Staging g\n"
        "LEFT JOIN CONSUMPTION_FINANCE.DimCurrency c ON c.k = g.k END",
        {"dbo.GL_Staging", "CONSUMPTION_FINANCE.DimCurrency"},
        {"CONSUMPTION_FINANCE.FactGL"},
    ),
    "local names": (
        "DECLARE @v TABLE (a INT); CREATE TABLE #t (a INT); INSERT INTO #t SELECT * FROM @v; SELECT * FROM sys.objects",
        set(),
        set(),
    ),
    "select keeps the insert": (
        "DECLARE @x = (SELECT id FROM t1) SET @y = 1 INSERT INTO t2 SELECT col FROM t3",
        {"dbo.t1", "dbo.t3"},
        {"dbo.t2"},
    ),
    "comments": ("SELECT 1 -- FROM dbo.Orders\n/* JOIN dbo.Products\n */ FROM dbo.Customers", {"dbo.Customers"}, set()),
    "after commit": ("BEGIN TRANSACTION; DELETE dbo.t1; COMMIT TRANSACTION; SELECT * FROM dbo.Orders", {"dbo.Orders"}, {"dbo.t1"}),
    "marks in literals": ("SELECT '--x', '/*' AS s FROM dbo.Orders -- FROM dbo.t1\n; SELECT '*/' FROM dbo.t3", {"dbo.Orders", "dbo.t3"}, set()),
    "output into": ("DELETE dbo.t1 OUTPUT deleted.* INTO dbo.t2 WHERE a = 1; SELECT 1 FROM dbo.t3", {"dbo.t3"}, {"dbo.t1", "dbo.t2"}),
    "keywords in literals": ("SELECT 'copied FROM dbo.t1 ' AS s FROM dbo.t2; EXEC ('SELECT * FROM dbo.t3 ')", {"dbo.t2"}, set()),
    "comma list": ("SELECT a FROM dbo.t1, dbo.t2 AS x, [dbo].[My Table] WHERE a IN (1, 2)", {"dbo.t1", "dbo.t2", "dbo.My Table"}, set()),
    "comma behind a join": (
        "SELECT f(a, dbo.Orders) FROM dbo.t1 x JOIN dbo.t2 y ON x.a = y.a AND y.b IN (1, 2), dbo.t3 GROUP BY a, dbo.Products",
        {"dbo.t1", "dbo.t2", "dbo.t3"},
        set(),
    ),
    "comma behind a subquery": (
        "SELECT (SELECT max(a) FROM dbo.t1), dbo.Orders FROM (SELECT 1 AS a FROM dbo.t2 WITH (NOLOCK), dbo.t3) q, dbo.Customers c",
        {"dbo.t1", "dbo.t2", "dbo.t3", "dbo.Customers"},
        set(),
    ),
    "update of a listed table": ("UPDATE y SET y.a = 1, y.b = 2 FROM dbo.t1 x, dbo.t2 y WHERE x.i = y.i", {"dbo.t1", "dbo.t2"}, {"dbo.t2"}),
    "brackets with commas": ("SELECT a FROM dbo.[My Table] [a, b], dbo.t1", {"dbo.My Table", "dbo.t1"}, set()),
    "top": ("UPDATE TOP (5) dbo.t1 SET a = 1; DELETE TOP (10) PERCENT FROM dbo.t2; INSERT TOP (abs(3)) INTO dbo.t3 SELECT 1", set(), {"dbo.t1", "dbo.t2", "dbo.t3"}),
    "database without schema": ("SELECT a FROM edw..Customers JOIN srv.edw..Orders o ON 1 = 1", {"dbo.Customers", "dbo.Orders"}, set()),
    "nested comments": ("/* a /* b */ FROM dbo.t1 */ SELECT 1 FROM dbo.t2 /** it's **/ JOIN dbo.t3 x ON 1 = 1", {"dbo.t2", "dbo.t3"}, set()),
    "quotes in names": ("SELECT a FROM [O'Brien].[T1] -- it's FROM dbo.t1\nJOIN dbo.t2 x ON 1 = 1", {"dbo.t2"}, set()),
    "comment never closed": ("SELECT a FROM dbo.t1 /* FROM dbo.t2", {"dbo.t1"}, set()),
    "qualified table named like a cte": ("WITH Orders AS (SELECT a FROM dbo.Orders) SELECT a FROM Orders", {"dbo.Orders"}, set()),
}


@pytest.fixture(scope="module")
def catalog(make):
    rows = [(i, *name.split(".", 1), "Table") for i, name in enumerate(TABLES, 1)]
    rows += [(101, "dbo", "spChild", "Stored Procedure"), (102, "dbo", "fnRows", "Function")]
    return make("object_id long, schema_name string, object_name string, object_type string", *rows)


def _resolved(make, catalog, *sqls, **options):
    texts = make("object_id long, definition string", *[(1000 + i, s) for i, s in enumerate(sqls)])
    return resolve.resolve_definitions(texts, catalog, **options)


def test_golden_texts(make, catalog):
    names = list(CASES)
    found = {i: (set(), set()) for i in range(len(names))}
    for row in _resolved(make, catalog, *[CASES[n][0] for n in names]).collect():
        if row["role"] in ("source", "target"):
            found[row["object_id"] - 1000][row["role"] == "target"].add(row["name"])
    assert {n: found[i] for i, n in enumerate(names)} == {n: (CASES[n][1], CASES[n][2]) for n in names}


def test_calls_functions_and_created_tables(make, catalog):
    sql = "EXEC dbo.spChild @a = 1; SELECT * FROM dbo.t1 x CROSS APPLY dbo.fnRows(x.a) f; SELECT a INTO dbo.Fresh FROM dbo.t2"
    rows = {(r["role"], r["name"], r["ref_id"], r["name_only"]) for r in _resolved(make, catalog, sql).collect()}
    assert ("sp_call", "dbo.spChild", 101, False) in rows
    assert ("function", "dbo.fnRows", 102, False) in rows
    assert ("target", "dbo.Fresh", None, True) in rows
    kept = {r["name"] for r in _resolved(make, catalog, sql, keep_created=False).collect()}
    assert "dbo.Fresh" not in kept


def test_calls_with_a_result(make, catalog):
    rows = _resolved(make, catalog, "EXEC @rc = dbo.spChild @a = 1; EXECUTE  @x=[dbo].[spChild]").collect()
    assert {(r["role"], r["name"]) for r in rows} == {("sp_call", "dbo.spChild")}


def test_no_rule_is_quadratic(make):
    import time

    texts = [
        "EXEC dbo.p " + "@a OUTPUT, " * 60_000, "SELECT a " * 60_000, "DECLARE @a INT " * 60_000, "/* " * 60_000, "FROM a " * 60_000,
        "[" * 60_000, "SELECT 1 FROM a WHERE x IN (" + "1, " * 60_000 + "2), dbo.b", "/*" + "*" * 100_000 + "*/ FROM dbo.b",
    ]
    df = make("object_id long, definition string", *enumerate(texts))
    extract.extract_refs(df.limit(1)).collect()
    begin = time.time()
    extract.extract_refs(df).collect()
    df.select(resolve.failure_reason(F.col("definition"))).collect()
    assert time.time() - begin < 30


def test_hints(make):
    sqls = {
        1: "AS BEGIN\n  -- @LINEAGE_INPUTS: dbo.SourceData\n  -- @lineage_outputs: dbo.Customers, dbo.Orders\r\n EXEC sp_executesql @sql END",
        2: "BEGIN CATCH -- @LINEAGE_INPUTS: dbo.Source\n-- @LINEAGE_OUTPUTS: dbo.ErrorRecoveryTable\nEND CATCH",
        3: "-- @LINEAGE_INPUTS: [CONSUMPTION_FINANCE].[DimCustomers], dbo . Staging , InvalidTable,, a.b.c\n-- @LINEAGE_OUTPUTS: TargetTable",
    }
    found = resolve.extract_hints(make("object_id long, definition string", *sqls.items())).collect()
    by_id = {i: {(r["role"], r["name"]) for r in found if r["object_id"] == i} for i in sqls}
    assert by_id[1] == {("source", "dbo.SourceData"), ("target", "dbo.Customers"), ("target", "dbo.Orders")}
    assert by_id[2] == {("source", "dbo.Source"), ("target", "dbo.ErrorRecoveryTable")}
    assert by_id[3] == {
        ("source", "CONSUMPTION_FINANCE.DimCustomers"), ("source", "dbo.Staging"), ("source", "dbo.InvalidTable"), ("target", "dbo.TargetTable"),
    }


def test_hint_modes(make, catalog):
    sql = "-- @LINEAGE_INPUTS: dbo.Orders\nINSERT INTO dbo.t1 SELECT * FROM dbo.Customers"
    union = {(r["role"], r["name"]) for r in _resolved(make, catalog, sql).collect()}
    replace = {(r["role"], r["name"]) for r in _resolved(make, catalog, sql, hint_mode="replace").collect()}
    assert union == {("source", "dbo.Orders"), ("source", "dbo.Customers"), ("target", "dbo.t1")}
    assert replace == {("source", "dbo.Orders"), ("target", "dbo.t1")}
    with pytest.raises(ValueError):
        _resolved(make, catalog, sql, hint_mode="other")


def test_parse_result_without_text(make, catalog):
    objects = catalog.withColumn("modify_date", F.lit(None).cast("timestamp_ntz"))
    texts = make("object_id long, definition string", (5, "x"))
    row = resolve.parse_definitions(objects, texts).collect()[0]
    assert (row["object_id"], row["parse_success"], row["parse_error"]) == (101, False, "No DDL definition found")


def test_long_texts_do_not_overflow(make, catalog):
    wide = "SELECT " + ", ".join(f"CASE WHEN c{i} = 1 THEN 'x;y' END AS c{i}" for i in range(20_000)) + " FROM dbo.t1; "
    many = "".join(f"INSERT INTO dbo.X{i} SELECT a, b FROM dbo.S{i} s JOIN dbo.t3 q ON q.i = s.i; " for i in range(4_000))
    long_comment = "/*" + "FROM dbo.Orders " * 50_000 + "*/"
    sql = "CREATE PROCEDURE [dbo].[big] AS BEGIN " + wide + long_comment + many + "INSERT INTO dbo.t2 SELECT 1 AS a FROM dbo.Customers END"
    rows = {(r["role"], r["name"]) for r in _resolved(make, catalog, sql).collect()}
    assert rows == {("source", "dbo.t1"), ("source", "dbo.t3"), ("source", "dbo.Customers"), ("target", "dbo.t2")}
    refs = extract.extract_refs(make("object_id long, definition string", (1, sql)))
    assert refs.where("role = 'target'").count() == 4_001


def test_failure_reasons(make):
    sqls = [
        ("EXEC (@sql)", 0, 0),
        ("exec sp_executesql @stmt", 9, 1),
        ("DECLARE @s NVARCHAR(MAX) = 'x' + 'SELECT 1'", 0, 0),
        ("BEGIN " * 5 + "WHILE 1=1 DECLARE c CURSOR FOR SELECT 1", 3, 2),
        ("CASE " * 10, 0, 0),
        ("WITH a AS (SELECT 1) " * 10, 0, 0),
        ("plain", 0, 0),
    ]
    df = make("sql string, e int, f int", *sqls)
    out = [r[0] for r in df.select(resolve.failure_reason(F.col("sql"), F.lit("boom"), F.col("e"), F.col("f"))).collect()]
    assert out[0].startswith(resolve.REASON_EXEC_VARIABLE + " | →")
    assert out[1].startswith(resolve.REASON_EXECUTESQL + " | Expected 9 tables, found 1 (8 missing) | →")
    assert out[2].startswith(resolve.REASON_CONCAT)
    assert out[3].startswith("Deep nesting: 5 BEGIN/END blocks (limit: 4) | " + resolve.REASON_WHILE + " | " + resolve.REASON_CURSOR)
    assert out[4].startswith("Complex CASE logic: 10 CASE statements")
    assert out[5].startswith("Multiple CTEs: 10 WITH clauses")
    assert out[6].startswith("Parse error: boom")


PIECES = ["SELECT", "select", " ", "\n", ";", "FROM", " from ", "TOP 5 ", "DISTINCT ", "a, b", "INTO t", "(", ")", "INSERT", "x"]


def _simplified(sql: str) -> str:
    """The same rule, one match at a time."""
    out, at = [], 0
    for m in re.finditer(r"(?i)\bSELECT\b", sql):
        if m.start() < at:
            continue
        tail = sql[m.start():]
        stop = re.search(r"(?i)\bSELECT\b", tail[1:])
        piece = tail[: stop.start() + 1] if stop else tail
        hit = re.match(r"(?is)SELECT\s+(TOP\s+\d+\s+|DISTINCT\s+)?[^;]*?(?=\s+(?:INTO|FROM)\b)", piece)
        out.append(sql[at:m.start()])
        out.append("SELECT " + (hit.group(1) or "") + "*" if hit else "")
        at = m.start() + (hit.end() if hit else 0)
    return "".join(out) + sql[at:]


def test_simplify_select_matches_plain_rule(make):
    @settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
    @given(st.lists(st.lists(st.sampled_from(PIECES), max_size=14).map("".join), min_size=20, max_size=40))
    def run(texts):
        df = make("t string", *[(t,) for t in texts])
        got = [r[0] for r in df.select(text.simplify_select(F.col("t"))).collect()]
        assert got == [_simplified(t) for t in texts]

    run()


def test_quoted_reserved_words_and_bars_are_names(make):
    texts = make("object_id long, definition string", (1, "SELECT a FROM [Order] JOIN dbo.[Values] v ON 1 = 1; SELECT b FROM [dbo].[a|b]"))
    names = {r["name"] for r in extract.extract_refs(texts).collect()}
    assert names == {"dbo.Order", "dbo.Values", "dbo.a|b"}


def test_first_transaction_only_on_request(make):
    texts = make("object_id long, definition string", (1, "DELETE dbo.t1; COMMIT TRANSACTION; SELECT a FROM dbo.t2"))
    assert {r["name"] for r in extract.extract_refs(texts).collect()} == {"dbo.t1", "dbo.t2"}
    assert {r["name"] for r in extract.extract_refs(texts, first_transaction=True).collect()} == {"dbo.t1"}


def test_rules_with_one_group(make):
    rule = rules.Rule(name="one", rule_type="extraction", extraction_target="source", pattern=r"\bREADS\s+(\S+)")
    texts = make("object_id long, definition string", (1, "READS dbo.t1"))
    assert rule.problems() == []
    assert [r["name"] for r in extract.extract_refs(texts, (rule,)).collect()] == ["dbo.t1"]
    assert rules.Rule(name="two", rule_type="extraction", extraction_target="source", pattern="(a)", groups=(2,)).problems()
