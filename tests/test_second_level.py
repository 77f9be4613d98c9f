"""Executed texts, failure reasons in the state, exports in parts, substring candidates, announced snapshots."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from threadline.functions import names
from threadline.operators import dynamic, gram_index, resolve
from threadline.sources import nodes_json, snapshot
from threadline.streaming.refresh import latest_version, stream_refresh, version_number

EXECUTED = {
    "literal": ("EXEC ('SELECT a FROM dbo.t1')", ["SELECT a FROM dbo.t1"]),
    "doubled quotes": ("EXECUTE(N'SELECT ''x'' AS s FROM dbo.t1 WHERE b = ''''')", ["SELECT 'x' AS s FROM dbo.t1 WHERE b = ''"]),
    "concatenation": ("EXEC ('SELECT a FROM ' + @t + ' JOIN dbo.t2 y ON 1 = 1')", ["SELECT a FROM @t JOIN dbo.t2 y ON 1 = 1"]),
    "executesql": ("EXEC sp_executesql N'DELETE dbo.t1', N'@p int', @p = 1", ["DELETE dbo.t1"]),
    "named statement": ("EXEC sp_executesql @stmt = N'DELETE dbo.t1'", ["DELETE dbo.t1"]),
    "variable": (
        "DECLARE @s NVARCHAR(MAX) = N'SELECT a '; SET @s += N'FROM dbo.t1'; SET @other = 'FROM dbo.t9'; EXEC (@S)",
        ["FROM dbo.t1", "SELECT a "],
    ),
    "variable in an expression": ("SET @w = ' WHERE x IN (SELECT y FROM dbo.t2)'; EXEC ('SELECT a FROM dbo.t1' + @w)",
        [" WHERE x IN (SELECT y FROM dbo.t2)", "SELECT a FROM dbo.t1@w"]),
    "function": ("EXEC ('SELECT a FROM ' + QUOTENAME(@t) + ' x')", ["SELECT a FROM @value x"]),
    "unknown variable": ("EXEC (@sql)", []),
    "comment": ("/* EXEC ('SELECT a FROM dbo.t1') */ EXEC dbo.p 'SELECT a FROM dbo.t1'", []),
    "call": ("EXEC dbo.p @a = 'FROM dbo.t1'", []),
}


def test_executed_texts(make):
    order = list(EXECUTED)
    df = make("i int, sql string", *[(i, EXECUTED[n][0]) for i, n in enumerate(order)])
    found = {order[r["i"]]: sorted(r["t"]) for r in df.select("i", dynamic.executed_texts(F.col("sql")).alias("t")).collect()}
    assert found == {n: EXECUTED[n][1] for n in order}


def test_dynamic_edges_are_marked_and_weaker(make):
    objects = make("object_id long, schema_name string, object_name string, object_type string",
        (1, "dbo", "t1", "Table"), (2, "dbo", "t2", "Table"), (9, "dbo", "p", "Stored Procedure"))
    texts = make("object_id long, definition string", (9, "SELECT a FROM dbo.t1; EXEC ('INSERT INTO dbo.t2 SELECT a FROM dbo.t1, dbo.gone')"))
    from threadline.operators import graph

    plain = graph.parsed_edges(resolve.resolve_definitions(texts, objects))
    found = dynamic.with_dynamic(plain, texts, objects).collect()
    assert {(r["source_id"], r["target_id"], r["edge_type"]) for r in found} == {(1, 9, "dependency"), (9, 2, "dynamic")}


def test_reasons_of_rows(make):
    objects = make("object_id long, schema_name string, object_name string, object_type string, modify_date timestamp_ntz",
        *[(i, "dbo", f"p{i}", "Stored Procedure", None) for i in range(1, 6)], (8, "dbo", "t1", "Table", None))
    texts = make("object_id long, definition string", (1, "SELECT a FROM dbo.t1"), (2, "EXEC (@s)"),
        (3, "-- WHILE\nSELECT 'CURSOR WHILE' FROM dbo.t1"), (4, "-- @LINEAGE_INPUTS: dbo.t1\nEXEC (@s)"))
    rows = {r["object_id"]: r for r in resolve.parse_definitions(objects, texts, reasons=True).collect()}
    assert [rows[i]["failure_reason"] for i in (1, 3, 4, 5)] == [None] * 4
    assert rows[2]["failure_reason"] == f"{resolve.REASON_EXEC_VARIABLE} | {resolve.ADVICE}"
    assert rows[5]["parse_error"] == "No DDL definition found"


NODE = "id string, name string, schema string, object_type string, inputs array<string>, outputs array<string>, part long, parts long, pos int"


@pytest.mark.parametrize("counted", [True, False])
def test_the_last_export_of_a_node_wins_whole(make, counted):
    rows = [
        ("h", "old", "s", "Table", [], ["a"], 0, 2, 1), ("h", "older", "s", "Table", [], ["b"], 1, 2, 2),
        ("a", "a", "s", "Table", [], [], 0, 1, 3), ("b", "b", "s", "Table", [], [], 0, 1, 4),
        ("h", "h", "s", "Table", [], ["a"], 0, 1, 5),
        ("g", "old", "s", "Table", [], ["a"], 0, 1, 6), ("g", "g", "s", "Table", [], ["b"], 0, 2, 7), ("g", "g", "s", "Table", [], ["h"], 1, 2, 8),
    ]
    df = make(NODE, *rows)
    nodes, found, _ = nodes_json.import_nodes(df if counted else df.drop("parts"))
    assert {(r["id"], r["name"]) for r in nodes.collect()} == {(x, x) for x in "habg"}
    out = {(r["id"], r["other"]) for r in found.where("direction = 'out'").collect()}
    assert out == {("h", "a"), ("g", "b"), ("g", "h")}


def test_parts_in_any_order(make):
    rows = [("h", "h", "s", "Table", [], [str(p)], p, 3, k) for k, p in enumerate([2, 0, 1, 1, 2, 0])]
    last = nodes_json.dedupe_last(make(NODE, *rows)).collect()
    assert sorted((r["part"], r["pos"]) for r in last) == [(0, 5), (1, 3), (2, 4)]


def test_object_keys_are_stable(make):
    df = make("schema_name string, object_name string", ("dbo", "T"), ("DBO", "t"), ("db", "oT"))
    keys = [r[0] for r in df.select(names.object_key(F.col("schema_name"), F.col("object_name"))).collect()]
    assert keys[0] == keys[1] == 8751762204432040472 and keys[2] != keys[0]
    assert snapshot.colliding_keys(df).count() == 0


def test_substring_candidates(spark, make, tmp_path):
    rng = random.Random(2)
    docs = [(i, rng.choice([None, "Name", "ÜBER"]), "".join(rng.choices("abcDé ", k=rng.randrange(0, 40)))) for i in range(300)]
    df = make("id long, name string, text string", *docs)
    folder = gram_index.create(df, str(tmp_path / "g"), "id", ["name", "text"], buckets=4)
    for term in ("abc", "Über", "dé a", "abca", "zzz", "ab", ""):
        holds = {i for i, n, t in docs if any(term.lower() in (x or "").lower() for x in (n, t))}
        found = {r["id"] for r in gram_index.candidates(df, folder, term).collect()}
        assert holds <= found
        if len(term) == 3:
            assert found == holds
        if len(term) < 3:
            assert len(found) == len(docs)


def test_several_snapshots_of_one_file_apply_in_order(spark, make, tmp_path):
    def write(name, text, day):
        import datetime

        tables = {
            "objects": make("object_id long, schema_name string, object_name string, object_type string, modify_date timestamp_ntz",
                (1, "dbo", "a", "Table", datetime.datetime(2024, 1, 1)), (2, "dbo", "b", "Table", datetime.datetime(2024, 1, 1)),
                (9, "dbo", "p", "Stored Procedure", datetime.datetime(2024, 1, day))),
            "definitions": make("object_id long, definition string", (9, text)),
            "dependencies": make("referencing_object_id long, referenced_object_id long, referenced_schema_name string, referenced_entity_name string", (None, None, "", "")),
        }
        for kind, df in tables.items():
            df.coalesce(1).write.parquet(f"{tmp_path}/{name}/{kind}")
        return f"{tmp_path}/{name}"

    folders = [write("s1", "SELECT x FROM dbo.a", 1), write("s2", "SELECT x FROM dbo.b", 2), write("s3", "INSERT INTO dbo.a SELECT x FROM dbo.b", 3)]
    control = tmp_path / "control"
    control.mkdir()
    (control / "one.json").write_text("".join(json.dumps({"snapshot": f}) + "\n" for f in folders))
    root = str(tmp_path / "state")
    query = stream_refresh(spark, str(control), root, str(tmp_path / "checkpoint"))
    query.awaitTermination()
    assert query.exception() is None
    edges = lambda v: {(r["source_id"], r["target_id"]) for r in spark.read.parquet(f"{root}/{v}/lineage_edges").collect()}
    assert [edges(v) for v in ("v-0", "v-0.1", "v-0.2")] == [{(1, 9)}, {(2, 9)}, {(2, 9), (9, 1)}]
    assert latest_version(spark, root).endswith("v-0.2") and version_number("x/v-12.3") == (12, 3)
