from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from threadline.functions import names
from threadline.operators import search
from threadline.plans.refresh import read_state, refresh, write_state
from threadline.session import scratch_dir
from threadline.sources import contracts, jdbc, logs, nodes_json, snapshot
from threadline.streaming.refresh import latest_version, stream_refresh


def test_kinds_are_recognised_by_columns():
    kind = contracts.detect_table_kind
    assert kind(["OBJECT_ID", "Definition", "extra"]) == "definitions"
    assert kind(["command_text"]) == "query_logs"
    assert kind(["command_text", "x"]) is None
    assert kind(["schema_name", "table_name", "column_name", "data_type"]) == "table_columns"
    assert kind(["object_id", "schema_name", "object_name", "object_type"]) == "objects"


def test_contract_messages(spark, make):
    bad = make("object_id string, schema_name string, object_name string", ("1", "a", "b"))
    rows = {(r["level"], r["message"]) for r in contracts.validate_contract(bad, "objects").collect()}
    assert rows == {("error", "missing required columns: object_type"), ("warning", "object_id: string cast to bigint")}
    assert contracts.validate_contract(make("sql_code string, database_object_id int"), "definitions_query").count() == 0
    assert contracts.validate_contract(bad, "nothing").first()["level"] == "error"
    found = {(r["kind"], r["level"]) for r in contracts.validate_kinds(spark, ["objects", "objects", None, "definitions"]).collect()}
    assert found == {
        ("objects", "warning"), ("dependencies", "error"), ("query_logs", "warning"), ("table_columns", "warning"), ("unknown", "warning"),
    }


@pytest.fixture
def tables(make):
    return {
        "objects": make(
            "object_id long, schema_name string, object_name string, object_type string, modify_date timestamp_ntz, Extra int",
            (1, "dbo", "T", "Table", None, 1), (2, "dbo", "P", "Stored Procedure", None, 1), (3, "dbo", "V", "View", None, 1),
            (4, "dbo", "U", "Table", None, 1),
        ),
        "definitions": make("object_id long, definition string", (2, "INSERT INTO dbo.U SELECT * FROM dbo.T"), (3, "CREATE VIEW dbo.V AS SELECT 1")),
        "dependencies": make(
            "referencing_object_id long, referenced_object_id long, referenced_schema_name string, referenced_entity_name string", (3, 1, "dbo", "T")
        ),
        "query_logs": make("command_text string"),
    }


def test_snapshot_round_trip(spark, tables, tmp_path):
    paths = snapshot.write_snapshot({**tables, "dependencies": tables["dependencies"].limit(0)}, str(tmp_path / "s"))
    assert set(paths) == {"objects", "definitions", "dependencies"}
    found, messages = snapshot.detect_snapshot(spark, str(tmp_path / "s"))
    assert set(found) == set(paths)
    assert messages.where("level = 'error'").count() == 0
    loaded = snapshot.load_snapshot(spark, found)
    counts = {r["table_name"]: r["row_count"] for r in snapshot.row_counts(loaded).collect()}
    assert counts == {"objects": 4, "definitions": 2, "dependencies": 0, "query_logs": 0, "table_columns": 0}
    assert "Extra" not in loaded["objects"].columns
    with pytest.raises(ValueError):
        snapshot.load_snapshot(spark, {"objects": found["objects"]})


def test_incremental_refresh_equals_full(spark, make, tables, tmp_path):
    dated = lambda day: F.lit(f"2024-{day}").cast("timestamp_ntz")
    first = refresh({**tables, "objects": tables["objects"].withColumn("modify_date", dated("01-01"))})
    write_state(first, str(tmp_path / "v1"))
    state = read_state(spark, str(tmp_path / "v1"))
    pairs = lambda s: {(r["source_id"], r["target_id"]) for r in s.edges.collect()}
    assert pairs(state) == {(1, 2), (2, 4), (1, 3)}
    changed = {
        **tables,
        "objects": tables["objects"].where("object_id <> 3").withColumn("modify_date", dated("05-01")),
        "definitions": make("object_id long, definition string", (2, "DELETE FROM dbo.T")),
    }
    again = refresh(changed, state)
    assert pairs(again) == {(2, 1)}
    full = refresh(changed, full_refresh=True)
    assert pairs(again) == pairs(full)
    meta = lambda s: {(r["object_id"], r["primary_source"], r["parse_success"]) for r in s.metadata.collect()}
    assert meta(again) == meta(full) == {(2, "parser", True)}


def test_stream_refresh_writes_versions(spark, tables, tmp_path):
    snapshot.write_snapshot(tables, str(tmp_path / "snap"))
    control = tmp_path / "control"
    control.mkdir()
    root, checkpoint = str(tmp_path / "state"), str(tmp_path / "ckpt")
    (control / "1.json").write_text(json.dumps({"snapshot": str(tmp_path / "snap")}))
    query = stream_refresh(spark, str(control), root, checkpoint)
    query.awaitTermination(120)
    version = latest_version(spark, root)
    assert version.endswith("v-0")
    assert read_state(spark, version).edges.count() == 3
    assert latest_version(spark, root, before=0) is None


def test_nodes_json(spark, tmp_path):
    items = [
        {"id": "1", "name": "a", "schema": "x", "object_type": "Table", "inputs": ["9"], "outputs": ["2"]},
        {"id": "2", "name": "b", "schema": "x", "object_type": "Function", "inputs": [], "outputs": "oops"},
        {"name": "no id", "schema": "x", "object_type": "View", "inputs": [], "outputs": []},
    ]
    (tmp_path / "n.json").write_text(json.dumps(items))
    nodes = nodes_json.read_nodes_json(spark, str(tmp_path / "n.json"), multi_line=True)
    assert nodes.count() == 3
    messages = {(r["id"], r["level"]) for r in nodes_json.validate_nodes(nodes).collect()}
    assert {("2", "error"), (None, "warning")} <= messages
    named = nodes.where("id IS NOT NULL")
    assert [tuple(r) for r in nodes_json.dangling_refs(named).collect()] == [("1", "input", "9")]
    edges, fixes = nodes_json.symmetrise(named)
    assert [tuple(r) for r in edges.collect()] == [("1", "2")]
    assert [tuple(r) for r in fixes.collect()] == [("2", "input", "1")]
    found = named.select("id").limit(0).selectExpr("id", "'in' AS direction", "id AS other", "true AS two_way")
    nodes_json.write_nodes_json(nodes_json.node_attributes(named), found, str(tmp_path / "out"))
    assert "ddl_text" not in spark.read.json(str(tmp_path / "out")).columns


def test_jdbc_options_and_queries():
    queries = jdbc.catalog_queries()
    assert set(queries) == {"objects", "definitions", "dependencies", "table_columns", "query_logs"}
    assert all("NOT IN ('sys'" in q for k, q in queries.items() if k != "query_logs")
    plain = jdbc.jdbc_options("jdbc:x", "SELECT 1", user="u")
    assert plain["query"] == "SELECT 1" and plain["user"] == "u"
    split = jdbc.jdbc_options("jdbc:x", "SELECT 1", "object_id", (0, 100), 8)
    assert split["dbtable"] == "(SELECT 1) AS part" and split["numPartitions"] == "8" and "query" not in split
    with pytest.raises(ValueError):
        jdbc.jdbc_options("jdbc:x", "SELECT 1", "object_id")


def test_log_lines(spark, tmp_path):
    lines = [f"2024-01-01 {'ERROR' if i % 3 == 0 else 'INFO'} line {i}" for i in range(30)]
    (tmp_path / "app.log").write_text("\n".join(lines) + "\n")
    out = logs.log_lines(spark, str(tmp_path / "app.log"), n=10, level="error").collect()
    assert [r["value"] for r in out] == [x for x in lines[-10:] if "ERROR" in x]
    assert {r["level"] for r in out} == {"ERROR"}
    assert logs.log_lines(spark, str(tmp_path / "app.log"), text="LINE 2").count() == 11


def test_export(spark, tables, tmp_path):
    snapshot.export_definitions(tables["definitions"], tables["objects"], str(tmp_path / "e"))
    assert [r["value"] for r in spark.read.text(str(tmp_path / "e")).collect()] == ["-- [dbo].[P]", "INSERT INTO dbo.U SELECT * FROM dbo.T"]


def test_names(make):
    df = make("s string", ("STG-Sales_EU",), ("sales_gold",), ("gold",), ("dbo",))
    got = [tuple(r) for r in df.select(names.schema_layer(F.col("s")), names.schema_department(F.col("s"))).collect()]
    assert got == [("staging", "saleseu"), ("consumption", "salesgold"), ("consumption", "gold"), (None, "dbo")]
    assert names.split_patterns(" a*, ,b ") == ["a*", "b"]
    hit = make("n string", ("a.b",), ("axb",), (r"q\E.*",)).select(names.matches_any(F.col("n"), ["A.*", r"q\E.*"])).collect()
    assert [r[0] for r in hit] == [True, False, True]


def test_search_index(spark, make, tmp_path):
    docs = make("id long, title string, body string", (1, "Customers", "load the customer café"), (2, "x", "customer order"), (3, "y", None))
    index = search.build_index(docs, "id", ["title", "body"], stop_words=["the"], stemmed=True, fold_accents=True)
    index.write(str(tmp_path / "ix"), buckets=4)
    terms = search.query_terms("Customers CAFÉ", index)
    assert terms == ["cafe", "custom"]
    loaded = search.TextIndex.load(spark, str(tmp_path / "ix"), "Customers CAFÉ")
    rows = [tuple(r) for r in search.search(loaded, "Customers CAFÉ").collect()]
    assert [r[0] for r in rows] == [1, 2]
    assert rows == [tuple(r) for r in search.search(index, "Customers CAFÉ").collect()]
    assert [r[0] for r in search.search(index, "customer cafe", mode="all").collect()] == [1]
    assert search.search(index, "!!").count() == 0


def test_scratch_needs_a_shared_folder_on_clusters(spark):
    class FakeConf:
        def get(self, key, default=None):
            return default

    class FakeContext:
        applicationId, master = "app", "spark://host:7077"

    class Fake:
        conf, sparkContext = FakeConf(), FakeContext()

    with pytest.raises(RuntimeError):
        scratch_dir(Fake(), "x")
    assert "/x-" in scratch_dir(spark, "x")


def test_all_files_of_a_kind_are_read_and_empty_tables_come_back(spark, make, tmp_path):
    objects = make("object_id long, schema_name string, object_name string, object_type string", (1, "a", "x", "Table"), (2, "a", "y", "View"))
    tables = {
        "objects": objects,
        "definitions": make("object_id long, definition string"),
        "dependencies": make(
            "referencing_object_id long, referenced_object_id long, referenced_schema_name string, referenced_entity_name string"
        ),
    }
    snapshot.write_snapshot(tables, str(tmp_path))
    objects.where("object_id = 2").withColumn("object_id", F.lit(3).cast("long")).write.parquet(str(tmp_path / "objects-more"))
    paths, _ = snapshot.detect_snapshot(spark, str(tmp_path))
    loaded = snapshot.load_snapshot(spark, paths)
    assert sorted(r["object_id"] for r in loaded["objects"].collect()) == [1, 2, 3]
    assert loaded["definitions"].count() == 0


def test_log_lines_follow_the_time_of_their_files(spark, tmp_path):
    import os

    for name, line, at in (("app.log.1", "old", 1000), ("app.log", "new", 2000)):
        (tmp_path / name).write_text(f"2024 INFO {line}\n")
        os.utime(tmp_path / name, (at, at))
    lines = [r["value"] for r in logs.log_lines(spark, str(tmp_path / "app.log*"), 10).collect()]
    assert lines == ["2024 INFO old", "2024 INFO new"]


def test_catalog_scan_is_in_contract_shape(make):
    rows = jdbc.in_contract_shape("objects", make("object_id long, schema_name string, object_name string, type_code string", (1, "a", "t", "U")))
    assert rows.first()["object_type"] == "Table"
