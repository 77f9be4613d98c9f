"""Clustered edges and layered state against their plain counterparts."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from threadline.operators import adjacency, traverse
from threadline.operators.traverse import TraceRequest
from threadline.plans import layers
from threadline.plans.refresh import refresh


def _graph(make, seed, nodes=60, edges=150):
    rng = random.Random(seed)
    pairs = [(rng.randrange(nodes), rng.randrange(nodes)) for _ in range(edges)] + [(7, i) for i in range(nodes)] + [(None, 3), (3, None)]
    rows = [(i, f"N{i}", rng.choice("abc"), "Table", "Other") for i in range(nodes)]
    return (
        make("id long, name string, schema string, object_type string, data_model_type string", *rows),
        make("source_id long, target_id long", *pairs, *pairs[:20]),
    )


def _rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


@pytest.mark.parametrize("literals, hub_rows", [(1000, 100_000), (0, 20)])
def test_traversals_agree_on_both_forms(spark, make, tmp_path, monkeypatch, literals, hub_rows):
    monkeypatch.setattr(adjacency, "LITERALS", literals)
    monkeypatch.setattr(adjacency, "HUB_ROWS", hub_rows)
    nodes, edges = _graph(make, hub_rows + literals)
    adjacency.write_adjacency(edges, f"{tmp_path}/a", buckets=16)
    clustered = adjacency.read_adjacency(spark, f"{tmp_path}/a")
    assert (clustered.hubs.count() > 0) == (hub_rows == 20)
    plain = edges.where("source_id IS NOT NULL AND target_id IS NOT NULL").distinct()
    assert _rows(clustered.edges(), "source_id", "target_id") == _rows(plain, "source_id", "target_id")
    for request in (TraceRequest(7, None, 1, None), TraceRequest(3, None, 0, 2, ["a", "b"])):
        assert _rows(traverse.trace(nodes, clustered, request), "id", "direction", "depth") == _rows(
            traverse.trace(nodes, edges, request), "id", "direction", "depth"
        )
    for start, end, way in ((7, 20, "downstream"), (20, 7, "upstream")):
        request = TraceRequest(start, end)
        assert _rows(traverse.path_nodes(nodes, clustered, request, way, 3), "id", "from_start", "to_end") == _rows(
            traverse.path_nodes(nodes, edges, request, way, 3), "id", "from_start", "to_end"
        )
    some = nodes.where("schema <> 'c'")
    assert _rows(traverse.reachable_from_focus(some, clustered, ["a"]), "id") == _rows(traverse.reachable_from_focus(some, edges, ["a"]), "id")
    with pytest.raises(ValueError):
        clustered.reach(nodes.select("id", F.lit("up").alias("direction")), 1, ["up"])


@pytest.mark.parametrize("seed, depth", [(1, 4), (2, 5)])
def test_routes_from_both_ends(make, seed, depth):
    rng = random.Random(seed)
    pairs = {(rng.randrange(12), rng.randrange(12)) for _ in range(34)}
    nodes = make("id long, name string, schema string, object_type string, data_model_type string", *[(i, f"N{i}", "a", "Table", "Other") for i in range(12)])
    edges = make("source_id long, target_id long", *pairs)

    def walk(path):
        if path[-1] == 5:
            yield tuple(path)
        elif len(path) <= depth:
            for a, b in pairs:
                if a == path[-1] and b not in path:
                    yield from walk([*path, b])

    want = set(walk([0]))
    found = [tuple(r[0]) for r in traverse.paths(nodes, edges, TraceRequest(0, 5), depth).collect()]
    assert len(found) == len(set(found)) and set(found) == want
    assert {r["id"] for r in traverse.route_nodes(nodes, edges, TraceRequest(0, 5), depth).collect()} == {i for p in want for i in p}


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_level_exchanges_no_edges(spark, make, tmp_path, monkeypatch):
    _, edges = _graph(make, 1)
    adjacency.write_adjacency(edges, f"{tmp_path}/a", buckets=16)
    clustered = adjacency.read_adjacency(spark, f"{tmp_path}/a")
    spark.range(3).write.parquet(f"{tmp_path}/f")
    frontier = spark.read.parquet(f"{tmp_path}/f")
    # Few ids: no join at all, and only their buckets are read.
    plan = _plan(clustered.step_from([1, 2, 3], "downstream"))
    assert "Join" not in plan and "Exchange" not in plan
    assert "In(at" in plan or "at IN" in plan or "INSET" in plan
    spark.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", "false")  # only then plans name the buckets
    pruned = _plan(clustered.outgoing.where(F.col("at").isin([1, 2])))
    spark.conf.unset("spark.sql.sources.bucketing.autoBucketedScan.enabled")
    assert int(re.search(r"SelectedBucketsCount: (\d+) out of 16", pruned).group(1)) <= 2
    # Many ids and no broadcast: a merge of the buckets where they lie; only the frontier is dealt.
    monkeypatch.setattr(adjacency, "LITERALS", 0)
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = _plan(clustered.outgoing.join(frontier.withColumnRenamed("id", "at"), "at", "left_semi"))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    edge_side, frontier_side = plan.split("FileScan")[0], plan.split("FileScan")[1]
    assert "SortMergeJoin" in plan and plan.count("Exchange") == 1
    assert "Exchange" not in edge_side and "Exchange" in frontier_side


OBJECTS = "object_id long, schema_name string, object_name string, object_type string, modify_date timestamp_ntz"
DEPENDENCIES = "referencing_object_id long, referenced_object_id long, referenced_schema_name string, referenced_entity_name string"


def _snapshot(make, procs, views, tables, day):
    """procs: id -> (text, day of change); views: id -> ids read."""
    import datetime

    at = lambda d: datetime.datetime(2024, 1, d)
    objects = [(i, "dbo", f"T{i}", "Table", at(1)) for i in tables]
    objects += [(i, "dbo", f"P{i}", "Stored Procedure", at(d)) for i, (_, d) in procs.items()]
    objects += [(i, "dbo", f"V{i}", "View", at(1)) for i in views]
    return {
        "objects": make(OBJECTS, *objects),
        "definitions": make("object_id long, definition string", *[(i, t) for i, (t, _) in procs.items()]),
        "dependencies": make(DEPENDENCIES, (None, None, "", ""), *[(v, t, "dbo", f"T{t}") for v, own in views.items() for t in own]),
    }


def _same(spark, version, want):
    got = layers.read_layers(spark, version)
    edges = ("source_id", "target_id", "owner_id")
    assert _rows(got.edges, *edges) == _rows(want.edges, *edges)
    fields = ("object_id", "last_parsed_modify_date", "primary_source", "parse_success", "expected_count", "found_count")
    assert _rows(got.metadata, *fields) == _rows(want.metadata, *fields)


def test_layers_hold_what_a_refresh_gives_and_little_else(spark, make, tmp_path, monkeypatch):
    monkeypatch.setattr(layers, "BROADCAST_IDS", 3)  # the second run reads few texts, the third many
    tables = range(1, 9)
    procs = {i: (f"INSERT INTO dbo.T{i % 8 + 1} SELECT a FROM dbo.T{(i + 3) % 8 + 1}", 2) for i in range(100, 160)}
    views = {i: [i % 8 + 1, (i + 1) % 8 + 1] for i in range(200, 220)}
    root = str(tmp_path / "state")
    snapshot = _snapshot(make, procs, views, tables, 2)
    first = layers.advance(snapshot, root)
    whole = refresh(snapshot)
    _same(spark, first, whole)

    # Two procedures and a view change, a view loses all, an object of each kind goes.
    procs = {**procs, 101: ("SELECT a FROM dbo.T1", 5), 102: ("EXEC dbo.P103", 5), 170: ("SELECT a FROM dbo.T2", 5)}
    del procs[110]
    views = {**views, 201: [5], 202: []}
    del views[203]
    snapshot = _snapshot(make, procs, views, tables, 5)
    second = layers.advance(snapshot, root)
    whole = refresh(snapshot, whole)
    _same(spark, second, whole)
    assert len(second.layers) == 2 and second.layers[1][1] < 0.15 * second.layers[0][1]
    assert layers.latest(spark, root) == second and layers.latest(spark, root, 1) == first

    # A table goes: what read or wrote it loses these edges only.
    snapshot = _snapshot(make, procs, {i: [t for t in own if t != 8] for i, own in views.items()}, range(1, 8), 5)
    third = layers.advance(snapshot, root)
    whole = refresh(snapshot, whole)
    _same(spark, third, whole)

    # Nothing changes: an empty layer, and too many layers are folded.
    monkeypatch.setattr(layers, "FOLD_LAYERS", 2)
    fourth = layers.advance(snapshot, root)
    assert fourth.number == 3 and len(fourth.layers) == 1
    _same(spark, fourth, whole)


def test_reading_layers_exchanges_owners_only(spark, make, tmp_path):
    tables = range(1, 9)
    procs = {i: (f"SELECT a FROM dbo.T{i % 8 + 1}", 2) for i in range(100, 160)}
    root = str(tmp_path / "state")
    layers.advance(_snapshot(make, procs, {}, tables, 2), root)
    version = layers.advance(_snapshot(make, {**procs, 101: ("SELECT a FROM dbo.T1", 5)}, {}, tables, 5), root)
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = _plan(layers.read_rows(spark, version, "edges"))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert "SortMergeJoin" in plan and "Exchange" not in plan
