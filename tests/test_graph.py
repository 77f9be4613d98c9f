"""Hand-made graphs: cycles, blocked nodes, hubs, loops."""

from __future__ import annotations

from collections import deque

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from threadline.operators import filters, graph, metrics, state, traverse
from threadline.operators.traverse import TraceRequest
from threadline.sources import nodes_json

NODE = "id long, name string, schema string, object_type string, data_model_type string"


def _nodes(make, ids, **schemas):
    return make(NODE, *[(i, f"n{i}", schemas.get(f"n{i}", "a"), "Table", "Other") for i in ids])


def _edges(make, *pairs):
    return make("source_id long, target_id long, edge_type string", *[(*p, "dependency") for p in pairs])


def _set(df, *cols):
    return {tuple(r[c] for c in cols) for r in df.collect()}


def test_cycle_ends_with_minimal_depths(make):
    found = traverse.trace(_nodes(make, [1, 2, 3]), _edges(make, (1, 2), (2, 3), (3, 1)), TraceRequest(1, upstream=None, downstream=None))
    assert _set(found, "id", "direction", "depth") == {
        (1, "upstream", 0), (3, "upstream", 1), (2, "upstream", 2), (1, "downstream", 0), (2, "downstream", 1), (3, "downstream", 2),
    }
    assert found.count() == 6


def test_filtered_node_blocks_and_filtered_start_is_empty(make):
    nodes = _nodes(make, [1, 2, 3], n2="hidden", n3="a")
    edges = _edges(make, (1, 2), (2, 3))
    assert _set(traverse.trace(nodes, edges, TraceRequest(1, schemas=["a"])), "id") == {(1,)}
    assert traverse.trace(nodes, edges, TraceRequest(2, schemas=["a"])).count() == 0
    assert _set(traverse.trace(nodes, edges, TraceRequest(1, exclude=["N3"])), "id") == {(1,), (2,)}


def test_levels_are_monotone(make):
    edges = _edges(make, *[(i, i + 1) for i in range(1, 6)])
    nodes = _nodes(make, range(1, 7))
    sizes = [traverse.trace(nodes, edges, TraceRequest(1, upstream=0, downstream=n)).where("direction = 'downstream'").count() for n in (0, 2, 4)]
    assert sizes == [1, 3, 5]


def test_paths(make):
    nodes = _nodes(make, range(1, 7))
    edges = _edges(make, (1, 2), (2, 4), (1, 3), (3, 4), (2, 1), (4, 5), (1, 6))
    request = TraceRequest(1, 4)
    assert _set(traverse.path_nodes(nodes, edges, request), "id") == {(1,), (2,), (3,), (4,)}
    assert {tuple(r[0]) for r in traverse.paths(nodes, edges, request, 3).collect()} == {(1, 2, 4), (1, 3, 4)}
    assert {tuple(r[0]) for r in traverse.paths(nodes, edges, TraceRequest(4, 1), 2, "upstream").collect()} == {(4, 2, 1), (4, 3, 1)}
    assert [tuple(r[0]) for r in traverse.paths(nodes, edges, TraceRequest(1, 1), 2).collect()] == [(1,)]
    assert traverse.path_nodes(nodes, edges, TraceRequest(5, 1)).count() == 0


def test_focus_reaches_only_its_component(make):
    nodes = _nodes(make, range(1, 7), n1="f", n5="g")
    edges = _edges(make, (2, 1), (2, 3), (4, 6))
    assert _set(traverse.reachable_from_focus(nodes, edges, ["f", "g"]), "id") == {(1,), (2,), (3,), (5,)}
    assert traverse.reachable_from_focus(nodes, edges, []).count() == 6


def test_random_graphs_match_plain_search(make):
    @settings(max_examples=3, deadline=None, suppress_health_check=list(HealthCheck))
    @given(st.sets(st.tuples(st.integers(1, 9), st.integers(1, 9)), min_size=5, max_size=18))
    def run(pairs):
        found = traverse.trace(_nodes(make, range(1, 10)), _edges(make, *pairs), TraceRequest(1, upstream=0, downstream=None))
        depth, queue = {1: 0}, deque([1])
        while queue:
            at = queue.popleft()
            for source, target in pairs:
                if source == at and target not in depth:
                    depth[target] = depth[at] + 1
                    queue.append(target)
        assert _set(found.where("direction = 'downstream'"), "id", "depth") == set(depth.items())

    run()


def test_lists_are_cut_alike_and_whole(make):
    pairs = [(0, i) for i in range(1, 501)] + [(i, 0) for i in range(1, 501, 5)] + [(0, 0)]
    edges = _edges(make, *pairs)
    lists = graph.adjacency(edges, parts=10).where("id = 0").collect()
    assert len(lists) == 10
    assert max(len(r["outputs"]) for r in lists) < 120
    assert sorted(x for r in lists for x in r["outputs"]) == sorted([*range(1, 501), 0])
    assert sorted(x for r in lists for x in r["bidirectional_with"]) == list(range(1, 501, 5))
    whole = graph.adjacency(edges, parts=1).where("id = 0").collect()
    assert [len(r["outputs"]) for r in whole] == [501]


def test_a_hub_survives_export_and_import(make, spark, tmp_path):
    edges = _edges(make, *[(0, i) for i in range(1, 51)], *[(i, 0) for i in range(40, 60)])
    nodes = _nodes(make, range(60)).withColumn("id", F.col("id").cast("string"))
    text = [F.col(c).cast("string").alias(c) for c in ("id", "other")]
    found = graph.neighbours(edges).select(text[0], "direction", text[1], "two_way")
    for parts in (1, 7):
        nodes_json.write_nodes_json(nodes, found, f"{tmp_path}/{parts}", parts=parts)
        back, links, _ = nodes_json.import_nodes(nodes_json.read_nodes_json(spark, f"{tmp_path}/{parts}"))
        assert back.count() == 60
        assert _set(links, "id", "direction", "other") == _set(found, "id", "direction", "other")


def test_path_nodes_stop_at_start_and_end(make):
    nodes, edges = _nodes(make, [1, 2, 4, 5]), _edges(make, (1, 4), (4, 5), (5, 4), (1, 2), (2, 1))
    assert _set(traverse.path_nodes(nodes, edges, TraceRequest(1, 4)), "id") == {(1,), (4,)}


def test_self_loop_is_no_pair(make):
    edges = _edges(make, (1, 1), (1, 2), (2, 1), (3, 1))
    assert _set(graph.bidirectional_pairs(edges), "node_a", "node_b") == {(1, 2)}
    shown = filters.visible_edges(_nodes(make, [1, 2, 3]), edges)
    assert _set(shown, "source_id", "target_id", "is_bidirectional") == {(1, 2, True), (3, 1, False), (1, 1, False)}


def test_must_show_nodes_are_never_cut(make):
    nodes, edges = _nodes(make, range(1, 8)), _edges(make, (1, 2), (3, 1))
    chosen = make("id long", (1,))
    assert _set(filters.top_nodes(nodes, edges, chosen, k=2), "id") == {(1,), (2,), (3,)}
    assert _set(filters.top_nodes(nodes, edges, chosen, k=5), "id") == {(1,), (2,), (3,), (4,), (5,)}


def test_short_terms_suggest_nothing(make):
    nodes = _nodes(make, [1, 2])
    assert filters.suggest(nodes, " n1 ").count() == 0
    assert filters.suggest(nodes, "n1", min_chars=1).count() == 1


def test_merge_rules(make):
    fields = "object_id long, last_parsed_modify_date timestamp_ntz, primary_source string, parse_success boolean"
    old = make(fields, (1, None, "dmv", True), (2, None, "dmv", False), (3, None, "dmv", True), (4, None, "dmv", None))
    new = make(fields, (1, None, "parser", False), (2, None, "log", True), (3, None, "log", True), (5, None, "log", False))
    assert _set(state.merge_metadata(old, new), "object_id", "primary_source", "parse_success") == {
        (1, "parser", False), (2, "log", True), (3, "dmv", True), (4, "dmv", None), (5, "log", False),
    }
    edge = "source_id long, target_id long, owner_id long, edge_type string"
    kept = state.merge_edges(
        make(edge, (1, 2, 2, "dependency"), (2, 3, 9, "dependency")), make(edge, (4, 2, 2, "dependency")), make("owner_id long", (2,))
    )
    assert _set(kept, "source_id", "target_id") == {(2, 3), (4, 2)}


def test_metrics_of_an_empty_catalog(make):
    objects = make("object_id long, schema_name string, object_name string, object_type string, modify_date timestamp_ntz")
    metadata = make("object_id long, parse_success boolean, primary_source string")
    dependencies = make("referencing_object_id long, referenced_object_id long")
    rows = metrics.parse_metrics(objects, metadata).collect()
    assert [(r["scope"], r["total"], r["parse_rate"]) for r in rows] in ([], [("ALL", 0, 0.0)])
    assert metrics.dependency_metrics(dependencies, objects).first()["total"] == 0
    assert metrics.gaps(objects, metadata, _edges(make)).count() == 0
