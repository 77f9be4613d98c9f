"""Work that must not grow faster than its input: lists in parts, tables of the catalog, patterns."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from threadline.operators import extract, graph, resolve
from threadline.operators.rules import DEFAULT_RULES
from threadline.plans import derived_catalog
from threadline.sources import nodes_json


def test_only_long_lists_are_cut_into_parts(spark, make, tmp_path):
    """a node of few neighbours is one row, whatever the number of parts."""
    found = make("id string, direction string, other string, two_way boolean", *[("hub", "out", f"n{i}", False) for i in range(50)], *[(f"n{i}", "in", "hub", False) for i in range(50)])
    nodes = make("id string, name string, schema string, object_type string", ("hub", "h", "dbo", "Table"), *[(f"n{i}", "n", "dbo", "Table") for i in range(50)], ("lone", "l", "dbo", "Table"))
    rows = graph.with_lists(nodes, found, 8, whole=10)
    counts = {r["id"]: (r["n"], r["parts"]) for r in rows.groupBy("id").agg(F.count("*").alias("n"), F.max("parts").alias("parts")).collect()}
    assert counts.pop("hub") == (8, 8)
    assert set(counts.values()) == {(1, 1)}
    assert graph.with_lists(nodes, found, 16).count() == 52  # no list is long: no node is cut
    nodes_json.write_nodes_json(nodes, found, str(tmp_path / "nodes"), parts=16)
    back, links, _ = nodes_json.import_nodes(nodes_json.read_nodes_json(spark, str(tmp_path / "nodes")))
    assert back.count() == 52
    assert {tuple(r) for r in links.collect()} == {tuple(r) for r in found.collect()}


def test_a_derived_table_writes_only_what_it_reads(spark, data_dir):
    """A query does not pay for tables that it does not read."""
    folder = data_dir.rstrip("/") + "/."  # a key of its own
    derived_catalog.load_table(spark, folder, "definitions")
    written = derived_catalog._written[(spark.sparkContext.applicationId, folder)]
    assert set(written) == {"proc_facts", "definitions"}
    derived_catalog.load_table(spark, folder, "lineage_edges")
    assert set(written) == {"proc_facts", "definitions", "objects", "dependencies", "lineage_edges"}


TEXTS = (
    "SELECT a FROM t -- FROM x\n JOIN [a b].[select] s ON 1 = 1 /* x /* y */ FROM z */",
    "update top (5) dbo.T set v = 'FROM k -- no' OUTPUT deleted.* INTO dbo.U; exec @rc = dbo.P; EXECUTE Q",
    "WITH c AS (SELECT 1), d as (SELECT 2) SELECT * INTO n FROM c, d, \"from\" f WHERE x = 'it''s'",
    "DECLARE @v TABLE (a int); INSERT @v SELECT * FROM #t cross apply dbo.f(1) OUTER\n\tAPPLY g(2)",
    "delete\tfrom dbo.A; TRUNCATE  TABLE b; create table q as select * from w; MERGE INTO m USING u ON 1=1",
    "/* never closed FROM a", "'", "--", "", None, "\x1b[31mSELECT x FROM y\x1b[0m", "ſELECT a FROM b; SELECT a İNTO c FROM K",
)


def test_passing_over_texts_quickly_finds_the_same(make):
    """What ``starts`` and ``needs`` skip holds no match."""
    plain = tuple(replace(r, starts="", needs=()) for r in DEFAULT_RULES)
    texts = make("object_id long, definition string", *enumerate(TEXTS))
    rows = lambda rules: sorted(map(tuple, extract.raw_references(texts, rules).collect()))
    assert rows(DEFAULT_RULES) == rows(plain)
    assert len(rows(plain)) > 20
    cleaned = lambda rules: [r[0] for r in texts.select("object_id", extract.clean_text(F.col("definition"), rules).alias("c")).orderBy("object_id").select("c").collect()]
    assert cleaned(DEFAULT_RULES) == cleaned(plain)


def test_reasons_clean_a_text_once(make):
    """The cleaned text is a column, not a part of every pattern."""
    objects = make("object_id long, schema_name string, object_name string, object_type string, modify_date timestamp", (1, "dbo", "p", "Stored Procedure", None))
    texts = make("object_id long, definition string", (1, "EXEC(@sql) -- WHILE 1=1"))
    none = make("object_id long, role string, name string, ref_id long, from_text boolean, from_hint boolean")
    parsed = resolve.parse_definitions(objects, texts, resolved=none, reasons=True)
    assert parsed.first()["failure_reason"].startswith(resolve.REASON_EXEC_VARIABLE + " | →")
    plan = parsed._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("--[^") == 1


def test_an_edge_is_exchanged_once_for_its_neighbours(make):
    """One row for a pair of ids is dealt, not one for each end, and lists only behind their exchange."""
    edges = make("source_id long, target_id long", (1, 2), (2, 1), (1, 2), (3, 1), (4, 4), (None, 5), (5, None), (6, None), (None, None))
    found = graph.neighbours(edges)
    assert sorted(map(repr, map(tuple, found.collect()))) == sorted(
        map(
            repr,
            [
                (1, "in", 2, True), (1, "out", 2, True), (2, "in", 1, True), (2, "out", 1, True), (3, "out", 1, False), (1, "in", 3, False),
                (4, "in", 4, False), (4, "out", 4, False), (None, "in", None, None), (None, "out", None, None), (6, "out", None, False), (None, "in", 6, False),
                (5, "in", None, None), (5, "out", None, None), (None, "in", 5, None), (None, "out", 5, None),
            ],
        )
    )
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Generate explode") < plan.index("Exchange hashpartitioning")  # behind the exchange: printed above it
    lists = graph.adjacency(edges, 1)
    assert {r["id"]: (r["inputs"], r["outputs"], r["bidirectional_with"]) for r in lists.where("id < 5").collect()} == {
        1: ([2, 3], [2], [2]), 2: ([1], [1], [1]), 3: ([], [1], []), 4: ([4], [4], []),
    }
    plan = lists._jdf.queryExecution().executedPlan().toString()
    assert plan.index("partial_collect_list") < plan.index("Exchange hashpartitioning(id")
