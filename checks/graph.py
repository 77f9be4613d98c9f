"""Graph construction."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.base import MODEL_SQL, NODES_CTE, check, joined, with_ctes
from threadline.functions import names
from threadline.operators import graph

HALVES = """halves AS (SELECT target_id AS id, 'in' AS direction, source_id AS other FROM lineage_edges UNION ALL SELECT source_id, 'out', target_id FROM lineage_edges)"""
NEIGHBOURS = """neighbours AS (SELECT id, direction, other, id <> other AND count(*) OVER (PARTITION BY id, other) = 2 AS two_way FROM (SELECT DISTINCT * FROM halves))"""
COUNTED = """counted AS (SELECT id, count(*) FILTER (direction = 'in') AS input_count, count(*) FILTER (direction = 'out') AS output_count,
  count(*) FILTER (direction = 'in' AND two_way) AS two_way_count FROM neighbours GROUP BY 1)"""
LISTED = """listed AS (SELECT id, coalesce(string_agg(CAST(other AS VARCHAR), ',' ORDER BY CAST(other AS VARCHAR)) FILTER (direction = 'in'), '') AS inputs,
  coalesce(string_agg(CAST(other AS VARCHAR), ',' ORDER BY CAST(other AS VARCHAR)) FILTER (direction = 'out'), '') AS outputs,
  coalesce(string_agg(CAST(other AS VARCHAR), ',' ORDER BY CAST(other AS VARCHAR)) FILTER (direction = 'in' AND two_way), '') AS bidirectional_with FROM neighbours GROUP BY 1)"""
# Parts that the lists of every node are cut into where lists are asked for.
PARTS = 16


def _text_list(name: str):
    return joined(F.sort_array(F.transform(F.col(name), lambda x: x.cast("string")))).alias(name)


@check(
    "D1_view_edges",
    with_ctes(
        "objects dependencies",
        """SELECT DISTINCT d.referenced_object_id AS source_id, d.referencing_object_id AS target_id, d.referencing_object_id AS owner_id, 'dependency' AS edge_type
        FROM dependencies d JOIN objects o ON o.object_id = d.referencing_object_id AND o.object_type = 'View' WHERE d.referenced_object_id IS NOT NULL""",
    ),
)
def view_edges(c):
    return graph.view_edges(c.dependencies, c.objects)


@check(
    "D2_native_edges",
    with_ctes("dependencies", "SELECT referencing_object_id, referenced_object_id, 'dmv' AS source FROM dependencies WHERE referenced_object_id IS NOT NULL"),
)
def native_edges(c):
    return graph.native_edges(c.dependencies)


@check("D4_D8_neighbours", with_ctes("lineage_edges", "SELECT id, direction, other, two_way FROM neighbours", HALVES, NEIGHBOURS))
def neighbours(c):
    return graph.neighbours(c.edges)


@check(
    "D4_D8_adjacency",
    with_ctes(
        "lineage_edges",
        """SELECT id, len(string_split(inputs, ',')) * CAST(inputs <> '' AS INTEGER) AS inputs, len(string_split(outputs, ',')) * CAST(outputs <> '' AS INTEGER) AS outputs,
        len(string_split(bidirectional_with, ',')) * CAST(bidirectional_with <> '' AS INTEGER) AS bidirectional_with, true AS sorted FROM listed""",
        HALVES,
        NEIGHBOURS,
        LISTED,
    ),
)
def adjacency(c):
    lists = graph.adjacency(c.edges, PARTS)
    in_order = F.lit(True)
    for name in ("inputs", "outputs", "bidirectional_with"):
        in_order = in_order & (F.array_sort(name) == F.col(name))
    size = lambda name: F.sum(F.size(name)).alias(name)
    return lists.groupBy("id").agg(size("inputs"), size("outputs"), size("bidirectional_with"), F.bool_and(in_order).alias("sorted"))


@check(
    "D5_D6_metadata_rows",
    with_ctes(
        "objects lineage_edges",
        """SELECT o.object_id, coalesce(n.input_count, 0) AS input_count, coalesce(n.output_count, 0) AS output_count, 'metadata' AS primary_source
        FROM objects o LEFT JOIN counted n ON n.id = o.object_id WHERE o.object_type IN ('Table', 'View')""",
        HALVES,
        NEIGHBOURS,
        COUNTED,
    ),
)
def metadata_rows(c):
    return graph.metadata_rows(c.objects, c.edges)


@check(
    "D7_bidirectional_pairs",
    with_ctes(
        "lineage_edges",
        """SELECT DISTINCT a.source_id AS node_a, a.target_id AS node_b FROM lineage_edges a
        JOIN lineage_edges b ON b.source_id = a.target_id AND b.target_id = a.source_id WHERE a.source_id < a.target_id""",
    ),
)
def bidirectional_pairs(c):
    return graph.bidirectional_pairs(c.edges)


@check(
    "D9_build_nodes",
    with_ctes(
        "objects lineage_edges lineage_metadata",
        """SELECT o.object_id AS id, o.object_name AS name, o.schema_name AS "schema", o.object_type,
          coalesce(n.input_count, 0) AS input_count, coalesce(n.output_count, 0) AS output_count, coalesce(n.two_way_count, 0) AS two_way_count,
          CASE WHEN m.object_id IS NOT NULL THEN coalesce(m.primary_source, 'unknown') WHEN o.object_type = 'Stored Procedure' THEN 'unparsed' ELSE 'metadata' END AS primary_source,
          CASE WHEN m.object_id IS NOT NULL THEN coalesce(m.parse_success, true) WHEN o.object_type = 'Stored Procedure' THEN NULL ELSE true END AS parse_success,
          m.parse_failure_reason, coalesce(m.expected_count, -1) AS expected_count, coalesce(m.found_count, -1) AS found_count
        FROM objects o LEFT JOIN counted n ON n.id = o.object_id
        LEFT JOIN lineage_metadata m ON m.object_id = o.object_id WHERE o.object_type IN ('Table', 'View', 'Stored Procedure')""",
        HALVES,
        NEIGHBOURS,
        COUNTED,
    ),
)
def build_nodes(c):
    nodes = graph.build_nodes(c.objects, c.edges, c.metadata)
    return nodes.select(
        "id",
        "name",
        "schema",
        "object_type",
        "input_count",
        "output_count",
        "two_way_count",
        "provenance.primary_source",
        "provenance.parse_success",
        "provenance.parse_failure_reason",
        F.coalesce("provenance.expected_count", F.lit(-1)).alias("expected_count"),
        F.coalesce("provenance.found_count", F.lit(-1)).alias("found_count"),
    )


DESCRIPTION_SQL = """CASE WHEN o.object_type <> 'Stored Procedure' THEN 'Parse Success: True' WHEN m.object_id IS NULL THEN 'Not parsed'
  WHEN m.parse_success THEN '✅ Parse Success: True' ELSE concat_ws(' ', '❌ Parse Failed',
  CASE WHEN m.parse_failure_reason <> '' THEN '| ' || CASE WHEN length(m.parse_failure_reason) > 80 THEN substr(m.parse_failure_reason, 1, 77) || '...' ELSE m.parse_failure_reason END END,
  CASE WHEN m.expected_count > 0 AND m.expected_count > m.found_count THEN '| ' || (m.expected_count - m.found_count) || ' tables missing - add @LINEAGE hints' END) END"""


@check(
    "D10_D13_frontend_nodes",
    with_ctes(
        "objects lineage_edges lineage_metadata",
        f"""SELECT CAST(o.object_id AS VARCHAR) AS id, o.object_name AS name, o.schema_name AS "schema", o.object_type,
          {DESCRIPTION_SQL} AS description, {MODEL_SQL.replace('object_', 'o.object_')} AS data_model_type,
          CASE WHEN o.object_type = 'Stored Procedure' THEN 'square' ELSE 'circle' END AS node_symbol,
          coalesce(i.refs, 0) AS input_count, coalesce(u.refs, 0) AS output_count
        FROM objects o LEFT JOIN lineage_metadata m ON m.object_id = o.object_id
        LEFT JOIN (SELECT target_id AS id, count(DISTINCT source_id) AS refs FROM lineage_edges WHERE source_id IN (SELECT id FROM nodes) GROUP BY 1) i ON i.id = o.object_id
        LEFT JOIN (SELECT source_id AS id, count(DISTINCT target_id) AS refs FROM lineage_edges WHERE target_id IN (SELECT id FROM nodes) GROUP BY 1) u ON u.id = o.object_id
        WHERE o.object_type IN ('Table', 'View', 'Stored Procedure')""",
        NODES_CTE,
    ),
)
def frontend_nodes(c):
    nodes = graph.frontend_nodes(c.objects, c.edges, c.metadata)
    return nodes.select(
        "id", "name", "schema", "object_type", "description", "data_model_type", "node_symbol", "input_count", "output_count"
    )


@check(
    "D10_frontend_neighbours",
    with_ctes(
        "objects lineage_edges",
        """SELECT CAST(id AS VARCHAR) AS id, direction, CAST(other AS VARCHAR) AS other, two_way FROM neighbours
        WHERE id IN (SELECT id FROM nodes) AND other IN (SELECT id FROM nodes)""",
        NODES_CTE,
        HALVES,
        NEIGHBOURS,
    ),
)
def frontend_neighbours(c):
    return graph.frontend_neighbours(c.objects, c.edges)


@check(
    "D11_node_symbol",
    with_ctes(
        "objects",
        "SELECT object_id, CASE object_type WHEN 'Function' THEN 'diamond' WHEN 'Stored Procedure' THEN 'square' ELSE 'circle' END AS node_symbol FROM objects",
    ),
)
def node_symbol(c):
    return c.objects.select("object_id", names.node_symbol(F.col("object_type")).alias("node_symbol"))


@check("D12_classify_model", with_ctes("objects", f"SELECT object_id, {MODEL_SQL} AS data_model_type FROM objects"))
def classify_model(c):
    return c.objects.select("object_id", names.classify_model(F.col("object_name"), F.col("object_type")).alias("data_model_type"))


@check(
    "D14_degrees",
    with_ctes(
        "lineage_edges",
        "SELECT id, count(*) FILTER (direction = 'in') AS input_count, count(*) FILTER (direction = 'out') AS output_count FROM halves GROUP BY id",
        HALVES,
    ),
)
def degrees(c):
    return graph.degrees(c.edges)


@check(
    "D15_edges_from_nodes",
    with_ctes(
        "objects lineage_edges",
        "SELECT source_id, target_id FROM lineage_edges WHERE source_id IN (SELECT id FROM nodes) AND target_id IN (SELECT id FROM nodes)",
        NODES_CTE,
    ),
)
def edges_from_nodes(c):
    return graph.edges_from_nodes(graph.build_nodes(c.objects, c.edges, c.metadata), graph.neighbours(c.edges))


@check(
    "D16_facets",
    with_ctes(
        "objects",
        """SELECT DISTINCT 'schema' AS facet, "schema" AS value FROM nodes UNION SELECT 'object_type', object_type FROM nodes
        UNION SELECT 'data_model_type', data_model_type FROM nodes""",
        NODES_CTE,
    ),
)
def facets(c):
    return graph.facets(c.nodes)


@check(
    "D17_schema_layer",
    with_ctes(
        "objects",
        """SELECT object_id, CASE WHEN regexp_matches(lower(schema_name), 'staging|stg|raw|landing|source|bronze') THEN 'staging'
          WHEN regexp_matches(lower(schema_name), 'transformation|transform|tfm|processed|intermediate|silver') THEN 'transformation'
          WHEN regexp_matches(lower(schema_name), 'consumption|cons|mart|final|presentation|pub|published|gold') THEN 'consumption' END AS layer FROM objects""",
    ),
)
def schema_layer(c):
    return c.objects.select("object_id", names.schema_layer(F.col("schema_name")).alias("layer"))


@check(
    "D18_schema_department",
    with_ctes(
        "objects",
        """SELECT object_id, CASE WHEN schema_name = 'dbo' THEN 'dbo' ELSE lower(replace(regexp_replace(schema_name, '^(STAGING|TRANSFORMATION|CONSUMPTION)_', ''), '_', '')) END AS department FROM objects""",
    ),
)
def schema_department(c):
    return c.objects.select("object_id", names.schema_department(F.col("schema_name")).alias("department"))


