"""Scans, sources and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.base import Catalog, check, with_ctes
from threadline.functions import names
from threadline.operators import graph
from threadline.session import scratch_dir
from threadline.sources import contracts, nodes_json, snapshot

SNAPSHOT = ("objects", "dependencies", "definitions", "query_logs", "table_columns")


def _snapshot(c: Catalog):
    tables = {k: getattr(c, k) for k in SNAPSHOT}
    tables["query_logs"] = tables["query_logs"].select("command_text")
    return tables


@check(
    "A1_row_counts",
    with_ctes(
        "objects dependencies definitions query_logs table_columns lineage_metadata lineage_edges",
        " UNION ALL ".join(
            f"SELECT '{t}' AS table_name, count(*) AS row_count FROM {t}" for t in (*SNAPSHOT, "lineage_metadata", "lineage_edges")
        ),
    ),
)
def row_counts(c):
    return snapshot.row_counts({**_snapshot(c), "lineage_metadata": c.metadata, "lineage_edges": c.edges})


@check(
    "A2_A17_snapshot_round_trip",
    with_ctes(
        "objects dependencies definitions query_logs table_columns",
        " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS row_count FROM {t}" for t in SNAPSHOT),
    ),
)
def snapshot_round_trip(c):
    folder = scratch_dir(c.spark, "snapshot")
    snapshot.write_snapshot(_snapshot(c), folder)
    paths, _ = snapshot.detect_snapshot(c.spark, folder)
    return snapshot.row_counts(snapshot.load_snapshot(c.spark, paths))


@check(
    "A4_attach_object_id",
    with_ctes(
        "objects table_columns",
        """SELECT c.schema_name, c.table_name, c.column_name, o.object_id AS correct_object_id FROM table_columns c
        LEFT JOIN objects o ON o.schema_name = c.schema_name AND o.object_name = c.table_name AND o.object_type = 'Table'""",
    ),
)
def attach_object_id(c):
    return snapshot.attach_object_id(c.table_columns, c.objects).select("schema_name", "table_name", "column_name", "correct_object_id")


CODE_SQL = """CASE object_type WHEN 'Table' THEN 'U ' WHEN 'View' THEN 'V ' WHEN 'Stored Procedure' THEN 'P '
  ELSE CASE (object_id // 10) % 6 WHEN 0 THEN 'FN' WHEN 1 THEN 'IF' WHEN 2 THEN 'TF' WHEN 3 THEN 'FS' WHEN 4 THEN 'FT' ELSE 'X' END END"""


@check(
    "A6_object_type_name",
    with_ctes(
        "objects",
        f"""SELECT object_id, trim({CODE_SQL}) AS type_code, CASE WHEN {CODE_SQL} = 'X' THEN 'Other' ELSE object_type END AS type_name,
        CASE WHEN {CODE_SQL} = 'X' THEN 'Other' ELSE object_type || 's' END AS label FROM objects""",
    ),
)
def object_type_name(c):
    n = (F.floor(F.col("object_id") / 10) % 6).cast("int")
    function_code = F.element_at(F.array(*[F.lit(x) for x in ("FN", "IF", "TF", "FS", "FT", "X")]), n + 1)
    code = (
        F.when(F.col("object_type") == "Table", "U ")
        .when(F.col("object_type") == "View", "V ")
        .when(F.col("object_type") == "Stored Procedure", "P ")
        .otherwise(function_code)
    )
    name = names.object_type_name(code)
    return c.objects.select("object_id", F.trim(code).alias("type_code"), name.alias("type_name"), names.plural_type_name(name).alias("label"))


@check(
    "A7_table_profile",
    with_ctes(
        "objects table_columns",
        """SELECT o.object_id, o.schema_name, o.object_name, count(DISTINCT c.column_id) AS column_count,
          string_agg(c.column_name || ':' || c.data_type, ', ' ORDER BY c.column_id) AS columns
        FROM objects o LEFT JOIN table_columns c ON c.schema_name = o.schema_name AND c.table_name = o.object_name
        WHERE o.object_type = 'Table' GROUP BY ALL""",
    ),
)
def table_profile(c):
    return snapshot.table_profile(c.objects, snapshot.attach_object_id(c.table_columns, c.objects))


@check(
    "A8_recent_requests",
    with_ctes(
        "query_logs",
        """SELECT event_id, session_id, command, command_text FROM query_logs
        WHERE session_id > 50 AND command NOT IN ('error', 'signup') AND command_text IS NOT NULL
        ORDER BY start_time DESC, event_id LIMIT 5000""",
    ),
)
def recent_requests(c):
    return snapshot.recent_requests(c.query_logs, idle=("error", "signup"), tie_break=["event_id"]).select(
        "event_id", "session_id", "command", "command_text"
    )


@check(
    "A9_exclude_schemas",
    with_ctes("objects", "SELECT object_id, schema_name, object_name FROM objects WHERE lower(schema_name) NOT IN ('dbo', 'staging_hr')"),
)
def exclude_schemas(c):
    return snapshot.exclude_schemas(c.objects, ("DBO", "Staging_HR")).select("object_id", "schema_name", "object_name")


@check(
    "A10_native_dependencies",
    with_ctes(
        "objects dependencies",
        """SELECT a.object_id AS referencing_object_id, coalesce(d.referenced_object_id, -1) AS referenced_object_id,
          a.schema_name AS referencing_schema, a.object_name AS referencing_object, a.object_type AS referencing_type,
          b.schema_name AS referenced_schema, b.object_name AS referenced_object, b.object_type AS referenced_type
        FROM dependencies d JOIN objects a ON a.object_id = d.referencing_object_id
        LEFT JOIN objects b ON b.object_id = d.referenced_object_id""",
    ),
)
def native_dependencies(c):
    return snapshot.native_dependencies(c.dependencies, c.objects).withColumn(
        "referenced_object_id", F.coalesce("referenced_object_id", F.lit(-1))
    )


# Raw nodes as an import may bring them: functions keep their type, tables of one schema lack
# it, lists come from one side only.
RAW_NODES = """raw_nodes AS (
  SELECT CAST(o.object_id AS VARCHAR) AS id, CASE WHEN o.object_type = 'View' THEN NULL ELSE o.object_name END AS name,
         CASE WHEN o.schema_name = 'STAGING_MACHINERY' THEN NULL ELSE o.schema_name END AS "schema", o.object_type FROM objects o),
raw_refs AS (
  SELECT DISTINCT CAST(target_id AS VARCHAR) AS id, 'input' AS direction, CAST(source_id AS VARCHAR) AS ref FROM lineage_edges WHERE source_id % 10 <> 1
  UNION SELECT CAST(source_id AS VARCHAR), 'output', CAST(target_id AS VARCHAR) FROM lineage_edges WHERE source_id % 10 = 1
  UNION SELECT CAST(target_id AS VARCHAR), 'input', CAST(source_id AS VARCHAR) FROM lineage_edges WHERE source_id % 10 = 1 AND target_id % 10 = 1
  UNION SELECT CAST(object_id AS VARCHAR), 'input', 'gone-' || CAST(object_id AS VARCHAR) FROM lineage_metadata WHERE NOT parse_success)"""


def _raw_nodes(c: Catalog):
    """Node rows as an import reads them, the lists of hubs cut into 16 parts."""
    kind = F.col("source_id") % 10
    text = lambda name: F.col(name).cast("string")
    inputs = c.edges.where((kind != 1) | (F.col("target_id") % 10 == 1)).select(
        text("target_id").alias("id"), F.lit("in").alias("direction"), text("source_id").alias("other")
    )
    outputs = c.edges.where(kind == 1).select(text("source_id").alias("id"), F.lit("out").alias("direction"), text("target_id").alias("other"))
    gone = c.metadata.where("NOT parse_success").select(
        text("object_id").alias("id"), F.lit("in").alias("direction"), F.concat(F.lit("gone-"), text("object_id")).alias("other")
    )
    refs = inputs.union(outputs).union(gone).distinct().withColumn("two_way", F.lit(False))
    nodes = c.objects.select(
        text("object_id").alias("id"),
        F.when(F.col("object_type") != "View", F.col("object_name")).alias("name"),
        F.when(F.col("schema_name") != "STAGING_MACHINERY", F.col("schema_name")).alias("schema"),
        "object_type",
    )
    return graph.with_lists(nodes, refs, 16)


@check(
    "A11_A19_nodes_json_round_trip",
    with_ctes(
        "objects lineage_edges",
        """SELECT CAST(object_id AS VARCHAR) AS id, object_name AS name, schema_name AS "schema", object_type,
          (SELECT count(*) FROM lineage_edges e WHERE e.target_id = o.object_id AND e.source_id IN (SELECT object_id FROM objects WHERE object_type <> 'Function')) AS input_count,
          (SELECT count(*) FROM lineage_edges e WHERE e.source_id = o.object_id) AS output_count
        FROM objects o WHERE object_type <> 'Function'""",
    ),
)
def nodes_json_round_trip(c):
    folder = scratch_dir(c.spark, "nodes-json")
    _export(c, folder)
    nodes, found, _ = nodes_json.import_nodes(nodes_json.read_nodes_json(c.spark, folder))
    way = F.col("direction")
    counts = found.groupBy("id").agg(F.count_if(way == "in").alias("input_count"), F.count_if(way == "out").alias("output_count"))
    return nodes.join(counts, "id", "left").select(
        "id", "name", "schema", "object_type", *[F.coalesce(n, F.lit(0)).alias(n) for n in ("input_count", "output_count")]
    )


def _export(c: Catalog, folder: str) -> None:
    """All nodes, those of hubs in 16 parts, so that no list of a hub is in one row."""
    nodes_json.write_nodes_json(
        graph.frontend_nodes(c.objects, c.edges, c.metadata), graph.frontend_neighbours(c.objects, c.edges), folder, parts=16
    )


@check(
    "A12_dedupe_last",
    """SELECT CAST(user_id AS VARCHAR) AS id, max(ts) AS ts, arg_max(event_type, event_id) AS event_type, max(event_id) AS pos
    FROM events GROUP BY user_id""",
)
def dedupe_last(c):
    rows = c.query_logs.select(
        F.col("session_id").cast("string").alias("id"), F.col("event_id").alias("pos"), F.col("start_time").alias("ts"), F.col("command").alias("event_type")
    )
    return nodes_json.dedupe_last(rows).select("id", "ts", "event_type", "pos")


@check(
    "A13_validate_nodes",
    with_ctes(
        "objects lineage_edges lineage_metadata",
        """SELECT id, 'error' AS level, 'missing required fields: ' || concat_ws(', ', CASE WHEN name IS NULL THEN 'name' END,
          CASE WHEN "schema" IS NULL THEN 'schema' END) AS message FROM raw_nodes WHERE name IS NULL OR "schema" IS NULL
        UNION ALL SELECT id, 'error', 'invalid object_type: ' || object_type FROM raw_nodes WHERE object_type = 'Function'""",
        RAW_NODES,
    ),
)
def validate_nodes(c):
    return nodes_json.validate_nodes(_raw_nodes(c)).distinct()


@check(
    "A11_A16_import_nodes",
    with_ctes(
        "objects lineage_edges lineage_metadata",
        """SELECT r.id, r.name, r."schema", r.object_type, count(s.source_id) FILTER (s.target_id = r.id) AS input_count, count(s.source_id) FILTER (s.source_id = r.id) AS output_count
        FROM raw_nodes r LEFT JOIN (SELECT source_id, target_id, target_id AS at FROM sides UNION ALL SELECT source_id, target_id, source_id FROM sides WHERE source_id <> target_id) s ON s.at = r.id
        GROUP BY 1, 2, 3, 4""",
        RAW_NODES,
        """sides AS (SELECT DISTINCT CASE direction WHEN 'input' THEN ref ELSE id END AS source_id, CASE direction WHEN 'input' THEN id ELSE ref END AS target_id
        FROM raw_refs WHERE ref IN (SELECT id FROM raw_nodes) AND id IN (SELECT id FROM raw_nodes))""",
    ),
)
def import_nodes(c):
    """An older export of every node in more parts, with lists of its own, stands before it in the import."""
    raw = _raw_nodes(c).withColumn("pos", F.lit(2))
    old = F.array(F.lit("-1"), F.col("id"))
    older = raw.withColumns({"name": F.lit("old"), "inputs": old, "outputs": old, "pos": F.lit(1), "parts": F.lit(17).cast("long")})
    nodes, found, _ = nodes_json.import_nodes(older.unionByName(raw))
    way = F.col("direction")
    counts = found.groupBy("id").agg(F.count_if(way == "in").alias("input_count"), F.count_if(way == "out").alias("output_count"))
    return nodes.join(counts, "id", "left").select(
        "id", "name", "schema", "object_type", *[F.coalesce(n, F.lit(0)).alias(n) for n in ("input_count", "output_count")]
    )


@check(
    "A14_drop_dangling_refs",
    with_ctes("objects lineage_edges lineage_metadata", "SELECT id, direction, ref FROM raw_refs WHERE ref IN (SELECT id FROM raw_nodes) AND id IN (SELECT id FROM raw_nodes)", RAW_NODES),
)
def drop_dangling_refs(c):
    return nodes_json.drop_dangling_refs(_raw_nodes(c))


SIDES = """sides AS (SELECT CASE direction WHEN 'input' THEN ref ELSE id END AS source_id, CASE direction WHEN 'input' THEN id ELSE ref END AS target_id,
  max(direction = 'input') AS has_input, max(direction = 'output') AS has_output
  FROM raw_refs WHERE ref IN (SELECT id FROM raw_nodes) AND id IN (SELECT id FROM raw_nodes) GROUP BY 1, 2)"""


@check("A15_symmetrise_edges", with_ctes("objects lineage_edges lineage_metadata", "SELECT source_id, target_id FROM sides", RAW_NODES, SIDES))
def symmetrise_edges(c):
    return nodes_json.symmetrise(_raw_nodes(c))[0]


@check(
    "A15_symmetrise_fixes",
    with_ctes(
        "objects lineage_edges lineage_metadata",
        """SELECT CASE WHEN has_input THEN source_id ELSE target_id END AS id, CASE WHEN has_input THEN 'output' ELSE 'input' END AS direction,
        CASE WHEN has_input THEN target_id ELSE source_id END AS ref FROM sides WHERE NOT (has_input AND has_output)""",
        RAW_NODES,
        SIDES,
    ),
)
def symmetrise_fixes(c):
    return nodes_json.symmetrise(_raw_nodes(c))[1]


@check("A16_normalise_schema", with_ctes("objects", 'SELECT object_id AS id, upper(schema_name) AS "schema" FROM objects'))
def normalise_schema(c):
    return nodes_json.normalise_schema(c.objects.select(F.col("object_id").alias("id"), F.col("schema_name").alias("schema")))


@check(
    "A18_export_definitions",
    with_ctes(
        "objects definitions",
        """SELECT o.schema_name, count(*) AS objects, sum(length(d.definition) - length(replace(d.definition, chr(10), '')) + 2)::BIGINT AS lines
        FROM definitions d JOIN objects o ON o.object_id = d.object_id AND o.object_type = 'Stored Procedure' GROUP BY 1""",
    ),
)
def export_definitions(c):
    folder = scratch_dir(c.spark, "export")
    texts = c.definitions.join(c.objects.where("object_type = 'Stored Procedure'").select("object_id"), "object_id", "left_semi")
    snapshot.export_definitions(texts, c.objects, folder)
    back = c.spark.read.text(folder)
    return back.groupBy("schema_name").agg(
        F.count_if(F.col("value").rlike(r"^-- \[.*\]$")).alias("objects"), F.count("*").alias("lines")
    )


@check(
    "A20_object_key",
    with_ctes("objects", "SELECT schema_name, object_name, true AS non_negative, true AS case_free FROM objects"),
)
def object_key(c):
    key = names.object_key(F.col("schema_name"), F.col("object_name"))
    upper = names.object_key(F.upper("schema_name"), F.upper("object_name"))
    return c.objects.select("schema_name", "object_name", (key >= 0).alias("non_negative"), (key == upper).alias("case_free"))


@check(
    "A20_key_collisions",
    with_ctes(
        "objects",
        """SELECT object_type, count(*) AS objects, count(DISTINCT lower(schema_name) || '.' || lower(object_name)) AS keys,
          0 AS colliding FROM objects GROUP BY 1""",
    ),
)
def key_collisions(c):
    """As many keys as names, in either case of letters, and no key with two names."""
    both = c.objects.select("object_type", "schema_name", "object_name").unionByName(
        c.objects.select("object_type", F.upper("schema_name").alias("schema_name"), F.lower("object_name").alias("object_name"))
    )
    keys = both.groupBy("object_type").agg(F.count_distinct(names.object_key(F.col("schema_name"), F.col("object_name"))).alias("keys"))
    counts = c.objects.groupBy("object_type").agg(F.count("*").alias("objects"))
    colliding = snapshot.colliding_keys(both).agg(F.count("*").cast("int").alias("colliding"))
    return counts.join(keys, "object_type").join(F.broadcast(colliding))  # one row


@check(
    "A21_union_objects",
    with_ctes(
        "objects",
        """SELECT object_id, schema_name, object_name, object_type,
        CASE WHEN object_type IN ('View', 'Function') THEN TIMESTAMP '2024-01-01' ELSE modify_date END AS modify_date FROM objects""",
    ),
)
def union_objects(c):
    of = lambda kind: c.objects.where(F.col("object_type") == kind)
    fields = ("object_id", "schema_name", "object_name")
    return snapshot.union_objects(
        of("Stored Procedure").select(*fields, "modify_date"),
        of("Table").select(*fields, "modify_date"),
        of("View").select(*fields),
        of("Function").select(*fields),
        now=F.lit("2024-01-01").cast("timestamp_ntz"),
    )


@check(
    "A22_union_definitions",
    with_ctes(
        "objects definitions",
        """SELECT d.object_id, length(d.definition) AS chars FROM definitions d JOIN objects o ON o.object_id = d.object_id
        WHERE o.object_type = 'View' OR o.schema_name <> 'STAGING_HR'""",
    ),
)
def union_definitions(c):
    kinds = c.objects.select("object_id", "schema_name", "object_type")
    texts = c.definitions.join(kinds, "object_id")
    blank = F.when(F.col("schema_name") == "STAGING_HR", " ").otherwise(F.col("definition"))
    procedures = texts.where("object_type = 'Stored Procedure'").select("object_id", blank.alias("definition"))
    views = texts.where("object_type = 'View'")
    return snapshot.union_definitions(procedures, views).select("object_id", F.length("definition").alias("chars"))


@check(
    "A23_validate_graph",
    with_ctes(
        "objects lineage_edges dependencies",
        """SELECT 'node' AS kind, CAST(object_id AS VARCHAR) AS id, 'missing fields: label, schema_name' AS message FROM objects WHERE schema_name = 'STAGING_MACHINERY'
        UNION ALL SELECT 'node', CAST(object_id AS VARCHAR), 'missing fields: label' FROM objects WHERE object_type = 'View'
        UNION ALL SELECT 'edge', CAST(referencing_object_id AS VARCHAR), 'missing fields: source' FROM dependencies WHERE referenced_object_id IS NULL""",
    ),
)
def validate_graph(c):
    no_schema = F.col("schema_name") == "STAGING_MACHINERY"
    nodes = c.objects.select(
        F.col("object_id").alias("id"),
        F.when(~no_schema & (F.col("object_type") != "View"), F.col("object_name")).alias("label"),
        "object_type",
        F.when(~no_schema, F.col("schema_name")).alias("schema_name"),
        "object_name",
        F.array().alias("inputs"),
        F.array().alias("outputs"),
    )
    edges = c.dependencies.select(
        F.col("referencing_object_id").alias("id"),
        F.col("referenced_object_id").alias("source"),
        F.col("referencing_object_id").alias("target"),
        F.lit("dependency").alias("edge_type"),
    )
    return nodes_json.validate_graph(nodes, edges)


@check(
    "A24_check_domains",
    with_ctes(
        "objects",
        """SELECT CAST(-object_id AS VARCHAR) AS object_id, 'Sequence' AS object_type, unnest(['object_id is negative', 'object_type is not allowed']) AS message FROM objects WHERE object_type = 'Function'
        UNION ALL SELECT 'x' || object_name, object_type, 'object_id is not an integer' FROM objects WHERE object_type = 'View'""",
    ),
)
def check_domains(c):
    kind = F.col("object_type")
    raw = c.objects.select(
        F.when(kind == "Function", (-F.col("object_id")).cast("string"))
        .when(kind == "View", F.concat(F.lit("x"), "object_name"))
        .otherwise(F.col("object_id").cast("string"))
        .alias("object_id"),
        F.when(kind == "Function", "Sequence").otherwise(kind).alias("object_type"),
    )
    return contracts.check_domains(raw)


