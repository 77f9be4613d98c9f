"""Graph queries, filters, generated DDL and search."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import porter
from checks.base import NODES_CTE, Catalog, check, joined, node_table, with_ctes
from threadline.operators import filters, gram_index, search, text_index, traverse, view
from threadline.operators.traverse import TraceRequest
from threadline.session import scratch_dir
from threadline.sources import logs, snapshot

START, END = 2, 12  # the tables of the first two parts

FILTERED = TraceRequest(
    start=START, upstream=2, downstream=3, schemas=["STAGING_SALES", "STAGING_HR", "CONSUMPTION_FINANCE", "CONSUMPTION_SALES"], exclude=["*77*", "spLoad12*"]
)
ALLOWED = """allowed AS (SELECT id FROM nodes WHERE "schema" IN ('STAGING_SALES', 'STAGING_HR', 'CONSUMPTION_FINANCE', 'CONSUMPTION_SALES')
  AND NOT regexp_matches(name, '(?i)^.*77.*$') AND NOT regexp_matches(name, '(?i)^spLoad12.*$'))"""
USABLE = """usable AS (SELECT source_id, target_id FROM lineage_edges WHERE source_id IN (SELECT id FROM allowed) AND target_id IN (SELECT id FROM allowed))"""
ALL_ALLOWED = "allowed AS (SELECT id FROM nodes)"


def _walk(name: str, seed: str, edges: str, a: str, b: str, cap: int | None) -> str:
    depth = f" AND w.depth < {cap}" if cap is not None else ""
    if cap is None:
        return f"{name} AS ({seed} UNION SELECT e.{b} FROM {name} w JOIN {edges} e ON e.{a} = w.id)"
    return f"{name} AS ({seed} UNION SELECT e.{b}, w.depth + 1 FROM {name} w JOIN {edges} e ON e.{a} = w.id WHERE true{depth})"


@check(
    "E1_trace",
    with_ctes(
        "objects lineage_edges",
        """SELECT id, 'upstream' AS direction, min(depth) AS depth FROM up GROUP BY id UNION ALL SELECT id, 'downstream', min(depth) FROM down GROUP BY id""",
        NODES_CTE,
        ALLOWED,
        USABLE,
        _walk("up", f"SELECT id, 0 AS depth FROM allowed WHERE id = {START}", "usable", "target_id", "source_id", 2),
        _walk("down", f"SELECT id, 0 AS depth FROM allowed WHERE id = {START}", "usable", "source_id", "target_id", 3),
    ),
)
def trace(c):
    return traverse.trace(c.nodes, c.adjacency, FILTERED)


@check(
    "E1_trace_all_levels",
    with_ctes(
        "objects lineage_edges",
        "SELECT id, 'upstream' AS direction FROM up UNION ALL SELECT id, 'downstream' FROM down",
        NODES_CTE,
        ALLOWED,
        USABLE,
        _walk("up", f"SELECT id FROM allowed WHERE id = {START}", "usable", "target_id", "source_id", None),
        _walk("down", f"SELECT id FROM allowed WHERE id = {START}", "usable", "source_id", "target_id", None),
    ),
)
def trace_all_levels(c):
    request = TraceRequest(FILTERED.start, None, None, None, FILTERED.schemas, None, FILTERED.exclude)
    return traverse.trace(c.nodes, c.edges, request).select("id", "direction")


@check(
    "E2_path_nodes",
    with_ctes(
        "objects lineage_edges",
        """SELECT a.id, a.d AS from_start, b.d AS to_end FROM (SELECT id, min(depth) AS d FROM ahead GROUP BY id) a
        JOIN (SELECT id, min(depth) AS d FROM back GROUP BY id) b ON b.id = a.id WHERE a.d + b.d <= 6""",
        NODES_CTE,
        ALL_ALLOWED,
        USABLE,
        f"onward AS (SELECT source_id, target_id FROM usable WHERE target_id <> {START} AND source_id <> {END})",
        _walk("ahead", f"SELECT id, 0 AS depth FROM allowed WHERE id = {START}", "onward", "source_id", "target_id", 6),
        _walk("back", f"SELECT id, 0 AS depth FROM allowed WHERE id = {END}", "onward", "target_id", "source_id", 6),
    ),
)
def path_nodes(c):
    return traverse.path_nodes(c.nodes, c.adjacency, TraceRequest(START, END), max_depth=6)


@check(
    "E2_paths",
    with_ctes(
        "objects lineage_edges",
        f"SELECT array_to_string(path, '>') AS path FROM routes WHERE here = {END}",
        NODES_CTE,
        ALL_ALLOWED,
        USABLE,
        f"""routes AS (SELECT [id] AS path, id AS here FROM allowed WHERE id = {START}
          UNION ALL SELECT list_append(r.path, e.target_id), e.target_id FROM routes r JOIN usable e ON e.source_id = r.here
          WHERE r.here <> {END} AND len(r.path) <= 6 AND NOT list_contains(r.path, e.target_id))""",
    ),
)
def paths(c):
    found = traverse.paths(c.nodes, c.edges, TraceRequest(START, END), max_depth=6)
    return found.select(joined("path", ">").alias("path"))


@check(
    "E2_route_nodes",
    with_ctes(
        "objects lineage_edges",
        f"SELECT DISTINCT unnest(path) AS id FROM routes WHERE here = {END}",
        NODES_CTE,
        ALL_ALLOWED,
        USABLE,
        f"""routes AS (SELECT [id] AS path, id AS here FROM allowed WHERE id = {START}
          UNION ALL SELECT list_append(r.path, e.target_id), e.target_id FROM routes r JOIN usable e ON e.source_id = r.here
          WHERE r.here <> {END} AND len(r.path) <= 6 AND NOT list_contains(r.path, e.target_id))""",
    ),
)
def route_nodes(c):
    return traverse.route_nodes(c.nodes, c.adjacency, TraceRequest(START, END), max_depth=6)


VISIBLE = """visible AS (SELECT id, name, "schema" FROM nodes WHERE "schema" IN ('CONSUMPTION_FINANCE', 'CONSUMPTION_SALES', 'STAGING_HR', 'STAGING_BUILDING'))"""


@check(
    "E3_reachable_from_focus",
    with_ctes(
        "objects lineage_edges",
        'SELECT id, name, "schema" FROM visible WHERE id IN (SELECT id FROM reached)',
        NODES_CTE,
        VISIBLE,
        """both_ways AS (SELECT source_id AS a, target_id AS b FROM lineage_edges WHERE source_id IN (SELECT id FROM visible) AND target_id IN (SELECT id FROM visible)
          UNION SELECT target_id, source_id FROM lineage_edges WHERE source_id IN (SELECT id FROM visible) AND target_id IN (SELECT id FROM visible))""",
        """reached AS (SELECT id FROM visible WHERE "schema" = 'CONSUMPTION_FINANCE' UNION SELECT e.b FROM reached r JOIN both_ways e ON e.a = r.id)""",
    ),
)
def reachable_from_focus(c):
    visible = filters.filter_nodes(c.nodes, ["CONSUMPTION_FINANCE", "CONSUMPTION_SALES", "STAGING_HR", "STAGING_BUILDING"])
    return traverse.reachable_from_focus(visible, c.adjacency, ["CONSUMPTION_FINANCE"]).select("id", "name", "schema")


@check(
    "E4_drop_isolated",
    with_ctes(
        "objects lineage_edges",
        """SELECT id, name FROM nodes WHERE id IN (SELECT source_id FROM inner_edges UNION SELECT target_id FROM inner_edges)""",
        NODES_CTE,
        "inner_edges AS (SELECT source_id, target_id FROM lineage_edges WHERE source_id IN (SELECT id FROM nodes) AND target_id IN (SELECT id FROM nodes))",
    ),
)
def drop_isolated(c):
    return filters.drop_isolated(c.nodes, c.edges).select("id", "name")


FACETS = """"schema" IN ('dbo', 'CONSUMPTION_SALES', 'STAGING_HR') AND object_type IN ('Table', 'View') AND (data_model_type IS NULL OR data_model_type IN ('Dimension', 'Other'))"""
FACET_ARGS = (["dbo", "CONSUMPTION_SALES", "STAGING_HR"], ["Table", "View"], ["Dimension", "Other"])


@check("E5_filter_nodes", with_ctes("objects", f'SELECT id, name, "schema", object_type, data_model_type FROM nodes WHERE {FACETS}', NODES_CTE))
def filter_nodes(c):
    return filters.filter_nodes(c.nodes, *FACET_ARGS)


@check(
    "E6_exclude_patterns",
    with_ctes(
        "objects",
        "SELECT id, name FROM nodes WHERE NOT regexp_matches(name, '(?i)^.*7.*$') AND NOT regexp_matches(name, '(?i)^vw_.*2$') AND name <> 'sp.oad1'",
        NODES_CTE,
    ),
)
def exclude_patterns(c):
    return filters.exclude_patterns(c.nodes, ["*7*", "VW_*2", "sp.oad1"]).select("id", "name")


@check(
    "E7_trace_and_filter",
    with_ctes(
        "objects lineage_edges",
        f"SELECT id, name FROM nodes WHERE {FACETS} AND id IN (SELECT id FROM down)",
        NODES_CTE,
        ALL_ALLOWED,
        USABLE,
        _walk("down", f"SELECT id, 0 AS depth FROM allowed WHERE id = {START}", "usable", "source_id", "target_id", 2),
    ),
)
def trace_and_filter(c):
    traced = traverse.trace(c.nodes, c.edges, TraceRequest(START, upstream=0, downstream=2))
    return filters.filter_nodes(c.nodes, *FACET_ARGS, traced=traced).select("id", "name")


NEAR = """near AS (SELECT target_id AS id FROM lineage_edges WHERE source_id IN (SELECT id FROM chosen) UNION SELECT source_id FROM lineage_edges WHERE target_id IN (SELECT id FROM chosen))"""
CHOSEN = "chosen AS (SELECT id FROM nodes WHERE name = 'Dim0')"


@check(
    "E8_neighbourhood",
    with_ctes(
        "objects lineage_edges",
        "SELECT id, CASE WHEN id IN (SELECT id FROM chosen) THEN 'highlighted' WHEN id IN (SELECT id FROM near) THEN 'neighbour' ELSE 'dimmed' END AS status FROM nodes",
        NODES_CTE,
        CHOSEN,
        NEAR,
    ),
)
def neighbourhood(c):
    return filters.neighbourhood(c.nodes, c.edges, c.nodes.where("name = 'Dim0'").select("id"))


@check(
    "E9_top_nodes",
    with_ctes(
        "objects lineage_edges",
        """SELECT id, name, priority FROM must UNION ALL SELECT id, name, priority FROM rest WHERE n <= 1000 - (SELECT count(*) FROM must)""",
        NODES_CTE,
        CHOSEN,
        NEAR,
        "must AS (SELECT id, name, 0 AS priority FROM nodes WHERE id IN (SELECT id FROM chosen UNION SELECT id FROM near))",
        """rest AS (SELECT id, name, priority, row_number() OVER (ORDER BY priority, id) AS n FROM (SELECT id, name, CASE object_type WHEN 'Stored Procedure' THEN 1 WHEN 'Function' THEN 2 ELSE 3 END AS priority
          FROM nodes WHERE id NOT IN (SELECT id FROM must)))""",
    ),
)
def top_nodes(c):
    return filters.top_nodes(c.nodes, c.edges, c.nodes.where("name = 'Dim0'").select("id")).select("id", "name", "priority")


@check(
    "E10_visible_edges",
    with_ctes(
        "objects lineage_edges",
        """SELECT CASE WHEN count(*) = 2 THEN least(min(source_id), min(target_id)) ELSE min(source_id) END AS source_id,
          CASE WHEN count(*) = 2 THEN greatest(max(source_id), max(target_id)) ELSE min(target_id) END AS target_id, count(*) = 2 AS is_bidirectional
        FROM (SELECT DISTINCT source_id, target_id FROM shown) GROUP BY least(source_id, target_id), greatest(source_id, target_id)""",
        NODES_CTE,
        VISIBLE.replace("visible AS (", "visible AS MATERIALIZED ("),
        "shown AS MATERIALIZED (SELECT source_id, target_id FROM lineage_edges WHERE source_id IN (SELECT id FROM visible) AND target_id IN (SELECT id FROM visible))",
    ),
)
def visible_edges(c):
    visible = filters.filter_nodes(c.nodes, ["CONSUMPTION_FINANCE", "CONSUMPTION_SALES", "STAGING_HR", "STAGING_BUILDING"])
    return filters.visible_edges(visible, c.edges)


@check(
    "E11_find_node",
    with_ctes("objects", "SELECT id, name, \"schema\" FROM nodes WHERE lower(name) = 'cust7' AND lower(\"schema\") LIKE 'staging%' ORDER BY id LIMIT 1", NODES_CTE),
)
def find_node(c):
    return filters.find_node(c.nodes, "cUST7").select("id", "name", "schema")


@check(
    "E12_suggest",
    with_ctes(
        "objects",
        """SELECT id, name, "schema" FROM nodes WHERE contains(lower(name), 'load1') AND "schema" IN ('STAGING_SALES', 'STAGING_HR')
        ORDER BY CASE WHEN starts_with(lower(name), 'load1') THEN 0 ELSE 1 END, id LIMIT 5""",
        NODES_CTE,
    ),
)
def suggest(c):
    return filters.suggest(c.nodes, " Load1 ", schemas=["STAGING_SALES", "STAGING_HR"]).select("id", "name", "schema")


@check(
    "E14_snapshot_info",
    with_ctes(
        "objects",
        'SELECT count(*) AS node_count, count(DISTINCT "schema") AS schema_count, count(DISTINCT object_type) AS object_type_count FROM nodes',
        NODES_CTE,
    ),
)
def snapshot_info(c):
    return filters.snapshot_info(c.nodes)


@check("E15_type_counts", with_ctes("objects", "SELECT object_type, object_type || 's' AS label, count(*) AS objects FROM objects GROUP BY 1"))
def type_counts(c):
    return filters.type_counts(c.objects)


TYPE_SQL = """CASE WHEN data_type IN ('varchar', 'nvarchar', 'char', 'nchar') THEN data_type || '(' || CASE WHEN max_length = -1 THEN 'MAX'
    WHEN data_type IN ('nvarchar', 'nchar') THEN CAST(max_length // 2 AS VARCHAR) ELSE CAST(max_length AS VARCHAR) END || ')'
  WHEN data_type IN ('decimal', 'numeric') THEN data_type || '(' || "precision" || ',' || scale || ')' ELSE data_type END"""
LINE_SQL = f"""'    [' || column_name || '] ' || {TYPE_SQL} || CASE WHEN is_nullable THEN ' NULL' ELSE ' NOT NULL' END"""
TABLE_DDL = f"""table_ddl AS (SELECT o.object_id, o.schema_name, o.object_name, 'Table' AS object_type, 'CREATE TABLE [' || o.schema_name || '].[' || o.object_name || '] (' || chr(10) ||
  string_agg({LINE_SQL}, ',' || chr(10) ORDER BY column_id) || chr(10) || ');' AS ddl_text
  FROM table_columns c JOIN objects o ON o.schema_name = c.schema_name AND o.object_name = c.table_name AND o.object_type = 'Table' GROUP BY 1, 2, 3)"""
FALLBACK = """fallback AS (SELECT object_id, schema_name, object_name, object_type, 'CREATE TABLE [' || schema_name || '].[' || object_name || '] (' || chr(10) ||
  '    /* Column information not available - table_columns.parquet not provided */' || chr(10) || ');' AS ddl_text
  FROM objects WHERE object_type = 'Table' AND object_id NOT IN (SELECT object_id FROM table_ddl))"""
UNIFIED = """unified AS (SELECT o.object_id, o.schema_name, o.object_name, o.object_type, d.definition AS ddl_text FROM definitions d JOIN objects o ON o.object_id = d.object_id
  AND o.object_type IN ('Stored Procedure', 'View') UNION ALL FROM table_ddl UNION ALL FROM fallback)"""
DDL = (TABLE_DDL, FALLBACK, UNIFIED)


def _columns(c: Catalog):
    return snapshot.attach_object_id(c.table_columns, c.objects)


def _unified(c: Catalog):
    return search.unified_ddl(c.objects, c.definitions, _columns(c))


@check("E13_get_ddl", with_ctes("objects definitions table_columns", f"SELECT * FROM unified WHERE object_id = {END}", *DDL))
def get_ddl(c):
    return search.get_ddl(_unified(c), END)


@check(
    "F1_column_type",
    with_ctes("table_columns", f"SELECT schema_name, table_name, column_name, {TYPE_SQL} AS type_text, {LINE_SQL} AS line FROM table_columns"),
)
def column_type(c):
    from threadline.functions import ddl

    parts = [F.col(x) for x in ("data_type", "max_length", "precision", "scale")]
    return c.table_columns.select(
        "schema_name",
        "table_name",
        "column_name",
        ddl.column_type(*parts).alias("type_text"),
        ddl.column_line(F.col("column_name"), *parts, F.col("is_nullable")).alias("line"),
    )


@check("F2_table_ddl", with_ctes("objects table_columns", "SELECT * FROM table_ddl", TABLE_DDL))
def table_ddl(c):
    return search.table_ddl(_columns(c))


@check("F3_fallback_ddl", with_ctes("objects table_columns", "SELECT * FROM fallback", TABLE_DDL, FALLBACK))
def fallback_ddl(c):
    return search.fallback_ddl(c.objects, _columns(c))


@check("F4_unified_ddl", with_ctes("objects definitions table_columns", "SELECT * FROM unified", *DDL))
def unified_ddl(c):
    return _unified(c)


POSTINGS = """words AS (SELECT id, unnest(string_split_regex(lower(body), '[^a-z]+')) AS term FROM docs),
postings AS (SELECT id, term, count(*) AS tf FROM words WHERE term <> '' GROUP BY 1, 2),
lengths AS (SELECT d.id, coalesce(sum(p.tf), 0)::BIGINT AS length FROM docs d LEFT JOIN postings p ON p.id = d.id GROUP BY 1)"""
DOCS = "docs AS (SELECT doc_id AS id, text AS body FROM documents)"
CATALOG_DOCS = "docs AS (SELECT object_id AS id, object_name || ' ' || ddl_text AS body FROM unified)"


def _ranked(hit: str) -> str:
    return f"""ranked AS (SELECT p.id, count(DISTINCT p.term) AS terms, round(sum(ln((s.n - f.df + 0.5) / (f.df + 0.5) + 1) * (p.tf * 2.2) / (p.tf + 1.2 * (1 - 0.75 + 0.75 * l.length / s.mean))), 6) AS score
  FROM postings p JOIN (SELECT term, count(*) AS df FROM postings GROUP BY 1) f ON f.term = p.term JOIN lengths l ON l.id = p.id
  CROSS JOIN (SELECT count(*) AS n, avg(length) AS mean FROM lengths) s WHERE {hit} GROUP BY p.id)"""


def _over_documents(select: str, *extra: str) -> str:
    return "WITH " + ",\n".join([DOCS, POSTINGS, *extra]) + "\n" + select


def _document_index(c: Catalog, **options):
    return search.build_index(c.documents, "doc_id", ["text"], **options)


@check("F5_postings_documents", _over_documents("SELECT p.term, p.id, p.tf, l.length FROM postings p JOIN lengths l ON l.id = p.id"))
def postings_documents(c):
    return _document_index(c).postings


@check(
    "F5_postings_catalog",
    with_ctes("objects definitions table_columns", "SELECT p.term, p.id, p.tf, l.length FROM postings p JOIN lengths l ON l.id = p.id", *DDL, CATALOG_DOCS, POSTINGS),
)
def postings_catalog(c):
    return search.build_index(_unified(c), "object_id", ["object_name", "ddl_text"]).postings


QUERY = "ention, the THAN"
HIT = "p.term IN ('ention', 'the', 'than')"


@check(
    "F6_search_documents",
    _over_documents(
        "SELECT r.id, r.score, substr(d.body, 1, 150) AS snippet FROM (SELECT id, score FROM ranked ORDER BY score DESC, id LIMIT 100) r JOIN docs d ON d.id = r.id",
        _ranked(HIT),
    ),
)
def search_documents(c):
    hits = search.search(_document_index(c), QUERY)
    return search.with_snippets(hits, c.documents, "doc_id", "text")


@check(
    "F6_search_catalog",
    with_ctes(
        "objects definitions table_columns",
        "SELECT id, score FROM ranked ORDER BY score DESC, id LIMIT 100",
        *DDL,
        CATALOG_DOCS,
        POSTINGS,
        _ranked("p.term IN ('merge', 'machinery')"),
    ),
)
def search_catalog(c):
    return search.search(search.build_index(_unified(c), "object_id", ["object_name", "ddl_text"]), "merge machinery")


ACCENTS = search._accent_map()
STEMMED = f"""words AS (SELECT id, unnest(string_split_regex(lower(translate(body, '{ACCENTS[0]}', '{ACCENTS[1]}')), '[^a-z]+')) AS term FROM docs),
cut AS MATERIALIZED (SELECT id, term, count(*) AS tf FROM words WHERE term <> '' GROUP BY 1, 2),
stems AS MATERIALIZED ({porter.stems("cut", "term")}),
postings AS MATERIALIZED (SELECT id, stem AS term, sum(tf) AS tf FROM cut JOIN stems USING (term) GROUP BY 1, 2),
lengths AS (SELECT d.id, coalesce(sum(p.tf), 0)::BIGINT AS length FROM docs d LEFT JOIN cut p ON p.id = d.id GROUP BY 1),
asked AS (SELECT unnest(['entions', 'eners', 'the']) AS term),
asked_stems AS ({porter.stems("asked", "term")})"""


@check(
    "F7_search_stemmed",
    "WITH " + ",\n".join([DOCS, STEMMED, _ranked("p.term IN (SELECT stem FROM asked_stems)")]) + "\nSELECT id, score FROM ranked",
)
def search_stemmed(c):
    return search.search(_document_index(c, stemmed=True, fold_accents=True), "entions eners the", k=None)


@check("F8_search_all_terms", _over_documents("SELECT id, score FROM ranked WHERE terms = 3", _ranked(HIT)))
def search_all_terms(c):
    return search.search(_document_index(c), QUERY, k=None, mode="all")


def _stored(c: Catalog, query: str, **options) -> search.TextIndex:
    folder = scratch_dir(c.spark, "index")
    _document_index(c, **options).write(folder, buckets=16)
    return search.TextIndex.load(c.spark, folder, query)


def _kept_index(c: Catalog, **options):
    """An index that was made of an earlier state of the documents and then brought up to date."""
    ids = F.col("doc_id")
    older = c.documents.where(ids % 7 != 0).select("doc_id", F.when(ids % 13 == 0, F.concat(F.lit("than the older "), "text")).otherwise(F.col("text")).alias("text"))
    gone = c.documents.where(ids % 11 == 0).select((-ids - 1).alias("doc_id"), "text")
    changed = c.documents.where((ids % 7 == 0) | (ids % 13 == 0)).select("doc_id", "text")
    index = text_index.create(older.unionByName(gone), scratch_dir(c.spark, "kept-index"), "doc_id", ["text"], buckets=16, **options)
    half = changed.where(ids % 2 == 0)
    index = text_index.update(index, half, "doc_id", ["text"], gone.select(F.col("doc_id").alias("id")))
    return text_index.update(index, changed.where(ids % 2 != 0), "doc_id", ["text"])


@check("F5_kept_index_postings", _over_documents("SELECT p.term, p.id, p.tf, l.length FROM postings p JOIN lengths l ON l.id = p.id"))
def kept_index_postings(c):
    return text_index.postings(c.spark, _kept_index(c))


@check("F6_kept_index_search", _over_documents("SELECT id, score FROM ranked ORDER BY score DESC, id LIMIT 100", _ranked(HIT)))
def kept_index_search(c):
    return text_index.search(c.spark, _kept_index(c), QUERY).hits


@check("F8_kept_index_all", _over_documents("SELECT id, score FROM ranked WHERE terms = 3 ORDER BY score DESC, id LIMIT 100", _ranked(HIT)))
def kept_index_all(c):
    return text_index.search(c.spark, _kept_index(c), QUERY, mode="all").hits


@check(
    "F8_kept_index_phrase",
    "SELECT doc_id AS id FROM documents WHERE regexp_matches(lower(text), '(^|[^a-z])than[^a-z]+the([^a-z]|$)')",
)
def kept_index_phrase(c):
    return text_index.search_phrase(c.spark, _kept_index(c), "Than The").select("id")


@check("F5_index_round_trip", _over_documents("SELECT id, score FROM ranked", _ranked(HIT)))
def index_round_trip(c):
    return search.search(_stored(c, QUERY), QUERY, k=None)


@check("F8_search_all_stop_words", _over_documents("SELECT id FROM ranked WHERE terms = 2", _ranked("p.term IN ('ention', 'than')")))
def search_all_stop_words(c):
    return search.search(_stored(c, QUERY, stop_words=["the", "and"]), QUERY, k=None, mode="all").select("id")


@check("F8_search_prefix", _over_documents("SELECT id, score FROM ranked", _ranked("starts_with(p.term, 'entio') OR starts_with(p.term, 'thanth')")))
def search_prefix(c):
    return search.search(_document_index(c), "entio thanth", k=None, mode="prefix")


@check("F8_search_phrase", "SELECT doc_id AS id FROM documents WHERE regexp_matches(lower(text), '(^|[^a-z])than[^a-z]+the([^a-z]|$)')")
def search_phrase(c):
    return search.search_phrase(c.documents, "Than The", "doc_id", "text")


TERM = "dim1"
SCORED = f"""described AS (SELECT n.id, n.name, n.object_type, n."schema", u.ddl_text, 'Layer of ' || n.name || ' in ' || n."schema" AS description
    FROM nodes n JOIN unified u ON u.object_id = n.id WHERE n.object_type <> 'View' UNION ALL
    SELECT n.id, n.name, n.object_type, n."schema", u.ddl_text, NULL FROM nodes n JOIN unified u ON u.object_id = n.id WHERE n.object_type = 'View'),
scored AS (SELECT *, CASE WHEN starts_with(lower(name), '{TERM}') THEN 10 WHEN contains(lower(name), '{TERM}') THEN 5 ELSE 0 END
    + CASE WHEN contains(lower(description), '{TERM}') THEN 2 ELSE 0 END + CASE WHEN contains(lower(ddl_text), '{TERM}') THEN 1 ELSE 0 END AS score,
    instr(lower(ddl_text), '{TERM}') - 1 AS spot FROM described)"""
HITS_SQL = f"""SELECT id, name, object_type AS "type", "schema", score, CASE WHEN contains(lower(description), '{TERM}') THEN substr(description, 1, 150) WHEN contains(lower(name), '{TERM}') THEN name
  ELSE '...' || substr(ddl_text, greatest(spot - 50, 0) + 1, spot + 100 - greatest(spot - 50, 0)) || '...' END AS snippet FROM scored WHERE score > 0"""


def _scored(c: Catalog):
    texts = _unified(c).select(F.col("object_id").alias("id"), "ddl_text")
    description = F.when(F.col("object_type") != "View", F.concat(F.lit("Layer of "), "name", F.lit(" in "), "schema"))
    return search.scored_search(node_table(c.objects).join(texts, "id").withColumn("description", description), TERM)


@check("F9_scored_search", with_ctes("objects definitions table_columns", HITS_SQL, NODES_CTE, *DDL, SCORED))
def scored_search(c):
    return _scored(c)


def _described(c: Catalog):
    texts = _unified(c).select(F.col("object_id").alias("id"), "ddl_text")
    description = F.when(F.col("object_type") != "View", F.concat(F.lit("Layer of "), "name", F.lit(" in "), "schema"))
    return node_table(c.objects).join(texts, "id").withColumn("description", description)


@check("F9_scored_search_by_grams", with_ctes("objects definitions table_columns", HITS_SQL, NODES_CTE, *DDL, SCORED))
def scored_search_by_grams(c):
    """The same hits: candidates from an index of three-letter runs, confirmed on whole texts."""
    nodes = _described(c)
    folder = gram_index.create(nodes, scratch_dir(c.spark, "grams"), "id", ["name", "description", "ddl_text"], buckets=16)
    return search.scored_search(gram_index.candidates(nodes, folder, TERM), TERM)


@check(
    "E12_suggest_by_grams",
    with_ctes(
        "objects",
        """SELECT id, name, "schema" FROM nodes WHERE contains(lower(name), 'load1') AND "schema" IN ('STAGING_SALES', 'STAGING_HR')
        ORDER BY CASE WHEN starts_with(lower(name), 'load1') THEN 0 ELSE 1 END, id LIMIT 5""",
        NODES_CTE,
    ),
)
def suggest_by_grams(c):
    folder = gram_index.create(c.nodes, scratch_dir(c.spark, "grams"), "id", ["name"], buckets=16)
    found = gram_index.candidates(c.nodes, folder, "LOAD1")
    return filters.suggest(found, "LOAD1", k=5, schemas=["STAGING_SALES", "STAGING_HR"]).select("id", "name", "schema")


@check(
    "F10_filter_hits",
    with_ctes(
        "objects definitions table_columns",
        f"""SELECT id, score FROM ({HITS_SQL}) WHERE "schema" IN ('CONSUMPTION_FINANCE', 'CONSUMPTION_SALES', 'STAGING_HR') AND "type" IN ('Table', 'View')""",
        NODES_CTE,
        *DDL,
        SCORED,
    ),
)
def filter_hits(c):
    return search.filter_hits(_scored(c), ["CONSUMPTION_FINANCE", "CONSUMPTION_SALES", "STAGING_HR"], ["Table", "View"]).select("id", "score")


LOG_LEVEL = "CASE command WHEN 'error' THEN 'ERROR' WHEN 'view' THEN 'WARNING' ELSE 'INFO' END"


@check(
    "F11_log_lines",
    with_ctes(
        "query_logs",
        f"""SELECT event_id AS pos, level, '2024-01-01 ' || level || ' ' || command_text AS value
        FROM (SELECT event_id, command_text, {LOG_LEVEL} AS level FROM query_logs ORDER BY event_id DESC LIMIT 1000) WHERE level = 'WARNING' AND contains(lower(command_text), 'tbl1')""",
    ),
)
def log_lines(c):
    level = F.when(F.col("command") == "error", "ERROR").when(F.col("command") == "view", "WARNING").otherwise("INFO")
    lines = c.query_logs.select(F.col("event_id").alias("pos"), F.concat_ws(" ", F.lit("2024-01-01"), level, "command_text").alias("value"))
    return logs.filter_lines(lines, 1000, "warning", "TBL1")




@check(
    "E3_E10_visible_graph",
    with_ctes(
        "objects lineage_edges",
        """SELECT a.source_id, a.target_id, b.source_id IS NOT NULL AND a.source_id <> a.target_id AS is_bidirectional
        FROM shown a LEFT JOIN shown b ON b.source_id = a.target_id AND b.target_id = a.source_id WHERE b.source_id IS NULL OR a.source_id <= a.target_id""",
        NODES_CTE,
        """linked AS MATERIALIZED (SELECT * FROM nodes WHERE id IN (SELECT unnest([source_id, target_id]) FROM lineage_edges
          WHERE source_id IN (SELECT id FROM nodes) AND target_id IN (SELECT id FROM nodes)))""",
        """kept AS MATERIALIZED (SELECT * FROM linked WHERE "schema" IN ('CONSUMPTION_FINANCE', 'CONSUMPTION_SALES', 'STAGING_HR', 'STAGING_BUILDING') AND lower(name) NOT LIKE 'cust1%')""",
        """between AS MATERIALIZED (SELECT source_id, target_id FROM lineage_edges WHERE source_id IN (SELECT id FROM kept) AND target_id IN (SELECT id FROM kept))""",
        """both_ways AS MATERIALIZED (SELECT source_id AS a, target_id AS b FROM between UNION SELECT target_id, source_id FROM between)""",
        """reached AS (SELECT id FROM kept WHERE "schema" = 'CONSUMPTION_FINANCE' UNION SELECT e.b FROM reached r JOIN both_ways e ON e.a = r.id)""",
        """best AS MATERIALIZED (SELECT id FROM kept WHERE id IN (SELECT id FROM reached)
          ORDER BY CASE object_type WHEN 'Stored Procedure' THEN 1 WHEN 'Function' THEN 2 ELSE 3 END, id LIMIT 500)""",
        "shown AS MATERIALIZED (SELECT source_id, target_id FROM between WHERE source_id IN (SELECT id FROM best) AND target_id IN (SELECT id FROM best))",
    ),
)
def visible_graph(c):
    schemas = ["CONSUMPTION_FINANCE", "CONSUMPTION_SALES", "STAGING_HR", "STAGING_BUILDING"]
    _, edges = view.visible_graph(
        c.nodes, c.edges, schemas=schemas, exclude=["Cust1*"], focus_schemas=["CONSUMPTION_FINANCE"], k=500
    )
    return edges
