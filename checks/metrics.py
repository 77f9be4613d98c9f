"""Metrics."""

from __future__ import annotations

from checks.base import check, with_ctes
from threadline.operators import metrics

PARSE = """parse_metrics AS (SELECT CASE WHEN grouping(o.object_type) = 1 THEN 'ALL' ELSE o.object_type END AS scope, count(*) AS total, count(m.parse_success) AS parsed,
    round(count(m.parse_success) / count(*) * 100, 1) AS parse_rate, count(*) FILTER (m.parse_success) AS success_count,
    round(count(*) FILTER (m.parse_success) / count(*) * 100, 1) AS success_pct, count(*) FILTER (m.primary_source = 'parser') AS by_parser,
    count(*) FILTER (m.primary_source = 'dmv') AS by_dmv, count(*) FILTER (m.primary_source = 'metadata') AS by_metadata
  FROM objects o LEFT JOIN lineage_metadata m ON m.object_id = o.object_id GROUP BY ROLLUP (o.object_type))"""
KINDS = ", ".join(
    f"count(*) FILTER (a.object_type = '{t1}' AND b.object_type = '{t2}') AS {name}" for name, (t1, t2) in metrics.DEPENDENCY_KINDS.items()
)
DEPENDENCY = f"""dependency_metrics AS (SELECT {KINDS}, count(*) AS total FROM dependencies d
  JOIN objects a ON a.object_id = d.referencing_object_id JOIN objects b ON b.object_id = d.referenced_object_id)"""
ISOLATION = """isolation_metrics AS (SELECT CASE WHEN grouping(object_type) = 1 THEN 'ALL' ELSE object_type END AS scope, count(*) AS total,
    count(*) FILTER (NOT used) AS isolated, round(count(*) FILTER (NOT used) / count(*) * 100, 1) AS isolation_rate
  FROM (SELECT object_type, object_id IN (SELECT referencing_object_id FROM dependencies UNION SELECT referenced_object_id FROM dependencies WHERE referenced_object_id IS NOT NULL) AS used FROM objects)
  GROUP BY ROLLUP (object_type))"""


@check("G1_parse_metrics", with_ctes("objects lineage_metadata", "SELECT * FROM parse_metrics", PARSE))
def parse_metrics(c):
    return metrics.parse_metrics(c.objects, c.metadata)


@check("G2_dependency_metrics", with_ctes("objects dependencies", "SELECT * FROM dependency_metrics", DEPENDENCY))
def dependency_metrics(c):
    return metrics.dependency_metrics(c.dependencies, c.objects)


@check("G3_isolation_metrics", with_ctes("objects dependencies", "SELECT * FROM isolation_metrics", ISOLATION))
def isolation_metrics(c):
    return metrics.isolation_metrics(c.objects, c.dependencies)


@check(
    "G3_isolation_strict_not_in",
    with_ctes(
        "objects dependencies",
        """SELECT CASE WHEN grouping(object_type) = 1 THEN 'ALL' ELSE object_type END AS scope, count(*) AS total,
        count(*) FILTER (alone) AS isolated, round(count(*) FILTER (alone) / count(*) * 100, 1) AS isolation_rate
        FROM (SELECT object_type, object_id NOT IN (SELECT referencing_object_id FROM dependencies UNION SELECT referenced_object_id FROM dependencies) AS alone FROM objects)
        GROUP BY ROLLUP (object_type)""",
    ),
)
def isolation_strict(c):
    return metrics.isolation_metrics(c.objects, c.dependencies, strict_not_in=True)


def _tall(table: str, section: str, columns: list[str], scope: str = "scope") -> str:
    return " UNION ALL ".join(
        f"SELECT '{section}' AS section, {scope} AS scope, '{col}' AS metric, CAST({col} AS DOUBLE) AS value FROM {table}" for col in columns
    )


@check(
    "G4_all_metrics",
    with_ctes(
        "objects lineage_metadata dependencies",
        " UNION ALL ".join(
            [
                _tall("parse_metrics", "parse", ["total", "parsed", "parse_rate", "success_count", "success_pct", "by_parser", "by_dmv", "by_metadata"]),
                _tall("dependency_metrics", "dependencies", [*metrics.DEPENDENCY_KINDS, "total"], "'ALL'"),
                _tall("isolation_metrics", "isolation", ["total", "isolated", "isolation_rate"]),
            ]
        ),
        PARSE,
        DEPENDENCY,
        ISOLATION,
    ),
)
def all_metrics(c):
    return metrics.all_metrics(c.objects, c.metadata, c.dependencies)


LINKED = "object_id IN (SELECT source_id FROM lineage_edges UNION SELECT target_id FROM lineage_edges)"
STATED = "object_id IN (SELECT object_id FROM lineage_metadata)"


def _gaps(condition: str) -> str:
    return with_ctes(
        "objects lineage_metadata lineage_edges",
        f"SELECT object_id, schema_name, object_name, object_type, modify_date FROM objects WHERE {condition}(NOT {STATED} OR NOT {LINKED})",
    )


@check("G5_gaps", _gaps("object_type = 'Stored Procedure' AND "))
def gaps(c):
    return metrics.gaps(c.objects, c.metadata, c.edges)


@check("G5_gaps_all_types", _gaps(""))
def gaps_all_types(c):
    return metrics.gaps(c.objects, c.metadata, c.edges, object_type=None)


GAP_STATS = f"""gap_stats AS (SELECT CASE WHEN grouping(object_type) = 1 THEN 'ALL' ELSE object_type END AS scope, count(*) AS total_objects,
    count(*) FILTER (s) AS parsed_objects, count(*) FILTER (NOT s) AS unparsed_objects, count(*) FILTER (s AND NOT l) AS empty_dependencies,
    count(*) FILTER (NOT s OR NOT l AND s) AS total_gaps, round(count(*) FILTER (NOT s OR NOT l AND s) / count(*) * 100, 2) AS gap_percentage
  FROM (SELECT object_type, {STATED} AS s, {LINKED} AS l FROM objects) GROUP BY ROLLUP (object_type))"""


@check("G6_gap_stats", with_ctes("objects lineage_metadata lineage_edges", "SELECT * FROM gap_stats", GAP_STATS))
def gap_stats(c):
    return metrics.gap_stats(c.objects, c.metadata, c.edges)


@check("G7_gap_stats_by_type", with_ctes("objects lineage_metadata lineage_edges", "SELECT * FROM gap_stats WHERE scope <> 'ALL'", GAP_STATS))
def gap_stats_by_type(c):
    return metrics.gap_stats_by_type(metrics.gap_stats(c.objects, c.metadata, c.edges))


@check(
    "G8_workspace_counts",
    with_ctes(
        "objects dependencies definitions query_logs table_columns lineage_metadata",
        " UNION ALL ".join(
            f"SELECT '{t}' AS table_name, count(*) AS row_count FROM {t}"
            for t in ("objects", "dependencies", "definitions", "query_logs", "table_columns", "lineage_metadata")
        ),
    ),
)
def workspace_counts(c):
    from threadline.sources.snapshot import row_counts

    names = ("objects", "dependencies", "definitions", "query_logs", "table_columns", "lineage_metadata")
    return row_counts({n: getattr(c, n) for n in names})


@check(
    "G9_source_breakdown",
    with_ctes(
        "lineage_metadata",
        "SELECT primary_source, count(*) AS objects, avg(CASE WHEN parse_success THEN 1.0::DOUBLE ELSE 0.0 END) AS avg_success_rate FROM lineage_metadata GROUP BY 1",
    ),
)
def source_breakdown(c):
    return metrics.source_breakdown(c.metadata)


@check(
    "G10_coverage",
    with_ctes(
        "objects lineage_metadata",
        f"""SELECT CASE WHEN grouping(object_type) = 1 THEN 'ALL' ELSE object_type END AS scope, count(*) AS total, count(*) FILTER (s) AS parsed,
        round(count(*) FILTER (s) / count(*) * 100, 1) AS coverage
        FROM (SELECT object_type, {STATED} AS s FROM objects WHERE object_type <> 'Function') GROUP BY ROLLUP (object_type)""",
    ),
)
def coverage(c):
    return metrics.coverage(c.objects, c.metadata)


@check(
    "G11_source_distribution",
    with_ctes("lineage_metadata", "SELECT coalesce(primary_source, 'unknown') AS primary_source, count(DISTINCT object_id) AS objects FROM lineage_metadata GROUP BY 1"),
)
def source_distribution(c):
    return metrics.source_distribution(c.metadata)


@check("G12_success_block", with_ctes("objects lineage_metadata", "SELECT scope, total, success_count, success_pct FROM parse_metrics", PARSE))
def success_block(c):
    return metrics.success_block(metrics.parse_metrics(c.objects, c.metadata))


@check(
    "G13_parse_counters",
    with_ctes(
        "objects lineage_metadata",
        """SELECT count(*) AS total, count(*) FILTER (m.parse_success) AS success, count(*) FILTER (NOT m.parse_success) AS failed
        FROM objects o LEFT JOIN lineage_metadata m ON m.object_id = o.object_id WHERE o.object_type = 'Stored Procedure'""",
    ),
)
def parse_counters(c):
    return metrics.parse_counters(c.objects, c.metadata)
