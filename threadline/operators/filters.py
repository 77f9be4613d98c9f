"""Filters, lookups and visible subsets of a node table.

Nodes carry at least (id, name, schema, object_type, data_model_type), one row per node; edges
(source_id, target_id).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadline.functions import names
from threadline.operators.graph import node_edges

# Interface limits.
VISIBLE_NODES = 1000
SUGGEST_MIN_CHARS = 5
SUGGEST_RESULTS = 5


def edge_ends(edges: DataFrame) -> DataFrame:
    """Distinct ids at either end; merged map-side, so hubs cost one row per task."""
    return edges.select(F.explode(F.array("source_id", "target_id")).alias("id")).distinct()


def drop_isolated(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes with at least one edge to a known node."""
    ends = edge_ends(node_edges(edges, nodes))
    return nodes.join(ends, "id", "left_semi")


def facet_condition(
    schemas: list[str] | None = None, object_types: list[str] | None = None, model_types: list[str] | None = None
) -> Column:
    """Schema in the list; object type and model type in theirs or NULL. ``None`` means no filter."""
    keep = F.lit(True)
    if schemas is not None:
        keep = keep & F.col("schema").isin(*schemas)
    if object_types is not None:
        keep = keep & (F.col("object_type").isNull() | F.col("object_type").isin(*object_types))
    if model_types is not None:
        keep = keep & (F.col("data_model_type").isNull() | F.col("data_model_type").isin(*model_types))
    return keep


def filter_nodes(
    nodes: DataFrame,
    schemas: list[str] | None = None,
    object_types: list[str] | None = None,
    model_types: list[str] | None = None,
    exclude: list[str] | None = None,
    traced: DataFrame | None = None,
) -> DataFrame:
    """Facet filter, exclusion patterns and an optional trace result, all together."""
    kept = nodes.where(facet_condition(schemas, object_types, model_types) & ~names.matches_any(F.col("name"), exclude or []))
    if traced is not None:
        kept = kept.join(traced.select("id").distinct(), "id", "left_semi")
    return kept


def exclude_patterns(nodes: DataFrame, patterns: list[str]) -> DataFrame:
    return nodes.where(~names.matches_any(F.col("name"), patterns))


def neighbours(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Distinct ids one edge away from ``ids`` in either direction."""
    keys = ids.select(F.col("id").alias("_id"))
    out = edges.join(keys, F.col("source_id") == F.col("_id"), "left_semi").select(F.col("target_id").alias("id"))
    into = edges.join(keys, F.col("target_id") == F.col("_id"), "left_semi").select(F.col("source_id").alias("id"))
    return out.unionByName(into).distinct()


def neighbourhood(nodes: DataFrame, edges: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, status): highlighted, neighbour or dimmed."""
    near = neighbours(edges, ids).withColumn("_near", F.lit(True))
    chosen = ids.select("id").distinct().withColumn("_chosen", F.lit(True))
    status = F.when(F.col("_chosen"), "highlighted").when(F.col("_near"), "neighbour").otherwise("dimmed")
    return nodes.join(chosen, "id", "left").join(near, "id", "left").select("id", status.alias("status"))


def top_nodes(nodes: DataFrame, edges: DataFrame, highlighted: DataFrame, k: int = VISIBLE_NODES) -> DataFrame:
    """At most ``k`` nodes: highlighted ones and their neighbours, then procedures, functions, others.

    Highlighted nodes and neighbours are never cut; the others fill what is left, by id.
    """
    near = neighbours(edges, highlighted).unionByName(highlighted.select("id")).distinct()
    must = nodes.join(near, "id", "left_semi").withColumn("priority", F.lit(0))
    rank = F.when(F.col("object_type") == "Stored Procedure", 1).when(F.col("object_type") == "Function", 2).otherwise(3)
    rest = nodes.join(near, "id", "left_anti").withColumn("priority", rank)
    # At most k rows survive the top-k, so numbering them in one task is bounded.
    best = rest.orderBy("priority", "id").limit(k)
    numbered = best.withColumn("_n", F.expr("row_number() OVER (ORDER BY priority, id)"))
    room = F.lit(k) - must.agg(F.count("*")).scalar()
    return must.unionByName(numbered.where(F.col("_n") <= room).drop("_n"))


def visible_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges between visible nodes; of a two-way pair only source < target stays, flagged."""
    inside = node_edges(edges, nodes).select("source_id", "target_id").distinct()
    low, high = F.least("source_id", "target_id"), F.greatest("source_id", "target_id")
    loops = inside.where("source_id = target_id").withColumn("is_bidirectional", F.lit(False))
    ways = (
        inside.where("source_id <> target_id")
        .groupBy(low.alias("a"), high.alias("b"))
        .agg(F.count("*").alias("n"), F.min("source_id").alias("first"))
    )
    one = F.when(F.col("n") == 2, F.col("a")).otherwise(F.col("first"))
    pairs = ways.select(
        one.alias("source_id"),
        F.when(one == F.col("a"), F.col("b")).otherwise(F.col("a")).alias("target_id"),
        (F.col("n") == 2).alias("is_bidirectional"),
    )
    return pairs.unionByName(loops)


def find_node(nodes: DataFrame, name: str, schema: str | None = None) -> DataFrame:
    """The node of a name (case-insensitive), the smallest id if several."""
    hit = nodes.where(F.lower("name") == name.lower())
    if schema is not None:
        hit = hit.where(F.lower("schema") == schema.lower())
    return hit.orderBy("id").limit(1)


def suggest(
    nodes: DataFrame,
    term: str,
    k: int = SUGGEST_RESULTS,
    min_chars: int = SUGGEST_MIN_CHARS,
    **facet_filters: list[str] | None,
) -> DataFrame:
    """Names starting with the term, then names containing it, by id; nothing for short terms."""
    needle = term.strip().lower()
    if len(needle) < max(min_chars, 1):
        return nodes.limit(0)
    name = F.lower("name")
    rank = F.when(name.startswith(needle), 0).when(F.contains(name, F.lit(needle)), 1)
    return (
        nodes.where(facet_condition(**facet_filters))
        .withColumn("_rank", rank)
        .where("_rank IS NOT NULL")
        .orderBy("_rank", "id")
        .limit(k)
        .drop("_rank")
    )


def snapshot_info(nodes: DataFrame) -> DataFrame:
    return nodes.agg(
        F.count("*").alias("node_count"),
        F.count_distinct("schema").alias("schema_count"),
        F.count_distinct("object_type").alias("object_type_count"),
    )


def type_counts(objects: DataFrame) -> DataFrame:
    """Objects per type, with the plural label."""
    return objects.groupBy("object_type").agg(F.count("*").alias("objects")).select(
        "object_type", names.plural_type_name(F.col("object_type")).alias("label"), "objects"
    )
