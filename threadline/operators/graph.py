"""Edges, neighbours, nodes.

Nodes are one row each at every size of the graph. Neighbours are rows of their own
(:func:`neighbours`), so a hub that holds a large share of all edges is never gathered in one
group. Lists (:func:`adjacency`) are made on request, in a number of parts that the caller names
and that holds for every node alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadline.functions import names
from threadline.sources.contracts import NODE_TYPES


def native_edges(dependencies: DataFrame) -> DataFrame:
    """All native dependencies with both ids known."""
    return dependencies.where("referencing_object_id IS NOT NULL AND referenced_object_id IS NOT NULL").select(
        "referencing_object_id", "referenced_object_id", F.lit("dmv").alias("source")
    )


def view_edges(dependencies: DataFrame, objects: DataFrame) -> DataFrame:
    """referenced object → view, for every view's native dependency."""
    views = objects.where("object_type = 'View'").select(F.col("object_id").alias("referencing_object_id"))
    return (
        dependencies.where("referenced_object_id IS NOT NULL")
        .join(views, "referencing_object_id", "left_semi")
        .select(
            F.col("referenced_object_id").alias("source_id"),
            F.col("referencing_object_id").alias("target_id"),
            F.col("referencing_object_id").alias("owner_id"),
            F.lit("dependency").alias("edge_type"),
        )
        .distinct()
    )


def view_metadata(edges: DataFrame, objects: DataFrame) -> DataFrame:
    """State rows of the views that native dependencies describe."""
    owners = edges.select(F.col("owner_id").alias("object_id")).distinct()
    return objects.join(owners, "object_id", "left_semi").select(
        "object_id",
        F.col("modify_date").alias("last_parsed_modify_date"),
        F.lit("dmv").alias("primary_source"),
        F.lit(True).alias("parse_success"),
    )


def parsed_edges(resolved: DataFrame) -> DataFrame:
    """Edges of validated references: what is read points to the object, the object to what it writes or calls."""
    reads = F.col("role").isin("source", "function")
    return (
        resolved.where("ref_id IS NOT NULL")
        .select(
            F.when(reads, F.col("ref_id")).otherwise(F.col("object_id")).alias("source_id"),
            F.when(reads, F.col("object_id")).otherwise(F.col("ref_id")).alias("target_id"),
            F.col("object_id").alias("owner_id"),
            F.lit("dependency").alias("edge_type"),
        )
        .distinct()
    )


def half_edges(edges: DataFrame) -> DataFrame:
    """Every edge seen from both ends: (id, direction, other); ``in`` lists what feeds the id."""
    return edges.select(
        F.explode(
            F.array(
                F.struct(F.col("target_id").alias("id"), F.lit("in").alias("direction"), F.col("source_id").alias("other")),
                F.struct(F.col("source_id").alias("id"), F.lit("out").alias("direction"), F.col("target_id").alias("other")),
            )
        ).alias("h")
    ).select("h.id", "h.direction", "h.other")


def neighbours(edges: DataFrame) -> DataFrame:
    """(id, direction, other, two_way): every neighbour of every edge end once per direction.

    ``two_way`` says that edges lead both ways between two different nodes. One aggregation on the
    pair of ids finds it, so no self join is needed and no key is hot. An edge is one row of it, with
    the smaller id first (or the one that is not null), and is seen from both ends only behind it.
    """
    source, target = F.col("source_id"), F.col("target_id")
    turned = F.coalesce(source > target, source.isNull())
    pairs = edges.select(
        F.when(turned, target).otherwise(source).alias("_low"),
        F.when(turned, source).otherwise(target).alias("_high"),
        F.when(turned, 2).otherwise(1).alias("_way"),
    ).groupBy("_low", "_high").agg(F.bit_or("_way").alias("_ways"))
    loop = F.equal_null("_low", "_high")
    up, down = (loop | (F.col("_ways").bitwiseAND(bit) != 0) for bit in (1, 2))
    two_way = up & down & (F.col("_low") != F.col("_high"))

    def seen(when: Column, at: str, direction: str, other: str) -> Column:
        return F.when(when, F.struct(F.col(at).alias("id"), F.lit(direction).alias("direction"), F.col(other).alias("other"), two_way.alias("two_way")))

    ends = F.array(
        seen(down, "_low", "in", "_high"), seen(up, "_low", "out", "_high"), seen(up & ~loop, "_high", "in", "_low"), seen(down & ~loop, "_high", "out", "_low")
    )
    return pairs.select(F.explode(F.array_compact(ends)).alias("n")).select("n.id", "n.direction", "n.other", "n.two_way")


def adjacency(edges: DataFrame, parts: int) -> DataFrame:
    """(id, part, inputs, outputs, bidirectional_with): sorted neighbour ids of every edge end.

    The lists of every node are cut into ``parts`` by a hash of the neighbour, both directions of
    one neighbour into the same part; a part without neighbours has no row. One part gives whole
    lists and is for graphs whose largest node fits into a task.
    """
    if parts < 1:
        raise ValueError("parts must be at least 1")
    return _lists(neighbours(edges), F.lit(parts))


def _lists(found: DataFrame, parts: Column) -> DataFrame:
    # Dealt as plain rows first: lists that are begun before the exchange have a row for nearly every neighbour too, and a larger one.
    inward = F.col("direction") == "in"
    way = F.when(inward & F.col("two_way"), 3).when(inward, 1).when(F.col("direction") == "out", 2)
    dealt = found.select("id", F.pmod(F.xxhash64("other"), parts).alias("part"), "other", way.alias("_way")).repartition("id", "part")
    pick = lambda *ways: F.sort_array(F.collect_list(F.when(F.col("_way").isin(*ways), F.col("other"))))
    return dealt.groupBy("id", "part").agg(pick(1, 3).alias("inputs"), pick(2).alias("outputs"), pick(3).alias("bidirectional_with"))


#: Lists of up to so many neighbours stay whole where the lists of hubs are cut into parts.
WHOLE_LISTS = 4096


def with_lists(nodes: DataFrame, found: DataFrame, parts: int, whole: int = WHOLE_LISTS) -> DataFrame:
    """Nodes with the lists of their neighbours (``part`` from 0, ``parts``), for formats that need lists.

    Nodes of more than ``whole`` neighbours have ``parts`` rows, all others one. ``found``: neighbours
    as from :func:`neighbours`, with ids as in ``nodes``.
    """
    if parts < 1:
        raise ValueError("parts must be at least 1")
    none = F.array().cast(f"array<{found.schema['other'].dataType.simpleString()}>")
    one = F.lit(1).cast("long")
    # At most one id for every ``whole`` neighbours there are: few enough for every task.
    counted = found.groupBy("id").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > whole)
    hubs = F.broadcast(counted.select("id", F.lit(parts).cast("long").alias("parts")))
    cut = lambda df: df.join(hubs, "id", "left").withColumn("parts", F.coalesce("parts", one)) if parts > 1 else df.withColumn("parts", one)
    rows = cut(nodes).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    return rows.join(_lists(cut(found), F.col("parts")), ["id", "part"], "left").select(
        *nodes.columns, "part", "parts", *[F.coalesce(c, none).alias(c) for c in ("inputs", "outputs", "bidirectional_with")]
    )


def bidirectional_pairs(edges: DataFrame) -> DataFrame:
    """Unordered pairs with an edge in both directions, found by one aggregation on the pair."""
    return (
        edges.where("source_id <> target_id")
        .groupBy(F.least("source_id", "target_id").alias("node_a"), F.greatest("source_id", "target_id").alias("node_b"))
        .agg(F.bool_or(F.expr("source_id < target_id")).alias("_up"), F.bool_or(F.expr("source_id > target_id")).alias("_down"))
        .where("_up AND _down")
        .select("node_a", "node_b")
    )


def degrees(edges: DataFrame) -> DataFrame:
    """(id, input_count, output_count) of every edge end; ``edges`` hold each pair once."""
    return half_edges(edges).groupBy("id").agg(
        F.count_if(F.col("direction") == "in").alias("input_count"),
        F.count_if(F.col("direction") == "out").alias("output_count"),
    )


def metadata_rows(objects: DataFrame, edges: DataFrame) -> DataFrame:
    """Tables and views with the numbers of their writers (inputs) and readers (outputs)."""
    wanted = objects.where(F.col("object_type").isin("Table", "View")).select("object_id")
    counted = neighbour_counts(edges).withColumnRenamed("id", "object_id")
    return wanted.join(counted, "object_id", "left").select(
        "object_id", *_counts("input_count", "output_count"), F.lit("metadata").alias("primary_source")
    )


def neighbour_counts(edges: DataFrame) -> DataFrame:
    """(id, input_count, output_count, two_way_count): distinct neighbours of every edge end."""
    way = F.col("direction")
    return neighbours(edges).groupBy("id").agg(
        F.count_if(way == "in").alias("input_count"),
        F.count_if(way == "out").alias("output_count"),
        F.count_if((way == "in") & F.col("two_way")).alias("two_way_count"),
    )


def _counts(*columns: str) -> list[Column]:
    return [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in columns]


def build_nodes(
    objects: DataFrame,
    edges: DataFrame,
    metadata: DataFrame,
    object_types: tuple[str, ...] = NODE_TYPES,
) -> DataFrame:
    """Nodes with the numbers of their inputs, outputs and two-way partners, and provenance.

    One row per node; :func:`neighbours` has who they are. Objects without state are ``metadata`` (tables, views) or
    ``unparsed`` (procedures, success unknown).
    """
    nodes = objects.where(F.col("object_type").isin(*object_types)).select(
        F.col("object_id").alias("id"), F.col("object_name").alias("name"), F.col("schema_name").alias("schema"), "object_type"
    )
    fields = {"parse_failure_reason": "string", "expected_count": "int", "found_count": "int"}
    state = metadata.select(
        F.col("object_id").alias("id"),
        F.lit(True).alias("_known"),
        F.coalesce("primary_source", F.lit("unknown")).alias("_source"),
        F.col("parse_success").alias("_ok"),
        *[(F.col(f) if f in metadata.columns else F.lit(None)).cast(kind).alias(f"_{f}") for f, kind in fields.items()],
    )
    data_object = F.col("object_type").isin("Table", "View")
    known = F.col("_known").isNotNull()
    source = F.when(known, F.col("_source")).when(data_object, "metadata").otherwise("unparsed")
    success = F.when(known, F.coalesce("_ok", F.lit(True))).when(data_object, F.lit(True))
    return (
        nodes.join(state, "id", "left")
        .join(neighbour_counts(edges), "id", "left")
        .select(
            "id",
            "name",
            "schema",
            "object_type",
            *_counts("input_count", "output_count", "two_way_count"),
            F.struct(
                source.alias("primary_source"), success.alias("parse_success"), *[F.col(f"_{f}").alias(f) for f in fields]
            ).alias("provenance"),
        )
    )


def node_edges(edges: DataFrame, ids: DataFrame, id_col: str = "id") -> DataFrame:
    """Edges with both ends among the ids."""
    keys = ids.select(F.col(id_col).alias("_id"))
    inside = edges.join(keys, F.col("source_id") == F.col("_id"), "left_semi")
    return inside.join(keys, F.col("target_id") == F.col("_id"), "left_semi")


# Wording of node descriptions.
DESCRIPTION_OK = "✅ Parse Success: True"
DESCRIPTION_FAILED = "❌ Parse Failed"
DESCRIPTION_DATA = "Parse Success: True"
DESCRIPTION_UNPARSED = "Not parsed"


def node_description(
    object_type: Column, parse_success: Column, reason: Column, expected: Column, found: Column
) -> Column:
    """Status text of a node; reasons over 80 characters are cut to 77."""
    cut = F.when(F.length(reason) > 80, F.concat(F.substring(reason, 1, 77), F.lit("..."))).otherwise(reason)
    missing = expected - found
    failed = F.concat_ws(
        " ",
        F.lit(DESCRIPTION_FAILED),
        F.when(reason != "", F.concat(F.lit("| "), cut)),
        F.when((expected > 0) & (missing > 0), F.format_string("| %d tables missing - add @LINEAGE hints", missing)),
    )
    return (
        F.when(object_type != "Stored Procedure", DESCRIPTION_DATA)
        .when(parse_success, DESCRIPTION_OK)
        .when(parse_success.isNull(), DESCRIPTION_UNPARSED)
        .otherwise(failed)
    )


def frontend_nodes(
    objects: DataFrame,
    edges: DataFrame,
    metadata: DataFrame,
    ddl: DataFrame | None = None,
    model_rules=names.MODEL_RULES,
) -> DataFrame:
    """Nodes for display, one row each: string ids, neighbours outside the node set not counted.

    :func:`frontend_neighbours` has the neighbours. ``ddl`` (object_id, ddl_text) adds the text; without it the column is absent.
    """
    shown = objects.where(F.col("object_type").isin(*NODE_TYPES))
    inner = node_edges(edges, shown, "object_id")
    nodes = build_nodes(shown, inner, metadata)
    p = "provenance."
    out = nodes.select(
        F.col("id").cast("string").alias("id"),
        "name",
        "schema",
        "object_type",
        node_description(
            F.col("object_type"),
            F.col(p + "parse_success"),
            F.col(p + "parse_failure_reason"),
            F.col(p + "expected_count"),
            F.col(p + "found_count"),
        ).alias("description"),
        names.classify_model(F.col("name"), F.col("object_type"), model_rules).alias("data_model_type"),
        names.node_symbol(F.col("object_type")).alias("node_symbol"),
        "input_count",
        "output_count",
        "two_way_count",
        F.col(p + "parse_success").alias("parse_success"),
    )
    if ddl is None:
        return out
    texts = ddl.select(F.col("object_id").cast("string").alias("id"), "ddl_text")
    return out.join(texts, "id", "left")


def frontend_neighbours(objects: DataFrame, edges: DataFrame) -> DataFrame:
    """Neighbours of the displayed nodes with string ids: (id, direction, other, two_way)."""
    shown = objects.where(F.col("object_type").isin(*NODE_TYPES))
    found = neighbours(node_edges(edges, shown, "object_id"))
    text = lambda c: F.col(c).cast("string").alias(c)
    return found.select(text("id"), "direction", text("other"), "two_way")


def edges_from_nodes(nodes: DataFrame, found: DataFrame) -> DataFrame:
    """Edges that the neighbours of nodes imply, each once, both ends being nodes."""
    inward = F.col("direction") == "in"
    listed = found.select(
        F.when(inward, F.col("other")).otherwise(F.col("id")).alias("source_id"),
        F.when(inward, F.col("id")).otherwise(F.col("other")).alias("target_id"),
    ).distinct()
    return node_edges(listed, nodes)


def facets(nodes: DataFrame, text: str | None = None) -> DataFrame:
    """(facet, value): the distinct schemas, object types and model types, optionally filtered by text."""
    values = nodes.select(
        F.explode(
            F.array(
                F.struct(F.lit("schema").alias("facet"), F.col("schema").alias("value")),
                F.struct(F.lit("object_type").alias("facet"), F.col("object_type").alias("value")),
                F.struct(F.lit("data_model_type").alias("facet"), F.col("data_model_type").alias("value")),
            )
        ).alias("f")
    ).select("f.facet", "f.value").where("value IS NOT NULL").distinct()
    if text:
        values = values.where(F.contains(F.lower("value"), F.lit(text.lower())))
    return values.orderBy("facet", "value")
