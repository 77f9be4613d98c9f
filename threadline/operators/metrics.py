"""Coverage, dependency, isolation and gap metrics; every scope in one pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadline.operators.filters import edge_ends
from threadline.sources.contracts import NODE_TYPES


def _rate(part: Column, total: Column, digits: int) -> Column:
    return F.when(total > 0, F.round(part / total * 100, digits)).otherwise(F.lit(0.0))


def _scope() -> Column:
    return F.when(F.grouping("object_type") == 1, "ALL").otherwise(F.col("object_type"))


def parse_metrics(objects: DataFrame, metadata: DataFrame) -> DataFrame:
    """Parse counts and rates, one row per object type and one for ALL."""
    state = metadata.select("object_id", "parse_success", "primary_source")
    counts = (
        objects.select("object_id", "object_type")
        .join(state, "object_id", "left")
        .rollup("object_type")
        .agg(
            _scope().alias("scope"),
            F.count("*").alias("total"),
            F.count("parse_success").alias("parsed"),
            F.count_if(F.col("parse_success")).alias("success_count"),
            F.count_if(F.col("primary_source") == "parser").alias("by_parser"),
            F.count_if(F.col("primary_source") == "dmv").alias("by_dmv"),
            F.count_if(F.col("primary_source") == "metadata").alias("by_metadata"),
        )
    )
    return counts.select(
        "scope",
        "total",
        "parsed",
        _rate(F.col("parsed"), F.col("total"), 1).alias("parse_rate"),
        "success_count",
        _rate(F.col("success_count"), F.col("total"), 1).alias("success_pct"),
        "by_parser",
        "by_dmv",
        "by_metadata",
    )


def success_block(metrics: DataFrame) -> DataFrame:
    """(scope, total, success_count, success_pct) of parse metrics."""
    return metrics.select("scope", "total", "success_count", "success_pct")


def parse_counters(objects: DataFrame, metadata: DataFrame, object_type: str = "Stored Procedure") -> DataFrame:
    """Live counters of a run: total, success, failed."""
    state = metadata.select("object_id", "parse_success")
    return (
        objects.where(F.col("object_type") == object_type)
        .select("object_id")
        .join(state, "object_id", "left")
        .agg(
            F.count("*").alias("total"),
            F.count_if(F.col("parse_success")).alias("success"),
            F.count_if(~F.col("parse_success")).alias("failed"),
        )
    )


DEPENDENCY_KINDS = {
    "sp_to_sp": ("Stored Procedure", "Stored Procedure"),
    "sp_to_table": ("Stored Procedure", "Table"),
    "sp_to_view": ("Stored Procedure", "View"),
    "view_to_table": ("View", "Table"),
    "view_to_view": ("View", "View"),
}


def dependency_metrics(dependencies: DataFrame, objects: DataFrame) -> DataFrame:
    """Native dependencies by the types of both ends.

    Dependencies are first counted per pair, so repeated rows and hot objects shrink map-side
    before the lookups.
    """
    pairs = (
        dependencies.where("referencing_object_id IS NOT NULL AND referenced_object_id IS NOT NULL")
        .groupBy("referencing_object_id", "referenced_object_id")
        .agg(F.count("*").alias("n"))
    )
    kinds = objects.select("object_id", "object_type")
    typed = pairs.join(
        kinds.select(F.col("object_id").alias("referencing_object_id"), F.col("object_type").alias("t1")), "referencing_object_id"
    ).join(kinds.select(F.col("object_id").alias("referenced_object_id"), F.col("object_type").alias("t2")), "referenced_object_id")
    sums = [
        F.coalesce(F.sum(F.when((F.col("t1") == a) & (F.col("t2") == b), F.col("n"))), F.lit(0)).alias(name)
        for name, (a, b) in DEPENDENCY_KINDS.items()
    ]
    return typed.agg(*sums, F.coalesce(F.sum("n"), F.lit(0)).alias("total"))


def isolation_metrics(objects: DataFrame, dependencies: DataFrame, strict_not_in: bool = False) -> DataFrame:
    """Objects in no native dependency, per type and in total, with their share of all objects.

    ``strict_not_in`` keeps the SQL rule that one NULL id makes ``NOT IN`` match nothing.
    """
    ids = dependencies.select(F.explode(F.array("referencing_object_id", "referenced_object_id")).alias("object_id")).distinct()
    flagged = objects.select("object_id", "object_type").join(
        ids.where("object_id IS NOT NULL").withColumn("_used", F.lit(True)), "object_id", "left"
    )
    alone = F.col("_used").isNull()
    if strict_not_in:
        alone = alone & ~F.coalesce(ids.agg(F.bool_or(F.col("object_id").isNull())).scalar(), F.lit(False))
    counts = flagged.rollup("object_type").agg(
        _scope().alias("scope"), F.count("*").alias("total"), F.count_if(alone).alias("isolated")
    )
    return counts.select("scope", "total", "isolated", _rate(F.col("isolated"), F.col("total"), 1).alias("isolation_rate"))


def all_metrics(objects: DataFrame, metadata: DataFrame, dependencies: DataFrame) -> DataFrame:
    """(section, scope, metric, value): parse, dependency and isolation metrics in tall form."""
    return (
        _tall(parse_metrics(objects, metadata), "parse", ["scope"])
        .unionByName(_tall(dependency_metrics(dependencies, objects).withColumn("scope", F.lit("ALL")), "dependencies", ["scope"]))
        .unionByName(_tall(isolation_metrics(objects, dependencies), "isolation", ["scope"]))
    )


def _tall(wide: DataFrame, section: str, keys: list[str]) -> DataFrame:
    values = [c for c in wide.columns if c not in keys]
    pairs = F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in values])
    return wide.select(*keys, F.explode(pairs).alias("p")).select(F.lit(section).alias("section"), *keys, "p.metric", "p.value")


def _gap_flags(objects: DataFrame, metadata: DataFrame, edges: DataFrame) -> DataFrame:
    """Objects with two flags: has_metadata, has_deps."""
    state = metadata.select("object_id").distinct().withColumn("_state", F.lit(True))
    ends = edge_ends(edges.where("edge_type = 'dependency'")).select(F.col("id").alias("object_id"), F.lit(True).alias("_edge"))
    return (
        objects.join(state, "object_id", "left")
        .join(ends, "object_id", "left")
        .withColumns({"has_metadata": F.col("_state").isNotNull(), "has_deps": F.col("_edge").isNotNull()})
        .drop("_state", "_edge")
    )


def gaps(
    objects: DataFrame, metadata: DataFrame, edges: DataFrame, object_type: str | None = "Stored Procedure", ordered: bool = True
) -> DataFrame:
    """Objects never parsed or without any edge."""
    chosen = objects if object_type is None else objects.where(F.col("object_type") == object_type)
    found = (
        _gap_flags(chosen, metadata, edges)
        .where("NOT has_metadata OR NOT has_deps")
        .select("object_id", "schema_name", "object_name", "object_type", "modify_date")
    )
    return found.orderBy("schema_name", "object_name") if ordered else found


def gap_stats(objects: DataFrame, metadata: DataFrame, edges: DataFrame) -> DataFrame:
    """Gap counts overall (scope ALL) and per object type."""
    counts = (
        _gap_flags(objects.select("object_id", "object_type"), metadata, edges)
        .rollup("object_type")
        .agg(
            _scope().alias("scope"),
            F.count("*").alias("total_objects"),
            F.count_if("has_metadata").alias("parsed_objects"),
            F.count_if(~F.col("has_metadata")).alias("unparsed_objects"),
            F.count_if(F.col("has_metadata") & ~F.col("has_deps")).alias("empty_dependencies"),
        )
        .drop("object_type")
    )
    total_gaps = F.col("unparsed_objects") + F.col("empty_dependencies")
    return counts.select(
        "*", total_gaps.alias("total_gaps"), _rate(total_gaps, F.col("total_objects"), 2).alias("gap_percentage")
    )


def gap_stats_by_type(stats: DataFrame) -> DataFrame:
    """The per-type rows of gap statistics, largest type first."""
    return stats.where("scope <> 'ALL'").orderBy(F.desc("total_objects"), "scope")


def source_breakdown(metadata: DataFrame) -> DataFrame:
    return metadata.groupBy("primary_source").agg(
        F.count("*").alias("objects"),
        F.avg(F.when(F.col("parse_success"), 1.0).otherwise(0.0)).alias("avg_success_rate"),
    )


def coverage(objects: DataFrame, metadata: DataFrame) -> DataFrame:
    """Tables, views and procedures: total, parsed and coverage, per type and ALL."""
    state = metadata.select("object_id").distinct().withColumn("_state", F.lit(True))
    counts = (
        objects.where(F.col("object_type").isin(*NODE_TYPES))
        .select("object_id", "object_type")
        .join(state, "object_id", "left")
        .rollup("object_type")
        .agg(_scope().alias("scope"), F.count("*").alias("total"), F.count("_state").alias("parsed"))
    )
    return counts.select("scope", "total", "parsed", _rate(F.col("parsed"), F.col("total"), 1).alias("coverage"))


def source_distribution(metadata: DataFrame) -> DataFrame:
    return metadata.groupBy(F.coalesce("primary_source", F.lit("unknown")).alias("primary_source")).agg(
        F.count_distinct("object_id").alias("objects")
    )
