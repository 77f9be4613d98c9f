"""Change detection and maintenance of the state tables.

State lives in plain files without in-place updates: every function returns the new content,
which callers write to a new folder (see ``threadline.plans.refresh``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OBJECT_FIELDS = ("object_id", "schema_name", "object_name", "object_type", "modify_date")


def objects_to_parse(
    objects: DataFrame, metadata: DataFrame | None, full_refresh: bool = False, ordered: bool = True
) -> DataFrame:
    """Objects never parsed, changed since, or failed; all of them on a full refresh.

    An unknown date on either side does not count as changed.
    """
    chosen = objects.select(*OBJECT_FIELDS)
    if metadata is not None and not full_refresh:
        seen = metadata.select(
            F.col("object_id"), F.col("last_parsed_modify_date").alias("_date"), F.col("parse_success").alias("_ok"), F.lit(True).alias("_seen")
        )
        chosen = (
            chosen.join(seen, "object_id", "left")
            .where("_seen IS NULL OR modify_date > _date OR NOT _ok")
            .select(*OBJECT_FIELDS)
        )
    return chosen.orderBy("schema_name", "object_name") if ordered else chosen


def needs_parse(objects: DataFrame, metadata: DataFrame, force: bool = False) -> DataFrame:
    """(object_id, needs_parse) for every object.

    True without a recorded parse date, when forced, or when the object changed after it.
    """
    seen = metadata.select("object_id", F.col("last_parsed_modify_date").alias("_date"))
    flag = F.lit(True) if force else F.col("_date").isNull() | F.coalesce(F.col("modify_date") > F.col("_date"), F.lit(False))
    return objects.select("object_id", "modify_date").join(seen, "object_id", "left").select("object_id", flag.alias("needs_parse"))


def definition_hashes(definitions: DataFrame) -> DataFrame:
    return definitions.select("object_id", F.sha2("definition", 256).alias("definition_hash"))


def snapshot_diff(previous: DataFrame, current: DataFrame) -> DataFrame:
    """(object_id, status): new, updated, unchanged or removed, by hash of the text.

    Only ids and hashes are shuffled, never the texts.
    """
    old = definition_hashes(previous).withColumnRenamed("definition_hash", "old_hash")
    new = definition_hashes(current).withColumnRenamed("definition_hash", "new_hash")
    joined = old.withColumn("_old", F.lit(True)).join(new.withColumn("_new", F.lit(True)), "object_id", "full")
    status = (
        F.when(F.col("_old").isNull(), "new")
        .when(F.col("_new").isNull(), "removed")
        .when(F.equal_null("old_hash", "new_hash"), "unchanged")
        .otherwise("updated")
    )
    return joined.select("object_id", status.alias("status"))


def diff_counts(diff: DataFrame) -> DataFrame:
    return diff.groupBy("status").agg(F.count("*").alias("objects"))


def drop_orphans(metadata: DataFrame, objects: DataFrame) -> DataFrame:
    """State rows whose object still exists."""
    return metadata.join(objects.select("object_id"), "object_id", "left_semi")


def orphans(metadata: DataFrame, objects: DataFrame) -> DataFrame:
    return metadata.join(objects.select("object_id"), "object_id", "left_anti")


def drop_orphan_edges(edges: DataFrame, objects: DataFrame) -> DataFrame:
    """Edges whose both ends still exist."""
    ids = objects.select("object_id")
    kept = edges.join(ids.withColumnRenamed("object_id", "source_id"), "source_id", "left_semi")
    return kept.join(ids.withColumnRenamed("object_id", "target_id"), "target_id", "left_semi").select(*edges.columns)


STATE_FIELDS = ("last_parsed_modify_date", "last_parsed_at", "parse_failure_reason", "expected_count", "found_count")


def merge_metadata(old: DataFrame, new: DataFrame) -> DataFrame:
    """State after a run.

    Objects not in ``new`` keep their row. Otherwise dates, counts and reason come from the new
    row; source and success too if it is the parser's, or if it succeeded where the old one had
    not - else the old ones stay.
    """
    fields = [f for f in STATE_FIELDS if f in new.columns]
    left = old.select("object_id", F.struct(*fields, "primary_source", "parse_success").alias("o"))
    right = new.select("object_id", F.struct(*fields, "primary_source", "parse_success").alias("n"))
    joined = left.join(right, "object_id", "full")
    truth = lambda c: F.coalesce(F.col(c), F.lit(False))
    take_new = (
        F.col("o").isNull()
        | F.coalesce(F.col("n.primary_source").isin("parser", "parser_with_hints"), F.lit(False))
        | (truth("n.parse_success") & ~truth("o.parse_success"))
    ) & F.col("n").isNotNull()
    return joined.select(
        "object_id",
        *[F.when(F.col("n").isNotNull(), F.col(f"n.{f}")).otherwise(F.col(f"o.{f}")).alias(f) for f in fields],
        *[F.when(take_new, F.col(f"n.{f}")).otherwise(F.col(f"o.{f}")).alias(f) for f in ("primary_source", "parse_success")],
    )


def merge_edges(old: DataFrame, new: DataFrame, owners: DataFrame) -> DataFrame:
    """Edges after a run.

    Edges owned by an object of ``owners`` (those the parser just re-read) are replaced; all
    others are kept and new ones added. Ownership makes the result independent of parse order.
    """
    fields = ["source_id", "target_id", "owner_id", "edge_type"]
    kept = old.select(*fields).join(owners.select("owner_id").distinct(), "owner_id", "left_anti").select(*fields)
    return kept.unionByName(new.select(*fields)).dropDuplicates(["source_id", "target_id", "owner_id"])


def dedupe_edges(edges: DataFrame) -> DataFrame:
    """One row per (source, target, edge type), owners dropped."""
    return edges.select("source_id", "target_id", "edge_type").distinct()
