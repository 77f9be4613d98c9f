"""Reading, shaping and writing catalog snapshots."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadline.functions import names
from threadline.sources.contracts import (
    OPTIONAL_KINDS,
    REQUIRED_KINDS,
    SCHEMAS,
    conform,
    detect_table_kind,
    empty,
    validate_kinds,
)

# System schemas left out of a scan.
SYSTEM_SCHEMAS = ("sys", "information_schema", "tempdb", "master", "msdb", "model", "guest")

# Request commands that carry no statement, and the request log limits.
IDLE_COMMANDS = ("AWAITING COMMAND", "SLEEP_TASK", "WAITFOR")
USER_SESSION_ABOVE = 50
REQUEST_LIMIT = 5000


def list_children(spark: SparkSession, folder: str) -> list[str]:
    """Paths directly below a folder on any file system Spark can read."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    names_found = [str(s.getPath().toString()) for s in fs.listStatus(path)]
    return sorted(p for p in names_found if not p.rsplit("/", 1)[-1].startswith(("_", ".")))


def detect_snapshot(spark: SparkSession, folder: str) -> tuple[dict[str, list[str]], DataFrame]:
    """Paths by table kind, recognised from column names, and contract messages.

    Only schemas are read. A file without columns is recognised by its name. Several files of one
    kind belong together; all of them are listed.
    """
    paths: dict[str, list[str]] = {}
    found: list[str | None] = []
    for path in list_children(spark, folder):
        columns = spark.read.parquet(path).columns
        kind = detect_table_kind(columns)
        if kind is None and not columns:
            stem = path.rsplit("/", 1)[-1].lower()
            kind = next((k for k in (*REQUIRED_KINDS, *OPTIONAL_KINDS) if k in stem), None)
        found.append(kind)
        if kind is not None:
            paths.setdefault(kind, []).append(path)
    return paths, validate_kinds(spark, found)


def load_snapshot(spark: SparkSession, paths: dict[str, str | list[str]]) -> dict[str, DataFrame]:
    """The five snapshot tables in contract shape; absent optional tables are empty.

    Each file is brought into shape by itself, so files of a kind may differ in optional columns.
    """
    missing = [k for k in REQUIRED_KINDS if k not in paths]
    if missing:
        raise ValueError(f"snapshot lacks required tables: {', '.join(missing)}")

    def read(kind: str) -> DataFrame:
        files = paths.get(kind, [])
        parts = [conform(spark.read.parquet(p), kind) for p in ([files] if isinstance(files, str) else files)]
        return reduce(DataFrame.unionByName, parts) if parts else empty(spark, kind)

    tables = {kind: read(kind) for kind in (*REQUIRED_KINDS, *OPTIONAL_KINDS)}
    tables["table_columns"] = attach_object_id(tables["table_columns"], tables["objects"])
    return tables


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(table_name, row_count) of every table."""
    counts = [df.agg(F.count("*").alias("row_count")).select(F.lit(name).alias("table_name"), "row_count") for name, df in tables.items()]
    return reduce(DataFrame.unionByName, counts)


def attach_object_id(columns: DataFrame, objects: DataFrame) -> DataFrame:
    """Columns with ``correct_object_id`` looked up by schema and table name, since stored ids go stale."""
    tables = (
        objects.where("object_type = 'Table'")
        .groupBy("schema_name", F.col("object_name").alias("table_name"))
        .agg(F.min("object_id").alias("correct_object_id"))
    )
    return columns.join(tables, ["schema_name", "table_name"], "left")


def exclude_schemas(df: DataFrame, schemas: tuple[str, ...] = SYSTEM_SCHEMAS, column: str = "schema_name") -> DataFrame:
    return df.where(~F.lower(column).isin(*[s.lower() for s in schemas]))


def table_profile(objects: DataFrame, columns: DataFrame) -> DataFrame:
    """Every table with its number of columns and a ``name:type`` list in column order.

    ``columns`` carry ``correct_object_id``. The list is as long as the table is wide, which the
    source systems bound.
    """
    pairs = F.concat_ws(":", "column_name", "data_type")
    per_table = columns.groupBy(F.col("correct_object_id").alias("object_id")).agg(
        F.count_distinct("column_id").alias("column_count"),
        F.array_join(
            F.transform(F.sort_array(F.collect_list(F.struct("column_id", pairs.alias("pair")))), lambda x: x["pair"]), ", "
        ).alias("columns"),
    )
    return (
        objects.where("object_type = 'Table'")
        .select("object_id", "schema_name", "object_name")
        .join(per_table, "object_id", "left")
        .select("object_id", "schema_name", "object_name", F.coalesce("column_count", F.lit(0)).alias("column_count"), "columns")
    )


def recent_requests(
    logs: DataFrame,
    n: int = REQUEST_LIMIT,
    idle: tuple[str, ...] = IDLE_COMMANDS,
    tie_break: list[str] | None = None,
) -> DataFrame:
    """The latest user statements: no system sessions, no idle commands, newest first."""
    kept = logs.where((F.col("session_id") > USER_SESSION_ABOVE) & ~F.col("command").isin(*idle) & F.col("command_text").isNotNull())
    return kept.orderBy(F.desc("start_time"), *(tie_break or [])).limit(n)


def native_dependencies(dependencies: DataFrame, objects: DataFrame) -> DataFrame:
    """Dependencies with the names of both ends; the referencing object must exist."""
    side = lambda prefix: objects.select(
        F.col("object_id").alias(f"{prefix}_object_id"),
        F.col("schema_name").alias(f"{prefix}_schema"),
        F.col("object_name").alias(f"{prefix}_object"),
        F.col("object_type").alias(f"{prefix}_type"),
    )
    pairs = dependencies.select("referencing_object_id", "referenced_object_id")
    return pairs.join(side("referencing"), "referencing_object_id").join(side("referenced"), "referenced_object_id", "left")


def union_objects(
    procedures: DataFrame, tables: DataFrame, views: DataFrame, functions: DataFrame | None = None, now: Column | None = None
) -> DataFrame:
    """One object table from per-kind lists (schema_name, object_name, object_id?, modify_date?).

    Kind is a constant; a missing date becomes the current time, a missing id a stable key.
    """
    kinds = [(procedures, "Stored Procedure"), (tables, "Table"), (views, "View"), (functions, "Function")]
    stamp = F.localtimestamp() if now is None else now
    parts = []
    for df, kind in kinds:
        if df is None:
            continue
        number = F.col("object_id").try_cast("bigint") if "object_id" in df.columns else F.lit(None).cast("bigint")
        date = F.col("modify_date").cast("timestamp_ntz") if "modify_date" in df.columns else F.lit(None).cast("timestamp_ntz")
        parts.append(
            df.select(
                F.coalesce(number, names.object_key(F.col("schema_name"), F.col("object_name"))).alias("object_id"),
                "schema_name",
                "object_name",
                F.lit(kind).alias("object_type"),
                F.coalesce(date, stamp).alias("modify_date"),
            )
        )
    return reduce(DataFrame.unionByName, parts)


def union_definitions(*sources: DataFrame) -> DataFrame:
    """(object_id, definition) of all sources with text."""
    parts = [df.select("object_id", "definition").where(F.trim("definition") != "") for df in sources]
    return reduce(DataFrame.unionByName, parts)


def write_snapshot(tables: dict[str, DataFrame], folder: str) -> dict[str, str]:
    """Each table to ``folder/<kind>`` as Parquet (snappy).

    Empty optional tables are skipped; required tables are written even if empty, so that the
    snapshot can be loaded.
    """
    paths = {}
    for kind, df in tables.items():
        if kind in OPTIONAL_KINDS and df.isEmpty():
            continue
        fields = [c for c in SCHEMAS[kind].names if c in df.columns] if kind in SCHEMAS else df.columns
        paths[kind] = f"{folder.rstrip('/')}/{kind}"
        df.select(*fields).write.option("compression", "snappy").parquet(paths[kind])
    return paths


def export_definitions(definitions: DataFrame, objects: DataFrame, folder: str) -> None:
    """Procedure texts as text files below ``schema_name=…``, each headed by ``-- [schema].[name]``.

    Every task appends what it holds to its own files, so a schema with most of the objects is
    written by all tasks and the number of files does not grow with the number of objects.
    """
    named = objects.where("object_type = 'Stored Procedure'").select("object_id", "schema_name", "object_name")
    header = F.concat(F.lit("-- ["), "schema_name", F.lit("].["), "object_name", F.lit("]\n"))
    (
        definitions.join(named, "object_id")
        .select("schema_name", F.concat(header, "definition").alias("value"))
        .write.partitionBy("schema_name")
        .text(folder)
    )


def colliding_keys(objects: DataFrame) -> DataFrame:
    """(key, names) of surrogate keys that more than one name has; names differ in more than case."""
    full = F.struct(F.lower("schema_name").alias("schema_name"), F.lower("object_name").alias("object_name"))
    key = names.object_key(F.col("schema_name"), F.col("object_name"))
    return objects.groupBy(key.alias("key")).agg(F.count_distinct(full).alias("names")).where("names > 1")
