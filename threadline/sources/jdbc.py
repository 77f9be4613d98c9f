"""Catalog scan of a live SQL Server family database over JDBC."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadline.functions import names
from threadline.sources.contracts import SCHEMAS, conform
from threadline.sources.snapshot import SYSTEM_SCHEMAS


def _no_system(column: str) -> str:
    listed = ", ".join(f"'{s}'" for s in SYSTEM_SCHEMAS)
    return f"LOWER({column}) NOT IN ({listed})"


def catalog_queries() -> dict[str, str]:
    """One query per snapshot table against the system catalog views."""
    objects = f"""
SELECT so.object_id, SCHEMA_NAME(so.schema_id) AS schema_name, so.name AS object_name,
       RTRIM(so.type) AS type_code, so.create_date, so.modify_date
FROM sys.objects AS so
WHERE RTRIM(so.type) IN ('U', 'V', 'P', 'FN', 'IF', 'TF', 'FS', 'FT') AND {_no_system('SCHEMA_NAME(so.schema_id)')}"""
    definitions = f"""
SELECT sm.object_id, sm.definition
FROM sys.sql_modules AS sm
WHERE {_no_system('OBJECT_SCHEMA_NAME(sm.object_id)')}"""
    dependencies = f"""
SELECT sed.referencing_id AS referencing_object_id, sed.referenced_id AS referenced_object_id,
       COALESCE(OBJECT_SCHEMA_NAME(sed.referenced_id), sed.referenced_schema_name) AS referenced_schema_name,
       COALESCE(OBJECT_NAME(sed.referenced_id), sed.referenced_entity_name) AS referenced_entity_name
FROM sys.sql_expression_dependencies AS sed
WHERE {_no_system('OBJECT_SCHEMA_NAME(sed.referencing_id)')}"""
    columns = f"""
SELECT sc.object_id, OBJECT_SCHEMA_NAME(sc.object_id) AS schema_name, OBJECT_NAME(sc.object_id) AS table_name,
       sc.name AS column_name, TYPE_NAME(sc.user_type_id) AS data_type, sc.max_length, sc.precision, sc.scale,
       sc.is_nullable, sc.column_id
FROM sys.columns AS sc
WHERE OBJECTPROPERTY(sc.object_id, 'IsUserTable') = 1 AND {_no_system('OBJECT_SCHEMA_NAME(sc.object_id)')}"""
    requests = """
SELECT er.session_id, er.start_time, er.command, st.text AS command_text
FROM sys.dm_exec_requests AS er CROSS APPLY sys.dm_exec_sql_text(er.sql_handle) AS st"""
    return {
        "objects": objects.strip(),
        "definitions": definitions.strip(),
        "dependencies": dependencies.strip(),
        "table_columns": columns.strip(),
        "query_logs": requests.strip(),
    }


def jdbc_options(
    url: str,
    query: str,
    partition_column: str | None = None,
    bounds: tuple[int, int] | None = None,
    partitions: int = 1,
    fetch_size: int = 10_000,
    **properties: str,
) -> dict[str, str]:
    """Reader options; with a partition column the scan is split into ranges of it."""
    options = {"url": url, "fetchsize": str(fetch_size), **properties}
    if partition_column is None:
        options["query"] = query
        return options
    if bounds is None:
        raise ValueError("a partitioned scan needs bounds")
    options.update(
        dbtable=f"({query}) AS part",
        partitionColumn=partition_column,
        lowerBound=str(bounds[0]),
        upperBound=str(bounds[1]),
        numPartitions=str(partitions),
    )
    return options


# Columns the large scans may be split on.
SPLIT_ON = {"definitions": "object_id", "table_columns": "object_id", "dependencies": "referencing_object_id"}


def read_catalog_jdbc(
    spark: SparkSession,
    url: str,
    queries: dict[str, str] | None = None,
    bounds: tuple[int, int] | None = None,
    partitions: int = 1,
    **properties: str,
) -> dict[str, DataFrame]:
    """Lazy snapshot tables of all catalog queries; big ones are split when ``bounds`` are given."""
    tables = {}
    for kind, query in (queries or catalog_queries()).items():
        column = SPLIT_ON.get(kind) if bounds else None
        options = jdbc_options(url, query, column, bounds, partitions, **properties)
        tables[kind] = in_contract_shape(kind, spark.read.format("jdbc").options(**options).load())
    return tables


def in_contract_shape(kind: str, rows: DataFrame) -> DataFrame:
    """Rows of a catalog query as a snapshot table: type codes become type names."""
    if "type_code" in rows.columns:
        rows = rows.withColumn("object_type", names.object_type_name(F.col("type_code"))).drop("type_code")
    return conform(rows, kind) if kind in SCHEMAS else rows
