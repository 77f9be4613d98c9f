"""Table contracts of a catalog snapshot: schemas, recognition, validation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_LONG, _STR, _INT = T.LongType(), T.StringType(), T.IntegerType()
_BOOL, _TS = T.BooleanType(), T.TimestampNTZType()


def _schema(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


SCHEMAS: dict[str, T.StructType] = {
    "objects": _schema(
        object_id=_LONG, schema_name=_STR, object_name=_STR, object_type=_STR, create_date=_TS, modify_date=_TS
    ),
    "definitions": _schema(object_id=_LONG, definition=_STR),
    "dependencies": _schema(
        referencing_object_id=_LONG,
        referenced_object_id=_LONG,
        referenced_schema_name=_STR,
        referenced_entity_name=_STR,
    ),
    "query_logs": _schema(command_text=_STR),
    "table_columns": _schema(
        object_id=_LONG,
        schema_name=_STR,
        table_name=_STR,
        column_name=_STR,
        data_type=_STR,
        max_length=_INT,
        precision=_INT,
        scale=_INT,
        is_nullable=_BOOL,
        column_id=_INT,
    ),
    "lineage_metadata": _schema(
        object_id=_LONG,
        last_parsed_modify_date=_TS,
        last_parsed_at=_TS,
        primary_source=_STR,
        parse_success=_BOOL,
        parse_failure_reason=_STR,
        expected_count=_INT,
        found_count=_INT,
    ),
    "lineage_edges": _schema(source_id=_LONG, target_id=_LONG, owner_id=_LONG, edge_type=_STR),
}

# Columns a table must have to be recognised; checked in this order, first match wins.
RECOGNISED_BY: dict[str, frozenset[str]] = {
    "definitions": frozenset({"object_id", "definition"}),
    "dependencies": frozenset(
        {"referencing_object_id", "referenced_object_id", "referenced_schema_name", "referenced_entity_name"}
    ),
    "table_columns": frozenset({"schema_name", "table_name", "column_name", "data_type"}),
    "objects": frozenset({"object_id", "schema_name", "object_name", "object_type"}),
    "query_logs": frozenset({"command_text"}),
}

REQUIRED_KINDS = ("objects", "dependencies", "definitions")
OPTIONAL_KINDS = ("query_logs", "table_columns")

# Result columns of the live-database metadata queries.
METADATA_RESULTS: dict[str, frozenset[str]] = {
    "objects_query": frozenset({"database_object_id", "schema_name", "object_name", "object_type"}),
    "definitions_query": frozenset({"database_object_id", "sql_code"}),
}

OBJECT_TYPES = ("Table", "View", "Stored Procedure", "Function", "Synonym", "Type")
NODE_TYPES = ("Table", "View", "Stored Procedure")
FUNCTION_TYPES = ("Function", "Scalar Function", "Table-valued Function")

MESSAGE_SCHEMA = "kind string, level string, message string"


def detect_table_kind(columns: list[str]) -> str | None:
    """Name the table a column list belongs to; ``None`` if it fits no contract."""
    have = {c.lower() for c in columns}
    for kind, needed in RECOGNISED_BY.items():
        if kind == "query_logs":
            if have == needed:
                return kind
        elif needed <= have:
            return kind
    return None


def _missing(columns: list[str], needed: frozenset[str]) -> list[str]:
    have = {c.lower() for c in columns}
    return sorted(needed - have)


def validate_contract(df: DataFrame, kind: str) -> DataFrame:
    """Contract messages for one table, judged on its schema alone (no data is read)."""
    needed = RECOGNISED_BY.get(kind) or METADATA_RESULTS.get(kind)
    rows: list[tuple[str, str, str]] = []
    if needed is None:
        rows.append((kind, "error", f"unknown table kind: {kind}"))
    else:
        gone = _missing(df.columns, needed)
        if gone:
            rows.append((kind, "error", f"missing required columns: {', '.join(gone)}"))
        if kind in SCHEMAS:
            types = {f.name.lower(): f.dataType for f in df.schema.fields}
            for field in SCHEMAS[kind].fields:
                if field.name in types and not _compatible(types[field.name], field.dataType):
                    rows.append(
                        (kind, "warning", f"{field.name}: {types[field.name].simpleString()} cast to {field.dataType.simpleString()}")
                    )
    return df.sparkSession.createDataFrame(rows, MESSAGE_SCHEMA)


def _compatible(have: T.DataType, want: T.DataType) -> bool:
    if isinstance(want, T.IntegralType):
        return isinstance(have, T.IntegralType)
    if isinstance(want, T.TimestampNTZType):
        return isinstance(have, (T.TimestampType, T.TimestampNTZType, T.DateType))
    return type(have) is type(want)


def validate_kinds(spark: SparkSession, found: list[str | None]) -> DataFrame:
    """Messages about a set of recognised files: duplicates, unknown files, missing tables."""
    rows: list[tuple[str, str, str]] = []
    for kind in (*REQUIRED_KINDS, *OPTIONAL_KINDS):
        count = found.count(kind)
        if count > 1:
            rows.append((kind, "warning", f"{count} files match, the last one is used"))
        if count == 0:
            level = "error" if kind in REQUIRED_KINDS else "warning"
            rows.append((kind, level, "no file matches"))
    unknown = found.count(None)
    if unknown:
        rows.append(("unknown", "warning", f"{unknown} files match no contract and are ignored"))
    return spark.createDataFrame(rows, MESSAGE_SCHEMA)


def conform(df: DataFrame, kind: str) -> DataFrame:
    """Contract columns only, lower-cased and cast; absent optional columns become NULL."""
    by_lower = {c.lower(): c for c in df.columns}
    return df.select(
        *[
            (F.col(f"`{by_lower[f.name]}`") if f.name in by_lower else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in SCHEMAS[kind].fields
        ]
    )


def empty(spark: SparkSession, kind: str) -> DataFrame:
    return spark.createDataFrame([], SCHEMAS[kind])


def check_domains(objects: DataFrame, allowed: tuple[str, ...] = OBJECT_TYPES) -> DataFrame:
    """Objects whose id is not a non-negative integer or whose type is unknown."""
    text = F.col("object_id").cast("string")
    whole = text.rlike(r"^-?[0-9]{1,18}$")
    problem = F.array_compact(
        F.array(
            F.when(~F.coalesce(whole, F.lit(False)), "object_id is not an integer").when(
                whole & (text.try_cast("bigint") < 0), "object_id is negative"
            ),
            F.when(~F.coalesce(F.col("object_type").isin(*allowed), F.lit(False)), "object_type is not allowed"),
        )
    )
    return objects.select(
        text.alias("object_id"), "object_type", F.explode(problem).alias("message")
    )
