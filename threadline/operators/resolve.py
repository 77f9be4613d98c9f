"""Catalog lookups: names to objects, hints, merged references, parse results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadline.functions import text
from threadline.operators.extract import extract_refs, hint_rows, read_references
from threadline.operators.rules import DEFAULT_RULES, Rule
from threadline.session import write_stage
from threadline.sources.contracts import FUNCTION_TYPES

def _kind_of_type(object_type: Column) -> Column:
    return (
        F.when(object_type.isin("Table", "View"), "table")
        .when(object_type == "Stored Procedure", "procedure")
        .when(object_type.isin(*FUNCTION_TYPES), "function")
    )


def _kind_of_role(role: Column) -> Column:
    return F.when(role == "sp_call", "procedure").when(role == "function", "function").otherwise("table")


def catalog_names(objects: DataFrame, with_hints: bool = False) -> DataFrame:
    """One row per (kind, lower-cased full name): the smallest object id and its spelling.

    Hints may name tables, views and procedures alike; these have the extra kind ``hint``.
    """
    full = F.concat_ws(".", "schema_name", "object_name")
    own = _kind_of_type(F.col("object_type"))
    kinds = F.array(own, F.when(own.isin("table", "procedure"), "hint")) if with_hints else F.array(own)
    return (
        objects.select(F.explode(F.array_compact(kinds)).alias("kind"), "object_id", full.alias("full_name"))
        .groupBy("kind", F.lower("full_name").alias("name_key"))
        .agg(F.min(F.struct("object_id", "full_name")).alias("hit"))
        .select("kind", "name_key", F.col("hit.object_id").alias("ref_id"), F.col("hit.full_name").alias("full_name"))
    )


def resolve_ids(refs: DataFrame, objects: DataFrame) -> DataFrame:
    """Every reference with ``ref_id`` / ``full_name`` of its object, NULL when unknown.

    One case-insensitive lookup serves tables and views, procedures and functions: the role
    decides which kind may match. The lookup side is unique per key, so a name that a large
    share of all texts mentions only skews the left side, which the adaptive join splits.
    """
    keyed = refs.withColumn("kind", _kind_of_role(F.col("role"))).withColumn("name_key", F.lower("name"))
    return keyed.join(catalog_names(objects), ["kind", "name_key"], "left").drop("kind", "name_key")


def validate_refs(refs: DataFrame, objects: DataFrame, keep_created: bool = True, id_col: str = "object_id") -> DataFrame:
    """References that exist in the catalog, in catalog spelling.

    With ``keep_created`` a table a statement creates stays, as a name without id.
    """
    found = resolve_ids(refs, objects)
    known = F.col("ref_id").isNotNull()
    created = F.col("skip_catalog") & (F.col("role") == "target")
    dummy = F.lower("name").startswith("dummy.")
    kept = found.where((known | created if keep_created else known) & ~dummy)
    # Spellings that differ in case only meet here.
    return kept.groupBy(id_col, "role", F.coalesce("full_name", "name").alias("name")).agg(
        F.min("ref_id").alias("ref_id"), F.bool_and(~known).alias("name_only")
    )


def lookup_names(names_df: DataFrame, objects: DataFrame, default_schema: str = "dbo") -> DataFrame:
    """(name, object_id): exact lookup of ``schema.name``, a bare name in the default schema."""
    dotted = F.contains(F.col("name"), F.lit("."))
    full = F.when(dotted, F.col("name")).otherwise(F.concat(F.lit(default_schema + "."), F.col("name")))
    catalog = objects.groupBy(F.concat_ws(".", "schema_name", "object_name").alias("full_name")).agg(
        F.min("object_id").alias("object_id")
    )
    return (
        names_df.select("name", full.alias("full_name"))
        .distinct()
        .join(catalog, "full_name", "left")
        .select("name", "object_id")
    )


def extract_hints(definitions: DataFrame, id_col: str = "object_id", text_col: str = "definition") -> DataFrame:
    """Names in hint comments of the raw text: id, role, name."""
    return definitions.select(id_col, F.explode(hint_rows(F.col(text_col))).alias("h")).select(id_col, "h.role", "h.name")


def check_hints(hints: DataFrame, objects: DataFrame) -> DataFrame:
    """All hints with the catalog object they name, NULL when unknown."""
    catalog = catalog_names(objects, with_hints=True).where("kind = 'hint'").drop("kind")
    return hints.withColumn("name_key", F.lower("name")).join(catalog, "name_key", "left").drop("name_key")


def validate_hints(hints: DataFrame, objects: DataFrame, id_col: str = "object_id") -> DataFrame:
    """Hints that name a table, view or procedure, in catalog spelling."""
    return (
        check_hints(hints, objects)
        .where("ref_id IS NOT NULL")
        .select(id_col, "role", F.col("full_name").alias("name"), "ref_id")
        .distinct()
    )


def hint_stats(definitions: DataFrame, objects: DataFrame, id_col: str = "object_id") -> DataFrame:
    checked = check_hints(extract_hints(definitions, id_col), objects)
    known = F.col("ref_id").isNotNull()
    return checked.groupBy(id_col).agg(
        F.count("*").alias("total_hints"),
        F.count_if(F.col("role") == "source").alias("input_hints"),
        F.count_if(F.col("role") == "target").alias("output_hints"),
        F.count_if(known).alias("valid_hints"),
        F.count_if(~known).alias("invalid_hints"),
    )


def merge_hints(refs: DataFrame, hints: DataFrame, mode: str = "union", id_col: str = "object_id") -> DataFrame:
    """Validated references and hints together.

    Columns: id, role, name, ref_id, name_only, and where a row came from: from_text, from_hint.

    ``union`` adds hints to what was found; ``replace`` drops the found references of a
    direction (role) for every object that has hints in it.
    """
    hinted = hints.select(
        id_col,
        "role",
        "name",
        "ref_id",
        F.lit(False).alias("name_only"),
        F.lit(False).alias("from_text"),
        F.lit(True).alias("from_hint"),
    )
    found = refs.withColumns({"from_text": F.lit(True), "from_hint": F.lit(False)})
    if mode == "replace":
        found = found.join(hints.select(id_col, "role").distinct(), [id_col, "role"], "left_anti")
    elif mode != "union":
        raise ValueError(f"unknown mode: {mode}")
    return (
        found.unionByName(hinted)
        .groupBy(id_col, "role", "name")
        .agg(
            F.min("ref_id").alias("ref_id"),
            F.min("name_only").alias("name_only"),
            F.max("from_text").alias("from_text"),
            F.max("from_hint").alias("from_hint"),
        )
    )


def self_references(refs: DataFrame, id_col: str = "object_id") -> DataFrame:
    """Tables an object both reads and writes."""
    return (
        refs.where(F.col("role").isin("source", "target"))
        .groupBy(id_col, "name")
        .agg(F.bool_or(F.col("role") == "source").alias("_r"), F.bool_or(F.col("role") == "target").alias("_w"))
        .where("_r AND _w")
        .select(id_col, "name")
    )


def resolve_definitions(
    definitions: DataFrame,
    objects: DataFrame,
    rules: tuple[Rule, ...] = DEFAULT_RULES,
    dialect: str = "tsql",
    hint_mode: str = "union",
    keep_created: bool = True,
    default_schema: str | None = "dbo",
    read: DataFrame | None = None,
) -> DataFrame:
    """Text to validated references, hints merged in: the result of :func:`merge_hints`.

    References and hints come from one scan of the texts and meet the catalog in one lookup. ``read`` may
    pass in :func:`read_references` of the same texts with the same arguments, if the caller has it.
    """
    rows = read_references(definitions, rules, dialect, default_schema) if read is None else read
    kind = F.when(F.col("from_hint"), "hint").otherwise(_kind_of_role(F.col("role")))
    found = rows.withColumns({"kind": kind, "name_key": F.lower("name")}).join(
        catalog_names(objects, with_hints=True), ["kind", "name_key"], "left"
    )
    known = F.col("ref_id").isNotNull()
    created = F.col("skip_catalog") & (F.col("role") == "target")
    kept = found.where((known | created if keep_created else known) & (F.col("from_hint") | ~F.lower("name").startswith("dummy.")))
    if hint_mode == "replace":
        # A group holds the references of one text only.
        per_object = Window.partitionBy("object_id", "role")
        kept = kept.withColumn("_hinted", F.max("from_hint").over(per_object)).where(F.col("from_hint") | ~F.col("_hinted"))
    elif hint_mode != "union":
        raise ValueError(f"unknown mode: {hint_mode}")
    return kept.groupBy("object_id", "role", F.coalesce("full_name", "name").alias("name")).agg(
        F.min("ref_id").alias("ref_id"),
        F.bool_and(~known).alias("name_only"),
        F.max(~F.col("from_hint")).alias("from_text"),
        F.max("from_hint").alias("from_hint"),
    )


def parse_diagnostics(refs: DataFrame, resolved: DataFrame, id_col: str = "object_id") -> DataFrame:
    """Counts per object.

    ``refs`` are lookups of the extracted names (:func:`resolve_ids`), ``resolved`` the merged
    result. ``expected_tables`` counts catalog tables found in the text, ``found_tables`` those
    of the final result, ``catalog_validation_rate`` the share of distinct extracted table
    names the catalog knows (1.0 when nothing was extracted).
    """
    table = F.col("role").isin("source", "target")
    known = F.col("ref_id").isNotNull()
    key = F.lower("name")
    text_side = refs.groupBy(id_col).agg(
        F.count_distinct(F.when(known & (F.col("role") == "source"), F.col("ref_id"))).alias("regex_sources"),
        F.count_distinct(F.when(known & (F.col("role") == "target"), F.col("ref_id"))).alias("regex_targets"),
        F.count_distinct(F.when(known & (F.col("role") == "sp_call"), F.col("ref_id"))).alias("regex_sp_calls"),
        F.count_distinct(F.when(table, key)).alias("_names"),
        F.count_distinct(F.when(table & known, key)).alias("_known"),
    )
    final_side = resolved.groupBy(id_col).agg(
        F.count_if(F.col("role") == "source").alias("final_sources"),
        F.count_if(F.col("role") == "target").alias("final_targets"),
        F.count_if(table & known).alias("found_tables"),
        F.count_if(F.col("from_hint") & (F.col("role") == "source")).alias("hint_inputs"),
        F.count_if(F.col("from_hint") & (F.col("role") == "target")).alias("hint_outputs"),
    )
    joined = text_side.join(final_side, id_col, "full")
    counts = [c for c in joined.columns if c != id_col]
    return joined.select(
        id_col, *[F.coalesce(c, F.lit(0)).alias(c) for c in counts]
    ).select(
        id_col,
        (F.col("regex_sources") + F.col("regex_targets")).alias("expected_tables"),
        "found_tables",
        "regex_sources",
        "regex_targets",
        "regex_sp_calls",
        "hint_inputs",
        "hint_outputs",
        "final_sources",
        "final_targets",
        F.when(F.col("_names") > 0, F.col("_known") / F.col("_names")).otherwise(F.lit(1.0)).alias("catalog_validation_rate"),
    )


def parse_definitions(
    objects: DataFrame,
    definitions: DataFrame,
    rules: tuple[Rule, ...] = DEFAULT_RULES,
    dialect: str = "tsql",
    object_types: tuple[str, ...] = ("Stored Procedure",),
    hint_mode: str = "union",
    resolved: DataFrame | None = None,
    catalog: DataFrame | None = None,
    reasons: bool = False,
) -> DataFrame:
    """One result row per object of the given types.

    Objects without text get ``parse_success`` false and an error. With ``reasons`` the column
    ``failure_reason`` says what else of a text cannot be followed (NULL if nothing, or if hints say
    what it reads and writes); comments and string literals do not count. ``catalog`` is the full object
    list when ``objects`` is only the part to parse; ``resolved`` may pass in references already
    computed for the same objects.
    """
    catalog = objects if catalog is None else catalog
    wanted = objects.where(F.col("object_type").isin(*object_types)).select("object_id", "modify_date")
    # Texts stay where they are: only a flag and the short references are joined.
    code = text.mask_literals(text.strip_comments(F.col("definition")))
    # A column of its own, so that the text is cleaned once and not for every pattern.
    coded = definitions.select("object_id", (F.length("definition") > 0).alias("_text"), *([code.alias("_code")] if reasons else []))
    if reasons:
        coded = coded.withColumn("_lowered", F.lower("_code"))
    flags = coded.select("object_id", "_text", *([failure_patterns(F.col("_code"), F.col("_lowered")).alias("_patterns")] if reasons else []))
    texts = wanted.join(flags, "object_id", "left").withColumn("has_text", F.coalesce("_text", F.lit(False)))
    if resolved is None:
        resolved = resolve_definitions(definitions, catalog, rules, dialect, hint_mode)
    table = F.col("role").isin("source", "target")
    known = F.col("ref_id").isNotNull()
    per_object = resolved.groupBy("object_id").agg(
        F.count_if(known & F.col("role").isin("source", "function")).alias("input_count"),
        F.count_if(known & F.col("role").isin("target", "sp_call")).alias("output_count"),
        F.count_if(known & table & F.col("from_text")).alias("expected_count"),
        F.count_if(known & table).alias("found_count"),
        F.bool_or("from_hint").alias("has_hints"),
    )
    zero = F.lit(0)
    return (
        texts.select("object_id", "modify_date", "has_text", *(["_patterns"] if reasons else []))
        .join(per_object, "object_id", "left")
        .select(
            "object_id",
            "modify_date",
            F.when(F.coalesce("has_hints", F.lit(False)), "parser_with_hints").otherwise("parser").alias("source"),
            F.col("has_text").alias("parse_success"),
            F.when(~F.col("has_text"), "No DDL definition found").alias("parse_error"),
            F.coalesce("input_count", zero).alias("input_count"),
            F.coalesce("output_count", zero).alias("output_count"),
            F.coalesce("expected_count", zero).alias("expected_count"),
            F.coalesce("found_count", zero).alias("found_count"),
            *([_reason_of_row().alias("failure_reason")] if reasons else []),
        )
    )


def _reason_of_row() -> Column:
    counts = (F.coalesce("expected_count", F.lit(0)), F.coalesce("found_count", F.lit(0)))
    told = (F.size("_patterns") > 0) & ~F.coalesce("has_hints", F.lit(False))
    return F.when(told, reason_text(F.col("_patterns"), F.lit(None).cast("string"), *counts))


# Reasons reported for text that pattern matching cannot follow.
REASON_EXEC_VARIABLE = "Dynamic SQL: EXEC(@variable) - table names unknown at parse time"
REASON_EXECUTESQL = "Dynamic SQL: sp_executesql @variable - table names unknown at parse time"
REASON_CONCAT = "Dynamic SQL: String concatenation detected"
REASON_WHILE = "WHILE loop: Iterative logic not supported by parser"
REASON_CURSOR = "CURSOR: Row-by-row processing not supported by parser"
REASON_OTHER = "Complex T-SQL patterns"
ADVICE = "→ Add @LINEAGE_INPUTS/@LINEAGE_OUTPUTS comment hints to document dependencies"


def failure_patterns(sql: Column, lowered: Column | None = None) -> Column:
    """What pattern matching cannot follow in a text: an array of reasons, empty if there is nothing.

    A text is searched only for patterns whose word it has, or has often enough. ``lowered`` may be the
    same text in lower case, where the caller has it.
    """
    lowered = F.lower(sql) if lowered is None else lowered
    has = lambda *words: text.holds(sql, words, lowered)

    def count(word: str, pattern: str, least: int) -> Column:
        often = F.length(lowered) - F.length(F.replace(lowered, F.lit(word), F.lit(""))) >= least * len(word)
        return F.when(often, F.regexp_count(sql, F.lit(pattern))).otherwise(0)

    begins = count("begin", r"(?i)(?=B)\bBEGIN\b", 5)
    cases = count("case", r"(?i)(?=C)\bCASE\b", 10)
    ctes = count("with", r"(?i)(?=W)\bWITH\s+\w+\s+AS\s*\(", 10)
    exec_variable = has("exec") & sql.rlike(r"(?i)(?=E)EXEC\s*\(\s*@\w+\s*\)")
    executesql = has("sp_executesql") & sql.rlike(r"(?i)(?=S)sp_executesql\s+@\w+")
    # A variable, then its type, then a keyword; each step looks only behind the first hit of the one before.
    declared = F.regexp_extract(F.regexp_extract(sql, r"(?is)DECLARE\s+@\w+(.*+)", 1), r"(?is)NVARCHAR(.*+)", 1)
    concat = has("declare") & has("nvarchar") & declared.rlike(r"(?i)(?=[ISUDF])(?:INSERT|SELECT|UPDATE|DELETE|FROM)")
    return F.array_compact(
        F.array(
            F.when(exec_variable, REASON_EXEC_VARIABLE),
            F.when(executesql, REASON_EXECUTESQL),
            F.when(concat & ~exec_variable & ~executesql, REASON_CONCAT),
            F.when(begins >= 5, F.format_string("Deep nesting: %d BEGIN/END blocks (limit: 4)", begins)),
            F.when(has("while") & sql.rlike(r"(?i)(?=W)\bWHILE\b"), REASON_WHILE),
            F.when(has("cursor") & sql.rlike(r"(?i)(?=C)\bCURSOR\b"), REASON_CURSOR),
            F.when(cases >= 10, F.format_string("Complex CASE logic: %d CASE statements (limit: 9)", cases)),
            F.when(ctes >= 10, F.format_string("Multiple CTEs: %d WITH clauses (limit: 9)", ctes)),
        )
    )


def reason_text(reasons: Column, error: Column, expected: Column, found: Column) -> Column:
    """The reasons as one text, with counts of tables and advice."""
    fallback = F.when(error != "", F.concat(F.lit("Parse error: "), F.substring(error, 1, 100))).otherwise(REASON_OTHER)
    main = F.when(F.size(reasons) > 0, F.array_join(reasons, " | ")).otherwise(fallback)
    missing = expected - found
    counts = F.when(
        (expected > 0) & (found >= 0) & (missing > 2),
        F.format_string("Expected %d tables, found %d (%d missing)", expected, found, missing),
    )
    return F.concat_ws(" | ", main, counts, F.lit(ADVICE))


def failure_reason(
    sql: Column, parse_error: Column | None = None, expected: Column | None = None, found: Column | None = None
) -> Column:
    """Why a text cannot be followed, with advice."""
    error = F.lit(None).cast("string") if parse_error is None else parse_error
    expected = F.lit(0) if expected is None else expected
    found = F.lit(0) if found is None else found
    return reason_text(failure_patterns(sql), error, expected, found)


def distinct_commands(logs: DataFrame) -> DataFrame:
    """Distinct data-moving statements of a query log."""
    return _commands(logs).select("command_text")


def _commands(logs: DataFrame) -> DataFrame:
    """(command_id, command_text) of the distinct statements; a 128-bit hash stands for the text in keys."""
    moving = logs.where(F.col("command_text").rlike(r"(?i)^\s*(SELECT|INSERT|UPDATE|DELETE|MERGE|TRUNCATE|WITH|EXEC|EXECUTE)\b"))
    return moving.groupBy(F.md5("command_text").alias("command_id")).agg(F.any_value("command_text").alias("command_text"))


def validate_with_logs(logs: DataFrame, edges: DataFrame, objects: DataFrame) -> DataFrame:
    """References of logged statements and whether the lineage knows the table in that role.

    A read is confirmed when some edge leaves the table, a write when some edge enters it.
    """
    commands = write_stage(_commands(logs), "commands")
    refs = extract_refs(commands, id_col="command_id", text_col="command_text")
    found = validate_refs(refs, objects, keep_created=False, id_col="command_id").where(
        F.col("role").isin("source", "target")
    )
    ends = edges.select(
        F.explode(
            F.array(
                F.struct(F.lit("source").alias("role"), F.col("source_id").alias("ref_id")),
                F.struct(F.lit("target").alias("role"), F.col("target_id").alias("ref_id")),
            )
        ).alias("e")
    ).select("e.role", "e.ref_id").distinct().withColumn("confirmed", F.lit(True))
    confirmed = found.join(ends, ["role", "ref_id"], "left")
    return confirmed.join(commands, "command_id").select(
        "command_text", "role", "name", "ref_id", F.coalesce("confirmed", F.lit(False)).alias("confirmed")
    )
