"""Dynamic SQL: texts that a text builds and executes.

Executed are the literals and concatenations in ``EXEC ('...')`` and after ``sp_executesql``, and those
assigned to a variable that one of the two executes. The pieces of a concatenation are put together, a
variable between them stands as its name, which no rule takes for a table. The texts found are a second
level: the same rules read them, and the edges they give are marked ``dynamic``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadline.functions import text
from threadline.operators import graph
from threadline.operators.extract import extract_refs
from threadline.operators.resolve import validate_refs
from threadline.operators.rules import DEFAULT_RULES, Rule

EDGE_TYPE = "dynamic"

# Token patterns: a literal with doubled quotes, one operand, and operands joined by plus signs.
_LITERAL = r"N?'(?:[^']++|'')*+'"
_OPERAND = rf"(?:{_LITERAL}|@\w++|(?:QUOTENAME|CAST|CONVERT|STR|LTRIM|RTRIM)\s*+\([^()]*+\))"
_BUILT = rf"{_OPERAND}(?:\s*+\+\s*+{_OPERAND})*+"
EXECUTED = rf"(?i)\bEXEC(?:UTE)?\s*+\(\s*+({_BUILT})\s*+\)"
EXECUTESQL = rf"(?i)\bsp_executesql\s++(?:@(?:stmt|statement)\s*+=\s*+)?({_BUILT})"
ASSIGNED = rf"(?i)(@\w++)(?:\s++N?VARCHAR\s*+\([^()]*+\))?\s*+\+?=\s*+({_BUILT})"


def _operands(expression: Column) -> Column:
    return F.regexp_extract_all(expression, F.lit(rf"(?i){_OPERAND}"), F.lit(0))


def built_text(expression: Column) -> Column:
    """The text of a concatenation; variables stand as their names, values of functions as ``@value``."""

    def said(operand: Column) -> Column:
        literal = F.replace(F.regexp_extract(operand, "(?is)^N?'(.*)'$", 1), F.lit("''"), F.lit("'"))
        return F.when(operand.rlike("(?i)^N?'"), literal).when(operand.startswith("@"), operand).otherwise(F.lit("@value"))

    return F.array_join(F.transform(_operands(expression), said), "")


def executed_texts(sql: Column) -> Column:
    """The texts that a text executes; lone variables without an assignment are left out."""
    code = text.strip_comments(sql)
    found = lambda pattern, group: F.regexp_extract_all(code, F.lit(pattern), F.lit(group))
    executed = F.concat(found(EXECUTED, 1), found(EXECUTESQL, 1))
    pairs = F.zip_with(found(ASSIGNED, 1), found(ASSIGNED, 2), lambda v, e: F.struct(F.lower(v).alias("v"), e.alias("e")))

    def all_of(seen: Column) -> Column:
        own = F.transform(F.flatten(F.transform(seen["executed"], _operands)), lambda o: F.lower(o))
        assigned = F.transform(F.filter(seen["pairs"], lambda p: F.array_contains(own, p["v"])), lambda p: p["e"])
        built = F.filter(F.concat(seen["executed"], assigned), lambda e: F.contains(e, F.lit("'")))
        return F.transform(built, built_text)

    # Bound to a variable, so that nothing is searched for again for every assignment.
    texts = F.flatten(F.transform(F.array(F.struct(executed.alias("executed"), pairs.alias("pairs"))), all_of))
    concerned = sql.rlike(r"(?i)\bEXEC(?:UTE)?\s*\(|\bsp_executesql\b")
    return F.when(concerned, texts).otherwise(F.array().cast("array<string>"))


def dynamic_texts(definitions: DataFrame, id_col: str = "object_id", text_col: str = "definition") -> DataFrame:
    """(id, definition): one row for every text that a text executes."""
    return definitions.select(id_col, F.explode(executed_texts(F.col(text_col))).alias("definition")).where("definition <> ''")


def dynamic_refs(
    definitions: DataFrame, rules: tuple[Rule, ...] = DEFAULT_RULES, dialect: str = "tsql", default_schema: str | None = "dbo"
) -> DataFrame:
    """Distinct references of executed texts: object_id, role, name, skip_catalog."""
    refs = extract_refs(dynamic_texts(definitions), rules, dialect, default_schema)
    return refs.groupBy("object_id", "role", "name").agg(F.max("skip_catalog").alias("skip_catalog"))


def dynamic_edges(
    definitions: DataFrame, objects: DataFrame, rules: tuple[Rule, ...] = DEFAULT_RULES, dialect: str = "tsql"
) -> DataFrame:
    """Edges of executed texts to objects of the catalog, marked ``dynamic``."""
    known = validate_refs(dynamic_refs(definitions, rules, dialect), objects, keep_created=False)
    return graph.parsed_edges(known).withColumn("edge_type", F.lit(EDGE_TYPE))


def with_dynamic(
    edges: DataFrame, definitions: DataFrame, objects: DataFrame, rules: tuple[Rule, ...] = DEFAULT_RULES, dialect: str = "tsql"
) -> DataFrame:
    """Edges and those of executed texts; one that both give is none of the second level."""
    columns = ("source_id", "target_id", "owner_id", "edge_type")
    every = edges.select(*columns).unionByName(dynamic_edges(definitions, objects, rules, dialect).select(*columns))
    return every.groupBy("source_id", "target_id", "owner_id").agg(F.min("edge_type").alias("edge_type"))
