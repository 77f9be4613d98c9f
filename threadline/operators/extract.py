"""Table references from SQL text.

One narrow projection per text: clean, match every rule, resolve aliases, drop names that do
not persist, and only then explode. Nothing is shuffled before the catalog lookup.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadline.functions import names, text
from threadline.operators.rules import DEFAULT_RULES, Rule, active, apply_rule, java_pattern
from threadline.session import spread_scans

# Schemas never reported as lineage.
EXCLUDED_SCHEMAS = ("sys", "information_schema", "tempdb", "master", "msdb", "model")

# Words that follow a keyword in SQL but are never a table or an alias.
RESERVED = (
    "as", "begin", "cross", "default", "distinct", "end", "exec", "execute", "for", "from", "full", "group", "having",
    "inner", "into", "join", "left", "matched", "not", "on", "option", "order", "outer", "output", "right", "select",
    "set", "statistics", "table", "then", "top", "union", "using", "values", "when", "where", "with",
)

# Between the fields of a reference written as text, and how created and plain targets begin.
SEPARATOR = "\x1f"
CREATED = f"target{SEPARATOR}true{SEPARATOR}"
PLAIN = f"target{SEPARATOR}false{SEPARATOR}"

# Patterns of names that live only inside one procedure, and of table aliases.
CTE = r"(?i)(?=W)\bWITH\s+(\w+)\s+AS\s*\("
NEXT_CTE = r"(?i),\s*(\w+)\s+AS\s*\("
TEMP_TABLE = r"(#\w+)"
TABLE_VARIABLE = r"(?i)(?=D)\bDECLARE\s+@(\w+)\s+TABLE\b"
# The table and its alias in one group, from the table's first character to the alias's last.
ALIAS = r"(?i)(?=[FJ])\b(?:FROM|JOIN)\s+(?=([^\s,;()]+\s+(?:AS\s+)?\w+\b))"

# Hint comment patterns, read from the uncleaned text.
HINT_MARK = r"(?i)@LINEAGE_(?:IN|OUT)PUTS:"
HINT_INPUTS = r"(?imd)--\s*@LINEAGE_INPUTS:\s*(.+?)(?:\n|$)"
HINT_OUTPUTS = r"(?imd)--\s*@LINEAGE_OUTPUTS:\s*(.+?)(?:\n|$)"


def _all(sql: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract_all(sql, F.lit(pattern), F.lit(group))


def _where_held(sql: Column, needs: tuple[str, ...], found: Column, lowered: Column | None = None) -> Column:
    """What was found in texts with one of ``needs``, nothing in others; NULL stays NULL."""
    return F.when(text.holds(sql, needs, lowered) | sql.isNull(), found).otherwise(F.array().cast("array<string>"))


def _hint_names(sql: Column, pattern: str) -> Column:
    items = F.flatten(F.transform(_all(sql, pattern, 1), lambda h: F.split(h, ",")))
    # Blanks around names and dots go with the brackets; more than two parts are no name.
    bare = F.transform(items, lambda item: F.regexp_replace(F.translate(item, "[]", ""), r"^\s+|\s+$|\s*(\.)\s*", "$1"))
    named = F.filter(bare, lambda item: (item != "") & ~item.rlike(r"\..*\."))
    return F.array_distinct(
        F.transform(named, lambda item: F.when(F.contains(item, F.lit(".")), item).otherwise(F.concat(F.lit("dbo."), item)))
    )


def hint_rows(sql: Column) -> Column:
    """(role, name) of the hint comments of a raw text; a single name gets the schema ``dbo``."""

    def rows(pattern: str, role: str) -> Column:
        return F.transform(_hint_names(sql, pattern), lambda n: F.struct(F.lit(role).alias("role"), n.alias("name")))

    none = F.array().cast("array<struct<role:string,name:string>>")
    return F.when(sql.rlike(HINT_MARK), F.concat(rows(HINT_INPUTS, "source"), rows(HINT_OUTPUTS, "target"))).otherwise(none)


def non_persistent(sql: Column, lowered: Column | None = None) -> Column:
    """Lower-cased names of CTEs, temp tables and table variables in a text."""
    found = F.array_union(
        F.array_union(_where_held(sql, ("with",), _all(sql, CTE, 1), lowered), _all(sql, NEXT_CTE, 1)),
        F.array_union(
            _where_held(sql, ("#",), _all(sql, TEMP_TABLE, 1)), _where_held(sql, ("declare",), _all(sql, TABLE_VARIABLE, 1), lowered)
        ),
    )
    return F.array_distinct(F.transform(found, lambda n: F.lower(n)))


def _first_of(found: Column, others: Column) -> Column:
    """Matches of a group, those of another where it is empty; the other is sought only if one is."""
    chosen = lambda seen: F.zip_with(seen, others, lambda a, b: F.when(a != "", a).otherwise(b))
    return text.bound(found, lambda seen: F.when(F.array_contains(seen, ""), chosen(seen)).otherwise(seen))


def rule_matches(sql: Column, rule: Rule, lowered: Column | None = None) -> Column:
    """Raw identifiers a rule finds, in text order."""
    pattern = java_pattern(rule.pattern, rule.starts)
    first, *others = rule.chosen_groups
    found = _all(sql, pattern, first)
    for group in others:
        found = _first_of(found, _all(sql, pattern, group))
    return _where_held(sql, rule.needs, found, lowered) if rule.needs else found


def clean_text(
    sql: Column,
    rules: tuple[Rule, ...] = DEFAULT_RULES,
    dialect: str = "tsql",
    simplify: bool = True,
    first_transaction: bool = False,
) -> Column:
    for rule in active(rules, dialect, "cleaning"):
        sql = apply_rule(sql, rule)
    return text.from_lists(text.normalise_sql(sql, simplify, first_transaction))


def raw_references(
    definitions: DataFrame,
    rules: tuple[Rule, ...] = DEFAULT_RULES,
    dialect: str = "tsql",
    id_col: str = "object_id",
    text_col: str = "definition",
    cleaned: bool = False,
) -> DataFrame:
    """Every match of every extraction rule: id, rule, role, pos, raw."""
    sql = F.col(text_col) if cleaned else clean_text(F.col(text_col), rules, dialect)
    found = definitions.select(F.col(id_col), sql.alias("_sql"))
    matches = F.flatten(F.array(*[_tagged(F.col("_sql"), r) for r in active(rules, dialect, "extraction")]))
    return found.select(id_col, F.explode(matches).alias("m")).select(id_col, "m.rule", "m.role", "m.pos", "m.raw")


def _tagged(sql: Column, rule: Rule) -> Column:
    return F.transform(
        rule_matches(sql, rule),
        lambda raw, i: F.struct(
            F.lit(rule.name).alias("rule"),
            F.lit(rule.extraction_target).alias("role"),
            i.alias("pos"),
            F.lit(rule.skip_catalog_validation).alias("skip_catalog"),
            raw.alias("raw"),
        ),
    )


def extract_refs(
    definitions: DataFrame,
    rules: tuple[Rule, ...] = DEFAULT_RULES,
    dialect: str = "tsql",
    default_schema: str | None = "dbo",
    excluded: tuple[str, ...] = EXCLUDED_SCHEMAS,
    only_safe: bool = False,
    simplify: bool = True,
    id_col: str = "object_id",
    text_col: str = "definition",
    first_transaction: bool = False,
    read: DataFrame | None = None,
) -> DataFrame:
    """Distinct references per text: id, role, name (``schema.name``), skip_catalog.

    ``skip_catalog`` is true when a rule that creates tables found the name. An alias that is a
    reserved word counts as no alias. ``first_transaction`` reads no further than the first commit.
    ``read`` may pass in :func:`read_references` of the same texts with the same arguments, if the caller has it.
    """
    if read is not None:
        return read.where(~F.col("from_hint")).drop("from_hint")
    stage = _cleaned(definitions, rules, dialect, simplify, id_col, text_col, first_transaction=first_transaction).select(
        id_col, _reference_keys(F.col("_sql"), F.col("_lowered"), rules, dialect, default_schema, excluded, only_safe).alias("_keys")
    )
    return _explode_keys(stage, _prefer_created(F.col("_keys")), id_col).drop("from_hint")


def read_references(
    definitions: DataFrame,
    rules: tuple[Rule, ...] = DEFAULT_RULES,
    dialect: str = "tsql",
    default_schema: str | None = "dbo",
    excluded: tuple[str, ...] = EXCLUDED_SCHEMAS,
    id_col: str = "object_id",
    text_col: str = "definition",
) -> DataFrame:
    """References and hints of every text in one scan: the columns of :func:`extract_refs` and from_hint."""
    hints = F.transform(hint_rows(F.col(text_col)), lambda h: F.concat_ws(SEPARATOR, h["role"], F.lit("hint"), h["name"]))
    stage = _cleaned(definitions, rules, dialect, True, id_col, text_col, hints.alias("_hints")).select(
        id_col, _reference_keys(F.col("_sql"), F.col("_lowered"), rules, dialect, default_schema, excluded).alias("_keys"), "_hints"
    )
    return _explode_keys(stage, F.concat(_prefer_created(F.col("_keys")), "_hints"), id_col)


def _cleaned(
    definitions: DataFrame,
    rules: tuple[Rule, ...],
    dialect: str,
    simplify: bool,
    id_col: str,
    text_col: str,
    *more: Column,
    first_transaction: bool = False,
) -> DataFrame:
    spread_scans(definitions.sparkSession)
    extra = ["_hints"] if more else []
    stage = definitions.where(F.col(text_col).isNotNull()).select(
        F.col(id_col), clean_text(F.col(text_col), rules, dialect, simplify, first_transaction).alias("_sql"), *more
    )
    plain = stage.select(id_col, text.unquote_identifiers(F.col("_sql"), RESERVED).alias("_sql"), *extra)
    return plain.select("*", F.lower("_sql").alias("_lowered"))


def _reference_keys(
    sql: Column,
    lowered: Column,
    rules: tuple[Rule, ...],
    dialect: str,
    default_schema: str | None,
    excluded: tuple[str, ...],
    only_safe: bool = False,
) -> Column:
    """Distinct texts of role, skip_catalog and name of a cleaned text."""
    # What all matches of a text share is bound to one lambda variable. A plain column would be
    # inlined into the inner lambdas and computed again for every match.
    shared = F.struct(
        F.flatten(F.array(*[_named(sql, same, lowered) for same in _alike(active(rules, dialect, "extraction"))])).alias("matches"),
        non_persistent(sql, lowered).alias("local"),
        F.transform(_all(sql, ALIAS, 1), lambda a: F.split(a, r"\s+")).alias("pairs"),
    )

    def with_aliases(found: Column) -> Column:
        return F.struct(
            found["matches"].alias("matches"),
            found["local"].alias("local"),
            F.transform(found["pairs"], lambda p: F.lower(F.element_at(p, -1))).alias("aliases"),
            F.transform(found["pairs"], lambda p: F.element_at(p, 1)).alias("aliased"),
        )

    def text_keys(shared: Column) -> Column:
        refs = F.filter(
            _qualify(shared, default_schema),
            lambda r: r["name"].isNotNull()
            & ~r["schema"].isin(*[x.lower() for x in excluded])
            & ~(r["table"].startswith("#") | r["table"].startswith("@"))
            & ~(r["bare"] & F.array_contains(shared["local"], r["table"])),  # only a bare name can mean a CTE
        )
        if only_safe:
            refs = F.filter(refs, lambda r: names.safe_identifier(r["name"]))
        # As plain text, references are told apart by a hash set, not pair by pair.
        return F.array_distinct(F.transform(refs, lambda r: F.concat_ws(SEPARATOR, r["role"], r["skip"].cast("string"), r["name"])))

    return F.flatten(F.transform(F.transform(F.array(shared), with_aliases), text_keys))


def _prefer_created(keys: Column) -> Column:
    """Keys without the plain ones of targets that are also created."""
    created = F.transform(
        F.filter(keys, lambda k: k.startswith(CREATED)), lambda k: F.concat(F.lit(PLAIN), F.substr(k, F.lit(len(CREATED) + 1)))
    )
    return F.array_except(keys, created)


def _explode_keys(stage: DataFrame, keys: Column, id_col: str) -> DataFrame:
    """One row per key.

    ``keys`` is exploded as an expression: from a plain column the optimizer derives a size
    filter, pushes it below the projection and thereby runs the whole extraction again.
    """
    # The name is all that follows the second separator, whatever it holds.
    role = F.substring_index("_key", SEPARATOR, 1)
    kind = F.substring_index(F.substring_index("_key", SEPARATOR, 2), SEPARATOR, -1)
    name = F.substr("_key", F.length(role) + F.length(kind) + F.lit(3))
    return stage.select(id_col, F.explode(keys).alias("_key")).select(
        id_col,
        role.alias("role"),
        text.without(F.replace(name, F.lit(text.INNER_BLANK), F.lit(" ")), text.QUOTED).alias("name"),
        (kind == "true").alias("skip_catalog"),
        (kind == "hint").alias("from_hint"),
    )


def _alike(rules: list[Rule]) -> list[list[Rule]]:
    """Rules that search alike together, in the order of the first of them."""
    groups: dict[tuple, list[Rule]] = {}
    for rule in rules:
        groups.setdefault((rule.pattern, rule.starts, rule.needs, rule.chosen_groups), []).append(rule)
    return list(groups.values())


def _named(sql: Column, rules: list[Rule], lowered: Column) -> Column:
    """What rules that search alike find, once for each of them; the text is searched once."""

    def told(rule: Rule, found: Column) -> Column:
        return F.transform(
            found,
            lambda raw: F.struct(
                F.lit(rule.extraction_target).alias("role"), F.lit(rule.skip_catalog_validation).alias("skip"), raw.alias("raw")
            ),
        )

    found = F.array_distinct(rule_matches(sql, rules[0], lowered))
    if len(rules) == 1:
        return told(rules[0], found)
    return text.bound(found, lambda seen: F.concat(*[told(r, seen) for r in rules]))


def _qualify(shared: Column, default_schema: str | None) -> Column:
    """Matches with aliases replaced: (role, skip, name, schema, table), the last two lower-cased.

    Lambdas are interpreted and share nothing, so every step binds what the next one reads.
    """
    base = lambda r: (r["role"].alias("role"), r["skip"].alias("skip"))
    keyed = F.transform(shared["matches"], lambda r: F.struct(*base(r), r["raw"].alias("raw"), F.lower(r["raw"]).alias("key")))
    words = F.filter(keyed, lambda r: ~r["key"].isin(*RESERVED))
    placed = F.transform(
        words,
        lambda r: F.struct(*base(r), r["raw"].alias("raw"), F.array_position(shared["aliases"], r["key"]).cast("int").alias("at")),
    )
    real = F.transform(
        placed,
        lambda r: F.struct(
            *base(r), F.when(r["at"] > 0, F.element_at(shared["aliased"], r["at"])).otherwise(r["raw"]).alias("real")
        ),
    )
    named = F.transform(
        real,
        lambda r: F.struct(*base(r), (~F.contains(r["real"], F.lit("."))).alias("bare"), names.qualified(r["real"], default_schema).alias("name")),
    )
    return F.transform(
        named,
        lambda r: F.struct(
            *base(r),
            r["bare"].alias("bare"),
            r["name"].alias("name"),
            F.lower(F.substring_index(r["name"], ".", 1)).alias("schema"),
            F.lower(F.substring_index(r["name"], ".", -1)).alias("table"),
        ),
    )


def filter_refs(
    refs: DataFrame, non_persistent_names: DataFrame, excluded: tuple[str, ...] = EXCLUDED_SCHEMAS, id_col: str = "object_id"
) -> DataFrame:
    """Drop references in excluded schemas, to temp objects, or to names local to the text.

    ``non_persistent_names`` has (id, local_name) rows.
    """
    schema = F.lower(F.split_part("name", F.lit("."), F.lit(1)))
    table = F.lower(F.split_part("name", F.lit("."), F.lit(-1)))
    kept = refs.where(~schema.isin(*[s.lower() for s in excluded]) & ~table.rlike("^[#@]")).withColumn("_table", table)
    local = non_persistent_names.select(F.col(id_col), F.lower("local_name").alias("_table"))
    return kept.join(local, [id_col, "_table"], "left_anti").drop("_table")


def non_persistent_rows(definitions: DataFrame, id_col: str = "object_id", text_col: str = "definition") -> DataFrame:
    return definitions.select(
        id_col, F.explode(non_persistent(text.strip_comments(F.col(text_col)))).alias("local_name")
    )
