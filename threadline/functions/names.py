"""Column functions on identifiers and object classification."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Catalog type codes and their names.
TYPE_NAMES = {
    "U": "Table",
    "V": "View",
    "P": "Stored Procedure",
    "FN": "Function",
    "IF": "Function",
    "TF": "Function",
    "FS": "Function",
    "FT": "Function",
}
PLURAL_NAMES = {
    "Table": "Tables",
    "View": "Views",
    "Stored Procedure": "Stored Procedures",
    "Function": "Functions",
}

# Words an identifier must not contain, and the allowed characters.
UNSAFE_WORDS = ("drop", "delete", "truncate", "exec", "execute", "--", "/*", "*/")
IDENTIFIER = r"^[\w.\[\]]+$"

# Naming conventions of data-model classes, first match wins.
MODEL_RULES: tuple[tuple[str, tuple[str, ...]], ...] = (
    ("Dimension", ("^Dim", "^vw_Dim", "^v_Dim", "^vwDim", "^vDim")),
    ("Fact", ("^Fact", "^vw_Fact", "^v_Fact", "^vwFact", "^vFact")),
)

# Words that name the layer of a schema, in order of precedence.
LAYER_WORDS = {
    "staging": ("staging", "stg", "raw", "landing", "source", "bronze"),
    "transformation": ("transformation", "transform", "tfm", "processed", "intermediate", "silver"),
    "consumption": ("consumption", "cons", "mart", "final", "presentation", "pub", "published", "gold"),
}

# Node symbols by object type.
SYMBOLS = {
    "Function": "diamond",
    "Scalar Function": "diamond",
    "Table-valued Function": "diamond",
    "Table": "circle",
    "View": "circle",
    "Stored Procedure": "square",
}


def _lookup(col: Column, names: dict[str, str], other: str) -> Column:
    picked = F.lit(other)
    for key, value in reversed(list(names.items())):
        picked = F.when(col == key, value).otherwise(picked)
    return picked


def object_type_name(code: Column) -> Column:
    return _lookup(F.trim(code), TYPE_NAMES, "Other")


def plural_type_name(name: Column) -> Column:
    chosen = _lookup(name, PLURAL_NAMES, "")
    return F.when(chosen != "", chosen).otherwise(name)


def node_symbol(object_type: Column) -> Column:
    return _lookup(object_type, SYMBOLS, "circle")


def bare(identifier: Column) -> Column:
    """Identifier without brackets, quotes and trailing separators."""
    return F.trim(F.regexp_replace(F.regexp_replace(identifier, r'[\[\]"]', ""), r"[,;\s]+$", ""))


def qualified(identifier: Column, default_schema: str | None = "dbo") -> Column:
    """``schema.name`` of a bare identifier: its last two dotted parts, NULL if the name is empty.

    A single part gets ``default_schema`` (``(unknown)`` if None), and so does ``database..name``,
    which leaves its schema to the default. An empty schema without a database gives NULL.
    """
    last_two = F.substring_index(identifier, ".", -2)
    schema = default_schema or "(unknown)"
    return (
        F.when(identifier == "", None)
        .when(~F.contains(identifier, F.lit(".")), F.concat(F.lit(f"{schema}."), identifier))
        .when(~(last_two.startswith(".") | last_two.endswith(".")), last_two)
        .when(last_two.startswith(".") & identifier.rlike(r"[^.]\.\.[^.]+$"), F.concat(F.lit(schema), last_two))
    )


def normalise_ident(identifier: Column, default_schema: str | None = "dbo") -> Column:
    """:func:`qualified` of an identifier that may still carry brackets, quotes and separators."""
    return qualified(bare(identifier), default_schema)


def safe_identifier(identifier: Column) -> Column:
    clean = identifier.rlike(IDENTIFIER)
    for word in UNSAFE_WORDS:
        clean = clean & ~F.contains(F.lower(identifier), F.lit(word))
    return clean


def classify_model(name: Column, object_type: Column, rules=MODEL_RULES) -> Column:
    picked = F.lit("Other")
    for label, patterns in reversed(rules):
        picked = F.when(name.rlike("(?i)" + "|".join(f"(?:{p})" for p in patterns)), label).otherwise(picked)
    return F.when(object_type.isin("Table", "View"), picked).otherwise("Other")


def schema_layer(schema: Column) -> Column:
    """Layer whose word occurs in the name; NULL when none does."""
    layer = F.lit(None).cast("string")
    for label, words in reversed(LAYER_WORDS.items()):
        layer = F.when(F.lower(schema).rlike("|".join(words)), label).otherwise(layer)
    return layer


def schema_department(schema: Column) -> Column:
    """The part of a schema name after its leading layer word, without separators.

    Only the first part decides: a layer word there is dropped when something follows it.
    """
    parts = F.filter(F.split(F.lower(schema), "[_-]+"), lambda p: p != "")
    words = [w for group in LAYER_WORDS.values() for w in group]
    leading = F.coalesce(F.get(parts, F.lit(0)).isin(*words), F.lit(False)) & (F.size(parts) > 1)
    rest = F.when(leading, F.slice(parts, 2, F.size(parts))).otherwise(parts)
    return F.array_join(rest, "")


def wildcard_regex(pattern: str) -> str:
    """Anchored, case-insensitive regex of a ``*`` pattern; everything else is literal."""
    pieces = pattern.split("*")
    return "(?is)^" + ".*".join("" if not p else r"\Q" + p.replace(r"\E", r"\E\\E\Q") + r"\E" for p in pieces) + "$"


def matches_any(name: Column, patterns: list[str]) -> Column:
    """Whether the name matches one of the wildcard patterns (NULL name: false)."""
    hit = F.lit(False)
    for pattern in patterns:
        hit = hit | F.coalesce(name.rlike(wildcard_regex(pattern)), F.lit(False))
    return hit


def split_patterns(text: str) -> list[str]:
    """Comma-separated exclusion terms, blanks dropped."""
    return [t.strip() for t in text.split(",") if t.strip()]


def object_key(schema: Column, name: Column) -> Column:
    """A surrogate id that is the same in every run (non-negative)."""
    return F.xxhash64(F.lower(schema), F.lower(name)).bitwiseAND(F.lit(0x7FFFFFFFFFFFFFFF))
