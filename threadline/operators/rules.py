"""Cleaning and extraction rules: definition, loading, listing, tests, application."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadline.functions.text import COMMENT, COMMENT_MARKS, LITERAL_TEXT, replace_where

ROLES = ("source", "target", "sp_call", "function")


@dataclass(frozen=True)
class RuleCase:
    name: str
    input: str
    expected: str
    description: str = ""


@dataclass(frozen=True)
class Rule:
    """One regex rule.

    ``steps`` are (pattern, replacement) pairs of a cleaning rule, in Python ``re`` notation.
    An extraction rule has one ``pattern``; the identifier is the first non-empty of ``groups``.
    ``starts`` may name the characters (case ignored, as within ``[]``) that every match begins with,
    so that the others are passed over quickly, and ``needs`` runs (case ignored) of which every
    match, or every match that changes the text, has one, so that texts without are not searched.
    """

    name: str
    rule_type: str = "cleaning"
    description: str = ""
    dialect: str = "generic"
    category: str = ""
    enabled: bool = True
    priority: int = 100
    steps: tuple[tuple[str, str], ...] = ()
    pattern: str = ""
    groups: tuple[int, ...] = ()  # the last group if none is named
    extraction_target: str | None = None
    skip_catalog_validation: bool = False
    cases: tuple[RuleCase, ...] = field(default_factory=tuple)
    starts: str = ""
    needs: tuple[str, ...] = ()

    @property
    def chosen_groups(self) -> tuple[int, ...]:
        """Groups that hold the identifier; the whole match for a pattern without groups."""
        return self.groups or (re.compile(self.pattern).groups,)

    def applies_to(self, dialect: str) -> bool:
        return self.dialect in ("generic", dialect)

    def problems(self) -> list[str]:
        found = []
        if self.rule_type == "extraction":
            if self.extraction_target not in ROLES:
                found.append(f"extraction_target must be one of {', '.join(ROLES)}")
            if not self.pattern:
                found.append("pattern is missing")
            elif not _compiles(self.pattern):
                found.append("pattern is not a valid regex")
            elif re.compile(self.pattern).groups < max(self.chosen_groups):
                found.append("pattern has fewer groups than are asked for")
        elif self.rule_type == "cleaning":
            if not self.steps:
                found.append("pattern and replacement are missing")
            found += [f"step {i} is not a valid regex and is skipped" for i, (p, _) in enumerate(self.steps, 1) if not _compiles(p)]
        else:
            found.append(f"unknown rule_type: {self.rule_type}")
        return found


def _compiles(pattern: str) -> bool:
    try:
        re.compile(pattern)
    except re.error:
        return False
    return True


def java_pattern(pattern: str, starts: str = "") -> str:
    """Java notation of a Python pattern, with the rule default flags (ignore case, lines, dot-all)."""
    text = pattern.replace("(?P<", "(?<")
    text = re.sub(r"\(\?P=(\w+)\)", r"\\k<\1>", text)
    return f"(?ims)(?=[{starts}])(?:{text})" if starts else "(?ims)" + text


def java_replacement(replacement: str) -> str:
    text = replacement.replace("$", r"\$")
    text = re.sub(r"\\g<(\d+)>", r"${\1}", text)
    text = re.sub(r"\\(\d+)", r"${\1}", text)
    return re.sub(r"\$\{(\d+)\}", r"$\1", text)


def apply_rule(sql: Column, rule: Rule) -> Column:
    """Fold the steps of a cleaning rule over the text; invalid steps are skipped."""
    if not rule.enabled or rule.rule_type != "cleaning":
        return sql
    for pattern, replacement in rule.steps:
        if _compiles(pattern):
            found, said = java_pattern(pattern, rule.starts), java_replacement(replacement)
            sql = replace_where(sql, rule.needs, found, said) if rule.needs else F.regexp_replace(sql, F.lit(found), F.lit(said))
    return sql


# Patterns of the standard rules.
DEFAULT_RULES: tuple[Rule, ...] = (
    Rule(
        name="remove_comments",
        needs=COMMENT_MARKS,
        description="Line and block comments",
        category="preprocessing",
        priority=1,
        steps=((COMMENT, r"\1"),),
        cases=(
            RuleCase("line", "SELECT 1 -- FROM a", "SELECT 1 "),
            RuleCase("block", "SELECT 1 /* FROM\nb */ FROM c", "SELECT 1  FROM c"),
            RuleCase("literal", "SELECT '--x' FROM a -- b", "SELECT '--x' FROM a "),
        ),
    ),
    Rule(
        name="strip_top",
        needs=("top",),
        starts="DIMU",
        dialect="tsql",
        description="TOP (n) stands between a keyword and its target",
        category="preprocessing",
        priority=1,
        steps=((r"\b(UPDATE|DELETE|INSERT|MERGE)\s+TOP\s*(?:\((?:[^()]++|\([^()]*+\))*+\)|\d++)(?:\s*PERCENT\b)?", r"\1"),),
    ),
    Rule(
        name="exec_result",
        needs=("@",),
        starts="E",
        dialect="tsql",
        description="EXEC @rc = p calls p",
        category="preprocessing",
        priority=2,
        steps=((r"\b(EXEC(?:UTE)?)\s+@\w+\s*=\s*", r"\1 "),),
    ),
    Rule(
        name="mask_literals",
        needs=("'",),
        description="What a string literal says is no statement",
        category="preprocessing",
        priority=2,
        steps=((LITERAL_TEXT, r"\1\2\3"),),
    ),
    Rule(
        name="delete_from",
        needs=("delete",),
        starts="D",
        description="DELETE FROM names a target, not a source",
        category="preprocessing",
        priority=2,
        steps=((r"\bDELETE\s+FROM\b", "DELETE"),),
        cases=(RuleCase("delete", "DELETE FROM dbo.T", "DELETE dbo.T"),),
    ),
    Rule(
        name="extract_sources_ansi",
        starts="FJU",
        rule_type="extraction",
        description="Tables after FROM, JOIN and USING",
        category="extraction",
        priority=5,
        extraction_target="source",
        # Every kind of join ends in the word JOIN, so its qualifiers need no alternatives.
        pattern=r"\b(FROM|JOIN|USING)\b\s+([^\s,;()]+)",
    ),
    Rule(
        name="extract_targets_ansi",
        starts="DIMU",
        rule_type="extraction",
        description="Tables after INSERT, UPDATE, MERGE, DELETE and INTO",
        category="extraction",
        priority=6,
        extraction_target="target",
        pattern=r"\b(INSERT(?:\s+INTO)?|UPDATE|MERGE(?:\s+INTO)?|DELETE)\s+([^\s,;()]+)",
    ),
    Rule(
        name="extract_targets_output_into",
        needs=("output",),
        starts="O",
        rule_type="extraction",
        dialect="tsql",
        description="Tables that an OUTPUT clause writes to",
        category="extraction",
        priority=6,
        extraction_target="target",
        # From the last OUTPUT in front of an INTO, so that no text is scanned twice.
        pattern=r"\b(OUTPUT)\b(?:[^;OoIi]++|(?!\b(?:OUTPUT|INTO)\b)[OoIi])*+\bINTO\s+([^\s,;()]+)",
    ),
    Rule(
        name="extract_sources_tsql_apply",
        needs=("apply",),
        starts="CO",
        rule_type="extraction",
        dialect="tsql",
        description="Table sources after CROSS APPLY and OUTER APPLY",
        category="extraction",
        priority=7,
        extraction_target="source",
        pattern=r"\b(CROSS\s+APPLY|OUTER\s+APPLY)\b\s+([^\s,;()]+)",
    ),
    Rule(
        name="extract_functions_tsql_apply",
        needs=("apply",),
        starts="CO",
        rule_type="extraction",
        dialect="tsql",
        description="Table-valued functions after CROSS APPLY and OUTER APPLY",
        category="extraction",
        priority=7,
        extraction_target="function",
        pattern=r"\b(CROSS\s+APPLY|OUTER\s+APPLY)\b\s+([^\s,;()]+)",
    ),
    Rule(
        name="extract_sp_calls_tsql",
        needs=("exec",),
        starts="E",
        rule_type="extraction",
        dialect="tsql",
        description="Procedures after EXEC and EXECUTE",
        category="extraction",
        priority=8,
        extraction_target="sp_call",
        pattern=r"\b(EXEC(?:UTE)?)\b\s+([^\s,;()]+)",
    ),
    Rule(
        name="extract_targets_tsql_truncate",
        needs=("truncate",),
        starts="T",
        rule_type="extraction",
        dialect="tsql",
        description="Tables after TRUNCATE TABLE",
        category="extraction",
        priority=9,
        extraction_target="target",
        pattern=r"\b(TRUNCATE\s+TABLE)\s+([^\s,;()]+)",
    ),
    Rule(
        name="extract_targets_tsql",
        starts="CS",
        rule_type="extraction",
        dialect="tsql",
        description="Tables created by SELECT INTO and CREATE TABLE AS SELECT",
        category="extraction",
        priority=10,
        extraction_target="target",
        pattern=(
            r"(?:\bSELECT\b(?:[^;SsIi]++|(?!\b(?:SELECT|INTO)\b)[SsIi])*+\bINTO\s+([^\s,;()]+)"
            r"|\bCREATE\s+TABLE\s+([^\s,;()]+)\s+AS\s+SELECT)"
        ),
        groups=(1, 2),
        skip_catalog_validation=True,
    ),
)


def active(rules: tuple[Rule, ...], dialect: str, rule_type: str) -> list[Rule]:
    """Enabled rules of one type for a dialect, in priority order."""
    chosen = [r for r in rules if r.enabled and r.rule_type == rule_type and r.applies_to(dialect)]
    return sorted((r for r in chosen if r.rule_type == "cleaning" or not r.problems()), key=lambda r: (r.priority, r.name))


def _as_rule(data: dict) -> Rule:
    kind = data.get("rule_type", "cleaning")
    pattern, replacement = data.get("pattern", ""), data.get("replacement", "")
    steps: tuple[tuple[str, str], ...] = ()
    if kind == "cleaning" and pattern:
        if isinstance(pattern, list):
            if not isinstance(replacement, list) or len(replacement) != len(pattern):
                raise ValueError("pattern and replacement must have the same number of steps")
            steps = tuple(zip(pattern, replacement, strict=True))
        else:
            steps = ((pattern.strip(), replacement),)
    options = data.get("extraction_options") or {}
    return Rule(
        name=data["name"],
        rule_type=kind,
        description=str(data.get("description", "")).strip(),
        dialect=data.get("dialect", "generic"),
        category=data.get("category", ""),
        enabled=bool(data.get("enabled", True)),
        priority=int(data.get("priority", 100)),
        steps=steps,
        pattern=pattern.strip() if kind == "extraction" and isinstance(pattern, str) else "",
        groups=tuple(data.get("groups", ())),
        extraction_target=data.get("extraction_target"),
        skip_catalog_validation=bool(options.get("skip_catalog_validation", data.get("skip_catalog_validation", False))),
        cases=tuple(
            RuleCase(c.get("name", ""), c["input"], c["expected"], c.get("description", "")) for c in data.get("test_cases") or ()
        ),
    )


def load_rules(folder: str | Path) -> tuple[tuple[Rule, ...], list[tuple[str, str]]]:
    """Rules of all ``.yaml`` / ``.yml`` / ``.json`` files below a folder, and the files that failed."""
    rules: list[Rule] = []
    failed: list[tuple[str, str]] = []
    for path in sorted(Path(folder).rglob("*")):
        if path.suffix not in (".yaml", ".yml", ".json"):
            continue
        try:
            text = path.read_text(encoding="utf-8")
            if path.suffix == ".json":
                data = json.loads(text)
            else:
                import yaml

                data = yaml.safe_load(text)
            rule = _as_rule(data)
            hard = [p for p in rule.problems() if "skipped" not in p]
            if hard:
                raise ValueError("; ".join(hard))
            rules.append(rule)
        except Exception as exc:  # one bad file must not stop the others
            failed.append((path.name, f"{type(exc).__name__}: {exc}"))
    return tuple(sorted(rules, key=lambda r: (r.priority, r.name))), failed


def rules_table(
    spark: SparkSession,
    rules: tuple[Rule, ...] = DEFAULT_RULES,
    failed: list[tuple[str, str]] | None = None,
    text: str | None = None,
    enabled: bool | None = None,
) -> DataFrame:
    """Rule catalogue by priority, failed files last; optional text and enabled filters."""
    rows = [
        (r.name, r.rule_type, r.dialect, r.category, r.enabled, r.priority, r.extraction_target, r.description, None)
        for r in rules
    ] + [(name, None, None, None, False, 2**31 - 1, None, None, error) for name, error in failed or ()]
    table = spark.createDataFrame(
        rows,
        "name string, rule_type string, dialect string, category string, enabled boolean, "
        "priority int, extraction_target string, description string, error string",
    )
    if text:
        needle = text.lower()
        table = table.where(
            F.contains(F.lower(F.concat_ws(" ", "name", "description", "category")), F.lit(needle))
        )
    if enabled is not None:
        table = table.where(F.col("enabled") == enabled)
    return table.orderBy("priority", "name")


def run_rule_cases(spark: SparkSession, rules: tuple[Rule, ...] = DEFAULT_RULES) -> DataFrame:
    """Embedded cases of the cleaning rules with their outcome."""
    parts = []
    for rule in rules:
        if not rule.cases:
            continue
        rows = [(rule.name, c.name, c.description, c.input, c.expected) for c in rule.cases]
        frame = spark.createDataFrame(rows, "rule string, case_name string, description string, input string, expected string")
        parts.append(frame.withColumn("actual", apply_rule(F.col("input"), rule)))
    if not parts:
        return spark.createDataFrame(
            [], "rule string, case_name string, description string, input string, expected string, actual string, passed boolean"
        )
    table = parts[0]
    for part in parts[1:]:
        table = table.unionByName(part)
    return table.withColumn("passed", F.col("actual") == F.col("expected"))
