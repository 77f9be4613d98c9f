"""SQL-text jobs over all definitions.

Single patterns are compared with the same pattern in the checking engine; whole extraction runs
with the references that follow from the rows the texts were generated from.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.base import Catalog, check, with_ctes
from threadline.functions import names, text
from threadline.operators import dynamic, extract, graph, resolve, rules
from threadline.plans.derived_catalog import VIEW, _id, part_name, part_schema
from threadline.session import write_stage

def _texts(expression: str) -> str:
    return with_ctes("definitions", f"SELECT object_id, {expression} AS sql_text FROM definitions")


def _column_check(name: str, function, expression: str) -> None:
    @check(name, _texts(expression))
    def run(c: Catalog):
        return c.definitions.select("object_id", function(F.col("definition")).alias("sql_text"))


TO_UPPER = rules.Rule(name="exec", steps=((r"\bEXEC\s+(\w+)\.", r"EXECUTE [\1]."),))
TWO_STEPS = rules.Rule(
    name="two", steps=((r"\bCOMMIT\s+TRANSACTION\b", "COMMIT"), ("(unclosed", ""), (r"#(\w+)", r"tempdb.\g<1>"))
)
# Comments of the texts hold no stars, and others at most one level deep.
COMMENTS_SQL = r"""regexp_replace(definition, '(''[^'']*''|\[[^\]]*\]|"[^"]*")|--[^\r\n]*|/\*[^*]*/\*[^*]*\*/[^*]*\*/|/\*[^*]*\*/', '\1', 'g')"""
BODY_SQL = (
    r"regexp_replace(regexp_replace(definition, '(?is)^.*?CREATE\s+PROC(?:EDURE)?\s+\[[^\]]+\]\.\[[^\]]+\].*?AS\s+BEGIN', ''), '(?i)\s*END\s*$', '')"
)
SIMPLIFY_SQL = (
    r"array_to_string(list_transform(string_split_regex(definition, '\bSELECT\b'), "
    r"lambda s: regexp_replace(s, '(?is)^\s+(TOP\s+\d+\s+|DISTINCT\s+)?[^;]*?(\s+(?:INTO|FROM)\b)', ' \1*\2')), 'SELECT')"
)

_column_check("C1_apply_rule", lambda t: rules.apply_rule(t, TO_UPPER), r"regexp_replace(definition, '(?ims)\bEXEC\s+(\w+)\.', 'EXECUTE [\1].', 'g')")
_column_check(
    "C2_multi_step_rule",
    lambda t: rules.apply_rule(t, TWO_STEPS),
    r"regexp_replace(regexp_replace(definition, '(?ims)\bCOMMIT\s+TRANSACTION\b', 'COMMIT', 'g'), '(?ims)#(\w+)', 'tempdb.\1', 'g')",
)
_column_check("C3_strip_comments", text.strip_comments, COMMENTS_SQL)
_column_check(
    "C4_strip_ansi",
    lambda t: text.strip_ansi(F.regexp_replace(t, "SELECT", "\x1b[32mSELECT\x1b[0m[4m")),
    "definition",
)
_column_check("C5_proc_body", text.proc_body, f"CASE WHEN definition LIKE 'CREATE PROC%' THEN {BODY_SQL} ELSE definition END")
_column_check(
    "C6_split_statements",
    text.split_statements,
    # No text has two blanks behind a semicolon, so a preceding character stands in for the lookbehind.
    r"regexp_replace(regexp_replace(definition, '(?i)([^;\s])\s+(DECLARE|INSERT|UPDATE|DELETE|MERGE|TRUNCATE)\b', '\1;\2', 'g'), '(?im)(^|;|END)\s+\b(SELECT|WITH)\b', '\1;\2', 'g')",
)
_column_check("C7_split_queries", text.split_queries, r"regexp_replace(definition, '(?im)(^|;|END)\s+\b(SELECT|WITH)\b', '\1;\2', 'g')")
_column_check("C8_until_commit", text.until_commit, r"regexp_replace(definition, '(?is)(\bCOMMIT\s+TRANSACTION\b).*', '\1')")
_column_check("C9_squeeze_ws", text.squeeze_ws, r"trim(regexp_replace(definition, '\s+', ' ', 'g'))")
_column_check("C10_simplify_select", text.simplify_select, SIMPLIFY_SQL)



def _plain():
    return F.regexp_replace(text.strip_comments(F.col("definition")), r"(?i)\bDELETE\s+FROM\b", "DELETE")


PLAIN_SQL = rf"regexp_replace({COMMENTS_SQL}, '(?i)\bDELETE\s+FROM\b', 'DELETE', 'g')"


def _rule_check(name: str, rule_name: str, same: str | None = None) -> None:
    """``same`` is a pattern for the checking engine that finds the same in these texts."""
    rule = next(r for r in rules.DEFAULT_RULES if r.name == rule_name)
    pattern = "(?ims)" + (same or rule.pattern)
    group = rule.chosen_groups[0]
    if len(rule.groups) == 2:
        found = (
            f"list_transform(list_zip(regexp_extract_all(t, '{pattern}', {rule.groups[0]}), regexp_extract_all(t, '{pattern}', {rule.groups[1]})), "
            "lambda p: CASE WHEN p[1] <> '' THEN p[1] ELSE p[2] END)"
        )
    else:
        found = f"regexp_extract_all(t, '{pattern}', {group})"
    sql = with_ctes(
        "definitions",
        f"SELECT object_id, '{rule.extraction_target}' AS role, CAST(unnest(range(len(m))) AS INTEGER) AS pos, unnest(m) AS raw "
        f"FROM (SELECT object_id, {found} AS m FROM (SELECT object_id, {PLAIN_SQL} AS t FROM definitions))",
    )

    @check(name, sql)
    def run(c: Catalog):
        plain = c.definitions.select("object_id", _plain().alias("definition"))
        return extract.raw_references(plain, (rule,), cleaned=True).select("object_id", "role", "pos", "raw")


_rule_check("C11_sources", "extract_sources_ansi")
_rule_check("C12_targets", "extract_targets_ansi")
_rule_check("C12_output_targets", "extract_targets_output_into", r"\b(OUTPUT)\b[^;]*?\bINTO\s+([^\s,;()]+)")
_rule_check("C13_apply_sources", "extract_sources_tsql_apply")
_rule_check("C14_procedure_calls", "extract_sp_calls_tsql")
_rule_check(
    "C15_created_tables",
    "extract_targets_tsql",
    r"(?:\bSELECT\b[^;]*?\bINTO\s+([^\s,;()]+)|\bCREATE\s+TABLE\s+([^\s,;()]+)\s+AS\s+SELECT)",
)

# What the generated texts say, straight from the generating rows (names as written in the text).
EXPECTED = f"""expected AS (
  SELECT {_id('s_suppkey', VIEW)} AS object_id, 'source' AS role, {part_schema('s_suppkey')} || '.' || {part_name('s_suppkey')} AS name, false AS created FROM supplier
  UNION SELECT object_id, 'source', 'dbo.RegionMaster0', false FROM proc_facts
  UNION
  SELECT object_id, 'source' AS role, s1 || '.' || n1 AS name, false AS created FROM proc_facts
  UNION SELECT object_id, 'source', cust_schema || '.' || cust_name, false FROM proc_facts
  UNION SELECT object_id, 'source', 'dbo.fn' || nation_key, false FROM proc_facts
  UNION SELECT object_id, 'function', 'dbo.fn' || nation_key, false FROM proc_facts
  UNION SELECT object_id, 'source', 'dbo.RegionMaster' || region_key, false FROM proc_facts WHERE n_lines >= 6
  UNION SELECT object_id, 'source', s2 || '.' || n2, false FROM proc_facts WHERE n_lines = 5
  UNION SELECT object_id, 'target', lower(s2) || '.' || n2, false FROM proc_facts
  UNION SELECT object_id, 'target', 'dbo.RegionMaster' || region_key, false FROM proc_facts WHERE n_lines >= 6
  UNION SELECT object_id, 'target', s1 || '.' || n1, false FROM proc_facts WHERE n_lines IN (2, 3, 4)
  UNION SELECT object_id, 'target', cust_schema || '.' || cust_name, false FROM proc_facts WHERE n_lines IN (2, 4)
  UNION SELECT object_id, 'target', 'dbo.NewT' || CAST(o_orderkey AS VARCHAR), true FROM proc_facts WHERE n_lines = 5
  UNION SELECT object_id, 'sp_call', called, false FROM proc_facts WHERE called IS NOT NULL
  UNION SELECT object_id, 'source', 'dbo.RegionMaster2', false FROM proc_facts WHERE o_orderkey % 7 IN (0, 4)
  UNION SELECT object_id, 'source', 'dbo.RegionMaster' || k, false FROM proc_facts, (SELECT unnest(['1', '2', '3', '4']) AS k) WHERE o_orderkey % 7 = 1
  UNION SELECT object_id, 'target', 'dbo.RegionMaster' || k, false FROM proc_facts, (SELECT unnest(['1', '2']) AS k) WHERE o_orderkey % 7 = 2
  UNION SELECT object_id, 'source', 'dbo.RegionMaster1', false FROM proc_facts WHERE o_orderkey % 7 = 3
  UNION SELECT object_id, 'source', 'O''Brien.T1', false FROM proc_facts WHERE o_orderkey % 7 = 5
  UNION SELECT object_id, 'sp_call', 'dbo.sp_executesql', false FROM proc_facts WHERE o_orderkey % 7 = 6)"""
# What the texts say that they build and execute.
DYNAMIC = """dynamic AS (SELECT object_id, 'source' AS role, 'dbo.RegionMaster3' AS name FROM proc_facts WHERE o_orderkey % 7 = 0
  UNION ALL SELECT object_id, 'target', 'dbo.RegionMaster1' FROM proc_facts WHERE o_orderkey % 7 = 6
  UNION ALL SELECT object_id, 'source', 'dbo.RegionMaster2' FROM proc_facts WHERE o_orderkey % 7 = 6)"""
CATALOG_NAMES = """names AS (SELECT CASE WHEN object_type IN ('Table', 'View') THEN 'table' WHEN object_type = 'Stored Procedure' THEN 'procedure' ELSE 'function' END AS kind,
  lower(schema_name || '.' || object_name) AS name_key, min(object_id) AS ref_id, arg_min(schema_name || '.' || object_name, object_id) AS full_name FROM objects GROUP BY 1, 2)"""
LOOKED_UP = """looked_up AS (SELECT e.*, n.ref_id, n.full_name FROM expected e LEFT JOIN names n ON n.name_key = lower(e.name)
  AND n.kind = CASE e.role WHEN 'sp_call' THEN 'procedure' WHEN 'function' THEN 'function' ELSE 'table' END)"""
VALID = """valid AS (SELECT DISTINCT object_id, role, coalesce(full_name, name) AS name, ref_id, ref_id IS NULL AS name_only FROM looked_up
  WHERE ref_id IS NOT NULL OR created)"""
HINTS = """hints AS (SELECT object_id, 'source' AS role, cust_schema || '.' || cust_name AS name FROM proc_facts WHERE o_orderpriority = '3-MEDIUM'
  UNION SELECT object_id, 'source', 'dbo.Nope' FROM proc_facts WHERE o_orderpriority = '3-MEDIUM'
  UNION SELECT object_id, 'target', 'dbo.RegionMaster' || region_key FROM proc_facts WHERE o_orderpriority = '3-MEDIUM')"""
VALID_HINTS = """valid_hints AS (SELECT h.object_id, h.role, n.full_name AS name, n.ref_id FROM hints h JOIN names n ON n.kind = 'table' AND n.name_key = lower(h.name))"""
MERGED = """merged AS (SELECT object_id, role, name, min(ref_id) AS ref_id, bool_and(name_only) AS name_only, bool_or(t) AS from_text, bool_or(h) AS from_hint FROM (
  SELECT object_id, role, name, ref_id, name_only, true AS t, false AS h FROM valid
  UNION ALL SELECT object_id, role, name, ref_id, false, false, true FROM valid_hints) GROUP BY 1, 2, 3)"""
RESOLVED = (EXPECTED, CATALOG_NAMES, LOOKED_UP, VALID, HINTS, VALID_HINTS, MERGED)
PARSED_EDGES = """parsed_edges AS (SELECT DISTINCT CASE WHEN role IN ('source', 'function') THEN ref_id ELSE object_id END AS source_id,
  CASE WHEN role IN ('source', 'function') THEN object_id ELSE ref_id END AS target_id, object_id AS owner_id FROM merged WHERE ref_id IS NOT NULL)"""
REFRESH_EDGES = (
    *RESOLVED,
    PARSED_EDGES,
    """refresh_edges AS (SELECT source_id, target_id, owner_id FROM parsed_edges WHERE owner_id IN (SELECT object_id FROM proc_facts)
  UNION SELECT referenced_object_id, referencing_object_id, referencing_object_id FROM dependencies
  WHERE referenced_object_id IS NOT NULL AND referencing_object_id IN (SELECT object_id FROM objects WHERE object_type = 'View'))""",
)


@check(
    "C16_run_rules",
    with_ctes("objects proc_facts", "SELECT object_id, role, name, max(created) AS skip_catalog FROM expected GROUP BY 1, 2, 3", EXPECTED),
)
def run_rules(c):
    return extract.extract_refs(c.definitions)


@check(
    "C8_C16_first_transaction",
    with_ctes(
        "objects proc_facts",
        "SELECT object_id, role, name, max(created) AS skip_catalog FROM expected WHERE name <> 'dbo.RegionMaster0' OR object_id IN (SELECT object_id FROM proc_facts WHERE n_lines >= 6 AND region_key = '0') GROUP BY 1, 2, 3",
        EXPECTED,
    ),
)
def first_transaction(c):
    return extract.extract_refs(c.definitions, first_transaction=True)


@check(
    "C17_normalise_ident",
    with_ctes(
        "definitions",
        rf"""SELECT object_id, raw, CASE WHEN bare = '' THEN NULL WHEN len(string_split(bare, '.')) = 1 THEN 'dbo.' || bare
          WHEN string_split(bare, '.')[-1] = '' THEN NULL
          WHEN string_split(bare, '.')[-2] = '' THEN CASE WHEN len(string_split(bare, '.')) > 2 AND string_split(bare, '.')[-3] <> '' THEN 'dbo.' || string_split(bare, '.')[-1] END
          ELSE string_split(bare, '.')[-2] || '.' || string_split(bare, '.')[-1] END AS name
        FROM (SELECT object_id, raw, regexp_replace(regexp_replace(raw, '[\[\]"]', '', 'g'), '[,;\s]+$', '') AS bare
          FROM (SELECT object_id, unnest(regexp_extract_all(definition, '\S+', 0)) AS raw FROM definitions))""",
    ),
)
def normalise_ident(c):
    words = c.definitions.select("object_id", F.explode(F.regexp_extract_all("definition", F.lit(r"\S+"), F.lit(0))).alias("raw"))
    return words.select("object_id", "raw", names.normalise_ident(F.col("raw")).alias("name"))


@check(
    "C18_resolve_aliases",
    with_ctes(
        "proc_facts",
        """SELECT object_id, 'dbo.RegionMaster' || region_key AS name FROM proc_facts WHERE n_lines >= 6
        UNION SELECT object_id, 'dbo.RegionMaster1' FROM proc_facts WHERE o_orderkey % 7 = 2""",
    ),
)
def resolve_aliases(c):
    update_rule = tuple(r for r in rules.DEFAULT_RULES if r.rule_type == "cleaning") + (
        rules.Rule(name="updates", rule_type="extraction", extraction_target="target", pattern=r"\b(UPDATE)\s+([^\s,;()]+)"),
    )
    return extract.extract_refs(c.definitions, update_rule).select("object_id", "name")


@check(
    "C19_non_persistent",
    with_ctes(
        "definitions",
        rf"""SELECT DISTINCT object_id, lower(n) AS local_name FROM (SELECT object_id, unnest(list_concat(
          regexp_extract_all(t, '(?i)\bWITH\s+(\w+)\s+AS\s*\(', 1), regexp_extract_all(t, '(?i),\s*(\w+)\s+AS\s*\(', 1),
          regexp_extract_all(t, '(#\w+)', 1), regexp_extract_all(t, '(?i)\bDECLARE\s+@(\w+)\s+TABLE\b', 1))) AS n
          FROM (SELECT object_id, {COMMENTS_SQL} AS t FROM definitions))""",
    ),
)
def non_persistent(c):
    return extract.non_persistent_rows(c.definitions)


@check(
    "C20_filter_refs",
    with_ctes(
        "definitions",
        rf"""SELECT object_id, raw FROM (SELECT object_id, unnest(regexp_extract_all({COMMENTS_SQL}, '(?i)\b(FROM)\s+([^\s,;()]+)', 2)) AS raw FROM definitions)
        WHERE raw NOT LIKE '#%' AND raw <> 'cte1' AND raw NOT LIKE 'CONSUMPTION_FINANCE.%' AND raw NOT LIKE '[CONSUMPTION_FINANCE]%'""",
    ),
)
def filter_refs(c):
    plain = c.definitions.select("object_id", text.strip_comments(F.col("definition")).alias("definition"))
    rule = rules.Rule(name="from", rule_type="extraction", extraction_target="source", pattern=r"\b(FROM)\s+([^\s,;()]+)")
    refs = extract.raw_references(plain, (rule,), cleaned=True).withColumn("name", names.normalise_ident(F.col("raw")))
    return extract.filter_refs(refs, extract.non_persistent_rows(c.definitions), ("Consumption_Finance",)).select("object_id", "raw")


@check(
    "C21_safe_identifier",
    with_ctes(
        "definitions",
        r"""SELECT object_id, raw, regexp_matches(raw, '^[\w.\[\]]+$') AND NOT regexp_matches(lower(raw), 'drop|delete|truncate|exec|--|/\*|\*/') AS safe
        FROM (SELECT object_id, unnest(regexp_extract_all(definition, '\S+', 0)) AS raw FROM definitions)""",
    ),
)
def safe_identifier(c):
    words = c.definitions.select("object_id", F.explode(F.regexp_extract_all("definition", F.lit(r"\S+"), F.lit(0))).alias("raw"))
    return words.select("object_id", "raw", names.safe_identifier(F.col("raw")).alias("safe"))


def _valid_check(name: str, roles: tuple[str, ...]) -> None:
    listed = ", ".join(f"'{r}'" for r in roles)
    sql = with_ctes(
        "objects proc_facts",
        f"SELECT object_id, role, name, coalesce(ref_id, -1) AS ref_id, name_only FROM valid WHERE role IN ({listed})",
        *RESOLVED[:4],
    )

    @check(name, sql)
    def run(c: Catalog):
        refs = extract.extract_refs(c.definitions).where(F.col("role").isin(*roles))
        return resolve.validate_refs(refs, c.objects).withColumn("ref_id", F.coalesce("ref_id", F.lit(-1)))


_valid_check("C22_C39_validate_tables", ("source", "target"))
_valid_check("C23_validate_procedures", ("sp_call",))
_valid_check("C24_validate_functions", ("function",))


@check(
    "C25_resolve_ids",
    with_ctes("objects proc_facts", "SELECT DISTINCT object_id, role, name, coalesce(ref_id, -1) AS ref_id FROM looked_up", *RESOLVED[:3]),
)
def resolve_ids(c):
    return resolve.resolve_ids(extract.extract_refs(c.definitions), c.objects).select(
        "object_id", "role", "name", F.coalesce("ref_id", F.lit(-1)).alias("ref_id")
    )


@check(
    "C26_lookup_names",
    with_ctes(
        "objects proc_facts",
        """SELECT r.name, coalesce(o.object_id, -1) AS object_id FROM (SELECT lower(s2) || '.' || n2 AS name FROM proc_facts UNION SELECT n1 FROM proc_facts) r
        LEFT JOIN objects o ON o.schema_name || '.' || o.object_name = CASE WHEN contains(r.name, '.') THEN r.name ELSE 'dbo.' || r.name END""",
    ),
)
def lookup_names(c):
    wanted = c.proc_facts.select(F.concat_ws(".", F.lower("s2"), "n2").alias("name")).union(c.proc_facts.select("n1"))
    return resolve.lookup_names(wanted, c.objects).select("name", F.coalesce("object_id", F.lit(-1)).alias("object_id"))


@check("C27_extract_hints", with_ctes("objects proc_facts", "SELECT object_id, role, name FROM hints", HINTS))
def extract_hints(c):
    return resolve.extract_hints(c.definitions)


@check(
    "C28_validate_hints",
    with_ctes("objects proc_facts", "SELECT object_id, role, name, ref_id FROM valid_hints", CATALOG_NAMES, HINTS, VALID_HINTS),
)
def validate_hints(c):
    return resolve.validate_hints(resolve.extract_hints(c.definitions), c.objects)


def _merged(c: Catalog, mode: str):
    texts = c.definitions
    refs = resolve.validate_refs(extract.extract_refs(texts), c.objects)
    return resolve.merge_hints(refs, resolve.validate_hints(resolve.extract_hints(texts), c.objects), mode)


@check(
    "C29_merge_hints_union",
    with_ctes(
        "objects proc_facts",
        "SELECT object_id, role, name, coalesce(ref_id, -1) AS ref_id, name_only, from_text, from_hint FROM merged",
        *RESOLVED,
    ),
)
def merge_hints_union(c):
    return _merged(c, "union").withColumn("ref_id", F.coalesce("ref_id", F.lit(-1)))


@check(
    "C29_merge_hints_replace",
    with_ctes(
        "objects proc_facts",
        """SELECT object_id, role, name, false AS from_hint FROM valid v WHERE NOT EXISTS (SELECT 1 FROM valid_hints h WHERE h.object_id = v.object_id AND h.role = v.role)
        UNION SELECT object_id, role, name, true FROM valid_hints""",
        *RESOLVED[:6],
    ),
)
def merge_hints_replace(c):
    return _merged(c, "replace").select("object_id", "role", "name", "from_hint")


@check(
    "C22_C29_resolve_definitions",
    with_ctes(
        "objects proc_facts",
        "SELECT object_id, role, name, coalesce(ref_id, -1) AS ref_id, name_only, from_text, from_hint FROM merged",
        *RESOLVED,
    ),
)
def resolve_definitions(c):
    return resolve.resolve_definitions(c.definitions, c.objects).withColumn("ref_id", F.coalesce("ref_id", F.lit(-1)))


@check(
    "C22_C29_resolve_replacing",
    with_ctes(
        "objects proc_facts",
        """SELECT object_id, role, name, false AS from_hint FROM valid v WHERE NOT EXISTS (SELECT 1 FROM valid_hints h WHERE h.object_id = v.object_id AND h.role = v.role)
        UNION SELECT object_id, role, name, true FROM valid_hints""",
        *RESOLVED[:6],
    ),
)
def resolve_replacing(c):
    return resolve.resolve_definitions(c.definitions, c.objects, hint_mode="replace").select("object_id", "role", "name", "from_hint")


@check(
    "C30_hint_stats",
    with_ctes(
        "objects proc_facts",
        "SELECT object_id, 3 AS total_hints, 2 AS input_hints, 1 AS output_hints, 2 AS valid_hints, 1 AS invalid_hints FROM proc_facts WHERE o_orderpriority = '3-MEDIUM'",
    ),
)
def hint_stats(c):
    return resolve.hint_stats(c.definitions, c.objects)


@check(
    "C31_self_references",
    with_ctes(
        "objects proc_facts",
        """SELECT object_id, name FROM merged WHERE role = 'source' INTERSECT SELECT object_id, name FROM merged WHERE role = 'target'""",
        *RESOLVED,
    ),
)
def self_references(c):
    return resolve.self_references(resolve.resolve_definitions(c.definitions, c.objects))


@check(
    "C32_parse_diagnostics",
    with_ctes(
        "objects proc_facts",
        """SELECT t.object_id, t.regex_sources + t.regex_targets AS expected_tables, f.found_tables, t.regex_sources, t.regex_targets, t.regex_sp_calls,
          f.hint_inputs, f.hint_outputs, f.final_sources, f.final_targets, t.known / t.names AS catalog_validation_rate
        FROM (SELECT object_id, count(DISTINCT ref_id) FILTER (role = 'source') AS regex_sources, count(DISTINCT ref_id) FILTER (role = 'target') AS regex_targets,
            count(DISTINCT ref_id) FILTER (role = 'sp_call') AS regex_sp_calls,
            count(DISTINCT lower(name)) FILTER (role IN ('source', 'target')) AS names,
            count(DISTINCT lower(name)) FILTER (role IN ('source', 'target') AND ref_id IS NOT NULL) AS known FROM looked_up GROUP BY 1) t
        JOIN (SELECT object_id, count(*) FILTER (role = 'source') AS final_sources, count(*) FILTER (role = 'target') AS final_targets,
            count(*) FILTER (role IN ('source', 'target') AND ref_id IS NOT NULL) AS found_tables,
            count(*) FILTER (role = 'source' AND from_hint) AS hint_inputs, count(*) FILTER (role = 'target' AND from_hint) AS hint_outputs
          FROM merged GROUP BY 1) f ON f.object_id = t.object_id""",
        *RESOLVED,
    ),
)
def parse_diagnostics(c):
    texts = c.definitions
    # Both sides need what the texts say: it is read once.
    read = write_stage(extract.read_references(texts), "read")
    refs = resolve.resolve_ids(extract.extract_refs(texts, read=read), c.objects)
    return resolve.parse_diagnostics(refs, resolve.resolve_definitions(texts, c.objects, read=read))


@check(
    "C33_parse_definitions",
    with_ctes(
        "objects proc_facts",
        """SELECT o.object_id, CASE WHEN m.has_hints THEN 'parser_with_hints' ELSE 'parser' END AS source, f.object_id IS NOT NULL AS parse_success,
          CASE WHEN f.object_id IS NULL THEN 'No DDL definition found' END AS parse_error, coalesce(m.input_count, 0) AS input_count,
          coalesce(m.output_count, 0) AS output_count, coalesce(m.expected_count, 0) AS expected_count, coalesce(m.found_count, 0) AS found_count
        FROM objects o LEFT JOIN proc_facts f ON f.object_id = o.object_id
        LEFT JOIN (SELECT object_id, bool_or(from_hint) AS has_hints, count(ref_id) FILTER (role IN ('source', 'function')) AS input_count,
            count(ref_id) FILTER (role IN ('target', 'sp_call')) AS output_count,
            count(ref_id) FILTER (role IN ('source', 'target') AND from_text) AS expected_count,
            count(ref_id) FILTER (role IN ('source', 'target')) AS found_count FROM merged GROUP BY 1) m ON m.object_id = o.object_id
        WHERE o.object_type = 'Stored Procedure'""",
        *RESOLVED,
    ),
)
def parse_definitions(c):
    return resolve.parse_definitions(c.objects, c.definitions).drop("modify_date")


@check(
    "C34_failure_reason",
    with_ctes(
        "proc_facts lineage_metadata definitions",
        """SELECT d.object_id, concat_ws(' | ', CASE WHEN f.o_orderpriority = '5-LOW' THEN 'Dynamic SQL: EXEC(@variable) - table names unknown at parse time' END,
            CASE WHEN f.o_orderkey % 7 = 6 THEN 'Dynamic SQL: sp_executesql @variable - table names unknown at parse time' END,
            CASE WHEN f.o_orderpriority = '5-LOW' THEN 'WHILE loop: Iterative logic not supported by parser'
              WHEN coalesce(f.o_orderkey, 0) % 7 <> 6 OR f.o_orderkey IS NULL THEN 'Complex T-SQL patterns' END,
          CASE WHEN m.expected_count > 0 AND m.expected_count - m.found_count > 2 THEN 'Expected ' || m.expected_count || ' tables, found ' || m.found_count || ' (' || (m.expected_count - m.found_count) || ' missing)' END,
          '→ Add @LINEAGE_INPUTS/@LINEAGE_OUTPUTS comment hints to document dependencies') AS reason
        FROM definitions d LEFT JOIN proc_facts f ON f.object_id = d.object_id LEFT JOIN lineage_metadata m ON m.object_id = d.object_id""",
    ),
)
def failure_reason(c):
    counts = c.metadata.select("object_id", "expected_count", "found_count")
    reason = resolve.failure_reason(F.col("definition"), None, F.coalesce("expected_count", F.lit(0)), F.coalesce("found_count", F.lit(0)))
    return c.definitions.join(counts, "object_id", "left").select("object_id", reason.alias("reason"))


@check(
    "C37_distinct_commands",
    with_ctes("query_logs", "SELECT DISTINCT command_text FROM query_logs WHERE command NOT IN ('error', 'signup')"),
)
def distinct_commands(c):
    return resolve.distinct_commands(c.query_logs)


LOG_REFS = """log_refs AS (SELECT DISTINCT command_text, 'source' AS role, 'dbo.tbl' || CASE command WHEN 'view' THEN CAST(session_id AS VARCHAR) ELSE '2' END AS name_key
    FROM query_logs WHERE command IN ('view', 'purchase')
  UNION SELECT DISTINCT command_text, 'target', CASE command WHEN 'click' THEN 'dbo.tbl5' ELSE 'consumption_finance.dim' || CAST(session_id AS VARCHAR) END
    FROM query_logs WHERE command IN ('click', 'purchase'))"""


@check(
    "C38_validate_with_logs",
    with_ctes(
        "objects lineage_edges query_logs",
        """SELECT r.command_text, r.role, n.full_name AS name, n.ref_id,
          CASE r.role WHEN 'source' THEN n.ref_id IN (SELECT source_id FROM lineage_edges) ELSE n.ref_id IN (SELECT target_id FROM lineage_edges) END AS confirmed
        FROM log_refs r JOIN names n ON n.kind = 'table' AND n.name_key = r.name_key""",
        CATALOG_NAMES,
        LOG_REFS,
    ),
)
def validate_with_logs(c):
    return resolve.validate_with_logs(c.query_logs, c.edges, c.objects)


@check("C14_dynamic_references", with_ctes("objects proc_facts", "SELECT object_id, role, name FROM dynamic", DYNAMIC))
def dynamic_references(c):
    return dynamic.dynamic_refs(c.definitions).select("object_id", "role", "name")


@check(
    "D3_edges_with_dynamic",
    with_ctes(
        "objects proc_facts",
        """SELECT source_id, target_id, owner_id, min(edge_type) AS edge_type FROM (SELECT *, 'dependency' AS edge_type FROM parsed_edges
          UNION ALL SELECT CASE d.role WHEN 'source' THEN n.ref_id ELSE d.object_id END, CASE d.role WHEN 'source' THEN d.object_id ELSE n.ref_id END, d.object_id, 'dynamic'
          FROM dynamic d JOIN names n ON n.kind = 'table' AND n.name_key = lower(d.name)) GROUP BY 1, 2, 3""",
        *RESOLVED,
        PARSED_EDGES,
        DYNAMIC,
    ),
)
def edges_with_dynamic(c):
    resolved = resolve.resolve_definitions(c.definitions, c.objects)
    return dynamic.with_dynamic(graph.parsed_edges(resolved), c.definitions, c.objects)


@check(
    "D3_parsed_edges",
    with_ctes("objects proc_facts", "SELECT source_id, target_id, owner_id FROM parsed_edges", *RESOLVED, PARSED_EDGES),
)
def parsed_edges(c):
    return graph.parsed_edges(resolve.resolve_definitions(c.definitions, c.objects)).select("source_id", "target_id", "owner_id")
