"""A catalog derived from order, part, supplier, customer and event tables.

Every source row takes part: each order is a procedure, each part and customer a table, each
supplier a view, each nation a function and each region a hub table that every procedure of
that region reads. Ids carry the kind in the last digit, so they never collide at any scale.

The SQL is written once for Spark and for a checking engine; ``{ts}`` is the name of the
timestamp type without time zone.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from threadline.session import bound_broadcasts, scratch_dir

BASE_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents")

PROC, PART, VIEW, FUNC, CUST, REGION, STALE, ORPHAN = 1, 2, 3, 4, 5, 6, 7, 9


#: Files of texts for each core, so that no core waits long for the last.
FILES_PER_CORE = 4


def _id(key: str, kind: int) -> str:
    return f"CAST({key} * 10 + {kind} AS BIGINT)"


def _text(key: str) -> str:
    return f"CAST({key} AS VARCHAR(20))"


def part_schema(key: str) -> str:
    return f"CASE {key} % 3 WHEN 0 THEN 'CONSUMPTION_FINANCE' WHEN 1 THEN 'TRANSFORMATION_SALES' ELSE 'dbo' END"


def part_name(key: str) -> str:
    return f"CASE {key} % 4 WHEN 0 THEN 'Dim' WHEN 1 THEN 'Fact' ELSE 'Tbl' END || {_text(key)}"


def proc_schema(status: str) -> str:
    return f"CASE {status} WHEN 'F' THEN 'STAGING_FINANCE' WHEN 'O' THEN 'STAGING_SALES' ELSE 'STAGING_HR' END"


CATALOG_SQL: dict[str, str] = {
    "objects": f"""
SELECT {_id('o_orderkey', PROC)} AS object_id, {proc_schema('o_orderstatus')} AS schema_name,
       'spLoad' || {_text('o_orderkey')} AS object_name, 'Stored Procedure' AS object_type,
       CAST(o_orderdate AS {{ts}}) AS modify_date FROM orders
UNION ALL
SELECT {_id('p_partkey', PART)}, {part_schema('p_partkey')}, {part_name('p_partkey')}, 'Table',
       CAST('2001-01-01 00:00:00' AS {{ts}}) FROM part
UNION ALL
SELECT {_id('s_suppkey', VIEW)}, 'CONSUMPTION_SALES',
       CASE WHEN s_suppkey % 2 = 0 THEN 'vw_Dim' ELSE 'vFact' END || {_text('s_suppkey')}, 'View',
       CAST('2001-01-01 00:00:00' AS {{ts}}) FROM supplier
UNION ALL
SELECT {_id('n_nationkey', FUNC)}, 'dbo', 'fn' || {_text('n_nationkey')}, 'Function',
       CAST('2001-01-01 00:00:00' AS {{ts}}) FROM nation
UNION ALL
SELECT {_id('c_custkey', CUST)}, 'STAGING_' || c_mktsegment, 'Cust' || {_text('c_custkey')}, 'Table',
       CAST('2001-01-01 00:00:00' AS {{ts}}) FROM customer
UNION ALL
SELECT {_id('r_regionkey', REGION)}, 'dbo', 'RegionMaster' || {_text('r_regionkey')}, 'Table',
       CAST('2001-01-01 00:00:00' AS {{ts}}) FROM region
""",
    "dependencies": f"""
SELECT d.referencing_object_id, d.referenced_object_id,
       o.schema_name AS referenced_schema_name, o.object_name AS referenced_entity_name
FROM (
  SELECT DISTINCT {_id('l_suppkey', VIEW)} AS referencing_object_id,
         CASE WHEN l_tax = 0.08 THEN CAST(NULL AS BIGINT) ELSE {_id('l_partkey', PART)} END AS referenced_object_id
  FROM lineitem
  UNION ALL
  SELECT DISTINCT {_id('l_orderkey', PROC)}, {_id('l_partkey', PART)} FROM lineitem
  UNION ALL
  SELECT DISTINCT {_id('l_orderkey', PROC)}, {_id('l_suppkey', VIEW)} FROM lineitem
  UNION ALL
  SELECT {_id('o.o_orderkey', PROC)}, {_id('p.o_orderkey', PROC)}
  FROM orders o JOIN orders p ON p.o_orderkey = o.o_orderkey - 1 WHERE o.o_orderpriority = '1-URGENT'
  UNION ALL
  SELECT {_id('a.s_suppkey', VIEW)}, {_id('b.s_suppkey', VIEW)}
  FROM supplier a JOIN supplier b ON b.s_suppkey = a.s_suppkey + 1 WHERE a.s_acctbal > b.s_acctbal
) d LEFT JOIN objects o ON o.object_id = d.referenced_object_id
""",
    "lineage_edges": f"""
SELECT DISTINCT source_id, target_id, owner_id, 'dependency' AS edge_type FROM (
  SELECT {_id('l_partkey', PART)} AS source_id, {_id('l_orderkey', PROC)} AS target_id, {_id('l_orderkey', PROC)} AS owner_id
  FROM lineitem WHERE l_linestatus = 'F' OR l_returnflag = 'R'
  UNION ALL
  SELECT {_id('l_orderkey', PROC)}, {_id('l_partkey', PART)}, {_id('l_orderkey', PROC)}
  FROM lineitem WHERE l_linestatus = 'O' OR l_returnflag = 'R'
  UNION ALL
  SELECT referenced_object_id, referencing_object_id, referencing_object_id
  FROM dependencies WHERE referencing_object_id % 10 = {VIEW} AND referenced_object_id IS NOT NULL
  UNION ALL
  SELECT {_id('o.o_orderkey', PROC)}, {_id('p.o_orderkey', PROC)}, {_id('o.o_orderkey', PROC)}
  FROM orders o JOIN orders p ON p.o_orderkey = o.o_orderkey - 1 WHERE o.o_orderpriority = '1-URGENT'
  UNION ALL
  SELECT {_id('n.n_regionkey', REGION)}, {_id('o.o_orderkey', PROC)}, {_id('o.o_orderkey', PROC)}
  FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey JOIN nation n ON n.n_nationkey = c.c_nationkey
  UNION ALL
  SELECT {_id('c.c_nationkey', FUNC)}, {_id('o.o_orderkey', PROC)}, {_id('o.o_orderkey', PROC)}
  FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey
) e
""",
    "lineage_metadata": f"""
SELECT {_id('o_orderkey', PROC)} AS object_id,
       CAST(CASE WHEN o_orderpriority = '2-HIGH' THEN o_orderdate - INTERVAL 1 DAY ELSE o_orderdate END AS {{ts}}) AS last_parsed_modify_date,
       'parser' AS primary_source, o_orderpriority <> '5-LOW' AS parse_success,
       CASE WHEN o_orderpriority = '5-LOW' THEN 'WHILE loop in load procedure number ' || {_text('o_orderkey')} ||
            ' cannot be followed by pattern matching, table names are unknown at parse time' END AS parse_failure_reason,
       CAST(o_custkey % 9 AS INTEGER) AS expected_count, CAST(o_custkey % 5 AS INTEGER) AS found_count
FROM orders WHERE o_orderstatus <> 'P'
UNION ALL
SELECT {_id('s_suppkey', VIEW)}, CAST('2001-01-01 00:00:00' AS {{ts}}), 'dmv', true, CAST(NULL AS VARCHAR(20)),
       CAST(NULL AS INTEGER), CAST(NULL AS INTEGER) FROM supplier WHERE s_acctbal > 1000
UNION ALL
SELECT {_id('p_partkey', PART)}, CAST(NULL AS {{ts}}), 'metadata', true, CAST(NULL AS VARCHAR(20)),
       CAST(NULL AS INTEGER), CAST(NULL AS INTEGER) FROM part WHERE p_size > 25
UNION ALL
SELECT {_id('r_regionkey', ORPHAN)}, CAST('2000-01-01 00:00:00' AS {{ts}}), CAST(NULL AS VARCHAR(20)), false,
       CAST(NULL AS VARCHAR(20)), CAST(NULL AS INTEGER), CAST(NULL AS INTEGER) FROM region
""",
    "table_columns": f"""
SELECT {_id('p_partkey', STALE)} AS object_id, {part_schema('p_partkey')} AS schema_name, {part_name('p_partkey')} AS table_name,
       'id' AS column_name, 'int' AS data_type, 4 AS max_length, 10 AS "precision", 0 AS scale, false AS is_nullable, 1 AS column_id
FROM part WHERE p_brand <> 'Brand#1'
UNION ALL
SELECT {_id('p_partkey', STALE)}, {part_schema('p_partkey')}, {part_name('p_partkey')}, 'label',
       CASE p_partkey % 4 WHEN 0 THEN 'varchar' WHEN 1 THEN 'nvarchar' WHEN 2 THEN 'char' ELSE 'nchar' END,
       CASE WHEN p_size > 40 THEN -1 ELSE 2 * p_size END, 0, 0, true, 2 FROM part WHERE p_brand <> 'Brand#1'
UNION ALL
SELECT {_id('p_partkey', STALE)}, {part_schema('p_partkey')}, {part_name('p_partkey')}, 'price', 'decimal', 9,
       18, p_size % 5, p_size > 10, 3 FROM part WHERE p_brand <> 'Brand#1'
UNION ALL
SELECT {_id('c_custkey', STALE)}, 'STAGING_' || c_mktsegment, 'Cust' || {_text('c_custkey')}, 'balance', 'numeric', 9,
       12, 2, c_acctbal < 0, 1 FROM customer
""",
    "proc_facts": f"""
SELECT o.o_orderkey, {_id('o.o_orderkey', PROC)} AS object_id, o.o_orderstatus, o.o_orderpriority,
       {proc_schema('o.o_orderstatus')} AS schema_name, 'spLoad' || {_text('o.o_orderkey')} AS object_name,
       {part_schema('l.first_part')} AS s1, {part_name('l.first_part')} AS n1,
       {part_schema('l.last_part')} AS s2, {part_name('l.last_part')} AS n2, l.n_lines,
       'STAGING_' || c.c_mktsegment AS cust_schema, 'Cust' || {_text('c.c_custkey')} AS cust_name,
       {_text('n.n_nationkey')} AS nation_key, {_text('n.n_regionkey')} AS region_key,
       CASE WHEN p.o_orderkey IS NOT NULL AND o.o_orderpriority = '1-URGENT'
            THEN {proc_schema('p.o_orderstatus')} || '.spLoad' || {_text('p.o_orderkey')} END AS called
FROM orders o
JOIN (SELECT l_orderkey, min(l_partkey) AS first_part, max(l_partkey) AS last_part, count(*) AS n_lines
      FROM lineitem GROUP BY l_orderkey) l ON l.l_orderkey = o.o_orderkey
JOIN customer c ON c.c_custkey = o.o_custkey
JOIN nation n ON n.n_nationkey = c.c_nationkey
LEFT JOIN orders p ON p.o_orderkey = o.o_orderkey - 1
""",
    "definitions": f"""
SELECT object_id, 'CREATE PROCEDURE [' || schema_name || '].[' || object_name || '] AS BEGIN ' || chr(10) ||
  CASE WHEN o_orderpriority = '3-MEDIUM' THEN '-- @LINEAGE_INPUTS: [' || cust_schema || '].[' || cust_name || '], dbo.Nope' || chr(10) ||
       '-- @LINEAGE_OUTPUTS: RegionMaster' || region_key || chr(10) ELSE '' END ||
  CASE WHEN called IS NOT NULL THEN 'EXEC ' || CASE WHEN o_orderkey % 2 = 1 THEN '@rc = ' ELSE '' END || called || ' @p; ' ELSE '' END ||
  CASE WHEN o_orderpriority = '5-LOW' THEN 'EXEC(@sql); WHILE 1=1 BEGIN SET @i = 1 END ' ELSE '' END ||
  CASE WHEN o_orderstatus = 'P' THEN '/* FROM dbo.RegionMaster0 */ WITH cte1 AS (SELECT 1 AS x) SELECT x FROM cte1; ' ELSE '' END ||
  'SELECT a, b FROM [' || s1 || '].[' || n1 || '] x INNER JOIN ' || cust_schema || '.' || cust_name ||
  ' c ON c.k = x.k CROSS APPLY dbo.fn' || nation_key || '(x.a) f; ' ||
  'INSERT INTO ' || lower(s2) || '.' || n2 || ' SELECT c1, c2 FROM #tmp t; ' ||
  CASE WHEN n_lines >= 6 THEN 'UPDATE r SET r.v = 1 FROM dbo.RegionMaster' || region_key || ' r; ' ELSE '' END ||
  CASE WHEN n_lines = 5 THEN 'SELECT a INTO dbo.NewT' || {_text('o_orderkey')} || ' FROM ' || s2 || '.' || n2 || '; ' ELSE '' END ||
  CASE WHEN n_lines = 3 THEN 'MERGE INTO ' || s1 || '.' || n1 || ' AS tgt USING ' || cust_schema || '.' || cust_name ||
       ' AS src ON tgt.k = src.k WHEN MATCHED THEN UPDATE SET tgt.v = 1; ' ELSE '' END ||
  CASE WHEN n_lines = 2 THEN 'DELETE FROM ' || s1 || '.' || n1 || ' WHERE 1 = 0; TRUNCATE TABLE ' || cust_schema || '.' || cust_name || '; ' ELSE '' END ||
  CASE WHEN n_lines = 4 THEN 'DELETE ' || s1 || '.' || n1 || ' OUTPUT deleted.* INTO ' || cust_schema || '.' || cust_name || ' WHERE 1 = 0; ' ELSE '' END ||
  CASE o_orderkey % 7
    WHEN 0 THEN 'SELECT ''copied FROM dbo.RegionMaster1 '' AS s FROM dbo.RegionMaster2; EXEC (''SELECT 1 FROM dbo.RegionMaster3 ''); '
    WHEN 1 THEN 'SELECT p.a FROM dbo.RegionMaster1 p, (SELECT b FROM dbo.RegionMaster2 q WITH (NOLOCK), dbo.RegionMaster3) s, [dbo].[RegionMaster4] WHERE p.a IN (1, 2); '
    WHEN 2 THEN 'UPDATE TOP (5) dbo.RegionMaster1 SET v = 1; DELETE TOP (10) FROM dbo.RegionMaster2 WHERE 1 = 0; '
    WHEN 3 THEN 'SELECT a FROM edw..RegionMaster1; '
    WHEN 4 THEN '/* a /* b */ FROM dbo.RegionMaster1 */ SELECT c FROM dbo.RegionMaster2; '
    WHEN 6 THEN 'DECLARE @q NVARCHAR(200) = N''INSERT INTO dbo.RegionMaster1 SELECT a FROM '' + @t + N'' x, dbo.RegionMaster2 WHERE b = c''; EXEC sp_executesql @q; '
    WHEN 5 THEN 'SELECT d FROM [O''Brien].[T1] -- it''s FROM dbo.RegionMaster1' || chr(10) || '; '
    ELSE '' END ||
  'COMMIT TRANSACTION; SELECT z FROM dbo.RegionMaster0 END' AS definition
FROM proc_facts
UNION ALL
SELECT {_id('s_suppkey', VIEW)}, 'CREATE VIEW [CONSUMPTION_SALES].[' ||
       CASE WHEN s_suppkey % 2 = 0 THEN 'vw_Dim' ELSE 'vFact' END || {_text('s_suppkey')} || '] AS SELECT * FROM ' ||
       {part_schema('s_suppkey')} || '.' || {part_name('s_suppkey')}
FROM supplier
""",
    "query_logs": """
SELECT event_id, ts AS start_time, user_id AS session_id, event_type AS command,
  CASE event_type WHEN 'view' THEN 'SELECT * FROM dbo.Tbl' || CAST(user_id AS VARCHAR(20))
  WHEN 'purchase' THEN 'INSERT INTO CONSUMPTION_FINANCE.Dim' || CAST(user_id AS VARCHAR(20)) || ' SELECT * FROM dbo.Tbl2'
  WHEN 'click' THEN 'update dbo.Tbl5 set x = 1' WHEN 'error' THEN 'KILL 51' ELSE 'SET NOCOUNT ON' END AS command_text
FROM events
""",
}

TABLES = tuple(CATALOG_SQL)

# Tables each derived table reads, in build order.
_READS = {
    "objects": (),
    "dependencies": ("objects",),
    "lineage_edges": ("dependencies",),
    "definitions": ("proc_facts",),
}


def _closure(names: tuple[str, ...]) -> list[str]:
    wanted: list[str] = []

    def add(name: str) -> None:
        for parent in _READS.get(name, ()):
            add(parent)
        if name not in wanted:
            wanted.append(name)

    for name in names:
        add(name)
    return wanted


def ctes(*names: str) -> str:
    """The WITH clause that defines the named tables (and what they read) for a checking engine."""
    return "WITH RECURSIVE " + ",\n".join(
        f"{name} AS ({CATALOG_SQL[name].format(ts='TIMESTAMP')})" for name in _closure(names)
    )


_written: dict[tuple[str, str], dict[str, tuple[str, StructType]]] = {}


def load_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived table of ``sf_dir``; it and what it reads are written once per application to the shared folder."""
    bound_broadcasts(spark)
    written = _written.setdefault((spark.sparkContext.applicationId, sf_dir), {})
    for wanted in _closure((name,)):
        if wanted not in written:
            written[wanted] = write_table(spark, sf_dir, wanted, written)
    path, schema = written[name]
    return spark.read.schema(schema).parquet(path)


def write_table(
    spark: SparkSession, sf_dir: str, name: str, written: dict[str, tuple[str, StructType]]
) -> tuple[str, StructType]:
    """Write one derived table; ``written`` has the path and schema of those that it reads."""
    prefix = "c" + hashlib.md5(sf_dir.encode()).hexdigest()[:8]
    sql = CATALOG_SQL[name].format(ts="TIMESTAMP_NTZ").replace('"precision"', "precision")
    aliases = []
    for table in (t for t in BASE_TABLES if re.search(rf"\b{t}\b", sql)):
        spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet").createOrReplaceTempView(f"{prefix}_{table}")
        aliases.append(f"{table} AS (SELECT * FROM {prefix}_{table})")
    for table in _READS.get(name, ()):
        rows = spark.read.schema(written[table][1]).parquet(written[table][0])
        if table == "proc_facts":  # work on texts is heavy: their short facts, not they, are spread over all cores
            rows = rows.repartition(FILES_PER_CORE * spark.sparkContext.defaultParallelism, "o_orderkey")
        rows.createOrReplaceTempView(f"{prefix}_{table}")
        aliases.append(f"{table} AS (SELECT * FROM {prefix}_{table})")
    found = spark.sql(f"WITH {', '.join(aliases)} {sql}")
    path = scratch_dir(spark, name)
    found.write.option("compression", "zstd").parquet(path)
    return path, found.schema


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
