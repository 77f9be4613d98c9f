"""Registration of checks and access to the derived catalog."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadline.functions import names
from threadline.operators.adjacency import Adjacency, read_adjacency, write_adjacency
from threadline.plans.derived_catalog import TABLES, ctes, documents, load_table
from threadline.session import scratch_dir
from threadline.sources.contracts import NODE_TYPES

_clustered: dict[tuple[str, str], str] = {}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


class Catalog:
    """The derived tables of one data folder as attributes."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name not in TABLES:
            raise AttributeError(name)
        return load_table(self.spark, self.sf_dir, name)

    @property
    def edges(self) -> DataFrame:
        return self.lineage_edges

    @property
    def adjacency(self) -> Adjacency:
        """The edges as a state keeps them for traversals; written once per application."""
        key = (self.spark.sparkContext.applicationId, self.sf_dir)
        if key not in _clustered:
            folder = scratch_dir(self.spark, "adjacency")
            write_adjacency(self.edges, folder)
            _clustered[key] = folder
        return read_adjacency(self.spark, _clustered[key])

    @property
    def metadata(self) -> DataFrame:
        return self.lineage_metadata

    @property
    def documents(self) -> DataFrame:
        return documents(self.spark, self.sf_dir)

    @property
    def nodes(self) -> DataFrame:
        return node_table(self.objects)


def node_table(objects: DataFrame) -> DataFrame:
    return objects.where(F.col("object_type").isin(*NODE_TYPES)).select(
        F.col("object_id").alias("id"),
        F.col("object_name").alias("name"),
        F.col("schema_name").alias("schema"),
        "object_type",
        names.classify_model(F.col("object_name"), F.col("object_type")).alias("data_model_type"),
    )


MODEL_SQL = """CASE WHEN object_type IN ('Table', 'View') THEN
  CASE WHEN regexp_matches(object_name, '(?i)^(Dim|vw_Dim|v_Dim|vwDim|vDim)') THEN 'Dimension'
       WHEN regexp_matches(object_name, '(?i)^(Fact|vw_Fact|v_Fact|vwFact|vFact)') THEN 'Fact' ELSE 'Other' END
  ELSE 'Other' END"""

NODES_CTE = f"""nodes AS (SELECT object_id AS id, object_name AS name, schema_name AS "schema", object_type,
  {MODEL_SQL} AS data_model_type FROM objects WHERE object_type IN ('Table', 'View', 'Stored Procedure'))"""


def with_ctes(tables: str, select: str, *extra: str) -> str:
    """SQL over derived tables (space-separated names), with further CTEs before the select."""
    head = ctes(*tables.split())
    return ",\n".join([head, *extra]) + "\n" + select


def check(name: str, sql: str | None = None):
    def register(fn: Callable[[Catalog], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: fn(Catalog(spark, sf_dir))
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return register


def joined(col: str | Column, separator: str = ",") -> Column:
    """A list as text, for comparison across engines."""
    col = F.col(col) if isinstance(col, str) else col
    return F.array_join(F.transform(col, lambda x: x.cast("string")), separator)
