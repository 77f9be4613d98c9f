"""Connected components of a graph given as pairs of numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadline.llm.common import stage


def components(pairs: DataFrame) -> DataFrame:
    """``node, component`` (the smallest node reachable) for every node of ``pairs`` (columns a, b).

    The graph is contracted: every node takes the smallest of itself and its neighbours as its name,
    and pairs that then join a name with itself vanish. An edge from a node to its new name stays
    in the graph as an edge between the two names, so nothing is cut. All that is kept between
    rounds are tables in the shared folder; the driver sees one count for each round. Rows of one
    node are never gathered: neighbourhoods are only reduced to their minimum, and joins look up
    one row per node. Pairs of equal or null nodes are ignored; an empty table gives no rows.
    """
    edges = stage(
        pairs.where(F.col("a") != F.col("b"))
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct(),
        "edges",
    )
    names = None
    while True:
        both = edges.union(edges.select("b", "a"))
        lower = stage(
            both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("name")), "names"
        )
        if lower.isEmpty():
            break
        if names is None:
            names = lower
        else:
            names = stage(
                names.join(lower.select(F.col("node").alias("name"), F.col("name").alias("next")), "name", "left").select(
                    "node", F.coalesce("next", "name").alias("name")
                ),
                "names",
            )
        at = lambda side, out: lower.select(F.col("node").alias(side), F.col("name").alias(out))
        half = stage(edges.join(at("a", "x"), "a").select("b", "x"), "edges")
        edges = stage(
            half.join(at("b", "y"), "b")
            .where(F.col("x") != F.col("y"))
            .select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b"))
            .distinct(),
            "edges",
        )
    if names is None:
        return pairs.select(F.col("a").alias("node"), F.col("b").alias("component")).limit(0)
    return names.withColumnRenamed("name", "component")
