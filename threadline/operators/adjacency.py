"""Edges clustered for traversals.

Every edge is stored twice, bucketed and sorted by the node a step starts from: ``outgoing`` by the
source, ``incoming`` by the target. A level of a traversal then reads only the buckets that its
frontier touches, and a frontier too large for a broadcast is merged with the buckets where they lie;
the edges themselves are never exchanged. Nodes with so many edges that one bucket would hold much more
than its share are hubs: their edges lie apart, spread over many files, and meet the frontier's hubs by
broadcast. There are fewer hubs than buckets by construction, so that broadcast has a bound.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadline.session import write_stage
from threadline.sources.clustered import bucket_count, read_clustered, write_clustered

#: A hub has this many times the rows of an average bucket, and at least HUB_ROWS.
HUB_SHARE = 4
HUB_ROWS = 100_000
#: Frontiers of at most this many ids are literals of the scan, which prunes buckets and row groups.
LITERALS = 1000

LAYOUT = "buckets int, kind string, hub_ways array<string>"
DIRECTIONS = {"downstream": "outgoing", "upstream": "incoming"}


@dataclass(frozen=True)
class Adjacency:
    """Tables (at, id) of one step downstream (outgoing) and upstream (incoming), and those of hubs."""

    outgoing: DataFrame
    incoming: DataFrame
    hub_outgoing: DataFrame
    hub_incoming: DataFrame
    hubs: DataFrame  # (at, way), fewer than buckets
    hub_ways: frozenset[str]  # ways in which there are hubs at all

    def edges(self) -> DataFrame:
        """(source_id, target_id), distinct."""
        plain, *hubs = self._tables("downstream")
        both = plain.unionByName(hubs[0]) if hubs else plain
        return both.select(F.col("at").alias("source_id"), F.col("id").alias("target_id"))

    def _tables(self, way: str) -> list[DataFrame]:
        """The steps of a way, those of hubs last if there are any."""
        if way not in DIRECTIONS:
            raise ValueError(f"unknown direction: {way}")
        name = DIRECTIONS[way]
        return [getattr(self, name), *([getattr(self, f"hub_{name}")] if way in self.hub_ways else [])]

    def step_from(self, ids: list, way: str) -> DataFrame:
        """(id) one step from a short list of ids, which prunes buckets and row groups; with repetitions."""
        plain, *hubs = (t.where(F.col("at").isin(ids)).select("id") for t in self._tables(way))
        return plain.unionByName(hubs[0]) if hubs else plain

    def step(self, frontier: DataFrame, way: str) -> DataFrame:
        """(id) one step from a frontier (id) of any size; with repetitions."""
        here = frontier.select(F.col("id").alias("at"))
        plain, *hubs = self._tables(way)
        found = plain.join(here, "at", "left_semi").select("id")
        if not hubs:
            return found
        own_hubs = self.hubs.where(F.col("way") == way).select("at").join(here, "at", "left_semi")  # fewer than buckets
        return found.unionByName(hubs[0].join(F.broadcast(own_hubs), "at", "left_semi").select("id"))

    def reach(self, frontier: DataFrame, count: int, going: list[str]) -> DataFrame:
        """(id, direction) one step from the frontier (id, direction) of ``count`` rows; ``any`` goes both ways."""
        few = frontier.select("id", "direction").collect() if count <= LITERALS else None
        found = None
        for direction in going:
            own = frontier.where(F.col("direction") == direction)
            ids = None if few is None else [r["id"] for r in few if r["direction"] == direction]
            for way in DIRECTIONS if direction == "any" else (direction,):
                part = self.step(own, way) if ids is None else self.step_from(ids, way)
                part = part.withColumn("direction", F.lit(direction))
                found = part if found is None else found.unionByName(part)
        return found.distinct()


def write_adjacency(edges: DataFrame, folder: str, buckets: int | None = None) -> None:
    """Write the clustered form of edges (source_id, target_id) into a folder that must not exist yet.

    Repeated edges count once; an edge with a null end is no step.
    """
    spark = edges.sparkSession
    root = folder.rstrip("/")
    known = edges.select("source_id", "target_id").where("source_id IS NOT NULL AND target_id IS NOT NULL")
    total = known.count()
    buckets = buckets or bucket_count(spark, total)
    limit = max(HUB_ROWS, HUB_SHARE * total // buckets)
    ways = {"downstream": ("source_id", "target_id"), "upstream": ("target_id", "source_id")}
    degrees = known.select(F.explode(F.array(*[F.struct(F.col(a).alias("at"), F.lit(w).alias("way")) for w, (a, _) in ways.items()])).alias("s"))
    hubs = write_stage(degrees.select("s.*").groupBy("at", "way").count().where(F.col("count") > limit).select("at", "way"), "hubs")
    hubs.write.parquet(f"{root}/hubs")
    for way, (at, to) in ways.items():
        steps = known.select(F.col(at).alias("at"), F.col(to).alias("id"))
        own = F.broadcast(hubs.where(F.col("way") == way).select("at"))  # fewer rows than buckets
        clustered = steps.join(own, "at", "left_anti").repartition(buckets, "at").dropDuplicates(["at", "id"])
        write_clustered(clustered, f"{root}/{DIRECTIONS[way]}", "at", buckets, ("id",))
        steps.join(own, "at", "left_semi").distinct().write.parquet(f"{root}/hub_{DIRECTIONS[way]}")
    kind = known.schema["source_id"].dataType.simpleString()
    hub_ways = [r["way"] for r in hubs.select("way").distinct().collect()]
    spark.createDataFrame([(buckets, kind, hub_ways)], LAYOUT).coalesce(1).write.json(f"{root}/layout")


def read_adjacency(spark: SparkSession, folder: str) -> Adjacency:
    """The clustered edges of a folder, declared to the session as bucketed tables."""
    root = folder.rstrip("/")
    layout = spark.read.schema(LAYOUT).json(f"{root}/layout").first()
    schema = T.StructType.fromDDL(f"at {layout['kind']}, id {layout['kind']}")
    clustered = lambda part: read_clustered(spark, f"{root}/{part}", schema, "at", layout["buckets"], ("id",))
    plain = lambda part: spark.read.schema(schema).parquet(f"{root}/{part}")
    hubs = spark.read.schema(f"at {layout['kind']}, way string").parquet(f"{root}/hubs")
    return Adjacency(
        clustered("outgoing"), clustered("incoming"), plain("hub_outgoing"), plain("hub_incoming"), hubs, frozenset(layout["hub_ways"] or ())
    )
