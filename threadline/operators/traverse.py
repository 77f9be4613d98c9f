"""Traversals: level traces, paths, reachability.

Each level joins the frontier with the edges, keeps ids not seen before, and is written to the
shared folder by one job that also counts it. The loop ends on an empty level; only the count
reaches the driver. The planner sees the written size of a level, so a small frontier is
broadcast and a large one is shuffled, where the adaptive skew join splits the edges of hubs.

Edges are a table (source_id, target_id) or, for more than a few traversals, an
:class:`~threadline.operators.adjacency.Adjacency`, whose levels read only what the frontier touches.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadline.functions import names
from threadline.operators.adjacency import Adjacency
from threadline.operators.filters import facet_condition
from threadline.operators.graph import node_edges
from threadline.session import scratch_dir, write_counted, write_stage

# Levels of a trace unless asked otherwise.
DEFAULT_LEVELS = 3

_BACK = {"downstream": "upstream", "upstream": "downstream"}


@dataclass(frozen=True)
class TraceRequest:
    """A trace: start (and end) node, levels per direction (None = all), filters."""

    start: object
    end: object | None = None
    upstream: int | None = DEFAULT_LEVELS
    downstream: int | None = DEFAULT_LEVELS
    schemas: list[str] | None = None
    model_types: list[str] | None = None
    exclude: list[str] = field(default_factory=list)

    def condition(self) -> Column:
        return facet_condition(self.schemas, None, self.model_types) & ~names.matches_any(F.col("name"), self.exclude)


@dataclass(frozen=True)
class _Scan:
    """Steps over a plain edge table: every level reads all of it."""

    edges: DataFrame

    def reach(self, frontier: DataFrame, count: int, going: list[str]) -> DataFrame:
        steps = self.edges.select(F.explode(F.array(*[_step(w) for d in going for w in _ways(d)])).alias("s")).select("s.*")
        here = frontier.withColumnRenamed("id", "at")
        return steps.join(here, ["at", "direction"], "left_semi").select("id", "direction").distinct()


def _walk(
    edges: DataFrame | Adjacency,
    seeds: DataFrame,
    limits: dict[str, int | None],
    label: str,
    allowed: DataFrame | None = None,
    stop: object | None = None,
) -> DataFrame:
    """(id, direction, depth) of everything reachable from the seeds, depth minimal.

    A plain edge table must already be restricted to allowed ids, or ``allowed`` (id) is given and the
    ids that a level reaches are held against it. ``seeds`` is (id). ``downstream`` walks source →
    target, ``upstream`` the other way, ``any`` ignores the direction of edges. All directions advance
    together, one job per level. Nothing goes on behind the id ``stop``.
    """
    steps = edges if isinstance(edges, Adjacency) else _Scan(edges)
    spark = seeds.sparkSession
    root = scratch_dir(spark, label)
    keys = T.StructType([seeds.schema["id"], T.StructField("direction", T.StringType())])
    with_depth = T.StructType([*keys.fields, T.StructField("depth", T.IntegerType())])

    start = seeds.select("id", F.explode(F.array(*[F.lit(d) for d in limits])).alias("direction")).distinct()
    count, level = write_counted(start, f"{root}/depth=0"), 0
    while count:
        going = [d for d, limit in limits.items() if limit is None or level < limit]
        if not going:
            break
        frontier = spark.read.schema(keys).parquet(f"{root}/depth={level}").where(F.col("direction").isin(*going))
        if stop is not None:
            frontier = frontier.where(F.col("id") != F.lit(stop))
        seen = spark.read.schema(with_depth).parquet(root).select("id", "direction")
        reached = steps.reach(frontier, count, going)
        if allowed is not None:
            reached = reached.join(allowed, "id", "left_semi")
        level += 1
        count = write_counted(reached.join(seen, ["id", "direction"], "left_anti"), f"{root}/depth={level}")
    return spark.read.schema(with_depth).parquet(root)


def _ways(direction: str) -> list[tuple[str, str]]:
    return [(direction, "downstream"), (direction, "upstream")] if direction == "any" else [(direction, direction)]


def _step(way: tuple[str, str]) -> Column:
    """One edge as a step: where it starts, where it leads, and the walk it belongs to."""
    direction, orientation = way
    if orientation not in ("downstream", "upstream"):
        raise ValueError(f"unknown direction: {direction}")
    ends = ("source_id", "target_id") if orientation == "downstream" else ("target_id", "source_id")
    return F.struct(F.col(ends[0]).alias("at"), F.col(ends[1]).alias("id"), F.lit(direction).alias("direction"))


def _oriented(edges: DataFrame, direction: str) -> DataFrame:
    if direction == "downstream":
        return edges.select("source_id", "target_id")
    if direction == "upstream":
        return edges.select(F.col("target_id").alias("source_id"), F.col("source_id").alias("target_id"))
    raise ValueError(f"unknown direction: {direction}")


def _allowed_edges(nodes: DataFrame, edges: DataFrame, label: str) -> DataFrame:
    """Edges between allowed nodes, written once because every level reads them."""
    return write_stage(node_edges(edges.select("source_id", "target_id").distinct(), nodes), label)


def _pairs(edges: DataFrame | Adjacency) -> DataFrame:
    return edges.edges() if isinstance(edges, Adjacency) else edges.select("source_id", "target_id").distinct()


def trace(nodes: DataFrame, edges: DataFrame | Adjacency, request: TraceRequest) -> DataFrame:
    """(id, direction, depth) of a level trace, both directions.

    A node that fails the filter is neither reported nor passed through; if the start fails,
    the result is empty. Clustered edges, and a plain table for a given number of levels, are read
    where they are and the ids that a level reaches are tested; a trace without limit over a plain
    table first writes the edges between allowed nodes, since it may need most of them many times.
    """
    allowed = nodes.where(request.condition())
    seeds = allowed.where(F.col("id") == F.lit(request.start)).select("id")
    limits = {"upstream": request.upstream, "downstream": request.downstream}
    if isinstance(edges, Adjacency):
        ids = write_stage(allowed.select("id"), "trace-allowed")  # every level holds what it reaches against them
        return _walk(edges, ids.where(F.col("id") == F.lit(request.start)), limits, "trace", ids)
    if None in limits.values():
        return _walk(_allowed_edges(allowed, edges, "trace-edges"), seeds, limits, "trace")
    return _walk(edges.select("source_id", "target_id"), seeds, limits, "trace", allowed.select("id"))


def path_nodes(
    nodes: DataFrame, edges: DataFrame | Adjacency, request: TraceRequest, direction: str = "downstream", max_depth: int | None = None
) -> DataFrame:
    """(id, from_start, to_end) of the nodes on routes from start to end.

    A route neither returns to the start nor goes on behind the end. Found are the nodes that the
    start reaches and that reach the end, with minimal distances; nodes whose shortest route is
    longer than ``max_depth`` are left out. A node whose ways to and from it share a node, so that
    it is on no route free of repetition, may still be among them (:func:`route_nodes` is exact).
    The filter applies to every node but the start.
    """
    start, end = F.lit(request.start), F.lit(request.end)
    allowed = nodes.where(request.condition() | (F.col("id") == start))
    seeds = allowed.where(F.col("id") == start)
    if isinstance(edges, Adjacency):
        if direction not in _BACK:
            raise ValueError(f"unknown direction: {direction}")
        ahead = _walk(edges, seeds, {direction: max_depth}, "path-ahead", allowed.select("id"), request.end)
        goal = ahead.where(F.col("id") == end)
        back = _walk(edges, goal, {_BACK[direction]: max_depth}, "path-back", ahead.select("id"), request.start)
    else:
        whole = _oriented(node_edges(_pairs(edges), allowed), direction)
        usable = write_stage(whole.where((F.col("target_id") != start) & (F.col("source_id") != end)), "path-edges")
        ahead = _walk(usable, seeds, {"downstream": max_depth}, "path-ahead")
        goal = ahead.where(F.col("id") == end)
        # Walking back from the end only through what the start reaches keeps the second pass small.
        back = _walk(node_edges(usable, ahead), goal, {"upstream": max_depth}, "path-back")
    joined = ahead.select("id", F.col("depth").alias("from_start")).join(
        back.select("id", F.col("depth").alias("to_end")), "id"
    )
    if max_depth is not None:
        joined = joined.where(F.col("from_start") + F.col("to_end") <= max_depth)
    return joined


def paths(
    nodes: DataFrame, edges: DataFrame | Adjacency, request: TraceRequest, max_depth: int, direction: str = "downstream"
) -> DataFrame:
    """(path): every route without repeated node from start to end of at most ``max_depth`` edges.

    Half routes grow from the start and from the end, inside :func:`path_nodes` and only while the
    other end is still within reach, and meet on the node in the middle: a route of n edges is a first
    half of n/2 edges, rounded up, and a second half of the rest that share that node alone. Halves
    are far fewer than whole partial routes, and each route is found once.
    """
    inside = write_stage(path_nodes(nodes, edges, request, direction, max_depth), "paths-nodes")
    usable = node_edges(_oriented(_pairs(edges), direction), inside)
    ends = lambda side: inside.select(F.col("id").alias(f"{side}_id"), F.col("from_start" if side == "source" else "to_end"))
    steps = write_stage(usable.join(ends("target"), "target_id").join(ends("source"), "source_id"), "paths-steps")
    first = _half_routes(inside, steps, request.start, request.end, ("source_id", "target_id", "to_end"), -(-max_depth // 2), max_depth)
    second = _half_routes(inside, steps, request.end, request.start, ("target_id", "source_id", "from_start"), max_depth // 2, max_depth)
    found = None
    for length in range(max_depth + 1):
        i, j = -(-length // 2), length // 2
        if i >= len(first) or j >= len(second):
            break
        tail = second[j].select("at", F.reverse("path").alias("tail"))
        whole = first[i].join(tail, "at").where(F.size(F.array_intersect("path", "tail")) == 1)
        part = whole.select(F.concat("path", F.slice("tail", 2, F.greatest(F.size("tail") - 1, F.lit(0)))).alias("path"))
        found = part if found is None else found.unionByName(part)
    return found


def _half_routes(
    inside: DataFrame, steps: DataFrame, start: object, end: object, columns: tuple[str, str, str], depth: int, max_depth: int
) -> list[DataFrame]:
    """(path, at) of the routes of 0 to ``depth`` edges from one end; none goes on behind the other end."""
    at, to, left = columns
    level = write_stage(inside.where(F.col("id") == F.lit(start)).select(F.array("id").alias("path"), F.col("id").alias("at")), "paths-0")
    found = [level]
    for length in range(1, depth + 1):
        grown = (
            level.where(F.col("at") != F.lit(end))
            .join(steps.select(F.col(at).alias("at"), F.col(to).alias("to"), F.col(left).alias("left")), "at")
            .where((F.lit(length) + F.col("left") <= max_depth) & ~F.array_contains(F.col("path"), F.col("to")))
            .select(F.array_append("path", F.col("to")).alias("path"), F.col("to").alias("at"))
        )
        level = write_stage(grown, f"paths-{length}")
        if level.isEmpty():
            break
        found.append(level)
    return found


def route_nodes(
    nodes: DataFrame, edges: DataFrame | Adjacency, request: TraceRequest, max_depth: int, direction: str = "downstream"
) -> DataFrame:
    """(id) of the nodes on routes without repetition from start to end of at most ``max_depth`` edges: exact."""
    return paths(nodes, edges, request, max_depth, direction).select(F.explode("path").alias("id")).distinct()


def reachable_from_focus(nodes: DataFrame, edges: DataFrame | Adjacency, focus_schemas: list[str]) -> DataFrame:
    """Visible nodes of the focus schemas and whatever connects to them inside the visible set.

    Direction of edges does not matter. Without focus schemas all nodes stay.
    """
    if not focus_schemas:
        return nodes
    seeds = nodes.where(F.col("schema").isin(*focus_schemas)).select("id")
    if isinstance(edges, Adjacency):
        found = _walk(edges, seeds, {"any": None}, "focus", nodes.select("id"))
    else:
        found = _walk(_allowed_edges(nodes, edges, "focus-edges"), seeds, {"any": None}, "focus")
    return nodes.join(found.select("id"), "id", "left_semi")
