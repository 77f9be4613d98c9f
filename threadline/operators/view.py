"""The graph a user looks at: all filters in their order."""

from __future__ import annotations

from pyspark.sql import DataFrame

from threadline.operators.filters import VISIBLE_NODES, drop_isolated, filter_nodes, top_nodes, visible_edges
from threadline.operators.traverse import reachable_from_focus
from threadline.session import write_stage


def visible_graph(
    nodes: DataFrame,
    edges: DataFrame,
    schemas: list[str] | None = None,
    object_types: list[str] | None = None,
    model_types: list[str] | None = None,
    exclude: list[str] | None = None,
    focus_schemas: list[str] | None = None,
    highlighted: DataFrame | None = None,
    traced: DataFrame | None = None,
    hide_isolated: bool = True,
    k: int = VISIBLE_NODES,
) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) to show.

    Isolated nodes go first, then facets, exclusion patterns and the trace apply, then what does not
    connect to the focus schemas goes, then the ``k`` most important nodes stay (``priority``), and
    of two-way pairs of edges one is left, flagged. ``highlighted`` (id) and their neighbours are
    never cut.
    """
    shown = drop_isolated(nodes, edges) if hide_isolated else nodes
    shown = write_stage(filter_nodes(shown, schemas, object_types, model_types, exclude, traced), "view-filtered")
    shown = reachable_from_focus(shown, edges, focus_schemas or [])
    chosen = shown.select("id").limit(0) if highlighted is None else highlighted
    shown = write_stage(top_nodes(shown, edges, chosen, k), "view-nodes")
    return shown, visible_edges(shown, edges)
