"""Expansion: the relationships and neighbours of many nodes at once."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.model import PropertyGraph

OUT, IN, BOTH = "outgoing", "incoming", "both"


#: Up to so many ids that are given as values are put into the filter of the arcs' scan.
FEW = 200


def few(ids: DataFrame | str | Iterable[str]) -> list[str] | None:
    """The ids, if they are values and few."""
    if isinstance(ids, DataFrame):
        return None
    ids = [ids] if isinstance(ids, str) else list(ids)
    return ids if len(ids) <= FEW else None


def as_ids(graph: PropertyGraph, ids: DataFrame | str | Iterable[str]) -> DataFrame:
    """(seed) from an id, ids or a frame with a column ``id``; repeated seeds count once."""
    if isinstance(ids, DataFrame):
        return ids.select(F.col("id").alias("seed")).distinct()
    ids = [ids] if isinstance(ids, str) else list(ids)
    return graph.spark.createDataFrame([(i,) for i in dict.fromkeys(ids)], "seed string")


def existing(graph: PropertyGraph, ids: DataFrame, column: str) -> DataFrame:
    """The rows whose id is a node's."""
    nodes = graph.vertices().select(F.col("id").alias("known_id"))
    return ids.join(nodes, F.col(column) == F.col("known_id"), "left_semi")


def starting(graph: PropertyGraph, ids: DataFrame | str | Iterable[str]) -> DataFrame:
    """(seed): the ids that are nodes', once each; a few values go into the scans' filters."""
    ids = ids if isinstance(ids, (DataFrame, str)) else list(ids)
    if (values := few(ids)) is None:
        return existing(graph, as_ids(graph, ids), "seed")
    return graph.vertices().where(F.col("id").isin(values)).select(F.col("id").alias("seed")).distinct()


def arcs(edges: DataFrame, direction: str = BOTH) -> DataFrame:
    """(here, there, rel_id, type): each relationship as seen from the end that is left.

    ``both`` gives outgoing and incoming arcs, so a self-loop gives two.
    """
    seen = lambda a, b: edges.select(F.col(a).alias("here"), F.col(b).alias("there"), "rel_id", "type")
    if direction == OUT:
        return seen("src", "dst")
    if direction == IN:
        return seen("dst", "src")
    if direction == BOTH:
        return seen("src", "dst").unionAll(seen("dst", "src"))
    raise ValueError(f"no direction {direction!r}: {OUT}, {IN} or {BOTH}")


def step_arcs(graph: PropertyGraph, types: Iterable[str] | None, direction: str) -> DataFrame:
    """Arcs of the types; those to a missing node are left out."""
    found = arcs(graph.edges(types), direction)
    return found if graph.whole else existing(graph, found, "there")


def far_labels(graph: PropertyGraph, types: Iterable[str] | None, direction: str) -> frozenset[str] | None:
    """Labels of which every node at the far end of such arcs carries one; None if that isn't known."""
    found: set[str] = set()
    for t in types or graph.types:
        if (table := graph.rels.get(t)) is not None:
            sides = {OUT: [table.ends], IN: [table.starts], BOTH: [table.starts, table.ends]}[direction]
            if not all(sides):
                return None
            found.update(*sides)
    return frozenset(found)


def neighbors(
    graph: PropertyGraph, ids: DataFrame | str | Iterable[str], types: Iterable[str] | None = None, direction: str = BOTH
) -> DataFrame:
    """(seed, id, rel_id, type): one row for each relationship, so parallel ones repeat the neighbour."""
    ids = ids if isinstance(ids, (DataFrame, str)) else list(ids)
    steps = step_arcs(graph, types, direction)
    if (values := few(ids)) is not None:
        steps = steps.where(F.col("here").isin(values))
    found = as_ids(graph, ids).join(steps, F.col("seed") == F.col("here"))
    return found.select("seed", F.col("there").alias("id"), "rel_id", "type")


def relationships_of(
    graph: PropertyGraph, ids: DataFrame | str | Iterable[str], types: Iterable[str] | None = None, direction: str = BOTH
) -> DataFrame:
    """(seed, rel_id, type, src, dst) of the relationships that touch each node."""
    found = neighbors(graph, ids, types, direction).select("seed", "rel_id", "type")
    return found.join(graph.edges(types).drop("type"), "rel_id").select("seed", "rel_id", "type", "src", "dst")


def edge_types(graph: PropertyGraph, ids: DataFrame | str | Iterable[str], direction: str = BOTH) -> DataFrame:
    """(seed, type): which types of relationships each node has."""
    return neighbors(graph, ids, None, direction).select("seed", "type").distinct()


def degrees(graph: PropertyGraph, types: Iterable[str] | None = None, direction: str = BOTH) -> DataFrame:
    """(id, degree) of nodes that have any such relationship."""
    found = step_arcs(graph, types, direction)
    return found.groupBy(F.col("here").alias("id")).agg(F.count(F.lit(1)).alias("degree"))
