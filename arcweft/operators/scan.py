"""Scans and lookups of nodes and relationships."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.predicates import compile_filter, quoted
from ..sources.model import EDGE, VERTEX, PropertyGraph, union

Filter = Mapping[str, Any] | Column | None


def find_nodes(graph: PropertyGraph, label: str | None, where: Filter = None) -> DataFrame:
    """Nodes that carry a label (any node without one) and pass a filter, with their properties."""
    found = []
    for table in graph.nodes.values():
        rows = table.frame if label is None else table.labelled(label)
        if rows is not None:
            found.append(rows.where(compile_filter(where, table.props)) if where is not None else rows)
    return union(found) if found else graph.spark.createDataFrame([], VERTEX)


def all_nodes(graph: PropertyGraph) -> DataFrame:
    """(id, labels) of every node, once, whatever number of labels it has."""
    return graph.vertices().dropDuplicates(["id"])


def get_node(graph: PropertyGraph, id: str) -> DataFrame:
    """The node with an id, or no row."""
    return find_nodes(graph, None, F.col("id") == id)


def get_relationship(graph: PropertyGraph, rel_id: str) -> DataFrame:
    return _rels(graph, graph.types, F.col("rel_id") == rel_id)


def find_relationships(graph: PropertyGraph, type: str, where: Filter = None) -> DataFrame:
    """Relationships of a type that pass a filter, with their properties."""
    return _rels(graph, (type,), where)


def _rels(graph: PropertyGraph, types: tuple[str, ...], where: Filter) -> DataFrame:
    found = []
    for t in types:
        if (table := graph.rels.get(t)) is not None:
            rows = table.frame.withColumn("type", F.lit(t))
            found.append(rows.where(compile_filter(where, table.props)) if where is not None else rows)
    return union(found) if found else graph.spark.createDataFrame([], EDGE)


def matching_ids(
    graph: PropertyGraph, where: Filter = None, labels: tuple[str, ...] = (), among: frozenset[str] | None = None
) -> DataFrame:
    """Ids of nodes that carry all labels and pass a filter; only the columns it names are read.

    ``among`` are labels of which the nodes in question are known to carry one: tables that
    can't hold such a node aren't read.
    """
    found = []
    for table in graph.nodes.values():
        if among is not None and not among & (table.fixed | table.maybe):
            continue
        rows: DataFrame | None = table.frame
        for label in labels:
            if label not in table.fixed:
                rows = rows.where(F.array_contains("labels", label)) if rows is not None and label in table.maybe else None
        if rows is not None:
            found.append(rows.where(compile_filter(where, table.props)).select("id"))
    return union(found) if found else graph.spark.createDataFrame([], "id string")


def matching_rels(graph: PropertyGraph, types: tuple[str, ...] | None, where: Filter = None) -> DataFrame:
    """(rel_id, type, src, dst) of relationships that pass a filter."""
    found = []
    for t in types or graph.types:
        if (table := graph.rels.get(t)) is not None:
            rows = table.frame.where(compile_filter(where, table.props)) if where is not None else table.frame
            found.append(rows.select("rel_id", F.lit(t).alias("type"), "src", "dst"))
    return union(found) if found else graph.spark.createDataFrame([], EDGE)


def has_label(graph: PropertyGraph, id: str, label: str) -> DataFrame:
    """One row (has_label); false for a missing node."""
    hit = F.max(F.array_contains("labels", label))
    return graph.vertices().where(F.col("id") == id).agg(F.coalesce(hit, F.lit(False)).alias("has_label"))


def stats(graph: PropertyGraph) -> DataFrame:
    """One row: numbers of nodes, relationships and indexes, counted from the tables."""
    nodes = graph.vertices().agg(F.count(F.lit(1)).alias("node_count"))
    rels = graph.edges().agg(F.count(F.lit(1)).alias("relationship_count"))
    one = nodes.withColumn("k", F.lit(1)).join(rels.withColumn("k", F.lit(1)), "k").drop("k")
    return one.withColumn("index_count", F.lit(len(graph.indexes)).cast("long"))


def label_counts(graph: PropertyGraph) -> DataFrame:
    """(label, n): a node counts once for each of its labels."""
    return graph.vertices().select(F.explode("labels").alias("label")).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


def type_counts(graph: PropertyGraph) -> DataFrame:
    return graph.edges().groupBy("type").agg(F.count(F.lit(1)).alias("n"))


def hydrate(graph: PropertyGraph, ids: DataFrame, id: str = "id") -> DataFrame:
    """Join labels and properties to a frame of node ids; repeated ids stay, and the frame's other columns.

    A property keeps its name.  A column of the frame that has it, too, gets underscores behind its own.
    """
    nodes = union(t.frame for t in graph.nodes.values()) if graph.nodes else graph.spark.createDataFrame([], VERTEX)
    taken, names = {c.lower() for c in (*nodes.columns, *ids.columns)}, []
    own = {c.lower() for c in nodes.columns} - {"id"}
    for c in ids.columns:
        new = c
        if c != id and c.lower() in own:
            while new.lower() in taken:
                new += "_"
            taken.add(new.lower())
        names.append(new)
    ids = ids.toDF(*names)
    return ids.join(nodes.withColumnRenamed("id", "node_id_"), F.col(quoted(id)) == F.col("node_id_")).drop("node_id_")
