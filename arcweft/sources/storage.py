"""Graphs on disk: one Parquet folder per table and a small JSON catalogue of their shapes.

A save writes a new version next to the old one; the catalogue that names it comes last, so a
reader sees the old graph or the new one, whole.  Nodes lie in order of their ids and
relationships of their start, so that lookups and first hops from known ids skip the row groups
that can't hold them.
"""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .model import GraphError, NodeTable, PropertyGraph, RelTable


def _in_order(frame: DataFrame, column: str) -> DataFrame:
    return frame.repartitionByRange(column).sortWithinPartitions(column)


def save(graph: PropertyGraph, path: str) -> str:
    """Write all tables; returns the version's name."""
    version = f"{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
    catalogue: dict = {"whole": graph.whole, "indexes": sorted(map(list, graph.indexes)), "nodes": [], "rels": []}
    for k, (name, t) in enumerate(graph.nodes.items()):
        _in_order(t.frame, "id").write.parquet(f"{path}/data/{version}/nodes-{k}")
        catalogue["nodes"].append({"name": name, "fixed": sorted(t.fixed), "maybe": sorted(t.maybe)})
    for k, (name, t) in enumerate(graph.rels.items()):
        _in_order(t.frame, "src").write.parquet(f"{path}/data/{version}/rels-{k}")
        catalogue["rels"].append({"name": name, "starts": sorted(t.starts), "ends": sorted(t.ends)})
    spark = graph.spark
    spark.createDataFrame([(json.dumps(catalogue),)], "value string").coalesce(1).write.text(f"{path}/versions/{version}")
    return version


def versions(spark: SparkSession, path: str) -> list[str]:
    """All complete versions, the newest last."""
    files = spark.read.text(f"{path}/versions/*").select(F.col("_metadata.file_path").alias("f")).distinct()
    return sorted(r.f.rstrip("/").split("/")[-2] for r in files.collect())  # one row per save


def load(spark: SparkSession, path: str, version: str | None = None) -> PropertyGraph:
    """The newest version, or the one named."""
    found = versions(spark, path)
    if version is not None and version not in found:
        raise GraphError(f"no version {version!r}")
    version = version or found[-1]
    catalogue = json.loads(spark.read.text(f"{path}/versions/{version}").first().value)
    read = lambda kind, k: spark.read.parquet(f"{path}/data/{version}/{kind}-{k}")
    nodes = {x["name"]: NodeTable(read("nodes", k), frozenset(x["fixed"]), frozenset(x["maybe"])) for k, x in enumerate(catalogue["nodes"])}
    rels = {x["name"]: RelTable(read("rels", k), x["name"], frozenset(x["starts"]), frozenset(x["ends"])) for k, x in enumerate(catalogue["rels"])}
    return PropertyGraph(spark, nodes, rels, catalogue["whole"], frozenset(map(tuple, catalogue["indexes"])))


def keys(graph: PropertyGraph, prefix: str = "", limit: int | None = None, reverse: bool = False) -> DataFrame:
    """A key-value view for debugging: sorted keys of nodes, labels and relationships under a prefix."""
    v, e = graph.vertices(), graph.edges()
    rows = v.select(F.concat(F.lit("n:"), "id").alias("key"))
    rows = rows.unionByName(v.select(F.explode("labels").alias("l"), "id").select(F.concat(F.lit("l:"), "l", F.lit(":"), "id").alias("key")))
    rows = rows.unionByName(e.select(F.concat(F.lit("r:"), "rel_id").alias("key")))
    rows = rows.where(F.startswith("key", F.lit(prefix))).orderBy(F.col("key").desc() if reverse else F.col("key"))
    return rows if limit is None else rows.limit(limit)
