"""Traversals of several steps, from one node or from many at once.

A traversal is an immutable description; ``collect`` and its like compile it.  Steps cycle: hop
h takes step h modulo their number, and ``depth`` counts hops.

Without ``unique`` the result is a multiset of walks, built as one lazy plan: a chain of joins
for each length, and their union.  With ``unique`` every node is reached once a seed, at its
first visit, and is expanded with the step of that hop alone; a loop keeps the newly reached
ids of a hop, which are matched against those reached before and written out, so plans stay
short.  A step's filter comes before the visit: a node that fails it isn't visited and may be
reached by a later hop.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from ..sources.model import PropertyGraph
from .expand import BOTH, IN, OUT, as_ids, existing, far_labels, few, starting, step_arcs
from .scan import Filter, hydrate, matching_ids

NODES = "seed string, id string, hop int"
PATHS = "seed string, nodes array<string>, rels array<string>, length int"


@dataclass(frozen=True)
class Step:
    direction: str
    types: tuple[str, ...] = ()
    where: Filter = None


@dataclass(frozen=True)
class Traversal:
    graph: PropertyGraph
    seeds: DataFrame
    steps: tuple[Step, ...] = ()
    hops: int | None = None
    most: int | None = None
    once: bool = False
    values: tuple[str, ...] | None = None  # the seeds, if they are few and known

    # -- description ------------------------------------------------------------------------

    def _step(self, direction: str, types: tuple[str, ...]) -> Traversal:
        return replace(self, steps=(*self.steps, Step(direction, types)))

    def outgoing(self, *types: str) -> Traversal:
        return self._step(OUT, types)

    def incoming(self, *types: str) -> Traversal:
        return self._step(IN, types)

    def both(self, *types: str) -> Traversal:
        return self._step(BOTH, types)

    def where(self, filter: Filter) -> Traversal:
        """Filter the nodes that the last step reaches; replaces an earlier filter of that step."""
        if not self.steps:
            raise ValueError("where() needs a step before it")
        return replace(self, steps=(*self.steps[:-1], replace(self.steps[-1], where=filter)))

    def depth(self, hops: int) -> Traversal:
        return replace(self, hops=hops)

    def limit(self, n: int) -> Traversal:
        """At most n results a seed, the nearest first."""
        return replace(self, most=n)

    def unique(self) -> Traversal:
        return replace(self, once=True)

    # -- results ----------------------------------------------------------------------------

    def collect(self) -> DataFrame:
        """(seed, id, hop) of every node reached, as often as it is reached."""
        if not self.steps or self.most == 0:
            return self.graph.spark.createDataFrame([], NODES)
        levels = self._levels() if self.once else self._walks()
        found = _union(levels, self.graph, NODES)
        return self._cut_off(found, "hop", "id")

    def counts(self) -> DataFrame:
        """(seed, id, hop, walks): the multiset of ``collect`` with multiplicities.

        Walks are merged after every hop, so the frontier holds a node once a seed however many
        walks lead to it.
        """
        level = self._start().select("seed", F.col("seed").alias("id"), F.lit(1).cast("long").alias("walks"))
        levels = []
        for hop in range(self._depth()):
            level = self._hop(level, hop).groupBy("seed", "id").agg(F.sum("walks").alias("walks"))
            levels.append(level.select("seed", "id", F.lit(hop + 1).alias("hop"), "walks"))
        return _union(levels, self.graph, NODES + ", walks long")

    def nodes(self) -> DataFrame:
        """``collect`` with labels and properties."""
        return hydrate(self.graph, self.collect())

    def paths(self) -> DataFrame:
        """(seed, nodes, rels, length) of every path; with ``unique`` one path to each node."""
        if not self.steps or self.most == 0:
            return self.graph.spark.createDataFrame([], PATHS)
        level = self._start().select(
            "seed", F.col("seed").alias("id"), F.array("seed").alias("nodes"), F.array().cast("array<string>").alias("rels")
        )
        levels, seen = [], level.select("seed", "id")
        for hop in range(self._depth()):
            level = self._hop(level, hop).select(
                "seed", "id", F.concat("nodes", F.array("id")).alias("nodes"), F.concat("rels", F.array("rel_id")).alias("rels")
            )
            if self.once:
                first = F.min(F.struct("nodes", "rels")).alias("path")
                level = level.join(seen, ["seed", "id"], "left_anti").groupBy("seed", "id").agg(first).select("seed", "id", "path.*")
                level = cut(level)
                if level.isEmpty():
                    break
                seen = seen.unionAll(level.select("seed", "id"))
            levels.append(level.select("seed", "nodes", "rels", F.lit(hop + 1).alias("length")))
        return self._cut_off(_union(levels, self.graph, PATHS), "length", "nodes", "rels")

    def subgraph(self) -> tuple[DataFrame, DataFrame]:
        """Nodes (seed, id) and relationships (seed, rel_id) that the traversal meets.

        Every node is expanded once, limits don't count, and a relationship is part of the
        result even if the node behind it fails the step's filter.
        """
        if not self.steps:
            none = self.graph.spark.createDataFrame([], "seed string, id string")
            return none, none.withColumnRenamed("id", "rel_id")
        rels: list[DataFrame] = []
        levels = [self._start(shown=True).select("seed", F.col("seed").alias("id")), *self._levels(rels)]
        nodes = reduce(DataFrame.unionAll, [x.select("seed", "id") for x in levels])
        return nodes, reduce(DataFrame.unionAll, rels).distinct()

    # -- plans ------------------------------------------------------------------------------

    def _depth(self) -> int:
        return len(self.steps) if self.hops is None else self.hops

    def _start(self, shown: bool = False) -> DataFrame:
        """The seeds that exist.  In a whole graph the others have no arcs, so only a result that shows seeds looks."""
        if self.graph.whole and not shown:
            return self.seeds
        return existing(self.graph, self.seeds, "seed") if self.values is None else starting(self.graph, self.values)

    def _arcs(self, hop: int) -> DataFrame:
        step = self.steps[hop % len(self.steps)]
        found = step_arcs(self.graph, step.types or None, step.direction)
        return found.where(F.col("here").isin(list(self.values))) if hop == 0 and self.values is not None else found

    def _hop(self, level: DataFrame, hop: int) -> DataFrame:
        """Replace ``id`` by the neighbours that pass the filter; adds ``rel_id``."""
        step = self.steps[hop % len(self.steps)]
        found = level.join(self._arcs(hop), F.col("id") == F.col("here")).drop("id", "here", "type").withColumnRenamed("there", "id")
        if step.where is None:
            return found
        labels = far_labels(self.graph, step.types or None, step.direction)
        return found.join(matching_ids(self.graph, step.where, among=labels), "id", "left_semi")

    def _walks(self) -> list[DataFrame]:
        level, levels = self._start().select("seed", F.col("seed").alias("id")), []
        for hop in range(self._depth()):
            level = self._hop(level, hop).select("seed", "id")
            levels.append(level.select("seed", "id", F.lit(hop + 1).alias("hop")))
        return levels

    def _levels(self, rels: list[DataFrame] | None = None) -> list[DataFrame]:
        """Newly reached nodes of each hop; ``rels`` gets the relationships that were followed."""
        level = cut(self._start().select("seed", F.col("seed").alias("id")))
        seen, levels, reached = level, [], 0
        for hop in range(self._depth()):
            if rels is not None:
                followed = level.join(self._arcs(hop), F.col("id") == F.col("here")).select("seed", "rel_id")
                rels.append(followed.distinct())
            found = self._hop(level, hop).select("seed", "id").distinct()
            level = cut(found.join(seen, ["seed", "id"], "left_anti"))
            if level.isEmpty():
                break
            seen = seen.unionAll(level)
            levels.append(level.withColumn("hop", F.lit(hop + 1)))
        if rels is not None and not rels:
            rels.append(self.graph.spark.createDataFrame([], "seed string, rel_id string"))
        return levels

    def _cut_off(self, found: DataFrame, *order: str) -> DataFrame:
        if self.most is None:
            return found
        from pyspark.sql import Window

        nth = F.row_number().over(Window.partitionBy("seed").orderBy(*order))
        return found.withColumn("nth", nth).where(F.col("nth") <= self.most).drop("nth")


def _union(levels: list[DataFrame], graph: PropertyGraph, schema: str) -> DataFrame:
    return reduce(DataFrame.unionAll, levels) if levels else graph.spark.createDataFrame([], schema)


def traverse(graph: PropertyGraph, start: DataFrame | str | Iterable[str]) -> Traversal:
    """Start at one node, several, or all of a frame's column ``id``."""
    start = start if isinstance(start, (DataFrame, str)) else list(start)
    values = few(start)
    return Traversal(graph, as_ids(graph, start), values=None if values is None else tuple(values))
