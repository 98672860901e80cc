"""A store of named graph spaces with portable operations and queries.

Each space is a graph of its own, so nothing crosses from one to another, by label or by id.
The store is the one mutable thing: an operation swaps its space's graph for a new one.  A
transaction works on a copy; commit swaps it in, rollback forgets it.
"""

from __future__ import annotations

import time
from collections.abc import Iterable, Mapping
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.predicates import quoted
from ..operators import mutate
from ..operators.expand import BOTH, IN, OUT, relationships_of
from ..operators.scan import find_nodes, get_node, get_relationship, hydrate, stats
from ..operators.traversal import traverse
from ..sources.model import GraphError, PropertyGraph
from ..sources.storage import load, save
from .cypher import Result, run

DIRECTIONS = {"in": IN, "out": OUT, "both": BOTH, None: BOTH}
# Names of features that clients ask for.
FEATURES = frozenset({"nodes", "relationships", "traversal", "batch", "indexes", "cypher", "cypher-bridge", "upsert", "graph-spaces", "transactions"})


def plain(rows: DataFrame, fields: Iterable[str] | None = None) -> DataFrame:
    """(id, label, properties): the first label, and all properties or those asked for."""
    label = F.try_element_at("labels", F.lit(1)).alias("label")
    props = [c for c in rows.columns if c not in ("id", "labels", "label")]
    if fields is not None:
        props = [c for c in fields if c not in ("id", "label")]
    shown = [F.col(quoted(c)) if c in rows.columns else F.lit(None).cast("string").alias(c) for c in props]
    return rows.select("id", label, *shown)


def ordered(rows: DataFrame, order_by: Mapping[str, str] | None, limit: int | None) -> DataFrame:
    """Sort by one field, nulls last and ties by id, then cut off: a top-k where both are given."""
    if order_by:
        field, down = order_by["field"], order_by.get("direction", "ASC").upper() == "DESC"
        column = F.col(quoted(field)) if field in rows.columns else F.lit(None).cast("string")
        rows = rows.orderBy(column.desc_nulls_last() if down else column.asc_nulls_last(), "id")
    return rows.limit(limit) if limit else rows


class Space:
    """Operations on one space's graph.  A transaction is a space, too."""

    def __init__(self, store: Store, name: str, graph: PropertyGraph) -> None:
        self.store, self.name, self._graph = store, name, graph

    @property
    def graph(self) -> PropertyGraph:
        return self._graph

    def _swap(self, graph: PropertyGraph) -> None:
        self._graph = graph

    # -- nodes ------------------------------------------------------------------------------

    def create_node(self, label: str, props: Mapping[str, Any]) -> str:
        """The id is the property ``_id`` or ``<label>Id``, if there is one."""
        own = props.get("_id") or props.get(label.lower() + "Id")
        graph, id = mutate.create_node(self.graph, [label], {k: v for k, v in props.items() if k != "_id"}, own)
        self._swap(graph)
        return id

    def create_nodes(self, label: str, items: Iterable[Mapping[str, Any]]) -> list[str]:
        rows = [([label], {k: v for k, v in p.items() if k != "_id"}, p.get("_id") or p.get(label.lower() + "Id")) for p in items]
        graph, ids = mutate.create_nodes(self.graph, rows)
        self._swap(graph)
        return ids

    def get_node(self, id: str) -> DataFrame:
        return plain(get_node(self.graph, id))

    def find_nodes(self, label: str, where: Mapping[str, Any] | None = None) -> DataFrame:
        return plain(find_nodes(self.graph, label, where))

    def update_node(self, id: str, props: Mapping[str, Any]) -> DataFrame | None:
        """The node as it is now; None if there is none."""
        if get_node(self.graph, id).isEmpty():
            return None
        self._swap(mutate.update_nodes(self.graph, [id], props))
        return self.get_node(id)

    def delete_node(self, id: str) -> bool:
        if get_node(self.graph, id).isEmpty():
            return False
        self._swap(mutate.delete_node(self.graph, id))
        return True

    def upsert_node(self, label: str, match: Mapping[str, Any], props: Mapping[str, Any]) -> str:
        graph, id = mutate.upsert_node(self.graph, label, match, props)
        self._swap(graph)
        return id

    def upsert_nodes(self, label: str, key: str, items: Iterable[Mapping[str, Any]]) -> list[str]:
        graph, ids = mutate.upsert_nodes(self.graph, label, key, items)
        self._swap(graph)
        return ids

    # -- relationships ----------------------------------------------------------------------

    def create_relationship(self, src: str, dst: str, type: str, props: Mapping[str, Any] | None = None) -> str:
        graph, id = mutate.create_relationship(self.graph, src, dst, type, props)
        self._swap(graph)
        return id

    def create_relationships(self, items: Iterable[tuple]) -> list[str]:
        graph, ids = mutate.create_relationships(self.graph, items)
        self._swap(graph)
        return ids

    def relationships(self, id: str, direction: str | None = None, type: str | None = None) -> DataFrame:
        return relationships_of(self.graph, id, [type] if type else None, DIRECTIONS[direction]).drop("seed")

    def delete_relationship(self, rel_id: str) -> bool:
        if get_relationship(self.graph, rel_id).isEmpty():
            return False
        self._swap(mutate.delete_relationships(self.graph, [rel_id]))
        return True

    def upsert_relationship(self, src: str, dst: str, type: str, props: Mapping[str, Any] | None = None) -> str:
        graph, id = mutate.upsert_relationship(self.graph, src, dst, type, props)
        self._swap(graph)
        return id

    # -- queries ----------------------------------------------------------------------------

    def traverse(
        self,
        start: str,
        type: str | None = None,
        direction: str | None = "out",
        depth: int = 1,
        where: Mapping[str, Any] | Column | None = None,
        limit: int | None = None,
        order_by: Mapping[str, str] | None = None,
        fields: Iterable[str] | None = None,
    ) -> DataFrame:
        """Nodes within ``depth`` steps, once each; the limit takes the nearest, before any order."""
        t = traverse(self.graph, start)
        types = (type,) if type else ()
        t = {OUT: t.outgoing, IN: t.incoming, BOTH: t.both}[DIRECTIONS[direction]](*types).depth(depth).unique()
        t = t.where(where) if where is not None else t
        t = t.limit(limit) if limit else t
        rows = hydrate(self.graph, t.collect().select("id"))
        if order_by:
            rows = ordered(rows, order_by, None)
        return plain(rows, fields)

    def query(self, query: Mapping[str, Any]) -> DataFrame:
        """A portable query: ``{"kind": "match" | "traverse", ...}``.  What it can't honour is an error."""
        kind = query.get("kind")
        known = {
            "match": {"kind", "label", "where", "returnFields", "orderBy", "limit"},
            "traverse": {"kind", "startId", "relType", "direction", "depth", "where", "limit", "orderBy", "returnFields"},
        }
        if kind not in known:
            raise GraphError(f"unknown kind of query {kind!r}")
        if strange := set(query) - known[kind]:
            raise GraphError(f"a {kind} query has no {', '.join(sorted(strange))}")
        if kind == "match":
            rows = find_nodes(self.graph, query["label"], query.get("where"))
            return plain(ordered(rows, query.get("orderBy"), query.get("limit")), query.get("returnFields"))
        return self.traverse(
            query["startId"], query.get("relType"), query.get("direction", "out"), query.get("depth", 1),
            query.get("where"), query.get("limit"), query.get("orderBy"), query.get("returnFields"),
        )

    def cypher(self, text: str) -> DataFrame:
        found: Result = run(self.graph, text)
        self._swap(found.graph)
        return found.rows

    # -- schema -----------------------------------------------------------------------------

    def ensure_index(self, label: str, props: Iterable[str]) -> None:
        for p in props:
            self._swap(mutate.create_index(self.graph, label, p))

    def ensure_constraint(self, label: str, prop: str, kind: str) -> DataFrame:
        """Ids of nodes that break it; a unique one is noted as an index, too."""
        if kind == "unique":
            self.ensure_index(label, [prop])
        return self.graph.ensure(label, prop, kind)

    def init_schema(self, schema: Mapping[str, Any]) -> dict[str, DataFrame]:
        """All constraints and indexes of a schema; what breaks each constraint."""
        found = {f"{c['type']} {c['label']}.{c['property']}": self.ensure_constraint(c["label"], c["property"], c["type"]) for c in schema.get("constraints", ())}
        for i in schema.get("indexes", ()):
            self.ensure_index(i["label"], i["properties"])
        return found


class Transaction(Space):
    """A space's graph as it was when the transaction began, with the transaction's own changes."""

    def __init__(self, space: Space) -> None:
        super().__init__(space.store, space.name, space.graph)
        self._base, self._space, self._open = space.graph, space, True

    def commit(self) -> None:
        """Swap the changes in; an error if someone else changed the space meanwhile."""
        if not self._open:
            raise GraphError("the transaction is over")
        if self._space.graph is not self._base:
            raise GraphError("the space has changed since the transaction began")
        self._open = False
        self._space._swap(self._graph)

    def rollback(self) -> None:
        self._open, self._graph = False, self._base

    def __enter__(self) -> Transaction:
        return self

    def __exit__(self, kind, error, trace) -> None:
        if self._open:
            self.rollback() if kind else self.commit()


class Store:
    """Named spaces, held as graphs and kept in a folder if one is given."""

    provider = "arcweft"

    def __init__(self, spark: SparkSession, path: str | None = None) -> None:
        self.spark, self.path, self.connected = spark, path, False
        self._spaces: dict[str, Space] = {}

    def connect(self) -> None:
        self.connected = True

    def disconnect(self) -> None:
        """Save every space, if there is a folder."""
        if self.path:
            for s in self._spaces.values():
                save(s.graph, f"{self.path}/{s.name}")
        self.connected = False

    def health(self) -> dict[str, Any]:
        began = time.perf_counter()
        try:
            self.spark.range(1).count()
        except Exception:  # noqa: BLE001 - any failure means the same here
            return {"connected": False, "provider": self.provider, "latency_ms": -1}
        return {"connected": self.connected, "provider": self.provider, "latency_ms": round(1000 * (time.perf_counter() - began))}

    def create_space(self, name: str, graph: PropertyGraph | None = None) -> Space:
        if name not in self._spaces:
            self._spaces[name] = Space(self, name, graph or PropertyGraph(self.spark))
        return self._spaces[name]

    def open_space(self, name: str) -> Space:
        """A space as it was last saved."""
        self._spaces[name] = Space(self, name, load(self.spark, f"{self.path}/{name}"))
        return self._spaces[name]

    def space(self, name: str) -> Space:
        if name not in self._spaces:
            raise GraphError(f"no space {name!r}")
        return self._spaces[name]

    def drop_space(self, name: str) -> None:
        self._spaces.pop(name, None)

    def spaces(self) -> list[str]:
        return list(self._spaces)

    def begin(self, name: str) -> Transaction:
        return Transaction(self.space(name))

    def has_feature(self, name: str) -> bool:
        return name in FEATURES

    def counts(self) -> dict[str, tuple[int, int]]:
        """Nodes and relationships of each space."""
        rows = {n: stats(s.graph).first() for n, s in self._spaces.items()}
        return {n: (r.node_count, r.relationship_count) for n, r in rows.items()}

    def reset(self) -> None:
        self._spaces.clear()
