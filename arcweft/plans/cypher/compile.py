"""From syntax trees to DataFrame plans.

A pattern is a chain of equi-joins on ids over narrow frames: each variable brings its id and
the properties that the query names, no more.  Conditions and maps are put at the scan of their
variable, where Catalyst pushes them into the file.  Nothing is ordered by hand: Spark picks
build sides and strategies at run time.  A variable that occurs twice is the same node.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ...functions.predicates import compile_filter, quoted
from ...operators import mutate
from ...sources.model import EDGE, VERTEX, GraphError, NodeTable, PropertyGraph, RelTable, new_id, node_rows, rel_rows, union
from .ast import Comparison, Create, Item, Match, NodePattern, Pattern, RelPattern
from .parser import AGGREGATES, QueryRefused, parse


@dataclass(frozen=True)
class Result:
    """Rows, and the graph after the query: the same one unless it changed something."""

    rows: DataFrame
    graph: PropertyGraph


Condition = tuple[str, str, Any]


def _filter(conditions: list[Condition], fields: dict[str, T.DataType]) -> Column:
    """All conditions on one table; several on one property must all hold."""
    tests = [compile_filter({prop: {op: value}}, fields) for prop, op, value in conditions]
    return reduce(lambda a, b: a & b, tests) if tests else F.lit(True)


class Plan:
    def __init__(self, graph: PropertyGraph, query: str, pattern: Pattern, where: tuple[Comparison, ...]) -> None:
        self.graph, self.query = graph, query
        self.nodes: dict[str, list[NodePattern]] = {}
        self.rels: dict[str, RelPattern] = {}
        self.order: list[tuple[str, str]] = []  # (kind, variable) along the pattern
        self._name("node", pattern.start)
        for rel, node in pattern.hops:
            self._name("rel", rel)
            self._name("node", node)
        both = self.nodes.keys() & self.rels.keys()
        if both:
            self.refuse(f"{min(both)!r} is a node and a relationship")
        self.conditions: dict[str, list[Condition]] = {v: [] for v in [*self.nodes, *self.rels]}
        for v, patterns in [*self.nodes.items(), *((v, [r]) for v, r in self.rels.items())]:
            for p in patterns:
                self.conditions[v] += [(prop, "eq", value) for prop, value in p.props.items()]
        for c in where:
            self.known(c.variable)
            self.conditions[c.variable].append((c.prop, c.op, c.value))

    def refuse(self, why: str) -> None:
        raise QueryRefused(self.query, why)

    def known(self, variable: str) -> None:
        if variable not in self.nodes and variable not in self.rels:
            self.refuse(f"{variable!r} isn't bound")

    def _name(self, kind: str, p: NodePattern | RelPattern) -> None:
        name = p.variable or f"_{len(self.order)}"
        if kind == "node":
            self.nodes.setdefault(name, []).append(p)
        elif name in self.rels:
            self.refuse(f"relationship {name!r} occurs twice")
        else:
            self.rels[name] = p
        self.order.append((kind, name))

    def props(self, variable: str) -> dict[str, T.DataType]:
        found: dict[str, T.DataType] = {}
        for t in self.tables(variable):
            found |= t.props
        return found

    def tables(self, variable: str) -> list[NodeTable] | list[RelTable]:
        if variable in self.rels:
            types = self.rels[variable].types or self.graph.types
            return [self.graph.rels[t] for t in dict.fromkeys(types) if t in self.graph.rels]
        labels = {x for p in self.nodes[variable] for x in p.labels}
        return [t for t in self.graph.nodes.values() if labels <= t.fixed | t.maybe]

    def scan(self, variable: str, props: list[str], whole: bool) -> DataFrame:
        """Ids (of relationships also their ends) and properties of what a variable may be, one struct column for all but ids."""
        out = []
        for t in self.tables(variable):
            rows = t.frame.where(_filter(self.conditions[variable], t.props))
            if isinstance(t, NodeTable):
                for label in sorted({x for p in self.nodes[variable] for x in p.labels} - t.fixed):
                    rows = rows.where(F.array_contains("labels", label))
                fixed = [F.col("id").alias(f"{variable}")]
                named = [F.col("labels")] if whole else []
            else:
                fixed = [F.col(c).alias(f"{variable}{x}") for c, x in (("rel_id", ""), ("src", "/src"), ("dst", "/dst"))]
                named = [F.lit(t.type).alias("type")] if whole else []
            have = list(t.props) if whole else [p for p in dict.fromkeys(props) if p in t.props]
            out.append(rows.select(*fixed, *[c.alias(f"{variable}//{n}") for c, n in zip(named, ["labels" if isinstance(t, NodeTable) else "type"], strict=False)], *[F.col(quoted(p)).alias(f"{variable}/{p}") for p in have]))
        if out:
            return union(out)
        empty = VERTEX if variable in self.nodes else EDGE
        frame = self.graph.spark.createDataFrame([], empty)
        if variable in self.nodes:
            return frame.select(F.col("id").alias(variable))
        return frame.select(F.col("rel_id").alias(variable), F.col("src").alias(f"{variable}/src"), F.col("dst").alias(f"{variable}/dst"))

    def rows(self, used: dict[str, list[str]], whole: set[str]) -> DataFrame:
        """One row for each match, with the columns that the query uses."""
        q = lambda name: F.col(quoted(name))

        def needed(v: str) -> DataFrame | None:
            """The scan of a node variable, unless its id alone is enough."""
            labels = {x for p in self.nodes[v] for x in p.labels}
            bare = not labels and not self.conditions[v] and not used.get(v) and v not in whole
            return None if bare and self.graph.whole else self.scan(v, used.get(v, []), v in whole)

        first = self.order[0][1]
        out: DataFrame | None = None
        bound = {first}
        if len(self.order) == 1:
            return self.scan(first, used.get(first, []), first in whole)
        out = needed(first)
        for k in range(1, len(self.order), 2):
            here, rel, there = self.order[k - 1][1], self.order[k][1], self.order[k + 1][1]
            scan = self.scan(rel, used.get(rel, []), rel in whole)
            pattern = self.rels[rel]
            a, b = ("/src", "/dst") if pattern.direction != "incoming" else ("/dst", "/src")
            seen = scan.withColumn("from/", q(rel + a)).withColumn("to/", q(rel + b))
            if pattern.direction == "both":
                seen = seen.unionAll(scan.withColumn("from/", q(rel + b)).withColumn("to/", q(rel + a)))
            seen = seen.drop(rel + "/src", rel + "/dst")
            if out is None:
                out = seen.withColumnRenamed("from/", here)
            else:
                out = out.join(seen, q(here) == q("from/")).drop("from/")
            if there in bound:
                out = out.where(q("to/") == q(there)).drop("to/")
                continue
            bound.add(there)
            ends = needed(there)
            out = out.withColumnRenamed("to/", there) if ends is None else out.join(ends, q("to/") == q(there)).drop("to/")
        return out

    def column(self, rows: DataFrame, variable: str, prop: str) -> Column:
        name = f"{variable}/{prop}"
        return F.col(quoted(name)) if name in rows.columns else F.lit(None).cast("string")

    def value(self, rows: DataFrame, variable: str) -> Column:
        """A whole node or relationship as a struct."""
        kind = "node" if variable in self.nodes else "relationship"
        extra = f"{variable}//{'labels' if kind == 'node' else 'type'}"
        own = [c for c in rows.columns if c.startswith(f"{variable}/") and c != extra]
        tail = [F.col(quoted(extra)).alias(extra.split("//")[1])] if extra in rows.columns else []
        return F.struct(F.lit(kind).alias("kind"), F.col(quoted(variable)).alias("id"), *tail, *[F.col(quoted(c)).alias(c.split("/", 1)[1]) for c in own])


def _aggregate(plan: Plan, rows: DataFrame, item: Item) -> Column:
    if item.variable is None:
        return F.count(F.lit(1))
    column = F.col(quoted(item.variable)) if item.prop is None else plan.column(rows, item.variable, item.prop)
    if item.aggregate == "count":
        return F.count_distinct(column) if item.distinct else F.count(column)
    found: Callable = {"sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max}[item.aggregate]
    if item.distinct and item.aggregate in ("sum", "avg"):
        return F.sum_distinct(column) if item.aggregate == "sum" else F.sum_distinct(column) / F.count_distinct(column)
    return found(column)


def _match(graph: PropertyGraph, query: str, q: Match) -> Result:
    plan = Plan(graph, query, q.pattern, q.where)
    items = q.items or tuple(Item(v, None, v) for _, v in plan.order if not v.startswith("_"))
    if not items:
        plan.refuse("there is nothing to return")
    items = tuple(dict.fromkeys(items)) if not q.items else items
    used: dict[str, list[str]] = {}
    whole: set[str] = set()
    for item in items:
        if item.variable is None:
            continue
        plan.known(item.variable)
        if item.prop is not None:
            used.setdefault(item.variable, []).append(item.prop)
        elif item.aggregate is None:
            whole.add(item.variable)
    aliases = [i.alias for i in items]
    if len(set(aliases)) < len(aliases):
        plan.refuse("two items have one name")
    extra = {}
    for o in q.order:
        if o.name not in aliases:
            variable, _, prop = o.name.partition(".")
            if not prop or any(i.aggregate for i in items) or q.distinct:
                plan.refuse(f"can't order by {o.name!r}")
            plan.known(variable)
            used.setdefault(variable, []).append(prop)
            extra[o.name] = (variable, prop)
    rows = plan.rows(used, whole)
    if q.sets or q.deletes:
        graph = _change(graph, plan, q, rows)
    for v, prop, value in q.sets:  # rows show what was set
        if v in whole or prop in used.get(v, []):
            new = F.array(*map(F.lit, value)) if isinstance(value, (list, tuple)) else F.lit(value)
            rows = rows.withColumn(f"{v}/{prop}", new)

    def shown(i: Item) -> Column:
        return plan.value(rows, i.variable) if i.prop is None else plan.column(rows, i.variable, i.prop)

    if any(i.aggregate for i in items):
        keys = [shown(i).alias(i.alias) for i in items if not i.aggregate]
        out = rows.groupBy(*keys).agg(*[_aggregate(plan, rows, i).alias(i.alias) for i in items if i.aggregate])
        out = out.select(*map(quoted, aliases))
    else:
        out = rows.select(*[shown(i).alias(i.alias) for i in items], *[plan.column(rows, v, p).alias(f"order/{n}") for n, (v, p) in extra.items()])
    if q.distinct:
        out = out.distinct()
    if q.order:
        name = lambda o: F.col(quoted(o.name if o.name in aliases else f"order/{o.name}"))
        out = out.orderBy(*[name(o).desc_nulls_last() if o.descending else name(o).asc_nulls_last() for o in q.order])
    if q.skip:
        out = out.offset(q.skip)
    if q.limit is not None:
        out = out.limit(q.limit)
    return Result(out.select(*map(quoted, aliases)), graph)


def _change(graph: PropertyGraph, plan: Plan, q: Match, rows: DataFrame) -> PropertyGraph:
    """SET and DELETE on what the rows name."""
    touched = list(dict.fromkeys([v for v, _, _ in q.sets] + list(q.deletes)))
    for v in touched:
        plan.known(v)
    ids = {v: rows.select(F.col(quoted(v)).alias("id")).distinct() for v in touched}
    for v in dict.fromkeys(v for v, _, _ in q.sets):
        props = {p: value for w, p, value in q.sets if w == v}
        if v in plan.nodes:
            graph = mutate.update_nodes(graph, ids[v], props)
        else:
            graph = mutate.update_relationships(graph, ids[v].withColumnRenamed("id", "rel_id"), props)
    for v in q.deletes:
        graph = mutate.delete_nodes(graph, ids[v]) if v in plan.nodes else mutate.delete_relationships(graph, ids[v].withColumnRenamed("id", "rel_id"))
    return graph


def _create(graph: PropertyGraph, query: str, q: Create) -> Result:
    nodes, rels, names = [], [], {}
    p = q.pattern
    chain = [p.start, *(n for _, n in p.hops)]
    for k, n in enumerate(chain):
        if n.variable is not None and n.variable in names:
            raise QueryRefused(query, f"{n.variable!r} occurs twice")
        names[n.variable or f"_{k}"] = new_id()
        nodes.append((n.labels, n.props, names[n.variable or f"_{k}"]))
    ids = list(names.values())
    for k, (r, _) in enumerate(p.hops):
        if len(r.types) > 1:
            raise QueryRefused(query, "a new relationship has one type")
        a, b = (ids[k + 1], ids[k]) if r.direction == "incoming" else (ids[k], ids[k + 1])  # undirected: outgoing
        rels.append((a, b, r.types[0] if r.types else "RELATED_TO", r.props))
    new, _ = mutate.create_nodes(graph, [(labels, props, i) for labels, props, i in nodes])
    made = []
    if rels:
        new, made = mutate.create_relationships(new, rels)
    one_hop = len(p.hops) == 1
    plain = ["node"] if not p.hops else ["start", "end"] if one_hop else [f"n{k}" for k in range(len(chain))]
    shown: list[DataFrame] = []
    for k, n in enumerate(chain):
        row = node_rows(graph.spark, [(ids[k], n.labels, n.props)]).frame
        shown.append(_one(row, n.variable or plain[k]))
    for k, ((r, _), rel_id, (a, b, t, props)) in enumerate(zip(p.hops, made, rels, strict=True)):
        row = rel_rows(graph.spark, t, [(rel_id, a, b, props)]).frame.withColumn("type", F.lit(t))
        shown.append(_one(row, r.variable or ("rel" if one_hop else f"r{k}")))
    one = shown[0]
    for other in shown[1:]:
        one = one.join(other, "one/")
    return Result(one.drop("one/"), new)


def _one(row: DataFrame, name: str) -> DataFrame:
    return row.select(F.lit(1).alias("one/"), F.struct(*map(quoted, row.columns)).alias(name))


def run(graph: PropertyGraph, query: str) -> Result:
    """Parse and plan a query.  Rows are lazy; the graph is a new value if the query changes it."""
    tree = parse(query)
    return _create(graph, query, tree) if isinstance(tree, Create) else _match(graph, query, tree)


def rows(graph: PropertyGraph, query: str) -> DataFrame:
    return run(graph, query).rows


__all__ = ["AGGREGATES", "GraphError", "QueryRefused", "Result", "rows", "run"]
