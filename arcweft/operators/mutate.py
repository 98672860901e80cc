"""Updates.  Each returns a new graph; the old one stays as it was.

New and changed rows come as Python values or as frames.  A change touches the tables that can
hold it alone, by joins on ids.  Because a graph is a value, a transaction is a graph in hand:
commit is to use the new one, rollback to drop it.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterable, Mapping
from dataclasses import replace
from typing import Any, TypeVar

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.predicates import quoted
from ..sources.model import (
    NODE_COLUMNS,
    REL_COLUMNS,
    GraphError,
    NodeTable,
    PropertyGraph,
    RelTable,
    new_id,
    node_rows,
    rel_rows,
    rows_frame,
    union,
)
from .scan import find_nodes, get_node, get_relationship

Props = Mapping[str, Any]
R = TypeVar("R")


def _merged(frame: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of both, by name.  A column of two types becomes a variant."""
    kinds, more = dict(frame.dtypes), dict(new.dtypes)
    for c in kinds.keys() & more.keys():
        if kinds[c] != more[c]:
            numbers = {"bigint", "double", "int", "float"}
            to = "double" if {kinds[c], more[c]} <= numbers else "variant"
            frame, new = ((f if t == to else f.withColumn(c, F.col(quoted(c)).cast(to))) for f, t in ((frame, kinds[c]), (new, more[c])))
    return frame.unionByName(new, allowMissingColumns=True)


def _taken(graph: PropertyGraph, ids: list[str], column: DataFrame) -> None:
    again = {i for i, n in Counter(ids).items() if n > 1}
    name = column.columns[0]
    found = again or {r[0] for r in column.where(F.col(name).isin(ids)).collect()}  # of the ids given
    if found:
        raise GraphError(f"already there: {', '.join(sorted(found))}")


def create_nodes(graph: PropertyGraph, nodes: Iterable[tuple[Iterable[str], Props] | tuple[Iterable[str], Props, str | None]]) -> tuple[PropertyGraph, list[str]]:
    """Add nodes (labels, properties, id); a missing id is made up, one in use is an error."""
    rows = [((x[2] if len(x) > 2 and x[2] is not None else new_id()), list(x[0]), dict(x[1])) for x in nodes]
    ids = [r[0] for r in rows]
    given = [x[2] for x in nodes if len(x) > 2 and x[2] is not None] if isinstance(nodes, list) else ids
    if given:
        _taken(graph, ids, graph.vertices().select("id"))
    tables = dict(graph.nodes)
    shapes: dict[str, list] = {}
    for r in rows:  # nodes go to the table of their labels
        shapes.setdefault("+" + "+".join(r[1]), []).append(r)
    for name, group in shapes.items():
        new = node_rows(graph.spark, group)
        if (old := tables.get(name)) is not None:
            fixed = old.fixed & new.fixed
            new = NodeTable(_merged(old.frame, new.frame), fixed, (old.fixed | old.maybe | new.fixed | new.maybe) - fixed)
        tables[name] = new
    return replace(graph, nodes=tables), ids


def create_node(graph: PropertyGraph, labels: Iterable[str], props: Props | None = None, id: str | None = None) -> tuple[PropertyGraph, str]:
    graph, ids = create_nodes(graph, [(labels, props or {}, id)])
    return graph, ids[0]


def add_node_frame(graph: PropertyGraph, name: str, frame: DataFrame, labels: Iterable[str]) -> PropertyGraph:
    """Add a whole frame of nodes (id and properties) as a table; the bulk form of ``create_nodes``."""
    if name in graph.nodes:
        raise GraphError(f"there is a table {name!r}")
    return graph.with_nodes(name, frame, labels)


def _free(name: str, taken: Iterable[str]) -> str:
    """``name``, with underscores added until none of ``taken`` is it."""
    seen = {t.lower() for t in taken}
    while name.lower() in seen:
        name += "_"
    return name


def _settable(frame: DataFrame, props: Props) -> tuple[DataFrame, dict[str, T.DataType]]:
    """The frame with a column for each property, of a type that can hold the value."""
    own = _free("row", props)
    one = rows_frame(frame.sparkSession, T.StructType([T.StructField(own, T.IntegerType())]), [(1,)], [props])
    for name, kind in dict(one.dtypes).items():
        if name == own:
            continue
        have = dict(frame.dtypes).get(name)
        if have is None:
            frame = frame.withColumn(name, F.lit(None).cast(kind))
        elif have != kind and props[name] is not None and not (have == "double" and kind in ("bigint", "int")):
            to = "double" if {have, kind} <= {"bigint", "int", "double", "float"} else "variant"
            if have != to:
                frame = frame.withColumn(name, F.col(quoted(name)).cast(to))
    return frame, {f.name: f.dataType for f in frame.schema}


def _set(frame: DataFrame, props: Props, hit) -> DataFrame:
    """Set properties on the rows where ``hit`` holds."""
    frame, kinds = _settable(frame, props)
    for name, value in props.items():
        if isinstance(kinds[name], T.VariantType) and value is not None:
            import json

            new = F.parse_json(F.lit(json.dumps(value)))
        else:
            new = (F.array(*map(F.lit, value)) if isinstance(value, (list, tuple)) else F.lit(value)).cast(kinds[name])
        frame = frame.withColumn(name, F.when(hit, new).otherwise(F.col(quoted(name))))
    return frame


def update_nodes(graph: PropertyGraph, ids: DataFrame | Iterable[str], props: Props) -> PropertyGraph:
    """Merge properties into the nodes with these ids; what isn't named stays."""
    frame = ids.select(F.col("id").alias("hit_id")).distinct() if isinstance(ids, DataFrame) else None
    few = None if frame is not None else list(ids)
    tables = {}
    for name, t in graph.nodes.items():
        if few is not None:
            rows = _set(t.frame, props, F.col("id").isin(few))
        else:
            rows = t.frame.join(frame, F.col("id") == F.col("hit_id"), "left")
            rows = _set(rows, props, F.col("hit_id").isNotNull()).drop("hit_id")
        tables[name] = replace(t, frame=rows)
    return replace(graph, nodes=tables)


def _present(rows: DataFrame, what: str, id: str) -> None:
    if rows.isEmpty():
        raise GraphError(f"no {what} {id!r}")


def update_node(graph: PropertyGraph, id: str, props: Props) -> PropertyGraph:
    """Merge properties into one node; an error if it is missing."""
    _present(get_node(graph, id), "node", id)
    return update_nodes(graph, [id], props)


def merge_node_frame(graph: PropertyGraph, name: str, updates: DataFrame) -> PropertyGraph:
    """Merge a frame (id, properties) into a table: its columns win wherever an id matches, nulls too."""
    table = graph.nodes[name]
    props = [c for c in updates.columns if c != "id"]
    new = updates.select(F.col("id").alias("new_id"), F.struct(*map(quoted, props)).alias("new"))
    rows = table.frame.join(new, F.col("id") == F.col("new_id"), "left")
    for c in props:
        old = F.col(quoted(c)) if c in table.frame.columns else F.lit(None)
        rows = rows.withColumn(c, F.when(F.col("new_id").isNotNull(), F.col(f"new.{quoted(c)}")).otherwise(old))
    return replace(graph, nodes={**graph.nodes, name: replace(table, frame=rows.drop("new_id", "new"))})


def delete_nodes(graph: PropertyGraph, ids: DataFrame | Iterable[str]) -> PropertyGraph:
    """Remove nodes and all relationships that touch them; ids without a node do nothing."""
    if isinstance(ids, DataFrame):
        gone = ids.select(F.col("id").alias("gone")).distinct()
        without = lambda f, c: f.join(gone, F.col(c) == F.col("gone"), "left_anti")
    else:
        few = list(ids)
        without = lambda f, c: f.where(~F.col(c).isin(few))
    nodes = {n: replace(t, frame=without(t.frame, "id")) for n, t in graph.nodes.items()}
    rels = {n: replace(t, frame=without(without(t.frame, "src"), "dst")) for n, t in graph.rels.items()}
    return replace(graph, nodes=nodes, rels=rels)


def delete_node(graph: PropertyGraph, id: str) -> PropertyGraph:
    return delete_nodes(graph, [id])


def _relabel(graph: PropertyGraph, ids: DataFrame | Iterable[str], label: str, add: bool) -> PropertyGraph:
    tables = {}
    for name, t in graph.nodes.items():
        if add == (label in t.fixed) and add or not add and label not in t.fixed | t.maybe:
            tables[name] = t  # nothing to do here
            continue
        rows = t.frame
        if isinstance(ids, DataFrame):
            rows = rows.join(ids.select(F.col("id").alias("hit_id")).distinct(), F.col("id") == F.col("hit_id"), "left")
            hit = F.col("hit_id").isNotNull()
        else:
            hit = F.col("id").isin(list(ids))
        change = F.array_union("labels", F.array(F.lit(label))) if add else F.array_remove("labels", label)
        rows = rows.withColumn("labels", F.when(hit, change).otherwise(F.col("labels"))).drop("hit_id")
        tables[name] = NodeTable(rows, t.fixed - {label}, t.maybe | {label})
    return replace(graph, nodes=tables)


def add_label(graph: PropertyGraph, ids: DataFrame | str | Iterable[str], label: str) -> PropertyGraph:
    """Idempotent; an error for one id without a node."""
    if isinstance(ids, str):
        _present(get_node(graph, ids), "node", ids)
        ids = [ids]
    return _relabel(graph, ids, label, True)


def remove_label(graph: PropertyGraph, ids: DataFrame | str | Iterable[str], label: str) -> PropertyGraph:
    """Idempotent; an error for one id without a node."""
    if isinstance(ids, str):
        _present(get_node(graph, ids), "node", ids)
        ids = [ids]
    return _relabel(graph, ids, label, False)


def create_relationships(graph: PropertyGraph, rels: Iterable[tuple[str, str, str] | tuple[str, str, str, Props]]) -> tuple[PropertyGraph, list[str]]:
    """Add relationships (src, dst, type, properties); both ends must exist."""
    rows = [(new_id(), x[0], x[1], x[2], dict(x[3]) if len(x) > 3 and x[3] else {}) for x in rels]
    ends = list(dict.fromkeys(e for r in rows for e in r[1:3]))
    have = {r.id for r in graph.vertices().where(F.col("id").isin(ends)).select("id").collect()} if ends else set()
    if lost := [e for e in ends if e not in have]:
        raise GraphError(f"no node {', '.join(map(repr, lost))}")
    tables = dict(graph.rels)
    by_type: dict[str, list] = {}
    for r in rows:
        by_type.setdefault(r[3], []).append((r[0], r[1], r[2], r[4]))
    for type, group in by_type.items():
        new = rel_rows(graph.spark, type, group)
        if (old := tables.get(type)) is not None:
            new = RelTable(_merged(old.frame, new.frame), type)
        tables[type] = new
    return replace(graph, rels=tables), [r[0] for r in rows]


def create_relationship(graph: PropertyGraph, src: str, dst: str, type: str, props: Props | None = None) -> tuple[PropertyGraph, str]:
    graph, ids = create_relationships(graph, [(src, dst, type, props or {})])
    return graph, ids[0]


def add_rel_frame(graph: PropertyGraph, type: str, frame: DataFrame) -> PropertyGraph:
    """Add a whole frame of relationships (rel_id, src, dst, properties) whose ends all exist.

    The ends are checked by one anti-join for each side; the bulk form of ``create_relationships``.
    """
    ids = graph.vertices().select(F.col("id").alias("known_id"))
    for end in ("src", "dst"):
        if not frame.join(ids, F.col(end) == F.col("known_id"), "left_anti").isEmpty():
            raise GraphError(f"some {end} of {type!r} has no node")
    fresh = PropertyGraph(graph.spark).with_rels(type, frame, whole=True).rels[type]
    if (old := graph.rels.get(type)) is not None:
        fresh = RelTable(_merged(old.frame, fresh.frame), type)
    return replace(graph, rels={**graph.rels, type: fresh})


def update_relationships(graph: PropertyGraph, ids: DataFrame | Iterable[str], props: Props) -> PropertyGraph:
    """Merge properties into the relationships with these ids."""
    if not isinstance(ids, DataFrame):
        few = list(ids)
        return replace(graph, rels={n: replace(t, frame=_set(t.frame, props, F.col("rel_id").isin(few))) for n, t in graph.rels.items()})
    hit, rels = ids.select(F.col("rel_id").alias("hit_id")).distinct(), {}
    for n, t in graph.rels.items():
        rows = t.frame.join(hit, F.col("rel_id") == F.col("hit_id"), "left")
        rels[n] = replace(t, frame=_set(rows, props, F.col("hit_id").isNotNull()).drop("hit_id"))
    return replace(graph, rels=rels)


def update_relationship(graph: PropertyGraph, rel_id: str, props: Props) -> PropertyGraph:
    """Merge properties; an error if the relationship is missing."""
    _present(get_relationship(graph, rel_id), "relationship", rel_id)
    return update_relationships(graph, [rel_id], props)


def delete_relationships(graph: PropertyGraph, ids: DataFrame | Iterable[str]) -> PropertyGraph:
    """Remove relationships; ids that there aren't do nothing."""
    rels = {}
    for n, t in graph.rels.items():
        if isinstance(ids, DataFrame):
            rows = t.frame.join(ids.select("rel_id").distinct(), "rel_id", "left_anti").select(t.frame.columns)
        else:
            rows = t.frame.where(~F.col("rel_id").isin(list(ids)))
        rels[n] = replace(t, frame=rows)
    return replace(graph, rels=rels)


def upsert_node(graph: PropertyGraph, label: str, match: Props, props: Props) -> tuple[PropertyGraph, str]:
    """Merge into the matching node with the least id, or create one from both."""
    first = find_nodes(graph, label, match).select("id").orderBy("id").first()
    if first is not None:
        return update_nodes(graph, [first.id], props), first.id
    return create_node(graph, [label], {**match, **props})


def _merge_items(graph: PropertyGraph, label: str, items: Mapping[str, Props]) -> PropertyGraph:
    """Merge different properties into different nodes of a label, by id: one join a table."""
    if not items:
        return graph
    props = list(dict.fromkeys(c for p in items.values() for c in p))
    taken = {*props, *(c for t in graph.nodes.values() for c in t.frame.columns)}
    hit_id, named, values = (_free(c, taken) for c in ("hit_id", "named", "new_values"))
    fixed = T.StructType([T.StructField(hit_id, T.StringType()), T.StructField(named, T.ArrayType(T.StringType()))])
    new = rows_frame(graph.spark, fixed, [(i, list(p)) for i, p in items.items()], list(items.values()))
    new = new.select(hit_id, named, F.struct(*map(quoted, props)).alias(values))
    tables = dict(graph.nodes)
    for name, t in graph.nodes.items():
        if label not in t.fixed | t.maybe:
            continue
        frame = t.frame
        for p in items.values():
            frame, kinds = _settable(frame, p)
        kinds = {f.name: f.dataType for f in frame.schema}
        rows = frame.join(new, F.col("id") == F.col(hit_id), "left")
        for c in props:
            hit = F.coalesce(F.array_contains(named, c), F.lit(False))
            rows = rows.withColumn(c, F.when(hit, F.col(f"{values}.{quoted(c)}").cast(kinds[c])).otherwise(F.col(quoted(c))))
        tables[name] = replace(t, frame=rows.drop(hit_id, named, values))
    return replace(graph, nodes=tables)


def upsert_nodes(graph: PropertyGraph, label: str, key: str, items: Iterable[Props]) -> tuple[PropertyGraph, list[str]]:
    """Upsert many by one key property; of items with one key the later ones are merged over the earlier."""
    merged: dict[Any, dict] = {}
    for item in items:
        merged.setdefault(item[key], {}).update(item)
    found = find_nodes(graph, label, {key: {"in": list(merged)}})
    have: dict[Any, str] = {}
    if key in found.columns:
        nth = F.row_number().over(Window.partitionBy(quoted(key)).orderBy("id"))
        value = F.col(quoted(key))
        have = {r[1]: r[0] for r in found.select("id", value.alias("v"), nth.alias("nth")).where("nth = 1").collect()}  # of the keys given
    graph = _merge_items(graph, label, {have[k]: item for k, item in merged.items() if k in have})
    graph, made = create_nodes(graph, [([label], item) for k, item in merged.items() if k not in have])
    fresh = iter(made)
    return graph, [have[k] if k in have else next(fresh) for k in merged]


def upsert_node_frame(graph: PropertyGraph, name: str, key: str, items: DataFrame, new_id_prefix: str) -> PropertyGraph:
    """Upsert a frame with one row for each key into a table: one full outer join.

    A key that several nodes have goes to the one with the least id; a new key makes a node
    whose id is the prefix and the key.
    """
    table = graph.nodes[name]
    props = [c for c in items.columns if c != key]
    first = F.row_number().over(Window.partitionBy(quoted(key)).orderBy("id")) == 1
    old = table.frame.withColumn("first_", first).withColumn("key_", F.when(F.col("first_"), F.col(quoted(key))))
    new = items.select(F.col(quoted(key)).alias("new_key"), *[F.col(quoted(c)).alias(f"new_{c}") for c in props])
    rows = old.join(new, F.col("key_") == F.col("new_key"), "full_outer")
    made, hit = F.col("id").isNull(), F.col("new_key").isNotNull()
    columns = [F.coalesce("id", F.concat(F.lit(new_id_prefix), F.col("new_key").cast("string"))).alias("id")]
    columns.append(F.when(made, F.array(*map(F.lit, sorted(table.fixed))).cast("array<string>")).otherwise(F.col("labels")).alias("labels"))
    for c in dict.fromkeys([*table.props, *props]):
        value = F.col(quoted(c)) if c in table.props else F.lit(None)
        if c == key:
            value = F.coalesce(value, F.col("new_key"))
        elif c in props:
            value = F.when(hit, F.col(quoted(f"new_{c}"))).otherwise(value)
        columns.append(value.alias(c))
    return replace(graph, nodes={**graph.nodes, name: replace(table, frame=rows.select(*columns))})


def upsert_relationship(graph: PropertyGraph, src: str, dst: str, type: str, props: Props | None = None) -> tuple[PropertyGraph, str]:
    """Merge into the relationship of a type between two nodes with the least id, or create it."""
    if type in graph.rels:
        rows = graph.rels[type].frame.where((F.col("src") == src) & (F.col("dst") == dst))
        if (first := rows.select("rel_id").orderBy("rel_id").first()) is not None:
            return (update_relationships(graph, [first.rel_id], props) if props else graph), first.rel_id
    return create_relationship(graph, src, dst, type, props)


def create_index(graph: PropertyGraph, label: str, prop: str) -> PropertyGraph:
    """Note an index.  Layout is Spark's business: sort the table by the property before saving it."""
    tables = {}
    for n, t in graph.nodes.items():
        tables[n] = replace(t, frame=t.frame.sortWithinPartitions(quoted(prop))) if label in t.fixed and prop in t.props and (label, prop) not in graph.indexes else t
    return replace(graph, nodes=tables, indexes=graph.indexes | {(label, prop)})


def drop_index(graph: PropertyGraph, label: str, prop: str) -> PropertyGraph:
    return replace(graph, indexes=graph.indexes - {(label, prop)})


def in_transaction(graph: PropertyGraph, change: Callable[[PropertyGraph], tuple[PropertyGraph, R]]) -> tuple[PropertyGraph, R | None, Exception | None]:
    """The changed graph and the result; if the change raises, the old graph and the error."""
    try:
        new, result = change(graph)
    except Exception as error:  # noqa: BLE001 - whatever went wrong, the old graph holds
        return graph, None, error
    return new, result, None


def frames(graph: PropertyGraph) -> tuple[DataFrame, DataFrame]:
    """All nodes and all relationships with their properties, for a look at the state."""
    nodes = union(t.frame for t in graph.nodes.values()) if graph.nodes else graph.vertices()
    rels = union(t.frame.withColumn("type", F.lit(t.type)) for t in graph.rels.values()) if graph.rels else graph.edges()
    assert set(NODE_COLUMNS) <= set(nodes.columns) and set(REL_COLUMNS) <= set(rels.columns)
    return nodes, rels
