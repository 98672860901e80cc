"""A labelled property graph as an immutable value of Spark frames.

Topology and properties are columns of narrow tables, one per kind of node and one per
relationship type: ``id, labels, <properties>`` and ``rel_id, src, dst, <properties>``.  A
query reads only the tables and columns that it names, so label and type selection prune whole
files, and filters reach the Parquet scan.  Expansion works on ids alone; properties are joined
at the end.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field, replace
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.predicates import quoted

NODE_COLUMNS, REL_COLUMNS = ("id", "labels"), ("rel_id", "src", "dst")
VERTEX = T.StructType([T.StructField("id", T.StringType()), T.StructField("labels", T.ArrayType(T.StringType()))])
EDGE = T.StructType([T.StructField(c, T.StringType()) for c in ("rel_id", "type", "src", "dst")])


class GraphError(ValueError):
    """A graph operation that can't be done: something it names is missing or already there."""


def _props(frame: DataFrame, fixed: tuple[str, ...]) -> dict[str, T.DataType]:
    fields = {f.name: f.dataType for f in frame.schema if f.name not in fixed}
    if len({n.lower() for n in fields}) < len(fields):
        raise GraphError(f"property names differ in case only: {sorted(fields)}")
    return fields


@dataclass(frozen=True)
class NodeTable:
    """Nodes of one shape.  All rows carry the labels in ``fixed``, some may carry those in ``maybe``."""

    frame: DataFrame
    fixed: frozenset[str]
    maybe: frozenset[str] = frozenset()

    @property
    def props(self) -> dict[str, T.DataType]:
        return _props(self.frame, NODE_COLUMNS)

    def labelled(self, label: str) -> DataFrame | None:
        """The rows that carry a label; None if none can."""
        if label in self.fixed:
            return self.frame
        return self.frame.where(F.array_contains("labels", label)) if label in self.maybe else None


@dataclass(frozen=True)
class RelTable:
    """Relationships of one type, and the labels that their ends are known to carry, if any."""

    frame: DataFrame
    type: str
    starts: frozenset[str] = frozenset()
    ends: frozenset[str] = frozenset()

    @property
    def props(self) -> dict[str, T.DataType]:
        return _props(self.frame, REL_COLUMNS)


def union(frames: Iterable[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


@dataclass(frozen=True)
class PropertyGraph:
    """Node tables by name and relationship tables by type.

    ``whole`` says that every relationship's ends exist; expansion then needs no look at the
    nodes.  Frames that come from outside are not trusted until ``validate`` has found nothing.
    """

    spark: SparkSession
    nodes: Mapping[str, NodeTable] = field(default_factory=dict)
    rels: Mapping[str, RelTable] = field(default_factory=dict)
    whole: bool = True
    indexes: frozenset[tuple[str, str]] = frozenset()

    # -- building ---------------------------------------------------------------------------

    def with_nodes(self, name: str, frame: DataFrame, labels: Iterable[str], maybe: Iterable[str] = ()) -> PropertyGraph:
        """Add a table of nodes: a string ``id``, perhaps ``labels``, and properties."""
        fixed = list(dict.fromkeys(labels))
        if "labels" not in frame.columns:
            frame = frame.withColumn("labels", F.array(*[F.lit(x) for x in fixed]).cast("array<string>"))
        props = [c for c in frame.columns if c not in NODE_COLUMNS]
        frame = frame.select(F.col("id").cast("string").alias("id"), "labels", *map(quoted, props))
        table = NodeTable(frame, frozenset(fixed), frozenset(maybe) - frozenset(fixed))
        _ = table.props
        return replace(self, nodes={**self.nodes, name: table})

    def with_rels(
        self, type: str, frame: DataFrame, starts: Iterable[str] = (), ends: Iterable[str] = (), whole: bool = False
    ) -> PropertyGraph:
        """Add relationships of a type: ``rel_id``, ``src``, ``dst`` and properties."""
        props = [c for c in frame.columns if c not in REL_COLUMNS]
        frame = frame.select(*[F.col(c).cast("string").alias(c) for c in REL_COLUMNS], *map(quoted, props))
        table = RelTable(frame, type, frozenset(starts), frozenset(ends))
        _ = table.props
        return replace(self, rels={**self.rels, type: table}, whole=self.whole and whole)

    def trusted(self) -> PropertyGraph:
        return replace(self, whole=True)

    # -- topology ---------------------------------------------------------------------------

    @property
    def labels(self) -> frozenset[str]:
        return frozenset().union(*(t.fixed | t.maybe for t in self.nodes.values())) if self.nodes else frozenset()

    @property
    def types(self) -> tuple[str, ...]:
        return tuple(self.rels)

    def vertices(self) -> DataFrame:
        """(id, labels) of every node once."""
        if not self.nodes:
            return self.spark.createDataFrame([], VERTEX)
        return union(t.frame.select("id", "labels") for t in self.nodes.values())

    def edges(self, types: Iterable[str] | None = None) -> DataFrame:
        """(rel_id, type, src, dst); only the tables of the types asked for are read."""
        wanted = [self.rels[t] for t in dict.fromkeys(types or self.rels) if t in self.rels]
        if not wanted:
            return self.spark.createDataFrame([], EDGE)
        return union(r.frame.select("rel_id", F.lit(r.type).alias("type"), "src", "dst") for r in wanted)

    # -- checks -----------------------------------------------------------------------------

    def validate(self) -> DataFrame:
        """(problem, n): duplicate ids and missing ends, with no row if there are none."""
        checks = []
        ids, rel_ids = self.vertices().select("id"), self.edges().select("rel_id")
        for what, column in (("duplicate node id", ids), ("duplicate relationship id", rel_ids)):
            again = column.groupBy(*column.columns).count().where("count > 1")
            checks.append(again.agg(F.count(F.lit(1)).alias("n")).select(F.lit(what).alias("problem"), "n"))
        for end in ("src", "dst"):
            lost = self.edges().join(ids, F.col(end) == F.col("id"), "left_anti")
            checks.append(lost.agg(F.count(F.lit(1)).alias("n")).select(F.lit(f"missing {end}").alias("problem"), "n"))
        return union(checks).where("n > 0")

    def ensure(self, label: str, prop: str, kind: str) -> DataFrame:
        """Nodes that break a constraint: ``unique`` values, or a property that must exist."""
        from ..operators.scan import find_nodes

        rows = find_nodes(self, label)
        column = F.col(quoted(prop)) if prop in rows.columns else F.lit(None).cast("string")
        rows = rows.select("id", column.alias("value"))
        if kind == "exists":
            return rows.where("value IS NULL").select("id")
        if kind != "unique":
            raise GraphError(f"unknown constraint {kind!r}")
        again = rows.where("value IS NOT NULL").groupBy("value").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        return rows.join(again, "value", "left_semi").select("id")


def empty_graph(spark: SparkSession) -> PropertyGraph:
    return PropertyGraph(spark)


def new_id() -> str:
    return str(uuid.uuid4())


# -- rows from Python -----------------------------------------------------------------------


def _type_of(values: list[Any]) -> T.DataType:
    """One type for all values that aren't null; a variant if they have several."""
    kinds = {type(v) for v in values if v is not None}
    if not kinds or kinds == {str}:
        return T.StringType()
    if kinds == {bool}:
        return T.BooleanType()
    if kinds == {int}:
        return T.LongType()
    if kinds <= {int, float}:
        return T.DoubleType()
    if kinds == {list}:
        inner = [x for v in values if v is not None for x in v]
        kind = _type_of(inner)
        if not isinstance(kind, (T.VariantType, T.ArrayType)):
            return T.ArrayType(kind)
    if kinds <= {int, float, str, bool, list, dict}:
        return T.VariantType()
    sample = next(v for v in values if v is not None)
    if len(kinds) == 1 and type(sample).__name__ in ("datetime", "date", "Decimal", "bytes"):
        names = {"datetime": T.TimestampNTZType(), "date": T.DateType(), "Decimal": T.DecimalType(38, 18), "bytes": T.BinaryType()}
        return names[type(sample).__name__]
    raise GraphError(f"no column type for values of {sorted(k.__name__ for k in kinds)}")


def rows_frame(spark: SparkSession, fixed: T.StructType, rows: list[tuple], props: list[Mapping[str, Any]]) -> DataFrame:
    """A frame of fixed columns and one column for each property name that occurs."""
    names = list(dict.fromkeys(n for p in props for n in p))
    kinds = {n: _type_of([p.get(n) for p in props]) for n in names}

    def cell(name: str, value: Any) -> Any:
        if value is None:
            return None
        if isinstance(kinds[name], T.VariantType):
            return json.dumps(value)
        return float(value) if isinstance(kinds[name], T.DoubleType) else value

    plain = {n: T.StringType() if isinstance(k, T.VariantType) else k for n, k in kinds.items()}
    schema = T.StructType([*fixed.fields, *(T.StructField(n, k) for n, k in plain.items())])
    data = [(*r, *(cell(n, p.get(n)) for n in names)) for r, p in zip(rows, props, strict=True)]
    frame = spark.createDataFrame(data, schema)
    parsed = {n: F.parse_json(F.col(quoted(n))) for n, k in kinds.items() if isinstance(k, T.VariantType)}
    return frame.select(*[parsed.get(c, F.col(quoted(c))).alias(c) for c in frame.columns])


def node_rows(spark: SparkSession, nodes: Iterable[tuple[str, Iterable[str], Mapping[str, Any]]]) -> NodeTable:
    """A node table from (id, labels, properties) triples."""
    nodes = [(i, list(dict.fromkeys(labels)), dict(p)) for i, labels, p in nodes]
    frame = rows_frame(spark, VERTEX, [(i, labels) for i, labels, _ in nodes], [p for _, _, p in nodes])
    sets = [frozenset(labels) for _, labels, _ in nodes]
    fixed = frozenset.intersection(*sets) if sets else frozenset()
    return NodeTable(frame, fixed, (frozenset().union(*sets) if sets else frozenset()) - fixed)


def rel_rows(spark: SparkSession, type: str, rels: Iterable[tuple[str, str, str, Mapping[str, Any]]]) -> RelTable:
    """A relationship table from (rel_id, src, dst, properties) tuples."""
    rels = [(*r[:3], dict(r[3])) for r in rels]
    fixed = T.StructType([T.StructField(c, T.StringType()) for c in REL_COLUMNS])
    return RelTable(rows_frame(spark, fixed, [r[:3] for r in rels], [r[3] for r in rels]), type)
