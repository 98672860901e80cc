"""Small graphs for the tests."""

from __future__ import annotations

from arcweft.operators import mutate as m
from arcweft.sources.model import PropertyGraph


def build(spark, nodes, rels=()):
    """A graph from {id: (labels, properties)} and (src, dst, type[, properties]) tuples."""
    g, _ = m.create_nodes(PropertyGraph(spark), [(labels, props, i) for i, (labels, props) in nodes.items()])
    if rels:
        g, _ = m.create_relationships(g, rels)
    return g


def people(spark):
    return build(
        spark,
        {
            "alice": (["Person"], {"name": "Alice", "age": 30, "city": "NYC"}),
            "bob": (["Person"], {"name": "Bob", "age": 25, "city": "LA"}),
            "charlie": (["Person"], {"name": "Charlie", "age": 35, "city": "NYC"}),
            "acme": (["Company"], {"name": "Acme Corp"}),
        },
        [
            ("alice", "bob", "KNOWS", {"since": 2020}),
            ("alice", "charlie", "KNOWS", {"since": 2019}),
            ("bob", "charlie", "KNOWS", {"since": 2021}),
            ("alice", "acme", "WORKS_ON"),
        ],
    )


def letters(spark, arrows, type="KNOWS", **props):
    """A graph from arrows such as "AB BC CA"; properties by letter."""
    arrows = arrows.split()
    names = dict.fromkeys("".join(arrows))
    return build(spark, {n: (["Node"], props.get(n, {})) for n in names}, [(a[0], a[1], type) for a in arrows])


def values(frame, column):
    return sorted(r[0] for r in frame.select(column).collect())
