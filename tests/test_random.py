"""Random graphs with self-loops, parallel relationships and null properties, against plain Python."""

import heapq
import random
from collections import Counter

import pytest

from arcweft.operators import algorithms as alg
from arcweft.operators.expand import neighbors
from arcweft.operators.traversal import traverse
from arcweft.sources.model import PropertyGraph


def make(spark, seed, nodes=30, rels=70):
    rng = random.Random(seed)
    ids = [f"n:{k}" for k in range(nodes)]
    ages = {i: rng.choice([None, *range(5)]) for i in ids}
    edges = [(f"r{k}", rng.choice(ids), rng.choice(ids), rng.choice("TU"), rng.choice([None, 1, 2, 5])) for k in range(rels)]
    g = PropertyGraph(spark).with_nodes("n", spark.createDataFrame(list(ages.items()), "id string, age int"), ["N"])
    for t in "TU":
        rows = [(r, a, b, w) for r, a, b, x, w in edges if x == t]
        g = g.with_rels(t, spark.createDataFrame(rows, "rel_id string, src string, dst string, w int"), whole=True)
    return g, ages, edges


def around(edges, node, types, direction):
    out = [(b, r, w) for r, a, b, t, w in edges if a == node and t in types] if direction != "incoming" else []
    return out + ([(a, r, w) for r, a, b, t, w in edges if b == node and t in types] if direction != "outgoing" else [])


def walk(edges, ages, start, steps, depth, unique):
    """Breadth first, as (hop, node) in the order of visits."""
    queue, seen, found = [(start, 0)], {start}, []
    for node, hop in queue:
        if hop:
            found.append((hop, node))
        if hop >= depth:
            continue
        types, direction, least = steps[hop % len(steps)]
        for other, _, _ in around(edges, node, types, direction):
            if least is not None and not (ages[other] is not None and ages[other] >= least):
                continue
            if unique:
                if other in seen:
                    continue
                seen.add(other)
            queue.append((other, hop + 1))
    return Counter(found)


STEPS = (
    [("T", "outgoing", None)],
    [("TU", "both", None)],
    [("T", "outgoing", None), ("U", "incoming", 2)],
    [("TU", "outgoing", 1), ("T", "both", None), ("U", "outgoing", None)],
)


def described(t, steps):
    for types, direction, least in steps:
        t = {"outgoing": t.outgoing, "incoming": t.incoming, "both": t.both}[direction](*types)
        t = t if least is None else t.where({"age": {"gte": least}})
    return t


@pytest.mark.parametrize("seed", range(2))
def test_traversals(spark, seed):
    g, ages, edges = make(spark, seed)
    for k, steps in enumerate(STEPS):
        start = f"n:{3 * k}"
        for unique, depth in ((False, 3), (True, 4)):
            t = described(traverse(g, start), steps).depth(depth)
            rows = (t.unique() if unique else t).collect().collect()
            assert Counter((r.hop, r.id) for r in rows) == walk(edges, ages, start, steps, depth, unique), (steps, unique)
        counted = {(r.hop, r.id): r.walks for r in described(traverse(g, start), steps).depth(3).counts().collect()}
        assert counted == walk(edges, ages, start, steps, 3, False)


def test_many_seeds_at_once(spark):
    g, ages, edges = make(spark, 5)
    seeds = [f"n:{k}" for k in range(6)]
    rows = described(traverse(g, seeds), STEPS[2]).depth(4).unique().collect().collect()
    for s in seeds:
        assert Counter((r.hop, r.id) for r in rows if r.seed == s) == walk(edges, ages, s, STEPS[2], 4, True)
    near = Counter((r.seed, r.id, r.rel_id) for r in neighbors(g, seeds, ["T"]).collect())
    assert near == Counter((s, o, r) for s in seeds for o, r, _ in around(edges, s, "T", "both"))


def test_distances(spark):
    g, ages, edges = make(spark, 6)
    hops = {r.id: r.hops for r in alg.hop_distances(g, "n:0", ["T", "U"], "outgoing").collect()}
    want, queue = {"n:0": 0}, ["n:0"]
    for n in queue:
        for o, _, _ in around(edges, n, "TU", "outgoing"):
            if o not in want:
                want[o] = want[n] + 1
                queue.append(o)
    assert hops == want
    paths = {r.id: r for r in alg.shortest_paths(g, "n:0", list(want), direction="outgoing").collect()}
    ends = {r: (a, b) for r, a, b, _, _ in edges}
    for i, h in want.items():
        p = paths[i]
        assert p.length == h and all(ends[r] == (a, b) for r, a, b in zip(p.rels, p.nodes, p.nodes[1:], strict=False))
    costs, heap = {}, [(0.0, "n:0")]
    while heap:
        c, n = heapq.heappop(heap)
        if n not in costs:
            costs[n] = c
            for o, _, w in around(edges, n, "TU", "both"):
                heapq.heappush(heap, (c + (1 if w is None else w), o))
    found = alg.cheapest_paths(g, "n:0", list(costs), "w").collect()
    assert {r.id: r.cost for r in found} == costs
    assert all(r.nodes[0] == "n:0" and r.nodes[-1] == r.id and r.length == len(r.rels) for r in found)


def test_neighbourhoods(spark):
    g, ages, edges = make(spark, 7)
    keep = lambda n: ages[n] is not None and ages[n] >= 1
    nodes, rels, queue = {"n:1": 0}, set(), ["n:1"]
    for n in queue:
        if nodes[n] >= 2:
            continue
        for o, r, w in around(edges, n, "TU", "both"):
            if w is None or w < 2 or not keep(o):
                continue
            rels.add(r)
            if o not in nodes:
                nodes[o] = nodes[n] + 1
                queue.append(o)
    found, met = alg.neighborhood(g, "n:1", 2, node_filter={"age": {"gte": 1}}, rel_filter={"w": {"gte": 2}})
    assert {r.id: r.hop for r in found.collect()} == nodes and {r.rel_id for r in met.collect()} == rels
