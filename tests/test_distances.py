"""Hop distances along types that lead from table to table, against a walk of one's own."""

import random

import pytest

from arcweft.operators import algorithms as alg
from arcweft.sources.model import PropertyGraph

KINDS = "abcd"


def typed(spark, n=12, arcs=40, seed=3):
    """Tables a to d, whose nodes carry a label of that name (some of c also "Odd"), types AB, BC, CD and AC, and CC from c to c."""
    rng = random.Random(seed)
    g = PropertyGraph(spark)
    for k in KINDS:
        rows = [(f"{k}{i}", [k, "Odd"] if k == "c" and i % 2 else [k]) for i in range(n)]
        g = g.with_nodes(k, spark.createDataFrame(rows, "id string, labels array<string>"), [k], ["Odd"] if k == "c" else [])
    edges = {}
    for t in ("AB", "BC", "CD", "AC", "CC"):
        x, y = t.lower()
        edges[t] = [(f"{t}{i}", f"{x}{rng.randrange(n)}", f"{y}{rng.randrange(n)}") for i in range(arcs)]
        g = g.with_rels(t, spark.createDataFrame(edges[t], "rel_id string, src string, dst string"), [x], [y], True)
    return g, edges


def walked(edges, types, seeds, direction, most):
    out = set()
    for s in seeds:
        hops, queue = {s: 0}, [s]
        for x in queue:
            if most is not None and hops[x] >= most:
                continue
            for t in types:
                for _, a, b in edges[t]:
                    a, b = (a, b) if direction == "outgoing" else (b, a)
                    if a == x and b not in hops:
                        hops[b] = hops[x] + 1
                        queue.append(b)
        out |= {(s, x, h) for x, h in hops.items()}
    return out


@pytest.mark.parametrize(
    ("types", "kinds", "direction", "most", "few"),
    [
        (["AB", "BC", "CD"], "a", "outgoing", None, 0),
        (["AB", "BC", "CD"], "dc", "incoming", 2, alg.FEW_NAMES),
        (["AB", "BC", "AC"], "a", "outgoing", None, alg.FEW_NAMES),  # c comes twice
        (["BC", "CC"], "b", "outgoing", 3, alg.FEW_NAMES),
        (["CC"], "c", "outgoing", 1, alg.FEW_NAMES),
        (["CD"], "ac", "outgoing", None, 0),
    ],
)
def test_distances_between_tables(spark, monkeypatch, types, kinds, direction, most, few):
    monkeypatch.setattr(alg, "FEW_NAMES", few)
    g, edges = typed(spark)
    seeds = [f"{k}{i}" for k in kinds for i in range(0, 12, 2)]
    want = walked(edges, types, seeds, direction, most)
    found = alg.hop_distances(g, [*seeds, "nobody"], types, direction, most).collect()
    assert sorted(map(tuple, found)) == sorted(want)
    odd = {f"c{i}" for i in range(1, 12, 2)}
    found = alg.hop_distances(g, seeds, types, direction, most, label="Odd").collect()
    assert sorted(map(tuple, found)) == sorted(r for r in want if r[1] in odd)


def test_more_far_nodes_than_a_code_has_low_bits_for(spark, monkeypatch):
    monkeypatch.setattr(alg, "LOW", 3)
    g, edges = typed(spark, 60, 400)
    seeds = [f"a{i}" for i in range(60)]
    found = alg.hop_distances(g, seeds, ["AB", "BC"], "outgoing").collect()
    assert sorted(map(tuple, found)) == sorted(walked(edges, ["AB", "BC"], seeds, "outgoing", None))


def test_the_last_level_is_not_written(spark, monkeypatch):
    """30 seeds, one node that all lead to, 30 that it leads to: 900 pairs from 60 relationships."""
    written = []

    def cut(df, real=alg.cut):
        out = real(df)
        written.append(out.count())
        return out

    monkeypatch.setattr(alg, "cut", cut)
    g = PropertyGraph(spark)
    for k, ids in (("a", range(30)), ("b", range(1)), ("c", range(30))):
        g = g.with_nodes(k, spark.createDataFrame([(f"{k}{i}",) for i in ids], "id string"), [k])
    for t, rows in (("AB", [(f"x{i}", f"a{i}", "b0") for i in range(30)]), ("BC", [(f"y{i}", "b0", f"c{i}") for i in range(30)])):
        g = g.with_rels(t, spark.createDataFrame(rows, "rel_id string, src string, dst string"), [t[0].lower()], [t[1].lower()], True)
    found = alg.hop_distances(g, [f"a{i}" for i in range(30)], ["AB", "BC"], "outgoing", 4, label="c")
    assert found.count() == 900 and max(written) <= 60
