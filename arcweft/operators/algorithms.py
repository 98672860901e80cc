"""Shortest paths, neighbourhoods, components and ranks, for many seeds at once.

Each works level by level: the frontier is a narrow frame of ids, joined to the arcs, matched
against what is known and written to the shared checkpoint folder.  The driver sees only
whether a frontier is empty.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.predicates import quoted
from ..session import cut, release, renew
from ..sources.model import GraphError, PropertyGraph, union
from .expand import BOTH, IN, OUT, arcs, as_ids, existing, starting, step_arcs
from .scan import Filter, matching_ids, matching_rels

Ids = DataFrame | str | Iterable[str]
PATH = "seed string, id string, nodes array<string>, rels array<string>, length int"


#: Up to so many names are broadcast to read codes by; above it they are joined.
FEW_NAMES = 200_000
#: Codes are cut into 16 low bits, kept in lists, and the rest.
LOW = 16


def hop_distances(
    graph: PropertyGraph,
    seeds: Ids,
    types: Iterable[str] | None = None,
    direction: str = BOTH,
    max_depth: int | None = None,
    label: str | None = None,
) -> DataFrame:
    """(seed, id, hops) of every node that can be reached, the seed itself with 0; with a ``label``, only of nodes that carry it."""
    types = tuple(types) if types is not None else None
    first = cut(starting(graph, seeds))
    layers = _layers(graph, first, types, direction, max_depth)
    if layers is not None:
        return _layered(graph, first, layers, direction, label)
    level, hop = first.select("seed", F.col("seed").alias("id"), F.lit(0).alias("hops")), 0
    seen = level
    steps = step_arcs(graph, types, direction)
    while max_depth is None or hop < max_depth:
        hop += 1
        found = level.join(steps, F.col("id") == F.col("here")).select("seed", F.col("there").alias("id")).distinct()
        level = renew(cut(found.join(seen, ["seed", "id"], "left_anti").withColumn("hops", F.lit(hop))))
        if level.isEmpty():
            break
        seen = seen.unionAll(level)
    return seen if label is None else _labelled(graph, seen, label)


def _labelled(graph: PropertyGraph, rows: DataFrame, label: str) -> DataFrame:
    tables = [t for t in (t.labelled(label) for t in graph.nodes.values()) if t is not None]
    if not tables:
        return rows.limit(0)
    return rows.join(union(t.select(F.col("id").alias("known_id")) for t in tables), F.col("id") == F.col("known_id"), "left_semi")


def _layers(
    graph: PropertyGraph, first: DataFrame, types: tuple[str, ...] | None, direction: str, max_depth: int | None
) -> list[tuple[tuple[str, ...], frozenset[str]]] | None:
    """For each hop from 0 on its types and the node tables that it ends in, if none of these can come twice; else None.

    This is told by the seeds' tables and the labels that a type's ends are known to carry.
    """
    if direction not in (OUT, IN) or not graph.whole:
        return None
    tables = [graph.rels[t] for t in dict.fromkeys(types or graph.types) if t in graph.rels]
    ends = lambda labels: frozenset(n for n, t in graph.nodes.items() if not labels or labels & (t.fixed | t.maybe))
    ways = [(t.type, ends(t.starts), ends(t.ends)) if direction == OUT else (t.type, ends(t.ends), ends(t.starts)) for t in tables]

    def walk(now: frozenset[str]) -> list | None:
        met, out = now, [((), now)]
        while max_depth is None or len(out) <= max_depth:
            on = [w for w in ways if w[1] & now]
            if not on:
                break
            now = frozenset().union(*(w[2] for w in on))
            if now & met:
                return None
            met |= now
            out.append((tuple(w[0] for w in on), now))
        return out

    if all(walk(frozenset([n])) is None for n in graph.nodes):
        return None
    kinds = union(t.frame.select("id", F.lit(n).alias("kind")) for n, t in graph.nodes.items())
    kinds = kinds.join(first, F.col("id") == F.col("seed"), "left_semi").select("kind").distinct()
    return walk(frozenset(r.kind for r in kinds.collect()))


def _layered(graph: PropertyGraph, first: DataFrame, layers: list, direction: str, label: str | None) -> DataFrame:
    """Distances where no level can meet an earlier one, so that none is compared with them.

    Seeds are numbered, and a level is written as lists of seeds by node.  The last one, which may have far
    more pairs than there are relationships, isn't written: each list of seeds meets a list of neighbours,
    and what goes to a seed are lists of 16-bit codes, which are merged there and read only then.
    """
    carry = lambda kinds: [k for k in kinds if label is None or label in graph.nodes[k].fixed | graph.nodes[k].maybe]

    def kept(rows: DataFrame, kinds: frozenset[str], hop: int) -> list[DataFrame]:
        if not carry(kinds):
            return []
        rows = rows.select("seed", "id", F.lit(hop).alias("hops"))
        sure = label is None or all(label in graph.nodes[k].fixed for k in kinds)
        return [rows if sure else _labelled(graph, rows, label).select("seed", "id", "hops")]

    numbered = cut(first.withColumn("s", F.monotonically_increasing_id()))
    n = numbered.count()
    names = numbered.select("s", "seed")
    done = kept(numbered.withColumn("id", F.col("seed")), layers[0][1], 0)
    # a list holds seeds of one partition of the numbering at most
    level = numbered.groupBy(F.col("seed").alias("id"), F.shiftright("s", 33).alias("part")).agg(F.collect_list("s").alias("seeds"))
    for hop, (types, kinds) in enumerate(layers[1:], 1):
        steps = arcs(graph.edges(types), direction).select("here", "there")
        if hop == len(layers) - 1:
            done += kept(_last(level, steps, names, n), kinds, hop) if carry(kinds) else []
            break
        found = level.join(steps, F.col("id") == F.col("here")).select(F.col("there").alias("id"), "part", F.explode("seeds").alias("s"))
        found = found.repartition("id", "part").distinct()
        level = cut(found.groupBy("id", "part").agg(F.collect_list("s").alias("seeds")))
        del found
        release(graph.spark)
        pairs = level.select("id", F.explode("seeds").alias("s")).join(F.broadcast(names) if n <= FEW_NAMES else names, "s")
        done += kept(pairs, kinds, hop)
    return reduce(DataFrame.unionAll, done) if done else graph.spark.createDataFrame([], "seed string, id string, hops int")


def _last(level: DataFrame, steps: DataFrame, names: DataFrame, n: int) -> DataFrame:
    """(seed, id) of what a level's lists of seeds reach in one step."""
    steps = steps.join(level.select(F.col("id").alias("here")), "here", "left_semi").distinct()
    far = cut(steps.select("there").distinct())
    m = far.count()
    far = cut(far.coalesce(max(1, m >> LOW)).withColumn("code", F.monotonically_increasing_id()))
    half = 1 << (LOW - 1)
    low = (F.col("code").bitwiseAND(F.lit((1 << LOW) - 1)) - half).cast("short")
    coded = steps.join(F.broadcast(far) if m <= FEW_NAMES else far, "there").select("here", F.shiftright("code", LOW).alias("high"), low.alias("low"))
    lists = cut(coded.groupBy("here", "high").agg(F.collect_list("low").alias("lows")))
    del coded, steps
    release(level.sparkSession)
    met = level.join(lists, F.col("id") == F.col("here")).select(F.explode("seeds").alias("s"), "high", "lows")
    few = n <= FEW_NAMES
    met = met.repartition("s", "high") if few else met.repartition("s")
    sets = met.groupBy("s", "high").agg(F.array_distinct(F.flatten(F.collect_list("lows"))).alias("lows"))
    sets = sets.join(F.broadcast(names) if few else names.hint("merge"), "s")
    code = F.shiftleft("high", LOW) + F.col("low").cast("long") + half
    pairs = sets.select("seed", "high", F.explode("lows").alias("low")).select("seed", code.alias("code"))
    return pairs.join(F.broadcast(far) if m <= FEW_NAMES else far, "code").select("seed", F.col("there").alias("id"))


def shortest_paths(
    graph: PropertyGraph,
    seeds: Ids,
    targets: Ids,
    types: Iterable[str] | None = None,
    direction: str = BOTH,
    max_depth: int | None = None,
) -> DataFrame:
    """(seed, id, nodes, rels, length): one path of the fewest hops from each seed to each target.

    Pairs without a path have no row; from a node to itself the path has length 0.  Of several
    shortest paths the one with the least node and relationship ids is taken.  A seed whose
    targets are all reached stops.
    """
    wanted = cut(as_ids(graph, targets).withColumnRenamed("seed", "id"))
    n = wanted.count()
    level = starting(graph, seeds).select(
        "seed", F.col("seed").alias("id"), F.array("seed").alias("nodes"), F.array().cast("array<string>").alias("rels")
    )
    level, hop, done = cut(level), 0, []
    seen = level.select("seed", "id")
    steps = step_arcs(graph, types, direction)
    while not level.isEmpty():
        done.append(level.join(wanted, "id", "left_semi").select("seed", "id", "nodes", "rels", F.size("rels").alias("length")))
        if max_depth is not None and hop >= max_depth:
            break
        hop += 1
        met = reduce(DataFrame.unionAll, done).groupBy("seed").count().where(F.col("count") >= n)
        open_ = level.join(met, "seed", "left_anti")
        found = open_.join(steps, F.col("id") == F.col("here")).select(
            "seed", F.col("there").alias("id"), F.concat("nodes", F.array("there")).alias("nodes"), F.concat("rels", F.array("rel_id")).alias("rels")
        )
        first = found.join(seen, ["seed", "id"], "left_anti").groupBy("seed", "id").agg(F.min(F.struct("nodes", "rels")).alias("path"))
        level = cut(first.select("seed", "id", "path.*"))
        seen = seen.unionAll(level.select("seed", "id"))
    return reduce(DataFrame.unionAll, done) if done else graph.spark.createDataFrame([], PATH)


def shortest_path(graph: PropertyGraph, start: str, end: str, *, cost: str | None = None, **options) -> DataFrame:
    """The path between two nodes, by hops or by a cost property; no row if there is none."""
    if cost:
        return cheapest_paths(graph, start, end, cost, **options)
    return shortest_paths(graph, start, end, **options)


def _costed(graph: PropertyGraph, cost: str, types: Iterable[str] | None, direction: str) -> DataFrame:
    """Arcs with their cost: 1 where the property is missing or null; what is no number is no arc."""
    tables = [graph.rels[t] for t in (types or graph.types) if t in graph.rels]
    found = []
    for t in tables:
        here = t.frame.select("rel_id", F.lit(t.type).alias("type"), "src", "dst")
        if cost in t.props:
            value = F.col(quoted(cost))
            number = F.when(value.isNull(), 1.0).otherwise(value.try_cast("double"))
            here = t.frame.select("rel_id", F.lit(t.type).alias("type"), "src", "dst", number.alias("cost"))
        else:
            here = here.withColumn("cost", F.lit(1.0))
        steps = arcs(here, direction).join(here.select("rel_id", "cost"), "rel_id") if direction == BOTH else None
        if steps is None:
            a, b = ("src", "dst") if direction == "outgoing" else ("dst", "src")
            steps = here.select(F.col(a).alias("here"), F.col(b).alias("there"), "rel_id", "type", "cost")
        found.append(steps.select("here", "there", "rel_id", "cost"))
    if not found:
        return graph.spark.createDataFrame([], "here string, there string, rel_id string, cost double")
    out = union(found).where("cost IS NOT NULL AND NOT isnan(cost)")
    return out if graph.whole else existing(graph, out, "there")


def cheapest_distances(
    graph: PropertyGraph,
    seeds: Ids,
    cost: str,
    types: Iterable[str] | None = None,
    direction: str = BOTH,
    max_depth: float | None = None,
    max_hops: int | None = None,
    targets: Ids | None = None,
) -> DataFrame:
    """(seed, id, cost, via_node, via_rel): the least cost to every node, and the arc that ends it.

    ``max_depth`` bounds the cost at which a node is still expanded: what one arc beyond it
    reaches has a row.  ``max_hops`` bounds the number of arcs.  Costs below 0 are an error.
    """
    steps = cut(_costed(graph, cost, types, direction))
    if not steps.where("cost < 0").isEmpty():
        raise ValueError(f"{cost!r} is below 0 for some relationship")
    wanted = None if targets is None else cut(as_ids(graph, targets).withColumnRenamed("seed", "target"))
    known = starting(graph, seeds).select(
        "seed", F.col("seed").alias("id"), F.lit(0.0).alias("cost"), F.lit(None).cast("string").alias("via_node"), F.lit(None).cast("string").alias("via_rel")
    )
    known = cut(known)
    changed, hop = known, 0
    while not changed.isEmpty() and (max_hops is None or hop < max_hops):
        hop += 1
        open_ = changed if max_depth is None else changed.where(F.col("cost") < max_depth)
        if wanted is not None:  # what costs more than all of a seed's targets can't be on a cheapest path
            far = known.join(wanted, F.col("id") == F.col("target")).groupBy("seed").agg(F.max("cost").alias("far"), F.count(F.lit(1)).alias("n"))
            far = far.where(F.col("n") >= wanted.count()).select("seed", "far")
            open_ = open_.join(far, "seed", "left").where("far IS NULL OR cost < far").drop("far")
        found = open_.select("seed", F.col("id").alias("from_id"), F.col("cost").alias("so_far")).join(steps, F.col("from_id") == F.col("here"))
        best = F.min(F.struct((F.col("so_far") + F.col("cost")).alias("cost"), F.col("from_id").alias("via_node"), F.col("rel_id").alias("via_rel")))
        found = found.groupBy("seed", F.col("there").alias("id")).agg(best.alias("new")).select("seed", "id", "new")
        old = known.select("seed", "id", F.struct("cost", "via_node", "via_rel").alias("old"))
        both = renew(cut(old.join(found, ["seed", "id"], "full_outer")))
        better = F.col("old").isNull() | (F.col("new.cost") < F.col("old.cost"))
        better = F.coalesce(better & F.col("new").isNotNull(), F.lit(False))
        known = both.select("seed", "id", F.when(better, F.col("new")).otherwise(F.col("old")).alias("now")).select("seed", "id", "now.*")
        changed = both.where(better).select("seed", "id", "new.*")
    return known


def cheapest_paths(
    graph: PropertyGraph,
    seeds: Ids,
    targets: Ids,
    cost: str,
    types: Iterable[str] | None = None,
    direction: str = BOTH,
    max_depth: float | None = None,
) -> DataFrame:
    """(seed, id, nodes, rels, length, cost): the cheapest path from each seed to each target."""
    known = cut(cheapest_distances(graph, seeds, cost, types, direction, max_depth, targets=targets))
    wanted = as_ids(graph, targets).withColumnRenamed("seed", "target")
    empty = F.array().cast("array<string>")
    back = known.join(wanted, F.col("id") == F.col("target")).select(
        "seed", F.col("id").alias("end"), F.col("cost").alias("total"), F.array("id").alias("nodes"), empty.alias("rels"), F.col("via_node").alias("at"), "via_rel"
    )
    back, done = cut(back), []
    while not back.isEmpty():
        done.append(back.where("at IS NULL").select("seed", F.col("end").alias("id"), "nodes", "rels", F.size("rels").alias("length"), F.col("total").alias("cost")))
        on = known.select("seed", F.col("id").alias("at"), F.col("via_node").alias("next_at"), F.col("via_rel").alias("next_rel"))
        back = cut(
            back.where("at IS NOT NULL").join(on, ["seed", "at"]).select(
                "seed", "end", "total", F.concat(F.array("at"), "nodes").alias("nodes"), F.concat(F.array("via_rel"), "rels").alias("rels"),
                F.col("next_at").alias("at"), F.col("next_rel").alias("via_rel"),
            )
        )
    return reduce(DataFrame.unionAll, done) if done else graph.spark.createDataFrame([], PATH + ", cost double")


def neighborhood(
    graph: PropertyGraph,
    seeds: Ids,
    depth: int,
    types: Iterable[str] | None = None,
    direction: str = BOTH,
    node_filter: Filter = None,
    rel_filter: Filter = None,
) -> tuple[DataFrame, DataFrame]:
    """Nodes (seed, id, hop) and relationships (seed, rel_id) within ``depth`` hops.

    Both filters must hold before a relationship or the node behind it counts; the seed itself
    is exempt.  Relationships among the nodes of the last level aren't part of it.
    """
    types = tuple(types) if types else None
    steps = arcs(matching_rels(graph, types, rel_filter), direction)
    steps = steps if graph.whole else existing(graph, steps, "there")
    if node_filter is not None:
        steps = steps.join(matching_ids(graph, node_filter), F.col("there") == F.col("id"), "left_semi")
    level = cut(starting(graph, seeds).select("seed", F.col("seed").alias("id"), F.lit(0).alias("hop")))
    seen, rels = level, [graph.spark.createDataFrame([], "seed string, rel_id string")]
    for hop in range(1, depth + 1):
        met = cut(level.join(steps, F.col("id") == F.col("here")).select("seed", F.col("there").alias("id"), "rel_id"))
        rels.append(met.select("seed", "rel_id"))
        new = met.select("seed", "id").distinct().join(seen, ["seed", "id"], "left_anti")
        level = cut(new.withColumn("hop", F.lit(hop)))
        if level.isEmpty():
            break
        seen = seen.unionAll(level)
    return seen, reduce(DataFrame.unionAll, rels).distinct()


def _least(edges: DataFrame) -> DataFrame:
    """(k, m): each node's least lesser neighbour, written out so that a skewed join with it can be split."""
    return cut(edges.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), "m"))


def connected_components(graph: PropertyGraph, types: Iterable[str] | None = None) -> DataFrame:
    """(id, component): the least id that each node reaches over relationships of any direction.

    Alternating stars: each round ties greater neighbours to the least of a neighbourhood, then
    lesser ones, until nothing changes; the number of rounds grows with the logarithm.
    """
    edges = graph.edges(types).where("src <> dst")
    edges = cut(edges.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct())
    state = None
    while True:
        now = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if now["n"] == 0 or now == state:
            break
        state = now
        least = _least(edges)
        large = cut(edges.join(least, F.col("v") == F.col("k"), "left").select("u", F.coalesce("m", "v").alias("v")).distinct())
        least = _least(large)
        # from one array: a union would carry what is known of each side's rows into the next round's plan
        both = F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))
        small = large.join(least, F.col("u") == F.col("k")).select(F.explode(both).alias("e")).select("e.u", "e.v")
        edges = renew(cut(small.where("u > v").distinct()))
    heads = edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
    nodes = graph.vertices().select("id").distinct()
    return nodes.join(heads, "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def page_rank(graph: PropertyGraph, rounds: int = 10, damping: float = 0.85, types: Iterable[str] | None = None) -> DataFrame:
    """(id, rank) after so many rounds; ranks sum to the number of nodes."""
    nodes = cut(graph.vertices().select("id").distinct())
    n = nodes.count()
    steps = step_arcs(graph, types, "outgoing").select("here", "there")
    steps = cut(steps.join(steps.groupBy("here").agg(F.count(F.lit(1)).alias("out")), "here"))
    ranks = nodes.withColumn("rank", F.lit(1.0))
    for _ in range(rounds):
        sent = ranks.join(steps, F.col("id") == F.col("here")).groupBy(F.col("there").alias("id")).agg(F.sum(F.col("rank") / F.col("out")).alias("got"))
        ranks = renew(cut(nodes.join(sent, "id", "left").select("id", F.coalesce("got", F.lit(0.0)).alias("got"))))
        lost = 1 - (ranks.agg(F.sum("got")).first()[0] or 0.0) / max(1, n)  # rank of nodes without a way out
        ranks = ranks.select("id", (F.lit(1 - damping) + F.lit(damping) * (F.col("got") + F.lit(lost))).alias("rank"))
    return ranks


#: Algorithms by name; each takes a graph and options and gives a frame.
ALGORITHMS: dict[str, Callable[..., DataFrame]] = {
    "hop_distances": hop_distances,
    "shortest_paths": shortest_paths,
    "cheapest_distances": cheapest_distances,
    "cheapest_paths": cheapest_paths,
    "connected_components": connected_components,
    "page_rank": page_rank,
}


def register(name: str, run: Callable[..., DataFrame]) -> None:
    """Add an algorithm of one's own; a name can't be taken twice."""
    if ALGORITHMS.setdefault(name, run) is not run:
        raise GraphError(f"there is an algorithm {name!r}")


def run_algorithm(graph: PropertyGraph, name: str, **options) -> DataFrame:
    if name not in ALGORITHMS:
        raise GraphError(f"no algorithm {name!r}; there are {', '.join(sorted(ALGORITHMS))}")
    return ALGORITHMS[name](graph, **options)
