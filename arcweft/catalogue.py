"""The graph queries by name, over the driver's tables, and SQL that must give the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.predicates import UnknownOperator, equalities
from .operators import algorithms as alg
from .operators import mutate as mut
from .operators.expand import degrees, edge_types, neighbors, relationships_of
from .operators.scan import (
    all_nodes,
    find_nodes,
    find_relationships,
    get_node,
    get_relationship,
    has_label,
    hydrate,
    label_counts,
    matching_ids,
    stats,
    type_counts,
)
from .operators.traversal import traverse
from .plans import strict
from .plans.cypher.compile import rows as cypher
from .plans.cypher.parser import QueryRefused
from .plans.portable import Store, ordered, plain
from .session import cut, remove, shared_dir
from .sources.model import GraphError, PropertyGraph
from .sources.star import star_graph
from .sources.storage import keys, load, save

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None) -> Callable[[Callable[[PropertyGraph], DataFrame]], Callable]:
    """Register a function from the star graph to a frame, and its SQL."""

    def register(make: Callable[[PropertyGraph], DataFrame]) -> Callable:
        QUERIES[make.__name__] = lambda spark, sf_dir: make(star_graph(spark, sf_dir))
        if sql is not None:
            SQL[make.__name__] = sql
        return make

    return register


# -- scans and lookups ----------------------------------------------------------------------


@query("SELECT 'customer:' || c_custkey AS id, c_name AS name FROM customer")
def find_nodes_label(g):
    return find_nodes(g, "Customer").select("id", "name")


@query("SELECT 'customer:' || c_custkey AS id, c_name AS name, c_acctbal AS acctbal FROM customer UNION ALL SELECT 'supplier:' || s_suppkey, s_name, s_acctbal FROM supplier")
def find_nodes_multilabel(g):
    return find_nodes(g, "Party").select("id", "name", "acctbal")


@query(
    "SELECT (SELECT count(*) FROM region) + (SELECT count(*) FROM nation) + (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier)"
    " + (SELECT count(*) FROM part) + (SELECT count(*) FROM orders) + (SELECT count(*) FROM events) + (SELECT count(*) FROM documents) AS n"
)
def all_nodes_dedup(g):
    return all_nodes(g).agg(F.count(F.lit(1)).alias("n"))


@query(
    "SELECT 'Region' AS label, count(*) AS n FROM region UNION ALL SELECT 'Nation', count(*) FROM nation UNION ALL SELECT 'Customer', count(*) FROM customer"
    " UNION ALL SELECT 'Supplier', count(*) FROM supplier UNION ALL SELECT 'Party', (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier)"
    " UNION ALL SELECT 'Part', count(*) FROM part UNION ALL SELECT 'Order', count(*) FROM orders UNION ALL SELECT 'Event', count(*) FROM events"
    " UNION ALL SELECT 'Document', count(*) FROM documents"
)
def ext_label_counts(g):
    return label_counts(g)


@query("SELECT 'order:' || l_orderkey AS src, 'part:' || l_partkey AS dst, l_quantity AS quantity, l_returnflag AS returnflag FROM lineitem WHERE l_quantity >= 45")
def find_rels_filtered(g):
    return find_relationships(g, "CONTAINS", {"quantity": {"gte": 45}}).select("src", "dst", "quantity", "returnflag")


REL_COUNTS = (
    "SELECT 'IN_REGION' AS type, count(*) AS n FROM nation UNION ALL SELECT 'LOCATED_IN', (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier)"
    " UNION ALL SELECT 'PLACED', count(*) FROM orders UNION ALL SELECT 'CONTAINS', count(*) FROM lineitem"
    " UNION ALL SELECT 'SUPPLIED_BY', count(*) FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem) UNION ALL SELECT 'DID', count(*) FROM events"
    " UNION ALL SELECT 'NEXT', count(*) FROM (SELECT lead(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS x FROM events) WHERE x IS NOT NULL"
    " UNION ALL SELECT 'SKIP', count(*) FROM (SELECT lead(event_id, 3) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS x FROM events) WHERE x IS NOT NULL"
)


@query(REL_COUNTS)
def ext_type_counts(g):
    return type_counts(g)


@query(f"SELECT ({SQL['all_nodes_dedup']}) AS node_count, (SELECT sum(n)::BIGINT FROM ({REL_COUNTS})) AS relationship_count, 0::BIGINT AS index_count")
def graph_stats(g):
    return stats(g)


@query("SELECT 'order:' || o_orderkey AS id, o_orderstatus AS status, o_totalprice AS totalprice FROM orders WHERE o_orderkey = 7")
def point_lookup(g):
    return get_node(g, "order:7").select("id", "status", "totalprice")


@query("SELECT 'placed:' || o_orderkey AS rel_id, 'customer:' || o_custkey AS src, 'order:' || o_orderkey AS dst FROM orders WHERE o_orderkey = 7")
def point_lookup_rel(g):
    return get_relationship(g, "placed:7").select("rel_id", "src", "dst")


@query("SELECT count(*) > 0 AS has_label FROM customer WHERE c_custkey = 3")
def has_label_party(g):
    return has_label(g, "customer:3", "Party")


@query("SELECT 'l:Region:region:' || r_regionkey AS key FROM region")
def key_prefix_scan(g):
    return keys(g, "l:Region:")


@query(
    "SELECT 'duplicate node id' AS problem, count(*) AS n FROM nation UNION ALL SELECT 'missing src', count(*) FROM supplier UNION ALL SELECT 'missing dst', count(*) FROM orders"
)
def validate(g):
    """Of a graph with faults: nations twice, neither suppliers nor orders; and of the whole graph, which has none."""
    broken = PropertyGraph(
        g.spark, {"nation": g.nodes["nation"], "again": g.nodes["nation"], "customer": g.nodes["customer"]},
        {t: g.rels[t] for t in ("LOCATED_IN", "PLACED")}, whole=False,
    )
    return broken.validate().unionByName(g.validate())


@query("SELECT 'l:Nation:nation:' || n_nationkey AS key FROM nation ORDER BY key DESC LIMIT 7")
def key_scan_backwards(g):
    return keys(g, "l:Nation:", limit=7, reverse=True)


def _reloaded(g: PropertyGraph, look: Callable[[PropertyGraph], DataFrame]) -> DataFrame:
    """What ``look`` sees of the parties and their nations after a save and a load."""
    part = PropertyGraph(g.spark, {k: g.nodes[k] for k in ("nation", "customer", "supplier")}, {"LOCATED_IN": g.rels["LOCATED_IN"]})
    path = f"{shared_dir(g.spark)}/graph-{uuid.uuid4().hex}"
    try:
        save(mut.create_index(part, "Customer", "mktsegment"), path)
        return cut(look(load(g.spark, path)))
    finally:
        remove(g.spark, path)


@query("SELECT 'customer:' || c_custkey AS id, c_name AS name, c_acctbal AS acctbal FROM customer UNION ALL SELECT 'supplier:' || s_suppkey, s_name, s_acctbal FROM supplier")
def saved_nodes(g):
    return _reloaded(g, lambda h: find_nodes(h, "Party").select("id", "name", "acctbal"))


_LOCATED = (
    "SELECT 'cloc:' || c_custkey AS rel_id, 'customer:' || c_custkey AS src, 'nation:' || c_nationkey AS dst FROM customer"
    " UNION ALL SELECT 'sloc:' || s_suppkey, 'supplier:' || s_suppkey, 'nation:' || s_nationkey FROM supplier"
)


@query(_LOCATED)
def saved_rels(g):
    return _reloaded(g, lambda h: find_relationships(h, "LOCATED_IN").select("rel_id", "src", "dst"))


@query(
    "SELECT (SELECT count(*) FROM nation) + (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier) AS node_count,"
    " (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier) AS relationship_count, 1::BIGINT AS index_count"
)
def reopened_counts(g):
    return _reloaded(g, stats)


@query("SELECT 'old' AS version, 'region:' || r_regionkey AS id FROM region UNION ALL SELECT 'new', 'region:' || r_regionkey FROM region WHERE r_regionkey <> 0")
def saved_versions(g):
    small = PropertyGraph(g.spark, {"region": g.nodes["region"]})
    path = f"{shared_dir(g.spark)}/graph-{uuid.uuid4().hex}"
    try:
        old = save(small, path)
        save(mut.delete_node(small, "region:0"), path)
        both = [find_nodes(load(g.spark, path, v), "Region").select(F.lit(n).alias("version"), "id") for n, v in (("old", old), ("new", None))]
        return cut(both[0].unionAll(both[1]))
    finally:
        remove(g.spark, path)


@query("SELECT 1::BIGINT AS after_drop, count(*) AS found FROM supplier WHERE s_name = (SELECT s_name FROM supplier WHERE s_suppkey = 1)")
def index_create_drop(g):
    indexed = mut.create_index(mut.create_index(mut.create_index(g, "Supplier", "name"), "Supplier", "name"), "Part", "size")
    name = get_node(g, "supplier:1").first().name
    found = find_nodes(indexed, "Supplier", {"name": name}).agg(F.count(F.lit(1)).alias("found"))
    return found.withColumn("after_drop", F.lit(len(mut.drop_index(indexed, "Part", "size").indexes)).cast("long"))


# -- predicates -----------------------------------------------------------------------------


def _filter(name: str, label: str, where: dict, sql: str, key: str = "order") -> None:
    def run(g):
        return find_nodes(g, label, where).select("id")

    run.__name__ = f"filter_{name}"
    query(sql)(run)


_order = "SELECT 'order:' || o_orderkey AS id FROM orders WHERE "
_part = "SELECT 'part:' || p_partkey AS id FROM part WHERE "
_docs = (
    "SELECT 'doc:' || d.doc_id AS id FROM documents d LEFT JOIN (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id) l"
    " ON l.doc_id = d.doc_id WHERE "
)
_filter("eq", "Order", {"status": "F"}, _order + "o_orderstatus = 'F'")
_filter("eq_other_type", "Order", {"status": 1}, _order + "false")
_filter("eq_null", "Document", {"quality": None}, _docs + "quality IS NULL")
_filter("neq", "Document", {"quality": {"neq": 1}}, _docs + "quality IS DISTINCT FROM 1")
_filter("gt", "Order", {"totalprice": {"gt": 300000}}, _order + "o_totalprice > 300000")
_filter("gte", "Part", {"size": {"gte": 40}}, _part + "p_size >= 40")
_filter("lt", "Part", {"size": {"lt": 5}}, _part + "p_size < 5")
_filter("lte", "Part", {"retailprice": {"lte": 1000}}, _part + "p_retailprice <= 1000")
_filter("in", "Order", {"status": {"in": ["F", "P"]}}, _order + "o_orderstatus IN ('F', 'P')")
_filter("in_empty", "Order", {"status": {"in": []}}, _order + "false")
_filter("contains", "Part", {"name": {"contains": "1"}}, _part + "contains(p_name, '1')")
_filter("starts", "Order", {"priority": {"startsWith": "1"}}, _order + "starts_with(o_orderpriority, '1')")
_filter("ends", "Part", {"brand": {"endsWith": "3"}}, _part + "ends_with(p_brand, '3')")
_filter("number_as_text", "Part", {"size": {"contains": "4"}}, _part + "contains(p_size::VARCHAR, '4')")
_filter("exists", "Document", {"quality": {"exists": True}}, _docs + "quality IS NOT NULL")
_filter("not_exists", "Document", {"toxic": {"exists": False}}, _docs + "toxic IS NULL")
_filter("multi", "Part", {"size": {"gte": 10, "lt": 20}, "brand": {"contains": "1"}}, _part + "p_size >= 10 AND p_size < 20 AND contains(p_brand, '1')")
_filter("missing_property", "Part", {"colour": {"neq": "red"}}, _part + "true")


@query("SELECT 'event:' || event_id AS id FROM events WHERE CAST(json_extract(props, '$.k') AS INT) > 50")
def filter_dynamic(g):
    k = F.try_variant_get(F.col("props"), "$.k", "int")
    return find_nodes(g, "Event", k > 50).select("id")


# -- expansion ------------------------------------------------------------------------------


@query("SELECT 'order:' || l_orderkey AS seed, 'part:' || l_partkey AS id FROM lineitem")
def neighbors_out(g):
    return neighbors(g, find_nodes(g, "Order"), ["CONTAINS"], "outgoing").select("seed", "id")


@query("SELECT 'part:' || l_partkey AS seed, 'order:' || l_orderkey AS id FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size = 10)")
def neighbors_in(g):
    return neighbors(g, find_nodes(g, "Part", {"size": 10}), ["CONTAINS"], "incoming").select("seed", "id")


@query(
    "SELECT 'order:' || o_orderkey AS seed, 'customer:' || o_custkey AS id FROM orders WHERE o_orderstatus = 'F'"
    " UNION ALL SELECT 'order:' || l_orderkey, 'part:' || l_partkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F'"
)
def neighbors_both(g):
    return neighbors(g, find_nodes(g, "Order", {"status": "F"}), ["PLACED", "CONTAINS"]).select("seed", "id")


@query(
    "SELECT 'customer:' || o_custkey AS seed, 'PLACED' AS type, 'order:' || o_orderkey AS id FROM orders"
    " UNION ALL SELECT 'customer:' || user_id, 'DID', 'event:' || event_id FROM events"
)
def neighbors_multitype(g):
    return neighbors(g, find_nodes(g, "Customer"), ["PLACED", "DID"], "outgoing").select("seed", "type", "id")


@query("SELECT 'order:' || o_orderkey AS seed, 'placed:' || o_orderkey AS rel_id, 'customer:' || o_custkey AS src, 'order:' || o_orderkey AS dst FROM orders WHERE o_totalprice > 400000")
def relationships_of_nodes(g):
    return relationships_of(g, find_nodes(g, "Order", {"totalprice": {"gt": 400000}}), ["PLACED"], "both").drop("type")


@query(
    "SELECT DISTINCT 'customer:' || c_custkey AS seed, 'LOCATED_IN' AS type FROM customer UNION SELECT 'customer:' || o_custkey, 'PLACED' FROM orders"
    " UNION SELECT 'customer:' || user_id, 'DID' FROM events"
)
def adjacent_types(g):
    return edge_types(g, find_nodes(g, "Customer"), "outgoing")


@query("SELECT 'part:' || l_partkey AS id, count(*) AS degree FROM lineitem GROUP BY 1")
def ext_degrees(g):
    return degrees(g, ["CONTAINS"], "incoming")


# -- traversal ------------------------------------------------------------------------------


@query(
    "SELECT 'customer:' || o_custkey AS seed, 'order:' || o_orderkey AS id, 1 AS hop, count(*) AS walks FROM orders GROUP BY ALL"
    " UNION ALL SELECT 'customer:' || o_custkey, 'part:' || l_partkey, 2, count(*) FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL"
)
def traverse_2hop_multiset(g):
    return traverse(g, find_nodes(g, "Customer")).outgoing("PLACED").outgoing("CONTAINS").counts()


_BOTH = (
    "b AS (SELECT 'order:' || l_orderkey AS f, 'part:' || l_partkey AS t FROM lineitem UNION SELECT 'part:' || l_partkey, 'order:' || l_orderkey FROM lineitem"
    " UNION SELECT 'customer:' || o_custkey, 'order:' || o_orderkey FROM orders UNION SELECT 'order:' || o_orderkey, 'customer:' || o_custkey FROM orders)"
)


@query(
    f"WITH RECURSIVE {_BOTH}, r(id, hop) AS (SELECT 'order:1' , 0 UNION SELECT b.t, r.hop + 1 FROM r JOIN b ON b.f = r.id WHERE r.hop < 3)"
    " SELECT id, min(hop)::INT AS hop FROM r GROUP BY id HAVING min(hop) > 0"
)
def traverse_unique(g):
    return traverse(g, "order:1").both("PLACED", "CONTAINS").depth(3).unique().collect().select("id", "hop")


@query(
    "WITH e AS (SELECT DISTINCT 'order:' || l_orderkey AS o, 'part:' || l_partkey AS p FROM lineitem), l0 AS (SELECT 'order:1' AS id),"
    " l1 AS (SELECT p AS id FROM e JOIN l0 ON o = l0.id EXCEPT SELECT id FROM l0),"
    " l2 AS (SELECT o AS id FROM e JOIN l1 ON p = l1.id EXCEPT (SELECT id FROM l0 UNION SELECT id FROM l1)),"
    " l3 AS (SELECT p AS id FROM e JOIN l2 ON o = l2.id EXCEPT (SELECT id FROM l0 UNION SELECT id FROM l1 UNION SELECT id FROM l2))"
    " SELECT id, 1 AS hop FROM l1 UNION ALL SELECT id, 2 FROM l2 UNION ALL SELECT id, 3 FROM l3"
)
def traverse_cyclic_steps(g):
    return traverse(g, "order:1").outgoing("CONTAINS").incoming("CONTAINS").depth(3).unique().collect().select("id", "hop")


@query(
    "SELECT 'customer:' || o_custkey AS seed, 'order:' || o_orderkey AS id, 1 AS hop FROM orders WHERE o_totalprice > 300000"
    " UNION ALL SELECT 'customer:' || o_custkey, 'part:' || l_partkey, 2 FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey"
    " WHERE o_totalprice > 300000 AND p_size < 10"
)
def traverse_step_filter(g):
    t = traverse(g, find_nodes(g, "Customer")).outgoing("PLACED").where({"totalprice": {"gt": 300000}})
    return t.outgoing("CONTAINS").where({"size": {"lt": 10}}).collect()


_NEXT = "n AS (SELECT 'event:' || event_id AS f, 'event:' || lead(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS t, user_id FROM events)"


@query(
    f"WITH RECURSIVE {_NEXT}, r(id, path, len) AS (SELECT f, f, 0 FROM n UNION ALL SELECT n.t, r.path || '>' || n.t, r.len + 1"
    " FROM r JOIN n ON n.f = r.id WHERE n.t IS NOT NULL AND r.len < 4) SELECT path, len::INT AS length FROM r WHERE len > 0"
)
def traverse_paths_all(g):
    found = traverse(g, find_nodes(g, "Event")).outgoing("NEXT").depth(4).paths()
    return found.select(F.concat_ws(">", "nodes").alias("path"), "length")


_SUB = (
    "WITH l1 AS (SELECT DISTINCT l_partkey AS p FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_orderkey = 1 AND p_size < 45),"
    " l2 AS (SELECT DISTINCT l_orderkey AS o FROM lineitem JOIN l1 ON l_partkey = p WHERE l_orderkey <> 1) "
)


@query(_SUB + "SELECT 'order:1' AS id UNION ALL SELECT 'part:' || p FROM l1 UNION ALL SELECT 'order:' || o FROM l2")
def traverse_subgraph_nodes(g):
    t = traverse(g, "order:1").outgoing("CONTAINS").where({"size": {"lt": 45}}).incoming("CONTAINS")
    return t.subgraph()[0].select("id")


@query(_SUB + "SELECT count(*) AS n FROM (SELECT l_orderkey FROM lineitem WHERE l_orderkey = 1 UNION ALL SELECT l_orderkey FROM lineitem JOIN l1 ON l_partkey = p WHERE l_orderkey <> 1)")
def traverse_subgraph_rels(g):
    """Relationships before the filter: all lines of the order, and those of the parts that pass."""
    t = traverse(g, "order:1").outgoing("CONTAINS").where({"size": {"lt": 45}}).incoming("CONTAINS")
    return t.subgraph()[1].agg(F.count(F.lit(1)).alias("n"))


@query("SELECT least(5, count(*)) AS n FROM lineitem WHERE l_orderkey = 1")
def traverse_limit(g):
    return traverse(g, "order:1").outgoing("CONTAINS").limit(5).collect().agg(F.count(F.lit(1)).alias("n"))


@query("SELECT 'customer:1' AS seed, 'order:' || o_orderkey AS id FROM orders WHERE o_custkey = 1")
def traverse_missing_start(g):
    """A start that isn't there gives nothing, nor does a traversal without steps."""
    found = traverse(g, ["customer:1", "customer:none"]).outgoing("PLACED").collect()
    return found.unionAll(traverse(g, "customer:1").collect()).select("seed", "id")


@query("SELECT 'order:' || o_orderkey AS id, o_totalprice AS totalprice FROM orders WHERE o_custkey = 1")
def traverse_hydrated(g):
    return traverse(g, "customer:1").outgoing("PLACED").nodes().select("id", "totalprice")


# -- algorithms -----------------------------------------------------------------------------

_EGO = (
    "WITH p AS (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_suppkey = 1), o AS (SELECT DISTINCT l_orderkey AS k FROM lineitem JOIN p ON l_partkey = p.k) "
)


@query(_EGO + "SELECT 'supplier:1' AS id, 0 AS hop UNION ALL SELECT 'part:' || k, 1 FROM p UNION ALL SELECT 'order:' || k, 2 FROM o")
def neighborhood_d2(g):
    """Suppliers are reached from parts, and parts from orders: incoming arcs of both types."""
    nodes, _ = alg.neighborhood(g, "supplier:1", 2, ["SUPPLIED_BY", "CONTAINS"], "incoming")
    return nodes.select("id", "hop")


@query(
    "SELECT 'order:1' AS id UNION SELECT 'part:' || l_partkey FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_orderkey = 1 AND l_quantity > 10 AND p_size > 10"
)
def neighborhood_filtered(g):
    nodes, _ = alg.neighborhood(g, "order:1", 1, ["CONTAINS"], "outgoing", {"size": {"gt": 10}}, {"quantity": {"gt": 10}})
    return nodes.select("id")


@query("SELECT count(*) AS n FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_orderkey = 1 AND l_quantity > 10 AND p_size > 10")
def neighborhood_filtered_rels(g):
    _, rels = alg.neighborhood(g, "order:1", 1, ["CONTAINS"], "outgoing", {"size": {"gt": 10}}, {"quantity": {"gt": 10}})
    return rels.agg(F.count(F.lit(1)).alias("n"))


@query(
    "SELECT DISTINCT 'customer:' || o_custkey AS seed, 'supplier:' || b.l_suppkey AS id, 3 AS hops FROM orders JOIN lineitem a ON a.l_orderkey = o_orderkey"
    " JOIN lineitem b ON b.l_partkey = a.l_partkey"
)
def bfs_path_length_all(g):
    return alg.hop_distances(g, find_nodes(g, "Customer"), ["PLACED", "CONTAINS", "SUPPLIED_BY"], "outgoing", 4, label="Supplier")


_COST = (
    "e AS (SELECT 'event:' || event_id AS f, 'event:' || lead(event_id, k) OVER w AS t,"
    " (CASE k WHEN 1 THEN epoch_us(lead(ts, k) OVER w) - epoch_us(ts) ELSE (epoch_us(lead(ts, k) OVER w) - epoch_us(ts)) // 2 END) AS c"
    " FROM events CROSS JOIN (VALUES (1), (3)) AS v(k) WINDOW w AS (PARTITION BY user_id, k ORDER BY ts, event_id))"
)


@query(
    f"WITH RECURSIVE {_COST}, s AS (SELECT 'event:' || event_id AS id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, 'event:' || event_id) = 1),"
    " r(seed, id, cost, hop) AS (SELECT id, id, 0::BIGINT, 0 FROM s UNION SELECT r.seed, e.t, r.cost + e.c, r.hop + 1 FROM r JOIN e ON e.f = r.id WHERE e.t IS NOT NULL AND r.hop < 8)"
    " SELECT seed, id, min(cost)::DOUBLE AS cost FROM r GROUP BY ALL"
)
def weighted_path_cost_all(g):
    """From the first event of every user, within eight hops."""
    events = neighbors(g, find_nodes(g, "Customer"), ["DID"], "outgoing").select("seed", "id").join(find_nodes(g, "Event").select("id", "ts"), "id")
    first = events.groupBy("seed").agg(F.min(F.struct("ts", "id")).alias("first")).select("first.id")
    return alg.cheapest_distances(g, first, "gap", ["NEXT", "SKIP"], "outgoing", max_hops=8).select("seed", "id", "cost")


@query(
    "SELECT DISTINCT 'supplier:' || b.l_suppkey AS id, 3 AS length FROM orders JOIN lineitem a ON a.l_orderkey = o_orderkey JOIN lineitem b ON b.l_partkey = a.l_partkey WHERE o_custkey = 1"
)
def bfs_max_depth(g):
    """Suppliers lie three hops from a customer: within two there is no path, within three there are."""
    ways = [alg.shortest_paths(g, "customer:1", find_nodes(g, "Supplier"), ["PLACED", "CONTAINS", "SUPPLIED_BY"], "outgoing", d) for d in (2, 3)]
    return ways[0].unionAll(ways[1]).select("id", "length")


@query(
    "SELECT 'customer:' || o_custkey || '>order:' || o_orderkey || '>part:' || l_partkey AS path, 2 AS length, 1 + l_quantity AS cost FROM"
    " (SELECT o_custkey, o_orderkey, l_partkey, l_quantity, row_number() OVER (PARTITION BY o_custkey, l_partkey ORDER BY l_quantity, 'order:' || o_orderkey) AS k"
    " FROM orders JOIN lineitem ON l_orderkey = o_orderkey) WHERE k = 1"
)
def weighted_paths(g):
    """The cheapest way from every customer to every part it ordered, by quantity; an order itself costs 1."""
    found = alg.cheapest_paths(g, find_nodes(g, "Customer"), find_nodes(g, "Part"), "quantity", ["PLACED", "CONTAINS"], "outgoing")
    return found.select(F.concat_ws(">", "nodes").alias("path"), "length", "cost")


_RANKED = (
    "e AS (SELECT 'customer:' || o_custkey AS src, 'order:' || o_orderkey AS dst FROM orders UNION ALL SELECT 'order:' || l_orderkey, 'part:' || l_partkey FROM lineitem"
    " UNION ALL SELECT DISTINCT 'part:' || l_partkey, 'supplier:' || l_suppkey FROM lineitem),"
    " n AS (SELECT 'region:' || r_regionkey AS id FROM region UNION ALL SELECT 'nation:' || n_nationkey FROM nation UNION ALL SELECT 'customer:' || c_custkey FROM customer"
    " UNION ALL SELECT 'supplier:' || s_suppkey FROM supplier UNION ALL SELECT 'part:' || p_partkey FROM part UNION ALL SELECT 'order:' || o_orderkey FROM orders"
    " UNION ALL SELECT 'event:' || event_id FROM events UNION ALL SELECT 'doc:' || doc_id FROM documents),"
    " d AS (SELECT src, count(*) AS ways FROM e GROUP BY src), r0 AS (SELECT id, 1.0::DOUBLE AS rank FROM n)"
)


def _round(k: int) -> str:
    return (
        f", g{k} AS (SELECT n.id, coalesce(sum(r.rank / d.ways), 0) AS got FROM n LEFT JOIN e ON e.dst = n.id LEFT JOIN d ON d.src = e.src LEFT JOIN r{k - 1} r ON r.id = e.src GROUP BY n.id),"
        f" r{k} AS (SELECT id, 0.15::DOUBLE + 0.85::DOUBLE * (got + 1 - (SELECT sum(got) FROM g{k}) / (SELECT count(*) FROM n)) AS rank FROM g{k})"
    )


@query(f"WITH {_RANKED}{_round(1)}{_round(2)}{_round(3)} SELECT id, round(rank, 6) AS rank FROM r3")
def ext_page_rank(g):
    return alg.run_algorithm(g, "page_rank", rounds=3, types=["PLACED", "CONTAINS", "SUPPLIED_BY"]).select("id", F.round("rank", 6).alias("rank"))


@query("SELECT 'customer:' || o_custkey AS id, count(*) AS degree FROM orders GROUP BY 1")
def registered_algorithm(g):
    alg.register("orders_of", _orders_of)
    return alg.run_algorithm(g, "orders_of", direction="outgoing")


def _orders_of(graph: PropertyGraph, direction: str) -> DataFrame:
    return degrees(graph, ["PLACED"], direction)


@query(
    "SELECT 'customer:' || o_custkey || '>order:' || o_orderkey || '>part:' || l_partkey AS path, 2 AS length FROM"
    " (SELECT o_custkey, o_orderkey, l_partkey, row_number() OVER (PARTITION BY o_custkey, l_partkey ORDER BY 'order:' || o_orderkey) AS k"
    " FROM orders JOIN lineitem ON l_orderkey = o_orderkey) WHERE k = 1"
)
def bfs_paths_all(g):
    found = alg.shortest_paths(g, find_nodes(g, "Customer"), find_nodes(g, "Part"), ["PLACED", "CONTAINS"], "outgoing", 2)
    return found.select(F.concat_ws(">", "nodes").alias("path"), "length")


@query(None)  # its SQL, a recursion over all nodes, is too slow; a test compares it with union-find
def ext_connected_components_all(g):
    return alg.connected_components(g)


# -- Cypher ---------------------------------------------------------------------------------


def _cypher(name: str, text: str, sql: str) -> None:
    def run(g):
        return cypher(g, text)

    run.__name__ = f"cypher_{name}"
    query(sql)(run)


_cypher(
    "minimum_slice",
    "MATCH (c:Customer)-[:PLACED]->(o:Order) WHERE c.mktsegment = 'MACHINERY' AND o.totalprice > 300000 RETURN c.name AS c_name, o.totalprice AS totalprice",
    "SELECT c_name, o_totalprice AS totalprice FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_mktsegment = 'MACHINERY' AND o_totalprice > 300000",
)
_cypher("label", "MATCH (p:Party) RETURN p.name AS name", "SELECT c_name AS name FROM customer UNION ALL SELECT s_name FROM supplier")
_cypher("all_labels", "MATCH (p:Party:Supplier) RETURN p.name AS name", "SELECT s_name AS name FROM supplier")
_cypher("where_range", "MATCH (p:Part) WHERE p.size >= 10 AND p.size < 12 RETURN p.name AS name, p.size AS size", "SELECT p_name AS name, p_size AS size FROM part WHERE p_size >= 10 AND p_size < 12")
_cypher("where_text", "MATCH (p:Part) WHERE p.brand ENDS WITH '3' AND p.name CONTAINS '1' RETURN p.name AS name", "SELECT p_name AS name FROM part WHERE ends_with(p_brand, '3') AND contains(p_name, '1')")
_cypher("inline_props", "MATCH (o:Order {status: 'F'}) RETURN o.totalprice AS totalprice", "SELECT o_totalprice AS totalprice FROM orders WHERE o_orderstatus = 'F'")
_cypher(
    "incoming", "MATCH (p:Part {size: 7})<-[:CONTAINS]-(o:Order) RETURN p.name AS part, o.totalprice AS totalprice",
    "SELECT p_name AS part, o_totalprice AS totalprice FROM part JOIN lineitem ON l_partkey = p_partkey JOIN orders ON o_orderkey = l_orderkey WHERE p_size = 7",
)
_cypher(
    "undirected", "MATCH (n:Nation)-[:LOCATED_IN]-(s:Supplier) RETURN n.name AS nation, s.name AS supplier",
    "SELECT n_name AS nation, s_name AS supplier FROM nation JOIN supplier ON s_nationkey = n_nationkey",
)
_cypher(
    "three_hops",
    "MATCH (r:Region)<-[:IN_REGION]-(n:Nation)<-[:LOCATED_IN]-(c:Customer)-[:PLACED]->(o:Order) WHERE o.totalprice > 350000 RETURN r.name AS region, n.name AS nation, c.name AS customer",
    "SELECT r_name AS region, n_name AS nation, c_name AS customer FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey"
    " JOIN orders ON o_custkey = c_custkey WHERE o_totalprice > 350000",
)
_cypher(
    "rel_property", "MATCH (o:Order)-[l:CONTAINS {returnflag: 'R'}]->(p:Part) WHERE l.quantity > 40 RETURN p.name AS part, l.quantity AS quantity",
    "SELECT p_name AS part, l_quantity AS quantity FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_returnflag = 'R' AND l_quantity > 40",
)
_cypher(
    "same_node_twice", "MATCH (o:Order)-[a:CONTAINS]->(p:Part)<-[b:CONTAINS]-(o) WHERE o.totalprice > 300000 RETURN p.name AS part",
    "SELECT p_name AS part FROM orders JOIN lineitem a ON a.l_orderkey = o_orderkey JOIN lineitem b ON b.l_orderkey = o_orderkey AND b.l_partkey = a.l_partkey"
    " JOIN part ON p_partkey = a.l_partkey WHERE o_totalprice > 300000",
)
_cypher(
    "either_type", "MATCH (c:Customer {mktsegment: 'BUILDING'})-[r:PLACED|DID]->(x) RETURN c.name AS name, count(*) AS n",
    "SELECT c_name AS name, count(*) AS n FROM customer JOIN (SELECT o_custkey AS k FROM orders UNION ALL SELECT user_id FROM events) ON k = c_custkey WHERE c_mktsegment = 'BUILDING' GROUP BY c_name, c_custkey",
)
_cypher(
    "top", "MATCH (o:Order) RETURN o.totalprice AS totalprice, o.priority AS priority ORDER BY totalprice DESC, o.priority LIMIT 10",
    "SELECT o_totalprice AS totalprice, o_orderpriority AS priority FROM orders ORDER BY 1 DESC, 2 LIMIT 10",
)
_cypher("skip", "MATCH (n:Nation) RETURN n.name AS name ORDER BY name SKIP 5 LIMIT 10", "SELECT n_name AS name FROM nation ORDER BY 1 LIMIT 10 OFFSET 5")
_cypher("limit_zero", "MATCH (o:Order) RETURN o.status AS status LIMIT 0", "SELECT o_orderstatus AS status FROM orders LIMIT 0")
_cypher("distinct", "MATCH (c:Customer) RETURN DISTINCT c.mktsegment AS segment", "SELECT DISTINCT c_mktsegment AS segment FROM customer")
_cypher("is_null", "MATCH (d:Document) WHERE d.quality IS NULL RETURN d.lang AS lang, count(*) AS n", "SELECT lang, count(*) AS n FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) GROUP BY lang")
_cypher("any_node", "MATCH (n) RETURN count(*) AS n", SQL["all_nodes_dedup"])


@query("SELECT 'node' AS kind, 'region:' || r_regionkey AS id, r_name AS name FROM region")
def strict_slice(g):
    return strict.execute(g, "MATCH (r:Region) RETURN r AS region").records.select("region.kind", "region.id", "region.name")


#: Queries beyond the strict form, or that it can't read.
BEYOND = (
    "MATCH (a:Region)-[:IN_REGION]-(b:Nation) RETURN a", "MATCH (a:Region) WHERE a.name = 1 RETURN a", "MATCH (a:Region {name: 1}) RETURN a",
    "MATCH (a:Region) RETURN $x", "MATCH (a:Region) RETURN a.name", "MATCH (a) RETURN a", "MATCH (a:Region) RETURN a, a", "MATCH (a:Region) RETURN a LIMIT 1",
    "MATCH (a:Region) RETURN b", "CREATE (a:Region)", "MATCH (a:Region) RETURN count(*)", "",
)


def _error(run: Callable[[], object]) -> str:
    """The kind of error that ``run`` ends with."""
    try:
        run()
    except (GraphError, QueryRefused, UnknownOperator) as error:
        return type(error).__name__
    return "none"


def _table(rows: list[tuple[str, str]], a: str, b: str) -> str:
    text = ", ".join("('" + "', '".join(x.replace("'", "''") for x in r) + "')" for r in rows)
    return f"SELECT * FROM (VALUES {text}) AS t({a}, {b})"


@query(_table([*((q, "QueryRefused") for q in BEYOND), ("MATCH (r:Region) RETURN r", "none")], "text", "error"))
def strict_refusals(g):
    rows = [(q, _error(lambda q=q: strict.execute(g, q))) for q in (*BEYOND, "MATCH (r:Region) RETURN r")]
    return g.spark.createDataFrame(rows, "text string, error string")


@query(_table([("size", "7"), ("name", "x")], "property", "value"))
def equality_extraction(g):
    """The properties that a filter fixes: what an index or an upsert would look up."""
    found = equalities({"size": 7, "name": {"eq": "x"}, "brand": {"neq": "y"}, "retailprice": {"gte": 1}})
    return g.spark.createDataFrame([(k, str(v)) for k, v in found.items()], "property string, value string")


# -- portable queries -----------------------------------------------------------------------


def _space(g: PropertyGraph):
    return Store(g.spark).create_space("star", g)


@query("SELECT 'customer:' || c_custkey AS id, 'Customer' AS label, c_name AS name FROM customer WHERE c_mktsegment = 'BUILDING'")
def portable_match(g):
    return _space(g).query({"kind": "match", "label": "Customer", "where": {"mktsegment": "BUILDING"}, "returnFields": ["name"]})


@query("SELECT 'order:' || o_orderkey AS id, 'Order' AS label, o_totalprice AS totalprice FROM orders ORDER BY o_totalprice DESC, 1 LIMIT 25")
def portable_top_k(g):
    return _space(g).query({"kind": "match", "label": "Order", "returnFields": ["totalprice"], "orderBy": {"field": "totalprice", "direction": "DESC"}, "limit": 25})


@query("SELECT 'document' AS kind, 'doc:' || d.doc_id AS id FROM documents d LEFT JOIN (SELECT doc_id, max(quality) AS q FROM labels GROUP BY 1) l ON l.doc_id = d.doc_id ORDER BY q NULLS LAST, 2 LIMIT 40")
def order_nulls_last(g):
    return ordered(find_nodes(g, "Document"), {"field": "quality"}, 40).select(F.lit("document").alias("kind"), "id")


@query("SELECT DISTINCT 'part:' || l_partkey AS id, 'Part' AS label, p_size AS size FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_orderkey = 1")
def portable_traverse(g):
    return _space(g).query({"kind": "traverse", "startId": "order:1", "relType": "CONTAINS", "direction": "out", "depth": 1, "returnFields": ["size"]})


@query("SELECT 'order:' || o_orderkey AS id, 'Order' AS label, o_totalprice AS totalprice FROM (SELECT * FROM orders WHERE o_custkey = 1 ORDER BY 'order:' || o_orderkey LIMIT 5)")
def portable_traverse_order(g):
    """The limit takes the nearest, ties by id, before any order."""
    order = {"field": "totalprice", "direction": "DESC"}
    return _space(g).query({"kind": "traverse", "startId": "customer:1", "relType": "PLACED", "limit": 5, "orderBy": order, "returnFields": ["totalprice"]})


@query("SELECT n_name AS nation, r_name AS region FROM nation JOIN region ON r_regionkey = n_regionkey")
def portable_cypher(g):
    return _space(g).cypher("MATCH (n:Nation)-[:IN_REGION]->(r:Region) RETURN n.name AS nation, r.name AS region")


@query(
    "SELECT 'region:' || r_regionkey AS id, CASE WHEN r_regionkey = 1 THEN 'seen' END AS note FROM region WHERE r_regionkey <> 0"
    " UNION ALL SELECT 'r1', 'made' UNION ALL SELECT 'r2', 'changed' UNION ALL SELECT 'gone', 'false' UNION ALL SELECT 'none', 'None'"
)
def portable_crud(g):
    s = Store(g.spark).create_space("s", PropertyGraph(g.spark, {"region": g.nodes["region"]}))
    s.create_node("Region", {"regionId": "r1", "note": "made"})
    s.create_nodes("Region", [{"_id": "r2", "note": "made"}, {"_id": "r3"}])
    s.update_node("r2", {"note": "changed"})
    s.update_node("region:1", {"note": "seen"})
    s.delete_node("region:0")
    s.delete_node("r3")
    missing = [("gone", str(s.delete_node("r3")).lower()), ("none", str(s.update_node("r3", {"note": "x"})))]
    found = s.find_nodes("Region").select("id", "note")
    one = s.get_node("r2").select("id", "note")
    return found.where("id <> 'r2'").unionAll(one).unionAll(g.spark.createDataFrame(missing, "id string, note string"))


@query("SELECT 'unique' AS kind, 'customer:' || c_custkey AS id FROM customer QUALIFY count(*) OVER (PARTITION BY c_mktsegment) > 1 UNION ALL SELECT 'exists', 'doc:' || doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality IS NOT NULL)")
def portable_schema(g):
    rules = [{"label": "Customer", "property": "mktsegment", "type": "unique"}, {"label": "Document", "property": "quality", "type": "exists"}]
    broken = _space(g).init_schema({"constraints": rules, "indexes": [{"label": "Part", "properties": ["size", "brand"]}]})
    return reduce(DataFrame.unionAll, [rows.select(F.lit(name.split()[0]).alias("kind"), "id") for name, rows in broken.items()])


@query("SELECT 'region:' || r_regionkey AS id FROM region UNION ALL SELECT 'kept' UNION ALL SELECT 'within' UNION ALL SELECT 'GraphError'")
def portable_transactions(g):
    """What is committed stays, what is rolled back or breaks off goes, and a late commit is refused."""
    store = Store(g.spark)
    s = store.create_space("s", PropertyGraph(g.spark, {"region": g.nodes["region"]}))
    tx, late = store.begin("s"), store.begin("s")
    tx.create_node("Region", {"_id": "kept"})
    tx.commit()
    undone = store.begin("s")
    undone.create_node("Region", {"_id": "undone"})
    undone.rollback()
    with store.begin("s") as inner:
        inner.create_node("Region", {"_id": "within"})
    try:
        with store.begin("s") as inner:
            inner.create_node("Region", {"_id": "broken off"})
            inner.create_node("Region", {"_id": "kept"})
    except GraphError:
        pass
    late.create_node("Region", {"_id": "late"})
    return s.find_nodes("Region").select("id").unionAll(g.spark.createDataFrame([(_error(late.commit),)], "id string"))


@query(_table([("unknown kind", "GraphError"), ("unknown key", "GraphError"), ("unknown operator", "UnknownOperator"), ("no such space", "GraphError"), ("taken id", "GraphError"), ("no such end", "GraphError")], "what", "error"))
def portable_errors(g):
    store = Store(g.spark)
    s = store.create_space("s", PropertyGraph(g.spark, {"region": g.nodes["region"]}))
    tries = {
        "unknown kind": lambda: s.query({"kind": "walk"}),
        "unknown key": lambda: s.query({"kind": "match", "label": "Region", "sort": 1}),
        "unknown operator": lambda: s.find_nodes("Region", {"name": {"like": "x"}}),
        "no such space": lambda: store.space("t"),
        "taken id": lambda: s.create_node("Region", {"_id": "region:1"}),
        "no such end": lambda: s.create_relationship("region:1", "region:none", "NEXT_TO"),
    }
    return g.spark.createDataFrame([(what, _error(run)) for what, run in tries.items()], "what string, error string")


@query(_table([("before", "false"), ("connected", "true"), ("after", "false"), ("spaces", "1"), ("reset", "0")], "what", "value"))
def portable_connection(g):
    store = Store(g.spark)
    rows = [("before", store.health()["connected"])]
    store.connect()
    rows.append(("connected", store.health()["connected"]))
    store.disconnect()
    rows.append(("after", store.health()["connected"]))
    store.create_space("s")
    rows.append(("spaces", len(store.spaces())))
    store.reset()
    rows.append(("reset", len(store.spaces())))
    return g.spark.createDataFrame([(what, str(v).lower()) for what, v in rows], "what string, value string")


@query("SELECT 'east' AS space, (SELECT count(*) FROM customer) AS customers, 0::BIGINT AS parts UNION ALL SELECT 'west', 0, (SELECT count(*) FROM part)")
def space_isolation(g):
    store = Store(g.spark)
    for name, table in (("east", "customer"), ("west", "part")):
        store.create_space(name, PropertyGraph(g.spark, {table: g.nodes[table]}))
    rows = []
    for name in store.spaces():
        counts = [store.space(name).find_nodes(x).agg(F.count(F.lit(1)).alias(x)) for x in ("Customer", "Part")]
        rows.append(counts[0].join(counts[1]).select(F.lit(name).alias("space"), F.col("Customer").alias("customers"), F.col("Part").alias("parts")))
    return rows[0].unionAll(rows[1])


# -- updates --------------------------------------------------------------------------------


@query("SELECT 'region:' || r_regionkey AS id, r_name AS name FROM region UNION ALL SELECT 'region:new', 'ATLANTIS'")
def create_node(g):
    new, _ = mut.create_node(g, ["Region"], {"name": "ATLANTIS"}, "region:new")
    return find_nodes(new, "Region").select("id", "name")


@query("SELECT 'part:' || p_partkey AS id, p_brand AS brand, CASE WHEN p_size < 10 THEN 0 ELSE p_size END AS size, CASE WHEN p_size < 10 THEN 'small' END AS note FROM part")
def update_merge(g):
    new = mut.update_nodes(g, find_nodes(g, "Part", {"size": {"lt": 10}}).select("id"), {"size": 0, "note": "small"})
    return find_nodes(new, "Part").select("id", "brand", F.col("size").cast("int").alias("size"), "note")


@query("SELECT (SELECT count(*) FROM part WHERE p_size >= 10) AS parts, (SELECT count(*) FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_size >= 10) AS lines")
def delete_cascade(g):
    new = mut.delete_nodes(g, find_nodes(g, "Part", {"size": {"lt": 10}}).select("id"))
    parts = find_nodes(new, "Part").agg(F.count(F.lit(1)).alias("parts"))
    return parts.join(find_relationships(new, "CONTAINS").agg(F.count(F.lit(1)).alias("lines")))


@query("SELECT 'supplier:' || s_suppkey AS id FROM supplier WHERE s_acctbal < 0")
def add_label(g):
    new = mut.add_label(g, find_nodes(g, "Supplier", {"acctbal": {"lt": 0}}).select("id"), "Debtor")
    return matching_ids(new, None, ("Debtor",))


@query("SELECT 'customer:' || c_custkey AS id FROM customer WHERE c_acctbal >= 0 UNION ALL SELECT 'supplier:' || s_suppkey FROM supplier")
def remove_label(g):
    new = mut.remove_label(g, find_nodes(g, "Customer", {"acctbal": {"lt": 0}}).select("id"), "Party")
    return matching_ids(new, None, ("Party",))


@query("SELECT c_name AS name, CASE WHEN c_custkey % 2 = 0 THEN 0 ELSE c_acctbal END AS acctbal FROM customer UNION ALL SELECT 'Nobody', 1")
def upsert_nodes(g):
    even = find_nodes(g, "Customer").where(F.try_element_at(F.split("id", ":"), F.lit(2)).cast("long") % 2 == 0)
    items = even.select("name", F.lit(0.0).alias("acctbal")).unionAll(g.spark.createDataFrame([("Nobody", 1.0)], "name string, acctbal double"))
    return mut.upsert_node_frame(g, "customer", "name", items, "customer/").nodes["customer"].frame.select("name", "acctbal")


_REGIONS = "SELECT r_name AS name, CASE WHEN r_regionkey = 1 THEN 'seen' END AS note FROM region UNION ALL SELECT 'ATLANTIS', 'new'"


@query(_REGIONS)
def upsert_node(g):
    new, _ = mut.upsert_node(g, "Region", {"name": get_node(g, "region:1").first().name}, {"note": "seen"})
    new, _ = mut.upsert_node(new, "Region", {"name": "ATLANTIS"}, {"note": "new"})
    return find_nodes(new, "Region").select("name", "note")


@query(f"SELECT name, note, CASE WHEN note = 'seen' THEN 1 WHEN note = 'new' THEN 3 END::BIGINT AS place FROM ({_REGIONS})")
def upsert_node_list(g):
    """Many at once by a key; of two items with one key the later is merged over the earlier."""
    name = get_node(g, "region:1").first().name
    items = [{"name": name, "note": "seen", "place": 1}, {"name": "ATLANTIS", "note": "new", "place": 2}, {"name": "ATLANTIS", "place": 3}]
    return find_nodes(mut.upsert_nodes(g, "Region", "name", items)[0], "Region").select("name", "note", "place")


@query("SELECT 'planet:' || k AS id, n AS name, CASE WHEN k > 1 THEN 'planet:1' END AS neighbour, CASE WHEN k > 1 THEN k END AS place FROM (VALUES (1, 'Sun'), (2, 'Venus'), (3, 'Earth')) AS v(k, n)")
def batch_create(g):
    new, ids = mut.create_nodes(g, [(["Planet"], {"name": n}, f"planet:{k}") for k, n in enumerate(("Sun", "Venus", "Earth"), 1)])
    new, _ = mut.create_relationships(new, [(i, ids[0], "AROUND", {"place": k}) for k, i in enumerate(ids, 1) if k > 1])
    around = find_relationships(new, "AROUND").select(F.col("src").alias("id"), F.col("dst").alias("neighbour"), F.col("place").cast("int").alias("place"))
    return find_nodes(new, "Planet").select("id", "name").join(around, "id", "left")


@query("SELECT 'part:' || p_partkey AS src, 'brand:' || p_brand AS dst FROM part")
def bulk_frames(g):
    """Brands as nodes and what is of each brand as relationships, from whole frames."""
    parts = find_nodes(g, "Part").select("id", "brand")
    brands = parts.select(F.concat(F.lit("brand:"), "brand").alias("id"), F.col("brand").alias("name")).distinct()
    rels = parts.select(F.concat(F.lit("of:"), "id").alias("rel_id"), F.col("id").alias("src"), F.concat(F.lit("brand:"), "brand").alias("dst"))
    new = mut.add_rel_frame(mut.add_node_frame(g, "brand", brands, ["Brand"]), "OF_BRAND", rels)
    return neighbors(new, find_nodes(new, "Brand"), ["OF_BRAND"], "incoming").select(F.col("id").alias("src"), F.col("seed").alias("dst"))


@query(f"SELECT rel_id, CASE WHEN rel_id = 'cloc:1' THEN 2019 WHEN dst = 'nation:3' THEN 2020 END::BIGINT AS since FROM ({_LOCATED})")
def update_relationship(g):
    located = find_relationships(g, "LOCATED_IN").where("dst = 'nation:3'")
    new = mut.update_relationship(mut.update_relationships(g, located.select("rel_id"), {"since": 2020}), "cloc:1", {"since": 2019})
    return find_relationships(new, "LOCATED_IN").select("rel_id", "since")


@query(f"SELECT rel_id FROM ({_LOCATED}) WHERE dst <> 'nation:3' AND rel_id NOT IN ('cloc:1', 'sloc:1')")
def delete_relationship(g):
    located = find_relationships(g, "LOCATED_IN").where("dst = 'nation:3'")
    new = mut.delete_relationships(mut.delete_relationships(g, located.select("rel_id")), ["cloc:1", "sloc:1", "none"])
    return find_relationships(new, "LOCATED_IN").select("rel_id")


@query("SELECT 'cloc:1' AS kind, 2021::BIGINT AS since, 'a' AS note UNION ALL SELECT 'new', 2023, NULL")
def upsert_relationship_merged(g):
    """Merged into the one that is there, and created where there is none; then merged into that."""
    home = find_relationships(g, "LOCATED_IN").where("rel_id = 'cloc:1'").first()
    new, first = mut.upsert_relationship(g, home.src, home.dst, "LOCATED_IN", {"since": 2020, "note": "a"})
    new, _ = mut.upsert_relationship(new, home.src, home.dst, "LOCATED_IN", {"since": 2021})
    new, made = mut.upsert_relationship(new, "region:0", "nation:0", "LOCATED_IN", {"since": 2022})
    new, _ = mut.upsert_relationship(new, "region:0", "nation:0", "LOCATED_IN", {"since": 2023})
    kind = F.when(F.col("rel_id") == made, F.lit("new")).otherwise(F.col("rel_id")).alias("kind")
    return find_relationships(new, "LOCATED_IN").where(F.col("rel_id").isin(first, made)).select(kind, "since", "note")


@query("SELECT 'Mars' AS name, 2 AS moons")
def cypher_create_node(g):
    from .plans.cypher import run

    return find_nodes(run(g, "CREATE (p:Planet {name: 'Mars', moons: 2})").graph, "Planet").select("name", F.col("moons").cast("int").alias("moons"))


@query("SELECT (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier) + 1 AS n")
def upsert_relationship(g):
    new, _ = mut.upsert_relationship(g, "customer:1", "nation:1", "LOCATED_IN", {"since": 2020})
    taken = g.edges(["LOCATED_IN"]).where("src = 'customer:1' AND dst = 'nation:1'")
    again, _ = mut.upsert_relationship(new, "customer:1", "nation:1", "LOCATED_IN", {"since": 2021})
    extra = F.lit(0 if taken.isEmpty() else 1)
    return again.edges(["LOCATED_IN"]).agg((F.count(F.lit(1)) + extra).alias("n"))


@query("SELECT 'order:' || o_orderkey AS id, CASE WHEN o_totalprice > 300000 THEN 'X' ELSE o_orderstatus END AS status FROM orders")
def cypher_set(g):
    from .plans.cypher import run

    return find_nodes(run(g, "MATCH (o:Order) WHERE o.totalprice > 300000 SET o.status = 'X'").graph, "Order").select("id", "status")


@query("SELECT 'order:' || o_orderkey AS id FROM orders WHERE o_orderstatus <> 'F'")
def cypher_delete(g):
    from .plans.cypher import run

    return find_nodes(run(g, "MATCH (o:Order {status: 'F'}) DETACH DELETE o").graph, "Order").select("id")


@query("SELECT 'Mars' AS a, 'PLANET_OF' AS t, 'Sol' AS b, 4 AS place")
def cypher_create(g):
    from .plans.cypher import run

    new = run(g, "CREATE (p:Planet {name: 'Mars'})-[r:PLANET_OF {place: 4}]->(s:Star {name: 'Sol'})").graph
    found = cypher(new, "MATCH (p:Planet)-[r:PLANET_OF]->(s:Star) RETURN p.name AS a, r.place AS place, s.name AS b")
    return found.select("a", F.lit("PLANET_OF").alias("t"), "b", F.col("place").cast("int").alias("place"))


@query(
    "SELECT 'region:' || r_regionkey AS id, 'Region' AS label, r_name AS name, NULL::DOUBLE AS acctbal FROM region UNION ALL SELECT 'nation:' || n_nationkey, 'Nation', n_name, NULL FROM nation"
    " UNION ALL SELECT 'customer:' || c_custkey, 'Customer', c_name, c_acctbal FROM customer UNION ALL SELECT 'supplier:' || s_suppkey, 'Supplier', s_name, s_acctbal FROM supplier"
    " UNION ALL SELECT 'part:' || p_partkey, 'Part', p_name, NULL FROM part UNION ALL SELECT 'order:' || o_orderkey, 'Order', NULL, NULL FROM orders"
    " UNION ALL SELECT 'event:' || event_id, 'Event', NULL, NULL FROM events UNION ALL SELECT 'doc:' || doc_id, 'Document', NULL, NULL FROM documents"
)
def hydrate_ids_all(g):
    return plain(hydrate(g, all_nodes(g).select("id")), ["name", "acctbal"])


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
