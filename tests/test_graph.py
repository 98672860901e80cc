import pytest

from arcweft.functions.predicates import UnknownOperator
from arcweft.operators import algorithms as alg
from arcweft.operators import mutate as m
from arcweft.operators.expand import neighbors, relationships_of
from arcweft.operators.scan import all_nodes, find_nodes, find_relationships, get_node, has_label, hydrate, stats
from arcweft.operators.traversal import traverse
from arcweft.sources.model import GraphError, PropertyGraph
from arcweft.sources.storage import keys, load, save, versions
from graphs import build, letters, people, values


@pytest.fixture(scope="module")
def crowd(spark):
    return people(spark)


@pytest.mark.parametrize(
    ("where", "names"),
    [
        ({}, {"Alice", "Bob", "Charlie"}),
        ({"age": {"neq": 30}}, {"Bob", "Charlie"}),
        ({"age": {"$gt": 30}}, {"Charlie"}),
        ({"age": {"gte": 30}}, {"Alice", "Charlie"}),
        ({"age": {"lt": 30}}, {"Bob"}),
        ({"age": {"lte": 30}}, {"Alice", "Bob"}),
        ({"city": {"in": ["NYC", "SF"]}}, {"Alice", "Charlie"}),
        ({"name": {"contains": "arlie"}}, {"Charlie"}),
        ({"name": {"startsWith": "Al"}}, {"Alice"}),
        ({"name": {"endsWith": "ice"}}, {"Alice"}),
        ({"city": {"exists": True}}, {"Alice", "Bob", "Charlie"}),
        ({"age": {"gte": 30}, "city": "NYC"}, {"Alice", "Charlie"}),
        ({"age": {"gt": 25, "lt": 35}}, {"Alice"}),
        ({"age": "30"}, set()),
        ({"nothing": {"neq": 1}}, {"Alice", "Bob", "Charlie"}),
        ({"nothing": {"gt": 1}}, set()),
        ({"age": {"contains": 3}}, {"Alice", "Charlie"}),
    ],
)
def test_filters(crowd, where, names):
    assert set(values(find_nodes(crowd, "Person", where), "name")) == names


def test_missing_and_null(spark, crowd):
    assert find_nodes(crowd, "Company", {"city": {"exists": False}}).count() == 1
    g = build(spark, {"x": (["P"], {"optional": None, "k": 1}), "y": (["P"], {"optional": "v"})})
    assert values(find_nodes(g, "P", {"optional": None}), "id") == ["x"]
    assert values(find_nodes(g, "P", {"optional": {"neq": "v"}}), "id") == ["x"]


def test_strict_types_in_one_property(spark):
    g = build(spark, {"s": (["D"], {"value": "123"}), "n": (["D"], {"value": 123}), "b": (["D"], {"value": True}), "l": (["D"], {"value": [1, "a"]})})
    for value, id in (("123", "s"), (123, "n"), (True, "b")):
        assert values(find_nodes(g, "D", {"value": value}), "id") == [id]


def test_unknown_operator_is_refused(crowd):
    with pytest.raises(UnknownOperator):
        find_nodes(crowd, "Person", {"age": {"$gtt": 3}})


def test_scans(crowd):
    assert all_nodes(crowd).count() == 4
    assert get_node(crowd, "alice").first().name == "Alice"
    assert get_node(crowd, "nobody").isEmpty()
    assert find_relationships(crowd, "KNOWS", {"since": {"gte": 2020}}).count() == 2
    assert stats(crowd).first()[:] == (4, 4, 0)
    assert has_label(crowd, "acme", "Company").first()[0] and not has_label(crowd, "none", "Company").first()[0]
    assert values(keys(crowd, "n:", 2, reverse=True), "key") == ["n:bob", "n:charlie"]


def test_neighbours_count_relationships(spark):
    g = build(spark, {"a": (["N"], {}), "b": (["N"], {})}, [("a", "b", "T"), ("a", "b", "T"), ("a", "a", "T"), ("b", "a", "U")])
    assert values(neighbors(g, "a", None, "outgoing"), "id") == ["a", "b", "b"]
    assert values(neighbors(g, "a"), "id") == ["a", "a", "b", "b", "b"]
    assert values(neighbors(g, "a", ["U"], "incoming"), "id") == ["b"]
    assert relationships_of(g, "b", ["U"]).count() == 1


def test_traversals(spark):
    chain = letters(spark, "AB BC CD")
    for depth in (1, 2, 3):
        assert traverse(chain, "A").outgoing("KNOWS").depth(depth).collect().count() == depth
    assert traverse(chain, "A").outgoing("KNOWS").depth(3).limit(2).collect().count() == 2
    assert traverse(chain, "A").outgoing().limit(0).collect().isEmpty()
    assert traverse(chain, "A").collect().isEmpty()
    assert traverse(chain, "?").outgoing().collect().isEmpty()
    assert values(traverse(chain, "B").both().collect(), "id") == ["A", "C"]
    paths = sorted(r.nodes for r in traverse(chain, "A").outgoing().depth(2).paths().collect())
    assert paths == [["A", "B"], ["A", "B", "C"]]
    with pytest.raises(ValueError, match="step"):
        traverse(chain, "A").where({})


def test_cycles(spark):
    ring = letters(spark, "AB BC CA")
    assert values(traverse(ring, "A").outgoing().depth(10).unique().collect(), "id") == ["B", "C"]
    assert sorted((r.hop, r.id) for r in traverse(ring, "A").outgoing().depth(4).collect().collect()) == [(1, "B"), (2, "C"), (3, "A"), (4, "B")]
    nodes, rels = traverse(ring, "A").outgoing().depth(2).subgraph()
    assert values(nodes, "id") == ["A", "B", "C"] and rels.count() == 2
    assert traverse(ring, "A").outgoing().depth(5).unique().paths().count() == 2


def test_counts_are_multiplicities(spark):
    g = letters(spark, "AB AC BD CD")
    rows = {(r.id, r.hop): r.walks for r in traverse(g, "A").outgoing().depth(2).counts().collect()}
    assert rows == {("B", 1): 1, ("C", 1): 1, ("D", 2): 2}


def test_step_filters(spark, crowd):
    t = traverse(crowd, "alice").outgoing("KNOWS")
    assert values(t.where({"age": {"gte": 30}}).nodes(), "name") == ["Charlie"]
    assert values(t.where({"name": "none"}).where({"age": {"lt": 30}}).nodes(), "name") == ["Bob"]
    # a rejected node isn't visited: a later step may reach it
    g = build(spark, {"s": (["N"], {"k": 0}), "a": (["N"], {"k": 1}), "b": (["N"], {"k": 2})}, [("s", "a", "T"), ("s", "b", "T"), ("a", "b", "T")])
    found = traverse(g, "s").outgoing("T").where({"k": 1}).outgoing("T").unique().collect()
    assert sorted((r.hop, r.id) for r in found.collect()) == [(1, "a"), (2, "b")]
    _, rels = traverse(g, "s").outgoing("T").where({"k": 1}).subgraph()
    assert rels.count() == 2  # recorded before the filter


def test_shortest_paths(spark):
    g = letters(spark, "AB BD AC CE ED")
    assert alg.shortest_path(g, "A", "D", direction="outgoing").first().nodes == ["A", "B", "D"]
    assert alg.shortest_path(g, "A", "A").first().length == 0
    assert alg.shortest_path(g, "A", "D", max_depth=1).isEmpty()
    assert alg.shortest_path(g, "D", "A", direction="outgoing").isEmpty()
    assert alg.shortest_path(g, "D", "A", direction="incoming").first().length == 2
    assert alg.shortest_path(g, "?", "A").isEmpty()
    assert {(r.id, r.hops) for r in alg.hop_distances(g, "A", direction="outgoing").collect()} == {("A", 0), ("B", 1), ("C", 1), ("D", 2), ("E", 2)}


def test_cheapest_paths(spark):
    rels = [("A", "B", "R", {"w": 1}), ("B", "D", "R", {"w": 1}), ("A", "C", "R", {"w": 10}), ("C", "D", "R", {"w": 1}), ("A", "D", "R", {"w": 9})]
    g = build(spark, {x: (["N"], {}) for x in "ABCD"}, rels)
    row = alg.shortest_path(g, "A", "D", cost="w", direction="outgoing").first()
    assert (row.nodes, row.length, row.cost) == (["A", "B", "D"], 2, 2.0)
    assert alg.shortest_path(g, "A", "D", cost="none", direction="outgoing").first().nodes == ["A", "D"]  # each costs 1
    near = alg.cheapest_distances(g, "A", "w", direction="outgoing", max_depth=1)
    assert {(r.id, r.cost) for r in near.collect()} == {("A", 0.0), ("B", 1.0), ("C", 10.0), ("D", 9.0)}
    with pytest.raises(ValueError, match="below 0"):
        alg.cheapest_distances(build(spark, {"A": ([], {})}, [("A", "A", "R", {"w": -1})]), "A", "w")


def test_neighbourhood(spark):
    nodes = {x: (["N"], {"age": a}) for x, a in zip("ABCDE", (20, 40, 35, 25, 50), strict=True)}
    g = build(spark, nodes, [("B", "A", "K"), ("A", "C", "K"), ("A", "D", "K"), ("D", "E", "K")])
    for depth, n, r in ((1, 4, 3), (2, 5, 4)):
        found, rels = alg.neighborhood(g, "A", depth)
        assert (found.count(), rels.count()) == (n, r)
    assert values(alg.neighborhood(g, "A", 1, direction="outgoing")[0], "id") == ["A", "C", "D"]
    assert values(alg.neighborhood(g, "A", 1, node_filter={"age": {"gte": 30}})[0], "id") == ["A", "B", "C"]
    assert alg.neighborhood(g, "?", 2)[0].isEmpty()


def test_components_and_ranks(spark):
    g = letters(spark, "AB BC DE")
    assert {r.id: r.component for r in alg.connected_components(g).collect()} == {"A": "A", "B": "A", "C": "A", "D": "D", "E": "D"}
    ranks = {r.id: r["rank"] for r in alg.page_rank(letters(spark, "AB CB"), 5).collect()}
    assert ranks["B"] > ranks["A"] and abs(sum(ranks.values()) - 3) < 1e-6


def test_updates_make_new_graphs(spark, crowd):
    new = m.update_node(crowd, "bob", {"age": 26, "note": "x"})
    assert get_node(new, "bob").first().asDict()["age"] == 26 and get_node(new, "bob").first().city == "LA"
    assert get_node(crowd, "bob").first().age == 25
    with pytest.raises(GraphError):
        m.update_node(crowd, "none", {})
    with pytest.raises(GraphError):
        m.create_node(crowd, ["Person"], {}, "bob")
    with pytest.raises(GraphError, match="nowhere"):
        m.create_relationship(crowd, "bob", "nowhere", "T")
    gone = m.delete_node(crowd, "alice")
    assert stats(gone).first()[:] == (3, 1, 0) and m.delete_node(gone, "alice")
    labelled = m.add_label(crowd, "bob", "Admin")
    assert values(find_nodes(labelled, "Admin"), "id") == ["bob"]
    assert find_nodes(m.remove_label(labelled, "bob", "Admin"), "Admin").isEmpty()
    rel = find_relationships(crowd, "WORKS_ON").first().rel_id
    assert find_relationships(m.update_relationship(crowd, rel, {"h": 3}), "WORKS_ON").first().h == 3
    assert find_relationships(m.delete_relationships(crowd, [rel]), "WORKS_ON").isEmpty()


def test_self_loop_counts_once(spark):
    g = build(spark, {"a": (["N"], {}), "b": (["N"], {})}, [("a", "a", "T"), ("a", "b", "T")])
    assert stats(m.delete_node(g, "a")).first()[:] == (1, 0, 0)


def test_upserts(spark, crowd):
    g, id = m.upsert_node(crowd, "Person", {"name": "Bob"}, {"age": 50})
    assert id == "bob" and get_node(g, "bob").first().age == 50
    g, id = m.upsert_node(g, "Person", {"name": "Zoe"}, {"age": 1})
    assert get_node(g, id).first().name == "Zoe"
    g, ids = m.upsert_nodes(g, "Person", "name", [{"name": "Bob", "age": 1}, {"name": "Bob", "city": "SF"}, {"name": "New"}])
    row = get_node(g, "bob").first()
    assert ids[0] == "bob" and (row.age, row.city) == (1, "SF") and len(ids) == 2
    g, a = m.upsert_relationship(g, "alice", "bob", "KNOWS", {"since": 1})
    g, b = m.upsert_relationship(g, "alice", "bob", "KNOWS", {"since": 2})
    assert a == b and find_relationships(g, "KNOWS").count() == 3


def test_transactions(crowd):
    kept, _, error = m.in_transaction(crowd, lambda g: (m.delete_node(g, "bob"), m.update_node(g, "none", {}))[:2])
    assert kept is crowd and isinstance(error, GraphError)
    new, id, error = m.in_transaction(crowd, lambda g: m.create_node(g, ["P"], {}))
    assert error is None and get_node(new, id).count() == 1


def test_save_and_load(spark, tmp_path):
    nodes = {
        "foundation/auth:createAuthProvider": (["Function"], {"text": "日本 😀", "big": 2**53 - 1}),
        "4:uuid:2072": (["A", "B", "C"], {"list": [1, "two", True, None]}),
        "with space": (["with space", "A"], {"deep": {"a": {"b": [1]}}}),
        "A": (["A"], {"a key.with/all:": 1}),
        "bare": ([], {}),
    }
    g = build(spark, nodes, [("A", "4:uuid:2072", "IN:SIDE", {"p": -0.0})])
    path = str(tmp_path / "g")
    save(g, path)
    again = load(spark, path)
    assert sorted(map(str, all_nodes(again).collect())) == sorted(map(str, all_nodes(g).collect()))
    assert find_nodes(again, "A").count() == 3 and find_relationships(again, "IN:SIDE").count() == 1
    assert values(find_nodes(again, "A", {"a key.with/all:": 1}), "id") == ["A"]
    save(m.delete_node(again, "A"), path)
    assert len(versions(spark, path)) == 2 and find_nodes(load(spark, path), "A").count() == 2
    assert find_nodes(load(spark, path, versions(spark, path)[0]), "A").count() == 3


def test_known_ids_reach_the_scan(spark, tmp_path, crowd):
    save(crowd, str(tmp_path / "g"))
    g = load(spark, str(tmp_path / "g"))

    def plan(frame):
        return frame._jdf.queryExecution().executedPlan().toString().replace("\n", " ")

    assert "PushedFilters: [In(src, [alice,bob])" in plan(neighbors(g, ["alice", "bob"], ["KNOWS"], "outgoing"))
    assert "In(src, [alice,bob])" in plan(traverse(g, ["alice", "bob"]).outgoing("KNOWS").collect())
    assert "EqualTo(id,bob)" in plan(get_node(g, "bob"))
    scan = plan(find_nodes(g, "Person", {"age": {"gte": 30}}).select("id"))
    assert "GreaterThanOrEqual(age,30)" in scan and "ReadSchema: struct<id:string,age:bigint>" in scan
    assert values(traverse(g, ["alice", "bob"]).outgoing("KNOWS").collect(), "id") == ["bob", "charlie", "charlie"]


def test_validation_and_constraints(spark):
    frame = spark.createDataFrame([("a", "x"), ("a", "x"), ("b", None)], "id string, email string")
    rels = spark.createDataFrame([("r", "a", "z")], "rel_id string, src string, dst string")
    g = PropertyGraph(spark).with_nodes("n", frame, ["N"]).with_rels("T", rels)
    assert {(r.problem, r.n) for r in g.validate().collect()} == {("duplicate node id", 1), ("missing dst", 1)}
    assert neighbors(g, "b").isEmpty() and neighbors(g, "a", None, "outgoing").isEmpty()  # no node z
    assert values(g.ensure("N", "email", "exists"), "id") == ["b"]
    assert g.ensure("N", "email", "unique").count() == 2
    with pytest.raises(GraphError, match="table"):
        m.add_node_frame(g, "n", frame, ["N"])


def test_hydrate_keeps_repeats(spark, crowd):
    ids = spark.createDataFrame([("bob", 1), ("bob", 2), ("none", 3)], "id string, k int")
    assert sorted((r.k, r.name) for r in hydrate(crowd, ids).collect()) == [(1, "Bob"), (2, "Bob")]


def test_hydrate_keeps_properties_of_the_frames_names(spark):
    g = build(spark, {"a": (["N"], {"hop": 7}), "b": (["N"], {"hop": 41, "seed": "own", "Hop_": 3}) }, [("a", "b", "R")])
    row = traverse(g, "a").outgoing("R").nodes().first().asDict()
    assert (row["hop"], row["seed"], row["Hop_"]) == (41, "own", 3)
    assert (row["hop__"], row["seed_"]) == (1, "a")


def test_upserting_many_keeps_what_an_item_does_not_name(spark):
    g = build(spark, {"a": (["N"], {"k": 1, "v": 1, "w": 1}), "b": (["N"], {"k": 2, "v": 2, "w": 2})})
    new, ids = m.upsert_nodes(g, "N", "k", [{"k": 1, "v": 10}, {"k": 2, "w": None}, {"k": 3, "v": 3.5}])
    assert ids[:2] == ["a", "b"]
    assert sorted((r.k, r.v, r.w) for r in find_nodes(new, "N").collect() if r.k < 3) == [(1, 10, 1), (2, 2, None)]
    assert find_nodes(new, "N", {"k": 3}).first().v == 3.5


def test_algorithms_by_name(spark):
    g = letters(spark, "AB BC")
    assert alg.run_algorithm(g, "connected_components").count() == 3
    with pytest.raises(GraphError):
        alg.run_algorithm(g, "none")
    with pytest.raises(GraphError):
        alg.register("page_rank", lambda graph: graph.vertices())
