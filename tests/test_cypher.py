import pytest

from arcweft.operators.scan import find_nodes, find_relationships, stats
from arcweft.plans import strict
from arcweft.plans.cypher import QueryRefused, parse, run
from arcweft.plans.portable import Store
from arcweft.sources.model import GraphError, PropertyGraph
from graphs import build, people, values


@pytest.fixture(scope="module")
def crowd(spark):
    return people(spark)


@pytest.mark.parametrize(
    ("query", "n"),
    [
        ("MATCH (p:Person) RETURN p", 3),
        ("match (p:Person) where p.age > 28 return p", 2),
        ("MATCH (p:Person) WHERE p.age > 28 AND p.city = 'NYC' RETURN p", 2),
        ("MATCH (p:Person) WHERE p.age > 20 AND p.age < 30 RETURN p", 1),
        ("MATCH (p:Person {name: 'Alice'})-[:KNOWS]->(q:Person) RETURN q", 2),
        ("MATCH (p:Person {name: 'Alice'})-[k:KNOWS {since: 2020}]->(q) RETURN q", 1),
        ("MATCH (p:Person)-[k:KNOWS]->(q) WHERE k.since >= 2020 RETURN q", 2),
        ("MATCH (p:Person) RETURN p LIMIT 2", 2),
        ("MATCH (p:Person) RETURN p LIMIT 0", 0),
        ("MATCH (p)-[:WORKS_ON]->(c:Company) RETURN p", 1),
        ("MATCH (c:Company)<-[:WORKS_ON]-(p) RETURN p", 1),
        ("MATCH (a {name: 'Bob'})-[:KNOWS]-(b) RETURN b", 2),
        ("MATCH (n) RETURN n", 4),
        ("MATCH (p:Person)", 3),
        ("MATCH (p:Person)-[k:KNOWS]->(q) LIMIT 2", 2),
        ("MATCH (a)-[]->(b)-[]->(c) RETURN a", 1),
        ("MATCH (a)-[:KNOWS]->(b)-[:KNOWS]->(a) RETURN a", 0),
        ("MATCH (p:Person) WHERE p.name IN ['Bob', 'Zoe'] RETURN p", 1),
        ("MATCH (p:Person) WHERE p.city IS NOT NULL RETURN p SKIP 1", 2),
        ("MATCH (p:Nobody) RETURN p.name", 0),
        ("MATCH (p:Person)-[:NOTHING]->(q) RETURN q.name", 0),
    ],
)
def test_match(crowd, query, n):
    assert run(crowd, query).rows.count() == n


def test_projection(crowd):
    row = run(crowd, "MATCH (n:Person {name: 'Alice'}) RETURN n.name, n.age AS years").rows.first()
    assert row["n.name"] == "Alice" and row.years == 30
    rows = run(crowd, "MATCH (a:Person)-[r:KNOWS]->(b) RETURN r, b ORDER BY b.name").rows
    with_rel = run(crowd, "MATCH (a:Person {name: 'Bob'})-[r:KNOWS]->(b) RETURN r, b").rows.first()
    assert rows.count() == 3 and with_rel.r.type == "KNOWS" and with_rel.r.since == 2021 and with_rel.b.labels == ["Person"]
    counted = run(crowd, "MATCH (p:Person) RETURN p.city AS city, count(*) AS n, avg(p.age) AS age, count(DISTINCT p.city) AS c ORDER BY city").rows
    assert [tuple(r) for r in counted.collect()] == [("LA", 1, 25.0, 1), ("NYC", 2, 32.5, 1)]


def test_text_with_keywords_is_text(spark):
    g = build(spark, {"x": (["T"], {"s": "it's, WHERE (a) RETURN b"})})
    assert run(g, """MATCH (t:T) WHERE t.s = "it's, WHERE (a) RETURN b" RETURN t.s""").rows.count() == 1


@pytest.mark.parametrize(
    "query",
    [
        "", "RETURN 1", "MATCH (:Person)", "MATCH (n:Person) RETURN m", "MATCH (n) WHERE n.a = 1 OR n.b = 2 RETURN n",
        "MATCH (n) WHERE NOT n.a = 1 RETURN n", "MATCH (a), (b) RETURN a", "MATCH (a)-->(b) RETURN a", "MATCH (a)-[*1..3]->(b) RETURN b",
        "MATCH (a) MATCH (b) RETURN a", "OPTIONAL MATCH (a) RETURN a", "MATCH (a) WITH a RETURN a", "MATCH (n {k: $p}) RETURN n",
        "MATCH (n:P) SET n.a = 1 DELETE n", "CREATE (a)-[:R|S]->(b)", "MATCH (n:P) SET m.a = 1", "MATCH (n:P) DELETE m", "CREATE (a), (b)",
        "MATCH (n) WHERE n.a = raw RETURN n", "MATCH (n) RETURN foo(n)", "MATCH (n:P) RETURN n LIMIT x", "MATCH (a)<-[:R]->(b) RETURN a",
        "MATCH (n:P) RETURN n UNION MATCH (m) RETURN m", "MERGE (n:P)", "MATCH (n) WHERE m.a = 1 RETURN n", "MATCH (a:A|B) RETURN a",
    ],
)
def test_refusals(crowd, query):
    with pytest.raises(QueryRefused):
        run(crowd, query)


def test_direction_and_types():
    tree = parse("MATCH (a)<-[r:knows|:likes]-(b:B:C) RETURN a")
    rel, node = tree.pattern.hops[0]
    assert rel.direction == "incoming" and rel.types == ("knows", "likes") and node.labels == ("B", "C")


def test_updates(spark):
    made = run(PropertyGraph(spark), "CREATE (a:Person {name: 'Ann', age: 30})-[k:KNOWS {since: 2020}]->(b:Person {name: 'Ben'})")
    assert made.rows.first().a.name == "Ann" and made.rows.columns == ["a", "b", "k"]
    g = made.graph
    assert stats(g).first()[:] == (2, 1, 0)
    done = run(g, "MATCH (p:Person) WHERE p.name = 'Ann' SET p.age = 31, p.note = 'x'")
    assert done.rows.count() == 1 and find_nodes(done.graph, "Person", {"age": 31, "note": "x"}).count() == 1
    done = run(g, "MATCH (p:Person {name: 'Ann'}) SET p.age = 33 RETURN p.age AS age, p.name AS name LIMIT 1")
    assert tuple(done.rows.first()) == (33, "Ann")
    assert run(g, "MATCH (a)-[k:KNOWS]->(b) SET a.age = 3").rows.columns == ["a", "k", "b"]
    plain = run(PropertyGraph(spark), "CREATE (:A)-[]-(:B)")
    assert plain.rows.columns == ["start", "end", "rel"] and plain.graph.types == ("RELATED_TO",)
    assert run(PropertyGraph(spark), "CREATE (:A {k: 1})").rows.columns == ["node"]
    done = run(g, "MATCH (a)-[k:KNOWS]->(b) SET k.since = 1")
    assert find_relationships(done.graph, "KNOWS").first().since == 1
    assert find_relationships(run(g, "MATCH (a)-[k:KNOWS]->(b) DELETE k").graph, "KNOWS").isEmpty()
    assert stats(run(g, "MATCH (p:Person {name: 'Ann'}) DETACH DELETE p").graph).first()[:] == (1, 0, 0)


def test_strict_slice_agrees(crowd):
    answer = strict.execute(crowd, "MATCH (n:Person) RETURN n AS who")
    assert {r.who.id for r in answer.records.collect()} == {r.n.id for r in run(crowd, "MATCH (n:Person) RETURN n").rows.collect()}
    assert "Person" in answer.summary["plan"]


@pytest.mark.parametrize(
    "query",
    [
        "MATCH (a:A)-[:R]->(b:B) RETURN a", "MATCH (a:A) WHERE a.x = 1 RETURN a", "MATCH (a:A {x: 1}) RETURN a", "MATCH (a:A) RETURN $x",
        "MATCH (a:A) RETURN a.x", "MATCH (a) RETURN a", "MATCH (a:A) RETURN a, a", "MATCH (a:A) RETURN a LIMIT 1", "MATCH (a:A) RETURN b", "",
    ],
)
def test_strict_refusals(crowd, query):
    with pytest.raises(QueryRefused):
        strict.execute(crowd, query)


def test_spaces(spark):
    store = Store(spark)
    store.connect()
    a, b = store.create_space("a"), store.create_space("b")
    one = a.create_node("Person", {"personId": "p1", "name": "Alice", "age": 30, "city": "NYC"})
    a.create_nodes("Person", [{"_id": "p2", "name": "Bob", "age": 25, "city": "LA"}, {"_id": "p3", "name": "Charlie", "age": 35, "city": "NYC"}])
    b.create_node("Person", {"name": "Other"})
    assert one == "p1" and a.find_nodes("Person").count() == 3 and b.find_nodes("Person").count() == 1
    assert b.get_node("p1").isEmpty() and b.update_node("p1", {}) is None and not b.delete_node("p1")
    q = {"kind": "match", "label": "Person"}
    assert a.query(q | {"where": {"city": "NYC"}}).count() == 2
    assert [r.name for r in a.query(q | {"orderBy": {"field": "age", "direction": "DESC"}}).collect()] == ["Charlie", "Alice", "Bob"]
    assert [r.name for r in a.query(q | {"orderBy": {"field": "age"}, "limit": 1}).collect()] == ["Bob"]
    assert a.query(q | {"returnFields": ["name"]}).columns == ["id", "label", "name"]
    with pytest.raises(GraphError):
        a.query({"kind": "path"})
    with pytest.raises(GraphError):
        a.query({"kind": "traverse", "startId": "p1", "endLabel": "X"})
    a.create_relationships([("p1", "p2", "KNOWS"), ("p1", "p3", "KNOWS"), ("p2", "p3", "KNOWS")])
    assert values(a.traverse("p1", "KNOWS", "out", depth=2), "id") == ["p2", "p3"]
    assert values(a.traverse("p1", "KNOWS", where={"age": {"gt": 28}}), "name") == ["Charlie"]
    assert a.traverse("p1", "KNOWS", limit=1).count() == 1
    assert a.relationships("p2", "in", "KNOWS").count() == 1
    assert a.cypher("MATCH (p:Person {name: 'Alice'})-[:KNOWS]->(q) RETURN q").count() == 2
    assert store.counts() == {"a": (3, 3), "b": (1, 0)} and store.has_feature("upsert") and store.health()["connected"]
    broken = a.init_schema({"constraints": [{"label": "Person", "property": "city", "type": "unique"}], "indexes": [{"label": "Person", "properties": ["age"]}]})
    assert values(broken["unique Person.city"], "id") == ["p1", "p3"]
    store.drop_space("b")
    assert store.spaces() == ["a"]


def test_store_transactions(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    s = store.create_space("s")
    s.create_node("P", {"_id": "x"})
    tx = store.begin("s")
    tx.create_node("P", {"_id": "y"})
    assert s.find_nodes("P").count() == 1 and tx.find_nodes("P").count() == 2
    tx.rollback()
    with store.begin("s") as tx:
        tx.upsert_node("P", {"k": 1}, {"v": 2})
    assert s.find_nodes("P").count() == 2
    late = store.begin("s")
    s.delete_node("x")
    with pytest.raises(GraphError, match="changed"):
        late.commit()
    store.disconnect()
    assert Store(spark, store.path).open_space("s").find_nodes("P").count() == 1
