"""Queries over whole tables: nothing is left out as a seed."""

from arcweft import catalogue

SF = "/root/testdata/sf0.001"


def test_every_node_is_a_seed(spark):
    read = lambda t: spark.read.parquet(f"{SF}/{t}.parquet")
    run = lambda name: catalogue.queries()[name](spark, SF)
    buyers = {f"customer:{r[0]}" for r in read("orders").select("o_custkey").distinct().collect()}
    assert {r.seed for r in run("bfs_path_length_all").select("seed").distinct().collect()} == buyers
    assert {r.path.split(">")[0] for r in run("bfs_paths_all").collect()} == buyers
    users = read("events").select("user_id").distinct().count()
    assert run("weighted_path_cost_all").select("seed").distinct().count() == users
    n = read("events").count()
    assert run("traverse_paths_all").where("length = 1").count() == n - users
    assert run("hydrate_ids_all").count() == run("all_nodes_dedup").first().n


def test_components_of_the_whole_graph(spark):
    run = lambda name: catalogue.queries()[name](spark, SF)
    above: dict[str, str] = {}

    def top(x):
        while above.setdefault(x, x) != x:
            x = above[x]
        return x

    from arcweft.sources.star import star_graph

    g = star_graph(spark, SF)
    for r in g.edges(None).select("src", "dst").distinct().collect():
        a, b = sorted((top(r.src), top(r.dst)))
        above[b] = a
    found = run("ext_connected_components_all").collect()
    assert len(found) == run("all_nodes_dedup").first().n
    assert all(r.component == top(r.id) for r in found)
